"""Places, shade, existing stock and the before/after effect on the canonical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from streetgrove.functions import geom, rulebook, sun
from streetgrove.operators import graph, quality as Q, spatial
from streetgrove.plans import checksql as S
from streetgrove.plans.queries.quality import covered_crowns, plan, split_curb
from streetgrove.plans.registry import Tables, query

FOOT_T = "greatest(0.0e0, least(1.0e0, case when (e.x2-e.x1)*(e.x2-e.x1)+(e.y2-e.y1)*(e.y2-e.y1)=0 then 0.0e0 else ((p.x-e.x1)*(e.x2-e.x1)+(p.y-e.y1)*(e.y2-e.y1))/((e.x2-e.x1)*(e.x2-e.x1)+(e.y2-e.y1)*(e.y2-e.y1)) end))"
ORI = lambda a, b, c, d, e, f: f"(({c}-{a})*({f}-{b})-({d}-{b})*({e}-{a}))"
CROSS = f"""{ORI('n.x','n.y','n.fx','n.fy','b.x1','b.y1')}*{ORI('n.x','n.y','n.fx','n.fy','b.x2','b.y2')}<0 and {ORI('b.x1','b.y1','b.x2','b.y2','n.x','n.y')}*{ORI('b.x1','b.y1','b.x2','b.y2','n.fx','n.fy')}<0"""
PLACE = f"""zin as (select p.site_id, p.point_id, z.feature_id, z.object_class from points p join zone_edges z on z.site_id=p.site_id where ((z.y1>p.y)<>(z.y2>p.y)) and p.x < z.x1+(p.y-z.y1)/(z.y2-z.y1)*(z.x2-z.x1) group by all having count(*)%2=1),
zoned as (select point_id, arg_min(object_class, feature_id) as zone from zin where object_class in ('territory.street','territory.yard','territory.square','territory.park') group by all),
nr0 as (select p.site_id, p.point_id, p.x, p.y, min(row({S.seg_dist(s='e')}, e.feature_id, e.x1, e.y1, e.x2, e.y2)) as n from points p join road_edges e on e.site_id=p.site_id group by all),
nr as (select p.site_id, p.point_id, p.x, p.y, p.n[1] as d, e.x1+{FOOT_T}*(e.x2-e.x1) as fx, e.y1+{FOOT_T}*(e.y2-e.y1) as fy from nr0 p, lateral (select p.n[3] as x1, p.n[4] as y1, p.n[5] as x2, p.n[6] as y2) e),
hid as (select distinct n.point_id from nr n join segments b on b.site_id=n.site_id and b.object_class='building' where {CROSS}),
plc as (select p.site_id, p.point_id, case when z.zone is not null and z.zone<>'territory.street' then substring(z.zone, 11) when n.d<=10 then 'roadside'
    when h.point_id is not null and z.zone is null then 'yard' else 'street' end as place
  from points p left join nr n using(point_id) left join zoned z using(point_id) left join hid h using(point_id))"""
ZONED_IN, PLACE_AFTER_ZONES = PLACE.split("\nzoned", 1)
ZONED_IN, PLACE_AFTER_ZONES = ZONED_IN.rstrip(","), "zoned" + PLACE_AFTER_ZONES
PLACE_USES = ("points", "zone_edges", "road_edges", "segments")


def place_classify_frame(t: Tables):
    """Zoning first, then the carriageway within 10 m, then yard behind a building, else street."""
    points = t.points.select("site_id", "point_id", "x", "y")
    zones = spatial.lowest_areas(points, t.zone_edges)
    kinds = ("territory.street", "territory.yard", "territory.square", "territory.park")
    zoned = zones.where(F.col("object_class").isin(*kinds)).groupBy("site_id", "point_id").agg(F.min_by("object_class", "feature_id").alias("zone"))
    near = spatial.nearest_segment(points, t.road_edges, (30.0, 250.0))
    fx, fy = spatial.foot()
    sight = points.join(near, ["site_id", "point_id"]).select("site_id", "point_id", "distance", F.col("x").alias("ax"), F.col("y").alias("ay"), fx.alias("bx"), fy.alias("by"))
    hidden = spatial.crossing_segments(sight, t.segments.where(F.col("object_class") == "building"), key=("point_id",)).withColumn("hidden", F.lit(True))
    place = (
        F.when(F.col("zone").isNotNull() & (F.col("zone") != "territory.street"), F.expr("substring(zone, 11)")).when(F.col("distance") <= 10, "roadside")
        .when(F.col("hidden") & F.col("zone").isNull(), "yard").otherwise("street")
    )
    rows = points.select("site_id", "point_id").join(sight.select("site_id", "point_id", "distance"), ["site_id", "point_id"], "left").join(zoned, ["site_id", "point_id"], "left").join(hidden, "point_id", "left")
    return rows.select("site_id", "point_id", place.alias("place"))


@query("place_classify", uses=PLACE_USES, extra=PLACE, sql="select site_id, point_id, place from plc")
def place_classify(t):
    return place_classify_frame(t)


@query(
    "territory_classify", uses=PLACE_USES, extra=ZONED_IN,
    sql="""select p.site_id, p.point_id, case when bool_or(object_class='territory.protected_green') then 'protected_green' when bool_or(object_class='territory.natural') then 'natural' else 'profile' end as territory
       from points p left join zin z using(point_id) group by all""",
)
def territory_classify(t):
    """Protected land beats natural land; uncovered points take the territory of the profile."""
    points = t.points.select("site_id", "point_id", "x", "y")
    zones = spatial.lowest_areas(points, t.zone_edges.where(F.col("object_class").isin("territory.protected_green", "territory.natural")))
    flags = zones.groupBy("site_id", "point_id").agg(F.max(F.col("object_class") == "territory.protected_green").alias("protected"))
    territory = F.when(F.col("protected"), "protected_green").when(~F.col("protected"), "natural").otherwise("profile")
    return points.join(flags, ["site_id", "point_id"], "left").select("site_id", "point_id", territory.alias("territory"))


CURB_PIECES = """c0 as (select distinct site_id, feature_id, x1, y1, x2, y2, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as len from segments where object_class='curb'),
pc as (select site_id, feature_id, k, len/n as piece_m, x1+(x2-x1)*(cast(k as double)/n) as ax, y1+(y2-y1)*(cast(k as double)/n) as ay, x1+(x2-x1)*(cast(k+1 as double)/n) as ex, y1+(y2-y1)*(cast(k+1 as double)/n) as ey
   from (select *, unnest(range(0,n)) as k from (select *, cast(ceil(len/{step}) as bigint) as n from c0 where len>0)))"""


@query(
    "curb_coverage", uses=("segments", "road_edges"), extra=CURB_PIECES.replace("{step}", "0.5e0"),
    sql=f"""with m as (select site_id, feature_id, k, piece_m, (ax+ex)/2 as x, (ay+ey)/2 as y from pc),
      n as (select p.site_id, p.feature_id, p.k from m p join road_edges s on s.site_id=p.site_id where {S.seg_dist()} <= 3 group by all)
      select m.site_id, round(sum(case when n.k is not null then piece_m else 0 end)/sum(piece_m),5) as coverage from m left join n on n.feature_id=m.feature_id and n.k=m.k group by all""",
)
def curb_coverage(t):
    """Share of kerb length within 3 m of the edge of a carriageway."""
    pieces = split_curb(t, 0.5).select("site_id", "feature_id", "k", "piece_m", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    near = spatial.near_segments(pieces, t.road_edges.select("site_id", "x1", "y1", "x2", "y2"), 3.0, cell=16.0, spread=("feature_id", "k")).select("site_id", "feature_id", "k").distinct().withColumn("on", F.lit(True))
    rows = pieces.join(near, ["site_id", "feature_id", "k"], "left")
    return rows.groupBy("site_id").agg(F.round(F.sum(F.when(F.col("on"), F.col("piece_m")).otherwise(0.0)) / F.sum("piece_m"), 5).alias("coverage"))


@query(
    "replace_moved", uses=("points",),
    sql="select site_id, count(*) filter (percent<10) as moved, count(*) filter (percent>=10) as kept from points group by all",
)
def replace_moved(t):
    """Only plantings whose coordinates changed are placed again."""
    before = t.points.select("site_id", "point_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    after = t.points.select("site_id", "point_id", F.when(F.col("percent") < 10, F.col("x") + 0.5).otherwise(F.col("x")).alias("xn"), F.col("y").alias("yn"))
    both = before.join(after, ["site_id", "point_id"], "full")
    changed = ~(F.col("x0").eqNullSafe(F.col("xn")) & F.col("y0").eqNullSafe(F.col("yn")))
    return both.groupBy("site_id").agg(F.count_if(changed).alias("moved"), F.count_if(~changed).alias("kept"))


SUN = rulebook.sql_values("sun", "day, hour, ux, uy", sun.shadow_hours())
SHADE = f"""{SUN},
tall as (select site_id, feature_id, x as bx0, x+w as bx1, y as by0, y+d as by1, 3.0e0*(1+suppkey%9) as h from rects),
sh as (select distinct p.point_id, s.day, s.hour from points p join tall b on b.site_id=p.site_id and p.x>=b.bx0-320 and p.x<=b.bx1+320 and p.y>=b.by0-320 and p.y<=b.by1+320, sun s
   where greatest(0.0e0, least((p.x-bx0)/nullif(ux*h,0.0e0),(p.x-bx1)/nullif(ux*h,0.0e0)), least((p.y-by0)/nullif(uy*h,0.0e0),(p.y-by1)/nullif(uy*h,0.0e0)))
      < least(1.0e0, greatest((p.x-bx0)/nullif(ux*h,0.0e0),(p.x-bx1)/nullif(ux*h,0.0e0)), greatest((p.y-by0)/nullif(uy*h,0.0e0),(p.y-by1)/nullif(uy*h,0.0e0))))"""


@query(
    "shade_share", uses=("points", "rects"), extra=SHADE,
    sql=f"select p.site_id, p.point_id, round(count(s.hour)/{len(sun.shadow_hours())}.0e0,3) as shade from points p left join sh s using(point_id) group by all",
)
def shade_share(t):
    """Share of the daylight hours of the season a point lies in the shadow of a building.

    The shadow of a box is the box swept along the shift of its roof, so a point is shaded when
    walking back along the shift meets the box: a slab test per hour. Boxes meet points through
    the cells their longest shadow can reach.
    """
    hours = sun.shadow_hours()
    stretch = max((dx * dx + dy * dy) ** 0.5 for _, _, dx, dy in hours)
    boxes = t.rects.select(
        "site_id", F.col("x").alias("bx0"), (F.col("x") + F.col("w")).alias("bx1"), F.col("y").alias("by0"), (F.col("y") + F.col("d")).alias("by1"), (3.0 * (1 + F.col("suppkey") % 9)).alias("h"))
    reach = F.col("h") * stretch
    cell = 64.0
    spread = boxes.withColumn("cx", F.explode(geom.cell_range(F.col("bx0") - reach, F.col("bx1") + reach, cell))).withColumn("cy", F.explode(geom.cell_range(F.col("by0") - reach, F.col("by1") + reach, cell)))
    points = t.points.select("site_id", "point_id", "x", "y").withColumn("cx", geom.cell_of("x", cell)).withColumn("cy", geom.cell_of("y", cell))
    table = t.spark.createDataFrame([(1 << k, ux, uy) for k, (_, _, ux, uy) in enumerate(hours)], "bit long, ux double, uy double")
    pairs = points.join(spread, ["site_id", "cx", "cy"]).join(F.broadcast(table))  # the table of hours has 2 x 17 rows at most

    def slab(p: str, low: str, high: str, unit: str):
        shift = F.nullif(F.col(unit) * F.col("h"), F.lit(0.0))
        a, b = (F.col(p) - F.col(low)) / shift, (F.col(p) - F.col(high)) / shift
        return F.least(a, b), F.greatest(a, b)

    x_in, x_out = slab("x", "bx0", "bx1", "ux")
    y_in, y_out = slab("y", "by0", "by1", "uy")
    # The hours of shadow are bits of one number a point, put together before anything is shuffled.
    shaded = pairs.where(F.greatest(F.lit(0.0), x_in, y_in) < F.least(F.lit(1.0), x_out, y_out)).select("site_id", "point_id", "bit")
    counts = shaded.groupBy("site_id", "point_id").agg(F.bit_count(F.bit_or("bit")).alias("n"))
    return t.points.select("site_id", "point_id").join(counts, ["site_id", "point_id"], "left").select(
        "site_id", "point_id", F.round(F.coalesce("n", F.lit(0)) / float(len(hours)), 3).alias("shade"))


STOCK = """marks as (select site_id, stem_id as id, x, y from stems where acctbal<5000 union all select site_id, 10000000000+stem_id, round(x+0.4e0,3), round(y+0.3e0,3) from stems where acctbal<2000),
trunks as (select site_id, stem_id as id, x, y from stems where acctbal>=5000),
me as (select a.id as a, b.id as b from marks a join marks b on a.site_id=b.site_id and a.id<>b.id and abs(a.x-b.x)<=1 and abs(a.y-b.y)<=1 where sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=1),
mr as (select id, id as root from marks union select me.a, mr.root from mr join me on me.b=mr.id),
mc as (select id, min(root) as component from mr group by all),
cl as (select m.site_id, component as id, avg(x) as x, avg(y) as y from marks m join mc using(id) group by all),
st_all as (select site_id, id, x, y, 'symbol' as source from trunks union all select c.site_id, c.id, c.x, c.y, 'mark' from cl c
   where not exists (select 1 from trunks t where t.site_id=c.site_id and abs(t.x-c.x)<=1 and abs(t.y-c.y)<=1 and sqrt((t.x-c.x)*(t.x-c.x)+(t.y-c.y)*(t.y-c.y))<=1))"""


def stock(t: Tables):
    """Trunks of symbols, and loose marks merged at 1 m unless a trunk stands beside them."""
    base = t.stems.select("site_id", F.col("stem_id").alias("id"), "x", "y", "acctbal")
    trunks = base.where("acctbal >= 5000").select("site_id", "id", "x", "y")
    moved = base.where("acctbal < 2000").select("site_id", (F.lit(10000000000) + F.col("id")).alias("id"), F.round(F.col("x") + 0.4, 3).alias("x"), F.round(F.col("y") + 0.3, 3).alias("y"))
    marks = base.where("acctbal < 5000").select("site_id", "id", "x", "y").unionByName(moved)
    pairs = spatial.self_pairs(marks, 1.0, id_col="id", strict=False).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    labels = graph.connected_components(marks, pairs, key="id")
    clusters = marks.join(labels, "id").groupBy("site_id", F.col("component").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    beside = spatial.near_points(clusters, trunks.select("site_id", F.col("x").alias("bx"), F.col("y").alias("by")), 1.0, spread=("id",)).select("site_id", "id").distinct()
    loose = clusters.join(beside, ["site_id", "id"], "left_anti")
    return trunks.withColumn("source", F.lit("symbol")).unionByName(loose.withColumn("source", F.lit("mark")))


@query("existing_stock", uses=("stems",), extra=STOCK, recursive=True, sql="select site_id, id, round(x,3) as x, round(y,3) as y, source from st_all")
def existing_stock(t):
    return stock(t).withColumn("x", F.round("x", 3)).withColumn("y", F.round("y", 3))


@query(
    "effect_counts", uses=("points", "stems", "inventory", "streets"),
    sql="""with b as (select site_id, count(*) as trees from stems group by all), r as (select site_id, cast(sum(case when verdict='remove' then cnt else 0 end) as bigint) as removed from inventory group by all),
       n as (select site_id, count(*) filter (planting_type='tree') as nt, count(*) filter (planting_type='shrub') as ns from points group by all),
       f as (select site_id, trees, removed, nt, ns, length_m/1000 as km from b join r using(site_id) join n using(site_id) join streets using(site_id))
       select site_id, 'trees' as key, cast(trees as double) as before, cast(trees-removed+nt as double) as after from f union all select site_id, 'shrubs', cast(null as double), cast(ns as double) from f
       union all select site_id, 'trees_per_km', round(trees/km,1), round((trees+nt)/km,1) from f union all select site_id, 'shrubs_per_km', cast(null as double), round(ns/km,1) from f""",
)
def effect_counts(t):
    """Trees and shrubs before and after with densities; unknown stays null, never zero."""
    before = t.stems.groupBy("site_id").agg(F.count(F.lit(1)).alias("trees"))
    removed = t.inventory.groupBy("site_id").agg(F.sum(F.when(F.col("verdict") == "remove", F.col("cnt")).otherwise(0)).alias("removed"))
    new = t.points.groupBy("site_id").agg(F.count_if(F.col("planting_type") == "tree").alias("nt"), F.count_if(F.col("planting_type") == "shrub").alias("ns"))
    rows = before.join(removed, "site_id").join(new, "site_id").join(t.streets.select("site_id", (F.col("length_m") / 1000).alias("km")), "site_id")
    none = F.lit(None).cast("double")
    entry = lambda key, a, b: F.struct(F.lit(key).alias("key"), a.cast("double").alias("before"), b.cast("double").alias("after"))
    return rows.select("site_id", F.explode(F.array(
        entry("trees", F.col("trees"), F.col("trees") - F.col("removed") + F.col("nt")), entry("shrubs", none, F.col("ns")),
        entry("trees_per_km", F.round(F.col("trees") / F.col("km"), 1), F.round((F.col("trees") + F.col("nt")) / F.col("km"), 1)),
        entry("shrubs_per_km", none, F.round(F.col("ns") / F.col("km"), 1)))).alias("e")).select("site_id", "e.key", "e.before", "e.after")


PLANSP = "plan as (select p.*, s.crown_mature_m, s.gas from points p join species s using(species_no))"
CELL2 = """cells as (select distinct a.site_id, cx, cy, fresh from (select c.*, unnest(range(cast(floor((x-radius)/2) as bigint), cast(floor((x+radius)/2) as bigint)+1)) as cx from circ c) a,
    lateral (select unnest(range(cast(floor((y-radius)/2) as bigint), cast(floor((y+radius)/2) as bigint)+1)) as cy) b join sites r on r.site_id=a.site_id
   where sqrt(((cx+0.5e0)*2-x)*((cx+0.5e0)*2-x)+((cy+0.5e0)*2-y)*((cy+0.5e0)*2-y))<=radius and (cx+0.5e0)*2 between r.x0 and r.x1 and (cy+0.5e0)*2 between r.y0 and r.y1)"""


@query(
    "effect_shade", uses=("points", "species", "stems", "sites"),
    extra=f"{PLANSP},\ncirc as (select site_id, x, y, crown_mature_m/2 as radius, 1 as fresh from plan where planting_type='tree' union all select site_id, x, y, crown_m/2, 0 from stems),\n{CELL2}",
    sql="""select site_id, round(count(distinct case when fresh=0 then row(cx,cy) end)*4.0e0,1) as before_m2, round(count(distinct row(cx,cy))*4.0e0,1) as after_m2 from cells group by all""",
)
def effect_shade(t):
    """Area under crowns before and after (union of circles on a 2 m raster, inside the boundary)."""
    bounds = t.sites.select("site_id", "x0", "x1", "y0", "y1")
    old = t.stems.select("site_id", "x", "y", (F.col("crown_m") / 2).alias("radius"), F.lit(1).alias("old"))
    new = plan(t).where(F.col("planting_type") == "tree").select("site_id", "x", "y", (F.col("crown_mature_m") / 2).alias("radius"), F.lit(0).alias("old"))
    cells = Q.circle_cells(old.unionByName(new), 2.0, bounds=bounds).groupBy("site_id", "cx", "cy").agg(F.max("old").alias("old"))
    return cells.groupBy("site_id").agg(F.round(F.sum("old") * 4.0, 1).alias("before_m2"), F.round(F.count(F.lit(1)) * 4.0, 1).alias("after_m2"))


CURB_COVER = f"""curb as (select * from segments where object_class='curb'),
cov as (select site_id, x, y, crown_m/2 as radius, 1 as old from stems union all select site_id, x, y, case when planting_type='shrub' then greatest(crown_mature_m/2,2.0e0) else crown_mature_m/2 end, 0 from plan),
iv0 as (select s.site_id, s.feature_id, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as len, p.radius, p.old,
    ((p.x-x1)*(x2-x1)+(p.y-y1)*(y2-y1))/sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as al, ((p.x-x1)*(y2-y1)-(p.y-y1)*(x2-x1))/sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as off
   from cov p join curb s on s.site_id=p.site_id and p.x between least(x1,x2)-p.radius and greatest(x1,x2)+p.radius and p.y between least(y1,y2)-p.radius and greatest(y1,y2)+p.radius where {S.seg_dist()} < p.radius),
iv as (select *, greatest(0.0e0, al-sqrt(greatest(0.0e0, radius*radius-off*off))) as a, least(len, al+sqrt(greatest(0.0e0, radius*radius-off*off))) as b from iv0),
bp as (select distinct feature_id, v from (select feature_id, a as v from iv union all select feature_id, b from iv)),
sp as (select feature_id, v as a, lead(v) over (partition by feature_id order by v) as b from bp),
cvd as (select iv.site_id, sp.feature_id, sp.a, sp.b, max(old) as old from sp join iv on iv.feature_id=sp.feature_id and iv.a<=sp.a and iv.b>=sp.b group by all)"""


@query(
    "effect_curb", uses=("points", "species", "stems", "segments"), extra=f"{PLANSP},\n{CURB_COVER}",
    sql="select site_id, round(sum(case when old=1 then b-a else 0 end),2) as before_m, round(sum(b-a),2) as after_m from cvd group by all",
)
def effect_curb(t):
    """Kerb metres under greenery before and after."""
    curb = t.segments.where(F.col("object_class") == "curb").select("site_id", "feature_id", "x1", "y1", "x2", "y2")
    old = t.stems.select("site_id", F.col("stem_id").alias("point_id"), "x", "y", (F.col("crown_m") / 2).alias("radius"), F.lit(1).alias("old"))
    shrub = F.col("planting_type") == "shrub"
    new = plan(t).select("site_id", "point_id", "x", "y", F.when(shrub, F.greatest(F.col("crown_mature_m") / 2, F.lit(2.0))).otherwise(F.col("crown_mature_m") / 2).alias("radius"), F.lit(0).alias("old"))
    intervals = Q.cover_intervals(curb, old.unionByName(new))
    both = intervals.withColumn("stage", F.explode(F.when(F.col("old") == 1, F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("after")))))
    lengths = Q.union_length(both, ["site_id", "feature_id", "stage"])
    return lengths.groupBy("site_id").agg(
        F.round(F.sum(F.when(F.col("stage") == "before", F.col("length_m")).otherwise(0.0)), 2).alias("before_m"),
        F.round(F.sum(F.when(F.col("stage") == "after", F.col("length_m")).otherwise(0.0)), 2).alias("after_m"))


@query(
    "effect_tiers", uses=("points", "species", "stems"), extra=PLANSP,
    sql="""with tr as (select site_id, x, y, crown_mature_m/2 as r, point_id as id from plan where planting_type='tree' union all select site_id, x, y, crown_m/2, -1-stem_id from stems), s as (select * from plan where planting_type='shrub')
       select s.site_id, count(distinct t.id) as after_trees from tr t join s on s.site_id=t.site_id and abs(s.x-t.x)<=t.r and abs(s.y-t.y)<=t.r where sqrt((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y))<=t.r group by all""",
)
def effect_tiers(t):
    """Trees, new and existing, that have a shrub of the plan under the crown."""
    shrubs = plan(t).where(F.col("planting_type") == "shrub")
    trees = plan(t).where(F.col("planting_type") == "tree").select("site_id", "point_id", "x", "y", (F.col("crown_mature_m") / 2).alias("radius"))
    stems = t.stems.select("site_id", (-1 - F.col("stem_id")).alias("point_id"), "x", "y", (F.col("crown_m") / 2).alias("radius"))
    return covered_crowns(trees.unionByName(stems), shrubs, "point_id").groupBy("site_id").agg(F.count(F.lit(1)).alias("after_trees"))


BANDS = ((10.0, 16.0, "10-15"), (16.0, 21.0, "16-20"), (21.0, 26.0, "21-25"), (26.0, 1000.0, "26+"))  # fixed values
NOISE = f"""{CURB_PIECES.replace('{step}', '2.0e0')},
rays as (select site_id, feature_id, k, piece_m, side, (ax+ex)/2 as x1, (ay+ey)/2 as y1, (ax+ex)/2-side*(ey-ay)/piece_m*35 as x2, (ay+ey)/2+side*(ex-ax)/piece_m*35 as y2 from pc, (values (1.0e0),(-1.0e0)) q(side)),
disc as (select site_id, x, y, case when planting_type='shrub' then greatest(crown_mature_m/2,0.5e0) else crown_mature_m/2 end as radius from plan union all select site_id, x, y, crown_m/2 from stems),
ri as (select s.site_id, s.feature_id, s.k, s.side, s.piece_m, p.radius, ((p.x-x1)*(x2-x1)+(p.y-y1)*(y2-y1))/35.0e0 as al, ((p.x-x1)*(y2-y1)-(p.y-y1)*(x2-x1))/35.0e0 as off
   from rays s join disc p on p.site_id=s.site_id and p.x between least(x1,x2)-p.radius and greatest(x1,x2)+p.radius and p.y between least(y1,y2)-p.radius and greatest(y1,y2)+p.radius where {S.seg_dist()} < p.radius),
rv as (select *, round(greatest(0.0e0, al-sqrt(greatest(0.0e0, radius*radius-off*off))),6) as a, round(least(35.0e0, al+sqrt(greatest(0.0e0, radius*radius-off*off))),6) as b from ri),
rg as (select *, case when a - coalesce(max(b) over (partition by feature_id, k, side order by a, b rows between unbounded preceding and 1 preceding), -100.0e0) > 4 then 1 else 0 end as brk from rv),
rn as (select *, sum(brk) over (partition by feature_id, k, side order by a, b rows between unbounded preceding and current row) as isl from rg),
w1 as (select site_id, feature_id, k, side, piece_m, max(b)-min(a) as w from rn where isl=1 group by all having min(a)<=2),
w2 as (select site_id, feature_id, k, piece_m, max(w) as w from w1 group by all)"""


def belt_widths(t: Tables):
    """Width of the green belt from every 2 m of kerb, to either side, gaps up to 4 m closed.

    The belt is read off the intervals in which crowns cover a 35 m ray across the kerb; the first
    run of intervals counts when it starts within 2 m.
    """
    pieces = split_curb(t, 2.0).withColumn("side", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    size = F.nullif("piece_m", F.lit(0.0))
    rays = pieces.select(
        "site_id", "feature_id", "k", "side", "piece_m", mx.alias("x1"), my.alias("y1"),
        (mx - F.col("side") * (F.col("by") - F.col("ay")) / size * 35).alias("x2"), (my + F.col("side") * (F.col("bx") - F.col("ax")) / size * 35).alias("y2"))
    shrub = F.col("planting_type") == "shrub"
    new = plan(t).select("site_id", "point_id", "x", "y", F.when(shrub, F.greatest(F.col("crown_mature_m") / 2, F.lit(0.5))).otherwise(F.col("crown_mature_m") / 2).alias("radius"))
    old = t.stems.select("site_id", (-1 - F.col("stem_id")).alias("point_id"), "x", "y", (F.col("crown_m") / 2).alias("radius"))
    cover = Q.cover_intervals(rays, new.unionByName(old)).withColumn("a", F.round("a", 6)).withColumn("b", F.round("b", 6))
    w = Window.partitionBy("site_id", "feature_id", "k", "side").orderBy("a", "b")
    reached = F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-100.0))
    marked = cover.withColumn("brk", F.when(F.col("a") - reached > 4, 1).otherwise(0))
    runs = marked.withColumn("isl", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("isl = 1")
    first = runs.groupBy("site_id", "feature_id", "k", "side", "piece_m").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <= 2")
    return first.groupBy("site_id", "feature_id", "k", "piece_m").agg(F.max(F.col("b") - F.col("a")).alias("w"))


@query(
    "noise_belt", uses=("points", "species", "stems", "segments"), extra=f"{PLANSP},\n{NOISE}",
    sql="""select site_id, case when w<10 then 'below' when w<16 then '10-15' when w<21 then '16-20' when w<26 then '21-25' else '26+' end as band, count(*) as pieces, round(sum(piece_m),1) as curb_m, round(max(w),3) as widest_m from w2 group by all""",
)
def noise_belt(t):
    band = F.lit("below")
    for low, high, name in BANDS:
        band = F.when((F.col("w") >= low) & (F.col("w") < high), name).otherwise(band)
    return belt_widths(t).groupBy("site_id", band.alias("band")).agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum("piece_m"), 1).alias("curb_m"), F.round(F.max("w"), 3).alias("widest_m"))


ROW_LEN = """rowp as (select *, cast(floor(y/20) as bigint) as row_no from points where mode='alley'),
rl as (select site_id, row_no, point_id, sqrt((x-lag(x) over w)*(x-lag(x) over w)+(y-lag(y) over w)*(y-lag(y) over w)) as step from rowp window w as (partition by site_id, row_no order by point_id))"""


def row_steps(t: Tables):
    rows = t.points.where(F.col("mode") == "alley").withColumn("row_no", F.floor(F.col("y") / 20).cast("long"))
    w = Window.partitionBy("site_id", "row_no").orderBy("point_id")
    return rows.withColumn("step", geom.hypot2(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))


@query("row_length", uses=("points",), extra=ROW_LEN, sql="select site_id, row_no, count(*) as plants, round(coalesce(sum(step),0),2) as length_m from rl group by all")
def row_length(t):
    """Distance between consecutive plants of every row, summed."""
    return row_steps(t).groupBy("site_id", "row_no").agg(F.count(F.lit(1)).alias("plants"), F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 2).alias("length_m"))


@query(
    "planting_kinds", uses=PLACE_USES, extra=f"{PLACE},\n{ROW_LEN}",
    sql="""select p.site_id, p.mode as kind, count(*) as cnt, count(*) filter (planting_type='tree') as trees, count(*) filter (place='roadside') as roadside, count(*) filter (place='yard') as yard, count(*) filter (place='street') as street,
        case when p.mode='alley' then (select round(sum(step),1) from rl where rl.site_id=p.site_id) end as length_m from points p join plc using(point_id) group by all""",
)
def planting_kinds(t):
    """Counts by planting technique with places, and the length of rows."""
    places = place_classify_frame(t).select("point_id", "place")
    length = row_steps(t).groupBy("site_id").agg(F.round(F.sum("step"), 1).alias("length_m")).withColumn("kind", F.lit("alley"))
    counts = t.points.join(places, "point_id").groupBy("site_id", F.col("mode").alias("kind")).agg(
        F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("planting_type") == "tree").alias("trees"),
        *[F.count_if(F.col("place") == p).alias(p) for p in ("roadside", "yard", "street")])
    return counts.join(length, ["site_id", "kind"], "left")


@query(
    "species_delta", uses=("points", "stems"),
    sql="""with a as (select distinct site_id, species_no as s from points), b as (select distinct site_id, stem_id%58 as s from stems)
       select site_id, count(distinct s) filter (k=1) as new_species, count(distinct s) filter (k=0) as existing, count(distinct s) as together from (select *, 1 as k from a union all select *, 0 from b) group by all""",
)
def species_delta(t):
    new = t.points.select("site_id", "species_no", F.lit(1).alias("new")).distinct()
    old = t.stems.select("site_id", (F.col("stem_id") % 58).alias("species_no"), F.lit(0).alias("new")).distinct()
    return new.unionByName(old).groupBy("site_id").agg(
        F.countDistinct(F.when(F.col("new") == 1, F.col("species_no"))).alias("new_species"), F.countDistinct(F.when(F.col("new") == 0, F.col("species_no"))).alias("existing"),
        F.countDistinct("species_no").alias("together"))
