"""Motifs and repairs of linework on the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetgrove.functions import geom
from streetgrove.operators import drawing as D
from streetgrove.operators import chains, graph, scan, spatial
from streetgrove.plans import checksql as S
from streetgrove.plans.queries.effect import CURB_PIECES
from streetgrove.plans.queries.quality import split_curb
from streetgrove.plans.registry import Tables, query
from streetgrove.session import cut


def matched(order: str, source: str, share: str) -> str:
    """Sequential matching by rounds in recursive SQL: rows of ``source`` in ``order``, ``share`` says conflict."""
    return f"""seqd as (select *, row_number() over (order by {order}) as pos from {source}),
edges as (select b.pos as id, a.pos as other from seqd a join seqd b on a.pos<b.pos and ({share})),
st as (select 0 as n, pos as id, 0 as status from seqd union all
  select st.n+1, st.id, case when st.status<>0 then st.status when coalesce(h.kept,0)>0 then 2 when coalesce(h.open,0)=0 then 1 else 0 end
  from st left join (select e.id, count(*) filter (s2.status=1) as kept, count(*) filter (s2.status=0) as open from edges e join st s2 on s2.id=e.other group by e.id) h on h.id=st.id where exists (select 1 from st s3 where s3.status=0)),
chosen as (select id as pos from st where n=(select max(n) from st) and status=1)"""


SHARE = "a.a_end=b.a_end or a.a_end=b.b_end or a.b_end=b.a_end or a.b_end=b.b_end"
ENDS = """ends as (select site_id, feature_id, feature_id*2 as e, x1 as x, y1 as y, (x1-x2)/nullif(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)),0) as dx, (y1-y2)/nullif(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)),0) as dy from segments where {cond}
  union all select site_id, feature_id, feature_id*2+1, x2, y2, (x2-x1)/nullif(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)),0), (y2-y1)/nullif(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)),0) from segments where {cond}),
pr0 as (select a.site_id, a.e as a_end, b.e as b_end, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d, a.x as ax, a.y as ay, b.x as bx, b.y as by_, a.dx as adx, a.dy as ady, b.dx as bdx, b.dy as bdy
  from ends a join ends b on a.site_id=b.site_id and a.e<b.e and a.feature_id<>b.feature_id and abs(a.x-b.x)<={gap} and abs(a.y-b.y)<={gap}),
tch as (select a_end as e from pr0 where d<=1e-6 union select b_end from pr0 where d<=1e-6),
pr as (select * from pr0 where d>1e-6 and d<={gap} and a_end not in (select e from tch) and b_end not in (select e from tch))"""


@query(
    "line_gap_bridge", uses=("segments",), recursive=True, extra=ENDS.replace("{cond}", "is_area=0").replace("{gap}", "4.0e0") + ",\n" + matched("d, a_end, b_end", "pr", SHARE) + """,
br as (select site_id, a_end, b_end, d from seqd join chosen using(pos)),
fr as (select * from ends where e not in (select a_end from br) and e not in (select b_end from br) and e not in (select e from tch) and dx is not null),
hit as (select f.e, f.site_id, s.feature_id as other, ((s.x1-f.x)*(s.y2-s.y1)-(s.y1-f.y)*(s.x2-s.x1))/nullif(f.dx*(s.y2-s.y1)-f.dy*(s.x2-s.x1),0) as m, ((s.x1-f.x)*f.dy-(s.y1-f.y)*f.dx)/nullif(f.dx*(s.y2-s.y1)-f.dy*(s.x2-s.x1),0) as u
   from fr f join segments s on s.site_id=f.site_id and s.feature_id<>f.feature_id and greatest(s.x1,s.x2)>=f.x-4 and least(s.x1,s.x2)<=f.x+4 and greatest(s.y1,s.y2)>=f.y-4 and least(s.y1,s.y2)<=f.y+4),
ext as (select site_id, e, min(row(m, other)) as h from hit where m>1e-6 and m<=4.0e0 and u between 0 and 1 group by all)""",
    sql="""select site_id, a_end, b_end, cast(null as bigint) as hit, round(d,3) as gap_m from br
      union all select site_id, e, null, h[2], round(h[1],3) from ext""",
)
def line_gap_bridge(t):
    """Free ends of different lines joined, nearest pairs first, each end once; an end that still hangs runs on to the first line it meets."""
    lines, gap = t.segments.where("is_area = 0"), 4.0
    kept, met = D.bridges(lines, [(gap, F.lit(True))])
    bridges = kept.select("site_id", F.col("a_end_id").alias("a_end"), F.col("b_end_id").alias("b_end"), F.lit(None).cast("long").alias("hit"), F.round("distance", 3).alias("gap_m"))
    runs = D.extensions(lines, spatial.named(t.segments.select("site_id", "feature_id", "x1", "y1", "x2", "y2")), kept, gap, met=met)
    return bridges.unionByName(runs.select("site_id", F.col("end_id").alias("a_end"), F.lit(None).cast("long").alias("b_end"), "hit", F.round("along_m", 3).alias("gap_m")))


STRAIGHT = "(adx*(bx-ax)+ady*(by_-ay))/d>=0.5e0 and -(bdx*(bx-ax)+bdy*(by_-ay))/d>=0.5e0 and -(adx*bdx+ady*bdy)>=0.5e0"


@query(
    "fence_gap_bridge", uses=("segments",), recursive=True,
    extra=ENDS.replace("{cond}", "object_class='fence'").replace("{gap}", "12.0e0") + f",\n  fp as (select *, case when {STRAIGHT} then 0 else 1 end as corner from pr where ({STRAIGHT}) or d<=6.0e0),\n" + matched("corner, d, a_end, b_end", "fp", SHARE),
    sql="select site_id, a_end, b_end, cast(corner as int) as corner, round(d,3) as gap_m from seqd join chosen using(pos)",
)
def fence_gap_bridge(t):
    """Strokes of a fence joined: those that continue each other first, then corners (wide gaps here)."""
    straight = F.coalesce(D.continues(0.5), F.lit(False))
    kept, _ = D.bridges(t.segments.where(F.col("object_class") == "fence"), [(12.0, straight), (6.0, ~straight)])
    return kept.select("site_id", F.col("a_end_id").alias("a_end"), F.col("b_end_id").alias("b_end"), F.col("offer").alias("corner"), F.round("distance", 3).alias("gap_m"))


@query(
    "tree_strip_chain", uses=("stems",), recursive=True,
    extra="""e as (select a.stem_id as a, b.stem_id as b from stems a join stems b on a.site_id=b.site_id and a.genus=b.genus and a.stem_id<>b.stem_id and abs(a.x-b.x)<=15 and abs(a.y-b.y)<=15 where sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=15),
      reach as (select stem_id as id, stem_id as root from stems union select e.a, reach.root from reach join e on e.b=reach.id), comp as (select id, min(root) as strip from reach group by all)""",
    sql="select s.site_id, s.genus as layer, c.strip, count(*) as marks from stems s join comp c on c.id=s.stem_id group by all",
)
def tree_strip_chain(t):
    """Loose marks of one layer near each other become one strip (15 m here)."""
    marks = t.stems.select("site_id", F.col("genus").alias("layer"), F.col("stem_id").alias("id"), "x", "y")
    pairs = spatial.self_pairs(marks, 15.0, id_col="id", on=("site_id", "layer"), strict=False)
    labels = graph.connected_components(marks, pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), key="id")
    return marks.join(labels, "id").groupBy("site_id", "layer", F.col("component").alias("strip")).agg(F.count(F.lit(1)).alias("marks"))


MID = """mid as (select site_id, feature_id, k, piece_m, (ax+ex)/2 as x, (ay+ey)/2 as y from pc)"""


def exists_near(edges: str, limit: str) -> str:
    return f"exists (select 1 from {edges} s where s.site_id=p.site_id and least(s.x1,s.x2)<=p.x+{limit} and greatest(s.x1,s.x2)>=p.x-{limit} and least(s.y1,s.y2)<=p.y+{limit} and greatest(s.y1,s.y2)>=p.y-{limit} and {S.seg_dist()}<={limit})"


@query(
    "kerb_refine", uses=("segments", "road_edges", "zone_edges"),
    extra=CURB_PIECES.replace("{step}", "0.5e0") + f",\n{MID},\nwk as (select * from zone_edges where object_class='territory.yard'),\nlw as (select * from zone_edges where object_class='territory.park'),\n"
    + f"jd as (select p.*, not {exists_near('road_edges', '1.0e0')} and {exists_near('wk', '40.0e0')} and {exists_near('lw', '60.0e0')} as beside from mid p)",
    sql="select site_id, case when beside then 'pavement_edge' else 'curb' end as object_class, count(*) as pieces, round(sum(piece_m),2) as length_m from jd group by all",
)
def kerb_refine(t):
    """Kerb pieces away from the carriageway, beside a footway and a lawn, become pavement edge.

    Pieces are half a metre; the distances are wide here because the fixture has no footways.
    """
    pieces = split_curb(t, 0.5).select("site_id", "feature_id", "k", "piece_m", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    key = ["site_id", "feature_id", "k"]

    def near(edges, limit, flag, cell):
        hits = spatial.near_segments(pieces, edges.select("site_id", "x1", "y1", "x2", "y2"), limit, cell=cell, spread=("feature_id", "k"))
        return hits.select(*key).distinct().withColumn(flag, F.lit(True))

    zones = t.zone_edges
    rows = (
        pieces.join(near(t.road_edges, 1.0, "road", 16.0), key, "left").join(near(zones.where(F.col("object_class") == "territory.yard"), 40.0, "walk", 40.0), key, "left")
        .join(near(zones.where(F.col("object_class") == "territory.park"), 60.0, "lawn", 60.0), key, "left")
    )
    beside = F.col("road").isNull() & F.col("walk").isNotNull() & F.col("lawn").isNotNull()
    return rows.groupBy("site_id", F.when(beside, "pavement_edge").otherwise("curb").alias("object_class")).agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum("piece_m"), 2).alias("length_m"))


EDGE_PIECES = CURB_PIECES.replace("{step}", "1.0e0").replace("object_class='curb'", "object_class='pavement_edge'")


@query(
    "project_edge_drop", uses=("segments", "zone_edges", "roads"),
    extra=EDGE_PIECES + f""",\n{MID},
  lw as (select * from zone_edges where object_class in ('territory.park','territory.square')),
  ins as (select p.feature_id, p.k, z.feature_id as zone from mid p join lw z on z.site_id=p.site_id where ((z.y1>p.y)<>(z.y2>p.y)) and p.x < z.x1+(p.y-z.y1)/(z.y2-z.y1)*(z.x2-z.x1) group by all having count(*)%2=1),
  deep as (select distinct i.feature_id, i.k from ins i join mid p on p.feature_id=i.feature_id and p.k=i.k where not {exists_near('lw', '0.15e0')} and not exists (select 1 from roads r where r.site_id=p.site_id and p.x>r.x and p.x<r.x+r.w and p.y>r.y and p.y<r.y+r.d))""",
    sql="select m.site_id, case when d.k is not null then 'ignore' else 'pavement_edge' end as object_class, count(*) as pieces, round(sum(piece_m),2) as length_m from mid m left join deep d on d.feature_id=m.feature_id and d.k=m.k group by all",
)
def project_edge_drop(t):
    """Pavement edges that run inside a project lawn are dropped where deeper than 0.15 m."""
    pieces = split_curb(t, 1.0, ("pavement_edge",)).select("site_id", "feature_id", "k", "piece_m", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    lawns = t.zone_edges.where(F.col("object_class").isin("territory.park", "territory.square"))
    key = ["site_id", "feature_id", "k"]
    inside = spatial.contained(pieces, lawns.withColumnRenamed("feature_id", "zone"), point_key=("feature_id", "k"), area_key=("zone",)).select(*key).distinct()
    edge = spatial.near_segments(pieces, lawns.select("site_id", "x1", "y1", "x2", "y2"), 0.15, cell=16.0, spread=("feature_id", "k")).select(*key).distinct()
    road = spatial.contained(pieces, t.road_edges.withColumnRenamed("feature_id", "road"), point_key=("feature_id", "k"), area_key=("road",)).select(*key).distinct()
    deep = inside.join(edge, key, "left_anti").join(road, key, "left_anti").withColumn("gone", F.lit(True))
    rows = pieces.join(deep, key, "left")
    return rows.groupBy("site_id", F.when(F.col("gone"), "ignore").otherwise("pavement_edge").alias("object_class")).agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum("piece_m"), 2).alias("length_m"))


def boxes(df, prefix: str):
    return df.select("site_id", F.col("feature_id").alias(prefix + "id"), F.col("x").alias(prefix + "x0"), F.col("y").alias(prefix + "y0"), (F.col("x") + F.col("w")).alias(prefix + "x1"), (F.col("y") + F.col("d")).alias(prefix + "y1"))


def in_cells(df, prefix: str, cell: float = 32.0):
    return df.withColumn("cx", F.explode(geom.cell_range(F.col(prefix + "x0"), F.col(prefix + "x1"), cell))).withColumn("cy", F.explode(geom.cell_range(F.col(prefix + "y0"), F.col(prefix + "y1"), cell)))


@query(
    "school_mark", uses=("rects",),
    extra="ol as (select 7000000000+feature_id as feature_id, site_id, x+suppkey%9 as x, y+suppkey%4 as y, w, d from rects where suppkey%2=0)",
    sql="""select b.feature_id, o.feature_id as outline_id, round((least(b.x+b.w,o.x+o.w)-greatest(b.x,o.x))*(least(b.y+b.d,o.y+o.d)-greatest(b.y,o.y)),3) as shared_m2 from rects b join ol o on o.site_id=b.site_id
       where least(b.x+b.w,o.x+o.w)>greatest(b.x,o.x) and least(b.y+b.d,o.y+o.d)>greatest(b.y,o.y)
         and (least(b.x+b.w,o.x+o.w)-greatest(b.x,o.x))*(least(b.y+b.d,o.y+o.d)-greatest(b.y,o.y)) >= 0.5e0*b.w*b.d and (least(b.x+b.w,o.x+o.w)-greatest(b.x,o.x))*(least(b.y+b.d,o.y+o.d)-greatest(b.y,o.y)) >= 0.5e0*o.w*o.d""",
)
def school_mark(t):
    """Buildings that share at least half of both areas with an outside outline also become schools."""
    outlines = t.rects.where("suppkey % 2 = 0").select("site_id", (F.lit(7000000000) + F.col("feature_id")).alias("feature_id"), (F.col("x") + F.col("suppkey") % 9).alias("x"), (F.col("y") + F.col("suppkey") % 4).alias("y"), "w", "d")
    pairs = in_cells(boxes(t.rects, "b"), "b").join(in_cells(boxes(outlines, "o"), "o"), ["site_id", "cx", "cy"]).drop("cx", "cy").distinct()
    shared = (F.least("bx1", "ox1") - F.greatest("bx0", "ox0")) * (F.least("by1", "oy1") - F.greatest("by0", "oy0"))
    area = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    meets = (F.least("bx1", "ox1") > F.greatest("bx0", "ox0")) & (F.least("by1", "oy1") > F.greatest("by0", "oy0"))
    return pairs.where(meets & (shared >= 0.5 * area("b")) & (shared >= 0.5 * area("o"))).select(F.col("bid").alias("feature_id"), F.col("oid").alias("outline_id"), F.round(shared, 3).alias("shared_m2"))


@query(
    "gis_alignment", uses=("rects", "zones", "sites"),
    sql="""with a as (select site_id, feature_id, x+w/2 as x, y+d/2 as y from zones), b as (select site_id, x+w/2 as x, y+d/2 as y from rects),
       n as (select a.site_id, a.feature_id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) as d from a join b on a.site_id=b.site_id group by all)
       select s.site_id, count(d) as paired, round(quantile_cont(d,0.5),3) as median_m, coalesce(quantile_cont(d,0.5)>3, true) as warn from sites s left join n using(site_id) group by all""",
)
def gis_alignment(t):
    """Median distance between the centres of layer buildings and their nearest drawing buildings; a street without a pair warns."""
    centre = lambda df: df.select("site_id", F.col("feature_id").alias("point_id"), (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("d") / 2).alias("y"))
    near = spatial.nearest_segment(centre(t.zones), spatial.as_segments(centre(t.rects)), (150.0,), payload=())
    middle = scan.order_statistics(near, "distance", (0.5,), by=("site_id",))
    rows = t.sites.select("site_id").join(middle, "site_id", "left")
    return rows.select("site_id", F.coalesce("n", F.lit(0)).alias("paired"), F.round("q0", 3).alias("median_m"), F.coalesce(F.col("q0") > 3, F.lit(True)).alias("warn"))


CONFLICT = f"""tr as (select site_id, round(x,2) as x, round(y,2) as y, min(stem_id) as id, count(*) as marks from stems group by all),
tin as (select p.site_id, p.id, z.feature_id, z.object_class from tr p join zone_edges z on z.site_id=p.site_id where ((z.y1>p.y)<>(z.y2>p.y)) and p.x < z.x1+(p.y-z.y1)/(z.y2-z.y1)*(z.x2-z.x1) group by all having count(*)%2=1),
dp as (select t.site_id, t.id, t.feature_id, t.object_class, min({S.seg_dist(s='s')}) as depth from tin t join tr p using(site_id, id) join zone_edges s on s.feature_id=t.feature_id group by all)"""


@query("source_conflicts", uses=("stems", "zone_edges"), extra=CONFLICT, sql="select site_id, id, feature_id, object_class, round(depth,3) as depth_m from dp where depth>0.5e0")
def source_conflicts(t):
    """Trunk positions (copies within 1 cm are one) strictly inside closed areas, deeper than the tolerance."""
    trunks = t.stems.groupBy("site_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y")).agg(F.min("stem_id").alias("id"))
    inside = spatial.contained(trunks, t.zone_edges, point_key=("id",), area_key=("feature_id", "object_class"))
    probe = inside.join(trunks, ["site_id", "id"])
    edges = t.zone_edges.select("site_id", "feature_id", "x1", "y1", "x2", "y2")
    depth = probe.join(edges, ["site_id", "feature_id"]).groupBy("site_id", "id", "feature_id", "object_class").agg(F.min(geom.segment_distance()).alias("depth"))
    return depth.where("depth > 0.5").select("site_id", "id", "feature_id", "object_class", F.round("depth", 3).alias("depth_m"))


@query("work_area_infer")
def work_area_infer(t):
    """Hull of the known objects of a site without far outliers, with its area."""
    centres = t.features.select("site_id", "x", "y")
    median = lambda frame, column, name: scan.order_statistics(frame, column, (0.5,), by=("site_id",)).select("site_id", F.col("q0").alias(name))
    away = centres.join(median(centres, "x", "mx"), "site_id").join(median(centres, "y", "my"), "site_id").withColumn("away", geom.point_distance("x", "y", "mx", "my"))
    fence = median(away, "away", "mid").select("site_id", F.greatest(3 * F.col("mid"), F.lit(500.0)).alias("fence"))
    core = away.join(fence, "site_id").where(F.col("away") <= F.col("fence"))
    hull = D.convex_hulls(core)
    after = hull.select("site_id", (F.col("n") - 1).alias("n"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    first = hull.where("n = 0").select("site_id", F.col("x").alias("fx"), F.col("y").alias("fy"))
    ring = hull.join(after, ["site_id", "n"], "left").join(first, "site_id")
    cross = F.col("x") * F.coalesce("ny", "fy") - F.coalesce("nx", "fx") * F.col("y")
    return ring.groupBy("site_id").agg(F.count(F.lit(1)).alias("vertices"), F.round(F.sum(cross) / 2, 1).alias("area_m2"))


DASH = """dsh as (select cast(floor(o_orderkey/500) as bigint) as sheet, o_orderkey as seq, o_orderkey%500*1.0e0 as x1, case when o_custkey%10=0 then 5.0e0 else 0.0e0 end as y1 from orders),
lk as (select *, coalesce(lag(y1) over (partition by sheet order by seq)=y1, false) as linked from dsh),
ch as (select *, sum(case when linked then 0 else 1 end) over (partition by sheet order by seq) as chain from lk)"""


@query("dash_chain", extra=DASH, sql="select sheet, chain::bigint as chain, count(*) as dashes, count(*) filter (linked) as gaps, min(x1) as from_x, count(*) filter (linked)>=3 as dashed from ch group by all")
def dash_chain(t):
    """Dashes of one sheet in drawing order; a chain is a dashed line from three gaps on."""
    dashes = t.orders.select(
        F.floor(F.col("o_orderkey") / 500).alias("sheet"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 500 * 1.0).cast("double").alias("x1"), F.when(F.col("o_custkey") % 10 == 0, 5.0).otherwise(0.0).alias("y1"))
    dashes = dashes.withColumn("x2", F.col("x1") + 0.6).withColumn("y2", F.col("y1"))
    chains = D.dash_chains(dashes, ("sheet",))
    return chains.groupBy("sheet", F.col("chain").cast("long").alias("chain")).agg(F.count(F.lit(1)).alias("dashes"), F.sum("gapped").cast("long").alias("gaps"), F.min("x1").alias("from_x")).withColumn("dashed", F.col("gaps") >= 3)


@query(
    "sheet_furniture_detect", uses=("labels_t",), recursive=True,
    extra="""nd as (select label_id as id, site_id, layer as sheet, x, y, case when label_id%7=0 then 'Масштаб 1:500' when label_id%7=1 then 'просто текст' end as text from labels_t),
      e as (select a.id as a, b.id as b from nd a join nd b on a.site_id=b.site_id and a.sheet=b.sheet and a.id<>b.id and abs(a.x-b.x)<=40 and abs(a.y-b.y)<=40 where sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=40),
      reach as (select id, id as root from nd union select e.a, reach.root from reach join e on e.b=reach.id), comp as (select id, min(root) as component from reach group by all), anc as (select distinct component from comp join nd using(id) where text like 'Масштаб%')""",
    sql="select n.site_id, n.sheet, count(*) as objects, count(a.component) as furniture from nd n join comp c using(id) left join anc a on a.component=c.component where n.text is null group by all",
)
def sheet_furniture_detect(t):
    """Objects linked to an anchor text of their sheet are furniture (40 m links here)."""
    nodes = t.labels_t.select("site_id", F.col("layer").alias("sheet"), F.col("label_id").alias("id"), "x", "y")
    members = nodes.where("id % 7 > 1")
    labels = nodes.where("id % 7 <= 1").withColumn("text", F.when(F.col("id") % 7 == 0, "Масштаб 1:500").otherwise("просто текст"))
    found = D.furniture(members, labels, 40.0)
    return found.groupBy("site_id", "sheet").agg(F.count(F.lit(1)).alias("objects"), F.count("anchor").alias("furniture"))


STRIP = """cir as (select cast(floor(o_orderkey/60) as bigint) as line, (o_orderkey%60)*0.5e0 as pos_m, case when o_custkey%40=0 then 0.3e0 when o_orderkey%60 in (13,33) then 0.5e0 when o_orderkey%60 in (12,14,32,34) then 0.35e0 else 0.1e0 end as r from orders),
sr as (select line, pos_m, r/max(r) over (partition by line) as q from cir), st as (select *, coalesce(q>=0.92e0 and lag(q) over w between 0.62e0 and 0.78e0 and lead(q) over w between 0.62e0 and 0.78e0, false) as tr from sr window w as (partition by line order by pos_m))"""


@query(
    "shrub_strip_motif", extra=STRIP,
    sql="""select line, count(*) as marks, count(*) filter (tr) as motifs, count(*) filter (tr)>=2 and count(*)>=9 and count(*) filter (q>0.25e0 and not (q between 0.62e0 and 0.78e0) and q<0.92e0)=0 and count(*) filter (q>=0.92e0 and not tr)=0
        and count(*) filter (q between 0.62e0 and 0.78e0)=2*count(*) filter (tr) and count(*) filter (q<=0.25e0)>=3*(count(*) filter (tr)-1) as strip from st group by all""",
)
def shrub_strip_motif(t):
    """Dotted lines interrupted by small-large-small circles are shrub strips."""
    k = F.col("o_orderkey") % 60
    radius = F.when(F.col("o_custkey") % 40 == 0, 0.3).when(k.isin(13, 33), 0.5).when(k.isin(12, 14, 32, 34), 0.35).otherwise(0.1)
    circles = t.orders.select(F.floor(F.col("o_orderkey") / 60).alias("line"), (k * 0.5).cast("double").alias("at"), radius.alias("radius_m"))
    return D.strip_motifs(circles, ("line",)).select("line", "marks", "motifs", "strip")


@query(
    "callout_detect",
    sql="""with a as (select o_orderkey as id, o_custkey%5 as site_id, o_orderstatus as s from orders)
       select site_id, id*10 as shaft, cast(1 as bigint) as texts, case when id%3=0 then cast(1 as bigint) else cast(0 as bigint) end as through, case when id%3=0 then 'candidate' else 'leader' end as callout from a where s<>'P'""",
)
def callout_detect(t):
    """Arrow leaders among the lines of a utility layer; a line running on through the tip makes it a candidate."""
    base = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("site_id"), F.col("o_orderstatus").alias("s")).withColumn("ox", (F.col("id") % 1000) * 50.0).withColumn("oy", F.floor(F.col("id") / 1000) * 50.0)
    line = lambda n, x1, y1, x2, y2: F.struct(F.lit(n).alias("n"), *[(F.col("ox" if i % 2 == 0 else "oy") + v).alias(c) for i, (c, v) in enumerate((("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2)))])
    parts = F.array(line(0, 0.0, 0.0, 6.0, 0.0), line(1, 0.0, 0.0, 0.5, 0.3), line(2, 0.0, 0.0, 0.5, -0.3))
    parts = F.when(F.col("id") % 3 == 0, F.concat(parts, F.array(line(3, 0.0, 0.0, -9.0, 0.0)))).otherwise(parts)
    lines = base.withColumn("p", F.explode(parts)).select("site_id", (F.col("id") * 10 + F.col("p.n")).alias("feature_id"), "p.x1", "p.y1", "p.x2", "p.y2")
    labels = base.where("s <> 'P'").select("site_id", (F.col("ox") + 7.0).alias("x"), (F.col("oy") + 1.0).alias("y"))
    return D.arrows(lines, labels).select("site_id", "shaft", "texts", "through", "callout")


@query(
    "occupied_geometry", uses=("zones",),
    sql="""select feature_id, case when feature_id%2=0 then 'utility.heat' when feature_id%3=0 then 'obstacle' else 'curb' end as object_class, round(least(w,d)/2,3) as inradius_m,
       case when feature_id%2=0 then least(w,d)/2<=20 when feature_id%3=0 then true else false end as is_area from zones""",
)
def occupied_geometry(t):
    """Does a closed figure take its interior: networks only while no wider than a structure (20 m here), obstacles always."""
    cls = F.when(F.col("feature_id") % 2 == 0, "utility.heat").when(F.col("feature_id") % 3 == 0, "obstacle").otherwise("curb")
    inradius = F.least("w", "d") / 2
    area = F.when(F.col("object_class").startswith("utility."), inradius <= 20.0).otherwise(F.col("object_class").isin("obstacle", "zone.power_line", "zone.gas", "parcel.private", "parcel.residential"))
    return t.zones.withColumn("object_class", cls).select("feature_id", "object_class", F.round(inradius, 3).alias("inradius_m"), area.alias("is_area"))


BOUND = "bd as (select feature_id, site_id, object_class as layer, w, d, (feature_id%8)*0.4e0 as gap, 2*(w+d)-(feature_id%8)*0.4e0 as length from zones)"


def open_rings(t: Tables):
    """Boundary lines whose last stroke stops short of the start by up to 2.8 m."""
    gap = (F.col("feature_id") % 8) * 0.4
    return t.zones.select("feature_id", "site_id", F.col("object_class").alias("layer"), "w", "d", gap.alias("gap"), (2 * (F.col("w") + F.col("d")) - gap).alias("length"))


@query(
    "work_boundary_build", uses=("zones",), extra=BOUND.replace("w, d,", "w, d, cast(feature_id%5 as double)/10 as e,"),
    sql="""select site_id, feature_id*4 as line, 4::bigint as pieces, round(gap,3) as gap_m, gap=0 or gap<=least(5.0e0, 0.01e0*length) as closed, round(length,3) as length_m,
      case when gap=0 or gap<=least(5.0e0, 0.01e0*length) then round(greatest(w-2*e,0.0e0)*greatest(d-2*e,0.0e0),2) end as area_m2 from bd""",
)
def work_boundary_build(t):
    """Strokes put together to boundary lines; a ring, or a line with a gap of at most 5 m and one per cent of it, encloses an
    area, shrunk by the error of its strokes."""
    strokes = t.boundary_strokes
    lines = cut(chains.lines_of_pieces(strokes), "boundary")
    errors = lines.join(strokes.select("piece_id", "error_m"), "piece_id").groupBy("line").agg(F.max("error_m").alias("error_m"))
    areas = chains.closed_areas(lines, errors, D.bridgeable)
    return areas.select("site_id", "line", "pieces", F.round("gap_m", 3).alias("gap_m"), "closed", F.round("length_m", 3).alias("length_m"), F.round("area_m2", 2).alias("area_m2"))


@query(
    "boundary_gap_report", uses=("zones",), extra=BOUND,
    sql="select site_id, count(*) as gaps, round(max(gap),3) as widest_m, count(distinct layer) as layers from bd where gap>=0.05e0 and gap<=least(5.0e0, 0.01e0*length) group by all",
)
def boundary_gap_report(t):
    """Gaps of the boundary closed by a chord, from 5 cm up: how many, how wide, on which layers."""
    rows = open_rings(t).where(D.bridgeable(F.col("gap"), F.col("length")) & (F.col("gap") >= 0.05))
    return rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("gaps"), F.round(F.max("gap"), 3).alias("widest_m"), F.countDistinct("layer").alias("layers"))
