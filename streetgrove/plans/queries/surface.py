"""Material map, lawns and flowerbeds on the canonical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from streetgrove.functions import geom, rulebook
from streetgrove.operators import graph, selection as C, spatial
from streetgrove.operators import names as N
from streetgrove.operators import planting as L
from streetgrove.operators import surface as U
from streetgrove.plans import checksql as S
from streetgrove.plans import shared
from streetgrove.plans.queries.effect import CURB_PIECES
from streetgrove.plans.queries.names import MATERIAL
from streetgrove.plans.queries.quality import split_curb
from streetgrove.plans.queries.selection import free_cells, free_sql, sample_cells
from streetgrove.plans.registry import Tables, query
from streetgrove.session import cut

SIZE = 5.0
CELL = U.CELL


def local_cell(x: str = "x", y: str = "y", size: float = SIZE):
    return F.floor(F.col(y) / size).cast("int").alias("row"), F.floor((F.col(x) - 1000 * F.col("site_id")) / size).cast("int").alias("col")


GROUND = f"""gl as (select *, rtrim(upper(trim(text)),'.') as u, cast(floor(y/5.0e0) as int) as "row", cast(floor((x-1000*site_id)/5.0e0) as int) as col from ground_labels),
sd as (select * from (select *, {MATERIAL} as kind from gl) where kind is not null)"""
PLACED = """near0 as (select s.label_id, min(row((f."row"-s."row")*(f."row"-s."row")+(f.col-s.col)*(f.col-s.col), f."row", f.col)) as m from sd s join free f on f.site_id=s.site_id and abs(f."row"-s."row")<=4 and abs(f.col-s.col)<=4 group by all),
near1 as (select * from near0 where m[1]<=16),
far as (select s.label_id, min(row((f."row"-s."row")*(f."row"-s."row")+(f.col-s.col)*(f.col-s.col), f."row", f.col)) as m from sd s join free f on f.site_id=s.site_id where s.label_id not in (select label_id from near1) group by all),
mv as (select * from near1 union all select * from far)"""


def labels(t: Tables):
    """Labels of the ground at their cells."""
    return t.ground_labels.select("site_id", "label_id", "text", *local_cell())


def seeds(t: Tables):
    """Labels whose text names a material."""
    return labels(t).withColumn("kind", N.label_material(F.col("text"))).where("kind is not null").select("site_id", "label_id", "row", "col", "kind")


def frame(size: float = SIZE):
    """Rows and columns of a site's grid."""
    return F.lit(int(1000 / size)), F.lit(int(1000 / size))


def grid(t: Tables, size: float = SIZE):
    return C.grid_points(t.sites, size).select(*CELL, "x", "y")


@query(
    "near_extent_filter", uses=("segments", "works"),
    sql="""select object_class, count(*) as kept from segments s join works b using(site_id) where sqrt(power(greatest(b.x0-greatest(s.x1,s.x2), least(s.x1,s.x2)-b.x1, 0.0e0),2)+power(greatest(b.y0-greatest(s.y1,s.y2), least(s.y1,s.y2)-b.y1, 0.0e0),2))<=200 group by all""",
)
def near_extent_filter(t):
    """Objects within 200 m of the box of their site's works; the box test comes first."""
    works = t.works.select("site_id", *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    rows = t.segments.join(works, "site_id")
    dx = F.greatest(F.col("bx0") - F.greatest(F.col("x1"), F.col("x2")), F.least(F.col("x1"), F.col("x2")) - F.col("bx1"), F.lit(0.0))
    dy = F.greatest(F.col("by0") - F.greatest(F.col("y1"), F.col("y2")), F.least(F.col("y1"), F.col("y2")) - F.col("by1"), F.lit(0.0))
    return rows.where((dx <= 200) & (dy <= 200) & (geom.hypot2(dx, dy) <= 200)).groupBy("object_class").agg(F.count(F.lit(1)).alias("kept"))


@query("line_rasterize", uses=("sites", "segments", "rects"), extra=free_sql(SIZE), sql='select site_id, "row", col from barrier')
def line_rasterize(t):
    return sample_cells(t, SIZE).select(*CELL).distinct()


AREA = """zg as (select site_id, cast(r as int) as "row", cast(c as int) as col, x0+(c+0.5e0)*5.0e0 as x, (r+0.5e0)*5.0e0 as y from sites, range(0,200) a(r), range(0,200) b(c)),
zc as (select g.site_id, g."row", g.col, max(case z.object_class when 'territory.square' then 1 when 'territory.park' then 1 when 'territory.street' then 2 when 'territory.yard' then 3 else 4 end) as p from zg g join zones z on z.site_id=g.site_id and g.x>z.x and g.x<z.x+z.w and g.y>z.y and g.y<z.y+z.d group by all)"""


def painted(t: Tables):
    """Cells whose centre lies in an area; soil, paved, unknown and functional are painted in this order."""
    order = F.when(F.col("object_class").isin("territory.square", "territory.park"), 1).when(F.col("object_class") == "territory.street", 2).when(F.col("object_class") == "territory.yard", 3).otherwise(4)
    inside = spatial.contained(grid(t), t.zone_edges, point_key=("row", "col"), area_key=("feature_id", "object_class"))
    return inside.groupBy(*CELL).agg(F.max(order).alias("p"))


def material_of(p="p"):
    return F.when(F.col(p) == 1, "soil").when(F.col(p) == 2, "paved").when(F.col(p) == 3, "unknown").otherwise("functional")


@query("area_rasterize", uses=("sites", "zones"), extra=AREA, sql="""select site_id, "row", col, case p when 1 then 'soil' when 2 then 'paved' when 3 then 'unknown' else 'functional' end as material from zc""")
def area_rasterize(t):
    return painted(t).select(*CELL, material_of().alias("material"))


@query(
    "point_material", uses=("points", "zone_edges", "sites", "segments", "rects"),
    extra=free_sql(SIZE) + """,
  pin as (select p.site_id, p.point_id, z.feature_id, z.object_class from points p join zone_edges z on z.site_id=p.site_id where ((z.y1>p.y)<>(z.y2>p.y)) and p.x < z.x1+(p.y-z.y1)/(z.y2-z.y1)*(z.x2-z.x1) group by all having count(*)%2=1),
  pmx as (select point_id, max(case object_class when 'territory.square' then 1 when 'territory.park' then 1 when 'territory.street' then 2 when 'territory.yard' then 3 else 4 end) as p from pin group by all)""",
    sql="""select p.site_id, p.point_id, case m.p when 1 then 'soil' when 2 then 'paved' when 3 then 'unknown' when 4 then 'functional' else case when f.site_id is not null then 'soil' else 'unknown' end end as material
       from points p left join pmx m using(point_id) left join free f on f.site_id=p.site_id and f."row"=cast(floor(p.y/5.0e0) as int) and f.col=cast(floor((p.x-1000*p.site_id)/5.0e0) as int)""",
)
def point_material(t):
    """Material under a point: the raster, overridden by soil < paved < uncertain < functional areas."""
    points = t.points.select("site_id", "point_id", "x", "y", *local_cell())
    order = F.when(F.col("object_class").isin("territory.square", "territory.park"), 1).when(F.col("object_class") == "territory.street", 2).when(F.col("object_class") == "territory.yard", 3).otherwise(4)
    areas = spatial.lowest_areas(points, t.zone_edges).groupBy("site_id", "point_id").agg(F.max(order).alias("p"))
    raster = free_cells(t, SIZE).select(*CELL, F.lit(True).alias("soil"))
    rows = points.join(raster, CELL, "left").join(areas, ["site_id", "point_id"], "left")
    return rows.select("site_id", "point_id", F.when(F.col("p").isNotNull(), material_of()).when(F.col("soil"), "soil").otherwise("unknown").alias("material"))


@query(
    "surface_summary", uses=("sites", "segments", "rects", "ground_labels"), extra=f"{free_sql(SIZE)},\n{GROUND}",
    sql="""with s as (select site_id, count(*) filter (kind='soil') as soil_labels, count(*) filter (kind='paved') as paved_labels from sd group by all)
       select g.site_id, count(*) as cells, count(f.site_id) as soil, count(*)-count(f.site_id) as other, any_value(soil_labels) as soil_labels, any_value(paved_labels) as paved_labels from grid g left join free f on f.site_id=g.site_id and f."row"=g."row" and f.col=g.col left join s on s.site_id=g.site_id group by g.site_id""",
)
def surface_summary(t):
    """Cells by material and labels by kind."""
    soil = free_cells(t, SIZE).select(*CELL, F.lit(1).alias("soil"))
    cells = grid(t).join(soil, CELL, "left").groupBy("site_id").agg(F.count(F.lit(1)).alias("cells"), F.count("soil").alias("soil"))
    said = seeds(t).groupBy("site_id").agg(F.count_if(F.col("kind") == "soil").alias("soil_labels"), F.count_if(F.col("kind") == "paved").alias("paved_labels"))
    return cells.join(said, "site_id", "left").select("site_id", "cells", "soil", (F.col("cells") - F.col("soil")).alias("other"), "soil_labels", "paved_labels")


@query(
    "material_seeds", uses=("sites", "segments", "rects", "ground_labels"), extra=f"{free_sql(SIZE)},\n{GROUND},\n{PLACED}",
    sql="""select s.label_id, s.site_id, s.kind, m[2] as "row", m[3] as col, m[1]>0 as moved from sd s left join mv using(label_id)""",
)
def material_seeds(t):
    """Seeds of labels by their text; one on a line moves to the nearest free cell."""
    return U.placed_seeds(seeds(t), free_cells(t, SIZE)).select("label_id", "site_id", "kind", "row", "col", "moved")


def free_seeds(t: Tables, free=None):
    """Places of the seeds on free ground."""
    placed = U.placed_seeds(seeds(t), free_cells(t, SIZE) if free is None else free)
    return placed.where("row is not null").select(*CELL, "kind").distinct()


@query(
    "label_spread", uses=("sites", "segments", "rects", "ground_labels"), recursive=True,
    extra=f"{free_sql(SIZE)},\n{GROUND},\n{PLACED}" + """,
  ps as (select distinct s.site_id, m[2] as "row", m[3] as col, s.kind from sd s join mv using(label_id)),
  rc as (select site_id, "row", col, kind, 0 as d from ps
     union select rc.site_id, rc."row"+m.dr, rc.col+m.dc, rc.kind, rc.d+1 from rc, (values (0,1),(0,-1),(1,0),(-1,0)) m(dr,dc), free f where rc.d<6 and f.site_id=rc.site_id and f."row"=rc."row"+m.dr and f.col=rc.col+m.dc),
  ds as (select site_id, "row", col, min(case when kind='paved' then d end) as paved, min(case when kind='soil' then d end) as soil from rc group by all)""",
    sql="""select site_id, "row", col, case when coalesce(paved,1000000)+0.2e0<coalesce(soil,1000000) then 'paved' when coalesce(soil,1000000)+0.2e0<coalesce(paved,1000000) then 'soil' else 'unknown' end as material from ds""",
)
def label_spread(t):
    """Materials flow from the places of labels over free cells up to 30 m and compete; a tie stays unknown."""
    free = cut(free_cells(t, SIZE), "free")
    return U.contest(U.spread(free, free_seeds(t, free), int(U.SPREAD_M / SIZE)), U.AMBIGUITY_M / SIZE)


def soil_grid(t: Tables):
    soil = free_cells(t, SIZE).select(*CELL, F.lit(True).alias("_s"))
    return grid(t).join(soil, CELL, "left").withColumn("soil", F.coalesce("_s", F.lit(False))).drop("_s")


DISTANCE = free_sql(SIZE) + """,
og as (select g.site_id, g."row", g.col, f.site_id is null as other from grid g left join free f on f.site_id=g.site_id and f."row"=g."row" and f.col=g.col),
rg as (select site_id, "row", col, least(col-coalesce(last_value(case when other then col end ignore nulls) over (partition by site_id, "row" order by col), -1),
    coalesce(first_value(case when other then col end ignore nulls) over (partition by site_id, "row" order by col rows between current row and unbounded following), 200)-col) as g from og),
dist as (select f.site_id, f."row", f.col, sqrt(cast(least(min((r."row"-f."row")*(r."row"-f."row")+r.g*r.g), power(least(f."row"+1, 200-f."row"),2)) as double))*5.0e0 as distance_m
   from free f join rg r on r.site_id=f.site_id and r.col=f.col group by f.site_id, f."row", f.col)"""


@query("distance_to_nonsoil", uses=("sites", "segments", "rects"), extra=DISTANCE, sql='select site_id, round(distance_m,3) as distance_m, count(*) as cells from dist group by all')
def distance_to_nonsoil(t):
    """Distance from soil cells to the nearest other cell or the edge of the grid."""
    d = U.distance_to_other(soil_grid(t), SIZE)
    return d.groupBy("site_id", F.round("distance_m", 3).alias("distance_m")).agg(F.count(F.lit(1)).alias("cells"))


@query(
    "fits_soil", uses=("sites", "segments", "rects", "points"), extra=DISTANCE,
    sql="""select p.site_id, p.point_id, coalesce(d.distance_m-5.0e0/sqrt(2.0e0)-sqrt(power(p.x-(1000*p.site_id+(d.col+0.5e0)*5.0e0),2)+power(p.y-(d."row"+0.5e0)*5.0e0,2)) >= case when planting_type='tree' then 1.24e0 else 0.5e0 end, false) as fits
       from points p left join dist d on d.site_id=p.site_id and d."row"=cast(floor(p.y/5.0e0) as int) and d.col=cast(floor((p.x-1000*p.site_id)/5.0e0) as int)""",
)
def fits_soil(t):
    """Does the pit fit the soil raster: cell distance less half a diagonal and the offset of the point."""
    d = U.distance_to_other(soil_grid(t), SIZE)
    points = t.points.select("site_id", "point_id", "planting_type", "x", "y", *local_cell()).join(d, CELL, "left")
    off = geom.hypot2(F.col("x") - (1000 * F.col("site_id") + (F.col("col") + 0.5) * SIZE), F.col("y") - (F.col("row") + 0.5) * SIZE)
    radius = F.when(F.col("planting_type") == "tree", 1.24).otherwise(0.5)
    lower = F.col("distance_m") - F.lit(SIZE) / F.sqrt(F.lit(2.0)) - off
    return points.select("site_id", "point_id", F.coalesce(lower >= radius, F.lit(False)).alias("fits"))


CONFIRMED = """dc as (select point_id, site_id, x as px, y as py, case when planting_type='tree' then 1.24e0 else 0.5e0 end as rad from points),
so as (select distinct site_id, x as ax, y as ay, x+w as bx, y+d as by_ from zones where object_class in ('territory.square','territory.park')),
nr as (select dc.*, so.ax, so.ay, so.bx, so.by_ from dc join so on so.site_id=dc.site_id and ax<px+rad and bx>px-rad and ay<py+rad and by_>py-rad),
gx as (select point_id, px-rad as v from dc union select point_id, px+rad from dc union select point_id, ax from nr where ax>px-rad union select point_id, bx from nr where bx<px+rad),
gy as (select point_id, py-rad as v from dc union select point_id, py+rad from dc union select point_id, ay from nr where ay>py-rad union select point_id, by_ from nr where by_<py+rad),
ix as (select point_id, v as x0, lead(v) over (partition by point_id order by v) as x1 from gx), iy as (select point_id, v as y0, lead(v) over (partition by point_id order by v) as y1 from gy),
bx_ as (select dc.point_id, dc.px, dc.py, dc.rad, x0, x1, y0, y1 from dc join ix on ix.point_id=dc.point_id and x1 is not null join iy on iy.point_id=dc.point_id and y1 is not null where dc.point_id in (select point_id from nr)
   and power(greatest(x0-px, px-x1, 0.0e0),2)+power(greatest(y0-py, py-y1, 0.0e0),2) < rad*rad),
opn as (select distinct b.point_id from bx_ b where not exists (select 1 from nr where nr.point_id=b.point_id and (b.x0+b.x1)/2 between nr.ax and nr.bx and (b.y0+b.y1)/2 between nr.ay and nr.by_)),
fit as (select distinct point_id from nr where point_id not in (select point_id from opn))"""


@query(
    "fits_confirmed_soil", uses=("points", "zones"), extra=CONFIRMED,
    sql="select p.site_id, count(*) as points, count(f.point_id) as confirmed, count(*)-count(f.point_id) as inferred from points p left join fit f using(point_id) group by all",
)
def fits_confirmed_soil(t):
    """Pits wholly inside drawn soil, areas that touch or overlap taken together, against those that rest on inference."""
    discs = t.points.select("site_id", "point_id", "x", "y", F.when(F.col("planting_type") == "tree", 1.24).otherwise(0.5).alias("radius"))
    soil = t.zone_edges.where(F.col("object_class").isin("territory.square", "territory.park"))
    fit = spatial.discs_covered(discs, soil, widest=1.24).withColumn("ok", F.lit(1))
    return discs.join(fit, ["site_id", "point_id"], "left").groupBy("site_id").agg(
        F.count(F.lit(1)).alias("points"), F.count("ok").alias("confirmed"), (F.count(F.lit(1)) - F.count("ok")).alias("inferred"))


def faces(t: Tables):
    return U.components(free_cells(t, SIZE))


@query("closed_face_material")
def closed_face_material(t):
    """Faces of free cells with the labels in them: one material decides, two leave it unresolved.

    Faces are connected cells (the raster stand-in for noded linework); a face that reaches the
    frame is open and decides nothing.
    """
    found = U.face_materials(faces(t), free_seeds(t), *frame())
    return found.groupBy("site_id", "material").agg(F.count(F.lit(1)).alias("faces"), F.sum("cells").alias("cells"))


@query("functional_area_mark")
def functional_area_mark(t):
    """Components under a playground label and smaller than 3000 m2 close as paved, with the label."""
    marks = U.placed_seeds(labels(t).where(N.label_is_functional(F.col("text"))), free_cells(t, SIZE)).where("row is not null")
    return U.functional_faces(faces(t), marks, SIZE).select("site_id", "label_id", "area_m2", "reason")


@query("display_majority_fill")
def display_majority_fill(t):
    """Spread materials tidied per face: a small unlabelled minority takes the majority."""
    free = cut(free_cells(t, SIZE), "free")
    own = cut(free_seeds(t, free), "seeds")
    material = U.contest(U.spread(free, own, int(U.SPREAD_M / SIZE)), U.AMBIGUITY_M / SIZE)
    said = own.select(*CELL, F.col("kind").alias("material"), F.lit(True).alias("_own"))
    cells = U.components(free).join(material, CELL, "left").withColumn("material", F.coalesce("material", F.lit("unknown"))).join(said, [*CELL, "material"], "left").withColumn("labelled", F.coalesce("_own", F.lit(False)))
    return U.majority_fill(cells).groupBy("site_id", "material", "shown").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "soil_polygons", uses=("sites", "segments", "rects"),
    extra=free_sql(SIZE) + """,
  rk as (select site_id, "row", col, col-row_number() over (partition by site_id, "row" order by col) as g from free), rr as (select site_id, "row", min(col) as c0, max(col) as c1 from rk group by site_id, "row", g),
  bk as (select *, "row"-row_number() over (partition by site_id, c0, c1 order by "row") as g from rr)""",
    sql="""select site_id, c0, c1, min("row") as r0, max("row") as r1, (c1-c0+1)*count(*)*25.0e0 as area_m2 from bk group by site_id, c0, c1, g""",
)
def soil_polygons(t):
    """Soil cells merged into row runs and the runs into rectangles."""
    merged = U.blocks(U.row_runs(free_cells(t, SIZE).select(*CELL)))
    return merged.select("site_id", "c0", "c1", "r0", "r1", ((F.col("c1") - F.col("c0") + 1) * (F.col("r1") - F.col("r0") + 1) * SIZE * SIZE).alias("area_m2"))


STAGE = f"""{GROUND},
gm as (select gl.*, sd.kind from gl left join sd using(label_id)),
lin as (select l.label_id, l.kind, l.site_id, z.feature_id, z.object_class from gm l join zone_edges z on z.site_id=l.site_id where ((z.y1>l.y)<>(z.y2>l.y)) and l.x < z.x1+(l.y-z.y1)/(z.y2-z.y1)*(z.x2-z.x1) group by all having count(*)%2=1),
sup as (select label_id, bool_or((kind='soil' and object_class='territory.street') or (kind='paved' and object_class in ('territory.square','territory.park'))) as superseded from lin group by all)"""


@query("stage_label_supersede", uses=("ground_labels", "zone_edges"), extra=STAGE, sql="select site_id, coalesce(kind, 'none') as material, count(*) as labels, count(*) filter (superseded) as superseded from gm left join sup using(label_id) group by all")
def stage_label_supersede(t):
    """Survey labels inside a projected area of the other material are superseded."""
    said = t.ground_labels.select("site_id", F.col("label_id").alias("point_id"), "x", "y", F.coalesce(N.label_material(F.col("text")), F.lit("none")).alias("material"))
    inside = spatial.lowest_areas(said, t.zone_edges, point_key=("point_id", "material"))
    opposite = ((F.col("material") == "soil") & (F.col("object_class") == "territory.street")) | ((F.col("material") == "paved") & F.col("object_class").isin("territory.square", "territory.park"))
    hit = inside.where(opposite).select("site_id", "point_id").distinct().withColumn("gone", F.lit(1))
    return said.join(hit, ["site_id", "point_id"], "left").groupBy("site_id", "material").agg(F.count(F.lit(1)).alias("labels"), F.count("gone").alias("superseded"))


@query(
    "open_ground_fallback", uses=("sites", "segments", "rects", "ground_labels", "zones", "works"), extra=f"{free_sql(SIZE)},\n{GROUND}",
    sql="""with k as (select s.site_id, count(*) as said from sd s join works b on b.site_id=s.site_id and s.x between b.x0 and b.x1 and s.y between b.y0 and b.y1 group by all),
       z as (select z.site_id, count(*) as lawns from zones z join works b on b.site_id=z.site_id and z.x+z.w/2 between b.x0 and b.x1 and z.y+z.d/2 between b.y0 and b.y1 where object_class in ('territory.square','territory.park') group by all)
       select s.site_id, coalesce(said,0) as labels, coalesce(lawns,0) as lawns, coalesce(said,0)=0 and coalesce(lawns,0)=0 as applies,
         case when coalesce(said,0)=0 and coalesce(lawns,0)=0 then (select count(*) from free f join works b on b.site_id=f.site_id and f.x between b.x0 and b.x1 and f.y between b.y0 and b.y1 where f.site_id=s.site_id)*25.0e0 else 0.0e0 end as inferred_m2
       from sites s left join k using(site_id) left join z using(site_id)""",
)
def open_ground_fallback(t):
    """Only where nothing in the area of works names the ground: its open cells count as inferred soil, with their area."""
    works = t.works.select("site_id", *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    within = lambda x, y: x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1"))
    said = t.ground_labels.where(N.label_material(F.col("text")).isNotNull()).join(works, "site_id").where(within(F.col("x"), F.col("y"))).groupBy("site_id").agg(F.count(F.lit(1)).alias("labels"))
    zones = t.zones.where(F.col("object_class").isin("territory.square", "territory.park")).join(works, "site_id")
    lawns = zones.where(within(F.col("x") + F.col("w") / 2, F.col("y") + F.col("d") / 2)).groupBy("site_id").agg(F.count(F.lit(1)).alias("lawns"))
    free = free_cells(t, SIZE).join(works, "site_id").where(within(F.col("x"), F.col("y"))).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    rows = t.sites.select("site_id").join(said, "site_id", "left").join(lawns, "site_id", "left").join(free, "site_id", "left").fillna(0)
    applies = (F.col("labels") == 0) & (F.col("lawns") == 0)
    return rows.select("site_id", "labels", "lawns", applies.alias("applies"), F.when(applies, F.col("n") * SIZE * SIZE).otherwise(0.0).alias("inferred_m2"))


def zone_cells(t: Tables):
    return painted(t).select(*CELL, material_of().alias("material"))


@query("paved_parts_by_label")
def paved_parts_by_label(t):
    """Paved parts with the paving that most of their labels name."""
    parts = U.components(zone_cells(t).where("material = 'paved'").select(*CELL))
    said = labels(t).where(N.label_material(F.col("text")) == "paved").select(*CELL, F.rtrim(F.upper(F.trim("text")), F.lit(".")).alias("word"))
    return U.part_words(parts, said, SIZE).select("site_id", "area_m2", "kind", "labels")


@query("lawn_islands")
def lawn_islands(t):
    """Soil parts that touch nothing but paving and hold a bed label are flowerbeds."""
    material = cut(zone_cells(t), "materials")
    soil = U.components(material.where("material = 'soil'").select(*CELL))
    beds = labels(t).where(N.label_planting(F.col("text")) == "bed")
    return U.islands(material, soil, beds, SIZE).select("site_id", "area_m2", "paved", "other", "flowerbed")


@query(
    "lawns_outside_note", uses=("sites", "zones", "works"), extra=AREA,
    sql="""with c as (select zc.site_id, 1000*zc.site_id+(col+0.5e0)*5.0e0 between x0 and x1 and ("row"+0.5e0)*5.0e0 between y0 and y1 as inside from zc join works using(site_id) where p=1),
       s as (select site_id, count(*) filter (inside)*25.0e0 as inside_m2, count(*) filter (not inside)*25.0e0 as outside_m2 from c group by all)
       select site_id, inside_m2, outside_m2, outside_m2>=500 and inside_m2<=0.05e0*(inside_m2+outside_m2) as warn from s""",
)
def lawns_outside_note(t):
    """Lawn area inside and outside the area of works; nearly all outside means the wrong boundary."""
    works = t.works.select("site_id", *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    x, y = 1000 * F.col("site_id") + (F.col("col") + 0.5) * SIZE, (F.col("row") + 0.5) * SIZE
    inside = x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1"))
    cells = zone_cells(t).where("material = 'soil'").join(works, "site_id")
    areas = cells.groupBy("site_id").agg((F.count_if(inside) * SIZE * SIZE).alias("inside_m2"), (F.count_if(~inside) * SIZE * SIZE).alias("outside_m2"))
    warn = (F.col("outside_m2") >= 500) & (F.col("inside_m2") <= 0.05 * (F.col("inside_m2") + F.col("outside_m2")))
    return areas.withColumn("warn", warn)


def lawn_cells(t: Tables):
    """Free soil off the pits of the plan; kept where a lawn is drawn, new elsewhere."""
    pits = t.points.select("site_id", *local_cell()).distinct()
    drawn = zone_cells(t).where("material = 'soil'").select(*CELL, F.lit(True).alias("_d"))
    soil = free_cells(t, SIZE).select(*CELL).join(pits, CELL, "left_anti").join(drawn, CELL, "left")
    return soil.select(*CELL, F.when(F.col("_d"), "kept").otherwise("new").alias("kind"))


@query("lawn_partition")
def lawn_partition(t):
    """Lawn parts by kind from 5 m2 up, with the rules that stand for them."""
    parts = U.components(lawn_cells(t), "kind").groupBy("site_id", "kind", "face").agg((F.count(F.lit(1)) * SIZE * SIZE).alias("area_m2")).where("area_m2 >= 5")
    rules = t.spark.createDataFrame([(rid, kind) for rid, kind, _ in rulebook.LAWN_RULES], "rule_id string, kind string")
    based = parts.join(F.broadcast(rules.where("kind is not null")), "kind")
    return based.groupBy("site_id", "kind", "rule_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("area_m2").alias("area_m2"))


@query("lawn_kind_by_label")
def lawn_kind_by_label(t):
    """Faces of drawn soil: a lawn word makes a lawn, a bed word without one a bed, else the nearest label decides."""
    cells = U.components(zone_cells(t).where("material = 'soil'").select(*CELL))
    said = labels(t).withColumn("word", N.label_planting(F.col("text"))).where("word is not null")
    kinds = U.planting_of_faces(cells, said.select("site_id", "label_id", "row", "col", "word"), SIZE)
    return kinds.groupBy("site_id", "kind", "by").agg(F.count(F.lit(1)).alias("faces"), F.sum("area_m2").alias("area_m2"))


def flowerbed_centres(t: Tables):
    """Lawn at least 3 m wide, by its distance to paving, thinned to 150 m."""
    wide = U.distance_to_other(soil_grid(t), SIZE).where(F.col("distance_m") >= 5)
    paved = zone_cells(t).where("material = 'paved'").select("site_id", (1000 * F.col("site_id") + (F.col("col") + 0.5) * SIZE).alias("bx"), ((F.col("row") + 0.5) * SIZE).alias("by"))
    cells = wide.select("site_id", *[F.col(c) for c in ("row", "col")], (1000 * F.col("site_id") + (F.col("col") + 0.5) * SIZE).alias("x"), ((F.col("row") + 0.5) * SIZE).alias("y")).withColumn("point_id", F.col("row").cast("long") * 1000 + F.col("col"))
    cells = cut(cells, "wide")
    walk = spatial.nearest_segment(cells, spatial.as_segments(paved, "bx", "by"), (10.0,), payload=()).select("site_id", "point_id", F.round("distance", 1).alias("walk"))
    near = cut(cells.join(walk, ["site_id", "point_id"]), "walk")
    kept = graph.first_spaced_points(near, 150.0, order=("walk", "x", "y", "point_id"))
    return near.join(kept, ["site_id", "point_id"])


@query("flowerbed_sites")
def flowerbed_sites(t):
    """Places of flowerbeds: first by the way to paving, at least 150 m apart."""
    return flowerbed_centres(t).select("site_id", "x", "y", "walk")


# Mixes by light with their plants and shares, nine plants to a square metre.
MIXES = (
    ("sun", "Molinia caerulea", 0.20), ("sun", "Deschampsia cespitosa", 0.15), ("sun", "Nepeta x faassenii", 0.25), ("sun", "Hylotelephium spectabile", 0.20), ("sun", "Aster dumosus", 0.20),
)
DENSITY = 9.0


@query("flowerbed_plants", uses=("zones",), extra=rulebook.sql_values("mx", "light, plant, share", list(MIXES)),
       sql="select feature_id, plant, cast(round_even(w*d*9.0e0*share,0) as bigint) as units from zones, mx where object_class in ('territory.square','territory.park')")
def flowerbed_plants(t):
    """Units of each plant of the mix: area x density x share."""
    mix = F.array(*[F.struct(F.lit(p).alias("plant"), F.lit(s).alias("share")) for light, p, s in MIXES if light == "sun"])
    beds = t.zones.where(F.col("object_class").isin("territory.square", "territory.park")).withColumn("m", F.explode(mix))
    return beds.select("feature_id", "m.plant", F.rint(F.col("w") * F.col("d") * DENSITY * F.col("m.share")).cast("long").alias("units"))


SOIL_PROBES = L.ring_offsets((0.5, 1.0, 1.5, 2.0), 16)


@query(
    "curb_soil", uses=("sites", "segments", "rects"), extra=free_sql(SIZE) + ",\n" + CURB_PIECES.replace("{step}", "5.0e0") + ",\n" + rulebook.sql_values("probe", "dx, dy", [(dx, dy) for _, dx, dy in SOIL_PROBES]),
    sql="""with m as (select site_id, feature_id, k, piece_m, (ax+ex)/2 as x, (ay+ey)/2 as y from pc),
       w as (select distinct m.site_id, m.feature_id, m.k, cast(floor(round(m.y+o.dy,3)/5.0e0) as int) as r, cast(floor((round(m.x+o.dx,3)-1000*m.site_id)/5.0e0) as int) as c from m, probe o),
       h as (select distinct w.feature_id, w.k from w join free f on f.site_id=w.site_id and f."row"=w.r and f.col=w.c)
       select m.site_id, h.k is not null as soil, count(*) as pieces, round(sum(piece_m),3) as length_m from m left join h on h.feature_id=m.feature_id and h.k=m.k group by all""",
)
def curb_soil(t):
    """Kerb pieces whose middle has soil within 2 m: sixteen directions, rings of half a metre."""
    middle = split_curb(t, 5.0).select("site_id", "feature_id", F.col("k").alias("piece"), "piece_m", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    probes = L.at_offsets(middle, SOIL_PROBES).select("site_id", "feature_id", "piece", *local_cell()).distinct()
    soil = probes.join(free_cells(t, SIZE).select(*CELL), CELL, "left_semi").select("site_id", "feature_id", "piece").distinct().withColumn("soil", F.lit(True))
    rows = middle.join(soil, ["site_id", "feature_id", "piece"], "left").withColumn("soil", F.coalesce("soil", F.lit(False)))
    return rows.groupBy("site_id", "soil").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum("piece_m"), 3).alias("length_m"))
