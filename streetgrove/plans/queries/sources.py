"""Scans, sinks and ingest accounting on the canonical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from streetgrove.functions import geom, rulebook
from streetgrove.operators import graph, scan, spatial
from streetgrove.plans import checksql as S
from streetgrove.plans.queries.names import DECIDED, classified
from streetgrove.plans.registry import Tables, query
from streetgrove.sources import geojson, ingest, sinks


@query(
    "rulebook_integrity",
    sql="""with r as (select distinct l_partkey%300 as rule_no, l_suppkey%150 as act from lineitem), a as (select s_suppkey as act from supplier where s_acctbal>0),
       m as (select o_custkey%40 as mix, count(*) as n, sum(case when o_orderpriority='1-URGENT' then 1 else 0 end)/cast(count(*) as double) as share from orders group by all)
       select 'unknown_act' as issue, count(*) as n from (select distinct act from r where act not in (select act from a)) union all
       select 'duplicate_rule', count(*) from (select rule_no from r group by all having count(*)>1) union all select 'mix_share', count(*) from m where abs(share-0.2e0)>0.01e0""",
)
def rulebook_integrity(t):
    """Issues of a rule book: citations without an act, repeated ids, mixes that do not add up."""
    rules = t.lineitem.select((F.col("l_partkey") % 300).alias("rule_no"), (F.col("l_suppkey") % 150).alias("act")).distinct()
    acts = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("act"))
    unknown = rules.select("act").distinct().join(acts, "act", "left_anti").agg(F.lit("unknown_act").alias("issue"), F.count(F.lit(1)).alias("n"))
    repeated = rules.groupBy("rule_no").count().where("count > 1").agg(F.lit("duplicate_rule").alias("issue"), F.count(F.lit(1)).alias("n"))
    mixes = t.orders.groupBy((F.col("o_custkey") % 40).alias("mix")).agg((F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count(F.lit(1))).alias("share"))
    shares = mixes.where(F.abs(F.col("share") - 0.2) > 0.01).agg(F.lit("mix_share").alias("issue"), F.count(F.lit(1)).alias("n"))
    return unknown.unionByName(repeated).unionByName(shares)


@query(
    "species_marks_join", uses=("species",),
    sql="""select species_no, n_nationkey is not null as listed, n_nationkey%2=0 as roads, n_nationkey%3=0 as yards, case when n_nationkey is not null then 'list '||n_regionkey||', row '||n_nationkey end as ref
       from species left join nation on n_nationkey=species_no%31""",
)
def species_marks_join(t):
    """Species with the marks of the official city list found by their reference."""
    marks = t.nation.select(
        F.col("n_nationkey").cast("long").alias("row_no"), F.create_map(F.lit("roads"), F.col("n_nationkey") % 2 == 0, F.lit("yards"), F.col("n_nationkey") % 3 == 0).alias("marks"),
        F.concat(F.lit("list "), F.col("n_regionkey").cast("string"), F.lit(", row "), F.col("n_nationkey").cast("string")).alias("ref"))
    joined = t.species.withColumn("row_no", F.col("species_no") % 31).join(F.broadcast(marks), "row_no", "left")  # the official list is a fixed document
    return joined.select("species_no", F.col("marks").isNotNull().alias("listed"), F.col("marks")["roads"].alias("roads"), F.col("marks")["yards"].alias("yards"), "ref")


def ring(x="x", y="y", w="w", d="d"):
    corner = lambda dx, dy: F.array(F.col(x) + dx, F.col(y) + dy)
    zero = F.lit(0.0)
    return F.array(corner(zero, zero), corner(F.col(w), zero), corner(F.col(w), F.col(d)), corner(zero, F.col(d)), corner(zero, zero))


@query(
    "geojson_layer_scan", uses=("segments", "rects"),
    sql="select feature_id, cast(seg_no as int) as seg_no, x1, y1, x2, y2, 'b'||(feature_id-1000000000) as name from segments where is_area=1",
)
def geojson_layer_scan(t):
    """Rectangles written as GeoJSON text and read back into segments."""
    features = t.rects.select("feature_id", geojson.feature_text(ring(), F.struct(F.concat(F.lit("b"), F.col("suppkey").cast("string")).alias("name"))).alias("text"))
    back = geojson.rings(geojson.records(features))
    return back.select("feature_id", "seg_no", "x1", "y1", "x2", "y2", F.col("properties")["name"].alias("name"))


@query(
    "zones_geojson_sink", uses=("zones",),
    sql="""select feature_id, '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[['||x||','||y||'],['||(x+w)||','||y||'],['||(x+w)||','||(y+d)||'],['||x||','||(y+d)||'],['||x||','||y||']]]},"properties":{"class":"'||object_class||'"}}' as text from zones""",
)
def zones_geojson_sink(t):
    """Plan areas as GeoJSON features in drawing metres, a line of JSON each, written beside their number."""
    return sinks.written(t.zones.select("feature_id", geojson.feature_text(ring(), F.struct(F.col("object_class").alias("class"))).alias("text")), "zones", "json", None)


CRS = """lay as (select c_nationkey as layer, case when c_nationkey%3=0 then 37.0e0+(c_custkey%1000)/5000.0e0 when c_nationkey%3=1 then cast(c_custkey as double) else 37.0e0+(c_custkey%1000)/100.0e0 end as x,
   case when c_nationkey%3=0 then 55.5e0+(c_custkey%777)/5000.0e0 else cast(c_custkey%500 as double) end as y, case when c_nationkey=7 then 'EPSG:32637' end as declared from customer)"""


@query(
    "layer_crs_decide", extra=CRS,
    sql="""select layer, count(*) as objects, case when max(declared) is not null then max(declared) when min(x)>=-180 and max(x)<=180 and min(y)>=-90 and max(y)<=90 and max(x)-min(x)<=1 and max(y)-min(y)<=1 then 'EPSG:4326' else 'local' end as crs,
       case when max(declared) is not null or (min(x)>=-180 and max(x)<=180 and min(y)>=-90 and max(y)<=90 and max(x)-min(x)<=1 and max(y)-min(y)<=1) then 1.0e0 else 0.0e0 end as transform_error_m from lay group by all""",
)
def layer_crs_decide(t):
    kind = F.col("c_nationkey") % 3
    x = F.when(kind == 0, 37.0 + (F.col("c_custkey") % 1000) / 5000.0).when(kind == 1, F.col("c_custkey").cast("double")).otherwise(37.0 + (F.col("c_custkey") % 1000) / 100.0)
    y = F.when(kind == 0, 55.5 + (F.col("c_custkey") % 777) / 5000.0).otherwise((F.col("c_custkey") % 500).cast("double"))
    rows = t.customer.select(F.col("c_nationkey").alias("layer"), x.alias("x"), y.alias("y"), F.when(F.col("c_nationkey") == 7, "EPSG:32637").alias("declared"))
    return ingest.layer_crs(rows, ("layer",)).select("layer", "objects", "crs", "transform_error_m")


LAYER_RULES = (
    {"file": "^SMALL", "class": "zone.gas", "also": "utility.gas"}, {"any_value": "^red", "class": "parcel.private"},
    {"attribute": "kind", "value": "^Brand#1", "class": "zone.power_line", "also": "power_line_overhead"}, {"attribute": "green_class", "class": "from_attribute"},
)
ATTR = """att as (select p_partkey as id, p_type as file, p_name, p_brand, case when p_size%10=0 then 'building' else '' end as gc from part),
atc as (select *, case when starts_with(file,'SMALL') then 0 when starts_with(p_name,'red') then 1 when starts_with(p_brand,'Brand#1') then 2 when gc<>'' then 3 end as rule from att)"""


def attributes(t: Tables):
    props = F.create_map(F.lit("name"), F.col("p_name"), F.lit("kind"), F.col("p_brand"), F.lit("green_class"), F.when(F.col("p_size") % 10 == 0, "building").otherwise(""))
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("file"), props.alias("properties"))


def layer_objects(t: Tables):
    found = attributes(t).withColumn("r", ingest.attribute_rule(LAYER_RULES))
    return found.where(F.col("r").isNotNull()).select("id", "file", F.explode(F.array_compact(F.array(F.col("r.cls"), F.col("r.also")))).alias("object_class"), F.col("r.rule").alias("rule"))


CLASSED = """lob as (select id, file, rule, case rule when 0 then 'zone.gas' when 1 then 'parcel.private' when 2 then 'zone.power_line' else gc end as object_class from atc where rule is not null
  union all select id, file, rule, case rule when 0 then 'utility.gas' else 'power_line_overhead' end from atc where rule in (0,2))"""


@query("layer_attribute_classify", extra=f"{ATTR},\n{CLASSED}", sql="select id, object_class, cast(rule as int) as rule from lob")
def layer_attribute_classify(t):
    """First rule that holds decides the class; ``also`` adds a second object."""
    return layer_objects(t).select("id", "object_class", "rule")


@query(
    "layer_inject", uses=("drawn",), extra=f"{DECIDED},\n{ATTR},\n{CLASSED}",
    sql="""select 'drawing' as origin, object_class, count(*) as features, 0.0e0 as reserve_m from fb group by all union all select 'layer '||file, object_class, count(*), 1.0e0 from lob group by all
       union all select 'layer '||file, 'skipped', count(*), cast(null as double) from atc where rule is null group by all""",
)
def layer_inject(t):
    """Scene after classification with the layer objects added, their error, and what was skipped."""
    drawing = classified(t).select(F.lit("drawing").alias("origin"), "object_class", F.lit(0.0).alias("reserve_m"))
    layers = layer_objects(t).select(F.concat(F.lit("layer "), "file").alias("origin"), "object_class", F.lit(1.0).alias("reserve_m"))
    silent = attributes(t).where(ingest.attribute_rule(LAYER_RULES).isNull()).select(F.concat(F.lit("layer "), "file").alias("origin"), F.lit("skipped").alias("object_class"), F.lit(None).cast("double").alias("reserve_m"))
    return drawing.unionByName(layers).unionByName(silent).groupBy("origin", "object_class", "reserve_m").agg(F.count(F.lit(1)).alias("features"))


ROAD_WIDTHS = {"ECONOMY": 14.0, "PROMO": 7.0, "LARGE": 4.0}


@query(
    "osm_context_extract",
    sql="""with e as (select p_partkey as id, p_type, p_size, p_name, p_size%2=0 as closed from part)
       select id, case when p_type='SMALL' then 'tree' when p_type='STANDARD' and closed then 'building' when p_type='MEDIUM' and closed and p_name like 'red%' then 'green' when p_type='MEDIUM' and closed and p_name not like 'blue%' then 'parking' when p_type in ('ECONOMY','PROMO','LARGE') then 'road' end as kind,
         case when p_type='STANDARD' and closed then greatest(1, least(p_size, 100)) end as levels, case p_type when 'ECONOMY' then 14.0e0 when 'PROMO' then 7.0e0 when 'LARGE' then 4.0e0 end as width_m
       from e where p_type='SMALL' or (p_type='STANDARD' and closed) or (p_type='MEDIUM' and closed and (p_name like 'red%' or p_name not like 'blue%')) or p_type in ('ECONOMY','PROMO','LARGE')""",
)
def osm_context_extract(t):
    """Map elements as JSON text to typed context objects."""
    at = lambda lon, lat: F.struct(F.lit(lon).alias("lon"), F.lit(lat).alias("lat"))
    closed = F.array(at(37.6, 55.7), at(37.7, 55.7), at(37.7, 55.8), at(37.6, 55.7))
    geometry = F.when(F.col("p_size") % 2 == 0, closed).otherwise(F.array(at(37.6, 55.7), at(37.7, 55.7)))
    kind = F.col("p_type")
    tags = (
        F.when(kind == "SMALL", F.create_map(F.lit("natural"), F.lit("tree"))).when(kind == "STANDARD", F.create_map(F.lit("building"), F.lit("yes"), F.lit("building:levels"), F.col("p_size").cast("string")))
        .when((kind == "MEDIUM") & F.col("p_name").startswith("red"), F.create_map(F.lit("leisure"), F.lit("park")))
        .when(kind == "MEDIUM", F.create_map(F.lit("amenity"), F.lit("parking"), F.lit("parking"), F.when(F.col("p_name").startswith("blue"), "underground").otherwise("surface")))
        .otherwise(F.create_map(F.lit("highway"), kind))
    )
    text = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.when(kind == "SMALL", "node").otherwise("way").alias("type"), tags.alias("tags"), geometry.alias("geometry")))
    element = F.from_json(F.col("text"), "id long, type string, tags map<string,string>, geometry array<struct<lon:double,lat:double>>")
    rows = t.part.select(text.alias("text")).select(element.alias("e")).select("e.*")
    is_ring = (F.size("geometry") >= 4) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    tag = lambda k: F.col("tags")[k]
    what = (
        F.when((F.col("type") == "node") & (tag("natural") == "tree"), "tree").when(tag("building").isNotNull() & is_ring, "building").when(tag("leisure").isin("park", "garden") & is_ring, "green")
        .when((tag("amenity") == "parking") & ~F.coalesce(tag("parking"), F.lit("")).isin("underground", "multi-storey", "rooftop") & is_ring, "parking").when(tag("highway").isNotNull(), "road")
    )
    levels = F.greatest(F.lit(1), F.least(F.regexp_extract(tag("building:levels"), r"\d+", 0).cast("int"), F.lit(100)))
    widths = F.create_map(*[v for k, w in ROAD_WIDTHS.items() for v in (F.lit(k), F.lit(w))])
    return rows.withColumn("kind", what).where("kind is not null").select(
        "id", "kind", F.when(F.col("kind") == "building", levels).alias("levels"), F.when(F.col("kind") == "road", widths[tag("highway")]).alias("width_m"))


@query(
    "tile_layer_scan", uses=("stems",),
    sql="select site_id, stem_id from stems where x+crown_m/2 >= 1000*site_id+200 and x-crown_m/2 <= 1000*site_id+600 and y+crown_m/2>=150 and y-crown_m/2<=700",
)
def tile_layer_scan(t):
    """Objects of the square tiles that touch an extent, once each, kept when their box meets it."""
    size = 250.0
    r = F.col("crown_m") / 2
    tiled = t.stems.withColumn("tx", F.explode(geom.cell_range(F.col("x") - r, F.col("x") + r, size))).withColumn("ty", F.explode(geom.cell_range(F.col("y") - r, F.col("y") + r, size)))
    x0, x1 = 1000 * F.col("site_id") + 200.0, 1000 * F.col("site_id") + 600.0
    wanted = tiled.where(F.col("tx").between(geom.cell_of(x0, size), geom.cell_of(x1, size)) & F.col("ty").between(geom.cell_of(F.lit(150.0), size), geom.cell_of(F.lit(700.0), size)))
    once = wanted.dropDuplicates(["site_id", "stem_id"])
    meets = (F.col("x") + r >= x0) & (F.col("x") - r <= x1) & (F.col("y") + r >= 150.0) & (F.col("y") - r <= 700.0)
    return once.where(meets).select("site_id", "stem_id")


@query(
    "context_without_survey", uses=("zones", "rects", "stems", "works"),
    sql="""with k as (select * from zones z where w*d>=1500 and not exists (select 1 from rects r where r.site_id=z.site_id and r.x<=z.x+z.w and r.x+r.w>=z.x and r.y<=z.y+z.d and r.y+r.d>=z.y)),
       b as (select site_id, count(*) as buildings from k group by all),
       t as (select site_id, count(*) as trees from stems s join works b using(site_id) where not (s.x between b.x0 and b.x1 and s.y between b.y0 and b.y1) group by all), n as (select site_id, count(*) as n from zones group by all)
       select n.site_id, coalesce(buildings,0) as buildings, n-coalesce(buildings,0) as dropped, trees from n left join b using(site_id) left join t using(site_id)""",
)
def context_without_survey(t):
    """Map buildings that do not repeat surveyed ones, and trees outside the surveyed box."""
    cell = 64.0

    def boxed(df, names):
        x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("d")
        out = df.select("site_id", "feature_id", x0.alias(names + "x0"), y0.alias(names + "y0"), x1.alias(names + "x1"), y1.alias(names + "y1"))
        return out.withColumn("cx", F.explode(geom.cell_range(F.col(names + "x0"), F.col(names + "x1"), cell))).withColumn("cy", F.explode(geom.cell_range(F.col(names + "y0"), F.col(names + "y1"), cell)))

    large = t.zones.where(F.col("w") * F.col("d") >= 1500)
    meets = (F.col("rx0") <= F.col("zx1")) & (F.col("rx1") >= F.col("zx0")) & (F.col("ry0") <= F.col("zy1")) & (F.col("ry1") >= F.col("zy0"))
    hit = boxed(large, "z").join(boxed(t.rects, "r").drop("feature_id"), ["site_id", "cx", "cy"]).where(meets).select("site_id", "feature_id").distinct()
    kept = large.join(hit, ["site_id", "feature_id"], "left_anti").groupBy("site_id").agg(F.count(F.lit(1)).alias("buildings"))
    works = t.works.select("site_id", *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    surveyed = F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1"))
    trees = t.stems.join(works, "site_id").where(~surveyed).groupBy("site_id").agg(F.count(F.lit(1)).alias("trees"))
    total = t.zones.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    rows = total.join(kept, "site_id", "left").join(trees, "site_id", "left").fillna(0, ["buildings"])
    return rows.select("site_id", "buildings", (F.col("n") - F.col("buildings")).alias("dropped"), "trees")


PLANTS = ("Липа мелколистная \"Грин\"", "Клён остролистный (крупномер)", "Берёза", "самосев ясеня", "Итого деревьев", "Дуб черешчатый шт", "Ель колючая куст")
PLANT_SQL = "case c_custkey%7 when 0 then 'Липа мелколистная \"Грин\"' when 1 then 'Клён остролистный (крупномер)' when 2 then 'Берёза' when 3 then 'самосев ясеня' when 4 then 'Итого деревьев' when 5 then 'Дуб черешчатый шт' else 'Ель колючая куст' end"
CATALOG = (("tilia", "Липа мелколистная", 4), ("tilia2", "Липа крупнолистная", 5), ("acer", "Клён остролистный", 1), ("betula", "Берёза повислая", 2), ("quercus", "Дуб красный", 3), ("picea", "Ель", 6))


def sheet(t: Tables):
    k = F.col("c_custkey")
    plant = F.array(*[F.lit(p) for p in PLANTS])[(k % 7).cast("int")]
    row = F.floor(k / 5)
    body = F.array(row.cast("string"), plant, F.when(k % 11 == 0, "").otherwise((1 + k % 4).cast("string")), F.when(F.col("c_acctbal") < 0, "вырубить").otherwise("сохранить"))
    header = F.array(F.lit("№"), F.lit("Наименование пород"), F.lit("Кол-во, шт."), F.lit("Заключение"))
    cells = F.when(row < 4, F.array(F.lit("ведомость"))).when(row == 4, header).otherwise(body)
    return t.customer.select((k % 5).alias("site_id"), row.cast("int").alias("row_no"), cells.alias("cells"))


INV = f"""inv as (select c_custkey%5 as site_id, {PLANT_SQL} as name, case when c_custkey%11=0 then null else 1+c_custkey%4 end as n, c_acctbal<0 as removed from customer where floor(c_custkey/5)>4),
spr as (select *, coalesce(n,1) as cnt from inv where name<>'Итого деревьев')"""


@query(
    "inventory_scan", extra=INV,
    sql="""select site_id, count(*) as rows_read, count(*) filter (removed) as rows_removed, cast(sum(case when removed then cnt else 0 end) as bigint) as removed, count(*) filter (not removed and n is null) as rows_without_count,
       cast(sum(case when not removed then cnt else 0 end) as bigint) as kept from spr group by all""",
)
def inventory_scan(t):
    """Census sheet: header found by its words, service rows dropped, removals counted apart."""
    rows = ingest.species_rows(ingest.sheet_rows(sheet(t), "site_id"))
    kept = ~F.col("removed")
    return rows.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("removed")).alias("rows_removed"), F.sum(F.when(F.col("removed"), F.col("n")).otherwise(0)).alias("removed"),
        F.count_if(kept & F.col("without_count")).alias("rows_without_count"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept"))


@query(
    "inventory_name_match", extra=INV,
    sql="""with m as (select *, case when name like 'Липа%' then 'tilia' when name like 'Клён%' then 'acer' when name like 'Берёза%' then 'betula' when name like 'Дуб%' then 'quercus' when name like 'Ель%' then 'picea' end as code from spr where not removed)
       select site_id, coalesce(code, 'unmatched') as code, coalesce(code in ('tilia','acer'), false) as exact, count(*) as rows, cast(sum(cnt) as bigint) as n from m group by all""",
)
def inventory_name_match(t):
    """Names of the sheet matched to the catalogue: two words, one word, then the genus."""
    catalog = t.spark.createDataFrame(list(CATALOG), "code string, name string, rank int")
    rows = ingest.species_rows(ingest.sheet_rows(sheet(t), "site_id")).where(~F.col("removed"))
    found = ingest.match_plants(rows, catalog)
    return rows.join(found, "name").groupBy("site_id", F.coalesce("code", F.lit("unmatched")).alias("code"), "exact").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))


@query(
    "drawing_package_union", uses=("points",),
    sql="""with f as (select site_id, mode as file, count(*) as n, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from points group by all)
       select a.site_id, a.file as first, b.file as second, a.n+b.n as features, round((least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0))/least((a.x1-a.x0)*(a.y1-a.y0),(b.x1-b.x0)*(b.y1-b.y0)),5) as overlap
       from f a join f b on a.site_id=b.site_id and a.file<b.file where least(a.x1,b.x1)>=greatest(a.x0,b.x0) and least(a.y1,b.y1)>=greatest(a.y0,b.y0)""",
)
def drawing_package_union(t):
    """Files of one street as one layer set, with the overlap of their extents."""
    files = t.points.groupBy("site_id", F.col("mode").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    a, b = files.alias("a"), files.alias("b")
    w = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    h = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    smaller = F.least(area("a"), area("b"))
    pairs = a.join(b, (F.col("a.site_id") == F.col("b.site_id")) & (F.col("a.file") < F.col("b.file"))).where((w >= 0) & (h >= 0))  # files of one street, a handful
    overlap = F.when(smaller <= 0, 1.0).otherwise(w * h / smaller)
    return pairs.select("a.site_id", F.col("a.file").alias("first"), F.col("b.file").alias("second"), (F.col("a.n") + F.col("b.n")).alias("features"), F.round(overlap, 5).alias("overlap"))


@query(
    "street_catalog_scan",
    sql="""select o_custkey as street, count(*) as files, round(sum(o_totalprice),0) as size, min(o_orderstatus) as unit from orders where o_custkey in (select o_custkey from orders where o_orderpriority='1-URGENT') group by all""",
)
def street_catalog_scan(t):
    """Streets of the catalogue with their files; streets without a main file are dropped."""
    main = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey").distinct()
    files = t.orders.join(main, "o_custkey", "left_semi")
    return files.groupBy(F.col("o_custkey").alias("street")).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("o_totalprice"), 0).alias("size"), F.min("o_orderstatus").alias("unit"))


UNITS = """uf as (select site_id||'/'||mode as file, case mode when 'alley' then 0.001e0 when 'lawn' then 1.0e0 end as header_m, x*k as x, y*k as y, case when mode='fill' then percent*100.0e0 else percent/10.0e0 end*case when k>1 then 1000 else 1 end as text_h
   from (select *, case when mode in ('groups','lawn') and site_id>=3 then 1000.0e0 else 1.0e0 end as k from points)),
us as (select file, header_m, greatest(max(x)-min(x), max(y)-min(y)) as size, quantile_cont(text_h,0.5) as txt, count(*) as anchors from uf group by all)"""


@query(
    "unit_decide", uses=("points",), extra=UNITS,
    sql="""select file, round(size,3) as size, round(txt,3) as text_h, how, case when how='header' then header_m when how in ('conflict_m','guess_m','fallback_m') then 1.0e0 when how='error' then null else 0.001e0 end as unit_m from (select *,
       case when header_m is not null and header_m<1 and size*header_m<10 and txt<20 then 'conflict_m' when header_m>=1 and size*header_m>100000 and txt>=20 and size*0.001e0 between 10 and 100000 then 'conflict_mm' when header_m>=1 and size*header_m>100000 and txt>=20 then 'error'
         when header_m is not null then 'header' when size>=10 and size<=10000 and txt<20 then 'guess_m' when size>10000 and size*0.001e0<=100000 and txt>=20 then 'guess_mm' when size>10000 then 'fallback_mm' else 'fallback_m' end as how from us)""",
)
def unit_decide(t):
    k = F.when(F.col("mode").isin("groups", "lawn") & (F.col("site_id") >= 3), 1000.0).otherwise(1.0)
    text = F.when(F.col("mode") == "fill", F.col("percent") * 100.0).otherwise(F.col("percent") / 10.0) * F.when(k > 1, 1000).otherwise(1)
    files = t.points.select(
        F.concat_ws("/", F.col("site_id").cast("string"), "mode").alias("file"), F.when(F.col("mode") == "alley", 0.001).when(F.col("mode") == "lawn", 1.0).alias("header_m"),
        (F.col("x") * k).alias("x"), (F.col("y") * k).alias("y"), text.alias("text_h"))
    return ingest.unit_scale(files).select("file", F.round("size", 3).alias("size"), F.round("text", 3).alias("text_h"), "how", "unit_m")


@query(
    "geometry_error_reserve", uses=("drawn",),
    sql="select kind, count(*) as objects, count(*) filter (error_m is null) as assumed, max(coalesce(error_m, 0.5e0)) as reserve_m, count(*) filter (error_m is null)=0 as strict_ok from drawn group by all",
)
def geometry_error_reserve(t):
    """Objects whose approximation error is unknown get a reserve of half a metre, and are counted."""
    unknown = F.col("error_m").isNull()
    return t.drawn.groupBy("kind").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(unknown).alias("assumed"), F.max(F.coalesce("error_m", F.lit(ingest.ASSUMED_ERROR_M))).alias("reserve_m"), (F.count_if(unknown) == 0).alias("strict_ok"))


@query(
    "read_accounting",
    sql="""with v as (select l_orderkey*10+l_linenumber as ref, l_returnflag as type, l_linestatus as layer, case when l_linenumber<=3 then 'read' when l_linenumber<=5 then 'annotation' else 'gap' end as outcome, l_linenumber as reason, l_orderkey from lineitem),
       r as (select *, row_number() over (partition by type, layer, outcome, reason order by ref, l_orderkey) as rn from v),
       seen as (select type, layer, count(distinct ref) as seen, count(*) as outcomes from v group by all)
       select type, layer, outcome, reason, count(*) as n, list_sort(list(ref) filter (rn<=5)) as examples, any_value(seen)=any_value(outcomes) as counted from r join seen using(type, layer) group by all""",
)
def read_accounting(t):
    """Outcomes of the visited primitives, gaps grouped with a few examples each; ``counted`` where a layer has as many outcomes as primitives."""
    outcome = F.when(F.col("l_linenumber") <= 3, "read").when(F.col("l_linenumber") <= 5, "annotation").otherwise("gap")
    visited = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("layer"), outcome.alias("outcome"), F.col("l_linenumber").alias("reason"))
    keys = ["type", "layer", "outcome", "reason"]
    counts = visited.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    firsts = scan.top_k(visited, 5, by=keys, order=(F.col("ref"),)).groupBy(*keys).agg(F.sort_array(F.collect_list("ref")).alias("examples"))
    seen = visited.groupBy("type", "layer").agg((F.countDistinct("ref") == F.count(F.lit(1))).alias("counted"))
    return counts.join(firsts, keys).join(seen, ["type", "layer"])


INK = f"""smp as (select site_id, feature_id, k, len/n as w, x+case when vertical=0 then len*((k+0.5e0)/n) else 0.0e0 end as x, y+case when vertical=1 then len*((k+0.5e0)/n) else 0.0e0 end as y
   from (select *, unnest(range(0,n)) as k from (select *, cast(ceil(len/2.0e0) as bigint) as n from lines))),
rd as (select * from segments where is_area=0 and feature_id%50<>0),
cov as (select distinct p.feature_id, p.k from smp p join rd s on s.site_id=p.site_id and p.x between least(s.x1,s.x2)-1 and greatest(s.x1,s.x2)+1 and p.y between least(s.y1,s.y2)-1 and greatest(s.y1,s.y2)+1 where {S.seg_dist()}<=0.15e0)"""


@query(
    "ink_coverage_check", uses=("lines", "segments"), extra=INK,
    sql="""select site_id, cast(floor(x/200) as bigint) as wx, cast(floor(y/200) as bigint) as wy, round(sum(w),4) as ink_m, round(sum(case when c.feature_id is null then w else 0 end),4) as missed_m
       from smp s left join cov c on c.feature_id=s.feature_id and c.k=s.k group by all""",
)
def ink_coverage_check(t):
    """Drawn ink by window and what of it no read geometry follows within 0.15 m."""
    n = F.ceil(F.col("len") / 2.0).cast("int")
    pieces = t.lines.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    along = F.col("len") * ((F.col("k") + 0.5) / F.col("n"))
    samples = pieces.select(
        "site_id", "feature_id", "k", (F.col("len") / F.col("n")).alias("w"), (F.col("x") + F.when(F.col("vertical") == 0, along).otherwise(0.0)).alias("x"), (F.col("y") + F.when(F.col("vertical") == 1, along).otherwise(0.0)).alias("y"))
    read = t.segments.where("is_area = 0 and feature_id % 50 <> 0").select("site_id", "x1", "y1", "x2", "y2")
    covered = spatial.near_segments(samples, read, 0.15, cell=8.0, spread=("feature_id", "k")).select("site_id", "feature_id", "k").distinct().withColumn("ok", F.lit(True))
    rows = samples.join(covered, ["site_id", "feature_id", "k"], "left")
    return rows.groupBy("site_id", geom.cell_of("x", 200.0).alias("wx"), geom.cell_of("y", 200.0).alias("wy")).agg(
        F.round(F.sum("w"), 4).alias("ink_m"), F.round(F.sum(F.when(F.col("ok").isNull(), F.col("w")).otherwise(0.0)), 4).alias("missed_m"))


@query(
    "entity_fingerprint_diff",
    sql="""select case when o_orderkey%23=0 then 'missing' when o_orderkey%17=0 then 'changed' else 'unchanged' end as status, count(*) as entities from orders group by all union all select 'added', count(*) from orders where o_orderkey%29=0""",
)
def entity_fingerprint_diff(t):
    """Content hash of every entity before and after a write."""
    hashed = lambda df: df.select("key", F.sha2(F.to_json(F.struct("x", "s")), 256).alias("h"))
    rows = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("x"), F.col("o_orderstatus").alias("s"))
    after = rows.where(F.col("key") % 23 != 0).withColumn("x", F.when(F.col("key") % 17 == 0, F.col("x") + 1).otherwise(F.col("x")))
    added = rows.where(F.col("key") % 29 == 0).withColumn("key", -1 - F.col("key"))
    both = hashed(rows).withColumnRenamed("h", "before").join(hashed(after.unionByName(added)).withColumnRenamed("h", "after"), "key", "full")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "missing").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return both.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("entities"))


EXPORT = """ex as (select point_id as id, x+case when percent=3 then 0.01e0 else 0.0e0 end as x, y, case when percent=5 then species_no+1 else species_no end as species_no, status from points where percent<>7
   union all select point_id, x, y, species_no, status from points where percent=9 union all select -1-point_id, x, y, species_no, status from points where percent=11)"""


@query(
    "export_reconcile", uses=("points",), extra=EXPORT,
    sql="""with c as (select id, count(*) as n, min(x) as x, min(y) as y, min(species_no) as species_no, min(status) as status from ex group by all)
      select coalesce(p.point_id, c.id) as id, case when p.point_id is null then 'not_in_plan' when c.id is null then 'not_written' when n>1 then 'repeated' when abs(p.x-c.x)>0.001e0 or abs(p.y-c.y)>0.001e0 then 'coordinates' when p.species_no<>c.species_no then 'species' else 'verdict' end as issue
      from points p full join c on c.id=p.point_id where p.point_id is null or c.id is null or n>1 or abs(p.x-c.x)>0.001e0 or abs(p.y-c.y)>0.001e0 or p.species_no<>c.species_no or p.status<>c.status""",
)
def export_reconcile(t):
    """Written plan against the certified one: one record per id, same place, species and verdict."""
    p = t.points.select("point_id", "x", "y", "species_no", "status", "percent")
    moved = p.where("percent <> 7").select(
        F.col("point_id").alias("id"), (F.col("x") + F.when(F.col("percent") == 3, 0.01).otherwise(0.0)).alias("wx"), F.col("y").alias("wy"),
        F.when(F.col("percent") == 5, F.col("species_no") + 1).otherwise(F.col("species_no")).alias("ws"), F.col("status").alias("wv"))
    repeated = p.where("percent = 9").select(F.col("point_id").alias("id"), F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("species_no").alias("ws"), F.col("status").alias("wv"))
    foreign = p.where("percent = 11").select((-1 - F.col("point_id")).alias("id"), F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("species_no").alias("ws"), F.col("status").alias("wv"))
    written = moved.unionByName(repeated).unionByName(foreign).groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("wx", "wy", "ws", "wv")])
    both = p.join(written, F.col("point_id") == F.col("id"), "full")
    far = (F.abs(F.col("x") - F.col("wx")) > 0.001) | (F.abs(F.col("y") - F.col("wy")) > 0.001)
    issue = (
        F.when(F.col("point_id").isNull(), "not_in_plan").when(F.col("id").isNull(), "not_written").when(F.col("n") > 1, "repeated").when(far, "coordinates")
        .when(~F.col("species_no").eqNullSafe(F.col("ws")), "species").when(~F.col("status").eqNullSafe(F.col("wv")), "verdict")
    )
    return both.withColumn("issue", issue).where("issue is not null").select(F.coalesce("point_id", "id").alias("id"), "issue")


@query(
    "vegetation_census", uses=("stems",),
    sql="""select site_id, count(*) as source, count(*) filter (stem_id%10<>3)+count(*) filter (stem_id%20=1) as scene, count(*) filter (stem_id%10=3) as missing, count(*) filter (stem_id%20=1) as extra from stems group by all""",
)
def vegetation_census(t):
    """Every vegetation sign reaches the scene once: one-to-one pairs within 1 mm, the rest listed.

    Signs choose in their order the nearest free anchor, which is the first independent set of the
    candidate pairs ordered by (sign, distance).
    """
    source = t.stems.select("site_id", F.col("stem_id").alias("point_id"), "x", "y")
    shifted = t.stems.where("stem_id % 10 <> 3").select("site_id", F.col("stem_id").alias("anchor"), (F.col("x") + 0.0004).alias("bx"), F.col("y").alias("by"))
    doubled = t.stems.where("stem_id % 20 = 1").select("site_id", (F.lit(1000000000) + F.col("stem_id")).alias("anchor"), (F.col("x") + 0.0006).alias("bx"), F.col("y").alias("by"))
    anchors = shifted.unionByName(doubled)
    # Two anchors of one sign lie within twice the tolerance, so a cell of 1 m holds them together.
    pairs = spatial.near_segments(source, anchors.select("site_id", "anchor", F.col("bx").alias("x1"), F.col("by").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2")), 0.001, cell=1.0)
    pairs = pairs.select("site_id", "point_id", "anchor", "distance", F.xxhash64("point_id", "anchor").alias("id"))
    ends = pairs.select("id", F.explode(F.array(F.concat(F.lit("s"), F.col("point_id").cast("string")), F.concat(F.lit("a"), F.col("anchor").cast("string")))).alias("end"))
    other = ends.select(F.col("id").alias("b"), "end")
    edges = ends.select(F.col("id").alias("a"), "end").join(other, "end").where("a < b").select("a", "b")
    kept = pairs.join(graph.first_independent_set(pairs, edges, order=("point_id", "distance", "anchor")), "id")
    a = source.groupBy("site_id").agg(F.count(F.lit(1)).alias("source"))
    b = anchors.groupBy("site_id").agg(F.count(F.lit(1)).alias("scene"))
    m = kept.groupBy("site_id").agg(F.count(F.lit(1)).alias("paired"))
    rows = a.join(b, "site_id").join(m, "site_id", "left").fillna(0, ["paired"])
    return rows.select("site_id", "source", "scene", (F.col("source") - F.col("paired")).alias("missing"), (F.col("scene") - F.col("paired")).alias("extra"))


# How much coarser each street is drawn than at full detail, 1 to 2: a setting of the street, whatever else is loaded.
COARSER = {0: 1.0, 1: 1.25, 2: 1.5, 3: 2.0}
TOLERANCE_M, SPAN_FLOOR_M = 0.15, 0.5  # fixed values
BASEMAP = f"""bm as (select *, case site_id {" ".join(f"when {site} then cast({cut} as double)" for site, cut in COARSER.items())} else cast(1 as double) end as cut from features),
bd as (select *, case when object_class='utility.telecom' then 'hidden' when len<cast({TOLERANCE_M} as double)*cut then 'degenerate' when cut>1 and len<cast({SPAN_FLOOR_M} as double)*cut then 'small' else 'kept' end as reason from bm)"""


@query("basemap_prune", uses=("features",), extra=BASEMAP, sql="select object_class, reason, count(*) as features from bd group by all")
def basemap_prune(t):
    """What the map drops and why; tolerance and smallest span grow with the coarseness set for the street."""
    cut = F.coalesce(F.create_map(*[F.lit(v) for pair in COARSER.items() for v in pair])[F.col("site_id").cast("int")], F.lit(1.0))
    rows = t.features.withColumn("cut", cut)
    reason = F.when(F.col("object_class") == "utility.telecom", "hidden").when(F.col("len") < TOLERANCE_M * F.col("cut"), "degenerate").when((F.col("cut") > 1) & (F.col("len") < SPAN_FLOOR_M * F.col("cut")), "small").otherwise("kept")
    return rows.groupBy("object_class", reason.alias("reason")).agg(F.count(F.lit(1)).alias("features"))


@query(
    "run_artifact_scan",
    sql="select o_custkey as source, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) as run_id, count(*) as runs from orders where o_orderstatus='F' group by all",
)
def run_artifact_scan(t):
    """Latest successful run of every drawing."""
    done = t.orders.where(F.col("o_orderstatus") == "F")
    return done.groupBy(F.col("o_custkey").alias("source")).agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("run_id"), F.count(F.lit(1)).alias("runs"))


@query(
    "law_quote_check",
    sql="""with q as (select item_id, trim(regexp_replace(text,'\\s+',' ','g')) as quote from benchmark), d as (select doc_id, trim(regexp_replace(text,'\\s+',' ','g')) as body from documents),
       h as (select item_id, count(*) as acts from q join d on contains(body, quote) group by all) select item_id, case when acts is null then 'fail' else 'ok' end as status, coalesce(acts,0) as acts from q left join h using(item_id)""",
)
def law_quote_check(t):
    """Is every registered quote a substring of some act, and of how many?

    A quote of six words or more is anchored on its second to fifth words, which stand whole in
    any text that contains it; acts are cut into four-word runs and only runs that begin a quote
    survive the join. The candidate pairs are then compared in full. Shorter quotes are few and
    are compared directly.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    quotes = t.benchmark.select("item_id", plain("text").alias("quote")).withColumn("w", F.split("quote", " "))
    acts = t.documents.select("doc_id", plain("text").alias("body"))
    long = quotes.where(F.size("w") >= 6).withColumn("anchor", F.array_join(F.slice("w", 2, 4), " "))
    words = acts.select("doc_id", F.split("body", " ").alias("w")).where(F.size("w") >= 4)
    runs = words.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, F.lit(4)), " "))).alias("anchor"))
    candidates = runs.join(long.select("item_id", "anchor"), "anchor").select("doc_id", "item_id").distinct()
    found = candidates.join(acts, "doc_id").join(long.select("item_id", "quote"), "item_id").where(F.contains("body", "quote")).select("item_id", "doc_id")
    short = quotes.where(F.size("w") < 6).select("item_id", "quote")
    found = found.unionByName(acts.join(short, F.contains("body", "quote")).select("item_id", "doc_id"))
    counts = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("acts"))
    return quotes.select("item_id").join(counts, "item_id", "left").select(
        "item_id", F.when(F.col("acts").isNull(), "fail").otherwise("ok").alias("status"), F.coalesce("acts", F.lit(0)).alias("acts"))


@query(
    "species_dictionary_match", uses=("species",),
    sql="""with v as (select p_partkey as row_no, lower(trim(unnest(string_split(case when p_partkey%4=0 then 'Acer negundo (f.) / Quercus  rubra' when p_partkey%4=1 then 'Tilia «vulgaris»' when p_partkey%4=2 then 'Betula pendula' else p_name end, '/')))) as name from part),
       n as (select row_no, trim(regexp_replace(regexp_replace(regexp_replace(name,'\\(.*?\\)',' ','g'),'[*«»"'']',' ','g'),'\\s+',' ','g')) as key from v), f as (select key, min(row_no) as row_no from n where key<>'' group by all)
      select species_no, lower(name_lat) as name, row_no from species left join f on f.key=lower(name_lat)""",
)
def species_dictionary_match(t):
    """Species found in a published list by any variant of a row's name; the rest stays unmatched."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Acer negundo (f.) / Quercus  rubra").when(k == 1, "Tilia «vulgaris»").when(k == 2, "Betula pendula").otherwise(F.col("p_name"))
    variants = t.part.select(F.col("p_partkey").alias("row_no"), F.explode(F.split(name, "/")).alias("v"))
    key = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim("v")), r"\(.*?\)", " "), "[*«»\"']", " "), r"\s+", " "))
    first = variants.select("row_no", key.alias("name")).where("name <> ''").groupBy("name").agg(F.min("row_no").alias("row_no"))
    return t.species.select("species_no", F.lower("name_lat").alias("name")).join(first, "name", "left").select("species_no", "name", "row_no")
