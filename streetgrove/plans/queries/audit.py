"""Foreign plan: extraction of plantings and their types."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetgrove.operators import audit as A
from streetgrove.plans.registry import Tables, query

PATTERN = "HIGH|URGENT|MEDIUM"
MARKS = """mk as (select site_id, point_id as feature_id, 'xref$0$'||priority as layer, x, y, case when percent%7=0 then 'line' when percent%3=0 then 'circle' else 'point' end as kind, case when percent%3=0 then percent/10.0e0 end as crown_m from points
  union all select site_id, 5000000000+point_id, 'xref$0$'||priority, round(x+0.01e0,3), y, 'circle', 4.0e0 from points where percent%5=0)"""


def drawn(t: Tables):
    """Planting marks of a drawing: some places carry both a sign and a crown circle."""
    layer = F.concat(F.lit("xref$0$"), F.col("priority"))
    kind = F.when(F.col("percent") % 7 == 0, "line").when(F.col("percent") % 3 == 0, "circle").otherwise("point")
    first = t.points.select("site_id", F.col("point_id").alias("feature_id"), layer.alias("layer"), "x", "y", kind.alias("kind"), F.when(F.col("percent") % 3 == 0, F.col("percent") / 10.0).alias("crown_m"))
    again = t.points.where(F.col("percent") % 5 == 0).select(
        "site_id", (F.lit(5000000000) + F.col("point_id")).alias("feature_id"), layer.alias("layer"), F.round(F.col("x") + 0.01, 3).alias("x"), "y", F.lit("circle").alias("kind"), F.lit(4.0).alias("crown_m"))
    return first.unionByName(again)


EXTRACT = f"""{MARKS},
ex as (select *, row_number() over (partition by site_id, round_even(x/0.05e0,0), round_even(y/0.05e0,0) order by case when crown_m is null then 1 else 0 end, feature_id) as rn
   from mk where kind in ('point','circle') and regexp_matches(layer, '{PATTERN}'))"""


@query("audit_planting_extract", uses=("points",), extra=EXTRACT, sql="select site_id, feature_id, layer, x, y, crown_m from ex where rn=1")
def audit_planting_extract(t):
    return A.plantings(drawn(t), PATTERN)


@query(
    "audit_skipped_shapes", uses=("points",), extra=MARKS,
    sql=f"select site_id, kind, count(*) as skipped from mk where kind not in ('point','circle') and regexp_matches(layer, '{PATTERN}') group by all",
)
def audit_skipped_shapes(t):
    return A.skipped(drawn(t), PATTERN)


GENERA = (("gear", "tree"), ("gizmo", "tree"), ("ring", "shrub"), ("bolts", "shrub"), ("anvil", "tree"), ("cold", "shrub"))


@query(
    "audit_type_infer", uses=("names",),
    sql="""with g(genus, type) as (values """ + ",".join(f"('{a}','{b}')" for a, b in GENERA) + """),
      w as (select distinct layer, unnest(string_split(lower(layer),' ')) as word from names),
      h as (select layer, genus, type from w join g on word=genus or (length(word)>=4 and (starts_with(genus, word) or starts_with(word, genus)))),
      v as (select layer, min(type) as type from h group by all having min(type)=max(type)),
      f as (select feature_id, names.layer, v.type, case when size%3=0 then null else size/10.0e0 end as crown_m from names left join v using(layer))
      select feature_id, case when regexp_matches(layer,'^hot') then 'shrub' when type is not null then type when crown_m is null then 'tree' when crown_m>=2 then 'tree' else 'shrub' end as planting_type,
        case when regexp_matches(layer,'^hot') then 'layer_pattern' when type is not null then 'genus' when crown_m is null then 'default' else 'crown' end as basis from f""",
)
def audit_type_infer(t):
    """Tree or shrub of every mark and what decided it; layer names are judged once each."""
    genera = t.spark.createDataFrame(list(GENERA), "genus string, type string")
    votes = A.genus_votes(t.names.select("layer").distinct(), genera).select("layer", "type")
    crown = F.when(F.col("size") % 3 == 0, F.lit(None)).otherwise(F.col("size") / 10.0)
    kind, basis = A.planting_type(shrubs="^hot")
    return t.names.join(votes, "layer", "left").withColumn("crown_m", crown).select("feature_id", kind.alias("planting_type"), basis.alias("basis"))
