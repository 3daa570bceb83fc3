"""Classification of drawing objects by name, sign and geometry on the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetgrove.functions import rulebook
from streetgrove.operators import names as N
from streetgrove.operators import scan, spatial
from streetgrove.plans import checksql as S
from streetgrove.plans.registry import Tables, query
from streetgrove.session import cut
from streetgrove.sources import sinks

# Rules of the fixture: pattern, target, geometry, class, priority.
RULES = (
    ("газопровод$", "layer", "any", "utility.gas", 0), ("колодец", "layer", "any", "utility.access", 0), ("тротуар", "layer", "area", "sidewalk", 1),
    ("демонтаж", "layer", "any", "ignore", 1), ("газон", "layer", "any", "lawn", 2), ("^новый", "layer", "any", "curb", 2), ("здание", "layer", "area", "building", 3),
    ("^Brand#1[0-9]", "block", "any", "pole", 0), ("^Brand#2", "block", "point", "existing_tree", 0), ("_(7|14)$", "block", "any", "obstacle", 5),
)
RULES_SQL = rulebook.sql_values("lr", "pattern, target, geometry, cls, priority", [tuple(r) for r in RULES])
LOCAL = "regexp_replace(regexp_replace({c}, '^.*\\|', ''), '^.*\\$[0-9]+\\$', '')"
LOCAL_LAYER, LOCAL_BLOCK = LOCAL.replace("{c}", "layer"), LOCAL.replace("{c}", "block")
CONTEXT = r"(^|[^\p{L}\p{N}_])(за|вместо|на месте|не|нет|без)([^\p{L}\p{N}_]|$)|(^|[^\p{L}\p{N}_])(демонт|уничтож|снос|проектир|восстан|устройств|замен|новый|нового|новая|новое)|(^|[^\p{L}\p{N}_])(proposed|demolition|remove|removed|replace|replacement|new|not)([^\p{L}\p{N}_]|$)|(^|[^\p{L}\p{N}_])газон\s+[ру]([^\p{L}\p{N}_]|$)"
DECIDED = f"""{RULES_SQL},
nm as (select distinct layer, block, kind, {LOCAL_LAYER} as ll, {LOCAL_BLOCK} as lb from drawn),
hit as (select nm.*, r.target='block' as isb, r.priority, r.cls from nm join lr r on regexp_matches(case when r.target='block' then lb else ll end, r.pattern) and (r.geometry='any' or r.geometry=kind)),
lvl as (select layer, block, kind, max(isb) as anyb from hit group by all),
cand as (select h.* from hit h join lvl using(layer, block, kind) where not anyb or isb),
pri as (select layer, block, kind, max(priority) as p from cand group by all),
cho as (select c.layer, c.block, c.kind, count(distinct cls) as n, min(cls) as cls from cand c join pri p on p.layer=c.layer and p.block=c.block and p.kind=c.kind and c.priority=p.p group by all),
dec as (select nm.layer, nm.block, nm.kind, case when n is null or n<>1 then 'unknown' when cls='lawn' and regexp_matches(lower(ll)||' ; '||lower(replace(lb,'_',' ')), '{CONTEXT}') then 'unknown' else cls end as object_class,
    case when n is null then 'unmatched' when n<>1 then 'conflict' when cls='lawn' and regexp_matches(lower(ll)||' ; '||lower(replace(lb,'_',' ')), '{CONTEXT}') then 'material_context' else 'name_rule' end as method from nm left join cho using(layer, block, kind)),
fb as (select d.feature_id, d.site_id, d.layer, d.block, d.kind, d.error_m, d.size, d.radius_m, d.is_frame, e.object_class as rule_class, e.method as rule_method,
    case when e.method<>'unmatched' then e.object_class when d.kind='point' then 'ignore' when d.is_frame then 'ignore' when d.radius_m<=1.5e0 then 'obstacle' else 'contour' end as object_class,
    case when e.method<>'unmatched' then e.method when d.kind='point' then 'assumed_geometry:point' when d.is_frame then 'assumed_geometry:sheet_frame' when d.radius_m<=1.5e0 then 'assumed_geometry:small_circle' else 'assumed_geometry:contour' end as method
  from drawn d join dec e using(layer, block, kind))"""


#: What the layer's name alone says.
LAYER_RULES = tuple(r for r in RULES if r[1] == "layer")
BY_LAYER = DECIDED.replace(RULES_SQL, rulebook.sql_values("lr", "pattern, target, geometry, cls, priority", [tuple(r) for r in LAYER_RULES]))


def decided(t: Tables, rules=RULES):
    """Distinct names are judged once and joined back."""
    return cut(N.rule_decisions(t.drawn.select("layer", "block", "kind"), rules), "decided")


def classified(t: Tables, rules=RULES):
    cls, method = N.geometry_fallback()
    rows = t.drawn.join(decided(t, rules), ["layer", "block", "kind"])
    silent = F.col("method") == "unmatched"
    return rows.withColumn("_c", F.when(silent, cls).otherwise(F.col("object_class"))).withColumn("_m", F.when(silent, method).otherwise(F.col("method"))).drop(
        "object_class", "method").withColumnRenamed("_c", "object_class").withColumnRenamed("_m", "method")


TRANSLIT = "lower(ll)"
for _a, _b in N.TRANSLITERATION.items():
    TRANSLIT = f"replace({TRANSLIT},'{_a}','{_b}')"


@query(
    "name_normalize", uses=("drawn",),
    sql=f"""select distinct layer, block, ll as local_layer, regexp_replace({LOCAL_BLOCK}, '(_[0-9]+)+$', '') as sign, trim(regexp_replace({TRANSLIT}, '[^a-z0-9]+', '-', 'g'), '-') as slug from (select layer, block, {LOCAL_LAYER} as ll from drawn)""",
)
def name_normalize(t):
    names = t.drawn.select("layer", "block").distinct()
    return names.select("layer", "block", N.local_name(F.col("layer")).alias("local_layer"), N.base_name(F.col("block")).alias("sign"), N.slug(N.local_name(F.col("layer"))).alias("slug"))


@query("layer_rule_classify", uses=("drawn",), extra=DECIDED, sql="select layer, block, kind, object_class, method from dec")
def layer_rule_classify(t):
    return decided(t)


@query("geometry_fallback_class", uses=("drawn",), extra=DECIDED, sql="select feature_id, object_class, method from fb")
def geometry_fallback_class(t):
    return classified(t).select("feature_id", "object_class", "method")


SIGNS = (("Brand#1", "existing_tree", "point"), ("Brand#2", "utility.access", "point"), ("Brand#3", "lawn", "marker"), ("Brand#4", "fence", "geometry"), ("Brand#5", "ignore", "annotation"), ("Brand#6", "pole", "point"))
SIGNS_SQL = rulebook.sql_values("signs", "sign, cls, role", list(SIGNS))


@query(
    "symbol_dictionary_join", uses=("drawn",), extra=SIGNS_SQL,
    sql=f"""select feature_id, d.sign, coalesce(cls, 'obstacle') as sign_class, coalesce(role, 'point') as role, case when role='geometry' then cls else 'ignore' end as stroke_class,
        case when cls is null then 'symbol_assumed:'||d.sign when role='geometry' then 'symbol_geometry:'||d.sign else 'symbol_stroke:'||d.sign end as method
        from (select feature_id, regexp_replace({LOCAL_BLOCK}, '(_[0-9]+)+$', '') as sign from drawn) d left join signs using(sign)""",
)
def symbol_dictionary_join(t):
    """Strokes of point, marker and annotation signs are drawing; an unknown sign is an obstacle."""
    signs = t.spark.createDataFrame(list(SIGNS), "sign string, cls string, role string")
    rows = t.drawn.select("feature_id", N.base_name(F.col("block")).alias("sign")).join(F.broadcast(signs), "sign", "left")  # a configured dictionary
    method = F.when(F.col("cls").isNull(), F.concat(F.lit("symbol_assumed:"), "sign")).when(F.col("role") == "geometry", F.concat(F.lit("symbol_geometry:"), "sign")).otherwise(F.concat(F.lit("symbol_stroke:"), "sign"))
    return rows.select("feature_id", "sign", F.coalesce("cls", F.lit("obstacle")).alias("sign_class"), F.coalesce("role", F.lit("point")).alias("role"),
                       F.when(F.col("role") == "geometry", F.col("cls")).otherwise("ignore").alias("stroke_class"), method.alias("method"))


@query(
    "symbol_instance_features", uses=("drawn", "labels_t"), extra=SIGNS_SQL,
    sql=f"""with b as (select feature_id, block, regexp_replace({LOCAL_BLOCK}, '(_[0-9]+)+$', '') as sign from drawn),
       s as (select b.block, sign, count(*) as strokes, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(feature_id) as first_id, arg_min(x, feature_id) as ix, arg_min(y, feature_id) as iy from b join labels_t l on l.label_id=b.feature_id group by all)
       select block, coalesce(cls,'obstacle') as object_class, strokes, case when cls='utility.access' then round((x0+x1)/2,3) else ix end as x, case when cls='utility.access' then round((y0+y1)/2,3) else iy end as y,
         case when cls='utility.access' then round((x1-x0)*(y1-y0),2) else cast(0 as double) end as box_m2 from s left join signs using(sign) where coalesce(role,'point') in ('point','marker')""",
)
def symbol_instance_features(t):
    """One object per sign instance: the insert point, or for a manhole the box of its strokes."""
    signs = t.spark.createDataFrame(list(SIGNS), "sign string, cls string, role string")
    strokes = t.drawn.select("feature_id", "block", N.base_name(F.col("block")).alias("sign")).join(t.labels_t.select(F.col("label_id").alias("feature_id"), "x", "y"), "feature_id")
    boxes = strokes.groupBy("block", "sign").agg(
        F.count(F.lit(1)).alias("strokes"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min(F.struct("feature_id", "x", "y")).alias("i"))
    rows = boxes.join(F.broadcast(signs), "sign", "left").where(F.coalesce("role", F.lit("point")).isin("point", "marker"))
    lid = F.coalesce(F.col("cls") == "utility.access", F.lit(False))
    return rows.select(
        "block", F.coalesce("cls", F.lit("obstacle")).alias("object_class"), "strokes", F.when(lid, F.round((F.col("x0") + F.col("x1")) / 2, 3)).otherwise(F.col("i.x")).alias("x"),
        F.when(lid, F.round((F.col("y0") + F.col("y1")) / 2, 3)).otherwise(F.col("i.y")).alias("y"),
        F.when(lid, F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 2)).otherwise(0.0).alias("box_m2"))


OVERRIDES = (("feature", "7", "fence"), ("feature", "999999999", "pole"), ("block", "XR|Brand#3_10", "pole"), ("layer", "tp$0$слой газон", "lawn"), ("layer", "no such layer", "road"))
OVERRIDES_SQL = rulebook.sql_values("ov", "target, key, cls", list(OVERRIDES))


def overrides(t: Tables):
    return t.spark.createDataFrame(list(OVERRIDES), "target string, key string, class string")


@query(
    "override_precedence", uses=("drawn",), extra=f"{DECIDED},\n{OVERRIDES_SQL}",
    sql="""select feature_id, coalesce(a.cls, b.cls, c.cls, fb.object_class) as object_class, case when a.cls is not null then 'explicit_feature' when b.cls is not null then 'explicit_block' when c.cls is not null then 'explicit_layer' else fb.method end as method
       from fb left join ov a on a.target='feature' and a.key=cast(feature_id as varchar) left join ov b on b.target='block' and lower(b.key)=lower(block) left join ov c on c.target='layer' and lower(c.key)=lower(layer)""",
)
def override_precedence(t):
    return N.with_overrides(classified(t), overrides(t)).select("feature_id", "object_class", "method")


@query(
    "classification_gate", uses=("drawn",), extra=f"{DECIDED},\n{OVERRIDES_SQL}",
    sql="""select count(*) filter (object_class in ('unknown','utility.unknown')) as unresolved, count(*) filter (object_class in ('unknown','utility.unknown') or split_part(method,':',1)='assumed_geometry') as review_required,
       (select count(*) from ov where not exists (select 1 from drawn d where (target='feature' and key=cast(feature_id as varchar)) or (target='block' and lower(key)=lower(block)) or (target='layer' and lower(key)=lower(layer)))) as unused_overrides, false as ready from fb""",
)
def classification_gate(t):
    """Counts that stop a strict run: unresolved objects, reviews asked for, unused assignments."""
    rows = classified(t)
    unused = N.unused_overrides(rows, overrides(t)).agg(F.count(F.lit(1)).alias("unused_overrides"))
    review = N.review_reason(F.col("object_class"), F.col("method"))
    counts = rows.agg(F.count_if(F.col("object_class").isin("unknown", "utility.unknown")).alias("unresolved"), F.count_if(review.isNotNull()).alias("review_required"))
    return counts.crossJoin(unused).withColumn("ready", (F.col("unresolved") + F.col("review_required") + F.col("unused_overrides")) == 0)  # two one-row tables


@query(
    "classified_geometry_fix", uses=("drawn",), extra=DECIDED,
    sql="""select feature_id, case when object_class='existing_tree' and radius_m is not null then 'point' when object_class='contour' and kind='area' then 'line' when object_class in ('curb','pavement_edge','fence') and kind='area' then 'line' else kind end as kind,
       case when object_class='existing_tree' and radius_m is not null then cast(0 as double) else error_m end as error_m from fb""",
)
def classified_geometry_fix(t):
    """A crown circle becomes its centre; closed linework of an edge class becomes its boundary."""
    tree = (F.col("object_class") == "existing_tree") & F.col("radius_m").isNotNull()
    edge = F.col("object_class").isin("contour", "curb", "pavement_edge", "fence") & (F.col("kind") == "area")
    return classified(t).select("feature_id", F.when(tree, "point").when(edge, "line").otherwise(F.col("kind")).alias("kind"), F.when(tree, 0.0).otherwise(F.col("error_m")).alias("error_m"))


@query("unknown_line_promote", uses=("drawn",), extra=DECIDED, sql="select feature_id, case when rule_class='unknown' and kind='line' then 'utility.unknown' else rule_class end as object_class from fb")
def unknown_line_promote(t):
    rows = t.drawn.join(decided(t), ["layer", "block", "kind"])
    return rows.select("feature_id", F.when((F.col("object_class") == "unknown") & (F.col("kind") == "line"), "utility.unknown").otherwise(F.col("object_class")).alias("object_class"))


@query("layer_coverage_report", uses=("drawn",), extra=DECIDED, sql="select layer, object_class, count(*) as features from fb group by all")
def layer_coverage_report(t):
    return classified(t).groupBy("layer", "object_class").agg(F.count(F.lit(1)).alias("features")).orderBy("layer", "object_class")


@query("layers_report_sink", uses=("drawn",), extra=DECIDED, sql="""select layer, count(*) as features, count(distinct object_class) as classes, string_agg(distinct object_class, ',' order by object_class) as listed from fb group by all""")
def layers_report_sink(t):
    """Layer coverage, written as JSON lines."""
    rows = classified(t).groupBy("layer").agg(
        F.count(F.lit(1)).alias("features"), F.countDistinct("object_class").alias("classes"), F.array_join(F.sort_array(F.collect_set("object_class")), ",").alias("listed"))  # classes are a closed list
    return sinks.written(rows, "layers", "json", None)


REVIEW = "case when object_class in ('unknown','utility.unknown') then 'class_unknown' when split_part(method,':',1)='assumed_geometry' then 'geometry_only' end"


@query(
    "classification_report", uses=("drawn",), extra=DECIDED,
    sql=f"""select layer, block, kind, object_class, method, count(*) as features, case when count(*) filter (error_m is null)>0 then null else max(error_m) end as max_error_m,
        list_slice(list_sort(list(feature_id)),1,5) as refs, {REVIEW} as review from fb group by all""",
)
def classification_report(t):
    return N.report(classified(t))


@query(
    "recognition_summary", uses=("drawn",), extra=DECIDED,
    sql="""select case when object_class='unknown' or method in ('unmatched','conflict') then 'unresolved' when method like 'assumed_geometry%' then 'by_geometry_only' when method='name_rule' then 'by_name_rule' else 'other' end as bucket, count(*) as features, count(distinct layer) as layers from fb group by all""",
)
def recognition_summary(t):
    return classified(t).groupBy(N.recognition_bucket(F.col("object_class"), F.col("method")).alias("bucket")).agg(F.count(F.lit(1)).alias("features"), F.countDistinct("layer").alias("layers"))


@query(
    "hint_candidates", uses=("drawn",), extra=DECIDED,
    sql=f"""with a as (select {LOCAL_LAYER} as name, object_class, count(*) as n from fb where split_part(method,':',1)='assumed_geometry' group by all)
      select name, cast(sum(n) as bigint) as features, string_agg(object_class||':'||n, ',' order by n desc, object_class) as current from a group by all""",
)
def hint_candidates(t):
    """Names decided by geometry alone that carry a meaning, with what they count as now."""
    asked = classified(t).where(F.element_at(F.split("method", ":"), 1).isin("assumed_geometry", "inferred_weak"))
    name = N.local_name(F.col("layer"))
    meaningful = name.rlike("(?iu)[a-zа-яё]{3,}") & ~name.rlike(r"(?iu)^(?:0|defpoints|level \d+)$|вн\.?\s*ссыл|внешн\w* ссыл|xref")
    counts = asked.withColumn("name", name).where(meaningful).groupBy("name", "object_class").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("object_class").alias("c"))))  # at most one entry per class
    return counts.groupBy("name").agg(F.sum("n").alias("features"), listed.alias("l")).select(
        "name", "features", F.array_join(F.transform("l", lambda e: F.concat(e["c"], F.lit(":"), (-e["o"]).cast("string"))), ",").alias("current"))


@query("vocabulary_infer")
def vocabulary_infer(t):
    return N.vocabulary_class(t.drawn.select(F.col("layer").alias("name")).distinct())


GRAMS = """{p}0 as (select distinct {n} as name, ' '||trim(regexp_replace(regexp_replace(replace(lower({n}),'ё','е'),'[0-9]+','#','g'),'[\\s_\\-.|$]+',' ','g'))||' ' as p from {s}),
{p}g as (select name, substring(p, cast(i as int), 3) as gram, count(*) as n from (select name, p, unnest(range(1, length(p)-1)) as i from {p}0) group by all),
{p}n as (select name, sqrt(sum(n*n)) as norm from {p}g group by all)"""


#: A name as the model reads it: the layer's local name and the block's name without numbers.
NAME_KEY = f"{LOCAL_LAYER}||' '||regexp_replace({LOCAL_BLOCK}, '(_[0-9]+)+$', '')"


@query(
    "name_model_knn", uses=("drawn",),
    extra=DECIDED + f""",
  loc as (select distinct {NAME_KEY} as name, object_class, method from fb),
  tr as (select name, min(object_class) as object_class from loc where method='name_rule' group by all having count(distinct object_class)=1),
  qs as (select distinct name||' '||upper(substring(name,1,2)) as name from loc),
  {GRAMS.replace('{p}', 'q').replace('{n}', 'name').replace('{s}', 'qs')},
  {GRAMS.replace('{p}', 'r').replace('{n}', 'name').replace('{s}', 'tr')},
  dt as (select qg.name, rg.name as near, sum(qg.n*rg.n) as dot from qg join rg using(gram) group by all),
  sc as (select dt.name, near, round(dot/(qn.norm*rn.norm),9) as sim from dt join qn on qn.name=dt.name join rn on rn.name=dt.near),
  bs as (select * from (select *, row_number() over (partition by name order by sim desc, near) as rn from sc) where rn<=5),
  vt as (select bs.name, object_class, sum(sim) as v, max(sim) as top from bs join tr on tr.name=bs.near group by all),
  ag as (select name, sum(v) as total, max(top) as best, max(row(v, object_class)) as w from vt group by all)""",
    sql="""select name, w[2] as object_class, round(w[1]/total,4) as share, round(best,4) as similarity from ag where best>=0.6e0 and w[1]/total>=0.7e0 and w[2] not in ('ignore','lawn','work_boundary','contour','unknown')""",
)
def name_model_knn(t):
    """Names judged by their most similar rule-decided names, whatever rule decided them."""
    key = F.concat(N.local_name(F.col("layer")), F.lit(" "), N.base_name(F.col("block")))
    named = t.drawn.select(key.alias("name")).distinct()
    decided_ = classified(t).where(F.col("method") == "name_rule").groupBy(key.alias("name")).agg(F.min("object_class").alias("object_class"), F.max("object_class").alias("_max"))
    known = decided_.where(F.col("object_class") == F.col("_max")).select("name", "object_class")
    return N.nearest_names(named.select(F.concat_ws(" ", "name", F.upper(F.substring("name", 1, 2))).alias("name")).distinct(), known)


def training(t: Tables):
    named = classified(t, LAYER_RULES).where(F.col("method") == "name_rule").groupBy(N.local_name(F.col("layer")).alias("name")).agg(
        F.min("object_class").alias("object_class"), F.max("object_class").alias("_max"))
    return named.where(F.col("object_class") == F.col("_max")).select("name", "object_class")


@query(
    "name_training_collect", uses=("drawn",), extra=BY_LAYER,
    sql=f"select {LOCAL_LAYER} as name, min(object_class) as object_class from fb where method='name_rule' group by 1 having count(distinct object_class)=1",
)
def name_training_collect(t):
    """Names that the rules gave a single class, over all drawings."""
    return training(t)


CODES = (("ТС 10 12 05", "utility.water"), ("ТС 10 12 05 03", "utility.sewer"), ("ТС 11 20 07", "pole"), ("ПО ЗУ 15 02 01", "lawn"), ("ПО ЗУ 16 03 09", "sidewalk"))
CODED = "case p_partkey%6 when 0 then 'ТС 1'||(p_size%2)||' 12 05 03' when 1 then 'сеть ТС_10_12_05' when 2 then 'ТС112007' when 3 then 'ПО ЗУ-15-02-01-44' when 4 then 'ТС-16' else p_name end"


@query(
    "classifier_code_match", extra=rulebook.sql_values("codes", "code, object_class", list(CODES)),
    sql=f"""with n as (select distinct {CODED} as layer from part), x as (select layer, regexp_extract(upper(layer), '(ТС|ПО[\\s_.\\-]*ЗУ)[\\s_.\\-]*([0-9]{{2}}[0-9\\s_.\\-]*)', 1) as mark, regexp_extract(upper(layer), '(ТС|ПО[\\s_.\\-]*ЗУ)[\\s_.\\-]*([0-9]{{2}}[0-9\\s_.\\-]*)', 2) as digits from n),
      g as (select layer, case when mark like 'П%' then 'ПО ЗУ' else 'ТС' end as part, regexp_extract_all(digits, '[0-9]+') as gr from x where digits<>''),
      p as (select layer, part, case when len(gr)=1 then regexp_extract_all(gr[1], '[0-9][0-9]') else gr end as gr from g),
      f as (select layer, part||' '||array_to_string(gr[1:k],' ') as code, k from (select *, unnest(range(3, len(gr)+1)) as k from p where len(gr)>=3))
      select layer, arg_max(code, k) as code, arg_max(object_class, k) as object_class from f join codes using(code) group by all""",
)
def classifier_code_match(t):
    """Class by the code of the city classifier written in a layer name."""
    size = F.col("p_size") % 2
    coded = (
        F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("ТС 1"), size.cast("string"), F.lit(" 12 05 03"))).when(F.col("p_partkey") % 6 == 1, "сеть ТС_10_12_05")
        .when(F.col("p_partkey") % 6 == 2, "ТС112007").when(F.col("p_partkey") % 6 == 3, "ПО ЗУ-15-02-01-44").when(F.col("p_partkey") % 6 == 4, "ТС-16").otherwise(F.col("p_name"))
    )
    codes = t.spark.createDataFrame(list(CODES), "code string, object_class string")
    return N.classifier_code(t.part.select(coded.alias("layer")).distinct(), codes)


# ---------------------------------------------------------------- labels

TEXTS = "case p_partkey%12 when 0 then 'ГАЗОН' when 1 then 'А' when 2 then 'ДЕТ.ПЛ.' when 3 then 'цветник.' when 4 then 'плитка бетонная' when 5 then 'ГАЗОН на ПЛОЩАДКЕ' when 6 then 'ж.б.' when 7 then 'Спорт ПЛ' when 8 then 'асф' else p_name end"


def texts(t: Tables):
    k = F.col("p_partkey") % 12
    values = ("ГАЗОН", "А", "ДЕТ.ПЛ.", "цветник.", "плитка бетонная", "ГАЗОН на ПЛОЩАДКЕ", "ж.б.", "Спорт ПЛ", "асф")
    text = F.col("p_name")
    for i, value in reversed(list(enumerate(values))):
        text = F.when(k == i, value).otherwise(text)
    return t.part.select(F.col("p_partkey").alias("label_id"), text.alias("text"), F.col("p_name").alias("layer"), "p_brand", "p_size")


MATERIAL = """case when u in ('А','Ц','ПЛ','БР','Б','Щ','ГР','АСФ','ПЛИТКА') then 'paved' when u in ('ГАЗОН','ГРУНТ','ЦВЕТНИК','КЛУМБА') then 'soil'
   when regexp_matches(u,'ПОКР|^(ДЕТ|СПОРТ|ХОЗ|ИГР)[^0-9A-Za-zА-Яа-яЁё_]*ПЛ|ПЛОЩАДК|АСФАЛЬТ|БРУСЧ|ПЛИТК|ТЕРРАВЕЙ') and not regexp_matches(u,'ГАЗОН|ЦВЕТНИК|КЛУМБ') then 'paved'
   when regexp_matches(u,'ГАЗОН|ЦВЕТНИК|КЛУМБ') and not regexp_matches(u,'ПОКР|^(ДЕТ|СПОРТ|ХОЗ|ИГР)[^0-9A-Za-zА-Яа-яЁё_]*ПЛ|ПЛОЩАДК|АСФАЛЬТ|БРУСЧ|ПЛИТК|ТЕРРАВЕЙ') then 'soil' end"""


@query("label_material_parse", sql=f"select label_id, text, {MATERIAL} as material from (select p_partkey as label_id, {TEXTS} as text, rtrim(upper(trim({TEXTS})),'.') as u from part)")
def label_material_parse(t):
    return texts(t).select("label_id", "text", N.label_material(F.col("text")).alias("material"))


@query(
    "label_role_classify",
    sql="""select p_partkey as label_id, case when p_partkey%50=0 then 'soil' when p_name like '%ring' then 'ignore' when p_brand like '%9' then 'ignore' when regexp_matches(p_name,'^(new|not)( |$)') then 'ignore' when p_name like 'red g%' then 'ignore' else 'auto' end as role,
       case when p_partkey%50=0 then 'explicit_label' when p_name like '%ring' or p_brand like '%9' then 'annotation_label' when regexp_matches(p_name,'^(new|not)( |$)') then 'material_context' when p_name like 'red g%' then 'conflict' else 'name_rule' end as method from part""",
)
def label_role_classify(t):
    """Role of a label: its own assignment, an annotation among its blocks, work wording, a conflict."""
    rules = (("ring$", "layer", "any", "ignore", 0), ("9$", "block", "any", "ignore", 0), ("^red g", "layer", "any", "road", 1), ("gear|gizmo", "layer", "any", "sidewalk", 1))
    labels = texts(t).withColumn("chain", F.array("p_brand", F.lit("frame")))
    asked = labels.withColumn("ancestor", F.explode("chain")).withColumn("kind", F.lit("label"))
    judged = asked.join(N.rule_decisions(asked, rules, block="ancestor"), ["layer", "ancestor", "kind"]).withColumnsRenamed({"object_class": "cls", "method": "why"})
    per = judged.groupBy("label_id", "layer").agg(
        F.max(F.when(F.col("cls") == "ignore", 1).otherwise(0)).alias("annotation"), F.max(F.when(F.col("why") == "conflict", 1).otherwise(0)).alias("conflict"))
    explicit = F.col("label_id") % 50 == 0
    context = N.review_needed(F.col("layer"))
    role = F.when(explicit, "soil").when((F.col("annotation") == 1) | context | (F.col("conflict") == 1), "ignore").otherwise("auto")
    how = F.when(explicit, "explicit_label").when(F.col("annotation") == 1, "annotation_label").when(context, "material_context").when(F.col("conflict") == 1, "conflict").otherwise("name_rule")
    return per.select("label_id", role.alias("role"), how.alias("method"))


# ---------------------------------------------------------------- diameters

DIA = "regexp_extract(replace(lower({c}),' ',''), '(^|[^a-zа-я])(d|ду|ø|ф)=?([0-9]{2,4})', 3)"


def dia(c: str) -> str:
    return f"case when {DIA.replace('{c}', c)}<>'' and cast({DIA.replace('{c}', c)} as int) between 20 and 4000 then cast({DIA.replace('{c}', c)} as int)/1000.0e0 end"


@query("diameter_parse", uses=("labels_t",), sql=f"select label_id, text, {dia('text').replace('cast(regexp', 'try_cast(regexp')} as diameter_m from labels_t")
def diameter_parse(t):
    return t.labels_t.select("label_id", "text", N.diameter_m(F.col("text")).alias("diameter_m"))


ATTACH = f"""lab as (select label_id, site_id, 'L'||(label_id%3) as layer, x, y, {dia('text').replace('cast(regexp', 'try_cast(regexp')} as dm from labels_t),
pipes as (select *, 'L'||(feature_id%3) as layer from segments where {S.util()}),
nd as (select p.label_id, s.feature_id, p.dm, {S.seg_dist()} as d from lab p join pipes s on s.site_id=p.site_id and s.layer=p.layer where p.dm is not null and {S.seg_dist()}<=6),
near as (select label_id, min(row(d, feature_id)) as n, any_value(dm) as dm from nd group by all)"""


@query("diameter_attach", uses=("labels_t", "segments"), extra=ATTACH, sql="select n[2] as feature_id, max(dm) as diameter_m, count(*) as labels from near group by all")
def diameter_attach(t):
    """Each diameter label goes to the nearest pipe of its layer within reach; a pipe takes the largest."""
    labels = t.labels_t.select("site_id", "label_id", "x", "y", F.concat(F.lit("L"), (F.col("label_id") % 3).cast("string")).alias("layer"), N.diameter_m(F.col("text")).alias("dm")).where("dm is not null")
    utility = F.col("object_class").startswith("utility.") & (F.col("object_class") != "utility.access")
    pipes = t.segments.where(utility).select("site_id", "feature_id", F.concat(F.lit("L"), (F.col("feature_id") % 3).cast("string")).alias("layer"), "x1", "y1", "x2", "y2")
    near = spatial.near_segments(labels, pipes, 6.0, on=("site_id", "layer"), spread=("label_id",), cell=32.0)
    best = near.groupBy("label_id").agg(F.min(F.struct("distance", "feature_id")).alias("n"), F.first("dm").alias("dm"))
    return best.groupBy(F.col("n.feature_id").alias("feature_id")).agg(F.max("dm").alias("diameter_m"), F.count(F.lit(1)).alias("labels"))


# Pieces of pipes in file order: piece k runs from node k to node k+1 and every eighth node breaks the chain.
CHAIN = """pieces as (select o_orderkey as id, o_custkey%5 as line, case when o_orderkey%8=0 then o_totalprice end as dm, o_orderkey%8=7 as broken from orders)"""


@query(
    "diameter_chain_fill", extra=CHAIN,
    sql="""with g as (select cast(floor(id/8) as bigint) as chain, count(*) as pieces, count(dm) as known, count(distinct dm) as n, max(dm) as dm from pieces group by all)
      select p.id, coalesce(p.dm, case when g.n=1 then g.dm end) as diameter, p.dm is null and g.n=1 as filled from pieces p join g on g.chain=cast(floor(p.id/8) as bigint)""",
)
def diameter_chain_fill(t):
    """A missing diameter is filled along an open, unbranched chain with exactly one known value."""
    from streetgrove.operators import graph

    pieces = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 8 == 0, F.col("o_totalprice")).alias("dm"))
    # Node keys: a chain shares a node between neighbours; the last piece of eight ends in a node of its own.
    ends = pieces.select("id", F.explode(F.array(F.col("id") * 2, F.when(F.col("id") % 8 == 7, F.col("id") * 2 + 1).otherwise((F.col("id") + 1) * 2))).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min("id").alias("a"), F.max("id").alias("b"))
    edges = degree.where("degree = 2").select("a", "b")
    crowded = ends.join(degree.where("degree > 2").select("node"), "node", "left_semi").select("id").distinct().withColumn("ambiguous", F.lit(1))
    labels = graph.connected_components(pieces, edges, key="id")
    open_ends = ends.join(degree.where("degree = 1").select("node"), "node", "left_semi").join(labels, "id").groupBy("component").agg(F.count(F.lit(1)).alias("open_ends"))
    rows = pieces.join(labels, "id").join(crowded, "id", "left")
    known = rows.groupBy("component").agg(F.countDistinct("dm").alias("n"), F.max("dm").alias("value"), F.max(F.coalesce("ambiguous", F.lit(0))).alias("ambiguous_chain"))
    ok = (F.col("n") == 1) & (F.col("ambiguous_chain") == 0) & (F.col("open_ends") == 2)
    return rows.join(known, "component").join(open_ends, "component", "left").select(
        "id", F.coalesce("dm", F.when(ok, F.col("value"))).alias("diameter"), F.coalesce(F.col("dm").isNull() & ok, F.lit(False)).alias("filled"))


# ---------------------------------------------------------------- buildings

SIGN_TEXT = "case p_partkey%9 when 0 then 'К-'||p_size when 1 then p_size||'' when 2 then 'КЖ'||p_size when 3 then 'Ж' when 4 then 'Ц' when 5 then 'М.Я.' when 6 then 'фунд.' when 7 then 'CM – H 2' else p_name end"
SIGN = f"""bl as (select p_partkey as label_id, p_partkey%97 as face, {SIGN_TEXT} as text, regexp_replace(translate(upper({SIGN_TEXT}),'‒–—―−ABCEHKMOPTX','-----АВСЕНКМОРТХ'),'\\s+','','g') as pl from part),
sg as (select *, regexp_matches(pl,'^(СМ|К|М)?-?(Ж|Н)?-?([0-9]{{1,2}})?$') and pl not in ('А','Б','Ц') and rtrim(pl,'.') not in ('М.Я','МЯ','ФУНД','КОТЛОВАН','ПОДЗ.СООР','РАЗР') as ok from bl),
sr as (select label_id, face, case when ok and try_cast(regexp_extract(pl,'^(СМ|К|М)?-?(Ж|Н)?-?([0-9]{{1,2}})?$',3) as int) between 1 and 60 then try_cast(regexp_extract(pl,'^(СМ|К|М)?-?(Ж|Н)?-?([0-9]{{1,2}})?$',3) as int) end as floors,
   case when ok then case regexp_extract(pl,'^(СМ|К|М)?-?(Ж|Н)?-?([0-9]{{1,2}})?$',1) when 'К' then 'brick' when 'М' then 'metal' when 'СМ' then 'mixed' end end as wall,
   case when ok then case regexp_extract(pl,'^(СМ|К|М)?-?(Ж|Н)?-?([0-9]{{1,2}})?$',2) when 'Ж' then 'residential' when 'Н' then 'non_residential' end end as use,
   pl in ('А','Б','Ц') as porch, rtrim(pl,'.') in ('М.Я','МЯ') as container, rtrim(pl,'.') in ('ФУНД','КОТЛОВАН','ПОДЗ.СООР','РАЗР') as ground from sg),
fc as (select face, max(floors) as floors, arg_min(wall, label_id) filter (wall is not null) as wall, case when bool_or(use='residential') then 'residential' else min(use) end as use, bool_or(porch) as porch, bool_or(container) as container, bool_or(ground) as ground from sr group by all)"""


def signs_by_face(t: Tables, face: str = "p_partkey % 97"):
    k = F.col("p_partkey") % 9
    size = F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("К-"), size)).when(k == 1, size).when(k == 2, F.concat(F.lit("КЖ"), size)).when(k == 3, "Ж").when(k == 4, "Ц").when(k == 5, "М.Я.")
        .when(k == 6, "фунд.").when(k == 7, "CM – H 2").otherwise(F.col("p_name"))
    )
    signs = t.part.select(F.col("p_partkey").alias("label_id"), F.expr(face).alias("face"), N.building_sign(text).alias("s")).select("label_id", "face", "s.*")
    return signs.groupBy("face").agg(
        F.max("floors").alias("floors"), F.min(F.when(F.col("wall").isNotNull(), F.struct("label_id", "wall")))["wall"].alias("wall"),
        F.when(F.max(F.coalesce(F.col("use") == "residential", F.lit(False))), "residential").otherwise(F.min("use")).alias("use"),
        F.max("porch").alias("porch"), F.max("container").alias("container"), F.max("ground").alias("ground"))


@query("building_label_parse", extra=SIGN, sql="select face, floors, wall, use, porch, container, ground from fc")
def building_label_parse(t):
    """Labels of a face read together: most storeys, first wall material, residential over other uses."""
    return signs_by_face(t)


@query(
    "building_height", uses=("house_parts",), extra=SIGN.replace("p_partkey%97", "cast(floor(p_partkey*7/10) as bigint)"),
    sql="""with e as (select h.*, f.floors, f.wall, f.use, f.porch, f.container, w*d as area from house_parts h left join fc f using(face)),
      sw as (select a.face, b.face as other, b.floors, least(a.y+a.d,b.y+b.d)-greatest(a.y,b.y) as shared from e a join e b on a.site_id=b.site_id and a.face<>b.face and (a.x+a.w=b.x or b.x+b.w=a.x) where b.floors is not null and least(a.y+a.d,b.y+b.d)-greatest(a.y,b.y)>=2
        union all select a.face, b.face, b.floors, least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x) from e a join e b on a.site_id=b.site_id and a.face<>b.face and (a.y+a.d=b.y or b.y+b.d=a.y) where b.floors is not null and least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x)>=2),
      nb as (select face, max(row(shared, -other, floors)) as m from sw group by face),
      k as (select e.*, m[3] as nb, case when floors is not null then null when container then 'container' when porch then 'porch' end as low from e left join nb using(face)),
      h as (select site_id, face, case when floors is not null then floors when low is not null then null when nb is not null then nb when wall is not null or use is not null then case when use='residential' then 5 else 1 end when area<150 then 1 when area<600 then 2 else 5 end as floors, low,
        case when floors is not null then 'label' when low is not null then 'letter' when nb is not null then 'neighbor' when wall is not null or use is not null then 'letter' else 'assumed' end as source from k)
      select site_id, face, floors, source, case when floors=1 then 4.0e0 when floors is not null then round(3.0e0*floors+1.2e0,2) when low='porch' then 0.45e0 else 1.5e0 end as height_m from h""",
)
def building_height(t):
    """Height by the first basis that speaks: label, letter of a low part, the neighbour along the longest shared wall, letter, area."""
    parts = t.house_parts
    signs = signs_by_face(t, "floor(p_partkey * 7 / 10)")
    corner = {"x0": F.col("x"), "y0": F.col("y"), "xw": F.col("x") + F.col("w"), "yd": F.col("y") + F.col("d")}
    wall = lambda x1, y1, x2, y2: F.struct(corner[x1].alias("x1"), corner[y1].alias("y1"), corner[x2].alias("x2"), corner[y2].alias("y2"))
    walls = F.array(wall("x0", "y0", "xw", "y0"), wall("xw", "y0", "xw", "yd"), wall("xw", "yd", "x0", "yd"), wall("x0", "yd", "x0", "y0"))
    edges = parts.withColumn("e", F.explode(walls)).select("site_id", "face", "e.*")
    rows = parts.join(signs, "face", "left").withColumn("area", F.col("w") * F.col("d"))
    return N.heights(rows, spatial.shared_walls(edges)).select("site_id", "face", "floors", "source", "height_m")
