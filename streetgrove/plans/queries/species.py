"""Species admission, scoring and composition on the canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.functions import rulebook, sun
from streetgrove.operators import graph, scan, spatial
from streetgrove.operators import rules as R
from streetgrove.operators import species as P
from streetgrove.plans import checksql as S
from streetgrove.plans import shared
from streetgrove.plans.queries import effect
from streetgrove.plans.queries.rules import SPECIES_RULES
from streetgrove.plans.registry import Tables, query
from streetgrove.session import cut

INVASIVE = rulebook.sql_values("inv", "rule_id, species_lat, grp", rulebook.invasive_rows())
NORMS = f"""{INVASIVE},
norms0 as (select s.*, coalesce(a.rule_id, b.rule_id) as invasive_rule, coalesce(a.grp, b.grp) as invasive_group,
   case when coalesce(a.grp,b.grp) is null then null when coalesce(a.grp,b.grp)=3 then 'conditional' else 'forbidden' end as invasive_decision
  from species s left join inv a on lower(a.species_lat)=lower(s.name_lat) and a.species_lat like '% %'
  left join inv b on lower(b.species_lat)=s.genus and b.species_lat not like '% %'),
norms as (select *, case when invasive_decision='forbidden' then 'invasive' when category_mark='minus' then 'planting_category'
   when fluff and not male_clone then 'female_fluff' when fruit_litter then 'fruit_litter'
   when allergen>=2 and not coalesce(category_mark in ('plus','limited'), false) then 'mass_allergen' end as norm_block from norms0)"""


def checked_species(t: Tables, territory: str = "green_fund"):
    listed = rulebook.invasive(t.spark)
    return P.species_norms(P.invasive_check(shared.species(t), listed, territory))


def species_by_territory(t: Tables):
    """The catalogue with the norms of every kind of territory; ``profile`` stands for ordinary green land."""
    lands = {"profile": "green_fund", "protected_green": "protected_green", "natural": "natural"}
    return reduce(DataFrame.unionByName, [checked_species(t, land).withColumn("territory", F.lit(name)) for name, land in lands.items()])


@query("invasive_check", uses=("species",), extra=NORMS, sql="select species_no, name_lat, invasive_rule, cast(invasive_group as int) as invasive_group, invasive_decision from norms")
def invasive_check(t):
    return checked_species(t).select("species_no", "name_lat", "invasive_rule", "invasive_group", "invasive_decision")


@query(
    "species_norms", uses=("species",), extra=NORMS,
    sql="""select species_no, norm_block, list_filter([case when invasive_decision='conditional' then 'invasive_condition' end,
      case when category_mark='limited' then 'limited_category' end, case when fluff and male_clone then 'male_clones_only' end], lambda x: x is not null) as conditions from norms""",
)
def species_norms(t):
    return checked_species(t).select("species_no", "norm_block", "conditions")


@query(
    "city_assortment_mark", uses=("species", "points"),
    sql="""select species_no, case when city_mark then 'recommended' when not city_mark then 'off_list' else 'not_listed' end as mark,
        case when not city_mark then cast(1 as double) else cast(0 as double) end as penalty, count(point_id) as n_points
        from species left join points using(species_no) group by all""",
)
def city_assortment_mark(t):
    per = t.points.groupBy("species_no").agg(F.count(F.lit(1)).alias("n"))
    mark = F.when(F.col("city_mark"), "recommended").when(~F.col("city_mark"), "off_list").otherwise("not_listed")
    penalty = F.when(F.col("city_mark") == F.lit(False), 1.0).otherwise(0.0)
    return t.species.join(F.broadcast(per), "species_no", "left").select(
        "species_no", mark.alias("mark"), penalty.alias("penalty"), F.coalesce("n", F.lit(0)).alias("n_points")
    )


def by_class(t: Tables, *, bounded: bool = True):
    """Measured clearance of a planting to each class its rules look at, if bounded as far as a species norm reaches.

    A class is measured to the outer wall where one of its rules is; that is one row a planting and class, whatever the number of rules.
    """
    kinds = shared.strict_rules(t).groupBy("object_class", "planting_type").agg(F.max(F.col("measure_to") == "outer_wall").alias("_wall"))
    near = shared.clearance(t, **({"reach": shared.species_reach(t)} if bounded else {}))
    rows = near.join(t.points.select("site_id", "point_id", "planting_type"), ["site_id", "point_id"]).join(F.broadcast(kinds), ["object_class", "planting_type"])  # classes of the rule book
    measured = F.round(F.when(F.col("_wall"), F.least("wall_m", "axis_m")).otherwise(F.col("axis_m")), 3)
    return rows.select("site_id", "point_id", "object_class", measured.alias("measured_m")).where("measured_m is not null")


HOURS = len(sun.shadow_hours())
CONTEXT = f"""{effect.SHADE},
shp as (select p.point_id, round(count(s.hour)/{HOURS}.0e0,3) as shade from points p left join sh s using(point_id) group by p.point_id),
{effect.ZONED_IN},
ter as (select p.point_id, case when bool_or(object_class='territory.protected_green') then 'protected_green' when bool_or(object_class='territory.natural') then 'natural' else 'profile' end as territory from points p left join zin z using(point_id) group by all),
und as (select distinct p.point_id from points p join overhead_lines s on s.site_id=p.site_id join rules r on r.object_class='power_line_overhead' and r.planting_type=p.planting_type where greatest(0.0e0, {S.seg_dist()}-s.error_m) < r.min_distance_m-0.001e0),
ctx as (select p.site_id, p.point_id, u.point_id is not null as under_line, shade, territory from points p left join und u using(point_id) left join shp using(point_id) left join ter using(point_id))"""
BY_CLASS = f"""{S.FACTS},
byc as (select site_id, point_id, object_class, min(measured_m) as measured_m from chk where measured_m is not null group by all)"""
KIND = "case when mode in ('alley','existing_row') then 'row' when mode='groups' then 'group' else 'single' end"
FILTERED = f"""{SPECIES_RULES},
{NORMS},
rules as (select * from all_rules where (edition is null or edition='2016') and rule_id not in ({S.DISABLED}) and len(genera)=0 and len(traits)=0 and min_crown_m is null),
{S.CLEARANCE},
{S.PRESENCE},
{S.checks()},
byc as (select site_id, point_id, object_class, min(measured_m) as measured_m from chk where measured_m is not null group by all),
dblock as (select p.point_id, r.species_no, min(r.rule_id) as drule from points p join byc b using(site_id, point_id)
   join sp_rules r on r.object_class=b.object_class and r.planting_type=p.planting_type and r.severity='forbid'
   where b.measured_m+cast(0.000001 as double) < r.threshold group by all),
saltd as (select point_id, min(measured_m) as salt_m from byc where object_class in ('road','curb') group by all),
{CONTEXT},
terr as (select * from (values ('profile', true), ('protected_green', false), ('natural', false)) v(territory, eased)),
normst as (select n.* exclude (invasive_decision, norm_block), territory, case when invasive_group is null then null when invasive_group=3 and eased then 'conditional' else 'forbidden' end as invasive_decision,
   case when invasive_group is not null and not (invasive_group=3 and eased) then 'invasive' when norm_block='invasive' then null else norm_block end as norm_block0 from norms n, terr),
normt as (select * exclude (norm_block0), coalesce(norm_block0, case when invasive_decision='forbidden' then 'invasive' when category_mark='minus' then 'planting_category' when fluff and not male_clone then 'female_fluff' when fruit_litter then 'fruit_litter'
   when allergen>=2 and not coalesce(category_mark in ('plus','limited'), false) then 'mass_allergen' end) as norm_block from normst),
filt as (select p.site_id, p.point_id, p.planting_type, {KIND} as structure_kind, salt_m, p.species_no as own_no, x.under_line, x.shade, n.*, coalesce('norm:'||norm_block, 'distance:'||drule,
    case when x.under_line and height_m>4 then 'overhead' end, case when hardiness_zone>4 then 'hardiness' end, case when light='sun' and x.shade>=0.5e0 then 'light' end, case when salt=0 and salt_m<5 then 'salt' end) as reason
  from points p join ctx x on x.point_id=p.point_id join normt n on n.life_type=p.planting_type and n.territory=x.territory left join dblock d on d.point_id=p.point_id and d.species_no=n.species_no
  left join saltd on saltd.point_id=p.point_id)"""
FILTER_USES = tuple(dict.fromkeys((*S.FACTS_USES, "species", "overhead_lines", "rects", "zone_edges", "road_edges")))


def place_context(t: Tables):
    """What lies over and around a planting besides distances: wires, shade of buildings, kind of territory, category of the place."""
    points = t.points.select("site_id", "point_id", "planting_type", "x", "y")
    wires = t.overhead_lines
    rules = shared.strict_rules(t).where(F.col("object_class") == P.OVERHEAD)
    reach = {P.OVERHEAD: max(r[3] for r in rulebook.distance_rule_rows() if r[1] == P.OVERHEAD)}
    facts = R.checks(points, rules, R.nearest_clearance(points, wires, reach=reach), shared.presence(t))
    under = P.under_lines(facts)
    return (
        t.points.select("site_id", "point_id").join(under, ["site_id", "point_id"], "left").withColumn("under_line", F.coalesce("under_line", F.lit(False)))
        .join(effect.shade_share(t), ["site_id", "point_id"], "left").join(effect.territory_classify(t), ["site_id", "point_id"], "left")
    )


def filter_inputs(t: Tables):
    kind = F.when(F.col("mode").isin("alley", "existing_row"), "row").when(F.col("mode") == "groups", "group").otherwise("single")
    points = t.points.select("site_id", "point_id", "planting_type", F.col("species_no").alias("own_no"), "mode", kind.alias("structure_kind"))
    placed = cut(points.join(place_context(t), ["site_id", "point_id"]), "context")
    rules = shared.species_rules(t).select("species_no", "object_class", "rule_id", "min_distance_m", "severity")
    return placed, cut(by_class(t), "by-class"), cut(species_by_territory(t), "catalogue"), rules


def filtered(t: Tables):
    return P.hard_filter(*filter_inputs(t))


@query(
    "site_context", uses=tuple(dict.fromkeys((*S.FACTS_USES, "overhead_lines", "rects", "zone_edges", "road_edges"))), extra=f"{BY_CLASS},\n{CONTEXT},\n{effect.PLACE_AFTER_ZONES}",
    sql=f"""select p.site_id, p.point_id, {KIND} as structure_kind, x.under_line, x.shade, x.territory, pl.place as category, min(measured_m) filter (object_class='curb') as curb_m, min(measured_m) filter (object_class='building') as building_m,
      min(measured_m) filter (object_class='utility.heat') as heat_m, min(measured_m) filter (object_class='utility.gas') as gas_m,
      min(measured_m) filter (object_class='pole') as pole_m from points p join ctx x on x.point_id=p.point_id join plc pl on pl.point_id=p.point_id left join byc b on b.point_id=p.point_id group by all""",
)
def site_context(t):
    """Per planting the smallest clearance to each class, however far, its structure, and what lies over and around it."""
    kind = F.when(F.col("mode").isin("alley", "existing_row"), "row").when(F.col("mode") == "groups", "group").otherwise("single")
    wide = t.points.select("site_id", "point_id", kind.alias("structure_kind")).join(by_class(t, bounded=False), ["site_id", "point_id"], "left")
    names = {"curb": "curb_m", "building": "building_m", "utility.heat": "heat_m", "utility.gas": "gas_m", "pole": "pole_m"}
    measured = wide.groupBy("site_id", "point_id", "structure_kind").agg(*[F.min(F.when(F.col("object_class") == c, F.col("measured_m"))).alias(n) for c, n in names.items()])
    place = effect.place_classify_frame(t).withColumnRenamed("place", "category")
    return measured.join(place_context(t), ["site_id", "point_id"]).join(place, ["site_id", "point_id"])


@query(
    "species_hard_filter", uses=FILTER_USES, extra=FILTERED,
    sql="select species_no, coalesce(reason,'admitted') as reason, count(*) as n_points from filt group by all",
)
def species_hard_filter(t):
    counts = P.filter_counts(*filter_inputs(t))
    return counts.select("species_no", F.coalesce("reason", F.lit("admitted")).alias("reason"), F.col("n").alias("n_points"))


SCORE = """((0.30e0*case when salt_m<5 then (compaction/2.0e0+(1.0e0-allergen/2.0e0)+salt/2.0e0+gas/2.0e0)/4.0e0 else (compaction/2.0e0+(1.0e0-allergen/2.0e0))/2.0e0 end
 + 0.20e0*cast(case structure_kind when 'row' then use_row when 'group' then use_group else use_single end as double)
 + 0.15e0*least(1.0e0, 2/12.0e0+case when evergreen then 0.25e0 else 0.0e0 end) + 0.15e0*least(1.0e0, lifespan_years/150.0e0)
 + 0.10e0*case care_level when 1 then 1.0e0 when 2 then 0.5e0 else 0.0e0 end + 0.10e0*least(1.0e0, pilot_streets/7.0e0)
 + 0.20e0*case category_mark when 'plus' then 1.0e0 when 'limited' then 0.5e0 else 0.25e0 end
 + case when life_type='tree' then 0.15e0*least(1.0e0, crown_mature_m/8.0e0) else 0.0e0 end)
 / (1.2e0 + case when life_type='tree' then 0.15e0 else 0.0e0 end))"""


@query(
    "suitability_score", uses=FILTER_USES, extra=FILTERED,
    sql=f"select site_id, point_id, species_no, round({SCORE},4) as score, reason from filt where own_no=species_no",
)
def suitability_score(t):
    own = filtered(t).where(F.col("own_no") == F.col("species_no"))
    return own.select("site_id", "point_id", "species_no", F.round(P.suitability(), 4).alias("score"), "reason")


@query(
    "condition_penalty", uses=FILTER_USES, extra=FILTERED,
    sql=f"""with sc as (select site_id, point_id, species_no, round({SCORE},4) as score,
          cast(invasive_decision is not null and invasive_decision='conditional' as int)+cast(allergen>=2 as int) as marks from filt where reason is null and own_no=species_no)
        select site_id, point_id, species_no, cast(marks as int) as marks, round(greatest(cast(0 as double), score-cast(0.2 as double)*marks),4) as score from sc""",
)
def condition_penalty(t):
    """Score lowered for a species admitted under a condition or with strong pollen."""
    own = filtered(t).where(F.col("reason").isNull() & (F.col("own_no") == F.col("species_no")))
    marks = F.coalesce((F.col("invasive_decision") == "conditional").cast("int"), F.lit(0)) + (F.col("allergen") >= 2).cast("int")
    return own.select(
        "site_id", "point_id", "species_no", marks.alias("marks"),
        F.round(F.greatest(F.lit(0.0), F.round(P.suitability(), 4) - 0.2 * marks), 4).alias("score"),
    )


@query(
    "alternatives_topk", uses=FILTER_USES, extra=FILTERED,
    sql=f"""select site_id, point_id, cast(rn as int) as place, species_no, percent from (
        select site_id, point_id, species_no, round(100*round({SCORE},4),0) as percent, row_number() over (partition by site_id, point_id order by round({SCORE},4) desc, species_no) as rn
        from filt where reason is null and species_no<>own_no) where rn<=3""",
)
def alternatives_topk(t):
    """A place's own best three are found first; rows that repeat a place share three."""
    ranked = P.best_admitted(*filter_inputs(t), 3, F.round(P.suitability(), 4), carry=("structure_kind",))
    best = scan.top_k(ranked, 3, by=("site_id", "point_id"), order=(F.desc("score"), F.col("species_no")), name="place")
    return best.select("site_id", "point_id", "place", "species_no", F.round(100 * F.col("score"), 0).alias("percent"))


@query(
    "single_species_mode", uses=FILTER_USES, extra=FILTERED,
    sql=f"""select site_id, count(*) filter (reason is null) as admitted, count(*) filter (reason is not null) as rejected,
      round(avg(round({SCORE},4)) filter (reason is null),3) as mean_score from filt where species_no=0 group by all""",
)
def single_species_mode(t):
    """One species everywhere: scores where admitted, rejections elsewhere."""
    one = filtered(t).where(F.col("species_no") == 0).withColumn("score", F.round(P.suitability(), 4))
    return one.groupBy("site_id").agg(
        F.count_if(F.col("reason").isNull()).alias("admitted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        F.round(F.avg(F.when(F.col("reason").isNull(), F.col("score"))), 3).alias("mean_score"),
    )


@query(
    "assignment_conditions", uses=("species", "points"), extra=NORMS,
    sql="""select c as condition, count(*) as n_points from points p join (select species_no, unnest(list_filter([case when invasive_decision='conditional' then 'invasive_condition' end,
      case when category_mark='limited' then 'limited_category' end, case when fluff and male_clone then 'male_clones_only' end], lambda x: x is not null)) as c
      from norms where norm_block is null) using(species_no) group by all""",
)
def assignment_conditions(t):
    admitted = checked_species(t).where(F.col("norm_block").isNull()).select("species_no", F.explode("conditions").alias("condition"))
    per = t.points.groupBy("species_no").agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(admitted), "species_no").groupBy("condition").agg(F.sum("n").alias("n_points"))


@query(
    "reassess_species", uses=FILTER_USES, extra=FILTERED,
    sql=f"""select site_id, coalesce(reason,'kept') as reason, count(*) as n, round(sum(round({SCORE},4)),2) as score from filt where own_no=species_no group by all""",
)
def reassess_species(t):
    """Retained species judged again, nothing reassigned."""
    own = filtered(t).where(F.col("own_no") == F.col("species_no")).withColumn("score", F.round(P.suitability(), 4))
    return own.groupBy("site_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("score")
    )


def planted(t: Tables):
    return t.points.join(F.broadcast(t.species.select("species_no", "genus", "family", "conifer", "crown_mature_m", "life_type", "month_a", "month_b")), "species_no")


PLANTED = "planted as (select p.*, s.genus, s.family, s.conifer, s.crown_mature_m, s.life_type, s.month_a, s.month_b from points p join species s using(species_no))"
QUOTA = f"""{PLANTED},
qk as (select site_id, point_id, 'species' as level, cast(species_no as varchar) as key, cast(0.4 as double) as share from planted
  union all select site_id, point_id, 'genus', genus, cast(0.5 as double) from planted union all select site_id, point_id, 'family', family, cast(0.7 as double) from planted
  union all select site_id, point_id, 'conifer', 'conifer', cast(0.5 as double) from planted where conifer),
grown as (select site_id, level, key, count(*) as grown from (select c.site_id, 'genus' as level, s.genus as key from stems c join species s on s.species_no=c.stem_id%58
    union all select c.site_id, 'species', cast(s.species_no as varchar) from stems c join species s on s.species_no=c.stem_id%58
    union all select c.site_id, 'family', s.family from stems c join species s on s.species_no=c.stem_id%58) group by all),
planned as (select site_id, count(*) as planned from points group by all),
gt as (select site_id, sum(grown) as grown_total from grown where level='species' group by all),
ql0 as (select q.site_id, q.level, q.key, q.share, q.n as count, planned, coalesce(grown,0) as grown, cast(coalesce(grown_total,0) as bigint) as grown_total
  from (select site_id, level, key, share, count(*) as n from qk group by all) q join planned using(site_id) left join grown using(site_id, level, key) left join gt using(site_id)),
ql as (select *, level<>'conifer' and grown_total>0 and grown>0 and grown>share*grown_total+cast(1e-9 as double) as exhausted,
   case when share*planned<1 then 1 else cast(floor(share*planned+cast(1e-9 as double)) as bigint) end as plan_limit,
   cast(floor(share*(planned+grown_total)+cast(1e-9 as double)) as bigint)-grown as pop_limit from ql0),
qlim as (select *, case when exhausted then 0 when level<>'conifer' and grown_total>0 then least(plan_limit, pop_limit) else plan_limit end as lim from ql)"""
QUOTA_USES = ("points", "species", "stems")


def quota_table(t: Tables):
    keys = P.quota_keys(planted(t), carry=("point_id",))
    planned = t.points.groupBy("site_id").agg(F.count(F.lit(1)).alias("planned"))
    grown = t.stems.select("site_id", "stem_id").withColumn("species_no", F.col("stem_id") % 58).join(F.broadcast(t.species.select("species_no", "genus", "family").withColumn("conifer", F.lit(False))), "species_no")
    existing = P.quota_keys(grown).groupBy("site_id", "level", "key").agg(F.count(F.lit(1)).alias("grown"))
    return P.quota_limits(keys, planned, existing)


@query("quota_limits", uses=QUOTA_USES, extra=QUOTA, sql='select site_id, level, key, count, lim as "limit", exhausted, greatest(0, count-lim) as excess from qlim')
def quota_limits(t):
    return quota_table(t).select("site_id", "level", "key", "count", "limit", "exhausted", "excess")


@query(
    "validate_composition", uses=QUOTA_USES, extra=QUOTA,
    sql="""select site_id, level, key, case when count>plan_limit then 'plan_quota' when exhausted then 'exhausted' else 'population_quota' end as issue, count, planned
        from qlim where count>plan_limit or (level<>'conifer' and grown_total>0 and (exhausted or count>pop_limit))""",
)
def validate_composition(t):
    """Quotas recomputed from the plan and the inventory, independently of the assignment."""
    rows = quota_table(t)
    plan_limit = P.allowance(F.col("share"), F.col("planned"))
    population = (F.floor(F.col("share") * (F.col("planned") + F.col("grown_total")) + 1e-9) - F.col("grown")).cast("long")
    grows = (F.col("level") != "conifer") & (F.col("grown_total") > 0)
    bad = (F.col("count") > plan_limit) | (grows & (F.col("exhausted") | (F.col("count") > population)))
    issue = F.when(F.col("count") > plan_limit, "plan_quota").when(F.col("exhausted"), "exhausted").otherwise("population_quota")
    return rows.where(bad).select("site_id", "level", "key", issue.alias("issue"), "count", "planned")


@query(
    "trim_to_quotas", uses=QUOTA_USES, extra=QUOTA,
    sql="""select site_id, level, key, count(*) as removed, min(point_id) as first_removed from (
       select q.site_id, q.level, q.key, q.point_id, row_number() over (partition by q.site_id, q.level, q.key order by q.point_id desc) as rn, greatest(0, count-lim) as excess
       from qk q join qlim l on l.site_id=q.site_id and l.level=q.level and l.key=q.key) where rn<=excess group by all""",
)
def trim_to_quotas(t):
    """The latest plantings of every key that stands above its quota, as many as the excess."""
    keys = P.quota_keys(planted(t), carry=("point_id",)).join(
        quota_table(t).where("excess > 0").select("site_id", "level", "key", "excess"), ["site_id", "level", "key"]
    )
    ranked = scan.prefix_sum(keys.withColumn("_back", -F.col("point_id")), F.lit(1), by=("site_id", "level", "key"), order=("_back",), name="rn")
    return ranked.where(F.col("rn") <= F.col("excess")).groupBy("site_id", "level", "key").agg(
        F.count(F.lit(1)).alias("removed"), F.min("point_id").alias("first_removed")
    )


@query(
    "quota_adapt", uses=FILTER_USES, extra=FILTERED,
    sql="""with per as (select point_id, count(distinct species_no) as a, count(distinct genus) as b, count(distinct family) as c from filt where reason is null group by all),
      long as (select 'species' as level, cast(0.4 as double) as share, a as n from per union all select 'genus', cast(0.5 as double), b from per union all select 'family', cast(0.7 as double), c from per),
      med as (select level, share, list_sort(list(n)) as l from long group by all)
      select level, l[1+len(l)//2] as median_options, round(greatest(share, cast(1 as double)/l[1+len(l)//2]),4) as share from med""",
)
def quota_adapt(t):
    """Quota per level not stricter than one over the upper median of options per place."""
    options = filtered(t).where(F.col("reason").isNull()).groupBy("site_id", "point_id").agg(
        F.countDistinct("species_no").alias("species"), F.countDistinct("genus").alias("genus"), F.countDistinct("family").alias("family")
    )
    levels = F.expr("stack(3, 'species', species, 'genus', genus, 'family', family) as (level, n)")
    histogram = options.select(levels).groupBy("level", "n").agg(F.count(F.lit(1)).alias("places"))
    w = Window.partitionBy("level").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("level")
    # The upper median is element n div 2 of the sorted list: the first option count whose
    # cumulative number of places exceeds it. The histogram has at most 58 rows per level.
    at = histogram.withColumn("upto", F.sum("places").over(w)).withColumn("total", F.sum("places").over(whole))
    median = at.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("level").agg(F.min("n").alias("median_options"))
    base = F.when(F.col("level") == "species", P.STRICT_QUOTAS["species"]).when(F.col("level") == "genus", P.STRICT_QUOTAS["genus"]).otherwise(P.STRICT_QUOTAS["family"])
    return median.select("level", "median_options", F.round(F.greatest(base, F.lit(1.0) / F.col("median_options")), 4).alias("share"))


STEP = "case when a.mode='alley' and b.mode='alley' then cast(5 as double) else least(greatest((a.crown_mature_m+b.crown_mature_m)/2.0e0*0.75e0,5.0e0),7.0e0) end"
TREE_PAIRS = f"""{PLANTED},
trees as (select * from planted where planting_type='tree'),
tp as (select a.site_id, a.point_id as a_id, b.point_id as b_id, {S.dist()} as d, a.mode='alley' and b.mode='alley' as in_row, {STEP} as step
  from trees a join trees b on a.site_id=b.site_id and a.point_id<b.point_id and abs(a.x-b.x)<=7 and abs(a.y-b.y)<=7 where {S.dist()} <= 6.65e0)"""


def tree_pairs(t: Tables):
    trees = planted(t).where(F.col("planting_type") == "tree")
    pairs = spatial.self_pairs(trees, 6.65, carry=("mode", "crown_mature_m"), strict=False)
    row = (F.col("a_mode") == "alley") & (F.col("b_mode") == "alley")
    return pairs.withColumn("in_row", row).withColumn("step", P.pair_step(F.col("a_crown_mature_m"), F.col("b_crown_mature_m"), row))


@query("tree_pair_step", uses=("points", "species"), extra=TREE_PAIRS, sql="select a_id, b_id, round(step,3) as step_m, round(greatest(step*0.95e0, least(step,5.0e0)),3) as min_step_m from tp")
def tree_pair_step(t):
    return tree_pairs(t).select(
        F.col("a_point_id").alias("a_id"), F.col("b_point_id").alias("b_id"), F.round("step", 3).alias("step_m"), F.round(P.step_min(F.col("step")), 3).alias("min_step_m")
    )


@query("tree_neighbors", uses=("points", "species"), extra=TREE_PAIRS, sql="select site_id, a_id, b_id, round(d,3) as distance_m, in_row from tp")
def tree_neighbors(t):
    return tree_pairs(t).select("site_id", F.col("a_point_id").alias("a_id"), F.col("b_point_id").alias("b_id"), F.round("distance", 3).alias("distance_m"), "in_row")


def settled(earlier: str) -> str:
    """Pairs that stand too close, and the trees kept by going through them in an order: rounds in recursive SQL.

    ``earlier`` says when tree a of a pair comes before tree b.
    """
    return f"""{TREE_PAIRS},
close as (select site_id, a_id, b_id, d, step from tp where d+0.000001e0 < greatest(step*0.95e0, least(step,5.0e0))),
twoway as (select a_id as id, b_id as other, d, step from close union all select b_id, a_id, d, step from close),
edges as (select a.point_id as other, b.point_id as id from twoway w join trees a on a.point_id=w.other join trees b on b.point_id=w.id where {earlier}),
st as (select 0 as n, point_id as id, 0 as status from trees
  union all
  select st.n+1, st.id, case when st.status<>0 then st.status when coalesce(h.kept,0)>0 then 2 when coalesce(h.open,0)=0 then 1 else 0 end
  from st left join (select e.id, count(*) filter (s2.status=1) as kept, count(*) filter (s2.status=0) as open from edges e join st s2 on s2.id=e.other group by e.id) h on h.id=st.id
  where exists (select 1 from st s3 where s3.status=0)),
chosen as (select id as point_id from st where n=(select max(n) from st) and status=1)"""


@query(
    "enforce_spacing", uses=("points", "species"), recursive=True, extra=settled("a.price>b.price or (a.price=b.price and a.point_id<b.point_id)"),
    sql="""with nb as (select id, min(row(d, other, step)) as m from twoway w join chosen on chosen.point_id=w.other group by all)
       select t.site_id, t.point_id, c.point_id is not null as kept, case when c.point_id is null then m[2] end as neighbour_id,
         case when c.point_id is null then round(m[1],3) end as distance_m, case when c.point_id is null then round(m[3],3) end as step_m
       from trees t left join chosen c on c.point_id=t.point_id left join nb on nb.id=t.point_id""",
)
def enforce_spacing(t):
    """Trees left after every too-close pair lost its lower-scored member, with the loser's reason."""
    trees = planted(t).where(F.col("planting_type") == "tree")
    close = tree_pairs(t).where(F.col("distance") + 1e-6 < P.step_min(F.col("step")))
    ranked = trees.select(F.col("point_id").alias("id"), (-F.col("price")).alias("minus_score"))
    edges = close.select(F.col("a_point_id").alias("a"), F.col("b_point_id").alias("b"))
    kept = graph.first_independent_set(ranked, edges, order=("minus_score", "id")).withColumn("kept", F.lit(True))
    both = close.select("site_id", F.col("a_point_id").alias("id"), F.col("b_point_id").alias("other"), "distance", "step").unionByName(
        close.select("site_id", F.col("b_point_id").alias("id"), F.col("a_point_id").alias("other"), "distance", "step"))
    reason = both.join(kept.select(F.col("id").alias("other")), "other", "left_semi").groupBy("id").agg(
        F.min(F.struct("distance", "other", "step")).alias("near"))
    return trees.select("site_id", F.col("point_id").alias("id")).join(kept, "id", "left").join(reason, "id", "left").select(
        "site_id", F.col("id").alias("point_id"), F.coalesce("kept", F.lit(False)).alias("kept"),
        F.when(F.col("kept").isNull(), F.col("near.other")).alias("neighbour_id"),
        F.when(F.col("kept").isNull(), F.round("near.distance", 3)).alias("distance_m"), F.when(F.col("kept").isNull(), F.round("near.step", 3)).alias("step_m"),
    )


@query(
    "drop_spacing_conflicts", uses=("points", "species"), recursive=True, extra=settled("a.point_id<b.point_id"),
    sql="select site_id, point_id from trees where point_id not in (select point_id from chosen)",
)
def drop_spacing_conflicts(t):
    """Of overlapping trees the later one goes: plantings are kept in the order of their ids."""
    trees = planted(t).where(F.col("planting_type") == "tree")
    close = tree_pairs(t).where(F.col("distance") + 1e-6 < P.step_min(F.col("step")))
    edges = close.select(F.col("a_point_id").alias("a"), F.col("b_point_id").alias("b"))
    kept = graph.first_independent_set(trees.select(F.col("point_id").alias("id")), edges, order=("id",))
    return trees.select("site_id", "point_id").join(kept.select(F.col("id").alias("point_id")), "point_id", "left_anti")


@query(
    "composition_summary", uses=("points", "species"), extra=PLANTED,
    sql="""with n as (select site_id, species_no, count(*) as n from planted group by all), tot as (select site_id, sum(n) as t from n group by all),
      sh as (select site_id, round(-sum((n/cast(t as double))*ln(n/cast(t as double))),4) as shannon from n join tot using(site_id) group by all)
      select site_id, count(*) as plantings, count(distinct species_no) as species, count(distinct genus) as genera,
        round(count(*) filter (conifer)/cast(count(*) as double),4) as conifer_share, shannon from planted join sh using(site_id) group by site_id, shannon""",
)
def composition_summary(t):
    plan = planted(t)
    counts = plan.groupBy("site_id", "species_no").agg(F.count(F.lit(1)).alias("n"))
    totals = plan.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("plantings"), F.countDistinct("species_no").alias("species"), F.countDistinct("genus").alias("genera"),
        F.round(F.count_if(F.col("conifer")) / F.count(F.lit(1)), 4).alias("conifer_share"),
    )
    return totals.join(P.shannon(counts, ("site_id",)), "site_id")


@query(
    "composition_refresh", uses=("points", "species"), extra=PLANTED,
    sql="""with long as (select site_id, planting_type, 'genus' as level, genus as key from planted union all select site_id, planting_type, 'family', family from planted
         union all select site_id, planting_type, 'month', cast(month_a as varchar) from planted union all select site_id, planting_type, 'month', cast(month_b as varchar) from planted),
      c as (select site_id, planting_type, level, key, count(*) as n from long group by all), tot as (select site_id, planting_type, count(*) as t from planted group by all)
      select site_id, planting_type, level, key, n, case when level='month' then null else round(n/cast(t as double),4) end as share from c join tot using(site_id, planting_type)""",
)
def composition_refresh(t):
    """Genus and family shares and decorative plants by month, for trees and shrubs apart."""
    entry = lambda level, key: F.struct(F.lit(level).alias("level"), key.cast("string").alias("key"))
    long = planted(t).select(
        "site_id", "planting_type",
        F.explode(F.array(entry("genus", F.col("genus")), entry("family", F.col("family")), entry("month", F.col("month_a")), entry("month", F.col("month_b")))).alias("e"),
    )
    counts = long.groupBy("site_id", "planting_type", "e.level", "e.key").agg(F.count(F.lit(1)).alias("n"))
    totals = t.points.groupBy("site_id", "planting_type").agg(F.count(F.lit(1)).alias("total"))
    share = F.when(F.col("level") != "month", F.round(F.col("n") / F.col("total"), 4))
    return counts.join(totals, ["site_id", "planting_type"]).select("site_id", "planting_type", "level", "key", "n", share.alias("share"))


@query(
    "drop_unplanted", uses=FILTER_USES, extra=FILTERED,
    sql="""with best as (select site_id, point_id, count(*) filter (reason is null) as ok, min(reason) as why from filt group by all)
      select site_id, case when ok>0 then 'planted' else why end as outcome, count(*) as n from best group by all""",
)
def drop_unplanted(t):
    """Places where no species is admitted turn into rejections with the first reason."""
    per = P.planted_or_why(*filter_inputs(t))
    return per.groupBy("site_id", F.when(F.col("ok"), "planted").otherwise(F.col("why")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "structure_cluster", uses=("points",), recursive=True,
    extra=f"""e as (select a.point_id as a, b.point_id as b from points a join points b on a.site_id=b.site_id and a.mode=b.mode and a.point_id<>b.point_id
        and abs(a.x-b.x)<=8 and abs(a.y-b.y)<=8 where {S.dist()} <= 7.5e0),
      reach as (select point_id as id, point_id as root from points union select e.a, reach.root from reach join e on e.b=reach.id),
      comp as (select id, min(root) as component from reach group by all),
      sz as (select component, count(*) as size from comp group by all)""",
    sql="""select p.site_id, p.point_id, c.component, s.size, case when size<2 then 'single' when mode='alley' then 'row'
       when mode='lawn' then case when size>=3 then 'group' else 'single' end else 'row' end as kind
       from points p join comp c on c.id=p.point_id join sz s using(component)""",
)
def structure_cluster(t):
    points = t.points.select("site_id", "point_id", "x", "y", "mode")
    return P.structures(points).select("site_id", "point_id", "component", "size", "kind")
