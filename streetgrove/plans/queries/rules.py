"""Distance-rule engine on the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetgrove.functions import geom, rulebook
from streetgrove.operators import rules as R
from streetgrove.operators import spatial
from streetgrove.plans import checksql as S
from streetgrove.plans import shared
from streetgrove.plans.registry import query
from streetgrove.sources import sinks


@query(
    "rule_edition_filter", uses=("points",), extra=S.RULES,
    sql="""select rule_id, planting_type, min_distance_m, count(*) as n_points from all_rules join points using(planting_type)
           where edition is null or edition='2026' group by all""",
)
def rule_edition_filter(t):
    rules = R.in_edition(rulebook.distance_rules(t.spark), "2026")
    per_type = t.points.groupBy("planting_type").agg(F.count(F.lit(1)).alias("n_points"))
    return rules.join(per_type, "planting_type").select("rule_id", "planting_type", "min_distance_m", "n_points")


SPECIES_RULES = f"""{S.RULES},
sp as (select *, case when thorny then ['thorny'] else cast([] as varchar[]) end as traits_s from species),
sp_rules as (select sp.species_no, sp.crown_mature_m, sp.height_m, r.*,
    case when severity='forbid' and table91 then min_distance_m+greatest(cast(0 as double),crown_mature_m-5)*cast(0.5 as double) else min_distance_m end as threshold
  from sp join all_rules r on r.planting_type=sp.life_type and (edition is null or edition='2016') and rule_id not in ({S.DISABLED})
   and (min_crown_m is null or crown_mature_m>min_crown_m) and (len(genera)=0 or list_contains(genera, genus))
   and len(list_filter(r.traits, lambda x: not list_contains(traits_s, x)))=0)"""


@query(
    "rule_applicability", uses=("species",), extra=SPECIES_RULES,
    sql="select species_no, rule_id, object_class, min_distance_m from sp_rules",
)
def rule_applicability(t):
    rules = R.enabled(R.in_edition(rulebook.distance_rules(t.spark), "2016"), rulebook.STRICT_DISABLED)
    return R.applicable(shared.species(t), rules).select("species_no", "rule_id", "object_class", "min_distance_m")


@query(
    "crown_threshold", uses=("species",), extra=SPECIES_RULES,
    sql="select species_no, rule_id, round(crown_mature_m,3) as crown_mature_m, round(threshold,4) as threshold_m from sp_rules",
)
def crown_threshold(t):
    return shared.species_rules(t).select(
        "species_no", "rule_id", F.round("crown_mature_m", 3).alias("crown_mature_m"), F.round("min_distance_m", 4).alias("threshold_m")
    )


@query(
    "utility_presence", uses=("sites", "features"), extra=S.PRESENCE, sql="select site_id, has_utility_data from presence",
)
def utility_presence(t):
    return shared.presence(t)


@query(
    "nearest_clearance", uses=("points", "segments"), extra=S.CLEARANCE,
    sql="select site_id, point_id, object_class, round(axis_m,3) as axis_m, axis_id, round(wall_m,3) as wall_m, wall_id from clr",
)
def nearest_clearance(t):
    return shared.clearance(t).withColumn("axis_m", F.round("axis_m", 3)).withColumn("wall_m", F.round("wall_m", 3))


@query(
    "rule_check", uses=S.FACTS_USES, extra=S.FACTS,
    sql="select site_id, point_id, rule_id, object_class, outcome, threshold_m, measured_m, nearest_id from chk",
)
def rule_check(t):
    return shared.facts(t).select("site_id", "point_id", "rule_id", "object_class", "outcome", "threshold_m", "measured_m", "nearest_id")


POINT_SPECIES = "pts as (select p.*, s.height_m as height_sp from points p join species s using(species_no))"
BARRIER_SQL = "case when height_sp<5 then cast(0.5 as double) when height_sp<=20 then cast(1 as double) end"


@query(
    "barrier_relaxation", uses=(*S.FACTS_USES, "species"),
    extra=f"{S.GENERAL},\n{S.CLEARANCE},\n{S.PRESENCE},\n{POINT_SPECIES},\n" + S.checks("rules", points="pts", barrier=BARRIER_SQL, keep="height_sp,"),
    sql="select object_class, outcome, count(*) as n, round(min(measured_m),3) as min_m from chk where outcome<>'pass' group by all",
)
def barrier_relaxation(t):
    heights = t.species.select("species_no", F.col("height_m").alias("height_sp"))
    points = t.points.select("site_id", "point_id", "planting_type", "species_no", "x", "y").join(F.broadcast(heights), "species_no")
    facts = R.checks(points, shared.strict_rules(t), shared.clearance(t, reach=shared.GENERAL_REACH), shared.presence(t), barrier_m=R.barrier_distance(F.col("height_sp")))
    return facts.where(F.col("outcome") != "pass").groupBy("object_class", "outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("measured_m"), 3).alias("min_m"))


@query(
    "verdict_reduce", uses=S.FACTS_USES, extra=f"{S.FACTS},\n{S.VERDICTS}", sql="select site_id, point_id, verdict, needs_barrier from verd",
)
def verdict_reduce(t):
    return R.verdicts(shared.facts(t, reach=shared.GENERAL_REACH))


@query(
    "slack_to_network", uses=S.FACTS_USES, extra=S.FACTS,
    sql=f"""select site_id, point_id, round(min(case when measured_m is not null and outcome<>'no_data' and threshold_m>0 and {S.util()} then measured_m-threshold_m end),3) as slack_m
        from chk group by all""",
)
def slack_to_network(t):
    return R.slack_to_network(shared.facts(t))


FOOTPRINT = "case when p.planting_type='tree' then cast(1.24 as double) else cast(0.5 as double) end"
PLANTABLE = f"""{S.INSIDE},
hard_near as (select distinct p.site_id, p.point_id from points p join segments s on s.site_id=p.site_id and s.is_area=1
   where s.x1 between p.x-60 and p.x+60 and s.y1 between p.y-60 and p.y+60 and {S.seg_dist()} <= {FOOTPRINT}),
plantable as (select p.* from points p join sites r using(site_id)
   where least(p.x-x0, x1-p.x, p.y-y0, y1-p.y) > 0 and least(p.x-x0, x1-p.x, p.y-y0, y1-p.y) >= {FOOTPRINT}
   and (p.site_id,p.point_id) not in (select site_id,point_id from hard_near) and (p.site_id,p.point_id) not in (select site_id,point_id from inside))"""


def footprint():
    return F.when(F.col("planting_type") == "tree", 1.24).otherwise(0.5)


def plantable(t):
    points = t.points.select("site_id", "point_id", "planting_type", "species_no", "station", "opt", "mode", "x", "y")
    return R.plantable(points, shared.area_rings(t), t.sites, footprint(), max_radius=1.24)


@query("plantable_mask", uses=("points", "segments", "sites"), extra=PLANTABLE, sql="select site_id, point_id from plantable")
def plantable_mask(t):
    return plantable(t).select("site_id", "point_id")


@query(
    "point_check", uses=(*S.FACTS_USES, "species"),
    extra=f"{SPECIES_RULES},\n{S.CLEARANCE},\n{S.PRESENCE},\n{PLANTABLE[len(S.INSIDE) + 1:]},\n"
    + S.checks("sp_rules", threshold="threshold", by="species_no") + f",\n{S.VERDICTS}",
    sql="""select p.site_id, p.point_id, case when a.point_id is null then 'forbidden' else coalesce(verdict,'allowed') end as verdict, a.point_id is not null as plantable,
        case when a.point_id is null then 'not_on_soil' else '' end as note
        from points p left join verd v using(site_id, point_id) left join plantable a using(site_id, point_id)""",
)
def point_check(t):
    """What if this species stood at this point: footprint, checks of the species, verdict, reason."""
    points = t.points.select("site_id", "point_id", "species_no", "planting_type", "x", "y")
    rules = shared.species_rules(t).drop("genus", "crown_mature_m", "height_m", "planting_type")
    facts = R.checks(points, rules, shared.clearance(t, reach=shared.species_reach(t)), shared.presence(t), by=("species_no",))
    ok = plantable(t).select("site_id", "point_id", F.lit(True).alias("plantable"))
    return (
        points.select("site_id", "point_id").join(R.verdicts(facts), ["site_id", "point_id"], "left").join(ok, ["site_id", "point_id"], "left")
        .select(
            "site_id", "point_id",
            F.when(F.col("plantable").isNull(), "forbidden").otherwise(F.coalesce("verdict", F.lit("allowed"))).alias("verdict"),
            F.coalesce("plantable", F.lit(False)).alias("plantable"),
            F.when(F.col("plantable").isNull(), "not_on_soil").otherwise("").alias("note"),
        )
    )


@query(
    "barrier_option", uses=S.FACTS_USES, extra=S.FACTS,
    sql=f"""select site_id, point_id, min(measured_m) as barrier_m, case when min(measured_m)<cast(1 as double)-cast(0.001 as double) then cast(5 as double) else cast(20 as double) end as height_limit_m
      from chk where outcome='fail' and severity='forbid' group by all
      having bool_and(planting_type='tree' and ({S.util()} or object_class in ('curb','road')) and measured_m is not null and measured_m>=cast(0.5 as double)-cast(0.001 as double))""",
)
def barrier_option(t):
    return R.barrier_option(shared.facts(t, reach=shared.GENERAL_REACH))


@query(
    "species_trace", uses=(*S.FACTS_USES, "species"), extra=f"{SPECIES_RULES},\n{S.CLEARANCE},\n{S.PRESENCE},\n" + S.checks("sp_rules", threshold="threshold", by="species_no"),
    sql="select site_id, point_id, rule_id, outcome, round(threshold_m,4) as threshold_m, measured_m, nearest_id from chk",
)
def species_trace(t):
    """Every placement re-measured with the rules of its own species."""
    points = t.points.select("site_id", "point_id", "species_no", "planting_type", "x", "y")
    rules = shared.species_rules(t).drop("genus", "crown_mature_m", "height_m", "planting_type")
    facts = R.checks(points, rules, shared.clearance(t), shared.presence(t), by=("species_no",))
    return facts.select("site_id", "point_id", "rule_id", "outcome", F.round("threshold_m", 4).alias("threshold_m"), "measured_m", "nearest_id")


ACTS = rulebook.sql_values("acts", "act_id, short", rulebook.act_rows())


@query(
    "disabled_rules_note", uses=("points",), extra=f"{S.RULES},\n{ACTS}",
    sql=f"""select act_id, short, count(distinct rule_id) as n_rules, cast(sum(n) as bigint) as n_points from all_rules join acts using(act_id)
        join (select planting_type, count(*) as n from points group by all) using(planting_type) where rule_id in ({S.DISABLED}) group by all""",
)
def disabled_rules_note(t):
    """Norms the profile does not apply, by act, with the plantings each would have governed."""
    off = rulebook.distance_rules(t.spark).where(F.col("rule_id").isin(*rulebook.STRICT_DISABLED))
    per_type = t.points.groupBy("planting_type").agg(F.count(F.lit(1)).alias("n"))
    return (
        off.join(rulebook.acts(t.spark), "act_id").join(per_type, "planting_type")
        .groupBy("act_id", "short").agg(F.countDistinct("rule_id").alias("n_rules"), F.sum("n").alias("n_points"))
    )


@query(
    "audit_rules", uses=("points",), extra=S.ACT_RULES,
    sql="select rule_id, act_id, min_distance_m, count(*) as n_points from act_rules join points using(planting_type) group by all",
)
def audit_rules(t):
    per_type = t.points.groupBy("planting_type").agg(F.count(F.lit(1)).alias("n_points"))
    return R.act_rules(rulebook.distance_rules(t.spark)).join(per_type, "planting_type").select("rule_id", "act_id", "min_distance_m", "n_points")


@query(
    "audit_check", uses=S.FACTS_USES, extra=f"{S.ACT_FACTS},\n{S.VERDICTS}",
    sql="""select site_id, point_id, verdict, count(*) filter (outcome='fail' and severity='forbid') as violations,
        count(*) filter (outcome='fail' and severity<>'forbid') as approvals, count(*) filter (outcome='barrier') as barriers
        from chk join verd using(site_id, point_id) group by all""",
)
def audit_check(t):
    facts = shared.audit_facts(t)
    failed = F.col("outcome") == "fail"
    counts = facts.groupBy("site_id", "point_id").agg(
        F.count_if(failed & (F.col("severity") == "forbid")).alias("violations"),
        F.count_if(failed & (F.col("severity") != "forbid")).alias("approvals"),
        F.count_if(F.col("outcome") == "barrier").alias("barriers"),
        F.count_if(F.col("outcome") == "no_data").alias("_nodata"),
    )
    verdict = F.when(F.col("violations") > 0, "forbidden").when((F.col("_nodata") > 0) | (F.col("approvals") > 0), "needs_approval").otherwise("allowed")
    return counts.select("site_id", "point_id", verdict.alias("verdict"), "violations", "approvals", "barriers")


@query(
    "audit_summary", uses=S.FACTS_USES, extra=S.ACT_FACTS,
    sql="""select rule_id, act_id, count(*) as violations, count(distinct site_id) as sites, min(measured_m) as closest_m
        from chk where outcome='fail' and severity='forbid' group by all""",
)
def audit_summary(t):
    """Which norms does the plan break, and how often?"""
    broken = shared.audit_facts(t).where((F.col("outcome") == "fail") & (F.col("severity") == "forbid"))
    return (
        broken.groupBy("rule_id", "act_id")
        .agg(F.count(F.lit(1)).alias("violations"), F.countDistinct("site_id").alias("sites"), F.min("measured_m").alias("closest_m"))
        .orderBy(F.desc("violations"), "rule_id")
    )


@query(
    "audit_totals", uses=S.FACTS_USES, extra=S.ACT_FACTS,
    sql="""with per as (select site_id, point_id, planting_type, count(*) filter (outcome='fail' and severity='forbid') as v,
          count(*) filter (outcome='fail' and severity<>'forbid') as a, count(*) filter (outcome='barrier') as b from chk group by all)
        select site_id, count(*) as plantings, count(*) filter (planting_type='tree') as trees, count(*) filter (planting_type='shrub') as shrubs,
          count(*) filter (v>0) as with_violations, cast(sum(v) as bigint) as violations, count(*) filter (v=0 and a>0) as only_needs_approval,
          count(*) filter (v=0 and b>0) as only_with_root_barrier from per group by all""",
)
def audit_totals(t):
    failed = F.col("outcome") == "fail"
    per = shared.audit_facts(t).groupBy("site_id", "point_id", "planting_type").agg(
        F.count_if(failed & (F.col("severity") == "forbid")).alias("v"),
        F.count_if(failed & (F.col("severity") != "forbid")).alias("a"),
        F.count_if(F.col("outcome") == "barrier").alias("b"),
    )
    return per.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("plantings"), F.count_if(F.col("planting_type") == "tree").alias("trees"),
        F.count_if(F.col("planting_type") == "shrub").alias("shrubs"), F.count_if(F.col("v") > 0).alias("with_violations"),
        F.sum("v").alias("violations"), F.count_if((F.col("v") == 0) & (F.col("a") > 0)).alias("only_needs_approval"),
        F.count_if((F.col("v") == 0) & (F.col("b") > 0)).alias("only_with_root_barrier"),
    )


@query(
    "audit_rows_sink", uses=S.FACTS_USES, extra=S.ACT_FACTS,
    sql="""select site_id, point_id, rule_id, case when outcome='fail' and severity='forbid' then 'violation' when outcome='fail' then 'approval' else outcome end as kind,
        threshold_m, measured_m, round(threshold_m-measured_m,3) as lacking_m, nearest_id from chk where outcome<>'pass'""",
)
def audit_rows_sink(t):
    kind = F.when((F.col("outcome") == "fail") & (F.col("severity") == "forbid"), "violation").when(F.col("outcome") == "fail", "approval").otherwise(F.col("outcome"))
    return sinks.written(shared.audit_facts(t).where(F.col("outcome") != "pass").select(
        "site_id", "point_id", "rule_id", kind.alias("kind"), "threshold_m", "measured_m",
        F.round(F.col("threshold_m") - F.col("measured_m"), 3).alias("lacking_m"), "nearest_id",
    ), "audit-rows", "csv")
