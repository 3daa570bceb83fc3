"""Edit journal, run log and progress on the canonical tables."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from streetgrove.functions import geom, rulebook
from streetgrove.operators import edits as E
from streetgrove.operators import rules as R
from streetgrove.operators import graph, scan, spatial
from streetgrove.plans import checksql as S
from streetgrove.plans import fixtures, shared
from streetgrove.plans.queries.selection import walk
from streetgrove.plans.registry import Tables, query
from streetgrove.session import cut

# Even plantings stand in the plan when a run begins.
REPLAY = """ed as (select run_id, seq, target, kind, round(value,2) as position, target%2=0 as starts from edits where kind is not null),
st as (select *, last_value(case kind when 'add' then true when 'delete' then false end ignore nulls) over (partition by run_id, target order by seq rows between unbounded preceding and 1 preceding) as prev from ed),
rep as (select *, coalesce(prev, starts) as present, case when kind='add' then not coalesce(prev, starts) else coalesce(prev, starts) end as accepted from st)"""


def edits(t: Tables):
    return t.edits.where(F.col("kind").isNotNull()).select("run_id", "seq", "target", "kind", F.round("value", 2).alias("position"))


def starts():
    return F.col("target") % 2 == 0


@query("edit_journal_apply", uses=("edits",), extra=REPLAY, sql="select run_id, seq, target, kind, accepted from rep")
def edit_journal_apply(t):
    return E.replay(E.once(edits(t)), starts()).select("run_id", "seq", "target", "kind", "accepted")


@query(
    "edit_marks_fold", uses=("edits",),
    extra=REPLAY + """,
  fold as (select run_id, target, bool_and(starts) as starts, arg_max(kind, seq) as last_kind, max(seq) as last_seq, arg_max(position, seq) filter (kind<>'delete') as position, count(*) as edits from rep where accepted group by all)""",
    sql="""select run_id, target, case when starts and last_kind<>'delete' then 'move' when starts then 'delete' else 'add' end as mark, last_seq, case when last_kind<>'delete' then position end as position, edits from fold
       where not (not starts and last_kind='delete')""",
)
def edit_marks_fold(t):
    return E.marks(E.replay(E.once(edits(t)), starts()), starts()).select("run_id", "target", "mark", "last_seq", "position", "edits")


@query(
    "edit_idempotency", uses=("edits",),
    sql="select run_id, count(*) as edits, count(*)+count(*) filter (kind='move') as delivered from edits where kind is not null group by all",
)
def edit_idempotency(t):
    """Moves are delivered twice; every (run, seq) is applied once."""
    all_edits = edits(t)
    delivered = all_edits.unionByName(all_edits.where(F.col("kind") == "move"))
    counts = delivered.groupBy("run_id").agg(F.count(F.lit(1)).alias("delivered"))
    return E.once(delivered).groupBy("run_id").agg(F.count(F.lit(1)).alias("edits")).join(counts, "run_id")


EDIT_POINTS = f"""{REPLAY},
points as (select run_id%5 as site_id, run_id*1000+target as point_id, 'tree' as planting_type, round(1000*(run_id%5)+cast(((max(seq)*7919)%100003) as double)*1000/100003.0e0,3) as x, round(cast(((max(seq)*104729)%99991) as double)*1000/99991.0e0,3) as y, run_id, max(seq) as seq
   from rep where accepted and kind<>'delete' group by run_id, target)"""


def edited_points(t: Tables):
    done = E.replay(E.once(edits(t)), starts()).where("accepted and kind <> 'delete'").groupBy("run_id", "target").agg(F.max("seq").alias("seq"))
    x = F.round(1000 * (F.col("run_id") % 5) + ((F.col("seq") * 7919) % 100003).cast("double") * 1000 / 100003.0, 3)
    y = F.round(((F.col("seq") * 104729) % 99991).cast("double") * 1000 / 99991.0, 3)
    return done.select((F.col("run_id") % 5).alias("site_id"), (F.col("run_id") * 1000 + F.col("target")).alias("point_id"), F.lit("tree").alias("planting_type"), x.alias("x"), y.alias("y"), "run_id", "seq")


# Least distance of an edited tree to the trees and the shrubs beside it.
TREE_STEP_M, SHRUB_STEP_M = 5.0, 1.74
CROWDED = f"""standing as ({fixtures.FIXTURES['points']}),
good as (select v.*, p.x, p.y, p.run_id, p.seq from verd v join points p on p.site_id=v.site_id and p.point_id=v.point_id where verdict<>'forbidden'
  and not exists (select 1 from standing s where s.site_id=p.site_id and abs(s.x-p.x)<=5 and abs(s.y-p.y)<=5 and sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y))+0.001e0 < case when s.planting_type='tree' then {TREE_STEP_M}e0 else {SHRUB_STEP_M}e0 end)),
""" + re.sub(r"\bst\b", "wst", walk("seq, point_id", f"{TREE_STEP_M - geom.EPS_M!r}e0", "and a.run_id=b.run_id", "good"))


def uncrowded(points, standing):
    """Plantings of ``points`` that keep their step: no edited one stays too near to what stands in the street, and of edited ones of a run the later goes."""
    others = spatial.near_points(
        standing.select("site_id", F.col("planting_type").alias("beside"), "x", "y"),
        points.select("site_id", "point_id", F.col("x").alias("bx"), F.col("y").alias("by")), TREE_STEP_M, spread=("x", "y"))
    need = F.when(F.col("beside") == "tree", TREE_STEP_M).otherwise(SHRUB_STEP_M)
    crowded = others.where(F.col("distance") + geom.EPS_M < need).select("site_id", "point_id").distinct()
    left = points.join(crowded, ["site_id", "point_id"], "left_anti")
    return graph.first_spaced_points(left, TREE_STEP_M - geom.EPS_M, order=("seq", "point_id"), on=("site_id", "run_id")).select("site_id", "point_id")


@query(
    "edit_revalidate", uses=("edits", "segments", "features", "sites"), recursive=True, extra=f"{EDIT_POINTS},\n{S.FACTS},\n{S.VERDICTS},\n{CROWDED}",
    sql="""select site_id, point_id, case when verdict<>'forbidden' and c.point_id is null then 'forbidden' else verdict end as verdict,
      case when verdict<>'forbidden' and c.point_id is null then 'spacing' else (select min(rule_id) from chk c where c.point_id=v.point_id and c.outcome='fail' and c.severity='forbid') end as reason
      from verd v left join chosen c using(point_id)""",
)
def edit_revalidate(t):
    """Edited plantings measured again; one that breaks a norm becomes a rejection with the rule, one that crowds its neighbours a rejection for its step."""
    points = cut(edited_points(t), "edited")
    clearance = R.nearest_clearance(points, t.segments, reach=shared.GENERAL_REACH, inside=_inside(t, points))
    facts = R.checks(points.drop("run_id", "seq"), shared.strict_rules(t), clearance, shared.presence(t))
    broken = facts.where((F.col("outcome") == "fail") & (F.col("severity") == "forbid")).groupBy("site_id", "point_id").agg(F.min("rule_id").alias("reason"))
    judged = cut(R.verdicts(facts).select("site_id", "point_id", "verdict").join(broken, ["site_id", "point_id"], "left"), "judged")
    known = points.where(spatial.finite("x", "y")).dropna(subset=["site_id", "run_id", "point_id"])  # others stand beside nothing
    fit = known.join(judged.where("verdict <> 'forbidden'").select("site_id", "point_id"), ["site_id", "point_id"], "left_semi")
    gone = fit.select("site_id", "point_id").distinct().join(uncrowded(fit, t.points), ["site_id", "point_id"], "left_anti").withColumn("crowded", F.lit(True))
    crowded = F.coalesce("crowded", F.lit(False))
    return judged.join(gone, ["site_id", "point_id"], "left").select(
        "site_id", "point_id", F.when(crowded, "forbidden").otherwise(F.col("verdict")).alias("verdict"), F.when(crowded, "spacing").otherwise(F.col("reason")).alias("reason"))


def _inside(t: Tables, points):
    return spatial.lowest_areas(points, shared.area_rings(t))


@query(
    "stage_timing", uses=(),
    sql="""with r as (select l_orderkey%20 as run_id, l_linenumber as stage, l_extendedprice as ms from lineitem), s as (select run_id, stage, sum(ms) as ms, count(*) as n from r group by all)
      select run_id, stage, n, round(ms,1) as ms, round(ms/sum(ms) over (partition by run_id),4) as share from s""",
)
def stage_timing(t):
    """Time per stage of every run and its share."""
    stages = t.lineitem.groupBy((F.col("l_orderkey") % 20).alias("run_id"), F.col("l_linenumber").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("ms"))
    total = F.sum("ms").over(Window.partitionBy("run_id"))
    return stages.select("run_id", "stage", "n", F.round("ms", 1).alias("ms"), F.round(F.col("ms") / total, 4).alias("share"))


# Weights of stages in the time of a run, numbered as in the fixture.
STAGE_WEIGHTS = [(1, "read", 0.29), (2, "classify", 0.06), (3, "surface", 0.03), (4, "place", 0.14), (5, "assort", 0.03), (6, "write_dxf", 0.18), (7, "verify", 0.19)]
SECONDS_PER_MB = 2.4
MIN_PRIOR_S = 6.0
FRACTION_CAP = 0.99
STAGES_SQL = rulebook.sql_values("sw", "stage, title, w", STAGE_WEIGHTS)


@query(
    "progress_estimate", uses=(), extra=STAGES_SQL,
    sql="""with tw as (select sum(w) as tw from sw), d as (select l_orderkey as run_id, l_linenumber as stage, sum(l_extendedprice)/1000 as s from lineitem group by all),
       m as (select l_orderkey as run_id, sum(l_quantity) as mb from lineitem group by all),
       p as (select run_id, sum(w/tw) as done_w, sum(s) as done_s from d join sw using(stage), tw group by all),
       q as (select p.run_id, done_w, done_s, greatest(6.0e0, 2.4e0*mb)*tw as prior from p join m using(run_id), tw),
       e as (select *, done_s+prior*(1-done_w)*power(done_s/(prior*done_w), done_w) as total from q)
       select run_id, round(least(done_w, 0.99e0),3) as fraction, round(greatest(total-done_s, 0.0e0),1) as eta_s from e""",
)
def progress_estimate(t):
    """Fraction done by stage weights and the time left, the prior scaled by the observed speed."""
    total_weight = sum(w for *_, w in STAGE_WEIGHTS)
    weights = t.spark.createDataFrame([(s, w / total_weight) for s, _, w in STAGE_WEIGHTS], "stage int, w double")
    done = t.lineitem.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage")).agg(F.sum("l_extendedprice").alias("ms"), F.sum("l_quantity").alias("mb"))
    runs = done.join(F.broadcast(weights), "stage").groupBy("run_id").agg(F.sum("w").alias("done_w"), F.sum(F.col("ms") / 1000).alias("done_s"), F.sum("mb").alias("mb"))
    prior = F.greatest(F.lit(MIN_PRIOR_S), SECONDS_PER_MB * F.col("mb")) * total_weight
    speed = F.when(F.col("done_w") > 0, F.col("done_s") / (F.col("prior") * F.col("done_w"))).otherwise(1.0)
    total = F.col("done_s") + F.col("prior") * (1 - F.col("done_w")) * F.pow(speed, F.col("done_w"))
    return runs.withColumn("prior", prior).withColumn("total", total).select(
        "run_id", F.round(F.least(F.col("done_w"), F.lit(FRACTION_CAP)), 3).alias("fraction"), F.round(F.greatest(F.col("total") - F.col("done_s"), F.lit(0.0)), 1).alias("eta_s"))


@query(
    "recent_runs", uses=(),
    sql="""with r as (select o_orderkey as run_id, o_custkey%5 as store, o_orderdate as ts, o_orderstatus as state, cast(floor(o_totalprice) as bigint) as size from orders),
       c as (select *, sum(size) over (partition by store order by ts desc, run_id desc) as upto, row_number() over (partition by store order by ts desc, run_id desc) as place from r)
       select store, run_id, cast(place as int) as place, state='F' and upto>10000000 as remove from c where place<=10 or (state='F' and upto>10000000)""",
)
def recent_runs(t):
    """The ten newest runs of each store, and finished runs beyond the size budget to remove.

    Sizes are accumulated from the newest run back by a distributed prefix sum, so a store with
    most of the runs is not ordered in one task.
    """
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 5).alias("store"), F.col("o_orderstatus").alias("state"), F.floor("o_totalprice").cast("long").alias("size"),
        (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"), (-F.col("o_orderkey")).alias("back"))
    sized = scan.prefix_sum(runs, F.col("size"), by=("store",), order=("age", "back"), name="upto")
    numbered = scan.prefix_sum(sized, F.lit(1), by=("store",), order=("age", "back"), name="place")
    remove = (F.col("state") == "F") & (F.col("upto") > 10_000_000)
    return numbered.where((F.col("place") <= 10) | remove).select("store", "run_id", F.col("place").cast("int").alias("place"), remove.alias("remove"))
