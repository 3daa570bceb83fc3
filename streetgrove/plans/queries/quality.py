"""Quality terms and the index on the canonical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from streetgrove.functions import geom
from streetgrove.operators import quality as Q
from streetgrove.operators import rules as R
from streetgrove.operators import chains, scan, spatial
from streetgrove.plans import checksql as S
from streetgrove.plans import shared
from streetgrove.plans.registry import Tables, query

GOALS = """goals as (select site_id, length_m, greatest(least(cast(150 as double)*(length_m/1000), cast(capacity as double)), cast(1 as double)) as t_trees,
   greatest(cast(600 as double)*(length_m/1000), cast(1 as double)) as t_shrubs from streets),
plan as (select p.*, s.crown_mature_m, s.allergen, s.category_mark, s.gas, s.month_a, s.month_b, s.genus, s.family, s.fluff and s.male_clone as conditional
   from points p join species s using(species_no))"""
USES = ("points", "species", "streets")


def half_sums(value: str, source="plan") -> str:
    return f"""(select g.site_id, cast(0.5 as double)*least(cast(1 as double), coalesce(sum(case when planting_type='tree' then {value} else cast(0 as double) end),0)/t_trees)
      + cast(0.5 as double)*least(cast(1 as double), coalesce(sum(case when planting_type='tree' then cast(0 as double) else {value} end),0)/t_shrubs) as score
     from goals g join {source} p on p.site_id=g.site_id group by g.site_id, t_trees, t_shrubs)"""


FIT = "greatest(cast(0 as double), percent/cast(100 as double)-cast(0.2 as double)*(case when conditional then 1 else 0 end+case when allergen=1 then 1 else 0 end))"
CATEGORY = "case category_mark when 'plus' then cast(1 as double) when 'limited' then cast(0.5 as double) when 'minus' then cast(0 as double) else cast(0.5 as double) end"


def goals(t: Tables):
    return Q.targets(t.streets)


def plan(t: Tables):
    dim = t.species.select("species_no", "crown_mature_m", "allergen", "category_mark", "gas", "month_a", "month_b", "genus", "family", (F.col("fluff") & F.col("male_clone")).alias("conditional"))
    return t.points.join(F.broadcast(dim), "species_no")


@query("plan_targets", uses=USES, extra=GOALS, sql="select site_id, length_m, round(t_trees,3) as t_trees, round(t_shrubs,3) as t_shrubs from goals")
def plan_targets(t):
    return goals(t).select("site_id", "length_m", F.round("t_trees", 3).alias("t_trees"), F.round("t_shrubs", 3).alias("t_shrubs"))


AXIS = """c0 as (select distinct site_id, feature_id, x1, y1, x2, y2, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as len from segments where object_class='curb'),
pcs as (select site_id, (x1+(x2-x1)*(cast(k as double)/n)+x1+(x2-x1)*(cast(k+1 as double)/n))/2 as x, (y1+(y2-y1)*(cast(k as double)/n)+y1+(y2-y1)*(cast(k+1 as double)/n))/2 as y
  from (select *, unnest(range(0,n)) as k from (select *, cast(ceil(len/5.0e0) as bigint) as n from c0 where len>0))),
nd as (select site_id, cast(floor(y/25.0e0) as bigint) as r, cast(floor(x/25.0e0) as bigint) as c, sum(x)/count(*) as x, sum(y)/count(*) as y from pcs group by all),
nb as (select a.site_id, row(a.r, a.c) as a, row(b.r, b.c) as b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as step from nd a join nd b on a.site_id=b.site_id and abs(a.r-b.r)<=1 and abs(a.c-b.c)<=1 and (a.r<>b.r or a.c<>b.c)),
lb as (select 0 as n, site_id, row(r, c) as a, row(r, c) as root, true as moved from nd
  union all select lb.n+1, lb.site_id, lb.a, least(lb.root, coalesce(m.root, lb.root)), coalesce(m.root<lb.root, false)
    from lb left join (select nb.site_id, nb.a, min(l2.root) as root from nb join lb l2 on l2.site_id=nb.site_id and l2.a=nb.b group by all) m on m.site_id=lb.site_id and m.a=lb.a where exists (select 1 from lb l3 where l3.moved)),
part as (select site_id, a, root from lb where n=(select max(n) from lb)),
bf as (select 0 as n, site_id, a, root, case when a=root then 0 end as d from part
  union all select bf.n+1, bf.site_id, bf.a, bf.root, case when bf.d is not null then bf.d when m.near is not null then bf.n+1 end
    from bf left join (select nb.site_id, nb.a, min(b2.d) as near from nb join bf b2 on b2.site_id=nb.site_id and b2.a=nb.b and b2.d is not null group by all) m on m.site_id=bf.site_id and m.a=bf.a where exists (select 1 from bf b3 where b3.d is null)),
lev as (select site_id, a, root, d from bf where n=(select max(n) from bf)),
par as (select l.site_id, l.root, l.a, min(row(k.a, nb.step)) as p from lev l join nb on nb.site_id=l.site_id and nb.a=l.a join lev k on k.site_id=l.site_id and k.a=nb.b and k.d=l.d-1 group by all),
und as (select site_id, root, a, p[1] as b, p[2] as step from par union all select site_id, root, p[1], a, p[2] from par),
s1 as (select site_id, root, root as a, cast(null as struct(r bigint, c bigint)) as came, 0.0e0 as way from lev where a=root union all select s1.site_id, s1.root, u.b, s1.a, s1.way+u.step from s1 join und u on u.site_id=s1.site_id and u.a=s1.a and (s1.came is null or u.b<>s1.came)),
fa as (select site_id, root, arg_min(a, row(-way, a)) as a from s1 group by all),
s2 as (select site_id, root, a, cast(null as struct(r bigint, c bigint)) as came, 0.0e0 as way from fa union all select s2.site_id, s2.root, u.b, s2.a, s2.way+u.step from s2 join und u on u.site_id=s2.site_id and u.a=s2.a and (s2.came is null or u.b<>s2.came))"""


@query(
    "street_length", uses=("segments",), recursive=True, extra=AXIS,
    sql="select site_id, 25.0e0 as cell_m, round(sum(m),2) as length_m from (select site_id, root, max(way) as m from s2 group by all) group by site_id",
)
def street_length(t):
    """Length of the axis of the kerbs: the longest way in a tree over their cells, so a bend counts."""
    middles = split_curb(t, 5.0).select("site_id", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    return chains.axis_lengths(middles).select("site_id", "cell_m", F.round("length_m", 2).alias("length_m"))


def term(name: str, frame):
    return frame.select("site_id", F.lit(name).alias("term"), F.round("score", 6).alias("score"))


def density(t):
    return Q.half_sums(plan(t).select("site_id", "planting_type", F.lit(1.0).alias("value")), goals(t))


def fit(t):
    return Q.half_sums(plan(t).select("site_id", "planting_type", Q.fit_value().alias("value")), goals(t))


def category(t):
    return Q.half_sums(plan(t).select("site_id", "planting_type", Q.category_value().alias("value")), goals(t))


@query("term_density", uses=USES, extra=GOALS, sql=f"select site_id, round(score,5) as score from {half_sums('cast(1 as double)')}")
def term_density(t):
    return density(t).select("site_id", F.round("score", 5).alias("score"))


@query("term_fit", uses=USES, extra=GOALS, sql=f"select site_id, round(score,5) as score from {half_sums(FIT)}")
def term_fit(t):
    return fit(t).select("site_id", F.round("score", 5).alias("score"))


@query("term_category", uses=USES, extra=GOALS, sql=f"select site_id, round(score,5) as score from {half_sums(CATEGORY)}")
def term_category(t):
    return category(t).select("site_id", F.round("score", 5).alias("score"))


CREDIT = """credit as (select site_id, planting_type, species_no, n, unit, least(cast(1 as double), n/unit) as credit from
   (select p.site_id, planting_type, species_no, count(*) as n, greatest(cast(1 as double), cast(0.1 as double)*case when planting_type='tree' then t_trees else t_shrubs end) as unit
    from plan p join goals using(site_id) group by p.site_id, planting_type, species_no, t_trees, t_shrubs)),
rich as (select site_id, planting_type, sum(credit) as richness from credit group by all),
t_div as (select site_id, sum(cast(0.5 as double)*least(cast(1 as double), richness/5)) as score from rich group by all)"""


def diversity(t):
    return Q.diversity(Q.species_credit(plan(t), goals(t)))


@query("term_diversity", uses=USES, extra=f"{GOALS},\n{CREDIT}", sql="select site_id, round(score,5) as score from t_div")
def term_diversity(t):
    return diversity(t).select("site_id", F.round("score", 5).alias("score"))


ROWS = """rowm as (select *, cast(floor(y/20) as bigint) as row_no from plan where mode in ('alley','existing_row')),
rf as (select site_id, mode, planting_type, row_no, avg(x) as mx, avg(y) as my, covar_pop(x,x) as xx, covar_pop(y,y) as yy, covar_pop(x,y) as xy, count(*) as n from rowm group by all having count(*)>=2),
ro as (select r.*, round((x-mx)*cos(0.5e0*atan2(2*xy,xx-yy))+(y-my)*sin(0.5e0*atan2(2*xy,xx-yy)),6) as tt from rowm r join rf using(site_id, mode, planting_type, row_no)),
rl as (select *, sqrt((x-lag(x) over w)*(x-lag(x) over w)+(y-lag(y) over w)*(y-lag(y) over w)) as d0, lag(species_no) over w as s0,
   sqrt((x-lead(x) over w)*(x-lead(x) over w)+(y-lead(y) over w)*(y-lead(y) over w)) as d1, lead(species_no) over w as s1,
   case when planting_type='tree' then 5.0e0 else 0.3e0 end*0.95e0 as lo, case when planting_type='tree' then 6.0e0 else 1.0e0 end*1.05e0 as hi
   from ro window w as (partition by site_id, mode, planting_type, row_no order by tt, point_id)),
held as (select *, coalesce(d0 between lo and hi and s0=species_no, false) or coalesce(d1 between lo and hi and s1=species_no, false) as holds from rl)"""


def rows_frame(t):
    members = plan(t).where(F.col("mode").isin("alley", "existing_row")).withColumn("row_no", F.floor(F.col("y") / 20).cast("long"))
    held = Q.row_holders(members, ("site_id", "mode", "planting_type", "row_no"))
    values = held.select("site_id", "planting_type", F.col("holds").cast("double").alias("value"))
    empty = plan(t).select("site_id", "planting_type", F.lit(0.0).alias("value"))
    return Q.half_sums(values.unionByName(empty), goals(t))


@query(
    "term_rows", uses=USES, extra=f"{GOALS},\n{ROWS},\nallv as (select site_id, planting_type, cast(case when holds then 1 else 0 end as double) as v from held union all select site_id, planting_type, cast(0 as double) from plan)",
    sql=f"select site_id, round(score,6) as score from {half_sums('v', 'allv')}",
)
def term_rows(t):
    return rows_frame(t).select("site_id", F.round("score", 6).alias("score"))


TIERS = """tshr as (select * from plan where planting_type='shrub'),
tcov as (select t.site_id, t.point_id from plan t where planting_type='tree' and exists (select 1 from tshr s where s.site_id=t.site_id and s.x between t.x-t.crown_mature_m/2 and t.x+t.crown_mature_m/2 and s.y between t.y-t.crown_mature_m/2 and t.y+t.crown_mature_m/2
    and sqrt((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)) <= t.crown_mature_m/2)),
ecov as (select e.site_id, e.stem_id from stems e where exists (select 1 from tshr s where s.site_id=e.site_id and s.x between e.x-e.crown_m/2 and e.x+e.crown_m/2 and s.y between e.y-e.crown_m/2 and e.y+e.crown_m/2
    and sqrt((s.x-e.x)*(s.x-e.x)+(s.y-e.y)*(s.y-e.y)) <= e.crown_m/2)),
t_tiers as (select g.site_id, least(cast(1 as double), (coalesce(a.n,0)+coalesce(b.n,0))/t_trees) as score, coalesce(a.n,0) as covered, coalesce(b.n,0) as existing
   from goals g left join (select site_id, count(*) as n from tcov group by all) a using(site_id) left join (select site_id, count(*) as n from ecov group by all) b using(site_id))"""


def covered_crowns(crowns, shrubs, id_col: str):
    """Crowns (x, y, radius) with a shrub under them: an existence test, not a list of pairs.

    A crown is laid on the cells that its own radius reaches.
    """
    discs = spatial.as_segments(crowns.select("site_id", id_col, "x", "y", "radius"))
    pairs = spatial.near_segments(shrubs.select("site_id", "x", "y"), discs, 0.0, cell=8.0, spread=("x", "y"), reserve=F.col("radius"))
    return pairs.select("site_id", id_col).distinct()


def tiers(t):
    shrubs = plan(t).where(F.col("planting_type") == "shrub")
    trees = plan(t).where(F.col("planting_type") == "tree").select("site_id", "point_id", "x", "y", (F.col("crown_mature_m") / 2).alias("radius"))
    stems = t.stems.select("site_id", "stem_id", "x", "y", (F.col("crown_m") / 2).alias("radius"))
    new = covered_crowns(trees, shrubs, "point_id").groupBy("site_id").agg(F.count(F.lit(1)).alias("covered"))
    old = covered_crowns(stems, shrubs, "stem_id").groupBy("site_id").agg(F.count(F.lit(1)).alias("existing"))
    rows = goals(t).join(new, "site_id", "left").join(old, "site_id", "left").fillna(0, ["covered", "existing"])
    return rows.withColumn("score", F.least(F.lit(1.0), (F.col("covered") + F.col("existing")) / F.col("t_trees")))


@query("term_tiers", uses=(*USES, "stems"), extra=f"{GOALS},\n{TIERS}", sql="select site_id, covered, existing, round(score,6) as score from t_tiers")
def term_tiers(t):
    return tiers(t).select("site_id", "covered", "existing", F.round("score", 6).alias("score"))


CELLS = """crowns as (select site_id, x, y, crown_mature_m/2 as radius from plan where planting_type='tree' union all select site_id, x, y, crown_m/2 from stems),
cc as (select distinct site_id, cx, cy from (select c.*, unnest(range(cast(floor((x-radius)/2) as bigint), cast(floor((x+radius)/2) as bigint)+1)) as cx from crowns c) a,
    lateral (select unnest(range(cast(floor((y-radius)/2) as bigint), cast(floor((y+radius)/2) as bigint)+1)) as cy) b join sites r using(site_id)
   where sqrt(((cx+0.5e0)*2-x)*((cx+0.5e0)*2-x)+((cy+0.5e0)*2-y)*((cy+0.5e0)*2-y))<=radius and (cx+0.5e0)*2 between r.x0 and r.x1 and (cy+0.5e0)*2 between r.y0 and r.y1),
t_canopy as (select g.site_id, n*4.0e0 as area_m2, least(cast(1 as double), n*4.0e0/(0.75e0*t_trees*3.141592653589793e0*16.0e0)) as score from goals g join (select site_id, count(*) as n from cc group by all) using(site_id))"""


def bounds(t):
    return t.sites.select("site_id", "x0", F.col("x1").alias("x1"), "y0", "y1")


def canopy(t):
    trees = plan(t).where(F.col("planting_type") == "tree").select("site_id", "x", "y", (F.col("crown_mature_m") / 2).alias("radius"))
    stems = t.stems.select("site_id", "x", "y", (F.col("crown_m") / 2).alias("radius"))
    area = Q.covered_area(trees.unionByName(stems), 2.0, bounds=bounds(t))
    goal = Q.CANOPY_TARGET * F.col("t_trees") * Q.PI * (Q.CANOPY_CROWN_M / 2) ** 2
    return goals(t).join(area, "site_id").withColumn("score", F.least(F.lit(1.0), F.col("area_m2") / goal))


@query("term_canopy", uses=(*USES, "stems", "sites"), extra=f"{GOALS},\n{CELLS.replace(') b join sites r using(site_id)', ') b join sites r on r.site_id=a.site_id').replace('select distinct site_id, cx, cy from (', 'select distinct a.site_id, cx, cy from (')}", sql="select site_id, area_m2, round(score,6) as score from t_canopy")
def term_canopy(t):
    """Crown area of the plan and the stock against three quarters of the crowns asked for (2 m raster)."""
    return canopy(t).select("site_id", "area_m2", F.round("score", 6).alias("score"))


DUST = f"""cover as (select site_id, point_id, x, y, case when planting_type='shrub' then greatest(crown_mature_m/2, 2.0e0) else crown_mature_m/2 end as radius,
   case when planting_type='shrub' then 1.0e0 else 0.5e0 end*(gas/2.0e0) as weight from plan),
curb as (select * from segments s where object_class='curb'),
iv0 as (select s.site_id, s.feature_id, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as len, p.radius, p.weight,
    ((p.x-x1)*(x2-x1)+(p.y-y1)*(y2-y1))/sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as al, ((p.x-x1)*(y2-y1)-(p.y-y1)*(x2-x1))/sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as off
   from cover p join curb s on s.site_id=p.site_id and p.x between least(x1,x2)-p.radius and greatest(x1,x2)+p.radius and p.y between least(y1,y2)-p.radius and greatest(y1,y2)+p.radius where {S.seg_dist()} < p.radius),
iv as (select *, greatest(0.0e0, al-sqrt(greatest(0.0e0, radius*radius-off*off))) as a, least(len, al+sqrt(greatest(0.0e0, radius*radius-off*off))) as b from iv0),
bp as (select distinct site_id, feature_id, v from (select site_id, feature_id, a as v from iv union all select site_id, feature_id, b from iv)),
sp as (select site_id, feature_id, v as a, lead(v) over (partition by feature_id order by v) as b from bp),
best as (select sp.site_id, sp.feature_id, sp.a, sp.b, max(weight) as w from sp join iv on iv.feature_id=sp.feature_id and iv.a<=sp.a and iv.b>=sp.b group by all),
clen as (select site_id, sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) as curb_m from curb group by all),
t_dust as (select c.site_id, curb_m, coalesce(m,0) as weighted_m, least(cast(1 as double), coalesce(m,0)/curb_m/0.5e0) as score from clen c left join (select site_id, sum((b-a)*w) as m from best group by all) using(site_id))"""


def dust(t):
    shrub = F.col("planting_type") == "shrub"
    radius = F.when(shrub, F.greatest(F.col("crown_mature_m") / 2, F.lit(Q.DUST_STRIP_M))).otherwise(F.col("crown_mature_m") / 2)
    weight = F.when(shrub, 1.0).otherwise(Q.DUST_CROWN_FACTOR) * (F.col("gas") / 2.0)
    cover = plan(t).select("site_id", "point_id", "x", "y", radius.alias("radius"), weight.alias("weight"))
    curb = t.segments.where(F.col("object_class") == "curb").select("site_id", "feature_id", "ring_id", "seg_no", "x1", "y1", "x2", "y2")
    total = curb.groupBy("site_id").agg(F.sum(geom.segment_length()).alias("curb_m"))
    intervals = Q.cover_intervals(curb, cover)
    rows = total.join(Q.weighted_cover(intervals), "site_id", "left").fillna(0.0, ["weighted_m"])
    return rows.withColumn("score", F.least(F.lit(1.0), F.col("weighted_m") / F.col("curb_m") / Q.DUST_TARGET))


@query("term_dust", uses=(*USES, "segments"), extra=f"{GOALS},\n{DUST}", sql="select site_id, round(curb_m,2) as curb_m, round(weighted_m,3) as weighted_m, round(score,6) as score from t_dust")
def term_dust(t):
    return dust(t).select("site_id", F.round("curb_m", 2).alias("curb_m"), F.round("weighted_m", 3).alias("weighted_m"), F.round("score", 6).alias("score"))


MARGIN = f"""slack as (select site_id, point_id, planting_type, round(min(case when measured_m is not null and outcome<>'no_data' and threshold_m>0 and {S.util()} then measured_m-threshold_m end),3) as slack_m from chk group by all),
mval as (select site_id, planting_type, case when slack_m is null then cast(1 as double) else least(cast(1 as double), greatest(cast(0 as double), slack_m/0.5e0)) end as v from slack)"""


def margin(t):
    slack = R.slack_to_network(shared.facts(t, reach=shared.norm_reach(Q.MARGIN_TARGET_M + 0.1)), key=("site_id", "point_id", "planting_type"))
    return Q.half_sums(slack.select("site_id", "planting_type", Q.margin_value().alias("value")), goals(t))


@query("term_margin", uses=(*S.FACTS_USES, "species", "streets"), extra=f"{GOALS},\n{S.FACTS},\n{MARGIN}", sql=f"select site_id, round(score,5) as score from {half_sums('v', 'mval')}")
def term_margin(t):
    return margin(t).select("site_id", F.round("score", 5).alias("score"))


def season(t):
    months = plan(t).select("site_id", F.explode(F.array("month_a", "month_b")).alias("month"))
    return months.groupBy("site_id").agg(F.countDistinct("month").alias("months")).withColumn("score", F.col("months") / 12.0)


T_SEASON = "t_season as (select site_id, count(distinct m)/12.0e0 as score, count(distinct m) as months from (select site_id, month_a as m from plan union all select site_id, month_b from plan) group by all)"


@query("term_season", uses=USES, extra=f"{GOALS},\n{T_SEASON}", sql="select site_id, months, round(score,6) as score from t_season")
def term_season(t):
    return season(t).select("site_id", "months", F.round("score", 6).alias("score"))


LOST = """lostp as (select site_id, 0.05e0*(count(*) filter (status='P'))/count(*) as penalty, count(*) filter (status='P') as lost, count(*) filter (status<>'P') as planted from points group by all)"""


def lost(t):
    """Places that pass the norms and stayed empty (status P of the fixture)."""
    rows = t.points.groupBy("site_id").agg(F.count_if(F.col("status") == "P").alias("lost"), F.count_if(F.col("status") != "P").alias("planted"))
    return rows.withColumn("penalty", F.lit(Q.LOST_WEIGHT) * F.col("lost") / (F.col("planted") + F.col("lost")))


@query("lost_place_penalty", uses=("points",), extra=LOST, sql="select site_id, lost, planted, round(penalty,6) as penalty from lostp")
def lost_place_penalty(t):
    return lost(t).select("site_id", "lost", "planted", F.round("penalty", 6).alias("penalty"))


SIMPLE_TERMS = f"""{GOALS},
{CREDIT},
{T_SEASON},
{ROWS},
allv as (select site_id, planting_type, cast(case when holds then 1 else 0 end as double) as v from held union all select site_id, planting_type, cast(0 as double) from plan),
{TIERS},
{CELLS.replace(') b join sites r using(site_id)', ') b join sites r on r.site_id=a.site_id').replace('select distinct site_id, cx, cy from (', 'select distinct a.site_id, cx, cy from (')},
{DUST},
terms as (select site_id, 'density' as term, round(score,6) as score from {half_sums('cast(1 as double)')} union all select site_id, 'fit', round(score,6) from {half_sums(FIT)}
  union all select site_id, 'category', round(score,6) from {half_sums(CATEGORY)} union all select site_id, 'diversity', round(score,6) from t_div
  union all select site_id, 'season', round(score,6) from t_season union all select site_id, 'rows', round(score,6) from {half_sums('v', 'allv')}
  union all select site_id, 'tiers', round(score,6) from t_tiers union all select site_id, 'canopy', round(score,6) from t_canopy union all select site_id, 'dust', round(score,6) from t_dust
  union all select site_id, 'margin', cast(null as double) from goals)"""
INDEX_USES = (*USES, "stems", "sites", "segments")


def terms(t, *, with_margin: bool = False):
    frames = {"density": density, "fit": fit, "category": category, "diversity": diversity, "season": season, "rows": rows_frame, "tiers": tiers, "canopy": canopy, "dust": dust}
    out = None
    for name, build in frames.items():
        frame = term(name, build(t))
        out = frame if out is None else out.unionByName(frame)
    last = term("margin", margin(t)) if with_margin else goals(t).select("site_id", F.lit("margin").alias("term"), F.lit(None).cast("double").alias("score"))
    return out.unionByName(last)


def weights(t):
    return t.spark.createDataFrame([(name, 0.1) for name in Q.TERMS], "term string, weight double")


@query(
    "quality_index", uses=tuple(dict.fromkeys((*INDEX_USES, *S.FACTS_USES))), extra=f"{SIMPLE_TERMS},\n{S.FACTS},\n{MARGIN},\n{LOST}",
    sql=f"""select site_id, count(*) as n_terms, round(least(cast(1 as double), greatest(cast(0 as double), avg(score)-penalty)),4) as quality
       from (select * from terms union all select site_id, 'margin', round(score,6) from {half_sums('v', 'mval')}) join lostp using(site_id) where score is not null group by site_id, penalty""",
)
def quality_index(t):
    """Index over all ten terms; the weight of an undefined term goes to the others."""
    out = Q.index(terms(t, with_margin=True), weights(t), lost(t).select("site_id", "penalty"))
    return out.select("site_id", "n_terms", F.round("index", 4).alias("quality"))


LOO = f"""cr as (select p.point_id, p.site_id, p.planting_type, t_trees, t_shrubs, {FIT} as fitv, {CATEGORY} as catv, c.n, c.unit, c.credit, r.richness
   from plan p join goals using(site_id) join credit c on c.site_id=p.site_id and c.planting_type=p.planting_type and c.species_no=p.species_no
   join rich r on r.site_id=p.site_id and r.planting_type=p.planting_type),
gs as (select site_id, planting_type, count(*)*1.0e0 as ones, sum({FIT}) as fits, sum({CATEGORY}) as cats from plan group by all),
loo as (select cr.site_id, cr.point_id,
   0.5e0*(least(1.0e0, ones/goal)-least(1.0e0,(ones-1)/goal)) as d_density, 0.5e0*(least(1.0e0, fits/goal)-least(1.0e0,(fits-fitv)/goal)) as d_fit,
   0.5e0*(least(1.0e0, cats/goal)-least(1.0e0,(cats-catv)/goal)) as d_category,
   0.5e0*(least(1.0e0, richness/5)-least(1.0e0,(richness-(credit-least(1.0e0,(n-1)/unit)))/5)) as d_diversity
  from (select *, case when planting_type='tree' then t_trees else t_shrubs end as goal from cr) cr join gs using(site_id, planting_type))"""


REMOVALS = """alone as (select site_id, point_id, count(*)/12.0e0 as d_season from (select site_id, m, count(*) as n, min(point_id) as point_id from
    (select site_id, point_id, month_a as m from plan union all select site_id, point_id, month_b from plan) group by site_id, m) where n=1 group by site_id, point_id),
owing as (select site_id, point_id, percent, case when conditional then 1 else 0 end+case when allergen=1 then 1 else 0 end as owed, count(*) over (partition by site_id) as n from plan),
removal as (select l.site_id, l.point_id, round(0.1e0*(d_density+d_fit+d_category+d_diversity+coalesce(d_season,0.0e0))-case when owed>0 and percent<20 then 0.5e0*owed/n else 0.0e0 end,8) as delta
   from loo l join owing o on o.site_id=l.site_id and o.point_id=l.point_id left join alone a on a.site_id=l.site_id and a.point_id=l.point_id)"""


@query(
    "index_reserve", uses=tuple(dict.fromkeys((*INDEX_USES, *S.FACTS_USES))), extra=f"{SIMPLE_TERMS},\n{S.FACTS},\n{MARGIN},\n{LOO},\n{REMOVALS}",
    sql=f"""with every as (select * from terms where term<>'margin' union all select site_id, 'margin', round(score,6) from {half_sums('v', 'mval')}),
       harm as (select site_id, count(*) filter (delta < -1e-9) as harmful from removal group by all)
       select site_id, term, round(gain,5) as gain, coalesce(harmful,0) as harmful from (select site_id, term, (1-score)/count(*) over (partition by site_id) as gain,
       row_number() over (partition by site_id order by round((1-score)/10.0e0,9) desc, term) as rn from every where score is not null) left join harm using(site_id) where rn<=2""",
)
def index_reserve(t):
    """The two of all ten terms with most to gain, and how many plantings lower the index by standing there."""
    defined = terms(t, with_margin=True).where(F.col("score").isNotNull()).join(F.broadcast(weights(t)), "term")
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("site_id"))
    gains = defined.withColumn("gain", F.round(share * (1 - F.col("score")), 9))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("gain"), "term"))
    harm = removal_changes(t).where("delta < -1e-9").groupBy("site_id").agg(F.count(F.lit(1)).alias("harmful"))
    best = gains.withColumn("rn", rank).where("rn <= 2").join(harm, "site_id", "left")
    return best.select("site_id", "term", F.round("gain", 5).alias("gain"), F.coalesce("harmful", F.lit(0)).alias("harmful"))


def leave_one_out(t):
    """What each planting adds to the additive terms, without evaluating the plan N times."""
    goal = F.when(F.col("planting_type") == "tree", F.col("t_trees")).otherwise(F.col("t_shrubs"))
    credits = Q.species_credit(plan(t), goals(t)).select("site_id", "planting_type", "species_no", "n", "unit", "credit")
    richness = credits.groupBy("site_id", "planting_type").agg(F.sum("credit").alias("richness"))
    valued = plan(t).withColumn("fitv", Q.fit_value()).withColumn("catv", Q.category_value())
    sums = valued.groupBy("site_id", "planting_type").agg(F.count(F.lit(1)).cast("double").alias("ones"), F.sum("fitv").alias("fits"), F.sum("catv").alias("cats"))
    rows = (
        valued.join(goals(t), "site_id").join(credits, ["site_id", "planting_type", "species_no"])
        .join(richness, ["site_id", "planting_type"]).join(sums, ["site_id", "planting_type"]).withColumn("goal", goal)
    )

    def saturated(total, own):
        return 0.5 * (F.least(F.lit(1.0), total / F.col("goal")) - F.least(F.lit(1.0), (total - own) / F.col("goal")))

    drop = F.col("credit") - F.least(F.lit(1.0), (F.col("n") - 1) / F.col("unit"))
    return rows.select(
        "site_id", "point_id", saturated(F.col("ones"), F.lit(1.0)).alias("d_density"), saturated(F.col("fits"), F.col("fitv")).alias("d_fit"),
        saturated(F.col("cats"), F.col("catv")).alias("d_category"),
        (0.5 * (F.least(F.lit(1.0), F.col("richness") / 5) - F.least(F.lit(1.0), (F.col("richness") - drop) / 5))).alias("d_diversity"),
    )


def removal_changes(t):
    """What each planting adds to the index: the additive terms, the season term (a planting that alone holds a month) and the price of an obligation."""
    values = leave_one_out(t)
    owed = plan(t).select("site_id", "point_id", (F.when(F.col("conditional"), 1).otherwise(0) + F.when(F.col("allergen") == 1, 1).otherwise(0)).alias("owed"), "percent")
    months = plan(t).select("site_id", "point_id", F.explode(F.array("month_a", "month_b")).alias("month"))
    sole = months.groupBy("site_id", "month").agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("point_id")).where("n = 1").groupBy("site_id", "point_id").agg((F.count(F.lit(1)) / 12.0).alias("d_season"))
    rows = values.join(owed, ["site_id", "point_id"]).join(sole, ["site_id", "point_id"], "left").fillna(0.0, ["d_season"])
    n = t.points.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    price = F.when((F.col("owed") > 0) & (F.col("percent") < 20), 0.5 * F.col("owed") / F.col("n")).otherwise(0.0)
    delta = 0.1 * (F.col("d_density") + F.col("d_fit") + F.col("d_category") + F.col("d_diversity") + F.col("d_season")) - price
    return rows.join(n, "site_id").withColumn("delta", F.round(delta, 8))


@query(
    "planting_value", uses=USES, extra=f"{GOALS},\n{CREDIT},\n{LOO}",
    sql="""select site_id, point_id, round(d_density,7) as d_density, round(d_fit,7) as d_fit, round(d_category,7) as d_category, round(d_diversity,7) as d_diversity,
        round(0.1e0*(d_density+d_fit+d_category+d_diversity),7) as delta from loo""",
)
def planting_value(t):
    rows = leave_one_out(t)
    total = 0.1 * (F.col("d_density") + F.col("d_fit") + F.col("d_category") + F.col("d_diversity"))
    return rows.select("site_id", "point_id", *[F.round(c, 7).alias(c) for c in ("d_density", "d_fit", "d_category", "d_diversity")], F.round(total, 7).alias("delta"))


@query(
    "largest_remainder", uses=("points",),
    sql="""with v as (select site_id, mode, count(*)/cast(7 as double)/1000 as value from points group by all),
      b as (select *, cast(floor(round(value*1000,6)) as bigint) as fl, round(round(value*1000,6)-floor(round(value*1000,6)),6) as rest, cast(round(round(sum(value) over (partition by site_id)*1000,6),0) as bigint) as tot from v),
      c as (select *, tot-cast(sum(fl) over (partition by site_id) as bigint) as missing, row_number() over (partition by site_id order by rest desc, mode) as rn from b)
      select site_id, mode, round(value,6) as value, fl+case when rn<=missing then 1 else 0 end as thousandths from c""",
)
def largest_remainder(t):
    parts = t.points.groupBy("site_id", "mode").agg((F.count(F.lit(1)) / 7.0 / 1000).alias("value"))
    return Q.largest_remainder(parts, ("site_id",), name="mode").select("site_id", "mode", F.round("value", 6).alias("value"), "thousandths")


@query(
    "panel_judgment_aggregate", uses=(),
    sql="""with j as (select l_partkey%4 as i, l_suppkey%4 as j, least(9.0e0, 1+floor(l_quantity/6)) as v from lineitem),
      u as (select least(i,j) as i, greatest(i,j) as j, case when i<j then v else 1/v end as v from j where i<>j)
      select i, j, count(*) as judgments, round(exp(avg(ln(v))),4) as merged, round(1/exp(avg(ln(v))),4) as reciprocal, count(*) filter (v<1/9.0e0-1e-9 or v>9) as off_scale from u group by all""",
)
def panel_judgment_aggregate(t):
    """Pairwise judgments of experts merged per matrix cell by the geometric mean."""
    raw = t.lineitem.select((F.col("l_partkey") % 4).alias("i"), (F.col("l_suppkey") % 4).alias("j"), F.least(F.lit(9.0), 1 + F.floor(F.col("l_quantity") / 6)).alias("v"))
    upper = raw.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(F.col("i") < F.col("j"), F.col("v")).otherwise(1 / F.col("v")).alias("v"))
    merged = F.exp(F.avg(F.ln("v")))
    return upper.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("judgments"), F.round(merged, 4).alias("merged"), F.round(1 / merged, 4).alias("reciprocal"),
        F.count_if((F.col("v") < 1 / 9 - 1e-9) | (F.col("v") > 9)).alias("off_scale"),
    )


PLANS = """pl as (select site_id*10+case mode when 'existing_row' then 0 when 'alley' then 1 when 'lawn' then 2 when 'groups' then 3 else 4 end as plan_id,
   avg(percent)/100 as s0, count(*) filter (planting_type='tree')/cast(count(*) as double) as s1, count(distinct species_no)/58.0e0 as s2, count(*) filter (status='F')/cast(count(*) as double) as s3 from points group by all),
pt as (select plan_id, 0 as k, round(s0,6) as s from pl union all select plan_id, 1, round(s1,6) from pl union all select plan_id, 2, round(s2,6) from pl union all select plan_id, 3, round(s3,6) from pl)"""


@query(
    "weight_robustness", uses=("points",), extra=PLANS,
    sql="""with d as (select range as draw from range(0,200)),
      w as (select draw, plan_id, round(sum(s*(case when k=draw%5 then 0.0e0 else 0.5e0+((draw*7919+k*104729)%1000)/1000.0e0 end))/sum(case when k=draw%5 then 0.0e0 else 0.5e0+((draw*7919+k*104729)%1000)/1000.0e0 end),9) as idx from pt, d group by all),
      r as (select draw, plan_id, row_number() over (partition by draw order by idx desc, plan_id) as place from w),
      b as (select plan_id, row_number() over (order by round(avg(s),9) desc, plan_id) as base from pt group by plan_id)
      select plan_id, base, quantile_cont(place,0.05) as low, quantile_cont(place,0.5) as mid, quantile_cont(place,0.95) as high, round(avg(abs(place-base)),4) as mean_shift from r join b using(plan_id) group by all""",
)
def weight_robustness(t):
    """Rank bands of plans under drawn weights: every draw jitters the weights and may drop a term.

    Draws are generated next to each plan (no product of tables); the random number is a hash of
    (draw, term), so a re-run or a lost executor gives the same bands.
    """
    mode_no = F.when(F.col("mode") == "existing_row", 0).when(F.col("mode") == "alley", 1).when(F.col("mode") == "lawn", 2).when(F.col("mode") == "groups", 3).otherwise(4)
    plans = t.points.groupBy((F.col("site_id") * 10 + mode_no).alias("plan_id")).agg(
        (F.avg("percent") / 100).alias("s0"), (F.count_if(F.col("planting_type") == "tree") / F.count(F.lit(1))).alias("s1"),
        (F.countDistinct("species_no") / 58.0).alias("s2"), (F.count_if(F.col("status") == "F") / F.count(F.lit(1))).alias("s3"),
    )
    scores = plans.select("plan_id", F.posexplode(F.array(*[F.round(f"s{i}", 6) for i in range(4)])).alias("k", "s"))
    means = scores.groupBy("plan_id").agg((-F.round(F.avg("s"), 9)).alias("minus"))
    based = scan.prefix_sum(means, F.lit(1), by=(), order=("minus", "plan_id"), name="base").select("plan_id", "base")
    drawn = scores.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(199))))
    jitter = 0.5 + ((F.col("draw") * 7919 + F.col("k") * 104729) % 1000) / 1000.0
    weight = F.when(F.col("k") == F.col("draw") % 5, 0.0).otherwise(jitter)
    idx = drawn.groupBy("draw", "plan_id").agg((-F.round(F.sum(F.col("s") * weight) / F.sum(weight), 9)).alias("minus"))
    placed = scan.prefix_sum(idx, F.lit(1), by=("draw",), order=("minus", "plan_id"), name="place")
    return placed.join(based, "plan_id").groupBy("plan_id", "base").agg(
        F.percentile("place", F.lit(0.05)).alias("low"), F.percentile("place", F.lit(0.5)).alias("mid"), F.percentile("place", F.lit(0.95)).alias("high"),
        F.round(F.avg(F.abs(F.col("place") - F.col("base"))), 4).alias("mean_shift"),
    )


@query(
    "weight_calibration_rows", uses=("points",), extra=PLANS,
    sql="""select a.plan_id as accepted, b.plan_id as variant, round(sum(a.s-b.s),6) as gain, round(greatest(cast(0 as double), -sum(0.25e0*(a.s-b.s))),6) as loss
       from pt a join pt b on cast(floor(a.plan_id/10) as bigint)=cast(floor(b.plan_id/10) as bigint) and a.plan_id%10=0 and b.plan_id%10<>0 and a.k=b.k group by all""",
)
def weight_calibration_rows(t):
    """Difference of the accepted plan of a street and each variant, and its loss under the weights."""
    mode_no = F.when(F.col("mode") == "existing_row", 0).when(F.col("mode") == "alley", 1).when(F.col("mode") == "lawn", 2).when(F.col("mode") == "groups", 3).otherwise(4)
    plans = t.points.groupBy((F.col("site_id") * 10 + mode_no).alias("plan_id")).agg(
        (F.avg("percent") / 100).alias("s0"), (F.count_if(F.col("planting_type") == "tree") / F.count(F.lit(1))).alias("s1"),
        (F.countDistinct("species_no") / 58.0).alias("s2"), (F.count_if(F.col("status") == "F") / F.count(F.lit(1))).alias("s3"),
    )
    long = plans.select(F.floor(F.col("plan_id") / 10).alias("street"), "plan_id", F.posexplode(F.array(*[F.round(f"s{i}", 6) for i in range(4)])).alias("k", "s"))
    accepted = long.where(F.col("plan_id") % 10 == 0).select("street", "k", F.col("plan_id").alias("accepted"), F.col("s").alias("sa"))
    variants = long.where(F.col("plan_id") % 10 != 0).select("street", "k", F.col("plan_id").alias("variant"), F.col("s").alias("sv"))
    diff = F.col("sa") - F.col("sv")
    return accepted.join(variants, ["street", "k"]).groupBy("accepted", "variant").agg(
        F.round(F.sum(diff), 6).alias("gain"), F.round(F.greatest(F.lit(0.0), -F.sum(0.25 * diff)), 6).alias("loss")
    )


@query(
    "curb_segments", uses=("segments",),
    sql="""with c as (select distinct site_id, feature_id, x1, y1, x2, y2, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as len from segments where object_class='curb')
      select site_id, feature_id, k, round(x1+(x2-x1)*(cast(k as double)/n),3) as x1, round(y1+(y2-y1)*(cast(k as double)/n),3) as y1, round(len/n,3) as len_m
      from (select *, unnest(range(0, n)) as k from (select *, cast(ceil(len/5) as bigint) as n from c where len>0))""",
)
def curb_segments(t):
    """Unique kerb segments split into pieces not longer than 5 m; zero lengths dropped."""
    return split_curb(t, 5.0).select("site_id", "feature_id", F.col("k").cast("long").alias("k"), F.round("ax", 3).alias("x1"), F.round("ay", 3).alias("y1"), F.round("piece_m", 3).alias("len_m"))


def split_curb(t, step: float, classes=("curb",)):
    curb = t.segments.where(F.col("object_class").isin(*classes)).select("site_id", "feature_id", "x1", "y1", "x2", "y2").distinct().withColumn("len", geom.segment_length()).where("len > 0")
    n = F.ceil(F.col("len") / step).cast("int")
    pieces = curb.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    a, b = F.col("k").cast("double") / F.col("n"), (F.col("k") + 1).cast("double") / F.col("n")
    return pieces.select(
        "site_id", "feature_id", "k", (F.col("x1") + (F.col("x2") - F.col("x1")) * a).alias("ax"), (F.col("y1") + (F.col("y2") - F.col("y1")) * a).alias("ay"),
        (F.col("x1") + (F.col("x2") - F.col("x1")) * b).alias("bx"), (F.col("y1") + (F.col("y2") - F.col("y1")) * b).alias("by"), (F.col("len") / F.col("n")).alias("piece_m"),
    )
