"""Candidate generation and selection on the canonical tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from streetgrove.functions import geom, likeness, rulebook
from streetgrove.operators import graph, scan, selection as C, spatial
from streetgrove.operators import rules as R
from streetgrove.plans import checksql as S
from streetgrove.plans import shared
from streetgrove.plans.queries.rules import FOOTPRINT, PLANTABLE, footprint
from streetgrove.plans.registry import Tables, query

# The drawn status of a planting stands for its verdict where the rule engine is not the subject.
VERDICT = "case status when 'F' then 'allowed' when 'O' then 'needs_approval' else 'forbidden' end"
CAND = f"""cand as (select *, {VERDICT} as verdict, percent%2=0 as needs_barrier,
   case mode when 'existing_row' then 0 when 'alley' then 1 when 'lawn' then 2 when 'groups' then 3 else 4 end as m from points),
ranked as (select *, case verdict when 'allowed' then cast(needs_barrier as int) when 'needs_approval' then 2+cast(needs_barrier as int) end as r from cand),
elig as (select *, row_number() over (order by m, station, r, opt, point_id) as ord,
   1+case when verdict='allowed' then 8 else 0 end+case when needs_barrier then 0 else 4 end+case when mode='existing_row' then 3 else 0 end+case when mode='alley' then 2 else 0 end as w from ranked where r is not null)"""


def walk(order: str, gap: str, near: str, source="elig") -> str:
    """Sequential thinning by rounds in recursive SQL: undecided 0, kept 1, dropped 2."""
    return f"""seqd as (select *, row_number() over (order by {order}) as pos from {source}),
edges as (select b.point_id as id, a.point_id as other from seqd a join seqd b on a.site_id=b.site_id and a.pos<b.pos and
     ((abs(a.x-b.x)<={gap} and abs(a.y-b.y)<={gap} and {S.dist()} < {gap}) {near})),
st as (select 0 as n, point_id as id, 0 as status from seqd
  union all
  select st.n+1, st.id, case when st.status<>0 then st.status when coalesce(h.kept,0)>0 then 2 when coalesce(h.open,0)=0 then 1 else 0 end
  from st left join (select e.id, count(*) filter (s2.status=1) as kept, count(*) filter (s2.status=0) as open from edges e join st s2 on s2.id=e.other group by e.id) h on h.id=st.id
  where exists (select 1 from st s3 where s3.status=0)),
chosen as (select id as point_id from st where n=(select max(n) from st) and status=1)"""


SAME_STOP = "or (a.m=b.m and a.station=b.station)"


def candidates(t: Tables):
    verdict = F.when(F.col("status") == "F", "allowed").when(F.col("status") == "O", "needs_approval").otherwise("forbidden")
    return t.points.select("site_id", "point_id", "x", "y", "mode", "station", "opt", verdict.alias("verdict"), (F.col("percent") % 2 == 0).alias("needs_barrier"))


def eligible(t: Tables):
    rows = candidates(t).withColumn("m", C.mode_rank()).withColumn("r", C.option_rank()).where(F.col("r").isNotNull())
    return rows.withColumn("stop", F.concat_ws(":", "m", "station")).withColumn("w", C.preference())


@query("stable_id", uses=("points",), sql="""select point_id, 'p-'||substring(sha256('p:'||planting_type||':'||printf('%.2f', floor((cast(round(x*1000) as bigint)+5)/10)/100.0e0)||':'||printf('%.2f', floor((cast(round(y*1000) as bigint)+5)/10)/100.0e0)),1,12) as stable_id from points""")
def stable_id(t):
    return t.points.select("point_id", C.stable_id("p", F.col("planting_type"), F.col("x"), F.col("y")).alias("stable_id"))


@query(
    "conflict_pairs", uses=("points",), extra=CAND,
    sql=f"""select a.site_id, a.point_id as a, b.point_id as b from elig a join elig b on a.site_id=b.site_id and a.point_id<b.point_id
      and ((abs(a.x-b.x)<=25 and abs(a.y-b.y)<=25 and {S.dist()}<25) or (a.m=b.m and a.station=b.station))""",
)
def conflict_pairs(t):
    """Places nearer than the gap, 25 m here as the fixture's plantings are far apart, and options of one station."""
    return C.conflicts(eligible(t), 25.0)


@query("greedy_select", uses=("points",), recursive=True, extra=f"{CAND},\n{walk('ord', '5.0e0', SAME_STOP)}", sql="select site_id, point_id from elig join chosen using(point_id)")
def greedy_select(t):
    return C.greedy(candidates(t), 5.0).select("site_id", "point_id")


@query(
    "weighted_select", uses=("points",), recursive=True, extra=f"{CAND},\n{walk('w desc, ord', '5.0e0', SAME_STOP)}",
    sql="""with b as (select site_id, cast(sum(best) as bigint) as bound from (select site_id, m, station, max(w) as best from elig group by all) group by all)
       select site_id, count(*) as places, cast(sum(w) as bigint) as objective, bound, round((bound-sum(w))/cast(sum(w) as double),5) as gap from elig join chosen using(point_id) join b using(site_id) group by site_id, bound""",
)
def weighted_select(t):
    """Places by preference, with the value reached and the bound that no selection can exceed.

    A feasible result with a stated gap; no claim that it is the optimum.
    """
    rows = eligible(t).withColumn("minus", -F.col("w"))
    kept = graph.first_spaced_points(rows, 5.0, order=("minus", "m", "station", "r", "opt", "point_id"), group="stop")
    reached = rows.join(kept, ["site_id", "point_id"], "left_semi").groupBy("site_id").agg(F.count(F.lit(1)).alias("places"), F.sum("w").cast("long").alias("objective"))
    bound = rows.groupBy("site_id", "stop").agg(F.max("w").alias("best")).groupBy("site_id").agg(F.sum("best").cast("long").alias("bound"))
    return reached.join(bound, "site_id").withColumn("gap", F.round((F.col("bound") - F.col("objective")) / F.col("objective"), 5))


@query(
    "selection_upper_bound", uses=("points",), extra=CAND,
    sql="select site_id, cast(sum(best) as bigint) as bound, count(*) as stations from (select site_id, m, station, max(w) as best from elig group by all) group by all",
)
def selection_upper_bound(t):
    best = eligible(t).groupBy("site_id", "stop").agg(F.max("w").alias("best"))
    return best.groupBy("site_id").agg(F.sum("best").cast("long").alias("bound"), F.count(F.lit(1)).alias("stations"))


@query(
    "selection_feasible", uses=("points",), extra=CAND,
    sql=f"""with near as (select a.site_id, count(*) as n from elig a join elig b on a.site_id=b.site_id and a.point_id<b.point_id and abs(a.x-b.x)<=5 and abs(a.y-b.y)<=5 where {S.dist()}<5 group by all),
       dup as (select site_id, count(*) as n from (select site_id, m, station from elig group by all having count(*)>1) group by all)
       select e.site_id, count(*) as selected, coalesce(max(near.n),0) as too_near, coalesce(max(dup.n),0) as shared_stations, coalesce(max(near.n),0)+coalesce(max(dup.n),0)=0 as feasible
       from elig e left join near using(site_id) left join dup using(site_id) group by e.site_id""",
)
def selection_feasible(t):
    """Independent recheck of a selection from coordinates: here of all eligible places at once."""
    chosen = eligible(t)
    near = spatial.self_pairs(chosen, 5.0).groupBy("site_id").agg(F.count(F.lit(1)).alias("too_near"))
    shared_stops = chosen.groupBy("site_id", "stop").count().where("count > 1").groupBy("site_id").agg(F.count(F.lit(1)).alias("shared_stations"))
    total = chosen.groupBy("site_id").agg(F.count(F.lit(1)).alias("selected"))
    rows = total.join(near, "site_id", "left").join(shared_stops, "site_id", "left").fillna(0, ["too_near", "shared_stations"])
    return rows.withColumn("feasible", (F.col("too_near") + F.col("shared_stations")) == 0)


@query(
    "rejection_dedupe", uses=("points",), recursive=True,
    extra=f"""{CAND},
  acc as (select * from cand where verdict='allowed'),
  rej0 as (select * from cand c where verdict='forbidden' and not exists (select 1 from acc a where a.site_id=c.site_id and abs(a.x-c.x)<=5 and abs(a.y-c.y)<=5 and sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y))<5)),
  {walk('m, station, opt, point_id', '5.0e0', '', 'rej0')}""",
    sql="select site_id, point_id from rej0 join chosen using(point_id)",
)
def rejection_dedupe(t):
    """Inadmissible places recorded once per neighbourhood and not beside an accepted place."""
    rows = candidates(t).withColumn("m", C.mode_rank())
    accepted = rows.where(F.col("verdict") == "allowed").select("site_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    refused = rows.where(F.col("verdict") == "forbidden")
    beside = spatial.near_points(refused.select("site_id", "point_id", "x", "y"), accepted, 5.0).where("distance < 5").select("site_id", "point_id").distinct()
    lonely = refused.join(beside, ["site_id", "point_id"], "left_anti")
    return graph.first_spaced_points(lonely, 5.0, order=("m", "station", "opt", "point_id")).select("site_id", "point_id")


@query("capacity_pack", uses=("points",), recursive=True, extra=f"{CAND},\n{walk('point_id', '5.0e0', '')}", sql="select site_id, count(*) as capacity from elig join chosen using(point_id) group by all")
def capacity_pack(t):
    kept = graph.first_spaced_points(eligible(t), 5.0, order=("point_id",))
    return kept.groupBy("site_id").agg(F.count(F.lit(1)).alias("capacity"))


@query(
    "candidate_check", uses=S.FACTS_USES, extra=f"{S.FACTS},\n{S.VERDICTS},\n{PLANTABLE[len(S.INSIDE) + 1:]}",
    sql="select site_id, verdict, count(*) as candidates from verd where (site_id, point_id) in (select (site_id, point_id) from plantable) group by all",
)
def candidate_check(t):
    """Plantable candidates by verdict: footprint first, then every rule once for the batch."""
    points = t.points.select("site_id", "point_id", "planting_type", "x", "y")
    fit = R.plantable(points, shared.area_rings(t), t.sites, footprint(), max_radius=1.24)
    verdicts = R.verdicts(shared.facts(t, reach=shared.GENERAL_REACH))
    return verdicts.join(fit.select("site_id", "point_id"), ["site_id", "point_id"], "left_semi").groupBy("site_id", "verdict").agg(F.count(F.lit(1)).alias("candidates"))


@query(
    "fill_candidates", uses=("points",), extra=CAND,
    sql="""select site_id, point_id, cast(row_number() over (partition by site_id order by r, -least(percent/100.0e0, 1.0e0), point_id) as bigint) as place from elig""",
)
def fill_candidates(t):
    """Accepted cells in planting order: verdict, barrier, capped slack descending, row order."""
    rows = eligible(t).join(t.points.select("point_id", "percent"), "point_id").withColumn("back", -F.least(F.col("percent") / 100.0, F.lit(1.0)))
    return scan.prefix_sum(rows, F.lit(1), by=("site_id",), order=("r", "back", "point_id"), name="place").select("site_id", "point_id", F.col("place").cast("long").alias("place"))


@query(
    "curb_lines", uses=("segments", "sites"),
    sql="""with c as (select s.site_id, feature_id, case when s.x1<s.x2 or (s.x1=s.x2 and s.y1<=s.y2) then s.x1 else s.x2 end as ax, case when s.x1<s.x2 or (s.x1=s.x2 and s.y1<=s.y2) then s.y1 else s.y2 end as ay,
         (s.x1+s.x2)/2 as mx, (s.y1+s.y2)/2 as my from segments s where object_class='curb'),
       e as (select site_id, min(mx) as x0, min(my) as y0, greatest(max(mx)-min(mx),1e-9) as sx, greatest(max(my)-min(my),1e-9) as sy from c group by all),
       q as (select c.*, cast(floor((mx-x0)/sx*65535.0e0) as bigint) as ix, cast(floor((my-y0)/sy*65535.0e0) as bigint) as iy from c join e using(site_id)),
       z as (select *, """ + "+".join(f"((ix>>{b})%2)*(1::bigint<<{2*b})+((iy>>{b})%2)*(1::bigint<<{2*b+1})" for b in range(16)) + """ as code from q)
       select site_id, feature_id, ax, ay, code, row_number() over (partition by site_id order by code, feature_id) as line_no from z""",
)
def curb_lines(t):
    """Kerb lines with a canonical direction, numbered along a Morton curve of their centres."""
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2")))
    lines = t.segments.where(F.col("object_class") == "curb").select(
        "site_id", "feature_id", F.when(forward, F.col("x1")).otherwise(F.col("x2")).alias("ax"), F.when(forward, F.col("y1")).otherwise(F.col("y2")).alias("ay"),
        ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"))
    extent = lines.groupBy("site_id").agg(
        F.min("mx").alias("x0"), F.min("my").alias("y0"), F.greatest(F.max("mx") - F.min("mx"), F.lit(1e-9)).alias("sx"), F.greatest(F.max("my") - F.min("my"), F.lit(1e-9)).alias("sy"))
    coded = lines.join(extent, "site_id").withColumn("code", C.morton((F.col("mx") - F.col("x0")) / F.col("sx"), (F.col("my") - F.col("y0")) / F.col("sy")))
    rows = scan.prefix_sum(coded, F.lit(1), by=("site_id",), order=("code", "feature_id"), name="line_no")
    return rows.select("site_id", "feature_id", "ax", "ay", "code", F.col("line_no").cast("long").alias("line_no"))


@query(
    "curb_stations", uses=("segments",),
    sql="""with c as (select *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as len from segments where object_class='curb'),
      k as (select *, unnest(range(0, case when len>=5 then cast(ceil((len-2.5e0)/5) as bigint) else 1 end)) as k from c where len>0),
      b as (select *, case when len>=5 then 2.5e0+k*5.0e0 else len/2 end as pos_m, (x2-x1)/len as ux, (y2-y1)/len as uy from k)
      select site_id, feature_id, cast(k as int) as k, side, cast(opt as int) as opt, round((x1+ux*pos_m)-uy*side*o,3) as x, round((y1+uy*pos_m)+ux*side*o,3) as y
      from b, (values (1.0e0),(-1.0e0)) s(side), (values (0,3.0e0),(1,2.5e0),(2,2.0e0)) f(opt,o)""",
)
def curb_stations(t):
    return C.stations_along(t.segments.where(F.col("object_class") == "curb"), C.SPACING_M).select("site_id", "feature_id", "k", "side", "opt", "x", "y")


FREE = """grid as (select site_id, cast(r as int) as "row", cast(c as int) as col, x0+(c+0.5e0)*{cell} as x, y0+(r+0.5e0)*{cell} as y
    from (select *, unnest(range(0, cast(ceil((y1-y0)/{cell}) as bigint))) as r from sites), lateral (select unnest(range(0, cast(ceil(1000/{cell}) as bigint))) as c)),
smp as (select s.site_id, cast(floor((s.x1+(s.x2-s.x1)*(k/cast(n as double))-1000*s.site_id)/{cell}) as int) as col, cast(floor((s.y1+(s.y2-s.y1)*(k/cast(n as double)))/{cell}) as int) as "row"
    from (select *, unnest(range(0, n+1)) as k from (select *, cast(greatest(1, ceil(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))/(0.45e0*{cell}))) as bigint) as n from segments)) s),
barrier as (select distinct site_id, "row", col from smp),
bld as (select g.site_id, g."row", g.col from grid g join rects b on b.site_id=g.site_id and g.x>b.x and g.x<b.x+b.w and g.y>b.y and g.y<b.y+b.d),
free as (select * from grid g where not exists (select 1 from barrier b where b.site_id=g.site_id and b."row"=g."row" and b.col=g.col) and not exists (select 1 from bld b where b.site_id=g.site_id and b."row"=g."row" and b.col=g.col))"""


def free_sql(cell: float) -> str:
    return FREE.replace("{cell}", f"{cell}e0")


def sample_cells(t: Tables, cell: float):
    """Cells touched by any line: samples each 0.45 of a cell."""
    n = F.greatest(F.lit(1), F.ceil(geom.segment_length() / (0.45 * cell))).cast("int")
    rows = t.segments.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    part = F.col("k") / F.col("n").cast("double")
    x, y = F.col("x1") + (F.col("x2") - F.col("x1")) * part, F.col("y1") + (F.col("y2") - F.col("y1")) * part
    return rows.select("site_id", "object_class", F.floor(y / cell).cast("int").alias("row"), F.floor((x - 1000 * F.col("site_id")) / cell).cast("int").alias("col"))


def free_cells(t: Tables, cell: float):
    """Soil cells of a site: no line in them and the centre off buildings."""
    grid = C.grid_points(t.sites, cell)
    barrier = sample_cells(t, cell).select("site_id", "row", "col").distinct()
    inside = spatial.contained(grid, shared.area_rings(t), point_key=("row", "col"), area_key=("feature_id",)).select("site_id", "row", "col").distinct()
    return grid.join(barrier, ["site_id", "row", "col"], "left_anti").join(inside, ["site_id", "row", "col"], "left_anti")


@query(
    "lawn_grid", uses=("sites", "segments", "rects"), extra=free_sql(5.0),
    sql="""select site_id, "row", col, x, y from free where "row"%2=0 and col%2=case when ("row"//2)%2=1 then 1 else 0 end""",
)
def lawn_grid(t):
    """Staggered lattice of soil cells: every second row and column, odd rows shifted."""
    cells = free_cells(t, 5.0)
    shift = F.when(F.floor(F.col("row") / 2) % 2 == 1, 1).otherwise(0)
    return cells.where((F.col("row") % 2 == 0) & (F.col("col") % 2 == shift)).select("site_id", "row", "col", "x", "y")


THETA = math.radians(30.0)
CT, ST = math.cos(THETA), math.sin(THETA)


@query(
    "lawn_lattice_oriented", uses=("sites", "segments", "rects"),
    extra=free_sql(5.0) + f""",
  lat as (select site_id, v, u, round(x0 + (u*20.0e0+case when v%2<>0 then 10.0e0 else 0.0e0 end)*{CT!r}-(v*20.0e0)*{ST!r},3) as x, round(y0+(u*20.0e0+case when v%2<>0 then 10.0e0 else 0.0e0 end)*{ST!r}+(v*20.0e0)*{CT!r},3) as y, x0, x1, y0, y1
     from sites, range(-30,50) a(v), range(0,80) b(u))""",
    sql="""select l.site_id, cast(l.v as int) as v, cast(l.u as int) as u, l.x, l.y from lat l join free f on f.site_id=l.site_id and f.col=cast(floor((l.x-l.x0)/5.0e0) as int) and f."row"=cast(floor((l.y-l.y0)/5.0e0) as int)
       where l.x>=l.x0 and l.x<l.x1 and l.y>=l.y0 and l.y<l.y1""",
)
def lawn_lattice_oriented(t):
    """Staggered lattice turned by 30 degrees; points on soil cells stay."""
    step = 20.0
    lattice = t.sites.withColumn("v", F.explode(F.sequence(F.lit(-30), F.lit(49)))).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(79))))
    a = F.col("u") * step + F.when(F.col("v") % 2 != 0, step / 2).otherwise(0.0)
    b = F.col("v") * step
    turned = lattice.withColumn("x", F.round(F.col("x0") + a * CT - b * ST, 3)).withColumn("y", F.round(F.col("y0") + a * ST + b * CT, 3))
    turned = turned.where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    located = turned.withColumn("col", F.floor((F.col("x") - F.col("x0")) / 5.0).cast("int")).withColumn("row", F.floor((F.col("y") - F.col("y0")) / 5.0).cast("int"))
    return located.join(free_cells(t, 5.0).select("site_id", "row", "col"), ["site_id", "row", "col"], "left_semi").select("site_id", "v", "u", "x", "y")


@query(
    "tree_groups", uses=("sites", "segments", "rects"),
    extra=free_sql(5.0) + f""",
  ctr as (select site_id, r, c, x0, y0, x0+9.0e0+(r%2)*9.0e0+c*18.0e0 as cx, y0+9.0e0+r*{18 * math.sqrt(3) / 2!r} as cy, x1 from sites, range(0, cast(ceil((1000-9.0e0)/{18 * math.sqrt(3) / 2!r}) as bigint)) a(r), range(0, 56) b(c) where x0+9.0e0+(r%2)*9.0e0+c*18.0e0 < x1),
  crn as (select site_id, r, c, k, x0, y0, round(cx+{6 / math.sqrt(3)!r}*cos({math.pi / 2!r}+k*{2 * math.pi / 3!r}+(r%2)*{math.pi!r}),3) as x, round(cy+{6 / math.sqrt(3)!r}*sin({math.pi / 2!r}+k*{2 * math.pi / 3!r}+(r%2)*{math.pi!r}),3) as y from ctr, range(0,3) d(k))""",
    sql="""select g.site_id, cast(r as int) as "row", cast(c as int) as col, cast(k as int) as corner, g.x, g.y from crn g join free f on f.site_id=g.site_id and f.col=cast(floor((g.x-g.x0)/5.0e0) as int) and f."row"=cast(floor((g.y-g.y0)/5.0e0) as int)""",
)
def tree_groups(t):
    corners = C.tree_groups(t.sites.select("site_id", "x0", "x1", "y0", "y1")).withColumn("fc", F.floor((F.col("x") - 1000 * F.col("site_id")) / 5.0).cast("int")).withColumn("fr", F.floor(F.col("y") / 5.0).cast("int"))
    soil = free_cells(t, 5.0).select("site_id", F.col("row").alias("fr"), F.col("col").alias("fc"))
    return corners.join(soil, ["site_id", "fr", "fc"], "left_semi").select("site_id", "row", "col", "corner", "x", "y")


@query(
    "shrub_group_points", uses=("points",),
    sql="""select site_id, point_id, cast(i*3+j as int) as k, round(x+(i-1)*1.0e0,3) as x, round(y+(j-1)*1.0e0,3) as y from points, range(0,3) a(i), range(0,3) b(j) where planting_type='tree' and status='P'""",
)
def shrub_group_points(t):
    """A 3x3 square of shrubs around every tree place left empty."""
    centres = t.points.where((F.col("planting_type") == "tree") & (F.col("status") == "P")).select("site_id", "point_id", "x", "y")
    return C.around(centres, C.square_offsets(C.SHRUB_GROUP_SIZE, C.SHRUB_GROUP_SPACING_M)).select("site_id", "point_id", "k", "x", "y")


@query("existing_row_extend")
def existing_row_extend(t):
    return C.rows_of_stems(t.stems.select("site_id", "stem_id", "x", "y"))


@query(
    "yard_alley_filter", uses=("points", "rects"),
    sql="""select site_id, count(*) as kept from points p where not (mode='alley' and exists (select 1 from rects b where b.site_id=p.site_id and p.x between b.x-20 and b.x+b.w+20 and p.y between b.y-20 and b.y+b.d+20)) group by all""",
)
def yard_alley_filter(t):
    """Alley candidates lying in a yard (within 20 m around a building box) are not offered."""
    boxes = t.rects.select("site_id", F.col("feature_id"), (F.col("x") - 20).alias("bx0"), (F.col("x") + F.col("w") + 20).alias("bx1"), (F.col("y") - 20).alias("by0"), (F.col("y") + F.col("d") + 20).alias("by1"))
    cells = boxes.withColumn("cx", F.explode(geom.cell_range(F.col("bx0"), F.col("bx1"), 64.0))).withColumn("cy", F.explode(geom.cell_range(F.col("by0"), F.col("by1"), 64.0)))
    alley = t.points.where(F.col("mode") == "alley").withColumn("cx", geom.cell_of("x", 64.0)).withColumn("cy", geom.cell_of("y", 64.0))
    within = F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1"))
    yard = alley.join(cells, ["site_id", "cx", "cy"]).where(within).select("site_id", "point_id").distinct()
    return t.points.join(yard, ["site_id", "point_id"], "left_anti").groupBy("site_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "variant_compare", uses=("points",),
    sql="""with v as (select site_id, mode as variant, avg(percent)/100 as quality, count(*) filter (status='O') as approvals, count(distinct station) as capacity, count(*) filter (status='P' and percent=0)=0 as valid,
          case mode when 'existing_row' then 0 when 'alley' then 1 when 'lawn' then 2 when 'groups' then 3 else 4 end as seq from points group by all),
       r as (select *, row_number() over (partition by site_id order by valid desc, round(quality,9) desc, approvals, seq) as place, max(capacity) over (partition by site_id) as site_capacity from v)
       select site_id, variant, round(quality,6) as quality, approvals, site_capacity, valid, valid and place=1 as chosen from r""",
)
def variant_compare(t):
    """Validated variants by (index, fewer approvals, earlier); the capacity target is shared."""
    variants = t.points.groupBy("site_id", F.col("mode").alias("variant")).agg(
        (F.avg("percent") / 100).alias("quality"), F.count_if(F.col("status") == "O").alias("approvals"), F.countDistinct("station").alias("capacity"),
        (F.count_if((F.col("status") == "P") & (F.col("percent") == 0)) == 0).alias("valid"))
    w = Window.partitionBy("site_id")
    place = F.row_number().over(w.orderBy(F.desc("valid"), F.desc(F.round("quality", 9)), "approvals", C.mode_rank("variant")))
    return variants.withColumn("place", place).withColumn("site_capacity", F.max("capacity").over(w)).select(
        "site_id", "variant", F.round("quality", 6).alias("quality"), "approvals", "site_capacity", "valid", (F.col("valid") & (F.col("place") == 1)).alias("chosen"))


BINS = rulebook.sql_values("bins", "object_class, lo, hi, w", likeness.rows())


@query(
    "likeness_score", uses=("points", "segments"),
    extra=f"""{BINS},
  nd as (select p.point_id, s.object_class, min({S.seg_dist()}) as d from points p join segments s on s.site_id=p.site_id and s.x1 between p.x-120 and p.x+120 and s.y1 between p.y-120 and p.y+120 where {S.seg_dist()} <= 40.0e0 group by all),
  cls as (select distinct object_class from bins),
  ld as (select p.point_id, c.object_class, least(coalesce(d, 40.0e0), 40.0e0) as d from points p cross join cls c left join nd on nd.point_id=p.point_id and nd.object_class=c.object_class)""",
    sql="select ld.point_id, round(1.0e0/(1.0e0+exp(-(-1.6959e0+sum(w)))),5) as likeness from ld join bins b on b.object_class=ld.object_class and ld.d>=b.lo and ld.d<b.hi group by ld.point_id",
)
def likeness_score(t):
    """Probability that a designer would plant here: nearest distances through the scorecard.

    The far bin is the default of every class, so only classes met within 40 m are joined; the
    rest of the logit is one constant.
    """
    bins = t.spark.createDataFrame(likeness.rows(), "object_class string, lo double, hi double, w double")
    far = {c: terms[-1] for c, terms in likeness.TERMS.items()}
    known = t.segments.where(F.col("object_class").isin(*likeness.TERMS))
    known = known.withColumns({"error_m": F.lit(0.0), "diameter_m": F.lit(0.0)})
    near = R.nearest_clearance(t.points.select("site_id", "point_id", "x", "y"), known, reach=dict.fromkeys(likeness.TERMS, likeness.CAP_M))
    best = near.groupBy("point_id", "object_class").agg(F.min("axis_m").alias("d"))
    default = F.create_map(*[v for c, w in far.items() for v in (F.lit(c), F.lit(w))])
    gained = best.join(F.broadcast(bins), "object_class").where((F.col("d") >= F.col("lo")) & (F.col("d") < F.col("hi")))
    delta = gained.groupBy("point_id").agg(F.sum(F.col("w") - default[F.col("object_class")]).alias("delta"))
    logit = F.lit(likeness.INTERCEPT + sum(far.values())) + F.coalesce("delta", F.lit(0.0))
    return t.points.select("point_id").join(delta, "point_id", "left").select("point_id", F.round(1 / (1 + F.exp(-logit)), 5).alias("likeness"))


def zone_facts(t: Tables, cell: float, margin: float):
    """Every rule at the centre of every plantable cell, as if a tree stood there."""
    grid = C.grid_points(t.sites, cell).select("site_id", "point_id", "x", "y", F.lit("tree").alias("planting_type"))
    fit = R.plantable(grid, shared.area_rings(t), t.sites, 1.24, max_radius=1.24, margin_m=margin)
    clearance = R.nearest_clearance(fit, t.segments, reach=shared.norm_reach(margin))
    return fit, R.checks(fit, shared.strict_rules(t), clearance, shared.presence(t), margin_m=margin)


@query("admissibility_zones")
def admissibility_zones(t):
    """Area certified for a tree by verdict: a cell counts when its centre passes with half its diagonal."""
    cell = 20.0
    _, facts = zone_facts(t, cell, cell / math.sqrt(2))
    verdicts = R.verdicts(facts)
    return verdicts.groupBy("site_id", "verdict").agg(F.count(F.lit(1)).alias("cells"), F.round(F.count(F.lit(1)) * cell * cell, 1).alias("area_m2"))


ZONE = f"""zsites as (select * from sites),
zpts as (select site_id, cast(r*100000+c as bigint) as point_id, x0+(c+0.5e0)*20.0e0 as x, y0+(r+0.5e0)*20.0e0 as y, 'tree' as planting_type from zsites, range(0,50) a(r), range(0,50) b(c)),
zin as (select p.site_id, p.point_id, s.feature_id from zpts p join segments s on s.site_id=p.site_id and s.is_area=1 where ((s.y1>p.y)<>(s.y2>p.y)) and p.x < s.x1+(p.y-s.y1)/(s.y2-s.y1)*(s.x2-s.x1) group by all having count(*)%2=1),
zd as (select p.site_id, p.point_id, s.object_class, s.is_area, {S.seg_dist()} as d, s.error_m as err, s.diameter_m/2 as half from zpts p join segments s on s.site_id=p.site_id),
zok as (select * from zpts p where (site_id, point_id) not in (select (site_id, point_id) from zin) and (site_id, point_id) not in (select (site_id, point_id) from zd where is_area=1 and d<=1.24e0)),
zc as (select site_id, point_id, object_class, min(greatest(0.0e0,d-err)) as axis_m, min(greatest(0.0e0,d-err-half)) as wall_m from zd group by all),
zf as (select z.site_id, z.point_id, r.rule_id from zok z join rules r on r.planting_type='tree' join zc c on c.site_id=z.site_id and c.point_id=z.point_id and c.object_class=r.object_class
   where not (case when measure_to='outer_wall' then wall_m else axis_m end >= min_distance_m-0.001e0))"""


@query(
    "blocked_shares", uses=("sites", "segments"), extra=f"{S.GENERAL},\n{ZONE}",
    sql="""select site_id, rule_id, round(count(*)*400.0e0,1) as blocked_m2, round(sum(case when n=1 then 400.0e0 else 0.0e0 end),1) as only_m2
      from (select *, count(*) over (partition by site_id, point_id) as n from zf) group by all""",
)
def blocked_shares(t):
    """Ground that each norm closes, and ground where it is the only reason."""
    cell = 20.0
    _, facts = zone_facts(t, cell, 0.0)
    failed = facts.where(F.col("outcome") == "fail")
    reasons = failed.groupBy("site_id", "point_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("rule_id").alias("rules"))  # a cell fails at most the rules of the book
    spread = reasons.select("site_id", "n", F.explode("rules").alias("rule_id"))
    return spread.groupBy("site_id", "rule_id").agg(
        F.round(F.count(F.lit(1)) * cell * cell, 1).alias("blocked_m2"), F.round(F.sum(F.when(F.col("n") == 1, cell * cell).otherwise(0.0)), 1).alias("only_m2"))
