"""Fragments of checking SQL shared by several queries: brute force, no cells."""

from __future__ import annotations

from streetgrove.functions import rulebook


def seg_dist(px="p.x", py="p.y", s="s") -> str:
    x1, y1, x2, y2 = (f"{s}.{c}" for c in ("x1", "y1", "x2", "y2"))
    norm = f"(({x2}-{x1})*({x2}-{x1})+({y2}-{y1})*({y2}-{y1}))"
    along = f"case when {norm}=0 then cast(0 as double) else (({px}-{x1})*({x2}-{x1})+({py}-{y1})*({y2}-{y1}))/{norm} end"
    t = f"greatest(cast(0 as double),least(cast(1 as double),{along}))"
    dx = f"({px}-({x1}+{t}*({x2}-{x1})))"
    dy = f"({py}-({y1}+{t}*({y2}-{y1})))"
    return f"sqrt({dx}*{dx}+{dy}*{dy})"


def dist(a="a", b="b", ax="x", ay="y", bx="x", by="y") -> str:
    return f"sqrt(({a}.{ax}-{b}.{bx})*({a}.{ax}-{b}.{bx})+({a}.{ay}-{b}.{by})*({a}.{ay}-{b}.{by}))"


RULES = rulebook.rules_sql("all_rules")
DISABLED = ",".join(f"'{r}'" for r in rulebook.STRICT_DISABLED)
GENERAL = f"""{RULES},
rules as (select * from all_rules where (edition is null or edition='2016') and rule_id not in ({DISABLED})
  and len(genera)=0 and len(traits)=0 and min_crown_m is null)"""
ACT_RULES = f"""{GENERAL},
act_rules as (select * from rules where act_id<>'PROJECT' and object_class not in ('existing_tree','existing_shrub'))"""

INSIDE = """inside as (select p.site_id, p.point_id, s.feature_id, s.object_class
  from points p join segments s on s.site_id=p.site_id and s.is_area=1
  where ((s.y1>p.y) <> (s.y2>p.y)) and p.x < s.x1+(p.y-s.y1)/(s.y2-s.y1)*(s.x2-s.x1)
  group by all having count(*)%2=1)"""

# clearance to every class by brute force over the whole site
CLEARANCE = f"""{INSIDE},
pair_d as (select p.site_id, p.point_id, s.object_class, s.feature_id, s.error_m as err, s.diameter_m/2 as half, {seg_dist()} as d
  from points p join segments s on s.site_id=p.site_id),
clr0 as (select site_id, point_id, object_class,
    min(row(greatest(cast(0 as double), d-err), feature_id)) as ax,
    min(row(greatest(cast(0 as double), d-err-half), feature_id)) as wl
  from pair_d group by all),
ins as (select site_id, point_id, object_class, min(feature_id) as in_id from inside group by all),
clr as (select c.site_id, c.point_id, c.object_class,
    case when in_id is not null then cast(0 as double) else ax[1] end as axis_m, coalesce(in_id, ax[2]) as axis_id,
    case when in_id is not null then cast(0 as double) else wl[1] end as wall_m, coalesce(in_id, wl[2]) as wall_id
  from clr0 c left join ins using(site_id, point_id, object_class))"""


def util(c="object_class") -> str:
    return f"({c} like 'utility.%' and {c}<>'utility.access')"


PRESENCE = f"""presence as (select r.site_id, coalesce(bool_or({util()} and object_class<>'utility.unknown'), false) as has_utility_data
  from sites r left join features using(site_id) group by all)"""


def checks(rules="rules", points="points", name="chk", threshold="min_distance_m", barrier: str | None = None, by="planting_type", keep="") -> str:
    m = "case when measure_to='outer_wall' then wall_m else axis_m end"
    relaxed = ""
    if barrier:
        relaxed = f""" when {barrier} is not null and p.planting_type='tree' and severity='forbid' and ({util('r.object_class')} or r.object_class in ('curb','road'))
            and {threshold}>{barrier} and {m}>={barrier}-0.001 then 'barrier'"""
    return f"""{name} as (select p.site_id, p.point_id, p.planting_type, {keep} r.rule_id, r.object_class, r.severity, r.act_id,
    case when {m} is null and {util('r.object_class')} and not coalesce(has_utility_data,false) then 'no_data' when {m} is null then 'pass'
      when {m} >= {threshold}-cast(0.001 as double) then 'pass'{relaxed} else 'fail' end as outcome,
    {threshold} as threshold_m, round({m},3) as measured_m,
    case when measure_to='outer_wall' then wall_id else axis_id end as nearest_id
  from {points} p join {rules} r using({by}) left join presence using(site_id)
  left join clr c on c.site_id=p.site_id and c.point_id=p.point_id and c.object_class=r.object_class)"""


VERDICTS = """verd as (select site_id, point_id, case when bool_or(outcome='fail' and severity='forbid') then 'forbidden'
    when bool_or(outcome='no_data') then 'needs_approval' when bool_or(outcome='fail') then 'needs_approval' else 'allowed' end as verdict,
    bool_or(outcome='barrier') as needs_barrier from chk group by all)"""

FACTS_USES = ("points", "segments", "features", "sites")
FACTS = f"{GENERAL},\n{CLEARANCE},\n{PRESENCE},\n{checks()}"
ACT_FACTS = f"{ACT_RULES},\n{CLEARANCE},\n{PRESENCE},\n{checks('act_rules', barrier='cast(1 as double)')}"
