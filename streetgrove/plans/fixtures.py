"""Canonical tables derived from the driver's parquet files.

Each definition is portable SQL, so Spark and the checking engine read the same inputs: only
integer arithmetic and one division, rounded to 3 decimals. Sites are squares of 1000 m.
Operators never appear here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def hashed(key: str, multiplier: int, modulus: int, span: int = 1000) -> str:
    return f"cast((({key})*{multiplier})%{modulus} as double)*{span}/cast({modulus} as double)"


def _place(key: str, site: str, mx: int = 7919, my: int = 104729) -> str:
    return (
        f"round(1000*({site})+{hashed(key, mx, 100003)},3) as x, "
        f"round({hashed(key, my, 99991)},3) as y"
    )


_GENERA = (
    "tilia", "acer", "populus", "crataegus", "larix", "betula", "syringa", "lonicera", "cotoneaster", "cornus",
    "quercus", "reynoutria", "ailanthus", "fraxinus", "rosa", "prunus", "spiraea", "picea", "pinus",
)
_EPITHETS = {"acer": "negundo", "cornus": "alba", "quercus": "rubra", "ailanthus": "altissima",
             "fraxinus": "pennsylvanica", "rosa": "rugosa", "prunus": "virginiana"}
_GENUS = "case s%19 " + " ".join(f"when {i} then '{g}'" for i, g in enumerate(_GENERA)) + " end"
_EPITHET = "case s%19 " + " ".join(f"when {_GENERA.index(g)} then '{e}'" for g, e in _EPITHETS.items()) + " else 'vulgaris' end"


_DRAWN_WORDS = (
    ("bolt", "газопровод"), ("ring", "колодец"), ("gear", "тротуар"), ("gizmo", "газон"), ("anvil", "здание"), ("plate", "кабель связи"),
    ("rod", "БР100"), ("widget", "дерево"), ("cold", "край дороги"), ("red", "демонтаж"), ("new", "новый"), ("old", "сущ"), ("hot", "проект"),
    ("large", "подпись"), ("small", "без"), ("blue", "слой"),
)
_LAYER = "p_name"
for _word, _drawn in _DRAWN_WORDS:
    _LAYER = f"replace({_LAYER},'{_word}','{_drawn}')"

_GROUND_WORDS = (
    ("gizmo", "Газон"), ("widget", "цветник."), ("gear", "А"), ("plate", "плитка бетонная"), ("anvil", "Дет.пл."), ("ring", "щ"), ("bolt", "к.кирп"), ("rod", "ГАЗОН на ПЛОЩАДКЕ"),
)
_GROUND = "regexp_replace(p_name, '^[a-z]+ ', '')"
for _word, _drawn in _GROUND_WORDS:
    _GROUND = f"replace({_GROUND},'{_word}','{_drawn}')"

FIXTURES: dict[str, str] = {
    "sites": """select cast(r_regionkey as bigint) as site_id, cast(1000*r_regionkey as double) as x0,
        cast(1000*r_regionkey+1000 as double) as x1, cast(0 as double) as y0, cast(1000 as double) as y1,
        r_name as site_name from region""",
    # plantings under check
    "points": f"""select o_orderkey as point_id, o_custkey%5 as site_id, {_place('o_orderkey', 'o_custkey%5')},
        case when o_orderpriority in ('1-URGENT','2-HIGH') then 'tree' else 'shrub' end as planting_type,
        o_custkey%58 as species_no, cast(floor(o_orderkey/3) as bigint) as station, o_orderkey%3 as opt,
        case o_orderkey%5 when 0 then 'existing_row' when 1 then 'alley' when 2 then 'lawn' when 3 then 'groups' else 'fill' end as mode,
        o_custkey as owner, (o_orderkey*37)%101 as percent, o_orderstatus as status, cast(o_totalprice as double) as price, o_orderpriority as priority
        from orders""",
    "line_rows": """select l_orderkey as feature_id, max(l_quantity) as q, min(l_suppkey) as sk, min(l_partkey) as pk,
        max(l_discount) as dc, max(abs(l_tax)) as tx from lineitem group by l_orderkey""",
    "lines": f"""select feature_id, pk%5 as site_id, {_place('feature_id', 'pk%5', 15485863, 32452843)},
        cast(q as double) as len, feature_id%2 as vertical, sk%10 as kind_no,
        case sk%10 when 0 then 'utility.water' when 1 then 'utility.sewer' when 2 then 'utility.heat'
          when 3 then 'utility.gas' when 4 then 'utility.power_cable' when 5 then 'utility.telecom'
          when 6 then 'curb' when 7 then 'fence' when 8 then 'pavement_edge' else 'pole' end as object_class,
        round(cast(dc as double)*4,3) as diameter_m, round(cast(tx as double)/10,3) as error_m
        from {{line_rows}}""",
    # wires between poles: every pole line of some weight
    "overhead_lines": """select site_id, feature_id, 'power_line_overhead' as object_class, diameter_m, error_m, x as x1, y as y1,
        case when vertical=0 then x+len else x end as x2, case when vertical=0 then y else y+len end as y2 from {lines} where kind_no=9 and diameter_m>=0.2""",
    "rects": f"""select 1000000000+s_suppkey as feature_id, s_suppkey%5 as site_id, {_place('s_suppkey', 's_suppkey%5', 49979687, 67867967)},
        cast(8+s_suppkey%20 as double) as w, cast(6+s_suppkey%15 as double) as d, s_suppkey as suppkey,
        s_nationkey, s_acctbal from supplier""",
    "segments": """select site_id, feature_id, cast(0 as int) as ring_id, cast(0 as int) as seg_no, object_class, diameter_m, error_m,
          cast(0 as int) as is_area, x as x1, y as y1,
          case when vertical=0 then x+len else x end as x2, case when vertical=0 then y else y+len end as y2 from {lines}
        union all select site_id, feature_id, cast(0 as int), cast(0 as int), 'building', cast(0 as double), cast(0 as double), cast(1 as int), x, y, x+w, y from {rects}
        union all select site_id, feature_id, cast(0 as int), cast(1 as int), 'building', cast(0 as double), cast(0 as double), cast(1 as int), x+w, y, x+w, y+d from {rects}
        union all select site_id, feature_id, cast(0 as int), cast(2 as int), 'building', cast(0 as double), cast(0 as double), cast(1 as int), x+w, y+d, x, y+d from {rects}
        union all select site_id, feature_id, cast(0 as int), cast(3 as int), 'building', cast(0 as double), cast(0 as double), cast(1 as int), x, y+d, x, y from {rects}""",
    "features": """select feature_id, site_id, object_class, 'line' as kind, cast(0 as int) as is_area, diameter_m, error_m, x, y, len from {lines}
        union all select feature_id, site_id, 'building', 'area', cast(1 as int), cast(0 as double), cast(0 as double), x, y, 2*(w+d) from {rects}""",
    # existing trees
    "stems": f"""select c_custkey as stem_id, c_custkey%5 as site_id, {_place('c_custkey', 'c_custkey%5', 86028121, 122949823)},
        round(3+cast(c_custkey%6 as double),1) as crown_m, c_mktsegment as genus, c_nationkey as nation_no, c_acctbal as acctbal from customer""",
    "labels_t": f"""select p_partkey as label_id, p_partkey%5 as site_id, {_place('p_partkey', 'p_partkey%5', 141650939, 179424673)},
        p_type as layer, case when p_partkey%2=0 then concat('d=', cast(p_size*20 as varchar(12))) else p_name end as text from part""",
    # what is written on the ground of a drawing, worded by the part's name
    "ground_labels": f"""select p_partkey as label_id, p_partkey%5 as site_id, {_place('p_partkey', 'p_partkey%5', 141650939, 179424673)}, {{ground}} as text from part""".replace("{ground}", _GROUND),
    # the drawn area of works: the largest zone of a site
    "works": """select site_id, x as x0, y as y0, x+w as x1, y+d as y1 from (select *, row_number() over (partition by site_id order by w*d desc, feature_id) as rn from {zones}) q where rn=1""",
    "names": """select p_partkey as feature_id, p_name as layer, p_brand as block, p_type as kind, p_size as size from part""",
    # objects of a drawing before classification, layers named as draughtsmen name them
    "drawn": f"""select p_partkey as feature_id, p_partkey%5 as site_id, concat('tp$0$', {_LAYER}) as layer, concat('xr|', p_brand, '_', cast(p_size as varchar(4))) as block,
        case p_size%4 when 0 then 'point' when 1 then 'line' when 2 then 'circle' else 'area' end as kind,
        case when p_size%4=2 then cast(p_size as double)/10 else null end as radius_m, p_size%9=0 as is_frame,
        case when p_size%7=0 then null else cast(p_size as double)/100 end as error_m, p_size as size, p_type as sheet from part""",
    # catalogue of 58 species: every part goes into one of them
    "species_rows": """select p_partkey%58 as species_no, sum(cast(p_size as bigint)) as s, count(*) as n from part group by p_partkey%58""",
    "species": f"""select species_no, concat('sp', cast(species_no as varchar(4))) as species_code,
        {_GENUS} as genus, concat('family', cast((s%19)%7 as varchar(4))) as family,
        concat(upper(substring({_GENUS},1,1)), substring({_GENUS},2,20), ' ', case when species_no%2=0 then {_EPITHET} else 'hybrida' end) as name_lat,
        case when species_no%2=0 then 'tree' else 'shrub' end as life_type,
        cast(species_no%10 as bigint)<2 as conifer,
        2+cast(s%50 as double)/5 as crown_mature_m, 1+cast(s%40 as double)/2 as height_m, 2+s%4 as hardiness_zone,
        case s%3 when 0 then 'sun' when 1 then 'semi' else 'shade' end as light, s%3 as salt, (s+1)%3 as gas, (s+2)%3 as compaction,
        s%3 as allergen, s%11=0 as thorny, s%13=0 as fluff, s%17=0 as fruit_litter, 20+s%180 as lifespan_years, 1+s%3 as care_level, n as pilot_count,
        case s%4 when 0 then 'plus' when 1 then 'limited' when 2 then 'minus' else null end as category_mark,
        1+s%12 as month_a, 1+(s+1)%12 as month_b, s%2=0 as use_row, s%3=0 as use_group, s%5=0 as use_single, s%7=0 as evergreen,
        case when s%6=0 then false when s%6<4 then true else null end as city_mark, s%9=0 as male_clone, s%8 as pilot_streets
        from {{species_rows}}""",
    # streets with a length from the project note
    "streets": """select o_custkey%5 as site_id, cast(10*count(*) as double) as length_m, count(distinct cast(floor(o_orderkey/3) as bigint)) as capacity from orders group by o_custkey%5""",
    "inventory": """select c_mktsegment as name, 1+c_custkey%4 as cnt, case when c_acctbal<0 then 'remove' else 'keep' end as verdict, c_custkey as row_no, c_custkey%5 as site_id from customer""",
    # carriageways: one across the site per nation; zoning squares around suppliers
    "roads": """select 2000000000+cast(n_nationkey as bigint) as feature_id, cast(n_nationkey%5 as bigint) as site_id, cast(1000*(n_nationkey%5) as double) as x, cast((n_nationkey*37)%950 as double) as y,
        cast(1000 as double) as w, cast(8+n_nationkey%6 as double) as d from nation""",
    "road_edges": """select site_id, feature_id, 'road' as object_class, x as x1, y as y1, x+w as x2, y as y2 from {roads} union all select site_id, feature_id, 'road', x+w, y, x+w, y+d from {roads}
        union all select site_id, feature_id, 'road', x+w, y+d, x, y+d from {roads} union all select site_id, feature_id, 'road', x, y+d, x, y from {roads}""",
    "zones": f"""select 3000000000+s_suppkey as feature_id, s_suppkey%5 as site_id, {_place('s_suppkey', 's_suppkey%5', 32452867, 86028157)}, cast(40+s_suppkey%50 as double) as w, cast(30+s_suppkey%40 as double) as d,
        case s_suppkey%6 when 0 then 'territory.street' when 1 then 'territory.yard' when 2 then 'territory.square' when 3 then 'territory.park' when 4 then 'territory.protected_green' else 'territory.natural' end as object_class from supplier""",
    "zone_edges": """select site_id, feature_id, object_class, x as x1, y as y1, x+w as x2, y as y2 from {zones} union all select site_id, feature_id, object_class, x+w, y, x+w, y+d from {zones}
        union all select site_id, feature_id, object_class, x+w, y+d, x, y+d from {zones} union all select site_id, feature_id, object_class, x, y+d, x, y from {zones}""",
    # the outline of a zone as a draughtsman leaves it: four strokes in any direction, the last one short of the start
    "boundary_strokes": """select feature_id*4+k as piece_id, site_id, feature_id, cast(feature_id%5 as double)/10 as error_m,
        case when (feature_id+k)%2=0 then ax else ex end as x1, case when (feature_id+k)%2=0 then ay else ey end as y1, case when (feature_id+k)%2=0 then ex else ax end as x2, case when (feature_id+k)%2=0 then ey else ay end as y2
        from (select feature_id, site_id, 0 as k, x as ax, y as ay, round(x+w,3) as ex, y as ey from {zones} union all select feature_id, site_id, 1, round(x+w,3), y, round(x+w,3), round(y+d,3) from {zones}
        union all select feature_id, site_id, 2, round(x+w,3), round(y+d,3), x, round(y+d,3) from {zones} union all select feature_id, site_id, 3, x, round(y+d,3), x, round(y+cast(feature_id%8 as double)*0.4,3) from {zones}) q""",
    # parts of terraced houses, five in a row wall to wall, as deep as their number says
    "house_parts": """select c_custkey as face, c_custkey%5 as site_id, cast(1000*(c_custkey%5)+24*(cast(floor(c_custkey/5) as bigint)%40)+2*(cast(floor(cast(floor(c_custkey/5) as bigint)%40/5) as bigint)) as double) as x,
        cast(30*cast(floor(c_custkey/200) as bigint) as double) as y, cast(24 as double) as w, cast(10+c_custkey%11 as double) as d from customer""",
    "edits": """select user_id%7 as run_id, event_id as seq, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as target, ts, case event_type when 'click' then 'move' when 'purchase' then 'add' when 'error' then 'delete' else null end as kind,
        event_type, value, user_id, props from events""",
}


def _refs(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table of the driver or a canonical table, as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name]
    bound = {ref: table(spark, sf_dir, ref) for ref in _refs(text)}
    for base in BASE_TABLES:
        if re.search(rf"\bfrom {base}\b", text):
            text = re.sub(rf"\bfrom {base}\b", f"from {{{base}}}", text)
            bound[base] = table(spark, sf_dir, base)
    return spark.sql(text, **bound)


def ctes(*names: str) -> str:
    """``name as (...)`` list with dependencies first, for the checking SQL."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in done:
            return
        text = FIXTURES[name]
        for ref in _refs(text):
            visit(ref)
        done[name] = f"{name} as ({re.sub(r'[{}]', '', text)})"

    for name in names:
        visit(name)
    return ",\n".join(done.values())
