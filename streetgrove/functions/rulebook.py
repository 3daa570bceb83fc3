"""The rule book as dimension tables. The values below are fixed values of the norms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values. Columns: rule_id, object class, planting type, metres, measured to, severity, act,
# edition ('-' for any), genera, minimum crown, trait, listed in table 9.1.
_DISTANCE = """
R-BLD-TREE-001 building tree 5.0 edge forbid SP42_13330_2016 - - - - 1
R-SCHOOL-TREE-001 school tree 10.0 edge forbid PP743 - - - - 0
R-SCHOOL-SHRUB-001 school shrub 1.5 edge forbid PP743 - - - - 0
R-BLD-SHRUB-001 building shrub 1.5 edge forbid SP42_13330_2016 - - - - 1
R-BLDCROWN-TREE-001 building tree 10.0 edge forbid PP743 - - 5.0 - 0
R-TRAM-TREE-001 tram tree 5.0 edge forbid SP42_13330_2016 - - - - 1
R-TRAM-SHRUB-001 tram shrub 3.0 edge forbid SP42_13330_2016 - - - - 1
R-RAIL-TREE-001 railway tree 5.0 edge forbid PROJECT - - - - 1
R-RAIL-SHRUB-001 railway shrub 3.0 edge forbid PROJECT - - - - 1
R-ROAD-TREE-001 road tree 2.0 edge forbid SP42_13330_2016 - - - - 1
R-ROAD-SHRUB-001 road shrub 1.0 edge forbid SP42_13330_2016 - - - - 1
R-CURB-TREE-001 curb tree 2.0 edge forbid SP42_13330_2016 - - - - 1
R-CURB-SHRUB-001 curb shrub 1.0 edge forbid SP42_13330_2016 - - - - 1
R-SWALK-TREE-001 sidewalk tree 0.7 edge forbid SP42_13330_2016 - - - - 1
R-SWALK-SHRUB-001 sidewalk shrub 0.5 edge forbid SP42_13330_2016 - - - - 1
R-PAVE-TREE-001 pavement_edge tree 0.7 edge forbid SP42_13330_2016 - - - - 1
R-PAVE-SHRUB-001 pavement_edge shrub 0.5 edge forbid SP42_13330_2016 - - - - 1
R-THORNSW-TREE-001 sidewalk tree 2.0 edge forbid SP82_13330_2016 - - - thorny 0
R-THORNSW-SHRUB-001 sidewalk shrub 2.0 edge forbid SP82_13330_2016 - - - thorny 0
R-THORNPV-TREE-001 pavement_edge tree 2.0 edge forbid SP82_13330_2016 - - - thorny 0
R-THORNPV-SHRUB-001 pavement_edge shrub 2.0 edge forbid SP82_13330_2016 - - - thorny 0
R-POLE-TREE-001 pole tree 4.0 axis forbid SP42_13330_2016 - - - - 1
R-SLOPE-TREE-001 slope tree 1.0 edge forbid SP42_13330_2016 - - - - 1
R-SLOPE-SHRUB-001 slope shrub 0.5 edge forbid SP42_13330_2016 - - - - 1
R-STRUCT-TREE-001 structure tree 3.0 edge forbid SP42_13330_2016 - - - - 1
R-STRUCT-SHRUB-001 structure shrub 1.0 edge forbid SP42_13330_2016 - - - - 1
R-GAS-TREE-001 utility.gas tree 1.5 outer_wall forbid SP42_13330_2016 - - - - 1
R-GASZONE-TREE-001 utility.gas tree 3.24 axis needs_approval PPRF878 - - - - 0
R-GASZONE-SHRUB-001 utility.gas shrub 2.5 axis needs_approval PPRF878 - - - - 0
R-HEATZONE-TREE-001 utility.heat tree 4.24 outer_wall needs_approval MINSTROY197 - - - - 0
R-HEATZONE-SHRUB-001 utility.heat shrub 3.5 outer_wall needs_approval MINSTROY197 - - - - 0
R-SEWER-TREE-001 utility.sewer tree 1.5 outer_wall forbid SP42_13330_2016 - - - - 1
R-STORM-TREE-001 utility.storm tree 1.5 outer_wall forbid SP42_13330_2016 - - - - 1
R-HEAT-TREE-001 utility.heat tree 2.0 outer_wall forbid SP42_13330_2016 - - - - 1
R-HEAT-SHRUB-001 utility.heat shrub 1.0 outer_wall forbid SP42_13330_2016 - - - - 1
R-HEAT-TREE-002 utility.heat tree 2.0 axis forbid PP623 - tilia,acer - - 0
R-HEAT-TREE-003 utility.heat tree 4.0 axis forbid PP623 - populus,crataegus,larix,betula - - 0
R-HEAT-SHRUB-002 utility.heat shrub 2.0 axis forbid PP623 - syringa,lonicera - - 0
R-HEAT-SHRUB-003 utility.heat shrub 4.0 axis forbid PP623 - cotoneaster,cornus,crataegus - - 0
R-WATER-TREE-001 utility.water tree 2.0 outer_wall forbid SP42_13330_2016 - - - - 1
R-DRAIN-TREE-001 utility.drain tree 2.0 outer_wall forbid SP42_13330_2016 - - - - 1
R-POWER-TREE-001 utility.power_cable tree 2.0 outer_wall forbid SP42_13330_2016 - - - - 1
R-POWER-SHRUB-001 utility.power_cable shrub 0.7 outer_wall forbid SP42_13330_2016 2016 - - - 1
R-TELECOM-TREE-001 utility.telecom tree 2.0 outer_wall forbid SP42_13330_2016 2016 - - - 1
R-POWER-SHRUB-002 utility.power_cable shrub 0.75 outer_wall forbid SP42_13330_2026 2026 - - - 0
R-TELECOM-TREE-002 utility.telecom tree 1.5 outer_wall forbid RD45_120_2000 2026 - - - 0
R-TELECOM-SHRUB-001 utility.telecom shrub 0.7 outer_wall forbid SP42_13330_2016 2016 - - - 1
R-UTILUNK-TREE-001 utility.unknown tree 2.0 outer_wall forbid PROJECT - - - - 1
R-UTILUNK-SHRUB-001 utility.unknown shrub 1.0 outer_wall forbid PROJECT - - - - 1
R-ACCESS-TREE-001 utility.access tree 2.0 axis forbid PROJECT - - - - 0
R-EXTREE-TREE-001 existing_tree tree 5.0 axis forbid PROJECT - - - - 0
R-OBST-TREE-001 obstacle tree 1.1 edge forbid PROJECT - - - - 0
R-OBST-SHRUB-001 obstacle shrub 0.5 edge forbid PROJECT - - - - 0
R-FENCE-TREE-001 fence tree 1.1 edge forbid PROJECT - - - - 0
R-FENCE-SHRUB-001 fence shrub 0.5 edge forbid PROJECT - - - - 0
R-EXSHRUB-TREE-001 existing_shrub tree 1.1 edge forbid PROJECT - - - - 0
R-EXSHRUB-SHRUB-001 existing_shrub shrub 0.5 edge forbid PROJECT - - - - 0
R-EXTREE-SHRUB-001 existing_tree shrub 1.0 axis forbid PROJECT - - - - 0
R-POLE-SHRUB-001 pole shrub 1.0 axis forbid PROJECT - - - - 1
R-ACCESS-SHRUB-001 utility.access shrub 0.5 edge forbid PROJECT - - - - 0
R-OHLZONE-TREE-001 zone.power_line tree 1.24 edge needs_approval PPRF160 - - - - 0
R-OHLZONE-SHRUB-001 zone.power_line shrub 0.5 edge needs_approval PPRF160 - - - - 0
R-GASAREA-TREE-001 zone.gas tree 1.24 edge needs_approval PPRF878 - - - - 0
R-GASAREA-SHRUB-001 zone.gas shrub 0.5 edge needs_approval PPRF878 - - - - 0
R-PARCEL-TREE-001 parcel.private tree 1.24 edge needs_approval GRK_RF - - - - 0
R-PARCEL-SHRUB-001 parcel.private shrub 0.5 edge needs_approval GRK_RF - - - - 0
R-MKD-TREE-001 parcel.residential tree 1.24 edge needs_approval ZHK_RF - - - - 0
R-MKD-SHRUB-001 parcel.residential shrub 0.5 edge needs_approval ZHK_RF - - - - 0
R-OHL-TREE-001 power_line_overhead tree 2.0 axis needs_approval PPRF160 - - - - 0
R-OHL-SHRUB-001 power_line_overhead shrub 2.0 axis needs_approval PPRF160 - - - - 0
"""

# Fixed values. Acts: id | short name.
_ACTS = """
SP42_13330_2016 | СП 42.13330.2016
SP42_13330_2026 | СП 42.13330.2026
RD45_120_2000 | РД 45.120-2000 (НТП 112-2000)
PP743 | 743-ПП
PP623 | 623-ПП (МГСН 1.02-02)
MGSN_1_01_99 | МГСН 1.01-99
PP369_2026 | 369-ПП
SP82_13330_2016 | СП 82.13330.2016
SP59_13330_2020 | СП 59.13330.2020
PP515 | 515-ПП
GOST_21_508_2020 | ГОСТ 21.508-2020
PPRF878 | ПП РФ № 878
GRK_RF | ГрК РФ
ZHK_RF | ЖК РФ
MINSTROY197 | Приказ Минстроя РФ № 197
PPRF160 | ПП РФ № 160
PROJECT | параметр проекта
"""

# Fixed values. Invasive list: rule_id | Latin name (one word is a whole genus) | group.
_INVASIVE = """
R-INV-AILANT-001 | Ailanthus altissima | 1
R-INV-HERACL-001 | Heracleum sosnowskyi | 1
R-INV-SOLCAN-001 | Solidago canadensis | 1
R-INV-SOLGIG-001 | Solidago gigantea | 1
R-INV-LUPPOL-001 | Lupinus polyphyllus | 1
R-INV-REYNOU-001 | Reynoutria | 1
R-INV-ACERNEG-001 | Acer negundo | 2
R-INV-AMORPH-001 | Amorpha fruticosa | 3
R-INV-PARTHE-001 | Parthenocissus inserta | 3
R-INV-CORALB-001 | Cornus alba | 3
R-INV-QUERUB-001 | Quercus rubra | 3
R-INV-AMESPI-001 | Amelanchier spicata | 3
R-INV-AMEALN-001 | Amelanchier alnifolia | 3
R-INV-HIPPOP-001 | Hippophae rhamnoides | 3
R-INV-JUGMAN-001 | Juglans mandshurica | 3
R-INV-PHYSOC-001 | Physocarpus opulifolius | 3
R-INV-ROBINI-001 | Robinia pseudoacacia | 3
R-INV-ROSRUG-001 | Rosa rugosa | 3
R-INV-SORBAR-001 | Sorbaria sorbifolia | 3
R-INV-PRUVIR-001 | Prunus virginiana | 3
R-INV-FRAPEN-001 | Fraxinus pennsylvanica | 3
"""

# Fixed values. Invasive groups: group -> (rule_id, territories where planting is conditional).
INVASIVE_GROUPS = [
    (1, "R-INVGROUP-ONE-001", []),
    (2, "R-INVGROUP-TWO-001", []),
    (3, "R-INVGROUP-THREE-001", ["green_fund"]),
    (4, "R-INVGROUP-FOUR-001", []),
]

# Fixed values. Restrictions of species by property: kind -> (rule_id, act).
RESTRICTIONS = [
    ("female_fluff", "R-PPSEVEN-FLUFF-001", "PP743"),
    ("fruit_litter", "R-PPSEVEN-LITTER-001", "PP743"),
    ("mass_allergen", "R-PPSEVEN-ALLERGEN-001", "PP743"),
    ("planting_category", "R-MGSN-CATEGORY-001", "PP623"),
    ("root_barrier", "R-BARRIER-ROOT-001", "SP42_13330_2016"),
]

# Fixed values. Lawn rules: rule_id, kind (None is any), act.
LAWN_RULES = [
    ("R-LAWN-KEPT-001", "kept", "PROJECT"),
    ("R-LAWN-NEW-001", "new", "PROJECT"),
    ("R-LAWN-FLOWER-001", "flowerbed", "PROJECT"),
    ("R-LAWN-DRAW-001", None, "GOST_21_508_2020"),
]

# Rules the strict profile switches off.
STRICT_DISABLED = ("R-GASZONE-TREE-001", "R-GASZONE-SHRUB-001", "R-HEATZONE-TREE-001", "R-HEATZONE-SHRUB-001")

# Fixed values of classes. A lid is not a line of the network.
HARD_CLASSES = ("road", "tram", "railway", "building", "sidewalk")
INTERIOR_CLASSES = ("obstacle", "zone.power_line", "zone.gas", "parcel.private", "parcel.residential")
SURFACE_BARRIERS = (
    "curb", "pavement_edge", "building", "fence", "lawn", "road", "sidewalk", "tram", "railway", "work_boundary", "contour",
)

RULE_SCHEMA = (
    "rule_id string, object_class string, planting_type string, min_distance_m double, measure_to string, "
    "severity string, act_id string, edition string, genera array<string>, min_crown_m double, "
    "traits array<string>, table91 boolean"
)


def distance_rule_rows() -> list[tuple]:
    rows = []
    for line in _DISTANCE.strip().splitlines():
        rid, cls, kind, dist, measure, severity, act, edition, genera, crown, trait, listed = line.split()
        rows.append((
            rid, cls, kind, float(dist), measure, severity, act, None if edition == "-" else edition,
            [] if genera == "-" else genera.split(","), None if crown == "-" else float(crown),
            [] if trait == "-" else [trait], listed == "1",
        ))
    return rows


def act_rows() -> list[tuple]:
    return [tuple(p.strip() for p in line.split("|")) for line in _ACTS.strip().splitlines()]


def invasive_rows() -> list[tuple]:
    rows = [[p.strip() for p in line.split("|")] for line in _INVASIVE.strip().splitlines()]
    return [(rid, latin, int(group)) for rid, latin, group in rows]


def distance_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(distance_rule_rows(), RULE_SCHEMA)


def acts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(act_rows(), "act_id string, short string")


def invasive(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(invasive_rows(), "rule_id string, species_lat string, grp int")


def sql_literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "cast([" + ",".join(sql_literal(v) for v in value) + "] as varchar[])"
    if isinstance(value, float):
        return f"cast({value} as double)"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    """``name(columns) as (values ...)`` for the checking SQL."""
    body = ",".join("(" + ",".join(sql_literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) as (values {body})"


def rules_sql(name: str = "rules") -> str:
    columns = "rule_id,object_class,planting_type,min_distance_m,measure_to,severity,act_id,edition,genera,min_crown_m,traits,table91"
    return sql_values(name, columns, distance_rule_rows())
