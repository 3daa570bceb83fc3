"""Decisions and accounting while layers, sheets and drawings come in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetgrove.operators import scan

# Fixed values.
ASSUMED_ERROR_M = 0.5
LONLAT_SPAN = 1.0
TRANSFORM_ERROR_M = 1.0
MIN_SITE_M, MAX_SITE_M, METRE_TEXT, UNITLESS_SPLIT, MIN_ANCHORS = 10.0, 100_000.0, 20.0, 10_000.0, 2
HEADER_ROWS = 40
SUMMARY_ROW = r"(?iu)всего|итого|кв\.?\s*м|трав\.|покров|деревьев|кустарников|газон"
NOT_SPECIES_ROW = r"(?iu)^\d|^выруб|^сохран|зона|^прим|^итог"
SERVICE_ROW = r"(?iu)инженер|дендролог|из них|аварийн|без компенс|неудовл|:\s*$"
REMOVE_MARK = r"(?iu)выруб|удал|снос"
UNIDENTIFIED = r"(?iu)самосев|поросл|пень|сухостой"


def layer_crs(layers: DataFrame, key: Sequence[str]) -> DataFrame:
    """Declared code first; lon/lat when all values are degrees and the span is at most one degree; else local."""
    bounds = layers.groupBy(*key).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("declared").alias("declared"), F.count(F.lit(1)).alias("objects"))
    degrees = (F.col("x0") >= -180) & (F.col("x1") <= 180) & (F.col("y0") >= -90) & (F.col("y1") <= 90) & (F.col("x1") - F.col("x0") <= LONLAT_SPAN) & (F.col("y1") - F.col("y0") <= LONLAT_SPAN)
    crs = F.when(F.col("declared").isNotNull(), F.col("declared")).when(degrees, "EPSG:4326").otherwise("local")
    return bounds.withColumn("crs", crs).withColumn("transform_error_m", F.when(F.col("crs") == "local", 0.0).otherwise(TRANSFORM_ERROR_M))


def attribute_rule(rules: Sequence[dict]) -> Column:
    """First rule whose conditions on file, any value and attribute all hold: struct(class, also, rule)."""
    cases = None
    for i, rule in enumerate(rules):
        test = F.lit(True)
        if rule.get("file"):
            test = test & F.col("file").rlike(rule["file"])
        if rule.get("any_value"):
            pattern = rule["any_value"]
            test = test & F.exists(F.map_values("properties"), lambda v: v.rlike(pattern))  # noqa: B023 - used at once
        if rule.get("attribute"):
            value = F.col("properties")[rule["attribute"]]
            test = test & value.isNotNull() & (value != "")
            if rule.get("value"):
                test = test & value.rlike(rule["value"])
        cls = F.col("properties")[rule["attribute"]] if rule["class"] == "from_attribute" else F.lit(rule["class"])
        hit = F.struct(cls.alias("cls"), F.lit(rule.get("also")).cast("string").alias("also"), F.lit(i).alias("rule"))
        cases = F.when(test, hit) if cases is None else cases.when(test, hit)
    return cases


def unit_scale(files: DataFrame) -> DataFrame:
    """Metres per drawing unit of each file from its header, extent and text height.

    ``files(file, header_m, x, y, text_h)``: anchors of the model, one row each.
    """
    stats = files.groupBy("file", "header_m").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("size"), F.count(F.lit(1)).alias("anchors"))
    heights = scan.order_statistics(files, "text_h", (0.5,), by=("file",)).select("file", F.col("q0").alias("text"))
    stats = stats.join(heights, "file", "left")
    size, text, header = F.col("size"), F.col("text"), F.col("header_m")
    enough = F.col("anchors") >= MIN_ANCHORS
    small_text, big_text = text.isNull() | (text < METRE_TEXT), text.isNull() | (text >= METRE_TEXT)
    metric = enough & (header < 1) & (size * header < MIN_SITE_M) & text.isNotNull() & (text < METRE_TEXT)
    not_metric = enough & (header >= 1) & (size * header > MAX_SITE_M) & big_text
    mm_explains = (size * 0.001 >= MIN_SITE_M) & (size * 0.001 <= MAX_SITE_M)
    guess_m = enough & (size >= MIN_SITE_M) & (size <= UNITLESS_SPLIT) & small_text
    guess_mm = enough & (size > UNITLESS_SPLIT) & (size * 0.001 <= MAX_SITE_M) & big_text
    how = (
        F.when(header.isNotNull() & metric, "conflict_m").when(header.isNotNull() & not_metric & mm_explains, "conflict_mm").when(header.isNotNull() & not_metric, "error")
        .when(header.isNotNull(), "header").when(guess_m, "guess_m").when(guess_mm, "guess_mm").when(size > UNITLESS_SPLIT, "fallback_mm").otherwise("fallback_m")
    )
    scale = F.when(how == "header", header).when(how.isin("conflict_m", "guess_m", "fallback_m"), 1.0).when(how == "error", F.lit(None)).otherwise(0.001)
    return stats.withColumn("how", how).withColumn("unit_m", scale)


def sheet_rows(sheet: DataFrame, key: str) -> DataFrame:
    """Rows of a census sheet below its header, with name, count and verdict picked by header words.

    ``sheet(key, row_no, cells array<string>)``. The header is the first of the first forty rows
    that says "Наименование".
    """
    lower = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    find = lambda word: F.array_position(F.transform("_l", lambda c: c.contains(word)), True)
    headers = sheet.where(F.col("row_no") < HEADER_ROWS).withColumn("_l", lower).withColumn("name_at", find("наименование")).where("name_at > 0")
    headers = headers.withColumn("count_at", find("кол")).withColumn("verdict_at", find("заклю"))
    first = headers.groupBy(key).agg(F.min(F.struct("row_no", "name_at", "count_at", "verdict_at")).alias("h"))
    rows = sheet.join(first, key).where(F.col("row_no") > F.col("h.row_no"))
    cell = lambda at: F.when(F.col(at) > 0, F.trim(F.coalesce(F.get("cells", F.col(at).cast("int") - 1), F.lit("")))).otherwise("")
    return rows.select(key, "row_no", cell("h.name_at").alias("name"), cell("h.count_at").alias("count_text"), cell("h.verdict_at").alias("verdict"))


def species_rows(rows: DataFrame) -> DataFrame:
    """Rows that name a plant, with a count (one when absent) and a removal flag."""
    name = F.col("name")
    service = (name == "") | name.rlike(SUMMARY_ROW) | name.rlike(NOT_SPECIES_ROW) | name.rlike(SERVICE_ROW)
    letters = F.length(F.regexp_replace(F.lower(name), "[^а-яa-z]", "")) >= 3
    number = F.floor(F.expr("try_cast(replace(count_text, ',', '.') as double)")).cast("long")
    counted = F.when(number > 0, number)
    return rows.where(~service & letters).withColumn("removed", F.col("verdict").rlike(REMOVE_MARK)).withColumn("without_count", counted.isNull()).withColumn("n", F.coalesce(counted, F.lit(1)))


def plant_name(name: Column) -> Column:
    """Normal form of a plant name: no cultivar, brackets or noise words."""
    text = F.regexp_replace(name, r"[\"'«][^\"'»]*[\"'»]|\([^)]*\)", "")
    text = F.translate(F.lower(text), "ё", "е")
    text = F.regexp_replace(text, r"(?u)(?<![а-яa-z0-9_])(?:куст|дер|шт|с\d+)(?![а-яa-z0-9_])|крупномер", "")
    return F.trim(F.regexp_replace(text, "[^а-яa-z]+", " "))


def match_plants(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue code of every name: two words, then one, then the genus (approximate).

    ``catalog(code, name, rank)``: the best-ranked entry owns a key. Distinct names are matched once.
    """
    entries = catalog.withColumn("norm", plant_name(F.col("name"))).where("norm <> ''")
    words = F.split("norm", " ")
    keys = entries.select("code", "rank", F.explode(F.array_distinct(F.array("norm", F.concat_ws(" ", F.slice(words, 1, 2))))).alias("key"))
    exact = keys.groupBy("key").agg(F.min(F.struct("rank", "code")).alias("e")).select("key", F.col("e.code").alias("code"))
    genus = entries.select("code", "rank", words[0].alias("key")).groupBy("key").agg(F.min(F.struct("rank", "code")).alias("e")).select("key", F.col("e.code").alias("genus_code"))
    names = rows.select("name").distinct().withColumn("norm", plant_name(F.col("name")))
    split = names.withColumn("two", F.concat_ws(" ", F.slice(words, 1, 2))).withColumn("one", words[0]).withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(F.size(words)))
    hit = (
        split.join(exact.select(F.col("key").alias("two"), F.col("code").alias("c2")), "two", "left").join(exact.select(F.col("key").alias("one"), F.col("code").alias("c1")), "one", "left")
        .join(genus.withColumnRenamed("key", "one"), "one", "left")
    )
    lost = (F.col("norm") == "") | F.col("norm").rlike(UNIDENTIFIED)
    code = F.when(lost, F.lit(None)).otherwise(F.coalesce("c2", "c1", "genus_code"))
    sure = ~lost & (F.col("c2").isNotNull() | (F.col("c1").isNotNull() & (F.col("n_words") == 1)))
    return hit.select("name", code.alias("code"), sure.alias("exact"))
