"""Extraction of plantings from a foreign plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAME_PLANTING_M = 0.05  # fixed values
MIN_STEM = 4
MIN_TREE_CROWN_M = 2.0

# Genera outside the catalogue that have one life form.
SHRUB_GENERA = (
    "бузина", "бересклет", "чубушник", "спирея", "кизильник", "пузыреплодник", "барбарис", "шиповник", "роза", "смородина",
    "жимолость", "лещина", "снежноягодник", "форзиция", "гортензия", "самшит", "магония", "дерен", "свидина", "лапчатка",
    "калина", "сирень", "айва", "миндаль", "облепиха",
)
TREE_GENERA = (
    "липа", "клен", "дуб", "ясень", "вяз", "береза", "тополь", "яблоня", "груша", "рябина", "черемуха", "каштан", "конский",
    "ольха", "лиственница", "ель", "сосна", "пихта", "платан", "орех", "гледичия", "катальпа", "бархат",
)


def local_layer(layer: Column) -> Column:
    """Layer without the prefix of a bound reference: what follows the last '|' or '$'."""
    return F.regexp_extract(layer, r"[^|$]+$", 0)


def plantings(features: DataFrame, pattern: str) -> DataFrame:
    """Points and circles of the planting layers; marks within 5 cm are one planting.

    Of the marks in one spot the first with a crown circle stays, else the first.
    """
    own = features.where(local_layer(F.col("layer")).rlike(f"(?i){pattern}"))
    shaped = own.where(F.col("kind").isin("point", "circle"))
    spot = [F.rint(F.col("x") / SAME_PLANTING_M).cast("long").alias("sx"), F.rint(F.col("y") / SAME_PLANTING_M).cast("long").alias("sy")]
    keyed = shaped.select("site_id", "feature_id", "layer", "x", "y", "crown_m", *spot)
    best = F.min_by(F.struct("feature_id", "layer", "x", "y", "crown_m"), F.struct(F.col("crown_m").isNull().cast("int"), F.col("feature_id")))
    return keyed.groupBy("site_id", "sx", "sy").agg(best.alias("p")).select("site_id", "p.*")


def skipped(features: DataFrame, pattern: str) -> DataFrame:
    own = features.where(local_layer(F.col("layer")).rlike(f"(?i){pattern}"))
    return own.where(~F.col("kind").isin("point", "circle")).groupBy("site_id", "kind").agg(F.count(F.lit(1)).alias("skipped"))


def genus_votes(layers: DataFrame, genera: DataFrame) -> DataFrame:
    """(layer, planting type) where every genus word of the layer name points to one type.

    Distinct layer names meet the genera on their first letters; a word of four letters or more
    may be the beginning of a genus or the other way round.
    """
    words = layers.select("layer", F.explode(F.array_distinct(F.split(F.translate(F.lower("layer"), "ё", "е"), r"[^0-9a-zа-я]+"))).alias("word")).where("word <> ''")
    head = lambda c: F.substring(c, 1, 1)
    dictionary = F.broadcast(genera.select("genus", "type", head("genus").alias("h")))  # a fixed word list
    fits = (F.col("word") == F.col("genus")) | ((F.length("word") >= MIN_STEM) & (F.col("genus").startswith(F.col("word")) | F.col("word").startswith(F.col("genus"))))
    hits = words.withColumn("h", head("word")).join(dictionary, "h").where(fits)
    return hits.groupBy("layer").agg(F.min("type").alias("type"), F.max("type").alias("_other"), F.min("genus").alias("genus")).where(F.col("type") == F.col("_other")).drop("_other")


def planting_type(layer: str = "layer", *, trees: str | None = None, shrubs: str | None = None, default: str = "tree") -> tuple[Column, Column]:
    """(type, basis): explicit layer patterns, own result layers, genus, crown circle, default."""
    name = local_layer(F.col(layer))
    kind, basis = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for pattern, value in ((shrubs, "shrub"), (trees, "tree")):
        if pattern:
            kind, basis = kind.when(name.rlike(f"(?i){pattern}"), value), basis.when(name.rlike(f"(?i){pattern}"), "layer_pattern")
    for prefix, value in (("GREEN_SHRUBS", "shrub"), ("GREEN_TREES", "tree")):
        own = F.upper(name).startswith(prefix)
        kind, basis = kind.when(own, value), basis.when(own, "own_layer")
    kind = kind.when(F.col("type").isNotNull(), F.col("type")).when(F.col("crown_m").isNull(), default).when(F.col("crown_m") >= MIN_TREE_CROWN_M, "tree").otherwise("shrub")
    basis = basis.when(F.col("type").isNotNull(), "genus").when(F.col("crown_m").isNull(), "default").otherwise("crown")
    return kind, basis
