"""GeoJSON layers: FeatureCollection, Feature or a bare geometry, as rows of (geometry, properties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Coordinates stay text until the type is known: their depth depends on it.
_GEOMETRY = "struct<type:string,coordinates:string>"
_FEATURE = f"struct<type:string,geometry:{_GEOMETRY},properties:map<string,string>>"
_DOCUMENT = f"struct<type:string,features:array<{_FEATURE}>,geometry:{_GEOMETRY},properties:map<string,string>,coordinates:string,crs:struct<properties:struct<name:string>>>"


def records(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per feature with a geometry; every other column of ``documents`` is kept."""
    doc = F.from_json(F.col(text), _DOCUMENT)
    rows = documents.withColumn("_d", doc)
    one = F.struct(F.lit("Feature").alias("type"), F.col("_d.geometry").alias("geometry"), F.col("_d.properties").alias("properties"))
    bare = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("_d.type").alias("type"), F.col("_d.coordinates").alias("coordinates")).alias("geometry"),
        F.create_map().cast("map<string,string>").alias("properties"))
    features = F.when(F.col("_d.type") == "FeatureCollection", F.col("_d.features")).when(F.col("_d.type") == "Feature", F.array(one)).when(F.col("_d.type").isNotNull(), F.array(bare))
    out = rows.withColumn("_f", F.explode(features)).where(F.col("_f.geometry").isNotNull())
    return out.select(
        *[c for c in documents.columns if c != text], F.col("_d.crs.properties.name").alias("declared_crs"),
        F.col("_f.geometry.type").alias("geometry_type"), F.col("_f.geometry.coordinates").alias("coordinates"), F.col("_f.properties").alias("properties"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, one document per file, with the file name as the layer."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("layer"))
    return records(files)


def rings(rows: DataFrame) -> DataFrame:
    """Vertices of all geometries as segments (x1, y1, x2, y2) with ring and position; rings of several polygons are
    numbered on, and a point is a segment of no length."""
    parsed = lambda depth: F.from_json(F.col("coordinates"), "array<" * depth + "double" + ">" * depth)
    kind, dot = F.col("geometry_type"), lambda p: F.array(p, p)
    parts = (
        F.when(kind.isin("Polygon", "MultiLineString"), parsed(3)).when(kind == "MultiPolygon", F.flatten(parsed(4))).when(kind == "LineString", F.array(parsed(2)))
        .when(kind == "MultiPoint", F.transform(parsed(2), dot)).when(kind == "Point", F.array(dot(parsed(1))))
    )
    rows = rows.select("*", F.posexplode(parts).alias("ring_id", "_ring"))
    vertices = rows.where(F.size("_ring") >= 2).select("*", F.explode(F.sequence(F.lit(0), F.size("_ring") - 2)).alias("seg_no"))
    at = lambda i, c: F.get(F.get(F.col("_ring"), i), F.lit(c))
    return vertices.select(
        *[c for c in rows.columns if c not in ("_ring", "coordinates")], "seg_no", at(F.col("seg_no"), 0).alias("x1"), at(F.col("seg_no"), 1).alias("y1"),
        at(F.col("seg_no") + 1, 0).alias("x2"), at(F.col("seg_no") + 1, 1).alias("y2"))


def feature_text(ring: Column, properties: Column) -> Column:
    """One GeoJSON feature of a polygon as a line of text: the sink writes these with ``write.text``."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
