"""Polygon layers from GeoJSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = "array<double>"
RING = f"array<{POSITION}>"
FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
#: A collection or a single feature.
TEXT = FEATURE.replace("type:string,", f"type:string,features:array<{FEATURE}>,", 1)


def read_polygons(spark: SparkSession, path: str, names: Sequence[str] = ("name", "tectonic_domain")) -> DataFrame:
    """Polygons of GeoJSON files, in the order of file and feature."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
    return polygons(texts, "value", names, ["source"])


def polygons(texts: DataFrame, text: str = "value", names: Sequence[str] = ("name",), order: Sequence[str] = ()) -> DataFrame:
    """One row for each polygon or multipolygon: the columns of ``order``, ``at`` (its place in the
    text), ``name`` (the first of the properties ``names`` that is there), and ``rings``.

    A text is a collection or a single feature. Other geometries, and features
    without a name, are left out; rings of one feature are those of all its parts,
    holes among them.
    """
    # What explode returns is not made again by a column that uses it, so each text is parsed once.
    parsed = texts.select(*order, F.explode(F.array(F.from_json(text, TEXT))).alias("t"))
    single = F.struct("t.type", "t.properties", "t.geometry")
    features = F.when(F.col("t.features").isNotNull(), F.col("t.features")).otherwise(F.array(single))
    found = parsed.select(*order, F.posexplode(features).alias("at", "f"))
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(coordinates, f"array<{RING}>")).when(
        kind == "MultiPolygon", F.flatten(F.from_json(coordinates, f"array<array<{RING}>>"))
    )
    name = F.coalesce(*[F.col("f.properties")[n] for n in names])
    made = found.select(*order, "at", name.alias("name"), F.explode(F.array(rings)).alias("rings"))
    return made.filter("name is not null and rings is not null")
