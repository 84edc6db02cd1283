"""Input tables of the corpus queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with only the columns that the operators read."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A small table of literals (one row at least), inside the plan."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("_row")).select("_row.*")
