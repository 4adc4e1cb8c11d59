"""The given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, tables: tuple[str, ...], args: dict | None = None) -> DataFrame:
    """A statement over tables of a scale folder, named in it in braces; values go in as :name."""
    return spark.sql(text, args=args or {}, **{t: table(spark, sf_dir, t) for t in tables})
