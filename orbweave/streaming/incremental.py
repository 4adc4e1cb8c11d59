"""Structured Streaming forms: deduplicated ingest, windowed counts, sessions, features kept by micro-batches of deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators import deltas


def deduplicated(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Events of a stream, each natural key once within the lateness allowed."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))


def keep_features(state_path: str):
    """A foreachBatch function: folds signed deltas (entity_id, kind, score, day, sign) into a kept state.

    Kept are the features of `deltas` and, for maxima that a retraction undoes, the standing events of each key and day as
    counts. Two folders take turns, so a batch that fails leaves the last state whole and can be run again. Batch 0 starts from nothing;
    every later one needs the state before it and fails without it.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark, before, now = batch.sparkSession, (number + 1) % 2, number % 2
        signed = batch.select("entity_id", "kind", "score", "day", "sign").filter(F.col("entity_id").isNotNull())
        days = signed.filter(F.col("day").isNotNull()).groupBy("entity_id", "kind", "day").agg(F.sum("sign").alias("n"))
        if number:
            state, standing = spark.read.parquet(f"{state_path}/{before}"), spark.read.parquet(f"{state_path}/days-{before}")
            days = standing.unionByName(days).groupBy("entity_id", "kind", "day").agg(F.sum("n").alias("n"))
        else:
            state = deltas.summarise(signed.limit(0))
        days.filter("n <> 0").write.mode("overwrite").parquet(f"{state_path}/days-{now}")
        live = spark.read.parquet(f"{state_path}/days-{now}").filter("n > 0")
        deltas.apply_deltas(state, signed, live).write.mode("overwrite").parquet(f"{state_path}/{now}")

    return fold
