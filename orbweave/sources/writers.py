"""Sinks on plain Parquet: append, rebuild, keyed upserts as a staged overwrite, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def upserted(current: DataFrame, changes: DataFrame, key: str, update: list[str] | None = None) -> DataFrame:
    """current with changes by natural key: new rows added, known rows replaced or, if `update` is given, in those columns only."""
    changes = changes.dropDuplicates([key])
    if update is None:
        return current.join(changes.select(key), key, "left_anti").unionByName(changes)
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in update], F.lit(True).alias("_hit"))
    kept = current.join(c, key, "left").select(*[F.when(F.col("_hit"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in update else F.col(x) for x in current.columns])
    return kept.unionByName(changes.join(current.select(key), key, "left_anti").select(*current.columns))


def unseen(changes: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not there yet, each key once: for idempotent inserts."""
    return changes.dropDuplicates([key]).join(current.select(key), key, "left_anti")


def merged_signals(active: DataFrame, found: DataFrame) -> DataFrame:
    """Upsert by (entity, type): evidence and confidence change only if the evidence differs, the first date stays."""
    k = ["entity_id", "signal_type"]
    a = active.select(*k, *[F.col(c).alias(f"a_{c}") for c in ("confidence", "detected_date", "evidence")])
    differs = F.col("a_evidence").isNull() | ~F.col("a_evidence").eqNullSafe(F.col("evidence"))
    pick = lambda c: F.when(F.col("evidence").isNotNull() & differs, F.col(c)).otherwise(F.coalesce(F.col(f"a_{c}"), F.col(c))).alias(c)
    return a.join(found, k, "full_outer").select(*k, pick("confidence"), F.coalesce("a_detected_date", "detected_date").alias("detected_date"), pick("evidence"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A report table; only the given number of rows comes to the driver."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()])
