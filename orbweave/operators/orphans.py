"""Orphan references: rows whose reference names nothing, names a deleted row, or came before the row it names.

Keys are split by weight. References are pre-aggregated per table, key and period; keys that hold more than a fixed
fraction of all references are heavy. There are at most 1/fraction heavy keys, whatever the input, so their checks are
broadcast; all other keys go through a shuffle join in which no key can be large. Both parts are united.

Nulls and ties: null or blank references are no references and give no row; rows with a null id are counted in the
report and left out of the row list; a null created_at on either side is never late; the same row delivered twice
counts once; repeated parents count from their earliest created_at. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.ids import reference_key
from orbweave.session import cut

HEAVY_FRACTION = 1e-4


def references(children: dict[str, DataFrame], ref: str = "entity_id", id_col: str = "id", at: str = "created_at") -> DataFrame:
    """The non-blank references of all child tables: table_name, id, key, created_at."""
    out = None
    for name, df in children.items():
        part = df.select(F.lit(name).alias("table_name"), F.col(id_col).alias("id"), reference_key(F.col(ref)).alias("key"), F.col(at).alias("created_at")).filter(F.col("key").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def _parents(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """One row per known key: created_at of the live row (null if there is none), whether it was deleted by a merge."""
    live = entities.select(reference_key(F.col("id")).alias("key"), F.col("created_at").alias("parent_at"), F.lit(True).alias("live"), F.lit(False).alias("gone"))
    gone = merges.select(reference_key(F.col("source_entity_id")).alias("key"), F.lit(None).cast("timestamp_ntz").alias("parent_at"), F.lit(False).alias("live"), F.lit(True).alias("gone"))
    return live.withColumn("parent_at", F.col("parent_at").cast("timestamp_ntz")).unionByName(gone).filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("parent_at").alias("parent_at"), F.max("live").alias("live"), F.max("gone").alias("gone"))


def _verdict() -> F.Column:
    return F.when(F.coalesce(F.col("live"), F.lit(False)), F.lit("live")).when(F.coalesce(F.col("gone"), F.lit(False)), F.lit("deleted")).otherwise(F.lit("missing"))


def _suspects(keys: DataFrame, entities: DataFrame, merges: DataFrame, fraction: float) -> tuple[DataFrame, DataFrame]:
    """Suspect keys with their verdict, light and heavy. keys: key, n, first_at; written out once, as all else hangs on it."""
    keys = cut(keys)
    total = keys.agg(F.sum("n").alias("total"))  # one row
    weighed = keys.crossJoin(F.broadcast(total)).withColumn("heavy", F.col("n") > F.greatest(F.lit(1000.0), F.col("total") * fraction))
    heavy = weighed.filter("heavy").select("key", "first_at")
    light = weighed.filter("not heavy").select("key", "first_at")
    parents = _parents(entities, merges)
    known_heavy = parents.join(F.broadcast(heavy.select("key")), "key", "left_semi")  # at most 1/fraction rows
    suspect = (F.col("verdict") != "live") | (F.col("parent_at") > F.col("first_at"))
    light_bad = light.join(parents, "key", "left").withColumn("verdict", _verdict()).filter(suspect).select("key", "parent_at", "verdict", F.lit(False).alias("heavy"))
    heavy_bad = heavy.join(F.broadcast(known_heavy), "key", "left").withColumn("verdict", _verdict()).filter(suspect).select("key", "parent_at", "verdict", F.lit(True).alias("heavy"))
    bad = cut(light_bad.unionByName(heavy_bad))
    return bad.filter("not heavy").drop("heavy"), bad.filter("heavy").drop("heavy")


def _joined(rows: DataFrame, light_bad: DataFrame, heavy_bad: DataFrame) -> DataFrame:
    """Rows of suspect keys: heavy keys by a broadcast of their few verdicts, the rest by shuffle; heavy rows never reach the shuffle."""
    heavy = rows.join(F.broadcast(heavy_bad), "key")
    light = rows.join(F.broadcast(heavy_bad.select("key")), "key", "left_anti").join(light_bad, "key")
    return heavy.unionByName(light)


def orphan_rows(refs: DataFrame, entities: DataFrame, merges: DataFrame, fraction: float = HEAVY_FRACTION) -> DataFrame:
    """(table_name, id, kind) of each distinct child id whose reference had nothing to point at: missing, deleted or late."""
    keys = refs.groupBy("key").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"))
    light_bad, heavy_bad = _suspects(keys, entities, merges, fraction)
    kind = F.when(F.col("verdict") != "live", F.col("verdict")).when(F.col("parent_at") > F.col("created_at"), F.lit("late"))
    return _joined(refs.filter(F.col("id").isNotNull()), light_bad, heavy_bad).select("table_name", "id", kind.alias("kind")).filter(F.col("kind").isNotNull()).distinct()


def orphan_report(refs: DataFrame, entities: DataFrame, merges: DataFrame, fraction: float = HEAVY_FRACTION) -> DataFrame:
    """Counts per table, month of created_at and kind, with the month's references beside them.

    Works on the pre-aggregated groups: a group all of whose rows are late, or none, needs no row. Only the one month in
    which a parent appeared is counted row by row. `references` and `orphans` count deliveries, not distinct ids.
    """
    groups = cut(refs.groupBy("table_name", "key", F.date_trunc("month", "created_at").alias("period")).agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")))
    light_bad, heavy_bad = _suspects(groups.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at")), entities, merges, fraction)
    bad = _joined(groups, light_bad, heavy_bad)
    whole = bad.select("table_name", "period", F.when(F.col("verdict") != "live", F.col("verdict")).when(F.col("parent_at") > F.col("last_at"), F.lit("late")).alias("kind"), "n").filter(F.col("kind").isNotNull())
    edge = (F.col("verdict") == "live") & (F.col("parent_at") > F.col("first_at"))
    rows = _joined(refs, light_bad.filter(F.col("verdict") == "live"), heavy_bad.filter(F.col("verdict") == "live"))
    mixed = (
        rows.filter((F.col("parent_at") > F.col("created_at")) & (F.date_trunc("month", "parent_at") == F.date_trunc("month", "created_at")))
        .groupBy("table_name", F.date_trunc("month", "created_at").alias("period"), "key").agg(F.count("*").alias("late"))
        .join(bad.filter(edge & ~(F.col("parent_at") > F.col("last_at"))).select("table_name", "period", "key"), ["table_name", "period", "key"], "left_semi")
        .select("table_name", "period", F.lit("late").alias("kind"), F.col("late").alias("n"))
    )
    orphans = whole.unionByName(mixed).groupBy("table_name", "period", "kind").agg(F.sum("n").cast("long").alias("orphans"))
    totals = groups.groupBy("table_name", "period").agg(F.sum("n").cast("long").alias("references"))
    return orphans.join(totals, ["table_name", "period"]).select("table_name", F.to_date("period").alias("period"), "kind", "orphans", "references")
