"""Per-entity features kept by signed deltas.

State has one row per entity and event type: n, total, latest. A delta is an event with sign +1 (insert) or -1 (retract).
Counts and totals are added. A maximum cannot be subtracted from, so it is recomputed only for keys in which a
retraction reached the latest date and no insert of the same batch is at least as late.

Defined results: an entity reference that is null or blank has no row; a type that is null or not in the list counts
for nothing, but its entity still has a row; a null or impossible date (before 2000, or after the day it was
loaded) and a null or impossible score (outside 0..1) add nothing to latest and total, yet the event counts; an id
delivered again is retracted as it was and inserted as it is now; rows with a null id are no events. Empty tables give
an empty table with all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.ids import reference_key, squeeze
from orbweave.session import cut

EARLIEST = "2000-01-01"
#: Keys of eight or some sixty bytes; more of them are joined by shuffle.
BROADCAST_ROWS = 500_000


def clean_events(signals: DataFrame) -> DataFrame:
    """id, entity_id, kind, score, day, and version: the order in which deliveries of one id count."""
    kind = F.regexp_replace(F.lower(squeeze(F.col("signal_type"))), "-", "_")
    day = F.when((F.col("detected_date") >= F.lit(EARLIEST).cast("date")) & (F.col("detected_date") <= F.to_date("created_at")), F.col("detected_date"))
    score = F.when(F.col("confidence_score").between(0, 1), F.col("confidence_score"))
    return signals.filter(F.col("id").isNotNull()).select(
        F.col("id"), reference_key(F.col("entity_id")).alias("entity_id"), kind.alias("kind"), score.cast("decimal(3,2)").alias("score"), day.alias("day"),
        F.struct(F.col("updated_at"), F.col("created_at")).alias("version"),
    )


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are few; else left to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def split_deliveries(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First deliveries, the signed deltas of later ones, and the events as they stand.

    Only ids that came more than once need to be brought together. They are found by a count over 64-bit hashes, so the
    rows themselves are not shuffled; two ids with one hash are looked at as well, which changes nothing. Deltas between
    the first and the last delivery cancel out, so one retraction and one insertion per id remain.
    """
    flat = lambda c: [F.col(f"{c}.{x}").alias(x) for x in ("entity_id", "kind", "score", "day")]
    hashed = events.withColumn("h", F.xxhash64("id"))
    repeated = cut(hashed.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("h"))
    rows = repeated.count()
    once = hashed.join(_sized(repeated, rows), "h", "left_anti").select("entity_id", "kind", "score", "day")
    body = F.struct("version", "entity_id", "kind", "score", "day")
    ids = cut(hashed.join(_sized(repeated, rows), "h", "left_semi").groupBy("id").agg(F.min(body).alias("first"), F.max(body).alias("last"), F.count("*").alias("deliveries")))
    again = ids.filter(F.col("deliveries") > 1)
    deltas = again.select(*flat("first"), F.lit(-1).alias("sign")).unionByName(again.select(*flat("last"), F.lit(1).alias("sign")))
    return once.unionByName(ids.select(*flat("first"))), deltas, once.unionByName(ids.select(*flat("last")))


def summarise(events: DataFrame) -> DataFrame:
    """State from scratch: entity_id, kind, n, total, latest."""
    return events.filter(F.col("entity_id").isNotNull()).groupBy("entity_id", "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("score"), F.lit(0)).cast("decimal(18,2)").alias("total"), F.max("day").alias("latest"))


def apply_deltas(state: DataFrame, deltas: DataFrame, live: DataFrame) -> DataFrame:
    """State after deltas; live are the events as they stand, read only for keys whose latest event was retracted."""
    d = deltas.filter(F.col("entity_id").isNotNull()).groupBy("entity_id", "kind").agg(
        F.sum("sign").alias("dn"), F.sum(F.col("sign") * F.coalesce(F.col("score"), F.lit(0))).alias("dtotal"),
        F.max(F.when(F.col("sign") > 0, F.col("day"))).alias("ins"), F.max(F.when(F.col("sign") < 0, F.col("day"))).alias("ret"),
    ).withColumn("mark", F.lit(True))
    s, k = state.alias("s"), d.alias("d")
    both = s.join(k, (F.col("s.entity_id") == F.col("d.entity_id")) & F.col("s.kind").eqNullSafe(F.col("d.kind")), "full_outer").select(
        F.coalesce("s.entity_id", "d.entity_id").alias("entity_id"), F.when(F.col("d.mark"), F.col("d.kind")).otherwise(F.col("s.kind")).alias("kind"),
        (F.coalesce("s.n", F.lit(0)) + F.coalesce("d.dn", F.lit(0))).alias("n"), (F.coalesce("s.total", F.lit(0)) + F.coalesce("d.dtotal", F.lit(0))).cast("decimal(18,2)").alias("total"),
        F.greatest("s.latest", "d.ins").alias("top"), (F.coalesce(F.col("d.ret") >= F.col("s.latest"), F.lit(False)) & F.coalesce(F.col("d.ins") < F.col("s.latest"), F.lit(True))).alias("lost"),
    )
    both = cut(both)
    kept = both.filter(~F.col("lost")).select("entity_id", "kind", "n", "total", F.col("top").alias("latest"))
    lost = both.filter("lost").select(F.col("entity_id").alias("e"), F.col("kind").alias("k"))
    rows = lost.count()
    if rows:
        same = (F.col("entity_id") == F.col("e")) & F.col("kind").eqNullSafe(F.col("k"))
        again = live.join(_sized(lost, rows), same, "left_semi").groupBy(F.col("entity_id").alias("e"), F.col("kind").alias("k")).agg(F.max("day").alias("found"))
        kept = kept.unionByName(both.filter("lost").join(again, same, "left").select("entity_id", "kind", "n", "total", F.col("found").alias("latest")))
    return kept.filter(F.col("n") > 0)


def wide(state: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per entity: <type>_n, <type>_latest and <type>_total for each listed type; 0 and null where it has none."""
    at = F.struct(F.col("n"), F.col("latest"), F.col("total"))
    rows = state.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("kind").isin(kinds), F.struct(F.col("kind"), at)))).alias("m"))
    cols = []
    for k in kinds:
        v = F.col("m").getItem(k)
        cols += [F.coalesce(v["n"], F.lit(0)).cast("long").alias(f"{k}_n"), v["latest"].alias(f"{k}_latest"), F.coalesce(v["total"], F.lit(0)).cast("decimal(18,2)").alias(f"{k}_total")]
    return rows.select("entity_id", *cols)


def long(state: DataFrame, types: DataFrame) -> DataFrame:
    """The state of the listed types only, one row per entity and type."""
    return state.join(F.broadcast(types.select(F.col("signal_type").alias("kind")).distinct()), "kind").select("entity_id", F.col("kind").alias("signal_type"), "n", "latest", F.col("total").cast("decimal(18,2)").alias("total"))


def entity_features(signals: DataFrame) -> DataFrame:
    """The whole maintenance on one table: state of the first deliveries, then the deltas of the later ones."""
    first, deltas, live = split_deliveries(clean_events(signals))
    return apply_deltas(summarise(first), deltas, live)
