"""Strategies of the notional fund: selection criteria, vintages of positions, and their removal with all that hangs on them.

A null in a compared column fails every criterion on it; a criterion that is not known is an error, so none is ignored silently. Ties in
the score are settled by entity_id. Empty pools, strategies without anyone eligible and vintages that are not there give no rows.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns behind the numeric criteria, as `min_` and `max_`.
MEASURES = {"p2": "p2_n", "sbir": "sbir_n", "private": "regd_n", "contracts": "contract_n", "composite": "composite"}
#: Columns behind the criteria that list the accepted values.
LISTS = ("core_business", "entity_type")


def criterion(criteria: dict) -> Column:
    """All criteria of a strategy as one condition; no criteria accept everyone."""

    def one(name: str, value) -> Column:
        if name in LISTS:
            return F.col(name).isin(*value) if value else F.lit(False)
        side, _, measure = name.partition("_")
        if side not in ("min", "max") or measure not in MEASURES:
            raise ValueError(f"unknown criterion {name}")
        c = F.col(MEASURES[measure])
        return c >= value if side == "min" else c <= value

    return F.coalesce(functools.reduce(lambda a, b: a & b, (one(k, v) for k, v in criteria.items()), F.lit(True)), F.lit(False))


def strategies(text: str) -> list[dict]:
    """Strategies from their JSON file: name, status, target_cohort_size, selection_criteria; the first of a name holds."""
    kept: dict[str, dict] = {}
    for s in json.loads(text):
        kept.setdefault(s["name"], s)
    return list(kept.values())


def activated(plans: list[dict], name: str) -> list[dict]:
    """The strategies with one of them made active."""
    return [s | {"status": "ACTIVE"} if s["name"] == name else s for s in plans]


def picks(pool: DataFrame, plans: list[dict], vintage: str) -> DataFrame:
    """Positions (strategy, vintage, entity_id, composite, rank) of every active strategy: its best by composite, up to its size.

    One pass over the pool. The limit on rank is a literal, so each task keeps only its own best before the shuffle and a strategy that
    accepts everyone is no hot group. entity_id must be unique in the pool; rows without one are not eligible.
    """
    live = [s for s in plans if s.get("status") == "ACTIVE"]
    if not live:
        return pool.limit(0).select(F.lit("").alias("strategy"), F.lit(vintage).alias("vintage"), "entity_id", "composite", F.lit(0).alias("rank"))
    size = F.create_map(*[F.lit(x) for s in live for x in (s["name"], int(s.get("target_cohort_size", 20)))])
    named = F.filter(F.array(*[F.when(criterion(s["selection_criteria"]), F.lit(s["name"])) for s in live]), lambda x: x.isNotNull())
    best = Window.partitionBy("strategy").orderBy(F.desc("composite"), "entity_id")
    d = pool.filter("entity_id IS NOT NULL").select("entity_id", "composite", F.explode(named).alias("strategy")).withColumn("rank", F.row_number().over(best))
    d = d.filter(F.col("rank") <= max(int(s.get("target_cohort_size", 20)) for s in live)).filter(F.col("rank") <= size[F.col("strategy")])
    return d.select("strategy", F.lit(vintage).alias("vintage"), "entity_id", "composite", "rank")


def deployed(standing: DataFrame, found: DataFrame) -> DataFrame:
    """Standing positions with those of new vintages; a vintage that a strategy already has is left as it stands."""
    there = standing.select("strategy", "vintage").distinct()
    return standing.unionByName(found.join(there, ["strategy", "vintage"], "left_anti"))


def milestones(positions: DataFrame, events: DataFrame) -> DataFrame:
    """Events (entity_id, kind, day) of each position from the events of all entities. Positions are bounded by the strategies' sizes."""
    p = F.broadcast(positions.select("strategy", "vintage", "entity_id"))
    return events.select("entity_id", "kind", "day").join(p, "entity_id")


def dropped(strategy: str, vintage: str, *children: DataFrame) -> list[DataFrame]:
    """Each frame (positions, milestones and so on) without the rows of one vintage of a strategy."""
    gone = F.col("strategy").eqNullSafe(strategy) & F.col("vintage").eqNullSafe(vintage)
    return [d.filter(~gone) for d in children]


def listing(spark: SparkSession, plans: list[dict], positions: DataFrame) -> DataFrame:
    """One row per strategy with its state, size, vintages and positions, those without any as zero."""
    known = spark.createDataFrame([(s["name"], s.get("status", "DRAFT"), int(s.get("target_cohort_size", 20))) for s in plans], "strategy string, status string, size int")
    n = positions.groupBy("strategy").agg(F.count_distinct("vintage").alias("vintages"), F.count("*").alias("positions"))
    return known.join(n, "strategy", "left").na.fill(0, ["vintages", "positions"])
