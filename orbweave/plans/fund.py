"""Queries of fund strategies and their vintages, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import fund as N
from orbweave.operators import scoring as S
from orbweave.plans.analytics import _UN
from orbweave.plans.registry import Registry
from orbweave.sources import views as V

query = Registry()

#: A strategies file; `untapped` becomes active in `_plans`, `later` stays a draft.
STRATEGIES = """[
 {"name": "next_wave", "status": "ACTIVE", "target_cohort_size": 20, "selection_criteria": {"entity_type": ["STARTUP"], "min_p2": 1, "min_composite": 2}},
 {"name": "untapped", "status": "DRAFT", "target_cohort_size": 15, "selection_criteria": {"entity_type": ["STARTUP", "NON_DEFENSE"], "min_sbir": 2, "max_private": 0}},
 {"name": "later", "status": "DRAFT", "selection_criteria": {"max_contracts": 0}}
]"""
VINTAGE = "2026-Q1"

_PO = _UN + """, po AS (SELECT pr.*, coalesce(composite, 0)::DOUBLE AS score FROM pr LEFT JOIN comp USING (entity_id)),
pk AS (SELECT strategy, '2026-Q1' AS vintage, entity_id, score AS composite, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, entity_id) r FROM (
 SELECT 'next_wave' strategy, 20 k, entity_id, score FROM po WHERE entity_type = 'STARTUP' AND p2_n >= 1 AND score >= 2
 UNION ALL SELECT 'untapped', 15, entity_id, score FROM po WHERE entity_type IN ('STARTUP', 'NON_DEFENSE') AND sbir_n >= 2 AND regd_n <= 0)) WHERE r <= k),
ml AS (SELECT pk.strategy, pk.vintage, x.kind FROM (SELECT entity_id, 'NEW_CONTRACT' kind FROM c WHERE award_date >= DATE '2025-03-01' UNION ALL SELECT entity_id, 'FUNDING_RAISE' FROM f WHERE event_type IN ('REG_D_FILING', 'VC_ROUND') AND event_date >= DATE '2025-03-01') x JOIN pk USING (entity_id))"""


def _plans() -> list[dict]:
    return N.activated(N.strategies(STRATEGIES), "untapped")


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Active entities with the measures that criteria ask for; entities without signals have a composite of 0."""
    d = S.profile(spark, sf).select("entity_id", "entity_type", "core_business", "p2_n", "sbir_n", "regd_n", "contract_n")
    return d.join(S.composite(spark, sf).select("entity_id", "composite"), "entity_id", "left").na.fill(0.0, ["composite"])


def _events(spark: SparkSession, sf: str) -> DataFrame:
    since = F.lit("2025-03-01").cast("date")
    m = V.contracts(spark, sf).filter(F.col("award_date") >= since).select("entity_id", F.lit("NEW_CONTRACT").alias("kind"), F.col("award_date").alias("day"))
    return m.unionByName(V.funding(spark, sf).filter(F.col("event_type").isin("REG_D_FILING", "VC_ROUND") & (F.col("event_date") >= since)).select("entity_id", F.lit("FUNDING_RAISE").alias("kind"), F.col("event_date").alias("day")))


query("fnd_vintages", _PO + " SELECT strategy, vintage, entity_id, composite, rank FROM pk")(lambda s, d: N.picks(pool(s, d), _plans(), VINTAGE))


@query("fnd_strategies", _PO + " SELECT strategy, status, size, (SELECT count(DISTINCT vintage) FROM pk WHERE pk.strategy = k.strategy)::BIGINT AS vintages, (SELECT count(*) FROM pk WHERE pk.strategy = k.strategy)::BIGINT AS positions FROM (VALUES ('next_wave', 'ACTIVE', 20), ('untapped', 'ACTIVE', 15), ('later', 'DRAFT', 20)) k(strategy, status, size)")
def _strategies(spark: SparkSession, sf: str) -> DataFrame:
    """The strategies with what they hold."""
    return N.listing(spark, _plans(), N.picks(pool(spark, sf), _plans(), VINTAGE))


@query("fnd_vintage_dropped", _PO + " SELECT strategy, vintage, kind, count(*)::BIGINT AS n FROM ml WHERE strategy <> 'untapped' GROUP BY 1, 2, 3")
def _dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Milestones by kind that stay once the vintage of one strategy is dropped with its positions and milestones."""
    p = N.picks(pool(spark, sf), _plans(), VINTAGE)
    (positions,) = N.dropped("untapped", VINTAGE, p)
    return N.milestones(positions, _events(spark, sf)).groupBy("strategy", "vintage", "kind").agg(F.count("*").alias("n"))


def queries() -> dict:
    return dict(query.calls)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
