"""Queries of scores, graph, vectors, history, cohorts, reports, audit and staging, each with its checking SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions.scalars import money, phase, round_stage
from orbweave.operators import graph as G
from orbweave.operators import scoring as S
from orbweave.operators import vectors as X
from orbweave.operators.detectors import agency_key, superseded
from orbweave.plans.detection import _AG, _PH, _SB
from orbweave.sources import views as V
from orbweave.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_B = V.BASE_SQL
_W = _B + ", w(base_type, weight, profile) AS (VALUES " + ", ".join(f"('{k}', {w}::DECIMAL(3,1), '{d}')" for k, (w, d) in S.WEIGHTS.items()) + """),
ws AS (SELECT entity_id, base_type, b.confidence::DECIMAL(3,2) confidence, detected_date, weight, profile, CASE WHEN profile = 'NONE' THEN 1.0 WHEN detected_date IS NULL THEN 0.5
  WHEN profile = 'FAST' THEN CASE WHEN age <= 182 THEN 1 WHEN age <= 365 THEN 0.7 WHEN age <= 730 THEN 0.4 ELSE 0.2 END ELSE CASE WHEN age <= 365 THEN 1 WHEN age <= 730 THEN 0.85 WHEN age <= 1095 THEN 0.65 ELSE 0.4 END END::DECIMAL(3,2) fresh
  FROM (SELECT *, DATE '2026-03-01' - detected_date age FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, base_type ORDER BY confidence DESC, detected_date DESC NULLS LAST) r FROM s WHERE status = 'ACTIVE' AND entity_id IS NOT NULL AND confidence IS NOT NULL) WHERE r = 1) b JOIN w USING (base_type)),
comp AS (SELECT entity_id, round(sum(weight * confidence), 2)::DOUBLE composite, round(sum(weight * confidence * fresh), 2)::DOUBLE fresh_composite, round(coalesce(sum(weight * confidence) FILTER (weight > 0), 0), 2)::DOUBLE positive, round(coalesce(sum(weight * confidence) FILTER (weight < 0), 0), 2)::DOUBLE negative, count(*)::BIGINT signals, round(sum(confidence), 2)::DOUBLE confidence_sum FROM ws GROUP BY 1)"""
_PR = _PH + """, cc AS (SELECT entity_id, count(*) contract_n, coalesce(sum(contract_value), 0)::DOUBLE contract_total, count(*) FILTER (procurement_type='ota') ota_n, count(*) FILTER (procurement_type='standard') standard_n, count(DISTINCT contracting_agency) agencies, max(award_date) last_award FROM c GROUP BY 1),
pr AS (SELECT e.id AS entity_id, entity_type, core_business, coalesce(p1_n,0) p1_n, coalesce(p2_n,0) p2_n, coalesce(regd_n,0) regd_n, coalesce(sbir_n,0) sbir_n, coalesce(sbir_total,0) sbir_total, sbir_first, regd_first, p2_last, sbir_last_x, coalesce(contract_n,0) contract_n, coalesce(contract_total,0) contract_total, coalesce(ota_n,0) ota_n, coalesce(standard_n,0) standard_n, coalesce(agencies,0) agencies, last_award
 FROM act e LEFT JOIN (SELECT *, greatest(p1_last, p2_last, p3_last) sbir_last_x FROM ph) ph ON ph.entity_id = e.id LEFT JOIN cc ON cc.entity_id = e.id)"""


# scores
query("scr_composite", _W + " SELECT * FROM comp")(S.composite)
query("scr_freshness", _W + " SELECT base_type, fresh, count(*)::BIGINT AS n FROM ws GROUP BY 1, 2")(lambda s, d: S.weighed_signals(s, d).groupBy("base_type", "fresh").agg(F.count("*").alias("n")))


@query("scr_stored_freshness", _B + ", w(base_type, weight) AS (VALUES " + ", ".join(f"('{k}', {w}::DECIMAL(3,1))" for k, (w, _) in S.WEIGHTS.items()) + ") SELECT entity_id, round(sum(weight * confidence * fw), 2)::DOUBLE AS score FROM (SELECT DISTINCT s.id, s.entity_id, s.base_type, s.confidence, coalesce(freshness_weight, 1)::DECIMAL(3,2) fw FROM s JOIN signals r USING (id) WHERE s.status = 'ACTIVE' AND s.entity_id IS NOT NULL AND s.confidence IS NOT NULL) JOIN w USING (base_type) GROUP BY 1")
def _stored(spark: SparkSession, sf: str) -> DataFrame:
    fw = table(spark, sf, "signals").select("id", F.coalesce("freshness_weight", F.lit(1)).cast("decimal(3,2)").alias("fw")).distinct()
    s = V.signals(spark, sf).filter("status = 'ACTIVE' AND entity_id IS NOT NULL AND confidence IS NOT NULL").join(fw, "id")
    return s.join(F.broadcast(S.weights(spark)), "base_type").groupBy("entity_id").agg(F.round(F.sum(F.col("weight") * F.col("confidence") * F.col("fw")), 2).cast("double").alias("score"))


query("scr_lifecycle", _PR + " SELECT CASE WHEN contract_total >= 50000000 AND regd_n > 0 THEN 'scaling' WHEN standard_n > 0 AND contract_total >= 1000000 THEN 'production' WHEN contract_n >= 3 THEN 'growth' WHEN ota_n > 0 THEN 'prototype' WHEN sbir_n > 0 THEN 'r_and_d' WHEN regd_n > 0 THEN 'funded' ELSE 'early' END AS stage_7, CASE WHEN contract_total >= 10000000 THEN 'Production' WHEN contract_n > 0 AND regd_n > 0 THEN 'Growth' WHEN p2_n + contract_n > 0 THEN 'Prototype' ELSE 'Pre-revenue' END AS stage_4, count(*)::BIGINT AS n FROM pr GROUP BY 1, 2")(lambda s, d: S.lifecycle(S.profile(s, d)).groupBy("stage_7", "stage_4").agg(F.count("*").alias("n")))
query("scr_entity_class", _PR + " SELECT entity_type, CASE WHEN contract_total >= 500000000 THEN 'PRIME' ELSE 'STARTUP' END AS class, count(*)::BIGINT AS n FROM pr GROUP BY 1, 2")(lambda s, d: S.entity_class(S.profile(s, d)).groupBy("entity_type", "class").agg(F.count("*").alias("n")))
query("scr_reclass_check", _PR + " SELECT entity_id, contract_total FROM pr WHERE entity_type = 'STARTUP' AND contract_total > 50000000")(lambda s, d: S.profile(s, d).filter("entity_type = 'STARTUP' AND contract_total > 50000000").select("entity_id", "contract_total"))
query("scr_completeness", _PR + " SELECT id AS entity_id, ((cage_code IS NOT NULL)::INT * 10 + (duns_number IS NOT NULL)::INT * 10 + (headquarters_location IS NOT NULL)::INT * 5 + (founded_date IS NOT NULL)::INT * 5 + coalesce(len(technology_tags), 0) + 3 * contract_n + 3 * sbir_n)::BIGINT AS score FROM act JOIN pr ON pr.entity_id = act.id")(
    lambda s, d: S.profile(s, d).join(V.active(s, d).select(F.col("id").alias("entity_id"), "cage_code", "duns_number", "headquarters_location", "founded_date", "technology_tags"), "entity_id").select("entity_id", (sum((F.col(c).isNotNull().cast("int") * k for c, k in (("duns_number", 10), ("headquarters_location", 5), ("founded_date", 5))), F.col("cage_code").isNotNull().cast("int") * 10) + F.greatest(F.size("technology_tags"), F.lit(0)) + 3 * F.col("contract_n") + 3 * F.col("sbir_n")).cast("long").alias("score")))

# graph
_E = _B + f""", fa AS (SELECT entity_id AS source, 'FUNDED_BY_AGENCY' AS kind, t AS target, count(*)::BIGINT AS weight, coalesce(sum(amount), 0)::DOUBLE AS total, min(event_date) AS first_seen, max(event_date) AS last_seen FROM (SELECT id, entity_id, amount, event_date, unnest(list_distinct(list_transform(investors_awarders, lambda x: trim(x, E' \\t\\r\\n')))) t FROM f WHERE event_type IN {_SB} AND entity_id IS NOT NULL) WHERE t <> '' GROUP BY 1, 3),
ca AS (SELECT entity_id AS source, 'CONTRACTED_BY_AGENCY' AS kind, {_AG} AS target, count(*)::BIGINT AS weight, coalesce(sum(contract_value), 0)::DOUBLE AS total, min(award_date) AS first_seen, max(award_date) AS last_seen FROM c WHERE entity_id IS NOT NULL AND trim(contracting_agency) <> '' GROUP BY 1, 3),
ib AS (SELECT entity_id AS source, 'INVESTED_IN_BY' AS kind, t AS target, count(*)::BIGINT AS weight, coalesce(sum(amount), 0)::DOUBLE AS total, min(event_date) AS first_seen, max(event_date) AS last_seen FROM (SELECT id, entity_id, amount, event_date, unnest(list_distinct(list_transform(investors_awarders, lambda x: trim(x, E' \\t\\r\\n')))) t FROM f WHERE event_type IN ('REG_D_FILING','VC_ROUND','PRIVATE_ROUND') AND entity_id IS NOT NULL) WHERE t <> '' GROUP BY 1, 3),
ed AS (SELECT * FROM fa UNION ALL SELECT * FROM ca UNION ALL SELECT * FROM ib)"""
query("grf_funded_by_agency", _E + " SELECT * FROM fa")(G.funded_by_agency)
query("grf_contracted_by_agency", _E + " SELECT * FROM ca")(G.contracted_by_agency)
query("grf_invested_in_by", _E + " SELECT * FROM ib")(G.invested_in_by)
query("grf_stats", _E + " SELECT kind, count(*)::BIGINT AS edges, count(DISTINCT source)::BIGINT AS sources, count(DISTINCT target)::BIGINT AS targets FROM ed GROUP BY 1")(lambda s, d: G.all_edges(s, d).groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets")))
query("grf_degree", _E + ", u AS (SELECT DISTINCT least(source, target) a, greatest(source, target) b FROM ed WHERE source <> target), n AS (SELECT node, count(*)::BIGINT degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY 1) SELECT node, degree, round(degree / (SELECT count(*) - 1 FROM n), 6) AS centrality FROM n ORDER BY degree DESC, node LIMIT 10")(G.degree)
query("grf_reach_2", _E + ", st AS (SELECT min(source) AS node FROM ib), b AS (SELECT DISTINCT source, target FROM ed UNION SELECT target, source FROM ed), h1 AS (SELECT DISTINCT target AS node FROM b WHERE source IN (SELECT node FROM st) AND target NOT IN (SELECT node FROM st)), h2 AS (SELECT DISTINCT target AS node FROM b WHERE source IN (SELECT node FROM h1) AND target NOT IN (SELECT node FROM h1) AND target NOT IN (SELECT node FROM st)) SELECT hop, count(*)::BIGINT AS nodes FROM (SELECT 0 AS hop, node FROM st UNION ALL SELECT 1, node FROM h1 UNION ALL SELECT 2, node FROM h2) GROUP BY 1")(
    lambda s, d: G.reach(s, d, G.invested_in_by(s, d).agg(F.min("source").alias("node"))).groupBy("hop").agg(F.count("*").alias("nodes")))
query("grf_agency_profiles", _B + f" SELECT agency, sum(c)::BIGINT AS contracts, sum(f)::BIGINT AS awards, count(DISTINCT entity_id)::BIGINT AS entities, coalesce(sum(value), 0)::DOUBLE AS total, min(day) AS first_day, max(day) AS last_day FROM (SELECT {_AG} AS agency, entity_id, contract_value AS value, award_date AS day, 1 AS c, 0 AS f FROM c WHERE trim(contracting_agency) <> '' UNION ALL SELECT unnest(list_distinct(list_transform(investors_awarders, lambda contracting_agency: {_AG.replace('contracting_agency', "trim(contracting_agency, E' \\t\\r\\n')")}))) AS agency, entity_id, amount, event_date, 0, 1 FROM f WHERE event_type IN {_SB}) WHERE agency <> '' GROUP BY 1")(G.agency_profiles)

# vectors
_U = "WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_CS = ", q AS (SELECT vec_id AS query_id, label AS own, v AS qv FROM u WHERE vec_id % 50 = 0), h AS (SELECT query_id, label, max(sim) sim, count(*)::BIGINT hits FROM (SELECT query_id, u.label, round(list_cosine_similarity(u.v, q.qv), 6) sim FROM u, q WHERE u.vec_id <> q.query_id) WHERE sim >= 0.25 GROUP BY 1, 2)"
query("vec_retrieve", _U + _CS + " SELECT * FROM h")(X.retrieve)
query("vec_top_labels", _U + _CS + " SELECT query_id, label, sim, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, label)::INT place FROM h) WHERE place <= 3")(X.top_labels)
query("vec_fan_in", _U + _CS + " SELECT label, max(sim) AS sim, count(*)::BIGINT AS queries FROM h GROUP BY 1")(lambda s, d: X.retrieve(s, d).groupBy("label").agg(F.max("sim").alias("sim"), F.count("*").alias("queries")))
query("vec_similar_to_group", _U + ", n AS (SELECT label, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM u), m AS (SELECT label AS grp, list(x ORDER BY i) mv FROM (SELECT label, i, avg(x) x FROM (SELECT label, unnest(v) x, generate_subscripts(v, 1) i FROM n) GROUP BY 1, 2) GROUP BY 1) SELECT grp AS query_id, label, max(round(list_cosine_similarity(n.v, m.mv), 6)) AS sim FROM n, m WHERE label <> grp GROUP BY 1, 2")(X.similar_to_group)
query("vec_clusters")(X.clusters)


# history: outcomes and snapshots
@query("out_new_contract", _B + " SELECT c.entity_id, c.id AS contract_id, c.award_date AS outcome_date, greatest(0, (c.award_date - q.d) // 30)::BIGINT AS months_since_signal FROM c JOIN (SELECT entity_id, min(detected_date) d FROM s WHERE status = 'ACTIVE' AND detected_date IS NOT NULL GROUP BY 1) q USING (entity_id) WHERE c.award_date >= DATE '2025-03-01' AND c.award_date >= q.d")
def _new_contract(spark: SparkSession, sf: str) -> DataFrame:
    q = V.signals(spark, sf).filter("status = 'ACTIVE' AND detected_date IS NOT NULL").groupBy("entity_id").agg(F.min("detected_date").alias("d"))
    c = V.contracts(spark, sf).filter(F.col("award_date") >= F.lit("2025-03-01").cast("date")).join(q, "entity_id").filter("award_date >= d")
    return c.select("entity_id", F.col("id").alias("contract_id"), F.col("award_date").alias("outcome_date"), F.greatest(F.lit(0), F.floor(F.datediff("award_date", "d") / 30)).cast("long").alias("months_since_signal"))


@query("out_funding_raise", _B + f" SELECT DISTINCT f.entity_id, f.event_date, f.amount::DOUBLE AS amount FROM f JOIN (SELECT entity_id, min(detected_date) d FROM s WHERE status = 'ACTIVE' AND detected_date IS NOT NULL GROUP BY 1) q USING (entity_id) WHERE event_type IN ('REG_D_FILING','VC_ROUND') AND event_date >= q.d AND event_date >= DATE '2025-03-01' AND (entity_id IN (SELECT entity_id FROM f WHERE event_type IN {_SB} AND entity_id IS NOT NULL) OR entity_id IN (SELECT entity_id FROM c WHERE entity_id IS NOT NULL))")
def _raise(spark: SparkSession, sf: str) -> DataFrame:
    q = V.signals(spark, sf).filter("status = 'ACTIVE' AND detected_date IS NOT NULL").groupBy("entity_id").agg(F.min("detected_date").alias("d"))
    f = V.funding(spark, sf)
    base = f.filter(F.col("event_type").isin(*V.SBIR)).select("entity_id").unionByName(V.contracts(spark, sf).select("entity_id")).distinct()
    r = f.filter(F.col("event_type").isin("REG_D_FILING", "VC_ROUND") & (F.col("event_date") >= F.lit("2025-03-01").cast("date"))).join(q, "entity_id").filter("event_date >= d")
    return r.join(base, "entity_id", "left_semi").select("entity_id", "event_date", F.col("amount").cast("double").alias("amount")).distinct()


_SNAP = _B + ", d(day) AS (VALUES (DATE '2025-01-01'), (DATE '2025-07-01'), (DATE '2026-01-01')), sn AS (SELECT entity_id, day, round(sum(confidence)::DOUBLE, 2) score, count(*)::BIGINT n FROM s, d WHERE detected_date <= day AND detected_date > day - 365 AND entity_id IS NOT NULL GROUP BY 1, 2)"


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Per entity and snapshot day: signals of the year before and their summed confidence; a signal joins at most a few days."""
    days = F.array(*[F.lit(x).cast("date") for x in ("2025-01-01", "2025-07-01", "2026-01-01")])
    s = V.signals(spark, sf).filter("entity_id IS NOT NULL AND detected_date IS NOT NULL")
    within = F.filter(days, lambda x: (F.col("detected_date") <= x) & (F.col("detected_date") > F.date_sub(x, 365)))
    return s.select("entity_id", "confidence", F.explode(within).alias("day")).groupBy("entity_id", "day").agg(F.round(F.sum("confidence").cast("double"), 2).alias("score"), F.count("*").alias("n"))


query("snp_snapshots", _SNAP + " SELECT * FROM sn")(snapshots)


@query("snp_deltas", _SNAP + " SELECT entity_id, day, score - prev AS change FROM (SELECT *, lag(score) OVER (PARTITION BY entity_id ORDER BY day) prev FROM sn) WHERE prev > 0 AND (abs(score - prev) / prev > 0.1 OR abs(score - prev) > 1)")
def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshots(spark, sf).withColumn("prev", F.lag("score").over(Window.partitionBy("entity_id").orderBy("day")))
    change = F.col("score") - F.col("prev")
    return s.filter((F.col("prev") > 0) & ((F.abs(change) / F.col("prev") > 0.1) | (F.abs(change) > 1))).select("entity_id", "day", change.alias("change"))


# cohorts against controls
@query("ben_periods", _PR + f" SELECT cohort, period, count(*) FILTER (event_type = 'SBIR_PHASE_1')::BIGINT AS p1, count(*) FILTER (event_type = 'SBIR_PHASE_2')::BIGINT AS p2, coalesce(sum(amount) FILTER (event_type IN {_SB}), 0)::DOUBLE AS sbir_total, count(*) FILTER (event_type = 'REG_D_FILING')::BIGINT AS regd, coalesce(sum(amount) FILTER (event_type = 'REG_D_FILING'), 0)::DOUBLE AS regd_total, count(DISTINCT entity_id)::BIGINT AS entities FROM (SELECT f.*, CASE WHEN e.core_business = 'SOFTWARE' THEN 'treatment' ELSE 'control' END cohort, CASE WHEN event_date < DATE '2024-01-01' THEN 'baseline' ELSE 'response' END period FROM f JOIN startup e ON e.id = f.entity_id WHERE event_date >= DATE '2022-01-01') GROUP BY 1, 2")
def _periods(spark: SparkSession, sf: str) -> DataFrame:
    f = _cohort_events(spark, sf).withColumn("period", F.when(F.col("event_date") < F.lit("2024-01-01").cast("date"), "baseline").otherwise("response"))
    k = lambda *e: F.col("event_type").isin(*e)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).cast("double")
    return f.groupBy("cohort", "period").agg(F.count_if(k("SBIR_PHASE_1")).alias("p1"), F.count_if(k("SBIR_PHASE_2")).alias("p2"), total(k(*V.SBIR)).alias("sbir_total"), F.count_if(k("REG_D_FILING")).alias("regd"), total(k("REG_D_FILING")).alias("regd_total"), F.count_distinct("entity_id").alias("entities"))


def _cohort_events(spark: SparkSession, sf: str) -> DataFrame:
    e = V.startups(spark, sf).select(F.col("id").alias("entity_id"), F.when(F.col("core_business") == "SOFTWARE", "treatment").otherwise("control").alias("cohort"))
    return V.funding(spark, sf).filter(F.col("event_date") >= F.lit("2022-01-01").cast("date")).join(e, "entity_id")


_QT = _PR + ", q AS (SELECT cohort, quarter, sum(n)::BIGINT n FROM (SELECT CASE WHEN e.core_business = 'SOFTWARE' THEN 'treatment' ELSE 'control' END cohort, CAST(date_trunc('quarter', event_date) AS DATE) AS quarter, 1 n FROM f JOIN startup e ON e.id = f.entity_id WHERE event_date >= DATE '2022-01-01' AND event_type = 'SBIR_PHASE_2' UNION ALL SELECT c, CAST(d AS DATE), 0 FROM (VALUES ('treatment'), ('control')) t(c), generate_series(DATE '2022-01-01', DATE '2026-01-01', INTERVAL 3 MONTH) g(d)) GROUP BY 1, 2)"


def quarterly(spark: SparkSession, sf: str) -> DataFrame:
    """Second-phase awards per cohort and quarter, quarters without any as zero."""
    have = _cohort_events(spark, sf).filter("event_type = 'SBIR_PHASE_2'").groupBy("cohort", F.date_trunc("quarter", "event_date").cast("date").alias("quarter")).agg(F.count("*").alias("n"))
    spine = V.startups(spark, sf).select(F.explode(F.array(F.lit("treatment"), F.lit("control"))).alias("cohort")).distinct().select("cohort", F.explode(F.expr("sequence(date'2022-01-01', date'2026-01-01', interval 3 months)")).alias("quarter"), F.lit(0).cast("long").alias("n"))
    return have.unionByName(spine).groupBy("cohort", "quarter").agg(F.sum("n").alias("n"))


query("ben_quarterly", _QT + " SELECT * FROM q")(quarterly)


@query("ben_timing", _QT + ", b AS (SELECT cohort, avg(n) m FROM q WHERE quarter < DATE '2024-01-01' GROUP BY 1) SELECT q.cohort, round(any_value(m), 4) AS baseline, min(quarter) FILTER (quarter > DATE '2024-01-01' AND n > 1.5 * m) AS first_response, arg_max(quarter, (n, DATE '2030-01-01' - quarter)) FILTER (quarter > DATE '2024-01-01') AS peak_quarter, max(n) FILTER (quarter > DATE '2024-01-01') AS peak FROM q JOIN b USING (cohort) GROUP BY 1")
def _timing(spark: SparkSession, sf: str) -> DataFrame:
    q = quarterly(spark, sf)
    cut = F.lit("2024-01-01").cast("date")
    b = q.filter(F.col("quarter") < cut).groupBy("cohort").agg(F.avg("n").alias("m"))
    after = F.col("quarter") > cut
    return q.join(b, "cohort").groupBy("cohort").agg(F.round(F.first("m"), 4).alias("baseline"), F.min(F.when(after & (F.col("n") > 1.5 * F.col("m")), F.col("quarter"))).alias("first_response"), F.max(F.when(after, F.struct(F.col("n"), (-F.unix_date("quarter")).alias("k"), F.col("quarter"))))["quarter"].alias("peak_quarter"), F.max(F.when(after, F.col("n"))).alias("peak"))


@query("ben_bootstrap")
def _bootstrap(spark: SparkSession, sf: str, draws: int = 100) -> DataFrame:
    """Difference in mean filed capital with a 95 % interval: Poisson weights per entity and draw from a hash, one pass."""
    per = _cohort_events(spark, sf).groupBy("entity_id", "cohort").agg(F.coalesce(F.sum(F.when(F.col("event_type") == "REG_D_FILING", F.col("amount"))), F.lit(0)).cast("double").alias("x"))
    u = (F.pmod(F.xxhash64("entity_id", "draw"), F.lit(1_000_003)) + 0.5) / 1_000_003
    w = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.996340, 4).otherwise(5)
    d = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", w).groupBy("draw", "cohort").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    diff = d.groupBy("draw").agg((F.max(F.when(F.col("cohort") == "treatment", F.col("mean"))) - F.max(F.when(F.col("cohort") == "control", F.col("mean")))).alias("diff"))
    return diff.agg(F.round(F.avg("diff"), 2).alias("diff"), F.round(F.percentile("diff", F.lit(0.025)), 2).alias("low"), F.round(F.percentile("diff", F.lit(0.975)), 2).alias("high"), F.round(F.avg((F.col("diff") <= 0).cast("double")), 4).alias("p"))


# notional fund
_UN = _PR.replace(_PH, _W + _PH[len(_B):]) + ", un AS (SELECT pr.entity_id, composite, p2_n, regd_n FROM pr JOIN comp USING (entity_id) WHERE entity_type = 'STARTUP' AND p2_n >= 1 AND composite >= 2)"


def universe(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible entities of a strategy: startups with a second-phase award and a composite of two and more."""
    return S.profile(spark, sf).filter("entity_type = 'STARTUP' AND p2_n >= 1").join(S.composite(spark, sf).filter("composite >= 2"), "entity_id").select("entity_id", "composite", "p2_n", "regd_n")


query("fnd_universe", _UN + " SELECT entity_id, composite, p2_n::BIGINT AS p2_n, regd_n::BIGINT AS regd_n FROM un")(universe)
query("fnd_ranked", _UN + " SELECT entity_id, composite, row_number() OVER (ORDER BY composite DESC, entity_id)::INT AS rank FROM un ORDER BY composite DESC, entity_id LIMIT 20")(
    lambda s, d: universe(s, d).select("entity_id", "composite").orderBy(F.desc("composite"), "entity_id").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "entity_id"))))


@query("fnd_milestones", _UN + f" SELECT kind, count(*)::BIGINT AS n, count(DISTINCT entity_id)::BIGINT AS entities FROM (SELECT 'NEW_CONTRACT' kind, entity_id FROM c WHERE award_date >= DATE '2025-03-01' UNION ALL SELECT 'FUNDING_RAISE', entity_id FROM f WHERE event_type IN ('REG_D_FILING','VC_ROUND') AND event_date >= DATE '2025-03-01' UNION ALL SELECT 'SBIR_ADVANCE', entity_id FROM f WHERE event_type IN ('SBIR_PHASE_2','SBIR_PHASE_3') AND event_date >= DATE '2025-03-01') WHERE entity_id IN (SELECT entity_id FROM un) GROUP BY 1")
def _milestones(spark: SparkSession, sf: str) -> DataFrame:
    since = F.lit("2025-03-01").cast("date")
    f = V.funding(spark, sf).filter(F.col("event_date") >= since)
    m = V.contracts(spark, sf).filter(F.col("award_date") >= since).select(F.lit("NEW_CONTRACT").alias("kind"), "entity_id")
    m = m.unionByName(f.filter(F.col("event_type").isin("REG_D_FILING", "VC_ROUND")).select(F.lit("FUNDING_RAISE").alias("kind"), "entity_id")).unionByName(f.filter(F.col("event_type").isin("SBIR_PHASE_2", "SBIR_PHASE_3")).select(F.lit("SBIR_ADVANCE").alias("kind"), "entity_id"))
    return m.join(universe(spark, sf).select("entity_id"), "entity_id", "left_semi").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))


# reports
query("rpt_coverage", _PR + " SELECT entity_type, count(*)::BIGINT AS entities, count(*) FILTER (sbir_n > 0)::BIGINT AS with_sbir, count(*) FILTER (contract_n > 0)::BIGINT AS with_contracts, count(*) FILTER (regd_n > 0)::BIGINT AS with_private FROM pr GROUP BY 1")(
    lambda s, d: S.profile(s, d).groupBy("entity_type").agg(F.count("*").alias("entities"), F.count_if(F.col("sbir_n") > 0).alias("with_sbir"), F.count_if(F.col("contract_n") > 0).alias("with_contracts"), F.count_if(F.col("regd_n") > 0).alias("with_private")))
query("rpt_capital_flow", _PR + " SELECT core_business, count(*)::BIGINT AS entities, sum(contract_total) FILTER (contract_n > 0) AS contracts, avg(agencies) AS mean_agencies FROM (SELECT core_business, contract_n, round(contract_total / 1000)::BIGINT contract_total, agencies FROM pr) GROUP BY 1")(
    lambda s, d: S.profile(s, d).withColumn("k", F.round(F.col("contract_total") / 1000).cast("long")).groupBy("core_business").agg(F.count("*").alias("entities"), F.sum(F.when(F.col("contract_n") > 0, F.col("k"))).alias("contracts"), F.avg("agencies").alias("mean_agencies")))
query("rpt_watchlist", _PR + " SELECT entity_id, sbir_n::BIGINT AS sbir_n, sbir_total FROM pr WHERE entity_type = 'STARTUP' AND sbir_n >= 2 AND contract_n = 0 AND regd_n = 0 ORDER BY sbir_total DESC, entity_id LIMIT 50")(
    lambda s, d: S.profile(s, d).filter("entity_type = 'STARTUP' AND sbir_n >= 2 AND contract_n = 0 AND regd_n = 0").select("entity_id", "sbir_n", "sbir_total").orderBy(F.desc("sbir_total"), "entity_id").limit(50))
query("rpt_ota_comparison", _PR + " SELECT CASE WHEN ota_n > 0 THEN 'ota' ELSE 'standard_only' END AS cohort, count(*)::BIGINT AS entities, median(contract_total) AS median_total, round(avg((regd_n > 0)::INT), 6) AS private_share FROM pr WHERE contract_n > 0 GROUP BY 1")(
    lambda s, d: S.profile(s, d).filter("contract_n > 0").groupBy(F.when(F.col("ota_n") > 0, "ota").otherwise("standard_only").alias("cohort")).agg(F.count("*").alias("entities"), F.median("contract_total").alias("median_total"), F.round(F.avg((F.col("regd_n") > 0).cast("int")), 6).alias("private_share")))
_MON = "(year(regd_first) - year(sbir_first)) * 12 + month(regd_first) - month(sbir_first)"
query("rpt_raise_timing", _PR + f" SELECT CASE WHEN m < 6 THEN '00-06' WHEN m < 12 THEN '06-12' WHEN m < 24 THEN '12-24' WHEN m < 36 THEN '24-36' WHEN m < 48 THEN '36-48' ELSE '48+' END AS bucket, count(*)::BIGINT AS n FROM (SELECT {_MON} m FROM pr WHERE regd_first > sbir_first) GROUP BY 1")(
    lambda s, d: S.profile(s, d).filter("regd_first > sbir_first").withColumn("m", F.expr(_MON)).groupBy(F.when(F.col("m") < 6, "00-06").when(F.col("m") < 12, "06-12").when(F.col("m") < 24, "12-24").when(F.col("m") < 36, "24-36").when(F.col("m") < 48, "36-48").otherwise("48+").alias("bucket")).agg(F.count("*").alias("n")))
query("rpt_signal_mix", _B + " SELECT base_type, status, count(*)::BIGINT AS n, round(avg(confidence)::DOUBLE, 4) AS mean FROM s WHERE base_type IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: V.signals(s, d).filter("base_type IS NOT NULL").groupBy("base_type", "status").agg(F.count("*").alias("n"), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("mean")))
query("rpt_ota_years", _B + " SELECT year(award_date) + (month(award_date) >= 10)::INT AS fiscal_year, count(*)::BIGINT AS n, coalesce(sum(contract_value), 0)::DOUBLE AS total, count(DISTINCT entity_id)::BIGINT AS entities FROM c WHERE procurement_type = 'ota' AND award_date IS NOT NULL GROUP BY 1")(
    lambda s, d: V.contracts(s, d).filter("procurement_type = 'ota' AND award_date IS NOT NULL").groupBy((F.year("award_date") + (F.month("award_date") >= 10).cast("int")).alias("fiscal_year")).agg(F.count("*").alias("n"), F.coalesce(F.sum("contract_value"), F.lit(0)).cast("double").alias("total"), F.count_distinct("entity_id").alias("entities")))
query("rpt_lapse_band", _PR + " SELECT CASE WHEN sbir_last_x >= DATE '2025-03-01' THEN 'recent' WHEN sbir_last_x >= DATE '2024-03-01' THEN 'cooling' WHEN sbir_last_x IS NOT NULL THEN 'lapsed' ELSE 'none' END AS band, count(*)::BIGINT AS n FROM pr WHERE entity_type = 'STARTUP' GROUP BY 1")(
    lambda s, d: S.profile(s, d).filter("entity_type = 'STARTUP'").groupBy(F.when(F.col("sbir_last") >= F.lit("2025-03-01").cast("date"), "recent").when(F.col("sbir_last") >= F.lit("2024-03-01").cast("date"), "cooling").when(F.col("sbir_last").isNotNull(), "lapsed").otherwise("none").alias("band")).agg(F.count("*").alias("n")))
query("rpt_quartiles", _B + " SELECT procurement_type, count(*)::BIGINT AS n, median(v) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_disc(v, 0.5) AS lower_median FROM (SELECT procurement_type, contract_value::DOUBLE v FROM c WHERE contract_value > 0) GROUP BY 1")(
    lambda s, d: V.contracts(s, d).filter("contract_value > 0").select("procurement_type", F.col("contract_value").cast("double").alias("v")).groupBy("procurement_type").agg(F.count("*").alias("n"), F.median("v").alias("median"), F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.75)).alias("q3"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("lower_median")))


# windows and sets
@query("win_duplicates_30d", _B + " SELECT entity_id, id FROM (SELECT entity_id, id, event_date, lag(event_date) OVER (PARTITION BY entity_id, event_type, amount ORDER BY event_date, id) prev FROM f WHERE entity_id IS NOT NULL AND amount IS NOT NULL AND event_date IS NOT NULL) WHERE event_date - prev <= 30")
def _dup30(spark: SparkSession, sf: str) -> DataFrame:
    f = V.funding(spark, sf).filter("entity_id IS NOT NULL AND amount IS NOT NULL AND event_date IS NOT NULL")
    prev = F.lag("event_date").over(Window.partitionBy("entity_id", "event_type", "amount").orderBy("event_date", "id"))
    return f.withColumn("prev", prev).filter(F.datediff("event_date", "prev") <= 30).select("entity_id", "id")


query("win_first_agency", _B + f" SELECT entity_id, agency, first_day, row_number() OVER (PARTITION BY entity_id ORDER BY first_day, agency)::INT AS place FROM (SELECT entity_id, {_AG} AS agency, min(award_date) AS first_day FROM c WHERE entity_id IS NOT NULL AND trim(contracting_agency) <> '' AND award_date IS NOT NULL GROUP BY 1, 2)")(
    lambda s, d: V.contracts(s, d).filter("entity_id IS NOT NULL AND trim(contracting_agency) <> '' AND award_date IS NOT NULL").groupBy("entity_id", agency_key(F.col("contracting_agency")).alias("agency")).agg(F.min("award_date").alias("first_day")).withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("first_day", "agency"))))
query("win_latest_contract", _B + " SELECT entity_id, id, award_date FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY award_date DESC, id DESC) r FROM c WHERE entity_id IS NOT NULL AND award_date IS NOT NULL) WHERE r <= 2")(
    lambda s, d: V.contracts(s, d).filter("entity_id IS NOT NULL AND award_date IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("award_date"), F.desc("id")))).filter("r <= 2").select("entity_id", "id", "award_date"))
query("win_token_budget", "SELECT doc_id, running FROM (SELECT doc_id, source, published, sum(n_chars) OVER (PARTITION BY source ORDER BY published DESC, doc_id)::BIGINT AS running, row_number() OVER (PARTITION BY source ORDER BY published DESC, doc_id) r FROM documents WHERE n_chars > 0 AND published IS NOT NULL) WHERE running <= 48000 OR r = 1")(
    lambda s, d: _token_budget(s, d))


def _token_budget(spark: SparkSession, sf: str, budget: int = 48_000) -> DataFrame:
    """The newest documents of each source that fit a budget of characters, the first always; only the days it reaches are sorted by row."""
    d = table(spark, sf, "documents").filter("n_chars > 0 AND published IS NOT NULL").select("doc_id", "source", "published", "n_chars")
    newest = Window.partitionBy("source").orderBy(F.desc("published"))
    days = d.groupBy("source", "published").agg(F.sum("n_chars").alias("day")).withColumn("before", F.sum("day").over(newest) - F.col("day")).filter(F.col("before") <= budget)
    w = Window.partitionBy("source").orderBy(F.desc("published"), "doc_id")
    near = d.alias("d").join(days.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d.published") == F.col("k.published")), "left_semi")
    near = near.withColumns({"running": F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, 0)), "r": F.row_number().over(w)})
    return near.filter((F.col("running") <= budget) | (F.col("r") == 1)).select("doc_id", "running")


query("set_active_entities", _B + " SELECT DISTINCT entity_id FROM (SELECT entity_id FROM c WHERE award_date >= DATE '2025-03-01' UNION SELECT entity_id FROM f WHERE event_date >= DATE '2025-03-01') WHERE entity_id IS NOT NULL")(
    lambda s, d: V.contracts(s, d).filter("award_date >= date'2025-03-01'").select("entity_id").union(V.funding(s, d).filter("event_date >= date'2025-03-01'").select("entity_id")).filter("entity_id IS NOT NULL").distinct())
query("set_both_sides", _B + f" SELECT entity_id FROM f WHERE event_type IN {_SB} AND entity_id IS NOT NULL INTERSECT SELECT entity_id FROM f WHERE event_type = 'REG_D_FILING'")(
    lambda s, d: V.funding(s, d).filter(F.col("event_type").isin(*V.SBIR) & F.col("entity_id").isNotNull()).select("entity_id").intersect(V.funding(s, d).filter("event_type = 'REG_D_FILING'").select("entity_id")))
query("set_tag_jaccard", "WITH a AS (SELECT core_business, list_sort(list_distinct(flatten(list(technology_tags)))) t FROM entities WHERE technology_tags IS NOT NULL AND core_business IS NOT NULL GROUP BY 1) SELECT x.core_business AS a, y.core_business AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard FROM a x JOIN a y ON x.core_business < y.core_business")(
    lambda s, d: _jaccard(s, d))


def _jaccard(spark: SparkSession, sf: str) -> DataFrame:
    a = V.entities(spark, sf).filter("technology_tags IS NOT NULL AND core_business IS NOT NULL").select("core_business", F.explode("technology_tags").alias("t")).distinct().groupBy("core_business").agg(F.collect_set("t").alias("t"))
    x, y = a.select(F.col("core_business").alias("a"), F.col("t").alias("ta")), a.select(F.col("core_business").alias("b"), F.col("t").alias("tb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb")), 6).alias("jaccard"))


# staging and audit
query("enr_duplicate_contracts", _B + " SELECT DISTINCT b.id FROM c a JOIN c b ON a.entity_id = b.entity_id AND a.contracting_agency = b.contracting_agency AND a.id < b.id WHERE (abs(a.contract_value - b.contract_value)::DOUBLE / greatest(abs(a.contract_value), abs(b.contract_value), 1)::DOUBLE < 0.1) OR (abs(a.award_date - b.award_date) <= 90 AND (a.contract_value = 0 OR b.contract_value = 0))")(lambda s, d: _dup_contracts(s, d))


NEAR = -math.log(0.9) - 1e-12  # a tenth less is no longer near


def _dup_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts that repeat an earlier one of the same entity and agency: nearly equal in value, or near in time without one.

    No pairs are made. Equal values of an entity and agency are one point with its smallest id; a window over the logarithm of
    the value finds the smallest id within a tenth. The window runs within cells of value, in which a point stands also for
    its neighbours, so a large entity is spread over its cells. Values below 1.2 are few and compared as they are; the leg
    without value runs over the entity's days.
    """
    key = ["entity_id", "contracting_agency"]
    c = V.contracts(spark, sf).filter("entity_id IS NOT NULL AND contracting_agency IS NOT NULL").select("id", *key, F.col("contract_value").alias("v"), "award_date")
    points = c.filter("v IS NOT NULL").groupBy(*key, "v").agg(F.min("id").alias("first"))
    large = points.filter(F.abs("v") >= 1.2).withColumns({"sign": F.signum("v").cast("int"), "ln": F.log(F.abs(F.col("v").cast("double")))}).withColumn("cell", F.floor("ln"))
    spread = large.withColumn("at", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    least = F.expr(f"min(first) OVER (PARTITION BY {', '.join(key)}, sign, at ORDER BY ln RANGE BETWEEN {NEAR}D PRECEDING AND {NEAR}D FOLLOWING)")
    hit = spread.withColumn("least", least).filter("at = cell").select(*key, "v", "least")
    bridge = points.filter(F.abs("v") < 1.5)  # by the cent at most 299 an entity and agency
    bridge = bridge.select(*key, F.col("v").alias("w"), F.col("first").alias("least"))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b)).cast("double") / F.greatest(F.abs(a), F.abs(b), F.lit(1)).cast("double")
    hit_small = points.filter(F.abs("v") < 1.5).join(bridge, key).filter(gap("v", "w") < 0.1).groupBy(*key, "v").agg(F.min("least").alias("least"))
    by_value = c.join(hit.unionByName(hit_small), [*key, "v"]).filter("least < id").select("id")
    days = c.filter("award_date IS NOT NULL").groupBy(*key, "award_date").agg(F.min("id").alias("any"), F.min(F.when(F.col("v") == 0, F.col("id"))).alias("empty"))
    around = Window.partitionBy(*key).orderBy(F.unix_date("award_date")).rangeBetween(-90, 90)
    days = days.select(*key, "award_date", F.min("any").over(around).alias("any"), F.min("empty").over(around).alias("empty"))
    # a missing value is near to nothing, and only another's zero makes it one
    by_day = c.join(days, [*key, "award_date"]).filter((F.col("empty") < F.col("id")) | ((F.col("v") == 0) & (F.col("any") < F.col("id")))).select("id")
    return by_value.unionByName(by_day).distinct()


query("enr_superseded", _B + " SELECT event_type, count(*)::BIGINT AS n FROM f WHERE id NOT IN (SELECT parent_event_id FROM f WHERE parent_event_id IS NOT NULL) GROUP BY 1")(lambda s, d: superseded(V.funding(s, d)).groupBy("event_type").agg(F.count("*").alias("n")))
query("er_merge_history", "SELECT source_entity_id, target_entity_id, merge_reason, row_number() OVER (PARTITION BY target_entity_id ORDER BY created_at DESC, id)::INT AS place FROM entity_merges")(
    lambda s, d: table(s, d, "entity_merges").select("source_entity_id", "target_entity_id", "merge_reason", F.row_number().over(Window.partitionBy("target_entity_id").orderBy(F.desc("created_at"), "id")).alias("place")))
query("er_decisions", "SELECT lower(trim(decision, E' \\t\\r\\n')) AS decision, match_reason, count(*)::BIGINT AS n, round(avg(similarity_score), 4) AS mean FROM potential_matches WHERE trim(decision, E' \\t\\r\\n') <> '' GROUP BY 1, 2")(
    lambda s, d: table(s, d, "potential_matches").withColumn("decision", F.lower(F.regexp_replace("decision", r"^\s+|\s+$", ""))).filter("decision <> ''").groupBy("decision", "match_reason").agg(F.count("*").alias("n"), F.round(F.avg("similarity_score"), 4).alias("mean")))
query("er_identifier_pairs", "SELECT cage_code, count(*)::BIGINT AS n, min(id) AS first_id FROM entities WHERE regexp_full_match(cage_code, '[A-Z0-9]{5}') AND NOT cage_code IN ('00000', 'XXXXX') GROUP BY 1 HAVING count(*) > 1")(
    lambda s, d: V.entities(s, d).filter(F.col("cage_code").rlike("^[A-Z0-9]{5}$") & ~F.col("cage_code").isin("00000", "XXXXX")).groupBy("cage_code").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1"))
_NRM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(canonical_name), '[,.]', '', 'g'), '\\s+(inc|llc|corp|corporation|incorporated|ltd|co|lp)$', ''), '[^a-z0-9]+', ' ', 'g'))"
query("er_exact_groups", f"SELECT key, count(*)::BIGINT AS n, min(id) AS first_id FROM (SELECT id, {_NRM} AS key FROM entities) WHERE key <> '' GROUP BY 1 HAVING count(*) > 1")(
    lambda s, d: V.entities(s, d).withColumn("key", F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("canonical_name"), "[,.]", ""), r"\s+(inc|llc|corp|corporation|incorporated|ltd|co|lp)$", ""), "[^a-z0-9]+", " "))).filter("key <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1"))


@query("aud_checks", _PR + f""" SELECT '1a_startup_over_50m' AS check_id, count(*)::BIGINT AS n FROM pr WHERE entity_type = 'STARTUP' AND contract_total > 50000000
UNION ALL SELECT '1d_non_defense_with_sbir', count(*) FROM pr WHERE entity_type = 'NON_DEFENSE' AND sbir_n > 0 UNION ALL SELECT '1d2_non_defense_with_contracts', count(*) FROM pr WHERE entity_type = 'NON_DEFENSE' AND contract_n > 0
UNION ALL SELECT '2a_orphan_parent', count(*) FROM f WHERE parent_event_id IS NOT NULL AND parent_event_id NOT IN (SELECT id FROM f) UNION ALL SELECT '2b_superseded', count(*) FROM f WHERE id IN (SELECT parent_event_id FROM f)
UNION ALL SELECT '2d_null_amount', count(*) FROM f WHERE amount IS NULL UNION ALL SELECT '2e_over_5b', count(*) FROM f WHERE amount > 5000000000
UNION ALL SELECT '3b_stale_with_activity', count(DISTINCT entity_id) FROM s WHERE base_type = 'gone_stale' AND status = 'ACTIVE' AND entity_id IN (SELECT entity_id FROM c WHERE award_date >= DATE '2025-03-01')
UNION ALL SELECT '3e_orphan_signal', count(*) FROM s WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT id FROM entities) UNION ALL SELECT '5c_contract_signal_without_contract', count(DISTINCT entity_id) FROM s WHERE base_type = 'first_dod_contract' AND entity_id IS NOT NULL AND entity_id NOT IN (SELECT entity_id FROM c WHERE entity_id IS NOT NULL)""")
def _audit(spark: SparkSession, sf: str) -> DataFrame:
    p, f, s, c, e = S.profile(spark, sf), V.funding(spark, sf), V.signals(spark, sf), V.contracts(spark, sf), V.entities(spark, sf)
    parents = f.filter("parent_event_id IS NOT NULL").select("id", F.col("parent_event_id").alias("up"))
    ids = f.select("id")
    checks = {
        "1a_startup_over_50m": p.filter("entity_type = 'STARTUP' AND contract_total > 50000000"), "1d_non_defense_with_sbir": p.filter("entity_type = 'NON_DEFENSE' AND sbir_n > 0"), "1d2_non_defense_with_contracts": p.filter("entity_type = 'NON_DEFENSE' AND contract_n > 0"),
        "2a_orphan_parent": parents.join(ids.withColumnRenamed("id", "up"), "up", "left_anti"), "2b_superseded": f.join(parents.select(F.col("up").alias("id")), "id", "left_semi"), "2d_null_amount": f.filter("amount IS NULL"), "2e_over_5b": f.filter("amount > 5000000000"),
        "3b_stale_with_activity": s.filter("base_type = 'gone_stale' AND status = 'ACTIVE'").join(c.filter("award_date >= date'2025-03-01'"), "entity_id", "left_semi").select("entity_id").distinct(),
        "3e_orphan_signal": s.filter("entity_id IS NOT NULL").join(e.select(F.col("id").alias("entity_id")), "entity_id", "left_anti"),
        "5c_contract_signal_without_contract": s.filter("base_type = 'first_dod_contract' AND entity_id IS NOT NULL").join(c, "entity_id", "left_anti").select("entity_id").distinct(),
    }
    out = None
    for k, d in checks.items():
        d = d.agg(F.count("*").alias("n")).select(F.lit(k).alias("check_id"), "n")
        out = d if out is None else out.unionByName(d)
    return out


# scalars over payloads
@query("fnc_award_amount", _B + """, j AS (SELECT id, regexp_replace(json_extract_string(raw_data, '$."Award Amount"'), '[$,\\s]', '', 'g') a, json_extract_string(raw_data, '$.Phase') ph FROM f WHERE json_valid(raw_data) AND json_type(raw_data) = 'OBJECT')
SELECT CASE WHEN regexp_matches(upper(trim(ph)), '\\b(III|3)\\b') THEN 'SBIR_PHASE_3' WHEN regexp_matches(upper(trim(ph)), '\\b(II|2)\\b') THEN 'SBIR_PHASE_2' WHEN regexp_matches(upper(trim(ph)), '\\b(I|1)\\b') THEN 'SBIR_PHASE_1' END AS phase, count(*)::BIGINT AS n, coalesce(sum(CASE WHEN regexp_full_match(a, '-?\\d{1,16}(\\.\\d+)?') THEN a::DECIMAL(18,2) END), 0)::DOUBLE AS total FROM j GROUP BY 1""")
def _award_amount(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts and phases as the award payloads write them; payloads that are no JSON object are left out."""
    f = V.funding(spark, sf).filter(F.try_parse_json("raw_data").isNotNull() & F.col("raw_data").rlike(r"^\s*\{"))
    j = f.select(phase(F.get_json_object("raw_data", "$.Phase")).alias("phase"), money(F.get_json_object("raw_data", "$['Award Amount']")).alias("amount"))
    return j.groupBy("phase").agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total"))


query("fnc_round_stage", _B + " SELECT CASE WHEN amount < 2000000 THEN 'seed' WHEN amount < 15000000 THEN 'A' WHEN amount < 50000000 THEN 'B' WHEN amount < 150000000 THEN 'C' WHEN amount IS NOT NULL THEN 'growth' END AS stage, count(*)::BIGINT AS n FROM f WHERE event_type IN ('REG_D_FILING','VC_ROUND','PRIVATE_ROUND') GROUP BY 1")(
    lambda s, d: V.funding(s, d).filter(F.col("event_type").isin(*G.PRIVATE)).groupBy(round_stage(F.col("amount")).alias("stage")).agg(F.count("*").alias("n")))
query("fbk_validation_rates", _B + " SELECT base_type, count(*)::BIGINT AS judged, round(avg((status = 'VALIDATED')::INT), 6) AS rate FROM s WHERE status IN ('VALIDATED', 'FALSE_POSITIVE') AND base_type IS NOT NULL GROUP BY 1")(
    lambda s, d: V.signals(s, d).filter("status IN ('VALIDATED', 'FALSE_POSITIVE') AND base_type IS NOT NULL").groupBy("base_type").agg(F.count("*").alias("judged"), F.round(F.avg((F.col("status") == "VALIDATED").cast("int")), 6).alias("rate")))


@query("er_identifier_match", """WITH e AS (SELECT id, cage_code, duns_number FROM entities WHERE merged_into_id IS NULL), v AS (SELECT record_id, upper(trim(cage_text)) c, trim(duns_text) d FROM vendor_records),
m AS (SELECT record_id, id, 1 p FROM v JOIN e ON e.cage_code = v.c WHERE regexp_full_match(c, '[A-Z0-9]{5}') AND c NOT IN ('00000', 'XXXXX') UNION ALL SELECT record_id, id, 2 FROM v JOIN e ON e.duns_number = v.d WHERE regexp_full_match(d, '[0-9]{9}') AND d NOT IN ('000000000', '999999999', '123456789'))
SELECT record_id, id AS entity_id, CASE p WHEN 1 THEN 'cage' ELSE 'duns' END AS by_code FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY p, id) r FROM m) WHERE r = 1""")
def _identifier_match(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor lines resolved by code alone: CAGE before DUNS, the smallest id among several."""
    e = V.active(spark, sf).select("id", F.col("cage_code").alias("c"), F.col("duns_number").alias("d"))
    v = table(spark, sf, "vendor_records").select("record_id", F.upper(F.trim("cage_text")).alias("c"), F.trim("duns_text").alias("d"))
    by_c = v.filter(F.col("c").rlike("^[A-Z0-9]{5}$") & ~F.col("c").isin("00000", "XXXXX")).join(e.select("id", "c"), "c").select("record_id", F.struct(F.lit(1).alias("p"), "id").alias("x"))
    by_d = v.filter(F.col("d").rlike("^[0-9]{9}$") & ~F.col("d").isin("000000000", "999999999", "123456789")).join(e.select("id", "d"), "d").select("record_id", F.struct(F.lit(2).alias("p"), "id").alias("x"))
    return by_c.unionByName(by_d).groupBy("record_id").agg(F.min("x").alias("x")).select("record_id", F.col("x.id").alias("entity_id"), F.when(F.col("x.p") == 1, "cage").otherwise("duns").alias("by_code"))


@query("scr_enrichment_priority", _PR.replace(_PH, _W + _PH[len(_B):]) + " SELECT entity_id, 2 * (composite >= 4)::INT + (composite >= 2 AND composite < 4)::INT + 2 * (contract_n = 0)::INT + (regd_n = 0)::INT + 2 * (sbir_total >= 5000000)::INT + (sbir_total >= 1000000 AND sbir_total < 5000000)::INT AS priority FROM pr JOIN comp USING (entity_id) WHERE entity_type = 'STARTUP'")
def _enrichment_priority(spark: SparkSession, sf: str) -> DataFrame:
    d = S.profile(spark, sf).filter("entity_type = 'STARTUP'").join(S.composite(spark, sf), "entity_id")
    k = lambda cond, n=1: F.expr(cond).cast("int") * n
    total = k("composite >= 4", 2) + k("composite >= 2 AND composite < 4") + k("contract_n = 0", 2) + k("regd_n = 0") + k("sbir_total >= 5000000", 2) + k("sbir_total >= 1000000 AND sbir_total < 5000000")
    return d.select("entity_id", total.alias("priority"))


@query("rag_context", "SELECT entity_id, count(*)::BIGINT AS documents, sum(n)::BIGINT AS characters FROM (SELECT entity_id, n_chars n, sum(n_chars) OVER w run, row_number() OVER w r FROM documents WHERE entity_id IS NOT NULL AND n_chars > 0 AND published IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY published DESC, doc_id)) WHERE r <= 15 AND (run <= 12000 OR r = 1) GROUP BY 1")
def _context(spark: SparkSession, sf: str) -> DataFrame:
    """The latest documents of an entity that fit a character budget; the first one always does."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("published"), "doc_id")
    d = table(spark, sf, "documents").filter("entity_id IS NOT NULL AND n_chars > 0 AND published IS NOT NULL").select("entity_id", "doc_id", "published", F.col("n_chars").alias("n"))
    d = d.withColumn("r", F.row_number().over(w)).filter("r <= 15").withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.filter("run <= 12000 OR r = 1").groupBy("entity_id").agg(F.count("*").alias("documents"), F.sum("n").alias("characters"))


@query("fnd_bootstrap")
def _fund_bootstrap(spark: SparkSession, sf: str, draws: int = 100, size: int = 20) -> DataFrame:
    """Random cohorts of the eligible universe without replacement: mean, spread and percentiles of their mean composite."""
    u = universe(spark, sf).select("entity_id", "composite").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    r = u.withColumn("r", F.row_number().over(Window.partitionBy("draw").orderBy(F.xxhash64("draw", "entity_id"), "entity_id"))).filter(F.col("r") <= size)
    m = r.groupBy("draw").agg(F.avg("composite").alias("m"))
    return m.agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.stddev_samp("m"), 4).alias("sd"), F.round(F.percentile("m", F.lit(0.05)), 4).alias("p5"), F.round(F.percentile("m", F.lit(0.95)), 4).alias("p95"))


query("agg_common_terms", "SELECT source, term, n FROM (SELECT source, term, count(*)::BIGINT n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, term) r FROM (SELECT source, unnest(regexp_extract_all(lower(title), '[a-z]{4,}')) term FROM documents WHERE title IS NOT NULL) GROUP BY 1, 2) WHERE r <= 5")(
    lambda s, d: table(s, d, "documents").filter("title IS NOT NULL").select("source", F.explode(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{4,})"))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "term"))).filter("r <= 5").drop("r"))

# the star schema
query("rel_pricing", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")(
    lambda s, d: table(s, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")))
query("rel_top_customers", "SELECT c_custkey, n_name, count(*)::BIGINT AS orders, max(o_totalprice) AS largest FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2 ORDER BY orders DESC, c_custkey LIMIT 100")(
    lambda s, d: table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("largest")).join(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("c_custkey", "n_name", "orders", "largest").orderBy(F.desc("orders"), "c_custkey").limit(100))
query("rel_events_sessions", "SELECT user_id, count(*)::BIGINT AS sessions, max(n)::BIGINT AS longest FROM (SELECT user_id, k, count(*) n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END new FROM events)) GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: _sessions(s, d))


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "ts", "event_id").withColumn("new", F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr("interval 30 minutes"), 0).otherwise(1))
    return e.withColumn("k", F.sum("new").over(w)).groupBy("user_id", "k").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
