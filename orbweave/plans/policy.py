"""Queries over the alignment with budget areas, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import graph as G
from orbweave.operators import policy as P
from orbweave.operators import scoring as S
from orbweave.operators.detectors import _out, contract_acceleration, superseded
from orbweave.operators.quantiles import order_statistics
from orbweave.plans.analytics import _E, _PR, _W
from orbweave.plans.detection import _PH, SQL as DETECTION_SQL
from orbweave.plans.registry import Registry
from orbweave.sources import views as V

query = Registry()
_values = lambda d: ", ".join(f"('{k}', '{v}')" if isinstance(v, str) else f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for k, v in d.items())
_SC = f""", areas(area, weight, growth) AS (VALUES {_values(P.AREAS)}), ta(tag, area) AS (VALUES {_values(P.TAG_AREA)}),
sc AS (SELECT entity_id, area, round(least(1.0::DOUBLE, 0.4::DOUBLE * count(*) + 0.2::DOUBLE * max((tag = first_tag)::INT)), 2) score FROM (SELECT id AS entity_id, technology_tags[1] first_tag, unnest(list_distinct(technology_tags)) tag FROM startup) JOIN ta USING (tag) GROUP BY 1, 2),
tw AS (SELECT entity_id, floor(sum(round(score * 100)::BIGINT * round(weight * 1000)::BIGINT)::DOUBLE / sum(round(weight * 1000)::BIGINT)::DOUBLE * 10 + 0.5::DOUBLE) / 1000 by_weight, floor(sum(round(score * 100)::BIGINT * (100 + growth)::BIGINT)::DOUBLE / sum((100 + growth)::BIGINT)::DOUBLE * 10 + 0.5::DOUBLE) / 1000 by_growth FROM sc JOIN areas USING (area) WHERE score > 0.2 GROUP BY 1),
tp AS (SELECT entity_id, area, score FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, area) r FROM sc) WHERE r = 1 AND score >= 0.1)"""
_B, _P, _WP = V.BASE_SQL + _SC, _PR + _SC, _PR.replace(_PH, _W + _PH[len(V.BASE_SQL) :]) + _SC


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return P.scores(V.startups(spark, sf))


query("pol_scores", _B + " SELECT * FROM sc")(scores)
query("pol_tailwinds", _B + " SELECT * FROM tw")(lambda s, d: P.tailwinds(scores(s, d)))
query("pol_top_areas", _B + " SELECT * FROM tp")(lambda s, d: P.top_areas(scores(s, d)))
query("pol_top_of_map", _B + " SELECT area, count(*)::BIGINT AS n FROM tp GROUP BY 1")(lambda s, d: P.score_maps(scores(s, d)).groupBy(P.top_of_map(F.col("scores")).alias("area")).agg(F.count("*").alias("n")))
query("pol_bands", _B + " SELECT area, count(*) FILTER (score >= 0.7)::BIGINT AS high, count(*) FILTER (score >= 0.4 AND score < 0.7)::BIGINT AS medium, count(*) FILTER (score < 0.4)::BIGINT AS low FROM sc GROUP BY 1")(lambda s, d: P.bands(scores(s, d)))
query("pol_large_areas", _B + " SELECT entity_id, count(*)::BIGINT AS areas, max(score) AS best FROM sc JOIN areas USING (area) WHERE weight >= 0.1 GROUP BY 1")(
    lambda s, d: P.score_maps(scores(s, d)).withColumn("m", F.map_filter("scores", lambda k, v: k.isin([a for a, x in P.AREAS.items() if x[0] >= 0.1]))).filter(F.size("m") > 0).select("entity_id", F.size("m").cast("long").alias("areas"), F.array_max(F.map_values("m")).alias("best")))
query("pol_score_at_least", _B + " SELECT entity_id, score FROM sc WHERE area = 'electronic_warfare' AND score >= 0.4")(
    lambda s, d: P.score_maps(scores(s, d)).select("entity_id", F.col("scores")["electronic_warfare"].alias("score")).filter("score >= 0.4"))
query("grf_aligned_to_policy", _B + " SELECT entity_id AS source, 'ALIGNED_TO_POLICY' AS kind, area AS target, score AS weight FROM sc WHERE score >= 0.3")(lambda s, d: P.aligned_edges(P.score_maps(scores(s, d))))
query("sig_policy_headwind", _B + " SELECT entity_id, 'policy_headwind' AS signal_type, least(0.9::DOUBLE, round(0.5::DOUBLE + (1 - weight) * 0.2::DOUBLE + (score - 0.5::DOUBLE) * 0.4::DOUBLE, 2)) AS confidence, as_of AS detected_date, area, score FROM tp JOIN areas USING (area), p WHERE growth <= 0 AND score >= 0.5")(
    lambda s, d: _out(P.headwinds(scores(s, d)), "policy_headwind", F.col("confidence"), V.as_of(), F.col("area"), F.col("score")).select("entity_id", "signal_type", "confidence", "detected_date", F.get_json_object("evidence", "$.area").alias("area"), F.get_json_object("evidence", "$.score").cast("double").alias("score")))
COHORT, LEAST = ("electronic_warfare", "space_resilience"), 0.4
_CO = _B + f", co AS (SELECT s.id AS entity_id, CASE WHEN s.id IN (SELECT entity_id FROM sc WHERE area IN {COHORT} AND score >= {LEAST}) THEN 'treatment' ELSE 'control' END cohort FROM startup s)"


def cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return P.cohorts(scores(spark, sf), V.startups(spark, sf).select(F.col("id").alias("entity_id")), COHORT, LEAST)


query("ben_cohorts", _CO + " SELECT cohort, count(*)::BIGINT AS n, n < 10 AS few FROM co GROUP BY 1")(lambda s, d: cohorts(s, d).groupBy("cohort").agg(F.count("*").alias("n")).withColumn("few", F.col("n") < 10))
_KINDS = (("p1", "SBIR_PHASE_1"), ("p2", "SBIR_PHASE_2"), ("regd", "REG_D_FILING"))


@query("ben_change", _CO + ", m AS (SELECT cohort, " + ", ".join(f"count(*) FILTER (event_type = '{k}' AND {c})::BIGINT {n}_{t}" for n, k in _KINDS for t, c in (("before", "event_date < DATE '2024-01-01'"), ("after", "event_date >= DATE '2024-01-01'"))) + " FROM f JOIN co USING (entity_id) WHERE event_date >= DATE '2022-01-01' GROUP BY 1) SELECT cohort, " + ", ".join(f"CASE WHEN {n}_before > 0 THEN round(({n}_after - {n}_before) * 100.0::DOUBLE / {n}_before, 4) END AS {n}_change, CASE WHEN {n}_before = 0 THEN 'no base' WHEN {n}_after > 1.2 * {n}_before THEN 'up' WHEN {n}_after < 0.8 * {n}_before THEN 'down' ELSE 'flat' END AS {n}_text" for n, _ in _KINDS) + " FROM m")
def _change(spark: SparkSession, sf: str) -> DataFrame:
    """Per cohort the change in per cent of each kind of event after the day, null without a base, and a word for it."""
    f = V.funding(spark, sf).filter("event_date >= date'2022-01-01'").join(cohorts(spark, sf), "entity_id")
    late = F.col("event_date") >= F.lit("2024-01-01").cast("date")
    m = f.groupBy("cohort").agg(*[F.count_if((F.col("event_type") == k) & (late if t == "after" else ~late)).alias(f"{n}_{t}") for n, k in _KINDS for t in ("before", "after")])
    out = []
    for n, _ in _KINDS:
        b, a = F.col(f"{n}_before"), F.col(f"{n}_after")
        out += [F.round(F.try_divide((a - b) * 100.0, b), 4).alias(f"{n}_change"), F.when(b == 0, "no base").when(a > 1.2 * b, "up").when(a < 0.8 * b, "down").otherwise("flat").alias(f"{n}_text")]
    return m.select("cohort", *out)


_PRIV = "(SELECT entity_id, coalesce(sum(amount), 0)::DOUBLE private FROM f WHERE event_type IN ('REG_D_FILING','PRIVATE_ROUND') AND id NOT IN (SELECT parent_event_id FROM f WHERE parent_event_id IS NOT NULL) GROUP BY 1)"


def private(spark: SparkSession, sf: str) -> DataFrame:
    """(entity_id, private): filings and rounds that no other event supersedes."""
    f = superseded(V.funding(spark, sf)).filter(F.col("event_type").isin("REG_D_FILING", "PRIVATE_ROUND"))
    return f.groupBy("entity_id").agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("private"))


@query("rpt_capital_by_area", _WP + f" SELECT area, count(*)::BIGINT AS entities, sum(round(coalesce(private, 0) / 1000)::BIGINT)::BIGINT AS private_k, sum(round(contract_total / 1000)::BIGINT)::BIGINT AS contracts_k, round(avg(coalesce(composite, 0)), 4) AS mean_composite, round(avg(coalesce(signals, 0)), 4) AS mean_signals FROM tp JOIN pr USING (entity_id) LEFT JOIN comp USING (entity_id) LEFT JOIN {_PRIV} v USING (entity_id) GROUP BY 1")
def _by_area(spark: SparkSession, sf: str) -> DataFrame:
    """Capital flow by the entities' top area."""
    d = P.top_areas(scores(spark, sf)).join(S.profile(spark, sf), "entity_id").join(S.composite(spark, sf), "entity_id", "left").join(private(spark, sf), "entity_id", "left")
    k = lambda c: F.sum(F.round(F.coalesce(c, F.lit(0.0)) / 1000).cast("long"))
    return d.groupBy("area").agg(F.count("*").alias("entities"), k(F.col("private")).alias("private_k"), k(F.col("contract_total")).alias("contracts_k"), F.round(F.avg(F.coalesce("composite", F.lit(0.0))), 4).alias("mean_composite"), F.round(F.avg(F.coalesce("signals", F.lit(0))), 4).alias("mean_signals"))


@query("rpt_acceleration_by_sector", DETECTION_SQL["sig_contract_acceleration"].replace(" SELECT entity_id, 'contract_acceleration'", ", acc AS (SELECT entity_id, 'contract_acceleration'", 1) + ") SELECT core_business, n, upper_median, tracking FROM (SELECT core_business, count(*)::BIGINT n, list_sort(list(recent_24mo_value))[len(list(recent_24mo_value)) // 2 + 1] AS upper_median, count(*) FILTER (a.entity_id IN (SELECT entity_id FROM f WHERE event_type = 'REG_D_FILING'))::BIGINT AS tracking FROM acc a JOIN act ON act.id = a.entity_id WHERE core_business IS NOT NULL GROUP BY 1)")
def _acceleration(spark: SparkSession, sf: str) -> DataFrame:
    """Accelerating companies by sector: number, upper median of the recent value, how many raised capital."""
    a = contract_acceleration(spark, sf).select("entity_id", F.get_json_object("evidence", "$.recent_24mo_value").cast("double").alias("v"))
    raised = V.funding(spark, sf).filter("event_type = 'REG_D_FILING'").select("entity_id", F.lit(1).alias("raised")).distinct()
    d = a.join(V.active(spark, sf).select(F.col("id").alias("entity_id"), "core_business"), "entity_id").filter("core_business IS NOT NULL").join(raised, "entity_id", "left")
    counts = d.groupBy("core_business").agg(F.count("raised").alias("tracking"))
    return order_statistics(d, "core_business", "v", upper_median=F.floor(F.col("n") / 2) + 1).join(counts, "core_business")


query("rpt_headwind_exposure", _P + " SELECT core_business, count(*)::BIGINT AS entities, count(*) FILTER (greatest(last_award, sbir_last_x) >= DATE '2026-03-01' - 548)::BIGINT AS recent FROM tp JOIN areas USING (area) JOIN pr USING (entity_id) WHERE growth <= 0 AND score >= 0.5 GROUP BY 1")(
    lambda s, d: P.headwinds(scores(s, d)).join(S.profile(s, d), "entity_id").groupBy("core_business").agg(F.count("*").alias("entities"), F.count_if(F.greatest("last_award", "sbir_last") >= F.date_sub(V.as_of(), 548)).alias("recent")))
_MON = "(year(regd_first) - year(sbir_first)) * 12 + month(regd_first) - month(sbir_first)"
query("rpt_fastest_areas", _P + f" SELECT area, count(*)::BIGINT AS n, round(avg({_MON}), 4) AS mean_months FROM tp JOIN pr USING (entity_id) WHERE regd_first > sbir_first GROUP BY 1 HAVING count(*) >= 3")(
    lambda s, d: P.top_areas(scores(s, d)).join(S.profile(s, d), "entity_id").filter("regd_first > sbir_first").groupBy("area").agg(F.count("*").alias("n"), F.round(F.avg(F.expr(_MON)), 4).alias("mean_months")).filter("n >= 3"))
query("rpt_next_wave", _P + " SELECT entity_id, p2_n::BIGINT AS p2_n, by_weight FROM pr JOIN tw USING (entity_id) WHERE p2_n > 0 AND regd_n = 0 AND by_weight > 0.3 AND p2_last >= DATE '2023-01-01' ORDER BY by_weight DESC, p2_n DESC, entity_id LIMIT 15")(
    lambda s, d: S.profile(s, d).join(P.tailwinds(scores(s, d)), "entity_id").filter("p2_n > 0 AND regd_n = 0 AND by_weight > 0.3 AND p2_last >= date'2023-01-01'").orderBy(F.desc("by_weight"), F.desc("p2_n"), "entity_id").limit(15).select("entity_id", "p2_n", "by_weight"))
query("grf_policy_paths", _E.replace(V.BASE_SQL, _B, 1) + " SELECT a.area, c.target AS agency, count(DISTINCT a.entity_id)::BIGINT AS entities FROM sc a JOIN ca c ON c.source = a.entity_id WHERE a.score >= 0.3 GROUP BY 1, 2")(
    lambda s, d: P.aligned_edges(P.score_maps(scores(s, d))).select("source", F.col("target").alias("area")).join(G.contracted_by_agency(s, d).select("source", F.col("target").alias("agency")), "source").groupBy("area", "agency").agg(F.count_distinct("source").alias("entities")))


@query("grf_ecosystem", _E.replace(V.BASE_SQL, _B, 1) + ", t AS (SELECT entity_id, score FROM sc WHERE area = 'electronic_warfare' AND score >= 0.5 ORDER BY score DESC, entity_id LIMIT 50) SELECT kind, count(*)::BIGINT AS edges, count(DISTINCT source)::BIGINT AS sources, count(DISTINCT target)::BIGINT AS targets FROM (SELECT entity_id AS source, 'ALIGNED_TO_POLICY' AS kind, 'electronic_warfare' AS target FROM t UNION SELECT source, kind, target FROM ed WHERE kind <> 'INVESTED_IN_BY' AND source IN (SELECT entity_id FROM t)) GROUP BY 1")
def _ecosystem(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty entities best aligned with an area, with the edges to their agencies: edges and ends by kind."""
    best = scores(spark, sf).filter("area = 'electronic_warfare' AND score >= 0.5").orderBy(F.desc("score"), "entity_id").limit(50).select(F.col("entity_id").alias("source"))
    edges = G.all_edges(spark, sf).filter("kind <> 'INVESTED_IN_BY'").join(F.broadcast(best), "source", "left_semi").select("source", "kind", "target")
    both = best.select("source", F.lit("ALIGNED_TO_POLICY").alias("kind"), F.lit("electronic_warfare").alias("target")).unionByName(edges).distinct()
    return both.groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


_NEG = "('gone_stale','sbir_stalled','customer_concentration','sbir_lapse_risk')"


@query("scr_employment", _WP + f""", ps AS (SELECT entity_id, count(DISTINCT base_type) n, count(DISTINCT base_type) FILTER (base_type <> 'high_priority_technology') o, max(detected_date) l FROM s WHERE status = 'ACTIVE' AND base_type NOT IN {_NEG} GROUP BY 1),
k AS (SELECT DISTINCT entity_id FROM s WHERE status = 'ACTIVE' AND base_type = 'kop_alignment') SELECT entity_id, round((0.30::DOUBLE * least(greatest(coalesce(composite, 0), 0), 10) / 10 + 0.25::DOUBLE * least(n, 6) / 6 + 0.20::DOUBLE * coalesce(by_weight, 0) + 0.15::DOUBLE * CASE WHEN l >= DATE '2025-09-01' THEN 1 WHEN l >= DATE '2025-03-01' THEN 0.7 WHEN l >= DATE '2024-03-01' THEN 0.4 ELSE 0 END + 0.10::DOUBLE * (k.entity_id IS NOT NULL)::INT) * CASE WHEN area IN ('electronic_warfare', 'autonomous_systems') THEN 1.15::DOUBLE ELSE 1 END, 6) AS score FROM pr JOIN ps USING (entity_id) LEFT JOIN comp USING (entity_id) LEFT JOIN tw USING (entity_id) LEFT JOIN tp USING (entity_id) LEFT JOIN k ON k.entity_id = pr.entity_id LEFT JOIN {_PRIV} v ON v.entity_id = pr.entity_id
WHERE entity_type = 'STARTUP' AND p2_n > 0 AND n >= 2 AND o >= 1 AND pr.entity_id NOT IN (SELECT entity_id FROM s WHERE entity_id IS NOT NULL AND status = 'ACTIVE' AND base_type IN ('gone_stale','sbir_stalled')) AND l >= DATE '2024-03-01' AND coalesce(private, 0) < 100000000 AND contract_total < 200000000""")
def _employment(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of companies worth approaching: score, breadth of signals, tailwind, recency and problem alignment, preferred areas up."""
    s = V.signals(spark, sf).filter("status = 'ACTIVE' AND entity_id IS NOT NULL")
    t = F.col("base_type")
    ps = s.groupBy("entity_id").agg(
        F.count_distinct(F.when(~t.isin("gone_stale", "sbir_stalled", "customer_concentration", "sbir_lapse_risk"), t)).alias("n"), F.count_distinct(F.when(~t.isin("gone_stale", "sbir_stalled", "customer_concentration", "sbir_lapse_risk", "high_priority_technology"), t)).alias("o"),
        F.max(F.when(~t.isin("gone_stale", "sbir_stalled", "customer_concentration", "sbir_lapse_risk"), F.col("detected_date"))).alias("l"), F.coalesce(F.bool_or(t.isin("gone_stale", "sbir_stalled")), F.lit(False)).alias("bad"), F.coalesce(F.bool_or(t == "kop_alignment"), F.lit(False)).alias("kop"))
    d = S.profile(spark, sf).filter("entity_type = 'STARTUP' AND p2_n > 0 AND contract_total < 200000000").join(ps.filter("n >= 2 AND o >= 1 AND NOT bad AND l >= date'2024-03-01'"), "entity_id")
    d = d.join(S.composite(spark, sf).select("entity_id", "composite"), "entity_id", "left").join(P.tailwinds(scores(spark, sf)), "entity_id", "left").join(P.top_areas(scores(spark, sf)), "entity_id", "left").join(private(spark, sf), "entity_id", "left").filter("coalesce(private, 0) < 100000000")
    zero = F.lit(0.0)
    recent = F.when(F.col("l") >= F.lit("2025-09-01").cast("date"), 1.0).when(F.col("l") >= F.lit("2025-03-01").cast("date"), 0.7).otherwise(0.4)
    base = 0.30 * F.least(F.greatest(F.coalesce("composite", zero), zero), F.lit(10.0)) / 10 + 0.25 * F.least("n", F.lit(6)) / 6 + 0.20 * F.coalesce("by_weight", zero) + 0.15 * recent + 0.10 * F.col("kop").cast("int")
    return d.select("entity_id", F.round(base * F.when(F.col("area").isin("electronic_warfare", "autonomous_systems"), 1.15).otherwise(1.0), 6).alias("score"))


query("scr_prospects", _WP + " SELECT entity_id, round(0.65::DOUBLE * coalesce(by_weight, 0) + 0.35::DOUBLE * least(composite / 6, 1), 6) AS rank_score, round(0.55::DOUBLE * least(composite / 6, 1) + 0.30::DOUBLE * coalesce(by_weight, 0) + 0.15::DOUBLE * CASE WHEN contract_n > 0 AND regd_n > 0 THEN 1 WHEN contract_n + regd_n > 0 THEN 0.5 ELSE 0 END, 6) AS execution_score FROM pr JOIN comp USING (entity_id) LEFT JOIN tw USING (entity_id) WHERE entity_type = 'STARTUP' AND composite > 2")(
    lambda s, d: _prospects(s, d))


def _prospects(spark: SparkSession, sf: str) -> DataFrame:
    """Prospect rank (fit and composite) and execution-weighted rank; fit is the tailwind."""
    d = S.profile(spark, sf).filter("entity_type = 'STARTUP'").join(S.composite(spark, sf).filter("composite > 2"), "entity_id").join(P.tailwinds(scores(spark, sf)), "entity_id", "left")
    fit, norm = F.coalesce("by_weight", F.lit(0.0)), F.least(F.col("composite") / 6, F.lit(1.0))
    tier = F.when((F.col("contract_n") > 0) & (F.col("regd_n") > 0), 1.0).when(F.col("contract_n") + F.col("regd_n") > 0, 0.5).otherwise(0.0)
    return d.select("entity_id", F.round(0.65 * fit + 0.35 * norm, 6).alias("rank_score"), F.round(0.55 * norm + 0.30 * fit + 0.15 * tier, 6).alias("execution_score"))


def queries() -> dict:
    return dict(query.calls)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
