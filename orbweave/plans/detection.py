"""Queries of the signal detectors, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import detectors as D
from orbweave.sources import views as V
from orbweave.sources.views import BASE_SQL

_SB = "('SBIR_PHASE_1','SBIR_PHASE_2','SBIR_PHASE_3')"
_PH = BASE_SQL + f""", ph AS (SELECT entity_id,
 count(*) FILTER (event_type='SBIR_PHASE_1') p1_n, max(event_date) FILTER (event_type='SBIR_PHASE_1') p1_last, min(event_date) FILTER (event_type='SBIR_PHASE_1') p1_first,
 count(*) FILTER (event_type='SBIR_PHASE_2') p2_n, max(event_date) FILTER (event_type='SBIR_PHASE_2') p2_last, min(event_date) FILTER (event_type='SBIR_PHASE_2') p2_first,
 count(*) FILTER (event_type='SBIR_PHASE_3') p3_n, max(event_date) FILTER (event_type='SBIR_PHASE_3') p3_last,
 count(*) FILTER (event_type='REG_D_FILING') regd_n, max(event_date) FILTER (event_type='REG_D_FILING') regd_last, min(event_date) FILTER (event_type='REG_D_FILING') regd_first,
 count(*) FILTER (event_type IN {_SB}) sbir_n, coalesce(sum(amount) FILTER (event_type IN {_SB}), 0)::DOUBLE sbir_total, min(event_date) FILTER (event_type IN {_SB}) sbir_first
 FROM f WHERE entity_id IS NOT NULL GROUP BY 1)"""


#: Evidence fields that come out of the checked queries as columns: name, type, and the value in the checking SQL.
EVIDENCE = {
    "sbir_phase_2_transition": (("phase_1_count", "bigint", "p1_n"), ("phase_2_count", "bigint", "p2_n")), "sbir_phase_3_transition": (("phase_2_count", "bigint", "p2_n"), ("phase_3_count", "bigint", "p3_n")),
    "sbir_stalled": (("phase_1_count", "bigint", "p1_n"),), "sbir_graduation_speed": (("days_to_graduate", "double", "d"),), "time_to_contract": (("days_to_contract", "double", "d"),),
    "rapid_contract_growth": (("historical_total", "double", "a"), ("recent_total", "double", "b")), "high_priority_technology": (("priority_count", "bigint", "n"),), "multi_agency_interest": (("agency_count", "bigint", "n"),),
    "outsized_award": (("contract_value", "double", "v"),), "sbir_to_contract_transition": (("total_contract_value", "double", "t"),), "sbir_to_vc_raise": (("sbir_award_count", "bigint", "sbir_n"), ("regd_filing_count", "bigint", "n"), ("total_regd_value", "double", "t")),
    "first_dod_contract": (("contract_number", "string", "contract_number"), ("contract_value", "double", "contract_value")), "sbir_validated_raise": (("phase2_to_raise_gap_months", "double", "round(g / 30.44::DOUBLE)"),),
    "funding_velocity": (("filings_in_window", "bigint", "n"), ("total_raised_in_window", "double", "t")), "gone_stale": (("months_since_last_signal", "bigint", "floor((DATE '2026-03-01' - l) / 30)"),),
    "sbir_lapse_risk": (("sbir_total", "double", "s"),), "contract_value_step_change": (("latest_contract_value", "double", "v"), ("median_prior_value", "double", "m")), "contract_acceleration": (("recent_24mo_value", "double", "a"), ("prior_24mo_value", "double", "b")),
    "commercial_pathway_fit": (), "sbir_breadth": (("agency_count", "bigint", "n"),), "sole_source_award": (("award", "string", "id"), ("contract_value", "double", "amount")), "jar_funding": (("value", "double", "contract_value"),),
}


def _emit(kind: str, confidence: str, day: str, source: str, base: str = _PH) -> str:
    evidence = "".join(f", CAST({value} AS {'VARCHAR' if t == 'string' else t.upper()}) AS {name}" for name, t, value in EVIDENCE.get(kind, ()))
    return f"{base} SELECT entity_id, '{kind}' AS signal_type, round(CAST({confidence} AS DOUBLE), 4) AS confidence, CAST({day} AS DATE) AS detected_date{evidence} FROM {source}"


_RAMP = "CASE WHEN d <= m THEN least(0.9::DOUBLE, 0.9::DOUBLE - d / greatest(m, 1) * 0.15::DOUBLE) ELSE greatest(0.6::DOUBLE, 0.75::DOUBLE - (least(d / greatest(m, 1), 3) - 1) * 0.10::DOUBLE) END"
_START, _ACT = "entity_id IN (SELECT id FROM startup)", "entity_id IN (SELECT id FROM act)"
_AG = "CASE " + " ".join(f"WHEN upper(contracting_agency) LIKE '%{w}%' THEN '{n}'" for w, n in D.AGENCY_WORDS) + " ELSE substr(contracting_agency, 1, 50) END"
_RAISES = "(SELECT DISTINCT entity_id, event_date, amount FROM f WHERE event_type='REG_D_FILING')"


def _concentration(share: float) -> str:
    return _emit("customer_concentration", "least(0.9::DOUBLE, 0.6::DOUBLE + (v / t - 0.8::DOUBLE) * 1.5)", "(SELECT as_of FROM p)", f"(SELECT entity_id, sum(n) n, sum(value)::DOUBLE t, max(value)::DOUBLE v FROM (SELECT entity_id, contracting_agency, sum(contract_value) value, count(*) n FROM c WHERE contract_value > 0 AND contracting_agency IS NOT NULL AND {_START} GROUP BY 1, 2) GROUP BY 1) WHERE n >= 2 AND v / t >= {share}::DOUBLE")


def _outsized(times: float) -> str:
    return _emit("outsized_award", "least(0.9::DOUBLE, 0.6::DOUBLE + (v / m - 3) * 0.05::DOUBLE)", "award_date", f"(SELECT c.entity_id, award_date, contract_value::DOUBLE v, m, row_number() OVER (PARTITION BY c.entity_id ORDER BY award_date NULLS LAST, contract_number, contract_value) r FROM c JOIN (SELECT entity_id, count(*) n, sum(contract_value)::DOUBLE / count(*) m FROM c WHERE contract_value > 0 GROUP BY 1) a ON a.entity_id = c.entity_id WHERE c.{_START} AND contract_value > 0 AND n >= 2 AND m >= 50000 AND contract_value::DOUBLE >= {times} * m) WHERE r = 1")


SQL = {
    "sig_phase_2_transition": _emit("sbir_phase_2_transition", "0.9", "p2_last", f"ph WHERE p1_n > 0 AND p2_n > 0 AND {_START}"),
    "sig_phase_3_transition": _emit("sbir_phase_3_transition", "0.9", "p3_last", f"ph WHERE p2_n > 0 AND p3_n > 0 AND {_START}"),
    "sig_sbir_stalled": _emit("sbir_stalled", "least(0.9::DOUBLE, 0.6::DOUBLE + 0.05::DOUBLE * p1_n)", "coalesce(p1_last, (SELECT as_of FROM p))", f"ph WHERE p1_n >= 2 AND p2_n = 0 AND p3_n = 0 AND {_ACT}"),
    "sig_graduation_speed": _emit("sbir_graduation_speed", _RAMP, "p2_first", f"(SELECT *, median(d) OVER () m FROM (SELECT *, (p2_first - p1_first)::DOUBLE d FROM ph WHERE p2_first > p1_first AND {_ACT}))"),
    "sig_time_to_contract": _emit("time_to_contract", _RAMP, "fc", f"(SELECT *, median(d) OVER () m FROM (SELECT ph.entity_id, fc, (fc - sbir_first)::DOUBLE d FROM ph JOIN (SELECT entity_id, min(award_date) fc FROM c WHERE contract_value > 0 GROUP BY 1) k USING (entity_id) WHERE fc > sbir_first AND {_ACT}))"),
    "sig_first_dod_contract": _emit("first_dod_contract", "0.75", "award_date", f"(SELECT entity_id, award_date, contract_number, contract_value, row_number() OVER (PARTITION BY entity_id ORDER BY award_date NULLS FIRST, contract_number, contract_value) r FROM c WHERE contract_value >= 100000 AND {_START}) x WHERE r = 1 AND award_date >= DATE '2026-03-01' - 365 AND NOT EXISTS (SELECT 1 FROM f WHERE f.entity_id = x.entity_id AND event_type IN {_SB} AND event_date < DATE '2026-03-01' - 365)"),
    "sig_rapid_contract_growth": _emit("rapid_contract_growth", "least(0.95::DOUBLE, 0.5::DOUBLE + (r - 2) * 0.1::DOUBLE)", "(SELECT as_of FROM p)", f"(SELECT entity_id, (b / 365) / (a / (DATE '2026-03-01' - 365 - DATE '2020-01-01')) r, a, b FROM (SELECT entity_id, (sum(contract_value) FILTER (award_date < DATE '2026-03-01' - 365))::DOUBLE a, (sum(contract_value) FILTER (award_date >= DATE '2026-03-01' - 365))::DOUBLE b FROM c WHERE {_ACT} GROUP BY 1)) WHERE a > 100000 AND b > 100000 AND r >= 2"),
    "sig_high_priority_technology": _emit("high_priority_technology", "least(0.9::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * n)", "(SELECT as_of FROM p)", "(SELECT id AS entity_id, len(list_filter(technology_tags, lambda x: x IN ('ai_ml','autonomy','quantum','hypersonics','cyber','space','directed_energy','c4isr','ew'))) n FROM act) WHERE n > 0"),
    "sig_multi_agency_interest": _emit("multi_agency_interest", "least(0.9::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * (n - 2))", "(SELECT as_of FROM p)", f"(SELECT entity_id, count(DISTINCT {_AG}) n FROM c WHERE trim(contracting_agency) <> '' AND {_START} GROUP BY 1) WHERE n >= 2"),
    "sig_outsized_award": _outsized(3.0),
    "sig_outsized_award_2x": _outsized(2.0),
    "sig_sbir_to_contract": _emit("sbir_to_contract_transition", "least(0.9::DOUBLE, 0.6::DOUBLE + least(t / greatest(sbir_total, 1), 3) * 0.1::DOUBLE)", "coalesce(l, (SELECT as_of FROM p))", f"(SELECT c.entity_id, sbir_total, sum(contract_value)::DOUBLE t, max(award_date) l FROM c JOIN ph USING (entity_id) WHERE contract_value > 0 AND sbir_n > 0 AND (sbir_first IS NULL OR award_date > sbir_first) AND {_ACT} GROUP BY 1, 2)"),
    "sig_sbir_to_vc_raise": _emit("sbir_to_vc_raise", "least(0.9::DOUBLE, 0.7::DOUBLE + CASE WHEN regd_last > sbir_first THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN n >= 2 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN t >= 10000000 THEN 0.05::DOUBLE ELSE 0 END)", "coalesce(regd_last, (SELECT as_of FROM p))", f"ph JOIN (SELECT entity_id, count(*) n, coalesce(sum(amount), 0)::DOUBLE t FROM {_RAISES} GROUP BY 1) r USING (entity_id) WHERE sbir_n > 0 AND regd_n > 0 AND {_ACT}"),
    "sig_sbir_validated_raise": _emit("sbir_validated_raise", "least(0.95::DOUBLE, 0.7::DOUBLE + CASE WHEN regd_first > sbir_first THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN g IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN ra > 5000000 THEN 0.05::DOUBLE ELSE 0 END)", "regd_last", f"""(SELECT ph.*, (SELECT min(b.event_date - a.event_date) FROM f a JOIN f b ON a.entity_id = b.entity_id WHERE a.entity_id = ph.entity_id AND a.event_type='SBIR_PHASE_2' AND b.event_type='REG_D_FILING' AND b.event_date - a.event_date BETWEEN 1 AND 548) g,
 (SELECT sum(amount)::DOUBLE FROM {_RAISES} r WHERE r.entity_id = ph.entity_id AND r.event_date > ph.sbir_first) ra FROM ph WHERE sbir_first IS NOT NULL AND regd_first IS NOT NULL AND {_ACT}) WHERE regd_first > sbir_first OR g IS NOT NULL"""),
    "sig_customer_concentration": _concentration(0.8),
    "sig_customer_concentration_40": _concentration(0.4),
    "sig_funding_velocity": _emit("funding_velocity", "least(0.9::DOUBLE, 0.7::DOUBLE + CASE WHEN n >= 3 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN t >= 10000000 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN t >= 50000000 THEN 0.05::DOUBLE ELSE 0 END)", "u", f"(SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, event_date, u DESC) k FROM (SELECT entity_id, event_date, count(*) OVER w n, coalesce(sum(amount) OVER w, 0)::DOUBLE t, max(event_date) OVER w u FROM f WHERE event_type='REG_D_FILING' AND event_date IS NOT NULL AND {_ACT} WINDOW w AS (PARTITION BY entity_id ORDER BY event_date RANGE BETWEEN CURRENT ROW AND INTERVAL 548 DAY FOLLOWING))) WHERE k = 1 AND n >= 2"),
    "sig_gone_stale": _emit("gone_stale", "least(0.9::DOUBLE, 0.6::DOUBLE + 0.01::DOUBLE * floor((DATE '2026-03-01' - l) / 30))", "(SELECT as_of FROM p)", f"(SELECT entity_id, max(detected_date) l FROM s WHERE status='ACTIVE' AND base_type IS DISTINCT FROM 'gone_stale' AND base_type IS NOT NULL GROUP BY 1) x WHERE l < DATE '2026-03-01' - 730 AND {_ACT} AND NOT EXISTS (SELECT 1 FROM c WHERE c.entity_id = x.entity_id AND award_date >= DATE '2026-03-01' - 730) AND NOT EXISTS (SELECT 1 FROM f WHERE f.entity_id = x.entity_id AND event_date >= DATE '2026-03-01' - 730)"),
    "sig_sbir_lapse_risk": _emit("sbir_lapse_risk", "round(s / (s + coalesce(ct, 0)), 2)", "(SELECT as_of FROM p)", f"(SELECT x.*, (SELECT sum(contract_value)::DOUBLE FROM c WHERE c.entity_id = x.entity_id) ct FROM (SELECT entity_id, count(*) FILTER (event_type IN {_SB}) n, coalesce(sum(amount) FILTER (event_type IN {_SB}), 0)::DOUBLE s, coalesce(sum(amount) FILTER (event_type IN ('REG_D_FILING','PRIVATE_ROUND')), 0)::DOUBLE pr FROM f WHERE id NOT IN (SELECT parent_event_id FROM f WHERE parent_event_id IS NOT NULL) GROUP BY 1) x) WHERE s >= 500000 AND n >= 2 AND pr < 1000000 AND {_START} AND s / (s + coalesce(ct, 0)) > 0.7::DOUBLE"),
    "sig_ota_bridge_award": _emit("ota_bridge_award", "0.9", "d", f"(SELECT c.entity_id, min(award_date) d FROM c JOIN (SELECT entity_id, min(award_date) o FROM c WHERE procurement_type='ota' AND award_date IS NOT NULL GROUP BY 1) k USING (entity_id) WHERE procurement_type='standard' AND award_date > o AND {_START} GROUP BY 1)"),
    "sig_multi_vehicle_presence": _emit("multi_vehicle_presence", "0.8", "(SELECT as_of FROM p)", f"(SELECT entity_id, max(coalesce(procurement_type='ota', false)::INT) + max(coalesce((upper(psc_code) LIKE 'A%'), false)::INT) + max((coalesce(procurement_type='standard', false) AND NOT coalesce(upper(psc_code) LIKE 'A%', false))::INT) + max((entity_id IN (SELECT entity_id FROM f WHERE event_type IN {_SB} AND entity_id IS NOT NULL))::INT) k FROM c WHERE {_START} GROUP BY 1) WHERE k >= 3"),
    "sig_contract_value_step_change": _emit("contract_value_step_change", "0.75", "award_date", f"(SELECT x.*, (SELECT median(contract_value::DOUBLE) FROM c WHERE c.entity_id = x.entity_id AND c.id <> x.id AND contract_value > 0 AND award_date IS NOT NULL) m FROM (SELECT entity_id, id, award_date, contract_value::DOUBLE v, row_number() OVER (PARTITION BY entity_id ORDER BY award_date DESC, id DESC) r, count(*) OVER (PARTITION BY entity_id) n FROM c WHERE contract_value > 0 AND award_date IS NOT NULL AND {_START}) x WHERE r = 1 AND n >= 4) WHERE v >= 5 * m"),
    "sig_contract_acceleration": _emit("contract_acceleration", "CASE WHEN r >= 10 THEN 0.9::DOUBLE ELSE round(least(0.9::DOUBLE, 0.6::DOUBLE + (r - 3) * 0.05::DOUBLE), 2) END", "l", f"(SELECT *, CASE WHEN b > 0 THEN a / b ELSE a / 500000 * 3 END r FROM (SELECT entity_id, count(*) FILTER (award_date >= DATE '2026-03-01' - 720) n, coalesce(sum(contract_value) FILTER (award_date >= DATE '2026-03-01' - 720), 0)::DOUBLE a, coalesce(sum(contract_value) FILTER (award_date >= DATE '2026-03-01' - 1440 AND award_date < DATE '2026-03-01' - 720), 0)::DOUBLE b, max(award_date) l FROM c WHERE contract_value > 0 AND award_date IS NOT NULL AND {_START} GROUP BY 1)) WHERE n >= 2 AND a >= 500000 AND r >= 3"),
    "sig_commercial_pathway_fit": _emit("commercial_pathway_fit", "least(z, 1)", "(SELECT as_of FROM p)", f"(SELECT e.id AS entity_id, CASE WHEN coalesce(sb, 0) > 0 AND coalesce(pv, 0) > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN e.id IN (SELECT entity_id FROM c WHERE entity_id IS NOT NULL) AND coalesce(pv, 0) > 0 THEN 0.2::DOUBLE ELSE 0 END + least(0.1::DOUBLE * coalesce(len(list_filter(technology_tags, lambda x: regexp_matches(lower(x), 'commercial|dual-use|enterprise|saas|cloud'))), 0), 0.2::DOUBLE) z FROM startup e LEFT JOIN (SELECT entity_id, count(*) FILTER (event_type IN {_SB}) sb, count(*) FILTER (event_type IN ('REG_D_FILING','PRIVATE_ROUND')) pv FROM f WHERE entity_id IS NOT NULL GROUP BY 1) k ON k.entity_id = e.id) WHERE z >= 0.4::DOUBLE"),
    "sig_sole_source_award": _emit("sole_source_award", "0.85", "coalesce(event_date, (SELECT as_of FROM p))", f"(SELECT * FROM f WHERE raw_data LIKE '%competitionInformation%' AND {_START} AND json_valid(raw_data) AND json_type(raw_data) = 'OBJECT' AND (json_extract_string(raw_data, '$.coreData.competitionInformation.extentCompeted.code') = 'C' OR json_extract_string(raw_data, '$.coreData.competitionInformation.solicitationProcedures.code') = 'SSS'))"),
    "sig_jar_funding": _emit("jar_funding", "0.95", "coalesce(award_date, (SELECT as_of FROM p))", "(SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY id) r FROM c WHERE entity_id IS NOT NULL AND (procurement_type = 'jar' OR contract_type ILIKE '%joint acceleration%')) WHERE r = 1"),
    "sig_sbir_breadth": _emit("sbir_breadth", "CASE WHEN n >= 8 THEN 0.95 WHEN n >= 6 THEN 0.85 ELSE 0.6 + 0.125 * (n - 4) END", "coalesce(l, (SELECT as_of FROM p))", f"(SELECT b.entity_id, n, l, len(technology_tags) tags, bs, ag FROM (SELECT entity_id, count(DISTINCT br) n, list(DISTINCT br) FILTER (br IS NOT NULL) bs, max(event_date) l FROM (SELECT entity_id, event_date, CASE WHEN json_valid(raw_data) AND json_type(raw_data) = 'OBJECT' THEN nullif(coalesce(json_extract_string(raw_data, '$.Branch'), json_extract_string(raw_data, '$.branch')), '') END br FROM f WHERE event_type IN ('SBIR_PHASE_1','SBIR_PHASE_2')) GROUP BY 1) b JOIN startup e ON e.id = b.entity_id LEFT JOIN (SELECT entity_id, list(DISTINCT {_AG}) ag FROM c WHERE trim(contracting_agency) <> '' AND {_START} GROUP BY 1 HAVING count(DISTINCT {_AG}) >= 2) k ON k.entity_id = b.entity_id WHERE n >= 4 AND len(technology_tags) >= 3) WHERE ag IS NULL OR NOT list_has_all(ag, bs) OR tags > 3"),
    "sig_summary": BASE_SQL + " SELECT base_type, count(*)::BIGINT AS n FROM s WHERE status = 'ACTIVE' AND base_type IS NOT NULL GROUP BY 1",
    "sig_top": BASE_SQL + " SELECT t.entity_id, base_type, confidence, canonical_name FROM (SELECT DISTINCT entity_id, base_type, confidence FROM s WHERE status = 'ACTIVE' AND entity_id IS NOT NULL AND base_type IS NOT NULL AND confidence IS NOT NULL ORDER BY confidence DESC, entity_id, base_type LIMIT 10) t LEFT JOIN entities e ON e.id = t.entity_id",
}
_CALLS = {
    "sig_phase_2_transition": D.phase_2_transition, "sig_phase_3_transition": D.phase_3_transition, "sig_sbir_stalled": D.sbir_stalled, "sig_graduation_speed": D.graduation_speed, "sig_time_to_contract": D.time_to_contract,
    "sig_first_dod_contract": D.first_dod_contract, "sig_rapid_contract_growth": D.rapid_contract_growth, "sig_high_priority_technology": D.high_priority_technology, "sig_multi_agency_interest": D.multi_agency_interest,
    "sig_outsized_award": D.outsized_award, "sig_outsized_award_2x": lambda s, d: D.outsized_award(s, d, 2.0), "sig_sbir_to_contract": D.sbir_to_contract, "sig_sbir_to_vc_raise": D.sbir_to_vc_raise, "sig_sbir_validated_raise": D.sbir_validated_raise,
    "sig_customer_concentration": D.customer_concentration, "sig_customer_concentration_40": lambda s, d: D.customer_concentration(s, d, 0.4), "sig_funding_velocity": D.funding_velocity, "sig_gone_stale": D.gone_stale, "sig_sbir_lapse_risk": D.sbir_lapse_risk,
    "sig_ota_bridge_award": D.ota_bridge_award, "sig_multi_vehicle_presence": D.multi_vehicle_presence, "sig_contract_value_step_change": D.contract_value_step_change, "sig_contract_acceleration": D.contract_acceleration, "sig_sole_source_award": D.sole_source_award,
    "sig_sbir_breadth": D.sbir_breadth, "sig_commercial_pathway_fit": D.commercial_pathway_fit, "sig_jar_funding": D.jar_funding,
}


#: The signal type of each query.
_KINDS = {k: next((t for t, f in D.DETECTORS.items() if f is g), None) for k, g in _CALLS.items()} | {"sig_outsized_award_2x": "outsized_award", "sig_customer_concentration_40": "customer_concentration"}


def _checked(name: str):
    """The query of a detector: its signals with the checked fields of the evidence as columns."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        fields = [F.get_json_object("evidence", f"$.{n}").cast(t).alias(n) for n, t, _ in EVIDENCE.get(_KINDS[name], ())]
        return _CALLS[name](spark, sf).select("entity_id", "signal_type", "confidence", "detected_date", *fields)

    return run


def _active(spark: SparkSession, sf: str) -> DataFrame:
    return V.signals(spark, sf).filter("status = 'ACTIVE' AND base_type IS NOT NULL")


def queries() -> dict:
    q = {k: _checked(k) for k in _CALLS}
    q["sig_all"] = lambda spark, sf: D.detect(spark, sf).groupBy("signal_type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("total"), F.count("evidence").alias("with_evidence"), F.max("evidence").alias("an_evidence"))
    q["sig_summary"] = lambda spark, sf: _active(spark, sf).groupBy("base_type").agg(F.count("*").alias("n"))
    q["sig_top"] = lambda spark, sf: D.top_signals(_active(spark, sf).filter("entity_id IS NOT NULL AND confidence IS NOT NULL").select("entity_id", "base_type", "confidence").distinct(), V.entities(spark, sf).select(F.col("id").alias("entity_id"), "canonical_name"))
    return q


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
