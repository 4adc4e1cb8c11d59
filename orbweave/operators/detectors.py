"""Signal detectors: set-oriented rules over the clean views.

Every detector takes a session and a folder of tables and gives (entity_id, signal_type, confidence, detected_date,
evidence); evidence is a JSON object. One pass per fact table groups by entity before entities are joined, so the fact
tables are shuffled once, by key and with map-side combine. First and latest rows are decided by date, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.sources import views as V

HIGH, MEDIUM, LOW = 0.90, 0.75, 0.60
#: The tags that count as priority technology.
PRIORITY_TAGS = ("ai_ml", "autonomy", "quantum", "hypersonics", "cyber", "space", "directed_energy", "c4isr", "ew")
#: What makes a tag one that also sells outside government.
DUAL_USE = ("commercial", "dual-use", "enterprise", "saas", "cloud")
RAISE_WINDOW = 548  # days


def _out(df: DataFrame, kind: str, confidence: Column, day: Column, *evidence: Column) -> DataFrame:
    return df.select("entity_id", F.lit(kind).alias("signal_type"), F.round(confidence.cast("double"), 4).alias("confidence"), day.cast("date").alias("detected_date"), F.to_json(F.struct(*evidence)).alias("evidence"))


def _of(facts: DataFrame, population: DataFrame) -> DataFrame:
    return facts.join(population.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")


def _is(*kinds: str) -> Column:
    return F.col("event_type").isin(*kinds)


def _when(cond: Column, x: Column | str) -> Column:
    return F.when(cond, F.col(x) if isinstance(x, str) else x)


def phases(spark: SparkSession, sf: str) -> DataFrame:
    """Per entity: counts, totals and dates of the award phases and of private filings."""
    out = []
    for k, kind in (("p1", "SBIR_PHASE_1"), ("p2", "SBIR_PHASE_2"), ("p3", "SBIR_PHASE_3"), ("regd", "REG_D_FILING")):
        out += [F.count_if(_is(kind)).alias(f"{k}_n"), F.coalesce(F.sum(_when(_is(kind), "amount")), F.lit(0)).cast("double").alias(f"{k}_total"), F.min(_when(_is(kind), "event_date")).alias(f"{k}_first"), F.max(_when(_is(kind), "event_date")).alias(f"{k}_last")]
    sbir = _is(*V.SBIR)
    out += [F.count_if(sbir).alias("sbir_n"), F.coalesce(F.sum(_when(sbir, "amount")), F.lit(0)).cast("double").alias("sbir_total"), F.min(_when(sbir, "event_date")).alias("sbir_first"), F.max(_when(sbir, "event_date")).alias("sbir_last")]
    return V.funding(spark, sf).filter(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(*out)


def phase_2_transition(spark: SparkSession, sf: str) -> DataFrame:
    d = _of(phases(spark, sf), V.startups(spark, sf)).filter("p1_n > 0 AND p2_n > 0")
    return _out(d, "sbir_phase_2_transition", F.lit(HIGH), F.col("p2_last"), F.col("p1_n").alias("phase_1_count"), F.col("p2_n").alias("phase_2_count"), F.col("p2_total").alias("total_phase_2_value"))


def phase_3_transition(spark: SparkSession, sf: str) -> DataFrame:
    d = _of(phases(spark, sf), V.startups(spark, sf)).filter("p2_n > 0 AND p3_n > 0")
    return _out(d, "sbir_phase_3_transition", F.lit(HIGH), F.col("p3_last"), F.col("p2_n").alias("phase_2_count"), F.col("p3_n").alias("phase_3_count"), F.col("p3_total").alias("total_phase_3_value"))


def sbir_stalled(spark: SparkSession, sf: str) -> DataFrame:
    d = _of(phases(spark, sf), V.active(spark, sf)).filter("p1_n >= 2 AND p2_n = 0 AND p3_n = 0")
    return _out(d, "sbir_stalled", F.least(F.lit(0.9), 0.6 + 0.05 * F.col("p1_n")), F.coalesce("p1_last", V.as_of()), F.col("p1_n").alias("phase_1_count"), F.col("p1_total").alias("total_phase_1_value"))


def _ramp(days: Column, median: Column) -> Column:
    """Faster than the median scores .75 to .90, slower falls to .60."""
    m = F.greatest(median, F.lit(1.0))
    return F.when(days <= median, F.least(F.lit(0.9), 0.9 - days / m * 0.15)).otherwise(F.greatest(F.lit(0.6), 0.75 - (F.least(days / m, F.lit(3.0)) - 1) * 0.10))


def graduation_speed(spark: SparkSession, sf: str) -> DataFrame:
    d = _of(phases(spark, sf), V.active(spark, sf)).filter("p2_first > p1_first").withColumn("days", F.datediff("p2_first", "p1_first").cast("double"))
    d = d.crossJoin(F.broadcast(d.agg(F.median("days").alias("median"))))  # one row
    return _out(d, "sbir_graduation_speed", _ramp(F.col("days"), F.col("median")), F.col("p2_first"), F.col("days").alias("days_to_graduate"), F.round("median").alias("median_days"))


def time_to_contract(spark: SparkSession, sf: str) -> DataFrame:
    first = V.contracts(spark, sf).filter("contract_value > 0").groupBy("entity_id").agg(F.min("award_date").alias("first_contract"))
    d = _of(phases(spark, sf), V.active(spark, sf)).join(first, "entity_id").filter("first_contract > sbir_first").withColumn("days", F.datediff("first_contract", "sbir_first").cast("double"))
    d = d.crossJoin(F.broadcast(d.agg(F.median("days").alias("median"))))  # one row
    return _out(d, "time_to_contract", _ramp(F.col("days"), F.col("median")), F.col("first_contract"), F.col("days").alias("days_to_contract"), F.round("median").alias("median_days"))


def first_dod_contract(spark: SparkSession, sf: str, lookback: int = 365, floor: int = 100_000) -> DataFrame:
    cutoff = F.date_sub(V.as_of(), lookback)
    c = _of(V.contracts(spark, sf).filter(F.col("contract_value") >= floor), V.startups(spark, sf))
    # a missing date sorts first, as in the rule's origin, and then nothing fires
    first = c.groupBy("entity_id").agg(F.min(F.struct(F.col("award_date").isNotNull().alias("dated"), F.col("award_date").alias("day"), F.col("contract_number").alias("number"), F.col("contract_value").alias("value"), F.col("contracting_agency").alias("agency"))).alias("x")).select("entity_id", "x.*").filter(F.col("day") >= cutoff)
    earlier = V.funding(spark, sf).filter(_is(*V.SBIR) & (F.col("event_date") < cutoff)).select("entity_id")
    return _out(first.join(earlier, "entity_id", "left_anti"), "first_dod_contract", F.lit(MEDIUM), F.col("day"), F.col("number").alias("contract_number"), F.col("value").cast("double").alias("contract_value"), F.col("agency").alias("contracting_agency"))


def rapid_contract_growth(spark: SparkSession, sf: str, lookback: int = 365) -> DataFrame:
    cutoff = F.date_sub(V.as_of(), lookback)
    c = _of(V.contracts(spark, sf), V.active(spark, sf))
    d = c.groupBy("entity_id").agg(F.sum(_when(F.col("award_date") < cutoff, "contract_value")).cast("double").alias("before"), F.sum(_when(F.col("award_date") >= cutoff, "contract_value")).cast("double").alias("since"))
    rate = (F.col("since") / lookback) / (F.col("before") / F.datediff(cutoff, F.lit("2020-01-01").cast("date")))
    d = d.filter("before > 100000 AND since > 100000").withColumn("r", rate).filter("r >= 2")
    return _out(d, "rapid_contract_growth", F.least(F.lit(0.95), 0.5 + (F.col("r") - 2) * 0.1), V.as_of(), F.col("before").alias("historical_total"), F.col("since").alias("recent_total"), F.round("r", 2).alias("growth_rate"))


def high_priority_technology(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.filter("technology_tags", lambda t: t.isin(*PRIORITY_TAGS))
    d = V.active(spark, sf).select(F.col("id").alias("entity_id"), F.array_sort(hits).alias("hits")).filter(F.size("hits") > 0)
    return _out(d, "high_priority_technology", F.least(F.lit(0.9), 0.6 + 0.1 * F.size("hits")), V.as_of(), F.col("hits").alias("priority_technologies"), F.size("hits").alias("priority_count"))


#: The words that name an agency, in the order in which they count, and its short name.
AGENCY_WORDS = (("ARMY", "Army"), ("NAVY", "Navy"), ("NAVAL", "Navy"), ("AIR FORCE", "Air Force"), ("SPACE FORCE", "Space Force"), ("DARPA", "DARPA"), ("DLA", "DLA"), ("DISA", "DISA"), ("MDA", "MDA"), ("MISSILE DEFENSE", "MDA"))


def agency_key(c: Column) -> Column:
    """An agency under one name: the service or bureau it speaks of, else its first fifty characters."""
    u = F.upper(c)
    out = F.substring(c, 1, 50)
    for word, name in reversed(AGENCY_WORDS):
        out = F.when(u.contains(word), F.lit(name)).otherwise(out)
    return out


def multi_agency_interest(spark: SparkSession, sf: str) -> DataFrame:
    c = _of(V.contracts(spark, sf).filter(F.trim("contracting_agency") != ""), V.startups(spark, sf))
    d = c.select("entity_id", agency_key(F.col("contracting_agency")).alias("agency")).distinct().groupBy("entity_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("agency")).alias("agencies")).filter("n >= 2")
    return _out(d, "multi_agency_interest", F.least(F.lit(0.9), 0.6 + 0.1 * (F.col("n") - 2)), V.as_of(), F.col("agencies"), F.col("n").alias("agency_count"))


def outsized_award(spark: SparkSession, sf: str, times: float = 3.0) -> DataFrame:
    c = _of(V.contracts(spark, sf).filter("contract_value > 0"), V.startups(spark, sf))
    mean = c.groupBy("entity_id").agg(F.count("*").alias("n"), (F.sum("contract_value").cast("double") / F.count("*")).alias("mean")).filter("n >= 2 AND mean >= 50000")
    big = c.join(mean, "entity_id").filter(F.col("contract_value").cast("double") >= times * F.col("mean"))
    d = big.groupBy("entity_id").agg(F.min(F.struct(F.col("award_date").isNull().alias("undated"), F.col("award_date").alias("day"), F.col("contract_number").alias("number"), F.col("contract_value").cast("double").alias("value"), F.col("mean"))).alias("x")).select("entity_id", "x.*")
    r = F.col("value") / F.col("mean")
    return _out(d, "outsized_award", F.least(F.lit(0.9), 0.6 + (r - 3) * 0.05), F.col("day"), F.col("number").alias("contract_number"), F.col("value").alias("contract_value"), F.round(r, 2).alias("size_ratio"))


def sbir_to_contract(spark: SparkSession, sf: str) -> DataFrame:
    p = _of(phases(spark, sf).filter("sbir_n > 0"), V.active(spark, sf)).select("entity_id", "sbir_n", "sbir_total", "sbir_first")
    c = V.contracts(spark, sf).filter("contract_value > 0").join(p, "entity_id").filter(F.col("sbir_first").isNull() | (F.col("award_date") > F.col("sbir_first")))
    d = c.groupBy("entity_id", "sbir_n", "sbir_total").agg(F.count("*").alias("n"), F.sum("contract_value").cast("double").alias("total"), F.max("award_date").alias("last"))
    ratio = F.least(F.col("total") / F.greatest(F.col("sbir_total"), F.lit(1.0)), F.lit(3.0))
    return _out(d, "sbir_to_contract_transition", F.least(F.lit(0.9), 0.6 + ratio * 0.1), F.coalesce("last", V.as_of()), F.col("sbir_n").alias("sbir_award_count"), F.col("n").alias("post_sbir_contract_count"), F.col("total").alias("total_contract_value"))


def _raises(spark: SparkSession, sf: str) -> DataFrame:
    """Filings with equal entity, day and amount counted once."""
    return V.funding(spark, sf).filter(_is("REG_D_FILING")).select("entity_id", "event_date", "amount").distinct()


def sbir_to_vc_raise(spark: SparkSession, sf: str) -> DataFrame:
    p = _of(phases(spark, sf).filter("sbir_n > 0 AND regd_n > 0"), V.active(spark, sf)).select("entity_id", "sbir_n", "sbir_first", "regd_last")
    r = _raises(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total"))
    d = p.join(r, "entity_id")
    score = 0.7 + F.when(F.col("regd_last") > F.col("sbir_first"), 0.1).otherwise(0.0) + F.when(F.col("n") >= 2, 0.05).otherwise(0.0) + F.when(F.col("total") >= 10_000_000, 0.05).otherwise(0.0)
    return _out(d, "sbir_to_vc_raise", F.least(F.lit(0.9), score), F.coalesce("regd_last", V.as_of()), F.col("sbir_n").alias("sbir_award_count"), F.col("n").alias("regd_filing_count"), F.col("total").alias("total_regd_value"))


def sbir_validated_raise(spark: SparkSession, sf: str) -> DataFrame:
    p = _of(phases(spark, sf).filter("sbir_first IS NOT NULL AND regd_first IS NOT NULL"), V.active(spark, sf)).select("entity_id", "sbir_first", "regd_first", "regd_last")
    twos = V.funding(spark, sf).filter(_is("SBIR_PHASE_2")).select("entity_id", F.col("event_date").alias("p2")).distinct()
    filings = V.funding(spark, sf).filter(_is("REG_D_FILING")).select("entity_id", F.col("event_date").alias("raised")).distinct()
    gap = F.datediff("raised", "p2")
    near = twos.join(filings, "entity_id").filter(gap.between(1, RAISE_WINDOW)).groupBy("entity_id").agg(F.min(gap).alias("gap"))
    after = _raises(spark, sf).join(p.select("entity_id", "sbir_first"), "entity_id").filter("event_date > sbir_first").groupBy("entity_id").agg(F.sum("amount").cast("double").alias("raised_after"))
    d = p.join(near, "entity_id", "left").join(after, "entity_id", "left").withColumn("a", F.col("regd_first") > F.col("sbir_first")).filter("a OR gap IS NOT NULL")
    score = 0.7 + F.when(F.col("a"), 0.1).otherwise(0.0) + F.when(F.col("gap").isNotNull(), 0.1).otherwise(0.0) + F.when(F.col("raised_after") > 5_000_000, 0.05).otherwise(0.0)
    order = F.when(F.col("regd_first") > F.col("sbir_first"), "sbir_first").when(F.col("regd_last") > F.col("sbir_first"), "mixed").otherwise("vc_first")
    return _out(d, "sbir_validated_raise", F.least(F.lit(0.95), score), F.col("regd_last"), order.alias("sequence"), F.round(F.col("gap") / 30.44).alias("phase2_to_raise_gap_months"))


def customer_concentration(spark: SparkSession, sf: str, share: float = 0.8) -> DataFrame:
    c = _of(V.contracts(spark, sf).filter("contract_value > 0 AND contracting_agency IS NOT NULL"), V.startups(spark, sf))
    by = c.groupBy("entity_id", "contracting_agency").agg(F.sum("contract_value").alias("value"), F.count("*").alias("n"))
    d = by.groupBy("entity_id").agg(F.sum("n").alias("n"), F.sum("value").cast("double").alias("total"), F.max(F.struct(F.col("value"), F.col("contracting_agency").alias("agency"))).alias("top"))
    d = d.withColumn("share", F.col("top.value").cast("double") / F.col("total")).filter((F.col("n") >= 2) & (F.col("share") >= share))
    return _out(d, "customer_concentration", F.least(F.lit(0.9), 0.6 + (F.col("share") - 0.8) * 1.5), V.as_of(), F.col("top.agency").alias("dominant_agency"), F.round(F.col("share") * 100, 1).alias("concentration_pct"))


def funding_velocity(spark: SparkSession, sf: str) -> DataFrame:
    r = _of(V.funding(spark, sf).filter(_is("REG_D_FILING") & F.col("event_date").isNotNull()), V.active(spark, sf)).withColumn("d", F.datediff("event_date", F.lit("1970-01-01").cast("date")))
    ahead = Window.partitionBy("entity_id").orderBy("d").rangeBetween(0, RAISE_WINDOW)
    w = r.select("entity_id", "event_date", F.count("*").over(ahead).alias("n"), F.sum("amount").over(ahead).alias("total"), F.max("event_date").over(ahead).alias("until"))
    d = w.groupBy("entity_id").agg(F.max(F.struct(F.col("n"), (-F.datediff("event_date", F.lit("1970-01-01").cast("date"))).alias("early"), F.col("until"), F.col("total"))).alias("x")).select("entity_id", "x.*").filter("n >= 2")
    total = F.coalesce(F.col("total"), F.lit(0)).cast("double")
    score = 0.7 + F.when(F.col("n") >= 3, 0.1).otherwise(0.0) + F.when(total >= 10_000_000, 0.05).otherwise(0.0) + F.when(total >= 50_000_000, 0.05).otherwise(0.0)
    return _out(d, "funding_velocity", F.least(F.lit(0.9), score), F.col("until"), F.col("n").alias("filings_in_window"), total.alias("total_raised_in_window"))


def gone_stale(spark: SparkSession, sf: str, days: int = 730) -> DataFrame:
    cutoff = F.date_sub(V.as_of(), days)
    s = V.signals(spark, sf).filter((F.col("status") == "ACTIVE") & (F.col("base_type") != "gone_stale"))
    last = _of(s.groupBy("entity_id").agg(F.max("detected_date").alias("last"), F.count("*").alias("n")).filter(F.col("last") < cutoff), V.active(spark, sf))
    d = last.join(V.contracts(spark, sf).filter(F.col("award_date") >= cutoff), "entity_id", "left_anti").join(V.funding(spark, sf).filter(F.col("event_date") >= cutoff), "entity_id", "left_anti")
    months = F.floor(F.datediff(V.as_of(), F.col("last")) / 30)
    return _out(d, "gone_stale", F.least(F.lit(0.9), 0.6 + 0.01 * months), V.as_of(), months.alias("months_since_last_signal"), F.col("n").alias("active_signal_count"))


def superseded(f: DataFrame) -> DataFrame:
    """Events without those that another event names as its parent."""
    return f.join(f.filter(F.col("parent_event_id").isNotNull()).select(F.col("parent_event_id").alias("id")), "id", "left_anti")


def sbir_lapse_risk(spark: SparkSession, sf: str) -> DataFrame:
    f = superseded(V.funding(spark, sf)).groupBy("entity_id").agg(F.count_if(_is(*V.SBIR)).alias("n"), F.coalesce(F.sum(_when(_is(*V.SBIR), "amount")), F.lit(0)).cast("double").alias("sbir"), F.coalesce(F.sum(_when(_is("REG_D_FILING", "PRIVATE_ROUND"), "amount")), F.lit(0)).cast("double").alias("private"))
    c = V.contracts(spark, sf).groupBy("entity_id").agg(F.coalesce(F.sum("contract_value"), F.lit(0)).cast("double").alias("contract"))
    d = _of(f.filter("sbir >= 500000 AND n >= 2 AND private < 1000000"), V.startups(spark, sf)).join(c, "entity_id", "left")
    d = d.withColumn("share", F.col("sbir") / (F.col("sbir") + F.coalesce("contract", F.lit(0.0)))).filter("share > 0.7")
    risk = F.when(F.col("share") >= 0.9, "high").when(F.col("share") >= 0.8, "medium").otherwise("low")
    return _out(d, "sbir_lapse_risk", F.round("share", 2), V.as_of(), F.col("sbir").alias("sbir_total"), risk.alias("risk_level"))


def ota_bridge_award(spark: SparkSession, sf: str) -> DataFrame:
    c = _of(V.contracts(spark, sf).filter("award_date IS NOT NULL"), V.startups(spark, sf))
    ota = c.filter("procurement_type = 'ota'").groupBy("entity_id").agg(F.min("award_date").alias("ota"))
    d = c.filter("procurement_type = 'standard'").join(ota, "entity_id").filter("award_date > ota").groupBy("entity_id", "ota").agg(F.min(F.struct("award_date", "contract_number")).alias("x"))
    gap = F.round(F.datediff("x.award_date", "ota") / 30.44, 1)
    return _out(d, "ota_bridge_award", F.lit(HIGH), F.col("x.award_date"), F.col("ota").alias("ota_date"), gap.alias("gap_months"))


def multi_vehicle_presence(spark: SparkSession, sf: str, least: int = 3) -> DataFrame:
    std = F.col("procurement_type") == "standard"
    psc_a = F.coalesce(F.upper("psc_code").startswith("A"), F.lit(False))
    c = _of(V.contracts(spark, sf), V.startups(spark, sf)).groupBy("entity_id").agg(F.max(F.col("procurement_type") == "ota").alias("ota"), F.max(psc_a).alias("baa_rd"), F.max(std & ~psc_a).alias("standard_production"))
    sbir = V.funding(spark, sf).filter(_is(*V.SBIR)).select("entity_id").distinct().withColumn("sbir", F.lit(True))
    d = c.join(sbir, "entity_id", "left")
    kinds = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("ota", "sbir", "baa_rd", "standard_production")]))
    return _out(d.withColumn("kinds", kinds).filter(F.size("kinds") >= least), "multi_vehicle_presence", F.lit(0.8), V.as_of(), F.col("kinds").alias("vehicle_types"))


def contract_value_step_change(spark: SparkSession, sf: str, times: float = 5.0) -> DataFrame:
    c = _of(V.contracts(spark, sf).filter("contract_value > 0 AND award_date IS NOT NULL"), V.startups(spark, sf))
    last = c.groupBy("entity_id").agg(F.count("*").alias("n"), F.max(F.struct("award_date", "id", F.col("contract_value").cast("double").alias("value"))).alias("x")).filter("n >= 4")
    rest = c.join(last, "entity_id").filter("id <> x.id").groupBy("entity_id", "n", "x").agg(F.median(F.col("contract_value").cast("double")).alias("median"))
    d = rest.filter(F.col("x.value") >= times * F.col("median"))
    return _out(d, "contract_value_step_change", F.lit(MEDIUM), F.col("x.award_date"), F.col("x.value").alias("latest_contract_value"), F.col("median").alias("median_prior_value"), (F.col("n") - 1).alias("prior_contract_count"))


def contract_acceleration(spark: SparkSession, sf: str) -> DataFrame:
    half, full = F.date_sub(V.as_of(), 720), F.date_sub(V.as_of(), 1440)
    c = _of(V.contracts(spark, sf).filter("contract_value > 0 AND award_date IS NOT NULL"), V.startups(spark, sf))
    recent, prior = F.col("award_date") >= half, (F.col("award_date") >= full) & (F.col("award_date") < half)
    d = c.groupBy("entity_id").agg(F.count_if(recent).alias("n"), F.coalesce(F.sum(_when(recent, "contract_value")), F.lit(0)).cast("double").alias("now"), F.coalesce(F.sum(_when(prior, "contract_value")), F.lit(0)).cast("double").alias("then"), F.max(_when(recent, "award_date")).alias("last"))
    ratio = F.when(F.col("then") > 0, F.col("now") / F.nullif(F.col("then"), F.lit(0.0))).otherwise(F.col("now") / 500_000 * 3)
    d = d.filter("n >= 2 AND now >= 500000").withColumn("r", ratio).filter("r >= 3")
    score = F.when(F.col("r") >= 10, 0.9).otherwise(F.round(F.least(F.lit(0.9), 0.6 + (F.col("r") - 3) * 0.05), 2))
    return _out(d, "contract_acceleration", score, F.col("last"), F.col("now").alias("recent_24mo_value"), F.col("then").alias("prior_24mo_value"))


def sole_source_award(spark: SparkSession, sf: str) -> DataFrame:
    """Awards that were not competed; one signal per award, as the last one written stands for the entity.

    The competition codes are in the payload of the award. Contracts have no payload here, so the payloads of the CONTRACT
    events are read, and those of other-transaction agreements are the ones that carry the codes.
    """
    j = lambda p: F.get_json_object("raw_data", f"$.coreData.competitionInformation.{p}.code")
    f = _of(V.funding(spark, sf).filter(F.col("raw_data").contains("competitionInformation")), V.startups(spark, sf)).filter((j("extentCompeted") == "C") | (j("solicitationProcedures") == "SSS"))
    return _out(f, "sole_source_award", F.lit(0.85), F.coalesce("event_date", V.as_of()), F.col("id").alias("award"), F.col("amount").cast("double").alias("contract_value"))


def sbir_breadth(spark: SparkSession, sf: str) -> DataFrame:
    """Awards of four and more branches by entities with at least three tags.

    Left out is an entity of exactly three tags whose agencies as found by multi_agency_interest hold all these branches.
    """
    agency = F.nullif(F.coalesce(F.get_json_object("raw_data", "$.Branch"), F.get_json_object("raw_data", "$.branch")), F.lit(""))
    f = _of(V.funding(spark, sf).filter(_is("SBIR_PHASE_1", "SBIR_PHASE_2")), V.startups(spark, sf).filter(F.size("technology_tags") >= 3))
    d = f.withColumn("agency", agency).groupBy("entity_id").agg(F.count_distinct("agency").alias("n"), F.array_sort(F.collect_set("agency")).alias("branches"), F.max("event_date").alias("last")).filter("n >= 4")
    known = multi_agency_interest(spark, sf).select("entity_id", F.from_json(F.get_json_object("evidence", "$.agencies"), "array<string>").alias("agencies"))
    tags = V.startups(spark, sf).select(F.col("id").alias("entity_id"), F.size("technology_tags").alias("tags"))
    d = d.join(tags, "entity_id").join(known, "entity_id", "left").filter(F.col("agencies").isNull() | (F.size(F.array_except("branches", "agencies")) > 0) | (F.col("tags") > 3))
    score = F.when(F.col("n") >= 8, 0.95).when(F.col("n") >= 6, 0.85).otherwise(0.6 + 0.125 * (F.col("n") - 4))
    return _out(d, "sbir_breadth", score, F.coalesce("last", V.as_of()), F.col("branches").alias("agencies"), F.col("n").alias("agency_count"))


def commercial_pathway_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Private capital beside awards and contracts, and tags that sell outside government.

    The rule's term for words of the business description is 0: entities have no such description.
    """
    p = V.funding(spark, sf).filter(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.count_if(_is(*V.SBIR)).alias("sbir_n"), F.count_if(_is("REG_D_FILING", "PRIVATE_ROUND")).alias("regd_n"))
    c = V.contracts(spark, sf).groupBy("entity_id").agg(F.count("*").alias("contract_n"))
    dual = F.size(F.filter("technology_tags", lambda t: F.lower(t).rlike("|".join(DUAL_USE))))
    e = V.startups(spark, sf).select(F.col("id").alias("entity_id"), F.greatest(dual, F.lit(0)).alias("dual"))
    d = e.join(p, "entity_id", "left").join(c, "entity_id", "left").na.fill(0, ["sbir_n", "regd_n", "contract_n"])
    score = F.when((F.col("sbir_n") > 0) & (F.col("regd_n") > 0), 0.3).otherwise(0.0) + F.when((F.col("contract_n") > 0) & (F.col("regd_n") > 0), 0.2).otherwise(0.0) + F.least(0.1 * F.col("dual"), F.lit(0.2))
    return _out(d.withColumn("score", score).filter("score >= 0.4"), "commercial_pathway_fit", F.least("score", F.lit(1.0)), V.as_of(), F.col("sbir_n").alias("sbir_count"), F.col("regd_n").alias("regd_count"))


def jar_funding(spark: SparkSession, sf: str) -> DataFrame:
    """Awards out of the acceleration reserve, by procurement type or contract type; an entity's first by id."""
    c = V.contracts(spark, sf).filter((F.col("procurement_type") == "jar") | F.col("contract_type").ilike("%joint acceleration%")).filter("entity_id IS NOT NULL")
    d = c.groupBy("entity_id").agg(F.min(F.struct("id", "award_date", F.col("contract_value").cast("double").alias("value"), "contracting_agency")).alias("x")).select("entity_id", "x.*")
    return _out(d, "jar_funding", F.lit(0.95), F.coalesce("award_date", V.as_of()), F.col("value"), F.col("contracting_agency").alias("agency"))


def top_signals(signals: DataFrame, names: DataFrame, n: int = 10) -> DataFrame:
    """The n most confident signals (entity_id, base_type, confidence) with the entity's name; ties by entity and type."""
    top = signals.orderBy(F.desc("confidence"), "entity_id", "base_type").limit(n)
    return top.join(names, "entity_id", "left")


#: All detectors by signal type.
DETECTORS = {
    "sbir_phase_2_transition": phase_2_transition, "sbir_phase_3_transition": phase_3_transition, "first_dod_contract": first_dod_contract, "rapid_contract_growth": rapid_contract_growth,
    "high_priority_technology": high_priority_technology, "multi_agency_interest": multi_agency_interest, "outsized_award": outsized_award, "sbir_to_contract_transition": sbir_to_contract,
    "sbir_to_vc_raise": sbir_to_vc_raise, "sbir_validated_raise": sbir_validated_raise, "sbir_stalled": sbir_stalled, "customer_concentration": customer_concentration,
    "sbir_graduation_speed": graduation_speed, "time_to_contract": time_to_contract, "funding_velocity": funding_velocity, "gone_stale": gone_stale, "sbir_lapse_risk": sbir_lapse_risk,
    "sole_source_award": sole_source_award, "ota_bridge_award": ota_bridge_award, "multi_vehicle_presence": multi_vehicle_presence, "contract_value_step_change": contract_value_step_change,
    "contract_acceleration": contract_acceleration, "sbir_breadth": sbir_breadth, "commercial_pathway_fit": commercial_pathway_fit, "jar_funding": jar_funding,
}


def detect(spark: SparkSession, sf: str, kinds: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """The signals of the named detectors in one table."""
    out = None
    for k in kinds:
        d = DETECTORS[k](spark, sf)
        out = d if out is None else out.unionByName(d)
    return out
