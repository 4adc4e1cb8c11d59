"""Composite scores, decay, life cycle and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators.detectors import phases
from orbweave.sources import views as V

# Weight and decay profile of each signal type.
WEIGHTS = {
    "jar_funding": (3.5, "SLOW"), "strategic_breakthrough_award": (3.5, "SLOW"), "sbir_to_contract_transition": (3.0, "SLOW"), "meia_experimentation": (3.0, "FAST"), "rapid_contract_growth": (2.5, "FAST"), "kop_alignment": (2.5, "NONE"),
    "sbir_validated_raise": (2.5, "SLOW"), "ota_bridge_award": (2.5, "SLOW"), "sbir_to_vc_raise": (2.0, "SLOW"), "outsized_award": (2.0, "SLOW"), "sbir_phase_3_transition": (2.0, "SLOW"), "pae_portfolio_member": (2.0, "NONE"),
    "time_to_contract": (2.0, "SLOW"), "sole_source_award": (2.0, "SLOW"), "contract_value_step_change": (2.0, "FAST"), "contract_acceleration": (2.0, "FAST"), "sbir_phase_2_transition": (1.5, "SLOW"), "multi_agency_interest": (1.5, "NONE"),
    "sbir_graduation_speed": (1.5, "SLOW"), "funding_velocity": (1.5, "FAST"), "commercial_pathway_fit": (1.5, "NONE"), "multi_vehicle_presence": (1.5, "NONE"), "sbir_breadth": (1.5, "NONE"), "high_priority_technology": (1.0, "NONE"),
    "first_dod_contract": (1.0, "FAST"), "customer_concentration": (-1.5, "NONE"), "gone_stale": (-1.5, "NONE"), "sbir_lapse_risk": (-1.5, "FAST"), "policy_headwind": (-1.5, "NONE"), "sbir_stalled": (-2.0, "NONE"),
}


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, w, d) for k, (w, d) in WEIGHTS.items()], "base_type string, weight double, profile string").withColumn("weight", F.col("weight").cast("decimal(3,1)"))


def freshness(day: Column, profile: Column, today: Column) -> Column:
    """What is left of a signal's weight at its age; .5 without a date, the slow profile for unknown ones."""
    age = F.datediff(today, day)
    fast = F.when(age <= 182, 1.0).when(age <= 365, 0.7).when(age <= 730, 0.4).otherwise(0.2)
    slow = F.when(age <= 365, 1.0).when(age <= 730, 0.85).when(age <= 1095, 0.65).otherwise(0.4)
    return F.when(profile == "NONE", 1.0).when(day.isNull(), 0.5).when(profile == "FAST", fast).otherwise(slow)


def weighed_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Active signals of known types with weight and freshness; one row per entity and type, the most confident."""
    s = V.signals(spark, sf).filter((F.col("status") == "ACTIVE") & F.col("entity_id").isNotNull() & F.col("confidence").isNotNull())
    best = s.groupBy("entity_id", "base_type").agg(F.max(F.struct("confidence", F.col("detected_date"))).alias("x")).select("entity_id", "base_type", F.col("x.confidence").alias("confidence"), F.col("x.detected_date").alias("detected_date"))
    w = best.join(F.broadcast(weights(spark)), "base_type")  # thirty rows
    return w.withColumn("fresh", freshness(F.col("detected_date"), F.col("profile"), V.as_of()).cast("decimal(3,2)"))  # decimals: sums are exact


def composite(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted sums per entity, plain and aged, split by sign."""
    v = F.col("weight") * F.col("confidence")
    r = lambda c: F.round(F.sum(c), 2).cast("double")
    return weighed_signals(spark, sf).groupBy("entity_id").agg(
        r(v).alias("composite"), r(v * F.col("fresh")).alias("fresh_composite"), F.coalesce(r(F.when(F.col("weight") > 0, v)), F.lit(0.0)).alias("positive"), F.coalesce(r(F.when(F.col("weight") < 0, v)), F.lit(0.0)).alias("negative"),
        F.count("*").alias("signals"), r(F.col("confidence")).alias("confidence_sum"))


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """The wide feature frame of active entities: award phases, filings, contracts by vehicle."""
    c = V.contracts(spark, sf).groupBy("entity_id").agg(
        F.count("*").alias("contract_n"), F.coalesce(F.sum("contract_value"), F.lit(0)).cast("double").alias("contract_total"), F.count_if(F.col("procurement_type") == "ota").alias("ota_n"),
        F.count_if(F.col("procurement_type") == "standard").alias("standard_n"), F.count_distinct("contracting_agency").alias("agencies"), F.max("award_date").alias("last_award"))
    p = phases(spark, sf)
    d = V.active(spark, sf).select(F.col("id").alias("entity_id"), "entity_type", "core_business").join(p, "entity_id", "left").join(c, "entity_id", "left")
    numbers = [n for n, t in d.dtypes if t in ("bigint", "double")]
    return d.na.fill(0, numbers)


def lifecycle(d: DataFrame) -> DataFrame:
    """Seven and four stages of an entity's life."""
    seven = (
        F.when((F.col("contract_total") >= 50_000_000) & (F.col("regd_n") > 0), "scaling").when((F.col("standard_n") > 0) & (F.col("contract_total") >= 1_000_000), "production").when(F.col("contract_n") >= 3, "growth")
        .when(F.col("ota_n") > 0, "prototype").when(F.col("sbir_n") > 0, "r_and_d").when(F.col("regd_n") > 0, "funded").otherwise("early"))
    four = F.when(F.col("contract_total") >= 10_000_000, "Production").when((F.col("contract_n") > 0) & (F.col("regd_n") > 0), "Growth").when(F.col("p2_n") + F.col("contract_n") > 0, "Prototype").otherwise("Pre-revenue")
    return d.withColumns({"stage_7": seven, "stage_4": four})


def entity_class(d: DataFrame) -> DataFrame:
    """PRIME by contract volume, STARTUP otherwise."""
    return d.withColumn("class", F.when(F.col("contract_total") >= 500_000_000, "PRIME").otherwise("STARTUP"))
