"""Clean views of the reference tables: one row per id, references by value, impossible dates as null."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.ids import reference_key
from orbweave.sources.tables import table

#: The day that recency is counted from; always a parameter of the data, never of the clock.
AS_OF = datetime.date(2026, 3, 1)
SBIR = ("SBIR_PHASE_1", "SBIR_PHASE_2", "SBIR_PHASE_3")


def as_of() -> Column:
    return F.lit(AS_OF)


def possible(day: Column, loaded: Column) -> Column:
    """The day, or null if it lies before 2000 or after the row was loaded."""
    return F.when((day >= F.lit(datetime.date(2000, 1, 1))) & (day <= F.to_date(loaded)), day)


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entities").select("id", "canonical_name", "name_variants", "entity_type", "core_business", "headquarters_location", "cage_code", "duns_number", "technology_tags", "merged_into_id", "record_source", "founded_date", "created_at")


def active(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that were not merged away."""
    return entities(spark, sf).filter(F.col("merged_into_id").isNull())


def startups(spark: SparkSession, sf: str) -> DataFrame:
    return active(spark, sf).filter(F.col("entity_type") == "STARTUP")


def funding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "funding_events").select("id", reference_key(F.col("entity_id")).alias("entity_id"), "event_type", "amount", possible(F.col("event_date"), F.col("created_at")).alias("event_date"), "source", "round_stage", "parent_event_id", "investors_awarders", "raw_data", "created_at").distinct()


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "contracts").select("id", reference_key(F.col("entity_id")).alias("entity_id"), "contract_number", "contracting_agency", "contract_value", possible(F.col("award_date"), F.col("created_at")).alias("award_date"), "naics_code", "psc_code", "contract_type", "procurement_type").distinct()


def signals(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.regexp_replace(F.lower(F.trim("signal_type")), "-", "_")
    score = F.when(F.col("confidence_score").between(0, 1), F.col("confidence_score"))
    return table(spark, sf, "signals").select("id", reference_key(F.col("entity_id")).alias("entity_id"), kind.alias("signal_type"), F.substring_index(kind, ":", 1).alias("base_type"), score.alias("confidence"), possible(F.col("detected_date"), F.col("created_at")).alias("detected_date"), "status").distinct()


def _uuid_sql(c: str) -> str:
    h = f"replace(regexp_replace(regexp_replace(lower({c}), '^\\s*(urn:uuid:)?\\{{?', ''), '\\}}?\\s*$', ''), '-', '')"
    u = f"(CASE WHEN regexp_full_match({h}, '[0-9a-f]{{32}}') THEN substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12) END)"
    return f"(CASE WHEN trim({c}, E' \\t\\r\\n') <> '' THEN coalesce({u}, lower(trim({c}, E' \\t\\r\\n'))) END)"


def _possible_sql(day: str) -> str:
    return f"CASE WHEN {day} >= DATE '2000-01-01' AND {day} <= CAST(created_at AS DATE) THEN {day} END"


#: The same views for the checking SQL.
BASE_SQL = f"""WITH act AS (SELECT * FROM entities WHERE merged_into_id IS NULL), startup AS (SELECT * FROM act WHERE entity_type = 'STARTUP'),
f AS (SELECT DISTINCT id, {_uuid_sql('entity_id')} AS entity_id, event_type, amount, {_possible_sql('event_date')} AS event_date, source, round_stage, parent_event_id, investors_awarders, raw_data, created_at FROM funding_events),
c AS (SELECT DISTINCT id, {_uuid_sql('entity_id')} AS entity_id, contract_number, contracting_agency, contract_value, {_possible_sql('award_date')} AS award_date, naics_code, psc_code, contract_type, procurement_type FROM contracts),
s AS (SELECT DISTINCT id, {_uuid_sql('entity_id')} AS entity_id, replace(lower(trim(signal_type)), '-', '_') AS signal_type, split_part(replace(lower(trim(signal_type)), '-', '_'), ':', 1) AS base_type, CASE WHEN confidence_score BETWEEN 0 AND 1 THEN confidence_score END AS confidence, {_possible_sql('detected_date')} AS detected_date, status FROM signals),
p AS (SELECT DATE '2026-03-01' AS as_of)
"""
