"""Queries of the problems tagged llm, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.ids import squeeze, uuid_value
from orbweave.llm import bpe, linkage, packing, spellings, survivorship, truncation
from orbweave.llm.components import components
from orbweave.sources.tables import table


def group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) between entities rows: merges, and pairs that a reviewer said to merge; ids by value, both present."""
    e = table(spark, sf_dir, "entities")
    merged = e.select(uuid_value(F.col("id")).alias("a"), uuid_value(F.col("merged_into_id")).alias("b"))
    said = table(spark, sf_dir, "potential_matches").filter(F.lower(squeeze(F.col("decision"))) == "merge").select(uuid_value(F.col("entity_a")).alias("a"), uuid_value(F.col("entity_b")).alias("b"))
    ids = e.select(uuid_value(F.col("id")).alias("id"))
    links = merged.unionByName(said).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.matches(table(spark, sf_dir, "entities"), table(spark, sf_dir, "vendor_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).filter(F.col("confidence") >= linkage.MATCH).select("entity_id", "record_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(group_links(spark, sf_dir)).select(F.col("id").alias("entity_id"), "group_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.col("text") != "")
    return packing.fill_containers(bpe.token_counts(docs))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.same_name_pairs(spellings.spelling_groups(table(spark, sf_dir, "entities")))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spelling_groups(table(spark, sf_dir, "entities"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.present_values(table(spark, sf_dir, "entities"))


def p2_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.golden(table(spark, sf_dir, "entities"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_documents(table(spark, sf_dir, "documents"))


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_golden": p2_golden, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found,
        "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_report": p10_report,
    }


def _uuid_sql(c: str) -> str:
    h = f"replace(regexp_replace(regexp_replace(lower({c}), '^\\s*(urn:uuid:)?\\{{?', ''), '\\}}?\\s*$', ''), '-', '')"
    return f"(CASE WHEN regexp_full_match({h}, '[0-9a-f]{{32}}') THEN substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12) END)"


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"""WITH RECURSIVE ids AS (SELECT lower(id) AS id FROM entities),
links AS (SELECT {_uuid_sql('id')} AS a, {_uuid_sql('merged_into_id')} AS b FROM entities UNION SELECT {_uuid_sql('entity_a')}, {_uuid_sql('entity_b')} FROM potential_matches WHERE lower(trim(decision, E' \\t\\r\\n')) = 'merge'),
l AS (SELECT a, b FROM links WHERE a <> b AND a IN (SELECT id FROM ids) AND b IN (SELECT id FROM ids)), s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
SELECT a AS entity_id, min(b) AS group_id FROM r GROUP BY a""",
    }
