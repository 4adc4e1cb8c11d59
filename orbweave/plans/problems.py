"""Queries of the general problems: per-entity features (3), orphan references (6), nested records (7)."""

from __future__ import annotations

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import deltas, nested, orphans
from orbweave.sources.tables import table

CHILD_TABLES = ("signals", "funding_events", "contracts")


def p3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the list of types does not grow with the data
    kinds = [r[0] for r in table(spark, sf_dir, "signal_types").select("signal_type").distinct().orderBy("signal_type").collect()]
    return deltas.wide(deltas.entity_features(table(spark, sf_dir, "signals")), kinds)


def p3_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.long(deltas.entity_features(table(spark, sf_dir, "signals")), table(spark, sf_dir, "signal_types"))


def _orphan_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return orphans.references({t: table(spark, sf_dir, t) for t in CHILD_TABLES}), table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_merges")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_rows(*_orphan_inputs(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(*_orphan_inputs(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s = table(spark, sf_dir, "funding_events"), table(spark, sf_dir, "signals")
    parts = [("funding_events", nested.flatten(f, "raw_data")), ("funding_events", nested.list_elements(f, "investors_awarders")), ("signals", nested.flatten(s, "evidence"))]
    out = None
    for name, rows in parts:
        part = rows.select(F.lit(name).alias("table_name"), "id", "path")
        out = part if out is None else out.unionByName(part)
    return out


def p7_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p7_found as child rows: parent's path (null at the top), name of the list, place in it, own fields."""
    f, s = table(spark, sf_dir, "funding_events"), table(spark, sf_dir, "signals")
    names = nested.list_elements(f, "investors_awarders", names=True).select("id", "path", F.to_json(F.struct("name")).alias("object"))
    parts = [("funding_events", nested.flatten(f, "raw_data", spans=True)), ("funding_events", names), ("signals", nested.flatten(s, "evidence", spans=True))]
    out = None
    for name, rows in parts:
        part = nested.linked(rows).select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def queries() -> dict:
    return {"p3_features": p3_features, "p3_long": p3_long, "p6_found": p6_found, "p6_report": p6_report, "p7_found": p7_found, "p7_children": p7_children}


def _uuid_sql(c: str) -> str:
    h = f"replace(regexp_replace(regexp_replace(lower({c}), '^\\s*(urn:uuid:)?\\{{?', ''), '\\}}?\\s*$', ''), '-', '')"
    return f"(CASE WHEN regexp_full_match({h}, '[0-9a-f]{{32}}') THEN substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12) END)"


def _key_sql(c: str) -> str:
    return f"(CASE WHEN trim({c}, E' \\t\\r\\n') <> '' THEN coalesce({_uuid_sql(c)}, lower(trim({c}, E' \\t\\r\\n'))) END)"


_P3 = f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) r FROM signals WHERE id IS NOT NULL),
e AS (SELECT {_key_sql('entity_id')} AS entity_id, replace(trim(lower(signal_type), E' \\t\\r\\n'), '-', '_') AS kind,
  CASE WHEN confidence_score BETWEEN 0 AND 1 THEN confidence_score END AS score,
  CASE WHEN detected_date >= DATE '2000-01-01' AND detected_date <= CAST(created_at AS DATE) THEN detected_date END AS day FROM v WHERE r = 1)"""
_REFS = "refs AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, id, {_key_sql('entity_id')} AS key, created_at FROM {t}" for t in CHILD_TABLES) + ")"
_ORPHANS = f"""WITH {_REFS}, named AS (SELECT * FROM refs WHERE key IS NOT NULL),
p AS (SELECT lower(id) AS key, min(created_at) AS parent_at FROM entities GROUP BY 1), g AS (SELECT DISTINCT lower(source_entity_id) AS key FROM entity_merges),
k AS (SELECT n.*, CASE WHEN p.key IS NULL AND g.key IS NOT NULL THEN 'deleted' WHEN p.key IS NULL THEN 'missing' WHEN p.parent_at > n.created_at THEN 'late' END AS kind
  FROM named n LEFT JOIN p USING (key) LEFT JOIN g USING (key))"""


def _p3_wide_sql(types_dir: str = "/root/testdata/sf0.001") -> dict[str, str]:
    """One column after the other for each listed type; the list (clean, the same at every scale) is read from the smallest tables."""
    try:
        kinds = sorted(set(pq.read_table(f"{types_dir}/signal_types.parquet", columns=["signal_type"]).column(0).to_pylist()))
    except FileNotFoundError:
        return {}
    cols = ", ".join(f"""count(*) FILTER (kind = '{k}')::BIGINT AS "{k}_n", max(day) FILTER (kind = '{k}') AS "{k}_latest", coalesce(sum(score) FILTER (kind = '{k}'), 0)::DECIMAL(18,2) AS "{k}_total\"""" for k in kinds)
    return {"p3_features": f"{_P3} SELECT entity_id, {cols} FROM e WHERE entity_id IS NOT NULL GROUP BY entity_id"}


def oracle_sql() -> dict[str, str]:
    return _p3_wide_sql() | {
        "p3_long": _P3 + " SELECT entity_id, kind AS signal_type, count(*)::BIGINT AS n, max(day) AS latest, coalesce(sum(score), 0)::DECIMAL(18,2) AS total FROM e WHERE entity_id IS NOT NULL AND kind IN (SELECT signal_type FROM signal_types) GROUP BY ALL",
        "p6_found": _ORPHANS + " SELECT DISTINCT table_name, id, kind FROM k WHERE kind IS NOT NULL AND id IS NOT NULL",
        "p6_report": _ORPHANS + """, t AS (SELECT table_name, CAST(date_trunc('month', created_at) AS DATE) AS period, count(*)::BIGINT AS "references" FROM named GROUP BY ALL)
SELECT k.table_name, CAST(date_trunc('month', k.created_at) AS DATE) AS period, kind, count(*)::BIGINT AS orphans, any_value(t."references") AS "references"
FROM k JOIN t ON t.table_name = k.table_name AND t.period = CAST(date_trunc('month', k.created_at) AS DATE) WHERE kind IS NOT NULL GROUP BY 1, 2, 3""",
    }
