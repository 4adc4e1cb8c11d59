"""Tests of names, problem alignment, matched pairs' choice and communities on small frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import text as T
from orbweave.operators import alignment as A


def test_names(spark):
    rows = [("ACME RF SYSTEMS INC",), ("BOLT AND NUT LLC",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(T.display_name(F.col("n"))).collect()]
    assert got == ["Acme RF Systems Inc.", "Bolt and Nut LLC", "", None]


def test_agency_names(spark):
    rows = [("Dept of the Navy",), ("U.S. ARMY depot",), ("harbour board",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(T.agency_name(F.col("n"))).collect()]
    assert got == ["Navy", "Army", "Harbour Board", "Unknown", "Unknown"]


def test_keyword_tags(spark):
    rows = [("Radar for a DRONE",), ("nothing",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(T.keyword_tags(F.col("n"))).collect()]
    assert got == [["autonomy", "sensors"], [], [], []]


def test_problem_of_most_indicators(spark):
    tags = spark.createDataFrame([("1", "directed_energy"), ("1", "directed_energy"), ("2", "x"), ("3", None)], "entity_id string, tag string").filter("tag IS NOT NULL")
    titles = spark.createDataFrame([("1", "Swarm defeat for ships"), ("2", "anti-jam antenna"), ("2", None)], "entity_id string, title string").filter("title IS NOT NULL")
    got = {r["entity_id"]: (r["problem"], r["matches"], round(r["score"], 4)) for r in A.alignments(A.profile_terms(tags, titles)).collect()}
    assert got == {"1": ("kop_001", ["directed energy", "swarm defeat"], 0.4), "2": ("kop_002", ["anti-jam"], round(1 / 6 * 0.95, 4))}


def test_no_terms_no_problems(spark):
    none = spark.createDataFrame([], "entity_id string, tag string")
    assert A.alignments(A.profile_terms(none, none.withColumnRenamed("tag", "title"))).count() == 0
