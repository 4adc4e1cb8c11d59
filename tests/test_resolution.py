"""Tests of resolution by codes, names and context on small frames."""

from __future__ import annotations

from orbweave.operators import resolution as R

SCHEMA = "a string, b string, " + ", ".join(f"{c}_{s} {t}" for c, t in (("name", "string"), ("cage", "string"), ("duns", "string"), ("place", "string"), ("tags", "array<string>")) for s in "ab") + ", score string, confidence string"


def _got(spark, *rows):
    d = spark.createDataFrame([(f"a{i}", f"b{i}", *r, "clash", "clash") for i, r in enumerate(rows)], SCHEMA)
    return [tuple(r)[2:] for r in R.resolved(d).orderBy("a").collect()]


def _row(names, cages=(None, None), duns=(None, None), places=(None, None), tags=(None, None)):
    return (*names, *cages, *duns, *places, *tags)


def test_codes_come_first_and_names_are_compared(spark):
    got = _got(spark, _row(("zq", "acme robotics"), cages=("1ABC2", "1ABC2")), _row(("acme", "acme"), duns=("1", "1")), _row((None, None), cages=("", "")))
    assert got == [("code", 1.0, True, "update"), ("code", 1.0, False, "update"), ("none", 0.0, False, "create")]


def test_names_and_context(spark):
    a, b = "acme robot works", "acme robotic wharf"
    base = round(R.fuzzy(a, b) / 100, 4)
    got = _got(spark, _row((a, b)), _row((a, b), places=("Reno, NV", "Elko, nv")), _row((a, b), tags=(["AI", "x", None, "x"], ["ai", "X", "y"])), _row((a, b), tags=(list("pqrst"), list("pqrst"))), _row(("acme", "acme"), places=("A", "A")))
    wanted = [round(R.fuzzy(a, b) / 100 + more, 4) for more in (0, 0.05, 0.06, 0.1)]
    assert base > 0.6 and [g[1] for g in got] == [w if w >= 0.7 else 0.0 for w in wanted] + [1.0]
    assert [g[3] for g in got] == ["update" if w >= 0.9 else "use" if w >= 0.7 else "create" for w in wanted] + ["update"]


def test_no_pairs_nulls_and_long_names(spark):
    assert R.resolved(spark.createDataFrame([], SCHEMA)).count() == 0
    assert _got(spark, _row(("", "acme")), _row(("acme " * 300, "acme " * 300)))[0] == ("none", 0.0, False, "create")
