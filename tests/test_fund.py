"""Tests of strategies and vintages on small frames: nulls, ties, repeated deployment, cascading removal, empty pools."""

from __future__ import annotations

import pytest

from orbweave.operators import fund as N

SCHEMA = "entity_id string, entity_type string, core_business string, p2_n long, sbir_n long, regd_n long, contract_n long, composite double, rank string, strategy string"
PLANS = [
    {"name": "a", "status": "ACTIVE", "target_cohort_size": 2, "selection_criteria": {"min_p2": 1}},
    {"name": "b", "status": "ACTIVE", "target_cohort_size": 9, "selection_criteria": {"entity_type": ["STARTUP"], "max_private": 0}},
    {"name": "c", "status": "DRAFT", "selection_criteria": {}},
]


def _pool(spark, rows):
    return spark.createDataFrame([(i, t, "x", p2, 0, private, 0, score, "clash", "clash") for i, t, p2, private, score in rows], SCHEMA)


ROWS = [("2", "STARTUP", 1, 0, 5.0), ("1", "STARTUP", 2, 1, 5.0), ("3", None, 1, None, 9.0), ("4", "STARTUP", None, 0, None), (None, "STARTUP", 1, 0, 99.0), ("5", "PRIME", 1, 0, 5.0)]


def _rows(d):
    return sorted((r["strategy"], r["rank"], r["entity_id"]) for r in d.collect())


def test_picks_best_with_ties_and_nulls(spark):
    got = _rows(N.picks(_pool(spark, ROWS), PLANS, "v"))
    assert got == [("a", 1, "3"), ("a", 2, "1"), ("b", 1, "2"), ("b", 2, "4")]


def test_activation_and_no_criteria(spark):
    got = _rows(N.picks(_pool(spark, ROWS), N.activated(PLANS, "c"), "v").filter("strategy = 'c'"))
    assert [x[2] for x in got] == ["3", "1", "2", "5", "4"]


def test_empty_pool_and_no_active_strategy(spark):
    assert _rows(N.picks(_pool(spark, []), PLANS, "v")) == []
    assert _rows(N.picks(_pool(spark, ROWS), PLANS[2:], "v")) == []


def test_hot_strategy_equals_brute_force(spark):
    rows = [(f"{i:04d}", "STARTUP", i % 3, i % 2, float(i * 7 % 11)) for i in range(500)]
    got = _rows(N.picks(_pool(spark, rows), PLANS, "v"))
    a = sorted((r for r in rows if r[2] >= 1), key=lambda r: (-r[4], r[0]))[:2]
    b = sorted((r for r in rows if r[3] <= 0), key=lambda r: (-r[4], r[0]))[:9]
    assert got == sorted([("a", k, r[0]) for k, r in enumerate(a, 1)] + [("b", k, r[0]) for k, r in enumerate(b, 1)])


def test_unknown_criterion():
    for name in ("min_luck", "p2", "max"):
        with pytest.raises(ValueError):
            N.criterion({name: 1})


def test_first_strategy_of_a_name_holds():
    assert [(s["name"], s["n"]) for s in N.strategies('[{"name": "a", "n": 1}, {"name": "b", "n": 2}, {"name": "a", "n": 3}]')] == [("a", 1), ("b", 2)]


def test_deploying_twice_changes_nothing(spark):
    first = N.picks(_pool(spark, ROWS), PLANS, "v")
    later = N.picks(_pool(spark, [("7", "STARTUP", 3, 0, 50.0)]), PLANS, "v")
    assert _rows(N.deployed(first, later)) == _rows(first)
    other = N.picks(_pool(spark, [("7", "STARTUP", 3, 0, 50.0)]), PLANS, "w")
    assert N.deployed(first, other).count() == first.count() + 2


def test_dropping_takes_positions_and_milestones(spark):
    p = N.picks(_pool(spark, ROWS), PLANS, "v")
    events = spark.createDataFrame([("3", "K", None, "clash"), ("3", "K", None, "clash"), ("2", "K", None, "clash"), (None, "K", None, "clash")], "entity_id string, kind string, day date, vintage string")
    m = N.milestones(p, events)
    assert sorted((r["strategy"], r["entity_id"]) for r in m.collect()) == [("a", "3"), ("a", "3"), ("b", "2")]
    left, children = N.dropped("a", "v", p, m)
    assert {r["strategy"] for r in left.collect()} == {"b"} and [r["entity_id"] for r in children.collect()] == ["2"]
    assert N.dropped("a", "other", p)[0].count() == p.count()
    assert sorted((r["strategy"], r["status"], r["vintages"], r["positions"]) for r in N.listing(spark, PLANS, left).collect()) == [("a", "ACTIVE", 0, 0), ("b", "ACTIVE", 1, 2), ("c", "DRAFT", 0, 0)]
