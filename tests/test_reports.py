"""Order statistics, resolution, policy and text helpers, kept features, plans without hot groups."""

from __future__ import annotations

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from orbweave.functions import text as T
from orbweave.functions.registry import gazetteer
from orbweave.operators import deltas, nested
from orbweave.operators import policy as P
from orbweave.operators import resolution as R
from orbweave.operators.quantiles import order_statistics, quartiles_exclusive
from orbweave.plans import analytics
from orbweave.streaming.incremental import keep_features


def test_quartiles_equal_the_exclusive_method(spark):
    rnd = random.Random(4)
    groups = {"a": [rnd.randrange(-50, 5000) / 4 for _ in range(101)], "b": [7.0] * 9, "c": [1.0, 2.0, 3.0, 4.0], "d": [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)], "g string, v double")
    got = {r["g"]: r for r in quartiles_exclusive(df, "g", "v").collect()}
    for g in "abc":
        assert [got[g][f"q{i}"] for i in (1, 2, 3)] == pytest.approx(statistics.quantiles(groups[g], n=4))
    assert got["d"]["q2"] is None and got["d"]["n"] == 2 and "e" not in got
    upper = {r["g"]: r["m"] for r in order_statistics(df, "g", "v", m=F.floor(F.col("n") / 2) + 1).collect()}
    assert upper == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}


def test_order_statistics_of_nothing(spark):
    assert order_statistics(spark.createDataFrame([], "g string, v double"), "g", "v", m=F.lit(1)).count() == 0


def test_normal_names(spark):
    rows = [("Acme Inc.",), ("Acme, Inc.",), ("ACME LLC",), ("Acme L.L.C.",), ("  Acme   Industries  ",), ("The Acme Company",), ("",), (None,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "n string").select(R.resolver_name(F.col("n")), R.only_generic(F.lit("global systems"))).collect()]
    assert [g[0] for g in got] == ["acme", "acme", "acme", "acme", "acme industries", "acme", "", None] and got[0][1]


def test_fuzzy_blend():
    assert R.fuzzy("acme rockets", "acme rockets") == pytest.approx(100.0)
    assert R.fuzzy("rockets acme", "acme rockets") > 80 > 40 > R.fuzzy("acme", "zzzz")
    assert R._ratio("", "") == 100.0 and R._ratio("", "a") == 0.0


def test_decisions_follow_the_tree(spark):
    f = "a string, b string, score double, cage_a string, cage_b string, duns_a string, duns_b string, name_a string, name_b string, state_a string, state_b string, naics boolean"
    rows = [
        ("1", "2", 10.0, "X", "X", None, None, "p", "q", None, None, False), ("1", "3", 10.0, None, None, None, None, "p q", "p q", None, None, False), ("1", "4", 91.0, None, "Y", None, None, "p", "q", "VA", "VA", False),
        ("1", "5", 91.0, None, None, None, None, "p", "q", "VA", "TX", True), ("1", "6", 96.0, None, None, None, None, "p", "q", "VA", None, False), ("1", "7", 96.0, None, None, None, None, "p", "q", "VA", "TX", False), ("1", "8", 5.0, None, None, None, None, "p", "p", None, None, False),
    ]
    got = {r["b"]: r["rule"] for r in R.decided(spark.createDataFrame(rows, f)).collect()}
    assert got == {"2": "identifier", "3": "identical", "4": "state", "5": "industry", "6": "very alike", "7": "review", "8": "apart"}


def test_area_scores_and_ties(spark):
    e = spark.createDataFrame([("1", ["ew", "rf", "space"]), ("2", ["thermal"]), ("3", None), ("4", [])], "id string, technology_tags array<string>")
    s = P.scores(e)
    assert {(r["entity_id"], r["area"]): r["score"] for r in s.collect()} == {("1", "electronic_warfare"): 1.0, ("1", "space_resilience"): 0.4, ("2", "hypersonics"): 0.6}
    assert {r["entity_id"]: r["area"] for r in P.top_areas(s).collect()} == {"1": "electronic_warfare", "2": "hypersonics"}
    assert [r["entity_id"] for r in P.headwinds(s).collect()] == ["2"]
    tie = spark.createDataFrame([({"b": 0.5, "a": 0.5},)], "m map<string,double>").select(P.top_of_map(F.col("m"))).first()[0]
    assert tie == "a"


def test_text_helpers(spark):
    r = spark.range(1).select(
        T.title_terms(F.lit("Novel UAS radar for the Navy")), T.tag_terms(F.lit("directed_energy")), T.unfenced(F.lit("x ```json {\"a\": 1} ``` y")), T.investor_name(F.lit("Zed  Capital, LLC")), T.is_firm(F.lit("Jo Doe")), T.with_synonyms(F.array(F.lit("ew"))),
    ).first()
    assert r[0] == ["navy", "radar", "radar navy", "uas", "uas radar"] and r[1] == ["directed", "directed energy", "directed_energy", "energy"]
    assert r[2] == '{"a": 1}' and r[3] == "Zed Capital" and r[4] is False and r[5] == ["attack", "countermeasures", "ecm", "electronic", "electronic attack", "electronic countermeasures", "electronic warfare", "ew", "warfare"]


def test_gazetteer_is_the_same_at_every_size(spark):
    def known(times):
        rows = [("Springfield", "VA")] * (300 * times) + [("Springfeld", "VA")] * (3 * times) + [("Smallton", "VA")] * (4 * times) + [("Oddville", "VA")] * 1
        return {r["city"] for r in gazetteer(spark.createDataFrame(rows, "city string, state string")).collect()}

    assert known(1) == known(10) == {"Springfield", "Smallton"}


def test_retracted_latest_gives_way_to_the_one_before(spark, tmp_path):
    day = datetime.date
    fold = keep_features(str(tmp_path))
    schema = "entity_id string, kind string, score decimal(3,2), day date, sign int"
    fold(spark.createDataFrame([("a", "k", None, day(2026, 1, 1), 1), ("a", "k", None, day(2026, 1, 5), 1)], schema), 0)
    fold(spark.createDataFrame([("a", "k", None, day(2026, 1, 5), -1)], schema), 1)
    r = spark.read.parquet(f"{tmp_path}/1").first()
    assert (r["n"], r["latest"]) == (1, day(2026, 1, 1))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        keep_features(str(tmp_path / "none"))(spark.createDataFrame([], schema), 3)


def test_kept_features_equal_a_rebuild(spark, tmp_path):
    rnd = random.Random(7)
    schema = "entity_id string, kind string, score decimal(3,2), day date, sign int"
    from decimal import Decimal

    standing, fold = [], keep_features(str(tmp_path))
    for number in range(4):
        new = [(rnd.choice("ab"), rnd.choice(["k", "l", None]), Decimal(rnd.randrange(100)) / 100, datetime.date(2026, 1, rnd.randrange(1, 9)) if rnd.random() < 0.9 else None) for _ in range(12)]
        gone = [standing.pop(rnd.randrange(len(standing))) for _ in range(min(6, len(standing)))]
        fold(spark.createDataFrame([(*x, 1) for x in new] + [(*x, -1) for x in gone], schema), number)
        standing += new
        rebuilt = deltas.summarise(spark.createDataFrame([(*x, 1) for x in standing], schema))
        kept = spark.read.parquet(f"{tmp_path}/{number % 2}").select(*rebuilt.columns)
        assert kept.exceptAll(rebuilt).isEmpty() and rebuilt.exceptAll(kept).isEmpty()


def test_children_carry_parent_place_and_fields(spark):
    deep = '{"a":' * 400 + '{"x":[{"y":1}]}' + "}" * 400
    text = '{"L": [{"n": 1, "M": [{"k": "v"}]}, null, {}], "s": "[{\\"q\\": 2}]", "d": "[1", "e": "{\\"z\\": NaN}"}'
    rows = {(r["id"], r["path"]): r for r in nested.linked(nested.flatten(spark.createDataFrame([("1", text), ("2", deep), ("3", "{"), ("4", None)], "id string, j string"), "j", spans=True)).collect()}
    assert {k[1] for k in rows if k[0] == "1"} == {"j.L[0]", "j.L[0].M[0]", "j.L[2]", "j.s[0]"}
    child = rows["1", "j.L[0].M[0]"]
    assert (child["parent_path"], child["list_name"], child["place"], child["fields"]) == ("j.L[0]", "M", 0, {"k": "v"})
    assert rows["1", "j.s[0]"]["fields"] == {"q": "2"} and rows["1", "j.L[2]"]["fields"] == {} and sum(k[0] == "2" for k in rows) == 1


def test_duplicate_contracts_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(2)
    from decimal import Decimal as D

    rows = [(f"{i:03d}", rnd.choice("ef"), rnd.choice("xy"), None if rnd.random() < 0.1 else D(rnd.choice([0, 0, 1, rnd.randrange(-300, 300), rnd.randrange(1, 10**6)])) / rnd.choice([1, 100]), datetime.date(2026, 1, 1) + datetime.timedelta(rnd.randrange(600)) if rnd.random() < 0.9 else None) for i in range(160)]
    df = spark.createDataFrame(rows, "id string, entity_id string, contracting_agency string, contract_value decimal(18,2), award_date date")
    monkeypatch.setattr(analytics.V, "contracts", lambda s, d: df)
    want = set()
    for a in rows:
        for b in rows:
            if a[1:3] == b[1:3] and a[0] < b[0]:
                both = a[3] is not None and b[3] is not None
                near = both and abs(a[3] - b[3]) / max(abs(a[3]), abs(b[3]), 1) < D("0.1")
                dated = a[4] and b[4] and abs((a[4] - b[4]).days) <= 90 and (a[3] == 0 or b[3] == 0)
                if near or dated:
                    want.add(b[0])
    assert {r["id"] for r in analytics._dup_contracts(spark, "").collect()} == want
