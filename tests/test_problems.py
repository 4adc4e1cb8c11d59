"""Orphans, deltas and nested records against plain Python on small hand-made tables."""

import datetime as dt
import json
import random

import pytest

from orbweave.operators import deltas, nested, orphans

U = ["00000000-0000-0000-0000-00000000000" + str(i) for i in range(10)]
T = lambda d: dt.datetime(2024, 1, d)
CHILD = "id string, entity_id string, created_at timestamp, key string"
ENT = "id string, created_at timestamp, live boolean"
MERGE = "source_entity_id string, kind string"


def _children(spark):
    rows = [
        ("a", U[1], T(5), "x"), ("a", U[1], T(5), "x"), ("b", "{" + U[1].upper() + "}", T(1), None), ("c", U[2].replace("-", ""), T(5), ""), ("d", "urn:uuid:" + U[3], T(5), ""), ("e", None, T(5), ""),
        ("f", "  ", T(5), ""), ("g", "n/a", T(5), ""), ("h", U[1], None, ""), (None, U[2], T(5), ""),
    ]
    return spark.createDataFrame(rows, CHILD)


def test_orphan_kinds(spark):
    refs = orphans.references({"signals": _children(spark)})
    e, m = spark.createDataFrame([(U[1], T(3), True)], ENT), spark.createDataFrame([(U[2], "x")], MERGE)
    got = {tuple(r) for r in orphans.orphan_rows(refs, e, m).collect()}
    assert got == {("signals", "b", "late"), ("signals", "c", "deleted"), ("signals", "d", "missing"), ("signals", "g", "missing")}


def test_orphans_heavy_keys_agree_with_light(spark):
    rows = [(str(i), U[i % 3], T(1 + i % 20), "") for i in range(4000)]
    refs = orphans.references({"t": spark.createDataFrame(rows, CHILD)})
    e, m = spark.createDataFrame([(U[0], T(9), True)], ENT), spark.createDataFrame([(U[1], "x")], MERGE)
    heavy, light = (sorted(map(tuple, orphans.orphan_rows(refs, e, m, f).collect())) for f in (1e-4, 2.0))
    late = {str(i) for i in range(4000) if i % 3 == 0 and 1 + i % 20 < 9}
    assert heavy == light and {r[1] for r in heavy if r[2] == "late"} == late
    report = {(r["kind"], r["orphans"], r["references"]) for r in orphans.orphan_report(refs, e, m).collect()}
    assert ("late", len(late), 4000) in report


def test_orphans_empty(spark):
    refs = orphans.references({"t": spark.createDataFrame([], CHILD)})
    assert orphans.orphan_rows(refs, spark.createDataFrame([], ENT), spark.createDataFrame([], MERGE)).count() == 0
    assert orphans.orphan_report(refs, spark.createDataFrame([], ENT), spark.createDataFrame([], MERGE)).count() == 0


SIG = "id string, entity_id string, signal_type string, confidence_score decimal(3,2), detected_date date, created_at timestamp, updated_at timestamp, kind string"


def test_features_with_redeliveries(spark):
    from decimal import Decimal as D

    day = lambda d: dt.date(2023, 5, d)
    rows = [
        ("1", U[1], "k", D("0.5"), day(3), T(1), T(1), "x"), ("1", U[1], "k", D("0.7"), day(1), T(1), T(2), "x"),  # latest event moves back
        ("2", U[1], "K ", D("0.2"), day(2), T(1), T(1), "x"), ("2", U[1], "K ", D("0.2"), day(2), T(1), T(1), "x"), ("3", U[1], "k", D("7.00"), dt.date(2099, 1, 1), T(1), None, "x"),
        ("4", U[2], None, D("0.3"), day(2), T(1), T(1), "x"), ("5", None, "k", D("0.3"), day(2), T(1), T(1), "x"), (None, U[1], "k", D("0.3"), day(2), T(1), T(1), "x"),
    ]
    w = {r["entity_id"]: r for r in deltas.wide(deltas.entity_features(spark.createDataFrame(rows, SIG)), ["k", "z"]).collect()}
    assert set(w) == {U[1], U[2]}
    assert (w[U[1]]["k_n"], w[U[1]]["k_latest"], w[U[1]]["k_total"]) == (3, day(2), D("0.90"))
    assert (w[U[1]]["z_n"], w[U[1]]["z_latest"], w[U[2]]["k_n"]) == (0, None, 0)


def test_features_empty(spark):
    assert deltas.wide(deltas.entity_features(spark.createDataFrame([], SIG)), ["k"]).columns == ["entity_id", "k_n", "k_latest", "k_total"]


def _brute(rows, column):
    """The rules by plain recursion over json.loads."""

    def read(v):
        if isinstance(v, str) and v.strip()[:1] in ("{", "["):
            try:
                return read(json.loads(v))
            except ValueError:
                return v
        if isinstance(v, dict):
            return {k: read(x) for k, x in v.items()}
        return [read(x) for x in v] if isinstance(v, list) else v

    values, arrays, out = [], set(), set()
    for i, s in rows:
        try:
            values.append((i, read(json.loads(s))))
        except (ValueError, TypeError):
            continue

    def learn(v, g):
        for k, x in v.items() if isinstance(v, dict) else []:
            arrays.update([f"{g}.{k}"] if isinstance(x, list) else [])
            learn(x, f"{g}.{k}")
        for x in v if isinstance(v, list) else []:
            learn(x, g)

    def walk(i, v, p, g):
        for k, x in v.items() if isinstance(v, dict) else []:
            q = f"{p}.{k}"
            if isinstance(x, dict) and f"{g}.{k}" in arrays:
                q += "[0]"
                out.add((i, q))
            walk(i, x, q, f"{g}.{k}")
        for n, x in enumerate(v) if isinstance(v, list) else []:
            if isinstance(x, dict):
                out.add((i, f"{p}[{n}]"))
            walk(i, x, f"{p}[{n}]", g)

    for _, v in values:
        learn(v, column)
    for i, v in values:
        walk(i, v, column, column)
    return out


BAD = ['{"a": [1,}', '{"a" 1}', "[{}", '{"a": tru}', '{"a": 01}', '{"a": 1.}', '{"a": [{}]} x', "{'a': 1}", '{"a": "b}', '{"a": [{"b": "\\q"}]}', '[{"a": 1},]', '{"a": [{}]]}', '{,}', '{"a": [{"b": -}]}', '{"a": "x\ny"}', "", "   ", "null", None]
GOOD = [
    '{"a": [null, {"b": {}}, {}, [{"c": [{}]}]]}', '{"a": {"b": 1}}', '"{\\"a\\": [{\\"x\\": \\"\\\\\\"[{\\"}]}"', '{"s": "[{\\"t\\": 1}]"}', '{"k\\"e": [{"é\\u00e9": 1e-3}]}', '[{"z": {"z": {}}}]', '{"e": [], "o": {}}', '{"o": [], "e": {}}',
    '{"deep": ' + "[" * 30 + "{}" + "]" * 30 + "}", '{"q": "say \\"{}\\" [", "r": [{"t": "\\\\"}]}', ' { "w" : [ { } , { } ] } ',
]


@pytest.mark.parametrize("paths_sent", [nested.PATHS_SENT, 0])
def test_flatten(spark, paths_sent):
    rows = [(str(i), s) for i, s in enumerate(BAD + GOOD)] + [("10", GOOD[0]), (None, GOOD[0])]
    df = spark.createDataFrame([(i, s, 1) for i, s in rows], "id string, doc string, path int")
    got = [tuple(r) for r in nested.flatten(df, "doc", paths_sent).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute([r for r in rows if r[0]], "doc")


def test_flatten_random(spark):
    rnd = random.Random(5)

    def value(d):
        k = rnd.random()
        if d > 4 or k < 0.2:
            return rnd.choice([1, -2.5, None, True, "x\\\"{[", "é😀", ""])
        if k < 0.3:
            return json.dumps(value(d + 1))
        return {rnd.choice("abcd"): value(d + 1) for _ in range(rnd.randint(0, 3))} if k < 0.65 else [value(d + 1) for _ in range(rnd.randint(0, 3))]

    rows = []
    for i in range(300):
        s = json.dumps(value(0), ensure_ascii=rnd.random() < 0.5)
        rows.append((str(i), s if rnd.random() < 0.8 else s[: rnd.randint(0, len(s))]))
    got = {tuple(r) for r in nested.flatten(spark.createDataFrame(rows, "id string, j string"), "j").collect()}
    assert got == _brute(rows, "j")


def test_list_elements(spark):
    df = spark.createDataFrame([("1", ["a", None, " ", "a"]), ("1", ["a", None, " ", "a"]), ("2", []), ("3", None)], "id string, l array<string>")
    assert {tuple(r) for r in nested.list_elements(df, "l").collect()} == {("1", "l[0]"), ("1", "l[3]")}
    assert nested.flatten(spark.createDataFrame([], "id string, j string"), "j").count() == 0
