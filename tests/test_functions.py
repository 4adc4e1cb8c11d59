"""Scalar functions, readers, writers and streaming on small input."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from orbweave.functions import ids, registry, scalars
from orbweave.sources import readers, writers
from orbweave.streaming import incremental


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_names(spark):
    got = one(spark, scalars.normalise_name, "Acme Inc.", "Acme, Inc.", "Acme Corporation", "Acme Corp", "ACME LLC", "Acme L.L.C.", "The Acme Company", "  Acme   Industries  ", None)
    assert got == ["ACME", "ACME", "ACME", "ACME", "ACME", "ACME", "THE ACME", "ACME INDUSTRIES", None]


def test_scalars(spark):
    assert [str(x) for x in one(spark, scalars.money, "$1,234.50", "Indefinite", "", None, "-5")] == ["1234.50", "None", "None", "None", "-5.00"]
    d = dt.date(2024, 3, 9)
    assert one(spark, scalars.any_date, "2024-03-09", "03/09/2024", "3/9/2024", "09-Mar-2024", "20240309", "March 9, 2024", "soon", None) == [d] * 6 + [None] * 2
    assert one(spark, scalars.phase, "Phase I", "Phase II", "phase III", "2", None, "junk") == ["SBIR_PHASE_1", "SBIR_PHASE_2", "SBIR_PHASE_3", "SBIR_PHASE_2", None, None]
    assert one(spark, scalars.growth, "+38%", "-43%") == [pytest.approx(1.38), pytest.approx(0.57)]
    assert one(spark, scalars.slug, " A-b  C! ") == ["a_b_c"]


def test_codes(spark):
    u = "0123abcd-0000-4000-8000-00000000000f"
    assert one(spark, ids.uuid_value, u, "{" + u.upper() + "}", "urn:uuid:" + u, u.replace("-", ""), f" {u} ", "n/a", "", None) == [u] * 5 + [None] * 3
    assert one(spark, registry.cage, " ab1c2 ", "CAGE AB1C2", "00000", "AB1C", "N/A", None) == ["AB1C2", "AB1C2", None, None, None, None]
    assert one(spark, registry.cage_pattern, "**1C2", "AB1??", "AB1C", "*****", None) == ["??1C2", "AB1??", "AB1C?", None, None]
    assert one(spark, registry.duns, "12-345-0987", "1234509870000", "NONE", "999999999", None) == ["123450987", "123450987", None, None, None]
    places = one(spark, registry.place, "Pine Harbor, GA", "pine harbor , ga", "Pine Harbor GA", "12 Kiln Ln, Pine Harbor, GA", "GA - Pine Harbor", "Pine Harbor, Georgia", "Pine Harbor, GA 12345", "Pine Harbor, GA, USA", "GA", "United States", "", None)
    assert [tuple(p) if p else p for p in places] == [("Pine Harbor", "GA")] * 8 + [(None, "GA"), None, None, None]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n1,"two\nlines"\n3\n4,5\n')
    assert sorted(map(tuple, readers.award_csv(spark, str(tmp_path / "a.csv"), ["h1", "h2"]).collect())) == [("1", "two\nlines"), ("4", "5")]
    for n, t in {"OFFERING": "ACCESSIONNUMBER\tX\n1\ta\n1\tb\n2\tc\n", "ISSUERS": "ACCESSIONNUMBER\tNAME\n1\tn\n", "FORMDSUBMISSION": "ACCESSIONNUMBER\tD\n2\td\n", "RELATEDPERSONS": "ACCESSIONNUMBER\tLAST\n1\tp\n1\tq\n"}.items():
        (tmp_path / f"{n}.tsv").write_text(t)
    got = {r["ACCESSIONNUMBER"]: (r["X"], r["NAME"], r["D"], [p["LAST"] for p in r["related_persons"] or []]) for r in readers.filings(spark, str(tmp_path)).collect()}
    assert got == {"1": ("b", "n", None, ["p", "q"]), "2": ("c", None, "d", [])}
    fy = [(r[0], r[1], r[2]) for r in readers.fiscal_years(spark, 2024, 2026, dt.date(2025, 12, 1)).orderBy("fiscal_year").collect()]
    assert fy[0] == (2024, dt.date(2023, 10, 1), dt.date(2024, 9, 30)) and fy[-1] == (2026, dt.date(2025, 10, 1), dt.date(2025, 12, 1))
    assert [r[0] for r in readers.quarters(spark, dt.date(2024, 2, 3), dt.date(2024, 7, 1)).orderBy("start").collect()] == ["2024Q1", "2024Q2", "2024Q3"]
    (tmp_path / "names.txt").write_text("# note\n\n Acme \n")
    assert [r[0] for r in readers.name_list(spark, str(tmp_path / "names.txt")).collect()] == ["Acme"]
    (tmp_path / "p.json").write_text(json.dumps([{"a": {"b": 1}}, {"a": None}]))
    assert readers.pages(spark, str(tmp_path / "p.json")).count() == 2


def test_writers(spark, tmp_path):
    cur, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int"), spark.createDataFrame([(2, "c", 9), (3, "d", 3), (3, "d", 3)], "k int, v string, w int")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(writers.upserted(cur, new, "k")) == [(1, "a", 1), (2, "c", 9), (3, "d", 3)]
    assert rows(writers.upserted(cur, new, "k", ["v"])) == [(1, "a", 1), (2, "c", 2), (3, "d", 3)]
    assert rows(writers.unseen(new, cur, "k")) == [(3, "d", 3)]
    s = "entity_id string, signal_type string, confidence double, detected_date string, evidence string"
    old, found = spark.createDataFrame([("e", "a", 0.5, "d1", "x"), ("e", "b", 0.5, "d1", "x"), ("e", "c", 0.5, "d1", "x")], s), spark.createDataFrame([("e", "a", 0.9, "d2", "x"), ("e", "b", 0.9, "d2", "y"), ("f", "a", 0.1, "d2", "z")], s)
    assert rows(writers.merged_signals(old, found)) == [("e", "a", 0.5, "d1", "x"), ("e", "b", 0.9, "d1", "y"), ("e", "c", 0.5, "d1", "x"), ("f", "a", 0.1, "d2", "z")]
    writers.rebuild(cur, str(tmp_path / "t"))
    writers.append(new, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    assert writers.markdown(cur.orderBy("k")).splitlines()[2] == "| 1 | a | 1 |"


def test_stream(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "entity_id string, kind string, score decimal(3,2), day date, sign int"
    spark.createDataFrame([("e", "k", None, dt.date(2024, 1, 1), 1), ("e", "k", None, dt.date(2024, 1, 5), 1)], schema).coalesce(1).write.parquet(src)
    q = lambda: spark.readStream.schema(schema).parquet(src).writeStream.foreachBatch(incremental.keep_features(state)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    q()
    spark.createDataFrame([("e", "k", None, dt.date(2024, 1, 3), 1)], schema).coalesce(1).write.mode("append").parquet(src)
    q()
    r = spark.read.parquet(f"{state}/1").collect()
    assert [(x["n"], x["latest"]) for x in r] == [(3, dt.date(2024, 1, 5))]


def test_stream_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(1, "a", t(1)), (1, "a", t(1)), (2, "a", t(50)), (3, "b", t(2))], "id int, k string, ts timestamp").coalesce(1).write.parquet(src)
    s = lambda: spark.readStream.schema("id int, k string, ts timestamp").parquet(src)
    for name, df, mode, n in (("d", incremental.deduplicated(s(), "id", "ts"), "append", 3), ("w", incremental.windowed_counts(s(), "ts", "k"), "complete", 2), ("s", incremental.sessions(s(), "ts", "k"), "complete", 3)):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
        assert spark.table(name).count() == n
