"""Peers: against all pairs, and without a shuffle of the pairs."""

from __future__ import annotations

import random
from collections import Counter

from orbweave.plans.company import peers


def _edges(spark, rows):
    return spark.createDataFrame(rows, "source string, target string")


def _by_hand(rows):
    asked = [(a, t) for a, t in rows if len(a) == 36 and int(a[-2:], 16) % 50 == 0]
    return Counter((a, b) for a, t in asked for b, u in rows if t == u and a != b)


def test_peers_equal_all_pairs(spark):
    rnd = random.Random(7)
    ids = [f"{i:08x}-0000-4000-8000-{i * 7:012x}" for i in range(150)] + ["no uuid", "x"]
    rows = list({(i, "hot") for i in ids[::2]} | {(rnd.choice(ids), f"t{rnd.randrange(9)}") for _ in range(300)} | {(ids[0], f"own {i}") for i in range(20)} | {(ids[1], "1:a"), (ids[2], "a")})
    want = _by_hand(rows)
    for how in ({}, {"part": 5, "few": 2, "salts": 3}):
        got = peers(_edges(spark, rows), **how).collect()
        assert len(got) == len(want) > 300 and {(r["a"], r["b"]): r["shared"] for r in got} == want


def test_peers_of_nothing(spark):
    assert peers(_edges(spark, [])).count() == 0
    assert peers(_edges(spark, [("x", "t"), ("y", "t")])).count() == 0


def test_pairs_of_peers_are_not_shuffled(spark):
    """All sources at two targets: many more pairs than sources, which used to be written to disk before they were counted."""
    rows = [(f"{i:08x}-0000-4000-8000-{i:012x}", t) for i in range(3000) for t in ("one", "two")]
    sc = spark.sparkContext
    sc.setJobGroup("peers", "peers")
    try:
        n = peers(_edges(spark, rows)).count()
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in tracker.getJobIdsForGroup("peers") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
        shuffled = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert n > 200_000 and 0 < shuffled < 50_000
