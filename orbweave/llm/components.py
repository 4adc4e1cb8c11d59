"""Pairwise matches into groups: strip leaves, compress chains by list ranking, solve the core, restore labels.

Each round takes all vertices of degree one and two out of the graph at once. Walks through vertices of degree two are
followed to their ends by pointer doubling (list ranking), so a chain of any length costs a logarithmic number of joins;
a chain between two branching vertices leaves one edge between them. What remains has degree three or more everywhere
and is solved by alternating stars. Labels are then handed back to the removed vertices, last round first.

A hub may hold a third of all edges. Degrees and neighbours come from aggregations with map-side combine; a walk carries
along whether its end is a leaf, so no removed vertex is joined to its hub; and where rows do go by a vertex (stars of the
core, labels handed back), vertices that hold more than 1/10,000 of the rows, at most 10,000 of them, are joined by
broadcast and the rest by shuffle. Steps are tables in the shared folder, deleted once their successors are written.

Self links, repeated links in either order, and links to unknown ids count for nothing; null ends are dropped; an
empty link table gives no groups.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.session import Steps

HEAVY = 10_000  # a vertex with more than 1/HEAVY of the rows is joined by broadcast; there are at most HEAVY of them
ONE_TASK = 1_000_000  # rows of a few ids each: no more than these need no care, whatever their keys


def join_by_vertex(rows: DataFrame, info: DataFrame, key: str, total: int, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """rows join info (one row a key) on a key that may be hot in rows; heavy names its hot values (found by a count if null).

    total is the number of rows. It decides on the plan only; the rows that come out are the same.
    """
    if total <= ONE_TASK:
        return rows.join(info, key, how)
    if heavy is None:
        heavy = rows.groupBy(key).agg(F.count("*").alias("rows_")).filter(F.col("rows_") * HEAVY > total).select(key)
    hot = info.join(F.broadcast(heavy), key, "left_semi")  # at most HEAVY rows
    cold = rows.join(F.broadcast(heavy), key, "left_anti")
    return rows.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(hot), key, how).unionByName(cold.join(info, key, how))


def _vertices(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("d"), F.min("dst").alias("n1"), F.max("dst").alias("n2"))


def _walk_ends(steps: Steps, low: DataFrame, twos: int) -> DataFrame:
    """For each arc out of a removed vertex: (u, v, nv, done, leaf, least), where the walk from u through v leads.

    An arc into a vertex of degree two goes on to that vertex's other neighbour; one into a vertex of degree one ends at
    a leaf. Walks are followed by doubling; those on a ring never end, and after the last round their `least` is the
    ring's smallest vertex.
    """
    arc = lambda u, v, to, end: low.filter(F.col("d") == end).select(F.col(u).alias("u"), F.col(v).alias("v"), to.alias("to"), F.lit(end == 1).alias("leaf"))
    onward = arc("n1", "src", F.col("n2"), 2).unionByName(arc("n2", "src", F.col("n1"), 2)).unionByName(arc("n1", "src", F.lit(None).cast(dict(low.dtypes)["src"]), 1))
    out = low.select(F.col("src").alias("u"), F.explode(F.array_distinct(F.array("n1", "n2"))).alias("v"))
    arcs = out.join(onward, ["u", "v"], "left").select(  # keys are arcs, each of them once
        "u", "v", F.when(F.col("to").isNotNull(), F.col("v")).otherwise(F.col("u")).alias("nu"), F.coalesce("to", "v").alias("nv"),
        F.col("to").isNull().alias("done"), F.coalesce("leaf", F.lit(False)).alias("leaf"), F.least("u", "v").alias("least"))
    going = F.coalesce(F.sum(F.when(~F.col("done"), 1)), F.lit(0))
    arcs, left = steps.write(arcs, going=going)
    for _ in range(math.ceil(math.log2(twos + 1)) + 1):
        if not left["going"]:
            break
        ahead = arcs.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("mu"), F.col("nv").alias("mv"), F.col("done").alias("mdone"), F.col("leaf").alias("mleaf"), F.col("least").alias("mleast"))
        open_ = arcs.filter(~F.col("done")).join(ahead, ["nu", "nv"], "left").select(
            "u", "v", F.coalesce("mu", "nu").alias("nu"), F.coalesce("mv", "nv").alias("nv"),
            # a walk that reaches a branching vertex has no arc ahead
            F.coalesce("mdone", F.lit(True)).alias("done"), F.coalesce("mleaf", F.lit(False)).alias("leaf"), F.least("least", F.coalesce("mleast", "nv")).alias("least"))
        before = arcs
        arcs, left = steps.write(arcs.filter("done").unionByName(open_), going=going)
        steps.drop(before)
    return arcs


def _strip(steps: Steps, edges: DataFrame, vertices: DataFrame, twos: int) -> tuple[tuple[DataFrame, int], DataFrame]:
    """Take out all vertices of degree one and two: (removed: v, parent) with their number, remaining edges."""
    low = vertices.filter(F.col("d") <= 2)
    arcs = _walk_ends(steps, low, twos)
    hub = F.when(F.col("done") & ~F.col("leaf"), F.col("nv"))
    # a vertex hangs on a branching end if it has one, else (path or ring) on the smallest vertex of its component
    ranked, _ = steps.write(arcs.groupBy("u").agg(F.min(hub).alias("hub1"), F.max(hub).alias("hub2"), F.min(F.least("least", "nv")).alias("least")))
    removed, state = steps.write(ranked.select(F.col("u").alias("v"), F.coalesce("hub1", "least").alias("parent")).filter(F.col("v") != F.col("parent")), n=F.count(F.lit(1)))
    bridges = ranked.filter(F.col("hub1") != F.col("hub2")).select(F.col("hub1").alias("a"), F.col("hub2").alias("b")).distinct()
    # a removed vertex knows all its edges, so they go by whole edges and no hub is a join key
    mine = low.select("src", F.explode(F.array_distinct(F.array("n1", "n2"))).alias("dst"))
    lost = mine.unionByName(mine.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    kept = edges.join(lost, ["src", "dst"], "left_anti")
    both = bridges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(bridges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    rest, _ = steps.write(kept.unionByName(both).distinct())
    steps.drop(arcs, ranked)
    return (removed, state["n"]), rest


def _core(steps: Steps, edges: DataFrame) -> DataFrame:
    """(v, label) of a graph without vertices of low degree: alternating large and small stars until no pair changes."""
    pairs, state = steps.write(edges.filter(F.col("src") > F.col("dst")).select("src", "dst"), n=F.count(F.lit(1)))
    while True:
        sym = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low, _ = steps.write(sym.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"), F.count("*").alias("d")))
        heavy = low.filter(F.col("d") * HEAVY > 2 * state["n"]).select("src")
        star = join_by_vertex(sym.filter(F.col("dst") > F.col("src")), low.select("src", "m"), "src", 2 * state["n"], heavy=heavy)
        large, many = steps.write(star.select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct(), n=F.count(F.lit(1)))
        small_low, _ = steps.write(large.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("d")))
        heavy = small_low.filter(F.col("d") * HEAVY > many["n"]).select("src")
        star = join_by_vertex(large, small_low.select("src", "m"), "src", many["n"], heavy=heavy)
        small = star.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(small_low.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct()
        before, n = pairs, state["n"]
        pairs, state = steps.write(small, n=F.count(F.lit(1)))
        same = state["n"] == n and pairs.join(before, ["src", "dst"], "left_anti").isEmpty()
        steps.drop(low, large, small_low, before)
        if same:
            return pairs.select(F.col("src").alias("v"), F.col("dst").alias("label")).unionByName(pairs.select(F.col("dst").alias("v"), F.col("dst").alias("label"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, group_id) of every id in a link; group_id is the smallest id of the group."""
    steps = Steps(links.sparkSession)
    pairs = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter(F.col("src") != F.col("dst"))
    edges = steps.take(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    rounds: list[tuple[DataFrame, int]] = []
    core = None
    while True:
        vertices, sizes = steps.write(_vertices(edges), n=F.count(F.lit(1)), low=F.coalesce(F.sum(F.when(F.col("d") <= 2, 1)), F.lit(0)), twos=F.coalesce(F.sum(F.when(F.col("d") == 2, 1)), F.lit(0)))
        if not sizes["n"]:
            break
        if not sizes["low"]:
            core = _core(steps, edges)
            break
        removed, rest = _strip(steps, edges, vertices, sizes["twos"])
        steps.drop(edges, vertices)
        rounds.append(removed)
        edges = rest
    kind = dict(edges.dtypes)["src"]
    labels, state = steps.write(core if core is not None else steps.spark.createDataFrame([], f"v {kind}, label {kind}"), n=F.count(F.lit(1)))
    for removed, many in reversed(rounds):
        parents = labels.select(F.col("v").alias("parent"), "label")
        # a parent without a label is the smallest vertex of a path or ring, and a root
        mine = join_by_vertex(removed, parents, "parent", many, "left").select("v", "parent", "label")
        roots = mine.filter(F.col("label").isNull()).select(F.col("parent").alias("v"), F.col("parent").alias("label")).distinct()
        before = labels
        labels, state = steps.write(labels.unionByName(mine.select("v", F.coalesce("label", "parent").alias("label"))).unionByName(roots), n=F.count(F.lit(1)))
        steps.drop(before, removed)
    least = labels.groupBy("label").agg(F.min("v").alias("group_id"))
    # group_id is by value the smallest vertex, which for most labels is the label itself
    other = least.filter(F.col("label") != F.col("group_id"))
    named = join_by_vertex(labels, other, "label", state["n"], "left")
    return steps.give(named.select(F.col("v").alias("id"), F.coalesce("group_id", "label").alias("group_id")))
