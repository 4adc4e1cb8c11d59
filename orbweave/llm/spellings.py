"""Variant spellings of one name: weighted n-grams, a sparse top-n cosine join, average-linkage clusters.

1. Every canonical name and variant is read (names.py); equal readings are one node, so copies never meet in pairs.
2. A node's vector has the character trigrams of its coined part, each tied to the initials of the describing words (or to
   the given name), and the coined part whole. Weights are inverse document frequencies, vectors have length one. Nodes that
   share a feature meet in a join on the feature, and their products are summed to the cosine. A node's most frequent features
   are left out of that join where they cannot reach the threshold by themselves; the lists of frequent ones are joined in parts.
3. Pairs above the threshold are checked word by word (`likeness`); coined parts too far apart in letters are left out
   before their cosines are completed. What differs in a letter or two is also held against websites, numbers and founding dates.
4. Average linkage over the cosines, first of each node's n nearest partners: clusters and their best neighbours join while
   the mean cosine of their pairs stays above a bound, so a single wrong link does not tie two groups together. Pairs that
   are among the n nearest of neither end are settled afterwards: what the clusters do not hold together already goes into a
   second linkage that starts from them, so no link is lost to n.

Null and blank names, and names that hold nothing but legal forms, are in no pair. A name that is only a coined word
ties nothing together, since sister companies share it. Repeated rows with one id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.ids import uuid_value
from orbweave.functions.registry import duns
from orbweave.llm.components import join_by_vertex
from orbweave.llm.names import DBA, GIVEN, LEGAL, REMARKS, Name, Reader, likeness, plain
from orbweave.session import Steps, cut

COSINE = 0.2
TOP_N = 32  # nearest partners of a node that the first linkage takes
MEAN_COSINE = 0.05
UNIT = 1_000_000  # cosines are added up in millionths, as whole numbers, so that their order does not matter
WORD_SHARE = 0.004  # of the rows: a word that so many names share is a describing word (at most 1/share times the words of a name)
HOT = 3000  # nodes; the list of a feature of more is joined in parts
ALIKE = ((0, "full"), (0, "initials"), (0, "subset"), (1, "full"), (1, "initials"), (2, "full"))  # slips, and how the rest agrees


def describing_words(names: DataFrame) -> list[str]:
    """Words of five letters and more that a share of all distinct names holds, and that stand beside several rarer words.

    A slip or a short form of a frequent word is that word, not a rarer one, so one owner's slips are no company. A name
    of nothing but frequent words has as its coined word the one with the fewest rarer words beside it: a word that is
    mostly that is the coined word of a large owner. The condition of rarer words matters for small tables too, where the
    coined word of one name may be frequent.
    """

    @F.pandas_udf("array<string>")
    def words(c: pd.Series) -> pd.Series:
        import re

        bare = lambda n: REMARKS.sub(" ", DBA.sub("", plain(n)))
        return c.map(lambda n: sorted({w for w in re.findall(r"[a-z]{3,}", bare(n)) if w not in LEGAL and w not in GIVEN and w not in ("the", "and")} if n else ()))

    rows = cut(names.select(words("name").alias("words")).groupBy("words").agg(F.count("*").alias("copies")))
    total = rows.count()
    frequent = [r["word"] for r in rows.select(F.explode("words").alias("word")).filter(F.length("word") >= 5).groupBy("word").count().filter(F.col("count") >= max(3, WORD_SHARE * total)).collect()]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(frequent)
        for t in batches:
            read = [{w: reader.word(w) for w in ws} for ws in t["words"]]
            t["known"] = [sorted(set(r.values()) & reader.known) for r in read]
            t["rare"] = [sorted(w for w, x in r.items() if x is None) for r in read]
            yield t[["known", "rare", "copies"]]

    parted = cut(rows.mapInPandas(split, "known array<string>, rare array<string>, copies long").groupBy("known", "rare").agg(F.sum("copies").alias("copies")))
    each = parted.select(F.explode("known").alias("word"), "rare", "copies")
    beside = {r["word"]: r["n"] for r in each.select("word", F.explode("rare").alias("rare")).groupBy("word").agg(F.count_distinct("rare").alias("n")).collect()}
    company = F.create_map(*[F.lit(x) for w in frequent for x in (w, beside.get(w, 0))]) if frequent else F.lit(None).cast("map<string,int>")
    coined = F.array_min(F.transform("known", lambda w: F.struct(company[w].alias("n"), w.alias("word"))))["word"]
    lone = parted.filter(F.size("rare") == 0).groupBy(coined.alias("word")).agg(F.sum("copies").alias("lone"))
    owners = {r["word"] for r in each.groupBy("word").agg(F.sum("copies").alias("rows")).join(lone, "word").filter("2 * lone >= rows").collect()}
    return sorted(w for w, n in beside.items() if n >= 3 and w not in owners)


def _key(n: Name) -> str:
    return "|".join((n.coined, " ".join(n.words), n.initials, " ".join(n.given), n.middle))


def _name(key: str) -> Name:
    coined, words, initials, given, middle = key.split("|")
    return Name(coined, words.split(), initials, tuple(given.split()), middle)


def readings(names: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(name, place, node) of each distinct name: its readings in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(vocabulary)
        for b in batches:
            out = [(n, i, _key(r)) for n in b["name"] for i, r in enumerate(reader.read(n)) if r.coined]
            yield pd.DataFrame(out, columns=["name", "place", "node"])

    return names.filter(F.col("name").rlike(r"\w")).select("name").distinct().mapInPandas(run, "name string, place int, node string")


def named_rows(entities: DataFrame) -> DataFrame:
    """(id, name, own) of every name of a row; own for the canonical one."""
    e = entities.select(uuid_value(F.col("id")).alias("id"), "canonical_name", "name_variants").filter(F.col("id").isNotNull())
    own = e.select("id", F.col("canonical_name").alias("name"), F.lit(True).alias("own"))
    return own.unionByName(e.select("id", F.explode("name_variants").alias("name"), F.lit(False).alias("own"))).filter(F.col("name").isNotNull())


def _features(nodes: DataFrame) -> DataFrame:
    """(node, feature) of each node; one row a feature."""

    @F.pandas_udf("array<string>")
    def grams(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            n = _name(k)
            signs = {"p" + g[0] for g in n.given} if n.person else {"o" + "".join(sorted([w[0] for w in n.words] + list(n.initials)))}
            c = f"^{n.coined}$"
            out.append(sorted({f"{s}:{c[i : i + 3]}" for s in signs for i in range(len(c) - 2)} | {f"={n.coined}"}))
        return pd.Series(out)

    return nodes.select("node", F.explode(grams("node")).alias("feature"))


def near_in_letters(a: str = "a", b: str = "b") -> Column:
    """Coined parts of two nodes close enough for `likeness`: a cheaper test of letters that never refuses what it accepts."""
    x, y = F.substring_index(a, "|", 1), F.substring_index(b, "|", 1)
    n = F.least(F.length(x), F.length(y))  # neighbouring letters that changed places are one slip there and two letters here
    same_start = F.substring(x, 1, 1) == F.substring(y, 1, 1)
    return (x == y) | ((n >= 5) & (F.levenshtein(x, y, 2) >= 0)) | ((n >= 7) & same_start & (F.levenshtein(x, y, 4) >= 0))


def cosine_pairs(nodes: DataFrame, least: float = COSINE, hot: int = HOT, may: Column | None = None) -> DataFrame:
    """(a, b, cosine) of nodes, a before b, whose vectors have at least that cosine and that `may`, a condition on a and b, allows.

    A node is listed under its features from the rarest on, until those left are together shorter than the bound: two nodes
    that share none of the listed ones cannot reach it. What the listed ones leave open is settled over all features.
    Within the join nodes go by number; the numbered table is written first, so numbers hold if an executor is lost.
    """
    numbered = cut(nodes.select("node", F.monotonically_increasing_id().alias("i")))
    postings = cut(_features(numbered).join(numbered, "node").select("i", "feature"))
    counts = postings.groupBy("feature").agg(F.count("*").alias("df"))
    total = nodes.agg(F.count("*").alias("nodes"))
    weighed = postings.join(counts, "feature").crossJoin(F.broadcast(total)).withColumn("w", F.log(1 + F.col("nodes") / F.col("df")))  # one row
    of_node = Window.partitionBy("i")
    onward = of_node.orderBy(F.desc("df"), "feature").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slack = 1e-9  # of rounding
    vectors = weighed.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_node)))
    vectors = vectors.withColumn("onward", F.sqrt(F.sum(F.col("w") * F.col("w")).over(onward))).withColumn("listed", F.col("onward") >= least - slack)
    vectors = cut(vectors.select("i", "feature", "df", "w", "listed", F.coalesce(F.max(F.when(~F.col("listed"), F.col("onward"))).over(of_node), F.lit(0.0)).alias("rest")))
    parts = F.ceil(F.col("df") / hot).cast("int")
    listed = vectors.filter(F.col("listed") & (F.col("df") > 1))
    left = listed.select(F.col("i").alias("ia"), "feature", F.pmod(F.hash("i"), parts).alias("part"), F.col("w").alias("wa"), F.col("rest").alias("ra"))
    right = listed.select(F.col("i").alias("ib"), "feature", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("w").alias("wb"), F.col("rest").alias("rb"))
    met = left.join(right, ["feature", "part"]).filter("ia < ib").groupBy("ia", "ib").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"), F.max(F.greatest("ra", "rb")).alias("rest"))
    met = met.filter(F.col("cosine") + F.col("rest") >= least - slack).select("ia", "ib")
    named = lambda x: numbered.select(F.col("i").alias(f"i{x}"), F.col("node").alias(x))
    met = met.join(named("a"), "ia").join(named("b"), "ib")
    met = cut(met if may is None else met.filter(may))
    side = lambda x: vectors.select(F.col("i").alias(f"i{x}"), "feature", F.col("w").alias(f"w{x}"))
    whole = met.select("ia", "ib").join(side("a"), "ia").join(side("b"), ["ib", "feature"]).groupBy("ia", "ib").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    found = met.join(whole.filter(F.col("cosine") >= least), ["ia", "ib"])
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def _evidence(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, kind, value): each website, number and founding date of the rows (id, node) that carry the node."""
    e = entities.select(uuid_value(F.col("id")).alias("id"), F.lower(F.trim("website_url")).alias("web"), duns(F.col("duns_number")).alias("number"), F.col("founded_date").cast("string").alias("founded"))
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("web", "number", "founded")])
    said = e.select("id", F.explode(kinds).alias("x")).select("id", "x.kind", "x.value").filter(F.col("value") != "")
    return rows.select("id", "node").distinct().join(said, "id").select("node", "kind", "value").distinct()


def alike(pairs: DataFrame) -> DataFrame:
    """(a, b, cosine, slips, how): pairs of nodes that can be one name word by word, with slips and kind of agreement."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            like = [likeness(_name(a), _name(b)) for a, b in zip(t["a"], t["b"], strict=True)]
            t["slips"], t["how"] = [x[0] if x else -1 for x in like], [x[1] if x else "" for x in like]
            yield t[[x in ALIKE for x in like]]

    return pairs.mapInPandas(run, "a string, b string, cosine double, slips int, how string")


def _checked(like: DataFrame, evidence: DataFrame) -> DataFrame:
    """(a, b, s): alike pairs of nodes that nothing speaks against, with their cosine in millionths.

    Pairs with slips are held against the evidence: with two they need a value in common; with one they fail if both have
    websites or numbers and no value of any kind is in common.
    """
    side = lambda df, x: df.withColumnRenamed("node", x)
    slipped = like.filter("slips > 0").select("a", "b")
    shared = cut(slipped.join(side(evidence, "a"), "a").join(side(evidence, "b"), ["b", "kind", "value"]).select("a", "b").distinct())
    telling = evidence.filter(F.col("kind") != "founded").select("node", "kind").distinct()
    against = slipped.join(side(telling, "a"), "a").join(side(telling, "b"), ["b", "kind"]).select("a", "b").distinct()
    bare = like.filter("slips = 1").join(shared, ["a", "b"], "left_anti").join(against, ["a", "b"], "left_anti")
    kept = like.filter("slips > 0").join(shared, ["a", "b"], "left_semi")
    return like.filter("slips = 0").unionByName(bare).unionByName(kept).select("a", "b", F.round(F.col("cosine") * UNIT).cast("long").alias("s"))


def nearest(pairs: DataFrame, n: int = TOP_N) -> DataFrame:
    """The pairs that are among the n of highest cosine of either end; equal cosines by name."""
    cosine = F.round("cosine", 6).alias("cosine")
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), cosine).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), cosine))
    top = ends.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "other"))).filter(F.col("r") <= n)
    return pairs.join(top.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), ["a", "b"], "left_semi")


def average_linkage(links: DataFrame, least: float = MEAN_COSINE, start: DataFrame | None = None) -> DataFrame:
    """(node, cluster) of all nodes in links (a, b, s); pairs without a link count as 0 in the mean.

    Each round every cluster names its best neighbour. Two that name each other become one, and those that name one of the
    two join them. Sums of cosines and sizes are added up, so a round needs the links between clusters only; what became of
    the nodes is followed up at the end. `start` gives the clusters (node, cluster) to begin with; nodes that it does not
    name begin alone. Clusters of very many links are joined by broadcast, as in components.py.
    """
    steps = Steps(links.sparkSession)
    links = steps.take(links.select("a", "b", "s"))
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    member = ends.select("node", F.col("node").alias("cluster"))
    if start is not None:
        given = steps.take(start.select("node", "cluster"))
        member = given.unionByName(member.join(given.select("node"), "node", "left_anti"))
    member, size = steps.write(member, n=F.count(F.lit(1)))
    pairs = links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s")).withColumns({"na": F.lit(1).cast("long"), "nb": F.lit(1).cast("long")})
    if start is not None:
        sizes = member.groupBy("cluster").agg(F.count("*").alias("n"))
        at = lambda x: member.join(sizes, "cluster").select(F.col("node").alias(x), F.col("cluster").alias(f"c{x}"), F.col("n").alias(f"n{x}"))
        pairs = _summed(pairs.select("a", "b", "s").join(at("a"), "a").join(at("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "s", "na", "nb"))
    pairs, many = steps.write(pairs, n=F.count(F.lit(1)))
    moved: list[DataFrame] = []

    def followed(member: DataFrame) -> DataFrame:
        for m in moved:
            member = join_by_vertex(member, m.select(F.col("c").alias("cluster"), "into"), "cluster", size["n"], "left").select("node", F.coalesce("into", "cluster").alias("cluster"))
        return member

    while True:
        mean = F.col("s") / (F.col("na") * F.col("nb"))
        good = pairs.filter(mean >= least * UNIT)
        side = lambda c, to: good.select(F.col(c).alias("c"), F.col(f"n{c}").alias("size"), F.struct(mean.alias("m"), F.col(to).alias("to")).alias("x"))
        best = side("a", "b").unionByName(side("b", "a")).groupBy("c").agg(F.max("x")["to"].alias("to"), F.max("size").alias("size"))
        named = join_by_vertex(best, best.select(F.col("c").alias("to"), F.col("to").alias("back")), "to", size["n"])
        # a mutual pair takes the smaller name; whoever names a member of a mutual pair goes with it
        mutual = named.filter(F.col("back") == F.col("c"))
        follow = named.filter(F.col("back") != F.col("c")).join(mutual.select(F.col("c").alias("to")), "to", "left_semi")
        moves = mutual.unionByName(follow).select("c", "size", F.when(F.col("back") == F.col("c"), F.least("c", "to")).otherwise(F.least("to", "back")).alias("into"))
        totals = moves.groupBy("into").agg(F.sum("size").alias("total"))
        moves, made = steps.write(join_by_vertex(moves, totals, "into", size["n"]).select("c", "into", "total"), n=F.count(F.lit(1)))
        if not made["n"]:
            return steps.give(followed(member))
        moved.append(moves)
        old, after = pairs, pairs
        for x in ("a", "b"):
            after = join_by_vertex(after, moves.withColumnRenamed("c", x), x, many["n"], "left").withColumns({x: F.coalesce("into", x), f"n{x}": F.coalesce("total", f"n{x}")}).drop("into", "total")
        pairs, many = steps.write(_summed(after), n=F.count(F.lit(1)))
        steps.drop(old)
        if len(moved) == 6:  # plans stay short however many rounds there are
            before = member
            member, _ = steps.write(followed(member))
            steps.drop(before, *moved)
            moved.clear()


def _summed(pairs: DataFrame) -> DataFrame:
    """(a, b, s, na, nb) of pairs between different clusters, s added up."""
    turned = F.col("a") > F.col("b")
    p = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"))
    return p.groupBy("a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb"))


def clusters(like: DataFrame, evidence: DataFrame, alias: DataFrame, n: int = TOP_N) -> DataFrame:
    """(node, cluster) from alike pairs and the aliases (a, b, s) that rows give themselves: nearest first, then the rest."""
    top = cut(nearest(like, n))
    rest = cut(like.join(top.select("a", "b"), ["a", "b"], "left_anti"))
    links = cut(_checked(top, evidence).unionByName(alias))
    found = average_linkage(links)
    if rest.isEmpty():
        return found
    at = lambda x: found.select(F.col("node").alias(x), F.col("cluster").alias(f"c{x}"))
    apart = rest.join(at("a"), "a", "left").join(at("b"), "b", "left").filter(~F.col("ca").eqNullSafe(F.col("cb")) | F.col("ca").isNull())
    return average_linkage(links.unionByName(_checked(cut(apart.select(*rest.columns)), evidence)), start=found)


#: A name read as a lone coined word is no evidence beyond its own row.
TELLS = r"^[^|]*\|\|\|\|"


def read_rows(names: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(id, own, place, node) of every name (id, name, own) by its readings."""
    return cut(names.join(cut(readings(names, vocabulary)), "name").select("id", "own", "place", "node"))


def own_nodes(rows: DataFrame) -> DataFrame:
    """(id, node) of the first reading of each row's canonical name."""
    return rows.filter(F.col("own") & (F.col("place") == 0)).select("id", "node").distinct()


def aliases(rows: DataFrame) -> DataFrame:
    """(a, b, s) of a row's canonical name with its other readings and variants: the row itself says that they are one."""
    others = rows.filter(~(F.col("own") & (F.col("place") == 0)) & ~F.col("node").rlike(TELLS)).select("id", F.col("node").alias("other"))
    return own_nodes(rows).join(others, "id").filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.lit(UNIT).cast("long").alias("s")).distinct()


def spelling_groups(entities: DataFrame, vocabulary: list[str] | None = None, n: int = TOP_N) -> DataFrame:
    """(entity_id, group_id) of every row with a readable name; group_id names the cluster of its canonical name.

    The describing words are learned from the rows unless a vocabulary that was fitted before is given.
    """
    names = cut(named_rows(entities))
    rows = read_rows(names, describing_words(names.filter("own")) if vocabulary is None else vocabulary)
    nodes = rows.filter(~F.col("node").rlike(TELLS)).select("node").distinct()
    like = cut(alike(cosine_pairs(nodes, may=near_in_letters())))
    found = clusters(like, cut(_evidence(entities, rows)), aliases(rows), n)
    return own_nodes(rows).join(found, "node", "left").select(F.col("id").alias("entity_id"), F.coalesce("cluster", "node").alias("group_id"))


def same_name_pairs(groups: DataFrame) -> DataFrame:
    """(entity_a, entity_b) of the rows of each group, the smaller id first."""
    a, b = groups.select(F.col("entity_id").alias("entity_a"), "group_id"), groups.select(F.col("entity_id").alias("entity_b"), "group_id")
    return a.join(b, "group_id").filter("entity_a < entity_b").select("entity_a", "entity_b")
