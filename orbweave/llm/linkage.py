"""Records of sources without a common key: soft-logic linkage solved by alternating directions.

Candidates come from the sparse cosine join of the names, from equal codes, from codes that are masked, cut or one slip
off within one state, and from equal coined words (without describing words) within one state or founding year. For
each candidate pair there is a truth value y between 0 and 1, for each pair of a record and an organisation (group of entity
spellings) a value z. Weighted rules speak about them: like names, codes, places and years argue for y, contradicting
ones against it, and a prior against all; y implies z and z implies y, so rows of one organisation match together
(transitivity); the z of a record sum up to one at most (exclusivity). Every rule is a hinge, the whole a convex problem.

It is solved by consensus ADMM: each rule moves its own copies of the values in closed form, copies are averaged, and
multipliers carry the disagreement on, until values and copies change by less than a tolerance. Candidates of a record
that fare alike under all rules (same organisation, same weights) are one row with their number, by an aggregation with
map-side combine; weights take few values, so a record has a bounded number of rows however many entity rows an owner
has. Rules tie values of one record only, so buckets of records are solved side by side. The final y is the confidence.

Records with a null id or an unreadable name, and merged entities, are in no pair. Equal records with different ids each
match. A missing attribute says nothing, nor does a code that more than a score of organisations carry.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.ids import uuid_value
from orbweave.functions.registry import cage, cage_pattern, corrected, duns, duns_tail, gazetteer, place, state_code
from orbweave.llm import spellings
from orbweave.session import cut

TOLERANCE = 1e-3  # of values and of their copies, from round to round
MOST_ROUNDS = 5000  # a bound on time; how many records reach it is given by `solve`
BUCKET_ROWS = 20_000
STEP = 1.0  # the penalty of ADMM
MATCH = 0.5
ORGS_A_CODE = 20  # a code that more organisations carry is no code of any
#: Rule weights; for like names by slips and kind of agreement.
NAME = {(0, "full"): 2.0, (0, "initials"): 1.5, (0, "subset"): 0.8, (1, "full"): 1.5, (1, "initials"): 0.7, (2, "full"): 0.4}
LONE = 0.8  # a coined word alone
PRIOR, NO_NAME, LINK, EXCLUSIVE = 1.0, 1.0, 2.0, 2.0
CAGE_SAME, CAGE_MASKED, CAGE_SLIP, CAGE_OTHER = 3.0, 1.5, 1.0, 1.5
DUNS_SAME, DUNS_MASKED, DUNS_SLIP, DUNS_OTHER = 3.0, 1.5, 1.0, 1.5
CITY_SAME, STATE_SAME, STATE_OTHER = 1.0, 0.2, 0.4
YEAR_SAME, YEAR_NEAR, YEAR_OTHER = 0.8, 0.2, 0.9


def _city(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with city and state brought to the known spelling."""
    fixed = corrected(rows.select("city", "state"), known)
    return rows.join(fixed, ["city", "state"], "left").withColumn("city", F.coalesce("fixed", "city")).drop("fixed")


def _sides(entities: DataFrame, vendors: DataFrame) -> tuple[DataFrame, DataFrame]:
    e = entities.filter(F.col("merged_into_id").isNull()).select(
        uuid_value(F.col("id")).alias("e"), cage(F.col("cage_code")).alias("e_cage"), duns(F.col("duns_number")).alias("e_duns"), place(F.col("headquarters_location")).alias("p"), F.year("founded_date").alias("e_year"),
    ).filter(F.col("e").isNotNull()).dropDuplicates(["e"]).select("*", "p.city", "p.state").drop("p")
    v = vendors.filter(F.col("record_id").isNotNull()).dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("r"), cage(F.col("cage_text")).alias("r_cage"), cage_pattern(F.col("cage_text")).alias("r_mask"), duns(F.col("duns_text")).alias("r_duns"), duns_tail(F.col("duns_text")).alias("r_tail"),
        F.initcap(F.trim(F.regexp_replace("city", r"\s+", " "))).alias("city"), state_code(F.col("state")).alias("state"), F.col("founded_year").alias("r_year"),
    )
    known = cut(gazetteer(e.select("city", "state").unionByName(v.select("city", "state"))))
    # a line without its state is in the one state that has such a city
    only = known.groupBy("city").agg(F.max("state").alias("only"), F.count("*").alias("states")).filter("states = 1").select("city", "only")
    v = v.join(only, "city", "left").withColumn("state", F.coalesce("state", "only")).drop("only")
    return cut(_city(e, known).withColumnRenamed("city", "e_city").withColumnRenamed("state", "e_state")), cut(_city(v, known).withColumnRenamed("city", "r_city").withColumnRenamed("state", "r_state"))


def _shared_by_many(rows: DataFrame, code: str) -> DataFrame:
    """rows with a code nulled that more organisations carry than one owner can have spellings apart."""
    many = rows.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count_distinct("org").alias("orgs")).filter(F.col("orgs") > ORGS_A_CODE).select(code, F.lit(True).alias("many"))
    return rows.join(many, code, "left").withColumn(code, F.when(F.col("many").isNull(), F.col(code))).drop("many")


def _masks(c: str, unknown: int) -> Column:
    """All forms of a five-letter code with that many of its letters unknown."""
    hide = [(i,) for i in range(5)] if unknown == 1 else [(i, j) for i in range(5) for j in range(i)]
    return F.array(*[F.concat(*[F.lit("?") if i in h else F.substring(c, i + 1, 1) for i in range(5)]) for h in hide])


def _by_near_codes(v: DataFrame, e: DataFrame) -> DataFrame:
    """(r, e) within one state whose CAGE codes fit but for masked letters, one other letter or two that changed places, or whose DUNS end alike in one town."""
    turned = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    ours = e.filter(F.col("e_cage").isNotNull() & F.col("e_state").isNotNull()).select("e", F.col("e_state").alias("state"), F.explode(F.concat(_masks("e_cage", 1), _masks("e_cage", 2), F.array(turned("e_cage")))).alias("k"))
    whole = v.filter(F.col("r_cage").isNotNull()).select("r", F.col("r_state").alias("state"), F.explode(F.concat(_masks("r_cage", 1), F.array(turned("r_cage")))).alias("k"))
    masked = v.filter(F.col("r_cage").isNull() & F.col("r_mask").isNotNull()).select("r", F.col("r_state").alias("state"), F.col("r_mask").alias("k"))
    tails = v.filter("r_tail IS NOT NULL").select("r", F.col("r_state").alias("state"), F.col("r_city").alias("city"), F.col("r_tail").alias("k"))
    ends = e.filter("e_duns IS NOT NULL").select("e", F.col("e_state").alias("state"), F.col("e_city").alias("city"), F.explode(F.array(F.right("e_duns", F.lit(3)), F.right("e_duns", F.lit(4)))).alias("k"))
    return whole.unionByName(masked).join(ours, ["state", "k"]).select("r", "e").unionByName(tails.join(ends, ["state", "city", "k"]).select("r", "e"))


def candidates(entities: DataFrame, vendors: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """One row per candidate (r, e): organisation, attributes of both sides, name_w (0 if only codes brought it here).

    The describing words are learned from the entities unless a vocabulary that was fitted before is given.
    """
    live = entities.filter(F.col("merged_into_id").isNull())
    e, v = _sides(entities, vendors)
    lines = vendors.select(F.concat(F.lit("v"), F.col("record_id").cast("string")).alias("id"), F.col("vendor_name").alias("name")).filter(F.col("id").isNotNull() & F.col("name").isNotNull())
    ours = cut(spellings.named_rows(live))
    rows = spellings.read_rows(ours.unionByName(lines.withColumn("own", F.lit(False))), spellings.describing_words(ours.filter("own")) if vocabulary is None else vocabulary)
    tells = ~F.col("node").rlike(spellings.TELLS)
    nodes = rows.filter(tells).select("node").distinct()
    like = cut(spellings.alike(spellings.cosine_pairs(nodes, may=spellings.near_in_letters())))
    # organisations: clusters of the entity names
    theirs, lined = rows.filter(~F.col("id").startswith("v")), rows.filter(F.col("id").startswith("v"))
    mine = theirs.filter(tells).select("node").distinct()
    among = like.join(mine.withColumnRenamed("node", "a"), "a", "left_semi").join(mine.withColumnRenamed("node", "b"), "b", "left_semi").select(*like.columns)
    found = spellings.clusters(among, cut(spellings._evidence(live, theirs)), spellings.aliases(theirs))
    groups = spellings.own_nodes(theirs).join(found, "node", "left").select(F.col("id").alias("e"), F.coalesce("cluster", "node").alias("org")).dropDuplicates(["e"])
    e = e.join(groups, "e", "left").withColumn("org", F.coalesce("org", "e"))
    e = cut(_shared_by_many(_shared_by_many(e, "e_cage"), "e_duns"))
    # names
    weight = reduce(lambda out, x: F.when((F.col("slips") == x[0][0]) & (F.col("how") == x[0][1]), x[1]).otherwise(out), NAME.items(), F.lit(0.0))
    one_way = like.select("a", "b", weight.alias("name_w"))
    weights = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "name_w")).unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(NAME[0, "full"]).alias("name_w")))
    r = F.expr("cast(substring(id, 2) as bigint)").alias("r")
    by_name = lined.filter(tells).select(r, F.col("node").alias("a")).join(weights, "a").join(theirs.filter(tells).select(F.col("id").alias("e"), F.col("node").alias("b")), "b").groupBy("r", "e").agg(F.max("name_w").alias("name_w"))
    # a coined word alone, on either side
    coined = F.substring_index("node", "|", 1).alias("coined")
    word_v = lined.select(r, coined, (~tells).alias("bare_v")).distinct().join(v.select("r", "r_state", "r_year"), "r")
    word_e = theirs.select(F.col("id").alias("e"), coined, (~tells).alias("bare_e")).distinct().join(e.select("e", "e_state", "e_year"), "e")
    lone = lambda k: word_v.withColumn("k", F.col(f"r_{k}")).join(word_e.withColumn("k", F.col(f"e_{k}")), ["coined", "k"]).filter("bare_v OR bare_e").select("r", "e")
    by_word = lone("state").unionByName(lone("year")).distinct().select("r", "e", F.lit(LONE).alias("name_w"))
    # codes
    by_code = v.select("r", F.col("r_cage").alias("k")).join(e.select("e", F.col("e_cage").alias("k")), "k").select("r", "e")
    by_number = v.select("r", F.col("r_duns").alias("k")).join(e.select("e", F.col("e_duns").alias("k")), "k").select("r", "e")
    coded = by_code.unionByName(by_number).unionByName(_by_near_codes(v, e)).select("r", "e", F.lit(0.0).alias("name_w"))
    pairs = by_name.unionByName(by_word).unionByName(coded).groupBy("r", "e").agg(F.max("name_w").alias("name_w"))
    return pairs.join(v, "r").join(e, "e")


def _either(*rules: tuple[Column, float]) -> Column:
    """The weight of the first rule that holds, else 0 (also where nothing is known)."""
    return reduce(lambda out, r: F.when(r[0], F.lit(r[1])).otherwise(out), reversed(rules), F.lit(0.0))


def grounded(pairs: DataFrame) -> DataFrame:
    """(r, e, org) with the signed weight of each unary rule: w0.. (positive argues for the match, negative against)."""
    c, m, d, t = F.col("r_cage"), F.col("r_mask"), F.col("r_duns"), F.col("r_tail")
    fits = F.like(F.col("e_cage"), F.translate(m, "?", "_"))
    letters = lambda x: F.array_sort(F.split(x, ""))
    slipped = lambda x, y: (F.levenshtein(x, y) <= 1) | ((F.levenshtein(x, y) == 2) & (letters(x) == letters(y)))
    year = F.abs(F.col("r_year") - F.col("e_year"))
    rules = [
        F.when(F.col("name_w") > 0, F.col("name_w")).otherwise(-NO_NAME),
        _either((c == F.col("e_cage"), CAGE_SAME), (slipped(c, F.col("e_cage")), CAGE_SLIP), (c.isNotNull() & F.col("e_cage").isNotNull(), -CAGE_OTHER), (c.isNull() & fits, CAGE_MASKED), (c.isNull() & m.isNotNull() & F.col("e_cage").isNotNull(), -CAGE_OTHER)),
        _either((d == F.col("e_duns"), DUNS_SAME), (slipped(d, F.col("e_duns")), DUNS_SLIP), (d.isNotNull() & F.col("e_duns").isNotNull(), -DUNS_OTHER), (F.col("e_duns").endswith(t), DUNS_MASKED), (t.isNotNull() & F.col("e_duns").isNotNull(), -DUNS_OTHER)),
        _either(((F.col("r_city") == F.col("e_city")) & (F.col("r_state") == F.col("e_state")), CITY_SAME), (F.col("r_state") == F.col("e_state"), STATE_SAME), (F.col("r_state") != F.col("e_state"), -STATE_OTHER)),
        _either((year == 0, YEAR_SAME), (year == 1, YEAR_NEAR), (year > 1, -YEAR_OTHER)),
        F.lit(-PRIOR),
    ]
    return pairs.select("r", "e", "org", *[w.cast("double").alias(f"w{i}") for i, w in enumerate(rules)])


UNARY = 6
WEIGHTS = [f"w{i}" for i in range(UNARY)]


def admm(w: np.ndarray, many: np.ndarray, org: np.ndarray, rec: np.ndarray, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Values y of rows with rule weights w that stand for `many` candidates each, and the rounds their records took.

    org numbers the (record, organisation) of each row, rec the record of each such number; both run from 0 without gaps,
    and rows come by rec. A record whose values and copies are at rest is taken out.
    """
    n = len(w)
    out, took = np.zeros(n), np.full(n, most, np.int64)
    rows = np.arange(n)
    y, z = np.full(n, 0.5), np.full(len(rec), 0.5)
    u, ul = np.zeros((n, w.shape[1])), np.zeros((n, 4))  # multipliers of the unary rules, and of the links: y1, z1, y2, z2
    ug = np.zeros(len(rec))
    g = LINK / STEP
    for t in range(1, most + 1):
        of = rec[org]
        weight, orgs, size = np.bincount(org, many), np.bincount(rec).astype(float), w / STEP
        # a unary rule moves its copy towards 1 or 0 by its weight, no farther than the end
        v = y[:, None] - u
        up, down = np.where(v >= 1, v, np.minimum(v + size, 1.0)), np.where(v <= 0, v, np.maximum(v + size, 0.0))
        x = np.where(size > 0, up, np.where(size < 0, down, v))
        # y implies z, and z implies y: the larger comes down and the smaller up until they meet or the weight is spent
        vy1, vz1, vy2, vz2 = y - ul[:, 0], z[org] - ul[:, 1], y - ul[:, 2], z[org] - ul[:, 3]
        m1, m2 = np.clip((vy1 - vz1) / 2, 0, g), np.clip((vz2 - vy2) / 2, 0, g)
        xl = np.stack([vy1 - m1, vz1 + m1, vy2 + m2, vz2 - m2], 1)
        # exclusivity: all organisations of a record give way alike
        vg = z - ug
        xg = vg - np.clip((np.bincount(rec, vg) - 1) / orgs, 0, EXCLUSIVE / STEP)[rec]
        y0, z0 = y, z
        y = np.clip(((x + u).sum(1) + xl[:, 0] + ul[:, 0] + xl[:, 2] + ul[:, 2]) / (w.shape[1] + 2), 0, 1)
        z = np.clip((np.bincount(org, many * (xl[:, 1] + ul[:, 1] + xl[:, 3] + ul[:, 3])) + xg + ug) / (2 * weight + 1), 0, 1)
        pulled, linked = x - y[:, None], xl - np.stack([y, z[org], y, z[org]], 1)
        u, ul, ug = u + pulled, ul + linked, ug + xg - z
        if t % 20 == 0 or t == most:
            far = np.maximum(np.abs(pulled).max(1), np.abs(linked).max(1))
            far = np.maximum(far, np.maximum(np.abs(y - y0), np.abs(z - z0)[org]))
            worst = np.zeros(len(orgs))
            np.maximum.at(worst, of, far)
            at_rest = worst[of] < tolerance
            if t == most or at_rest.all():
                out[rows] = y
                took[rows[at_rest]] = t
                break
            if at_rest.any():
                out[rows[at_rest]], took[rows[at_rest]] = y[at_rest], t
                stay, slots = ~at_rest, worst[rec] >= tolerance
                to_slot, to_rec = np.cumsum(slots) - 1, np.cumsum(worst >= tolerance) - 1
                org, rec = to_slot[org[stay]], to_rec[rec[slots]]
                rows, w, many, y, u, ul = rows[stay], w[stay], many[stay], y[stay], u[stay], ul[stay]
                z, ug = z[slots], ug[slots]
    return out, took


def _solve_bucket(b: pd.DataFrame) -> pd.DataFrame:
    b = b.sort_values(["r", "org", *WEIGHTS], kind="stable").reset_index(drop=True)
    new_r = (b["r"] != b["r"].shift()).to_numpy()
    new_o = new_r | (b["org"] != b["org"].shift()).to_numpy()
    org = np.cumsum(new_o) - 1
    y, took = admm(b[WEIGHTS].to_numpy(float), b["many"].to_numpy(float), org, (np.cumsum(new_r) - 1)[new_o])
    return b.assign(confidence=y, rounds=took)[["r", "org", *WEIGHTS, "confidence", "rounds"]]


def solve(ground: DataFrame) -> DataFrame:
    """(r, e, org, confidence, rounds): the values, and the rounds after which their record was at rest."""
    ground = cut(ground)
    spark = ground.sparkSession
    kinds = cut(ground.groupBy("r", "org", *WEIGHTS).agg(F.count("*").alias("many")))
    buckets = max(1, math.ceil(kinds.count() / BUCKET_ROWS))
    tasks = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    schema = "r long, org string, " + ", ".join(f"{w} double" for w in WEIGHTS) + ", confidence double, rounds long"
    spread = kinds.withColumn("bucket", F.pmod(F.xxhash64("r"), F.lit(buckets))).repartition(tasks, "bucket")  # a given number is not coalesced
    solved = spread.groupBy("bucket").applyInPandas(_solve_bucket, schema)
    return ground.join(solved, ["r", "org", *WEIGHTS]).select("r", "e", "org", "confidence", "rounds")


def matches(entities: DataFrame, vendors: DataFrame) -> DataFrame:
    """(entity_id, record_id, confidence) of every candidate."""
    return solve(grounded(candidates(entities, vendors))).select(F.col("e").alias("entity_id"), F.col("r").alias("record_id"), F.round("confidence", 4).alias("confidence"))
