"""Record linkage and text operators against brute force, public encoders and known cases."""

import base64
import datetime as dt
import math
import os
import random

import numpy as np
import pytest

from orbweave.llm import bpe, linkage, names, packing, spellings, survivorship, truncation
from orbweave.llm import components as components_module
from orbweave.llm.components import components

U = [f"00000000-0000-0000-0000-0000000000{i:02d}" for i in range(60)]
ENT = (
    "id string, canonical_name string, name_variants array<string>, entity_type string, cage_code string, duns_number string, headquarters_location string, website_url string, founded_date date, "
    "merged_into_id string, record_source string, created_at timestamp, updated_at timestamp, node string, city string"
)


def entity(i, name, variants=None, cage=None, duns=None, hq=None, web=None, founded=None, merged=None, source="sam_registry", day=1):
    t = dt.datetime(2024, 1, day)
    return (U[i], name, variants, "STARTUP", cage, duns, hq, web, founded, U[merged] if merged is not None else None, source, t, t, "clash", "clash")


# groups
def _roots(pairs):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = f(a), f(b)
            if a != b:
                p[max(a, b)] = min(a, b)
    return {x: f(x) for x in p}


@pytest.mark.parametrize("case", ["path", "ring", "star", "clique", "mixed", "empty"])
def test_components(spark, case):
    rnd = random.Random(3)
    pairs = {
        "path": [(i, i + 1) for i in range(40)], "ring": [(i, (i + 1) % 15) for i in range(15)], "star": [(0, i) for i in range(1, 30)] + [(0, 1), (1, 0), (5, 5)], "clique": [(i, j) for i in range(7) for j in range(i)],
        "mixed": [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(90)] + [(100, 101), (None, 3)], "empty": [],
    }[case]
    text = [(None if a is None else f"{a * 7 % 997:03d}", None if b is None else f"{b * 7 % 997:03d}") for a, b in pairs]
    got = [tuple(r) for r in components(spark.createDataFrame([(a, b, "x") for a, b in text], "a string, b string, label string")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == _roots(text)


# names
@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Kratopen Orbital Software Co.", "Krátopen Orbital Sftwr LLC", True), ("Vogomar-orbital Security LP", "Vogo Mar Orbital Security LP", True), ("Dresuwick  A.S. Ltd", "DRESUWICK APPLIED SIMULATION LTD", True), ("Buvat0r Orbital Instruments", "Instruments, Buvator Orbital Ltd", True),
        ("Kikorkin Allied Photonics Corp", "Kikorkin Tactical Robotics", False), ("Voruzell, Hank C.", "Henry C Voruzell", True), ("Richard Kimucroft", "Ramón Glan Kimucroft", False), ("Margaret S. Pekihane", "Peggy Pekihane", True), ("Brepofex Applied Optics", "Stekulon Applied Optics", False),
    ],
)
def test_likeness(a, b, same):
    r = names.Reader("orbital software security applied simulation instruments allied photonics tactical robotics optics".split())
    assert any(names.likeness(x, y) for x in r.read(a) for y in r.read(b)) == same


def test_distance():
    def plain(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in range(2))
        assert names.distance(a, b, 3) == min(plain(a, b), 4)


def _entities(spark):
    rows = [entity(i, f"{c} Applied Optics Inc") for i, c in enumerate(("Brepofex", "Stekulon", "Vogomart", "Dresuwik", "Kratopen"))]
    rows += [
        entity(10, "Brepofex A.O. Inc"), entity(11, "BREPOFEX APPLIED OPTCIS LLC"), entity(12, "Applied Optics Brepofex"), entity(13, "Brepofex Applied Optics Inc"), entity(14, "Brepofex Marine Power Inc"), entity(15, "Stekulon Applied Power"),
        entity(16, None, None), entity(17, "", []), entity(18, "   ", [None, ""]), entity(19, "Zutamont Marine Power", ["Zutamont Marine Pwr"]), entity(20, "Zutamnot Marine Power"), entity(20, "Zutamnot Marine Power"), entity(21, "Inc"), entity(22, "Plavidex Marine Power"),
    ]
    return spark.createDataFrame(rows, ENT)


def test_spelling_pairs(spark):
    e = _entities(spark)
    pairs = {tuple(r) for r in spellings.same_name_pairs(spellings.spelling_groups(e)).collect()}
    same = lambda *x: {(U[i], U[j]) for i in x for j in x if i < j}
    assert pairs == same(0, 10, 11, 12, 13) | same(19, 20)
    assert spellings.spelling_groups(e.limit(0)).count() == 0


def test_describing_words_beside_a_large_owner(spark):
    """One owner whose describing words are often mistyped holds a third of the rows."""
    rnd = random.Random(5)
    others = ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(4)) for _ in range(200)]
    words = "optics marine power software".split()
    slip = lambda w: w[: (i := rnd.randint(1, len(w) - 1))] + rnd.choice("bdfgkmnvxz") + w[i + 1 :]
    rows = [f"{c} Applied {rnd.choice(words)} Inc" for c in others] + [f"Brepofex {slip('applied') if i % 6 == 0 else 'Applied'} {slip('optics') if i % 6 == 3 else 'Optics'} LLC" for i in range(100)]
    got = spellings.describing_words(spark.createDataFrame([(n,) for n in rows], "name string"))
    assert got == sorted(["applied", *words])
    ids = [(f"00000000-0000-0000-0000-{i:012d}", n) for i, n in enumerate(rows)]
    e = spark.createDataFrame([(i, n, None, None, None, None) for i, n in ids], "id string, canonical_name string, name_variants array<string>, website_url string, duns_number string, founded_date date")
    groups = {r["entity_id"]: r["group_id"] for r in spellings.spelling_groups(e).collect()}
    assert len(groups) == len(ids) and len({groups[i] for i, n in ids if n.startswith("Brepofex")}) == 1


def test_cosine_pairs_of_hot_features(spark):
    nodes = spark.createDataFrame([(f"{c}|applied optics|||",) for c in ("brepofex", "brepofax", "brepotex", "stekulon")], "node string")
    pairs = lambda **k: {(r["a"], r["b"]) for r in spellings.cosine_pairs(nodes, **k).collect()}
    cold = pairs()
    assert cold and cold == pairs(hot=1)


@pytest.mark.parametrize("least", [0.05, 0.2, 0.6])
def test_cosine_pairs_are_those_of_brute_force(spark, least):
    rnd = random.Random(7)
    keys = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 6))) + f"|{rnd.choice(['applied optics', 'applied power', 'optics'])}|||" for _ in range(90)})
    nodes = spark.createDataFrame([(k,) for k in keys], "node string")
    has, df = {}, {}
    for r in spellings._features(nodes).collect():
        has.setdefault(r["node"], set()).add(r["feature"])
        df[r["feature"]] = df.get(r["feature"], 0) + 1
    w = {f: math.log(1 + len(keys) / n) for f, n in df.items()}
    norm = {k: math.sqrt(sum(w[f] ** 2 for f in x)) for k, x in has.items()}
    cosine = {(a, b): sum(w[f] ** 2 for f in has[a] & has[b]) / norm[a] / norm[b] for a in keys for b in keys if a < b}
    want = {k for k, x in cosine.items() if x >= least}
    for hot in (4, 3000):
        got = {(r["a"], r["b"]): r["cosine"] for r in spellings.cosine_pairs(nodes, least, hot).collect()}
        assert set(got) == want and all(abs(got[k] - cosine[k]) < 1e-9 for k in want)


def test_letters_never_refuse_what_likeness_accepts(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 10)))

    def slip(w):
        i = rnd.randrange(len(w))
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abcd") + w[i:], w[:i] + rnd.choice("abcd") + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])

    rows = [(f"{x}|applied optics|||", f"{slip(slip(x)) if rnd.random() < 0.8 else word()}|applied optics|||") for x in (word() for _ in range(1500))]
    allowed = spark.createDataFrame(rows, "a string, b string").filter(spellings.near_in_letters()).collect()
    ok = {tuple(r) for r in allowed}
    alike = {r for r in rows if names.likeness(spellings._name(r[0]), spellings._name(r[1])) in spellings.ALIKE}
    assert alike and alike <= ok


@pytest.mark.parametrize("n", [1, 2, 50])
def test_no_link_is_lost_to_the_nearest(spark, n):
    """Pairs beyond the n nearest of both ends are settled after the first linkage."""
    like = spark.createDataFrame([(f"x{i:02d}|power|||", f"x{j:02d}|power|||", 0.9 - 0.001 * (i + j), 0, "full") for j in range(12) for i in range(j)], "a string, b string, cosine double, slips int, how string")
    none = spark.createDataFrame([], "node string, kind string, value string")
    got = spellings.clusters(like, none, spark.createDataFrame([], "a string, b string, s bigint"), n).collect()
    assert len(got) == 12 and len({r["cluster"] for r in got}) == 1


def test_evidence_of_many_values(spark):
    """Nodes of three values each; the one in common is neither the first nor the last."""
    n = lambda c: f"{c}|marine power|||"
    webs = {"zutamontel": "amz", "zutabontol": "bmy", "vogomartel": "acz", "vogobartol": "bmy", "stekulonar": "amz", "stekulanar": "bmy", "plavidexor": "acz", "plavidixor": "bmy"}
    rows = [(f"{i:032d}", n(c), w) for i, (c, w) in enumerate((c, w) for c, x in webs.items() for w in x)]
    e = spark.createDataFrame(rows, "id string, node string, website_url string").selectExpr("*", "cast(null as string) AS duns_number", "cast(null as date) AS founded_date")
    own = e.selectExpr("concat_ws('-', substr(id, 1, 8), substr(id, 9, 4), substr(id, 13, 4), substr(id, 17, 4), substr(id, 21)) AS id", "node")
    names_ = list(webs)
    pairs = spark.createDataFrame([(n(names_[i]), n(names_[i + 1]), 0.5) for i in range(0, 8, 2)], "a string, b string, cosine double")
    got = {r["a"] for r in spellings._checked(spellings.alike(pairs), spellings._evidence(e.drop("node"), own)).collect()}
    assert got == {n("zutamontel"), n("stekulonar")}


def test_average_linkage_breaks_single_links(spark):
    one = spellings.UNIT
    links = [(f"{g}{i}", f"{g}{j}", one) for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", one * 6 // 10)]
    got = dict(map(tuple, spellings.average_linkage(spark.createDataFrame(links, "a string, b string, s bigint")).collect()))
    assert {len({v for k, v in got.items() if k[0] == g}) for g in "ab"} == {1} and got["a0"] != got["b0"]


# survivorship
def test_survivors_and_values(spark):
    rows = [
        entity(0, "A", cage="ab1c2", hq="Old Town, TX", source="sam_registry", day=1), entity(1, "A", cage="AB1C2", hq="pine harbor , ga", merged=0, source="usaspending", day=5), entity(2, "A", cage="BA1C2", hq="P. Harbor, GA", merged=1, source="sam_registry", day=9),
        entity(3, "A", cage="ZZ9Z9", hq="Old Town, TX", merged=2, source="web_enrichment", day=20), entity(4, "B", cage="00000", hq="United States"), entity(5, "B", cage="N/A", hq=None, merged=4), entity(6, "C", cage="QQ1QQ"), entity(7, "D", merged=8), entity(8, "D", merged=7), entity(9, "E", merged=59),
    ] + [entity(20 + i, "X", hq=x) for i, x in enumerate(["Pine Harbor, GA"] * 4 + ["Old Town, TX"] * 4)]
    e = spark.createDataFrame(rows, ENT)
    assert {tuple(r) for r in survivorship.survivors(e).collect()} >= {(U[i], U[0]) for i in range(4)} | {(U[5], U[4])}
    assert {tuple(r) for r in survivorship.present_values(e).collect()} == {(U[0], "cage_code", "AB1C2"), (U[0], "headquarters_location", "Pine Harbor, GA")}
    assert survivorship.present_values(e.limit(0)).count() == 0


@pytest.mark.parametrize(("steps", "alone"), [(4, True), (10, True), (4, False), (10, False), (600, False)])
def test_survivors_of_long_chains(spark, steps, alone):
    """One chain, alone or beside a ring and a chain into nothing."""
    u = lambda i: f"00000000-0000-0000-0000-{i:012d}"
    rows = [(u(i), u(i - 1) if i else None) for i in range(steps + 1)]
    rows += [] if alone else [(u(1000 + i), u(1000 + (i + 1) % 3)) for i in range(3)] + [(u(2000), u(1000))] + [(u(3000 + i), u(3001 + i)) for i in range(9)]
    got = [tuple(r) for r in survivorship.survivors(spark.createDataFrame(rows, "id string, merged_into_id string")).collect()]
    assert sorted(got) == [(u(i), u(0)) for i in range(steps + 1)]


# linkage
VEN = "record_id bigint, feed string, vendor_name string, street string, city string, state string, cage_text string, duns_text string, founded_year int, loaded_at timestamp, org string"


def test_linkage(spark):
    v = lambda i, n, city=None, st=None, cage=None, duns=None, year=None: (i, "f", n, None, city, st, cage, duns, year, None, "clash")
    e = _entities(spark).unionByName(spark.createDataFrame([entity(30, "Hudopal Applied Optics", cage="AB1C2", duns="123450987", hq="Pine Harbor, GA", founded=dt.date(2001, 1, 1)), entity(31, "Hudopal Applied Optics", merged=30)], ENT))
    rows = [
        v(1, "HUDOPAL APPLIED OPTICS LLC", "Pine Harbor", "Georgia", None, None, 2001), v(2, "Hudopal A O", None, None, "**1C2", None, None), v(3, "Hudopal Applied Optics", "Other City", "TX", "QQ9QQ", "999888777", 1980),
        v(4, None), v(5, ""), v(6, "Nobody Marine Power"), v(7, "Unreadable", None, None, "AB1C2", "123450987", 2001), (None, "f", "Hudopal Applied Optics", None, None, None, None, None, None, None, ""), v(1, "HUDOPAL APPLIED OPTICS LLC", "Pine Harbor", "Georgia", None, None, 2001),
    ]
    got = [tuple(r) for r in linkage.matches(e, spark.createDataFrame(rows, VEN)).filter("confidence >= 0.5").select("entity_id", "record_id").collect()]
    assert len(got) == len(set(got)) and {r for r in got if r[0] == U[30]} == {(U[30], 1), (U[30], 2), (U[30], 7)}
    assert not [r for r in got if r[0] == U[31]]
    assert linkage.matches(e, spark.createDataFrame([], VEN)).count() == 0


def test_admm_reaches_the_optimum(spark):
    """One record, two organisations: exclusivity leaves the better one; rows of one organisation go together."""
    w = lambda *x: dict(zip([f"w{i}" for i in range(6)], [float(y) for y in x], strict=True))
    rows = [{"r": 1, "e": "a", "org": "A", **w(2, 3, 0, 0, 0, -1)}, {"r": 1, "e": "b", "org": "A", **w(0.7, 0, 0, 0, 0, -1)}, {"r": 1, "e": "c", "org": "B", **w(1.5, 0, 0, 0, 0, -1)}, {"r": 2, "e": "c", "org": "B", **w(2, 0, 0, 0, 0, -1)}, {"r": 3, "e": "a", "org": "A", **w(0.4, -1.5, 0, 0, 0, -1)}]
    g = spark.createDataFrame(rows).select("r", "e", "org", *[f"w{i}" for i in range(6)])
    y = {(r["r"], r["e"]): r["confidence"] for r in linkage.solve(g).collect()}
    assert y[1, "a"] > 0.9 and y[1, "b"] > 0.9 and y[1, "c"] < 0.5 and y[2, "c"] > 0.9 and y[3, "a"] < 0.1


def test_rows_that_fare_alike_are_solved_once():
    """Many equal candidates as one row with their number give the values they have one by one."""
    w = np.array([[2.0, 0, 0, 0.2, 0, -1], [0.5, 1, 0, 0.2, 0, -1], [1.5, 0, 0, 1, 0, -1]])
    once, took = linkage.admm(w, np.array([5.0, 1, 2]), np.array([0, 0, 1]), np.array([0, 0]))
    each, _ = linkage.admm(w[[0] * 5 + [1, 2, 2]], np.ones(8), np.array([0] * 6 + [1, 1]), np.array([0, 0]))
    assert np.allclose(once[[0] * 5 + [1, 2, 2]], each, atol=5e-3) and took.max() < linkage.MOST_ROUNDS


def test_codes_of_many_owners_say_nothing(spark):
    rows = [(i, "AAAA1", f"org{i}") for i in range(linkage.ORGS_A_CODE + 1)] + [(100 + i, "BBBB2", "one") for i in range(60)]
    kept = linkage._shared_by_many(spark.createDataFrame(rows, "e long, e_cage string, org string"), "e_cage").filter("e_cage IS NOT NULL")
    assert {r["e_cage"] for r in kept.collect()} == {"BBBB2"} and kept.count() == 60


# tokens and containers
@pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="vocabulary is not here")
def test_ids_equal_the_public_encoder(spark):
    import tiktoken

    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    texts = [None, "", " ", "  a  b\n\n c \t\r\n", "<|endoftext|> it's we'll 'S", "a" * 30000, "😀é ß ﷽ ​\x1c\x1d x", "".join(rnd.choice("ab 1'\n\té—.") for _ in range(3000))]
    texts += ["".join(rnd.choice("the of re in g ab\n\t '.,é") for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(df).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["tokens"] for r in bpe.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode_documents(df.limit(0)).count() == 0


def _fewest(sizes, cap):
    """The least number of bins by exhaustive search."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for r in {b: k for k, b in enumerate(bins)}.values():
            if bins[r] >= sizes[i]:
                place(i + 1, [b - sizes[i] if k == r else b for k, b in enumerate(bins)])
        place(i + 1, [*bins, cap - sizes[i]])

    place(0, [])
    return best


def test_pack_is_optimal_on_small_input():
    rnd = random.Random(4)
    for _ in range(40):
        sizes = sorted((rnd.randint(2, 20) for _ in range(rnd.randint(1, 10))), reverse=True)
        bins = packing.pack(sizes, 21)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 21 for b in bins)
        assert len(bins) == _fewest(sizes, 21) >= packing.lower_bound(sizes, 21)


def test_containers(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.randint(0, 30) if i % 50 else 250, "x") for i in range(600)] + [(7, 11, "x"), (7, 11, "x"), (9999, None, "x")]
    out = packing.fill_containers(spark.createDataFrame(rows, "doc_id bigint, tokens bigint, block string"), cap=100, block_items=100).collect()
    by, per = {}, {}
    for r in out:
        by.setdefault(r["container_id"], []).append(r)
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["tokens"]
    assert all(sum(x["tokens"] for x in b) <= 100 and sum(x["tokens"] for x in b) == b[0]["filled"] for b in by.values())
    want = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + (t or 0)
    assert per == {i: t for i, t in want.items() if t}
    assert len(by) <= sum(want.values()) / 100 * 1.03 + 1
    assert packing.fill_containers(spark.createDataFrame([], "doc_id bigint, tokens bigint"), cap=100).count() == 0


# truncation
def test_cut_texts(spark):
    rnd = random.Random(8)
    words = "the panel found that every sensor array in the northern range kept its margin under heavy load while crews waited for spare parts and new orders".split()
    rows, cut_ids = [], set()
    for i in range(500):
        text = ""
        for _ in range(rnd.randint(6, 30)):
            s = " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 12)))
            text += s[0].upper() + s[1:] + rnd.choice(". . . ? !".split()) + " "
        text = text.strip()
        if len(text) > 600:
            text = text[:600].rstrip()
            if text[-1] not in ".?!":
                cut_ids.add(i)
        rows.append((i, text, "a", "clash"))
    rows += [(900, None, "a", ""), (901, "", "a", ""), (902, " \n", None, ""), (903, rows[min(cut_ids)][1], "b", ""), (904, "They waited for the sp�", "b", ""), (905, "They waited… Read more", "b", "")]
    cut_ids |= {903, 904, 905}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, key string")
    got = {r[0] for r in truncation.cut_documents(docs).collect()}
    assert got >= cut_ids and len(got - cut_ids) <= 3
    assert truncation.length_limits(truncation._marked(docs)).filter("source = 'a' AND unit = 'chars'").orderBy("p").first()["length"] == 600
    report = {r["source"]: r for r in truncation.cut_report(docs).collect()}
    assert report["b"]["cut_texts"] == 3 and report[None]["with_text"] == 0
    assert truncation.cut_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_search_wins_where_best_fit_misses(seed):
    """Sizes around a third and around a half of the capacity, and triplets that fill it exactly."""
    rnd = random.Random(seed)
    cases = [[rnd.randrange(640, 720) for _ in range(300)], [x for _ in range(100) for x in (lambda a, b: (a, b, 2048 - a - b))(rnd.randrange(520, 800), rnd.randrange(520, 700))], [rnd.choice([rnd.randrange(900, 1100), rnd.randrange(300, 700)]) for _ in range(400)]]
    for sizes in cases:
        sizes.sort(reverse=True)
        bins, plain = packing.pack(sizes, 2048), packing.best_fit(sizes, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)
        assert packing.lower_bound(sizes, 2048) <= len(bins) < len(plain)


def test_fillings_are_undominated_and_in_order():
    rnd = random.Random(1)
    for _ in range(30):
        count = {}
        for _ in range(6):
            s = rnd.randrange(1, 12)
            count[s] = count.get(s, 0) + 1
        f = packing.Fillings(count, 20, 10**6)
        got = [tuple(x) for x in f.around(15, dict(count), 15)]
        wastes = [15 - sum(x) for x in got]
        assert wastes == sorted(wastes) and len(set(got)) == len(got)
        for x in got:
            left = {s: n - x.count(s) for s, n in count.items()}
            assert min(left.values()) >= 0 and not any(left.get(s, 0) for h in (0, *x) for s in range(h + 1, h + 15 - sum(x) + 1))


@pytest.mark.parametrize("heavy", [False, True])
def test_components_of_hubs(spark, monkeypatch, heavy):
    """A star, and a dense core with a hub of leaves, by plain joins and with hubs joined by broadcast."""
    if heavy:
        monkeypatch.setattr(components_module, "ONE_TASK", 0)
        monkeypatch.setattr(components_module, "HEAVY", 20)
    rnd = random.Random(3)
    pairs = [("hub", f"l{i:03d}") for i in range(300)] + [(f"c{rnd.randrange(30):02d}", f"c{rnd.randrange(30):02d}") for _ in range(160)] + [("c00", f"m{i:03d}") for i in range(200)] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r["id"]: r["group_id"] for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: root(x) for x in up}
