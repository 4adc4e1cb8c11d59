"""Entity resolution over given pairs: normal forms of names, fuzzy blend, decision tree, merges applied."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.registry import STATES

# Corporate endings in the order in which each normal form takes them off, once a pass.
RESOLVER_SUFFIXES = (
    r"\s+incorporated$", r"\s+corporation$", r"\s+limited$", r"\s+company$", r"\s+inc\.?$", r"\s+corp\.?$", r"\s+llc\.?$", r"\s+l\.l\.c\.?$", r"\s+ltd\.?$", r"\s+llp\.?$", r"\s+l\.l\.p\.?$",
    r"\s+lp\.?$", r"\s+l\.p\.?$", r"\s+co\.?$", r"\s+pc\.?$", r"\s+p\.c\.?$", r"\s+pllc\.?$", r",\s*inc\.?$", r",\s*llc\.?$", r",\s*corp\.?$", r",\s*$",
)
MATCHER_SUFFIXES = (r"\binc\.?$", r"\bincorporated$", r"\bcorp\.?$", r"\bcorporation$", r"\bllc$", r"\bl\.l\.c\.?$", r"\bltd\.?$", r"\blimited$", r"\bllp$", r"\bl\.l\.p\.?$", r"\blp$", r"\bl\.p\.?$", r"\bco\.?$", r"\bcompany$", r"\bpc$", r"\bp\.c\.?$", r",\s*$")
CHECK_SUFFIXES = (
    r"\s+incorporated$", r"\s+inc\.?$", r"\s+llc\.?$", r"\s+l\.l\.c\.?$", r"\s+ltd\.?$", r"\s+limited$", r"\s+corp\.?$", r"\s+corporation$", r"\s+co\.?$", r"\s+company$", r"\s+lp\.?$", r"\s+l\.p\.?$", r"\s+plc\.?$",
    r"\s+pllc\.?$", r"\s+pc\.?$", r"\s+p\.c\.?$", r",?\s*llc\.?$", r",?\s*inc\.?$",
)
# Words that say nothing by themselves.
GENERIC = (
    "aerospace", "technologies", "technology", "systems", "solutions", "services", "defense", "dynamics", "industries", "engineering", "international", "corporation", "advanced", "global", "group", "associates",
    "consulting", "research", "analytics", "scientific", "innovations", "enterprises", "partners", "holdings", "management",
)


def _stripped(c: Column, suffixes: tuple[str, ...]) -> Column:
    for s in suffixes:
        c = F.regexp_replace(c, f"(?i){s}", "")
    return c


def _spaced(c: Column, odd: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, odd, " "), r"\s+", " "))


def resolver_name(c: Column) -> Column:
    """Lower case without corporate endings (three passes), punctuation and a leading "the"."""
    t = F.trim(c)
    for _ in range(3):
        t = F.trim(_stripped(t, RESOLVER_SUFFIXES))
    return F.regexp_replace(F.lower(_spaced(t, r"[^\w\s]")), "^the ", "")


def matcher_name(c: Column) -> Column:
    """Upper case without corporate endings (one pass) and punctuation."""
    return F.upper(_spaced(_stripped(F.trim(c), MATCHER_SUFFIXES), r"[^\w\s]"))


def check_name(c: Column) -> Column:
    """Lower case without corporate endings (one pass) and the commoner punctuation."""
    return _spaced(_spaced(_stripped(F.lower(F.trim(c)), CHECK_SUFFIXES), r"\s+"), r"[,.\-'\"&]")


def only_generic(normal: Column) -> Column:
    """A normal form of nothing but generic words, or of none."""
    words = F.filter(F.split(normal, " "), lambda w: w != "")
    return F.size(F.array_except(words, F.array(*[F.lit(w) for w in GENERIC]))) == 0


def state_in(place: Column) -> Column:
    """The first token of a place that is a state's code."""
    return F.get(F.filter(F.split(F.replace(F.upper(place), F.lit(","), F.lit(" ")), r"\s+"), lambda t: t.isin(list(STATES))), F.lit(0))


def share_a_token(a: Column, b: Column) -> Column:
    tokens = lambda c: F.filter(F.split(F.lower(c), r"[\s,]+"), lambda t: t != "")
    return F.arrays_overlap(tokens(a), tokens(b))


def _ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    if not a or not b:
        return 100.0 * (a == b)
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def fuzzy(a: str, b: str) -> float:
    """.2 plain, .4 over sorted words, .4 over the words in common against each side's words (0 to 100)."""
    x, y = sorted(set(a.split())), sorted(set(b.split()))
    both, only = sorted({*x} & {*y}), (sorted({*x} - {*y}), sorted({*y} - {*x}))
    s0 = " ".join(both)
    s1, s2 = (" ".join([*both, *o]) for o in only)
    as_set = 100.0 if both and not (only[0] and only[1]) else max(_ratio(s0, s1) if s0 else 0.0, _ratio(s0, s2) if s0 else 0.0, _ratio(s1, s2))
    return 0.2 * _ratio(a, b) + 0.4 * _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) + 0.4 * as_set


def similarity(a: Column, b: Column) -> Column:
    """The fuzzy blend of two normal forms, in Arrow batches; 0 if one is null or empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([fuzzy(p, q) if p and q else 0.0 for p, q in zip(x, y, strict=True)])

    return run(a, b)


def context_boost(place_a: Column, place_b: Column, tags_a: Column, tags_b: Column) -> Column:
    """What context adds to a confidence: .05 for places that share a token, .03 for each tag in common up to .1; nulls add nothing."""
    low = lambda t: F.transform(F.array_compact(t), F.lower)
    common = F.coalesce(F.size(F.array_intersect(low(tags_a), low(tags_b))), F.lit(0))
    return F.when(share_a_token(place_a, place_b), 0.05).otherwise(0.0) + F.least(F.greatest(common, F.lit(0)) * 0.03, F.lit(0.1))


def resolved(f: DataFrame) -> DataFrame:
    """(a, b, how, confidence, mismatch, action) of candidate pairs with name, cage, duns, place and tags of both sides.

    An equal code decides with confidence 1 (mismatch: the names score below 50); else the fuzzy blend of the names and what context adds,
    1 at most, from .7 on. .9 updates the entity, .7 uses it as it is, anything less creates one. Codes that are null or empty match nothing;
    a pair without a name on one side scores 0.
    """
    equal = lambda c: F.coalesce((F.col(f"{c}_a") == F.col(f"{c}_b")) & (F.col(f"{c}_a") != ""), F.lit(False))
    d = f.withColumn("_score", similarity(F.col("name_a"), F.col("name_b"))).withColumn("_code", equal("cage") | equal("duns"))
    named = F.least(F.col("_score") / 100 + context_boost(F.col("place_a"), F.col("place_b"), F.col("tags_a"), F.col("tags_b")), F.lit(1.0))
    d = d.withColumn("_sure", F.round(F.when(F.col("_code"), 1.0).otherwise(named), 4))
    how = F.when(F.col("_code"), "code").when(F.col("_sure") >= 0.7, "name").otherwise("none")
    action = F.when(F.col("_sure") >= 0.9, "update").when(F.col("_sure") >= 0.7, "use").otherwise("create")
    return d.select("a", "b", how.alias("how"), F.when(F.col("_sure") >= 0.7, F.col("_sure")).otherwise(0.0).alias("confidence"), (F.col("_code") & (F.col("_score") < 50)).alias("mismatch"), action.alias("action"))


def pair_features(pairs: DataFrame, entities: DataFrame, contracts: DataFrame) -> DataFrame:
    """pairs (a, b, score) with what the decision tree asks: shared codes, identical names, states, shared industry codes."""
    e = entities.select("id", resolver_name(F.col("canonical_name")).alias("name"), F.col("cage_code").alias("cage"), F.col("duns_number").alias("duns"), state_in(F.col("headquarters_location")).alias("state"))
    side = lambda x: e.select(*[F.col(c).alias(x if c == "id" else f"{c}_{x}") for c in e.columns])
    codes = contracts.filter("naics_code IS NOT NULL AND entity_id IS NOT NULL").select("entity_id", "naics_code").distinct()
    one, two = codes.select(F.col("entity_id").alias("a"), "naics_code"), codes.select(F.col("entity_id").alias("b"), "naics_code")
    shared = pairs.select("a", "b").join(one, "a").join(two, ["b", "naics_code"]).select("a", "b", F.lit(True).alias("naics")).distinct()
    return pairs.join(side("a"), "a").join(side("b"), "b").join(shared, ["a", "b"], "left").withColumn("naics", F.coalesce("naics", F.lit(False)))


def decided(f: DataFrame) -> DataFrame:
    """(a, b, decision, confidence, rule) of pairs with features; score runs to 100."""
    no = F.lit(False)
    code = F.coalesce(F.col("cage_a") == F.col("cage_b"), no) | F.coalesce(F.col("duns_a") == F.col("duns_b"), no)
    same = F.coalesce((F.col("name_a") == F.col("name_b")) & F.contains("name_a", F.lit(" ")), no)
    state, other = F.coalesce(F.col("state_a") == F.col("state_b"), no), F.coalesce(F.col("state_a") != F.col("state_b"), no)
    s = F.col("score")
    rule = F.when(code, "identifier").when(same, "identical").when((s >= 90) & state, "state").when((s >= 90) & F.col("naics"), "industry").when((s >= 95) & ~other, "very alike").when(s >= 70, "review").otherwise("apart")
    confidence = F.element_at(F.create_map(*[F.lit(x) for x in ("identifier", 1.0, "identical", 0.98, "state", 0.95, "industry", 0.9, "very alike", 0.95)]), F.col("rule"))
    return f.withColumn("rule", rule).select("a", "b", F.when(F.col("rule").isin("review", "apart"), F.col("rule")).otherwise("merge").alias("decision"), confidence.alias("confidence"), "rule")


def merged(entities: DataFrame) -> DataFrame:
    """(id, variants, tags, sources) of rows that others were merged into: the union of names and tags, the row's own name left out."""
    near = entities.select(F.coalesce("merged_into_id", "id").alias("target"), (F.col("merged_into_id").isNotNull()).alias("source"), "canonical_name", "name_variants", "technology_tags")
    # pre-aggregated by distinct name, so a target of very many sources gathers its distinct spellings only
    names = near.select("target", F.explode(F.array_append(F.coalesce(F.array_compact("name_variants"), F.array().cast("array<string>")), F.col("canonical_name"))).alias("name")).distinct()
    own = entities.select(F.col("id").alias("target"), F.col("canonical_name").alias("own"))
    variants = names.join(own, "target").filter("name IS NOT NULL AND NOT (name <=> own)").groupBy("target").agg(F.count("*").alias("variants"))
    tags = near.select("target", F.explode("technology_tags").alias("tag")).filter("tag IS NOT NULL").distinct().groupBy("target").agg(F.count("*").alias("tags"))
    sources = near.filter("source").groupBy("target").agg(F.count("*").alias("sources"))
    return sources.join(own.select("target"), "target").join(variants, "target", "left").join(tags, "target", "left").na.fill(0).withColumnRenamed("target", "id")


def latest_decisions(matches: DataFrame) -> DataFrame:
    """(a, b, decision) of each unordered pair: the last one written that is not blank, the larger match id among equals."""
    d = matches.select(F.least("entity_a", "entity_b").alias("a"), F.greatest("entity_a", "entity_b").alias("b"), F.lower(F.regexp_replace("decision", r"^\s+|\s+$", "")).alias("decision"), "queued_at", "match_id")
    d = d.filter("decision <> '' AND a <> b")
    w = Window.partitionBy("a", "b").orderBy(F.desc_nulls_last("queued_at"), F.desc("match_id"))
    return d.withColumn("r", F.row_number().over(w)).filter("r = 1").select("a", "b", "decision")
