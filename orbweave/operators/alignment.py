"""Alignment of entities with operational problems, by indicators found in their tags and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import text as T

# Operational problems by rank, each with its indicators.
PROBLEMS = (
    ("kop_001", 1, ("counter-UAS", "directed energy", "integrated air defense", "swarm defeat", "threat discrimination")),
    ("kop_002", 2, ("mesh networking", "anti-jam", "GPS-denied", "resilient comms", "autonomous navigation", "alternative PNT")),
    ("kop_003", 3, ("undersea warfare", "anti-ship", "autonomous naval", "mine warfare", "distributed maritime")),
    ("kop_004", 4, ("target recognition", "battle management", "kill chain", "fire coordination", "AI targeting")),
    ("kop_005", 5, ("autonomous resupply", "additive manufacturing", "forward logistics", "energy harvesting")),
    ("kop_006", 6, ("satellite protection", "space situational awareness", "rapid reconstitution", "counter-space")),
    ("kop_007", 7, ("microelectronics", "munitions production", "supply chain visibility", "trusted foundry", "domestic manufacturing")),
)


def forms(problems: tuple = PROBLEMS) -> list[tuple[str, int, int, str, str]]:
    """(problem, rank, number of indicators, indicator, form): each indicator in lower case and its synonyms."""
    return [(k, rank, len(all_), i, f) for k, rank, all_ in problems for i in all_ for f in (i.lower(), *T.SYNONYMS.get(i.lower(), ()))]


def words(form: str) -> set[str]:
    """The words of a form, parted at blanks and hyphens, without single letters."""
    return {w for w in form.replace("-", " ").split() if len(w) > 1}


def profile_terms(tags: DataFrame, titles: DataFrame) -> DataFrame:
    """(entity_id, term), each once: the terms of tags (entity_id, tag) and titles (entity_id, title) and their synonyms."""
    own = tags.select("entity_id", F.explode(T.tag_terms(F.col("tag"))).alias("term")).unionByName(titles.select("entity_id", F.explode(T.title_terms(F.col("title"))).alias("term"))).distinct()
    return own.select("entity_id", F.explode(T.with_synonyms(F.array("term"))).alias("term")).filter("term <> ''").distinct()


def alignments(terms: DataFrame, problems: tuple = PROBLEMS) -> DataFrame:
    """(entity_id, problem, rank, matches, score) of each entity's best problem, the first by rank among equals.

    An indicator is met if one of its forms lies within a term, or if all words of a form are terms of the entity. The score is
    the share of indicators met, less .05 a rank. Forms across the border of two terms do not count, as the order of terms is none.
    An entity's terms are never gathered: forms and words are joined to them as small tables.
    """
    spark, f = terms.sparkSession, forms(problems)
    within = F.filter(F.array(*[F.lit(x) for x in sorted({x[4] for x in f})]), lambda x: F.contains(F.col("term"), x))
    whole = terms.select("entity_id", F.explode(within).alias("form"))
    parts = spark.createDataFrame(sorted({(x[4], w, len(words(x[4]))) for x in f for w in words(x[4])}), "form string, term string, n int")
    apart = terms.join(F.broadcast(parts), "term").groupBy("entity_id", "form", "n").agg(F.count("*").alias("have")).filter("have = n").select("entity_id", "form")  # some two hundred words
    listed = spark.createDataFrame(f, "problem string, rank int, total int, indicator string, form string")
    met = whole.unionByName(apart).join(F.broadcast(listed), "form").select("entity_id", "problem", "rank", "total", "indicator").distinct()
    per = met.groupBy("entity_id", "problem", "rank", "total").agg(F.array_sort(F.collect_list("indicator")).alias("matches"))
    score = F.size("matches") / F.col("total") * (1 - (F.col("rank") - 1) * 0.05)
    best = per.withColumn("score", score).groupBy("entity_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "problem", "rank", "matches")).alias("x"))
    return best.select("entity_id", "x.problem", "x.rank", "x.matches", "x.score")
