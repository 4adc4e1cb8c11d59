"""Alignment of entities with budget areas: scores by a keyword rule, tailwinds, top areas, bands, edges, headwinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of each budget area, and its growth in per cent.
AREAS = {
    "space_resilience": (0.235, 38.0), "nuclear_modernization": (0.170, 17.0), "autonomous_systems": (0.130, 10.0), "supply_chain_resilience": (0.110, 7.0), "contested_logistics": (0.100, 10.0),
    "electronic_warfare": (0.085, 10.0), "jadc2": (0.075, 10.0), "border_homeland": (0.050, 10.0), "cyber_offense_defense": (0.030, 10.0), "hypersonics": (0.015, -43.0),
}
#: The area that a technology tag speaks for, in place of the scores of a language model.
TAG_AREA = {
    "space": "space_resilience", "gps_denied": "space_resilience", "autonomy": "autonomous_systems", "swarm": "autonomous_systems", "edge_ai": "autonomous_systems", "sonar": "autonomous_systems",
    "additive_mfg": "supply_chain_resilience", "composites": "supply_chain_resilience", "photonics": "supply_chain_resilience", "batteries": "contested_logistics", "ew": "electronic_warfare", "rf": "electronic_warfare",
    "radar": "electronic_warfare", "comms": "jadc2", "lidar": "border_homeland", "biotech": "border_homeland", "cyber": "cyber_offense_defense", "quantum": "cyber_offense_defense", "hypersonics": "hypersonics", "thermal": "hypersonics",
}


def _literal(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def scores(entities: DataFrame) -> DataFrame:
    """(entity_id, area, score): .4 for each tag of the area and .2 if the first tag is one, at most 1; entities without such tags have no row."""
    tags = entities.select(F.col("id").alias("entity_id"), F.posexplode(F.array_distinct("technology_tags")).alias("place", "tag"))
    named = tags.withColumn("area", _literal(TAG_AREA)[F.col("tag")]).filter(F.col("area").isNotNull())
    return named.groupBy("entity_id", "area").agg(F.round(F.least(F.lit(1.0), 0.4 * F.count("*") + 0.2 * F.max((F.col("place") == 0).cast("int"))), 2).alias("score"))


def score_maps(s: DataFrame) -> DataFrame:
    """(entity_id, scores): one map of area to score for each entity; there are ten areas."""
    return s.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("area", "score")))).alias("scores"))


def tailwinds(s: DataFrame) -> DataFrame:
    """(entity_id, by_weight, by_growth): mean score over areas above .2, weighted by budget weight, or by one plus growth."""
    # whole numbers, so that sums do not depend on their order: weights in thousandths, scores and growth in hundredths
    w, g = _literal({k: round(v[0] * 1000) for k, v in AREAS.items()})[F.col("area")], _literal({k: round(100 + v[1]) for k, v in AREAS.items()})[F.col("area")]
    mean = lambda x: F.floor(F.sum(F.round(F.col("score") * 100).cast("long") * x) / F.sum(x) * 10 + 0.5) / 1000
    return s.filter("score > 0.2").groupBy("entity_id").agg(mean(w).alias("by_weight"), mean(g).alias("by_growth"))


def top_areas(s: DataFrame, least: float = 0.1) -> DataFrame:
    """(entity_id, area, score) of the highest score, the first area by name among equals."""
    best = s.groupBy("entity_id").agg(F.min_by(F.struct("area", "score"), F.struct(-F.col("score"), "area")).alias("x"))
    return best.select("entity_id", "x.area", "x.score").filter(F.col("score") >= least)


def top_of_map(m: Column) -> Column:
    """The key of the largest value of a map, the smallest key among equals."""
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))[0]["k"]


def bands(s: DataFrame) -> DataFrame:
    """Per area the entities of high (.7), medium (.4) and low score."""
    return s.groupBy("area").agg(F.count_if(F.col("score") >= 0.7).alias("high"), F.count_if((F.col("score") >= 0.4) & (F.col("score") < 0.7)).alias("medium"), F.count_if(F.col("score") < 0.4).alias("low"))


def aligned_edges(maps: DataFrame, least: float = 0.3) -> DataFrame:
    """ALIGNED_TO_POLICY edges: the areas of a score map at or above a threshold."""
    kept = maps.select("entity_id", F.explode(F.map_filter("scores", lambda k, v: v >= least)).alias("target", "weight"))
    return kept.select(F.col("entity_id").alias("source"), F.lit("ALIGNED_TO_POLICY").alias("kind"), "target", "weight")


def headwinds(s: DataFrame, least: float = 0.5) -> DataFrame:
    """(entity_id, area, score, confidence) of entities whose top area is one of shrinking budget."""
    shrinking = {k: v[0] for k, v in AREAS.items() if v[1] <= 0}
    t = top_areas(s).withColumn("weight", _literal(shrinking)[F.col("area")]).filter(F.col("weight").isNotNull() & (F.col("score") >= least))
    return t.select("entity_id", "area", "score", F.least(F.lit(0.9), F.round(0.5 + (1 - F.col("weight")) * 0.2 + (F.col("score") - least) * 0.4, 2)).alias("confidence"))


def cohorts(s: DataFrame, population: DataFrame, areas: tuple[str, ...], least: float) -> DataFrame:
    """(entity_id, cohort): treatment if any of the areas reaches the score, control if all are null or below."""
    hit = s.filter(F.col("area").isin(*areas) & (F.col("score") >= least)).select("entity_id", F.lit(True).alias("hit")).distinct()
    return population.select("entity_id").join(hit, "entity_id", "left").select("entity_id", F.when(F.col("hit"), "treatment").otherwise("control").alias("cohort"))
