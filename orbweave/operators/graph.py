"""The property graph as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.ids import squeeze
from orbweave.operators.detectors import agency_key
from orbweave.sources import views as V

PRIVATE = ("REG_D_FILING", "VC_ROUND", "PRIVATE_ROUND")


def _edges(df: DataFrame, kind: str, target: str, value: str, day: str) -> DataFrame:
    return df.groupBy("entity_id", F.col(target).alias("target")).agg(F.count("*").alias("weight"), F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("total"), F.min(day).alias("first_seen"), F.max(day).alias("last_seen")).select(F.col("entity_id").alias("source"), F.lit(kind).alias("kind"), "target", "weight", "total", "first_seen", "last_seen")


def funded_by_agency(spark: SparkSession, sf: str) -> DataFrame:
    f = V.funding(spark, sf).filter(F.col("event_type").isin(*V.SBIR) & F.col("entity_id").isNotNull())
    named = f.select("id", "entity_id", "amount", "event_date", F.explode(F.array_distinct(F.transform("investors_awarders", squeeze))).alias("target")).filter("target <> ''")
    return _edges(named, "FUNDED_BY_AGENCY", "target", "amount", "event_date")


def contracted_by_agency(spark: SparkSession, sf: str) -> DataFrame:
    c = V.contracts(spark, sf).filter(F.col("entity_id").isNotNull() & (F.trim("contracting_agency") != "")).withColumn("agency", agency_key(F.col("contracting_agency")))
    return _edges(c, "CONTRACTED_BY_AGENCY", "agency", "contract_value", "award_date")


def invested_in_by(spark: SparkSession, sf: str) -> DataFrame:
    f = V.funding(spark, sf).filter(F.col("event_type").isin(*PRIVATE) & F.col("entity_id").isNotNull())
    named = f.select("id", "entity_id", "amount", "event_date", F.explode(F.array_distinct(F.transform("investors_awarders", squeeze))).alias("target")).filter("target <> ''")
    return _edges(named, "INVESTED_IN_BY", "target", "amount", "event_date")


def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    return funded_by_agency(spark, sf).unionByName(contracted_by_agency(spark, sf)).unionByName(invested_in_by(spark, sf))


def reach(spark: SparkSession, sf: str, start: DataFrame, hops: int = 2) -> DataFrame:
    """(node, hop) of all nodes within some hops of the start nodes, either way along an edge; each at its nearest hop."""
    e = all_edges(spark, sf).select("source", "target").distinct()
    both = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))
    seen = front = start.select("node", F.lit(0).alias("hop"))
    for i in range(1, hops + 1):
        front = front.select(F.col("node").alias("source")).join(both, "source").select(F.col("target").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(i))
        seen = seen.unionByName(front)
    return seen


def paths(spark: SparkSession, sf: str, start: DataFrame, hops: int = 2) -> DataFrame:
    """(hop, node, path) of the nodes within some hops of the start: each at its nearest hop, by the first of its paths in text order."""
    e = all_edges(spark, sf).select("source", "target").distinct()
    both = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    front = start.select(F.lit(0).alias("hop"), "node", F.col("node").alias("path"))
    seen, out = front.select("node"), None
    for i in range(1, hops + 1):
        step = front.select(F.col("node").alias("source"), "path").join(both, "source").select(F.col("target").alias("node"), F.concat("path", F.lit(" > "), "target").alias("path"))
        front = step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti").select(F.lit(i).alias("hop"), "node", "path")
        seen, out = seen.unionByName(front.select("node")), front if out is None else out.unionByName(front)
    return out


def agency_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Per agency: contracts and awards with entities, totals and dates; agencies of one name are added up."""
    c = V.contracts(spark, sf).filter(F.trim("contracting_agency") != "").select(agency_key(F.col("contracting_agency")).alias("agency"), "entity_id", F.col("contract_value").alias("value"), F.col("award_date").alias("day"), F.lit(1).alias("c"), F.lit(0).alias("f"))
    f = V.funding(spark, sf).filter(F.col("event_type").isin(*V.SBIR)).select(F.explode(F.array_distinct(F.transform("investors_awarders", lambda x: agency_key(squeeze(x))))).alias("agency"), "entity_id", F.col("amount").alias("value"), F.col("event_date").alias("day"), F.lit(0).alias("c"), F.lit(1).alias("f")).filter("agency <> ''")
    return c.unionByName(f).groupBy("agency").agg(F.sum("c").alias("contracts"), F.sum("f").alias("awards"), F.count_distinct("entity_id").alias("entities"), F.coalesce(F.sum("value"), F.lit(0)).cast("double").alias("total"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def degree(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """The k nodes of highest degree centrality in the undirected simple graph."""
    e = all_edges(spark, sf).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).filter("a <> b").distinct()
    d = e.select(F.col("a").alias("node")).unionAll(e.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    n = d.agg((F.count("*") - 1).alias("rest"))  # one row
    return d.crossJoin(F.broadcast(n)).withColumn("centrality", F.round(F.col("degree") / F.col("rest"), 6)).select("node", "degree", "centrality").orderBy(F.desc("degree"), "node").limit(k)
