"""Similarity over embeddings: blocks of query vectors against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.sources.tables import table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.withColumn("n", norm(F.col("v"))).withColumn("v", F.transform("v", lambda x: x / F.col("n"))).drop("n")


BLOCK = 512  # query vectors that meet a part of the rows at once


def _best_by_label(part: tuple, rows: pd.DataFrame, asked: pd.DataFrame, floor: float) -> pd.DataFrame:
    none = pd.DataFrame({"query_id": [], "label": [], "sim": [], "hits": []}).astype({"query_id": "int64", "label": "int64", "hits": "int64"})
    if rows.empty or asked.empty:
        return none
    sims = np.round(np.stack(asked["q"].to_numpy()) @ np.stack(rows["v"].to_numpy()).T, 6)
    sims[asked["skip_id"].to_numpy()[:, None] == rows["vec_id"].to_numpy()[None, :]] = -2.0
    sims[asked["skip_label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]] = -2.0
    i, j = np.nonzero(sims >= floor)
    if not len(i):
        return none
    hit = pd.DataFrame({"query_id": asked["query_id"].to_numpy()[i], "label": rows["label"].to_numpy()[j], "sim": sims[i, j]})
    return hit.groupby(["query_id", "label"], as_index=False).agg(sim=("sim", "max"), hits=("sim", "size"))


def search(rows: DataFrame, asked: DataFrame, floor: float) -> DataFrame:
    """(query_id, label, sim, hits): for each query vector (query_id, q, skip_id, skip_label) the best cosine to each label of at least `floor`.

    Blocks of queries meet parts of the rows (vec_id, label, v), all unit vectors; a task multiplies one block with one part.
    """
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-asked.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    q = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    run = lambda k, a, b: _best_by_label(k, a, b, floor)
    met = r.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInPandas(run, "query_id long, label long, sim double, hits long")
    return met.groupBy("query_id", "label").agg(F.max("sim").alias("sim"), F.sum("hits").alias("hits"))


def retrieve(spark: SparkSession, sf: str, floor: float = 0.25) -> DataFrame:
    """For every vector whose id is divisible by fifty: the best cosine to each label, with the number of hits, itself left out."""
    u = unit_vectors(spark, sf).withColumn("label", F.col("label").cast("long"))
    asked = u.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.col("v").alias("q"), F.col("vec_id").alias("skip_id"), F.lit(-1).cast("long").alias("skip_label"))
    return search(u, asked, floor)


def top_labels(spark: SparkSession, sf: str, n: int = 3) -> DataFrame:
    """The n best labels of each query vector."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "label"))
    return retrieve(spark, sf).withColumn("place", place).filter(F.col("place") <= n).select("query_id", "label", "sim", "place")


def similar_to_group(spark: SparkSession, sf: str) -> DataFrame:
    """For the mean vector of every label the nearest vector of each other label."""
    u = unit_vectors(spark, sf).withColumn("label", F.col("label").cast("long"))
    mean = u.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m"))
    mean = mean.select("label", F.transform("m", lambda s: s["x"]).alias("v")).withColumn("n", norm(F.col("v")))
    asked = mean.select(F.col("label").alias("query_id"), F.transform("v", lambda x: x / F.col("n")).alias("q"), F.lit(-1).cast("long").alias("skip_id"), F.col("label").alias("skip_label"))
    return search(u, asked, -1.0).select("query_id", "label", "sim")


def clusters(spark: SparkSession, sf: str, k: int = 20, seed: int = 42) -> DataFrame:
    """k-means over unit vectors: size and mean cosine to the centre of each cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    u = unit_vectors(spark, sf).select("vec_id", "label", "v", array_to_vector("v").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(u)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, c array<double>")
    p = model.transform(u).select("prediction", vector_to_array("features").alias("v")).join(F.broadcast(centres), "prediction")  # k rows
    return p.groupBy("prediction").agg(F.count("*").alias("size"), F.round(F.avg(dot(F.col("v"), F.col("c")) / norm(F.col("c"))), 6).alias("cohesion"))
