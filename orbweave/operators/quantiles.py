"""Exact order statistics of groups, without a sort of a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_statistics(df: DataFrame, by: str, value: str, **places: Column) -> DataFrame:
    """One row per group: n, and the value at each named place (from 1, a Column over n; null beyond the group).

    Values (doubles, nulls left out) are counted in narrow ranges first. The running counts tell which range holds a place,
    and only the rows of that range are ranked, so a group of any size is spread over its ranges.
    """
    x = F.col(value).cast("double")
    rows = df.filter(x.isNotNull()).select(F.col(by).alias("g"), x.alias("v")).withColumn("cell", F.signum("v") * F.floor(F.log1p(F.abs("v")) * 64))
    cells = rows.groupBy("g", "cell").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g").orderBy("cell")  # a few thousand cells at most
    cells = cells.select("g", "cell", (F.sum("c").over(w) - F.col("c")).alias("below"), F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy("g")).alias("n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), p.cast("long").alias("place")) for k, p in places.items()])
    asked = cells.select("g", "cell", "below", "upto", "n", F.explode(wanted).alias("x")).filter((F.col("x.place") > F.col("below")) & (F.col("x.place") <= F.col("upto")))
    asked = asked.select("g", "cell", "x.name", (F.col("x.place") - F.col("below")).alias("r"))
    held = rows.join(asked.select("g", "cell").distinct(), ["g", "cell"], "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("g", "cell").orderBy("v")))
    found = asked.join(held, ["g", "cell", "r"]).groupBy("g").agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in places])
    return cells.groupBy("g").agg(F.max("n").alias("n")).join(found, "g", "left").withColumnRenamed("g", by)


def quartiles_exclusive(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, q1, q2, q3 by the exclusive method: place (n + 1) p, interpolated between its neighbours; null for groups below four."""
    n = F.col("n")
    place = {p: (n + 1) * p / 4 for p in (1, 2, 3)}
    sides = {f"{s}{p}": F.greatest(F.lit(1), F.least(n, F.floor(x) + int(s == "b"))) for p, x in place.items() for s in "ab"}
    o = order_statistics(df, by, value, **sides)
    q = [F.when(n >= 4, F.col(f"a{p}") + (x - F.floor(x)) * (F.col(f"b{p}") - F.col(f"a{p}"))).alias(f"q{p}") for p, x in place.items()]
    return o.select(by, "n", *q)
