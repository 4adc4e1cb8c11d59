"""Landed feeds: bulk award CSV, zipped quarters as TSV, nested JSON pages, decision lists."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def award_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A bulk CSV with header; quoted values may span lines, rows of another width are dropped."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED", enforceSchema=True)


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per accession of a quarter: issuer and offering beside it, related persons as an array; the last offering wins."""
    tsv = lambda n: spark.read.csv(f"{folder}/{n}.tsv", header=True, sep="\t")
    offering = tsv("OFFERING").withColumn("_n", F.monotonically_increasing_id())
    last = offering.groupBy("ACCESSIONNUMBER").agg(F.max(F.struct("_n", *[c for c in offering.columns if c not in ("_n", "ACCESSIONNUMBER")])).alias("o")).select("ACCESSIONNUMBER", "o.*").drop("_n")
    persons = tsv("RELATEDPERSONS")
    people = persons.groupBy("ACCESSIONNUMBER").agg(F.array_sort(F.collect_list(F.struct(*[c for c in persons.columns if c != "ACCESSIONNUMBER"]))).alias("related_persons"))
    return last.join(tsv("ISSUERS"), "ACCESSIONNUMBER", "left").join(tsv("FORMDSUBMISSION"), "ACCESSIONNUMBER", "left").join(people, "ACCESSIONNUMBER", "left")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON pages as landed by a scraper, one record per row."""
    return spark.read.json(path, multiLine=True)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed merge queue with its decision column."""
    return spark.read.csv(path, header=True).filter(F.trim("decision") != "")


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """One name per line; blank lines and lines that begin with # are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter((F.col("name") != "") & ~F.col("name").startswith("#"))


def fiscal_year(day: Column) -> Column:
    return F.year(day) + (F.month(day) >= 10).cast("int")


def fiscal_years(spark: SparkSession, first: int, last: int, today: datetime.date) -> DataFrame:
    """(fiscal_year, start, end) from October to September, cut at today."""
    y = spark.range(first, last + 1).select(F.col("id").cast("int").alias("fiscal_year"))
    return y.select("fiscal_year", F.make_date(F.col("fiscal_year") - 1, F.lit(10), F.lit(1)).alias("start"), F.least(F.make_date("fiscal_year", F.lit(9), F.lit(30)), F.lit(today)).alias("end")).filter("start <= end")


def quarters(spark: SparkSession, start: datetime.date, end: datetime.date) -> DataFrame:
    """(label, start, end) of every quarter that overlaps the given days."""
    first = F.date_trunc("quarter", F.lit(start)).cast("date")
    q = spark.range(1).select(F.explode(F.sequence(first, F.lit(end), F.expr("interval 3 months"))).alias("start"))
    return q.select(F.concat(F.year("start"), F.lit("Q"), F.quarter("start")).alias("label"), "start", F.date_sub(F.add_months("start", 3), 1).alias("end"))
