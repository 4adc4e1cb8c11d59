"""One surviving record per group of duplicates, field by field.

Every row is reduced to comparable values first (codes cleaned, places brought to one spelling). Then a single
aggregation takes for each field the maximum of a struct (usable, source priority, time, value): a usable value beats a
missing one, a registry feed beats a hand-typed one, and among equals the latest wins. Two such maxima are kept for codes,
by time and by support; if they differ by one slip of a finger, the supported one is right.

Groups: a row without merged_into_id and all rows that lead to it over any number of steps. Chains that end in a
missing row or in a ring have no surviving row and give none. Null ids are dropped; equal times are decided by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.ids import uuid_value
from orbweave.functions.registry import cage, corrected, duns, gazetteer, place
from orbweave.session import cut

#: Feeds in which an owner registers itself or a contract office checks the codes.
TRUSTED = ("sam_registry", "sbir_awards", "usaspending")


def survivors(entities: DataFrame) -> DataFrame:
    """(id, root) of every row whose chain of merges ends in an unmerged row, by pointer doubling."""
    e = entities.select(uuid_value(F.col("id")).alias("id"), uuid_value(F.col("merged_into_id")).alias("up"), F.col("merged_into_id").isNull().alias("top")).filter(F.col("id").isNotNull()).dropDuplicates(["id"])
    done = e.filter("top").select("id", F.col("id").alias("root"))
    open_ = cut(e.filter(~F.col("top") & F.col("up").isNotNull()).select("id", "up"))
    rows, before = open_.count(), -1
    # as long as a chain has an end some row finishes or drops out each round; if none does, only rings are left
    while rows and rows != before:
        # whoever points to a finished row is finished; the rest points twice as far
        ended = open_.join(done.select(F.col("id").alias("up"), "root"), "up").select("id", "root")
        further = open_.select(F.col("id").alias("up"), F.col("up").alias("next"))
        left = open_.join(done.select(F.col("id").alias("up")), "up", "left_anti").join(further, "up").select("id", F.col("next").alias("up"))
        done, open_ = cut(done.unionByName(ended)), cut(left)
        rows, before = open_.count(), rows
    return done


def cleaned(entities: DataFrame) -> DataFrame:
    """id, tier, at, and the usable values of each row: code, number, location and whether that place is known."""
    rows = entities.select(
        uuid_value(F.col("id")).alias("id"), F.when(F.col("record_source").isin(*TRUSTED), 1).otherwise(0).alias("tier"), F.coalesce("updated_at", "created_at").alias("at"),
        cage(F.col("cage_code")).alias("code"), duns(F.col("duns_number")).alias("number"), place(F.col("headquarters_location")).alias("p"), "website_url", "founded_date", "canonical_name", "entity_type",
    ).select("*", "p.city", "p.state").drop("p")
    known = cut(gazetteer(rows.select("city", "state")))
    fixed = corrected(rows.select("city", "state"), known)
    rows = rows.join(known.select("city", "state", F.lit(True).alias("known")), ["city", "state"], "left").join(fixed, ["city", "state"], "left")
    city = F.coalesce("fixed", "city")
    return rows.withColumn("location", F.when(city.isNotNull() & ~city.rlike(r"^\w\.? "), F.concat_ws(", ", city, "state"))).withColumn("known", F.coalesce("known", F.lit(False)) | F.col("fixed").isNotNull())


def _slip(a: str, b: str) -> F.Column:
    """Two codes one slip apart: one character, or two that changed places."""
    letters = lambda c: F.array_join(F.array_sort(F.split(F.col(c), "")), "")
    return (F.levenshtein(F.col(a), F.col(b)) <= 1) | ((F.levenshtein(F.col(a), F.col(b)) == 2) & (letters(a) == letters(b)))


def golden(entities: DataFrame) -> DataFrame:
    """One row per group of two or more rows: entity_id, members and the surviving value of each field."""
    rows = cut(cleaned(entities).join(survivors(entities), "id"))
    best = lambda value, *first: F.max(F.when(F.col(value).isNotNull(), F.struct(*first, F.col("tier"), F.col("at"), F.col(value).alias("v"))))["v"]
    support = rows.filter(F.col("code").isNotNull()).groupBy("root", "code").agg(F.sum(F.col("tier") * 2 + 1).alias("support"), F.max("at").alias("at"))
    most = support.groupBy("root").agg(F.max(F.struct("support", "at", F.col("code").alias("v")))["v"].alias("most"))
    g = rows.groupBy("root").agg(
        F.count("*").alias("members"), best("code").alias("code"), best("number").alias("duns_number"), best("location", F.col("known")).alias("headquarters_location"),
        best("website_url").alias("website_url"), best("founded_date").alias("founded_date"), best("canonical_name").alias("canonical_name"), best("entity_type").alias("entity_type"),
    ).filter(F.col("members") > 1)
    code = F.when(F.col("most").isNotNull() & (F.col("most") != F.col("code")) & _slip("code", "most"), F.col("most")).otherwise(F.col("code"))
    return g.join(most, "root", "left").select(F.col("root").alias("entity_id"), "members", code.alias("cage_code"), "duns_number", "headquarters_location", "website_url", "founded_date", "canonical_name", "entity_type")


def present_values(entities: DataFrame) -> DataFrame:
    """(entity_id, field, value) for the two fields that an owner has today."""
    g = golden(entities)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("cage_code", "headquarters_location")])
    return g.select("entity_id", F.explode(fields).alias("x")).select("entity_id", "x.field", "x.value").filter(F.col("value").isNotNull())
