"""Registry codes and places as people type them: cleaned, or null where nothing usable is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.session import cut

# The two-letter codes of the states and their names.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida",
    "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}


def _filler(c: Column) -> Column:
    """Text filled in for form's sake: one character repeated, or a run of digits."""
    return c.rlike(r"^(.)\1*$") | c.isin("12345", "ABCDE", "123456789", "987654321")


def cage(c: Column) -> Column:
    """Five letters and digits in upper case; null for anything shorter, masked or filled in for form's sake."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"^CAGE\W*", ""), r"[\s\-]", "")
    return F.when(t.rlike("^[A-Z0-9]{5}$") & ~_filler(t), t)


def cage_pattern(c: Column) -> Column:
    """A code that is partly masked or cut, as five characters with '?' for the unknown; null if fewer than three are known."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"^CAGE\W*", ""), r"[\s\-]", "")
    t = F.translate(t, "*#_", "???")
    t = F.when(F.length(t) == 4, F.concat(t, F.lit("?"))).otherwise(t)
    return F.when(t.rlike(r"^[A-Z0-9?]{5}$") & (F.length(F.regexp_replace(t, r"\?", "")) >= 3) & ~_filler(F.regexp_replace(t, r"\?", "")), t)


def duns(c: Column) -> Column:
    """Nine digits; thirteen that end in 0000 are cut to nine; null for the rest."""
    t = F.regexp_replace(c, r"[\s\-]", "")
    t = F.when(t.rlike(r"^\d{9}0000$"), F.substring(t, 1, 9)).otherwise(t)
    return F.when(t.rlike(r"^\d{9}$") & ~_filler(t), t)


def duns_tail(c: Column) -> Column:
    """The last digits of a masked number (three or four), else null."""
    t = F.regexp_replace(F.lower(c), r"[\s\-]", "")
    return F.nullif(F.regexp_extract(t, r"^[*x]+(\d{3,4})$", 1), F.lit(""))


def let(c: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def state_code(c: Column) -> Column:
    """The two-letter code of a state given by code or name; null for the rest."""
    names = F.create_map(*[F.lit(x) for k, v in STATES.items() for x in (v.upper(), k)])
    return let(F.upper(F.trim(F.regexp_replace(c, r"\s+", " "))), lambda t: F.when(t.isin(list(STATES)), t).otherwise(names[t]))


def place(c: Column) -> Column:
    """struct(city, state) of "City, ST" in its many spellings; city null if only a state is given; null if neither is."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\s ]+", " "), r"(?i),? *(usa|u\.s\.a\.|united states)$", ""))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r",? *\d{5}(-\d{4})?$", ""), r"^\d+ [^,]*,", ""))
    forms = ((r"^([A-Za-z]{2}) *- *(.+)$", 2, 1), (r"^(.*?) *, *([^,]+)$", 1, 2), (r"^(.+) ([A-Za-z]{2})$", 1, 2), (r"^()(.+)$", 1, 2))

    def read(t: Column) -> Column:
        tried = [F.struct(F.nullif(F.initcap(F.trim(F.regexp_extract(t, p, i))), F.lit("")).alias("city"), state_code(F.regexp_extract(t, p, j)).alias("state")) for p, i, j in forms]
        return F.filter(F.array(*tried), lambda x: x["state"].isNotNull())

    return F.get(let(t, read), F.lit(0))


def gazetteer(places: DataFrame, least: int = 3, ratio: int = 50) -> DataFrame:
    """(city, state, n): the places that exist, by the rows that name them.

    A spelling is a place if `least` rows have it, unless one within two letters of it in the same state has `ratio` times
    as many: slips of a large place recur too, as tables grow. Neither number depends on the size of the table.
    """
    named = places.filter(F.col("city").isNotNull() & F.col("state").isNotNull() & ~F.col("city").rlike(r"^\w\."))
    known = cut(named.groupBy("city", "state").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    large = known.filter(F.col("n") >= least * ratio).select("state", F.col("city").alias("big"), F.col("n").alias("many"))
    slips = known.join(large, "state").filter((F.col("many") >= ratio * F.col("n")) & (F.levenshtein(_letters("city"), _letters("big"), 2) >= 0)).select("city", "state").distinct()
    return known.join(slips, ["city", "state"], "left_anti")


def _letters(c: str) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z]", "")


def corrected(places: DataFrame, known: DataFrame) -> DataFrame:
    """(city, state, fixed): for each distinct unknown city the known one it is short for ("P. Harbor") or misspells.

    Compared within the state only; of several the nearest, then the most frequent.
    """
    odd = places.filter(F.col("city").isNotNull() & F.col("state").isNotNull()).select("city", "state").distinct().join(known.select("city", "state"), ["city", "state"], "left_anti")
    k = known.select("state", F.col("city").alias("fixed"), "n")
    short = F.col("city").rlike(r"^\w\. ") & (F.substring("city", 1, 1) == F.substring("fixed", 1, 1)) & (F.regexp_extract("city", r"^\w\. (.*)$", 1) == F.regexp_extract("fixed", r"^\S+ (.*)$", 1))
    far = F.when(short, F.lit(0)).otherwise(F.levenshtein(_letters("city"), _letters("fixed"), 2))
    near = odd.join(k, "state").withColumn("far", far).filter(short | ((F.col("far") >= 0) & ~F.col("city").rlike(r"^\w\. ")))
    return near.groupBy("city", "state").agg(F.min_by("fixed", F.struct(F.col("far"), -F.col("n"), F.col("fixed"))).alias("fixed"))
