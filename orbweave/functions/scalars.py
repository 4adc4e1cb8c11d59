"""Scalar helpers of the reference's reports and feeds as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes that a normalised name does not carry.
SUFFIXES = ("INC", "INCORPORATED", "LLC", "L L C", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "LP", "LLP", "PLC", "PBC")


def normalise_name(c: Column, passes: int = 3) -> Column:
    """Upper case, punctuation to single blanks, legal suffixes taken off the end up to `passes` times."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"(?<=\b[A-Z])\.(?=[A-Z]\b)", " "), r"[^A-Z0-9]+", " "))
    for _ in range(passes):
        t = F.regexp_replace(t, rf"(?<=\S) ({'|'.join(SUFFIXES)})$", "")
    return t


def money(c: Column) -> Column:
    """Text like "$1,234.50" as a decimal; null for words."""
    t = F.nullif(F.regexp_replace(c, r"[$,\s]", ""), F.lit(""))
    return F.when(t.rlike(r"^-?\d{1,16}(\.\d+)?$"), t.cast("decimal(18,2)"))


def short_money(c: Column) -> Column:
    """1.2K, 3.4M, 5.6B."""
    a = F.abs(c)
    return F.when(a >= 1e9, F.format_string("$%.1fB", c / 1e9)).when(a >= 1e6, F.format_string("$%.1fM", c / 1e6)).when(a >= 1e3, F.format_string("$%.1fK", c / 1e3)).otherwise(F.format_string("$%.0f", c))


def any_date(c: Column) -> Column:
    """A date in any of the formats the feeds use; null if none fits."""
    t = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd-MMM-yyyy", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss", "MMMM d, yyyy")])


def months_between(a: Column, b: Column) -> Column:
    """Calendar months from a to b, signed."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def phase(c: Column) -> Column:
    """The award phase of free text in Roman or Arabic numerals."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike(r"\b(III|3)\b"), "SBIR_PHASE_3").when(t.rlike(r"\b(II|2)\b"), "SBIR_PHASE_2").when(t.rlike(r"\b(I|1)\b"), "SBIR_PHASE_1")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def stable_seed(c: Column) -> Column:
    """The first twelve hexadecimal digits of the SHA-256 of a text as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 12), 16, 10).cast("long")


def growth(c: Column) -> Column:
    """"+38%" as 1.38."""
    return 1 + F.regexp_extract(c, r"([+-]?\d+(?:\.\d+)?)%", 1).cast("double") / 100


def round_stage(amount: Column) -> Column:
    return F.when(amount < 2_000_000, "seed").when(amount < 15_000_000, "A").when(amount < 50_000_000, "B").when(amount < 150_000_000, "C").when(amount.isNotNull(), "growth")


def relative_distance(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)), F.lit(1.0))
