"""Texts cut off by a field or a transfer.

Length hazards: for each source and for lengths in characters and in bytes, the share of texts that end at exactly a
length among those at least as long, from window sums over the table of lengths. Each hazard is tested against the
hazards beside it (Poisson tail bound), and the Benjamini-Hochberg rule keeps the false discoveries of each source in
check. What remains are field limits.

Endings: a text ends whole if it closes a sentence, if its last line closes many texts of its source, or if its last
word ends texts far more often than it stands within a line. These habits are counted over all texts, those at field
limits left out. A text is cut if its ending is not whole at a field limit, or shows the marks of a cut (a torn
character, a "read more", a torn tag or entity), or, away from limits, if its ending is none of the corpus's habits.

Null, empty and white-space texts are not cut; copies of a text are judged as one; a null source is a source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.session import cut

ALPHA = 1e-4  # false-discovery level of the length tests
NEAR = 25  # lengths on either side that a hazard is held against
LINE_SHARE = 0.002  # of its source's texts: a last line that so many share is a closing line
WORD_SHARE = 0.004  # of its source's texts: a last word that so many share is a habit
CLOSING_SHARE = 0.0015  # of all texts: two last words that so many share are a closing
WORD_RATE = 3e-3  # a word that ends texts at least so often, of the times it is met, may end one
TAIL = 400  # characters in which the marks of an ending are looked for, none of which is near as long; all else reads whole texts
REASONS = ("field limit", "torn", "unusual ending")
SENTENCE_END = r"""[.!?。]["'”’»)\]}*_]*$"""
ELLIPSIS = r"(\.\.\.|…)[\"'”’»)\]]*$"
#: A text that goes on elsewhere, or whose last character, tag or entity is torn.
TORN = r"(?i)((\.\.\.|…)\]?\s*(\(?(read|see|show) (more|on)\)?|continue( reading)?|more)\W*$)|([(\[](continue|more|read more)[)\]]$)|(&(hellip|#8230);$)|(\[(\.\.\.|…)\]$)|�$|&[a-z#0-9]{1,8}$"


def _words(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "0")


def _marked(docs: DataFrame) -> DataFrame:
    """One row per source and distinct text: key, lengths, and the parts of the ending."""
    t = F.col("text")
    # each pattern takes all it can from the front, so it reads a text once
    whole = F.regexp_replace(t, r"\s+\z", "")
    line = F.substring_index(F.translate("whole", "\r", "\n"), "\n", -1)
    # closing lines may also follow the last sentence on its line
    last = F.trim(F.regexp_extract(line, r"(?s)^(?:.*[.!?。]\s)?(.*)$", 1))
    last_word = lambda c: F.regexp_extract(c, r"(?s)^(?:.*\s)?(\S+)$", 1)
    spaced = F.regexp_replace(last_word("whole"), r"([|=])(?=\S)", "$1 ")
    tag = F.substring_index("whole", "<", -1)
    return docs.filter(t.rlike(r"\S")).select(F.coalesce("source", F.lit("\x00")).alias("source"), F.sha2(t.cast("binary"), 256).alias("key"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), whole.alias("whole")).select(
        "source", "key", "chars", "bytes", F.right("whole", F.lit(TAIL)).alias("tail"), _words(last_word(spaced)).alias("word"), _words(last).alias("line"),
        _words(F.regexp_extract("whole", r"(?s)^(?:.*\s)?(\S+\s+\S+)$", 1)).alias("two"), (F.contains("whole", F.lit("<")) & tag.rlike("^(?i)[a-z/]") & ~F.contains(tag, F.lit(">"))).alias("in_tag"),
    ).groupBy("source", "key").agg(*[F.first(c).alias(c) for c in ("chars", "bytes", "tail", "word", "line", "two", "in_tag")])


def length_limits(texts: DataFrame, alpha: float = ALPHA, near: int = NEAR) -> DataFrame:
    """(source, unit, length) at which significantly more texts end than at the lengths beside it."""
    parts = None
    for unit in ("chars", "bytes"):
        p = texts.groupBy("source", F.lit(unit).alias("unit"), F.col(unit).cast("long").alias("length")).agg(F.count("*").alias("n"))
        parts = p if parts is None else parts.unionByName(p)
    by = Window.partitionBy("source", "unit").orderBy("length")
    hazards = parts.withColumn("at_risk", F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("peak", F.lit(False))
    # a peak would hide its smaller neighbours, so the second test leaves the first one's peaks out of the surroundings
    first = _tested(hazards, alpha, near)
    second = _tested(first.withColumn("peak", F.col("found")).drop("found"), alpha, near)
    return second.filter(F.col("peak") | F.col("found")).select("source", "unit", "length", "n", "at_risk", "p")


def _tested(h: DataFrame, alpha: float, near: int) -> DataFrame:
    """found: the hazard stands out from those of the lengths within `near`, peaks left out; the false-discovery rule holds per source and unit."""
    beside = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-near, near)
    all_ = Window.partitionBy("source", "unit")
    calm = F.when(F.col("peak"), 0).otherwise(F.col("n"))
    h = h.withColumn("around", F.sum(calm).over(beside) - calm).withColumn("span", F.least(F.lit(near), F.col("length") - 1) + F.lit(near))
    # texts expected to end here at the neighbours' hazard, never below half a text in the whole span
    expected = F.greatest(F.col("around"), F.lit(0.5)) / F.col("span")
    p = F.when(F.col("n") > expected, F.exp(-(F.col("n") * F.log(F.col("n") / expected) - F.col("n") + expected))).otherwise(1.0)
    ranked = h.withColumn("p", p).withColumn("i", F.row_number().over(all_.orderBy("p", "length"))).withColumn("m", F.count("*").over(all_))
    bar = F.max(F.when(F.col("p") <= alpha * F.col("i") / F.col("m"), F.col("p"))).over(all_)
    return ranked.withColumn("found", F.coalesce((F.col("p") <= bar) & (F.col("n") >= 3), F.lit(False))).drop("i", "m", "around", "span")


def _inner_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that stand within a line, with their number for each source; digits count as 0."""
    import re

    digits = re.compile(r"\d+").sub
    for batch in batches:
        counts: dict[str, Counter] = {}
        for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            count = counts.setdefault(source, Counter())
            for line in digits("0", text).replace("|", "| ").replace("=", "= ").split("\n"):
                count.update(line.split()[:-1])
        for source, count in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(count), pa.string()), pa.array(list(count.keys()), pa.string()), pa.array(list(count.values()), pa.int64())], ["source", "word", "inner"])


def judged(docs: DataFrame) -> DataFrame:
    """One row per source and distinct text: source, key, at_limit, is_cut, reason (field limit, torn, or unusual ending)."""
    texts = cut(_marked(docs))
    limits = length_limits(texts).select("source", "unit", "length")
    at_chars = limits.filter("unit = 'chars'").select("source", F.col("length").alias("chars"), F.lit(True).alias("by_chars"))
    at_bytes = limits.filter("unit = 'bytes'").select("source", F.col("length").alias("bytes"), F.lit(True).alias("by_bytes"))
    t = texts.join(at_chars, ["source", "chars"], "left").join(at_bytes, ["source", "bytes"], "left").withColumn("at_limit", F.coalesce("by_chars", "by_bytes", F.lit(False)))
    t = cut(t.select("source", "key", "tail", "word", "line", "two", "in_tag", "at_limit"))
    free = t.filter(~F.col("at_limit"))
    sizes = t.groupBy("source").agg(F.count("*").alias("texts"))
    total = sizes.agg(F.sum("texts").alias("all_texts"))
    lines = free.groupBy("source", "line").agg(F.count("*").alias("ends_line"))
    closings = free.filter(F.col("two") != "").groupBy("two").agg(F.count("*").alias("ends_two"))
    ends = free.groupBy("source", "word").agg(F.count("*").alias("ends"))
    inner = docs.filter(F.col("text").isNotNull()).select(F.coalesce("source", F.lit("\x00")).alias("source"), "text").mapInArrow(_inner_words, "source string, word string, inner long").groupBy("source", "word").agg(F.sum("inner").alias("inner"))
    words = ends.join(inner, ["source", "word"], "left").select("source", "word", "ends", F.coalesce("inner", F.lit(0)).alias("inner"))
    own = F.when(F.col("at_limit"), 0).otherwise(1)
    # one row of totals, one row per source
    j = t.join(F.broadcast(sizes), "source").crossJoin(F.broadcast(total)).join(lines, ["source", "line"], "left").join(closings, "two", "left").join(words, ["source", "word"], "left")
    others = F.coalesce("ends", F.lit(0)) - own
    met = others + F.coalesce("inner", F.lit(0))
    habit = (others >= F.greatest(F.lit(2.0), WORD_SHARE * F.col("texts"))) & (others >= WORD_RATE * met)
    # away from limits a rarer last word passes too, if it ends texts often for a word so rare
    habit |= ~F.col("at_limit") & (others >= F.greatest(F.lit(1.0), WORD_SHARE / 4 * F.col("texts"))) & (others >= 0.02 * met)
    closing = ((F.coalesce("ends_line", F.lit(0)) - own) >= F.greatest(F.lit(2.0), LINE_SHARE * F.col("texts"))) | ((F.coalesce("ends_two", F.lit(0)) - own) >= F.greatest(F.lit(3.0), CLOSING_SHARE * F.col("all_texts")))
    sentence = F.col("tail").rlike(SENTENCE_END) & ~F.col("tail").rlike(ELLIPSIS)
    # "Inc." and the like: a full stop that hardly ever ends a text
    abbreviation = F.col("word").endswith(".") & (F.coalesce("inner", F.lit(0)) >= 200) & (F.coalesce("ends", F.lit(0)) < 1e-3 * F.col("inner"))
    torn = F.col("tail").rlike(TORN) | F.col("in_tag")
    whole = (sentence & ~abbreviation) | closing | (habit & ~F.col("tail").rlike(ELLIPSIS))
    reason = F.when(F.col("at_limit"), "field limit").when(torn, "torn").otherwise("unusual ending")
    return j.select("source", "key", "at_limit", (torn | ~whole).alias("is_cut"), F.when(torn | ~whole, reason).alias("reason"))


def cut_documents(docs: DataFrame) -> DataFrame:
    """doc_id of every document whose text is cut, copies under any source included."""
    keys = judged(docs).filter("is_cut").select("key").distinct()
    return docs.filter(F.col("text").rlike(r"\S")).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key")).join(keys, "key", "left_semi").select("doc_id").distinct()


def cut_report(docs: DataFrame) -> DataFrame:
    """Per source: documents, documents with a text, cut ones, their share of those, and how many of them each reason found.

    A text that is cut for several reasons under several sources counts for the first in the order field limit, torn, unusual ending.
    """
    order = F.min(F.struct(F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason")).alias("i"), "reason"))["reason"]
    keys = judged(docs).filter("is_cut").groupBy("key").agg(order.alias("reason"))
    has_text = F.col("text").rlike(r"\S")
    rows = docs.select("source", has_text.alias("has_text"), F.when(has_text, F.sha2(F.col("text").cast("binary"), 256)).alias("key")).join(keys, "key", "left")
    by = [F.count_if(F.col("reason") == r).alias(f"by_{r.replace(' ', '_')}") for r in REASONS]
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("has_text").alias("with_text"), F.count("reason").alias("cut_texts"), *by).withColumn("share", F.when(F.col("with_text") > 0, F.round(F.col("cut_texts") / F.col("with_text"), 6)))
