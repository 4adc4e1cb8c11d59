"""Deeply nested JSON into linked flat rows, by structural indexing.

A batch of JSON texts is one byte array. Bitmaps of quotes, brackets and delimiters are made for the whole batch at
once; a running parity of unescaped quotes tells what lies inside strings; prefix sums over brackets give the depth of
every token; the opener last seen at a depth is the parent, and the token that closes it ends its span. From parents and
counted commas come the paths and the positions. The same arrays hold the grammar check, so a text that is no valid JSON gives nothing.

Rules (see also `flatten`): positions count from 0 and count nulls; a string that holds a JSON object or array is read as
that; a lone object under a key that elsewhere in the column holds an array is element 0. Null and empty payloads give
no rows, and a row without id gives none. A key given twice in one object is kept twice (equal paths then count once).
No depth is too great for the index; there is no recursion but over strings within strings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.session import cut

#: More paths than this, and the paths that hold both arrays and lone objects are joined instead of sent to the tasks.
PATHS_SENT = 20_000
LONE = "\x01"
_STRING = re.compile(r'("(?:[^"\\]|\\.)*")(\s*:)?', re.S)
_STARTS = re.compile(r'"(?:\s|\\[nrt])*[\[{]')
_OBJ, _END_OBJ, _ARR, _END_ARR, _COLON, _COMMA, _QUOTE, _WORD = range(1, 9)
_STRUCTURAL = np.zeros(256, np.uint8)
for _c, _k in zip(b"{}[]:,", (_OBJ, _END_OBJ, _ARR, _END_ARR, _COLON, _COMMA), strict=True):
    _STRUCTURAL[_c] = _k
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_WORDY = np.ones(256, np.uint8)
_WORDY[list(b'{}[]:," \t\r\n')] = 0
_OPENS = np.zeros(256, bool)
_OPENS[list(b"{[ \\\t\r\n")] = True
_STEP = np.array([0, 1, -1, 1, -1, 0, 0, 0, 0], np.int64)
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True


def unwrap(text: str) -> str:
    """The text with every string value that holds a JSON object or array replaced by that value; keys stay as they are."""

    def within(m: re.Match) -> str:
        raw = m.group(1)
        if m.group(2) or not _STARTS.match(raw):  # a key, or plain text
            return m.group()
        try:
            inner = json.loads(raw, strict=True).strip(" \t\r\n")
        except ValueError:
            return m.group()
        return unwrap(inner) if inner[:1] in ("{", "[") and _valid(inner) else m.group()

    return _STRING.sub(within, text)


def _refuse(constant: str) -> None:
    raise ValueError(constant)  # NaN and Infinity are no JSON


def _valid(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_refuse)
    except ValueError:
        return False
    except RecursionError:  # too deep for that parser only
        return bool(Index(*_lines(pa.array([text], pa.string()))).ok[0])
    return True


def _words_valid(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which spans are true, false, null or a JSON number."""
    n = e - s
    ok = np.zeros(len(s), bool)
    for lit in (b"true", b"false", b"null"):
        i = np.flatnonzero(n == len(lit))
        if len(i):
            ok[i] |= (b[s[i][:, None] + np.arange(len(lit))] == np.frombuffer(lit, np.uint8)).all(1)
    num = np.flatnonzero(~ok & (_DIGIT[b[s]] | (b[s] == 45)) & _DIGIT[b[e - 1]])
    if not len(num):
        return ok
    s, e = s[num], e[num]
    size = e - s
    at = np.repeat(s - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    who = np.repeat(np.arange(len(s)), size)
    c, digit = b[at], _DIGIT[b[at]]
    exp, dot, sign = (c == 101) | (c == 69), c == 46, (c == 43) | (c == 45)
    first = at == s[who]
    before, after = b[np.maximum(at - 1, 0)], b[np.minimum(at + 1, len(b) - 1)]
    bad = ~(digit | exp | dot | sign)
    bad |= dot & ~(_DIGIT[before] & _DIGIT[after])
    bad |= exp & (first | ~_DIGIT[before])
    bad |= sign & ~((first & (c == 45)) | (~first & ((before == 101) | (before == 69))))
    start = s + (b[s] == 45)
    bad_num = np.bincount(who[bad], minlength=len(s)) > 0
    bad_num |= (np.bincount(who[exp], minlength=len(s)) > 1) | (np.bincount(who[dot], minlength=len(s)) > 1)
    bad_num |= (b[start] == 48) & (e - start > 1) & _DIGIT[b[np.minimum(start + 1, len(b) - 1)]]
    pe, pd = np.full(len(s), len(b)), np.full(len(s), -1)
    pe[who[exp]] = at[exp]
    pd[who[dot]] = at[dot]
    ok[num] = ~(bad_num | (pd > pe))
    return ok


class Index:
    """Tokens of a batch of JSON texts, each followed by a line feed: position, kind, record, parent and place within it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        b = self.b = data
        starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64) - 1
        record = lambda p: np.searchsorted(starts, p, "right") - 1
        ok = np.ones(len(starts), bool)
        quote = b == 34
        slashes = np.flatnonzero(b == 92)
        if len(slashes):  # within a run of backslashes every second one is itself escaped
            first = np.concatenate(([True], np.diff(slashes) != 1))
            place = np.arange(len(slashes)) - np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0))
            escapes = slashes[place % 2 == 0]
            nxt = b[escapes + 1]
            quote[escapes[nxt == 34] + 1] = False
            ok[record(escapes[~_ESCAPED[nxt]])] = False
            uni = escapes[nxt == 117]
            for j in range(2, 6):
                ok[record(uni[~_HEX[b[np.minimum(uni + j, len(b) - 1)]]])] = False
        quotes = np.flatnonzero(quote)
        odd = np.flatnonzero(np.bincount(record(quotes), minlength=len(starts)) & 1)
        ok[odd] = False
        toggle = quote.view(np.uint8).copy()
        toggle[ends[odd]] = 1  # an open string ends with its text
        inside = np.bitwise_xor.accumulate(toggle)
        outside = inside ^ 1
        kind = _STRUCTURAL[b] * outside
        opening = inside[quotes] == 1
        kind[quotes[opening]] = _QUOTE
        self.closing = quotes[~opening]
        low = np.flatnonzero((b < 32) & (inside == 1))
        ok[record(low)] = False
        wordy = (_WORDY[b] & outside).view(bool)
        edge = np.flatnonzero(wordy[1:] != wordy[:-1]) + 1
        if len(wordy) and wordy[0]:
            edge = np.concatenate(([0], edge))
        heads, tails = edge[0::2], edge[1::2]  # every text ends with a line feed, so words come in pairs of edges
        kind[heads] = _WORD
        if len(heads):
            ok[record(heads[~_words_valid(b, heads, tails)])] = False
        pos = np.flatnonzero(kind)
        rec = record(pos)
        k = kind[pos]
        level = np.cumsum(_STEP[k], dtype=np.int64)
        if len(pos):
            begin = np.flatnonzero(np.concatenate(([True], rec[1:] != rec[:-1])))
            base = np.where(begin > 0, level[begin - 1], 0)
            depth = level - np.repeat(base, np.diff(np.concatenate((begin, [len(pos)]))))
            ok[rec[begin][(np.minimum.reduceat(depth, begin) < 0) | (depth[np.concatenate((begin[1:], [len(pos)])) - 1] != 0)]] = False
            keep = ok[rec]
            pos, k, rec, depth = pos[keep], k[keep], rec[keep], depth[keep]
        else:
            depth = level
        self._link(pos, k.astype(np.int8), rec, depth, ok)

    def _link(self, pos, kind, rec, depth, ok):
        m = len(pos)
        opener, closer = (kind == _OBJ) | (kind == _ARR), (kind == _END_OBJ) | (kind == _END_ARR)
        member = depth - opener + closer  # the level of the container that a token stands in; 0 at the root
        heads = np.flatnonzero(opener)
        lv, who, is_head = np.concatenate((member, depth[heads])), np.concatenate((np.arange(m), heads)), np.concatenate((np.zeros(m, bool), np.ones(len(heads), bool)))
        order = np.lexsort((is_head, who, lv))
        who, is_head = who[order], is_head[order]
        last = np.maximum.accumulate(np.where(is_head, np.arange(len(who)), 0)) if len(who) else who
        comma = np.cumsum((kind[who] == _COMMA) & ~is_head) if len(who) else who
        parent, place = np.full(m, -1, np.int64), np.zeros(m, np.int64)
        body = ~is_head
        parent[who[body]], place[who[body]] = who[last][body], (comma - comma[last])[body]
        parent[member == 0] = -1
        up = np.where(parent >= 0, kind[parent], 0) if m else kind
        prior = np.concatenate(([0], kind[:-1])) if m else kind
        if m:
            prior[np.concatenate(([True], rec[1:] != rec[:-1]))] = 0
        value = np.isin(kind, (_OBJ, _ARR, _QUOTE, _WORD))
        key = (kind == _QUOTE) & (up == _OBJ) & ((prior == _OBJ) | (prior == _COMMA))
        done = np.concatenate(([False], ((np.isin(kind, (_QUOTE, _WORD)) & ~key) | closer)[:-1])) if m else key
        after_key = np.concatenate(([False], key[:-1])) if m else key
        good = np.zeros(m, bool)
        good |= value & (up == 0) & (prior == 0)
        good |= value & (up == _ARR) & ((prior == _ARR) | (prior == _COMMA))
        good |= value & (up == _OBJ) & (prior == _COLON)
        good |= key
        good |= (kind == _COLON) & (up == _OBJ) & after_key
        good |= (kind == _COMMA) & (up != 0) & done
        good |= (kind == _END_OBJ) & (up == _OBJ) & (done | (prior == _OBJ))
        good |= (kind == _END_ARR) & (up == _ARR) & (done | (prior == _ARR))
        ok[rec[~good]] = False
        seen = np.zeros(len(ok), bool)
        seen[rec] = True
        self.pos, self.kind, self.rec, self.parent, self.place, self.up, self.ok = pos, kind, rec, parent, place, up, ok & seen

    def spans(self, tokens: np.ndarray) -> list[str]:
        """The text of each of these containers, from the bracket that opens it to the one that closes it."""
        closers = np.flatnonzero((self.kind == _END_OBJ) | (self.kind == _END_ARR))
        end = np.zeros(len(self.pos), np.int64)
        end[self.parent[closers]] = self.pos[closers] + 1
        raw = self.b.tobytes()
        return [raw[x:y].decode("utf-8", "replace") for x, y in zip(self.pos[tokens].tolist(), end[tokens].tolist(), strict=True)]

    def keys(self, tokens: np.ndarray) -> list[bytes]:
        """The raw key of each of these values in an object: the string two tokens before the value."""
        s = self.pos[tokens - 2]
        e = self.closing[np.searchsorted(self.closing, s)]
        raw = self.b.tobytes()
        return [raw[x + 1 : y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]


def _key_text(raw: bytes) -> str:
    return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode("utf-8", "replace")


def _openers(ix: Index) -> Iterator[tuple[int, bool, int, int, int, int, bytes]]:
    """Containers in order: token, is an object, parent, parent's kind, place, record, raw key (empty outside objects)."""
    t = np.flatnonzero(((ix.kind == _OBJ) | (ix.kind == _ARR)) & ix.ok[ix.rec])
    keyed = ix.up[t] == _OBJ
    keys = np.full(len(t), b"", object)
    keys[keyed] = np.array([*ix.keys(t[keyed]), None], object)[:-1]
    return zip(t.tolist(), (ix.kind[t] == _OBJ).tolist(), ix.parent[t].tolist(), ix.up[t].tolist(), ix.place[t].tolist(), ix.rec[t].tolist(), keys.tolist(), strict=True)


def survey_paths(ix: Index, column: str) -> set[str]:
    """The distinct key paths of a batch that hold arrays ('[' + path) and lone objects ('{' + path)."""
    ids: dict[tuple[int, bytes], int] = {}
    names, number, found = [column], {}, set()
    for t, is_obj, up, where, _, _, key in _openers(ix):
        if up < 0:
            number[t] = 0
        elif where == _ARR:
            number[t] = number[up]
        else:
            step = (number[up], key)
            g = ids.get(step)
            if g is None:
                g = ids[step] = len(names)
                names.append(f"{names[step[0]]}.{_key_text(key)}")
            number[t] = g
            found.add((is_obj, g))
    return {("{" if is_obj else "[") + names[g] for is_obj, g in found}


def index_rows(ix: Index, column: str, both: frozenset | None) -> tuple[list[int], list[str], list[int]]:
    """Record, path and token of every object that is an array element; a lone object under a key path in `both` is element 0.

    With both=None the question stays open: a lone object's step is marked with LONE and its row is given as well.
    """
    paths: dict[int, tuple[str, str]] = {}
    names: dict[bytes, str] = {}
    recs, out, tokens = [], [], []
    for t, is_obj, up, where, place, r, key in _openers(ix):  # in order: parents first
        row = False
        if up < 0:
            path = generic = column
        elif where == _ARR:
            path, generic = paths[up]
            path, row = f"{path}[{place}]", is_obj
        else:
            k = names.get(key)
            if k is None:
                k = names[key] = _key_text(key)
            path, generic = paths[up]
            path, generic = f"{path}.{k}", f"{generic}.{k}"
            if is_obj and both is None:
                path, row = path + LONE, True
            elif is_obj and generic in both:
                path, row = path + "[0]", True
        paths[t] = (path, generic)
        if row:
            recs.append(r)
            out.append(path)
            tokens.append(t)
    return recs, out, tokens


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a line feed, and the offsets."""
    lines = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    _, offsets, data = lines.buffers()
    off = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def _indexed(texts: pa.Array) -> Index:
    """The index of a batch; the few payloads that hold JSON inside strings are rewritten before."""
    data, off = _lines(texts)
    open_ = np.flatnonzero((data[:-1] == 34) & _OPENS[data[1:]])
    rows = [int(r) for r in np.unique(np.searchsorted(off, open_, "right") - 1) if _STARTS.search(texts[int(r)].as_py())]
    if rows:
        mask = np.zeros(len(texts), bool)
        mask[rows] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([unwrap(texts[r].as_py()) for r in rows], texts.type))
        data, off = _lines(texts)
    return Index(data, off)


def _surveyor(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            if batch.num_rows:
                new = survey_paths(_indexed(batch.column(0)), column) - seen
                if len(seen) < PATHS_SENT:  # a memo only: what is not remembered is given again
                    seen |= new
                yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], ["path"])

    return run


def _flattener(column: str, both: frozenset | None, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ix = _indexed(batch.column(1))
                rec, path, tokens = index_rows(ix, column, both)
                ids = batch.column(0).take(pa.array(rec, pa.int64())).cast(pa.string())
                more = [pa.array(ix.spans(np.array(tokens, np.int64)), pa.string())] if spans else []
                yield pa.RecordBatch.from_arrays([ids, pa.array(path, pa.string()), *more], ["id", "path", *["object"][: len(more)]])

    return run


def _payloads(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col("id").isNotNull() & F.col(column).contains("{")).select(F.col("id"), F.col(column).alias("text"))


def mixed_paths(df: DataFrame, column: str) -> DataFrame:
    """The key paths of a column that hold arrays in some rows and lone objects in others."""
    seen = cut(_payloads(df, column).select("text").mapInArrow(_surveyor(column), "path string").distinct())  # read twice below
    arrays = seen.filter(F.col("path").startswith("[")).select(F.expr("substring(path, 2)").alias("key"))
    lone = seen.filter(F.col("path").startswith("{")).select(F.expr("substring(path, 2)").alias("key"))
    return arrays.join(lone, "key", "left_semi")


def _resolve_by_join(rows: DataFrame, both: DataFrame, column: str) -> DataFrame:
    """Paths with marked lone steps, resolved by a join with the mixed key paths; for columns with very many paths."""
    steps = F.split(F.col("path"), LONE)
    n = F.size(steps)
    prefix = lambda i: F.regexp_replace(F.regexp_replace(F.concat_ws("", F.slice(steps, 1, i)), r"\[\d+\]", ""), LONE, "")
    marked = rows.withColumn("lone", F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), prefix)).otherwise(F.array().cast("array<string>")))
    plain, open_ = marked.filter(F.size("lone") == 0), marked.filter(F.size("lone") > 0)
    hits = open_.select("id", "path", F.explode("lone").alias("key")).join(both, "key").groupBy("id", "path").agg(F.collect_set("key").alias("hits"))  # as many as a path has steps
    solved = open_.join(hits, ["id", "path"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    built = F.aggregate(F.sequence(F.lit(1), n), F.lit(""), lambda acc, i: F.concat(acc, F.element_at(steps, i), F.when((i < n) & F.array_contains(F.col("hits"), F.element_at(F.col("lone"), F.least(i, n - 1))), F.lit("[0]")).otherwise(F.lit(""))))
    ends_lone = F.col("path").endswith(LONE)
    solved = solved.filter(~ends_lone | F.array_contains(F.col("hits"), F.element_at(F.col("lone"), -1)))
    more = [c for c in rows.columns if c not in ("id", "path")]
    return plain.select("id", "path", *more).unionByName(solved.select("id", built.alias("path"), *more))


def flatten(df: DataFrame, column: str, paths_sent: int = PATHS_SENT, spans: bool = False) -> DataFrame:
    """(id, path) of every object that is an element of an array at any depth in a JSON text column; with spans also its text.

    The first pass learns which key paths are mixed; their number is counted, and only up to `paths_sent` they go to the
    tasks. Beyond that the paths are resolved by a join. Repeated deliveries of an id count once; if their objects under
    one path differ, the last one by text is given.
    """
    both = mixed_paths(df, column)
    few = both.limit(paths_sent + 1).collect()  # key paths, not rows: their number is checked
    schema = "id string, path string" + (", object string" if spans else "")
    if len(few) <= paths_sent:
        rows = _payloads(df, column).mapInArrow(_flattener(column, frozenset(r["key"] for r in few), spans), schema)
    else:
        rows = _resolve_by_join(_payloads(df, column).mapInArrow(_flattener(column, None, spans), schema), both, column)
    return rows.groupBy("id", "path").agg(F.max("object").alias("object")) if spans else rows.distinct()


def linked(rows: DataFrame) -> DataFrame:
    """rows (id, path, object) as child rows: parent_path (null at the top), list_name, place, and the object's own fields.

    fields maps each key of the object to its value as text, strings without quotes and lists and objects as JSON; a key
    given twice has its last value.
    """
    up = F.regexp_extract("path", r"^(.*\])[^\]]*\[\d+\]$", 1)
    return rows.select(
        "id", "path", F.when(up != "", up).alias("parent_path"), F.regexp_extract("path", r"([^.\[\]]+)(?:\[\d+\])+$", 1).alias("list_name"),
        F.regexp_extract("path", r"\[(\d+)\]$", 1).cast("int").alias("place"), F.from_json("object", "map<string,string>").alias("fields"),
    )


def list_elements(df: DataFrame, column: str, names: bool = False) -> DataFrame:
    """(id, path) of every non-blank element of a list column, with names also the element; positions count nulls and blanks."""
    e = df.filter(F.col("id").isNotNull()).select("id", F.posexplode(column).alias("place", "name"))
    rows = e.filter(F.col("name").rlike(r"[^\s ​﻿]")).select("id", F.concat(F.lit(f"{column}["), F.col("place").cast("string"), F.lit("]")).alias("path"), "name")
    return rows.groupBy("id", "path").agg(F.max("name").alias("name")) if names else rows.select("id", "path").distinct()
