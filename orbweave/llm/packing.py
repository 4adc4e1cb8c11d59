"""Items into containers of fixed capacity: bin completion branch and bound within hashed blocks.

Items are spread over blocks of bounded size by a hash of their id, so no task ever holds more than a block and equal
input gives equal containers. Each block is packed by bin completion: the largest open item is placed, the undominated
fillings around it are tried in order of waste, one after another as they are needed, and branches whose waste shows that
they cannot beat the incumbent are cut; best-fit decreasing gives the first incumbent. What a block leaves in containers
that are not nearly full is dissolved and packed again in fewer blocks, as long as fewer blocks come out, so the room lost
to the division into blocks does not grow with them.

The only bound on the search is STEPS, the sizes that a block's search may look at. Where a branch is given up, and where
the steps run out, what is placed so far is completed by best fit and becomes the incumbent if it is better; past that the
best packing found so far holds. An item longer than the capacity fills whole containers of its own; its rest is an item like others. Null and
empty texts, and texts of zero tokens, are in no container. Documents with one id given twice are two items.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.session import cut

CAPACITY = 2048
BLOCK_ITEMS = 4000
#: Sizes that the search of a block may look at (a second or so); the best packing found so far holds beyond it.
STEPS = 1_000_000
NEARLY_FULL = 0.995


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Best-fit decreasing over sizes given in falling order; bins hold indices."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for i, s in enumerate(sizes):
        fit = rooms >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
            bins[b].append(i)
            r -= s
        else:
            b = len(bins)
            bins.append([i])
            r = cap - s
        by_room[r].append(b)
        rooms |= 1 << r
    return bins


def lower_bound(sizes: list[int], cap: int) -> int:
    """No packing has fewer bins: total size, items over half a bin, and for each k the items that cannot share a bin with one above cap-k."""
    a = np.array(sizes)
    best = max(math.ceil(sum(sizes) / cap), int((2 * a > cap).sum()))
    for k in sorted({s for s in sizes if s <= cap // 2}):
        big, mid = a[a > cap - k], a[(a > cap // 2) & (a <= cap - k)]
        small = int(a[(a >= k) & (a <= cap // 2)].sum())
        room = len(mid) * cap - int(mid.sum())
        best = max(best, len(big) + len(mid) + max(0, math.ceil((small - room) / cap)))
    return best


class Fillings:
    """Undominated fillings of a room from sizes that are left, by waste, each found when it is asked for.

    A filling is dominated if one of its sizes can be exchanged for a larger left size that still fits. Which sums the
    smaller sizes can make at all is worked out once for all the items of a block.
    """

    def __init__(self, count: dict[int, int], cap: int, steps: int):
        self.steps = steps
        self.sizes = sorted(count, reverse=True)
        rising = self.sizes[::-1]
        self.first = [len(rising) - bisect_right(rising, t) for t in range(cap + 1)]  # place of the largest size up to t
        self.rank = {s: i for i, s in enumerate(self.sizes)}
        full = (1 << (cap + 1)) - 1
        sums = [1]  # bit t of sums[-1 - i]: t is a sum of items of sizes[i:]
        for s in reversed(self.sizes):
            reach, n, k = sums[-1], min(count[s], cap // s), 1
            while n:
                step = min(k, n)
                reach |= (reach << (step * s)) & full
                n, k = n - step, k * 2
            sums.append(reach)
        self.sums = sums[::-1]

    def _exact(self, at: int, target: int, left: dict[int, int]) -> Iterator[list[int]]:
        """Multisets of left sizes from place `at` on whose sum is the target."""
        if not target:
            yield []
            return
        for i in range(max(at, self.first[target]), len(self.sizes)):
            self.steps -= 1
            if self.steps < 0 or not self.sums[i] >> target & 1:
                return  # neither these sizes nor smaller ones make the target
            s = self.sizes[i]
            if left[s] > 0 and self.sums[i] >> (target - s) & 1:
                left[s] -= 1
                try:
                    for more in self._exact(i, target - s, left):
                        yield [s, *more]
                finally:
                    left[s] += 1

    def around(self, room: int, left: dict[int, int], most_waste: int) -> Iterator[list[int]]:
        """Fillings of the room that waste at most that much; `left` is changed while one is sought and whole when it is given."""
        for waste in range(min(room, most_waste) + 1):
            if self.sums[0] >> (room - waste) & 1:
                for f in self._exact(0, room - waste, dict(left)):
                    if not waste or not self._dominated(f, waste, left):
                        yield f

    def _dominated(self, f: list[int], waste: int, left: dict[int, int]) -> bool:
        free = lambda s: left.get(s, 0) - f.count(s) > 0
        return any(free(s) for h in {0, *f} for s in range(h + 1, h + waste + 1) if s in self.rank)


def pack(sizes: list[int], cap: int, steps: int = STEPS) -> list[list[int]]:
    """Bins of indices into sizes (given in falling order)."""
    best = best_fit(sizes, cap)
    least = lower_bound(sizes, cap) if sizes else 0
    if len(best) <= least:
        return best
    total = sum(sizes)
    count: dict[int, int] = {}
    for s in sizes:
        count[s] = count.get(s, 0) + 1
    fill, left = Fillings(count, cap, steps), dict(count)
    plan: list[list[int]] | None = None
    goal = len(best) - 1
    bins: list[list[int]] = []
    waste, deepest = 0, 0
    stack: list[tuple[Iterator[list[int]], int]] = []  # the fillings still to try at each bin, and its largest item

    def open_bin(at: int) -> None:
        while not left[fill.sizes[at]]:
            at += 1
        top = fill.sizes[at]
        left[top] -= 1
        stack.append((fill.around(cap - top, left, goal * cap - total - waste), top))

    def settle(found: list[list[int]]) -> None:
        nonlocal plan, goal
        if len(found) <= goal:
            plan, goal = found, len(found) - 1

    def completed() -> list[list[int]]:
        rest = [s for s in fill.sizes for _ in range(left[s] + (s == stack[-1][1]))]
        return [*map(list, bins), *([rest[i] for i in b] for b in best_fit(rest, cap))]

    open_bin(0)
    while stack and fill.steps >= 0 and goal >= least:
        fillings, top = stack[-1]
        if len(bins) == len(stack):  # come back to a bin: its last filling is undone
            last = bins.pop()
            waste -= cap - sum(last)
            for s in last[1:]:
                left[s] += 1
        f = next(fillings, None) if waste <= goal * cap - total else None
        if f is None or waste + cap - top - sum(f) > goal * cap - total:
            if len(bins) > deepest or fill.steps < 0:
                deepest = len(bins)
                settle(completed())
            stack.pop()
            left[top] += 1
            continue
        for s in f:
            left[s] -= 1
        waste += cap - top - sum(f)
        bins.append([top, *f])
        if any(left.values()):
            open_bin(fill.rank[top])
        else:
            settle([list(b) for b in bins])
    if plan is None:
        return best
    at: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        at.setdefault(s, []).append(i)
    return [[at[s].pop() for s in b] for b in plan]


def _packer(cap: int, level: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["tokens", "doc_id", "piece", "copy"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins = pack(items["tokens"].tolist(), cap)
        name, fill = [""] * len(items), [0] * len(items)
        block = items["block"].iloc[0]
        for k, b in enumerate(bins):
            full = int(items["tokens"].iloc[b].sum())
            for i in b:
                name[i], fill[i] = f"{level}-{block}-{k}", full
        return items.assign(container_id=name, filled=fill)[["container_id", "doc_id", "piece", "copy", "tokens", "filled"]]

    return run


def fill_containers(sized: DataFrame, cap: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(container_id, doc_id, piece, tokens, filled): every piece of every document (doc_id, tokens) in one container."""
    whole = F.floor(F.col("tokens") / cap).cast("int")
    copies = sized.filter(F.col("tokens") > 0).groupBy("doc_id", "tokens").agg(F.count("*").alias("copies"))
    each = cut(copies.select("doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")))
    full = each.filter(whole > 0).select("doc_id", "copy", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")).select(
        F.concat_ws("-", F.lit("whole"), F.col("doc_id").cast("string"), F.col("copy").cast("string"), F.col("piece").cast("string")).alias("container_id"), "doc_id", "piece", F.lit(cap).cast("long").alias("tokens"), F.lit(cap).cast("long").alias("filled"))
    items = each.filter(F.col("tokens") % cap > 0).select("doc_id", whole.alias("piece"), "copy", (F.col("tokens") % cap).alias("tokens"))
    parts, level, n = [full], 0, items.count()
    schema = f"container_id string, doc_id {dict(sized.dtypes)['doc_id']}, piece int, copy int, tokens long, filled long"
    spark = sized.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    while n:
        blocks = math.ceil(n / block_items)
        block = F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(level)), F.lit(blocks))
        spread = items.withColumn("block", block).repartition(min(blocks, tasks), "block")  # a given number is not coalesced into fewer tasks
        packed = cut(spread.groupBy("block").applyInPandas(_packer(cap, level), schema))
        open_ = packed.filter(F.col("filled") < NEARLY_FULL * cap)
        left = open_.count() if blocks > 1 else 0
        again = left > 0 and math.ceil(left / block_items) < blocks
        kept = packed.filter(F.col("filled") >= NEARLY_FULL * cap) if again else packed
        parts.append(kept.select("container_id", "doc_id", "piece", "tokens", "filled"))
        if not again:
            break
        items, n, level = open_.select("doc_id", "piece", "copy", "tokens"), left, level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
