"""Sharding by a minimax contiguous partition of ordered atomic groups; DataFrame functions only.

The smallest level that lets the ordered groups fit is found by binary search,
each guess checked greedily; a group above the level is a shard of its own, so
the largest shard is the smallest possible.  The group boundaries stay in a table: the
search knows them first by coarse cells of the running size, then asks for the
finer cells that could still change its answer, so what reaches the driver is
bounded by the number of cells, not by the input.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from itertools import groupby, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.text import parallelism, text_or_empty, written

OVERHEAD = 16
_CELL_BITS = 14  # the first look has up to 2**14 cells of equal width
_ZOOM_BITS = 7


def _asc(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def running(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Adds run (sum of size up to the row) and place (from 0) in the order of the columns, over the whole table.

    Rows are range-partitioned and numbered inside their range; ranges are added
    up as one row each, so no task holds more than its range.
    """
    p = parallelism(rows.sparkSession)
    ranged = written(rows.repartitionByRange(p, *_asc(*order)).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("range").agg(F.sum(size).alias("s"), F.count("*").alias("c"))
    ranges = ranges.select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    own = Window.partitionBy("range").orderBy(*_asc(*order))
    joined = ranged.join(F.broadcast(ranges), "range")  # one row for each shuffle partition
    return joined.select(*rows.columns, (F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("s0")).alias("run"), (F.row_number().over(own) - 1 + F.col("c0")).alias("place"))


class Boundaries:
    """Group ends in cells: each cell's least and largest end are known; a cell of one end, or touched by no guess, stays as it is."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.shift = max(0, total.bit_length() - _CELL_BITS)
        self.cells = {}  # least end: (largest end, shift, cell)
        self._look(self.shift, None, None)

    def _look(self, shift: int, coarse: int | None, cells: list[int] | None) -> None:
        rows = self.ends if cells is None else self.ends.where(F.shiftright("end", coarse).isin(cells))
        for r in rows.groupBy(F.shiftright("end", shift).alias("cell")).agg(F.min("end").alias("a"), F.max("end").alias("b")).collect():
            self.cells[r["a"]] = (r["b"], shift, r["cell"])
        self.least = sorted(self.cells)

    def at_most(self, x: int) -> tuple[int, int]:
        """Bounds of the largest end that is x at most; 0 if none is."""
        i = bisect_right(self.least, x) - 1
        if i < 0:
            return 0, 0
        a = self.least[i]
        b = self.cells[a][0]
        return (b, b) if b <= x else (a, x)

    def after(self, x: int) -> tuple[int, int]:
        """Bounds of the least end above x; the total if none is."""
        i = bisect_right(self.least, x) - 1
        if i >= 0 and self.cells[self.least[i]][0] > x:
            return x + 1, self.cells[self.least[i]][0]
        end = self.least[i + 1] if i + 1 < len(self.least) else self.total
        return end, end

    def exact(self, look: Callable[[int], tuple[int, int]], x: int) -> int:
        while (found := look(x))[0] != found[1]:
            self.refine([(x, x)])
        return found[0]

    def greedy(self, level: int, shards: int, lo: int, hi: int) -> list[tuple[int, int]]:
        """Cuts between two ends, each shard filled up to the level; a group above the level stands alone."""
        cuts, low, high = [], lo, lo
        for _ in range(shards):
            low = min(hi, max(self.at_most(low + level)[0], self.after(low)[0]))
            high = min(hi, max(self.at_most(high + level)[1], self.after(high)[1]))
            cuts.append((low, high))
        return cuts

    def refine(self, spans: list[tuple[int, int]]) -> None:
        """Splits every cell that a look-up within these spans may end in."""
        by_shift: dict[int, list[int]] = {}
        for lo, hi in spans:
            for a in self.least[max(0, bisect_right(self.least, lo) - 1) : bisect_right(self.least, hi)]:
                if a in self.cells and a < self.cells[a][0]:
                    _, shift, cell = self.cells.pop(a)
                    by_shift.setdefault(shift, []).append(cell)
        for shift, cells in by_shift.items():
            self._look(max(0, shift - _ZOOM_BITS), shift, cells)
        self.least = sorted(self.cells)

    def least_level(self, shards: int, lo: int, hi: int) -> tuple[int, list[int]]:
        """The smallest level at which the groups between two ends fit into the shards, and where the greedy check cuts."""

        def first(a: int, b: int, good) -> int:
            while a < b:
                mid = (a + b) // 2
                a, b = (a, mid) if good(mid) else (mid + 1, b)
            return a

        while True:
            surely = first(1, max(1, hi - lo), lambda c: self.greedy(c, shards, lo, hi)[-1][0] >= hi)
            maybe = first(1, surely, lambda c: self.greedy(c, shards, lo, hi)[-1][1] >= hi)
            low, high = self.greedy(maybe, shards, lo, hi), self.greedy(surely, shards, lo, hi)
            if maybe == surely and all(a == b for a, b in low):
                return surely, [a for a, _ in low]
            spans = [(a, b) for (a, _), (_, b) in zip([(lo, lo), *low], [(lo, lo), *high], strict=True)]
            self.refine([*spans, *((a + maybe, b + surely) for a, b in spans)])

    def even(self, shards: int, lo: int, hi: int) -> list[int]:
        """The ends that are next below equal steps between two ends."""
        steps = [lo + (hi - lo) * i // shards for i in range(1, shards)]
        while any(a != b for a, b in map(self.at_most, steps)):
            self.refine([(x, x) for x in steps])
        return [*(max(lo, self.at_most(x)[0]) for x in steps), hi]

    def cuts(self, shards: int) -> list[int]:
        """Ends of the shards: the largest is as small as possible, and those without a group above the level are near equal.

        What lies between groups above the level is cut again, in equal steps or
        at its own smallest level, whichever leaves the fuller least shard; shards
        that are left halve the largest of several groups.
        """
        level, cuts = self.least_level(shards, 0, self.total)
        parts = _parts(0, cuts)
        most = max((b - a for a, b in parts), default=0)
        if most > level:
            again = []
            for alone, run in groupby(parts, lambda p: p[1] - p[0] > level):
                run = list(run)
                if not alone:
                    n, lo, hi = len(run), run[0][0], run[-1][1]
                    ways = [_parts(lo, self.least_level(n, lo, hi)[1]), _parts(lo, self.even(n, lo, hi))]
                    run = max((w for w in ways if max(b - a for a, b in w) <= most), key=lambda w: (len(w), min(b - a for a, b in w)))
                again += run
            parts = again
        done, heap = [], [(a - b, a, b) for a, b in parts]
        heapify(heap)
        while heap and len(done) + len(heap) < shards:
            _, a, b = heappop(heap)
            before = self.exact(self.at_most, (a + b) // 2)
            ends = [e for e in (before, self.exact(self.after, max(a, before))) if a < e < b]
            if ends:
                cut = min(ends, key=lambda e: max(e - a, b - e))
                heappush(heap, (a - cut, a, cut))
                heappush(heap, (cut - b, cut, b))
            else:
                done.append(b)  # one group
        ends = sorted([*done, *(b for _, _, b in heap)])
        return ends + [self.total] * (shards - len(ends))


def _parts(lo: int, cuts: list[int]) -> list[tuple[int, int]]:
    return [(a, b) for a, b in pairwise([lo, *cuts]) if a < b]


def assign(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text).

    size: UTF-8 bytes of the text (null: none) plus `overhead`.  Rows of equal
    text are one atomic group.  Groups stand in the order of a digest of their
    text, rows of a group by doc_id (nulls first), and shards are contiguous in
    that order, with the smallest possible largest shard; a group larger than
    its share stands alone and the other shards are near equal.  slot: place in
    the shard, from 0, without gaps.  A null text is grouped with the empty one.
    Repeated rows each get a slot.  Shards are empty only where there are
    fewer groups; an empty table gives no rows.  Other columns are
    not looked at.
    """
    text = text_or_empty("text")
    rows = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 32).alias("group"))
    placed = written(running(written(rows), ["group", "doc_id"], "size"))
    ends = written(placed.groupBy("group").agg(F.max("run").alias("end")).select("end"))
    total = ends.agg(F.max("end")).first()[0]
    empty = placed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if total is None:
        return empty
    cuts = Boundaries(ends, total).cuts(shards)
    shard = F.size(F.filter(F.lit(cuts[:-1]).cast("array<long>"), lambda c: c < F.col("run"))) if shards > 1 else F.lit(0)
    cut = placed.withColumn("shard", shard)
    starts = cut.groupBy("shard").agg(F.min("place").alias("start"))
    out = cut.join(F.broadcast(starts), "shard")  # one row for each shard
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot"))

