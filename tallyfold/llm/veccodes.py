"""Vector codes: product quantisation in whole numbers, with memoised grid cells.

Each part of a vector falls into a coarse cell of a grid.  What the cell's box
says about the codebook's entries is worked out once and kept: an entry is
dominated if, all across the box, the one nearest to the box's centre is
strictly nearer (the least difference of the two distances over the box is above
0).  A part is compared exactly with the entries of its cell that are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.text import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Side of a cell, a power of two.
CELL = 32
#: Cells that a task keeps for each part; beyond, it starts afresh.
KEPT_CELLS = 100_000
#: Pairs of a part and an entry that are compared at once.
_AT_ONCE = 1 << 19


class Cells:
    """The entries of one codebook that can be nearest to something in a cell, by cell."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.memo = entries, {}
        self.apart = np.abs(entries[:, None, :] - entries[None, :, :]).sum(2)

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Ascending entries for each cell (rows of whole numbers)."""
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.memo]
        for a in range(0, len(new), 4096):
            some = new[a : a + 4096]
            middle = cells[some] * (2 * CELL) + (CELL - 1)  # twice the centre, whole
            far = ((2 * self.entries) ** 2).sum(1)[None, :] - 2 * (middle @ (2 * self.entries).T)  # 4 * distance to the centre, less what all share
            best = far.argmin(1)
            # moving CELL / 2 along each axis changes the difference of two distances by CELL * |e - f| at most
            left = far - far[np.arange(len(some)), best][:, None] <= 4 * (CELL - 1) * self.apart[best]
            for i, row in zip(some, left, strict=True):
                self.memo[keys[i]] = np.flatnonzero(row)
        out = [self.memo[k] for k in keys]
        if len(self.memo) > KEPT_CELLS:
            self.memo.clear()
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry nearest to each row of x, of equal ones the first, and its squared distance."""
        rows = np.ascontiguousarray(x // CELL)
        cells, of = np.unique(rows.view(f"V{rows.shape[1] * 8}").ravel(), return_inverse=True)
        lists = self.candidates(cells.view(np.int64).reshape(-1, rows.shape[1]))
        size = np.array([len(c) for c in lists])
        first, flat = np.cumsum(size) - size, np.concatenate(lists)
        own = size[of]
        entry, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        part = (np.cumsum(own) - 1) // _AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(x)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            n = own[a:b]
            at = np.cumsum(n) - n
            row = np.repeat(np.arange(a, b), n)
            e = flat[np.repeat(first[of[a:b]] - at, n) + np.arange(len(row))]
            gap = x[row] - self.entries[e]
            both = np.minimum.reduceat(np.einsum("pd,pd->p", gap, gap) * ENTRIES + e, at)
            entry[a:b], far[a:b] = both % ENTRIES, both // ENTRIES
        return entry, far


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def quantised(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, c (whole components) of the rows that can be coded; see encode()."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    rows = vectors.where(x.isNotNull() & F.forall(x, finite)).select("vec_id", "label", whole.alias("c"))
    return rows.where((F.size("c") > 0) & (F.size("c") % parts == 0))


def trained(rows: DataFrame, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, place) after the rounds; None without rows.  rows: a written table of vec_id, c."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "c").select("c").limit(ENTRIES).collect()
    if not first:
        return None
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    spark, (_, k, width) = rows.sparkSession, books.shape
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cells = [Cells(b) for b in shared.value]
            total, count = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch["c"]).reshape(len(batch), parts, width)
                for p in range(parts):
                    entry, _ = cells[p].nearest(np.ascontiguousarray(x[:, p]))
                    order = np.argsort(entry, kind="stable")
                    used, at = np.unique(entry[order], return_index=True)
                    total[p * k + used] += np.add.reduceat(x[order, p], at)
                    count[p * k + used] += np.diff(np.append(at, len(order)))
            used = np.flatnonzero(count)
            both = np.concatenate([count[used, None], total[used]], 1)
            places = np.repeat(used * (width + 1), width + 1) + np.tile(np.arange(width + 1), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(both.ravel())], ["place", "n"])

        got = rows.select("c").mapInArrow(sums, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
        flat = np.zeros(parts * k * (width + 1), np.int64)
        for r in got.collect():  # a row for each number of the codebooks at most
            flat[r["place"]] = r["n"]
        flat = flat.reshape(parts, k, width + 1)
        used = flat[:, :, 0] > 0
        books[used] = flat[used][:, 1:] // flat[used][:, :1]
        shared.unpersist()
    return books


def encode(vectors: DataFrame, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row of vectors (vec_id, embedding, label) that can be coded.

    Component x counts as floor(SCALE * x); vectors are cut into `parts` equal
    parts.  Each part's codebook starts as that part of the ENTRIES least
    vec_ids (rows of one vec_id in the order of their components, null last) and
    is replaced `rounds` times by the rounded-down means of what is nearest to
    each entry.  code: two hex digits a part; error: squared distances to the
    entries, summed; label_error: errors of all rows of the label (of all null
    ones for null); codebooks_sha256: of the final entries' numbers, joined by
    commas.

    Rows whose vector is null, or has null or non-finite components, go; so do
    vectors that are empty, can't be cut equally, or aren't as long as the first
    row's.  Null vec_ids stay null.  Repeated rows are so many vectors, other
    columns aren't looked at, and an empty table gives none.  Sums hold for
    components up to 2**14 in size.
    """
    spark = vectors.sparkSession
    empty = "vec_id long, label int, code string, error long"
    rows = quantised(vectors, parts)
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "c").select(F.size("c")).first()
    rows = written(rows.where(F.size("c") == (head[0] if head else 0)))
    books = trained(rows, parts, rounds)
    if books is None:
        return spark.createDataFrame([], empty).select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in shared.value]
        for batch in batches:
            if len(batch):
                x = _matrix(batch["c"]).reshape(len(batch), parts, -1)
                found = [cells[p].nearest(np.ascontiguousarray(x[:, p])) for p in range(parts)]
                code = np.stack([e for e, _ in found], 1).astype(np.uint8)
                error = sum(d for _, d in found)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes().hex() for c in code]), pa.array(error)], ["vec_id", "label", "code", "error"])

    out = written(rows.mapInArrow(coded, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"))
    of_label = out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return out.join(of_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
