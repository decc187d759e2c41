"""Benchmark decontamination: a full-text index per training shard, searched backward for test phrases.

Each shard's words form one sequence over the phrases' vocabulary (words that no
phrase has, and runs of words too short for any phrase, are one break symbol).
Its suffix array gives the Burrows-Wheeler transform; ranks in a wavelet matrix
drive the backward search of all phrases at once; sampled suffix positions
locate the occurrences, whose word ranges are merged into spans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.text import ALNUM, Texts, discard, slices, trimmed, written

#: Phrase texts searched at once; more are searched in further passes over each shard's rows.
BLOCK_BYTES = 16 << 20
#: Bytes of text in one shard's index; arrays over them take some 60 bytes of memory for each.
SHARD_BYTES = 1 << 20
_SAMPLE = 8
_TERMINAL, _BREAK = 0, 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t by prefix doubling; only groups that are still tied are sorted again."""
    n = len(t)
    bits = max(1, int(n).bit_length())
    word = max(1, int(t.max()).bit_length()) if n else 1
    # as many leading symbols as fit beside a place into 64 bits
    k = max(1, min(3, (64 - bits) // word))
    key = np.zeros(n, np.uint64)
    for j in range(k):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - j] = t[j:]
        key = key << np.uint64(word) | shifted
    if k * word + bits <= 64:
        both = np.sort(key << np.uint64(bits) | np.arange(n, dtype=np.uint64))
        sa = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
        lead = both >> np.uint64(bits)
    else:
        sa = np.argsort(key, kind="stable")
        lead = key[sa]
    new = np.ones(n, bool)
    new[1:] = lead[1:] != lead[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = head, -1
    slots = np.arange(n)
    while True:
        last = np.append(new[1:], True)
        slots = slots[~(new & last)]
        if not len(slots):
            return sa
        at = sa[slots]
        a, b = rank[at], rank[np.minimum(at + k, n)] + 1
        order = np.lexsort((b, a)) if len(at) < 4096 or 3 * bits + 1 > 64 else None
        if order is None:
            both = np.sort((a.astype(np.uint64) << np.uint64(2 * bits)) | (b.astype(np.uint64) << np.uint64(bits)) | np.arange(len(at), dtype=np.uint64))
            order = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
        a, b, at = a[order], b[order], at[order]
        sa[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        k *= 2


class WaveletMatrix:
    """Ranks of symbols: how often c stands before place i, for arrays of c and i."""

    def __init__(self, x: np.ndarray, bits: int):
        self.ones, self.zeros, self.bits = [], [], bits
        for level in range(bits - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(x) - int(self.ones[-1][-1]))
            x = np.concatenate([x[~bit], x[bit]])
        c = np.arange(1 << bits)
        self.base = self._down(c, np.zeros_like(c))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            before = ones[i]
            i = np.where(c >> level & 1, zeros + before, i - before)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.base[c]


class FMIndex:
    """Index of a sequence of symbols from 1 up; symbol 0 ends it."""

    def __init__(self, t: np.ndarray, symbols: int):
        t = np.append(t, _TERMINAL)
        sa = suffix_array(t)
        self.bwt = t[sa - 1]
        self.wavelet = WaveletMatrix(self.bwt, max(1, (symbols - 1).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))])
        marked = sa % _SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.below[c] + self.wavelet.rank(c, i)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern; one pattern per row of a matrix."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt))
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            lo[alive], hi[alive] = self.step(c, lo[alive]), self.step(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        dead = np.ones(len(patterns), bool)
        dead[alive] = False
        hi[dead] = lo[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows: back through the text to the next sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            left = left[self.marks[rows[left] + 1] == self.marks[rows[left]]]
            rows[left] = self.step(self.bwt[rows[left]], rows[left])
            steps[left] += 1
        return self.samples[self.marks[rows]] + steps


class Phrases:
    """Windows of the items' words, as symbols of their vocabulary, by window length."""

    def __init__(self, ids: list[str], texts: list[str | None], length: int):
        words = Texts(pa.array(texts, pa.string())).words(ALNUM, fold=True)
        hashes = np.sort(words.hash)
        self.vocabulary = hashes[np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]]
        symbol = np.searchsorted(self.vocabulary, words.hash).astype(np.int32) + 2
        n = words.last - words.first
        self.ids, self.by_length, self.count = np.array(ids, object), {}, 0
        phrase, item = [], []
        for m in sorted({min(length, x) for x in n.tolist() if x}):
            own = np.flatnonzero(n == m if m < length else n >= m)
            windows = n[own] - m + 1
            of = np.repeat(own, windows)
            at = words.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
            rows = symbol[at[:, None] + np.arange(m)]
            order = np.lexsort(rows.T[::-1])
            new = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(1))
            which = np.cumsum(new) - 1 + self.count
            self.by_length[m] = np.arange(self.count, which[-1] + 1), rows[order[new]].astype(np.int64)
            phrase.append(which)
            item.append(of[order])
            self.count = int(which[-1]) + 1
        phrase, item = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (phrase, item))
        self.holders = item[np.lexsort((item, phrase))]
        self.edge = np.concatenate([[0], np.cumsum(np.bincount(phrase, minlength=self.count))])
        self.shortest = min(self.by_length, default=0)

    def items_of(self, phrase: int) -> set[str]:
        return set(self.ids[self.holders[self.edge[phrase] : self.edge[phrase + 1]]])

    def occurrences(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first word, words) of each occurrence in a shard's words; first: where its texts begin."""
        none = np.zeros(0, np.int64)
        if not self.by_length or not len(hashes):
            return none, none, none
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes
        edge = np.zeros(len(hashes) + 1, bool)
        edge[first] = True
        place = np.flatnonzero(known)
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) > 1) | edge[place[1:]]
        run = np.cumsum(new) - 1
        keep = np.bincount(run, minlength=1)[run] >= self.shortest if len(run) else run.astype(bool)
        place, new = place[keep], new[keep]
        if not len(place):
            return none, none, none
        to = np.arange(len(place)) + np.cumsum(new)  # a break before each run
        t = np.full(to[-1] + 2, _BREAK, np.int64)
        t[to] = at[place] + 2
        word = np.zeros(len(t) + 1, np.int64)
        word[to] = place
        index = FMIndex(t, len(self.vocabulary) + 2)
        out = []
        for m, (which, patterns) in self.by_length.items():
            lo, hi = index.search(patterns)
            n = hi - lo
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out.append((np.repeat(which, n), word[index.locate(rows)], np.full(len(rows), m)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def mark(docs: DataFrame, items: DataFrame, length: int = 10, text: str = "text", out: str = "hit") -> DataFrame:
    """Adds to docs a struct column `out`: n_words, spans, items, clean.

    A word is a run of letters and digits: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after
    lower-casing A-Z.  A phrase is `length` words in a row of an item's text, or
    all its words if they are fewer.  spans: merged word ranges [from, to) that
    occurrences of phrases cover; items: ids, as sorted strings, of the items
    with an occurring phrase; clean: the text without the spans.

    docs keeps its columns, whatever their names; a column named `out` is
    replaced.  Null text has no words and stays null in clean.  Items without
    id, text or words match nothing; repeated items count once.  Without items
    or documents the result has no spans or no rows.  The items are read in
    blocks of about BLOCK_BYTES of text, so their number isn't bounded; each
    block is a pass over the documents, which are written in between.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    kind = pa.struct([("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string())), ("clean", pa.string())])
    frame = docs.drop(out)
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    hit = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(StructType([StructField("from", LongType()), StructField("to", LongType())]))), StructField("items", ArrayType(StringType())), StructField("clean", StringType())])
    schema = StructType([*frame.schema.fields, StructField(out, hit)])
    spark = docs.sparkSession
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES
        phrases = spark.sparkContext.broadcast(Phrases([r[0] for r in rows], [r[1] for r in rows], length))

        def passed(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text, SHARD_BYTES):
                    hits = _mark(part, text, out, phrases.value, kind)
                    columns = [part.column(n) for n in part.schema.names if n != out]
                    names = [n for n in part.schema.names if n != out]
                    yield pa.RecordBatch.from_arrays([*columns, hits], [*names, out])
                trimmed()

        done, frame = frame, frame.mapInArrow(passed, schema)
        if b < blocks - 1:
            frame = written(frame)  # else the passes would all run at once in each task
            if b:
                discard(done)
    return frame


def _mark(part: pa.RecordBatch, text: str, out: str, phrases: Phrases, kind: pa.DataType) -> pa.Array:
    texts = Texts(part[text])
    words = texts.words(ALNUM, fold=True)
    which, at, size = phrases.occurrences(words.hash, words.first)
    doc = np.searchsorted(words.first, at, "right") - 1
    n, clean = (words.last - words.first).tolist(), part[text].to_pylist() if len(doc) else None
    spans: list[list] = [[] for _ in n]
    items: list[set] = [set() for _ in n]
    if out in part.schema.names:  # what earlier blocks have found
        for i, x in enumerate(part[out].to_pylist()):
            spans[i] = [(s["from"], s["to"]) for s in x["spans"]]
            items[i] = set(x["items"])
        clean = part[text].to_pylist()
    if clean is None:
        empty = pa.array([[]] * len(n), kind.field("spans").type)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), empty, pa.array([[]] * len(n), pa.list_(pa.string())), part[text].cast(pa.string())], fields=list(kind))
    first = words.first[doc]
    for d, a, b in {(d, a, b) for d, a, b in zip(doc.tolist(), (at - first).tolist(), (at - first + size).tolist(), strict=True)}:
        spans[d].append((a, b))
    for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
        items[d] |= phrases.items_of(w)
    for i, own in enumerate(spans):
        if own:
            spans[i] = own = _merge(own)
            f, s = int(words.first[i]), int(texts.start[i])
            raw, done, kept = clean[i].encode(), 0, []
            for a, b in own:
                kept.append(raw[done : int(words.start[f + a]) - s])
                done = int(words.end[f + b - 1]) - s
            clean[i] = b"".join([*kept, raw[done:]]).decode()
    rows = [{"n_words": w, "spans": [{"from": a, "to": b} for a, b in s], "items": sorted(x), "clean": c} for w, s, x, c in zip(n, spans, items, clean, strict=True)]
    return pa.array(rows, kind)
