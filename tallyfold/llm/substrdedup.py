"""Substring dedup over words by seed and extend.

Winnowed anchors join documents in ranges of their seeds; there, matches are
extended both ways by comparing neighbours in the order of the words behind and
before the seed (see repeats.Search), and windows inside a maximal repeat of
`length` words or more are marked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.repeats import KEY_BYTES, Search, Units, covered
from tallyfold.llm.text import PLAIN, Texts, U, combine


def rolling(x: np.ndarray, n: int, pick=np.minimum) -> np.ndarray:
    """Least (or by pick) of the n elements from each place on, by doubling; shorter by n - 1."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def winnowed(seeds: np.ndarray, first: np.ndarray, last: np.ndarray, span: int, length: int) -> np.ndarray:
    """Places whose seed hash is the least among some span seeds in a row, all within one window of a text."""
    if len(seeds) < span:
        return np.zeros(0, np.int64)
    least = rolling(seeds, span)
    inside = np.zeros(len(least) + 1, np.int32)
    long = last - first >= length
    np.add.at(inside, first[long], 1)
    np.add.at(inside, np.minimum(last[long] - length + 1, len(least)), -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, U(0))
    padded = np.concatenate([np.zeros(span - 1, U), least, np.zeros(span - 1, U)])
    return np.flatnonzero((rolling(padded, span, np.maximum) == seeds) & (seeds > 0))


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """Marks words covered by a run of `length` words that also starts earlier in the corpus.

    docs: doc_id (long) and text; other columns are not looked at.  Words are runs
    of anything but blank, tab, line feed, vertical tab, form feed and carriage
    return.  Earlier: in a smaller doc_id, or at an earlier place of the same
    document.  Judged on the input, not on what is left.  Matches are kept as
    windows of the maximal repeats, which cover the same words.

    Returns doc_id, n_words, removed (spans of word places [from, to)), kept (the
    other words joined by one blank).  Null and empty texts have no words.
    Rows that repeat a doc_id are compared by the place in their text alone, so
    the same words at the same place of both stay in both.  Rows of null doc_id
    count as one smallest id.  An empty table gives none.  Words are compared as
    64-bit hashes.
    """
    span = length // 2 + 1
    seed = length - span + 1

    def read(table: pa.Table) -> Units:
        words = Texts(table["text"]).words(PLAIN, fold=False)
        units = Units(words.hash, words.hash, words.first, words.last, length)
        seeds = units.hashes(seed)
        at = winnowed(seeds, words.first, words.last, span, length)
        return units.anchored(at, seeds[at], length - seed)

    def finish(units: Units, table: pa.Table, done: np.ndarray) -> pa.Table:
        gone = covered(done, length)
        texts = table["text"].to_pylist()
        total = np.concatenate([[0], np.cumsum(gone)])
        spans, kept = [], []
        for text, f, t in zip(texts, units.first.tolist(), units.last.tolist(), strict=True):
            own = gone[f:t]
            if total[t] == total[f]:
                spans.append([])
                kept.append(" ".join(split(text)))
                continue
            cut = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            spans.append([{"from": int(a), "to": int(b)} for a, b in cut.reshape(-1, 2)])
            kept.append(" ".join(w for w, g in zip(split(text), own.tolist(), strict=True) if not g))
        return pa.table({"doc_id": table["real_id"], "n_words": pa.array(units.last - units.first, pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), "kept": pa.array(kept, pa.string())})

    def key(reach: np.ndarray) -> np.ndarray:
        """A hash of each anchor's seed, which spreads common first words."""
        out = np.zeros((len(reach), KEY_BYTES // 8), ">u8")
        out[:, 0] = combine(*(reach[:, length - seed + j].copy() for j in range(seed)))
        return out.view(f"S{KEY_BYTES}").ravel()

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").alias("real_id"), "text")
    return Search(rows, read, key, within=True).windows(finish, "doc_id long, n_words long, removed array<struct<from:long,to:long>>, kept string")


_SPACE = str.maketrans({c: " " for c in "\t\n\v\f\r"})


def split(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_SPACE).split(" ") if w]
