"""Suffix-array dedup over bytes by a difference cover: sampled suffixes are sorted, the others merged by them, neighbours compared.

The cover's places are the anchors of repeats.Search: suffixes at sampled places
are sorted in ranges by triples of eight bytes, whose names are recursed on
while they tie; a suffix that starts some bytes before a sample is ordered by
those bytes and the sample's name; equal neighbours of `length` bytes are told
by the prefixes that neighbours have in common.  Order beyond `length` bytes
isn't needed and isn't made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.repeats import KEY_BYTES, Search, Units, covered
from tallyfold.llm.text import _BYTE, Texts

#: A perfect difference set: every difference modulo 21 is that of two members.
PERIOD, COVER = 21, np.array([0, 1, 6, 8, 18])


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """Marks bytes covered by a `length`-byte string that also starts in a document with a smaller doc_id.

    Sampled suffixes are those at places that a difference cover of the text
    selects: any two equal strings of `length` bytes have a sampled place at one
    common offset.  Equality is that of bytes.

    docs: doc_id (long) and text, taken as UTF-8; null counts as empty.  Strings
    do not cross documents.  Judged on the input, not on what is left.
    Returns doc_id, n_bytes, removed (spans of byte places [from, to)), kept (the
    other bytes, as binary).  Repeated rows of one doc_id have no smaller id
    among them.  Rows of null doc_id count as the smallest id.  An empty table
    gives none.
    """
    if length < 2 * PERIOD:
        raise ValueError(f"length must be {2 * PERIOD} at least")
    seed = length - PERIOD + 1

    def read(table: pa.Table) -> Units:
        texts = Texts(table["text"])
        size = np.maximum(texts.end - texts.start - seed + 1, 0)
        # the sampled places of all texts: whole periods first, then those past the end are dropped
        blocks = -(-size // PERIOD)
        block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = ((np.repeat(texts.start, blocks) + block * PERIOD)[:, None] + COVER).ravel()
        at = at[at < np.repeat(texts.start + size, blocks * len(COVER))]
        units = Units(texts.data, _BYTE[texts.data], texts.start, texts.end, length)
        return units.anchored(at, units.hash(at, seed), length - seed)

    def finish(units: Units, table: pa.Table, done: np.ndarray) -> pa.Table:
        data, gone = units.raw, covered(done, length)
        total = np.concatenate([[0], np.cumsum(gone)])
        spans, kept = [], []
        for f, t in zip(units.first.tolist(), units.last.tolist(), strict=True):
            if total[t] == total[f]:
                spans.append([])
                kept.append(data[f:t].tobytes())
                continue
            own = gone[f:t]
            cut = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            spans.append([{"from": int(a), "to": int(b)} for a, b in cut.reshape(-1, 2)])
            kept.append(data[f:t][~own].tobytes())
        return pa.table({"doc_id": table["real_id"], "n_bytes": pa.array(units.last - units.first, pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    def key(reach: np.ndarray) -> np.ndarray:
        """The first triple behind each anchor."""
        at = length - seed
        return np.ascontiguousarray(reach[:, at : at + KEY_BYTES]).view(f"S{KEY_BYTES}").ravel()

    def ends(ranges: int, size: int) -> np.ndarray:
        """Ends of ranges of triples, from some 32 places for each range: one in so many bytes of every text, the first by the text's hash."""
        step = max(1, size // (32 * ranges))
        raw = docs.select(F.col("text").cast("binary").alias("raw"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)).alias("first"))
        some = raw.where(F.col("first") <= F.octet_length("raw") - KEY_BYTES)
        places = F.sequence(F.col("first"), (F.octet_length("raw") - KEY_BYTES).cast("long"), F.lit(step).cast("long"))
        pieces = some.select(F.explode(F.transform(places, lambda at: F.substring("raw", at.cast("int") + 1, F.lit(KEY_BYTES)))).alias("piece"))
        found = np.sort(np.array([bytes(r["piece"]) for r in pieces.collect()], f"S{KEY_BYTES}"))
        return found[np.arange(1, ranges) * len(found) // ranges] if len(found) else np.zeros(max(0, ranges - 1), f"S{KEY_BYTES}")

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").alias("real_id"), "text")
    return Search(rows, read, key, within=False, ends=ends).windows(finish, "doc_id long, n_bytes long, removed array<struct<from:long,to:long>>, kept binary")
