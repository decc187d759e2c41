"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where their boundaries meet, encoded in pieces."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.text import parallelism, trimmed, unused

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024


@functools.lru_cache(4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(4)
def _regex(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str, final: bool) -> list[int]:
    """Where pre-tokens of a chunk begin; without the last two unless the text ends there, as what follows may change them."""
    at = [m.start() for m in _regex(pattern).finditer(text)]
    return at if final else at[:-2]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, decoded: str | None = None) -> DataFrame:
    """Adds a binary column `out`: token ids as little-endian unsigned 32-bit integers; and one named `decoded`, if given: what decode() makes of them, in the same pass.

    path: a file of base64 tokens with their ranks, there on each machine;
    pattern: what splits a text into pre-tokens, none longer in what it looks at
    than the text that follows.  No special tokens.  docs keeps its columns,
    whatever their names; those named `out` or `decoded` are replaced.  Null and empty texts
    have no ids.  Texts of more than `chunk` characters become overlapping
    chunks in rows of their own; two neighbours are cut at the first boundary
    that both have in their overlap, and joined where they have none.  Repeated
    long texts are encoded once.  An empty table gives none.
    """
    spark = docs.sparkSession
    p = parallelism(spark)
    outs = [out] if decoded is None else [out, decoded]
    docs = docs.drop(*outs)
    whole = F.coalesce(F.col(text), F.lit(""))

    def with_ids(part: pa.RecordBatch, keep: list[str], ids: list[bytes], names: list[str]) -> pa.RecordBatch:
        found = [ids] if len(names) == 1 else [ids, raw_bytes(encoding(path, pattern), ids)]
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *(pa.array(x, pa.binary()) for x in found)], [*keep, *names])

    def encoded(batches: Iterator[pa.RecordBatch], column: str, keep: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                ids = [enc.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() if t else b"" for t in part[column].to_pylist()]
                yield with_ids(part, keep, ids, names)
            trimmed()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Overlapping chunks of each text, one pass over it."""
        for batch in batches:
            for key, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for first in range(0, len(t), 64 * chunk):
                    at = list(range(first, min(len(t), first + 64 * chunk), chunk))
                    columns = [[key] * len(at), at, [t[a : a + chunk + overlap] for a in at], [a + chunk + overlap >= len(t) for a in at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.bool_()), strict=True)], ["key", "at", "chunk", "final"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for at, t, final in zip(batch["at"].to_pylist(), batch["chunk"].to_pylist(), batch["final"].to_pylist(), strict=True):
                found = boundaries(t, pattern, final)
                heads.append([at + x for x in found if 0 < x < overlap])
                tails.append([at + x for x in found if chunk < x])
            yield pa.RecordBatch.from_arrays([batch["key"], batch["at"], batch["chunk"], pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["key", "at", "chunk", "head", "tail"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole_ids = [b"".join(x["ids"] for x in parts) for parts in batch["parts"].to_pylist()]
            yield with_ids(batch, ["key"], whole_ids, ["ids"] if decoded is None else ["ids", "bytes"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    names = docs.columns
    schema = StructType([*docs.schema.fields, *(StructField(n, BinaryType()) for n in outs)])
    short = docs.where(F.length(whole) <= chunk).mapInArrow(lambda b: encoded(b, text, names, outs), schema)
    longs = docs.where(F.length(whole) > chunk)
    texts = longs.select(F.sha2(F.encode(text, "utf-8"), 256).alias("key"), F.col(text).alias("text")).repartition(p, "key").dropDuplicates(["key"])
    chunks = texts.mapInArrow(cut, "key string, at int, chunk string, final boolean")
    marks = chunks.repartition(p, "key", "at").mapInArrow(split, "key string, at int, chunk string, head array<int>, tail array<int>")
    of = Window.partitionBy("key").orderBy("at")
    # from the cut with the chunk before, or the chunk's own start, up to the cut with the next one, or its start
    marks = marks.withColumn("to", F.array_min(F.array_intersect("tail", F.lead("head").over(of)))).withColumn("from", F.lag("to").over(of))
    more = F.lead("at").over(of).isNotNull()
    marks = marks.withColumn("no", F.sum(F.when(F.col("from").isNotNull(), 1).otherwise(0)).over(of)).withColumn("more", more)
    start = F.coalesce(F.col("from"), F.col("at")) - F.col("at")
    end = F.coalesce(F.col("to") - F.col("at"), F.when(F.col("more"), F.lit(chunk)).otherwise(F.lit(chunk + overlap)))
    pieces = marks.select("key", "no", "at", F.substring(F.col("chunk"), start + 1, end - start).alias("s"))
    pieces = pieces.groupBy("key", "no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), "").alias("piece"))
    ids = pieces.repartition(p, "key", "no").mapInArrow(lambda b: encoded(b, "piece", ["key", "no"], ["ids"]), "key string, no long, ids binary")
    parts = ids.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    key, *found = unused([*docs.columns, *outs], "_key", *(f"_{n}" for n in outs))
    of_key = parts.mapInArrow(joined, "key string, ids binary" + (", bytes binary" if decoded is not None else "")).toDF(key, *found)
    long = longs.withColumn(key, F.sha2(F.encode(text, "utf-8"), 256)).join(of_key, key).select(*(F.col(f"`{c}`") for c in names), *(F.col(f).alias(n) for f, n in zip(found, outs, strict=True)))
    return short.union(long)


def raw_bytes(enc, ids: list[bytes]) -> list[bytes]:
    """The tokens' bytes of each list of ids, one after the other."""
    import numpy as np

    return [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) if x else b"" for x in ids]


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds a binary column `out`: the raw bytes of the ids' tokens, one after the other; null ids give none."""
    rows = rows.drop(out)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                raw = raw_bytes(enc, part[ids].to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, out])
            trimmed()

    from pyspark.sql.types import BinaryType, StructField, StructType

    return rows.mapInArrow(decoded, StructType([*rows.schema.fields, StructField(out, BinaryType())]))
