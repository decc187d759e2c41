"""Vectorised helpers on whole texts inside Spark tasks (numpy over Arrow batches).

A batch of texts is one byte array, each text followed by a newline, so a word
never runs from one text into the next.  Hashes are 64 bits: a byte polynomial
modulo 2**64 over a random byte table, then an avalanche step.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Odd multipliers, one for each place of a combined hash.
MUL = tuple(U(x | 1) for x in np.random.default_rng(20240611).integers(0, 2**63, 64, dtype=np.uint64) * U(2))
_BYTE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32

#: Bytes of a word as [^\x20\x09-\x0D]+ and, after lower-casing A-Z,
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (an upper-case letter counts as its lower one).
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step; changes its argument in place."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA24BAED4963EE407)
    x ^= x >> U(32)
    return x


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash for each place of equally long hash arrays, order counts."""
    out = parts[0] * MUL[0]
    for m, p in zip(MUL[1:], parts[1:], strict=False):
        out += p * m
    return mix(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's base and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, U)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["up"], _powers["down"]


class Texts:
    """A batch of texts as one byte array; text i is data[start[i]:end[i]], without the newline behind it."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        joined = pc.binary_join_element_wise(filled, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
        if isinstance(joined, pa.ChunkedArray):
            joined = joined.combine_chunks()
        _, offsets, data = joined.buffers()
        at = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        self.start, self.end = at[:-1], at[1:] - 1

    def __len__(self) -> int:
        return len(self.start)

    def words(self, kind: np.ndarray, fold: bool) -> Words:
        return Words(self, kind, fold)


class Words:
    """Words of a batch: byte ranges and hashes; text i has words first[i]:last[i]."""

    def __init__(self, texts: Texts, kind: np.ndarray, fold: bool):
        data = texts.data
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = kind[data]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        up, down = powers(len(data) + 1)
        table = _BYTE[_FOLDED] if fold else _BYTE
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(table[data] * up[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, texts.start)
        self.last = np.searchsorted(self.start, texts.end)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n elements from each place on, by doubling; shorter by n - 1."""
    if n == 1:
        return h
    half = grams(h, n // 2)
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, U)
    if n % 2 == 0:
        return combine(half[:k], half[n // 2 : n // 2 + k])
    return combine(half[:k], half[n // 2 : n // 2 + k], h[n - 1 : n - 1 + k])


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; on one machine, as in tests, a local one where it is unset."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession) -> str:
    """An unused path in the application's folder below the shared checkpoint folder; the folder goes when the driver ends."""
    import uuid

    folder = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{folder}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of Parquet files in the shared checkpoint folder."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes the files of a written() table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(result=None):
    """Gives memory that this Python worker no longer uses back to the machine; returns its argument."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # where the C library has it
        libc.malloc_trim(0)
    return result


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = {"lock": threading.Lock(), "users": 0, "before": "false"}


@contextmanager
def shuffle_files_cleaned(spark: SparkSession):
    """Jobs within remove their shuffle files when they end; what they leave is in written tables.

    The setting is put back when the last of several threads leaves.
    """
    with _cleaning["lock"]:
        if not _cleaning["users"]:
            _cleaning["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _cleaning["users"] += 1
    try:
        yield
    finally:
        with _cleaning["lock"]:
            _cleaning["users"] -= 1
            if not _cleaning["users"]:
                spark.conf.set(_CLEANUP, _cleaning["before"])


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name, with as many underscores added as keep it apart from the columns."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def slices(batch: pa.RecordBatch | pa.Table, text: str, size: int = 4 << 20):
    """Runs of rows of about `size` bytes of text, one row at least, so that arrays over bytes stay small."""
    lengths = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


FILTER_BITS = 1 << 22


def likely_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among the wanted ones (a column of that name), and a few others; no row is shuffled.

    The wanted keys become a bit table of fixed size, FILTER_BITS / 64 rows at
    most, which is broadcast.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(`{key}`), {FILTER_BITS}), 64) as int))")
    table = wanted.groupBy(F.floor(place / 64).cast("int").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    hit = rows.withColumn("_word", F.floor(place / 64).cast("int")).join(F.broadcast(written(table)), "_word")
    return hit.where(F.call_function("getbit", F.col("_bits"), F.pmod(place, F.lit(64)).cast("int")) == 1).drop("_word", "_bits")
