"""Following ledgers as they grow: ingest with quarantine, incremental chain checks, live status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tallyfold.operators.lineage import kept
from tallyfold.sources.ledger import EVENT, ledger_of, parse, split_strict


def follow_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream of ledger_id and raw."""
    return spark.readStream.text(folder).select(ledger_of(F.col("_metadata.file_path")).alias("ledger_id"), F.col("value").alias("raw")).where("trim(raw) <> ''")


BUCKETS = 64
_bucket = lambda: F.pmod(F.xxhash64("ledger_id"), F.lit(BUCKETS)).cast("int")


def committed(spark: SparkSession, manifest: str) -> list[int]:
    """Epochs that were written whole; a number for each batch."""
    try:
        return sorted(r[0] for r in spark.read.parquet(manifest).select(F.col("epoch").cast("long")).distinct().collect())
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no batch yet
            return []
        raise


#: Columns of the two tables, which are partitioned by epoch and bucket of the ledger.
EVENTS, QUARANTINE = f"ledger_id string, {EVENT}, raw string, epoch long, bucket int", "ledger_id string, raw string, rule string, epoch long, bucket int"


def read_ingested(spark: SparkSession, table: str, manifest: str, columns: str = EVENTS) -> DataFrame:
    """Rows of the events, or with QUARANTINE of the other lines, that committed epochs wrote; what a broken-off batch left is not among them."""
    return spark.read.schema(columns).parquet(table).where(F.col("epoch").isin(committed(spark, manifest))).drop("epoch", "bucket")


def ingest(lines: DataFrame, events: str, quarantine: str, manifest: str, checkpoint: str) -> StreamingQuery:
    """Appends strict events to one table and the other lines to another, each line of a ledger once, in whatever files and batches it comes.

    A batch leaves out what committed epochs hold of its ledgers (it reads the
    ledgers' buckets for that), writes both tables and then its epoch into the
    manifest.  A batch that is repeated after a crash overwrites what it wrote;
    readers go by the manifest (read_ingested).
    """

    def both(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = kept(batch.select("ledger_id", "raw").dropDuplicates(["ledger_id", "raw"]).withColumn("bucket", _bucket()))
        done = [e for e in committed(spark, manifest) if e < epoch]
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
        if done:
            for table, columns in ((events, EVENTS), (quarantine, QUARANTINE)):
                held = spark.read.schema(columns).parquet(table).where(F.col("epoch").isin(done) & F.col("bucket").isin(touched)).select("ledger_id", "raw")
                fresh = fresh.join(held, ["ledger_id", "raw"], "left_anti")
            fresh = kept(fresh)
        good, bad = split_strict(fresh)
        for rows, table in ((parse(good).withColumn("bucket", _bucket()), events), (bad, quarantine)):
            rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "bucket").parquet(table)
        spark.range(1).select(F.col("id").alias("whole")).write.mode("overwrite").parquet(f"{manifest}/epoch={epoch}")

    return lines.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHAIN_OUT = "ledger_id string, sequence long, rule string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChainProcessor(StatefulProcessor):
    """Checks a ledger's rows in order of sequence.

    State: the next sequence and the last digest; and, each under a key of its
    own, the rows that came before their predecessor.  A gap that stays open for
    `gap_ms` is told once, by a timer.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "following long, digest string, told long")
        self.waiting = handle.getMapState("waiting", "sequence long", "previous string, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  names that Spark calls
        following, last, told = self.head.get() if self.head.exists() else (1, None, 0)
        fresh, found = {}, []
        text = lambda x: None if pd.isna(x) else x
        for batch in rows:
            for n, previous, digest in zip(batch["sequence"].tolist(), batch["previous"].tolist(), batch["digest"].tolist(), strict=True):
                if n < following or n in fresh or self.waiting.containsKey((n,)):
                    found.append((key[0], n, "sequence again"))
                else:
                    fresh[n] = (text(previous), digest)
        while True:
            if following in fresh:
                previous, digest = fresh.pop(following)
            elif self.waiting.containsKey((following,)):
                previous, digest = self.waiting.getValue((following,))
                self.waiting.removeKey((following,))
            else:
                break
            if text(previous) != last:
                found.append((key[0], following, "broken link"))
            last, following = digest, following + 1
        for n, row in fresh.items():
            self.waiting.updateValue((n,), row)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if told != following and next(iter(self.waiting.keys()), None) is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
        self.head.update((following, last, told))
        yield pd.DataFrame(found, columns=["ledger_id", "sequence", "rule"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        following, last, _ = self.head.get()
        self.head.update((following, last, following))
        yield pd.DataFrame([(key[0], following, "gap")], columns=["ledger_id", "sequence", "rule"])

    def close(self) -> None:
        pass


def chain_stream(rows: DataFrame, gap_ms: int = 3_600_000) -> DataFrame:
    """Violations of a stream of ledger_id, sequence, previous, digest, as they are found; a gap after gap_ms of waiting.

    Keyed map state needs the RocksDB store, which is set for the session.  A
    query with timers runs batches without data for them and so never ends by
    itself; one that is to end (availableNow) sets
    spark.sql.streaming.noDataMicroBatches.enabled to false, and its timers wait
    for the next batch with data.
    """
    rows.sparkSession.conf.set(_STORE, _ROCKS)
    return rows.select("ledger_id", "sequence", "previous", "digest").groupBy("ledger_id").transformWithStateInPandas(ChainProcessor(gap_ms), CHAIN_OUT, "Append", "ProcessingTime")


def live_status(rows: DataFrame, by: list[str], status: str, ranks: list[str]) -> DataFrame:
    """Furthest state so far, for update mode; late rows do no harm."""
    rank = F.array_position(F.lit(ranks), F.col(status))
    return rows.groupBy(*by).agg(F.max(rank).alias("rank"))


def live_jobs(journal: DataFrame) -> DataFrame:
    """Last state of each job of a journal stream, for update mode."""
    from tallyfold.operators.jobs import _steps

    return _steps(journal).groupBy("ledger_id", "job_id").agg(F.max_by("to", "sequence").alias("state"), F.count("*").alias("revision"))
