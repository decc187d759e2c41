"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokenising.

Each stage works on the whole table that its predecessor kept and returns the
columns of documents, the last one tokens.  Documents go where their language
isn't clear (1) or where they are not the least doc_id of their near-duplicates
(3); lines go where they repeat an earlier one (2), words where they repeat a
benchmark phrase (4).
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, decontam, langid, linededup, neardup

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes of the rows that go to a Python worker at once, unless the session was started with another number: Spark, Arrow and the worker hold them at the same time.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def with_text(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """docs with this text and its length in characters in place of the old ones."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return docs.select(*(new.get(c, F.col(c)).alias(c) for c in columns))


def small_batches(stage):
    """stage, with rows sent to Python workers by bytes; the setting stays, as what the stage returns runs later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not spark.sparkContext.getConf().contains(_BATCHES):
            spark.conf.set(_BATCHES, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits its most likely language; fitted on a bounded sample of labelled rows, the source is the host.

    The label is no evidence.  Null, empty and letterless texts go, as does
    everything where no row has a label.  Repeated rows share one decision; null
    sources say nothing; an empty table stays empty; other columns pass through.
    """
    found = langid.identify(docs, langid.train(docs), host=F.col("source"))
    return found.where("language.kept").select(*docs.columns)


@small_batches
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, exactly or nearly.

    Null texts stay null, documents without lines left stay as empty ones, rows
    of null doc_id stay whole, and rows of one doc_id count as one document.
    """
    return with_text(linededup.remove_lines(docs), "lines.kept", docs.columns)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near duplicates.

    Null, empty and blank texts and rows of null doc_id all stay; repeated rows
    of one doc_id stay or go together.
    """
    gone = neardup.link(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@small_batches
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that occurrences of benchmark phrases cover; all rows stay, null texts stay null."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_text(decontam.mark(docs, items), "hit.clean", docs.columns)


@small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip (the ids decode to the text) of each row; null and empty texts have no tokens."""
    both = bpe.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY, public_tokenizers.PATTERN, decoded="bytes")
    same = F.encode(F.coalesce("text", F.lit("")), "utf-8") == F.col("bytes")
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

ORACLE_SQL = None  # the stages use models, hashes and a tokeniser; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each from the rows that its predecessor wrote to the shared checkpoint folder."""
    from tallyfold.llm.text import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
