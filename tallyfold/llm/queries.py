"""The operators' queries, thin over the operators, with production parameters; and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, decontam, fingerprint, langid, linededup, neardup, ranked, secretscan, sharding, substrdedup, suffixdedup, veccodes, vecgraph
from tallyfold.llm.oracles import ORACLES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _span_sizes(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontam.mark(_docs(spark, sf_dir).select("doc_id", "text"), items, length=10).select("doc_id", "hit.*")
    n_hit = _span_sizes("spans")
    return hit.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.concat_ws(",", "items"), "utf-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(_docs(spark, sf_dir), words=3, percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.encode(F.coalesce("lines.kept", F.lit("")), "utf-8"), 256).alias("kept_sha256"))


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(_docs(spark, sf_dir).select("doc_id", "text"), VOCABULARY, public_tokenizers.PATTERN, decoded="bytes")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(_docs(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.remove_repeats(_docs(spark, sf_dir), length=50)
    return out.select("doc_id", "n_bytes", _span_sizes("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (their source as host) and pages (declared language, address suffix and host); fitted on documents' labels, which are no evidence."""
    docs = _docs(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    none = F.lit(None).cast("string")
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"))
    url, html = F.col("url"), F.col("html")
    rows = rows.union(pages.select(F.lit(None).cast("long"), F.col("page_id").cast("long"), langid.page_text(html), langid.markup_language(html), langid.suffix_of(url), langid.host_of(url)))
    found = langid.identify(rows, langid.train(docs), declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"))
    return found.select("doc_id", "page_id", "language.lang", F.round("language.posterior", 9).alias("posterior"), "language.kept")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_docs(spark, sf_dir), F.col("source"))
    return found.select("doc_id", "nth", "part", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 9).alias("probability"), "secret")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrdedup.remove_repeats(_docs(spark, sf_dir), length=20)
    return out.select("doc_id", "n_words", _span_sizes("removed").alias("n_removed"), F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(_docs(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecgraph.link(_vectors(spark, sf_dir), cosine=0.9)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked.search(_docs(spark, sf_dir), items, k=10)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.encode(_vectors(spark, sf_dir), parts=4, rounds=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_benchmark_decontamination,
        op2_minhash_near_dedup,
        op3_line_dedup,
        op4_byte_level_bpe,
        op5_minimax_sharding,
        op6_suffix_array_dedup,
        op7_language_id,
        op8_secret_scan,
        op9_substring_dedup,
        op10_document_fingerprints,
        op11_embedding_near_dedup,
        op12_ranked_search,
        op13_vector_codes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
