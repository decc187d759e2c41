"""Document fingerprints: a wide xxhash of the canonical text; DataFrame functions only.

Canonical: Unicode compatibility composition, full case folding, composition
again, runs of white space as one blank, none at the ends.  Rows of one hash
are compared byte by byte; where a hash has different texts, a digest of the
text is added to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.text import likely_in, parallelism, text_or_empty, written


def canonical(text: Column) -> Column:
    """Folded form of a text that isn't null; the normaliser is the one of the JVM library that Spark's collations use."""

    def composed(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits: two 64-bit hashes from different seeds, as 32 hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2)))


def collisions(rows: DataFrame) -> DataFrame:
    """The hashes (fp) whose rows (fp, canon) have different bytes; only the least and the largest text of a hash are kept on the way."""
    return rows.groupBy("fp").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("fp")


def told_apart(rows: DataFrame, fp: str, canon_digest: str, collided: DataFrame) -> DataFrame:
    """Adds the digest to the hash where that hash is among the collided ones."""
    hit = collided.select(F.col("fp").alias(fp), F.lit(True).alias("_hit"))
    return rows.join(hit, fp, "left").withColumn(fp, F.when(F.col("_hit"), F.concat(fp, F.lit("-"), canon_digest)).otherwise(F.col(fp))).drop("_hit")


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, next: the text of the next row in descending doc_id; after the last row, the first.

    Rows are shuffled once, by ranges of doc_id; a range's first row also goes
    to the range before it.  Nulls come last; rows of one doc_id by text hash.
    """
    p = parallelism(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("at"), text_or_empty("text").alias("text"))
    ranges = docs.select("at").repartitionByRange(p, "at").groupBy(F.spark_partition_id().alias("r")).agg(F.min("at").alias("a"), F.max("at").alias("b"))
    ranges = sorted((r["a"], r["b"]) for r in ranges.collect())  # one row for each shuffle partition
    starts, tops = [a for a, _ in ranges], [b for _, b in ranges]
    if not starts:
        return docs.select("doc_id", "text", F.col("text").alias("next"))
    n = len(starts)
    cell = F.size(F.filter(F.lit(starts).cast("array<long>"), lambda a: a <= F.col("at")))
    rows = docs.withColumn("cell", cell)
    rows = rows.withColumn("to", F.explode(F.when(F.col("at").isin(tops), F.array(F.struct(F.col("cell"), F.lit(0).alias("guest")), F.struct((F.col("cell") % n + 1).alias("cell"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("cell"), F.lit(0).alias("guest"))))))
    rows = rows.select("doc_id", "at", "text", "to.cell", "to.guest")
    w = Window.partitionBy("cell").orderBy("guest", F.col("at").desc(), F.xxhash64("text"))
    return rows.repartition(p, "cell").withColumn("next", F.lead("text").over(w)).where("guest = 0").select("doc_id", "text", F.coalesce("next", "text").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs (doc_id, text).

    Texts of equal canonical form have equal fingerprints, others different
    ones.  Null counts as empty.  Repeated rows are kept.  An empty table gives
    none.  Other columns are not looked at.
    """
    rows = docs.select("doc_id", canonical(text_or_empty("text")).alias("canon"))
    rows = rows.select("doc_id", "canon", wide_hash(F.col("canon")).alias("fp"))
    collided = written(collisions(rows))
    out = told_apart(rows.select("doc_id", "fp", F.sha2(F.encode("canon", "utf-8"), 256).alias("digest")), "fp", "digest", collided)
    return out.select("doc_id", F.col("fp").alias("fingerprint"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and whether they and the next text's are the same.

    Texts of one hash are compared byte by byte; an edited text, which exists
    only on the way, is compared with the others of its hash by digest.

    Edited: the last floor(n/2) code points give way to the first as many (or
    all) of the next row's text, in descending doc_id.  Likeness is 1.0 for
    equal fingerprints with equal canonical bytes, else 0.0.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = neighbours(docs).withColumn("n_chars", F.char_length("text"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half), F.substring(F.col("next"), F.lit(1), half)))
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("e"), canonical(F.col("next")).alias("x"))
    like = lambda a, b: ((wide_hash(a) == wide_hash(b)) & (a == b)).cast("double")
    c, e, x = F.col("c"), F.col("e"), F.col("x")
    rows = written(rows.select("doc_id", "n_chars", "edited_sha256", wide_hash(c).alias("fp"), wide_hash(e).alias("efp"), F.sha2(F.encode(c, "utf-8"), 256).alias("cd"), F.sha2(F.encode(e, "utf-8"), 256).alias("ed"), like(c, e).alias("near_edited"), like(c, x).alias("near_next")))
    several = rows.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    # the shared hashes' texts once more, byte by byte
    again = docs.select(canonical(text_or_empty("text")).alias("canon"))
    collided = written(collisions(likely_in(again.select("canon", wide_hash(F.col("canon")).alias("fp")), "fp", several)))
    every = rows.select("fp", F.col("cd").alias("canon")).union(rows.select("efp", "ed"))
    collided = written(collided.union(collisions(every)).distinct())
    rows = told_apart(told_apart(rows, "fp", "cd", collided), "efp", "ed", collided)
    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"), "near_edited", "near_next")
