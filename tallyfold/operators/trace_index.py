"""A trace index that stays: posting lists of the values that events mention, appended batch by batch, read by bucket.

A value's postings lie in the bucket of its hash, and a look-up reads the buckets
of what it asks for and no other.  A posting list is cut at every BLOCK
sequences, so a value that a third of all events mention is many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.lineage import references
from tallyfold.operators.state import PREFIXES

BUCKETS = 256
BLOCK = 4096
_SCHEMA = "ledger_id string, value string, collection string, block long, sequences array<long>, bucket int, batch string"


def bucket_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def collection_of(value: Column) -> Column:
    """The collection that an id belongs to by its beginning; null for other values."""
    out = F.lit(None).cast("string")
    for name, prefix in PREFIXES.items():
        out = F.when(value.startswith(prefix), name).otherwise(out)
    return out


def postings(events: DataFrame) -> DataFrame:
    """ledger_id, value, collection, block, sequences: in which events (ledger_id, sequence, object_id, payload) each string value is."""
    refs = references(events).withColumn("sequence", F.col("sequence").cast("long")).withColumn("block", F.floor(F.col("sequence") / BLOCK))
    lists = refs.groupBy("ledger_id", "value", "block").agg(F.array_sort(F.collect_set("sequence")).alias("sequences"))  # BLOCK at most
    return lists.select("ledger_id", "value", collection_of(F.col("value")).alias("collection"), "block", "sequences")


def append(events: DataFrame, path: str, batch: str) -> None:
    """Adds the events of a batch to the index; a batch that comes again replaces itself."""
    rows = postings(events).withColumn("bucket", bucket_of(F.col("value"))).withColumn("batch", F.lit(batch))
    # lists are cut already, so a bucket is few rows even where its values are in many events
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def look_up(spark: SparkSession, path: str, ids: DataFrame, collection: str | None = None) -> DataFrame:
    """ledger_id, id, sequence of the events that own or mention each id (ledger_id, id); with a collection, of its ids alone.

    The ids' buckets, BUCKETS numbers at most, come to the driver and choose the
    folders that are read.
    """
    asked = ids if collection is None else ids.where(collection_of(F.col("id")).eqNullSafe(F.lit(collection)))
    asked = asked.select("ledger_id", F.col("id").alias("value")).distinct()
    buckets = [r[0] for r in asked.select(bucket_of(F.col("value"))).distinct().collect()]
    found = read(spark, path).where(F.col("bucket").isin(buckets)).join(asked, ["ledger_id", "value"])
    return found.select("ledger_id", F.col("value").alias("id"), F.explode("sequences").alias("sequence")).distinct()
