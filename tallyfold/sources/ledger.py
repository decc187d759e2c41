"""Ledgers, anchors, journals, blobs and records as DataFrames; result bundles out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.digest import bytes_digest, canonical_json

ACTOR = "actor struct<actor_id:string,actor_type:string,host:string,authenticated_by:string>"
RECEIPT = "schema_version string, receipt_id string, event_id string, event_body_sigil string, previous_receipt_sigil string, accepted_at string, receipt_sigil string"
EVENT = f"sequence long, event_id string, type string, object_id string, occurred_at string, previous_receipt_sigil string, {ACTOR}, payload string, event_body_sigil string, receipt struct<{RECEIPT.replace(' string', ':string')}>"
# Fixed values of the record formats: the members of an event and of one of the old format.
FIELDS = ["schema_version", "sequence", "event_id", "type", "object_id", "occurred_at", "previous_receipt_sigil", "actor", "payload", "event_body_sigil", "receipt"]
OLD_FIELDS = ["schema_version", "event_id", "type", "object_id", "occurred_at", "previous_sigil", "payload", "receipt"]
OLD_RECEIPT = ["receipt_id", "event_id", "sigil", "previous_sigil", "accepted_at"]


def ledger_of(path: Column) -> Column:
    """The file's name without folder and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """ledger_id and raw of each line that isn't blank; one file is one ledger."""
    return spark.read.text(path).select(ledger_of(F.col("_metadata.file_path")).alias("ledger_id"), F.col("value").alias("raw")).where("trim(raw) <> ''")


def split_strict(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that are strict JSON objects (no key twice at any depth, no NaN), and the others with a rule."""
    parsed = F.try_parse_json("raw")
    checked = lines.withColumn("_canonical", canonical_json(F.col("raw"))).withColumn(
        "rule", F.when(parsed.isNull() | F.col("_canonical").isNull(), "not strict JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
    )
    return checked.where("rule is null").drop("rule", "_canonical"), checked.where("rule is not null").drop("_canonical")


def parse(lines: DataFrame) -> DataFrame:
    """Event columns of strict lines, beside raw; payload stays JSON text."""
    return lines.select("ledger_id", F.from_json("raw", EVENT).alias("e"), "raw").select("ledger_id", "e.*", "raw")


def unknown_fields(raw: Column, known: list[str]) -> Column:
    """Members of a JSON object that aren't among the known ones."""
    return F.array_except(F.json_object_keys(raw), F.lit(known))


def parse_old(lines: DataFrame) -> DataFrame:
    """Events of the old format (lines: ledger_id, line, raw): their fields, line as sequence, receipt, and fields_ok, which says if the members are exactly the known ones."""
    schema = "event_id string, type string, object_id string, occurred_at string, previous_sigil string, payload string, receipt struct<receipt_id:string,event_id:string,sigil:string,previous_sigil:string,accepted_at:string>"
    rows = lines.select("ledger_id", F.col("line").cast("long").alias("sequence"), F.from_json("raw", schema).alias("e"), "raw")
    exactly = lambda text, known: F.coalesce(F.array_sort(F.json_object_keys(text)) == F.lit(sorted(known)), F.lit(False))
    same = exactly(F.col("raw"), OLD_FIELDS) & exactly(F.get_json_object("raw", "$.receipt"), OLD_RECEIPT)
    return rows.select("ledger_id", "sequence", "e.*", same.alias("fields_ok"), "raw")


# Record fields of the collections that are read as files of their own.
COLLECTIONS = {
    "snapshots": "snapshot_id string, program_id string, head struct<receipt_sigil:string>, objects array<struct<object_id:string,object_type:string,object_sigil:string>>, snapshot_sigil string",
    "capsules": "task_id string, host string, program_id string, objective string, capability struct<id:string,contract_version:string,contract_sigil:string>, snapshot struct<snapshot_id:string,snapshot_sigil:string>, expected_outputs array<struct<schema:string>>, circle struct<tools:array<string>,time_budget_seconds:long,network:boolean>, bindings struct<review_id:string>, capsule_sigil string",
    "contracts": "id string, contract_version string, expected_outputs array<struct<schema:string>>, allowed_tools array<string>, network boolean, max_time_seconds long, requires_approval boolean",
    "definitions": "rite_id string, schema_version string, description string, stages array<struct<name:string,exit_contract:struct<event_type:string,object_type:string,kind:string,phase:string,status:string>>>",
}


def read_collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Records of a collection, one JSON file each, with raw for their digests and ledger_id of the folder two above the file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+/[^/]+$", 1).alias("ledger_id"))
    return rows.select("ledger_id", F.from_json("raw", COLLECTIONS[name]).alias("r"), "raw").select("ledger_id", "r.*", "raw")


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("event_count long, terminal_receipt_sigil string").json(path, multiLine=True)
    return rows.select(ledger_of(F.col("_metadata.file_path")).alias("ledger_id"), "event_count", "terminal_receipt_sigil")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    schema = "sequence long, event_id string, event_type string, recorded_at string, previous_event_sigil string, payload string, event_sigil string"
    return read_lines(spark, path).select("ledger_id", F.from_json("raw", schema).alias("e"), "raw").select("ledger_id", "e.*", "raw")


# Fixed: members of a journal event's payload, by the columns that jobs.* reads.
JOURNAL = {
    "job_id": "$.job_id", "task_id": "$.task_id", "key": "$.idempotency_key_sigil", "state": "$.state", "reason": "$.reason", "specification_id": "$.specification.specification_id", "specification_digest": "$.specification.specification_sigil",
    "job_binding": "$.job_binding_sigil", "executor_id": "$.executor_instance_id", "build_digest": "$.executor_build_sigil",
}


def journal_columns(journal: DataFrame) -> DataFrame:
    """A read journal in the columns of jobs.*: event_digest, and the members of the payload; request is that of a start or of a cancellation."""
    v = F.try_parse_json("payload")
    text = lambda path: F.try_variant_get(v, path, "string")
    request = F.coalesce(text("$.start_request_sigil"), text("$.cancellation_request_sigil"))
    more = [F.try_variant_get(v, "$.executor_epoch", "long").alias("epoch"), F.try_variant_get(v, "$.expected_revision", "long").alias("expected_revision")]
    return journal.select("ledger_id", "sequence", "event_id", "event_type", "recorded_at", F.col("previous_event_sigil").alias("previous_digest"), F.col("event_sigil").alias("event_digest"), *(text(path).alias(c) for c, path in JOURNAL.items()), request.alias("request"), *more)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, length and digest of each file; the content goes no further than its task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", bytes_digest(F.col("content")).alias("digest"))


def distinct_blobs(blobs: DataFrame) -> DataFrame:
    """One row per digest: first path, copies, length, and whether its copies differ in length."""
    rows = blobs.groupBy("digest").agg(F.min("path").alias("path"), F.count("*").alias("copies"), F.min("length").alias("length"), F.max("length").alias("_most"))
    return rows.select("digest", "path", "copies", "length", (F.col("length") != F.col("_most")).alias("collides"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_bundles(bundles: DataFrame, path: str, form: str = "json") -> None:
    """A folder for each ledger and bundle (its bundle_id where it has one, else its protocol); only folders that are written anew are replaced."""
    by = ["ledger_id", "bundle_id" if "bundle_id" in bundles.columns else "protocol_id"]
    bundles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(form).save(path)


def write_ledger(lines: DataFrame, path: str) -> None:
    """A folder of lines, in order, for each ledger (ledger_id, sequence, raw); one ledger's lines are written by one task."""
    lines.repartition("ledger_id").sortWithinPartitions("ledger_id", "sequence").select("ledger_id", F.col("raw").alias("value")).write.mode("overwrite").partitionBy("ledger_id").text(path)
