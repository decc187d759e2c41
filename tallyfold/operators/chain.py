"""Chains: contiguous sequences, links, digests, anchors, recovery, and building or converting ledgers.

Violations are rows (ledger_id, sequence, object_id, rule).  Checks compare a
row with its predecessor by an equi-join on the sequence, so that one huge
ledger is checked in parallel; only building a chain is sequential in a ledger.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyfold.functions.digest import PREFIX, json_digest, json_digests, written
from tallyfold.operators.lineage import kept


def violations(rows: DataFrame, rules: dict[str, Column], object_id: str = "event_id") -> DataFrame:
    """A row for each rule whose condition is true."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return rows.select("ledger_id", F.col("sequence").cast("long").alias("sequence"), F.col(object_id).cast("string").alias("object_id"), F.explode(broken).alias("rule"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def sequence_gaps(rows: DataFrame, start: int = 1, by: str = "ledger_id", sequence: str = "sequence") -> DataFrame:
    """Per ledger: rows, least and largest number, distinct numbers, repeated and gapped; contiguous says if it runs from start."""
    s = F.col(sequence)
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.min(s).alias("least"), F.max(s).alias("largest"), F.count_distinct(s).alias("distinct_n"))
    return out.select(by, "n", "least", "largest", (F.col("n") > F.col("distinct_n")).alias("repeated"), (F.col("largest") - start + 1 > F.col("distinct_n")).alias("gapped"), ((F.col("n") == F.col("distinct_n")) & (F.col("least") == start) & (F.col("largest") == F.col("n") + start - 1)).alias("contiguous"))


def broken_links(rows: DataFrame, previous: str = "previous", digest: str = "digest") -> DataFrame:
    """Rows whose previous digest isn't that of the row one before; the first must have none."""
    before = rows.select("ledger_id", (F.col("sequence") + 1).alias("sequence"), F.col(digest).alias("_before"), F.lit(True).alias("_has"))
    joined = rows.join(before, ["ledger_id", "sequence"], "left")
    wrong = F.when(F.col("_has"), ~F.col(previous).eqNullSafe(F.col("_before"))).otherwise((F.col("sequence") != 1) | F.col(previous).isNotNull())
    return joined.where(wrong).select("ledger_id", "sequence", F.lit("broken link").alias("rule"))


def audit_events(events: DataFrame) -> DataFrame:
    """All chain rules on parsed events: sequence, digests of body and receipt, links, and what the receipt repeats."""
    r = F.col("receipt")
    rows = events.withColumn("_own", json_digests(F.col("raw"), {"body": (("event_body_sigil", "receipt"), None), "receipt": (("receipt_sigil",), "receipt")})).withColumn("_body", F.col("_own.body")).withColumn("_receipt", F.col("_own.receipt"))
    local = violations(
        rows,
        {
            "body digest": ~F.col("event_body_sigil").eqNullSafe(F.col("_body")),
            "receipt digest": ~r["receipt_sigil"].eqNullSafe(F.col("_receipt")),
            "receipt event": ~r["event_id"].eqNullSafe(F.col("event_id")),
            "receipt body": ~r["event_body_sigil"].eqNullSafe(F.col("event_body_sigil")),
            "receipt time": ~r["accepted_at"].eqNullSafe(F.col("occurred_at")),
            "receipt link": ~r["previous_receipt_sigil"].eqNullSafe(F.col("previous_receipt_sigil")),
        },
    )
    flat = kept(events.select("ledger_id", "sequence", "event_id", F.col("previous_receipt_sigil").alias("previous"), r["receipt_sigil"].alias("digest")))  # lines are opened once for all that is about order
    links = broken_links(flat).join(flat.select("ledger_id", "sequence", F.col("event_id").alias("object_id")), ["ledger_id", "sequence"]).select("ledger_id", "sequence", "object_id", "rule")
    twice = flat.groupBy("ledger_id", "sequence").agg(F.count("*").alias("n"), F.min("event_id").alias("object_id")).where("n > 1 or sequence < 1").select("ledger_id", "sequence", "object_id", F.lit("sequence").alias("rule"))
    before = flat.select("ledger_id", (F.col("sequence") + 1).alias("sequence"))
    gap = flat.where("sequence > 1").join(before, ["ledger_id", "sequence"], "left_anti").select("ledger_id", "sequence", F.col("event_id").alias("object_id"), F.lit("sequence").alias("rule"))
    return union([local, links, twice, gap]).distinct()


def first_violations(found: DataFrame) -> DataFrame:
    """The first violation of each ledger: where a reader that stops would have stopped."""
    return found.groupBy("ledger_id").agg(F.min(F.struct("sequence", "rule", "object_id")).alias("v")).select("ledger_id", "v.*")


def valid_prefix(events: DataFrame, found: DataFrame) -> DataFrame:
    first = found.groupBy("ledger_id").agg(F.min("sequence").alias("_stop"))
    return events.join(first, "ledger_id", "left").where("_stop is null or sequence < _stop").drop("_stop")


def recovery(rows: DataFrame, anchors: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Per ledger: status, committed and tail rows.

    rows: ledger_id, sequence, digest.  HEALTHY: the anchor is at the last row;
    RECOVERABLE: valid rows follow it; REWRITTEN: another row stands at the
    anchor; REMOVED: rows are gone; INVALID: found has a violation.
    """
    last = rows.groupBy("ledger_id").agg(F.count("*").alias("n"))
    at = rows.select("ledger_id", F.col("sequence").alias("event_count"), F.col("digest").alias("_at"))
    joined = anchors.join(last, "ledger_id", "left").join(at, ["ledger_id", "event_count"], "left").na.fill(0, ["n"])
    if found is not None:
        joined = joined.join(found.select("ledger_id").distinct().withColumn("_bad", F.lit(True)), "ledger_id", "left")
    else:
        joined = joined.withColumn("_bad", F.lit(None).cast("boolean"))
    status = F.when(F.col("event_count") > F.col("n"), "REMOVED").when(~F.col("_at").eqNullSafe(F.col("terminal_receipt_sigil")), "REWRITTEN").when(F.col("_bad"), "INVALID").when(F.col("n") > F.col("event_count"), "RECOVERABLE").otherwise("HEALTHY")
    return joined.select("ledger_id", status.alias("status"), F.col("event_count").alias("committed"), F.greatest(F.col("n") - F.col("event_count"), F.lit(0)).cast("long").alias("tail"))


def accept_tails(rows: DataFrame, anchors: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Anchors after the valid tails of recoverable ledgers are accepted."""
    fine = recovery(rows, anchors, found).where("status = 'RECOVERABLE'").select("ledger_id")
    last = rows.join(fine, "ledger_id", "left_semi").groupBy("ledger_id").agg(F.max(F.struct("sequence", "digest")).alias("m")).select("ledger_id", F.col("m.sequence").alias("_n"), F.col("m.digest").alias("_d"))
    return anchors.join(last, "ledger_id", "left").select("ledger_id", F.coalesce("_n", "event_count").alias("event_count"), F.coalesce("_d", "terminal_receipt_sigil").alias("terminal_receipt_sigil"))


def _folded(rows: DataFrame, order: list[str], step, columns: dict) -> DataFrame:
    """rows with columns that follow from one row to the next, in order within a ledger.

    step(state, number, row) gives the new state and the columns' values; a
    ledger's rows come one after the other in one task, which holds a batch and
    the state, not the ledger.
    """
    schema = StructType([*rows.schema.fields, *(StructField(n, t) for n, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, number, state = object(), 0, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["ledger_id"] != ledger:
                    ledger, number, state = row["ledger_id"], 0, None
                number += 1
                state, values = step(state, number, row)
                out.append(values)
            added = [pa.array([v[i] for v in out], pa.int64() if isinstance(t, LongType) else pa.string()) for i, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *columns])

    return rows.repartition("ledger_id").sortWithinPartitions("ledger_id", *order).mapInArrow(run, schema)


def build_chain(rows: DataFrame, order: list[str], body: Column) -> DataFrame:
    """Numbers a ledger's rows and chains them: body_digest, sequence, previous, digest.

    A digest hashes the one before and the body digest.  The fold is sequential
    within a ledger by its nature, and linear; ledgers are parallel.
    """

    def step(previous, number, row):
        digest = hashlib.sha256(((previous or "") + row["body_digest"]).encode()).hexdigest()
        return digest, (number, previous, digest)

    own = rows.withColumn("body_digest", F.sha2(F.encode(body, "utf-8"), 256))
    return _folded(own, order, step, {"sequence": LongType(), "previous": StringType(), "digest": StringType()})


# Fixed texts of the record formats.
EVENT_SCHEMA, RECEIPT_SCHEMA = "chronicle-event/1.1", "receipt/1.1"


def seal_events(events: DataFrame, order: list[str]) -> DataFrame:
    """raw (the event's line, canonical JSON), sequence, previous and digest (its receipt's) of events in order.

    events: ledger_id, event_id, type, object_id, occurred_at, actor and payload
    (JSON texts), receipt_id.  Body and receipt digests are those of canonical
    JSON; a receipt and a body name the receipt before.
    """
    digest = lambda x: PREFIX + hashlib.sha256(written(x).encode()).hexdigest()

    def step(previous, number, row):
        event = {"schema_version": EVENT_SCHEMA, "sequence": number, "previous_receipt_sigil": previous} | {k: row[k] for k in ("event_id", "type", "object_id", "occurred_at")} | {k: json.loads(row[k]) for k in ("actor", "payload")}
        body = digest(event)
        receipt = {"schema_version": RECEIPT_SCHEMA, "receipt_id": row["receipt_id"], "event_id": row["event_id"], "event_body_sigil": body, "previous_receipt_sigil": previous, "accepted_at": row["occurred_at"]}
        seal = digest(receipt)
        line = written(event | {"event_body_sigil": body, "receipt": receipt | {"receipt_sigil": seal}})
        return seal, (number, previous, seal, line)

    return _folded(events, order, step, {"sequence": LongType(), "previous": StringType(), "digest": StringType(), "raw": StringType()})


def audit_old(events: DataFrame) -> DataFrame:
    """All chain rules on events of the old format (see parse_old): members, digest of the event without its receipt, links, and what the receipt repeats."""
    r = F.col("receipt")
    own = events.withColumn("_own", json_digest(F.col("raw"), ("receipt",)))
    local = violations(
        own,
        {
            "unknown or missing field": ~F.col("fields_ok"),
            "digest": ~r["sigil"].eqNullSafe(F.col("_own")),
            "receipt event": ~r["event_id"].eqNullSafe(F.col("event_id")),
            "receipt time": ~r["accepted_at"].eqNullSafe(F.col("occurred_at")),
            "receipt link": ~r["previous_sigil"].eqNullSafe(F.col("previous_sigil")),
        },
    )
    flat = events.select("ledger_id", "sequence", F.col("previous_sigil").alias("previous"), r["sigil"].alias("digest"), "event_id")
    links = broken_links(flat).join(flat.select("ledger_id", "sequence", F.col("event_id").alias("object_id")), ["ledger_id", "sequence"]).select("ledger_id", "sequence", "object_id", "rule")
    return local.unionByName(links)


def convert_old(events: DataFrame, actor: str) -> DataFrame:
    """Sound ledgers of the old format as lines of the new one (see seal_events); actor: JSON text of whoever converts.

    Ledgers that break a chain rule are left out; audit_old() names them.  The
    objects' states follow from types, ids, times and payloads, which stay;
    unchanged() shows it on the state tables.
    """
    bad = audit_old(events).select("ledger_id").distinct()
    rows = events.join(bad, "ledger_id", "left_anti").withColumnRenamed("sequence", "line")
    rows = rows.select("ledger_id", "line", "event_id", "type", "object_id", "occurred_at", F.lit(actor).alias("actor"), "payload", F.col("receipt.receipt_id").alias("receipt_id"))
    return seal_events(rows, ["line"])


def wrong_digests(rows: DataFrame, body: Column) -> DataFrame:
    """Rows whose body digest or chained digest doesn't follow from what they hold; row-local, so parallel within a ledger."""
    own = F.sha2(F.encode(body, "utf-8"), 256)
    chained = F.sha2(F.encode(F.concat(F.coalesce("previous", F.lit("")), F.col("body_digest")), "utf-8"), 256)
    return violations(rows, {"body digest": own != F.col("body_digest"), "digest": chained != F.col("digest")}, "sequence")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with side; none if a conversion has kept the state."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))
