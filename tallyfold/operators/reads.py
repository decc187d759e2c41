"""Reads: look-ups over collections, listings, pages, searches, counts, and stored against actual content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.digest import json_digest


def objects(collections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """ledger_id, collection, rank, object_id, body (JSON) of all collections, in their order."""
    frames = [rows.select("ledger_id", F.lit(name).alias("collection"), F.lit(i).alias("rank"), F.col(key).cast("string").alias("object_id"), F.to_json(F.struct(*rows.columns)).alias("body")) for i, (name, (rows, key)) in enumerate(collections.items())]
    return reduce(DataFrame.unionByName, frames)


def look_up(every: DataFrame, ids: DataFrame) -> DataFrame:
    """The object of each id (ledger_id, object_id); of several collections, the first."""
    hits = every.join(ids, ["ledger_id", "object_id"])
    return hits.groupBy("ledger_id", "object_id").agg(F.min_by(F.struct("collection", "body"), "rank").alias("x")).select("ledger_id", "object_id", "x.*")


def by_collection(every: DataFrame) -> DataFrame:
    return every.groupBy("ledger_id", "collection").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("object_id")).alias("ids"))


def of_programs(every: DataFrame) -> DataFrame:
    """ledger_id, program_id, collection, ids: the sorted ids that each program has in each collection; a program has itself.

    every: ledger_id, program_id, collection, object_id.
    """
    return every.groupBy("ledger_id", "program_id", "collection").agg(F.array_sort(F.collect_set("object_id")).alias("ids"))


def reviews(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each review request as `request`, with its completed artifact as `artifact`, or null; both: ledger_id, id, ..."""
    done = artifacts.select("ledger_id", "id", F.struct(*artifacts.columns).alias("artifact"))
    return requests.select("ledger_id", "id", F.struct(*requests.columns).alias("request")).join(done, ["ledger_id", "id"], "left")


def digest_of(ids: DataFrame, events: DataFrame, objects: DataFrame) -> DataFrame:
    """ledger_id, id, source, digest of identifiers: a receipt's or an event's receipt digest, else that of an object's record.

    events: ledger_id, sequence, event_id, receipt_id, digest; objects:
    ledger_id, rank (of its collection), object_id, body.  Of several events the
    first counts, of several objects the first collection's.
    """
    named = events.select("ledger_id", "sequence", "digest", F.explode(F.array_distinct(F.array("receipt_id", "event_id"))).alias("id"))
    sealed = named.join(ids.select("ledger_id", "id"), ["ledger_id", "id"]).groupBy("ledger_id", "id").agg(F.min_by("digest", "sequence").alias("_sealed"))
    held = objects.withColumnRenamed("object_id", "id").join(ids.select("ledger_id", "id"), ["ledger_id", "id"]).groupBy("ledger_id", "id").agg(F.min_by("body", "rank").alias("_body"))
    both = ids.select("ledger_id", "id").join(sealed, ["ledger_id", "id"], "left").join(held, ["ledger_id", "id"], "left")
    source = F.when(F.col("_sealed").isNotNull(), "receipt").when(F.col("_body").isNotNull(), "object")
    return both.select("ledger_id", "id", source.alias("source"), F.coalesce("_sealed", json_digest(F.col("_body"))).alias("digest"))


def ordinal_ids(rows: DataFrame, prefix: str, order: list[str], digits: int = 3) -> DataFrame:
    """rows with ordinal_id: prefix and the row's place in its ledger, from 1, with leading zeros.

    A ledger's rows are numbered in one task by their order columns alone.
    """
    place = F.row_number().over(Window.partitionBy("ledger_id").orderBy(*order))
    return rows.withColumn("ordinal_id", F.format_string(f"{prefix}%0{digits}d", place))


def page(rows: DataFrame, key: str, limit: int = 50, offset: int = 0, after=None) -> DataFrame:
    """A slice in key order: by offset, or, for large tables, after the last key of the page before."""
    if after is not None:
        return rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit)
    return rows.orderBy(key).offset(offset).limit(limit)


#: Rows of a page at most.
MOST_ROWS = 100


def paged(rows: DataFrame, key: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int, int | None]:
    """A page in key order, the number of all rows, and the offset of the next page (None after the last).

    limit is in 1..MOST_ROWS; an offset beyond the end is refused.
    """
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be in 1..{MOST_ROWS}")
    total = rows.count()
    if not 0 <= offset <= total:
        raise ValueError("the offset is past the end")
    following = min(offset + limit, total)
    return page(rows, key, limit, offset), total, following if following < total else None


def search(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows that have the query in one of the columns, in whatever case."""
    hits = [F.contains(F.lower(c), F.lit(query.lower())) for c in columns]
    return rows.where(reduce(Column.__or__, hits))


def content_audit(registered: DataFrame, actual: DataFrame) -> DataFrame:
    """registered (path, digest) against actual (path, digest): OK, MISSING or MISMATCH."""
    both = registered.join(actual.select("path", F.col("digest").alias("_have")), "path", "left")
    return both.withColumn("result", F.when(F.col("_have").isNull(), "MISSING").when(F.col("_have") == F.col("digest"), "OK").otherwise("MISMATCH")).drop("_have")


def exports_audit(canonical: DataFrame, exported: DataFrame, key: list[str]) -> DataFrame:
    """Bundles against their exports, by digest: OK, MISMATCH, MISSING (no export) or EXTRA (no such bundle); both: key, digest."""
    both = canonical.select(*key, F.col("digest").alias("_own")).join(exported.select(*key, F.col("digest").alias("_out")), key, "full_outer")
    result = F.when(F.col("_out").isNull(), "MISSING").when(F.col("_own").isNull(), "EXTRA").when(F.col("_own") == F.col("_out"), "OK").otherwise("MISMATCH")
    return both.select(*key, result.alias("result"))


def outputs_audit(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Accepted outputs (ledger_id, task_id, path, digest) against files (path, digest, content as JSON text): OK, MISSING, MISMATCH, or OTHER TASK where the file names another task."""
    both = outputs.join(files.select("path", F.col("digest").alias("_have"), F.get_json_object("content", "$.task_id").alias("_task")), "path", "left")
    result = F.when(F.col("_have").isNull(), "MISSING").when(F.col("_have") != F.col("digest"), "MISMATCH").when(~F.col("_task").eqNullSafe(F.col("task_id")), "OTHER TASK").otherwise("OK")
    return both.select("ledger_id", "task_id", "path", result.alias("result"))


def data_checks(chain: DataFrame, state: DataFrame, snapshots: DataFrame, capsules: DataFrame, outputs: DataFrame, artifacts: DataFrame, exports: DataFrame) -> dict[str, DataFrame]:
    """The seven checks of a health report, as violations (ledger_id) by name.

    chain, state, snapshots and capsules are violations already (of the chain,
    across objects, of digest pins); outputs, artifacts and exports are audits
    with a result.
    """
    bad = lambda audit: audit.where("result <> 'OK'")
    return {"chain": chain, "state": state, "snapshots": snapshots, "capsules": capsules, "outputs": bad(outputs), "artifacts": bad(artifacts), "exports": bad(exports)}


def health(ledgers: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """Per ledger and check: violations, and PASS without any; a last row `all` per ledger."""
    counted = [v.groupBy("ledger_id").agg(F.count("*").alias("n")).withColumn("check", F.lit(name)) for name, v in checks.items()]
    every = ledgers.select("ledger_id").distinct().select("ledger_id", F.explode(F.lit(list(checks))).alias("check"))
    rows = every.join(reduce(DataFrame.unionByName, counted), ["ledger_id", "check"], "left").na.fill(0, ["n"])
    whole = rows.groupBy("ledger_id").agg(F.sum("n").alias("n")).withColumn("check", F.lit("all"))
    return rows.unionByName(whole).select("ledger_id", "check", "n", F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("result"))
