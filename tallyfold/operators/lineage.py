"""Lineage and trace: edges, closures, references anywhere in a payload, inventories and their freshness."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.digest import json_digest


def edges(tables: dict[str, tuple[DataFrame, str, dict[str, str]]]) -> DataFrame:
    """ledger_id, src, dst, kind from the id columns of records.

    tables: name to (records, id column, {column of an id or of ids: kind}).
    """
    from tallyfold.operators.chain import union

    out = []
    for records, own, links in tables.values():
        kinds = dict(records.dtypes)
        for column, kind in links.items():
            dst = F.explode(column) if kinds[column].startswith("array") else F.col(column)
            out.append(records.select("ledger_id", F.col(own).cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(kind).alias("kind")).where("dst is not null"))
    return union(out)


def _steps(links: DataFrame, up: bool, n: int) -> DataFrame:
    """ledger_id, node, next of the edges, each once, cut to files in n partitions by node: as many as the edges need, so a task's share doesn't grow with them."""
    return kept(links.select("ledger_id", F.col("dst" if up else "src").alias("node"), F.col("src" if up else "dst").alias("next")).repartition(n, "node").distinct())


def closure(links: DataFrame, start: DataFrame, up: bool = False) -> DataFrame:
    """ledger_id, root, node, depth: all that the start ids (ledger_id, id) lead to; with up, all that leads to them.

    One join with the edges for each step, on the nodes that are new, until
    there are none.  The edges are cut to files once and each step's new nodes
    once, so a lost executor repeats one step alone and nothing is written twice.
    """
    from tallyfold.operators import ordered

    n = ordered.parts(links)
    step = _steps(links, up, n)
    frontier = kept(start.select("ledger_id", F.col("id").alias("root"), F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0)))
    seen, size = frontier, frontier.count()
    for depth in count(1):
        own = ["ledger_id", "root", "node"]
        here = max(n, size // ordered.TASK_ROWS + 1)
        new = frontier.repartition(n, "ledger_id", "node").join(step, ["ledger_id", "node"]).select("ledger_id", "root", F.col("next").alias("node")).repartition(here, *own).distinct().join(seen, own, "left_anti")
        frontier = kept(new.withColumn("depth", F.lit(depth)))
        size = frontier.count()
        if not size:
            return seen
        seen = seen.unionByName(frontier)


def reach_counts(links: DataFrame, start: DataFrame, up: bool = False) -> DataFrame:
    """ledger_id, root, depth, n: how many nodes each start id (ledger_id, id) leads to at each depth, as closure() would count them.

    A node keeps which of 64 roots reach it as the bits of one number, and a
    step takes over the bits of all nodes before it at once; no row for a root
    and a node is made.
    """
    from tallyfold.operators.ordered import parts, running

    n = parts(links)
    step = _steps(links, up, n)
    roots_ = kept(running(start.select("ledger_id", F.col("id").cast("string").alias("root")).distinct(), ["ledger_id"], ["root"], {"_n": F.lit(1).cast("long")}).select("ledger_id", "root", F.floor((F.col("_n") - 1) / 64).alias("word"), ((F.col("_n") - 1) % 64).cast("int").alias("bit")))
    by = ["ledger_id", "node", "word"]
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    frontier = seen = kept(roots_.select("ledger_id", F.col("root").alias("node"), "word", mask.alias("bits")).groupBy(*by).agg(F.bit_or("bits").alias("bits")))
    found = []
    for depth in count():
        ones = F.array(*(F.sum(F.call_function("getbit", F.col("bits"), F.lit(j)).cast("long")) for j in range(64)))
        counted = frontier.groupBy("ledger_id", "word").agg(ones.alias("ones")).select("ledger_id", "word", F.posexplode("ones").alias("bit", "n")).where("n > 0")
        found.append(counted.join(roots_, ["ledger_id", "word", "bit"]).select("ledger_id", "root", F.lit(depth).alias("depth"), "n"))
        reached = frontier.repartition(n, "ledger_id", "node").join(step, ["ledger_id", "node"]).select("ledger_id", F.col("next").alias("node"), "word", "bits").repartition(n, *by).groupBy(*by).agg(F.bit_or("bits").alias("bits"))
        new = reached.join(seen.withColumnRenamed("bits", "_seen"), by, "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long")))))
        frontier = kept(new.where("bits <> 0").select(*by, "bits"))
        if frontier.isEmpty():
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out
        seen = kept(seen.unionByName(frontier).repartition(n, *by).groupBy(*by).agg(F.bit_or("bits").alias("bits")))


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; on one machine, as in tests, a local one where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df cut to files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def once(value: Column) -> Column:
    """A costly value as rows of one, which conditions on its parts aren't moved below: they would compute it again, each for itself."""
    return F.explode(F.array(value))


def scratch(spark: SparkSession) -> str:
    """An unused path below the shared folder; it goes when the driver ends."""
    import uuid

    name = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


#: Rows of one range of ids, whose chains a task follows by itself.
RANGE_ROWS = 250_000


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ledger_id, id, root, done of the rows (ledger_id, id, root, done) of one range: each chain as far as it stays in the range; null on a cycle."""
    rows = list(batches)
    if not sum(b.num_rows for b in rows):
        return
    t = pa.Table.from_batches(rows).combine_chunks()
    n = t.num_rows
    whole = pa.chunked_array([*t["id"].chunks, *t["root"].chunks]).combine_chunks().dictionary_encode()
    names = whole.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
    ledgers = t["ledger_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    own, to = (ledgers + 1) * (2 * n + 1) + names[:n], (ledgers + 1) * (2 * n + 1) + names[n:]
    order = np.argsort(own, kind="stable")
    place = np.minimum(np.searchsorted(own[order], to), n - 1)
    inside = (own[order[place]] == to) & ~t["done"].to_numpy()
    end = np.where(inside, order[place], np.arange(n))
    for _ in range(n.bit_length() + 1):
        after = end[end]
        if np.array_equal(after, end):
            break
        end = after
    lost = inside[end]  # what hasn't left the range by now goes round in it
    root = t["root"].combine_chunks().take(pa.array(end))
    root = pc.if_else(pa.array(lost), pa.scalar(None, root.type), root)
    done = t["done"].to_numpy()[end] | lost
    out = pa.table({"ledger_id": t["ledger_id"], "id": t["id"], "root": root, "done": pa.array(done)})
    yield from out.to_batches()


def roots(parents: DataFrame) -> DataFrame:
    """ledger_id, id, root: the end of each chain of parents (ledger_id, id, parent; null parent ends it); null on a cycle or before one.

    Ids are dealt into ranges, and each range's task follows its chains until
    they end or leave it.  Only the ids at which chains enter a range take part
    in what follows, pointer doubling: each round doubles how far an id sees, so
    the rounds are bounded by the logarithm of the rows, and what hasn't ended by
    then is on a cycle.  Ids that see their end take no further part, so a root
    that most chains share is no join key again.
    """
    own = parents.select("ledger_id", "id", "parent")
    known = own.select("ledger_id", F.col("id").alias("parent"), F.lit(True).alias("_known"))
    outer = F.col("parent").isNull() | F.col("_known").isNull()  # a parent that isn't a row ends the chain, too
    first = kept(own.join(known, ["ledger_id", "parent"], "left").select("ledger_id", "id", F.coalesce("parent", "id").alias("root"), outer.alias("done")))
    if first.where("not done").isEmpty():
        return first.select("ledger_id", "id", "root")
    ranges = max(int(parents.sparkSession.conf.get("spark.sql.shuffle.partitions")), first.count() // RANGE_ROWS + 1)
    followed = kept(first.repartitionByRange(ranges, "ledger_id", "id").mapInArrow(_followed, first.schema))
    left = followed.where("not done")
    entered = left.select("ledger_id", F.col("root").alias("id")).distinct()
    now = kept(followed.join(entered, ["ledger_id", "id"], "left_semi"))
    ended = now.where("done")
    for _ in range(max(1, now.count()).bit_length() + 1):
        waiting = now.where("not done")
        if waiting.isEmpty():
            break
        up = ended.unionByName(waiting).select("ledger_id", F.col("id").alias("root"), F.col("root").alias("_up"), F.col("done").alias("_end"))
        now = kept(waiting.drop("done").join(up, ["ledger_id", "root"]).select("ledger_id", "id", F.col("_up").alias("root"), F.col("_end").alias("done")))
        ended = ended.unionByName(now.where("done"))
    lost = now.where("not done").select("ledger_id", "id", F.lit(None).cast(now.schema["root"].dataType).alias("root"))
    ends = ended.select("ledger_id", "id", "root").unionByName(lost).select("ledger_id", F.col("id").alias("_at"), F.col("root").alias("_root"))
    far = left.join(ends, (left["ledger_id"] == ends["ledger_id"]) & (F.col("root") == F.col("_at"))).select(left["ledger_id"], "id", F.col("_root").alias("root"))
    return followed.where("done").select("ledger_id", "id", "root").unionByName(far)


def references(events: DataFrame) -> DataFrame:
    """ledger_id, sequence, value: every string value at any depth of the payload (JSON text), and the event's own object.

    Built once for all look-ups, in one pass: the payload's compact JSON is cut
    into its strings, of which those before a colon are keys.
    """
    strings = F.regexp_extract_all(F.try_parse_json("payload").cast("string"), F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?'), F.lit(0))
    values = F.from_json(F.concat(F.lit("["), F.array_join(F.filter(strings, lambda x: ~x.endswith(":")), ","), F.lit("]")), "array<string>")
    own = F.array("object_id")
    return events.select("ledger_id", "sequence", F.explode(F.array_distinct(F.concat(own, F.coalesce(values, F.array().cast("array<string>"))))).alias("value")).where("value is not null").distinct()


def trace(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Events that own or mention each of the ids (ledger_id, id)."""
    return refs.join(ids.select("ledger_id", F.col("id").alias("value")), ["ledger_id", "value"]).select("ledger_id", F.col("value").alias("id"), "sequence").distinct()


def freshness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Changes between two inventories (ledger_id, object_type, object_id, digest): ADDED, REMOVED or CHANGED."""
    key = ["ledger_id", "object_type", "object_id"]
    both = stored.withColumnRenamed("digest", "_old").join(current.withColumnRenamed("digest", "_new"), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "ADDED").when(F.col("_new").isNull(), "REMOVED").when(F.col("_old") != F.col("_new"), "CHANGED")
    return both.select(*key, change.alias("change")).where("change is not null")


def foreign_heads(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """Snapshots (ledger_id, snapshot_id, head) whose head isn't a digest of the ledger; no head is none, too."""
    heads = rows.select("ledger_id", F.col("digest").alias("head")).distinct()
    return snapshots.join(heads, ["ledger_id", "head"], "left_anti")


def inventory(objects: DataFrame) -> DataFrame:
    """ledger_id, program_id, object_type, object_id, digest: what each program has, with digests of the records (body: JSON text), in order of type and id."""
    rows = objects.select("ledger_id", "program_id", "object_type", "object_id", json_digest(F.col("body")).alias("digest"))
    return rows.orderBy("ledger_id", "program_id", "object_type", "object_id")


def inventories(objects: DataFrame) -> DataFrame:
    """ledger_id, program_id, objects: the sorted inventory of each program as one array, and a digest of the whole."""
    own = inventory(objects).groupBy("ledger_id", "program_id").agg(F.array_sort(F.collect_list(F.struct("object_type", "object_id", "digest"))).alias("objects"))
    return own.withColumn("inventory_digest", json_digest(F.to_json(F.struct("objects"))))
