import json
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from tallyfold.operators import chain
from tallyfold.streaming import tail


def test_ingest_takes_each_line_once(spark, tmp_path):
    folder = tmp_path / "in"
    for d in ("a", "b", "c"):
        (folder / d).mkdir(parents=True)
    at = {x: f"{tmp_path}/{x}" for x in ("events", "bad", "manifest", "state")}
    run = lambda: tail.ingest(tail.follow_lines(spark, f"{folder}/*"), *at.values()).awaitTermination()
    told = lambda x: sorted(tuple(r) for r in tail.read_ingested(spark, at[x], at["manifest"], tail.EVENTS if x == "events" else tail.QUARANTINE).select("ledger_id", "raw").collect())
    line = lambda i: json.dumps({"sequence": i, "event_id": f"e{i}"})
    (folder / "a" / "L1.jsonl").write_text(line(1) + "\n" + line(1) + "\nnot json\n")
    run()
    (folder / "b" / "L1.jsonl").write_text(line(1) + "\n" + line(2) + "\nnot json\n")  # the same lines in another file
    (folder / "b" / "L2.jsonl").write_text(line(1) + "\n")
    run()
    assert told("events") == [("L1", line(1)), ("L1", line(2)), ("L2", line(1))] and told("bad") == [("L1", "not json")]
    # a batch that broke off between the tables is no part of them, and comes whole when it is repeated
    shutil.rmtree(f"{at['manifest']}/epoch=1")
    shutil.rmtree(f"{at['bad']}/epoch=1", ignore_errors=True)
    for log in Path(at["state"], "commits").glob("*1*"):
        log.unlink()
    assert told("events") == [("L1", line(1))]
    run()
    assert told("events") == [("L1", line(1)), ("L1", line(2)), ("L2", line(1))] and tail.committed(spark, at["manifest"]) == [0, 1]


def test_chain_follows_late_rows_and_tells_gaps(spark, tmp_path):
    rows = chain.build_chain(spark.createDataFrame([(x, i, f"b{i}") for x in ("A", "B", "C") for i in range(6)], "ledger_id string, at int, body string"), ["at"], F.col("body"))
    rows = rows.select("ledger_id", "sequence", F.when((F.col("ledger_id") == "B") & (F.col("sequence") == 4), "x").otherwise(F.col("previous")).alias("previous"), "digest").cache()
    parts = f"{tmp_path}/rows"
    add = lambda df: df.coalesce(1).write.mode("append").parquet(parts)
    add(rows.where("sequence > 3"))  # these come first and wait
    stream = spark.readStream.schema(rows.schema).parquet(parts)

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def go():
        tail.chain_stream(stream, gap_ms=1).writeStream.format("parquet").option("path", f"{tmp_path}/found").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return {tuple(r) for r in spark.read.schema(tail.CHAIN_OUT).parquet(f"{tmp_path}/found").collect()}

    assert not {x for x in go() if x[2] != "gap"}
    add(rows.where("sequence <= 3 and ledger_id <> 'C'"))  # from the checkpoint: what waited is there
    found = go()
    assert {x for x in found if x[2] != "gap"} == {("B", 4, "broken link")}
    add(rows.where("ledger_id = 'A' and sequence = 2"))
    found = go()
    assert ("C", 1, "gap") in found and {x for x in found if x[2] != "gap"} == {("B", 4, "broken link"), ("A", 2, "sequence again")}
    add(rows.where("sequence <= 3 and ledger_id = 'C'"))
    assert {x for x in go() if x[0] == "C"} == {("C", 1, "gap")}  # told once
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_live_status(spark, tmp_path):
    rows = spark.createDataFrame([("p", "B"), ("p", "A"), ("q", "A")], "program_id string, s string")
    rows.write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/s")
    q = tail.live_status(stream, ["program_id"], "s", ["A", "B"]).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from live").collect()} == {("p", 2), ("q", 1)}


def test_live_jobs(spark, tmp_path):
    rows = [("L", 1, "job.submitted", "a", None), ("L", 2, "job.queued", "a", None), ("L", 3, "job.terminal", "a", "FAILED"), ("L", 4, "job.submitted", "b", None), ("L", 5, "job.cancellation_observed", "a", None)]
    journal = spark.createDataFrame(rows, "ledger_id string, sequence long, event_type string, job_id string, state string")
    journal.write.parquet(f"{tmp_path}/j")
    stream = spark.readStream.schema(journal.schema).parquet(f"{tmp_path}/j")
    q = tail.live_jobs(stream).writeStream.format("memory").queryName("jobs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select job_id, state, revision from jobs").collect()} == {("a", "FAILED", 3), ("b", "SUBMITTED", 1)}
