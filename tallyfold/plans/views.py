"""The given tables in the shapes of the operators: runs, ledgers, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _disposition(included, reason=None):
    return F.struct(included.alias("included"), (reason if reason is not None else F.lit(None).cast("string")).alias("reason"), F.lit(None).cast("string").alias("policy_reference")).alias("disposition")


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as runs: experiment = line status, arm = return flag, metric = extended price; all count."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.lit("L").alias("ledger_id"), F.lit("P").alias("protocol_id"), F.col("l_linestatus").alias("experiment_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("run_id"), F.col("l_returnflag").alias("arm"), F.lit("FORMAL").alias("phase"), F.lit("COMPLETED").alias("status"), _disposition(F.lit(True)), F.lit(None).cast("long").alias("seed"), F.create_map(F.lit("price"), "l_extendedprice").alias("metrics"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as runs: mean value of a user (seed) and event type (arm)."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return rows.select(F.lit("L").alias("ledger_id"), F.lit("P").alias("protocol_id"), F.lit("E").alias("experiment_id"), F.concat_ws("-", "user_id", "event_type").alias("run_id"), F.col("event_type").alias("arm"), F.lit("FORMAL").alias("phase"), F.lit("COMPLETED").alias("status"), _disposition(F.lit(True)), F.col("user_id").alias("seed"), F.create_map(F.lit("value"), "v").alias("metrics"))


def status_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as runs of one protocol for each user: failed where the type is error, set aside where props.k ends in 0."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    failed = F.col("event_type") == "error"
    return rows.select(F.lit("L").alias("ledger_id"), F.col("user_id").cast("string").alias("protocol_id"), F.lit("E").alias("experiment_id"), F.lpad(F.col("event_id").cast("string"), 10, "0").alias("run_id"), F.col("event_type").alias("arm"), F.lit("FORMAL").alias("phase"), F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), _disposition(F.col("k") % 10 != 0, F.when(F.col("k") == 0, "zero").when(F.col("k") == 10, "")), F.col("event_id").alias("seed"), F.create_map(F.lit("value"), "value").alias("metrics"))


SPEC = "ledger_id string, protocol_id string, comparison_id string, position int, experiment_id string, arms array<string>, metric string, pairing string, uncertainty string, level double, seed long, samples long, policy string, threshold double"


def registered(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Comparisons from (comparison_id, experiment_id, control, treatment, metric, pairing, uncertainty, seed, samples, policy, threshold)."""
    return spark.createDataFrame([("L", "P", c, i, e, [a, b], m, p, u, 0.95, s, n, policy, t) for i, (c, e, a, b, m, p, u, s, n, policy, t) in enumerate(rows)], SPEC)


def user_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one chained ledger for each user; body: event_id and type."""
    from tallyfold.operators.chain import build_chain

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger_id"), "ts", "event_id", "event_type")
    return build_chain(rows, ["ts", "event_id"], body())


def body():
    return F.concat_ws("|", F.col("event_id").cast("string"), F.col("event_type"))
