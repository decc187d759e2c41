"""Registered comparisons of runs: who counts, who is missing, effects, intervals, inventory.

runs: ledger_id, protocol_id, experiment_id, run_id, arm, phase, status,
disposition STRUCT<included, reason, policy_reference>, seed, metrics MAP.
comparisons: ledger_id, protocol_id, comparison_id, position, experiment_id,
arms ARRAY [control, treatment], metric, pairing (paired, unpaired, none),
uncertainty (student_t, bootstrap, unavailable), level, seed, samples, policy
(none, bonferroni, holm, fdr), threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.digest import SUM, draw, draws, id_hash, id_sums, text_digest
from tallyfold.functions.student import t_critical
from tallyfold.operators.lineage import kept
from tallyfold.operators.ordered import chunked

KEY = ["ledger_id", "protocol_id", "comparison_id"]
#: Values of a comparison that the bootstrap holds in one array; more go by rows and a shuffle.
ARRAY_LIMIT = 100_000
#: Samples that share one copy of those arrays.
SAMPLE_BLOCK = 64
FINISHED = "COMPLETED"


def counts() -> Column:
    """A run counts if it is complete and not set aside; its phase doesn't matter."""
    return F.coalesce((F.col("status") == FINISHED) & F.col("disposition.included"), F.lit(False))


def included(runs: DataFrame) -> DataFrame:
    return runs.where(counts())


def exclusions(runs: DataFrame) -> DataFrame:
    """Runs that don't count, with reason and policy; for empty ones the run's status and its protocol's plan stand in."""
    told = lambda c, default: F.coalesce(F.nullif(F.col(f"disposition.{c}"), F.lit("")), default).alias(c)
    reason = told("reason", F.concat(F.lit("Run status is "), F.col("status")))
    return runs.where(~counts()).select("ledger_id", "protocol_id", "run_id", "status", reason, told("policy_reference", F.concat("protocol_id", F.lit("#analysis-plan"))))


def normalized(old: DataFrame) -> DataFrame:
    """Runs of the old shape (analysis_included, no arm or phase) in the shape of the new."""
    have = set(old.columns)
    flag = F.col("analysis_included") if "analysis_included" in have else F.lit(None).cast("boolean")
    own = F.col("disposition") if "disposition" in have else F.lit(None).cast("struct<included:boolean,reason:string,policy_reference:string>")
    text = F.lit(None).cast("string")
    rows = old.withColumn("disposition", F.struct(F.coalesce(own["included"], flag).alias("included"), own["reason"].alias("reason"), own["policy_reference"].alias("policy_reference")))
    for c in ("arm", "phase"):
        if c not in have:
            rows = rows.withColumn(c, text)
    return rows.drop("analysis_included")


def version_of(columns: dict[str, str]) -> Column:
    """Version of a record by the first of these columns that is filled; columns: name to version, newest first."""
    return F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(v)) for c, v in columns.items()), F.lit("1.0"))


def _sides(comparisons: DataFrame) -> DataFrame:
    sides = comparisons.select(*KEY, "experiment_id", "metric", F.posexplode("arms").alias("at", "arm")).where("at < 2")
    return sides.withColumn("side", F.when(F.col("at") == 0, "c").otherwise("t")).drop("at")


def observations(runs: DataFrame, comparisons: DataFrame) -> DataFrame:
    """KEY, side (c control, t treatment), run_id, seed, value, for the runs that count in each comparison."""
    joined = included(runs).join(_sides(comparisons), ["ledger_id", "protocol_id", "experiment_id", "arm"])
    return joined.select(*KEY, "side", "run_id", "seed", F.try_element_at("metrics", F.col("metric")).alias("value"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _arms(runs: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row per comparison: n, mean, sd, min, max by side.

    A side is one arm of an experiment, so arms are summed up first, by partial
    sums in each task, and only their sums meet the comparisons.
    """
    by, x = ["ledger_id", "protocol_id", "experiment_id", "arm"], F.col("value")
    opened = included(runs).select(*by, F.posexplode_outer("metrics").alias("at", "metric", "value"))
    first = F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0)  # a run's first row stands for it
    sums = opened.groupBy(*by, "metric").agg(first.alias("_runs"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.var_samp(x).alias("var"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(_finite(x)).alias("fine"))
    sums = kept(sums)  # a row for each arm and metric
    sides = _sides(comparisons).join(sums.groupBy(*by).agg(F.sum("_runs").alias("_runs")), by).join(sums.drop("_runs"), [*by, "metric"], "left")
    out = []
    for s in ("t", "c"):
        out += [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for c in ("n", "mean", "sd", "var", "min", "max")]
    out.append(F.sum(F.col("_runs") - F.coalesce("fine", F.lit(0))).alias("bad_values"))
    return sides.groupBy(*KEY).agg(*out)


def pairs(values: DataFrame) -> DataFrame:
    """KEY, seed, difference (treatment - control), faulty: a side is missing, there twice, or has no seed."""
    x = lambda s: F.when(F.col("side") == s, F.col("value"))
    by_seed = values.groupBy(*KEY, "seed").agg(F.count_if(F.col("side") == "t").alias("t"), F.count_if(F.col("side") == "c").alias("c"), (F.max(x("t")) - F.max(x("c"))).alias("difference"))
    return by_seed.select(*KEY, "seed", "difference", (F.col("seed").isNull() | (F.col("t") != 1) | (F.col("c") != 1)).alias("faulty"))


def _paired(values: DataFrame) -> DataFrame:
    d = F.when(~F.col("faulty"), F.col("difference"))
    return pairs(values).groupBy(*KEY).agg(F.count(d).alias("n_d"), F.avg(d).alias("mean_d"), F.stddev_samp(d).alias("sd_d"), F.count_if("faulty").alias("bad_pairs"))


def effective_level(level: Column, policy: Column, comparisons: Column) -> Column:
    return F.when(policy == "bonferroni", 1 - (1 - level) / comparisons).otherwise(level)


def bootstrap(values: DataFrame, comparisons: DataFrame, array_limit: int = ARRAY_LIMIT) -> DataFrame:
    """KEY, lower, upper: percentile bootstrap from the registered seed.

    Values are drawn in a fixed order: differences by seed, else treatment then
    control, each by run_id.  Draw i of sample b has the counter b * n + i, so
    samples are independent tasks.  Up to array_limit values of a comparison
    stand in arrays; beyond, each draw is a row that is joined with its value.
    """
    wanted = comparisons.where("uncertainty = 'bootstrap' and pairing in ('paired', 'unpaired')")
    single = wanted.select(*KEY, "pairing", "level", "seed", "samples", "effective")
    order = F.struct(F.col("seed").alias("n"), F.lit("").alias("r")).alias("o")
    paired = pairs(values).where("not faulty").join(single.where("pairing = 'paired'").select(*KEY), KEY).select(*KEY, F.lit("d").alias("side"), order, F.col("difference").alias("value"))
    lone = values.join(single.where("pairing = 'unpaired'").select(*KEY), KEY).select(*KEY, "side", F.struct(F.lit(0).cast("long").alias("n"), F.col("run_id").alias("r")).alias("o"), "value")
    rows = paired.union(lone)
    size = rows.groupBy(*KEY).agg(*(F.count_if(F.col("side") == s).alias(f"n{s}") for s in "dtc"))
    size = size.where("nd >= 2 or (nt >= 2 and nc >= 2)").join(single, KEY)
    total = F.col("nd") + F.col("nt") + F.col("nc")
    means = _array_means(rows, size.where(total <= array_limit)).union(_row_means(rows, size.where(total > array_limit)))
    alpha = 1 - F.col("effective")
    both = means.join(single.select(*KEY, "effective"), KEY)
    ends = both.groupBy(*KEY, "effective").agg(F.array_sort(F.collect_list("mean")).alias("m"))

    def quantile(p: Column) -> Column:
        at = p * (F.size("m") - 1)
        lo = F.floor(at).cast("int")
        a, b = F.get("m", lo), F.coalesce(F.get("m", lo + 1), F.get("m", lo))
        return a + (at - lo) * (b - a)

    return ends.select(*KEY, quantile(alpha / 2).alias("lower"), quantile(1 - alpha / 2).alias("upper"))


def _array_means(rows: DataFrame, size: DataFrame) -> DataFrame:
    arrays = rows.join(size.select(*KEY), KEY).groupBy(*KEY).agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("o", "value")))), lambda x: x["value"]).alias(s) for s in "dtc"))
    # the arrays go to blocks of samples, not to each sample
    blocks = size.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("samples") - 1) / SAMPLE_BLOCK)))).join(arrays, KEY).repartition(*KEY, "block")
    first = (F.col("block") * SAMPLE_BLOCK).cast("long")
    asked = blocks.select(*KEY, F.col("seed").cast("string").alias("seed"), first.alias("first"), F.least(first + SAMPLE_BLOCK, F.col("samples")).cast("long").alias("last"), *"dtc")

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out_b, out = [], [], []
            for i, (seed, lo, hi, d, t, c) in enumerate(zip(*(batch[x].to_pylist() for x in ("seed", "first", "last", *"dtc")), strict=True)):
                sides = [np.array(x, float) for x in ([d] if d else [t, c])]
                n = sum(map(len, sides))
                for b in range(lo, hi):
                    picks, found = b * n, []
                    for side in sides:
                        found.append(side[draws(seed, picks, len(side))].sum() / len(side))
                        picks += len(side)
                    at.append(i)
                    out_b.append(b)
                    out.append(found[0] if d else found[0] - found[1])
            keys = [batch[k].take(pa.array(at, pa.int64())) for k in KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(out_b, pa.int64()), pa.array(out, pa.float64())], [*KEY, "b", "mean"])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return asked.mapInArrow(means, ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", b long, mean double")


def _row_means(rows: DataFrame, size: DataFrame) -> DataFrame:
    place = Window.partitionBy(*KEY, "side").orderBy("o")
    numbered = rows.join(size.select(*KEY), KEY).select(*KEY, "side", (F.row_number().over(place) - 1).cast("long").alias("at"), "value")
    n = F.when(F.col("side") == "d", F.col("nd")).when(F.col("side") == "t", F.col("nt")).otherwise(F.col("nc"))
    sides = F.when(F.col("nd") > 0, F.array(F.lit("d"))).otherwise(F.array(F.lit("t"), F.lit("c")))
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.col("samples") - 1))
    draws = size.withColumn("b", b).withColumn("side", F.explode(sides)).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    counter = F.col("b") * (F.col("nd") + F.col("nt") + F.col("nc")) + F.col("i") + F.when(F.col("side") == "c", F.col("nt")).otherwise(0)
    picked = draws.select(*KEY, "b", "side", draw(F.col("seed"), counter, F.col("n")).alias("at")).join(numbered, [*KEY, "side", "at"])
    sign = F.when(F.col("side") == "c", -1.0).otherwise(1.0)
    means = picked.groupBy(*KEY, "b", "side").agg((F.avg("value") * F.first(sign)).alias("m"))
    return means.groupBy(*KEY, "b").agg(F.sum("m").alias("mean"))


def compare(runs: DataFrame, comparisons: DataFrame, intervals: bool = True) -> DataFrame:
    """One row per comparison: descriptives, estimate, standardized effect, interval, threshold; problem says why there is none.

    A comparison without runs in an arm, with values that are missing or not
    finite, or (paired) without identical unique seeds has a problem and no
    estimate.  An interval that can't be had says why in unc_reason.
    """
    registered = comparisons.withColumn("effective", effective_level(F.col("level"), F.col("policy"), F.count("*").over(Window.partitionBy("ledger_id", "protocol_id"))))
    values = observations(runs, registered)
    rows = registered.join(_arms(runs, registered), KEY, "left")
    pairing = registered.where("pairing = 'paired'").select(*KEY)
    if pairing.isEmpty():  # no second pass over the runs
        rows = rows.select("*", F.lit(0).cast("long").alias("n_d"), *(F.lit(None).cast("double").alias(c) for c in ("mean_d", "sd_d")), F.lit(0).cast("long").alias("bad_pairs"))
    else:
        rows = rows.join(_paired(values.join(pairing, KEY)), KEY, "left")
    rows = kept(rows.na.fill(0, ["n_t", "n_c", "n_d", "bad_values", "bad_pairs"]))  # a row for each comparison
    return concluded(rows, intervals, lambda wanted: bootstrap(values, wanted))


def concluded(rows: DataFrame, intervals: bool = True, drawn: Callable[[DataFrame], DataFrame] | None = None, keys: list[str] = KEY) -> DataFrame:
    """compare()'s results from what is known of each comparison's values.

    rows: the registered comparison with its effective level, and n, mean, sd,
    var, min, max of both sides (n_t, n_c, ...), n_d, mean_d and sd_d of the
    differences, bad_values and bad_pairs.  drawn: bootstrap intervals of the
    comparisons that want them; without, these stay null.
    """
    paired = F.col("pairing") == "paired"
    problem = F.when((F.col("n_t") == 0) | (F.col("n_c") == 0), "an arm has no runs that count").when(F.col("bad_values") > 0, "a value is missing or not finite").when(paired & (F.col("bad_pairs") > 0), "arms don't have the same unique seeds")
    rows = rows.withColumn("problem", problem)
    fine = F.col("problem").isNull()
    estimate = F.when(fine, F.when(paired, F.col("mean_d")).otherwise(F.col("mean_t") - F.col("mean_c")))
    nt, nc = F.col("n_t"), F.col("n_c")
    pooled = ((nt - 1) * F.coalesce("var_t", F.lit(0.0)) + (nc - 1) * F.coalesce("var_c", F.lit(0.0))) / (nt + nc - 2)
    std_reason = F.when(paired, F.when(F.col("n_d") < 2, "needs two pairs").when(F.col("sd_d") == 0, "differences have no variance")).otherwise(F.when((nt < 2) | (nc < 2), "needs two observations per arm").when(pooled == 0, "arms have no variance"))
    rows = rows.withColumn("estimate", estimate).withColumn("std_reason", F.when(fine, std_reason))
    std = F.when(fine & F.col("std_reason").isNull(), F.when(paired, F.col("estimate") / F.col("sd_d")).otherwise(F.col("estimate") / F.sqrt(pooled)))
    rows = rows.withColumn("std_estimate", std).withColumn("std_method", F.when(F.col("std_estimate").isNull(), "unavailable").when(paired, "paired_dz").otherwise("cohens_d"))
    vt, vc = F.col("var_t") / nt, F.col("var_c") / nc
    down = vt * vt / (nt - 1) + vc * vc / (nc - 1)
    welch = F.when(down > 0, (vt + vc) * (vt + vc) / down).otherwise((nt + nc - 2).cast("double"))
    reason = (
        F.when(F.col("policy").isin("holm", "fdr"), F.concat(F.col("policy"), F.lit(" has no interval")))
        .when(F.col("uncertainty") == "unavailable", "registered as unavailable")
        .when(F.col("pairing") == "none", "pairing none has no sampling model")
        .when(paired & (F.col("n_d") < 2), "needs two pairs")
        .when(~paired & ((nt < 2) | (nc < 2)), "needs two observations per arm")
    )
    student = fine & F.col("unc_reason").isNull() & (F.col("uncertainty") == "student_t")
    rows = rows.withColumn("unc_reason", F.when(fine, reason))
    rows = rows.withColumn("effective_level", F.when(F.col("policy").isin("holm", "fdr"), F.col("level")).otherwise(F.col("effective")))
    rows = rows.withColumn("se", F.when(student, F.when(paired, F.col("sd_d") / F.sqrt("n_d")).otherwise(F.sqrt(vt + vc))))
    rows = rows.withColumn("df", F.when(student, F.when(paired, (F.col("n_d") - 1).cast("double")).otherwise(welch)))
    rows = rows.withColumn("unc_method", F.when(fine & F.col("unc_reason").isNull(), F.col("uncertainty")).otherwise("unavailable"))
    if intervals:
        # one row per comparison reaches the solver
        rows = rows.withColumn("margin", F.when(F.col("se") > 0, t_critical(F.col("effective_level"), F.col("df")) * F.col("se")).when(F.col("se") == 0, 0.0))
        wanted = rows.where("unc_method = 'bootstrap'").withColumn("effective", F.col("effective_level"))
        if drawn is None or wanted.isEmpty():
            rows = rows.withColumn("lower", F.lit(None).cast("double")).withColumn("upper", F.lit(None).cast("double"))
        else:
            rows = rows.join(drawn(wanted), KEY, "left")
        rows = rows.withColumn("lower", F.coalesce(F.col("estimate") - F.col("margin"), F.col("lower"))).withColumn("upper", F.coalesce(F.col("estimate") + F.col("margin"), F.col("upper")))
    else:
        rows = rows.withColumn("lower", F.lit(None).cast("double")).withColumn("upper", F.lit(None).cast("double"))
    exceeds = F.when(F.col("threshold").isNotNull(), F.abs("estimate") >= F.col("threshold"))
    side = [F.col(f"{x}_{s}") for s in "tc" for x in ("n", "mean", "sd", "min", "max")]
    return rows.select(*keys, "position", "experiment_id", "metric", F.col("arms")[1].alias("treatment_arm"), F.col("arms")[0].alias("control_arm"), "pairing", *side, "n_d", "sd_d", "estimate", "std_method", "std_reason", "std_estimate", "unc_method", "unc_reason", F.col("level").alias("requested_level"), "effective_level", "se", "df", "lower", "upper", "seed", "samples", "threshold", exceeds.alias("exceeds"), "problem")


def inventory(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Per protocol, run ids: all, included, excluded, failed; and of the expected ones (ledger_id, protocol_id, run_id) those missing."""
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("run_id"))))
    by = ["ledger_id", "protocol_id"]
    own = runs.groupBy(*by).agg(ids(F.lit(True)).alias("all_runs"), ids(counts()).alias("included_runs"), ids(~counts()).alias("excluded_runs"), ids(F.col("status") == "FAILED").alias("failed_runs"))
    missing = missing_runs(runs, expected).groupBy(*by).agg(F.array_sort(F.collect_set("run_id")).alias("missing_runs"))
    none = F.array().cast("array<string>")
    out = own.join(missing, by, "full_outer")
    return out.select(*by, *(F.coalesce(c, none).alias(c) for c in ("all_runs", "included_runs", "excluded_runs", "failed_runs", "missing_runs")))


def missing_runs(runs: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.join(runs, ["ledger_id", "protocol_id", "run_id"], "left_anti")


def bundles(results: DataFrame, runs: DataFrame, expected: DataFrame) -> DataFrame:
    """One nested record per protocol: its comparisons in registered order, its inventory and its exclusions."""
    by = ["ledger_id", "protocol_id"]
    names = [c for c in results.columns if c not in (*by, "position")]
    own = results.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*names).alias("x")))), lambda s: s["x"]).alias("comparisons"))
    out = exclusions(runs).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("run_id", "reason", "policy_reference"))).alias("exclusions"))
    return own.join(inventory(runs, expected), by, "left").join(out, by, "left")


#: Run ids in one chunk of an inventory.
CHUNK = 10_000
KINDS = ("all", "included", "excluded", "failed", "missing")


def _listed(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """ledger_id, protocol_id, kind, run_id: a row for each list that a run is in, and each expected one that is missing."""
    by = ["ledger_id", "protocol_id"]
    of = F.array_compact(F.array(F.lit("all"), F.when(counts(), "included").otherwise("excluded"), F.when(F.col("status") == "FAILED", "failed")))
    return runs.select(*by, F.explode(of).alias("kind"), "run_id").unionByName(missing_runs(runs, expected).select(*by, F.lit("missing").alias("kind"), "run_id").distinct())


def inventory_chunks(runs: DataFrame, expected: DataFrame, size: int = CHUNK) -> DataFrame:
    """ledger_id, protocol_id, kind (see KINDS), chunk, items: the sorted run ids of each list, `size` a row."""
    return chunked(_listed(runs, expected), ["ledger_id", "protocol_id", "kind"], "run_id", size)


def inventory_digests(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """ledger_id, protocol_id, kind, n, digest of each list of run ids: the same whatever the chunks, and without any being made.

    The digest is that of the number of ids and two sums of their hashes, so it
    is made of partial sums.
    """
    rows = _listed(runs, expected).groupBy("ledger_id", "protocol_id", "kind").agg(F.count("*").alias("n"), F.sum(id_hash(1, F.col("run_id"))).alias("a"), F.sum(id_hash(2, F.col("run_id"))).alias("b"))
    return rows.select("ledger_id", "protocol_id", "kind", "n", inventory_digest(F.col("n"), F.col("a"), F.col("b")).alias("digest"))


def inventory_digest(n: Column, a: Column, b: Column) -> Column:
    return text_digest(F.concat_ws(":", n.cast("string"), a.cast(SUM).cast("string"), b.cast(SUM).cast("string")))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """inventory_digests() from chunks, however they are cut."""
    s = id_sums(F.col("items"))
    rows = chunks.select("ledger_id", "protocol_id", "kind", s.alias("s")).groupBy("ledger_id", "protocol_id", "kind").agg(F.sum("s.n").alias("n"), F.sum("s.a").alias("a"), F.sum("s.b").alias("b"))
    return rows.select("ledger_id", "protocol_id", "kind", "n", inventory_digest(F.col("n"), F.col("a"), F.col("b")).alias("digest"))


def bundle_records(results: DataFrame, runs: DataFrame, expected: DataFrame) -> DataFrame:
    """One record per protocol: its comparisons in registered order, and of each list of runs the number, the digest and the chunks that hold it (see inventory_chunks()).

    Only what is registered, comparisons and kinds of lists, is gathered in a
    row; runs aren't, so a protocol may have any number.
    """
    by = ["ledger_id", "protocol_id"]
    names = [c for c in results.columns if c not in (*by, "position")]
    own = results.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*names).alias("x")))), lambda s: s["x"]).alias("comparisons"))
    told = F.struct("n", "digest", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    lists = inventory_digests(runs, expected).groupBy(*by).agg(*(F.max(F.when(F.col("kind") == k, told)).alias(f"{k}_runs") for k in KINDS))
    return own.join(lists, by, "left")


def legacy_summary(runs: DataFrame) -> DataFrame:
    """Old-style means by metric with a fixed normal margin, where all runs that count report the same metrics; else problem."""
    by = ["ledger_id", "protocol_id"]
    rows = included(runs).withColumn("names", F.array_sort(F.map_keys("metrics")))
    same = rows.groupBy(*by).agg((F.count_distinct("names") > 1).alias("mixed"))
    values = rows.select(*by, F.explode("metrics").alias("metric", "value")).groupBy(*by, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    margin = 1.96 * F.coalesce("sd", F.lit(0.0)) / F.sqrt("n")
    return values.join(same, by).select(*by, "metric", "n", F.when(~F.col("mixed"), F.col("mean")).alias("mean"), F.when(~F.col("mixed"), F.col("mean") - margin).alias("lower"), F.when(~F.col("mixed"), F.col("mean") + margin).alias("upper"), F.when(F.col("mixed"), "runs report different metrics").alias("problem"))


def recheck(recorded: DataFrame, runs: DataFrame, comparisons: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Recorded results (KEY, sequence, estimate, lower, upper) against those rebuilt from the runs recorded before each.

    runs has a sequence too.  Returns the rows that differ by more than the tolerance, relative to 1 or the value.
    """
    at = recorded.select("ledger_id", "protocol_id", "sequence").distinct().withColumnRenamed("sequence", "as_of")
    before = runs.join(at, ["ledger_id", "protocol_id"]).where("sequence < as_of")
    tag = F.concat_ws("@", "protocol_id", "as_of")
    then = before.withColumn("protocol_id", tag).drop("as_of", "sequence")
    spec = comparisons.join(at, ["ledger_id", "protocol_id"]).withColumn("protocol_id", tag).drop("as_of")
    rebuilt = kept(compare(then, spec)).select(*KEY, *(F.col(c).alias(f"new_{c}") for c in ("estimate", "lower", "upper")))
    old = recorded.withColumn("own_protocol", F.col("protocol_id")).withColumn("protocol_id", F.concat_ws("@", "protocol_id", "sequence"))
    differs = lambda a, b: ~F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(b)), a.isNull() & b.isNull())
    both = old.join(rebuilt, KEY, "left")
    bad = [differs(F.col(c), F.col(f"new_{c}")) for c in ("estimate", "lower", "upper")]
    return both.where(bad[0] | bad[1] | bad[2]).select("ledger_id", F.col("own_protocol").alias("protocol_id"), "comparison_id", "sequence", "estimate", "new_estimate")
