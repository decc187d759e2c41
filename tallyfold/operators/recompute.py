"""Recorded result bundles against those that the runs recorded before them give, all bundles of all ledgers in one pass.

A run counts for every bundle of its protocol after it.  Runs are summed up
between one bundle and the next (count, mean, squared deviations, least, most:
moments that merge), and a bundle's are the merged ones of all stretches before
it, so a run is read once however many bundles follow.  Lists of run ids are
compared as multisets: their number and two sums of hashes, which merge alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.digest import SUM, id_hash, id_sums
from tallyfold.operators import compare
from tallyfold.operators.chain import union, violations
from tallyfold.operators.lineage import kept
from tallyfold.operators.ordered import carried

BY = ["ledger_id", "program_id", "protocol_id"]
OF = [*BY, "comparison_id", "side"]
# The form of a recorded bundle that names registered comparisons, members of it and of the older one, and of a registered analysis.
NESTED = "result-bundle/1.1"
_SIDE = "struct<n:long,mean:double,sample_stddev:double,min:double,max:double>"
_METRIC = (
    f"struct<descriptive:struct<treatment:{_SIDE},control:{_SIDE}>,effect:struct<method:string,estimate:double,standardized:struct<method:string,estimate:double,reason:string>>,"
    "uncertainty:struct<method:string,requested_level:double,effective_level:double,lower:double,upper:double,degrees_of_freedom:double,seed:long,samples:long,reason:string>,practical_significance:struct<threshold:double,exceeds_threshold:boolean>>"
)
BUNDLE = (
    "schema_version string, bundle_id string, program_id string, protocol_id string, multiple_comparison_policy string, comparisons array<struct<comparison_id:string,experiment_id:string,treatment_arm:string,control_arm:string,pairing:string,"
    f"run_ids:struct<treatment:array<string>,control:array<string>>,metrics:map<string,{_METRIC}>>>, run_inventory struct<all_run_ids:array<string>,included_run_ids:array<string>,excluded_runs:array<struct<run_id:string,status:string,reason:string,policy_reference:string>>,failed_run_ids:array<string>,missing_run_ids:array<string>>"
)
OLD_BUNDLE = "included_run_ids array<string>, excluded_run_ids array<string>, runs array<struct<run_id:string>>, metrics map<string,struct<n:long,mean:double,sample_stddev:double,ci95_lower:double,ci95_upper:double>>"
ANALYSIS = (
    "comparisons array<struct<comparison_id:string,experiment_id:string,arms:array<string>,metric:string,pairing:string,uncertainty_method:string,confidence_level:double,bootstrap_seed:long,bootstrap_samples:long>>, "
    "multiple_comparison_policy string, practical_significance_thresholds map<string,double>, expected_run_ids array<string>"
)

def dated(runs: DataFrame, bundles: DataFrame) -> DataFrame:
    """runs with as_of, the sequence of their protocol's first bundle after them; those that no bundle follows go."""
    own = [c for c in runs.columns if c not in (*BY, "sequence")]
    told = runs.select(*BY, "sequence", F.struct(*own).alias("r"), F.lit(None).cast("long").alias("at"))
    marks = bundles.select(*BY, "sequence", F.lit(None).cast(told.schema["r"].dataType).alias("r"), F.col("sequence").cast("long").alias("at"))
    return carried(told.union(marks), BY, ["sequence"], {"as_of": F.col("at")}, back=True).where("r is not null and as_of is not null").select(*BY, "as_of", "sequence", "r.*")


def moments(values: DataFrame, by: list[str]) -> DataFrame:
    """by, as_of, n, mean, m2, least, most, bad: of the values between two bundles."""
    x = F.col("value")
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.when(fine, x)
    return values.groupBy(*by, "as_of").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_if(~fine).alias("bad"))


def merged(parts: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """asked (by, as_of) with n, mean, m2, least, most, bad of all parts up to it; each part's as_of is asked for.

    Means are taken about the mean of all, so that little is lost where they
    are large beside the deviations.
    """
    rows = asked.select(*by, "as_of").distinct().join(parts, [*by, "as_of"], "left").na.fill(0, ["n", "bad"])
    every = Window.partitionBy(*by)
    up = every.orderBy("as_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = F.col("n").cast("double")
    rows = rows.withColumn("_c", F.try_divide(F.sum(w * F.col("mean")).over(every), F.sum(w).over(every))).withColumn("_d", F.col("mean") - F.col("_c"))
    n, d = F.sum("n").over(up), F.sum(w * F.col("_d")).over(up)
    rows = rows.select(*by, "as_of", "_c", n.alias("_n"), F.try_divide(d, n).alias("_m"), F.sum(F.col("m2") + w * F.col("_d") * F.col("_d")).over(up).alias("_q"), F.min("least").over(up).alias("least"), F.max("most").over(up).alias("most"), F.sum("bad").over(up).alias("bad"))
    m2 = F.when(F.col("least") == F.col("most"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("_q") - F.col("_n") * F.col("_m") * F.col("_m")))
    return rows.select(*by, "as_of", F.col("_n").alias("n"), (F.col("_c") + F.col("_m")).alias("mean"), m2.alias("m2"), "least", "most", "bad")


def differences(values: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (comparison, as_of) with n_d, mean_d, m2_d of the paired differences up to it, and bad_pairs, the seeds that aren't there once in both arms.

    A seed is bad from its first run until it has one in each arm, and again
    from the run that makes a second one; without a seed, a run stays bad.
    """
    by = OF[:-1]
    seeds = values.where("seed is not null").groupBy(*by, "seed", "side", "as_of").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    w = Window.partitionBy(*by, "seed", "side")
    seeds = seeds.withColumn("_first", F.min("as_of").over(w))
    again = F.min(F.when((F.col("as_of") > F.col("_first")) | (F.col("n") > 1), F.col("as_of")))
    at = lambda s: F.min(F.when(F.col("side") == s, F.col("as_of")))
    x = lambda s: F.min_by(F.when(F.col("side") == s, F.col("value")), F.when(F.col("side") == s, F.col("as_of")))
    pairs = seeds.groupBy(*by, "seed").agg(at("t").alias("_t"), at("c").alias("_k"), again.alias("_again"), (x("t") - x("c")).alias("value"))
    whole = F.when(F.col("_t").isNotNull() & F.col("_k").isNotNull(), F.greatest("_t", "_k"))
    pairs = pairs.select(*by, F.least("_t", "_k").alias("seen"), whole.alias("whole"), F.when(whole.isNotNull() & F.col("_again").isNotNull(), F.greatest(whole, F.col("_again"))).alias("spoilt"), "value")
    changes = F.array(F.struct(F.col("seen").alias("as_of"), F.lit(1).alias("k")), F.struct(F.col("whole").alias("as_of"), F.lit(-1).alias("k")), F.struct(F.col("spoilt").alias("as_of"), F.lit(1).alias("k")))
    bad = pairs.select(*by, F.explode(changes).alias("c")).select(*by, "c.as_of", "c.k").where("as_of is not null")
    bad = bad.unionByName(values.where("seed is null").select(*by, "as_of", F.lit(1).alias("k"))).groupBy(*by, "as_of").agg(F.sum("k").alias("k"))
    up = Window.partitionBy(*by).orderBy("as_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = asked.select(*by, "as_of").distinct().join(bad, [*by, "as_of"], "left").select(*by, "as_of", F.coalesce(F.sum("k").over(up), F.lit(0)).alias("bad_pairs"))
    of_pairs = merged(moments(pairs.where("whole is not null").withColumnRenamed("whole", "as_of"), by), asked, by)
    return of_pairs.select(*by, "as_of", F.col("n").alias("n_d"), F.col("mean").alias("mean_d"), F.col("m2").alias("m2_d")).join(bad, [*by, "as_of"])


def results_at(runs: DataFrame, bundles: DataFrame, comparisons: DataFrame) -> DataFrame:
    """compare()'s results as of each bundle: BY, comparison_id, as_of and the rest.

    runs: dated() ones with compare's columns; bundles: BY, sequence;
    comparisons: compare's columns with program_id.  Bootstrap intervals need the
    values themselves and are left null; see drawn_at().
    """
    level = compare.effective_level(F.col("level"), F.col("policy"), F.count("*").over(Window.partitionBy(*BY)))
    registered = comparisons.withColumn("effective", level)
    asked = bundles.select(*BY, F.col("sequence").cast("long").alias("as_of")).join(registered.select(*BY, "comparison_id", "pairing"), BY)
    sides = registered.select(*BY, "comparison_id", "experiment_id", "metric", F.posexplode("arms").alias("_at", "arm")).where("_at < 2").withColumn("side", F.when(F.col("_at") == 0, "c").otherwise("t"))
    own = compare.included(runs).join(sides, [*BY, "experiment_id", "arm"])
    values = own.select(*OF, "as_of", "seed", F.try_element_at("metrics", F.col("metric")).alias("value"))
    both = asked.select(*BY, "comparison_id", "as_of", F.explode(F.array(F.lit("t"), F.lit("c"))).alias("side"))
    of_arms = merged(moments(values, OF), both, OF)
    wide = []
    for s in ("t", "c"):
        x = lambda c, s=s: F.max(F.when(F.col("side") == s, c))
        var = F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1))
        wide += [x(F.col("n")).alias(f"n_{s}"), x(F.col("mean")).alias(f"mean_{s}"), x(F.sqrt(var)).alias(f"sd_{s}"), x(var).alias(f"var_{s}"), x(F.col("least")).alias(f"min_{s}"), x(F.col("most")).alias(f"max_{s}")]
    by = [*BY, "comparison_id", "as_of"]
    rows = of_arms.groupBy(*by).agg(*wide, F.sum("bad").alias("bad_values")).join(registered, [*BY, "comparison_id"])
    paired = values.join(registered.where("pairing = 'paired'").select(*BY, "comparison_id"), [*BY, "comparison_id"])
    of_pairs = differences(paired, asked.where("pairing = 'paired'"))
    sd = F.when(F.col("n_d") > 1, F.sqrt(F.col("m2_d") / (F.col("n_d") - 1)))
    rows = rows.join(of_pairs.select(*by, "n_d", "mean_d", sd.alias("sd_d"), "bad_pairs"), by, "left").na.fill(0, ["n_d", "bad_pairs"])
    return compare.concluded(kept(rows), keys=by)


def _same(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(b)), a.isNull() & b.isNull())


def compared(recorded: DataFrame, rebuilt: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Breaches of nested bundles' comparisons: recorded has BY, sequence, id and comparisons as in BUNDLE, rebuilt is results_at()."""
    c = recorded.select(*BY, "sequence", "id", F.posexplode("comparisons").alias("place", "c")).select(*BY, "sequence", "id", "place", F.col("c.comparison_id").alias("comparison_id"), "c")
    again = violations(c.groupBy(*BY, "sequence", "id", "comparison_id").agg(F.count("*").alias("n")).where("n > 1"), {"bundle: comparison repeated": F.lit(True)}, "id")
    there = rebuilt.withColumnRenamed("as_of", "sequence").withColumn("_there", F.lit(True))
    wanted = recorded.select(*BY, "sequence", "id").join(there, [*BY, "sequence"])
    both = wanted.join(c.withColumn("_told", F.lit(True)), [*BY, "sequence", "id", "comparison_id"], "full_outer")
    m = F.try_element_at("c.metrics", F.col("metric"))
    told, same = F.coalesce("_told", F.lit(False)), lambda path, own: _same(m.getField(path[0]).getField(path[1]) if len(path) == 2 else m[path[0]][path[1]][path[2]], F.col(own), tolerance)
    text = lambda a, b: a.eqNullSafe(b)
    side = F.lit(True)
    for s, name in (("t", "treatment"), ("c", "control")):
        for field, own in (("n", "n"), ("mean", "mean"), ("sample_stddev", "sd"), ("min", "min"), ("max", "max")):
            side = side & same(("descriptive", name, field), f"{own}_{s}")
    fine = F.col("problem").isNull()
    effect = same(("effect", "estimate"), "estimate") & same(("effect", "standardized", "estimate"), "std_estimate") & text(m["effect"]["standardized"]["method"], F.col("std_method"))
    drawn = F.col("unc_method") == "bootstrap"
    interval = text(m["uncertainty"]["method"], F.col("unc_method")) & same(("uncertainty", "requested_level"), "requested_level") & same(("uncertainty", "effective_level"), "effective_level") & same(("uncertainty", "degrees_of_freedom"), "df")
    interval = interval & (drawn | (same(("uncertainty", "lower"), "lower") & same(("uncertainty", "upper"), "upper")))
    interval = interval & (~drawn | (text(m["uncertainty"]["seed"], F.col("seed")) & text(m["uncertainty"]["samples"], F.col("samples"))))
    meaning = same(("practical_significance", "threshold"), "threshold") & text(m["practical_significance"]["exceeds_threshold"], F.col("exceeds"))
    sides = text(F.col("c.experiment_id"), F.col("experiment_id")) & text(F.col("c.treatment_arm"), F.col("treatment_arm")) & text(F.col("c.control_arm"), F.col("control_arm")) & text(F.col("c.pairing"), F.col("pairing")) & (F.size("c.metrics") == 1) & m.isNotNull() & text(F.col("place"), F.col("position"))
    wrong = lambda ok: told & fine & ~F.coalesce(ok, F.lit(False))
    known = F.coalesce("_there", F.lit(False))
    return union([again, violations(
        both,
        {
            "bundle: can't be rebuilt": known & ~fine, "bundle: comparison missing": known & ~told, "bundle: unknown comparison": ~known,
            "bundle: comparison": known & wrong(sides), "bundle: descriptive": known & wrong(side), "bundle: effect": known & wrong(effect), "bundle: interval": known & wrong(interval), "bundle: significance": known & wrong(meaning),
        },
        "id",
    )])


def drawn_at(recorded: DataFrame, runs: DataFrame, comparisons: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Breaches of bootstrap intervals; a bundle's runs are drawn from anew, as no sum of them will do."""
    boot = comparisons.where("uncertainty = 'bootstrap' and pairing in ('paired', 'unpaired') and policy not in ('holm', 'fdr')")
    tag = F.concat_ws("@", "protocol_id", "program_id").alias("protocol_id")
    u = F.element_at(F.map_values("c.metrics"), 1)
    told = recorded.select(*BY, "sequence", "id", F.explode("comparisons").alias("c")).select(*BY, "sequence", "id", F.col("c.comparison_id").alias("comparison_id"), u["effect"]["estimate"].alias("estimate"), u["uncertainty"]["lower"].alias("lower"), u["uncertainty"]["upper"].alias("upper"))
    told = told.join(boot.select(*BY, "comparison_id"), [*BY, "comparison_id"], "left_semi")
    flat = lambda df, *columns: df.select("ledger_id", tag, *columns)
    rest = [c for c in comparisons.columns if c not in BY]
    level = compare.effective_level(F.col("level"), F.col("policy"), F.count("*").over(Window.partitionBy(*BY)))
    boot = boot.join(comparisons.select(*BY, "comparison_id", level.alias("_level")), [*BY, "comparison_id"]).withColumn("level", F.col("_level")).withColumn("policy", F.lit("none"))
    bad = compare.recheck(flat(told, "comparison_id", "sequence", "estimate", "lower", "upper"), flat(runs, *[c for c in runs.columns if c not in (*BY, "as_of")]), flat(boot, *rest), tolerance)
    named = flat(told, "comparison_id", "sequence", "id").distinct()
    return violations(bad.join(named, ["ledger_id", "protocol_id", "comparison_id", "sequence"]), {"bundle: interval": F.lit(True)}, "id")


def inventories(recorded: DataFrame, runs: DataFrame, expected: DataFrame, sorted_lists: bool = True) -> DataFrame:
    """Breaches of bundles' lists of runs.

    recorded: BY, sequence, id and some of all_ids, included_ids, excluded_ids,
    failed_ids, missing_ids (arrays of texts; null: not told); runs: dated()
    ones; expected: BY, run_id.
    """
    counts, failed = compare.counts(), F.col("status") == "FAILED"
    kinds = {"all": F.lit(True), "included": counts, "excluded": ~counts, "failed": failed}
    sums = []
    for k, c in kinds.items():
        sums += [F.count_if(c).alias(f"n_{k}"), F.sum(F.when(c, id_hash(1, F.col("run_id")))).alias(f"a_{k}"), F.sum(F.when(c, id_hash(2, F.col("run_id")))).alias(f"b_{k}")]
    parts = runs.groupBy(*BY, "as_of").agg(*sums)
    wanted = expected.select(*BY, "run_id").distinct()
    seen = wanted.join(runs.groupBy(*BY, "run_id").agg(F.min("as_of").alias("as_of")), [*BY, "run_id"])
    found = seen.groupBy(*BY, "as_of").agg(F.count("*").alias("n_seen"), F.sum(id_hash(1, F.col("run_id"))).alias("a_seen"), F.sum(id_hash(2, F.col("run_id"))).alias("b_seen"))
    whole = wanted.groupBy(*BY).agg(F.count("*").alias("n_want"), F.sum(id_hash(1, F.col("run_id"))).alias("a_want"), F.sum(id_hash(2, F.col("run_id"))).alias("b_want"))
    up = Window.partitionBy(*BY).orderBy("as_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = recorded.select(*BY, F.col("sequence").cast("long").alias("as_of")).distinct().join(parts, [*BY, "as_of"], "left").join(found, [*BY, "as_of"], "left")
    to = lambda c: F.coalesce(c, F.lit(0)).cast(SUM)
    rows = rows.select(*BY, "as_of", *(F.sum(to(F.col(f"{x}_{k}"))).over(up).alias(f"{x}_{k}") for k in (*kinds, "seen") for x in "nab")).join(whole, BY, "left")
    rows = rows.select("*", *((to(F.col(f"{x}_want")) - F.col(f"{x}_seen")).alias(f"{x}_missing") for x in "nab"))
    both = recorded.withColumn("as_of", F.col("sequence").cast("long")).join(rows, [*BY, "as_of"])
    rules = {}
    for k in (*kinds, "missing"):
        ids = F.col(f"{k}_ids")
        own = id_sums(ids)
        ok = (to(own["n"]) == F.col(f"n_{k}")) & (own["a"] == F.col(f"a_{k}")) & (own["b"] == F.col(f"b_{k}"))
        rules[f"bundle: {k} runs"] = ids.isNotNull() & ~F.coalesce(ok & ((F.array_sort(ids) == ids) if sorted_lists else F.lit(True)), F.lit(False))
    return violations(both, rules, "id")


def old_summaries(recorded: DataFrame, runs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Breaches of bundles of the old form: recorded has BY, sequence, id, metrics (name to n, mean, sample_stddev, ci95_lower, ci95_upper)."""
    own = compare.included(runs)
    asked = recorded.select(*BY, F.col("sequence").cast("long").alias("as_of")).distinct()
    names = F.xxhash64(F.array_sort(F.map_keys("metrics")))
    up = Window.partitionBy(*BY).orderBy("as_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = own.groupBy(*BY, "as_of").agg(F.min(names).alias("lo"), F.max(names).alias("hi"), F.count("*").alias("k"), F.min(F.size("metrics")).alias("size"))
    sets = asked.join(sets, [*BY, "as_of"], "left").select(*BY, "as_of", F.min("lo").over(up).alias("lo"), F.max("hi").over(up).alias("hi"), F.sum("k").over(up).alias("k"), F.min("size").over(up).alias("size"))
    values = own.select(*BY, "as_of", F.explode("metrics").alias("metric", "value"))
    of_metric = asked.join(values.select(*BY, "metric").distinct(), BY)
    now = merged(moments(values, [*BY, "metric"]), of_metric, [*BY, "metric"]).where("n + bad > 0")
    told = recorded.select(*BY, F.col("sequence").cast("long").alias("as_of"), "id", F.explode("metrics").alias("metric", "m"))
    both = now.join(recorded.select(*BY, F.col("sequence").cast("long").alias("as_of"), "id"), [*BY, "as_of"]).join(told, [*BY, "as_of", "id", "metric"], "full_outer")
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    margin = 1.96 * sd / F.sqrt("n")
    same = F.lit(True)
    for field, value in (("n", F.col("n")), ("mean", F.col("mean")), ("sample_stddev", sd), ("ci95_lower", F.col("mean") - margin), ("ci95_upper", F.col("mean") + margin)):
        same = same & _same(F.col(f"m.{field}"), value, tolerance)
    unfit = recorded.withColumn("as_of", F.col("sequence").cast("long")).join(sets, [*BY, "as_of"], "left")
    bad = F.coalesce(F.col("k"), F.lit(0)) == 0
    both = both.withColumn("sequence", F.col("as_of"))
    return union([
        violations(unfit, {"bundle: can't be rebuilt": bad | (F.col("lo") != F.col("hi")) | (F.col("size") == 0)}, "id"),
        violations(both, {"bundle: can't be rebuilt": F.col("bad") > 0, "bundle: metrics": ~F.coalesce(same, F.lit(False))}, "id"),
    ]).distinct()


def analyses(events: DataFrame, rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """ledger_id, sequence, object_id, rule: recorded bundles that the runs before them don't give; rows: state.parsed() of events."""
    from tallyfold.operators import state

    text = rows.where("type = 'analysis.computed' and p.bundle is not null").select("ledger_id", "sequence", "id", F.col("p.program_id").alias("program_id"), F.col("p.protocol_id").alias("protocol_id"), F.col("p.bundle").alias("text"))
    drafted = state.created(events, "protocol.drafted").select("ledger_id", "program_id", F.col("id").alias("protocol_id"), F.col("sequence").alias("_drafted"), F.from_json("analysis_spec", ANALYSIS).alias("s"))
    form = F.get_json_object("text", "$.schema_version") == NESTED
    bundles = kept(text.join(drafted.select("ledger_id", "protocol_id", "_drafted", F.col("s").isNotNull().alias("_spec")), ["ledger_id", "protocol_id"], "left").withColumn("nested", F.coalesce(form & (F.col("_drafted") < F.col("sequence")), F.lit(False))))
    if bundles.isEmpty():
        return violations(bundles, {"bundle": F.lit(False)}, "id")
    told = state.created(events, "run.recorded")
    disposition = F.struct(F.coalesce(F.col("analysis_disposition.included"), F.col("analysis_included")).alias("included"), F.col("analysis_disposition.reason").alias("reason"), F.col("analysis_disposition.policy_reference").alias("policy_reference"))
    runs = told.select(*BY, "sequence", F.col("id").alias("run_id"), "experiment_id", "arm", "phase", "status", disposition.alias("disposition"), "seed", "metrics")
    runs = kept(dated(runs, bundles))
    specs = drafted.select(*BY, F.posexplode("s.comparisons").alias("position", "c"), F.col("s.multiple_comparison_policy").alias("policy"), F.col("s.practical_significance_thresholds").alias("_t"))
    specs = kept(specs.select(*BY, "c.comparison_id", "position", "c.experiment_id", "c.arms", "c.metric", "c.pairing", F.col("c.uncertainty_method").alias("uncertainty"), F.col("c.confidence_level").alias("level"), F.col("c.bootstrap_seed").alias("seed"), F.col("c.bootstrap_samples").alias("samples"), "policy", F.try_element_at("_t", F.col("c.metric")).alias("threshold")))
    expected = drafted.select(*BY, F.explode("s.expected_run_ids").alias("run_id"))
    nested = bundles.where("nested").withColumn("b", F.from_json("text", BUNDLE))
    flat = nested.select(*BY, "sequence", "id", "b.comparisons", F.col("b.multiple_comparison_policy").alias("policy"), F.col("b.run_inventory").alias("i"), "_spec")
    rebuilt = results_at(runs, nested, specs)
    lists = flat.select(*BY, "sequence", "id", F.col("i.all_run_ids").alias("all_ids"), F.col("i.included_run_ids").alias("included_ids"), F.col("i.excluded_runs.run_id").alias("excluded_ids"), F.col("i.failed_run_ids").alias("failed_ids"), F.col("i.missing_run_ids").alias("missing_ids"))
    older = bundles.where("not nested").withColumn("b", F.from_json("text", OLD_BUNDLE))
    none = F.lit(None).cast("array<string>")
    old_lists = older.select(*BY, "sequence", "id", F.col("b.runs.run_id").alias("all_ids"), F.col("b.included_run_ids").alias("included_ids"), F.col("b.excluded_run_ids").alias("excluded_ids"), none.alias("failed_ids"), none.alias("missing_ids"))
    reasons = flat.select(*BY, "sequence", "id", F.explode("i.excluded_runs").alias("x")).select(*BY, "sequence", "id", F.col("x.run_id").alias("run_id"), "x.status", "x.reason", "x.policy_reference")
    own = compare.exclusions(runs).select("ledger_id", "protocol_id", "run_id", F.col("status").alias("_status"), F.col("reason").alias("_reason"), F.col("policy_reference").alias("_policy"))
    why = reasons.join(own, ["ledger_id", "protocol_id", "run_id"], "left")
    as_told = F.col("status").eqNullSafe(F.col("_status")) & F.col("reason").eqNullSafe(F.col("_reason")) & F.col("policy_reference").eqNullSafe(F.col("_policy"))
    policy = drafted.select(*BY, F.col("s.multiple_comparison_policy").alias("_policy"))
    found = [
        compared(flat, rebuilt, tolerance), inventories(lists.unionByName(old_lists), runs, expected), violations(why, {"bundle: exclusions": ~as_told}, "id").distinct(),
        violations(flat.join(policy, BY, "left"), {"bundle: policy": ~F.col("policy").eqNullSafe(F.col("_policy")), "bundle: no registered analysis": ~F.coalesce(F.col("_spec"), F.lit(False)), "bundle: no comparisons": F.col("comparisons").isNull() | F.col("i").isNull()}, "id"),
        old_summaries(older.select(*BY, "sequence", "id", "b.metrics"), runs, tolerance),
    ]
    if not specs.where("uncertainty = 'bootstrap'").isEmpty():
        found.append(drawn_at(flat, runs, specs, tolerance))
    return union(found).distinct()
