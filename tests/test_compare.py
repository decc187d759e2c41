import math

import numpy as np
import pytest

from tallyfold.functions import student
from tallyfold.operators import compare as C

RUN = "ledger_id string, protocol_id string, experiment_id string, run_id string, arm string, phase string, status string, disposition struct<included:boolean,reason:string,policy_reference:string>, seed long, metrics map<string,double>"
SPEC = "ledger_id string, protocol_id string, comparison_id string, position int, experiment_id string, arms array<string>, metric string, pairing string, uncertainty string, level double, seed long, samples long, policy string, threshold double"


def run(i, arm, value, seed=None, status="COMPLETED", included=True, experiment="E", reason=None):
    return ("L", "P", experiment, i, arm, None, status, (included, reason, None), seed, {"m": value})


def spec(name="c1", pairing="unpaired", uncertainty="student_t", level=0.95, seed=None, samples=None, policy="none", threshold=None, position=0):
    return ("L", "P", name, position, "E", ["c", "t"], "m", pairing, uncertainty, level, seed, samples, policy, threshold)


def compared(spark, runs, specs):
    rows = C.compare(spark.createDataFrame(runs, RUN), spark.createDataFrame(specs, SPEC)).orderBy("comparison_id").collect()
    return rows


def arms(control, treatment, seeds=False):
    out = [run(f"c{i}", "c", v, i if seeds else None) for i, v in enumerate(control)]
    return out + [run(f"t{i}", "t", v, i if seeds else None) for i, v in enumerate(treatment)]


def test_paired_interval(spark):
    (r,) = compared(spark, arms([1.0, 2.0, 3.0], [1.4, 2.8, 3.9], True), [spec(pairing="paired")])
    assert r.df == 2 and r.estimate == pytest.approx(0.7)
    assert (r.lower, r.upper) == (pytest.approx(0.0427589, abs=1e-6), pytest.approx(1.3572411, abs=1e-6))
    assert r.std_method == "paired_dz" and r.std_estimate == pytest.approx(2.6457513)


def test_one_value_per_arm(spark):
    (r,) = compared(spark, arms([1.0], [1.5]), [spec()])
    assert r.estimate == 0.5 and r.unc_method == "unavailable" and "two observations per arm" in r.unc_reason and r.sd_t is None


def test_missing_arm_and_bad_values(spark):
    (r,) = compared(spark, arms([], [1.5]), [spec()])
    assert r.problem and r.estimate is None
    (r,) = compared(spark, arms([1.0, math.nan], [1.5, 2.0]), [spec()])
    assert r.problem and r.estimate is None


@pytest.mark.parametrize("limit", [100_000, 2])
def test_bootstrap_is_that_of_the_seed_in_any_order(spark, limit):
    runs = arms([1.0, 1.2, 1.4], [1.5, 1.9, 2.1])
    for rows in (runs, runs[::-1]):
        specs = spark.createDataFrame([spec(uncertainty="bootstrap", seed=17, samples=1000)], SPEC)
        values = C.observations(spark.createDataFrame(rows, RUN), specs)
        from pyspark.sql import functions as F

        (r,) = C.bootstrap(values, specs.withColumn("effective", F.col("level")), limit).collect()
        assert (r.lower, r.upper) == (pytest.approx(0.3), pytest.approx(0.9666666666666666))
    (r,) = compared(spark, runs, [spec(uncertainty="bootstrap", seed=17, samples=1000)])
    assert (r.lower, r.upper) == (pytest.approx(0.3), pytest.approx(0.9666666666666666)) and r.unc_method == "bootstrap"


def test_pairs_need_the_same_seeds(spark):
    runs = [run("a", "c", 1.0, 1), run("b", "c", 1.0, 2), run("c", "t", 2.0, 1), run("d", "t", 2.0, 3)]
    (r,) = compared(spark, runs, [spec(pairing="paired")])
    assert r.problem and r.estimate is None


def test_family_of_two(spark):
    rows = compared(spark, arms([1.0, 1.2], [1.5, 1.7]), [spec("c1", policy="bonferroni"), spec("c2", policy="bonferroni", position=1)])
    for r in rows:
        assert r.effective_level == pytest.approx(0.975) and r.df == pytest.approx(2)
        assert (r.lower, r.upper) == (pytest.approx(-0.3775686, abs=1e-6), pytest.approx(1.3775686, abs=1e-6))
        assert r.std_estimate == pytest.approx(3.5355339)


def test_other_experiments_are_not_pooled(spark):
    runs = arms([1.0, 1.2], [1.6, 1.8]) + [run("x", "c", -100.0, experiment="F"), run("y", "t", 100.0, experiment="F")]
    (r,) = compared(spark, runs, [spec()])
    assert r.estimate == pytest.approx(0.6)
    expected = spark.createDataFrame([("L", "P", "x"), ("L", "P", "gone")], "ledger_id string, protocol_id string, run_id string")
    (i,) = C.inventory(spark.createDataFrame(runs, RUN), expected).collect()
    assert len(i.all_runs) == 6 and i.missing_runs == ["gone"]


def test_inventory_keeps_failed_and_excluded(spark):
    runs = arms([1.0], [2.0]) + [run("f", "t", 9.0, status="FAILED", included=False), run("x", "t", 9.0, included=False, reason="drift"), run("e", "t", 9.0, included=False, reason="")]
    df = spark.createDataFrame(runs, RUN)
    (i,) = C.inventory(df, spark.createDataFrame([("L", "P", "gone")], "ledger_id string, protocol_id string, run_id string")).collect()
    assert i.failed_runs == ["f"] and i.excluded_runs == ["e", "f", "x"] and i.missing_runs == ["gone"]
    reasons = {r.run_id: r.reason for r in C.exclusions(df).collect()}
    assert reasons == {"f": "Run status is FAILED", "x": "drift", "e": "Run status is COMPLETED"}


def test_small_study(spark):
    runs = [run("1", "c", 0.80, 1), run("2", "t", 0.86, 1), run("3", "c", 0.82, 2), run("4", "t", 0.91, 2), run("5", "t", 5.0, 3, included=False), run("6", "c", 5.0, 3, status="FAILED", included=False)]
    (r,) = compared(spark, runs, [spec(pairing="paired", threshold=0.05)])
    assert r.estimate == pytest.approx(0.075) and r.df == 1 and r.exceeds
    assert (r.lower, r.upper) == (pytest.approx(-0.1155931, abs=1e-6), pytest.approx(0.2655931, abs=1e-6))
    assert r.std_estimate == pytest.approx(3.5355339)


def test_no_variance_and_no_pairing(spark):
    (r,) = compared(spark, arms([1.0, 1.0], [2.0, 2.0]), [spec()])
    assert (r.estimate, r.lower, r.upper, r.df) == (1, 1, 1, 2) and r.std_method == "unavailable"
    (r,) = compared(spark, arms([1.0, 1.5], [2.0, 2.1]), [spec(pairing="none")])
    assert r.std_method == "cohens_d" and r.unc_method == "unavailable" and r.lower is None
    (r,) = compared(spark, arms([1.0, 1.5], [2.0, 2.1]), [spec(policy="holm")])
    assert r.unc_method == "unavailable" and r.effective_level == 0.95


def test_critical_values_of_printed_tables():
    level = [0.95, 0.95, 0.95, 0.95, 0.99, 0.975]
    df = [1, 2, 10, 30, 5, 2]
    assert student.critical(level, df) == pytest.approx([12.706205, 4.302653, 2.228139, 2.042272, 4.032143, 6.205347], abs=1e-6)
    # closed forms for 1 and 2 degrees of freedom
    p = np.array([0.8, 0.9, 0.95, 0.99])
    assert student.critical(p, np.ones(4)) == pytest.approx(np.tan(np.pi * p / 2), rel=1e-10)
    assert student.critical(p, np.full(4, 2.0)) == pytest.approx(p * np.sqrt(2 / (1 - p * p)), rel=1e-10)
    t = np.linspace(-20, 20, 81)
    assert student.cdf(t, np.ones(81)) == pytest.approx(0.5 + np.arctan(t) / np.pi, abs=1e-11)
    assert (np.diff(student.cdf(t, np.full(81, 7.0))) > 0).all()


def test_critical_values_for_many_degrees_of_freedom():
    for level in (0.5, 0.9, 0.95, 0.999):
        z = -student.NormalDist().inv_cdf((1 - level) / 2)
        for df in (1e6, 1e9, 1e12):
            near = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
            assert float(student.critical(level, df)) == pytest.approx(near, abs=1e-10)
        below, above = (float(student.critical(level, student.MANY + d)) for d in (-1e-3, 0))  # where the series takes over
        assert above < below + 1e-11 and below == pytest.approx(above, abs=1e-8)
    for t in (-7.0, -2.0, 0.3, 4.0):
        below, above = (float(student.cdf(t, student.MANY + d)) for d in (-1e-3, 0))
        assert below == pytest.approx(above, abs=1e-10)
    assert float(student.cdf(1.959963984540054, 1e12)) == pytest.approx(0.975, abs=1e-11)


def test_bundles_old_runs_and_recheck(spark):
    runs = spark.createDataFrame(arms([1.0, 1.2], [1.5, 1.7]), RUN)
    specs = spark.createDataFrame([spec("b", position=0), spec("a", position=1)], SPEC)
    results = C.compare(runs, specs)
    expected = spark.createDataFrame([], "ledger_id string, protocol_id string, run_id string")
    (b,) = C.bundles(results, runs, expected).collect()
    assert [x.comparison_id for x in b.comparisons] == ["b", "a"] and len(b.included_runs) == 4
    old = spark.createDataFrame([("L", "P", "r1", "COMPLETED", True, {"m": 1.0}), ("L", "P", "r2", "COMPLETED", True, {"m": 3.0})], "ledger_id string, protocol_id string, run_id string, status string, analysis_included boolean, metrics map<string,double>")
    (s,) = C.legacy_summary(C.normalized(old)).collect()
    assert s.n == 2 and s.mean == 2 and s.upper == pytest.approx(2 + 1.96 * math.sqrt(2) / math.sqrt(2))
    from pyspark.sql import functions as F

    timed = runs.withColumn("sequence", F.lit(1).cast("long"))
    recorded = results.select(*C.KEY, F.lit(5).cast("long").alias("sequence"), "estimate", "lower", "upper")
    assert C.recheck(recorded, timed, specs).count() == 0
    wrong = recorded.withColumn("estimate", F.when(F.col("comparison_id") == "a", F.col("estimate") + 1).otherwise(F.col("estimate")))
    assert [r.comparison_id for r in C.recheck(wrong, timed, specs).collect()] == ["a"]


def shuffled(spark, since):
    """Most rows that one stage wrote for others among the stages from `since` on, and the next stage's number."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    own = [(s.stageId(), s.shuffleWriteRecords()) for s in (stages.apply(i) for i in range(stages.size()))]
    return max((n for i, n in own if i >= since), default=0), max((i for i, _ in own), default=-1) + 1


def test_runs_are_summed_up_before_they_are_shuffled(spark):
    runs = arms([float(i % 7) for i in range(3000)], [float(i % 5) for i in range(2000)])
    runs += [run("none", "t", None), ("L", "P", "E", "empty", "c", None, "COMPLETED", (True, None, None), None, {}), ("L", "P", "E", "other", "c", None, "COMPLETED", (True, None, None), None, {"x": 1.0, "m": 2.0})]
    rows, specs = spark.createDataFrame(runs, RUN), spark.createDataFrame([spec(), spec("c2", policy="bonferroni", position=1)], SPEC)
    _, since = shuffled(spark, 0)
    got = C.compare(rows, specs, intervals=False).orderBy("comparison_id").collect()
    most, _ = shuffled(spark, since)
    assert [(r.comparison_id, r.n_t, r.n_c, r.max_t, r.problem) for r in got] == [(c, 2000, 3001, 4.0, "a value is missing or not finite") for c in ("c1", "c2")]
    assert most < 200
