"""Rules between rows: references, duplicates, transitions, flags, gates, policy verdicts.

Every rule gives the rows that break it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.digest import id_hash, id_sums
from tallyfold.operators.lineage import kept
from tallyfold.operators.ordered import running


def unknown_references(uses: DataFrame, objects: DataFrame) -> DataFrame:
    """Uses (ledger_id, sequence, ref) of an object that isn't there before; objects: ledger_id, id, sequence of its creation."""
    made = objects.groupBy("ledger_id", F.col("id").alias("ref")).agg(F.min("sequence").alias("_made"))
    return uses.join(made, ["ledger_id", "ref"], "left").where("_made is null or _made >= sequence").drop("_made")


def foreign_references(uses: DataFrame, objects: DataFrame) -> DataFrame:
    """Uses (ledger_id, program_id, ref) of an object of another program; objects: ledger_id, id, program_id."""
    own = objects.select("ledger_id", F.col("id").alias("ref"), F.col("program_id").alias("_program"))
    return uses.join(own, ["ledger_id", "ref"]).where("not (program_id <=> _program)").drop("_program")


def duplicates(rows: DataFrame, by: list[str], order: str = "sequence") -> DataFrame:
    """All but the first row of each key."""
    first = rows.groupBy(*by).agg(F.min(order).alias("_first"))
    return rows.join(first, by).where(F.col(order) > F.col("_first")).drop("_first")


def repeated_elements(array: Column) -> Column:
    return F.size(array) != F.size(F.array_distinct(array))


def bad_transitions(rows: DataFrame, allowed: DataFrame, by: list[str], state: str, order: list[str], start: str | None = None) -> DataFrame:
    """Rows whose step from the state before isn't allowed (source, target); the first comes from `start`, or is free.

    allowed is joined as Spark's sizes tell; a table of transitions is small.
    """
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
    steps = rows.withColumn("source", F.coalesce(before, F.lit(start)) if start is not None else before)
    ok = allowed.select("source", F.col("target").alias(state))
    return steps.where("source is not null").join(ok, ["source", state], "left_anti")


def current_state(rows: DataFrame, by: list[str], state: str, order: str) -> DataFrame:
    """Last state of each object, and its history in order."""
    return rows.groupBy(*by).agg(F.max_by(state, order).alias("state"), F.transform(F.array_sort(F.collect_list(F.struct(order, state))), lambda x: x[state]).alias("history"))


def lowered_flags(rows: DataFrame, by: list[str], flag: str, order: str) -> DataFrame:
    """Rows whose flag is false after it was true."""
    before = F.max(F.coalesce(F.col(flag), F.lit(False))).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", before).where(F.col("_before") & ~F.coalesce(F.col(flag), F.lit(False))).drop("_before")


def highest_status(rows: DataFrame, by: list[str], status: str, ranks: list[str]) -> DataFrame:
    """The furthest of the ordered states that was ever reached, in whatever order the rows come."""
    rank = F.array_position(F.lit(ranks), F.col(status))
    return rows.groupBy(*by).agg(F.max(rank).alias("rank")).select(*by, F.col("rank").cast("int").alias("rank"), F.when(F.col("rank") > 0, F.try_element_at(F.lit(ranks), F.col("rank").cast("int"))).alias("status"))


#: Moments of a key beyond which its intervals are joined by rank.
MANY_MOMENTS = 1024
#: Moments of such a key that lie in one bin.
BIN = 64


def _valid(intervals: DataFrame) -> DataFrame:
    return intervals.where("opened is not null and (closed is null or closed > opened)")


def _endpoints(moments: DataFrame, intervals: DataFrame, by: list[str], of_moment: dict[str, Column], of_interval: dict[str, Column]) -> DataFrame:
    """by, at, turn, and the named values of moments (turn 1), openings (2) and closings (0): what comes at one time is in this order, so an interval is open strictly between its ends."""
    names = list(of_moment)
    rows = moments.select(*by, "at", F.lit(1).alias("turn"), *(c.alias(n) for n, c in of_moment.items()))
    for turn, column in ((2, "opened"), (0, "closed")):
        rows = rows.unionByName(intervals.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("at"), F.lit(turn).alias("turn"), *(of_interval[n].alias(n) for n in names)))
    return rows


def open_sums(moments: DataFrame, intervals: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """moment_id and, by name, the sum of a value of the intervals (by, opened, closed, ...) that are open at each moment (by, moment_id, at).

    Sums run along the time of each key, to which an opening adds and from which
    a closing takes away, so the work doesn't grow with how many are open.
    """
    spans = _valid(intervals)
    names = list(values)
    rows = spans.select(*by, F.col("opened").alias("at"), F.lit(2).alias("turn"), F.lit(None).cast(moments.schema["moment_id"].dataType).alias("moment_id"), *(c.alias(n) for n, c in values.items()))
    rows = rows.unionByName(spans.where("closed is not null").select(*by, F.col("closed").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast(moments.schema["moment_id"].dataType).alias("moment_id"), *((-c).alias(n) for n, c in values.items())))
    rows = rows.unionByName(moments.select(*by, "at", F.lit(1).alias("turn"), "moment_id", *(F.lit(0).cast(rows.schema[n].dataType).alias(n) for n in names)))
    found = running(rows, by, ["at", "turn"], {f"_{n}": F.col(n) for n in names})
    return found.where("turn = 1").select("moment_id", *(F.col(f"_{n}").alias(n) for n in names))


def open_at(moments: DataFrame, intervals: DataFrame, by: list[str], many: int = MANY_MOMENTS) -> DataFrame:
    """Per moment (by, moment_id, at), the intervals (by, interval_id, opened, closed) that were open, sorted; none gives an empty array.

    A key of up to `many` moments is joined as it is.  In a larger one moments
    are numbered by time, and an interval is known by the numbers between its
    ends: it meets the bins of BIN numbers that it covers, so the work follows
    the result, whatever the lengths.
    """
    spans = _valid(intervals)
    hot = kept(moments.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > many).select(*by))
    few, short = moments, spans
    lists = []
    if not hot.isEmpty():
        few, short = moments.join(hot, by, "left_anti"), spans.join(hot, by, "left_anti")
        large, long = moments.join(hot, by, "left_semi"), spans.join(hot, by, "left_semi")
        none = F.lit(None)
        ends = _endpoints(large, long, by, {"moment_id": F.col("moment_id"), "interval_id": none.cast(spans.schema["interval_id"].dataType)}, {"moment_id": none.cast(moments.schema["moment_id"].dataType), "interval_id": F.col("interval_id")})
        ranked = kept(running(ends, by, ["at", "turn"], {"rank": (F.col("turn") == 1).cast("long")}))
        numbered = ranked.where("turn = 1").select(*by, "moment_id", (F.col("rank") - 1).alias("rank")).withColumn("bin", F.floor(F.col("rank") / BIN))
        total = ranked.groupBy(*by).agg(F.max("rank").alias("_all"))
        cover = ranked.where("turn <> 1").groupBy(*by, "interval_id").agg(F.max(F.when(F.col("turn") == 2, F.col("rank"))).alias("lo"), F.max(F.when(F.col("turn") == 0, F.col("rank"))).alias("hi"))
        cover = cover.join(total, by).select(*by, "interval_id", "lo", F.coalesce("hi", "_all").alias("hi")).where("lo < hi")
        cover = cover.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN))))
        lists.append(numbered.join(cover, [*by, "bin"]).where("rank >= lo and rank < hi").groupBy("moment_id").agg(F.array_sort(F.collect_list("interval_id")).alias("open_ids")))
    lists.append(few.join(short, by).where("opened < at and (closed is null or closed > at)").groupBy("moment_id").agg(F.array_sort(F.collect_list("interval_id")).alias("open_ids")))
    found = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    return moments.join(found, "moment_id", "left").withColumn("open_ids", F.coalesce("open_ids", F.array().cast(found.schema["open_ids"].dataType)))


def decision_gates(decisions: DataFrame, issues: DataFrame, limitations: DataFrame) -> DataFrame:
    """Decisions that break a gate: ledger_id, sequence, object_id, rule.

    decisions: ledger_id, sequence, decision_id, program_id, outcome,
    assessment_ids, required_actions, parent_program_id, unresolved_issue_ids,
    unresolved_uncertainties; issues: ledger_id, program_id, issue_id, severity,
    opened, closed (sequences); limitations: ledger_id, assessment_id, limitation.
    What is open at a decision is counted, and its ids are compared with the
    recorded ones as sorted lists of one number and sums of hashes.
    """
    from tallyfold.operators.chain import violations

    own = decisions.withColumn("moment_id", F.struct("ledger_id", "decision_id")).withColumn("at", F.col("sequence"))
    by = ["ledger_id", "program_id"]
    critical = (F.col("severity") == "CRITICAL").cast("long")
    sums = {"open_n": F.lit(1).cast("long"), "critical": F.coalesce(critical, F.lit(0)), "open_a": id_hash(1, F.col("issue_id")), "open_b": id_hash(2, F.col("issue_id"))}
    rows = own.join(open_sums(own, issues, by, sums), "moment_id", "left").na.fill(0, ["open_n", "critical"])
    recorded = id_sums(F.col("unresolved_issue_ids"))
    as_open = (recorded["n"] == F.col("open_n")) & (recorded["a"] == F.coalesce(F.col("open_a"), F.lit(0))) & (recorded["b"] == F.coalesce(F.col("open_b"), F.lit(0))) & (F.array_sort("unresolved_issue_ids") == F.col("unresolved_issue_ids"))
    told = own.select("ledger_id", "moment_id", F.explode("assessment_ids").alias("assessment_id")).join(limitations, ["ledger_id", "assessment_id"]).groupBy("moment_id").agg(F.array_sort(F.collect_set("limitation")).alias("told"))
    rows = rows.join(told, "moment_id", "left").withColumn("told", F.coalesce("told", F.array().cast("array<string>")))
    o = F.col("outcome")
    return violations(
        rows,
        {
            "CONTINUE with an open critical issue": (o == "CONTINUE") & (F.col("critical") > 0),
            "REPAIR without actions": (o == "REPAIR") & (F.size("required_actions") == 0),
            "PIVOT without its own parent": (o == "PIVOT") & ~F.col("parent_program_id").eqNullSafe(F.col("program_id")),
            "REVIEW_REQUIRED without two assessments": (o == "REVIEW_REQUIRED") & (F.size("assessment_ids") < 2),
            "open issues differ": F.col("unresolved_issue_ids").isNotNull() & ~as_open,
            "uncertainties differ": F.col("unresolved_uncertainties") != F.col("told"),
        },
        "decision_id",
    )


# Fixed form of a task's id.
TASK_ID = r"^TK-[A-Z0-9]+\z"


def verdicts(capsules: DataFrame, contracts: DataFrame, approvals: DataFrame, hosts: list[str] | None = None, task_pattern: str | None = TASK_ID) -> DataFrame:
    """Verdict per task capsule: REJECTED, WAITING_FOR_APPROVAL or PASS, with the first reason that holds.

    hosts: those that a capsule may name, and task_pattern, which its id fits;
    null: anything does.
    capsules: ledger_id, task_id, host (where hosts are given), capability_id, contract_version,
    contract_digest, expected_outputs, tools, network, seconds, digest,
    digest_ok; contracts: capability_id, version, digest, outputs,
    allowed_tools, allows_network, max_seconds, needs_approval; approvals:
    ledger_id, task_id, capability_id, contract_digest, digest, tools, network,
    seconds.
    """
    c, a = contracts.alias("c"), approvals.withColumn("_approved", F.lit(True)).alias("a")
    rows = capsules.alias("t").join(c, F.col("t.capability_id") == F.col("c.capability_id"), "left").join(a, (F.col("t.ledger_id") == F.col("a.ledger_id")) & (F.col("t.task_id") == F.col("a.task_id")), "left")
    bound = F.lit(True)
    for x in ("digest", "capability_id", "contract_digest", "tools", "network", "seconds"):
        bound = bound & F.col(f"a.{x}").eqNullSafe(F.col(f"t.{x}"))
    contract_same = F.col("t.contract_version").eqNullSafe(F.col("c.version")) & F.col("t.contract_digest").eqNullSafe(F.col("c.digest")) & F.col("t.expected_outputs").eqNullSafe(F.col("c.outputs"))
    extra = F.size(F.array_except("t.tools", "c.allowed_tools")) > 0
    approved = F.col("a._approved").isNotNull()
    named = F.lit(True) if task_pattern is None else F.coalesce(F.col("t.task_id").cast("string").rlike(task_pattern), F.lit(False))
    if hosts is not None:
        named = named & F.coalesce(F.col("t.host").isin(hosts), F.lit(False))
    reason = (
        F.when(~named, "identifiers")
        .when(~F.coalesce(F.col("t.digest_ok"), F.lit(False)), "digest")
        .when(~contract_same, "contract")
        .when(F.coalesce(extra, F.lit(False)), "tools")
        .when(F.coalesce(F.col("t.seconds") < 1, F.lit(True)), "no time")
        .when(F.col("t.seconds") > F.coalesce("c.max_seconds", F.lit(0)), "too much time")
        .when(F.coalesce(F.col("t.network"), F.lit(False)) & ~F.coalesce(F.col("c.allows_network"), F.lit(False)), "network")
        .when(F.col("c.needs_approval") & ~approved, "approval needed")
        .when(F.col("c.needs_approval") & ~bound, "approval differs")
    )
    verdict = F.when(reason.isNull(), "PASS").when(reason == "approval needed", "WAITING_FOR_APPROVAL").otherwise("REJECTED")
    return rows.select("t.ledger_id", "t.task_id", verdict.alias("verdict"), reason.alias("reason"))


def pilot_gaps(experiments: DataFrame, required: DataFrame, recorded: DataFrame) -> DataFrame:
    """Required pilot runs or arms (ledger_id, experiment_id, run_id or arm as `need`) that no recorded pilot run has."""
    return required.join(experiments, ["ledger_id", "experiment_id"], "left_semi").join(recorded, ["ledger_id", "experiment_id", "need"], "left_anti")


def sole_active(rows: DataFrame, by: list[str], item: str) -> DataFrame:
    """The one active item of each key, or how many there are if not one."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(item).alias("_item")).select(*by, F.when(F.col("n") == 1, F.col("_item")).alias(item), "n")


def chosen_workings(wanted: DataFrame, workings: DataFrame, version: str | None = None) -> DataFrame:
    """wanted (ledger_id, program_id, protocol_id, working_id: null for any) with chosen and problem.

    workings: ledger_id, working_id, program_id, protocol_id, status and, where a
    version is asked for, version.  Active ones of the program and protocol (and
    version) match.  An explicit one must be among them; without, the only one is
    chosen, none leaves it open, and several need an explicit choice.
    """
    by = ["ledger_id", "program_id", "protocol_id"]
    active = workings.where((F.col("status") == "ACTIVE") & (F.lit(True) if version is None else F.col("version").eqNullSafe(F.lit(version))))
    of = active.groupBy(*by).agg(F.count("*").alias("n"), F.min("working_id").alias("_one"))
    own = active.select(*by, "working_id", F.lit(True).alias("_active")).distinct()
    rows = wanted.join(of, by, "left").join(own, [*by, "working_id"], "left")
    explicit, n = F.col("working_id").isNotNull(), F.coalesce("n", F.lit(0))
    problem = F.when(explicit & F.col("_active").isNull(), "not active for the protocol").when(~explicit & (n > 1), "several are active")
    chosen = F.when(problem.isNull(), F.when(explicit, F.col("working_id")).when(n == 1, F.col("_one")))
    return rows.select(*wanted.columns, chosen.alias("chosen"), problem.alias("problem"))


def last_findings(findings: DataFrame, objects: DataFrame) -> DataFrame:
    """objects (ledger_id, id, status) with the status of the last finding (sequence, position) on each."""
    last = findings.groupBy("ledger_id", "id").agg(F.max_by("status", F.struct("sequence", "position")).alias("_last"))
    return objects.join(last, ["ledger_id", "id"], "left").withColumn("status", F.coalesce("_last", "status")).drop("_last")
