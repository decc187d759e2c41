"""Workflow progress and what to do next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import lineage, state
from tallyfold.operators.chain import union
from tallyfold.operators.lineage import kept
from tallyfold.operators.ordered import dealt

# Fixed: events that can end a stage, and the kind of object each is about.
ENDS = {
    "artifact.registered": "artifact", "experiment.pilot_completed": "experiment", "run.recorded": "run",
    "analysis.computed": "result-bundle", "assessment.recorded": "assessment", "decision.sealed": "decision",
}
#: Makers that a task holds; what they made are several times as many.
MAKERS = 200_000


def stage_rules(definitions: DataFrame) -> DataFrame:
    """rite_id, stage_no, event_type, kind, phase, status from definitions (rite_id, stages): what each stage but the last is left by."""
    contract = F.col("s.exit_contract")
    rows = definitions.select("rite_id", F.posexplode("stages").alias("stage_no", "s")).where("s.exit_contract is not null")
    return rows.select("rite_id", "stage_no", *(contract[c].alias(c) for c in ("event_type", "kind", "phase", "status")))


def runs_of_events(events: DataFrame) -> DataFrame:
    """ledger_id, sequence, working_id, type, kind, phase, status: the one workflow run that each stage-ending event belongs to.

    An artifact belongs to the run that made it, or to that of the experiment
    that made it; an experiment, and a run of one, to the experiment's; a bundle
    to that of all experiments that it compares, an assessment to its bundle's,
    a decision to that of all its assessments.  Events without one, with
    several, or with a gap on the way have no row, as have those whose program
    or protocol isn't the run's.
    """
    # an event carries what it is judged by along, so it meets its maker, or its bundle, in one join and never itself again
    fields = ("program_id", "protocol_id", "producer_id", "experiment_id", "working_id", "result_bundle_id", "assessment_ids", "kind", "phase", "status")
    key, told = ["ledger_id", "id"], ["ledger_id", "sequence", "id", "type", "program_id", "protocol_id", "kind", "phase", "status"]

    def of(*types: str) -> DataFrame:
        rows = state.parsed(events, [*fields, "bundle"]).where(F.col("type").isin(*types))
        return rows.select("ledger_id", "sequence", "id", "type", *(F.col(f"p.{c}").alias(c) for c in fields), "p.bundle")

    first = lambda t, *c: of(t).groupBy(*key).agg(F.min_by(F.struct(*c), "sequence").alias("_first")).select(*key, "_first.*")
    workings = first("working.created", "program_id", "protocol_id").select("ledger_id", F.col("id").alias("working_id"), F.col("program_id").alias("_program"), F.col("protocol_id").alias("_protocol"))
    planned = first("experiment.planned", "program_id", "protocol_id", "working_id").select(*key, F.col("program_id").alias("_planned"), F.col("protocol_id").alias("_made_under"), F.col("working_id").alias("_own"))
    # what can make something: experiments, and workflow runs themselves, each with its run; both may have one id
    direct = workings.select("ledger_id", F.col("working_id").alias("id"), F.col("working_id").alias("_direct"), F.col("_protocol").alias("_under"))
    makers = planned.join(direct, key, "full_outer").withColumn("working_id", F.coalesce("_direct", "_own")).join(workings, ["ledger_id", "working_id"])
    makers = dealt(kept(makers.select(*key, "working_id", "_program", "_protocol", "_planned", "_own", F.array("_made_under", "_under").alias("_makes_for"))), key, MAKERS)
    kind = F.col("type")
    producer = F.when(kind == "artifact.registered", F.col("producer_id")).when(kind == "run.recorded", F.col("experiment_id")).otherwise(F.col("id"))
    an_artifact = kind == "artifact.registered"
    right = F.coalesce((F.col("protocol_id") == F.col("_protocol")) | (an_artifact & F.array_contains("_makes_for", F.col("_protocol"))), F.lit(False))

    def made(*types: str) -> DataFrame:
        program = F.when(kind == "experiment.pilot_completed", F.coalesce("_planned", "program_id")).otherwise(F.col("program_id"))
        rows = of(*types).select(*told, producer.alias("_maker")).join(makers.withColumnRenamed("id", "_maker"), ["ledger_id", "_maker"])
        return rows.where(program == F.col("_program"))

    artifacts = kept(made("artifact.registered").select(*told, "working_id", "_protocol", right.alias("_right")))
    out = [made("experiment.pilot_completed", "run.recorded").where(right).select(*told, "working_id"), artifacts.where("_right").select(*told, "working_id")]
    open_ = artifacts.where("not _right")
    if not open_.isEmpty():  # artifacts of a maker under another protocol: whatever stands at the end of their chain may have the run's
        chains = first("artifact.registered", "producer_id").withColumnRenamed("producer_id", "parent")
        ends = lineage.roots(chains).join(open_.select(*key).distinct(), key, "left_semi")
        had = F.when(kind == "protocol.drafted", F.col("id")).otherwise(F.col("protocol_id"))
        known = of("protocol.drafted", "working.created", "experiment.planned", "run.recorded", "analysis.computed", "assessment.recorded").select("ledger_id", F.col("id").alias("root"), "type", "sequence", had.alias("_protocol"))
        known = known.join(ends.select("ledger_id", "root").distinct(), ["ledger_id", "root"], "left_semi").groupBy("ledger_id", "root", "type").agg(F.min_by("_protocol", "sequence").alias("_protocol"))
        out.append(open_.join(ends.join(known, ["ledger_id", "root"]).select(*key, "_protocol"), [*key, "_protocol"], "left_semi").select(*told, "working_id"))
    # bundles, by the experiments that they compare; assessments by their bundle, decisions by all their assessments
    compared = F.from_json("bundle", "comparisons array<struct<experiment_id:string>>")["comparisons"]["experiment_id"]
    none = F.array(F.lit(None).cast("string"))
    bundles = of("analysis.computed").groupBy(*key).agg(F.min_by(compared, "sequence").alias("compared")).select("ledger_id", F.col("id").alias("bundle_id"), F.explode(F.when(F.size("compared") > 0, F.col("compared")).otherwise(none)).alias("id"))
    bundles = bundles.join(makers.select(*key, F.col("_own").alias("working_id")), key, "left").groupBy("ledger_id", "bundle_id").agg(F.min("working_id").alias("_low"), F.max("working_id").alias("_high"), F.bool_or(F.col("working_id").isNull()).alias("_gap"))
    protocols = F.array("protocol_id")
    ends = of("analysis.computed").select(*told, F.col("id").alias("bundle_id"), protocols.alias("_for")).unionByName(of("assessment.recorded").select(*told, F.col("result_bundle_id").alias("bundle_id"), protocols.alias("_for")))
    ends = ends.join(bundles, ["ledger_id", "bundle_id"])
    assessments = first("assessment.recorded", "result_bundle_id", "protocol_id").select("ledger_id", F.col("id").alias("assessment_id"), F.col("result_bundle_id").alias("bundle_id"), F.col("protocol_id").alias("_assessed"))
    decided = of("decision.sealed").select(*told, F.explode("assessment_ids").alias("assessment_id")).join(assessments, ["ledger_id", "assessment_id"], "left").join(bundles, ["ledger_id", "bundle_id"], "left")
    decided = decided.groupBy(*told).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.bool_or(F.coalesce("_gap", F.lit(True))).alias("_gap"), F.collect_set("_assessed").alias("_for")).withColumn("_for", F.concat("_for", protocols))
    several = ends.drop("bundle_id").unionByName(decided).where("not _gap and _low = _high").withColumnRenamed("_low", "working_id").join(workings, ["ledger_id", "working_id"])
    out.append(several.where((F.col("program_id") == F.col("_program")) & F.array_contains("_for", F.col("_protocol"))).select(*told, "working_id"))
    return union(out).select("ledger_id", "sequence", "working_id", "type", "kind", "phase", "status")


def progress(events: DataFrame, runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Per workflow run: stages left, in order, with the event that left each.

    runs: ledger_id, working_id, rite_id; rules: rite_id, stage_no (from 0),
    event_type, kind, phase, status (null: any); events: ledger_id, sequence,
    working_id (the one run that its lineage leads to, see runs_of_events()), type, kind, phase,
    status.  Stage k is left by the first matching event later than the one that
    left stage k - 1; earlier matches are not remembered.
    """
    match = lambda c: F.col(f"r.{c}").isNull() | F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}"))
    rows = events.alias("e").join(runs.alias("w"), (F.col("e.ledger_id") == F.col("w.ledger_id")) & (F.col("e.working_id") == F.col("w.working_id")))
    rows = rows.join(rules.alias("r"), (F.col("r.rite_id") == F.col("w.rite_id")) & (F.col("r.event_type") == F.col("e.type")) & match("kind") & match("phase") & match("status"))
    key = ["ledger_id", "working_id"]
    matches = lineage.kept(rows.select("w.ledger_id", "w.working_id", "r.stage_no", "e.sequence"))
    stages = (rules.agg(F.max("stage_no")).first()[0] if not rules.isEmpty() else -1) + 1  # of a definition
    at, left = runs.select(*key, "rite_id"), []
    for k in range(stages):  # the next match after the last step: a minimum, merged before it is shuffled
        own = matches.where(F.col("stage_no") == k).select(*key, "sequence")
        after = F.col("sequence") > (F.col(left[-1]) if left else F.lit(-1))
        at = at.join(own, key, "left").groupBy(*key, "rite_id", *left).agg(F.min(F.when(after, F.col("sequence"))).alias(f"left_{k}"))
        left.append(f"left_{k}")
    out = at.withColumn("left_at", F.array_compact(F.array(*left)) if left else F.array().cast("array<long>"))
    last = rules.groupBy("rite_id").agg(F.count("*").alias("stages"))
    return out.join(last, "rite_id", "left").select("ledger_id", "working_id", "rite_id", "left_at", F.size("left_at").alias("stage_no"), F.when(F.size("left_at") >= F.col("stages"), "COMPLETED").otherwise("ACTIVE").alias("status"))


# Fixed order of advice: the first line whose condition holds is the answer.
ADVICE = [
    ("create or select a program", "program_id is null"),
    ("select an existing program", "not known"),
    ("resolve critical issues", "size(open_critical) > 0"),
    ("record evidence", "evidence = 0"),
    ("seal the question", "not has_question"),
    ("draft a protocol", "protocols = 0"),
    ("seal the protocol", "draft_protocols > 0"),
    ("start an experiment", "experiments = 0"),
    ("record runs and analyse", "bundles = 0"),
    ("assess the result", "assessments = 0"),
    ("decide", "decisions = 0"),
]


def next_actions(programs: DataFrame) -> DataFrame:
    """Advice for each program, with the sorted ids of the issues where it is to resolve those.

    programs: program_id (null: none is selected), known, open_critical (ids),
    evidence, has_question, protocols, draft_protocols, experiments, bundles,
    assessments, decisions (counts).
    """
    out = F.lit(None).cast("string")
    for text, condition in reversed(ADVICE):
        out = F.when(F.expr(condition), text).otherwise(out)
    out = F.coalesce(out, F.lit("continue from open issues and the last decision"))
    return programs.withColumn("next_action", F.when(out == "resolve critical issues", F.concat(out, F.lit(": "), F.array_join(F.array_sort("open_critical"), ", "))).otherwise(out))


def program_counts(events: DataFrame, selected: DataFrame) -> DataFrame:
    """What next_actions() asks for, of selected programs (ledger_id, program_id; null, or unknown ones, too)."""
    rows = state.parsed(events)
    objects = state.every_object(rows).where("collection <> 'programs'")
    n = lambda c: F.count_if(F.col("collection") == c)
    steps = state.transitions(rows)
    draft = steps.groupBy("ledger_id", "collection", "id").agg(F.max_by("state", "sequence").alias("state"))
    open_ = rows.where("type = 'issue.opened' and p.severity = 'CRITICAL'").select("ledger_id", "id", F.col("p.program_id").alias("program_id")).join(draft.where("collection = 'issues' and state = 'OPEN'").select("ledger_id", "id"), ["ledger_id", "id"])
    critical = open_.groupBy("ledger_id", "program_id").agg(F.array_sort(F.collect_set("id")).alias("open_critical"))
    drafts = objects.where("collection = 'protocols'").join(draft.where("collection = 'protocols' and state = 'DRAFT'").select("ledger_id", "id"), ["ledger_id", "id"]).groupBy("ledger_id", "program_id").agg(F.count("*").alias("draft_protocols"))
    counts = objects.groupBy("ledger_id", "program_id").agg(n("evidence").alias("evidence"), n("protocols").alias("protocols"), n("experiments").alias("experiments"), n("result_bundles").alias("bundles"), n("assessments").alias("assessments"), n("decisions").alias("decisions"))
    made = rows.where("type = 'program.created'").select("ledger_id", F.col("id").alias("program_id")).distinct().withColumn("known", F.lit(True))
    asked = rows.where("type = 'research_question.sealed'").select("ledger_id", F.col("id").alias("program_id")).distinct().withColumn("has_question", F.lit(True))
    out = selected.select("ledger_id", "program_id").distinct()
    for part in (made, asked, counts, drafts, critical):
        out = out.join(part, ["ledger_id", "program_id"], "left")
    out = out.na.fill(0, ["evidence", "protocols", "experiments", "bundles", "assessments", "decisions", "draft_protocols"]).na.fill(False, ["known", "has_question"])
    return out.withColumn("open_critical", F.coalesce("open_critical", F.array().cast("array<string>")))
