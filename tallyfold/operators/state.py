"""Current-state tables of a ledger's objects, and the rules across them.

events: ledger_id, sequence, event_id, type, object_id, occurred_at, payload
(JSON text).  A table is a filter on the type that creates its objects, with
what later events change joined to it by aggregation; nothing is folded row by
row.  Rules are evaluated for all events at once and give rows; only the first
violation of a ledger is what a reader that stops would report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.digest import id_hash, json_digest
from tallyfold.operators import rules
from tallyfold.operators.chain import union, violations
from tallyfold.operators.lineage import once, scratch
from tallyfold.operators.recompute import analyses

# Fixed values of the ledger: object kinds by the event that creates one, with payload fields.
_CLAIM_FINDING, _HYPOTHESIS_FINDING = "array<struct<claim_id:string,status:string>>", "array<struct<hypothesis_id:string,status:string>>"
CREATED = {
    "program.created": ("programs", "slug string, title string, problem string"),
    "evidence.recorded": ("evidence", "program_id string, source string, observation string, verification struct<source_resolved:boolean,content_inspected:boolean>"),
    "claim.created": ("claims", "program_id string, type string, statement string, evidence_relations array<struct<evidence_id:string,relation:string>>"),
    "hypothesis.created": ("hypotheses", "program_id string, claim_ids array<string>, statement string, prediction string"),
    "protocol.drafted": ("protocols", "program_id string, title string, analysis_plan string, hypothesis_ids array<string>, study_mode string, analysis_spec string"),
    "approval.granted": ("approvals", "program_id string, capsule_sigil string, capability string, capability_contract_sigil string, circle string, bindings string"),
    "review.requested": ("review_requests", "program_id string, type string, target string, scope string, disclosure string, destination string, approval string, status string"),
    "review.completed": ("review_artifacts", "program_id string, task_id string, source string, reviewer string, result string"),
    "agent-result.accepted": ("task_results", "program_id string, capability string, host string, snapshot string, capsule_sigil string, input_sigil string, result string, bindings string"),
    "working.created": ("workings", "program_id string, protocol_id string, rite_id string, rite_sigil string, rite string"),
    "experiment.planned": ("experiments", "program_id string, protocol_id string, hypothesis_id string, question string, working_id string"),
    "run.recorded": ("runs", "program_id string, protocol_id string, experiment_id string, status string, seed long, arm string, phase string, metrics map<string,double>, analysis_included boolean, analysis_disposition struct<included:boolean,reason:string,policy_reference:string>"),
    "analysis.computed": ("result_bundles", "program_id string, protocol_id string, bundle string, bundle_sigil string"),
    "assessment.recorded": ("assessments", f"program_id string, protocol_id string, result_bundle_id string, study_mode string, summary string, limitations array<string>, claim_findings {_CLAIM_FINDING}, hypothesis_findings {_HYPOTHESIS_FINDING}"),
    "reproduction.assessed": ("reproductions", "program_id string, evidence_id string, run_ids array<string>, result_bundle_id string, artifact_ids array<string>, assessment_id string, status string"),
    "decision.sealed": ("decisions", "program_id string, outcome string, assessment_ids array<string>, rationale string, required_actions array<string>, unresolved_issue_ids array<string>, unresolved_uncertainties array<string>, lineage struct<parent_program_id:string>"),
    "artifact.registered": ("artifacts", "program_id string, kind string, location struct<uri:string,sigil:string>, producer_id string, input_ids array<string>"),
    "issue.opened": ("issues", "program_id string, subject_ids array<string>, severity string, title string, description string"),
    "deviation.recorded": ("deviations", "program_id string, protocol_id string, kind string, summary string, rationale string, impact string, affected_object_ids array<string>"),
}
ALIASES = {"experiment.created": "experiment.planned"}
WAITS = "WAITING_FOR_DISCLOSURE_AUTHORIZATION"
# States that later events lead to, as (event type, collection, states it starts from, state).
STEPS = [
    ("protocol.sealed", "protocols", ["DRAFT"], "FROZEN"),
    ("issue.resolved", "issues", ["OPEN"], "RESOLVED"),
    ("review.approved", "review_requests", [WAITS], "APPROVED"),
    ("review.completed", "review_requests", ["PREPARED", "APPROVED"], "COMPLETED"),
    ("review.accepted", "review_requests", ["COMPLETED"], "ACCEPTED"),
    ("experiment.implemented", "experiments", ["PLANNED"], "IMPLEMENTED"),
    ("experiment.pilot_started", "experiments", ["IMPLEMENTED"], "PILOT_RUNNING"),
    ("experiment.pilot_completed", "experiments", ["PILOT_RUNNING"], "PILOT_COMPLETED"),
    ("experiment.formal_started", "experiments", ["PILOT_COMPLETED"], "FORMAL_RUNNING"),
    ("experiment.completed", "experiments", ["FORMAL_RUNNING"], "COMPLETED"),
    ("experiment.cancelled", "experiments", ["PLANNED", "IMPLEMENTED", "PILOT_RUNNING", "PILOT_COMPLETED", "FORMAL_RUNNING"], "CANCELLED"),
]
START = {"protocols": "DRAFT", "issues": "OPEN", "experiments": "PLANNED"}
# Fixed: events about an object that must be there, and its collection.
ABOUT = {
    "evidence.verified": "evidence", "evidence.source_resolved": "evidence", "evidence.content_inspected": "evidence", "claim_relation.proposed": "claims", "claim_relation.verified": "claims",
    "research_question.sealed": "programs", "working.advanced": "workings", "program.closed": "programs",
}
# Fixed order of a program's states; it only ever moves on.
PROGRAM_STATES = ["IDEA", "EVIDENCE_RECORDED", "CLAIMS_REGISTERED", "HYPOTHESES_REGISTERED", "RQ_FROZEN", "DESIGN_FROZEN", "IMPLEMENTED", "PILOTED", "RUNNING", "RESULT_READY", "EVALUATED", "CLOSED"]
REACHED = {
    "program.created": "IDEA", "evidence.recorded": "EVIDENCE_RECORDED", "claim.created": "CLAIMS_REGISTERED", "hypothesis.created": "HYPOTHESES_REGISTERED", "research_question.sealed": "RQ_FROZEN",
    "protocol.sealed": "DESIGN_FROZEN", "experiment.implemented": "IMPLEMENTED", "experiment.pilot_completed": "PILOTED", "experiment.formal_started": "RUNNING", "analysis.computed": "RESULT_READY", "assessment.recorded": "EVALUATED", "program.closed": "CLOSED",
}
# Fixed: payload fields that hold ids, as (collection, or null for an object of any kind; events that have the field).
REFERENCES = {
    "program_id": ("programs", [k for k in CREATED if k != "program.created"]),
    "claim_ids": ("claims", ["hypothesis.created"]),
    "hypothesis_ids": ("hypotheses", ["protocol.drafted"]),
    "evidence_relations.evidence_id": ("evidence", ["claim.created"]),
    "evidence_id": ("evidence", ["reproduction.assessed", "claim_relation.proposed", "claim_relation.verified"]),
    "protocol_id": ("protocols", ["working.created", "experiment.planned", "run.recorded", "analysis.computed", "assessment.recorded", "deviation.recorded"]),
    "hypothesis_id": ("hypotheses", ["experiment.planned"]),
    "working_id": ("workings", ["experiment.planned"]),
    "experiment_id": ("experiments", ["run.recorded"]),
    "result_bundle_id": ("result_bundles", ["assessment.recorded", "reproduction.assessed"]),
    "claim_findings.claim_id": ("claims", ["assessment.recorded"]),
    "hypothesis_findings.hypothesis_id": ("hypotheses", ["assessment.recorded"]),
    "run_ids": ("runs", ["reproduction.assessed"]),
    "artifact_ids": ("artifacts", ["reproduction.assessed"]),
    "assessment_id": ("assessments", ["reproduction.assessed"]),
    "assessment_ids": ("assessments", ["decision.sealed"]),
    "producer_id": (None, ["artifact.registered"]),
    "input_ids": (None, ["artifact.registered"]),
    "subject_ids": (None, ["issue.opened"]),
    "affected_object_ids": (None, ["deviation.recorded"]),
}
#: Payload fields that rules look at; objects that differ by event stay JSON text.
PAYLOAD = (
    "program_id string, slug string, type string, claim_ids array<string>, hypothesis_ids array<string>, study_mode string, protocol_id string, hypothesis_id string, working_id string, experiment_id string, result_bundle_id string, evidence_id string, "
    "evidence_relations array<struct<evidence_id:string,relation:string>>, relation string, run_ids array<string>, artifact_ids array<string>, assessment_id string, assessment_ids array<string>, producer_id string, input_ids array<string>, subject_ids array<string>, "
    f"affected_object_ids array<string>, claim_findings {_CLAIM_FINDING}, hypothesis_findings {_HYPOTHESIS_FINDING}, status string, phase string, kind string, arm string, severity string, outcome string, required_actions array<string>, unresolved_issue_ids array<string>, "
    "unresolved_uncertainties array<string>, limitations array<string>, lineage struct<parent_program_id:string>, verification struct<source_resolved:boolean,content_inspected:boolean>, destination struct<execution:string,provider:string>, "
    "disclosure struct<includes_credentials:boolean>, approval struct<required:boolean,status:string,approved_by:string,approved_at:string,rationale:string>, approved_by string, source string, task_id string, rite_sigil string, rite string, from_stage string, to_stage string, "
    "analysis_spec string, bundle string, bundle_sigil string, result string, capability string, snapshot string, input_sigil string, bindings struct<review_id:string>, analysis_included boolean, analysis_disposition struct<included:boolean>"
)
_ACTOR = "struct<actor_id:string,actor_type:string>"


def _named() -> Column:
    kind = F.col("type")
    for old, new in ALIASES.items():
        kind = F.when(kind == old, new).otherwise(kind)
    return kind


def _type(events: DataFrame) -> DataFrame:
    return events.withColumn("type", _named())


#: The type of each payload field, by name.
_FIELDS = dict(x.split(" ", 1) for x in PAYLOAD.split(", "))


def parsed(events: DataFrame, fields: list[str] | None = None, also: list[str] | None = None) -> DataFrame:
    """Events with their payload fields as p (or those named; program, protocol and bundle among them), their type in its newer name, and the program they belong to; one row each. also: further columns of theirs to keep."""
    payload = PAYLOAD if fields is None else ", ".join(f"{c} {_FIELDS[c]}" for c in fields)
    read = F.from_json("payload", payload)
    actor = F.struct(F.col("actor.actor_id").alias("actor_id"), F.col("actor.actor_type").alias("actor_type")) if "actor" in events.columns else F.lit(None).cast(_ACTOR)
    rows = _type(events.withColumn("written_type", F.col("type"))).select("ledger_id", "sequence", "event_id", "type", "written_type", F.col("object_id").alias("id"), F.col("occurred_at").alias("at"), actor.alias("actor"), *(also or []), (read if fields is None else once(read)).alias("p"))
    bundle = lambda c: F.coalesce(F.col(f"p.{c}"), F.when(F.col("type") == "analysis.computed", F.get_json_object("p.bundle", f"$.{c}")))
    p = F.col("p").withField("program_id", bundle("program_id")).withField("protocol_id", bundle("protocol_id"))
    return rows.withColumn("p", p)


#: Fixed: all event types that have a meaning; any other is a breach.
KNOWN = list(dict.fromkeys([*CREATED, *ALIASES, *(t for t, *_ in STEPS), *ABOUT]))


def by_type(events: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """read(events), which keeps the column _part, as a table cut to files by type: what asks for some types reads theirs alone, and asking for a type that no event has is known to give nothing before anything runs.

    Types without a meaning, however many, lie together.  Events are sorted
    before they are read, as they are much narrower then.  Files of mostly empty
    fields are much smaller than the rows, so joins sort instead of trusting
    the size of the files.
    """
    spark, path = events.sparkSession, scratch(events.sparkSession)
    rows = read(events.withColumn("_part", F.coalesce(F.when(_named().isin(KNOWN), _named()), F.lit("other"))).sortWithinPartitions("_part"))
    rows.write.partitionBy("_part").parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    found = [r[0] for r in table.select("_part").distinct().collect()]
    own = lambda t: F.col("type") if t == "other" else F.lit(t).alias("type")
    parts = [table.where(F.col("_part") == t).select(*(own(t) if c == "type" else F.col(c) for c in rows.columns if c != "_part")) for t in sorted(found)]
    return union(parts or [table.where("false").drop("_part")]).hint("merge")


def created(events: DataFrame, kind: str) -> DataFrame:
    """Objects as their creating events have them: ledger_id, id, sequence, at, payload fields; of one id, the first."""
    rows = _type(events).where(F.col("type") == kind)
    first = rows.groupBy("ledger_id", F.col("object_id").alias("id")).agg(F.min_by(F.struct("sequence", F.col("occurred_at").alias("at"), "payload"), "sequence").alias("e"))
    return first.select("ledger_id", "id", "e.sequence", "e.at", F.from_json("e.payload", CREATED[kind][1]).alias("p")).select("ledger_id", "id", "sequence", "at", "p.*")


def every_object(rows: DataFrame) -> DataFrame:
    """ledger_id, id, collection, program_id, sequence of each object when it was created; rows: parsed() events."""
    kinds = F.create_map(*(x for k, (c, _) in CREATED.items() for x in (F.lit(k), F.lit(c))))
    program = F.when(F.col("type") == "program.created", F.col("id")).otherwise(F.col("p.program_id"))
    return rows.where(F.col("type").isin(list(CREATED))).select("ledger_id", "id", F.try_element_at(kinds, F.col("type")).alias("collection"), program.alias("program_id"), "sequence")


def transitions(rows: DataFrame) -> DataFrame:
    """ledger_id, collection, id, sequence, type, state: what each event of an object's life leads to, its creation first; rows: parsed() events."""
    made = {k: (c, START.get(c)) for k, (c, _) in CREATED.items() if c in START or c == "review_requests"}
    steps = made | {t: (c, to) for t, c, _, to in STEPS}
    of = F.create_map(*(x for t, (c, _) in steps.items() for x in (F.lit(t), F.lit(c))))
    to = F.create_map(*(x for t, (_, s) in steps.items() if s for x in (F.lit(t), F.lit(s))))
    own = rows.where(F.col("type").isin(list(steps)))
    state = F.coalesce(F.try_element_at(to, F.col("type")), F.col("p.status"), F.lit("PREPARED"))
    return own.select("ledger_id", F.try_element_at(of, F.col("type")).alias("collection"), "id", "sequence", "type", state.alias("state"))


def with_state(objects: DataFrame, steps: DataFrame, collection: str) -> DataFrame:
    now = rules.current_state(steps.where(F.col("collection") == collection), ["ledger_id", "id"], "state", "sequence").withColumnRenamed("state", "current_status")
    return objects.join(now, ["ledger_id", "id"], "left")


def _reached(rows: DataFrame) -> Column:
    state = F.try_element_at(F.create_map(*(x for k, v in REACHED.items() for x in (F.lit(k), F.lit(v)))), F.col("type"))
    state = F.when((F.col("type") == "run.recorded") & ~F.col("p.phase").eqNullSafe(F.lit("PILOT")), "RUNNING").otherwise(state)
    return F.when((F.col("type") == "artifact.registered") & (F.col("p.kind") == "implementation"), "IMPLEMENTED").otherwise(state)


def reached(rows: DataFrame) -> DataFrame:
    """ledger_id, program_id, sequence, type, state: each event that lifts its program; runs that aren't pilots and implementation artifacts do too. Only events that don't name their program are looked up among the objects."""
    about = F.when(F.col("type").startswith("program.") | F.col("type").startswith("research_question."), F.col("id"))
    told = rows.withColumn("state", _reached(rows)).where("state is not null or type = 'decision.sealed'").select("ledger_id", "id", F.coalesce("p.program_id", about).alias("program_id"), "sequence", "type", "state")
    out, untold = told.where("program_id is not null").drop("id"), told.where("program_id is null").drop("program_id")
    if untold.isEmpty():
        return out
    own = every_object(rows).select("ledger_id", "id", "program_id").distinct()
    return out.unionByName(untold.join(own, ["ledger_id", "id"], "left").drop("id"))


def program_status(events: DataFrame) -> DataFrame:
    """ledger_id, program_id, status: the furthest state reached."""
    return _program_status(parsed(events, REACHED_FIELDS))


def _program_status(rows: DataFrame) -> DataFrame:
    return rules.highest_status(reached(rows).where("state is not null"), ["ledger_id", "program_id"], "state", PROGRAM_STATES).drop("rank")


def evidence_flags(rows: DataFrame) -> DataFrame:
    """ledger_id, sequence, id, type, source_resolved, content_inspected as each event sets them (null: doesn't); rows: parsed() events."""
    t = F.col("type")
    flag = lambda name, own: F.when(t == own, True).when(t.isin("evidence.recorded", "evidence.verified"), F.coalesce(F.col(f"p.verification.{name}"), F.lit(False)))
    return rows.where(t.startswith("evidence.")).select("ledger_id", "sequence", "id", "type", flag("source_resolved", "evidence.source_resolved").alias("source_resolved"), flag("content_inspected", "evidence.content_inspected").alias("content_inspected"))


def relations(rows: DataFrame) -> DataFrame:
    """ledger_id, claim_id, evidence_id, sequence, step (PROPOSED or VERIFIED), relation: one row for each step of a relation."""
    pair = rows.where(F.col("type").isin("claim.created", "claim_relation.proposed", "claim_relation.verified"))
    one = F.array(F.struct(F.col("p.evidence_id").alias("evidence_id"), F.col("p.relation").alias("relation")))
    many = F.when(F.col("type") == "claim.created", F.coalesce("p.evidence_relations", F.array().cast("array<struct<evidence_id:string,relation:string>>"))).otherwise(one)
    step = F.when(F.col("type") == "claim_relation.verified", "VERIFIED").otherwise("PROPOSED")
    return pair.select("ledger_id", F.col("id").alias("claim_id"), "sequence", step.alias("step"), F.posexplode(many).alias("place", "r")).select("ledger_id", "claim_id", "r.evidence_id", "sequence", "step", "place", "r.relation")


#: Payload fields that parsed() needs for relations().
RELATION_FIELDS = ["program_id", "protocol_id", "bundle", "evidence_id", "evidence_relations", "relation"]


def claim_relations(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """ledger_id, claim_id, evidence_id, relation, status of each pair; parts: into how many partitions the steps are dealt (see ordered.parts()), else the session's."""
    by = ["ledger_id", "claim_id", "evidence_id"]
    steps = relations(rows)
    steps = steps if parts is None else steps.repartition(parts, *by[1:])
    return steps.groupBy(*by).agg(F.min_by("relation", "sequence").alias("relation"), F.when(F.bool_or(F.col("step") == "VERIFIED"), "VERIFIED").otherwise("PROPOSED").alias("status"))


def findings(rows: DataFrame, kind: str) -> DataFrame:
    """ledger_id, id, sequence, position, status that assessments give to claims or hypotheses; an experiment makes its hypothesis ACTIVE."""
    own = rows.where("type = 'assessment.recorded'").select("ledger_id", "sequence", F.posexplode(f"p.{kind}_findings").alias("position", "f")).select("ledger_id", F.col(f"f.{kind}_id").alias("id"), "sequence", "position", F.col("f.status").alias("status"))
    if kind != "hypothesis":
        return own
    started = rows.where("type = 'experiment.planned' and p.hypothesis_id is not null")
    return own.unionByName(started.select("ledger_id", F.col("p.hypothesis_id").alias("id"), "sequence", F.lit(0).alias("position"), F.lit("ACTIVE").alias("status")))


#: Payload fields that parsed() needs for reached(), and for all that tables() asks of events that don't create an object.
REACHED_FIELDS = ["program_id", "protocol_id", "bundle", "phase", "kind"]
TABLE_FIELDS = list(dict.fromkeys([*REACHED_FIELDS, *RELATION_FIELDS, "status", "verification", "claim_findings", "hypothesis_findings", "hypothesis_id"]))


def tables(events: DataFrame) -> dict[str, DataFrame]:
    """All current-state tables by collection."""
    return _tables(events, parsed(events, TABLE_FIELDS))


def _tables(events: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    ids = lambda of: F.transform(F.array_sort(F.collect_list(F.struct("sequence", "id"))), lambda x: x["id"]).alias(of)
    out = {c: created(events, k) for k, (c, _) in CREATED.items()}
    children = every_object(rows).where("collection <> 'programs'").groupBy("ledger_id", "program_id").agg(ids("children"))
    question = rows.where("type = 'research_question.sealed'").groupBy("ledger_id", "id").agg(F.min("at").alias("question_sealed_at"))
    out["programs"] = out["programs"].join(_program_status(rows).withColumnRenamed("program_id", "id"), ["ledger_id", "id"], "left").join(children.withColumnRenamed("program_id", "id"), ["ledger_id", "id"], "left").join(question, ["ledger_id", "id"], "left")
    flags = evidence_flags(rows).groupBy("ledger_id", "id").agg(F.coalesce(F.bool_or("source_resolved"), F.lit(False)).alias("resolved"), F.coalesce(F.bool_or("content_inspected"), F.lit(False)).alias("inspected"))
    out["evidence"] = out["evidence"].join(flags, ["ledger_id", "id"], "left")
    steps = transitions(rows)
    for c in ("protocols", "issues", "experiments", "review_requests"):
        out[c] = with_state(out[c], steps, c)
    for c, kind in (("claims", "claim"), ("hypotheses", "hypothesis")):
        out[c] = rules.last_findings(findings(rows, kind), out[c].withColumn("status", F.lit("PROPOSED")))
    related = claim_relations(rows).groupBy("ledger_id", F.col("claim_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("evidence_id", "relation", "status"))).alias("relations"))
    out["claims"] = out["claims"].join(related, ["ledger_id", "id"], "left")
    by_protocol = out["deviations"].groupBy("ledger_id", F.col("protocol_id").alias("of")).agg(ids("deviations")).withColumnRenamed("of", "id")
    out["protocols"] = out["protocols"].join(by_protocol, ["ledger_id", "id"], "left")
    return out


def reference_uses(rows: DataFrame) -> DataFrame:
    """ledger_id, sequence, id, type, program_id, ref, kind (collection it must be in, or null) of every id field; one pass over parsed() events."""
    kinds = dict(x.strip().split(" ", 1) for x in PAYLOAD.split(", ") if " " in x.strip())
    t, fields = F.col("type"), []
    for field, (kind, types) in REFERENCES.items():
        many = "." in field or kinds[field].startswith("array")
        held = F.coalesce(F.col(f"p.{field}"), F.array().cast("array<string>")) if many else F.array(f"p.{field}")
        of = F.lit(kind).cast("string").alias("kind")
        fields.append(F.when(t.isin(types), F.transform(held, lambda x: F.struct(x.alias("ref"), of))))  # noqa: B023  used at once
    about = F.try_element_at(F.create_map(*(F.lit(x) for pair in ABOUT.items() for x in pair)), t)
    fields.append(F.when(about.isNotNull(), F.array(F.struct(F.col("id").alias("ref"), about.alias("kind")))))
    none = F.array().cast("array<struct<ref:string,kind:string>>")
    uses = rows.select("ledger_id", "sequence", "id", "type", F.col("p.program_id").alias("program_id"), F.concat(*(F.coalesce(f, none) for f in fields)).alias("u"))
    return uses.withColumn("u", F.explode("u")).select("ledger_id", "sequence", "id", "type", "program_id", "u.ref", "u.kind").where("ref is not null")


def record_edges(rows: DataFrame) -> DataFrame:
    """ledger_id, src, dst, kind, sequence of every id field of every kind of record: src is the object of the event, kind the field's collection (any: of whatever kind); rows: parsed() events."""
    made = rows.where(F.col("type").isin(list(CREATED)))
    uses = reference_uses(made).where("ref <> id")
    return uses.select("ledger_id", F.col("id").alias("src"), F.col("ref").alias("dst"), F.coalesce("kind", F.lit("any")).alias("kind"), "sequence").distinct()


def state_digests(events: DataFrame) -> DataFrame:
    """ledger_id, collection, n, a, b: number of rows of each current-state table and two sums of hashes of their JSON, whatever their order."""
    frames = []
    kept_rows = by_type(events, lambda e: parsed(e, TABLE_FIELDS, ["payload", "_part"]))
    own = kept_rows.select("ledger_id", "sequence", "type", F.col("id").alias("object_id"), F.col("at").alias("occurred_at"), "payload")
    for name, rows in _tables(own, kept_rows).items():
        body = F.to_json(F.struct(*(c for c in sorted(rows.columns) if c not in ("ledger_id", "sequence"))))
        frames.append(rows.groupBy("ledger_id").agg(F.count("*").alias("n"), F.sum(id_hash(1, body)).alias("a"), F.sum(id_hash(2, body)).alias("b")).select("ledger_id", F.lit(name).alias("collection"), "n", "a", "b"))
    return union(frames)


def state_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """ledger_id, collection, n_before, n_after of the state tables in which two sets of events differ, for the ledgers of both; none proves that the state is the same.

    Tables are compared by state_digests(), so what meets is a row for each
    ledger and table; sequences may differ, as those of a converted ledger do.
    """
    both = state_digests(before).select("ledger_id", "collection", F.struct("n", "a", "b").alias("x")).join(state_digests(after).select("ledger_id", "collection", F.struct("n", "a", "b").alias("y")), ["ledger_id", "collection"], "full_outer")
    return both.where("not (x <=> y)").select("ledger_id", "collection", F.coalesce("x.n", F.lit(0)).alias("n_before"), F.coalesce("y.n", F.lit(0)).alias("n_after"))


def audit(events: DataFrame) -> DataFrame:
    """ledger_id, sequence, object_id, rule of every event that breaks a rule across objects.

    Events are parsed once and cut to files by type; each family of rules reads
    what it needs of them.  A field that is missing is a matter of the records' contracts.
    """
    rows = by_type(events, lambda e: parsed(e, also=["_part"]).withColumn("again", _again()))
    objects = every_object(rows)
    return union([
        references(rows, objects), steps(rows), evidence(rows), claims(rows), studies(rows), pilots(rows), reviews(rows), results(rows), workings(rows), decisions(rows), closing(rows), analyses(events, rows),
    ]).distinct()


def references(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Unknown types, repeated ids and slugs, repeated elements (rows have it as again), and references that aren't there before or are of another program."""
    types = violations(rows.where(~F.col("type").isin(KNOWN)), {"unknown type": F.lit(True)}, "id")
    slugs = rows.where("type = 'program.created' and p.slug is not null").select("ledger_id", "sequence", "id", F.col("p.slug").alias("slug"))
    slugs = violations(rules.duplicates(slugs, ["ledger_id", "slug"]), {"duplicate slug": F.lit(True)}, "id")
    repeated = violations(rows.where("again"), {"repeated element": F.lit(True)}, "id")
    return union([types, slugs, repeated, _placed(rows, objects)])


def _again() -> Column:
    """Whether a list of ids in a payload has one twice."""
    again = F.lit(False)
    for c in ("claim_ids", "hypothesis_ids", "assessment_ids", "input_ids", "subject_ids", "affected_object_ids", "evidence_relations.evidence_id", "claim_findings.claim_id", "hypothesis_findings.hypothesis_id"):
        again = again | F.coalesce(rules.repeated_elements(F.col(f"p.{c}")), F.lit(False))
    return again


def _placed(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Repeated ids, and references that aren't there before or are of another program: objects and references meet what is known of an id in one join."""
    by = ["ledger_id", "ref"]
    review = F.col("collection") == "review_artifacts"  # a completed review has its request's id; it can be completed once by its states
    program = F.when(~review, F.col("program_id"))
    # when an id was first there, in any collection and in each, and the programs it was created under
    firsts = {c: f"_{c}" for c, _ in CREATED.values()}
    made = objects.withColumnRenamed("id", "ref").where("ref is not null").repartition(*by).groupBy(*by).agg(
        F.min("sequence").alias("_any"), *(F.min(F.when(F.col("collection") == c, F.col("sequence"))).alias(n) for c, n in firsts.items()),
        F.min(program).alias("_low"), F.max(program).alias("_high"), F.bool_or(~review & F.col("program_id").isNull()).alias("_lost"),
    )
    uses = reference_uses(rows).select("ledger_id", "sequence", "id", "program_id", "ref", "kind", F.lit(False).alias("own"))
    own = objects.where("collection <> 'review_artifacts' and id is not null").select("ledger_id", "sequence", "id", "program_id", F.col("id").alias("ref"), F.col("collection").alias("kind"), F.lit(True).alias("own"))
    found = uses.unionByName(own).join(made, by, "left")
    first = F.when(F.col("kind").isNull(), F.col("_any")).otherwise(F.coalesce(*(F.when(F.col("kind") == c, F.col(n)) for c, n in firsts.items())))
    inner = ~F.col("own") & ~F.col("kind").eqNullSafe(F.lit("programs"))
    return violations(
        found,
        {
            "duplicate id": F.col("own") & (F.col("sequence") > first),
            "unknown reference": ~F.col("own") & (first.isNull() | (first >= F.col("sequence"))),
            "reference to another program": inner & F.col("program_id").isNotNull() & (F.col("_lost") | (F.col("_low") != F.col("program_id")) | (F.col("_high") != F.col("program_id"))),
        },
        "id",
    )


def steps(rows: DataFrame) -> DataFrame:
    """Events that don't start from the state they need, and changes of experiments under another lineage than they were planned under."""
    w = Window.partitionBy("ledger_id", "collection", "id").orderBy("sequence")
    moves = transitions(rows).withColumn("source", F.lag("state").over(w))
    right = F.array([F.lit(f"{s}>{t}") for t, _, sources, _ in STEPS for s in sources])
    step = F.col("type").isin([t for t, *_ in STEPS])
    order = violations(moves, {"transition": step & ~F.coalesce(F.array_contains(right, F.concat_ws(">", "source", "type")), F.lit(False))}, "id")
    own = F.struct("p.program_id", "p.protocol_id", "p.working_id", F.col("written_type").alias("kind"))
    planned = rows.where("type = 'experiment.planned'").groupBy("ledger_id", "id").agg(F.min_by(own, "sequence").alias("o"))
    later = rows.where("type like 'experiment.%' and type <> 'experiment.planned'").join(planned, ["ledger_id", "id"])
    differs = lambda c: ~F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}"))
    lineage = violations(later, {"other lineage": differs("program_id") | differs("protocol_id") | (F.col("o.working_id").isNotNull() & differs("working_id")), "experiment of the old kind": F.col("o.kind") == "experiment.created"}, "id")
    opened = rows.where("type = 'issue.opened'").groupBy("ledger_id", "id").agg(F.min_by("p.program_id", "sequence").alias("_program"))
    solved = rows.where("type = 'issue.resolved'").join(opened, ["ledger_id", "id"])
    return union([order, lineage, violations(solved, {"other lineage": ~F.col("p.program_id").eqNullSafe(F.col("_program"))}, "id")])


def evidence(rows: DataFrame) -> DataFrame:
    """Flags of evidence that are lowered, set twice or set too early."""
    wf = Window.partitionBy("ledger_id", "id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.max(F.coalesce(F.col(c), F.lit(False))).over(wf), F.lit(False))
    flags = evidence_flags(rows)
    later = flags.where("type <> 'evidence.recorded'").select("ledger_id", "id").distinct()
    same = F.col("f.ledger_id").eqNullSafe(F.col("l.ledger_id")) & F.col("f.id").eqNullSafe(F.col("l.id"))
    flags = flags.alias("f").join(later.alias("l"), same, "left_semi").withColumn("_r", before("source_resolved")).withColumn("_i", before("content_inspected"))
    t = F.col("type")
    return violations(
        flags,
        {
            "flag lowered": (t == "evidence.verified") & ((F.col("_r") & ~F.col("source_resolved")) | (F.col("_i") & ~F.col("content_inspected"))),
            "resolved twice": (t == "evidence.source_resolved") & F.col("_r"),
            "inspected early or twice": (t == "evidence.content_inspected") & (~F.col("_r") | F.col("_i")),
        },
        "id",
    )


def claims(rows: DataFrame) -> DataFrame:
    """Relations of claims to evidence that isn't inspected yet, that are proposed twice, or verified without or before a proposal; questions sealed twice."""
    ready = evidence_flags(rows).groupBy("ledger_id", F.col("id").alias("evidence_id")).agg(F.min(F.when(F.col("source_resolved"), F.col("sequence"))).alias("_r"), F.min(F.when(F.col("content_inspected"), F.col("sequence"))).alias("_i"))
    w = Window.partitionBy("ledger_id", "claim_id", "evidence_id").orderBy("sequence", "place").rowsBetween(Window.unboundedPreceding, -1)
    had = lambda step: F.count_if(F.col("step") == step).over(w)
    made = rows.where("type = 'claim.created'").select("ledger_id", F.col("id").alias("claim_id"), "sequence", F.lit(True).alias("_made"))
    found = relations(rows).withColumn("_proposed", had("PROPOSED")).withColumn("_verified", had("VERIFIED")).join(ready, ["ledger_id", "evidence_id"], "left").join(made, ["ledger_id", "claim_id", "sequence"], "left")
    seen = F.coalesce((F.col("_r") < F.col("sequence")) & (F.col("_i") < F.col("sequence")), F.lit(False))
    verified = F.col("step") == "VERIFIED"
    out = violations(
        found,
        {
            "evidence not inspected": ~seen & (verified | F.coalesce(F.col("_made"), F.lit(False))),
            "relation proposed twice": ~verified & (F.col("_proposed") > 0),
            "relation not proposed": verified & (F.col("_proposed") == 0),
            "relation verified twice": verified & (F.col("_verified") > 0),
        },
        "claim_id",
    )
    sealed = rows.where("type = 'research_question.sealed'").select("ledger_id", "id", "sequence")
    return out.unionByName(violations(rules.duplicates(sealed, ["ledger_id", "id"]), {"question sealed twice": F.lit(True)}, "id"))


def _protocols(rows: DataFrame) -> DataFrame:
    """ledger_id, protocol_id, _frozen (sequence of its seal), _hypotheses, _spec."""
    frozen = F.min(F.when(F.col("type") == "protocol.sealed", F.col("sequence"))).alias("_frozen")
    drafted = F.when(F.col("type") == "protocol.drafted", F.col("sequence"))
    return rows.where("type in ('protocol.sealed', 'protocol.drafted')").groupBy("ledger_id", F.col("id").alias("protocol_id")).agg(frozen, F.min_by("p.hypothesis_ids", drafted).alias("_hypotheses"), F.min_by("p.analysis_spec", drafted).alias("_spec"))


def studies(rows: DataFrame) -> DataFrame:
    """Work under a protocol that isn't frozen, hypotheses that the protocol doesn't register, runs under another lineage than their experiment, and assessments."""
    protocols = _protocols(rows)
    none = F.array().cast("array<string>")
    used = F.when(F.col("type") == "experiment.planned", F.array_compact(F.array("p.hypothesis_id"))).when(F.col("type") == "assessment.recorded", F.col("p.hypothesis_findings.hypothesis_id"))
    under = rows.where("type in ('working.created', 'experiment.planned', 'deviation.recorded', 'assessment.recorded') and p.protocol_id is not null").withColumn("protocol_id", F.col("p.protocol_id")).join(protocols, ["ledger_id", "protocol_id"])
    frozen = F.coalesce(F.col("_frozen") < F.col("sequence"), F.lit(False))
    first = violations(
        under,
        {
            "protocol not frozen": (F.col("type") != "assessment.recorded") & ~frozen,
            "hypothesis not of the protocol": F.size(F.array_except(F.coalesce(used, none), F.coalesce("_hypotheses", none))) > 0,
            "confirmatory without finding": (F.col("p.study_mode") == "confirmatory") & (F.col("type") == "assessment.recorded") & (F.size(F.coalesce("p.hypothesis_findings.hypothesis_id", none)) == 0),
        },
        "id",
    )
    drafts = violations(rows.where("type = 'protocol.drafted'"), {"confirmatory without hypothesis": (F.col("p.study_mode") == "confirmatory") & (F.size(F.coalesce("p.hypothesis_ids", none)) == 0)}, "id")
    own = lambda t, name: rows.where(F.col("type") == t).groupBy("ledger_id", F.col("id").alias(name)).agg(F.min_by(F.struct("p.program_id", "p.protocol_id"), "sequence").alias("o"))
    other = (~F.col("p.program_id").eqNullSafe(F.col("o.program_id"))) | (~F.col("p.protocol_id").eqNullSafe(F.col("o.protocol_id")))
    runs = rows.where("type = 'run.recorded'").withColumn("experiment_id", F.col("p.experiment_id"))
    included = F.coalesce(F.col("p.analysis_disposition.included"), F.col("p.analysis_included"), F.lit(False))
    kept_runs = violations(runs, {"included run not completed": included & ~F.col("p.status").eqNullSafe(F.lit("COMPLETED"))}, "id")
    of_experiment = violations(runs.join(own("experiment.planned", "experiment_id"), ["ledger_id", "experiment_id"]), {"other lineage": other}, "id")
    assessed = rows.where("type = 'assessment.recorded'").withColumn("bundle_id", F.col("p.result_bundle_id"))
    of_bundle = violations(assessed.join(own("analysis.computed", "bundle_id"), ["ledger_id", "bundle_id"]), {"other lineage": other}, "id")
    pinned = rows.where("type = 'analysis.computed' and p.bundle_sigil is not null").withColumn("_own", json_digest(F.col("p.bundle")))
    return union([first, drafts, kept_runs, of_experiment, of_bundle, violations(pinned, {"bundle digest": ~F.col("p.bundle_sigil").eqNullSafe(F.col("_own"))}, "id")])


def pilots(rows: DataFrame) -> DataFrame:
    """Completed pilots without the runs that the protocol registers for them, in the right experiment, protocol and phase, or without an arm that is compared."""
    spec = F.from_json("_spec", "pilot_run_ids array<string>, comparisons array<struct<experiment_id:string,arms:array<string>>>")
    done = rows.where("type = 'experiment.pilot_completed'").select("ledger_id", "sequence", "id", F.col("p.program_id").alias("program_id"), F.col("p.protocol_id").alias("protocol_id"))
    done = done.join(_protocols(rows), ["ledger_id", "protocol_id"], "left").withColumn("s", spec)
    none = violations(done, {"no registered pilot": F.coalesce(F.size("s.pilot_run_ids"), F.lit(0)) <= 0}, "id")
    runs = rows.where("type = 'run.recorded'").groupBy("ledger_id", F.col("id").alias("run_id")).agg(F.min_by(F.struct("sequence", "p.program_id", "p.protocol_id", "p.experiment_id", "p.phase", "p.arm"), "sequence").alias("r"))
    needed = done.select("ledger_id", "sequence", "id", "program_id", "protocol_id", F.explode("s.pilot_run_ids").alias("run_id")).join(runs, ["ledger_id", "run_id"], "left")
    there = F.coalesce(F.col("r.sequence") < F.col("sequence"), F.lit(False))
    fits = F.col("r.program_id").eqNullSafe(F.col("program_id")) & F.col("r.protocol_id").eqNullSafe(F.col("protocol_id")) & F.col("r.experiment_id").eqNullSafe(F.col("id")) & F.col("r.phase").eqNullSafe(F.lit("PILOT"))
    gaps = violations(needed, {"pilot run missing": ~there, "pilot run of another kind": there & ~fits}, "id")
    arms = done.select("ledger_id", "sequence", "id", F.explode("s.comparisons").alias("c")).where("c.experiment_id = id").select("ledger_id", "sequence", "id", F.explode("c.arms").alias("arm"))
    recorded = needed.where(there).select("ledger_id", "sequence", "id", F.col("r.arm").alias("arm"))
    left = arms.join(recorded, ["ledger_id", "sequence", "id", "arm"], "left_anti")
    return union([none, gaps, violations(left, {"pilot arm missing": F.lit(True)}, "id")])


def reviews(rows: DataFrame) -> DataFrame:
    """Requests outside the bounds of their kind, and approvals, completions and acceptances by or for something else than they need."""
    p = lambda c: F.col(f"p.{c}")
    asked = rows.where("type = 'review.requested'")
    outside = p("type") == "external_diff_review"
    state = F.when(outside, WAITS).otherwise("PREPARED")
    bounds = (
        ~p("destination.execution").eqNullSafe(F.when(outside, "external").otherwise("local"))
        | ~p("status").eqNullSafe(state)
        | ~p("approval.required").eqNullSafe(outside)
        | ~p("approval.status").eqNullSafe(F.when(outside, WAITS).otherwise("NOT_REQUIRED"))
        | F.coalesce("p.approval.approved_by", "p.approval.approved_at", "p.approval.rationale").isNotNull()
        | F.when(outside, (F.coalesce(p("destination.provider"), F.lit("")) == "") | F.coalesce(p("disclosure.includes_credentials"), F.lit(False))).otherwise(p("destination.provider").isNotNull())
    )
    first = asked.groupBy("ledger_id", "id").agg(F.min_by("p", "sequence").alias("q"))
    later = rows.where("type in ('review.approved', 'review.completed', 'review.accepted')").join(first, ["ledger_id", "id"])
    t, abroad = F.col("type"), F.col("q.type") == "external_diff_review"
    human = F.coalesce(F.col("actor.actor_type") == "human", F.lit(False))
    approved = (t == "review.approved") & (~abroad | F.coalesce(F.col("q.disclosure.includes_credentials"), F.lit(False)) | ~human | ~p("approved_by").eqNullSafe(F.col("actor.actor_id")))
    source = lambda c: F.get_json_object("p.source", f"$.{c}")
    elsewhere = (t == "review.completed") & (~source("execution").eqNullSafe(F.col("q.destination.execution")) | ~source("provider").eqNullSafe(F.col("q.destination.provider")))
    out = [violations(asked, {"review outside its bounds": bounds}, "id"), violations(later, {"approval": approved, "other source": elsewhere, "accepted by no human": (t == "review.accepted") & ~human}, "id")]
    accepted = rows.where("type = 'agent-result.accepted'").groupBy("ledger_id", F.col("id").alias("task_id")).agg(F.min_by(F.struct("sequence", "p"), "sequence").alias("a"))
    done = later.where("type = 'review.completed'").withColumn("task_id", F.col("p.task_id")).join(accepted, ["ledger_id", "task_id"], "left")
    # fixed names of the two capabilities that carry a review out, as endings
    capability = F.get_json_object("a.p.capability", "$.id")
    right = (
        (F.col("a.sequence") < F.col("sequence")) & F.col("a.p.program_id").eqNullSafe(F.col("q.program_id")) & (F.get_json_object("a.p.result", "$.status") == "COMPLETED")
        & capability.endswith(F.when(abroad, ".review.external").otherwise(".review.local")) & F.col("a.p.bindings.review_id").eqNullSafe(F.col("id"))
    )
    return union([*out, violations(done, {"no task result for the review": ~F.coalesce(right, F.lit(False))}, "id")])


def review_lives(rows: DataFrame) -> DataFrame:
    """A row for each review: ledger_id, id, program_id, kind, state, and when it was requested, approved, completed and accepted, by whom, by which task; seconds from request to the last step."""
    own = rows.where(F.col("type").startswith("review."))
    at = lambda t, c: F.min_by(c, F.when(F.col("type") == t, F.col("sequence")))
    moved = transitions(rows).where("collection = 'review_requests'").groupBy("ledger_id", "id").agg(F.max_by("state", "sequence").alias("state"), F.count("*").alias("steps"))
    asked = "review.requested"
    names = {"requested": asked, "approved": "review.approved", "completed": "review.completed", "accepted": "review.accepted"}
    lives = own.groupBy("ledger_id", "id").agg(
        at(asked, F.col("p.program_id")).alias("program_id"), at(asked, F.col("p.type")).alias("kind"), at(asked, F.col("p.destination.provider")).alias("provider"), *(at(t, F.col("at")).alias(f"{n}_at") for n, t in names.items()),
        at("review.approved", F.col("p.approved_by")).alias("approved_by"), at("review.accepted", F.col("actor.actor_id")).alias("accepted_by"), at("review.completed", F.col("p.task_id")).alias("task_id"),
    )
    last = F.coalesce("accepted_at", "completed_at", "approved_at", "requested_at")
    seconds = F.unix_timestamp(F.try_to_timestamp(last)) - F.unix_timestamp(F.try_to_timestamp("requested_at"))
    return lives.join(moved, ["ledger_id", "id"], "left").withColumn("seconds", seconds)


def results(rows: DataFrame) -> DataFrame:
    """Accepted task results that pin another task, input, snapshot or contract than their event."""
    own = rows.where("type = 'agent-result.accepted'")
    inner = lambda c: F.get_json_object("p.result", f"$.{c}")
    old, new = inner("schema_version").endswith("/1.0"), inner("schema_version").endswith("/1.1")
    pins = F.when(old, inner("input_sigil").eqNullSafe(F.col("p.input_sigil"))).when(new, inner("snapshot_sigil").eqNullSafe(F.get_json_object("p.snapshot", "$.snapshot_sigil")) & inner("capability_contract_sigil").eqNullSafe(F.get_json_object("p.capability", "$.contract_sigil")))
    return violations(own, {"result of another task": ~inner("task_id").eqNullSafe(F.col("id")), "result pins": ~F.coalesce(pins, F.lit(False))}, "id")


def workings(rows: DataFrame) -> DataFrame:
    """Workflow runs whose definition isn't the pinned one, and steps by hand that aren't one stage on, or in a run that advances by events."""
    made = rows.where("type = 'working.created'")
    pinned = violations(made.where("p.rite is not null").withColumn("_own", json_digest(F.col("p.rite"))), {"definition digest": ~F.col("p.rite_sigil").eqNullSafe(F.col("_own"))}, "id")
    rite = F.from_json("p.rite", "schema_version string, stages array<struct<name:string>>")
    first = made.groupBy("ledger_id", "id").agg(F.min_by(rite, "sequence").alias("w"))
    w = Window.partitionBy("ledger_id", "id").orderBy("sequence")
    moved = rows.where("type = 'working.advanced'").withColumn("_from", F.lag("p.to_stage").over(w)).join(first, ["ledger_id", "id"])
    names = F.col("w.stages.name")
    here = F.coalesce("_from", F.get(names, F.lit(0)))
    following = F.get(names, F.array_position(names, F.col("p.from_stage")).cast("int"))
    bad = F.coalesce(F.col("w.schema_version").endswith("/1.1"), F.lit(False)) | ~F.col("p.from_stage").eqNullSafe(here) | ~F.coalesce(following == F.col("p.to_stage"), F.lit(False))
    return pinned.unionByName(violations(moved, {"stage": bad}, "id"))


def decisions(rows: DataFrame) -> DataFrame:
    """Decisions that break a gate: by the issues open at that moment and the limitations of their assessments."""
    sealed = rows.where("type = 'decision.sealed'").select(
        "ledger_id", "sequence", F.col("id").alias("decision_id"), "p.program_id", "p.outcome", F.coalesce("p.assessment_ids", F.array().cast("array<string>")).alias("assessment_ids"),
        F.coalesce("p.required_actions", F.array().cast("array<string>")).alias("required_actions"), F.col("p.lineage.parent_program_id").alias("parent_program_id"), "p.unresolved_issue_ids", "p.unresolved_uncertainties",
    )
    issue = rows.where("type in ('issue.opened', 'issue.resolved')").groupBy("ledger_id", F.col("id").alias("issue_id"))
    opened = F.when(F.col("type") == "issue.opened", F.col("sequence"))
    issues = issue.agg(F.min_by("p.program_id", opened).alias("program_id"), F.min_by("p.severity", opened).alias("severity"), F.min(opened).alias("opened"), F.min(F.when(F.col("type") == "issue.resolved", F.col("sequence"))).alias("closed"))
    told = rows.where("type = 'assessment.recorded'").groupBy("ledger_id", F.col("id").alias("assessment_id")).agg(F.min_by("p.limitations", "sequence").alias("l")).select("ledger_id", "assessment_id", F.explode("l").alias("limitation"))
    return rules.decision_gates(sealed, issues, told)


def closing(rows: DataFrame) -> DataFrame:
    """Programs closed at another moment than exactly EVALUATED, or without a decision."""
    closes = rows.where("type = 'program.closed'").select("ledger_id", "sequence", F.col("id").alias("program_id"))
    if closes.isEmpty():
        return violations(closes, {"closed": F.lit(False)}, "program_id")
    before = closes.join(reached(rows).select("ledger_id", "program_id", F.col("sequence").alias("_s"), "type", "state"), ["ledger_id", "program_id"]).where("_s < sequence")
    rank = F.array_position(F.lit(PROGRAM_STATES), F.col("state"))
    at = before.groupBy("ledger_id", "program_id", "sequence").agg(F.max(rank).alias("rank"), F.count_if(F.col("type") == "decision.sealed").alias("decisions"))
    found = closes.join(at, ["ledger_id", "program_id", "sequence"], "left").na.fill(0, ["rank", "decisions"])
    return violations(found, {"closed before evaluation": F.col("rank") != PROGRAM_STATES.index("EVALUATED") + 1, "closed without decision": F.col("decisions") == 0}, "program_id")


def status_summary(state: dict[str, DataFrame], rows: DataFrame | None = None) -> DataFrame:
    """Per ledger: programs, and the open critical issues, sorted; with chained rows (ledger_id, sequence, digest) also the last digest."""
    n = state["programs"].groupBy("ledger_id").agg(F.count("*").alias("programs"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "status")))).alias("stages"))
    issues = state["issues"].where("current_status = 'OPEN' and severity = 'CRITICAL'").groupBy("ledger_id").agg(F.array_sort(F.collect_list("id")).alias("open_critical"))
    out = n.join(issues, "ledger_id", "left").withColumn("open_critical", F.coalesce("open_critical", F.array().cast("array<string>")))
    if rows is None:
        return out
    return out.join(rows.groupBy("ledger_id").agg(F.max_by("digest", "sequence").alias("last_digest")), "ledger_id", "left")


# Fixed: how ids of each collection begin.
PREFIXES = {
    "programs": "RP-", "evidence": "EV-", "claims": "CL-", "hypotheses": "HY-", "protocols": "PT-", "review_requests": "RV-", "task_results": "TK-", "workings": "WK-", "experiments": "EX-", "runs": "RUN-",
    "result_bundles": "RB-", "assessments": "AS-", "reproductions": "RR-", "decisions": "DE-", "artifacts": "AR-", "issues": "IS-", "deviations": "DV-",
}


def typed(column: Column, collection: str) -> Column:
    """Whether an id is of a collection, by its prefix."""
    return column.startswith(PREFIXES[collection])
