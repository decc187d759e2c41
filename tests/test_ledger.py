import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import digest as D
from tallyfold.operators import acceptance, chain, conversion, jobs, lineage, reads, rules, state, workflow
from tallyfold.operators import contracts as K
from tallyfold.sources import ledger


def canonical(x):
    return json.dumps(x, ensure_ascii=True, sort_keys=True, separators=(",", ":"))


def sealed(x):
    return "sha256:" + hashlib.sha256(canonical(x).encode()).hexdigest()


def chained(n, payload=lambda i: {"é": i, "n": {"z": 1.5, "a": [i]}}, kind=lambda i: "program.created", ids=lambda i: f"RP-{i}"):
    """A ledger of n events as lines."""
    out, previous = [], None
    for i in range(1, n + 1):
        at = f"2024-01-01T00:00:{i:02d}+00:00"
        event = {"schema_version": "x", "sequence": i, "event_id": f"CE-{i}", "type": kind(i), "object_id": ids(i), "occurred_at": at, "previous_receipt_sigil": previous, "actor": {"actor_id": "a", "actor_type": "human", "host": "h", "authenticated_by": "s"}, "payload": payload(i)}
        body = sealed(event)
        receipt = {"schema_version": "x", "receipt_id": f"RC-{i}", "event_id": f"CE-{i}", "event_body_sigil": body, "previous_receipt_sigil": previous, "accepted_at": at}
        receipt["receipt_sigil"] = previous = sealed(receipt)
        out.append(event | {"event_body_sigil": body, "receipt": receipt})
    return out


@pytest.fixture(scope="module")
def write(tmp_path_factory):
    def to(name, lines):
        folder = tmp_path_factory.mktemp(name)
        (folder / f"{name}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
        return str(folder)

    return to


def audited(spark, folder):
    good, bad = ledger.split_strict(ledger.read_lines(spark, folder))
    return ledger.parse(good), bad


def test_a_sound_ledger_has_no_violations(spark, write):
    events, bad = audited(spark, write("sound", chained(5)))
    assert bad.count() == 0 and chain.audit_events(events).count() == 0


TAMPER = {
    "body digest": lambda e: e["payload"].update(x=1),
    "receipt digest": lambda e: e["receipt"].update(receipt_id="RC-9"),
    "receipt time": lambda e: e["receipt"].update(accepted_at="2024-01-02T00:00:00+00:00"),
    "receipt event": lambda e: e["receipt"].update(event_id="CE-9"),
}


@pytest.mark.parametrize("rule", TAMPER)
def test_tampering_shows_in_its_own_row(spark, write, rule):
    lines = chained(4)
    TAMPER[rule](lines[2])
    events, _ = audited(spark, write("tampered", lines))
    found = {(r.sequence, r.rule) for r in chain.audit_events(events).collect()}
    assert (3, rule) in found and all(s == 3 for s, _ in found)
    assert chain.valid_prefix(events, chain.audit_events(events)).count() == 2


def test_order_and_gaps(spark, write):
    lines = chained(6)
    del lines[3]
    events, _ = audited(spark, write("gap", lines))
    assert {(r.sequence, r.rule) for r in chain.audit_events(events).collect()} == {(5, "sequence"), (5, "broken link")}


def test_bad_lines_are_set_aside(spark, write):
    lines = ['{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 2}}', "[1]", "nonsense", '{"a": NaN}', '{"a": 1}']
    good, bad = ledger.split_strict(ledger.read_lines(spark, write("bad", lines)))
    assert [r.raw for r in good.collect()] == ['{"a": 1}'] and bad.count() == 5


def test_canonical_form(spark):
    rows = ['{"b": 1.0, "a": "é\\u2028", "c": [1e10, 100000000000.0, true, null]}', "{", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "j string").select(D.canonical_json(F.col("j"))).collect()]
    assert got == ['{"a":"\\u00e9\\u2028","b":1.0,"c":[10000000000.0,100000000000.0,true,null]}', None, None]
    (r,) = spark.createDataFrame([("17", 3, 7)], "s string, c int, n int").select(D.draw(F.col("s"), F.col("c"), F.col("n").cast("long")).alias("d")).collect()
    assert r.d == int(hashlib.sha256(b"17:3").hexdigest(), 16) % 7


def test_a_text_is_read_once_for_all_its_forms():
    forms = [((), None), (("a",), None), ((), "b"), (("x",), "b"), ((), "none")]
    assert D.canonicals('{"b": {"y": 1.50, "x": "é"}, "a": 1}', forms) == [canonical({"a": 1, "b": {"y": 1.5, "x": "é"}}), '{"b":{"x":"\\u00e9","y":1.5}}', '{"x":"\\u00e9","y":1.5}', '{"y":1.5}', None]
    assert [D.canonicals(t, forms[:3]) for t in ('{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}', "\ufeff{}", "{} {}", None)] == [[None] * 3] * 6
    assert D.canonicals(" [1] ", forms[:3]) == ["[1]", None, None] and D.canonical("[1]", ("a",)) is None


def test_recovery(spark):
    rows = chain.build_chain(spark.createDataFrame([("L", i, f"b{i}") for i in range(5)], "ledger_id string, at int, body string"), ["at"], F.col("body"))
    d = {r.sequence: r.digest for r in rows.collect()}
    anchor = lambda n, x: spark.createDataFrame([("L", n, x)], "ledger_id string, event_count long, terminal_receipt_sigil string")
    status = lambda a: chain.recovery(rows, a).first()
    assert status(anchor(5, d[5])).status == "HEALTHY" and (status(anchor(4, d[4])).status, status(anchor(4, d[4])).tail) == ("RECOVERABLE", 1)
    assert status(anchor(6, d[5])).status == "REMOVED" and status(anchor(4, "x")).status == "REWRITTEN"
    assert status(chain.accept_tails(rows, anchor(4, d[4]))).status == "HEALTHY"
    assert chain.wrong_digests(rows, F.col("body")).count() == 0 and chain.broken_links(rows).count() == 0
    assert chain.wrong_digests(rows.withColumn("body", F.when(F.col("sequence") == 2, "x").otherwise(F.col("body"))), F.col("body")).count() == 1
    assert chain.unchanged(rows.select("body"), rows.select("body")).count() == 0


def events_of(spark, rows):
    return spark.createDataFrame([("L", i + 1, f"CE-{i + 1}", t, o, f"t{i}", json.dumps(p)) for i, (t, o, p) in enumerate(rows)], "ledger_id string, sequence long, event_id string, type string, object_id string, occurred_at string, payload string")


def events_with_actors(spark, rows):
    kind = {"review.approved": "human", "review.accepted": "human"}
    out = [("L", i + 1, f"CE-{i + 1}", t, o, f"t{i}", (p.pop("_actor", "ann"), p.pop("_kind", kind.get(t, "tool"))), json.dumps(p)) for i, (t, o, p) in enumerate((t, o, dict(p)) for t, o, p in rows)]
    return spark.createDataFrame(out, "ledger_id string, sequence long, event_id string, type string, object_id string, occurred_at string, actor struct<actor_id:string,actor_type:string>, payload string")


P, WAITS = {"program_id": "RP-1"}, "WAITING_FOR_DISCLOSURE_AUTHORIZATION"
EXP = P | {"protocol_id": "PT-1", "hypothesis_id": "HY-1", "question": "q", "working_id": "WK-1"}
RITE = {"schema_version": "rite/1.0", "stages": [{"name": "a"}, {"name": "b"}, {"name": "c"}]}
SPEC = {"pilot_run_ids": ["RUN-P", "RUN-Q"], "comparisons": [{"experiment_id": "EX-1", "arms": ["c", "t"]}]}
OPEN_REVIEW = {"type": "local_review", "destination": {"execution": "local", "provider": None}, "status": "PREPARED", "disclosure": {"includes_credentials": False}, "approval": {"required": False, "status": "NOT_REQUIRED", "approved_by": None, "approved_at": None, "rationale": None}}
FAR_REVIEW = {"type": "external_diff_review", "destination": {"execution": "external", "provider": "x"}, "status": WAITS, "disclosure": {"includes_credentials": False}, "approval": {"required": True, "status": WAITS, "approved_by": None, "approved_at": None, "rationale": None}}


_RUNS = ["RUN-1", "RUN-P", "RUN-Q"]
BUNDLE = P | {"schema_version": "result-bundle/1.0", "bundle_id": "RB-1", "protocol_id": "PT-1", "runs": [{"run_id": r} for r in _RUNS], "included_run_ids": _RUNS, "excluded_run_ids": [], "metrics": {"m": {"n": 3, "mean": 1.0, "sample_stddev": 0.0, "ci95_lower": 1.0, "ci95_upper": 1.0}}}


def accepted(task, capability, review):
    return ("agent-result.accepted", task, P | {"capability": {"id": capability, "contract_sigil": "k"}, "snapshot": {"snapshot_sigil": "s"}, "bindings": {"review_id": review}, "result": {"schema_version": "agent-result/1.1", "task_id": task, "snapshot_sigil": "s", "capability_contract_sigil": "k", "status": "COMPLETED"}})


def run_of(name, arm, phase="PILOT"):
    return ("run.recorded", name, EXP | {"experiment_id": "EX-1", "status": "COMPLETED", "phase": phase, "arm": arm, "metrics": {"m": 1.0}, "analysis_disposition": {"included": True}})


def study():
    """A sound study: every kind of event, in an order that breaks no rule."""
    bundle = BUNDLE
    decide = lambda i, outcome, **more: ("decision.sealed", i, P | {"outcome": outcome, "assessment_ids": ["AS-1"], "unresolved_issue_ids": [], "unresolved_uncertainties": ["l"]} | more)
    return [
        ("program.created", "RP-1", {"slug": "a", "title": "t", "problem": "x"}),
        ("evidence.recorded", "EV-1", P | {"source": {"uri": "u", "sigil": "s"}, "observation": "o"}),
        ("evidence.source_resolved", "EV-1", P), ("evidence.content_inspected", "EV-1", P),
        ("claim.created", "CL-1", P | {"type": "empirical", "statement": "s", "evidence_relations": [{"evidence_id": "EV-1", "relation": "SUPPORTS"}]}),
        ("claim.created", "CL-2", P | {"type": "empirical", "statement": "s"}),
        ("claim_relation.proposed", "CL-2", P | {"evidence_id": "EV-1", "relation": "LIMITS"}), ("claim_relation.verified", "CL-2", P | {"evidence_id": "EV-1"}),
        ("hypothesis.created", "HY-1", P | {"claim_ids": ["CL-1"], "statement": "s", "prediction": "p"}),
        ("hypothesis.created", "HY-2", P | {"claim_ids": ["CL-1"], "statement": "s", "prediction": "p"}),
        ("research_question.sealed", "RP-1", P | {"statement": "s"}),
        ("protocol.drafted", "PT-1", P | {"title": "t", "hypothesis_ids": ["HY-1"], "study_mode": "confirmatory", "analysis_spec": SPEC}),
        ("protocol.sealed", "PT-1", P),
        ("protocol.drafted", "PT-2", P | {"title": "t", "hypothesis_ids": ["HY-1"]}),
        ("working.created", "WK-1", P | {"protocol_id": "PT-1", "rite_id": "r", "rite": RITE, "rite_sigil": sealed(RITE)}),
        ("working.advanced", "WK-1", P | {"from_stage": "a", "to_stage": "b"}),
        ("experiment.planned", "EX-1", EXP), ("experiment.implemented", "EX-1", EXP), ("experiment.pilot_started", "EX-1", EXP), run_of("RUN-P", "c"), run_of("RUN-Q", "t"),
        ("experiment.pilot_completed", "EX-1", EXP), ("experiment.formal_started", "EX-1", EXP), run_of("RUN-1", "c", "FORMAL"),
        ("analysis.computed", "RB-1", {"bundle": bundle, "bundle_sigil": sealed(bundle)}),
        ("deviation.recorded", "DV-1", P | {"protocol_id": "PT-1", "kind": "PLANNED", "affected_object_ids": ["RUN-1"]}),
        ("assessment.recorded", "AS-1", P | {"protocol_id": "PT-1", "result_bundle_id": "RB-1", "study_mode": "confirmatory", "summary": "s", "limitations": ["l"], "claim_findings": [{"claim_id": "CL-1", "status": "SUPPORTED"}], "hypothesis_findings": [{"hypothesis_id": "HY-1", "status": "SUPPORTED"}]}),
        ("assessment.recorded", "AS-2", P | {"protocol_id": "PT-1", "result_bundle_id": "RB-1", "summary": "s", "limitations": ["l"], "claim_findings": [], "hypothesis_findings": []}),
        ("artifact.registered", "AR-1", P | {"kind": "table", "producer_id": "RB-1", "input_ids": ["RUN-1"]}),
        ("reproduction.assessed", "RR-1", P | {"evidence_id": "EV-1", "run_ids": ["RUN-1"], "result_bundle_id": "RB-1", "artifact_ids": ["AR-1"], "assessment_id": "AS-1", "status": "REPRODUCED"}),
        decide("DE-1", "CONTINUE"), decide("DE-2", "REPAIR", required_actions=["do"]), decide("DE-3", "PIVOT", lineage={"parent_program_id": "RP-1", "reason": "r"}), decide("DE-4", "STOP"), decide("DE-5", "INSUFFICIENT_EVIDENCE"), decide("DE-6", "REVIEW_REQUIRED", assessment_ids=["AS-1", "AS-2"]),
        ("issue.opened", "IS-1", P | {"subject_ids": ["RUN-1"], "severity": "CRITICAL", "title": "t", "description": "d"}),
        ("issue.opened", "IS-2", P | {"subject_ids": ["RUN-1"], "severity": "LOW", "title": "t", "description": "d"}), ("issue.resolved", "IS-2", P | {"resolution": "r"}),
        ("evidence.recorded", "EV-2", P | {"source": {"uri": "late", "sigil": "s"}, "observation": "o"}),
        ("review.requested", "RV-1", P | OPEN_REVIEW), accepted("TK-1", "x.review.local", "RV-1"), ("review.completed", "RV-1", P | {"task_id": "TK-1", "source": {"execution": "local", "provider": None}}), ("review.accepted", "RV-1", P),
        ("review.requested", "RV-2", P | FAR_REVIEW), ("review.approved", "RV-2", P | {"approved_by": "ann"}), accepted("TK-2", "x.review.external", "RV-2"), ("review.completed", "RV-2", P | {"task_id": "TK-2", "source": {"execution": "external", "provider": "x"}}),
    ]


def test_state_tables(spark):
    events = events_with_actors(spark, study()).repartition(3)
    t = state.tables(events)
    (program,) = t["programs"].collect()
    assert program.status == "EVALUATED" and program.children[0] == "EV-1" and program.question_sealed_at  # late evidence lowers nothing
    assert {r.id: (r.resolved, r.inspected) for r in t["evidence"].collect()} == {"EV-1": (True, True), "EV-2": (False, False)}
    assert {r.id: (r.current_status, r.deviations) for r in t["protocols"].collect()} == {"PT-1": ("FROZEN", ["DV-1"]), "PT-2": ("DRAFT", None)}
    (x,) = t["experiments"].collect()
    assert x.current_status == "FORMAL_RUNNING" and len(x.history) == 5
    assert {r.id: (r.status, [(x.evidence_id, x.relation, x.status) for x in r.relations]) for r in t["claims"].collect()} == {"CL-1": ("SUPPORTED", [("EV-1", "SUPPORTS", "PROPOSED")]), "CL-2": ("PROPOSED", [("EV-1", "LIMITS", "VERIFIED")])}
    assert {r.id: r.status for r in t["hypotheses"].collect()} == {"HY-1": "SUPPORTED", "HY-2": "PROPOSED"}
    assert {r.id: r.current_status for r in t["issues"].collect()} == {"IS-1": "OPEN", "IS-2": "RESOLVED"}
    assert {r.id: r.current_status for r in t["review_requests"].collect()} == {"RV-1": "ACCEPTED", "RV-2": "COMPLETED"}
    summary = state.status_summary(t, spark.createDataFrame([("L", 1, "x"), ("L", 2, "y")], "ledger_id string, sequence long, digest string")).first()
    assert summary.open_critical == ["IS-1"] and summary.last_digest == "y" and summary.stages == {"RP-1": "EVALUATED"}
    assert state.audit(events).collect() == []
    until = [r for r in study()[:17]]
    assert {r.id: r.status for r in state.tables(events_with_actors(spark, until))["hypotheses"].collect()} == {"HY-1": "ACTIVE", "HY-2": "PROPOSED"}


def test_every_rule_across_objects_has_its_breach(spark):
    """Each broken event stands alone at the end of the sound study."""
    other = {"program_id": "RP-2"}
    bad_pilot = EXP | {"protocol_id": "PT-3"}
    decide = lambda **more: ("decision.sealed", "DE-9", P | {"outcome": "STOP", "assessment_ids": ["AS-1"]} | more)
    cases = [
        ("unknown reference", [("hypothesis.created", "HY-9", P | {"claim_ids": ["CL-9"]})]),
        ("unknown reference", [("evidence.verified", "EV-9", P | {"verification": {}})]),
        ("unknown reference", [("assessment.recorded", "AS-9", P | {"protocol_id": "PT-1", "result_bundle_id": "RB-1", "claim_findings": [{"claim_id": "CL-9", "status": "x"}]})]),
        ("duplicate id", [("hypothesis.created", "HY-1", P | {"claim_ids": ["CL-1"]})]),
        ("duplicate slug", [("program.created", "RP-3", {"slug": "a"})]),
        ("repeated element", [("hypothesis.created", "HY-9", P | {"claim_ids": ["CL-1", "CL-1"]})]),
        ("reference to another program", [("program.created", "RP-2", {"slug": "b"}), ("hypothesis.created", "HY-9", other | {"claim_ids": ["CL-1"]})]),
        ("transition", [("experiment.pilot_started", "EX-1", EXP)]),
        ("transition", [("review.approved", "RV-2", P | {"approved_by": "ann"})]),
        ("other lineage", [("experiment.completed", "EX-1", EXP | {"working_id": "WK-2"})]),
        ("other lineage", [("issue.resolved", "IS-1", other)]),
        ("experiment of the old kind", [("experiment.created", "EX-8", EXP), ("experiment.implemented", "EX-8", EXP)]),
        ("inspected early or twice", [("evidence.content_inspected", "EV-2", P)]),
        ("flag lowered", [("evidence.verified", "EV-1", P | {"verification": {"source_resolved": True}})]),
        ("evidence not inspected", [("claim.created", "CL-9", P | {"evidence_relations": [{"evidence_id": "EV-2", "relation": "LIMITS"}]})]),
        ("relation proposed twice", [("claim_relation.proposed", "CL-1", P | {"evidence_id": "EV-1", "relation": "LIMITS"})]),
        ("relation not proposed", [("evidence.source_resolved", "EV-2", P), ("evidence.content_inspected", "EV-2", P), ("claim_relation.verified", "CL-1", P | {"evidence_id": "EV-2"})]),
        ("relation verified twice", [("claim_relation.verified", "CL-2", P | {"evidence_id": "EV-1"})]),
        ("question sealed twice", [("research_question.sealed", "RP-1", P)]),
        ("protocol not frozen", [("deviation.recorded", "DV-9", P | {"protocol_id": "PT-2", "affected_object_ids": []})]),
        ("protocol not frozen", [("working.created", "WK-9", P | {"protocol_id": "PT-2", "rite": RITE, "rite_sigil": sealed(RITE)})]),
        ("hypothesis not of the protocol", [("experiment.planned", "EX-9", EXP | {"hypothesis_id": "HY-2"})]),
        ("confirmatory without hypothesis", [("protocol.drafted", "PT-9", P | {"study_mode": "confirmatory"})]),
        ("confirmatory without finding", [("assessment.recorded", "AS-9", P | {"protocol_id": "PT-1", "result_bundle_id": "RB-1", "study_mode": "confirmatory"})]),
        ("included run not completed", [("run.recorded", "RUN-9", EXP | {"experiment_id": "EX-1", "status": "FAILED", "analysis_disposition": {"included": True}})]),
        ("bundle digest", [("analysis.computed", "RB-9", {"bundle": BUNDLE, "bundle_sigil": "sha256:0"})]),
        ("no registered pilot", [("protocol.drafted", "PT-3", P | {"hypothesis_ids": ["HY-1"]}), ("protocol.sealed", "PT-3", P), ("experiment.planned", "EX-9", bad_pilot), ("experiment.implemented", "EX-9", bad_pilot), ("experiment.pilot_started", "EX-9", bad_pilot), ("experiment.pilot_completed", "EX-9", bad_pilot)]),
        ("review outside its bounds", [("review.requested", "RV-9", P | FAR_REVIEW | {"disclosure": {"includes_credentials": True}})]),
        ("review outside its bounds", [("review.requested", "RV-9", P | OPEN_REVIEW | {"destination": {"execution": "local", "provider": "x"}})]),
        ("approval", [("review.requested", "RV-9", P | FAR_REVIEW), ("review.approved", "RV-9", P | {"approved_by": "bob"})]),
        ("accepted by no human", [("review.accepted", "RV-2", P | {"_kind": "tool"})]),
        ("no task result for the review", [("review.requested", "RV-9", P | OPEN_REVIEW), ("review.completed", "RV-9", P | {"task_id": "TK-1", "source": {"execution": "local", "provider": None}})]),
        ("other source", [("review.requested", "RV-9", P | OPEN_REVIEW), accepted("TK-9", "x.review.local", "RV-9"), ("review.completed", "RV-9", P | {"task_id": "TK-9", "source": {"execution": "external", "provider": "x"}})]),
        ("result pins", [("agent-result.accepted", "TK-9", P | {"capability": {"contract_sigil": "k"}, "snapshot": {"snapshot_sigil": "z"}, "result": {"schema_version": "agent-result/1.1", "task_id": "TK-9", "snapshot_sigil": "s", "capability_contract_sigil": "k"}})]),
        ("result of another task", [("agent-result.accepted", "TK-9", P | {"input_sigil": "i", "result": {"schema_version": "agent-result/1.0", "task_id": "TK-8", "input_sigil": "i"}})]),
        ("bundle: metrics", [("analysis.computed", "RB-9", {"bundle": BUNDLE | {"metrics": {"m": BUNDLE["metrics"]["m"] | {"mean": 1.5}}}})]),
        ("bundle: included runs", [("analysis.computed", "RB-9", {"bundle": BUNDLE | {"included_run_ids": ["RUN-P", "RUN-1", "RUN-Q"]}})]),
        ("bundle: all runs", [run_of("RUN-9", "c", "FORMAL"), ("analysis.computed", "RB-9", {"bundle": BUNDLE | {"included_run_ids": [*_RUNS[:1], "RUN-9", *_RUNS[1:]], "metrics": {"m": BUNDLE["metrics"]["m"] | {"n": 4}}}})]),
        ("definition digest", [("working.created", "WK-9", P | {"protocol_id": "PT-1", "rite": RITE, "rite_sigil": "sha256:0"})]),
        ("stage", [("working.advanced", "WK-1", P | {"from_stage": "a", "to_stage": "b"})]),
        ("CONTINUE with an open critical issue", [decide(outcome="CONTINUE")]),
        ("REPAIR without actions", [decide(outcome="REPAIR")]),
        ("PIVOT without its own parent", [decide(outcome="PIVOT", lineage={"parent_program_id": "RP-2"})]),
        ("REVIEW_REQUIRED without two assessments", [decide(outcome="REVIEW_REQUIRED")]),
        ("open issues differ", [decide(unresolved_issue_ids=[])]),
        ("uncertainties differ", [decide(unresolved_uncertainties=["x", "l"])]),
        ("closed before evaluation", [("program.created", "RP-3", {"slug": "c"}), ("program.closed", "RP-3", {}), ]),
        ("unknown type", [("something.else", "X", {})]),
    ]
    base, n = study(), len(study())
    frames = []
    for i, (_, more) in enumerate(cases):
        frames += [(f"{i}", *r[1:]) for r in events_with_actors(spark, base + more).collect()]
    events = spark.createDataFrame(frames, "ledger_id string, sequence long, event_id string, type string, object_id string, occurred_at string, actor struct<actor_id:string,actor_type:string>, payload string").repartition(4).cache()
    found = {}
    for r in state.audit(events).collect():
        assert r.sequence > n, r
        found.setdefault(int(r.ledger_id), set()).add(r.rule)
    extra = {"closed without decision"}
    for i, (rule, _) in enumerate(cases):
        assert rule in found.get(i, set()) and len(found[i] - {rule} - extra) == 0, (rule, found.get(i))


def test_rules_read_the_types_that_are_there(spark):
    """Rules and tables of types that no event has cost nothing, and an id is placed by one join, also where several collections have it."""
    rows = [
        ("program.created", "RP-1", {"slug": "a"}), ("program.created", "RP-2", {"slug": "b"}), ("evidence.recorded", "X-1", P), ("claim.created", "X-1", {"program_id": "RP-2"}),
        ("hypothesis.created", "HY-1", {"program_id": "RP-2", "claim_ids": ["X-1"]}), ("hypothesis.created", "HY-2", P | {"claim_ids": ["HY-1"]}), ("claim.created", "X-1", {"program_id": "RP-2"}), ("something.else", "X-2", {}), ("evidence.recorded", "X-3", {}),
    ]
    events = events_with_actors(spark, rows)
    found = {(r.sequence, r.rule) for r in state.audit(events).collect()}
    assert found == {(5, "reference to another program"), (6, "unknown reference"), (6, "reference to another program"), (7, "duplicate id"), (8, "unknown type")}
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    few = events_with_actors(spark, rows[:3])
    assert joins(state.audit(few)) <= 4 and joins(state.state_changes(few, few)) <= 10
    assert {(r.collection, r.n_before, r.n_after) for r in state.state_changes(few, events).collect()} == {("programs", 2, 2), ("evidence", 1, 2), ("claims", 0, 1), ("hypotheses", 0, 2)}
    assert state.audit(events.where("false")).count() == 0 and state.state_changes(events.where("false"), events.where("false")).count() == 0


def test_pilots_need_their_runs(spark):
    def with_runs(*runs):
        head = study()[:19]
        return head + list(runs) + [("experiment.pilot_completed", "EX-1", EXP)]

    for runs, want in (((run_of("RUN-P", "c"),), {"pilot run missing", "pilot arm missing"}), ((run_of("RUN-P", "c"), run_of("RUN-Q", "t", "FORMAL")), {"pilot run of another kind"}), ((run_of("RUN-P", "c"), run_of("RUN-Q", "c")), {"pilot arm missing"})):
        assert {r.rule for r in state.audit(events_with_actors(spark, with_runs(*runs))).collect()} == want


def test_gates(spark):
    d = lambda i, outcome, open_ids, told, actions=(), parent=None, n=1: ("L", 10, i, "RP-1", outcome, [f"AS-{k}" for k in range(n)], list(actions), parent, open_ids, told)
    rows = [d("ok", "STOP", ["IS-1"], ["l"]), d("go", "CONTINUE", ["IS-1"], ["l"]), d("fix", "REPAIR", ["IS-1"], ["l"]), d("turn", "PIVOT", ["IS-1"], ["l"], parent="RP-2"), d("ask", "REVIEW_REQUIRED", ["IS-1"], ["l"]), d("hid", "STOP", [], [])]
    schema = "ledger_id string, sequence long, decision_id string, program_id string, outcome string, assessment_ids array<string>, required_actions array<string>, parent_program_id string, unresolved_issue_ids array<string>, unresolved_uncertainties array<string>"
    issues = spark.createDataFrame([("L", "RP-1", "IS-1", "CRITICAL", 2, 20), ("L", "RP-1", "IS-2", "CRITICAL", 2, 5), ("L", "RP-1", "IS-3", "CRITICAL", 12, None)], "ledger_id string, program_id string, issue_id string, severity string, opened long, closed long")
    told = spark.createDataFrame([("L", "AS-0", "l")], "ledger_id string, assessment_id string, limitation string")
    got = {}
    for r in rules.decision_gates(spark.createDataFrame(rows, schema), issues, told).collect():
        got.setdefault(r.object_id, set()).add(r.rule)
    assert got == {"go": {"CONTINUE with an open critical issue"}, "fix": {"REPAIR without actions"}, "turn": {"PIVOT without its own parent"}, "ask": {"REVIEW_REQUIRED without two assessments"}, "hid": {"open issues differ", "uncertainties differ"}}


def test_jobs(spark):
    j = lambda n, t, job=None, key=None, st=None, request="r", rev=None: ("L", n, f"e{n}", t, "d", job, "T" if job else None, key, request, st, "because", rev)
    rows = [
        j(1, "executor.epoch-started"), j(2, "job.submitted", "a", "k1"), j(3, "job.queued", "a"), j(4, "job.cancellation_requested", "a", "c1", rev=2), j(5, "job.terminal", "a", st="CANCELLED"), j(6, "job.cancellation_observed", "a", "c2"),
        j(7, "job.submitted", "b", "k1", request="other"), j(8, "job.submitted", "b2", "k2"), j(9, "job.cancellation_requested", "b2", "c3", rev=7), j(10, "job.terminal", "b2", st="SUCCEEDED"), j(11, "job.queued", "zz"), j(12, "executor.epoch-started"),
    ]
    journal = spark.createDataFrame(rows, "ledger_id string, sequence long, event_id string, event_type string, event_digest string, job_id string, task_id string, key string, request string, state string, reason string, expected_revision long")
    assert {(r.sequence, r.rule) for r in jobs.broken_rules(journal).collect()} == {(7, "key conflict"), (9, "other revision"), (10, "cancelled job ended otherwise"), (11, "unknown job"), (12, "epoch")}
    assert {r.job_id: (r.state, r.revision) for r in jobs.states(journal).where("job_id in ('a', 'b')").collect()} == {"a": ("CANCELLED", 4), "b": ("SUBMITTED", 1)}
    assert {r.job_id for r in jobs.outcomes(journal, "outcome/1").collect()} == {"a", "b2"}
    assert [r.sequence for r in jobs.observed(journal, 2, 9, 3).collect()] == [3, 4, 5]
    want = "OJ-" + hashlib.sha256(canonical(["outcome/1", "a", "d"]).encode()).hexdigest().upper()
    assert jobs.outcomes(journal, "outcome/1").where("job_id = 'a'").first().outcome_id == want
    key = sealed(["execution-start-idempotency-key/1.0", "é1"])
    (r,) = spark.createDataFrame([("TK-1", "é1")], "t string, k string").select(jobs.job_id(F.col("t"), F.col("k")).alias("j")).collect()
    assert r.j == "JB-" + hashlib.sha256(canonical(["execution-job-id/1.0", "TK-1", key]).encode()).hexdigest().upper()


def test_workflow(spark):
    stages = spark.createDataFrame([("R", 0, "artifact.registered", "implementation", None, None), ("R", 1, "run.recorded", None, "PILOT", None)], "rite_id string, stage_no int, event_type string, kind string, phase string, status string")
    runs = spark.createDataFrame([("L", "W1", "R"), ("L", "W2", "R")], "ledger_id string, working_id string, rite_id string")
    rows = [("L", 1, "W1", "run.recorded", None, "PILOT", None), ("L", 2, "W1", "artifact.registered", "implementation", None, None), ("L", 3, "W1", "run.recorded", None, "FORMAL", None), ("L", 4, "W1", "run.recorded", None, "PILOT", None)]
    events = spark.createDataFrame(rows, "ledger_id string, sequence long, working_id string, type string, kind string, phase string, status string")
    got = {r.working_id: (r.left_at, r.status) for r in workflow.progress(events, runs, stages).collect()}
    assert got == {"W1": ([2, 4], "COMPLETED"), "W2": ([], "ACTIVE")}  # the early run isn't remembered


def test_lineage_and_trace(spark):
    links = spark.createDataFrame([("L", a, b, "k") for a, b in ("ab", "bc", "cd", "xd", "da")], "ledger_id string, src string, dst string, kind string")
    start = spark.createDataFrame([("L", "b")], "ledger_id string, id string")
    assert {(r.node, r.depth) for r in lineage.closure(links, start).collect()} == {("b", 0), ("c", 1), ("d", 2), ("a", 3)}
    parents = spark.createDataFrame([("L", i, i - 1 if i else None) for i in range(20)], "ledger_id string, id int, parent int")
    assert {r.root for r in lineage.roots(parents).collect()} == {0}
    rings = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 5), (7, 7), (8, 9), (10, None), (11, 10), (12, 11)]  # 9 isn't there
    loops = spark.createDataFrame([("L", a, b) for a, b in rings], "ledger_id string, id int, parent int")
    assert {r.id: r.root for r in lineage.roots(loops).collect()} == {1: None, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None, 8: 9, 10: 10, 11: 10, 12: 10}
    events = events_of(spark, [("t", "A", {"k": ["x", {"deep": {"er": "B"}}]}), ("t", "B", {"B": "key only"}), ("t", "C", {"n": 1})])
    ids = spark.createDataFrame([("L", "B"), ("L", "x"), ("L", "none")], "ledger_id string, id string")
    assert {(r.id, r.sequence) for r in lineage.trace(lineage.references(events), ids).collect()} == {("B", 1), ("B", 2), ("x", 1)}
    odd = events_of(spark, [("t", "A", {"k: x": 'say "x": \\', "": ["", None, 1, True, {"n": "é\n:"}]}), ("t", "B", {})])
    assert {(r.sequence, r.value) for r in lineage.references(odd).collect()} == {(1, "A"), (1, 'say "x": \\'), (1, ""), (1, "é\n:"), (2, "B")}
    bodies = spark.createDataFrame([("L", "P", "t", "2", '{"b": 1, "a": 2}'), ("L", "P", "t", "1", "{}"), ("L", "P", "s", "9", "{}")], "ledger_id string, program_id string, object_type string, object_id string, body string")
    assert [(r.object_type, r.object_id, r.digest) for r in lineage.inventory(bodies).collect()] == [("s", "9", sealed({})), ("t", "1", sealed({})), ("t", "2", sealed({"a": 2, "b": 1}))]
    assert [o.object_id for o in lineage.inventories(bodies).first().objects] == ["9", "1", "2"]
    heads = spark.createDataFrame([("L", "s1", "x"), ("L", "s2", "gone"), ("L", "s3", None)], "ledger_id string, snapshot_id string, head string")
    assert {r.snapshot_id for r in lineage.foreign_heads(heads, spark.createDataFrame([("L", "x"), ("L", "x")], "ledger_id string, digest string")).collect()} == {"s2", "s3"}
    inventory = lambda rows: spark.createDataFrame(rows, "ledger_id string, object_type string, object_id string, digest string")
    changed = lineage.freshness(inventory([("L", "t", "1", "a"), ("L", "t", "2", "a")]), inventory([("L", "t", "2", "b"), ("L", "t", "3", "a")]))
    assert {(r.object_id, r.change) for r in changed.collect()} == {("1", "REMOVED"), ("2", "CHANGED"), ("3", "ADDED")}


def test_lineage_and_trace_have_no_last_step(spark):
    links = spark.createDataFrame([("L", str(i), str(i + 1), "k") for i in range(66)], "ledger_id string, src string, dst string, kind string").coalesce(1)
    start = spark.createDataFrame([("L", "0")], "ledger_id string, id string").coalesce(1)
    assert {(r.node, r.depth) for r in lineage.closure(links, start).collect()} == {(str(i), i) for i in range(67)}
    payload = '{"a":' * 20 + "[" * 20 + '"deep"' + "]" * 20 + "}" * 20
    events = spark.createDataFrame([("L", 1, "own", payload)], "ledger_id string, sequence long, object_id string, payload string").coalesce(1)
    assert {r.value for r in lineage.references(events).collect()} == {"own", "deep"}


def test_contracts(spark):
    schema = "run_id string, experiment_id string, protocol_id string, status string, phase string, disposition struct<included:boolean,reason:string,policy_reference:string>, metrics map<string,double>"
    rows = [("ok", "E", "P", "COMPLETED", None, (True, None, "P#1"), {"m": 1.0}), ("bad", "E", "P", "FAILED", "X", (True, "why", "Q#1"), {}), ("nan", None, "P", "COMPLETED", "PILOT", (False, None, None), {"m": float("nan")})]
    found = {}
    for r in K.breaches(spark.createDataFrame(rows, schema), K.run_rules(), ["run_id"]).collect():
        found.setdefault(r.run_id, set()).add(r.rule)
    assert found == {"bad": {"phase: not one of its values", "included: not completed", "included: no metric", "included: has a reason", "policy: not of its protocol"}, "nan": {"experiment_id: missing", "metrics: not finite", "excluded: no reason"}}
    times = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("2024-13-01T00:00:00Z",), ("2024-01-01T00:00:00+02:00",)], "t string")
    assert {r.t for r in K.breaches(times, [K.timestamp("t")], ["t"]).collect()} == {"2024-01-01T00:00:00", "2024-13-01T00:00:00Z"}
    pinned = {"a": 1}
    records = spark.createDataFrame([(json.dumps(pinned | {"d": sealed(pinned)}),), (json.dumps({"a": 2, "d": sealed(pinned)}),)], "raw string")
    assert K.digest_pins(records, "raw", "d", ["raw"]).count() == 1
    assert K.breaches(records, [K.closed("raw", ["a"])], ["raw"]).count() == 2


def test_blobs_and_reads(spark, tmp_path):
    for name, text in (("a.bin", b"x"), ("b.bin", b"x"), ("c.bin", b"y")):
        (tmp_path / name).write_bytes(text)
    blobs = ledger.read_blobs(spark, str(tmp_path))
    assert sorted(r.copies for r in ledger.distinct_blobs(blobs).collect()) == [1, 2]
    t = spark.createDataFrame([("L", f"x{i}", "Ring" if i % 2 else "bolt") for i in range(10)], "ledger_id string, id string, name string")
    every = reads.objects({"first": (t, "id"), "second": (t.where("id > 'x5'"), "id")})
    assert {(r.collection, r.n) for r in reads.by_collection(every).collect()} == {("first", 10), ("second", 4)}
    assert reads.look_up(every, spark.createDataFrame([("L", "x7")], "ledger_id string, object_id string")).first().collection == "first"
    assert [r.id for r in reads.page(t, "id", 2, after="x3").collect()] == ["x4", "x5"] and reads.search(t, ["name"], "RING").count() == 5
    report = reads.health(t, {"a": spark.createDataFrame([("L", "r")], "ledger_id string, rule string"), "b": spark.createDataFrame([], "ledger_id string, rule string")})
    assert {(r.check, r.n, r.result) for r in report.collect()} == {("a", 1, "FAIL"), ("b", 0, "PASS"), ("all", 1, "FAIL")}


def old_lines(n):
    out, previous = [], None
    for i in range(1, n + 1):
        at = f"2024-01-01T00:00:{i:02d}+00:00"
        event = {"schema_version": "y", "event_id": f"CE-{i}", "type": "program.created", "object_id": f"RP-{i}", "occurred_at": at, "previous_sigil": previous, "payload": {"slug": f"s{i}", "é": [i]}}
        seal = sealed(event)
        out.append(event | {"receipt": {"receipt_id": f"RC-{i}", "event_id": f"CE-{i}", "sigil": seal, "previous_sigil": previous, "accepted_at": at}})
        previous = seal
    return out


def test_old_ledgers_are_checked_and_converted(spark):
    bad = old_lines(3)
    bad[1]["payload"]["x"] = 1
    more = [x | {"more": 1} for x in old_lines(1)]
    lines = [(name, i + 1, json.dumps(x)) for name, rows in (("good", old_lines(4)), ("bad", bad), ("more", more)) for i, x in enumerate(rows)]
    old = ledger.parse_old(spark.createDataFrame(lines, "ledger_id string, line int, raw string").repartition(3))
    found = {(r.ledger_id, r.sequence, r.rule) for r in chain.audit_old(old).collect()}
    assert found == {("bad", 2, "digest"), ("more", 1, "unknown or missing field"), ("more", 1, "digest")}
    actor = {"actor_id": "m", "actor_type": "tool", "host": "h", "authenticated_by": "s"}
    new = ledger.parse(chain.convert_old(old, json.dumps(actor)).select("ledger_id", "raw"))
    rows = new.orderBy("sequence").collect()
    assert [r.event_id for r in rows] == ["CE-1", "CE-2", "CE-3", "CE-4"] and {r.ledger_id for r in rows} == {"good"} and chain.audit_events(new).count() == 0
    before, previous = old_lines(4), None
    for r, x in zip(rows, before, strict=True):
        event = {"schema_version": "chronicle-event/1.1", "event_id": x["event_id"], "sequence": r.sequence, "type": x["type"], "object_id": x["object_id"], "occurred_at": x["occurred_at"], "previous_receipt_sigil": previous, "actor": actor, "payload": x["payload"]}
        receipt = {"schema_version": "receipt/1.1", "receipt_id": x["receipt"]["receipt_id"], "event_id": x["event_id"], "event_body_sigil": sealed(event), "previous_receipt_sigil": previous, "accepted_at": x["occurred_at"]}
        assert r.event_body_sigil == sealed(event) and r.receipt.receipt_sigil == sealed(receipt)
        previous = sealed(receipt)
    done = conversion.converted(old, json.dumps(actor))
    assert {r.ledger_id for r in done["refused"].collect()} == {"bad", "more"} and done["unsound"].count() == 0 and done["lines"].count() == 4
    assert conversion.state_proof(old, done["lines"]).count() == 0  # all tables, not of programs alone
    other = old.withColumn("object_id", F.when((F.col("ledger_id") == "good") & (F.col("sequence") == 2), "RP-9").otherwise(F.col("object_id")))
    assert {(r.ledger_id, r.collection) for r in conversion.state_proof(other, done["lines"]).collect()} == {("good", "programs")}


def test_a_written_ledger_reads_back(spark, tmp_path):
    events = spark.createDataFrame([(name, i, f"CE-{i}", "t", "o", "2024-01-01T00:00:00Z", "{}", '{"k": 1}', f"RC-{i}") for name in ("a", "b") for i in range(5)], "ledger_id string, n int, event_id string, type string, object_id string, occurred_at string, actor string, payload string, receipt_id string")
    ledger.write_ledger(chain.seal_events(events, ["n"]), str(tmp_path / "out"))
    for name in ("a", "b"):
        back = ledger.parse(ledger.read_lines(spark, str(tmp_path / "out" / f"ledger_id={name}")).withColumn("ledger_id", F.lit(name)))
        assert back.count() == 5 and chain.audit_events(back).count() == 0


def test_events_find_their_workflow_run(spark):
    def compared(*experiments):
        return {"bundle": P | {"protocol_id": "PT-1", "comparisons": [{"experiment_id": e} for e in experiments]}}

    exp = lambda w, **more: P | {"protocol_id": "PT-1", "hypothesis_id": None, "question": "q", "working_id": w} | more
    assess = lambda i, b: ("assessment.recorded", i, P | {"protocol_id": "PT-1", "result_bundle_id": b})
    rows = [
        ("program.created", "RP-1", {"slug": "a"}), ("protocol.drafted", "PT-1", P), ("protocol.drafted", "PT-2", P),
        ("working.created", "WK-1", P | {"protocol_id": "PT-1"}), ("working.created", "WK-2", P | {"protocol_id": "PT-1"}), ("working.created", "WK-3", P | {"protocol_id": "PT-2"}),
        ("experiment.planned", "EX-1", exp("WK-1")), ("experiment.planned", "EX-2", exp("WK-2")), ("experiment.planned", "EX-3", exp(None)), ("experiment.planned", "EX-4", exp("WK-3")),
        ("artifact.registered", "AR-1", P | {"kind": "implementation", "producer_id": "WK-1", "input_ids": []}),  # 11
        ("artifact.registered", "AR-2", P | {"kind": "plot", "producer_id": "EX-2", "input_ids": []}),
        ("artifact.registered", "AR-3", P | {"kind": "plot", "producer_id": "AR-1", "input_ids": []}),  # made by an artifact: no run
        ("run.recorded", "RUN-1", exp(None, experiment_id="EX-1", phase="PILOT", status="COMPLETED")),
        ("run.recorded", "RUN-2", exp(None, experiment_id="EX-3")),
        ("run.recorded", "RUN-3", exp(None, experiment_id="EX-4")),  # the run's protocol is another
        ("experiment.pilot_completed", "EX-1", exp("WK-1")),  # 17
        ("analysis.computed", "RB-1", compared("EX-1")), ("analysis.computed", "RB-2", compared("EX-1", "EX-2")), ("analysis.computed", "RB-3", compared("EX-1", "EX-3")), ("analysis.computed", "RB-4", compared()),
        assess("AS-1", "RB-1"), assess("AS-2", "RB-2"),  # 22, 23
        ("decision.sealed", "DE-1", P | {"assessment_ids": ["AS-1"]}), ("decision.sealed", "DE-2", P | {"assessment_ids": ["AS-1", "AS-2"]}), ("decision.sealed", "DE-3", P | {"assessment_ids": ["AS-1", "AS-9"]}),
    ]
    got = {r.sequence: (r.working_id, r.kind, r.phase, r.status) for r in workflow.runs_of_events(events_of(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {11: "WK-1", 12: "WK-2", 14: "WK-1", 17: "WK-1", 18: "WK-1", 22: "WK-1", 24: "WK-1"}
    assert got[11][1] == "implementation" and got[14][2:] == ("PILOT", "COMPLETED")
    definitions = spark.createDataFrame([("R", [("A", ("artifact.registered", "artifact", "implementation", None, None)), ("B", None)])], "rite_id string, stages array<struct<name:string,exit_contract:struct<event_type:string,object_type:string,kind:string,phase:string,status:string>>>")
    assert [tuple(r) for r in workflow.stage_rules(definitions).collect()] == [("R", 0, "artifact.registered", "implementation", None, None)]
    runs = spark.createDataFrame([("L", w, "R") for w in ("WK-1", "WK-2")], "ledger_id string, working_id string, rite_id string")
    left = {r.working_id: (r.left_at, r.status) for r in workflow.progress(workflow.runs_of_events(events_of(spark, rows)), runs, workflow.stage_rules(definitions)).collect()}
    assert left == {"WK-1": ([11], "COMPLETED"), "WK-2": ([], "ACTIVE")}


def test_each_event_finds_its_run_by_itself(spark):
    own = lambda p: P | {"protocol_id": p}
    art = lambda i, by: ("artifact.registered", i, P | {"kind": "plot", "producer_id": by, "input_ids": []})
    rows = [
        ("working.created", "WK-1", own("PT-1")), ("working.created", "WK-2", own("PT-2")), ("experiment.planned", "EX-1", own("PT-1") | {"working_id": "WK-2"}), ("experiment.planned", "EX-2", own("PT-1") | {"working_id": "WK-2"}),
        ("run.recorded", "EX-1", own("PT-2")), art("AR-1", "WK-1"), art("AR-2", "WK-2"), art("AR-3", "EX-1"), art("AR-4", "EX-2"),
    ]
    events = events_of(spark, rows).withColumn("sequence", F.when(F.col("object_id") == "AR-2", F.lit(6)).otherwise(F.col("sequence")).cast("long"))  # two events of one number
    got = sorted((r.sequence, r.working_id) for r in workflow.runs_of_events(events).collect())
    assert got == [(6, "WK-1"), (6, "WK-2"), (8, "WK-2")]  # AR-3: the end of its chain has the run's protocol under another record


def test_next_actions(spark):
    rows = study()
    moments = {"RP-1": "resolve critical issues: IS-1", "RP-9": "select an existing program", None: "create or select a program"}
    selected = spark.createDataFrame([("L", p) for p in moments], "ledger_id string, program_id string")
    now = lambda rows: {r.program_id: r.next_action for r in workflow.next_actions(workflow.program_counts(events_with_actors(spark, rows), selected)).collect()}
    assert now(rows) == moments
    for n, want in ((1, "record evidence"), (8, "seal the question"), (11, "draft a protocol"), (12, "seal the protocol"), (13, "start an experiment"), (24, "seal the protocol")):
        assert now(rows[:n])["RP-1"] == want
    alone = [r for r in rows if r[1] != "PT-2" and not r[1].startswith("IS-")]
    cut = [i for i, r in enumerate(alone) if r[0] in ("analysis.computed", "assessment.recorded", "decision.sealed")]
    for n, want in ((cut[0], "record runs and analyse"), (cut[1], "assess the result"), (cut[3], "decide"), (len(alone), "continue from open issues and the last decision")):
        assert now(alone[:n])["RP-1"] == want


def test_more_reads(spark):
    every = spark.createDataFrame([("L", "P", "runs", "R2"), ("L", "P", "runs", "R1"), ("L", "P", "programs", "P")], "ledger_id string, program_id string, collection string, object_id string")
    assert {(r.collection, tuple(r.ids)) for r in reads.of_programs(every).collect()} == {("runs", ("R1", "R2")), ("programs", ("P",))}
    t = state.tables(events_with_actors(spark, study()))
    both = {r.id: (r.request.type, r.artifact and r.artifact.task_id) for r in reads.reviews(t["review_requests"], t["review_artifacts"]).collect()}
    assert both == {"RV-1": ("local_review", "TK-1"), "RV-2": ("external_diff_review", "TK-2")}
    events = spark.createDataFrame([("L", 1, "CE-1", "RC-1", "d1"), ("L", 2, "CE-2", "RC-2", "d2")], "ledger_id string, sequence long, event_id string, receipt_id string, digest string")
    objects = spark.createDataFrame([("L", 1, "X", '{"b":1}'), ("L", 0, "X", '{"a":1}'), ("L", 0, "CE-1", "{}")], "ledger_id string, rank int, object_id string, body string")
    ids = spark.createDataFrame([("L", i) for i in ("RC-2", "CE-1", "X", "none")], "ledger_id string, id string")
    assert {r.id: (r.source, r.digest) for r in reads.digest_of(ids, events, objects).collect()} == {"RC-2": ("receipt", "d2"), "CE-1": ("receipt", "d1"), "X": ("object", sealed({"a": 1})), "none": (None, None)}
    assert [r.ordinal_id for r in reads.ordinal_ids(events, "RB-", ["sequence"]).orderBy("sequence").collect()] == ["RB-001", "RB-002"]
    bundle = lambda *rows: spark.createDataFrame([("L", *r) for r in rows], "ledger_id string, id string, digest string")
    exports = reads.exports_audit(bundle(("a", "1"), ("b", "1"), ("c", "1")), bundle(("a", "1"), ("b", "2"), ("d", "1")), ["ledger_id", "id"])
    assert {(r.id, r.result) for r in exports.collect()} == {("a", "OK"), ("b", "MISMATCH"), ("c", "MISSING"), ("d", "EXTRA")}
    outputs = spark.createDataFrame([("L", "TK-1", "a", "1"), ("L", "TK-1", "b", "1"), ("L", "TK-1", "c", "1"), ("L", "TK-1", "d", "1")], "ledger_id string, task_id string, path string, digest string")
    files = spark.createDataFrame([("a", "1", '{"task_id":"TK-1"}'), ("b", "2", '{"task_id":"TK-1"}'), ("d", "1", '{"task_id":"TK-2"}')], "path string, digest string, content string")
    audit = reads.outputs_audit(outputs, files)
    assert {(r.path, r.result) for r in audit.collect()} == {("a", "OK"), ("b", "MISMATCH"), ("c", "MISSING"), ("d", "OTHER TASK")}
    none = spark.createDataFrame([], "ledger_id string, rule string")
    report = reads.health(events.select("ledger_id"), reads.data_checks(none, none, none, none, audit, reads.content_audit(outputs.select("ledger_id", "path", "digest").where("path = 'a'"), files), exports))
    assert {(r.check, r.n, r.result) for r in report.collect()} == {("chain", 0, "PASS"), ("state", 0, "PASS"), ("snapshots", 0, "PASS"), ("capsules", 0, "PASS"), ("outputs", 3, "FAIL"), ("artifacts", 0, "PASS"), ("exports", 3, "FAIL"), ("all", 6, "FAIL")}


def test_verdicts_name_the_first_reason(spark):
    schema = "ledger_id string, task_id string, host string, capability_id string, contract_version string, contract_digest string, expected_outputs array<string>, tools array<string>, network boolean, seconds long, digest string, digest_ok boolean"
    row = lambda t, host="h", ok=True: ("L", t, host, "c", "1", "k", ["o"], [], False, 5, "d", ok)
    contracts = spark.createDataFrame([("c", "1", "k", ["o"], [], False, 9, False)], "capability_id string, version string, digest string, outputs array<string>, allowed_tools array<string>, allows_network boolean, max_seconds long, needs_approval boolean")
    capsules = spark.createDataFrame([row("TK-1"), row("tk-1", ok=False), row("TK-2", host="x"), row("TK-3", ok=False)], schema)
    got = {r.task_id: (r.verdict, r.reason) for r in rules.verdicts(capsules, contracts, capsules.where("false"), hosts=["h"]).collect()}
    assert got == {"TK-1": ("PASS", None), "tk-1": ("REJECTED", "identifiers"), "TK-2": ("REJECTED", "identifiers"), "TK-3": ("REJECTED", "digest")}


def test_acceptance_of_results(spark):
    out = "array<struct<schema:string,path:string,digest:string>>"
    cases = {
        "TK-OK": ("k", "COMPLETED", [("a", "p", "1")]), "TK-TWO": ("k", "COMPLETED", [("a", "p", "1"), ("a", "./p/../p", "1")]), "TK-NONE": ("k", "COMPLETED", []), "TK-OTHER": ("z", "COMPLETED", [("a", "p", "2")]), "TK-GONE": ("k", "COMPLETED", [("a", "q", "1")]),
        "TK-WHO": ("k", "COMPLETED", [("a", "p", "1")]), "TK-FAILED": ("k", "FAILED", [("b", "p", "1")]), "TK-IDLE": ("k", "FAILED", []), "TK-OUT": ("k", "FAILED", [("a", "/p", "1"), ("a", "x/../../p", "1")]),
    }
    results = spark.createDataFrame([("L", i, t, "s", c, st, o) for i, (t, (c, st, o)) in enumerate(cases.items())], f"ledger_id string, sequence int, task_id string, snapshot string, contract_digest string, status string, outputs {out}")
    capsules = spark.createDataFrame([("L", t, "s", "k", ["a", "c"]) for t in cases if t != "TK-WHO"], "ledger_id string, task_id string, snapshot string, contract_digest string, expected_outputs array<string>")
    passed = capsules.select("ledger_id", "task_id", F.lit("PASS").alias("verdict"))
    fresh = spark.createDataFrame([("L", "s", True)], "ledger_id string, snapshot string, fresh boolean")
    files = spark.createDataFrame([("p", "1"), ("./p/../p", "1"), ("/p", "1"), ("x/../../p", "1")], "path string, digest string")
    told = lambda rows: {(r.object_id, r.rule) for r in rows.collect()}
    want = {("TK-NONE", "no outputs"), ("TK-OTHER", "other contract"), ("TK-OTHER", "output differs"), ("TK-GONE", "output missing"), ("TK-FAILED", "unexpected output"), ("TK-OUT", "absolute path"), ("TK-OUT", "path leaves the project")}
    want |= {("TK-WHO", x) for x in ("unknown task", "other snapshot", "other contract", "policy", "unexpected output")}
    assert told(acceptance.acceptance(results, capsules, passed, fresh, files)) == want


def test_acceptance_of_what_reviews_and_files_say(spark):
    shape = "ledger_id string, task_id string, snapshot string, contract_digest string, expected_outputs array<string>, host string, program_id string, snapshot_program string, capability_id string, current_contract string, review_id string"
    tasks = {
        "TK-A": ("a", "b.review.local", "RV-1", "h"), "TK-B": ("a", "b.review.external", "RV-2", "h"), "TK-C": ("a", "b.review.accept", "RV-1", "h"), "TK-D": ("a", "b.review.local", None, "h"), "TK-E": ("a", "b.review.local", "RV-9", "h"),
        "TK-F": ("a", "b.review.local", "RV-2", "h"), "TK-G": ("evidence-verification-result/1.0", "b.verify", None, "other"), "TK-H": ("evidence-verification-result/1.0", "b.verify", None, None),
    }
    capsules = spark.createDataFrame([("L", t, "s", "k", [x[0]], "h", "RP-1", "RP-2" if t == "TK-H" else "RP-1", x[1], "k2" if t == "TK-G" else "k", x[2]) for t, x in tasks.items()], shape)
    results = spark.createDataFrame([("L", 10 + i, t, "s", "k", "COMPLETED", [(x[0], t, "1")], x[3]) for i, (t, x) in enumerate(tasks.items())], "ledger_id string, sequence int, task_id string, snapshot string, contract_digest string, status string, outputs array<struct<schema:string,path:string,digest:string>>, provenance_host string")
    document = lambda t, **data: json.dumps({"schema_version": tasks[t][0], "task_id": t, "data": data})
    good = {"evidence_id": "EV-1", "source_resolved": True, "content_inspected": False, "verification_notes": "n", "limitations": []}
    content = {t: document(t, review_id=x[2]) for t, x in tasks.items()} | {"TK-G": document("TK-G", **good), "TK-H": document("TK-H", **good | {"evidence_id": "CL-1"}), "TK-C": document("TK-A", review_id="RV-2"), "TK-E": "[1]", "TK-F": "{no json"}
    files = spark.createDataFrame([(t, "1", c) for t, c in content.items()], "path string, digest string, content string")
    reviews = spark.createDataFrame(
        [("L", "RV-1", "local_review", 1, "PREPARED"), ("L", "RV-1", "local_review", 11, "COMPLETED"), ("L", "RV-2", "external_diff_review", 2, "WAITS"), ("L", "RV-2", "external_diff_review", 11, "APPROVED"), ("L", "RV-9", "local_review", 99, "PREPARED")],
        "ledger_id string, review_id string, kind string, sequence int, state string",
    )
    passed = capsules.select("ledger_id", "task_id", F.lit("PASS").alias("verdict"))
    fresh = spark.createDataFrame([("L", "s", True)], "ledger_id string, snapshot string, fresh boolean")
    got = {(r.object_id, r.rule) for r in acceptance.acceptance(results, capsules, passed, fresh, files, reviews).collect()}
    # TK-B at 11: its approval is at 11, so it doesn't stand before it; TK-C at 12 sees the completion
    assert got == {
        ("TK-B", "review not ready"), ("TK-C", "output of another task"), ("TK-C", "output of another review"), ("TK-D", "no review bound"), ("TK-E", "unknown review"), ("TK-E", "output no object"), ("TK-F", "review not ready"), ("TK-F", "output no object"),
        ("TK-G", "other host"), ("TK-G", "contract changed"), ("TK-H", "other program"), ("TK-H", "output contract"),
    }


def test_documents_are_read_before_they_meet_outputs(spark):
    outs = spark.createDataFrame([("L", 1, "TK-1", None, None, i, "s", "p", "2") for i in range(3)], "ledger_id string, sequence int, task_id string, review_id string, capability_id string, place int, schema string, path string, digest string")
    files = spark.createDataFrame([("p", "1", '{"schema_version":"s","task_id":"TK-2"}')], "path string, digest string, content string")
    out = acceptance.contents(outs, files)
    assert sorted(r.rule for r in out.collect()) == ["output differs", "output of another task"]  # of three outputs
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("json(content#") <= 2, plan  # for the rules, and for data of a known shape


def test_patterns_hold_to_the_end(spark):
    rows = spark.createDataFrame([("a-b", "2024-01-01T00:00:00Z", "RP-1", "sha256:" + "0" * 64), ("a-b\n", "2024-01-01T00:00:00Z\n", "RP-1\n", "sha256:" + "0" * 64 + "\n")], "slug string, at string, id string, sigil string")
    broken = [(r.slug, r.rule) for r in K.breaches(rows, [K.pattern("slug", K.SLUG), K.timestamp("at"), K.identifier("id", "RP-"), K.pattern("sigil", K.DIGEST)], ["slug"]).collect()]
    assert sorted(broken) == [("a-b\n", x) for x in ("at: not a time with zone", "id: no identifier", "sigil: pattern", "slug: pattern")]


def test_record_contracts(spark):
    def broken(change):
        rows = [(t, o, p | change.get(o, {})) for t, o, p in study()]
        return {(r.id, r.rule) for r in K.every_breach(state.tables(events_with_actors(spark, rows))).collect()}

    whole = {
        "RP-1": {"problem": "x"}, "EV-1": {"source": {"uri": "u", "sigil": "sha256:" + "0" * 64}}, "EV-2": {"source": {"uri": "u", "sigil": "sha256:" + "0" * 64}}, "PT-1": {"analysis_plan": "p", "study_mode": "confirmatory"}, "PT-2": {"analysis_plan": "p"}, "WK-1": {"rite_id": "r@1"},
        "DV-1": {"impact": "MINOR", "summary": "s", "rationale": "r"}, "AR-1": {"location": {"uri": "u", "sigil": "sha256:" + "0" * 64}}, "RV-1": {"target": {"repository": "r"}, "scope": {"checks": ["c"]}, "reviewer": "x"}, "RV-2": {"target": {"repository": "r"}, "scope": {"checks": ["c"]}},
    } | {f"DE-{i}": {"rationale": "r"} for i in range(1, 7)}
    fine = {x for x in broken(whole) if x[1] not in ("result: no recommendation", "capsule_sigil: pattern")}
    assert fine == set()
    for field, values, rule, own in (("severity", K.SEVERITIES, "severity: not one of its values", "IS-1"), ("outcome", K.OUTCOMES, "outcome: not one of its values", "DE-4"), ("impact", K.IMPACTS, "impact: not one of its values", "DV-1"), ("type", K.CLAIM_TYPES, "type: not one of its values", "CL-1"), ("status", K.REPRODUCTIONS, "status: not one of its values", "RR-1")):
        assert (own, rule) in broken(whole | {own: whole.get(own, {}) | {field: values[-1] + "X"}})
    bad = broken(whole | {"RP-1": {"slug": "Not a slug", "problem": "x"}, "EV-2": {"source": {"uri": "", "sigil": "s"}}, "AS-1": {"claim_findings": [{"claim_id": "CL-1", "status": "PROPOSED"}]}, "AR-1": {"location": {"uri": "u", "sigil": "x"}}})
    assert {("RP-1", "slug: pattern"), ("EV-2", "source: no reference to content"), ("AS-1", "claim_findings.status: not one of its values"), ("AR-1", "location: digest")} <= bad
    ids = spark.createDataFrame([("RP-A_1",), ("rp-1",), ("RP-",), ("XX-1",)], "id string")
    assert {r.id for r in K.breaches(ids, [K.identifier("id", "RP-")], ["id"]).collect()} == {"rp-1", "RP-", "XX-1"}
    entry = spark.createDataFrame([("a", True, None, []), ("b", True, " ", [("", "x")]), ("c", False, None, [("u", "sha256:" + "0" * 64)])], "run_id string, needs_arm boolean, arm string, artifacts array<struct<uri:string,sigil:string>>")
    assert {(r.run_id, r.rule) for r in K.breaches(entry, K.run_entry_rules(), ["run_id"]).collect()} == {("a", "arm: missing"), ("b", "arm: too short"), ("b", "artifacts: no reference to content")}
    spec = spark.createDataFrame([("L", "P", "c"), ("L", "P", "c"), ("L", "P", "d")], "ledger_id string, protocol_id string, comparison_id string")
    assert [r.comparison_id for r in K.repeated_comparisons(spec).collect()] == ["c"]


def test_output_contracts(spark):
    ok = {"queries": ["q"], "sources": [{"uri": "u", "title": "t"}], "screened_count": 3, "candidate_evidence": [], "unresolved_queries": [], "limitations": []}
    rows = [(1, "evidence_discovery", ok), (2, "evidence_discovery", ok | {"queries": [], "x": 1, "screened_count": -1, "sources": [{"uri": ""}]}), (3, "nope", {}), (4, "code_inspection", [1]), (5, "code_inspection", {"inspected_files": ["a", 1], "findings": ["a", ""], "tests_considered": []}), (6, "experiment_execution", {"experiment_id": "EX-1", "commands": ["c"], "run_ids": ["RUN-1", "RUN-1"], "status": "LOST", "failures": []})]
    got = {(r.k, r.field, r.rule) for r in K.output_breaches(spark.createDataFrame([(k, s, json.dumps(d)) for k, s, d in rows], "k int, shape string, data string"), ["k"]).collect()}
    assert got == {(2, "queries", "wrong value"), (2, "screened_count", "wrong value"), (2, "sources.title", "missing"), (2, "sources.uri", "wrong value"), (2, "x", "unknown field"), (3, "", "not an object of a known shape"), (4, "", "not an object of a known shape"), (5, "findings", "wrong value"), (5, "inspected_files", "wrong value"), (5, "residual_risks", "missing"), (6, "run_ids", "wrong value"), (6, "status", "wrong value")}


def test_output_contracts_meet_in_no_join(spark):
    objects = {"experiment_proposal": {"a": 1}, "run_matrix": [{"a": 1}, {}], "controls": ["c"], "failure_criteria": ["f", None], "risks": []}
    found = {"queries": ["q"], "sources": [{"uri": "u", "title": "t"}, {"uri": "u", "other": 1}, None], "screened_count": 1.5, "candidate_evidence": "x", "unresolved_queries": [], "limitations": []}
    rows = [(1, "experiment_plan", json.dumps(objects)), (1, "experiment_plan", json.dumps(objects)), (2, "evidence_discovery", json.dumps(found)), (3, "source", "no JSON"), (4, "source", None), (5, None, "{}"), (6, "artifact", '{"uri":"u","sigil":"sha256:0"}')]
    out = K.output_breaches(spark.createDataFrame(rows, "k int, shape string, data string"), ["k"])
    none = "not an object of a known shape"
    assert sorted(tuple(r) for r in out.collect()) == sorted([
        (1, "failure_criteria", "wrong value"), (1, "run_matrix", "wrong value"), (2, "candidate_evidence", "wrong value"), (2, "screened_count", "wrong value"), (2, "sources.", none), (2, "sources.other", "unknown field"), (2, "sources.title", "missing"), (3, "", none), (4, "", none), (5, "", none), (6, "sigil", "wrong value"),
    ])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Union" not in plan  # an output's fields were sent to the driver to be joined with it


def test_roots_of_long_chains_take_few_rounds(spark):
    n = 3000
    rows = [(w, f"{i:05d}", f"{i - 1:05d}" if i else None) for w in "AB" for i in range(n)]
    rows += [("A", f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [("A", "x1", "r3"), ("B", "x1", "x2"), ("B", "x2", "gone"), ("B", "x3", "02999")]
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {(r.ledger_id, r.id): r.root for r in lineage.roots(spark.createDataFrame(rows, "ledger_id string, id string, parent string")).collect()}
    jobs = len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before)
    assert len(got) == len(rows) and {got[w, f"{i:05d}"] for w in "AB" for i in range(n)} == {"00000"}
    assert {got["A", f"r{i}"] for i in range(40)} == {None} and got["A", "x1"] is None
    assert got["B", "x1"] == got["B", "x2"] == "gone" and got["B", "x3"] == "00000"
    assert jobs < 45  # a chain of 3000 took 12 rounds
