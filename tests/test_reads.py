"""Readers and writers there and back, pages, observation of jobs, reviews, edges, the trace index, state proofs."""

import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_ledger import P, events_with_actors, sealed, study

from tallyfold.operators import compare, jobs, lineage, ordered, reads, rules, state, trace_index, workflow
from tallyfold.sources import ledger


def journal_lines(events):
    out, previous = [], None
    for i, (kind, payload) in enumerate(events):
        e = {"schema_version": "x", "journal_id": "J", "event_id": f"JE-{i + 1}", "sequence": i + 1, "event_type": kind, "recorded_at": "t", "previous_event_sigil": previous, "payload": payload}
        previous = sealed(e)
        out.append(json.dumps(e | {"event_sigil": previous}))
    return out


JOURNAL = [
    ("executor.epoch-started", {"executor_instance_id": "X", "executor_epoch": 1, "executor_build_sigil": "b"}),
    ("job.submitted", {"job_id": "JB-1", "task_id": "TK-1", "idempotency_key_sigil": "k1", "start_request_sigil": "r1", "job_binding_sigil": "jb", "specification": {"specification_id": "s", "specification_sigil": "sd"}}),
    ("job.queued", {"job_id": "JB-1"}), ("job.submitted", {"job_id": "JB-2", "task_id": "TK-2", "idempotency_key_sigil": "k1", "start_request_sigil": "r2"}),
    ("job.cancellation_requested", {"job_id": "JB-1", "idempotency_key_sigil": "k2", "cancellation_request_sigil": "c", "expected_revision": 2}), ("job.terminal", {"job_id": "JB-1", "state": "CANCELLED", "reason": "asked"}), ("job.queued", {"job_id": "JB-2"}),
]


def test_journals_become_columns_of_jobs(spark, tmp_path):
    (tmp_path / "L.jsonl").write_text("\n".join(journal_lines(JOURNAL)) + "\n")
    flat = ledger.journal_columns(ledger.read_journal(spark, str(tmp_path))).cache()
    assert jobs.broken_rules(flat).count() == 0
    assert {(r.job_id, r.state, r.revision, r.terminal_reason) for r in jobs.states(flat).collect()} == {("JB-1", "CANCELLED", 4, "asked"), ("JB-2", "QUEUED", 2, None)}
    first = flat.where("sequence = 2").first()
    assert (first.task_id, first.key, first.request, first.specification_digest) == ("TK-1", "k1", "r1", "sd") and flat.where("sequence = 1").first().epoch == 1
    # pages of one job stay those of one moment
    page, cursor = jobs.observe(flat, "L", "JB-1", limit=2)
    assert [r.sequence for r in page.collect()] == [2, 3] and cursor["through_journal_sequence"] == 7
    grown = flat.unionByName(flat.where("sequence = 3").withColumn("sequence", F.lit(8).cast("long")).withColumn("event_digest", F.lit("d8")))
    page, last = jobs.observe(grown, "L", "JB-1", limit=2, cursor=cursor)
    assert [r.sequence for r in page.collect()] == [5, 6] and last is None
    for bad in (cursor | {"last_returned_sequence": 2}, {"job_id": "JB-1"}, cursor | {"job_id": "JB-2"}):
        with pytest.raises(ValueError, match="stale"):
            jobs.observe(flat, "L", "JB-1", cursor=bad)
    with pytest.raises(ValueError, match="stale"):
        jobs.observe(flat.withColumn("event_digest", F.lit("other")), "L", "JB-1", cursor=cursor)
    for limit, job, why in ((0, "JB-1", "limit"), (257, "JB-1", "limit"), (5, "JB-9", "unknown job")):
        with pytest.raises(ValueError, match=why):
            jobs.observe(flat, "L", job, limit=limit)


def test_anchors_and_collections_are_read(spark, tmp_path):
    heads = tmp_path / "heads"
    heads.mkdir()
    (heads / "A.json").write_text('{"event_count": 3,\n "terminal_receipt_sigil": "d"}')
    assert [tuple(r) for r in ledger.read_anchors(spark, str(heads)).collect()] == [("A", 3, "d")]
    contract = {"id": "c", "contract_version": "1", "expected_outputs": [{"schema": "o"}], "allowed_tools": ["t"], "network": False, "max_time_seconds": 9, "requires_approval": False}
    capsule = {"task_id": "TK-1", "host": "h", "capability": {"id": "c", "contract_version": "1", "contract_sigil": "k"}, "snapshot": {"snapshot_id": "S", "snapshot_sigil": "s"}, "expected_outputs": [{"schema": "o"}], "circle": {"tools": ["t"], "time_budget_seconds": 5, "network": False}}
    rite = {"rite_id": "R@1", "stages": [{"name": "a", "exit_contract": {"event_type": "run.recorded", "kind": None, "phase": "PILOT"}}, {"name": "b"}]}
    for folder, name, body in (("contracts", "c", contract), ("capsules", "TK-1", capsule | {"capsule_sigil": sealed(capsule)}), ("definitions", "R", rite)):
        at = tmp_path / "A" / folder
        at.mkdir(parents=True)
        (at / f"{name}.json").write_text(json.dumps(body, indent=1))
    read = lambda name: ledger.read_collection(spark, str(tmp_path / "A" / name), name)
    c, t = read("contracts"), read("capsules")
    names = lambda x: F.col(x)["schema"]
    contracts = c.select(F.col("id").alias("capability_id"), F.col("contract_version").alias("version"), F.lit("k").alias("digest"), names("expected_outputs").alias("outputs"), "allowed_tools", F.col("network").alias("allows_network"), F.col("max_time_seconds").alias("max_seconds"), F.col("requires_approval").alias("needs_approval"))
    from tallyfold.functions.digest import json_digest

    own = json_digest(F.col("raw"), ("capsule_sigil",))
    capsules = t.select("ledger_id", "task_id", "host", F.col("capability.id").alias("capability_id"), F.col("capability.contract_version").alias("contract_version"), F.col("capability.contract_sigil").alias("contract_digest"), names("expected_outputs").alias("expected_outputs"), F.col("circle.tools").alias("tools"), F.col("circle.network").alias("network"), F.col("circle.time_budget_seconds").alias("seconds"), F.col("capsule_sigil").alias("digest"), (own == F.col("capsule_sigil")).alias("digest_ok"))
    none = spark.createDataFrame([], "ledger_id string, task_id string, capability_id string, contract_digest string, digest string, tools array<string>, network boolean, seconds long")
    assert [(r.ledger_id, r.task_id, r.verdict) for r in rules.verdicts(capsules, contracts, none, hosts=["h"]).collect()] == [("A", "TK-1", "PASS")]
    assert [(r.rite_id, r.stage_no, r.event_type, r.phase) for r in workflow.stage_rules(read("definitions")).collect()] == [("R@1", 0, "run.recorded", "PILOT")]


def test_bundles_are_written_and_versions_told(spark, tmp_path):
    rows = spark.createDataFrame([("L", "P1", 1), ("L", "P2", 2)], "ledger_id string, protocol_id string, n int")
    out = str(tmp_path / "out")
    ledger.write_bundles(rows, out)
    ledger.write_bundles(rows.where("n = 2").withColumn("n", F.lit(9)), out)
    assert {(r.protocol_id, r.n) for r in spark.read.json(out).collect()} == {("P1", 1), ("P2", 9)}
    old = spark.createDataFrame([("a", None, None), ("b", "FORMAL", None), ("c", "FORMAL", "t")], "id string, phase string, arm string")
    assert {r.id: r.v for r in old.select("id", compare.version_of({"arm": "1.2", "phase": "1.1"}).alias("v")).collect()} == {"a": "1.0", "b": "1.1", "c": "1.2"}


def test_pages_have_totals_and_bounds(spark):
    rows = spark.range(7).withColumnRenamed("id", "k")
    page, total, following = reads.paged(rows, "k", 3, 3)
    assert [r.k for r in page.collect()] == [3, 4, 5] and (total, following) == (7, 6)
    page, total, following = reads.paged(rows, "k", 3, 6)
    assert [r.k for r in page.collect()] == [6] and following is None
    for limit, offset in ((0, 0), (101, 0), (5, 8), (5, -1)):
        with pytest.raises(ValueError, match="limit|offset"):
            reads.paged(rows, "k", limit, offset)


def test_workings_are_chosen(spark):
    workings = spark.createDataFrame([("L", w, "RP-1", p, s, v) for w, p, s, v in (("WK-1", "PT-1", "ACTIVE", "1.1"), ("WK-2", "PT-1", "COMPLETED", "1.1"), ("WK-3", "PT-2", "ACTIVE", "1.1"), ("WK-4", "PT-2", "ACTIVE", "1.1"), ("WK-5", "PT-1", "ACTIVE", "1.0"))], "ledger_id string, working_id string, program_id string, protocol_id string, status string, version string")
    wanted = spark.createDataFrame([("L", "RP-1", p, w) for p, w in (("PT-1", None), ("PT-1", "WK-2"), ("PT-1", "WK-5"), ("PT-2", None), ("PT-2", "WK-4"), ("PT-3", None))], "ledger_id string, program_id string, protocol_id string, working_id string")
    got = {(r.protocol_id, r.working_id): (r.chosen, r.problem) for r in rules.chosen_workings(wanted, workings, "1.1").collect()}
    assert got == {("PT-1", None): ("WK-1", None), ("PT-1", "WK-2"): (None, "not active for the protocol"), ("PT-1", "WK-5"): (None, "not active for the protocol"), ("PT-2", None): (None, "several are active"), ("PT-2", "WK-4"): ("WK-4", None), ("PT-3", None): (None, None)}


def test_reviews_and_edges(spark):
    rows = state.parsed(events_with_actors(spark, study())).cache()
    lives = {r.id: (r.kind, r.state, r.steps, r.approved_by, r.task_id, r.accepted_at is not None, r.provider) for r in state.review_lives(rows).collect()}
    assert lives == {"RV-1": ("local_review", "ACCEPTED", 3, None, "TK-1", True, None), "RV-2": ("external_diff_review", "COMPLETED", 3, "ann", "TK-2", False, "x")}
    edges = {(r.src, r.dst, r.kind) for r in state.record_edges(rows).collect()}
    assert {("CL-1", "EV-1", "evidence"), ("EX-1", "WK-1", "workings"), ("AS-1", "RB-1", "result_bundles"), ("AR-1", "RUN-1", "any"), ("DE-6", "AS-2", "assessments"), ("RR-1", "AR-1", "artifacts"), ("PT-1", "HY-1", "hypotheses")} <= edges
    assert not [e for e in edges if e[0] == e[1]]


def test_the_trace_index_stays(spark, tmp_path):
    rows = [(r[0], r[1], dict(r[2])) for r in study()]
    events = events_with_actors(spark, rows).cache()
    path = str(tmp_path / "index")
    trace_index.append(events.where("sequence <= 20"), path, "a")
    trace_index.append(events.where("sequence > 20"), path, "b")
    ids = spark.createDataFrame([("L", x) for x in ("EV-1", "RUN-1", "RP-1", "none")], "ledger_id string, id string")
    want = {tuple(r) for r in lineage.trace(lineage.references(events), ids).select("ledger_id", "id", "sequence").collect()}
    look = lambda **more: {tuple(r) for r in trace_index.look_up(spark, path, ids, **more).collect()}
    assert look() == want and len(want) > 20
    trace_index.append(events.where("sequence > 20"), path, "b")  # again
    assert look() == want and look(collection="runs") == {x for x in want if x[1] == "RUN-1"}
    plan = trace_index.look_up(spark, path, ids.limit(1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_states_are_proved_equal(spark):
    sound = events_with_actors(spark, study())
    later = sound.withColumn("sequence", F.col("sequence") * 2)
    assert state.state_changes(sound, later).count() == 0
    other = sound.where("object_id <> 'DV-1'").unionByName(events_with_actors(spark, [("hypothesis.created", "HY-9", P | {"claim_ids": ["CL-1"], "statement": "s", "prediction": "p"})]).withColumn("sequence", F.lit(99).cast("long")))
    assert {(r.collection, r.n_before, r.n_after) for r in state.state_changes(sound, other).collect()} == {("deviations", 1, 0), ("hypotheses", 2, 3), ("programs", 1, 1), ("protocols", 2, 2)}


def test_reach_is_counted_by_bits(spark):
    import random
    from collections import deque

    rng = random.Random(6)
    edges = [("L", f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(200)] + [("M", "a", "b"), ("M", "b", "a")]
    links = spark.createDataFrame(edges, "ledger_id string, src string, dst string")
    start = [("L", f"n{i}") for i in range(100)] + [("M", "a"), ("L", "n1")]
    for up in (False, True):
        following = {}
        for ledger_id, a, b in edges:
            following.setdefault((ledger_id, b if up else a), set()).add(a if up else b)
        want = {}
        for ledger_id, root in set(start):
            depth, todo = {root: 0}, deque([root])
            while todo:
                x = todo.popleft()
                for y in following.get((ledger_id, x), ()):
                    if y not in depth:
                        depth[y] = depth[x] + 1
                        todo.append(y)
            for d in depth.values():
                want[ledger_id, root, d] = want.get((ledger_id, root, d), 0) + 1
        got = {(r.ledger_id, r.root, r.depth): r.n for r in lineage.reach_counts(links, spark.createDataFrame(start, "ledger_id string, id string"), up).collect()}
        assert got == want


def test_inventories_in_chunks(spark):
    schema = "ledger_id string, protocol_id string, run_id string, status string, disposition struct<included:boolean,reason:string,policy_reference:string>"
    rows = [("L", "P" if i % 5 else "Q", f"R{i:03d}", "FAILED" if i % 7 == 0 else "COMPLETED", (i % 3 > 0, None, None)) for i in range(100)]
    runs = spark.createDataFrame(rows, schema).repartition(3)
    expected = spark.createDataFrame([("L", "P", "R001"), ("L", "P", "GONE"), ("L", "P", "GONE")], "ledger_id string, protocol_id string, run_id string")
    lists = {}
    for _, p, i, status, d in rows:
        for k in ("all", "included" if status == "COMPLETED" and d[0] else "excluded", *(["failed"] if status == "FAILED" else [])):
            lists.setdefault((p, k), []).append(i)
    lists["P", "missing"] = ["GONE"]
    whole = {(r.protocol_id, r.kind): (r.n, r.digest) for r in compare.inventory_digests(runs, expected).collect()}
    for size in (7, 1000):
        chunks = compare.inventory_chunks(runs, expected, size).cache()
        got = {}
        for r in chunks.orderBy("chunk").collect():
            assert len(r["items"]) <= size
            got.setdefault((r.protocol_id, r.kind), []).extend(r["items"])
        assert got == lists and {(r.protocol_id, r.kind): (r.n, r.digest) for r in compare.chunk_digests(chunks).collect()} == whole
    assert {k: n for k, (n, _) in whole.items()} == {k: len(v) for k, v in lists.items()} and len({d for _, d in whole.values()}) == len(whole)
    results = spark.createDataFrame([("L", "P", 0, "c", 1.0)], "ledger_id string, protocol_id string, position int, comparison_id string, estimate double")
    (b,) = compare.bundle_records(results, runs, expected).collect()
    assert (b.comparisons[0].estimate, b.all_runs.n, b.all_runs.chunks, b.missing_runs.n) == (1.0, 80, 1, 1) and b.all_runs.digest == whole["P", "all"][1]


def test_a_task_of_a_closure_holds_a_bounded_share_of_the_edges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 10)
    seen = []
    kept = lineage.kept
    monkeypatch.setattr(lineage, "kept", lambda df: (lambda out: (seen.append(out.rdd.glom().map(len).collect()), out)[1])(kept(df)))
    links = spark.range(400).select(F.lit("L").alias("ledger_id"), F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("p"), F.col("id") % 100).alias("dst"))
    start = links.select("ledger_id", F.col("dst").alias("id")).distinct()
    assert {(r.depth, r.n) for r in lineage.reach_counts(links, start, up=True).collect()} == {(0, 1), (1, 4)}
    assert lineage.closure(links, start, up=True).count() == 500
    edges = [x for x in seen if sum(x) == 400 and len(x) > 1]
    assert edges and all(len(x) >= 41 for x in edges) and max(map(max, edges)) < 60


def test_relations_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 10)
    rows = spark.range(200).select(F.lit("L").alias("ledger_id"), F.col("id").alias("sequence"), F.lit("CE").alias("event_id"), F.when(F.col("id") < 100, "claim_relation.proposed").otherwise("claim_relation.verified").alias("type"), (F.col("id") % 100).cast("string").alias("object_id"), F.lit("t").alias("occurred_at"), F.lit('{"evidence_id":"EV-1","relation":"SUPPORTS"}').alias("payload"))
    out = state.claim_relations(state.parsed(rows, state.RELATION_FIELDS), ordered.parts(rows))
    assert out.rdd.getNumPartitions() == 21
    assert {(r.evidence_id, r.relation, r.status) for r in out.collect()} == {("EV-1", "SUPPORTS", "VERIFIED")} and out.count() == 100
