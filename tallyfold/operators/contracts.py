"""Contracts on records as rule tables: each rule is a Catalyst predicate, each breach a row, all rules in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# \z, not $, which also holds before a line feed at the end.
DIGEST = r"^sha256:[a-f0-9]{64}\z"
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
IDENTIFIER = r"^[A-Z][A-Z0-9_]*-[A-Z0-9][A-Z0-9_-]*\z"
RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)\z"


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column


def required(column: str) -> Rule:
    return Rule(f"{column}: missing", F.col(column).isNull())


def one_of(column: str, values: list) -> Rule:
    return Rule(f"{column}: not one of its values", F.col(column).isNotNull() & ~F.col(column).isin(values))


def constant(column: str, value) -> Rule:
    return Rule(f"{column}: not {value}", F.col(column).isNotNull() & (F.col(column) != F.lit(value)))


def pattern(column: str, regex: str) -> Rule:
    return Rule(f"{column}: pattern", F.col(column).isNotNull() & ~F.col(column).rlike(regex))


def filled(column: str, least: int = 1) -> Rule:
    return Rule(f"{column}: too short", F.col(column).isNotNull() & (F.length(F.trim(column)) < least))


def identifier(column: str, prefix: str) -> Rule:
    return Rule(f"{column}: no identifier", F.col(column).isNotNull() & ~(F.col(column).rlike(IDENTIFIER) & F.col(column).startswith(prefix)))


def reference_to_content(column: str) -> Rule:
    """JSON text of an object with exactly a uri, not empty, and a digest."""
    c = F.col(column)
    fine = (F.array_sort(F.json_object_keys(c)) == F.array(F.lit("sigil"), F.lit("uri"))) & (F.length(F.get_json_object(c, "$.uri")) > 0) & F.get_json_object(c, "$.sigil").rlike(DIGEST)
    return Rule(f"{column}: no reference to content", c.isNotNull() & ~F.coalesce(fine, F.lit(False)))


def each_of(column: str, field: str, values: list) -> Rule:
    """Every element's field is one of the values."""
    return Rule(f"{column}.{field}: not one of its values", F.coalesce(F.exists(F.col(f"{column}.{field}"), lambda x: ~x.isin(values)), F.lit(False)))


def items(column: str, least: int = 1) -> Rule:
    return Rule(f"{column}: too few", F.col(column).isNotNull() & (F.size(column) < least))


def unique(column: str) -> Rule:
    return Rule(f"{column}: repeated", F.col(column).isNotNull() & (F.size(column) != F.size(F.array_distinct(column))))


def between(column: str, least=None, most=None, open_ends: bool = False) -> Rule:
    c, out = F.col(column), F.lit(False)
    if least is not None:
        out = out | ((c <= least) if open_ends else (c < least))
    if most is not None:
        out = out | ((c >= most) if open_ends else (c > most))
    return Rule(f"{column}: out of bounds", c.isNotNull() & out)


def timestamp(column: str) -> Rule:
    """RFC 3339 with a zone."""
    c = F.col(column)
    return Rule(f"{column}: not a time with zone", c.isNotNull() & ~(c.rlike(RFC3339) & F.try_to_timestamp(c).isNotNull()))


def finite(column: str) -> Rule:
    """Every value of a map or array is a finite number."""
    values = F.map_values(column)
    return Rule(f"{column}: not finite", F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def implies(name: str, condition: Column, then: Column) -> Rule:
    return Rule(name, F.coalesce(condition, F.lit(False)) & ~F.coalesce(then, F.lit(False)))


def closed(raw: str, fields: list[str]) -> Rule:
    """No members beyond the known ones in the JSON text."""
    return Rule(f"{raw}: unknown field", F.size(F.array_except(F.json_object_keys(raw), F.lit(fields))) > 0)


def breaches(records: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """key and rule, a row for each breach."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules)))
    return records.select(*key, F.explode(found).alias("rule"))


def repeated(records: DataFrame, by: list[str]) -> DataFrame:
    return records.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def run_rules() -> list[Rule]:
    """Rules of a run record; disposition: included, reason, policy_reference; artifacts: uri, sigil; needs_arm: its protocol registers comparisons."""
    included, done = F.col("disposition.included"), F.col("status") == "COMPLETED"
    reason = F.length(F.trim(F.coalesce(F.col("disposition.reason"), F.lit("")))) > 0
    policy = F.col("disposition.policy_reference")
    return [
        required("run_id"), required("experiment_id"), required("status"), one_of("status", ["COMPLETED", "FAILED", "CANCELLED", "LOST"]), one_of("phase", ["PILOT", "FORMAL"]), finite("metrics"),
        Rule("metrics: unnamed", F.coalesce(F.exists(F.map_keys("metrics"), lambda k: F.trim(k) == ""), F.lit(False))),
        implies("included: not completed", included, done), implies("included: no metric", included, F.size("metrics") > 0), implies("included: has a reason", included, ~reason),
        implies("excluded: no reason", done & ~included, reason), implies("policy: not of its protocol", policy.isNotNull(), policy.startswith(F.concat(F.col("protocol_id"), F.lit("#")))),
    ]


def run_entry_rules() -> list[Rule]:
    """What more an entry of a run is asked for: arm and artifacts (see run_rules())."""
    bad = F.exists("artifacts", lambda a: ~F.coalesce((F.length(a["uri"]) > 0) & a["sigil"].rlike(DIGEST), F.lit(False)))
    return [implies("arm: missing", F.col("needs_arm"), F.col("arm").isNotNull()), filled("arm"), Rule("artifacts: no reference to content", F.coalesce(bad, F.lit(False)))]


def comparison_rules() -> list[Rule]:
    """Rules of a registered comparison."""
    boot = F.col("uncertainty") == "bootstrap"
    return [
        required("comparison_id"), required("metric"), one_of("pairing", ["paired", "unpaired", "none"]), one_of("uncertainty", ["student_t", "bootstrap", "unavailable"]), one_of("policy", ["none", "bonferroni", "holm", "fdr"]), between("level", 0, 1, open_ends=True),
        Rule("arms: not two different ones", (F.size("arms") != 2) | (F.size(F.array_distinct("arms")) != 2)), implies("bootstrap: no seed", boot, F.col("seed").isNotNull()), implies("bootstrap: samples", boot, F.col("samples").between(100, 100_000)),
    ]


def protocol_rules() -> list[Rule]:
    return [required("title"), filled("title"), unique("hypothesis_ids"), one_of("study_mode", ["exploratory", "confirmatory"]), implies("confirmatory: no hypothesis", F.col("study_mode") == "confirmatory", F.size("hypothesis_ids") > 0)]


# Fixed values of the records.
CLAIM_TYPES = ["empirical", "theoretical", "methodological", "operational"]
RELATIONS = ["SUPPORTS", "CONTRADICTS", "LIMITS", "REPRODUCES", "UNRESOLVED"]
CLAIM_STATES = ["SUPPORTED", "CONTESTED", "REJECTED", "UNRESOLVED"]
HYPOTHESIS_STATES = ["SUPPORTED", "NOT_SUPPORTED", "INCONCLUSIVE", "REJECTED"]
OUTCOMES = ["CONTINUE", "REPAIR", "PIVOT", "STOP", "INSUFFICIENT_EVIDENCE", "REVIEW_REQUIRED"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
DEVIATIONS = ["PLANNED", "UNPLANNED"]
IMPACTS = ["NONE", "MINOR", "MAJOR", "INVALIDATING"]
REPRODUCTIONS = ["REPRODUCED", "NOT_REPRODUCED", "INCONCLUSIVE"]
REVIEWS = ["local_review", "external_diff_review"]
RESULTS = ["COMPLETED", "FAILED", "CANCELLED"]


def record_rules() -> dict[str, list[Rule]]:
    """Rule tables by collection, for the columns of the state tables."""
    from tallyfold.operators.state import PREFIXES

    decided, json = F.col("outcome"), F.get_json_object
    known = {
        "programs": [required("slug"), pattern("slug", SLUG), required("title"), filled("title"), required("problem")],
        "evidence": [required("source"), reference_to_content("source"), required("observation"), filled("observation"), implies("inspected: not resolved", F.col("verification.content_inspected"), F.col("verification.source_resolved"))],
        "claims": [required("type"), one_of("type", CLAIM_TYPES), required("statement"), filled("statement"), each_of("evidence_relations", "relation", RELATIONS)],
        "hypotheses": [required("claim_ids"), filled("statement"), filled("prediction"), items("claim_ids"), unique("claim_ids")],
        "protocols": [*protocol_rules(), required("analysis_plan"), filled("analysis_plan")],
        "approvals": [required("capsule_sigil"), pattern("capsule_sigil", DIGEST), required("capability"), pattern("capability_contract_sigil", DIGEST)],
        "review_requests": [required("type"), one_of("type", REVIEWS), Rule("target: no repository", F.coalesce(F.length(json("target", "$.repository")), F.lit(0)) == 0), Rule("scope: no checks", F.coalesce(F.json_array_length(json("scope", "$.checks")), F.lit(0)) == 0)],
        "review_artifacts": [required("task_id"), required("source"), Rule("result: no recommendation", F.coalesce(F.length(json("result", "$.recommendation")), F.lit(0)) == 0)],
        "task_results": [required("capability"), pattern("capsule_sigil", DIGEST), Rule("result: status", ~F.coalesce(json("result", "$.status").isin(RESULTS), F.lit(False)))],
        "workings": [required("rite_id"), pattern("rite_id", "@"), required("rite_sigil"), pattern("rite_sigil", DIGEST)],
        "experiments": [required("protocol_id"), required("question"), filled("question")],
        "runs": [required("experiment_id"), required("status"), one_of("status", ["COMPLETED", "FAILED", "CANCELLED", "LOST"]), one_of("phase", ["PILOT", "FORMAL"]), finite("metrics"), filled("arm")],
        "result_bundles": [required("bundle"), pattern("bundle_sigil", DIGEST)],
        "assessments": [required("summary"), filled("summary"), each_of("claim_findings", "status", CLAIM_STATES), each_of("hypothesis_findings", "status", HYPOTHESIS_STATES), unique_by("claim_findings", "claim_id"), unique_by("hypothesis_findings", "hypothesis_id"), each_filled("limitations"), one_of("study_mode", ["exploratory", "confirmatory"])],
        "decisions": [required("outcome"), one_of("outcome", OUTCOMES), required("rationale"), filled("rationale"), required("assessment_ids"), items("assessment_ids"), unique("assessment_ids"), each_filled("required_actions"), implies("repair: no actions", decided == "REPAIR", F.size("required_actions") > 0), implies("pivot: no parent", decided == "PIVOT", F.col("lineage.parent_program_id").isNotNull()), implies("review: one assessment", decided == "REVIEW_REQUIRED", F.size("assessment_ids") > 1)],
        "artifacts": [required("kind"), filled("kind"), required("producer_id"), unique("input_ids"), Rule("location: digest", ~F.coalesce(F.col("location.sigil").rlike(DIGEST), F.lit(False)))],
        "issues": [required("severity"), one_of("severity", SEVERITIES), filled("title"), filled("description"), required("subject_ids"), items("subject_ids"), unique("subject_ids")],
        "deviations": [required("kind"), one_of("kind", DEVIATIONS), filled("summary"), filled("rationale"), required("impact"), one_of("impact", IMPACTS), unique("affected_object_ids")],
        "reproductions": [required("status"), one_of("status", REPRODUCTIONS), items("run_ids"), unique("run_ids"), items("artifact_ids"), unique("artifact_ids")],
    }
    return {name: [identifier("id", PREFIXES[name]), *rules] if name in PREFIXES else rules for name, rules in known.items()}


def every_breach(tables: dict[str, DataFrame]) -> DataFrame:
    """ledger_id, collection, id, rule of each record of the state tables that breaks its contract."""
    from tallyfold.operators.chain import union

    known = record_rules()
    return union([breaches(rows, known[name], ["ledger_id", "id"]).select("ledger_id", F.lit(name).alias("collection"), "id", "rule") for name, rows in tables.items() if name in known])


def unique_by(column: str, field: str) -> Rule:
    return Rule(f"{column}: repeated", F.coalesce(F.size(column) != F.size(F.array_distinct(F.col(f"{column}.{field}"))), F.lit(False)))


def each_filled(column: str) -> Rule:
    return Rule(f"{column}: empty text", F.coalesce(F.exists(column, lambda x: F.trim(x) == ""), F.lit(False)))


def repeated_comparisons(comparisons: DataFrame) -> DataFrame:
    """Comparison ids that a protocol registers more than once."""
    return repeated(comparisons, ["ledger_id", "protocol_id", "comparison_id"])


# What a task's output data of each shape holds.  A field has a kind and, by kind, a least number,
# the beginning of ids, the allowed values, or the shape of its elements.
_TEXTS, _SOME = ("texts", 0, None), ("texts", 1, None)
_TEXT, _FLAG, _COUNT, _OBJECT = ("text", 1, None), ("flag", None, None), ("count", 0, None), ("object", 1, None)
SHAPES = {
    "research_orchestration": {"workstreams": _SOME, "dependencies": _TEXTS, "gates": _SOME, "open_issues": _TEXTS},
    "evidence_discovery": {"queries": _SOME, "sources": ("shapes", 0, "source"), "screened_count": _COUNT, "candidate_evidence": ("shapes", 0, "candidate_evidence"), "unresolved_queries": _TEXTS, "limitations": _TEXTS},
    "evidence_synthesis": {"evidence_ids": ("ids", 1, "EV-"), "synthesis": _TEXT, "contradictions": _TEXTS, "uncertainties": _TEXTS, "limitations": _TEXTS},
    "evidence_verification": {"evidence_id": ("id", 1, "EV-"), "source_resolved": _FLAG, "content_inspected": _FLAG, "verification_notes": _TEXT, "limitations": _TEXTS},
    "hypothesis_framing": {"hypotheses": ("shapes", 1, "framed_hypothesis"), "assumptions": _TEXTS, "open_questions": _TEXTS},
    "hypothesis_challenge": {"hypothesis_id": ("id", 1, "HY-"), "challenges": _SOME, "counterevidence": _TEXTS, "validity_threats": _SOME, "recommendation": _TEXT},
    "study_design": {"protocol_proposal": _OBJECT, "hypotheses": _SOME, "estimand": _TEXT, "validity_threats": _SOME, "open_issues": _TEXTS},
    "study_audit": {"protocol_id": ("id", 1, "PT-"), "findings": _SOME, "validity_threats": _TEXTS, "open_issues": _TEXTS, "recommendation": _TEXT},
    "code_inspection": {"inspected_files": _SOME, "findings": _TEXTS, "tests_considered": _TEXTS, "residual_risks": _TEXTS},
    "code_modification": {"patch": _TEXT, "changed_files": _SOME, "tests_run": _SOME, "validation": _TEXT, "residual_risks": _TEXTS},
    "experiment_plan": {"experiment_proposal": _OBJECT, "run_matrix": ("objects", 1, None), "controls": _SOME, "failure_criteria": _SOME, "risks": _TEXTS},
    "experiment_execution": {"experiment_id": ("id", 1, "EX-"), "commands": _SOME, "run_ids": ("ids", 0, "RUN-"), "status": ("value", 1, "COMPLETED FAILED CANCELLED"), "failures": _TEXTS},
    "experiment_collection": {"run_ids": ("ids", 1, "RUN-"), "artifacts": ("shapes", 0, "artifact"), "missing_outputs": _TEXTS, "quality_checks": _SOME, "limitations": _TEXTS},
    "analysis_computation": {"result_bundle": _OBJECT, "included_run_ids": ("ids", 0, "RUN-"), "excluded_runs": ("objects", 0, None), "method": _TEXT, "warnings": _TEXTS},
    "analysis_interpretation": {"bundle_id": ("id", 1, "RB-"), "findings": _SOME, "uncertainty": _SOME, "practical_significance": _TEXT, "limitations": _TEXTS},
    "decision_review": {"assessment_ids": ("ids", 1, "AS-"), "competing_interpretations": _TEXTS, "unresolved_issues": _TEXTS, "recommendation": _TEXT},
    "decision_proposal": {"outcome": ("value", 1, " ".join(OUTCOMES)), "rationale": _TEXT, "assessment_ids": ("ids", 1, "AS-"), "required_actions": _TEXTS, "uncertainties": _TEXTS},
    "source": {"uri": _TEXT, "title": _TEXT},
    "candidate_evidence": {"source_uri": _TEXT, "claim": _TEXT, "relevance": _TEXT, "uncertainty": _TEXT},
    "framed_hypothesis": {"statement": _TEXT, "falsification_criteria": _TEXT, "evidence_ids": ("ids", 0, "EV-")},
    "artifact": {"uri": _TEXT, "sigil": ("digest", 1, None)},
}


def output_breaches(outputs: DataFrame, key: list[str]) -> DataFrame:
    """key, field, rule of each breach of task output data: outputs has key, shape and data (JSON text).

    Fields are rows: each is joined to its shape's contract (a fixed table), by
    which it is unknown or of the wrong kind; what is missing follows from an
    output's own names, so outputs and fields never meet in a join.  Elements
    that have a shape of their own are outputs in turn; breaches found before
    them pass by, so all comes from one pass.  Data that isn't a JSON object, or
    of an unknown shape, is one breach.
    """
    spark = outputs.sparkSession
    table = [(shape, field, *kind) for shape, fields in SHAPES.items() for field, kind in fields.items()]
    contract = F.broadcast(spark.createDataFrame(table, "shape string, field string, kind string, least int, of string"))  # the table above
    asked = F.create_map(*(x for shape, fields in SHAPES.items() for x in (F.lit(shape), F.array(*map(F.lit, fields)))))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("variant")
    part = lambda field, v, rule: F.struct(field.alias("field"), v.alias("v"), rule.alias("rule"))
    rows = outputs.select(*key, F.lit("").alias("at"), "shape", F.try_parse_json("data").alias("v"), none.alias("rule"))
    for _ in range(2):  # shapes are two levels deep
        rows = rows.withColumn("members", F.when(F.col("shape").isin(list(SHAPES)), F.try_variant_get("v", "$", "map<string,variant>")))
        lacks = F.array_except(F.try_element_at(asked, F.col("shape")), F.map_keys("members"))
        parts = (
            F.when(F.col("rule").isNotNull(), F.array(part(F.lit(""), nothing, F.col("rule"))))
            .when(F.col("members").isNull(), F.array(part(F.lit(""), nothing, F.lit("not an object of a known shape"))))
            .otherwise(F.concat(F.transform(F.map_entries("members"), lambda e: part(e["key"], e["value"], none)), F.transform(lacks, lambda x: part(x, nothing, F.lit("missing")))))
        )
        fields = rows.select(*key, "at", "shape", F.explode(parts).alias("f")).select(*key, "at", "shape", "f.field", "f.v", F.col("f.rule").alias("_rule"), F.schema_of_variant("f.v").alias("t"))
        t, k, of = F.col("t"), F.col("kind"), F.col("of")
        texts, text = F.try_variant_get("v", "$", "array<string>"), F.try_variant_get("v", "$", "string")
        enough = F.size(texts) >= F.col("least")
        worded = t.isin("ARRAY<STRING>", "ARRAY<VOID>") & enough & ~F.exists(texts, lambda x: x == "")
        fine = (
            F.when(k == "texts", worded)
            .when(k == "ids", worded & ~F.exists(texts, lambda x: ~x.startswith(of)) & (F.size(texts) == F.size(F.array_distinct(texts))))
            .when(k == "text", (t == "STRING") & (text != ""))
            .when(k == "id", (t == "STRING") & text.startswith(of))
            .when(k == "digest", (t == "STRING") & text.rlike(DIGEST))
            .when(k == "value", (t == "STRING") & F.array_contains(F.split(of, " "), text))
            .when(k == "flag", t == "BOOLEAN")
            .when(k == "count", (t == "BIGINT") & (F.try_variant_get("v", "$", "long") >= F.col("least")))
            .when(k == "object", t.startswith("OBJECT") & (t != "OBJECT<>"))
            .when(k == "objects", (t.startswith("ARRAY<OBJECT") | (t == "ARRAY<VOID>")) & enough & ~F.exists(texts, lambda x: x == "{}"))
            .when(k == "shapes", (t.startswith("ARRAY<OBJECT") | (t == "ARRAY<VOID>")) & enough)
        )
        rule = F.coalesce("_rule", F.when(k.isNull(), F.lit("unknown field")), F.when(~F.coalesce(fine, F.lit(False)), F.lit("wrong value")))
        judged = fields.join(contract, ["shape", "field"], "left").select(*key, F.concat("at", "field").alias("field"), "kind", "of", "v", "t", rule.alias("rule"))
        inner = F.coalesce((k == "shapes") & t.startswith("ARRAY<OBJECT"), F.lit(False))
        below = F.when(F.col("rule").isNotNull(), F.array(nothing)).when(inner, F.try_variant_get("v", "$", "array<variant>"))
        rows = judged.select(*key, F.when(F.col("rule").isNotNull(), F.col("field")).otherwise(F.concat("field", F.lit("."))).alias("at"), of.alias("shape"), F.explode(below).alias("v"), "rule")
    return judged.where("rule is not null").select(*key, "field", "rule").distinct()


def digest_pins(records: DataFrame, raw: str, field: str, key: list[str]) -> DataFrame:
    """Records (JSON text) whose stored digest isn't that of the rest of the record."""
    from tallyfold.functions.digest import json_digest

    own = json_digest(F.col(raw), (field,))
    return records.where(~F.get_json_object(raw, f"$.{field}").eqNullSafe(own)).select(*key, F.lit("digest differs").alias("rule"))
