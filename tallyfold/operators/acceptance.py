"""Acceptance of task results: each rule that an accepted result must keep, as rows of those that break it.

results: ledger_id, sequence, task_id, snapshot, contract_digest, status,
outputs ARRAY<STRUCT<schema, path, digest>>; where it has it, provenance_host.
capsules: ledger_id, task_id, snapshot, contract_digest, expected_outputs
ARRAY<STRING>; where it has them, host, program_id, snapshot_program,
capability_id, current_contract (its digest now) and review_id (the bound one).
reviews: ledger_id, review_id, kind, sequence, state, a row for each step of a
review; files: path, digest and, where it has it, content (text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.chain import union, violations
from tallyfold.operators.contracts import SHAPES, output_breaches
from tallyfold.operators.lineage import kept, once

KEY = ["ledger_id", "task_id"]
# How the names of the capabilities that work on reviews end, with the kind (null: any) and state that the review needs.
REVIEWED = {".review.local": ("local_review", "PREPARED"), ".review.external": ("external_diff_review", "APPROVED"), ".review.accept": (None, "COMPLETED")}
# Fixed: the end of a result's schema name; what stands before it names the shape of the data.
_RESULT = r"-result/[0-9.]+\z"


def _own(rows: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in rows.columns else F.lit(None).cast(kind)


def steps_out(path: Column) -> Column:
    """Whether a relative path leaves the folder that it starts from, at any of its steps."""
    depth = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    walk = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, p: F.struct((a["at"] + depth(p)).alias("at"), F.least(a["least"], a["at"] + depth(p)).alias("least")))
    return walk["least"] < 0


def states_at(moments: DataFrame, reviews: DataFrame) -> DataFrame:
    """moments (ledger_id, review_id, sequence, ...) with review_kind and review_state before each; null where there is no step yet."""
    by = ["ledger_id", "review_id"]
    at = moments.select(*by, "sequence").distinct()
    before = at.join(reviews.select(*by, "kind", F.col("sequence").alias("_s"), "state"), by).where("_s < sequence")
    last = before.groupBy(*by, "sequence").agg(F.max_by(F.struct(F.col("kind").alias("review_kind"), F.col("state").alias("review_state")), "_s").alias("_r"))
    return moments.join(last, [*by, "sequence"], "left").select(*moments.columns, "_r.review_kind", "_r.review_state")


def bindings(rows: DataFrame, reviews: DataFrame | None) -> DataFrame:
    """Results of tasks on reviews that aren't bound to one, or to one that isn't in the state that the task needs."""
    capability = F.coalesce("capability_id", F.lit(""))
    on_review = F.lit(False)
    ready = F.lit(False)
    for ending, (kind, state) in REVIEWED.items():
        own = capability.endswith(ending)
        on_review = on_review | own
        ready = ready | (own & (F.col("review_state") == state) & (F.lit(True) if kind is None else F.col("review_kind") == kind))
    asked = rows.where(on_review)
    asked = states_at(asked, reviews) if reviews is not None else asked.select("*", *(F.lit(None).cast("string").alias(c) for c in ("review_kind", "review_state")))
    bound, there = F.col("review_id").isNotNull(), F.col("review_state").isNotNull()
    return violations(asked, {"no review bound": ~bound, "unknown review": bound & ~there, "review not ready": there & ~F.coalesce(ready, F.lit(False))}, "task_id")


def outputs_of(rows: DataFrame) -> DataFrame:
    """ledger_id, sequence, task_id, review_id, capability_id, place, schema, path, digest: a row for each output."""
    return rows.select("ledger_id", "sequence", "task_id", "review_id", "capability_id", F.posexplode("outputs").alias("place", "o")).select("*", "o.schema", "o.path", "o.digest").drop("o")


def contents(outs: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks with outputs without a file inside the project, of other bytes, or whose document isn't what its schema, task and review ask for."""
    with_text = "content" in files.columns
    by = ["ledger_id", "sequence", "task_id"]
    have = files.select("path", F.col("digest").alias("_have"), (once(F.try_parse_json("content")) if with_text else F.lit(None)).alias("_v"))
    member = lambda path: F.try_variant_get("_v", path, "string")
    if with_text:  # a document is read once, before it meets the outputs that name it
        an_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
        have = have.select("path", "_have", an_object.alias("_object"), member("$.schema_version").alias("_schema"), member("$.task_id").alias("_task"), member("$.data.review_id").alias("_review"), "_v")
    held = outs.join(have.drop("_v"), "path", "left")
    absolute = F.col("path").startswith("/")
    there = F.col("_have").isNotNull()
    rules = {"absolute path": absolute, "path leaves the project": ~absolute & steps_out(F.col("path")), "output missing": ~there, "output differs": there & (F.col("_have") != F.col("digest"))}
    if with_text:
        read = there & F.col("_object")
        on_review = F.lit(False)
        for ending in REVIEWED:
            on_review = on_review | F.coalesce(F.col("capability_id"), F.lit("")).endswith(ending)
        rules |= {
            "output no object": there & ~F.col("_object"),
            "output of another schema": read & ~F.col("_schema").eqNullSafe(F.col("schema")),
            "output of another task": read & ~F.col("_task").eqNullSafe(F.col("task_id")),
            "output of another review": read & on_review & ~F.col("_review").eqNullSafe(F.col("review_id")),
        }
    # a task breaks a rule once, however many of its outputs do
    broken = held.groupBy(*by).agg(*(F.bool_or(c).alias(f"_{i}") for i, c in enumerate(rules.values())))
    out = violations(broken, {name: F.col(f"_{i}") for i, name in enumerate(rules)}, "task_id")
    if not with_text:
        return out
    shape = F.regexp_replace(F.regexp_replace("schema", _RESULT, ""), "-", "_")
    shaped = outs.select(*by, "place", "path", shape.alias("shape")).where(F.col("shape").isin(list(SHAPES)))
    data = shaped.join(have.where("_have is not null and _object"), "path").select(*by, "place", "shape", F.to_json(F.try_variant_get("_v", "$.data", "variant")).alias("data"))
    return out.unionByName(violations(output_breaches(data, [*by, "place"]).select(*by).distinct(), {"output contract": F.lit(True)}, "task_id"))


def acceptance(results: DataFrame, capsules: DataFrame, verdicts: DataFrame, fresh: DataFrame, files: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """ledger_id, sequence, object_id (the task), rule: what accepted results break.

    verdicts: ledger_id, task_id, verdict; fresh: ledger_id, snapshot, fresh.
    A result of any status may give each expected schema any number of times,
    and no other; a completed one gives one output at least.  What a capsule or
    result doesn't tell (its host, programs, present contract) isn't held
    against it; a task on a review must be bound to one.
    """
    told = lambda c: _own(capsules, c).alias(c)
    c = capsules.select(
        *KEY, F.col("snapshot").alias("_s"), F.col("contract_digest").alias("_c"), F.col("expected_outputs").alias("_o"), told("host"), told("program_id"), told("snapshot_program"), told("capability_id"), told("current_contract"), told("review_id"), F.lit(True).alias("_task")
    )
    rows = results.withColumn("_host", _own(results, "provenance_host")).join(c, KEY, "left").join(verdicts.select(*KEY, "verdict"), KEY, "left").join(fresh.select("ledger_id", "snapshot", "fresh"), ["ledger_id", "snapshot"], "left")
    rows = kept(rows)  # read by the results' own rules, by those of reviews and by the outputs
    schemas = F.coalesce(F.col("outputs.schema"), F.array().cast("array<string>"))
    expected = F.coalesce("_o", F.array().cast("array<string>"))
    other = lambda a, b: F.coalesce(a != b, F.lit(False))
    own = violations(
        rows,
        {
            "unknown task": F.col("_task").isNull(),
            "other snapshot": ~F.col("snapshot").eqNullSafe(F.col("_s")),
            "other contract": ~F.col("contract_digest").eqNullSafe(F.col("_c")),
            "contract changed": other(F.col("current_contract"), F.col("_c")),
            "other program": other(F.col("snapshot_program"), F.col("program_id")),
            "stale snapshot": ~F.coalesce(F.col("fresh"), F.lit(False)),
            "policy": ~F.coalesce(F.col("verdict") == "PASS", F.lit(False)),
            "other host": other(F.col("_host"), F.col("host")),
            "no outputs": (F.col("status") == "COMPLETED") & (F.size(schemas) == 0),
            "unexpected output": F.size(F.array_except(schemas, expected)) > 0,
        },
        "task_id",
    )
    return union([own, bindings(rows, reviews), contents(outputs_of(rows), files)])
