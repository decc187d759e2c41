"""The job journal: states, outcomes and rules.

journal: ledger_id, sequence, event_id, event_type, event_digest, job_id,
task_id, key (idempotency), request (digest), state (terminal), reason,
expected_revision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.digest import PREFIX, deterministic_id, json_digest_of, list_digest
from tallyfold.operators.chain import union, violations

# Fixed values of the journal: its states that end a job.
TERMINAL = ["SUCCEEDED", "FAILED", "CANCELLED", "TIMED_OUT", "LOST"]


def _steps(journal: DataFrame) -> DataFrame:
    """Rows that change a job's state, with the state they lead to."""
    t = F.col("event_type")
    to = F.when(t == "job.submitted", "SUBMITTED").when(t == "job.queued", "QUEUED").when(t == "job.cancellation_requested", "CANCEL_REQUESTED").when(t == "job.terminal", F.col("state"))
    return journal.withColumn("to", to).where("to is not null")


def states(journal: DataFrame) -> DataFrame:
    """Per job: state, revision, and the terminal row if it has one."""
    end = F.when(F.col("event_type") == "job.terminal", F.struct("sequence", "event_id", "event_digest", "reason"))
    return _steps(journal).groupBy("ledger_id", "job_id").agg(F.max_by("to", "sequence").alias("state"), F.count("*").alias("revision"), F.max(end).alias("_end")).select("ledger_id", "job_id", "state", "revision", F.col("_end.event_id").alias("terminal_event_id"), F.col("_end.event_digest").alias("terminal_event_digest"), F.col("_end.reason").alias("terminal_reason"))


def broken_rules(journal: DataFrame) -> DataFrame:
    """ledger_id, sequence, object_id, rule of each journal row that breaks a rule."""
    epoch = F.col("event_type") == "executor.epoch-started"
    least = journal.groupBy("ledger_id").agg(F.min("sequence").alias("_least"))
    known = ["executor.epoch-started", "job.submitted", "job.queued", "job.cancellation_requested", "job.cancellation_observed", "job.terminal"]
    shape = violations(journal.join(least, "ledger_id"), {"epoch": epoch != (F.col("sequence") == F.col("_least")), "unknown type": ~F.col("event_type").isin(known)}, "event_id")
    w = Window.partitionBy("ledger_id", "job_id").orderBy("sequence")
    t = F.col("event_type")
    moved = F.when(t == "job.submitted", "SUBMITTED").when(t == "job.queued", "QUEUED").when(t == "job.cancellation_requested", "CANCEL_REQUESTED").when(t == "job.terminal", F.col("state"))
    before = F.last(moved, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    changes = F.count(moved).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = journal.where("job_id is not null").withColumn("_b", before).withColumn("_r", changes)
    b, over = F.col("_b"), F.coalesce(F.col("_b").isin(TERMINAL), F.lit(False))
    order = violations(
        rows,
        {
            "submitted twice": (t == "job.submitted") & b.isNotNull(),
            "unknown job": (t != "job.submitted") & b.isNull(),
            "queued from another state": (t == "job.queued") & b.isNotNull() & (b != "SUBMITTED"),
            "cancel after the end": (t == "job.cancellation_requested") & over,
            "observed before the end": (t == "job.cancellation_observed") & b.isNotNull() & ~over,
            "ended twice": (t == "job.terminal") & over,
            "no end state": (t == "job.terminal") & ~F.coalesce(F.col("state").isin(TERMINAL), F.lit(False)),
            "cancelled job ended otherwise": (t == "job.terminal") & (b == "CANCEL_REQUESTED") & (F.col("state") != "CANCELLED"),
            "other revision": (t == "job.cancellation_requested") & F.col("expected_revision").isNotNull() & (F.col("expected_revision") != F.col("_r")),
        },
        "event_id",
    )
    return union([shape, order, repeated_keys(journal)])


def repeated_keys(journal: DataFrame) -> DataFrame:
    """Submissions and cancellations that use a key again: with the same request a replay is refused, with another it conflicts."""
    start = journal.where("event_type = 'job.submitted'").withColumn("_scope", F.struct(F.lit("s").alias("k"), F.col("task_id").alias("of"), "key"))
    stop = journal.where("event_type in ('job.cancellation_requested', 'job.cancellation_observed')").withColumn("_scope", F.struct(F.lit("c").alias("k"), F.col("job_id").alias("of"), "key"))
    rows = start.unionByName(stop)
    first = rows.groupBy("ledger_id", "_scope").agg(F.min(F.struct("sequence", "request")).alias("_f"))
    again = rows.join(first, ["ledger_id", "_scope"]).where("sequence > _f.sequence")
    return violations(again, {"key used twice": F.col("request").eqNullSafe(F.col("_f.request")), "key conflict": ~F.col("request").eqNullSafe(F.col("_f.request"))}, "event_id")


# Fixed texts that ids of jobs are made with.
_KEY, _JOB = "execution-start-idempotency-key/1.0", "execution-job-id/1.0"


def job_id(task_id: Column, key: Column) -> Column:
    """The id that a task's job has for an idempotency key."""
    return deterministic_id("JB-", F.lit(_JOB), task_id, F.concat(F.lit(PREFIX), list_digest(F.lit(_KEY), key)))


def outcomes(journal: DataFrame, schema: str) -> DataFrame:
    """Ended jobs, with an id that follows from the outcome's schema text, the job and the digest of its last event."""
    ended = states(journal).where(F.col("state").isin(TERMINAL))
    return ended.withColumn("outcome_id", deterministic_id("OJ-", F.lit(schema), F.col("job_id").cast("string"), F.col("terminal_event_digest").cast("string")))


def observed(rows: DataFrame, after: int, through: int, limit: int) -> DataFrame:
    """A page of rows: later than `after`, not later than `through`, which stays fixed while the table grows."""
    return rows.where((F.col("sequence") > after) & (F.col("sequence") <= through)).orderBy("sequence").limit(limit)


MOST_OBSERVED = 256
# Fixed names of a cursor's members, of which its digest is made.
CURSOR = ("job_id", "last_returned_sequence", "through_event_sigil", "through_journal_sequence")


def cursor_digest(cursor: dict) -> str:
    return json_digest_of({k: cursor[k] for k in CURSOR})


def observe(journal: DataFrame, ledger_id: str, job_id: str, limit: int = MOST_OBSERVED, cursor: dict | None = None) -> tuple[DataFrame, dict | None]:
    """A page of a job's events, and the cursor of the next one, or None where there is none.

    Without a cursor the page reads up to the journal's last event; a cursor
    holds that bound and its digest, so pages stay those of one moment while the
    journal grows.  A cursor that was changed, is another job's, or whose bound
    is no longer the event that it was, is refused.  Only two rows and the page
    come to the driver.
    """
    if not 1 <= limit <= MOST_OBSERVED:
        raise ValueError(f"limit must be in 1..{MOST_OBSERVED}")
    own = journal.where(F.col("ledger_id") == ledger_id)
    if own.where((F.col("job_id") == job_id) & (F.col("event_type") == "job.submitted")).isEmpty():
        raise ValueError(f"unknown job: {job_id}")
    if cursor is None:
        last, (through, digest) = 0, own.agg(F.max(F.struct("sequence", "event_digest")).alias("e")).first()["e"]
    else:
        if set(cursor) != {*CURSOR, "cursor_sigil"} or cursor["cursor_sigil"] != cursor_digest(cursor) or cursor["job_id"] != job_id:
            raise ValueError("the cursor is stale")
        last, through, digest = cursor["last_returned_sequence"], cursor["through_journal_sequence"], cursor["through_event_sigil"]
        bound = own.where(F.col("sequence") == through).select("event_digest").first()
        if not 0 <= last <= through or bound is None or bound[0] != digest:
            raise ValueError("the cursor is stale")
    rest = observed(own.where(F.col("job_id") == job_id), last, through, limit + 1)
    found = [r["sequence"] for r in rest.select("sequence").collect()]
    following = None
    if len(found) > limit:
        following = {"job_id": job_id, "last_returned_sequence": found[limit - 1], "through_journal_sequence": through, "through_event_sigil": digest}
        following["cursor_sigil"] = cursor_digest(following)
    return observed(own.where(F.col("job_id") == job_id), last, found[:limit][-1] if found else last, limit), following
