"""Old ledgers into the new form, with what shows that it was done rightly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import state
from tallyfold.operators.chain import audit_events, audit_old, seal_events
from tallyfold.operators.lineage import kept
from tallyfold.sources.ledger import parse


def converted(events: DataFrame, actor: str) -> dict[str, DataFrame]:
    """refused (ledger_id, sequence, rule, ... of old ledgers that break a chain rule), lines (the sound ones in the new form, see seal_events()), unsound (chain breaches of these, none if all went well).

    The old events are audited once, and the new lines sealed once; both are cut
    to files that the rest reads.
    """
    refused = kept(audit_old(events))
    bad = refused.select("ledger_id").distinct()
    rows = events.join(bad, "ledger_id", "left_anti").withColumnRenamed("sequence", "line")
    rows = rows.select("ledger_id", "line", "event_id", "type", "object_id", "occurred_at", F.lit(actor).alias("actor"), "payload", F.col("receipt.receipt_id").alias("receipt_id"))
    lines = kept(seal_events(rows, ["line"]))
    return {"refused": refused, "lines": lines, "unsound": audit_events(parse(lines.select("ledger_id", "raw")))}


def state_proof(events: DataFrame, lines: DataFrame) -> DataFrame:
    """State tables in which converted ledgers differ from the old events (see state.state_changes()); none proves that all are the same."""
    after = parse(lines.select("ledger_id", "raw"))
    before = events.join(lines.select("ledger_id").distinct(), "ledger_id", "left_semi")
    return state.state_changes(before, after)
