"""All states at once: inventory, availability, evidence, decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import catalog, status


def latest_evidence(runs: DataFrame, key: str = "state", order: str = "run_id") -> DataFrame:
    """The newest run per state, gated: complete, its metrics, or what is missing."""
    newest = catalog.first_rows(runs, [key], order, last=True)
    return status.evidence_gate(newest).select(
        key, F.col("complete").alias("evidence_complete"), F.col("problems").alias("evidence_missing"),
        "pr_auc", "roc_auc",
    )


def state_sweep(events: DataFrame, states: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """One report row per state. states: state, is_pilot and the administrative edges."""
    inventory = catalog.inventory_quality(events, states.drop("is_pilot"))
    ready = (
        states.select("state", "is_pilot")
        .join(inventory, "state", "left")
        .join(status.availability(states, files), "state", "left")
        .join(latest_evidence(runs), "state", "left")
    )
    report = status.status_decision(ready)
    proven = F.col("overall_status") == "VALIDATED_PILOT"
    return report.withColumns({
        "pr_auc": F.when(proven, F.col("pr_auc")), "roc_auc": F.when(proven, F.col("roc_auc")),
    }).drop("evidence_complete", "evidence_missing")
