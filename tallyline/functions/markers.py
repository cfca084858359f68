"""Predicates that recognise what a journey row records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stage, status and comment texts of the journey table.
FILTRATION, TXN_JOIN, TRANSFORMATION, GENERATION = (
    "FILTRATION",
    "TRANSACTION_JOIN",
    "TRANSFORMATION",
    "REPORT_GENERATION",
)
ALREADY_REPORTED_PREFIX = "EXCLUDED_BECAUSE_ALREADY_REPORTED("
ATTEMPT_NOT_RECEIVED = "ATTEMPT_NOT_RECEIVED"
TRANSFORMATION_SKIPPED = "TRANSFORMATION_SKIPPED"
LATE_ATTEMPT_TEXT = "%not yet recorded%"
GENERATION_DONE = "Report Generation Completed"


def at(stage: str, status: str) -> Column:
    return (F.col("stage") == stage) & (F.col("status") == status)


def already_reported(system: str | None = None) -> Column:
    """Left out since it was already reported. The comment names the reporting
    system in brackets; give ``system`` to accept that one only."""
    c = F.col("comments")
    named = c.startswith(ALREADY_REPORTED_PREFIX) & c.endswith(")")
    if system is not None:
        named = c == f"{ALREADY_REPORTED_PREFIX}{system})"
    return at(FILTRATION, "EXCLUDED") & named


def missing_attempt() -> Column:
    return at(TXN_JOIN, "ERROR") & (F.col("comments") == ATTEMPT_NOT_RECEIVED)


def transformed() -> Column:
    return at(TRANSFORMATION, "SUCCESS")


def failed(skipped_only: bool = False) -> Column:
    hit = at(TRANSFORMATION, "FAILURE")
    return hit & (F.col("comments") == TRANSFORMATION_SKIPPED) if skipped_only else hit


def generated() -> Column:
    return at(GENERATION, "GENERATED")


def _status_in(*values: str) -> Column:
    return F.coalesce(F.upper("status").isin(*values), F.lit(False))


def _stage_is(value: str) -> Column:
    return F.upper("stage") == value


def join_error() -> Column:
    """An attempt that had not arrived when transactions were joined."""
    late = F.coalesce(F.col("skip_reason"), F.lit("")).ilike(LATE_ATTEMPT_TEXT)
    return _stage_is(TXN_JOIN) & (_status_in("ERROR") | late)


def join_stopped() -> Column:
    return _stage_is(TXN_JOIN) & (_status_in("ERROR", "FAILURE", "FAILED") | F.col("skip_reason").isNotNull())


def failure_status() -> Column:
    return _status_in("FAILURE", "FAILED")


def transformation_failure() -> Column:
    return _stage_is(TRANSFORMATION) & failure_status()


def needs_explaining() -> Column:
    return ~_status_in("SUCCESS") | F.col("skip_reason").isNotNull()


def reason_category() -> Column:
    """Root-cause class of a row that did not plainly succeed; first match wins."""
    return (
        F.when(join_error(), "ATTEMPT_NOT_RECEIVED")
        .when(transformation_failure(), "TRANSFORMATION_FAILURE")
        .when(F.coalesce(F.col("skip_reason"), F.lit("")) != "", "OTHER_SKIP_REASON")
        .otherwise("OTHER_FAILURE")
    )
