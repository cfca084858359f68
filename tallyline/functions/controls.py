"""Control equations over batch rows, and the health labels built on them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each control says that the first column equals the sum of the others.
EQUATIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "reportable": ("expected_reportable_txn", ("actual_reportable_txn",)),
    "eligibility": (
        "expected_activity_eligible_for_transformation",
        ("actual_activity_eligible_for_transformation",),
    ),
    "lookback": ("lookback_txn", ("lookback_actual_txn", "lookback_future_reporting_txn")),
    "reporting_period": (
        "reporting_period_txn",
        ("reporting_period_actual_txn", "reporting_period_future_reporting_txn"),
    ),
    "activity": ("activity_selected", ("lookback_txn", "reporting_period_txn", "activity_simulated")),
    "transformation": (
        "actual_activity_eligible_for_transformation",
        ("activity_transformed", "activity_transformation_failed"),
    ),
    "transformation_with_dup": (
        "actual_activity_eligible_for_transformation",
        ("activity_transformed", "activity_transformation_failed", "duplicate_transformation"),
    ),
    "expected_vs_selected": ("expected_reportable_txn", ("activity_selected",)),
    "selection": (
        "txn_selected",
        ("excluded_txn", "txn_missing_attempt_count", "already_reported_count", "expected_reportable_txn"),
    ),
}

# Controls whose failure counts as an imbalance of the batch. The others are diagnostics.
VALIDATED = ("lookback", "reporting_period", "activity", "transformation")


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def gap(control: str) -> Column:
    """Difference of a control with nulls read as zero; 0 means it balances."""
    whole, parts = EQUATIONS[control]
    return zero(whole) - reduce(add, [zero(p) for p in parts])


def gap_or_null(control: str, null_parts_are_zero: bool = False) -> Column:
    """Difference of a control that is null when a side is null."""
    whole, parts = EQUATIONS[control]
    right = [zero(p) if null_parts_are_zero else F.col(p) for p in parts]
    return F.col(whole) - reduce(add, right)


def rule_hit_gap() -> Column:
    """Expected rule hits less matched and missed ones."""
    return zero("distinct_rule_hits_count_source") - (
        zero("distinct_rule_hits_count_target") + zero("missed_rule_hits_count_target")
    )


def rule_hit_publish_gap() -> Column:
    """Missed rule hits less what the published count would leave over (a rejected rule)."""
    return zero("missed_rule_hits_count_target") - (
        zero("rule_hit_publish_count_source") - zero("distinct_rule_hits_count_target")
    )


def recon_broken() -> Column:
    """The reportable or the eligibility control fails."""
    return (gap("reportable") != 0) | (gap("eligibility") != 0)


def has_failures() -> Column:
    return zero("activity_transformation_failed") > 0


def has_issue() -> Column:
    return recon_broken() | has_failures()


# The kinds of issue a batch can have.
ISSUES = ("REPORTABLE_RECON_DIFF", "ELIGIBILITY_RECON_DIFF", "TRANSFORMATION_FAILURE", "DUPLICATE_TRANSFORMATION")


def issue_kinds() -> dict[str, Column]:
    """When a batch has an issue of each kind."""
    tests = (gap("reportable") != 0, gap("eligibility") != 0, has_failures(), zero("duplicate_transformation") > 0)
    return dict(zip(ISSUES, tests, strict=True))


def any_gap(*controls: str) -> Column:
    """At least one of the controls fails."""
    return reduce(lambda a, b: a | b, [gap(c) != 0 for c in controls])


def imbalanced() -> Column:
    return any_gap(*VALIDATED)


def health(broken: str = "CRITICAL", failing: str = "NEEDS_ATTENTION", fine: str = "HEALTHY") -> Column:
    return F.when(recon_broken(), broken).when(has_failures(), failing).otherwise(fine)


def health_rank() -> Column:
    """Sort key of the label: worst first."""
    return F.when(recon_broken(), 1).when(has_failures(), 2).otherwise(3)


# Operational statuses that mean the batch failed or is still running.
FAILED_BATCH = ("Failed",)
FAILED_COMPILER = ("Data Selection Failed", "Data Transformation Failed", "Report Generation Failed")
FAILED_REPORT = ("FAILED",)
RUNNING_BATCH = ("In Progress",)
RUNNING_COMPILER = (
    "Data Selection Completed",
    "Data Transformation Started",
    "Data Transformation Completed",
    "Report Generation Started",
)


def health_five_level(
    batch_status: str = "batch_status",
    compiler_status: str = "compiler_status",
    report_status: str = "report_status",
) -> Column:
    """Failed, In Progress, Critical, Warning or Healthy; the first that applies.

    The mapping is ours and deliberately cautious: any failed status wins, a batch
    still running is never called healthy, a broken control is critical, and any
    quality counter above zero or a missing operational row is a warning.
    """
    failed = (
        F.col(batch_status).isin(*FAILED_BATCH)
        | F.col(compiler_status).isin(*FAILED_COMPILER)
        | F.col(report_status).isin(*FAILED_REPORT)
    )
    running = F.col(batch_status).isin(*RUNNING_BATCH) | F.col(compiler_status).isin(*RUNNING_COMPILER)
    counters = (
        has_failures() | (zero("duplicate_transformation") > 0) | (zero("txn_missing_attempt_count") > 0)
    )
    return (
        F.when(failed, "Failed")
        .when(running, "In Progress")
        .when(recon_broken() | imbalanced(), "Critical")
        .when(counters | F.col(batch_status).isNull(), "Warning")
        .otherwise("Healthy")
    )
