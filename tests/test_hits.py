from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tallyline.functions.period import Period
from tallyline.operators import hits, metrics
from tests.conftest import at, one, rows_of


def hit(n: int, **kw) -> dict:
    row = dict(
        rpt_grp_id=1, rpt_grp_name="g", bucket_id=0, rule_id="R1", attempt_id=n, external_txn_key=n, mtcn=f"m{n}",
        transaction_date=at(2026, 6, 10), rule_currency_amount=Decimal("1.50"), rule_iso_currency_code="USD",
    )
    return row | kw


def test_report_at_the_end_plus_one_day_is_still_open(make, june):
    t = make(
        "rule_hit",
        [
            hit(1, reporting_timestamp=at(2026, 6, 30, 23, 59, 59)),
            hit(2, reporting_timestamp=at(2026, 7, 1)),
            hit(3),
            hit(4, exclusion_reason_id="x"),
            hit(5, transaction_date=at(2026, 7, 1)),
        ],
    )
    got = one(hits.weekly_reporting_health(t, june))
    assert got == dict(total_rule_hits=4, excluded_hits=1, requires_reporting=3, reported_hits=1, still_open=2, reported_pct=33.33)
    bal = one(hits.cohort_balance(t, june))
    assert bal["rule_hit_balance_diff"] == 0 and bal["reporting_balance_diff"] == 0


def test_age_bands_hold_both_their_ends(make, june):
    ages = [0, 3, 4, 7, 8, 14, 15, 30, 31, 400]
    t = make("rule_hit", [hit(a, transaction_date=at(2026, 6, 30, 12) - timedelta(days=a)) for a in ages])
    got = one(hits.open_backlog_aging(t, june))
    assert [got[f"open_{b}_days"] for b in ("0_3", "4_7", "8_14", "15_30", "30_plus")] == [2] * 5
    assert got["total_open_backlog"] == 10 and got["oldest_open_days"] == 400
    assert rows_of(hits.age_bands(t, june), "open_hits") == [(2,)] * 5
    assert one(hits.group_backlog_health(t, june))["open_over_30_days"] == 2


def test_keys_are_compared_as_text(make):
    t = make("rule_hit", [hit(1), hit(2, mtcn="m1"), hit(3)])
    assert rows_of(hits.rule_hit_detail(t, external_txn_key="3"), "attempt_id") == [(3,)]
    assert rows_of(hits.rule_hit_detail(t, mtcn="m1", external_txn_key="3"), "attempt_id") == [(1,), (2,), (3,)]
    assert hits.rule_hit_detail(t, external_txn_key="B-1").count() == 0


def test_rules_are_found_through_the_efile_batch(make):
    t = make("rule_hit", [hit(1, batch_id=7, efile_batch_id="B", is_reported=True), hit(2, batch_id=7), hit(3, efile_batch_id="B")])
    got = one(hits.rule_breakdown(t, 1, "B"))
    assert (got["rule_hits"], got["reported"], got["not_reported"]) == (2, 1, 0)


def test_currencies_beyond_the_top_are_mixed_without_an_amount(make, june):
    codes = ["USD"] * 4 + ["EUR"] * 3 + ["GBP"] * 2 + ["JPY", "MXN"]
    t = make("rule_hit", [hit(i, rule_iso_currency_code=c) for i, c in enumerate(codes)])
    got = {r.currency: (r.open_hits, r.open_amount) for r in metrics.open_value_by_currency(t, june).collect()}
    assert got == {
        "USD": (4, Decimal("6.00")), "EUR": (3, Decimal("4.50")), "GBP": (2, Decimal("3.00")), "mixed": (2, None)
    }


def test_percentile_of_counts_equals_percentile_of_rows(make, june):
    lags = [0, 0, 1, 1, 1, 5, 9, 30]
    t = make("rule_hit", [hit(i, reporting_timestamp=at(2026, 6, 10) + timedelta(days=d)) for i, d in enumerate(lags)])
    got = one(metrics.report_lag(t, june))
    assert (got["median_days"], got["p95_days"], got["reported_hits"]) == (1.0, 22.65, 8)


def test_pages_of_the_drill_follow_each_other(make, june):
    # Rows 0 and 3 differ in the attempt only.
    t = make("rule_hit", [hit(i, transaction_date=at(2026, 6, 1 + i % 3), external_txn_key=i // 4) for i in range(10)])
    whole = [tuple(r) for r in metrics.open_hits_drill(t, june).collect()]
    seen, cursor = [], None
    while True:
        page = metrics.open_hits_drill(t, june, page_size=4, after=cursor).collect()
        seen += [tuple(r) for r in page]
        if len(page) < 4:
            break
        cursor = tuple(page[-1][c] for c in metrics.DRILL_ORDER)
    assert seen == whole and len(seen) == 10


# Totals of the published month that must tie out.
TOTAL, EXCLUDED, REPORTED, OPEN = 1245678, 143333, 1092458, 9887


def test_published_totals_tie_out(spark):
    p = Period(date(2026, 6, 1), date(2026, 6, 30))
    i = F.col("id")
    t = spark.range(TOTAL).select(
        (i % 25).cast("int").alias("rpt_grp_id"),
        F.when(i < EXCLUDED, "x").alias("exclusion_reason_id"),
        F.when((i >= EXCLUDED) & (i < EXCLUDED + REPORTED), F.lit(at(2026, 6, 20))).alias("reporting_timestamp"),
        F.lit(at(2026, 6, 10)).alias("transaction_date"),
    )
    with_null = t.union(t.limit(3).withColumn("rpt_grp_id", F.lit(None).cast("int")))
    for rows in (t, with_null, t.limit(0)):
        checks = metrics.tie_out(rows, p)
        assert checks.count() == 13 and checks.filter("NOT passed").count() == 0
    shown = metrics.group_breakdown(t, p)
    wrong = shown.withColumn("reported", F.when(F.col("rpt_grp_id") == 3, F.col("reported") - 1).otherwise(F.col("reported")))
    assert rows_of(metrics.tie_out(t, p, wrong).filter("NOT passed"), "check") == [("groups reported",)]
    total = one(shown.filter("is_total"))
    assert (total["total_rule_hits"], total["excluded"], total["requires_reporting"]) == (TOTAL, EXCLUDED, REPORTED + OPEN)
    assert (total["reported"], total["still_open"], total["reported_pct"]) == (REPORTED, OPEN, 99.1)
