"""The dashboard's filters. They narrow the tables that the headline operators read, so every one of these accepts them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.controls import ISSUES, issue_kinds
from tallyline.functions.period import Period, narrow
from tallyline.operators.snapshots import latest_batch

BATCH = ("rpt_grp_id", "batch_id")
OF_HITS = ("rule_id", "source", "mtcn", "external_txn_key", "galactic_id")


@dataclass(frozen=True)
class Filters:
    """One value each; None does not filter. ``source`` is the system a hit came from, ``stage`` one of the journey."""

    rpt_grp_id: int | None = None
    batch_id: str | None = None
    batch_status: str | None = None
    issue_type: str | None = None
    stage: str | None = None
    country: str | None = None
    rule_id: str | None = None
    source: str | None = None
    mtcn: str | None = None
    external_txn_key: int | None = None
    galactic_id: str | None = None

    def __post_init__(self) -> None:
        if self.issue_type is not None and self.issue_type not in ISSUES:
            raise ValueError(f"unknown issue type {self.issue_type}")

    def chosen(self) -> dict[str, object]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}


def _table(given: DataFrame | None, name: str, why: str) -> DataFrame:
    if given is None:
        raise ValueError(f"the filter on {why} needs the table {name}")
    return given


def filtered_batches(
    recon: DataFrame,
    p: Period | None,
    f: Filters,
    *,
    batch_info: DataFrame | None = None,
    hits: DataFrame | None = None,
    journey: DataFrame | None = None,
    config: DataFrame | None = None,
) -> DataFrame:
    """Latest snapshots of the period's batches that pass all filters; pass it to any operator in place of the table.

    Status and issue are those of the latest snapshot, so an older one never brings a batch back. A batch passes the
    hit filters (rule, source and the transaction keys) if one of its hits meets all of them, hits being bridged to
    batches by ``efile_batch_id`` within the group; it passes a stage if one of its transactions has a row there.
    Batches of groups without configuration pass no country. Only the tables the chosen filters need must be given.

    The other tables are reduced to distinct batch keys before they meet the batches, so a rule or a stage that
    holds most rows costs a task one row per batch.
    """
    out = latest_batch(recon, p, f.rpt_grp_id, f.batch_id)
    if f.issue_type is not None:
        out = out.filter(issue_kinds()[f.issue_type])
    if f.country is not None:
        out = out.join(_groups_of(f.country, config), "rpt_grp_id", "left_semi")
    if f.batch_status is not None:
        info = narrow(_table(batch_info, "batch_info", "batch status"), rpt_grp_id=f.rpt_grp_id, batch_id=f.batch_id, batch_status=f.batch_status)
        out = out.join(info.select(*BATCH, "seq_no").distinct(), [*BATCH, "seq_no"], "left_semi")
    wanted = {k: v for k, v in f.chosen().items() if k in OF_HITS}
    if wanted:
        met = narrow(_table(hits, "hits", "/".join(wanted)), rpt_grp_id=f.rpt_grp_id, efile_batch_id=f.batch_id, **wanted)
        out = out.join(met.select("rpt_grp_id", F.col("efile_batch_id").alias("batch_id")).distinct(), list(BATCH), "left_semi")
    if f.stage is not None:
        met = narrow(_table(journey, "journey", "stage"), rpt_grp_id=f.rpt_grp_id, batch_id=f.batch_id, stage=f.stage)
        out = out.join(met.select(*BATCH).distinct(), list(BATCH), "left_semi")
    return out


def filtered_recon(recon: DataFrame, f: Filters, *, config: DataFrame | None = None) -> DataFrame:
    """Rule-hit reconciliation rows that pass the group and the country; its rows know no batch, so nothing else applies."""
    out = narrow(recon, rpt_grp_id=f.rpt_grp_id)
    return out if f.country is None else out.join(_groups_of(f.country, config), "rpt_grp_id", "left_semi")


def _groups_of(country: str, config: DataFrame | None) -> DataFrame:
    return narrow(_table(config, "config", "country"), country_name=country).select("rpt_grp_id")
