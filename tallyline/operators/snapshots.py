"""Latest-state selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tallyline.functions.period import Period, narrow

NEWEST = ("seq_no", "modified_timestamp", "created_timestamp")


def latest(df: DataFrame, keys: tuple[str, ...], newest: tuple[str, ...] = NEWEST) -> DataFrame:
    """The newest row per key; nulls sort as oldest.

    Rows that tie on ``newest`` are told apart by their other columns, in the order of the table, greatest first, so
    the answer never depends on the order of reading.

    ``row_number() = 1`` plans as a partial WindowGroupLimit before the shuffle, so a
    task sends one row per key however many versions it read.
    """
    others = [f.name for f in df.schema.fields if f.name not in (*keys, *newest) and not isinstance(f.dataType, (MapType, VariantType))]
    order = [F.desc_nulls_last(c) for c in (*[c for c in newest if c in df.columns], *others)]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") == 1).drop("_rn")


def latest_batch(
    recon: DataFrame, p: Period | None, rpt_grp_id: int | None = None, batch_id: str | None = None
) -> DataFrame:
    """Latest snapshot per (group, batch) among those created in the period.

    The period comes first on purpose: a later snapshot outside it must not hide the
    one inside, and Spark would not move this filter below the window by itself.
    """
    if p is not None:
        recon = recon.filter(p.holds("created_timestamp"))
    return latest(narrow(recon, rpt_grp_id=rpt_grp_id, batch_id=batch_id), ("rpt_grp_id", "batch_id"))


def latest_recon(
    recon: DataFrame, p: Period, rpt_grp_id: int | None = None, anchor: str = "run_date"
) -> DataFrame:
    """Latest snapshot per (group, run date); the period applies to the chosen anchor."""
    inside = p.holds_run_date() if anchor == "run_date" else p.holds(anchor)
    return latest(narrow(recon.filter(inside), rpt_grp_id=rpt_grp_id), ("rpt_grp_id", "run_date"))


def latest_stage(journey: DataFrame, rpt_grp_id: int | None = None, batch_id: str | None = None) -> DataFrame:
    """Latest state per (group, batch, transaction, stage)."""
    return latest(
        narrow(journey, rpt_grp_id=rpt_grp_id, batch_id=batch_id),
        ("rpt_grp_id", "batch_id", "identifier", "stage"),
        ("modified_timestamp", "created_timestamp"),
    )


def upsert_latest(
    current: DataFrame, changes: DataFrame, keys: tuple[str, ...], newest: tuple[str, ...] = ("modified_timestamp",)
) -> DataFrame:
    """Table content after an upsert: a change replaces the row of its key.

    Among changes to one key the newest wins; any change beats the stored row. Only the changes are ordered; the
    stored rows are passed on, save those a change replaces. Keys hold no nulls.
    """
    kept = current.join(changes.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(latest(changes, keys, newest), allowMissingColumns=True)
