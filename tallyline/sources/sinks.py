"""Writing results: CSV, JSON rows, partition overwrite, and upserts from streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.snapshots import latest


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach.

    It lies under ``spark.checkpoint.dir``, which the cluster names. Only where that is
    unset, as in local tests, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tallyline-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV folder with a header, written by all tasks in parallel."""
    df.write.mode("overwrite").csv(path, header=True)


def json_rows(df: DataFrame, section: str) -> DataFrame:
    """Each row as a JSON object under a section name; null fields stay in the object."""
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.lit(section).alias("section"), body.alias("result"))


def json_report(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections of a check as JSON rows."""
    out = None
    for name, df in sections.items():
        rows = json_rows(df, name)
        out = rows if out is None else out.unionByName(rows)
    return out


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace only the partitions the rows belong to; a large one is split by its size at run time."""
    (
        df.hint("rebalance", *[F.col(c) for c in columns])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )


class UpsertLog:
    """A table fed by a stream's micro-batches, where a later batch replaces earlier rows by key.

    Each batch is written to its own folder and overwrites it when Spark repeats the batch,
    so a retry after a lost executor or driver leaves the same content. Readers take the
    newest row per key. Where the rows have a column ``live``, one in which it is false takes its key out.
    """

    def __init__(self, path: str, keys: tuple[str, ...], newest: tuple[str, ...] = ()):
        self.path, self.keys, self.newest = path, keys, newest

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/_seq={batch_id}")

    def versions(self, spark: SparkSession) -> DataFrame:
        """All rows of all batches, with the number of the batch in ``_seq``."""
        return spark.read.option("basePath", self.path).parquet(self.path)

    def _newest(self, spark: SparkSession) -> DataFrame:
        rows = self.versions(spark)
        marked = ("live",) if "live" in rows.columns else ()
        rows = latest(rows, self.keys, ("_seq", *self.newest, *marked)).drop("_seq")
        return rows.filter("live") if marked else rows

    def read(self, spark: SparkSession) -> DataFrame:
        return self._newest(spark).drop("live")

    def compact(self, spark: SparkSession, target: str) -> UpsertLog:
        """Write the current content as one batch of a new log."""
        self._newest(spark).write.mode("overwrite").parquet(f"{target}/_seq=-1")
        return UpsertLog(target, self.keys, self.newest)
