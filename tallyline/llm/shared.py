"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="tallyline-llm-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them back.

    Later steps start from the files, so a lost executor costs only its own tasks and loops do not grow the plan.
    """
    spark = df.sparkSession
    path = new_path(spark, purpose)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables of ``saved`` once all that was made of them is written itself; other frames are left alone."""
    for df in tables:
        path = getattr(df, "saved_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
