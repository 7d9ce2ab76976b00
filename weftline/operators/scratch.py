"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (local master, as in tests), a fresh temporary
    folder is made and recorded in the session. On a cluster that would be another folder on every machine,
    so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.weftline.scratch", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.weftline.scratch", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; nothing exists there yet."""
    return f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    This cuts the lineage in a way that outlives executors, and makes several later readers of one
    intermediate result read the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
