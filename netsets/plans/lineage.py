"""Cutting lineage in loops: checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session, whose tasks share the driver's machine, may do without and gets a temporary folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="netsets-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder from now on; lost executors lose nothing of them, and later plans begin here.

    A checkpoint keeps the ordering and the constraints of the plan that it replaces, and rounds of joins and renamed columns multiply
    both until planning takes minutes. So its rows become a relation that knows their types alone.
    """
    spark = df.sparkSession
    shared_dir(spark)
    held = df.checkpoint(eager=True)
    rows = held._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, held._jdf.schema(), False), spark)


#: Rows of a side that is sent to every task after counting them.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, computed once, and sent to every task if it has no more than SMALL_ROWS rows; a larger one is joined as Spark plans it."""
    held = cut(df)
    return F.broadcast(held) if held.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else held
