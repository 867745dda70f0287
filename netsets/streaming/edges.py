"""Networks that grow: edges arrive as text files and the last weight of a pair wins, as in a file read at once.

The kept network is a folder of versions, one per micro-batch. A batch reads the newest version below its own number and writes its
own, so a batch that is run again after a failure gives the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edge_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """u, v, w of lines `u v w` (weight 1 without a third field) of the files that arrive in a folder."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).where(F.size(f) >= 2)
    return lines.select(f[0].alias("u"), f[1].alias("v"), F.coalesce(F.try_element_at(f, F.lit(3)).cast("double"), F.lit(1.0)).alias("w"))


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the finished versions: those with the mark that Spark's writer leaves last."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, table: str, below: int | None = None) -> DataFrame | None:
    """The newest version (under `below`, if given), or None."""
    known = [v for v in _versions(spark, table) if below is None or v < below]
    return spark.read.parquet(f"{table}/v={known[-1]}") if known else None


def keep_latest(edges: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merges the stream into the table's versions; ends when what has arrived is merged, unless told to run on."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, table, number)
        new = batch.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w", F.monotonically_increasing_id().alias("at"))
        both = new if old is None else new.unionByName(old.withColumn("at", F.lit(-1).cast("long")))
        both.groupBy("u", "v").agg(F.max_by("w", "at").alias("w")).write.mode("overwrite").parquet(f"{table}/v={number}")

    out = edges.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
