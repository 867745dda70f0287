"""What the training-data operators share: lineage cuts, the shared folder, Arrow mapping."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsets.plans.lineage import cut, shared_dir

__all__ = ["WORD", "cut", "fresh_path", "give_back", "map_batches", "read", "returning", "shared_dir", "small_batches", "text_of"]

#: A word as the contracts count it: code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def give_back() -> None:
    """Memory that the process holds but does not use goes back to the system: idle workers stay beside the executor's next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and give back memory when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Rows that Spark hands to Python at once: texts are long, and every batch is held several times over.
ROWS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands Python at most ROWS_PER_BATCH rows at once in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Applies a batch function; `make` runs once per task, so caches live as long as the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(returning(run), schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
