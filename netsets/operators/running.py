"""Running totals and line numbers without an ordered list of all rows in one task: ranges in order, and the totals before each.

Only the totals of ranges meet in one task: a row a range, and their number is fixed by the settings, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsets.plans.lineage import cut

RANGE = "_range"


def _before(totals: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, range and for each column its total over the ranges before."""
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, RANGE, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns])


def _placed(dealt: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, RANGE]
    renamed = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in before.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return dealt.join(renamed, on).drop(*[f"_k{i}" for i in range(len(keys))])


def running(rows: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """rows with through_<column>: its total over all rows of the group with the same or a higher `order`, which is distinct in a group."""
    dealt = cut(rows.repartitionByRange(*by, F.desc(order)).withColumn(RANGE, F.spark_partition_id()))
    totals = dealt.groupBy(*by, RANGE).agg(*[F.sum(c).alias(c) for c in columns])
    upto = Window.partitionBy(*by, RANGE).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = _placed(dealt, _before(totals, by, columns), by)
    out = inside.select(*rows.columns, *[(F.sum(c).over(upto) + F.col(f"_before_{c}")).alias(f"through_{c}") for c in columns])
    return out


def _ranges_of_lines(rows: DataFrame, at: str) -> DataFrame:
    """The reader's partitions, which hold a file's lines in order; a line's number says which is its."""
    return rows.withColumn(RANGE, F.shiftright(at, 33))


def numbered(rows: DataFrame, at: str = "at", name: str = "n") -> DataFrame:
    """rows with their number, from 1, in the order of `at`, which is monotonically_increasing_id at the time of reading."""
    dealt = _ranges_of_lines(rows, at)
    totals = dealt.groupBy(RANGE).agg(F.count(F.lit(1)).alias(name))
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(at))
    placed = _placed(dealt, _before(totals, [], [name]), [])
    return placed.select(*rows.columns, (inside + F.col(f"_before_{name}")).alias(name))


def under_headers(rows: DataFrame, is_header: Column, value: Column, at: str = "at", name: str = "head") -> DataFrame:
    """The rows that are no headers, each with the value and the place of the last header above it."""
    dealt = _ranges_of_lines(rows, at).withColumn("_own", F.when(is_header, F.struct(F.col(at).alias("place"), value.alias("value"))))
    last = dealt.groupBy(RANGE).agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col(at))).alias("_last"))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    above = last.select(RANGE, F.last("_last", ignorenulls=True).over(earlier).alias("_above"))
    upto = Window.partitionBy(RANGE).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = _placed(dealt, above, []).withColumn(name, F.coalesce(F.last("_own", ignorenulls=True).over(upto), F.col("_above")))
    return found.where(F.col("_own").isNull()).select(*rows.columns, F.col(f"{name}.value").alias(name), F.col(f"{name}.place").alias(f"{name}_at"))
