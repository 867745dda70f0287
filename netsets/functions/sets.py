"""Column expressions over set sizes and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(both: Column, a: Column, b: Column) -> Column:
    return both / (a + b - both)


def bader(both: Column, a: Column, b: Column) -> Column:
    """Squared overlap over the product of the sizes."""
    return (both * both) / (a * b)


def size_aware_match(both: Column, a: Column, b: Column, small: int = 3) -> Column:
    """Two small sets match only if equal, a small and a large one never do, others by their Jaccard index."""
    equal = ((both == a) & (both == b)).cast("double")
    return F.when((a <= small) & (b <= small), equal).when((a <= small) | (b <= small), F.lit(0.0)).otherwise(jaccard(both, a, b))


def array_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def f2_score(p: Column, r: Column, standard: bool = False) -> Column:
    """The published pipeline's form, 4pr / (5p + r); standard=True gives 5pr / (4p + r)."""
    num, den = (5 * p * r, 4 * p + r) if standard else (4 * p * r, 5 * p + r)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))
