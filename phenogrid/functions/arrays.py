"""Statistics of short arrays, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    high = F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def array_mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), F.size(a))


def array_std_pop(a: Column) -> Column:
    m = array_mean(a)
    return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)), F.size(a)))
