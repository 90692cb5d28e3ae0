"""Set operations on tables and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def chain_arrays(a: Column, a_reversed: Column, b: Column, b_reversed: Column) -> Column:
    """Two arrays end to end, each turned round if its flag is set."""
    return F.concat(F.when(a_reversed, F.reverse(a)).otherwise(a), F.when(b_reversed, F.reverse(b)).otherwise(b))


def renumbered(groups: list[DataFrame], name: str = "lg") -> DataFrame:
    """Outputs of several groups under one numbering LG01, LG02, ..."""
    out = None
    for i, df in enumerate(groups, 1):
        part = df.withColumn(name, F.lit(f"LG{i:02d}"))
        out = part if out is None else out.unionByName(part)
    return out
