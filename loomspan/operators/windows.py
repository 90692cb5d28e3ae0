"""Order-dependent operators: neighbours, bounded windows, terminal majorities, offsets, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(part: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*part).orderBy(*order)


def adjacent_distance(df: DataFrame, part: list[str], order: list, pos: str) -> DataFrame:
    """``distance`` to the next row; null at the end."""
    return df.withColumn("distance", F.abs(F.lead(pos).over(ordered(part, order)) - F.col(pos)))


def adjacent_change(df: DataFrame, part: list[str], order: list, state: str) -> DataFrame:
    """``jump``: 1 where the state differs from the row before; null at the start."""
    before = F.lag(state).over(ordered(part, order))
    return df.withColumn("jump", F.when(before.isNotNull(), (before != F.col(state)).cast("int")))


def numbered(df: DataFrame, part: list[str], order: list) -> DataFrame:
    """``ix`` from 0 and ``m``, the rows of the group."""
    return df.withColumn("ix", (F.row_number().over(ordered(part, order)) - 1).cast("long")).withColumn("m", F.count("*").over(Window.partitionBy(*part)))


def forward_bound(df: DataFrame, part: list[str], pos: str, markers: int, bp: int) -> DataFrame:
    """``last``: end of the window that starts at each row of a ``numbered`` table.

    The window reaches ``markers`` rows on or to the first row at least ``bp`` away, whichever is later, but not past the
    end. ``pos`` is a long that rises with ``ix``.
    """
    far = Window.partitionBy(*part).orderBy(F.col(pos)).rangeBetween(bp, Window.unboundedFollowing)
    first_far = F.coalesce(F.min("ix").over(far), F.col("m") - 1)
    return df.withColumn("last", F.least(F.col("m") - 1, F.greatest(F.col("ix") + markers, first_far)))


def backward_bound(df: DataFrame, part: list[str], pos: str, markers: int, bp: int) -> DataFrame:
    """``first``: as ``forward_bound``, to the left."""
    far = Window.partitionBy(*part).orderBy(F.col(pos)).rangeBetween(Window.unboundedPreceding, -bp)
    last_far = F.coalesce(F.max("ix").over(far), F.lit(0).cast("long"))
    return df.withColumn("first", F.greatest(F.lit(0).cast("long"), F.least(F.col("ix") - markers, last_far)))


def terminal_majority(df: DataFrame, part: list[str], state: str, end: str, width: int = 10) -> DataFrame:
    """Majority state of the first or last rows of each group of a ``numbered`` table.

    The end has min(width, m div 2) rows, one at least. Ties go to the terminal row's own state, then to the state that
    reaches the count first when read inwards.
    """
    depth = F.col("ix") if end == "start" else F.col("m") - 1 - F.col("ix")
    size = F.greatest(F.lit(1), F.least(F.lit(width), F.expr("m div 2")))
    rows = df.withColumn("_depth", depth).where(F.col("_depth") < size)
    counts = rows.groupBy(*part, state).agg(F.count("*").alias("_n"), F.min("_depth").alias("_first"), F.max("_depth").alias("_reach"))
    order = Window.partitionBy(*part).orderBy(F.desc("_n"), F.when(F.col("_first") == 0, 0).otherwise(1), "_reach")
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*part, F.col(state).alias(f"{state}_{end}"))


def block_id(df: DataFrame, order: list, header: Column, part: list[str] | None = None) -> DataFrame:
    """``block``: number of header rows so far."""
    return df.withColumn("block", F.sum(header.cast("int")).over(Window.partitionBy(*(part or [])).orderBy(*order)))


def running_offset(df: DataFrame, part: list[str], order: list, size: Column, gap: int = 0) -> DataFrame:
    """``offset``: sizes and gaps of the rows before."""
    before = ordered(part, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size + F.lit(gap)).over(before), F.lit(0)))


def running_total(df: DataFrame, part: list[str], order: list, value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(ordered(part, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def running_share(df: DataFrame, part: list[str], order: list, value: Column, name: str) -> DataFrame:
    whole = Window.partitionBy(*part)
    return df.withColumn(name, F.sum(value).over(ordered(part, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum(value).over(whole))


def mean_from_last(df: DataFrame, part: list[str], order: str, value: Column, name: str) -> DataFrame:
    """One row a group: the mean of doubles whose sum starts at the last row by ``order`` (total, not null). A sum rounds
    by its order, and a shuffle leaves that open. Nulls don't count."""
    back = ordered(part, [F.desc(order)])
    means = df.select(*part, F.avg(value).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(name), F.lead(order).over(back).alias("_next"))
    return means.where(F.col("_next").isNull()).drop("_next")


def ranked(df: DataFrame, part: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(ordered(part, order)).cast("long"))


def top(df: DataFrame, part: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; the order must be total."""
    return ranked(df, part, order, "_rank").where(F.col("_rank") <= n).drop("_rank")


def with_ties(df: DataFrame, part: list[str], value: Column, n: int) -> DataFrame:
    """Rows up to the n-th smallest value, all that tie with it included."""
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*part).orderBy(value))).where(F.col("_rank") <= n).drop("_rank")


def slices(df: DataFrame, part: list[str], order: list, size: str, is_reversed: Column) -> DataFrame:
    """Index range (start_ix, end_ix) of each chained part, swapped where the part is reversed."""
    out = running_offset(df, part, order, F.col(size))
    lo, hi = F.col("offset"), F.col("offset") + F.col(size) - 1
    return out.withColumn("start_ix", F.when(is_reversed, hi).otherwise(lo)).withColumn("end_ix", F.when(is_reversed, lo).otherwise(hi)).drop("offset")


def reversed_index(ix: Column, m: Column) -> Column:
    return m - 1 - ix


def chained(df: DataFrame, part: list[str], order: list, position: Column, length: Column, gap: int) -> DataFrame:
    """``chain_pos``: positions of parts laid end to end with gaps. One row a part; ``position`` is relative to it."""
    return running_offset(df, part, order, length, gap).withColumn("chain_pos", F.col("offset") + position)
