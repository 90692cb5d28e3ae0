"""Aggregations: label histograms, allele fractions, jump rates, accuracy, genotype classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def label_histogram(df: DataFrame, run: list[str], label: str) -> DataFrame:
    return df.groupBy(*run, label).agg(F.count("*").alias("n"))


def label_skew(df: DataFrame, run: list[str], label: str) -> DataFrame:
    """Largest and smallest label count of each run, relative to their mean."""
    return label_histogram(df, run, label).groupBy(*run).agg(F.count("*").alias("labels"), (F.max("n") / F.avg("n")).alias("max_skew"), (F.min("n") / F.avg("n")).alias("min_skew"))


def modal(df: DataFrame, value: Column, part: list[str] | None = None) -> DataFrame:
    """The most frequent value (of each group); ties go to the smallest."""
    part = part or []
    counts = df.groupBy(*part, value.alias("value")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*part).orderBy(F.desc("n"), "value")
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def allele_fraction(a: Column, b: Column) -> Column:
    """Sum of b over the sum of both; one half if either is zero."""
    x, y = F.sum(a), F.sum(b)
    return F.when((x == 0) | (y == 0) | x.isNull() | y.isNull(), F.lit(0.5)).otherwise(F.try_divide(y, x + y))


def jump_rate(df: DataFrame, run: list[str], pair: list[str], jump: str) -> DataFrame:
    """Mean over runs of each run's part of haplotypes that change between two markers."""
    own = df.groupBy(*run, *pair).agg(F.avg(jump).alias("_rate"))
    return own.groupBy(*pair).agg(F.avg("_rate").alias("rate"), F.count("*").alias("runs"))


def best_of(df: DataFrame, part: list[str], counts: list[str], ties: list[str]) -> DataFrame:
    """The row of each group with the largest of its counts, then the largest sum, then the smallest ``ties``."""
    order = Window.partitionBy(*part).orderBy(F.desc(F.greatest(*counts)), F.desc(sum(F.col(c) for c in counts)), *ties)
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def accuracy(matched: Column, compared: Column) -> Column:
    return F.try_divide(F.sum(matched), F.sum(compared))


def weighted_log_likelihood(df: DataFrame, run: list[str], role: str, loglik: str, progeny: int, field: str) -> DataFrame:
    """Sum over samples; with genotype calls a parent weighs as half of the progeny."""
    weight = F.when(F.col(role) < 2, progeny / 2 if field == "GT" else 1.0).otherwise(1.0)
    return df.groupBy(*run).agg(F.sum(weight * F.col(loglik)).alias("loglik"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"))


def genotype_classes(df: DataFrame, site: list[str], dosage: str, depth: str, classes: list[int]) -> DataFrame:
    """Calls of each class, all calls and the summed depth of each site."""
    by_class = [F.sum(F.when(F.col(dosage) == k, 1).otherwise(0)).alias(f"class_{k}") for k in classes]
    return df.groupBy(*site).agg(*by_class, F.count(dosage).alias("called"), F.sum(depth).alias("depth"))


def bins(length: Column, edges: list[int]) -> Column:
    """Number of the fixed bin: how many edges are at or below the length."""
    return sum(((length >= e).cast("int") for e in edges), F.lit(0)).cast("long")


def log_sum_exp(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """ln of the sum of exponentials of a group, from its largest value; both passes are partial sums."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    return df.join(top, keys).groupBy(*keys).agg((F.first("_top") + F.ln(F.sum(F.exp(F.col(value) - F.col("_top"))))).alias(name))
