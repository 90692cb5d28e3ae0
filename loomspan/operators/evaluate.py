"""Phasing accuracy against known founders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.scalar import permutation_list


def phasing_accuracy(truth: DataFrame, inferred: DataFrame, ploidy: int) -> DataFrame:
    """matched, compared, accuracy by contig, under the best matching of founder names of each parent.

    Both tables have contig, sample, marker_ix and founders (labels 1..2H). Founder names are arbitrary, and so is which
    parent is first in neither table; the largest trace over H! matchings of each parent counts.
    """
    spark = truth.sparkSession
    t = truth.select("contig", "sample", "marker_ix", F.explode("founders").alias("f"))
    g = inferred.select("contig", "sample", "marker_ix", F.explode("founders").alias("g"))
    cells = t.join(g, ["contig", "sample", "marker_ix"]).groupBy("contig", "f", "g").agg(F.count("*").alias("n"))
    parent = lambda c: F.when(F.col(c) <= ploidy, 1).otherwise(2)
    cells = cells.withColumn("parent", parent("f")).where(F.col("parent") == parent("g"))
    moves = spark.createDataFrame([(i, p * ploidy + x + 1, p * ploidy + y + 1) for p in (0, 1) for i, perm in enumerate(permutation_list(ploidy)) for x, y in enumerate(perm)], "matching int, f int, g int")
    traces = cells.withColumns({"f": F.col("f").cast("int"), "g": F.col("g").cast("int")}).join(F.broadcast(moves), ["f", "g"]).groupBy("contig", "parent", "matching").agg(F.sum("n").alias("matched"))
    best = traces.groupBy("contig", "parent").agg(F.max("matched").alias("matched"))
    compared = t.groupBy("contig").agg(F.count("*").alias("compared"))
    return best.groupBy("contig").agg(F.sum("matched").alias("matched")).join(compared, "contig").withColumn("accuracy", F.col("matched") / F.col("compared"))


def inferred_founders(fits: DataFrame) -> DataFrame:
    """contig, rep, sample, marker_ix, founders of fitted runs."""
    rows = fits.where("NOT dropped").select("contig", "rep", "sample", F.posexplode("haplotypes").alias("slot", "s"))
    cells = rows.select("contig", "rep", "sample", "slot", F.posexplode("s").alias("marker_ix", "state"))
    return cells.groupBy("contig", "rep", "sample", "marker_ix").agg(F.array_sort(F.collect_list("state")).alias("founders"))
