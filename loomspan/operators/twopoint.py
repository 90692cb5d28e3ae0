"""Two-point recombination fractions between contigs from the haplotypes at their ends.

``ends`` has one row for each contig, run, progeny, parent and end (start, stop) with the founder haplotype ``hap`` (1 to the
ploidy) that the progeny got there. For two contigs the progeny is the join key, so no pair of runs is enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.scalar import lod, permutation_list

ORIENTATIONS = ("ss", "se", "es", "ee")


def two_state(ends: DataFrame, contig: str, sample: str, start: str, stop: str) -> DataFrame:
    """Fractions of two contigs that share samples, if states carry the same names on both: 1 - agreements / samples."""
    a = ends.select(F.col(contig).alias("a"), sample, F.col(start).alias("sa"), F.col(stop).alias("ea"))
    b = ends.select(F.col(contig).alias("b"), sample, F.col(start).alias("sb"), F.col(stop).alias("eb"))
    both = a.join(b, sample).where("a < b")
    same = {"ss": ("sa", "sb"), "se": ("sa", "eb"), "es": ("ea", "sb"), "ee": ("ea", "eb")}
    counts = both.groupBy("a", "b").agg(F.count("*").alias("n"), *[F.sum((F.col(x) == F.col(y)).cast("int")).alias(f"c_{o}") for o, (x, y) in same.items()])
    rf = counts.select("a", "b", "n", *[(1 - F.col(f"c_{o}") / F.col("n")).alias(f"rf_{o}") for o in ORIENTATIONS])
    least = F.least(*[F.col(f"rf_{o}") for o in ORIENTATIONS])
    return rf.withColumn("rf_min", least).withColumn("lod", lod(F.col("rf_min"), F.col("n")))


def two_point(ends: DataFrame, founders: int) -> DataFrame:
    """Fractions under the best matching of founder names, over all run pairs.

    One matching of names holds for all four end pairs. The straight pairing of parents (1 with 1, 2 with 2) and the
    crossed one (1 with 2, 2 with 1) are tried, each with the matching of names that has the largest count, then the
    largest sum, then the lexicographically largest counts; straight wins ties. ``ends``: contig, run, progeny, parent
    (1, 2), end ('s', 'e'), slot, hap (1 to ``founders``, the ploidy). Pairs without common progeny have a null fraction and don't appear.
    """
    spark = ends.sparkSession
    a = ends.select(F.col("contig").alias("a"), F.col("run").alias("ra"), "progeny", F.col("parent").alias("pa"), F.col("end").alias("ea"), F.col("hap").alias("ha"))
    b = ends.select(F.col("contig").alias("b"), F.col("run").alias("rb"), "progeny", F.col("parent").alias("pb"), F.col("end").alias("eb"), F.col("hap").alias("hb"))
    cells = a.join(b, "progeny").where("a < b").groupBy("a", "b", "ra", "rb", "pa", "pb", "ea", "eb", "ha", "hb").agg(F.countDistinct("progeny").alias("c"))
    # founders! matchings, each as (number, from, to): a few rows
    moves = spark.createDataFrame([(i, x + 1, y + 1) for i, p in enumerate(permutation_list(founders)) for x, y in enumerate(p)], "matching int, ha int, hb int")
    traced = cells.withColumns({"ha": F.col("ha").cast("int"), "hb": F.col("hb").cast("int")}).join(F.broadcast(moves), ["ha", "hb"])
    sums = traced.groupBy("a", "b", "ra", "rb", "pa", "pb", "matching").agg(*[F.sum(F.when(F.concat("ea", "eb") == o, F.col("c")).otherwise(0)).alias(o) for o in ORIENTATIONS])
    counts = [F.col(o) for o in ORIENTATIONS]
    rank = [F.desc(F.greatest(*counts)), F.desc(sum(counts)), *[F.desc(c) for c in counts]]
    best = sums.withColumn("_r", F.row_number().over(Window.partitionBy("a", "b", "ra", "rb", "pa", "pb").orderBy(*rank))).where("_r = 1")
    crossed = (F.col("pa") != F.col("pb")).cast("int").alias("crossed")
    pairing = best.groupBy("a", "b", "ra", "rb", crossed).agg(*[F.sum(o).alias(o) for o in ORIENTATIONS])
    keep = pairing.withColumn("_r", F.row_number().over(Window.partitionBy("a", "b", "ra", "rb").orderBy(F.desc(F.greatest(*counts)), F.desc(sum(counts)), "crossed"))).where("_r = 1").drop("_r")
    own = ends.select("contig", "run", "progeny").distinct()
    meet = own.select(F.col("contig").alias("a"), F.col("run").alias("ra"), "progeny").join(own.select(F.col("contig").alias("b"), F.col("run").alias("rb"), "progeny"), "progeny").where("a < b").groupBy("a", "b", "ra", "rb").agg((F.count("*") * founders).alias("n"))
    rows = keep.join(meet, ["a", "b", "ra", "rb"])
    order = Window.partitionBy("a", "b").orderBy(F.desc(F.greatest(*counts) / F.col("n")), F.desc(sum(counts) / F.col("n")), "ra", "rb")
    top = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    rf: list[Column] = [(1 - F.col(o) / F.col("n")).alias(f"rf_{o}") for o in ORIENTATIONS]
    out = top.select("a", "b", "n", *rf)
    return out.withColumn("rf_min", F.least(*[F.col(f"rf_{o}") for o in ORIENTATIONS])).withColumn("lod", lod(F.col("rf_min"), F.col("n")))
