"""Linkage groups: connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b): the smallest vertex that it reaches.

    Minimum labels spread along edges and jump to their labels' labels, so rounds grow with the logarithm of a chain's
    length. Each round is checkpointed, which cuts the lineage and survives lost executors.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        from loomspan.sources.storage import checkpoint_dir

        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("hook"))
        hop = hooked.select(F.col("v").alias("hook"), F.col("hook").alias("hop"))
        new = hooked.join(hop, "hook").select("v", "old", F.least("hook", "hop").alias("label")).checkpoint()
        labels = new.select("v", "label")
        if not new.where("label < old").limit(1).count():
            return labels
    raise RuntimeError(f"labels still move after {rounds} rounds")
