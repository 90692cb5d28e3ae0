"""Connected components by minimum labels with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b: longs): the label is the smallest vertex that it reaches."""
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        # written first: it is both sides of the next join, where a large component's vertices meet in one label and can be split
        hooked = scratch.keep(labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("hook")), "hooked")
        hop = hooked.select(F.col("v").alias("hook"), F.col("hook").alias("hop"))
        new = scratch.keep(hooked.join(hop, "hook").select("v", "old", F.least("hook", "hop").alias("label")), "labels")
        moved = new.where("label < old").limit(1).count()
        labels = new.select("v", "label")
        if not moved:
            scratch.drop(both)
            return labels
