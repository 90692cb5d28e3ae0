"""Recombination between markers of one contig, from haplotypes within windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import joins as J
from loomspan.operators import mapping
from loomspan.operators import windows as W


def marker_table(fits: DataFrame) -> DataFrame:
    """contig, ix, pos, m of the fitted markers."""
    rows = fits.where("positions IS NOT NULL").groupBy("contig").agg(F.first("positions").alias("p"))
    return rows.select("contig", F.size("p").cast("long").alias("m"), F.posexplode("p").alias("ix", "pos")).withColumn("ix", F.col("ix").cast("long"))


def pair_rates(fits: DataFrame, parents: list[str], markers: int = 30, bp: int = 10_000) -> DataFrame:
    """contig, u, v, rf, bp, m: mean over runs of the part of haplotypes that differ, for v in u's window."""
    sites = W.forward_bound(marker_table(fits), ["contig"], "pos", markers, bp)
    pairs = J.band(sites, ["contig"], "ix", "last", ["pos", "m"])
    columns = state_columns(fits, parents)
    of = lambda x: columns.select("contig", "rep", F.col("ix").alias(x), F.col("states").alias(f"s{x}"))
    met = pairs.join(of("u"), ["contig", "u"]).join(of("v"), ["contig", "rep", "v"])
    jumps = F.aggregate(F.zip_with("su", "sv", lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    rate = met.groupBy("contig", "u", "v").agg(F.avg(jumps / F.size("su")).alias("rf"), F.first("pos_u").alias("pu"), F.first("pos_v").alias("pv"), F.first("m_u").alias("m"))
    return rate.select("contig", "u", "v", "rf", F.abs(F.col("pv") - F.col("pu")).alias("bp"), "m")


def state_columns(fits: DataFrame, parents: list[str]) -> DataFrame:
    """contig, rep, ix, states: the founders of all progeny's haplotypes at one marker, so that a pair of markers meets in
    two short arrays, however long the contig."""
    rows = fits.where("NOT dropped").where(~F.col("sample").isin(parents)).select("contig", "rep", "sample", F.posexplode("haplotypes").alias("slot", "s"))
    cells = rows.select("contig", "rep", "sample", "slot", F.posexplode("s").alias("ix", "state"))
    held = cells.groupBy("contig", "rep", F.col("ix").cast("long").alias("ix")).agg(F.array_sort(F.collect_list(F.struct("sample", "slot", "state"))).alias("x"))
    return held.select("contig", "rep", "ix", F.transform("x", lambda c: c["state"]).alias("states"))


def contig_maps(fits: DataFrame, parents: list[str], markers: int = 30, bp: int = 10_000) -> DataFrame:
    """contig, dist, rf: base pairs and fractions along the lightest marker path."""
    path = mapping.marker_paths(pair_rates(fits, parents, markers, bp))
    rows = path.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("ord", "bp", "rf"))).alias("p"))
    return rows.select("contig", F.transform("p", lambda x: x["bp"]).alias("dist"), F.transform("p", lambda x: x["rf"]).alias("rf"))


def breakpoints(fits: DataFrame, parents: list[str], threshold: float = 0.1, markers: int = 30, bp: int = 10_000) -> DataFrame:
    """contig, left, right, rf: neighbours that recombine above the threshold and that no pair around them contradicts.

    The pairs around (j, j+1) have u from j's backward window to j and v from j+1 to its forward window's end.
    """
    sites = W.backward_bound(W.forward_bound(marker_table(fits), ["contig"], "pos", markers, bp), ["contig"], "pos", markers, bp)
    rates = pair_rates(fits, parents, 2 * markers, 2 * bp)
    near = rates.where((F.col("v") == F.col("u") + 1) & (F.col("rf") > threshold)).select("contig", F.col("u").alias("j"), F.col("rf").alias("own"))
    up = sites.select("contig", F.col("ix").alias("j"), "first", F.col("pos").alias("left"))
    down = sites.select("contig", (F.col("ix") - 1).alias("j"), "last", F.col("pos").alias("right"))
    spans = near.join(up, ["contig", "j"]).join(down, ["contig", "j"]).withColumn("u", F.explode(F.sequence("first", "j")))
    around = spans.join(rates.select("contig", "u", "v", "rf"), ["contig", "u"]).where("v > j AND v <= last")
    return around.groupBy("contig", "j", "left", "right", "own").agg(F.min("rf").alias("least")).where(F.col("least") >= threshold).select("contig", "left", "right", F.col("own").alias("rf"))
