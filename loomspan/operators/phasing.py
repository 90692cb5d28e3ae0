"""Phasing: every (contig, repeat) is one task's fit of the haplotype model; the results are run tables."""

from __future__ import annotations

import logging
import resource
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import windows as W
from loomspan.operators.kernels import hmm

LOG = logging.getLogger(__name__)
SCHEMA = """contig string, rep int, seed long, loglik double, iterations int, n_markers int, sample_ix int, sample string, dropped boolean,
haplotypes array<array<int>>, dosage array<int>, emissions array<array<double>>, jumps array<double>, positions array<long>, part_logliks array<double>, single_state int"""


def fit_contigs(calls: DataFrame, parents: list[str], ploidy: int, repeats: int = 1, seed: int = 0, min_progeny: int = 30, field: str = "AD", max_iter: int = 1000, conjunctions: tuple[int, ...] = ()) -> DataFrame:
    """Run rows, one a sample: calls have contig, marker_ix, pos, sample_ix, sample, ref_depth, alt_depth.

    A contig's matrix is one group (its size is markers times samples). A contig with fewer than two markers, or fewer
    than ``min_progeny`` progeny, gives no rows. The seed of a fit is a hash of the contig, the repeat and ``seed``; the
    sample in row 0 carries the emissions, the jumps and the likelihoods of the chain's parts.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        contig, rep, own = key
        empty = pd.DataFrame({c.split()[0]: [] for c in SCHEMA.replace("\n", " ").split(", ")})
        samples = pdf[["sample_ix", "sample"]].drop_duplicates().sort_values("sample_ix")
        markers = pdf[["marker_ix", "pos"]].drop_duplicates().sort_values("marker_ix")
        names = samples["sample"].tolist()
        if len(markers) < 2 or any(p not in names for p in parents) or len(names) - 2 < min_progeny:
            return empty
        row = pdf["sample_ix"].map({k: i for i, k in enumerate(samples["sample_ix"])}).to_numpy()
        col = pdf["marker_ix"].map({k: i for i, k in enumerate(markers["marker_ix"])}).to_numpy()
        ref, alt = (np.zeros((len(names), len(markers)), int) for _ in range(2))
        ref[row, col] = pdf["ref_depth"]
        alt[row, col] = pdf["alt_depth"]
        data = hmm.Data(ref, alt, markers["pos"].to_numpy(float), (names.index(parents[0]), names.index(parents[1])), ploidy, conjunctions, field)
        began = time.monotonic()
        fit = hmm.fit(data, int(own) & 0x7FFFFFFF, max_iter)
        LOG.info("%s run %d: %d samples, %d markers, %d rounds, %.1f s, %d MB", contig, rep, *data.shape, fit.iterations, time.monotonic() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
        dosage, _ = hmm.calls(fit)
        return pd.DataFrame(
            {
                "contig": contig, "rep": rep, "seed": own, "loglik": fit.loglik, "iterations": fit.iterations, "n_markers": len(markers), "sample_ix": samples["sample_ix"].to_numpy(), "sample": names, "dropped": fit.dropped,
                "haplotypes": [h.tolist() for h in fit.haplotypes], "dosage": dosage.tolist(), "emissions": [fit.emissions.tolist()] + [None] * (len(names) - 1), "jumps": [fit.jumps.tolist()] + [None] * (len(names) - 1),
                "positions": [markers["pos"].astype("int64").tolist()] + [None] * (len(names) - 1), "part_logliks": [hmm.part_logliks(data, fit)] + [None] * (len(names) - 1), "single_state": fit.whole,
            }
        )

    units = calls.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("seed", F.xxhash64("contig", "rep", F.lit(seed)))
    return units.groupBy("contig", "rep", "seed").applyInPandas(one, SCHEMA)


def run_rows(fits: DataFrame) -> DataFrame:
    return fits.select("contig", "rep", "seed", "loglik", "iterations", "n_markers").distinct()


def part_runs(fits: DataFrame) -> DataFrame:
    """contig, rep, part, loglik: the likelihood of each contig of a chain in each run, so that its runs can be ranked."""
    return fits.where("part_logliks IS NOT NULL").select("contig", "rep", F.posexplode("part_logliks").alias("part", "loglik"))


def labels(fits: DataFrame) -> DataFrame:
    """contig, rep, label: every founder label of the samples that weren't dropped."""
    return fits.where("NOT dropped").select("contig", "rep", F.explode(F.flatten("haplotypes")).alias("label"))


def kept_runs(fits: DataFrame, ploidy: int, best: int = 10, phi: float = 2.0, least: int = 1) -> DataFrame:
    """(contig, rep): runs with every founder and no skewed one, best likelihoods first; contigs with too few runs go."""
    from loomspan.operators import aggregates as A
    from loomspan.operators import filters as P

    skew = A.label_skew(labels(fits), ["contig", "rep"], "label").where((F.col("labels") == 2 * ploidy) & P.skew_ok(F.col("max_skew"), F.col("min_skew"), phi))
    good = run_rows(fits).join(skew.select("contig", "rep"), ["contig", "rep"])
    top = W.top(good, ["contig"], [F.desc("loglik"), "rep"], best)
    enough = top.groupBy("contig").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return top.join(enough.select("contig"), "contig", "left_semi").select("contig", "rep", "loglik")


def end_haplotypes(fits: DataFrame, parents: list[str], ploidy: int, width: int = 10) -> DataFrame:
    """Rows of ``two_point``: the majority founder of each slot at either end; parent 2's founders count from 1 again."""
    rows = fits.where("NOT dropped").where(~F.col("sample").isin(parents)).select("contig", F.col("rep").alias("run"), F.col("sample").alias("progeny"), F.posexplode("haplotypes").alias("slot", "states"))
    states = rows.select("contig", "run", "progeny", "slot", F.posexplode("states").alias("ix", "state"), F.size("states").alias("m"))
    keys = ["contig", "run", "progeny", "slot"]
    out = None
    for end, name in (("start", "s"), ("end", "e")):
        part = W.terminal_majority(states, keys, "state", end, width).select(*keys, F.lit(name).alias("end"), F.col(f"state_{end}").alias("state"))
        out = part if out is None else out.union(part)
    second = F.col("state") > ploidy
    return out.select("contig", "run", "progeny", "slot", "end", F.when(second, 2).otherwise(1).alias("parent"), F.when(second, F.col("state") - ploidy).otherwise(F.col("state")).cast("int").alias("hap"))


def adjacent_rates(fits: DataFrame, parents: list[str]) -> DataFrame:
    """contig, ix, pos_left, pos_right, rate: part of haplotypes that change between neighbouring markers, mean over runs."""
    from loomspan.operators import aggregates as A

    rows = fits.where("NOT dropped").where(~F.col("sample").isin(parents)).select("contig", "rep", "sample", F.posexplode("haplotypes").alias("slot", "s"))
    pairs = rows.select("contig", "rep", F.posexplode(F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: (a != b).cast("int"))).alias("ix", "jump"))
    rate = A.jump_rate(pairs, ["rep"], ["contig", "ix"], "jump")
    where = fits.where("positions IS NOT NULL").groupBy("contig").agg(F.first("positions").alias("p"))
    return rate.join(where, "contig").select("contig", "ix", F.get("p", F.col("ix")).alias("pos_left"), F.get("p", F.col("ix") + 1).alias("pos_right"), "rate", "runs")


def assembly_errors(rates: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Places where neighbouring markers recombine above the threshold: contig, left, right, rf."""
    return rates.where(F.col("rate") > threshold).select("contig", F.col("pos_left").alias("left"), F.col("pos_right").alias("right"), F.col("rate").alias("rf"))
