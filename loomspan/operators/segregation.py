"""Segregation of F1 genotype classes: expected ratios from the parents' dosages and an exact test of the counts."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import scalar as X


@lru_cache(maxsize=64)
def expected(ploidy: int, dosage_a: int, dosage_b: int) -> tuple[float, ...]:
    """Parts of the progeny with 0..ploidy copies: each parent's gamete draws half of its alleles without replacement."""
    half = ploidy // 2

    def gamete(d):
        return np.array([comb(d, k) * comb(ploidy - d, half - k) / comb(ploidy, half) for k in range(half + 1)])

    return tuple(np.convolve(gamete(dosage_a), gamete(dosage_b)))


#: Compositions of a count that the exact test lists at most (16 bytes each); above it the test draws so many.
EXACT, DRAWS = 1_000_000, 100_000


def _log_factorial(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


@lru_cache(maxsize=8)
def _outcomes(n: int, ratio: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of all ways to deal n over the classes, ascending, and their running probability."""
    factorial = _log_factorial(n)
    left, value = np.array([n]), np.array([factorial[n]])
    for p in ratio[:-1]:
        row = np.repeat(np.arange(len(left)), left + 1)
        own = np.arange(len(row)) - np.repeat(np.cumsum(left + 1) - left - 1, left + 1)
        value = value[row] - factorial[own] + own * np.log(p)
        left = left[row] - own
    value = np.sort(value - factorial[left] + left * np.log(ratio[-1]))
    return value, np.cumsum(np.exp(value))


def multinomial_p(counts: np.ndarray, ratio: tuple[float, ...], exact: int = EXACT, draws: int = DRAWS, seed: int = 1) -> np.ndarray | float:
    """For each row of counts (all of one sum), or for one list of them, the probability of counts at most as likely.

    All outcomes are listed, once for all rows. ``exact`` bounds their number: a larger sum has so many ``draws`` with that
    seed instead, and its probability a standard error of at most half of their inverse root.
    """
    one = np.ndim(counts) == 1
    counts = np.atleast_2d(np.asarray(counts, np.int64))
    use = [i for i, p in enumerate(ratio) if p > 0]
    none = np.delete(counts, use, axis=1).any(axis=1)
    own, part, n = counts[:, use], tuple(ratio[i] for i in use), int(counts[0].sum())
    factorial = _log_factorial(n)

    def log_lik(c):
        return factorial[n] - factorial[c].sum(axis=1) + c @ np.log(part)

    at = log_lik(np.where(none[:, None], 0, own)) + 1e-9
    if comb(n + len(use) - 1, len(use) - 1) <= exact:
        value, below = _outcomes(n, part)
        found = np.concatenate(([0.0], below))[np.searchsorted(value, at, side="right")]
    else:
        drawn = np.sort(log_lik(np.random.default_rng(seed).multinomial(n, np.array(part) / sum(part), draws)))
        found = (np.searchsorted(drawn, at, side="right") + 1) / (draws + 1)
    found = np.where(none, 0.0, np.minimum(found, 1.0))
    return float(found[0]) if one else found


def segregation_test(sites: DataFrame, ploidy: int, counts: str = "counts", dosage_a: str = "dosage_a", dosage_b: str = "dosage_b") -> DataFrame:
    """``p``: of each site's class counts (array, 0..ploidy) under its parents' dosages."""

    @F.pandas_udf("double")
    def p(c: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        rows = np.stack(c.to_list()).astype(np.int64) if len(c) else np.zeros((0, ploidy + 1), np.int64)
        keys = np.stack((a.to_numpy(np.int64), b.to_numpy(np.int64), rows.sum(axis=1)), axis=1)
        out = np.zeros(len(rows))
        for i, j, n in np.unique(keys, axis=0).tolist():
            at = np.flatnonzero((keys == (i, j, n)).all(axis=1))
            different, back = np.unique(rows[at], axis=0, return_inverse=True)
            out[at] = multinomial_p(different, expected(ploidy, i, j))[back.ravel()]
        return pd.Series(out)

    return sites.withColumn("p", p(F.col(counts), F.col(dosage_a), F.col(dosage_b)))


def called_dosage(ref: Column, alt: Column, ploidy: int) -> Column:
    """Copies of the alternative allele of highest likelihood; none without reads."""
    pl = X.binomial_pl(ref.cast("double"), alt.cast("double"), ploidy)
    return F.when(ref + alt > 0, X.arg_min(pl))


def genotype_text(dosage: Column, ploidy: int) -> Column:
    """0/0, 0/1, ...; dots for a missing call."""
    alleles = F.concat(F.array_repeat(F.lit("0"), F.lit(ploidy) - dosage.cast("int")), F.array_repeat(F.lit("1"), dosage.cast("int")))
    return F.coalesce(F.array_join(alleles, "/"), F.lit("/".join("." * ploidy)))


def call_text(dosage: Column, ref: Column, alt: Column, ploidy: int, pl: Column | None = None) -> Column:
    """GT:AD:DP:GQ:PL of a call. Without likelihoods every other class has 30; with them (0 at the call) GQ is the second."""
    flat = F.transform(F.sequence(F.lit(0), F.lit(ploidy)), lambda i: F.when(i == dosage, 0).otherwise(30))
    values = flat if pl is None else pl
    quality = F.lit(30) if pl is None else X.genotype_quality(pl)
    texts = [genotype_text(dosage, ploidy), F.concat_ws(",", ref.cast("string"), alt.cast("string")), (ref + alt).cast("string"), quality.cast("string"), X.paste(values, ",")]
    return F.when(dosage.isNull(), ".").otherwise(F.concat_ws(":", *texts))
