"""Scalar functions on columns: map distances, likelihoods, combinatorics, array arithmetic."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Recombination fractions are kept within these bounds before logarithms.
RF_MIN, RF_MAX = 1e-7, 0.4999999
SEQUENCING_ERROR = 0.01


def micro(x: Column) -> Column:
    """A double as whole millionths; results compared across engines are quantised so."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("long")


def bounded(r: Column, low: float = RF_MIN, high: float = RF_MAX) -> Column:
    return F.least(F.greatest(r, F.lit(low)), F.lit(high))


def kosambi(r: Column) -> Column:
    r = F.least(r, F.lit(RF_MAX))
    return 0.25 * F.ln((1 + 2 * r) / (1 - 2 * r))


def haldane(r: Column) -> Column:
    return -0.5 * F.ln(1 - 2 * F.least(r, F.lit(RF_MAX)))


def inverse_kosambi(d: Column) -> Column:
    return F.least(0.5 * F.tanh(2 * d), F.lit(RF_MAX))


def inverse_haldane(d: Column) -> Column:
    return 0.5 * (1 - F.exp(-2 * d))


def centimorgan(r: Column, map_function: str = "kosambi") -> Column:
    r = bounded(r, 0.0)
    return 25 * F.ln((1 + 2 * r) / (1 - 2 * r)) if map_function == "kosambi" else -50 * F.ln(1 - 2 * r)


def lod(rf: Column, n: Column) -> Column:
    """log10 likelihood ratio of linkage at ``rf`` against independence, over n meioses."""
    t = bounded(rf)
    return (n - n * t) * F.log10(1 - t) + n * t * F.log10(t) - n * F.log10(F.lit(0.5))


def rf_from_lod(score: Column, n: Column, rounds: int = 60) -> Column:
    """The fraction whose LOD is ``score``, by bisection: the LOD falls as the fraction grows to one half."""
    start = F.struct(F.lit(RF_MIN).alias("lo"), F.lit(0.5).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        above = lod(mid, n) > score
        return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def gap_to_bp(gaps: Column) -> Column:
    """Gaps given as fractions (all at most 1) become base pairs at 1 cM a million; others are base pairs already."""
    bp = F.transform(gaps, lambda g: (-0.5 * F.ln(1 - 2 * F.least(g, F.lit(RF_MAX))) * 1e8))
    return F.when(F.forall(gaps, lambda g: g <= 1.0), bp).otherwise(gaps)


# likelihoods


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def normalise(x: Column, pseudocount: float = 0.0) -> Column:
    """Parts of the sum; zeros if the sum is zero."""
    y = F.transform(x, lambda v: v + F.lit(pseudocount))
    total = array_sum(y)
    return F.when(total == 0, F.transform(y, lambda v: F.lit(0.0))).otherwise(F.transform(y, lambda v: F.try_divide(v, total)))


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.ln(array_sum(F.transform(x, lambda v: F.exp(v - top))))


def log_normalise(x: Column) -> Column:
    total = log_sum_exp(x)
    return F.transform(x, lambda v: v - total)


def phred_to_likelihood(pl: Column) -> Column:
    """Normalised likelihoods of phred values; all zero (no information) stays all zero."""
    none = F.forall(pl, lambda v: v == 0)
    return F.when(none, F.transform(pl, lambda v: F.lit(0.0))).otherwise(normalise(F.transform(pl, lambda v: F.pow(F.lit(10.0), -v / 10.0))))


def binomial_pl(ref: Column, alt: Column, ploidy: int, error: float = SEQUENCING_ERROR) -> Column:
    """Phred likelihoods of 0..ploidy alternative alleles from read depths, the best at 0."""
    def log10_likelihood(i):
        p = ((ploidy - i) * (1 - error) + i * error) / ploidy
        return ref * F.log10(p) + alt * F.log10(1 - p)

    logs = F.transform(F.sequence(F.lit(0), F.lit(ploidy)), lambda i: log10_likelihood(i.cast("double")))
    best = F.array_max(logs)
    return F.transform(logs, lambda v: -10 * (v - best))


def genotype_quality(pl: Column) -> Column:
    """The second smallest phred value."""
    return F.element_at(F.array_sort(pl), 2)


def hard_pl(dosage: Column, ploidy: int, far: int = 255) -> Column:
    """0 at the called dosage and ``far`` elsewhere; a missing call has zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(ploidy)), lambda i: F.when(dosage.isNull() | (dosage == i), 0).otherwise(far))


def log10_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log10(i.cast("double")))


def log10_choose(n: Column, k: Column) -> Column:
    return log10_factorial(n) - log10_factorial(k) - log10_factorial(n - k)


def choose(n: Column, k: Column) -> Column:
    """Exact binomial coefficient; every partial product is one too."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(1).cast("long"), lambda a, i: F.when(k == 0, a).otherwise(((a * (n - k + i)).cast("decimal(38,0)") / i).cast("long")))


def multichoose(n: Column, k: Column) -> Column:
    return choose(n + k - 1, k)


def log_binomial_pmf(k: Column, n: Column, p: Column) -> Column:
    return log10_choose(n, k) * F.ln(F.lit(10.0)) + k * F.ln(p) + (n - k) * F.ln(1 - p)


def log_poisson_pmf(k: Column, mean: Column) -> Column:
    return k * F.ln(mean) - mean - log10_factorial(k) * F.ln(F.lit(10.0))


# arrays


def hamming(a: Column, b: Column) -> Column:
    """Places at which two arrays of one length differ; nulls match nulls."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def scale(x: Column, k) -> Column:
    return F.transform(x, lambda v: v * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def transpose(m: Column) -> Column:
    """Columns of a matrix given as an array of rows of one length."""
    return F.transform(F.sequence(F.lit(1), F.size(F.element_at(m, 1))), lambda j: F.transform(m, lambda row: F.element_at(row, j.cast("int"))))


def arg_max(x: Column) -> Column:
    """0-based place of the first largest value."""
    return F.array_position(x, F.array_max(x)) - 1


def arg_min(x: Column) -> Column:
    return F.array_position(x, F.array_min(x)) - 1


def positive_min(x: Column) -> Column:
    return F.array_min(F.filter(x, lambda v: v > 0))


def positive_max(x: Column) -> Column:
    return F.array_max(F.filter(x, lambda v: v > 0))


def all_negative_infinity(x: Column) -> Column:
    return F.forall(x, lambda v: v == F.lit(float("-inf")))


def finite(x: Column) -> Column:
    """The value, or null where it isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def triangular(i: Column) -> Column:
    return F.expr("1L") * i * (i + 1) / 2


def paste(x: Column, sep: str) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), sep)


def padded(x: Column, width: int, fill: str = "0") -> Column:
    """A number's text, filled from the left; longer texts stay whole."""
    text = x.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def truncated_id(ids: Column, width: int = 128) -> Column:
    """Long joined names keep their first part and count: a____etcN."""
    joined = F.array_join(ids, "____")
    return F.when(F.length(joined) <= width, joined).otherwise(F.concat(F.substring(F.element_at(ids, 1), 1, width), F.lit("____etc"), F.size(ids).cast("string")))


def well(index: Column, columns: int = 12) -> Column:
    """Plate coordinates of a 0-based index: A01 to A12, then B01."""
    return F.concat(F.char(65 + F.floor(index / columns).cast("int")), F.lpad((index % columns + 1).cast("string"), 2, "0"))


def permutation_list(n: int) -> list[tuple[int, ...]]:
    """All orders of 0..n-1, the identity first."""
    return list(permutations(range(n)))


def case(pairs: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = reduce(lambda acc, p: F.when(*p) if acc is None else acc.when(*p), pairs, None)
    return out if otherwise is None else out.otherwise(otherwise)
