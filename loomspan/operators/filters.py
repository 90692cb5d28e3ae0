"""Filters and projections on variant, call and run tables. Columns are parameters, so any table will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Reasons of the variant filters, in the order in which a row is charged.
REASONS = ("QUAL", "MAF", "DP", "MNP", "MIS")


def quality_ok(qual: Column, least: float) -> Column:
    """A missing quality passes."""
    return qual.isNull() | (qual >= least)


def maf_ok(af: Column, least: float) -> Column:
    return af.isNull() | af.between(least, 1 - least)


def depth_ok(depth: Column, least: float, most: float) -> Column:
    return depth.isNull() | depth.between(least, most)


def alleles_ok(alt: Column, has_ref: Column) -> Column:
    """One alternative allele, or two if no sample carries the reference (these are recoded)."""
    n = F.size(F.split(alt, ","))
    return (n == 1) | ((n == 2) & ~has_ref)


def missing_rate(calls: Column) -> Column:
    """Part of the calls that are null or begin with a dot."""
    gone = F.filter(calls, lambda c: c.isNull() | c.startswith("."))
    return F.size(gone) / F.size(calls)


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The first check that isn't true; null if all are."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def waterfall(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows charged to each reason; rows that pass count under 'pass'."""
    return df.groupBy(F.coalesce(first_failure(checks), F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


def depth_of(ad: Column, ref: Column, alt: Column) -> Column:
    """Allele depths from the AD field, or else from separate reference and alternative counts."""
    return F.coalesce(ad, F.when(ref.isNotNull() & alt.isNotNull(), F.array(ref, alt)), F.array(F.lit(0), F.lit(0)))


def in_ranges(df: DataFrame, ranges: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows inside the closed range (start, end) given for their key."""
    return df.join(ranges, key).where(F.col(pos).between(F.col("start"), F.col("end"))).drop("start", "end")


def having_count(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Groups with at least so many rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def samples_kept(missing: DataFrame, markers: int) -> DataFrame:
    """Samples (sample, missing) that lack at most M - max(3, 0.3 M) markers."""
    return missing.where(F.col("missing") <= markers - max(3, 0.3 * markers))


def enough_progeny(samples: DataFrame, run: str, least: int = 30) -> DataFrame:
    return samples.groupBy(run).agg(F.countDistinct("sample").alias("progeny")).where(F.col("progeny") >= least)


def all_founders(labels: DataFrame, run: str, founders: int) -> DataFrame:
    """Runs in which every founder label is seen."""
    return labels.groupBy(run).agg(F.countDistinct("label").alias("labels")).where(F.col("labels") == founders)


def skew_ok(biggest: Column, smallest: Column, phi: float = 2.0) -> Column:
    """Label counts relative to their mean: largest at most phi, smallest at least 1 / phi."""
    return (biggest <= phi) & (smallest >= 1 / phi)


def keep_in(df: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(targets, keys, "left_semi")


def keep_out(df: DataFrame, drops: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(drops, keys, "left_anti")


def linked(rf: Column, score: Column, most: float, least: float) -> Column:
    """Edges that stay: not farther than ``most`` and not below the LOD ``least``."""
    return ~((rf > most) | (score < least))


def inner_fragments(df: DataFrame, part: list[str], order: list[str], length: Column, least: int = 100) -> DataFrame:
    """Fragments of at least ``least`` letters that are neither the first nor the last of their sequence."""
    w = Window.partitionBy(*part).orderBy(*order)
    inside = df.withColumn("_b", F.lag(F.lit(1)).over(w)).withColumn("_a", F.lead(F.lit(1)).over(w))
    return inside.where(F.col("_b").isNotNull() & F.col("_a").isNotNull() & (length >= least)).drop("_a", "_b")


def snp_ok(hom: Column, het: Column, called: Column, mean_depth: Column, classes: Column) -> Column:
    """Depth filter of genotype calls: homozygous over 3, heterozygous over 5 reads, 50 called, mean depth 3 to 50, two classes of 5 %."""
    return (hom >= 3) & (het >= 5) & (called >= 50) & mean_depth.between(3, 50) & (classes >= 2)


def biallelic(alt: Column) -> Column:
    return ~F.contains(alt, F.lit(","))


def first_samples(df: DataFrame, sample_ix: str, n: int) -> DataFrame:
    return df.where(F.col(sample_ix) < n)


def without_markers(df: DataFrame, marker_ix: str, drops: list[int]) -> DataFrame:
    return df.where(~F.col(marker_ix).isin(drops)) if drops else df


def marker_id(contig: Column, pos: Column) -> Column:
    return F.concat_ws("_", contig, pos.cast("string"))


def roles(name: Column, parents: list[str]) -> Column:
    """0 and 1 for the parents, 2 for progeny."""
    out = F.lit(2)
    for i, p in enumerate(parents):
        out = F.when(name == p, F.lit(i)).otherwise(out)
    return out
