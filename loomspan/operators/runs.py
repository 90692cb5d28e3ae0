"""Run tables: one folder a run, tables by their logical names, corrupt runs skipped, and slices along the markers."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
#: Columns of the run table behind each logical name.
MEMBERS = {
    "haplotype": ["sample_ix", "sample", "haplotypes"], "genotype": ["sample_ix", "sample", "dosage", "dropped"], "dosage": ["sample_ix", "sample", "dosage"],
    "runinfo": ["seed", "loglik", "iterations", "n_markers"], "emission": ["emissions"], "transition": ["jumps"], "snp": ["positions"],
}
#: Of these each run has one row; the others have one a sample.
SINGLE = ("runinfo", "emission", "transition", "snp")


def write_runs(fits: DataFrame, path: str, keys: tuple[str, ...] = ("contig", "rep")) -> None:
    fits.repartition(*keys).write.partitionBy(*keys).parquet(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All runs that can be read; files that can't are passed over (``skipped_runs`` names them)."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)


def skipped_runs(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("contig", "rep")) -> DataFrame:
    """Keys of the runs whose files give no rows, each named in the log. Only file names and one row a run are looked at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    listed = files.select(*[F.url_decode(F.regexp_extract("path", f"/{k}=([^/]*)/", 1)).alias(k) for k in keys]).distinct()
    read = read_runs(spark, path, schema).select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct()
    out = listed.join(read, list(keys), "left_anti")
    for r in out.limit(100).collect():
        LOG.warning("skipped run %s", " ".join(f"{k}={r[k]}" for k in keys))
    return out


def member(fits: DataFrame, name: str) -> DataFrame:
    """The table of that logical name: contig, rep and its columns."""
    if name not in MEMBERS:
        raise ValueError(f"no table {name!r}; there are {', '.join(sorted(MEMBERS))}")
    cols = MEMBERS[name]
    if name in SINGLE and name != "runinfo":
        return fits.where(F.col(cols[0]).isNotNull()).select("contig", "rep", *cols)
    rows = fits.select("contig", "rep", *cols)
    return rows.distinct() if name in SINGLE else rows


# slices along a run's markers, 0-based


def ordered_positions(df: DataFrame, part: list[str], pos: str, descending: Column | None = None) -> DataFrame:
    """``positions`` of each part, ascending, or turned round where its markers stand in descending order."""
    rows = df.groupBy(*part).agg(F.sort_array(F.collect_list(pos)).alias("positions"), *([F.first(descending).alias("_d")] if descending is not None else []))
    return rows if descending is None else rows.withColumn("positions", F.when(F.col("_d"), F.reverse("positions")).otherwise(F.col("positions"))).drop("_d")


def by_index(values: Column, places: Column) -> Column:
    """The values at the listed places, in that order; a place past the end gives null."""
    return F.transform(places, lambda i: F.get(values, i.cast("int")))


def by_range(values: Column, start: Column, stop: Column) -> Column:
    """The values from ``start`` to ``stop``, both included; backwards if the stop is before the start."""
    lo, hi = F.least(start, stop).cast("int"), F.greatest(start, stop).cast("int")
    part = F.slice(values, lo + 1, hi - lo + 1)
    return F.when(start <= stop, part).otherwise(F.reverse(part))


def marker_ids(contig: Column, positions: Column, start: Column, stop: Column) -> Column:
    """Names contig_position of a range of markers, in its direction."""
    return F.transform(by_range(positions, start, stop), lambda p: F.concat_ws("_", contig, p.cast("string")))


def phased_calls(haplotypes: Column, alleles: Column, start: Column, stop: Column) -> Column:
    """Calls a|b|... of a range of markers: each haplotype's founder at a marker has that founder's allele there.

    ``haplotypes``: an array of founder labels (from 1) for each slot; ``alleles``: at each marker an array by founder.
    """
    first = by_range(F.sequence(F.lit(0), F.size(alleles) - 1), start, stop)
    return F.transform(first, lambda m: F.array_join(F.transform(haplotypes, lambda h: F.get(F.get(alleles, m), F.get(h, m) - 1).cast("string")), "|"))
