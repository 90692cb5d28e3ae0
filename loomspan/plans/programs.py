"""The toolkit's programs as compositions of operators, and a command line that dispatches to them by name."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.scalar import lod
from loomspan.functions.sequences import wrap
from loomspan.operators import evaluate, mapping, phasing, simulate, singlepoint, twopoint
from loomspan.operators.numbering import global_index
from loomspan.sources import sequences, storage, tables, vcf


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A result that several steps read: written in the shared folder, not recomputed."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(storage.checkpoint_dir(spark))
    return df.checkpoint()


def datapreparation(spark: SparkSession, path: str, min_qual: float = 0, min_depth: float = 0, max_depth: float = float("inf"), min_maf: float = 0, max_missing: float = 1) -> tuple[DataFrame, DataFrame, list[str]]:
    """(sites, calls, samples) of a call file after the filters; calls are long, with marker numbers."""
    samples = vcf.header(spark, path)
    kept = vcf.filter_variants(vcf.read_vcf(spark, path), min_qual=min_qual, min_depth=min_depth, max_depth=max_depth, min_maf=min_maf, max_missing=max_missing)
    sites = vcf.narrowed(kept)
    return sites, vcf.with_marker_index(vcf.call_rows(sites, samples)), samples


def haplotyper(calls: DataFrame, parents: list[str], ploidy: int, repeats: int = 30, seed: int = 0, min_snps: int = 5, **options) -> DataFrame:
    """Fits of every contig with enough markers, ``repeats`` times each."""
    enough = calls.select("contig", "pos").distinct().groupBy("contig").agg(F.count("*").alias("n")).where(F.col("n") >= min_snps)
    return phasing.fit_contigs(calls.join(enough.select("contig"), "contig", "left_semi"), parents, ploidy, repeats, seed, **options)


def _best(fits: DataFrame, ploidy: int, best: int, phi: float, least: int) -> DataFrame:
    return fits.join(phasing.kept_runs(fits, ploidy, best, phi, least).select("contig", "rep"), ["contig", "rep"], "left_semi")


def asmerr(fits: DataFrame, sites: DataFrame, parents: list[str], ploidy: int, threshold: float = 0.1, best: int = 30, phi: float = 2.0, least: int = 1, markers: int = 30, bp: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(errors, sites of the broken contigs under their new names)."""
    errors = singlepoint.breakpoints(_best(fits, ploidy, best, phi, least), parents, threshold, markers, bp)
    return errors, vcf.split_contigs(sites, errors)


def single_point(fits: DataFrame, parents: list[str], ploidy: int, best: int = 10, phi: float = 2.0, least: int = 1, markers: int = 30, bp: int = 10_000) -> DataFrame:
    return singlepoint.contig_maps(_best(fits, ploidy, best, phi, least), parents, markers, bp)


def two_point(fits: DataFrame, parents: list[str], ploidy: int, best: int = 10, phi: float = 2.0, least: int = 1) -> DataFrame:
    return twopoint.two_point(phasing.end_haplotypes(_best(fits, ploidy, best, phi, least), parents, ploidy), ploidy)


def superscaffold(pairs: DataFrame, threshold: float = mapping.JOIN_RF) -> DataFrame:
    contigs = pairs.select(F.col("a").alias("contig")).union(pairs.select("b")).distinct()
    return mapping.superscaffolds(pairs, contigs, threshold)


def linkage_map(pairs: DataFrame, contig_maps: DataFrame, max_rf: float = mapping.GROUP_RF, min_lod: float = 3.0, one_group: bool = False) -> DataFrame:
    """Map rows; contigs that are far from all of their group become groups of their own."""
    contigs = contig_maps.select("contig").union(pairs.select("a")).union(pairs.select("b")).distinct()
    groups = mapping.linkage_groups(pairs, contigs, max_rf, min_lod, one_group)
    if not one_group:
        odd = mapping.chimeras(pairs, groups, max_rf).select("contig")
        last = groups.agg(F.max("lg")).first()[0] or 0
        alone = global_index(odd, ["contig"], "n").select("contig", (F.col("n") + 1 + F.lit(last)).alias("lg"))
        groups = groups.join(odd, "contig", "left_anti").union(alone)
    return mapping.assembled_map(mapping.ordered_groups(pairs, groups), mapping.contig_lengths(contig_maps))


def chromosomer(rows: DataFrame, seqs: DataFrame, errors: DataFrame | None = None, gap: int = 1000, trim_gaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pseudomolecules, AGP rows)."""
    molecules, parts = mapping.pseudomolecules(rows, seqs, errors, gap, trim_gaps)
    return molecules, sequences.agp_rows(parts, gap)


def evaluator(truth: DataFrame, fits: DataFrame, ploidy: int) -> DataFrame:
    """Accuracy of the best run of every contig."""
    best = phasing.kept_runs(fits, ploidy, 1, float("inf"), 1).select("contig", "rep")
    return evaluate.phasing_accuracy(truth, evaluate.inferred_founders(fits).join(best, ["contig", "rep"], "left_semi"), ploidy)


def popsimulation(spark: SparkSession, chromosomes: DataFrame, size: int, ploidy: int, seed: int) -> DataFrame:
    return simulate.genotypes(simulate.markers(chromosomes, ploidy, seed), simulate.pedigree(spark, size), ploidy, seed)


def gbssimulation(seqs: DataFrame, enzyme: str, mean: float, sd: float, barcode: str, seed: int) -> DataFrame:
    return simulate.reads(simulate.fragments(seqs, enzyme, seed=seed), mean, sd, barcode, seed)


def endtoend(spark: SparkSession, path: str, parents: list[str], ploidy: int, repeats: int = 30, seed: int = 0, seqs: DataFrame | None = None, rf_threshold: float = 0.1, min_progeny: int = 30, **limits) -> dict[str, DataFrame]:
    """The whole way: preparation, phasing, misjoin repair and re-phasing, fractions, maps, pseudomolecules."""
    sites, calls, samples = datapreparation(spark, path, **limits)
    sites = _kept(spark, sites)
    fits = _kept(spark, haplotyper(calls, parents, ploidy, repeats, seed, min_progeny=min_progeny))
    errors, broken = asmerr(fits, sites, parents, ploidy, rf_threshold)
    errors = _kept(spark, errors)
    if errors.limit(1).count():
        pieces = vcf.with_marker_index(vcf.call_rows(broken, samples))
        again = haplotyper(pieces, parents, ploidy, repeats, seed + 1, min_progeny=min_progeny)
        fits = _kept(spark, fits.join(errors.select("contig").distinct(), "contig", "left_anti").unionByName(again))
    pairs = _kept(spark, two_point(fits, parents, ploidy))
    maps = _kept(spark, single_point(fits, parents, ploidy))
    rows = _kept(spark, linkage_map(pairs, maps))
    out = {"fits": fits, "errors": errors, "pairs": pairs, "contig_maps": maps, "linkage_map": rows, "superscaffolds": superscaffold(pairs)}
    if seqs is not None:
        out["pseudomolecules"], out["agp"] = chromosomer(rows, seqs, errors)
    return out


def _prepare(spark, a):
    sites, calls, samples = datapreparation(spark, a.input, a.min_qual, a.min_depth, a.max_depth, a.min_maf, a.max_missing)
    vcf.write_vcf(sites, samples, f"{a.output}.vcf")
    vcf.write_collection(calls, f"{a.output}.collection")


def _phase(spark, a):
    calls = vcf.read_collection(spark, a.input)
    haplotyper(calls, a.parents.split(":"), a.ploidy, a.repeats, a.seed, min_progeny=a.min_progeny).write.parquet(a.output)


def _rf(spark, a):
    pairs = two_point(spark.read.parquet(a.input), a.parents.split(":"), a.ploidy)
    tables.write_rf(pairs.select("rf_min", *[F.col(x).alias(f"rf{i}") for i, x in enumerate(mapping.RF)], "a", "b", "n"), a.output)


def _single(spark, a):
    tables.contig_map_lines(single_point(spark.read.parquet(a.input), a.parents.split(":"), a.ploidy)).write.text(a.output)


def _scaffold(spark, a):
    pairs = tables.read_rf(spark, a.input).select("a", "b", "n", "rf_min", *[F.col(f"rf{i}").alias(x) for i, x in enumerate(mapping.RF)])
    tables.scaffold_lines(superscaffold(pairs)).write.text(a.output)


def _errors(spark, a):
    samples = vcf.header(spark, a.calls)
    errors, broken = asmerr(spark.read.parquet(a.input), vcf.narrowed(vcf.read_vcf(spark, a.calls)), a.parents.split(":"), a.ploidy)
    errors.select("contig", "left", "right", "rf").write.csv(f"{a.output}.err", sep="\t")
    vcf.write_vcf(broken, samples, f"{a.output}.vcf")


def _map(spark, a):
    rows = tables.read_rf(spark, a.input)
    pairs = rows.select("a", "b", "n", "rf_min", *[F.col(f"rf{i}").alias(x) for i, x in enumerate(mapping.RF)], lod(F.col("rf_min"), F.col("n")).alias("lod"))
    tables.linkage_map_lines(linkage_map(pairs, tables.read_contig_map(spark, a.maps))).write.text(a.output)


def _chromosomes(spark, a):
    errors = tables.read_errors(spark, a.errors).select("contig", F.explode("errors").alias("e")).select("contig", "e.*") if a.errors else None
    molecules, agp = chromosomer(tables.read_linkage_map(spark, a.input), sequences.read_fasta(spark, a.sequences), errors)
    sequences.write_fasta(molecules.withColumnRenamed("object", "name"), f"{a.output}.fa")
    agp.write.parquet(f"{a.output}.agp")


def _evaluate(spark, a):
    evaluator(spark.read.parquet(a.truth), spark.read.parquet(a.input), a.ploidy).write.csv(a.output, header=True)


def _whole(spark, a):
    seqs = sequences.read_fasta(spark, a.sequences) if a.sequences else None
    limits = {k: getattr(a, k) for k in ("min_qual", "min_depth", "max_depth", "min_maf", "max_missing")}
    for name, df in endtoend(spark, a.input, a.parents.split(":"), a.ploidy, a.repeats, a.seed, seqs, min_progeny=a.min_progeny, **limits).items():
        df.write.parquet(f"{a.output}/{name}")


def _population(spark, a):
    seqs = sequences.read_fasta(spark, a.input)
    chromosomes = seqs.select(F.col("name").alias("chrom"), F.col("length").cast("long").alias("length"))
    sites = _kept(spark, simulate.markers(chromosomes, a.ploidy, a.seed))
    family = simulate.pedigree(spark, a.size)
    truth = simulate.genotypes(sites, family, a.ploidy, a.seed)
    truth.write.parquet(f"{a.output}/truth")
    for name, lines in (("ped", simulate.pedigree_lines(family)), ("chrom", simulate.chromosome_lines(chromosomes)), ("map", simulate.marker_lines(sites)), ("gen", simulate.founder_lines(sites))):
        lines.write.text(f"{a.output}/{name}")
    genome = simulate.genomes(seqs.select("name", "seq"), truth)
    genome.select("sample", F.concat(F.lit(">"), "name", F.lit("_"), F.col("haplotype").cast("string"), F.lit("\n"), wrap(F.col("seq"))).alias("value")).write.partitionBy("sample").text(f"{a.output}/genomes")


def _reads(spark, a):
    seqs = sequences.read_fasta(spark, a.input).select("name", "seq")
    simulate.fastq_lines(gbssimulation(seqs, a.enzyme, a.depth, a.depth_sd, a.barcode, a.seed)).write.option("compression", "gzip").text(a.output)


PROGRAMS: dict[str, Callable] = {
    "datapreparation": _prepare, "haplotyper": _phase, "asmerr": _errors, "singlepoint": _single, "twopoint": _rf, "superscaffold": _scaffold, "map": _map,
    "chromosomer": _chromosomes, "evaluator": _evaluate, "endtoend": _whole, "popsimulation": _population, "gbssimulation": _reads,
}
FLAGS = (
    ("--input", str, None), ("--output", str, None), ("--calls", str, ""), ("--maps", str, ""), ("--errors", str, ""), ("--sequences", str, ""), ("--truth", str, ""), ("--parents", str, "P1:P2"), ("--ploidy", int, 2), ("--repeats", int, 30),
    ("--seed", int, 0), ("--size", int, 192), ("--enzyme", str, "ApeKI"), ("--depth", float, 10), ("--depth-sd", float, 5), ("--barcode", str, "ACGT"), ("--min-progeny", int, 30), ("--min-qual", float, 0), ("--min-depth", float, 0),
    ("--max-depth", float, float("inf")), ("--min-maf", float, 0), ("--max-missing", float, 1),
)


def main(argv: list[str] | None = None) -> int:
    """Run a program by its name, in any case; unknown names and options are errors."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("program", type=str.lower, choices=sorted(PROGRAMS))
    for flag, kind, value in FLAGS:
        parser.add_argument(flag, type=kind, default=value, required=value is None)
    args = parser.parse_args(argv)
    PROGRAMS[args.program](SparkSession.builder.getOrCreate(), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
