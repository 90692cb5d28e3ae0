"""Variant call files: scan with header validation, filters with a waterfall, recoding, collection tables, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import sequences as S
from loomspan.operators import filters as P
from loomspan.operators.numbering import global_index

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def header(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the one header line, cut at the first colon; duplicates and missing columns are errors."""
    lines = [r[0] for r in spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(2).collect()]
    if len(lines) != 1:
        raise ValueError(f"{len(lines)} header lines")
    cells = lines[0].split()
    if any(name not in cell.upper() for name, cell in zip(FIXED, cells, strict=False)) or len(cells) < len(FIXED):
        raise ValueError("the header lacks fixed columns")
    samples = [c.split(":")[0] for c in cells[len(FIXED) :]]
    if len(set(samples)) < len(samples):
        raise ValueError("duplicate sample names")
    return samples


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """One row a site: contig, pos, id, ref, alt, qual (null for '.'), filter, info map, fmt, calls (text, one a sample)."""
    cell = F.split("value", r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).select(cell.alias("c"))
    item = lambda i: F.get("c", F.lit(i))
    info = F.map_from_entries(F.transform(F.filter(F.split(item(7), ";"), lambda x: F.length(x) > 0), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.regexp_extract(x, "=(.*)$", 1))))
    return rows.select(
        S.clean_name(item(0)).alias("contig"), item(1).try_cast("int").alias("pos"), item(2).alias("id"), item(3).alias("ref"), item(4).alias("alt"), F.expr("try_cast(get(c, 5) AS DOUBLE)").alias("qual"),
        item(6).alias("filter"), info.alias("info"), F.split(item(8), ":").alias("fmt"), F.slice("c", 10, F.size("c")).alias("calls"),
    )


def _field(call: Column, name: str) -> Column:
    at = F.array_position(F.col("fmt"), F.lit(name))
    return F.when(at > 0, F.get(F.split(call, ":"), (at - 1).cast("int")))


def has_reference() -> Column:
    """Whether some sample that is called carries the reference: a 0 in its genotype or reads of it."""
    def carries(call):
        gt = F.coalesce(F.contains(_field(call, "GT"), F.lit("0")), F.lit(False))
        ad = F.coalesce(F.get(F.split(_field(call, "AD"), ","), F.lit(0)).try_cast("int"), F.lit(0)) > 0
        ro = F.coalesce(_field(call, "RO").try_cast("int"), F.lit(0)) > 0
        return ~call.startswith(".") & (gt | ad | ro)

    return F.exists("calls", carries)


def checks(min_qual: float = 0, min_depth: float = 0, max_depth: float = float("inf"), min_maf: float = 0, max_missing: float = 1) -> list[tuple[str, Column]]:
    """The filters in their order. Quality and INFO values that are absent pass."""
    number = lambda key: F.expr(f"try_cast(split(info['{key}'], ',')[0] AS DOUBLE)")
    return [
        ("QUAL", P.quality_ok(F.col("qual"), min_qual)),
        ("MAF", P.maf_ok(number("AF"), min_maf)),
        ("DP", P.depth_ok(number("DP"), min_depth, max_depth)),
        ("MNP", P.alleles_ok(F.col("alt"), has_reference())),
        ("MIS", P.missing_rate(F.col("calls")) <= max_missing),
    ]


def filter_variants(variants: DataFrame, **limits) -> DataFrame:
    return variants.where(P.first_failure(checks(**limits)).isNull())


def filter_counts(variants: DataFrame, **limits) -> DataFrame:
    return P.waterfall(variants, checks(**limits))


def narrowed(variants: DataFrame) -> DataFrame:
    """Calls as structs (gt, ad): the second and third allele of rescued sites become the two; missing calls are null."""
    # a column of its own: inside the lambdas "alt" would be the new one
    variants = variants.withColumn("rescued", F.size(F.split("alt", ",")) == 2)
    rescued = F.col("rescued")
    shift = F.when(rescued, 1).otherwise(0)

    def ints(text, from_):
        parts = F.split(text, ",")
        return F.when(F.size(parts) >= 2, F.transform(F.array(F.get(parts, from_), F.get(parts, from_ + 1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))))

    def call(c):
        gt = _field(c, "GT")
        ro, ao = _field(c, "RO").try_cast("int"), F.get(F.split(_field(c, "AO"), ","), F.lit(0)).try_cast("int")
        return F.when(~c.startswith("."), F.struct(F.when(rescued, S.recode_multiallelic(gt)).otherwise(gt).alias("gt"), P.depth_of(ints(_field(c, "AD"), shift), ro, ao).alias("ad")))

    alt = F.split("alt", ",")
    return variants.select("contig", "pos", "id", F.when(rescued, alt[0]).otherwise(F.col("ref")).alias("ref"), F.when(rescued, alt[1]).otherwise(F.col("alt")).alias("alt"), "qual", F.transform("calls", call).alias("calls"))


def call_rows(sites: DataFrame, samples: list[str]) -> DataFrame:
    """Long form: contig, pos, ref, alt, sample_ix, sample, gt, ref_depth, alt_depth (zero where the call is missing)."""
    names = F.array(*[F.lit(s) for s in samples])
    rows = sites.select("contig", "pos", "ref", "alt", F.posexplode("calls").alias("sample_ix", "call"))
    depth = lambda i: F.coalesce(F.col("call.ad")[i], F.lit(0))
    return rows.select("contig", "pos", "ref", "alt", "sample_ix", F.get(names, F.col("sample_ix")).alias("sample"), F.col("call.gt").alias("gt"), depth(0).alias("ref_depth"), depth(1).alias("alt_depth"))


def merge_samples(calls: DataFrame) -> DataFrame:
    """Calls of columns with one sample name added up."""
    return calls.groupBy("contig", "pos", "ref", "alt", "sample").agg(F.sum("ref_depth").alias("ref_depth"), F.sum("alt_depth").alias("alt_depth"))


def with_marker_index(calls: DataFrame) -> DataFrame:
    """``marker_ix`` from 0 in each contig, by position."""
    sites = calls.select("contig", "pos").distinct()
    order = Window.partitionBy("contig").orderBy("pos")
    return calls.join(sites.withColumn("marker_ix", F.row_number().over(order) - 1), ["contig", "pos"])


def vcf_lines(sites: DataFrame, samples: list[str], info: Column | None = None) -> DataFrame:
    """Header and rows of a VCF with FORMAT GT:AD; depths of missing calls are '.'."""
    call = F.transform("calls", lambda c: F.when(c.isNull(), F.lit(".")).otherwise(F.concat_ws(":", F.coalesce(c["gt"], F.lit(".")), F.array_join(F.transform(c["ad"], lambda x: x.cast("string")), ","))))
    cells = [F.col("contig"), F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), F.col("ref"), F.col("alt"), F.coalesce(F.col("qual").cast("string"), F.lit(".")), F.lit("."), info if info is not None else F.lit("."), F.lit("GT:AD")]
    rows = sites.select(F.lit(1).alias("n"), "contig", "pos", F.concat(F.concat_ws("\t", *cells), F.lit("\t"), F.array_join(call, "\t")).alias("value"))
    head = "##fileformat=VCFv4.2\n#" + "\t".join([*FIXED, *samples])
    first = sites.sparkSession.createDataFrame([(0, "", 0, head)], rows.schema)
    return first.union(rows).orderBy("n", "contig", "pos").select("value")


def snp_info(depth: Column, bias: Column, error: Column, dispersion: Column, samples: Column, classes: Column, p: Column) -> Column:
    """INFO of a filtered site: DP;AB;ER;OD;NS;SG;PV, fractions in thousandths."""
    number = lambda x: F.format_string("%.3f", x)
    parts = {"DP": depth.cast("string"), "AB": number(bias), "ER": number(error), "OD": number(dispersion), "NS": samples.cast("string"), "SG": F.array_join(F.transform(classes, lambda c: c.cast("string")), ","), "PV": number(p)}
    return F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v) for k, v in parts.items()])


def write_vcf(sites: DataFrame, samples: list[str], path: str, compression: str = "none") -> None:
    vcf_lines(sites, samples).write.option("compression", compression).text(path)


def append_vcf(sites: DataFrame, samples: list[str], path: str) -> None:
    """Rows without a header beside those that ``path`` holds."""
    vcf_lines(sites, samples).where(~F.col("value").startswith("#")).write.mode("append").text(path)


def reformatted_pl(gt: Column) -> Column:
    """Phred values that the reformatter of a tetraploid caller's output gives a call: 0 at its class and 255 elsewhere.

    The call with four alternatives has the values of the one with three, as the format's users expect.
    """
    dosage = F.size(F.filter(F.split(gt, "/"), lambda a: a == "1"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == F.least(dosage, F.lit(3)), "0").otherwise("255")), ",")


def split_contigs(sites: DataFrame, errors: DataFrame) -> DataFrame:
    """Contigs with breakpoints become contig_1, contig_2, ...; only these are returned."""
    from loomspan.operators.joins import sub_contig

    broken = sites.join(errors.select("contig").distinct(), "contig", "left_semi")
    return sub_contig(broken, errors, "contig", "pos").withColumn("contig", F.concat_ws("_", "contig", F.col("piece").cast("string"))).drop("piece")


def write_collection(calls: DataFrame, path: str) -> None:
    """One partition a contig, so a scan of some contigs reads only theirs."""
    calls.repartition("contig").write.partitionBy("contig").parquet(path)


def read_collection(spark: SparkSession, path: str, contigs: list[str] | None = None, ranges: DataFrame | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if contigs is not None:
        rows = rows.where(F.col("contig").isin(contigs))
    return rows if ranges is None else P.in_ranges(rows, ranges, "contig", "pos")


def catalog(calls: DataFrame) -> DataFrame:
    """Contigs with their markers, largest first; ties by name."""
    sizes = calls.groupBy("contig").agg(F.countDistinct("pos").alias("n_markers"))
    return global_index(sizes, [F.desc("n_markers"), "contig"], "ix").withColumn("ix", F.col("ix") + 1)
