"""Interchange texts of the recombination tools as tables: fractions, errors, maps, scaffolds, run details, depth matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RF_SCHEMA = "rf_min double, rf0 double, rf1 double, rf2 double, rf3 double, a string, b string, n int"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order. These files are one reader's work each; their order is that of one partition."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where(F.length(F.trim("value")) > 0)


def read_rf(spark: SparkSession, path: str) -> DataFrame:
    """Pairs; '##' lines name the contigs."""
    rows = spark.read.text(path).where(~F.col("value").startswith("##") & (F.length(F.trim("value")) > 0))
    return rows.select(F.from_csv("value", F.lit(RF_SCHEMA), {"sep": "\t"}).alias("r")).select("r.*")


def write_rf(pairs: DataFrame, path: str, contigs: DataFrame | None = None, in_order: bool = True, compression: str | None = None) -> None:
    """'##' lines, then pairs by their names; ``in_order`` False leaves the order of the pairs to save their sorting.

    ``contigs``: the names (contig), taken from the pairs if they aren't given. ``compression``: as 'gzip'; read_rf reads that too.
    """
    names = pairs.select(F.col("a").alias("c")).union(pairs.select("b")) if contigs is None else contigs.select(F.col("contig").alias("c"))
    heads = names.distinct().select(F.lit(0).alias("k"), F.col("c").alias("a"), F.lit("").alias("b"), F.concat(F.lit("##"), "c").alias("value"))
    rows = pairs.select(F.lit(1).alias("k"), "a", "b", F.concat_ws("\t", *[F.col(c).cast("string") for c in ("rf_min", "rf0", "rf1", "rf2", "rf3", "a", "b", "n")]).alias("value"))
    lines = heads.union(rows)
    (lines.orderBy("k", "a", "b") if in_order else lines).select("value").write.text(path, compression=compression)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """contig, errors (left, right, rf) by their left ends."""
    rows = spark.read.csv(path, sep="\t", schema="contig string, left double, right double, rf double")
    return rows.groupBy("contig").agg(F.sort_array(F.collect_list(F.struct("left", "right", "rf"))).alias("errors"))


def read_contig_map(spark: SparkSession, path: str) -> DataFrame:
    """Blocks 'C contig', 'D distances', fraction lines: contig, dist, rf (mean of the block's fraction lines)."""
    order = Window.partitionBy("file").orderBy("line")
    rows = _lines(spark, path).withColumn("block", F.sum(F.col("value").startswith("C ").cast("int")).over(order))
    numbers = lambda c: F.transform(F.split(c, ","), lambda x: x.cast("double"))
    kind = F.substring("value", 1, 2)
    heads = rows.groupBy("file", "block").agg(F.max(F.when(kind == "C ", F.substring_index("value", " ", -1))).alias("contig"), F.max(F.when(kind == "D ", F.substring("value", 3, 1 << 30))).alias("d"))
    cells = rows.where(~kind.isin("C ", "D ")).select("file", "block", F.posexplode(numbers(F.col("value"))).alias("i", "r")).groupBy("file", "block", "i").agg(F.avg("r").alias("r"))
    means = cells.groupBy("file", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("rf"))
    return heads.join(means, ["file", "block"], "left").select("contig", numbers(F.col("d")).alias("dist"), "rf")


def contig_map_lines(maps: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return maps.select(F.concat(F.lit("C "), F.col("contig"), F.lit("\nD "), text(F.col("dist")), F.lit("\n"), text(F.col("rf"))).alias("value"))


def read_linkage_map(spark: SparkSession, path: str) -> DataFrame:
    """Groups with two lines a contig, name(+) and name(-): lg, ord, contig, strand, cm_start, cm_end."""
    order = Window.partitionBy("file").orderBy("line")
    rows = _lines(spark, path).withColumn("is_head", F.col("value").startswith("group")).withColumn("lg", F.sum(F.col("is_head").cast("int")).over(order))
    rows = rows.where(~F.col("is_head")).withColumn("n", F.row_number().over(Window.partitionBy("file", "lg").orderBy("line")) - 1)
    cell = F.split("value", r"\s+")
    rows = rows.select("lg", F.expr("n div 2").alias("ord"), (F.col("n") % 2).alias("side"), F.regexp_replace(cell[0], r"\([+-]\)$", "").alias("contig"), F.regexp_extract(cell[0], r"\(([+-])\)$", 1).alias("end"), cell[1].cast("double").alias("cm"))
    pair = rows.groupBy("lg", "ord", "contig").agg(F.min_by("end", "side").alias("strand"), F.min_by("cm", "side").alias("cm_start"), F.max_by("cm", "side").alias("cm_end"))
    return pair.select("lg", "ord", "contig", "strand", "cm_start", "cm_end")


def linkage_map_lines(maps: DataFrame) -> DataFrame:
    other = F.when(F.col("strand") == "+", "-").otherwise("+")
    line = lambda end, cm: F.concat(F.col("contig"), F.lit("("), end, F.lit(")\t"), F.col(cm).cast("string"))
    rows = maps.groupBy("lg").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(line(F.col("strand"), "cm_start"), F.lit("\n"), line(other, "cm_end")).alias("text")))).alias("rows"))
    return rows.orderBy("lg").select(F.concat(F.lit("group\tLG"), F.col("lg").cast("string"), F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).alias("value"))


def read_scaffolds(spark: SparkSession, path: str) -> DataFrame:
    """Lines '-c a:b -s r -r f:t': cluster, ord, contig, gap_rf (to the next), reversed."""
    rows = spark.read.text(path).where(F.col("value").contains("-c "))
    flag = lambda f: F.split(F.regexp_extract("value", rf"-{f}\s+(\S+)", 1), ":")
    rows = rows.select(F.monotonically_increasing_id().alias("cluster"), flag("c").alias("c"), flag("s").alias("s"), flag("r").alias("r"))
    return rows.select("cluster", F.posexplode("c").alias("ord", "contig"), "s", "r").select("cluster", "ord", "contig", F.expr("try_cast(get(s, ord) AS DOUBLE)").alias("gap_rf"), F.coalesce(F.expr("try_cast(get(r, ord) AS BOOLEAN)"), F.lit(False)).alias("reversed"))


def scaffold_lines(df: DataFrame) -> DataFrame:
    parts = df.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("ord", "contig", "gap_rf", "reversed"))).alias("p"))
    joined = lambda f: F.array_join(F.transform("p", f), ":")
    gaps = F.array_join(F.transform(F.filter("p", lambda x: x["gap_rf"].isNotNull()), lambda x: x["gap_rf"].cast("string")), ":")
    flags = F.when(F.size("p") > 1, F.concat(F.lit(" -s "), gaps, F.lit(" -r "), joined(lambda x: x["reversed"].cast("string")))).otherwise(F.lit(""))
    return parts.orderBy("cluster").select(F.concat(F.lit("-c "), joined(lambda x: x["contig"]), flags).alias("value"))


def read_depths(spark: SparkSession, path: str) -> DataFrame:
    """Depth matrix: N, M, the samples, two lines, then 'id pos a,b d,d ...': marker_ix, id, pos, sample_ix, sample, ref, alt."""
    rows = _lines(spark, path)
    samples = rows.where("line = 2").select("file", F.split("value", r"\s+").alias("samples"))
    cells = F.split("value", r"\s+")
    body = rows.where("line > 4").select("file", (F.col("line") - 5).alias("marker_ix"), cells[0].alias("id"), cells[1].cast("double").alias("pos"), F.posexplode(F.slice(cells, 4, F.size(cells))).alias("sample_ix", "d"))
    depth = lambda i: F.coalesce(F.get(F.split("d", ","), F.lit(i)).try_cast("int"), F.lit(0))
    return body.join(samples, "file").select("marker_ix", "id", "pos", "sample_ix", F.get("samples", F.col("sample_ix")).alias("sample"), depth(0).alias("ref"), depth(1).alias("alt"))


def write_depths(sites: DataFrame, samples: list[str], path: str) -> None:
    """Depth matrices (the layout of ``read_depths``), a folder a contig. ``sites``: contig, pos, id, calls (gt, ad).

    A contig's matrix is one text, as its readers take it.
    """
    cell = lambda c: F.when(c.isNull(), "0,0").otherwise(F.array_join(F.transform(c["ad"], lambda x: x.cast("string")), ","))
    row = F.concat_ws(" ", "id", F.col("pos").cast("string"), F.lit("A,G"), F.array_join(F.transform("calls", cell), " "))
    rows = sites.groupBy("contig").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", row.alias("text")))).alias("rows"))
    head = F.concat_ws("\n", F.lit(str(len(samples))), F.col("n").cast("string"), F.lit(" ".join(samples)), F.lit("#"), F.lit("#"))
    rows.select("contig", F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).alias("value")).repartition("contig").write.partitionBy("contig").text(path)


def read_run_details(spark: SparkSession, path: str) -> DataFrame:
    """'##key: value' lines of each file as a map."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_extract("value", r"^#*\s*(\w+)\s*:\s*(.*)$", 1).alias("k"), F.regexp_extract("value", r"^#*\s*(\w+)\s*:\s*(.*)$", 2).alias("v")).where("k <> ''")
    return rows.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("details"))


def emission_probabilities(line):
    """P(ref) of each haplotype of an emission line: the second token of each brace."""
    groups = F.regexp_extract_all(line, F.lit(r"\{(.*?)\}"), F.lit(1))
    return F.transform(groups, lambda g: F.split(F.split(g, ";")[0], ",")[1].cast("double"))


def read_barcodes(spark: SparkSession, path: str, seed: int, skip: int = 16) -> DataFrame:
    """Second column of a barcode file after its heading, in a seeded order."""
    rows = _lines(spark, path).where(F.col("line") >= skip).select("line", F.split("value", ",")[1].alias("barcode"))
    return rows.orderBy(F.xxhash64("line", F.lit(seed))).select("barcode")


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """'K : V' lines of a file of settings, all of them; the driver holds it, so one over a megabyte is refused."""
    rows = spark.read.text(path).where(F.col("value").contains(":")).select(F.trim(F.split_part("value", F.lit(":"), F.lit(1))), F.trim(F.regexp_replace("value", "^[^:]*:", "")))
    size = spark.read.text(path).agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    if size > 1 << 20:
        raise ValueError(f"{path} has {size} bytes: too many for settings")
    return {r[0]: r[1] for r in rows.collect()}


def settings_lines(spark: SparkSession, settings: dict) -> DataFrame:
    """The settings of a map as 'K : V' lines, which ``read_config`` reads."""
    return spark.createDataFrame([(f"{k} : {v}",) for k, v in settings.items()], "value string")


def map_log_lines(maps: DataFrame) -> DataFrame:
    """The log of a linkage map (lg, cm_end): '$cm' and the length of each group, which ``total_cm`` adds up."""
    rows = maps.groupBy("lg").agg(F.max("cm_end").alias("cm"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("lg", "cm"))), lambda r: F.concat(F.lit("["), r["lg"].cast("string"), F.lit("] "), F.format_string("%.6f", r["cm"])))
    return rows.agg(F.concat_ws("\n", F.lit("$cm"), F.array_join(texts, "\n")).alias("value"))


def total_cm(spark: SparkSession, path: str) -> DataFrame:
    """Sum of the centimorgans on a log's $cm lines, by file."""
    rows = _lines(spark, path).where(F.col("value").rlike(r"^\s*\[?\d"))
    numbers = F.regexp_extract_all("value", F.lit(r"(\d+\.\d+)"), F.lit(1))
    return rows.select("file", F.explode(numbers).alias("x")).groupBy("file").agg(F.sum(F.col("x").cast("double")).alias("cm"))
