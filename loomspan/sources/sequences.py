"""FASTA and AGP: scans, assembly of pseudomolecules, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import sequences as S


def read_fasta(spark: SparkSession, path: str, revcomp: bool = False) -> DataFrame:
    """name (first word of the header), seq, length; records start at '>'. ``revcomp`` adds rows named <name>_rc."""
    rows = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    split = F.split("value", "\n", 2)
    out = rows.select(F.regexp_extract(F.element_at(split, 1), r"^(\S+)", 1).alias("name"), F.regexp_replace(F.coalesce(F.try_element_at(split, F.lit(2)), F.lit("")), r"\s", "").alias("seq"))
    if revcomp:
        out = out.union(out.select(F.concat("name", F.lit("_rc")), S.reverse_complement(F.col("seq"))))
    return out.withColumn("length", F.length("seq"))


def fasta_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith(">")).select(F.regexp_extract("value", r"^>(\S+)", 1).alias("name"))


def read_fasta_folder(spark: SparkSession, path: str) -> DataFrame:
    """FASTA files of a folder (.fa, .fasta, .fna, gzip too) with the sample named by the file."""
    rows = spark.read.text(path, lineSep=">", pathGlobFilter="*.{fa,fasta,fna,fa.gz,fasta.gz,fna.gz}").withColumn("file", F.input_file_name()).where(F.length(F.trim("value")) > 0)
    split = F.split("value", "\n", 2)
    sample = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.(fa|fasta|fna)(\.gz)?$", "")
    return rows.select(sample.alias("sample"), F.regexp_extract(F.element_at(split, 1), r"^(\S+)", 1).alias("name"), F.regexp_replace(F.coalesce(F.try_element_at(split, F.lit(2)), F.lit("")), r"\s", "").alias("seq"))


def fasta_lines(df: DataFrame, width: int = 100, description: Column | None = None) -> DataFrame:
    head = F.concat(F.lit(">"), F.col("name")) if description is None else F.concat(F.lit(">"), F.col("name"), F.lit(" "), description)
    return df.select(F.concat(head, F.lit("\n"), S.wrap(F.col("seq"), width)).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 100) -> None:
    fasta_lines(df, width).write.text(path)


def assemble(df: DataFrame, gap: int) -> DataFrame:
    """(object, seq): the parts of each object in their order, '-' strands reverse-complemented, with gaps of n between."""
    seq = F.when(F.col("strand") == "-", S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    rows = df.select("object", F.struct(F.col("ord"), seq.alias("seq")).alias("p"))
    return rows.groupBy("object").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["seq"]), "n" * gap).alias("seq"))


def agp_rows(df: DataFrame, gap: int) -> DataFrame:
    """AGP rows of parts (object, ord, component, length, strand): 1-based, closed; a gap between parts, none at the end."""
    order = Window.partitionBy("object").orderBy("ord", "component")
    before = F.coalesce(F.sum(F.col("length") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("beg", (before + 1).cast("long")).withColumn("n", F.row_number().over(order).cast("long")).withColumn("m", F.count("*").over(Window.partitionBy("object")))
    part = F.struct(F.col("beg"), (F.col("beg") + F.col("length") - 1).alias("stop"), (2 * F.col("n") - 1).alias("part_number"), F.lit("W").alias("kind"), F.col("component"), F.lit("1").alias("a"), F.col("length").cast("string").alias("b"), F.col("strand"))
    hole = F.struct((F.col("beg") + F.col("length")).alias("beg"), (F.col("beg") + F.col("length") + gap - 1).alias("stop"), (2 * F.col("n")).alias("part_number"), F.lit("N").alias("kind"), F.lit(str(gap)).alias("component"), F.lit("gap").alias("a"), F.lit("1").alias("b"), F.lit("+").alias("strand"))
    return rows.select("object", F.explode(F.when(F.col("n") < F.col("m"), F.array(part, hole)).otherwise(F.array(part))).alias("r")).select("object", "r.*")


def write_agp(df: DataFrame, gap: int, path: str) -> None:
    cols = [F.col("object"), *[F.col(c).cast("string") for c in ("beg", "stop", "part_number", "kind")]]
    hole = F.col("kind") == "N"
    line = F.concat_ws("\t", *cols, F.when(hole, "gap").otherwise(F.col("component")), F.lit("1"), F.when(hole, str(gap)).otherwise(F.col("b")), F.col("strand"))
    agp_rows(df, gap).orderBy("object", "part_number").select(line.alias("value")).write.text(path)
