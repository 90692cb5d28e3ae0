"""A training corpus from ``documents``: quality, repeated lines, near duplicates, mixing, tokens.

Each stage works on all that the one before kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bpe, line_dedup, mixing, ngram_join, quality
from loomspan.llm.common import Scratch, table

#: Part of the tokens that the mix may use, and how often a document may come at most.
MIX_FRACTION, MIX_EPOCHS = 0.9, 2


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject."""
    scratch = Scratch(spark, "quality")
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), scratch), scratch)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more; a document of nothing else goes."""
    cut = line_dedup.dedup_lines(docs, Scratch(spark, "lines"))
    left = F.col("removed_runs").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(left).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id. Documents without an id stay."""
    found = ngram_join.ngram_components(docs, Scratch(spark, "ngram"), count_links=False)
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    several = first.where("rows > 1").limit(1).count()
    kept = docs.join(first.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    if several:
        kept = kept.dropDuplicates(["doc_id"])
    return kept.union(docs.where("doc_id IS NULL"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as their epochs say."""
    return mixing.mix_documents(docs, Scratch(spark, "mixing"), MIX_FRACTION, MIX_EPOCHS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with checksums of the ids and of the bytes that they decode to."""
    return bpe.encode_documents(docs, *bpe.default_vocabulary(), Scratch(spark, "tokens"))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("mixing", mixed),
    ("byte_bpe", tokens),
]
#: Models, prefix doubling and token merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
