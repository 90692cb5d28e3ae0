"""Where intermediate results go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one, for one machine, where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='loomspan-')}"


def read_bytes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files as they are: path, length, content (under 2 GB each); ``pattern`` selects names, as 'run*'."""
    files = spark.read.format("binaryFile")
    return (files.option("pathGlobFilter", pattern) if pattern else files).load(path).select("path", "length", "content")
