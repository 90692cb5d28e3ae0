"""Fixity audit of WARC replicas by Merkle trees over offset ranges.

A record is hashed with its offset and length; the records that start in one range of a file are a leaf, and ``FANOUT``
neighbouring ranges are a node. Replicas are compared by the roots of their files, and only the branches that differ are
followed down to ranges and then to records.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

#: A leaf's range has 2**16 bytes, a node 2**4 children.
RANGE_BITS, FANOUT_BITS = 16, 4
#: Records without an offset are dealt to so many places before the first offset, by a hash of their bytes.
LOST = 1 << 40


def _digest(*parts: str) -> Column:
    """Hash of a group's parts in their order; a group holds a range's records or a node's children."""
    rows = F.array_sort(F.collect_list(F.struct(*parts)))
    return F.sha2(F.concat_ws("\n", F.transform(rows, lambda r: F.concat_ws(" ", *[r[p].cast("string") for p in parts]))).cast("binary"), 256)


class Tree:
    """Node tables of one replica, leaves first: file, k (number of the range or node), hash.

    ``leaves``: file, place, length, hash and n of the distinct records. The place is the offset, or a negative number.
    """

    def __init__(self, records: DataFrame, scratch: Scratch, name: str):
        record = F.coalesce(F.col("record").cast("binary"), F.lit(b""))
        place = F.coalesce(F.col("offset").cast("long"), F.lit(-1) - F.pmod(F.xxhash64(record), F.lit(LOST)))
        file = F.coalesce(F.col("file").cast("string"), F.lit(""))
        rows = records.select(file.alias("file"), place.alias("place"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("hash"))
        self.leaves = scratch.keep(rows.groupBy("file", "place", "length", "hash").agg(F.count("*").alias("n")), f"{name}-records")
        far = self.leaves.agg(F.max(F.greatest(F.col("place"), -F.col("place")))).first()[0] or 0
        self.depth = 0
        while far >> (RANGE_BITS + FANOUT_BITS * self.depth):
            self.depth += 1
        self.levels = [scratch.keep(self.leaves.groupBy("file", F.shiftright("place", RANGE_BITS).alias("k")).agg(_digest("place", "length", "hash", "n").alias("hash")), f"{name}-ranges")]
        self.scratch, self.name = scratch, name

    def grow(self, depth: int) -> None:
        while len(self.levels) <= depth:
            below = self.levels[-1]
            self.levels.append(self.scratch.keep(below.groupBy("file", F.shiftright("k", FANOUT_BITS).alias("up")).agg(_digest("k", "hash").alias("hash")).withColumnRenamed("up", "k"), f"{self.name}-nodes"))


def _differ(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    a, b = left.withColumnRenamed("hash", "l"), right.withColumnRenamed("hash", "r")
    return a.join(b, on, "full").where(~F.col("l").eqNullSafe(F.col("r")))


def audit(primary: DataFrame, replica: DataFrame, scratch: Scratch) -> DataFrame:
    """Records that differ: file, offset, kind (changed, missing in the replica, extra in it), lengths and hashes of both.

    Both tables have file, offset and record (bytes). A null record is an empty one; null files and offsets are '' and
    -1 (such records are spread over the tree by their bytes). Records at one offset (repeated rows) are compared as sorted
    groups: if the groups differ, each distinct record of either side that the other lacks, or has another number of, is
    reported. Empty tables have no roots; a file that one side lacks is missing or extra with all its records.
    """

    trees = [Tree(primary, scratch, "primary"), Tree(replica, scratch, "replica")]
    depth = max(t.depth for t in trees)
    for t in trees:
        t.grow(depth)
    branches = None
    for level in range(depth, -1, -1):
        nodes = [t.levels[level] for t in trees]
        if branches is not None:
            nodes = [n.join(branches, (n["file"] == branches["file_"]) & (F.shiftright(n["k"], FANOUT_BITS) == branches["k_"]), "left_semi") for n in nodes]
        branches = scratch.keep(_differ(*nodes, ["file", "k"]).select(F.col("file").alias("file_"), F.col("k").alias("k_")), "branches")
    records = []
    for t in trees:
        rows = t.leaves.withColumn("k", F.shiftright("place", RANGE_BITS))
        records.append(rows.join(branches, (rows["file"] == branches["file_"]) & (rows["k"] == branches["k_"]), "left_semi"))
    side = F.struct("length", "hash", "n")
    a, b = (r.select("file", "place", side.alias("s")) for r in records)
    none = F.lit(None).cast(a.schema["s"].dataType)
    sides = a.select("file", "place", F.col("s").alias("l"), none.alias("r")).union(b.select("file", "place", none, F.col("s")))
    at = sides.groupBy("file", "place").agg(F.array_sort(F.collect_list("l")).alias("ls"), F.array_sort(F.collect_list("r")).alias("rs")).where("ls <> rs")
    only = at.select("file", F.greatest("place", F.lit(-1)).alias("offset"), F.array_except("ls", "rs").alias("ls"), F.array_except("rs", "ls").alias("rs"))
    pairs = only.select("file", "offset", F.explode(F.arrays_zip("ls", "rs")).alias("p"))
    kind = F.when(F.col("p.rs").isNull(), "missing").when(F.col("p.ls").isNull(), "extra").otherwise("changed")
    return pairs.select("file", "offset", kind.alias("kind"), F.col("p.ls.length").alias("length"), F.col("p.rs.length").alias("replica_length"), F.col("p.ls.hash").alias("sha256"), F.col("p.rs.hash").alias("replica_sha256"))


_HEAD = r"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:md5:%s>\r\nWARC-Target-URI: %s\r\nContent-Type: text/html\r\nContent-Length: %s\r\n\r\n".encode().decode("unicode_escape")


def page_records(pages: DataFrame, per_file: int = 500) -> DataFrame:
    """WARC resource records of the pages: file, offset, record, url; ``per_file`` page numbers share a file.

    Offsets are sums of lengths, so only these are ordered within a file; the records themselves move once, by their own key.
    """
    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    head = F.format_string(_HEAD, F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), url).cast("binary")), url, F.octet_length(html).cast("string"))
    rows = pages.select(F.concat(F.lit("pages-"), F.coalesce(F.expr(f"CAST(page_id div {per_file} AS STRING)"), F.lit("none")), F.lit(".warc")).alias("file"), F.coalesce("page_id", F.lit(-1)).alias("page_id"), url.alias("url"), F.concat(head, html, F.lit("\r\n\r\n")).cast("binary").alias("record"))
    key = ["file", "page_id", "url", "h"]
    named = rows.withColumn("h", F.xxhash64("record"))
    sizes = named.groupBy(*key).agg(F.first(F.octet_length("record").cast("long")).alias("size"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("page_id", "url", "h").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)))
    # repeated pages stand one behind the other
    several = named.join(starts.where("n > 1").select(*key), key, "left_semi").dropDuplicates(key)
    once = named.join(starts.where("n = 1").select(*key, F.col("start").alias("offset")), key)
    again = several.join(starts.where("n > 1"), key).withColumn("offset", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.col("start") + i * F.col("size"))))
    return once.select("file", "offset", "record", "url").union(again.select("file", "offset", "record", "url"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed WARC files: file (its name), offset, record. A file (under 2 GB) is one task's work.

    A record ends with its content and two line ends. What follows the last whole record of a file is one record more. A
    header is read to its end, however long.
    """
    header_end, length = re.compile(rb"\r\n\r\n"), re.compile(rb"(?im)^content-length:\s*(\d+)\s*$")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, offsets, rows = memoryview(content.as_buffer()), 0, [], []
                while at < len(data):
                    head = header_end.search(data, at)
                    size = length.search(data[at : head.start()]) if head else None
                    end = head.end() + int(size[1]) + 4 if size else len(data)
                    offsets.append(at)
                    rows.append(bytes(data[at:end]))
                    at = min(end, len(data))
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(rows)), pa.array(offsets, pa.int64()), pa.array(rows, pa.binary())], ["file", "offset", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, offset long, record binary")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage, by a hash of the address: a byte changed, the tail lost, or the record lost."""
    lot = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 6), 16, 10).cast("long") % 97
    half = F.expr("cast(octet_length(record) div 2 AS int)")
    changed = F.concat(F.substring("record", 1, 40), F.lit(b"#"), F.expr("substring(record, 42)"))
    return records.withColumn("lot", lot).where("lot <> 2").withColumn("record", F.when(F.col("lot") == 0, changed).when(F.col("lot") == 1, F.substring(F.col("record"), F.lit(1), half)).otherwise(F.col("record"))).drop("lot")


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = page_records(table(spark, sf_dir, "pages"))
    return audit(records, damaged(records), Scratch(spark, "warc")).select("file", "offset", "kind", "length", "replica_length", "sha256", "replica_sha256")


_SQL_HEAD = "'WARC/1.1' || r || 'WARC-Type: resource' || r || 'WARC-Date: 2024-01-01T00:00:00Z' || r || 'WARC-Record-ID: <urn:md5:' || md5(page_id || ' ' || url) || '>' || r || 'WARC-Target-URI: ' || url || r || 'Content-Type: text/html' || r || 'Content-Length: ' || strlen(html) || r || r"
OP7_SQL = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS r FROM pages),
w AS (SELECT 'pages-' || (page_id // 500) || '.warc' AS file, page_id, url, {_SQL_HEAD} || html || r || r AS rec FROM p),
o AS (SELECT *, strlen(rec) AS n, coalesce(sum(strlen(rec)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, CAST('0x' || substr(md5(url), 1, 6) AS BIGINT) % 97 AS lot FROM w),
b AS (SELECT *, CASE lot WHEN 0 THEN encode(rec)[1:40] || encode('#') || encode(rec)[42:] WHEN 1 THEN encode(rec)[1:n // 2] WHEN 2 THEN NULL ELSE encode(rec) END AS rep FROM o WHERE lot < 3)
SELECT file, CAST(off AS BIGINT) AS "offset", CASE lot WHEN 2 THEN 'missing' ELSE 'changed' END AS kind, CAST(n AS BIGINT) AS length, CAST(octet_length(rep) AS BIGINT) AS replica_length, sha256(encode(rec)) AS sha256, sha256(rep) AS replica_sha256 FROM b WHERE rep IS NULL OR rep <> encode(rec)"""
