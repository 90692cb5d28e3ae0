"""Deletion of repeated line runs by a suffix array over line ids, built by prefix doubling.

The rank of a suffix at depth 2**k is its place in the order of suffixes by their first 2**k lines (a line's id is its place
in the order of line hashes); suffixes that agree so far share a rank and are one interval of the suffix array, whose
longest common prefix is at least 2**k. Ranks of doubled depth are places in the order of (rank, rank 2**k lines later).
Positions whose interval holds one suffix have no copy and leave, so a round is no larger than the repeated part. The
interval of a longer common prefix of any length is named by the ranks of its first and its last 2**k lines, which overlap.

A line goes if it lies in a run of at least ``min_words`` words whose lines also stand at an earlier position. Such a run
is the union of its shortest sub-runs of that many words, from each line onwards and up to each line, so common prefixes
of more than ``min_words`` lines need no rank of their own; adjoining deletions are the maximal runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
#: A position is a document's number above so many bits of the line's number (a Spark string can't hold more lines).
LINE_BITS = 28


def _identity(id_col: str = "doc_id") -> list[Column]:
    """Of a document: its id (nulls first) and a hash of its text. Repeated rows are one document."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("thash")]


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that hold a word, with their number among these (seq) and among all lines, two hashes and their words."""
    numbered = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("line"))), lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))
    return docs.where("text IS NOT NULL").select(*_identity(), F.posexplode(numbered).alias("seq", "s")).select(
        "did", "thash", "seq", F.col("s.line").alias("line"), F.xxhash64("s.x").alias("h1"), F.xxhash64("s.x", F.lit(1)).alias("h2"), F.regexp_count("s.x", F.lit(WORD)).cast("long").alias("w")
    )


def _in_order(rows: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Distinct rows with ``ix``, their place in the order of ``by``: a range sort, then the sizes of its partitions.

    The rows are written before, since a range sort reads them twice.
    """
    rows = scratch.keep(rows, name)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = scratch.keep(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id()), name)
    part = F.shiftright("m", 33)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # a row for each partition of the sort
    return sorted_.withColumn("part", part).join(F.broadcast(offsets), "part").select(*rows.columns, (F.col("offset") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("ix"))


def _intervals(rows: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """(pos, rank) of the rows whose ``by`` is at several positions; the rank is its place in their order.

    The intervals are written before the join, whose large partitions can then be split: a frequent line is one row there.
    """
    several = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    ranks = scratch.keep(_in_order(several, by, scratch, "order"), "intervals")
    return rows.join(ranks, by).select("pos", F.col("ix").alias("rank"))


def repeated_runs(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal runs to delete: did, thash, first and last line (from 0, blank lines inside included), lines."""
    lines = scratch.keep(_lines(docs), "lines")
    own = lines.where("seq = 0").groupBy("did", "thash").agg(F.count("*").alias("rows"))
    numbered = scratch.keep(_in_order(own, ["did", "thash"], scratch, "documents"), "numbered")
    # repeated rows are one document; without them, lines need no shuffle to find that out
    known = lines.dropDuplicates(["did", "thash", "seq"]) if numbered.where("rows > 1").limit(1).count() else lines
    known = known.join(numbered.drop("rows"), ["did", "thash"])
    placed = scratch.keep(known.select((F.shiftleft("ix", LINE_BITS) + F.col("seq")).alias("pos"), "did", "thash", "line", "h1", "h2", "w"), "placed")
    scratch.drop(lines)
    level = scratch.keep(_intervals(placed.select("pos", "h1", "h2"), ["h1", "h2"], scratch), "ranks")
    levels, k = level.withColumn("k", F.lit(0)), 0
    while (2 << k) <= min_words:
        after = level.select((F.col("pos") - F.lit(1 << k)).alias("pos"), F.col("rank").alias("next"))
        doubled = scratch.keep(level.join(after, "pos"), "doubled")
        level = scratch.keep(_intervals(doubled, ["rank", "next"], scratch), "ranks")
        scratch.drop(doubled)
        k += 1
        if not level.limit(1).count():
            break
        levels = levels.union(level.withColumn("k", F.lit(k)))
    # stretches of lines that all have copies; x: words before the line in its stretch; a row past the end closes each
    doc = F.shiftright("pos", LINE_BITS)
    of_doc = Window.partitionBy(doc).orderBy("pos")
    single = levels.where("k = 0").select("pos").join(placed.select("pos", "w"), "pos")
    stretch = single.withColumn("stretch", F.col("pos") - F.row_number().over(of_doc))
    past = stretch.groupBy("stretch", doc.alias("ix")).agg((F.max("pos") + 1).alias("pos"), F.lit(0).cast("long").alias("w"))
    rows = stretch.withColumn("ix", doc).select("ix", "stretch", "pos", "w").union(past.select("ix", "stretch", "pos", "w"))
    own = Window.partitionBy("ix", "stretch").orderBy("pos")
    rows = rows.withColumn("x", F.coalesce(F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_words = Window.partitionBy("ix", "stretch").orderBy("x")
    rows = rows.withColumn("after", F.first("pos").over(by_words.rangeBetween(min_words, Window.unboundedFollowing))).withColumn("from", F.last("pos").over(by_words.rangeBetween(Window.unboundedPreceding, -min_words)))
    runs = rows.where("after IS NOT NULL").select("pos", (F.col("after") - F.col("pos")).alias("len")).union(rows.where("from IS NOT NULL").select(F.col("from").alias("pos"), (F.col("pos") - F.col("from")).alias("len"))).distinct()
    depth = F.lit(0)
    for j in range(1, k + 2):
        depth = F.when(F.col("len") >= (1 << j), F.lit(j)).otherwise(depth)
    runs = runs.withColumn("k", depth).withColumn("tail", F.col("pos") + F.col("len") - F.expr("shiftleft(1L, k)"))
    runs = runs.join(levels.select("k", "pos", F.col("rank").alias("head_rank")), ["k", "pos"]).join(levels.select("k", F.col("pos").alias("tail"), F.col("rank").alias("tail_rank")), ["k", "tail"])
    runs = scratch.keep(runs.select("pos", "len", "head_rank", "tail_rank"), "runs")
    firsts = scratch.keep(runs.groupBy("head_rank", "tail_rank", "len").agg(F.min("pos").alias("first")), "firsts")
    copies = runs.join(firsts, ["head_rank", "tail_rank", "len"]).where("pos > first").groupBy("pos").agg((F.col("pos") + F.max("len")).alias("end"))
    # a later copy that begins past all ends so far begins another deletion
    reach = F.max("end").over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    begun = copies.withColumn("begins", F.when(F.col("pos") <= reach, 0).otherwise(1)).withColumn("nth", F.sum("begins").over(of_doc))
    spans = begun.groupBy(doc.alias("ix"), "nth").agg(F.min("pos").alias("start"), (F.max("end") - 1).alias("stop"))
    ends = scratch.keep(spans.select("start", "stop", F.explode(F.array_distinct(F.array("start", "stop"))).alias("pos")), "ends")
    at = ends.join(placed.select("pos", "did", "thash", "line"), "pos")
    return scratch.keep(at.groupBy("start", "stop", "did", "thash").agg(F.min("line").alias("first"), F.max("line").alias("last")).select("did", "thash", "first", "last", (F.col("stop") - F.col("start") + 1).alias("lines")), "gone")


def dedup_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``, plus ``removed_runs`` (first and last line of each).

    Lines end at line feeds; lines without words aren't compared, and go only inside a deleted run. Documents are
    ordered by doc_id (null first), then by a hash of the text; the first copy stays. Repeated rows are one document and
    meet the same fate. Null and empty texts stay as they are; a text whose lines all go becomes empty. Lines are equal
    if two 64-bit hashes agree. An empty table gives no rows; other columns pass.
    """
    runs = repeated_runs(docs, scratch, min_words)
    cut = runs.groupBy("did", "thash").agg(F.sort_array(F.collect_list(F.struct(F.col("first").alias("first"), F.col("last").alias("last")))).alias("removed_runs"))
    did, thash = _identity()
    cols = [c for c in docs.columns if c != "removed_runs"]
    own = docs.select(F.struct(*[F.col(c) for c in cols]).alias("row_"), did, thash, F.col("text").alias("text_"))
    # the same plan at any size: whole texts move once, and a partition's cuts are its hash table
    joined = own.join(cut.hint("shuffle_hash"), ["did", "thash"], "left")
    kept = F.array_join(F.filter(F.split("text_", "\n"), lambda x, i: ~F.exists("removed_runs", lambda r: i.between(r["first"], r["last"]))), "\n")
    text = F.when(F.col("removed_runs").isNull(), F.col("text_")).otherwise(kept)
    return joined.select(*[(text if c == "text" else F.col(f"row_.{c}")).alias(c) for c in cols], "removed_runs")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "lines"))
    spans = F.array_join(F.transform("removed_runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return docs.select("doc_id", F.coalesce(F.size("removed_runs"), F.lit(0)).cast("long").alias("n_runs"), F.coalesce(spans, F.lit("")).alias("removed_lines"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_bytes"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("kept_md5"))


OP4_SQL = r"""WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
l AS (SELECT doc_id, x, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM l0 WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY seq) AS cw, md5(x) AS h FROM l),
win AS (SELECT a.doc_id, a.seq AS s, b.seq AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + 49
  WHERE b.cw - a.cw + a.w >= 50 AND (b.cw - b.w - a.cw + a.w < 50 OR b.cw - a.cw < 50)),
named AS (SELECT win.doc_id, s, e, string_agg(h, ',' ORDER BY c.seq) AS name FROM win JOIN c ON c.doc_id = win.doc_id AND c.seq BETWEEN s AND e GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, s) AS n FROM named),
gone AS (SELECT DISTINCT c.doc_id, c.seq, c.line FROM nth JOIN c ON c.doc_id = nth.doc_id AND c.seq BETWEEN s AND e WHERE n > 1),
runs AS (SELECT doc_id, min(line) AS a, max(line) AS b FROM (SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS g FROM gone) GROUP BY doc_id, g),
spans AS (SELECT doc_id, count(*) AS n_runs, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_lines FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY line), '') AS text FROM l0 WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.doc_id = l0.doc_id AND l0.line BETWEEN a AND b) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, coalesce(removed_lines, '') AS removed_lines, CAST(strlen(coalesce(kept.text, '')) AS BIGINT) AS kept_bytes, md5(coalesce(kept.text, '')) AS kept_md5
FROM documents d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)"""
