"""Relational tables seen as genetics tables: events as markers, line items as allele depths, parts as variants, orders as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig (five days), sample, state, pos (seconds from the first of the month), event_id; ordered by ts, event_id."""
    seconds = (F.dayofmonth("ts") - 1).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf_dir, "events").select(F.floor((F.dayofmonth("ts") - 1) / 5).cast("long").alias("contig"), F.col("user_id").alias("sample"), F.col("event_type").alias("state"), seconds.cast("long").alias("pos"), "ts", "event_id", "value")


MARKERS_SQL = "SELECT CAST(floor((day(ts) - 1) / 5) AS BIGINT) AS contig, user_id AS sample, event_type AS state, CAST((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS pos, ts, event_id, value FROM events"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele depths per site and sample: quantities shipped under either status."""
    line = table(spark, sf_dir, "lineitem")
    depth = lambda status: F.sum(F.when(F.col("l_linestatus") == status, F.col("l_quantity")).otherwise(0.0)).cast("long")
    return line.groupBy(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("sample")).agg(depth("F").alias("ref"), depth("O").alias("alt"))


CALLS_SQL = "SELECT l_partkey AS site, l_suppkey AS sample, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS ref, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS alt FROM lineitem GROUP BY ALL"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig (brand), pos, ref and alt (type), qual (price; null for every seventh), af, depth."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_brand").alias("contig"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("ref"), F.when(F.col("p_partkey") % 11 == 0, "C,T,A").when(F.col("p_partkey") % 5 == 0, "C,T").otherwise("C").alias("alt"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("qual"), ((F.col("p_partkey") % 101) / 100.0).alias("af"), F.col("p_size").alias("depth"),
    )


VARIANTS_SQL = "SELECT p_brand AS contig, p_partkey AS pos, p_type AS ref, CASE WHEN p_partkey % 11 = 0 THEN 'C,T,A' WHEN p_partkey % 5 = 0 THEN 'C,T' ELSE 'C' END AS alt, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS qual, (p_partkey % 101) / 100.0::DOUBLE AS af, p_size AS depth FROM part"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of a contig: customer, order and its price as the log-likelihood."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contig"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("loglik"), "o_orderstatus", "o_orderpriority")


RUNS_SQL = "SELECT o_custkey AS contig, o_orderkey AS run, o_totalprice AS loglik, o_orderstatus, o_orderpriority FROM orders"


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last state of every contig and sample."""
    rows = markers(spark, sf_dir)
    first = F.min(F.struct("ts", "event_id", "state"))["state"]
    last = F.max(F.struct("ts", "event_id", "state"))["state"]
    return rows.groupBy("contig", "sample").agg(first.alias("start"), last.alias("stop"))


ENDS_SQL = f"SELECT DISTINCT contig, sample, first_value(state) OVER w AS \"start\", last_value(state) OVER w AS stop FROM ({MARKERS_SQL}) WINDOW w AS (PARTITION BY contig, sample ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def supplier_pairs(spark: SparkSession, sf_dir: str, remainder: int | None = None) -> DataFrame:
    """Suppliers of one nation as linked contigs: parts that both ship, and a fraction from them. ``remainder``: only pairs
    of suppliers with one remainder by it."""
    from loomspan.operators.joins import overlaps

    line = table(spark, sf_dir, "lineitem")
    rows = overlaps(line, "l_suppkey", "l_partkey", F.col("g") % remainder if remainder else None)
    return rows.select("a", "b", "common", "n", (0.5 * (1 - F.col("common") / F.col("n"))).alias("rf"))


PAIRS_SQL = """SELECT a.s AS a, b.s AS b, count(*) AS common, least(any_value(a.n), any_value(b.n)) AS n, 0.5 * (1 - count(*) / least(any_value(a.n), any_value(b.n))::DOUBLE) AS rf
FROM (SELECT s, p, count(*) OVER (PARTITION BY s) AS n FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)) a
JOIN (SELECT s, p, count(*) OVER (PARTITION BY s) AS n FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)) b ON a.p = b.p AND a.s < b.s GROUP BY a.s, b.s"""
