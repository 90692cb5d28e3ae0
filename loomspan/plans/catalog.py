"""Registry of the engine's own queries and their SQL.

Each query applies operators to whole tables; doubles are compared in millionths, and every ranking has a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import scalar as X
from loomspan.functions import sequences as S
from loomspan.operators import aggregates as A
from loomspan.operators import filters as P
from loomspan.operators import joins as J
from loomspan.operators import sets as U
from loomspan.operators import twopoint
from loomspan.operators import windows as W
from loomspan.operators.numbering import global_index
from loomspan.plans.views import CALLS_SQL, ENDS_SQL, MARKERS_SQL, PAIRS_SQL, RUNS_SQL, VARIANTS_SQL, calls, ends, markers, runs, supplier_pairs, table, variants

QUERIES: dict = {}
ORACLE_SQL: dict = {}
MICRO = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"


def micro_sql(expr: str) -> str:
    return MICRO.format(expr)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def micro(*cols: str):
    return [X.micro(F.col(c)).alias(c) for c in cols]


# scans and projections


@query("SELECT p_partkey, p_brand || '_' || p_partkey AS marker FROM part")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", P.marker_id(F.col("p_brand"), F.col("p_partkey")).alias("marker"))


@query("SELECT p_brand, p_partkey FROM part JOIN (VALUES ('Brand#11', 100, 900), ('Brand#22', 1, 1500), ('Brand#33', 5, 50)) r(b, lo, hi) ON p_brand = b AND p_partkey BETWEEN lo AND hi")
def range_scan(spark, d):
    ranges = spark.createDataFrame([("Brand#11", 100, 900), ("Brand#22", 1, 1500), ("Brand#33", 5, 50)], "p_brand string, start long, end long")
    return P.in_ranges(table(spark, d, "part").select("p_brand", "p_partkey"), F.broadcast(ranges), "p_brand", "p_partkey")


@query("SELECT p_brand AS contig, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS BIGINT) AS ix FROM part GROUP BY p_brand")
def catalog_sizes(spark, d):
    sizes = A.group_sizes(table(spark, d, "part").withColumnRenamed("p_brand", "contig"), "contig")
    return global_index(sizes, [F.desc("n"), "contig"], "ix").withColumn("ix", F.col("ix") + 1)


@query("WITH s AS (SELECT p_brand AS contig, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS ix FROM part GROUP BY p_brand) SELECT contig, p_partkey AS pos FROM part JOIN s ON contig = p_brand WHERE ix IN (1, 3, 5)")
def scan_by_index(spark, d):
    wanted = catalog_sizes(spark, d).where(F.col("ix").isin(1, 3, 5)).select("contig")
    return P.keep_in(table(spark, d, "part").select(F.col("p_brand").alias("contig"), F.col("p_partkey").alias("pos")), wanted, ["contig"])


@query("SELECT s_suppkey, translate(replace(s_name, '#', '.'), '|.', '__') AS name, split_part(s_name || ':x', ':', 1) AS sample FROM supplier")
def sanitize_names(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.clean_name(F.replace("s_name", F.lit("#"), F.lit("."))).alias("name"), S.sample_name(F.concat("s_name", F.lit(":x"))).alias("sample"))


@query(f"SELECT contig, pos FROM ({VARIANTS_SQL}) WHERE qual IS NULL OR qual >= 1000")
def filter_qual(spark, d):
    return variants(spark, d).where(P.quality_ok(F.col("qual"), 1000)).select("contig", "pos")


@query(f"SELECT contig, pos FROM ({VARIANTS_SQL}) WHERE af BETWEEN 0.05 AND 0.95")
def filter_maf(spark, d):
    return variants(spark, d).where(P.maf_ok(F.col("af"), 0.05)).select("contig", "pos")


@query(f"SELECT contig, pos FROM ({VARIANTS_SQL}) WHERE depth BETWEEN 10 AND 40")
def filter_depth(spark, d):
    return variants(spark, d).where(P.depth_ok(F.col("depth"), 10, 40)).select("contig", "pos")


@query("SELECT l_partkey AS site, count(*) AS cells, sum((l_quantity < 5)::INT)::BIGINT AS missing FROM lineitem GROUP BY l_partkey HAVING sum((l_quantity < 5)::INT) / count(*)::DOUBLE <= 0.1")
def filter_missing_rate(spark, d):
    cells = F.collect_list(F.when(F.col("l_quantity") < 5, "./.").otherwise("0/1"))
    sites = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site")).agg(F.count("*").alias("cells"), cells.alias("calls"))
    return sites.where(P.missing_rate(F.col("calls")) <= 0.1).select("site", "cells", F.round(P.missing_rate(F.col("calls")) * F.col("cells")).cast("long").alias("missing"))


@query(f"""SELECT CASE WHEN NOT (qual IS NULL OR qual >= 1000) THEN 'QUAL' WHEN NOT af BETWEEN 0.05 AND 0.95 THEN 'MAF' WHEN NOT depth BETWEEN 10 AND 40 THEN 'DP'
  WHEN NOT (alt NOT LIKE '%,%' OR (alt = 'C,T' AND pos % 2 = 0)) THEN 'MNP' WHEN pos % 13 = 0 THEN 'MIS' ELSE 'pass' END AS reason, count(*) AS n FROM ({VARIANTS_SQL}) GROUP BY 1""")
def filter_waterfall(spark, d):
    v = variants(spark, d)
    checks = zip(P.REASONS, (P.quality_ok(v["qual"], 1000), P.maf_ok(v["af"], 0.05), P.depth_ok(v["depth"], 10, 40), P.alleles_ok(v["alt"], v["pos"] % 2 == 1), v["pos"] % 13 != 0), strict=True)
    return P.waterfall(v, list(checks))


@query("SELECT o_orderkey, translate(o_orderpriority, '12', '01') AS recoded FROM orders WHERE o_orderpriority NOT LIKE '%3%'")
def multiallelic_recode(spark, d):
    return table(spark, d, "orders").where(~F.contains("o_orderpriority", F.lit("3"))).select("o_orderkey", S.recode_multiallelic(F.col("o_orderpriority")).alias("recoded"))


@query(f"SELECT site, sample, CASE WHEN site % 3 = 0 THEN ref ELSE CASE WHEN site % 3 = 1 THEN ref + 1 ELSE 0 END END AS a, CASE WHEN site % 3 = 0 THEN alt WHEN site % 3 = 1 THEN alt + 1 ELSE 0 END AS b FROM ({CALLS_SQL})")
def depth_fallback(spark, d):
    c = calls(spark, d)
    ad = F.when(c["site"] % 3 == 0, F.array("ref", "alt"))
    ro, ao = (F.when(c["site"] % 3 == 1, F.col(x) + 1) for x in ("ref", "alt"))
    depth = P.depth_of(ad, ro, ao)
    return c.select("site", "sample", depth[0].alias("a"), depth[1].alias("b"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 70")
def having_min_count(spark, d):
    return P.having_count(table(spark, d, "events"), ["user_id"], 70)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_targets(spark, d):
    return P.keep_in(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_drops(spark, d):
    return P.keep_out(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")
def union_all(spark, d):
    return U.append(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("k")))


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_difference(spark, d):
    return U.difference(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")))


@query("SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40")
def set_intersection(spark, d):
    return U.intersection(table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("k")))


@query("SELECT c_custkey, CASE c_name WHEN 'Customer#000000001' THEN 0 WHEN 'Customer#000000002' THEN 1 ELSE 2 END AS role FROM customer")
def pedigree_tag(spark, d):
    return table(spark, d, "customer").select("c_custkey", P.roles(F.col("c_name"), ["Customer#000000001", "Customer#000000002"]).alias("role"))


@query("WITH p AS (SELECT l_suppkey AS s, l_partkey AS p, CAST(sum(l_quantity) AS BIGINT) AS len FROM lineitem GROUP BY ALL) SELECT s, p, coalesce(CAST(sum(len + 10) OVER (PARTITION BY s ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) + p AS chain_pos FROM p")
def chain_positions(spark, d):
    parts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.sum("l_quantity").cast("long").alias("len"))
    return W.chained(parts, ["s"], ["p"], F.col("p"), F.col("len"), 10).select("s", "p", "chain_pos")


@query("""WITH n AS (SELECT o_custkey AS run, o_orderkey AS ord, count(*) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
o AS (SELECT *, coalesce(CAST(sum(m) OVER (PARTITION BY run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS f FROM n)
SELECT run, ord, CASE WHEN ord % 2 = 1 THEN f + m - 1 ELSE f END AS start_ix, CASE WHEN ord % 2 = 1 THEN f ELSE f + m - 1 END AS end_ix FROM o""")
def run_slices(spark, d):
    sizes = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("ord")).agg(F.count("*").alias("m"))
    return W.slices(sizes, ["run"], ["ord"], "m", F.col("ord") % 2 == 1).select("run", "ord", "start_ix", "end_ix")


# order-dependent


@query(f"SELECT event_id, abs(lead(pos) OVER (PARTITION BY sample ORDER BY ts, event_id) - pos) AS distance FROM ({MARKERS_SQL})")
def adjacent_gap(spark, d):
    return W.adjacent_distance(markers(spark, d), ["sample"], ["ts", "event_id"], "pos").select("event_id", "distance")


@query(f"""WITH j AS (SELECT sample, contig, CASE WHEN lag(state) OVER w IS NULL THEN NULL WHEN lag(state) OVER w <> state THEN 1 ELSE 0 END AS jump FROM ({MARKERS_SQL}) WINDOW w AS (PARTITION BY contig, sample ORDER BY ts, event_id)),
r AS (SELECT contig, sample, avg(jump) AS rate FROM j WHERE jump IS NOT NULL GROUP BY ALL) SELECT contig, {micro_sql('avg(rate)')} AS rate, count(*) AS runs FROM r GROUP BY contig""")
def adjacent_jump(spark, d):
    jumps = W.adjacent_change(markers(spark, d), ["contig", "sample"], ["ts", "event_id"], "state").where("jump IS NOT NULL")
    return A.jump_rate(jumps, ["sample"], ["contig"], "jump").select("contig", *micro("rate"), "runs")


_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY sample ORDER BY pos, event_id) - 1 AS ix, count(*) OVER (PARTITION BY sample) AS m FROM ({MARKERS_SQL})"


def _numbered(spark, d):
    return W.numbered(markers(spark, d), ["sample"], ["pos", "event_id"])


_FORWARD = f"SELECT *, least(m - 1, greatest(ix + 3, coalesce(min(ix) OVER (PARTITION BY sample ORDER BY pos RANGE BETWEEN 90000 FOLLOWING AND UNBOUNDED FOLLOWING), m - 1))) AS last FROM ({_NUMBERED})"


@query(f"SELECT event_id, ix, last FROM ({_FORWARD})")
def dual_bound_window(spark, d):
    return W.forward_bound(_numbered(spark, d), ["sample"], "pos", 3, 90000).select("event_id", "ix", "last")


@query(f"SELECT event_id, greatest(0, least(ix - 3, coalesce(max(ix) OVER (PARTITION BY sample ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 90000 PRECEDING), 0))) AS first, last FROM ({_FORWARD})")
def two_sided_window(spark, d):
    both = W.backward_bound(W.forward_bound(_numbered(spark, d), ["sample"], "pos", 3, 90000), ["sample"], "pos", 3, 90000)
    return both.select("event_id", "first", "last")


_BAND = f"WITH f AS ({_FORWARD}) SELECT a.sample, a.ix AS u, b.ix AS v, (a.state <> b.state)::INT AS mismatch FROM f a JOIN f b ON a.sample = b.sample AND b.ix > a.ix AND b.ix <= a.last"


@query(f"SELECT v - u AS lag, count(*) AS n, CAST(sum(mismatch) AS BIGINT) AS mismatches FROM ({_BAND}) GROUP BY 1")
def band_self_join(spark, d):
    near = J.band(W.forward_bound(_numbered(spark, d), ["sample"], "pos", 3, 90000), ["sample"], "ix", "last", ["state"])
    return near.groupBy((F.col("v") - F.col("u")).alias("lag")).agg(F.count("*").alias("n"), F.sum((F.col("state_u") != F.col("state_v")).cast("long")).alias("mismatches"))


@query(f"""WITH f AS ({_FORWARD}), p AS (SELECT a.sample, a.ix AS u, avg(abs(a.value - b.value)) AS rf FROM f a JOIN f b ON a.sample = b.sample AND b.ix > a.ix AND b.ix <= a.last GROUP BY ALL)
SELECT sample, count(*) AS windows, {micro_sql('min(rf)')} AS least FROM p GROUP BY sample HAVING min(rf) >= 5""")
def error_detection(spark, d):
    """Means are compared with a bound, so their last bits count: they are summed as the SQL's engine sums, from a window's last row back."""
    near = J.band(W.forward_bound(_numbered(spark, d), ["sample"], "pos", 3, 90000), ["sample"], "ix", "last", ["value"])
    rf = W.mean_from_last(near, ["sample", "u"], "v", F.abs(F.col("value_u") - F.col("value_v")), "rf")
    return rf.groupBy("sample").agg(F.count("*").alias("windows"), F.min("rf").alias("least")).where("least >= 5").select("sample", "windows", *micro("least"))


@query("SELECT p_partkey, 1 + (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand AND b.p_size >= 48 AND b.p_partkey < a.p_partkey) AS piece FROM part a")
def split_by_breakpoint(spark, d):
    part = table(spark, d, "part")
    breaks = part.where("p_size >= 48").select("p_brand", F.col("p_partkey").alias("left"))
    return J.sub_contig(part, breaks, "p_brand", "p_partkey").select("p_partkey", "piece")


_CONTIG = f"SELECT *, row_number() OVER (PARTITION BY contig, sample ORDER BY ts, event_id) - 1 AS ix, count(*) OVER (PARTITION BY contig, sample) AS m FROM ({MARKERS_SQL})"
_TERMINAL = """SELECT contig, sample, state FROM (SELECT contig, sample, state, row_number() OVER (PARTITION BY contig, sample ORDER BY count(*) DESC, CASE WHEN min(dep) = 0 THEN 0 ELSE 1 END, max(dep)) AS r FROM
  (SELECT *, {depth} AS dep FROM c) WHERE dep < greatest(1, least(10, m // 2)) GROUP BY contig, sample, state) WHERE r = 1"""


@query(f"WITH c AS ({_CONTIG}), s AS ({_TERMINAL.format(depth='ix')}), e AS ({_TERMINAL.format(depth='m - 1 - ix')}) SELECT s.contig, s.sample, s.state AS state_start, e.state AS state_end FROM s JOIN e ON s.contig = e.contig AND s.sample = e.sample")
def terminal_majority(spark, d):
    rows = W.numbered(markers(spark, d), ["contig", "sample"], ["ts", "event_id"])
    return W.terminal_majority(rows, ["contig", "sample"], "state", "start").join(W.terminal_majority(rows, ["contig", "sample"], "state", "end"), ["contig", "sample"])


@query(f"WITH b AS (SELECT sample, sum((state = 'purchase')::INT) OVER (PARTITION BY sample ORDER BY ts, event_id) AS block FROM ({MARKERS_SQL})) SELECT sample, CAST(block AS BIGINT) AS block, count(*) AS n FROM b GROUP BY ALL")
def block_ids(spark, d):
    return W.block_id(markers(spark, d), ["ts", "event_id"], F.col("state") == "purchase", ["sample"]).groupBy("sample", "block").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, {micro_sql('sum(value) OVER (PARTITION BY sample ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} // 1000 AS total FROM ({MARKERS_SQL})")
def cumulative_cm(spark, d):
    out = W.running_total(markers(spark, d), ["sample"], ["ts", "event_id"], F.col("value"), "total")
    return out.select("event_id", F.floor(X.micro(F.col("total")) / 1000).cast("long").alias("total"))


@query(f"SELECT event_id, {micro_sql('CAST(sum(pos) OVER (PARTITION BY sample ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(pos) OVER (PARTITION BY sample) AS DOUBLE)')} AS share FROM ({MARKERS_SQL})")
def cumulative_share(spark, d):
    return W.running_share(markers(spark, d), ["sample"], ["ts", "event_id"], F.col("pos"), "share").select("event_id", *micro("share"))


@query("SELECT s_suppkey, chr(CAST(65 + s_suppkey % 312 // 12 AS INT)) || lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0') AS well FROM supplier")
def well_coordinates(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", X.well(F.col("s_suppkey") % (12 * 26)).alias("well"))


@query(f"SELECT event_id, CAST((row_number() OVER (PARTITION BY sample ORDER BY ts, event_id)) % 2 AS BIGINT) AS parity FROM ({MARKERS_SQL})")
def record_parity(spark, d):
    return W.ranked(markers(spark, d), ["sample"], ["ts", "event_id"], "n").select("event_id", (F.col("n") % 2).alias("parity"))


@query("WITH x AS (SELECT p_brand, p_partkey, p_size, 1 + CAST(coalesce(sum(p_size + 5) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, count(*) OVER (PARTITION BY p_brand) AS m FROM part) SELECT p_brand AS object, b AS beg, b + p_size - 1 AS stop, 2 * n - 1 AS part_number, 'W' AS kind, CAST(p_partkey AS VARCHAR) AS component FROM x UNION ALL SELECT p_brand, b + p_size, b + p_size + 4, 2 * n, 'N', '5' FROM x WHERE n < m")
def agp(spark, d):
    from loomspan.sources.sequences import agp_rows

    parts = table(spark, d, "part").select(F.col("p_brand").alias("object"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("component"), F.col("p_size").alias("length"), F.lit("+").alias("strand"))
    return agp_rows(parts, 5).select("object", "beg", "stop", "part_number", "kind", "component")


# aggregations


@query("SELECT user_id AS run, event_type AS label, count(*) AS n FROM events GROUP BY ALL")
def label_histogram(spark, d):
    return A.label_histogram(table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("label")), ["run"], "label")


@query(f"WITH h AS (SELECT user_id AS run, event_type AS label, count(*) AS n FROM events GROUP BY ALL) SELECT run, {micro_sql('max(n) / avg(n)')} AS max_skew, {micro_sql('min(n) / avg(n)')} AS min_skew FROM h GROUP BY run HAVING count(*) = 5 AND max(n) / avg(n) <= 1.5 AND min(n) / avg(n) >= 1 / 1.5")
def skew_qc(spark, d):
    skew = A.label_skew(table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("label")), ["run"], "label")
    return skew.where((F.col("labels") == 5) & P.skew_ok(F.col("max_skew"), F.col("min_skew"), 1.5)).select("run", *micro("max_skew", "min_skew"))


@query("SELECT value, n FROM (SELECT split_part(p_type, ' ', 1) AS value, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, value LIMIT 1")
def modal_prefix(spark, d):
    return A.modal(table(spark, d, "part"), F.split_part("p_type", F.lit(" "), F.lit(1)))


@query(f"SELECT contig, run, {micro_sql('loglik')} AS loglik FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY loglik DESC, run) AS r FROM ({RUNS_SQL})) WHERE r <= 3")
def topk_runs(spark, d):
    return W.top(runs(spark, d), ["contig"], [F.desc("loglik"), "run"], 3).select("contig", "run", *micro("loglik"))


@query(f"SELECT site, {micro_sql('CASE WHEN sum(ref) = 0 OR sum(alt) = 0 THEN 0.5 ELSE sum(alt)::DOUBLE / (sum(ref) + sum(alt))::DOUBLE END')} AS baf FROM ({CALLS_SQL}) GROUP BY site")
def allele_fraction(spark, d):
    return calls(spark, d).groupBy("site").agg(A.allele_fraction(F.col("ref"), F.col("alt")).alias("baf")).select("site", *micro("baf"))


@query(f"SELECT site, sum((alt = 0)::INT)::BIGINT AS class_0, sum((ref > 0 AND alt > 0)::INT)::BIGINT AS class_1, sum((ref = 0 AND alt > 0)::INT)::BIGINT AS class_2, count(*) AS called, sum(ref + alt)::BIGINT AS depth FROM ({CALLS_SQL}) GROUP BY site")
def segregation_counts(spark, d):
    dosage = F.when(F.col("alt") == 0, 0).when(F.col("ref") > 0, 1).otherwise(2)
    return A.genotype_classes(calls(spark, d).select("site", dosage.alias("dosage"), (F.col("ref") + F.col("alt")).alias("depth")), ["site"], "dosage", "depth", [0, 1, 2])


@query("SELECT (n_chars >= 100)::INT + (n_chars >= 200)::INT + (n_chars >= 400)::INT + (n_chars >= 800)::INT + (n_chars >= 1600)::INT + (n_chars >= 3200)::INT + (n_chars >= 6400)::INT + (n_chars >= 12800)::INT::BIGINT AS bin, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, d):
    return table(spark, d, "documents").groupBy(A.bins(F.col("n_chars"), [100 * 2**i for i in range(8)]).alias("bin")).agg(F.count("*").alias("n"))


@query(f"SELECT contig, {micro_sql('sum(CASE WHEN run % 10 < 2 THEN 15 * loglik ELSE loglik END)')} // 1000 AS loglik FROM ({RUNS_SQL}) GROUP BY contig")
def weighted_loglik(spark, d):
    rows = runs(spark, d).withColumn("role", (F.col("run") % 10).cast("int"))
    return A.weighted_log_likelihood(rows, ["contig"], "role", "loglik", 30, "GT").select("contig", F.floor(X.micro(F.col("loglik")) / 1000).cast("long").alias("loglik"))


# pairs and recombination


@query("SELECT a.n_nationkey AS n_nationkey_a, b.n_nationkey AS n_nationkey_b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def pair_triangle(spark, d):
    return J.pairs(table(spark, d, "nation"), "n_nationkey", ["n_nationkey"])


@query("WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT a.s AS a, b.s AS b, count(*) AS common FROM s a JOIN s b ON a.p = b.p AND a.s < b.s GROUP BY ALL")
def set_intersection_matrix(spark, d):
    return J.shared_members(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")), "s", "p")


_LOD = "(n - n * t) * log10(1 - t) + n * t * log10(t) - n * log10(0.5)"
_TWO = f"""WITH e AS ({ENDS_SQL}), c AS (SELECT a.contig AS a, b.contig AS b, count(*) AS n, sum((a."start" = b."start")::INT) AS ss, sum((a."start" = b.stop)::INT) AS se, sum((a.stop = b."start")::INT) AS es, sum((a.stop = b.stop)::INT) AS ee
  FROM e a JOIN e b ON a.sample = b.sample AND a.contig < b.contig GROUP BY ALL),
r AS (SELECT a, b, n, 1 - ss / n::DOUBLE AS r0, 1 - se / n::DOUBLE AS r1, 1 - es / n::DOUBLE AS r2, 1 - ee / n::DOUBLE AS r3 FROM c),
q AS (SELECT *, least(r0, r1, r2, r3) AS rf, least(greatest(least(r0, r1, r2, r3), 1e-7), 0.4999999) AS t FROM r)"""


@query(f"{_TWO} SELECT a, b, n, {micro_sql('r0')} AS rf_ss, {micro_sql('r1')} AS rf_se, {micro_sql('r2')} AS rf_es, {micro_sql('r3')} AS rf_ee, {micro_sql('rf')} AS rf_min, {micro_sql(_LOD)} AS lod FROM q")
def two_point(spark, d):
    return twopoint.two_state(ends(spark, d), "contig", "sample", "start", "stop").select("a", "b", "n", *micro("rf_ss", "rf_se", "rf_es", "rf_ee", "rf_min", "lod"))


_BIN = f"SELECT contig, sample, (\"start\" IN ('click', 'purchase', 'signup'))::INT AS s, (stop IN ('click', 'purchase', 'signup'))::INT AS e FROM ({ENDS_SQL})"


@query(f"""WITH x AS ({_BIN}), c AS (SELECT a.contig AS a, b.contig AS b, count(*) AS n, sum((a.s = b.s)::INT) AS ss, sum((a.s = b.e)::INT) AS se, sum((a.e = b.s)::INT) AS es, sum((a.e = b.e)::INT) AS ee FROM x a JOIN x b ON a.sample = b.sample AND a.contig < b.contig GROUP BY ALL),
m AS (SELECT a, b, n, 0 AS k, ss, se, es, ee FROM c UNION ALL SELECT a, b, n, 1, n - ss, n - se, n - es, n - ee FROM c)
SELECT a, b, n, {micro_sql('1 - ss / n::DOUBLE')} AS rf_ss, {micro_sql('1 - se / n::DOUBLE')} AS rf_se, {micro_sql('1 - es / n::DOUBLE')} AS rf_es, {micro_sql('1 - ee / n::DOUBLE')} AS rf_ee
FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY greatest(ss, se, es, ee) DESC, ss + se + es + ee DESC, k) AS r FROM m) WHERE r = 1""")
def two_point_perm(spark, d):
    ones = ["click", "purchase", "signup"]
    x = ends(spark, d).select("contig", "sample", F.col("start").isin(ones).cast("int").alias("s"), F.col("stop").isin(ones).cast("int").alias("e"))
    a, b = (x.select(F.col("contig").alias(k), "sample", F.col("s").alias(f"s{k}"), F.col("e").alias(f"e{k}")) for k in "ab")
    agree = {"ss": ("sa", "sb"), "se": ("sa", "eb"), "es": ("ea", "sb"), "ee": ("ea", "eb")}
    c = a.join(b, "sample").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), *[F.sum((F.col(u) == F.col(v)).cast("int")).alias(o) for o, (u, v) in agree.items()])
    both = c.withColumn("k", F.lit(0)).unionByName(c.select("a", "b", "n", *[(F.col("n") - F.col(o)).alias(o) for o in agree], F.lit(1).alias("k")))
    best = A.best_of(both, ["a", "b"], list(agree), ["k"])
    return best.select("a", "b", "n", *[X.micro(1 - F.col(o) / F.col("n")).alias(f"rf_{o}") for o in agree])


@query(f"""WITH p AS ({PAIRS_SQL}) SELECT a, b, {micro_sql('0.25 * ln((1 + 2 * least(rf, 0.4999999)) / (1 - 2 * least(rf, 0.4999999)))')} AS kosambi, {micro_sql('-0.5 * ln(1 - 2 * least(rf, 0.4999999))')} AS haldane,
{micro_sql('25 * ln((1 + 2 * least(greatest(rf, 0), 0.4999999)) / (1 - 2 * least(greatest(rf, 0), 0.4999999)))')} AS cm, {micro_sql('least(0.5 * tanh(2 * rf), 0.4999999)')} AS inv_kosambi, {micro_sql('0.5 * (1 - exp(-2 * rf))')} AS inv_haldane FROM p""")
def map_functions(spark, d):
    r = F.col("rf")
    p = supplier_pairs(spark, d).select("a", "b", X.kosambi(r).alias("kosambi"), X.haldane(r).alias("haldane"), X.centimorgan(r).alias("cm"), X.inverse_kosambi(r).alias("inv_kosambi"), X.inverse_haldane(r).alias("inv_haldane"))
    return p.select("a", "b", *micro("kosambi", "haldane", "cm", "inv_kosambi", "inv_haldane"))


@query(f"WITH p AS ({PAIRS_SQL}), q AS (SELECT *, least(greatest(rf, 1e-7), 0.4999999) AS t FROM p) SELECT a, b, {micro_sql(_LOD)} AS lod FROM q")
def lod_scores(spark, d):
    return supplier_pairs(spark, d).select("a", "b", X.lod(F.col("rf"), F.col("n")).alias("lod")).select("a", "b", *micro("lod"))


@query(f"WITH p AS ({PAIRS_SQL}), m AS (SELECT quantile_disc(rf, 0.6) AS cut FROM p) SELECT a, b, common, {micro_sql('rf')} AS rf FROM (SELECT *, least(greatest(rf, 1e-7), 0.4999999) AS t FROM p), m WHERE NOT (rf > cut OR {_LOD} < 0.01)")
def edge_filter(spark, d):
    """Pairs up to the fraction of six tenths of all, and with some evidence."""
    p = supplier_pairs(spark, d)
    cut = p.agg(F.expr("percentile_disc(0.6) WITHIN GROUP (ORDER BY rf)")).first()[0]
    return p.where(P.linked(F.col("rf"), X.lod(F.col("rf"), F.col("n")), cut if cut is not None else 1.0, 0.01)).select("a", "b", "common", *micro("rf"))


@query(f"WITH p AS ({PAIRS_SQL}), s AS (SELECT a, b, common FROM p UNION ALL SELECT b, a, common FROM p) SELECT a, b, common FROM (SELECT *, rank() OVER (PARTITION BY a ORDER BY -common) AS r FROM s) WHERE r <= 3")
def knn_with_ties(spark, d):
    p = supplier_pairs(spark, d).select("a", "b", "common")
    return W.with_ties(p.union(p.select("b", "a", "common")), ["a"], -F.col("common"), 3)


@query(f"{_TWO}, s AS (SELECT a, b, r0, r1, r2, r3 FROM q UNION ALL SELECT b, a, r0, r2, r1, r3 FROM q) SELECT a, b, {micro_sql('CASE WHEN a % 2 = 0 THEN CASE WHEN b % 2 = 0 THEN r2 ELSE r3 END ELSE CASE WHEN b % 2 = 0 THEN r0 ELSE r1 END END')} AS rf FROM s")
def pair_orientation(spark, d):
    names = [f"rf_{o}" for o in twopoint.ORIENTATIONS]
    p = twopoint.two_state(ends(spark, d), "contig", "sample", "start", "stop").select("a", "b", *names)
    both = J.symmetric(p, "a", "b", names)
    sign = lambda c: F.when(F.col(c) % 2 == 0, "+").otherwise("-")
    return both.select("a", "b", X.micro(J.oriented([F.col(n) for n in names], sign("a"), sign("b"))).alias("rf"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS m FROM lineitem), z AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.m = b.m AND a.k <> b.k GROUP BY ALL)
SELECT k, n AS size FROM z WHERE NOT EXISTS (SELECT 1 FROM c JOIN z y ON y.k = c.b WHERE c.a = z.k AND c.c = z.n AND (y.n > z.n OR c.b < c.a))""")
def subset_elimination(spark, d):
    return J.subsets_removed(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("m")), "k", "m")


# likelihoods


@query(f"""WITH c AS (SELECT * FROM ({CALLS_SQL})), g AS (SELECT site, sample, i, ref * log10((2 - i) * 0.99 / 2 + i * 0.01 / 2) + alt * log10(1 - ((2 - i) * 0.99 / 2 + i * 0.01 / 2)) AS l FROM c, (VALUES (0), (1), (2)) t(i))
SELECT site, sample, i AS dosage, {micro_sql('-10 * (l - max(l) OVER (PARTITION BY site, sample))')} // 100 AS pl FROM g""")
def binomial_likelihood(spark, d):
    pl = X.binomial_pl(F.col("ref").cast("double"), F.col("alt").cast("double"), 2)
    out = calls(spark, d).select("site", "sample", F.posexplode(pl).alias("dosage", "pl"))
    return out.select("site", "sample", "dosage", F.floor(X.micro(F.col("pl")) / 100).cast("long").alias("pl"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {micro_sql('pow(10, -(l_quantity % 7) / 10) / (pow(10, -(l_quantity % 7) / 10) + pow(10, -(l_partkey % 9) / 10.0::DOUBLE) + 1)')} AS first FROM lineitem")
def phred_likelihood(spark, d):
    gl = X.phred_to_likelihood(F.array(F.col("l_quantity") % 7, (F.col("l_partkey") % 9).cast("double"), F.lit(0.0)))
    none = (F.col("l_quantity") % 7 == 0) & (F.col("l_partkey") % 9 == 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.micro(F.when(none, F.lit(1.0) / 3).otherwise(gl[0])).alias("first"))


@query(f"WITH v AS (SELECT user_id, max(value) AS top FROM events GROUP BY user_id) SELECT user_id, {micro_sql('any_value(top) + ln(sum(exp(value - top)))')} // 10 AS lse FROM events JOIN v USING (user_id) GROUP BY user_id")
def logsumexp(spark, d):
    return A.log_sum_exp(table(spark, d, "events"), ["user_id"], "value", "lse").select("user_id", F.floor(X.micro(F.col("lse")) / 10).cast("long").alias("lse"))


@query("SELECT s_suppkey, CAST(s_suppkey * (s_suppkey - 1) // 2 AS BIGINT) AS pairs, CAST((s_suppkey + 2) * (s_suppkey + 1) * s_suppkey // 6 AS BIGINT) AS multi, CAST(s_suppkey * (s_suppkey + 1) // 2 AS BIGINT) AS triangle FROM supplier")
def combinatorics(spark, d):
    n = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", X.choose(n, F.lit(2)).alias("pairs"), X.multichoose(n, F.lit(3)).alias("multi"), X.triangular(n).cast("long").alias("triangle"))


@query(f"""WITH e AS ({ENDS_SQL}), w AS (SELECT sample, list("start" ORDER BY contig) AS x FROM e GROUP BY sample), n AS (SELECT sample AS a, lead(sample) OVER (ORDER BY sample) AS b, x, lead(x) OVER (ORDER BY sample) AS y FROM w)
SELECT a, b, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] <> y[i])::INT)) AS BIGINT) AS distance FROM n WHERE len(x) = len(y)""")
def hamming(spark, d):
    states = ends(spark, d).groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("contig", "start"))), lambda z: z["start"]).alias("x"))
    numbered = global_index(states, ["sample"], "n")
    both = numbered.select("n", F.col("sample").alias("a"), "x").join(numbered.select((F.col("n") - 1).alias("n"), F.col("sample").alias("b"), F.col("x").alias("y")), "n")
    return both.where(F.size("x") == F.size("y")).select("a", "b", X.hamming(F.col("x"), F.col("y")).cast("long").alias("distance"))


# sequences


@query("SELECT page_id, reverse(translate(url, 'ACGTNacgtn', 'TGCANtgcan')) AS revcomp FROM pages")
def revcomp(spark, d):
    return table(spark, d, "pages").select("page_id", S.reverse_complement(F.col("url")).alias("revcomp"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '(.{10})', '\\1\n', 'g'), '\n$', '') AS wrapped FROM pages")
def wrap_lines(spark, d):
    return table(spark, d, "pages").select("page_id", S.wrap(F.col("url"), 10).alias("wrapped"))


@query("SELECT n_regionkey AS object, string_agg(CASE WHEN n_nationkey % 2 = 1 THEN reverse(translate(n_name, 'ACGTNacgtn', 'TGCANtgcan')) ELSE n_name END, 'nnnnn' ORDER BY n_nationkey) AS seq FROM nation GROUP BY 1")
def polyn_join(spark, d):
    from loomspan.sources.sequences import assemble

    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("object"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("seq"), F.when(F.col("n_nationkey") % 2 == 1, "-").otherwise("+").alias("strand"))
    return assemble(rows, 5)


@query("SELECT doc_id, i AS piece, substr(text, 1 + 1000 * (i - 1), 1000) AS part FROM (SELECT doc_id, text, unnest(range(1, 2 + (length(text) - 1) // 1000)) AS i FROM documents WHERE length(text) > 0)")
def breakpoint_chunks(spark, d):
    spans = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1000).cast("int")), lambda i: F.struct((1 + 1000 * i).alias("start"), (1000 + 1000 * i).alias("stop")))
    return J.pieces(table(spark, d, "documents").where(F.length("text") > 0), spans, "text").select("doc_id", F.col("piece").cast("long").alias("piece"), "part")


@query("SELECT page_id, CAST(len(list_filter(range(1, length(url)), lambda i: substr(url, i, 2) = 'th')) AS BIGINT) AS sites FROM pages")
def digest_sites(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(S.motif_sites(F.col("url"), "th")).cast("long").alias("sites"))


# evaluation


@query(f"""WITH e AS ({_BIN}), c AS (SELECT contig, sum((s = e)::INT) AS same, count(*) AS n FROM e GROUP BY contig) SELECT contig, {micro_sql('greatest(same, n - same) / n::DOUBLE')} AS accuracy FROM c""")
def eval_accuracy(spark, d):
    ones = ["click", "purchase", "signup"]
    x = ends(spark, d).select("contig", F.col("start").isin(ones).alias("s"), F.col("stop").isin(ones).alias("e"))
    both = x.select("contig", (F.col("s") == F.col("e")).alias("ok"), F.lit(0).alias("k")).union(x.select("contig", F.col("s") != F.col("e"), F.lit(1)))
    each = both.groupBy("contig", "k").agg(A.accuracy(F.col("ok").cast("int"), F.lit(1)).alias("accuracy"))
    return each.groupBy("contig").agg(F.max("accuracy").alias("accuracy")).select("contig", *micro("accuracy"))


@query("SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY md5(CAST(s_suppkey AS VARCHAR))) AS n FROM supplier) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) USING (n)")
def sample_barcodes(spark, d):
    return J.zipped(table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "customer").select("c_custkey"), [F.md5(F.col("s_suppkey").cast("string").cast("binary"))], ["c_custkey"])


@query(f"""WITH RECURSIVE p AS ({PAIRS_SQL}), e AS (SELECT a, b FROM p WHERE common >= (SELECT quantile_disc(common, 0.9) FROM p)), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(v, l) AS (SELECT a, a FROM g UNION SELECT g.b, r.l FROM r JOIN g ON g.a = r.v) SELECT v, min(l) AS label FROM r GROUP BY v""")
def linkage_components(spark, d):
    from loomspan.operators.grouping import connected_components

    p = supplier_pairs(spark, d)
    # rank of the 0.9 discrete quantile
    cut = p.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY common)").alias("cut"))
    return connected_components(p.join(F.broadcast(cut)).where("common >= cut").select("a", "b"))


@query("""WITH c AS (SELECT l_partkey AS site, l_suppkey AS sample, sum((l_linestatus = 'F')::INT) AS a, sum((l_linestatus = 'O')::INT) AS b FROM lineitem GROUP BY ALL),
p AS (SELECT *, a * log10(0.99) + b * log10(0.01) AS l0, a * log10(0.5) + b * log10(0.5) AS l1, a * log10(0.01) + b * log10(0.99) AS l2 FROM c)
SELECT site, sample, CASE WHEN l0 >= l1 AND l0 >= l2 THEN '0/0' WHEN l1 >= l2 THEN '0/1' ELSE '1/1' END AS gt FROM p""")
def genotype_calls(spark, d):
    from loomspan.operators.segregation import called_dosage, genotype_text

    of = lambda status: F.sum((F.col("l_linestatus") == status).cast("int"))
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("sample")).agg(of("F").alias("a"), of("O").alias("b"))
    return c.select("site", "sample", genotype_text(called_dosage(F.col("a"), F.col("b"), 2), 2).alias("gt"))


# kernels: no SQL can state these; tests hold them against enumeration and planted truth


def _event_pairs(spark, d):
    pairs = twopoint.two_state(ends(spark, d), "contig", "sample", "start", "stop")
    return pairs.withColumns({c: F.concat(F.lit("c"), F.col(c).cast("string")) for c in "ab"})


def _event_contigs(spark, d):
    return markers(spark, d).select(F.concat(F.lit("c"), F.col("contig").cast("string")).alias("contig")).distinct()


@query()
def dag_path(spark, d):
    from loomspan.operators import mapping

    near = J.band(W.forward_bound(_numbered(spark, d), ["sample"], "pos", 3, 20000), ["sample"], "ix", "last", ["value", "pos", "m"])
    rf = F.least(F.abs(F.col("value_u") - F.col("value_v")) / 1000, F.lit(0.5))
    return mapping.marker_paths(near.select(F.col("sample").cast("string").alias("contig"), "u", "v", rf.alias("rf"), F.abs(F.col("pos_v") - F.col("pos_u")).cast("double").alias("bp"), F.col("m_u").alias("m")))


@query()
def nn_join(spark, d):
    from loomspan.operators import mapping

    return mapping.superscaffolds(_event_pairs(spark, d), _event_contigs(spark, d), 0.85)


@query()
def linkage_groups(spark, d):
    from loomspan.operators import mapping

    return mapping.linkage_groups(_event_pairs(spark, d), _event_contigs(spark, d), 1.0, -1e9)


@query()
def order_groups(spark, d):
    from loomspan.operators import mapping

    pairs = _event_pairs(spark, d)
    return mapping.ordered_groups(pairs, _event_contigs(spark, d).withColumn("lg", F.lit(1).cast("long")))


@query()
def assembled_map(spark, d):
    from loomspan.operators import mapping

    lengths = _event_contigs(spark, d).withColumn("own_cm", F.lit(10.0))
    return mapping.assembled_map(order_groups(spark, d), lengths)


@query()
def simulate_population(spark, d):
    from loomspan.plans import programs

    chromosomes = table(spark, d, "region").select(F.col("r_name").alias("chrom"), F.lit(40_000).cast("long").alias("length"))
    return programs.popsimulation(spark, chromosomes, 12, 4, 3)


@query()
def simulate_reads(spark, d):
    from loomspan.operators import simulate

    letters = F.regexp_replace(F.translate(F.lower("s_name"), "abcdefghijklmnopqrstuvwxyz0123456789#", "ACGTACGTACGTACGTACGTACGTACGTACGTACGTAC"), "[^ACGT]", "")
    seqs = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.repeat(letters, 30), F.lit("GCAGC"), F.repeat(letters, 20)).alias("seq"))
    return simulate.reads(simulate.fragments(seqs, "ApeKI"), 2, 1, "ACTG", 7)


@query()
def hmm_fit(spark, d):
    from loomspan.operators import simulate
    from loomspan.plans import programs

    chromosomes = table(spark, d, "region").select(F.col("r_name").alias("chrom"), F.lit(15_000).cast("long").alias("length"))
    truth = programs.popsimulation(spark, chromosomes, 34, 2, 3)
    return programs.haplotyper(simulate.depths(truth, 10, 3), ["P1", "P2"], 2, repeats=2, seed=5, max_iter=20).select("contig", "rep", "loglik", "sample", "dosage")


@query()
def segregation_test(spark, d):
    from loomspan.operators import segregation

    counts = segregation_counts(spark, d)
    sites = counts.select("site", F.array("class_0", "class_1", "class_2").alias("counts"), F.lit(1).alias("dosage_a"), F.lit(1).alias("dosage_b"))
    return segregation.segregation_test(sites, 2).select("site", *micro("p"))


from loomspan.plans import files  # noqa: E402, F401  (registers its queries)
