"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's components are dealt to ``LISTS`` lists; a score is the sum of a query's partial scores in them.
1. Each list gives its best entries for each query; these few vectors' whole scores are resolved, and a query's k-th best
   of them is a score that its answer can't fall below.
2. That cutoff, divided by the number of lists, is broadcast: a vector that is under it in every list stays under the
   cutoff, so each list sends only the entries that reach it.
3. What the lists sent bounds a vector's score from above (a missing part is under the threshold); vectors that can still
   reach the cutoff are resolved exactly and ranked.
Equal vectors are one entry with their smallest ids. Queries are worked off in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

SCALE, TOP, LISTS = 1024, 10, 2
#: Queries of a block, about (their vectors and cutoffs are broadcast), and rows that a task scores at once.
QUERY_BLOCK, ROWS = 2048, 4096
#: Below this magnitude, products and sums of scaled components are exact in double precision.
EXACT = 2.0**53
#: Bounds beyond it are doubles; what rounding can take from one, relative to its size.
ROUNDING = 2.0**-48


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE)


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the usable vectors of an Arrow list column, and their components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    ok = sizes > 0
    bad = ~np.isfinite(values)
    row = np.repeat(np.arange(n), sizes)
    ok[row[bad]] = False
    dims = np.unique(sizes[ok])
    if len(dims) > 1:
        raise ValueError(f"vectors of {len(dims)} different lengths")
    use = np.flatnonzero(ok)
    return use, values[ok[row]].reshape(len(use), dims[0] if len(dims) else 0)


def _classes(most: int):
    """Scaled vectors as bytes, with up to ``most`` + 1 smallest ids of each batch."""

    def run(batches):
        for batch in batches:
            use, values = _matrix(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)[use]
            known: dict[bytes, list[int]] = {}
            for k, v in sorted(set(zip(ids.tolist(), map(np.ndarray.tobytes, scaled(values)), strict=True))):
                own = known.setdefault(v, [])
                if len(own) <= most:
                    own.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.binary()), pa.array(list(known.values()), pa.list_(pa.int64()))], ["vector", "ids"])

    return run


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products, as doubles where these are exact and as Python integers beyond."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if most < EXACT:
        return queries @ vectors.T
    whole = [[sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for v in vectors.tolist()] for q in queries.tolist()]
    return np.array(whole, dtype=object).reshape(len(queries), len(vectors))


def _unpack(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def _parts(dim: int) -> list[np.ndarray]:
    return [np.arange(dim)[j::LISTS] for j in range(LISTS)]


def _list_scan(queries_held, cutoff_held, most: int):
    """Entries (query, list, class, partial) of each list: its best without a cutoff, else all that reach the threshold."""

    def run(batches):
        queries = queries_held.value
        cutoffs = cutoff_held.value if cutoff_held else None
        best: dict[int, list[np.ndarray]] = {}

        def out(q, j, c, p):
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([j] * len(q), pa.int32()), pa.array(c, pa.int64()), pa.array(np.asarray(p, np.float64))], ["q", "list", "cid", "part"])

        for batch in batches:
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            for j in np.unique(lists):
                own = np.flatnonzero(lists == j)
                cids = batch.column(1).to_numpy(zero_copy_only=False)[own]
                vectors = _unpack(batch.column(2).take(pa.array(own)))
                cols = _parts(queries.shape[1])[j]
                for i in range(0, len(own), ROWS):
                    scores = _products(queries[:, cols], vectors[i : i + ROWS]).astype(np.float64)
                    if cutoffs is not None:
                        bound = np.where(np.isfinite(cutoffs), cutoffs / LISTS - ROUNDING * np.abs(cutoffs), cutoffs)
                        q, c = np.nonzero(scores + ROUNDING * np.abs(scores) >= bound[:, None])
                        yield out(q, j, cids[i + c], scores[q, c])
                        continue
                    k = min(most + 1, scores.shape[1])
                    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    s, c = np.take_along_axis(scores, top, 1), cids[i + top]
                    if j in best:
                        s, c = np.hstack((best[j][0], s)), np.hstack((best[j][1], c))
                    k = min(most + 1, s.shape[1])
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    best[j] = [np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)]
        for j, (s, c) in best.items():
            q = np.repeat(np.arange(len(s)), s.shape[1])
            yield out(q, j, c.ravel(), s.ravel())

    return run


def _resolve(queries_held):
    """Whole scores (query, class, score, ids) of rows q, cid, vector, ids."""

    def run(batches):
        queries = queries_held.value
        for batch in batches:
            q = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = _unpack(batch.column(2))
            if np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1]) < EXACT:
                score = np.einsum("ij,ij->i", queries[q], vectors) if len(q) else np.zeros(0)
                score = pa.array(score.astype(np.int64))
            else:
                score = pa.array([sum(int(a) * int(b) for a, b in zip(queries[i].tolist(), v, strict=True)) for i, v in zip(q, vectors.tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score, batch.column(3)], ["q", "cid", "score", "ids"])

    return run


def exact_top_k(vectors: DataFrame, scratch: Scratch, k: int = TOP, every: int = 100) -> DataFrame:
    """The k best rows for each query (ids divisible by ``every``): query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding. Components become floor(1024 x); scores are their integer inner products. A row
    isn't its own query's candidate; ties go to the smaller vec_id. Null and empty vectors, and those with null or
    non-finite components, take no part, as rows without an id. A repeated id counts once for each of its scores. Scores
    beyond double precision are whole numbers all the same; one beyond 64 bits is an error. A table with one usable row
    gives no rows; other columns are ignored. Vectors must have one length.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL")
    merged = own.mapInArrow(_classes(k), "vector binary, ids array<long>").groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    classes = scratch.keep(merged.select(F.element_at("ids", 1).alias("cid"), "ids", "vector"), "classes")
    # a repeated id with different vectors is several entries: the class is named by the id and a hash
    classes = classes.withColumn("cid", F.xxhash64("cid", "vector"))
    dim = classes.select((F.octet_length("vector") / 8).cast("int")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not dim:
        return empty
    halves = _split_lists(classes, dim[0])
    lists = scratch.keep(halves, "lists")
    asked = own.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        arrow = pa.array([r["embedding"] for r in block], pa.list_(pa.float64()))
        use, values = _matrix(arrow)
        if not len(use):
            continue
        ids = np.array([block[i]["vec_id"] for i in use], np.int64)
        queries = scaled(values)
        held = spark.sparkContext.broadcast(queries)
        found = _block(classes, lists, scratch, held, k, ids)
        out = found if out is None else out.union(found)
    return out if out is not None else empty


def _split_lists(classes: DataFrame, dim: int) -> DataFrame:
    cols = _parts(dim)

    def run(batches):
        for batch in batches:
            vectors = _unpack(batch.column(1))
            for j in range(LISTS):
                part = np.ascontiguousarray(vectors[:, cols[j]]) if len(vectors) else vectors
                yield pa.RecordBatch.from_arrays([pa.array([j] * batch.num_rows, pa.int32()), batch.column(0), pa.array([x.tobytes() for x in part], pa.binary())], ["list", "cid", "part"])

    return classes.select("cid", "vector").mapInArrow(run, "list int, cid long, part binary").repartition(F.col("list"), F.pmod("cid", F.lit(64)))


def _block(classes: DataFrame, lists: DataFrame, scratch: Scratch, held, k: int, ids: np.ndarray) -> DataFrame:
    spark = classes.sparkSession
    n = len(ids)
    entry = "q int, list int, cid long, part double"
    query_ids = spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "q int, query_id long")  # a block of queries
    resolved = "q int, cid long, score long, ids array<long>"

    def whole(pairs: DataFrame) -> DataFrame:
        return pairs.join(classes, "cid").select("q", "cid", "vector", "ids").mapInArrow(_resolve(held), resolved)

    def ranked(scores: DataFrame) -> DataFrame:
        # of a class's ids the smallest k that aren't the query's own can count
        each = scores.join(F.broadcast(query_ids), "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").dropDuplicates(["query_id", "vec_id", "score"])
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = lists.mapInArrow(_list_scan(held, None, k), entry)
    best = first.withColumn("nth", F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("part"), "cid"))).where(F.col("nth") <= k + 1)
    lower = scratch.keep(ranked(whole(best.select("q", "cid").distinct())), "lower")
    floors = lower.where(F.col("rank") == k).select("query_id", "score").collect()  # one row a query of the block
    place = {int(v): i for i, v in enumerate(ids)}
    cutoffs = np.full(n, -np.inf)
    for r in floors:
        cutoffs[place[r["query_id"]]] = r["score"]
    cutoff_held = spark.sparkContext.broadcast(cutoffs)
    sent = lists.mapInArrow(_list_scan(held, cutoff_held, k), entry)
    bounds = sent.groupBy("q", "cid").agg(F.sum("part").alias("known"), F.count("*").alias("lists"))
    cutoff = spark.createDataFrame([(i, float(c)) for i, c in enumerate(cutoffs)], "q int, cutoff double")
    most = F.col("known") + (LISTS - F.col("lists")) * F.col("cutoff") / LISTS
    slack = F.lit(ROUNDING) * (F.abs("known") + F.abs("cutoff"))
    able = bounds.join(F.broadcast(cutoff), "q").where((F.col("cutoff") == float("-inf")) | (most + slack >= F.col("cutoff")))
    return scratch.keep(ranked(whole(able.select("q", "cid"))), "block")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), Scratch(spark, "topk"))


OP5_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
