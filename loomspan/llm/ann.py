"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample by k-means with a charge on full lists. Every vector goes to its nearest list and,
if it lies near a boundary, to a few more whose centroids are almost as near. A query walks an in-memory graph of the
centroids best first and reads the lists whose centroid is within a ratio of the nearest one's distance.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table
from .topk import _matrix

TOP = 10
#: Vectors that the centroids are fitted on, about; vectors a list, on the mean; most centroids (broadcast, 8 MB at 256 dimensions).
SAMPLE, LIST, MAX_LISTS = 20_000, 100, 4096
#: A vector is replicated to lists within this ratio of its nearest centroid's distance, to so many lists at most.
REPLICA_RATIO, REPLICAS = 1.1, 4
#: Lists within this ratio of a query's nearest centroid's distance are read.
PROBE_RATIO = 1.2
DEGREE, ENTRIES = 24, 4
BALANCE, ROUNDS = 0.02, 8
QUERY_BLOCK = 2048
#: Rows of a list beyond these go to another part of it.
PART = 50_000


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0)


def rounding(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What ``squared`` of vectors that were rounded when the centre was taken off them may be off by."""
    return 8 * (a.shape[1] + 8) * np.finfo(np.float64).eps * ((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :])


def balanced_kmeans(sample: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    spread = float(sample.var(axis=0).sum())
    sizes = np.full(lists, len(sample) / lists)
    for _ in range(ROUNDS):
        nearest = np.concatenate([(squared(sample[i : i + 4096], centroids) + BALANCE * spread * (sizes * lists / len(sample) - 1)).argmin(1) for i in range(0, len(sample), 4096)])
        sizes = np.bincount(nearest, minlength=lists)
        order = np.argsort(nearest, kind="stable")
        ends = np.cumsum(sizes)
        for j in range(lists):
            centroids[j] = sample[order[ends[j] - sizes[j] : ends[j]]].mean(axis=0) if sizes[j] else sample[rng.integers(len(sample))]
    return centroids


@dataclass
class Index:
    """Centroids of the vectors less their centre, with links to near ones: far from the origin differences would drown in rounding."""

    centroids: np.ndarray
    graph: list[np.ndarray]
    centre: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, centre: np.ndarray, seed: int = 13) -> "Index":
        """Each centroid's nearest ones, the reverse links, and two random ones that keep the graph connected."""
        n = len(centroids)
        rng = np.random.default_rng(seed)
        links: list[set[int]] = [set() for _ in range(n)]
        for i in range(0, n, 512):
            near = np.argsort(squared(centroids[i : i + 512], centroids), axis=1)[:, : DEGREE + 1]
            for k, row in enumerate(near.tolist(), i):
                for j in row:
                    if j != k:
                        links[k].add(j)
                        links[j].add(k)
        for k in range(n):
            for j in {(k + 1) % n, int(rng.integers(n))} - {k}:
                links[k].add(j)
                links[j].add(k)
        return cls(centroids, [np.array(sorted(x), np.int64) for x in links], centre)

    def lists(self, query: np.ndarray, ratio: float) -> np.ndarray:
        """Lists within ``ratio`` of the nearest centroid that the walk finds."""
        n = len(self.centroids)
        seen = np.zeros(n, bool)
        distance = np.full(n, np.inf)
        start = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))
        heap: list[tuple[float, int]] = []
        best = np.inf

        def reach(nodes: np.ndarray) -> None:
            nonlocal best
            nodes = nodes[~seen[nodes]]
            if len(nodes):
                seen[nodes] = True
                d = np.sqrt(((self.centroids[nodes] - query) ** 2).sum(axis=1))
                distance[nodes] = d
                best = min(best, float(d.min()))
                for x in zip(d.tolist(), nodes.tolist(), strict=True):
                    heapq.heappush(heap, x)

        reach(start)
        slack = 0
        while heap:
            d, k = heapq.heappop(heap)
            # a few steps outside the ratio lead over gaps in the graph
            slack = slack + 1 if d > best * ratio else 0
            if slack > DEGREE:
                break
            reach(self.graph[k])
        return np.flatnonzero(distance <= best * ratio)


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as packed doubles, without rows that take no part."""

    def run(batches):
        for batch in batches:
            use, values = _matrix(batch.column(1))
            some = values.any(axis=1) if values.size else np.zeros(len(use), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(use[some])), pa.array([x.tobytes() for x in values[some]], pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL").mapInArrow(run, "vec_id long, v binary")


def _rows(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _assign(index_held):
    """(list, vec_id, v): a vector's nearest list, and near ones. Rows: vec_id, v."""

    def run(batches):
        centroids, centre = index_held.value.centroids, index_held.value.centre
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                d = np.sqrt(squared(_rows(part.column(1)) - centre, centroids))
                k = min(REPLICAS, d.shape[1])
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                own = np.take_along_axis(d, near, 1)
                row, col = np.nonzero(own <= own.min(axis=1)[:, None] * REPLICA_RATIO)
                yield pa.RecordBatch.from_arrays([pa.array(near[row, col]), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["list", "vec_id", "v"])

    return run


def _probe(index_held, ratio: float):
    """(q, list) of the lists that each query reads. Rows: q, v."""

    def run(batches):
        index = index_held.value
        for batch in batches:
            for q, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = index.lists(np.frombuffer(v.as_buffer(), np.float64) - index.centre, ratio)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(found), pa.int32()), pa.array(found)], ["q", "list"])

    return run


def _kth(rough: np.ndarray, vec_ids: np.ndarray, k: int) -> np.ndarray | float:
    """Each query's k-th smallest distance among different ids; infinity if there are fewer."""
    order = np.argsort(vec_ids, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], vec_ids[order[1:]] != vec_ids[order[:-1]])))
    if len(starts) < k:
        return np.inf
    if len(starts) < len(order):
        rough = np.minimum.reduceat(rough[:, order], starts, axis=1)
    return np.partition(rough, k - 1, axis=1)[:, k - 1]


def _search(index_held, block_held, k: int):
    """A task's k nearest for each query of the block: q, vec_id, score. Rows: list, vec_id, v."""

    def run(batches):
        queries, ids, readers = block_held.value
        centre = index_held.value.centre
        centred = queries - centre
        best_d = np.full((len(ids), k), np.inf)
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            for j in np.unique(lists):
                reading = readers.get(int(j))
                if reading is None:
                    continue
                at = np.flatnonzero(lists == j)
                vec_ids = batch.column(1).to_numpy(zero_copy_only=False)[at]
                vectors = _rows(batch.column(2).take(pa.array(at)))
                near = vectors - centre
                rough, off = squared(centred[reading], near), rounding(centred[reading], near)
                rough[ids[reading][:, None] == vec_ids[None, :]] = np.inf
                limit = np.minimum(best_d[reading, -1] ** 2 * (1 + 1e-12), _kth(rough + off, vec_ids, k))
                close = (rough - off <= limit[:, None]) & np.isfinite(rough)
                for i in np.flatnonzero(close.any(axis=1)):
                    cols = np.flatnonzero(close[i])
                    q = reading[i]
                    d = np.sqrt(((vectors[cols] - queries[q]) ** 2).sum(axis=1))
                    all_d, all_id = np.concatenate((best_d[q], d)), np.concatenate((best_id[q], vec_ids[cols]))
                    order = np.lexsort((all_id, all_d))
                    all_d, all_id = all_d[order], all_id[order]
                    # replicas and repeated rows come side by side: same id, same distance
                    new = np.ones(len(order), bool)
                    new[1:] = (all_id[1:] != all_id[:-1]) | (all_d[1:] != all_d[:-1])
                    new &= np.isfinite(all_d)
                    n = min(k, int(new.sum()))
                    best_d[q], best_id[q] = np.inf, np.iinfo(np.int64).max
                    best_d[q, :n], best_id[q, :n] = all_d[new][:n], all_id[new][:n]
        q, c = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_id[q, c]), pa.array(best_d[q, c])], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, scratch: Scratch, k: int = TOP, every: int = 100, probe_ratio: float = PROBE_RATIO) -> DataFrame:
    """The k nearest rows found for each query (ids divisible by ``every``): query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; the score is the Euclidean distance of the original vectors in double precision.
    A row isn't its own query's candidate; ties go to the smaller vec_id. Null, empty and zero vectors, those with null or
    non-finite components, and rows without an id take no part. All vectors have one length. Every usable vector is in
    the index, whatever the size of its lists; the sample only places the centroids. With a ``probe_ratio`` of infinity
    every list is read and the result is exact: rough distances carry a bound of their rounding. A distance that overflows
    double precision is no neighbour. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = scratch.keep(_usable(vectors), "usable")
    n = usable.count()
    if not n:
        return empty
    drawn = usable.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / n) * (1 << 30)))).select("v", "vec_id").limit(2 * SAMPLE).collect()
    drawn = drawn or usable.select("v", "vec_id").limit(SAMPLE).collect()
    drawn.sort(key=lambda r: (r["vec_id"], bytes(r["v"])))
    sample = np.stack([np.frombuffer(r["v"], np.float64) for r in drawn])
    lists = max(1, min(MAX_LISTS, n // LIST, len(np.unique(sample, axis=0))))
    centre = sample.mean(axis=0)
    index_held = spark.sparkContext.broadcast(Index.build(balanced_kmeans(sample - centre, lists), centre))
    postings = usable.mapInArrow(_assign(index_held), "list long, vec_id long, v binary")
    # parts of a list are dealt by id, so that a list of any length is read by several tasks
    parts = max(1, -(-n * REPLICAS // PART))
    postings = scratch.keep(postings.repartition(F.col("list"), F.pmod(F.xxhash64("vec_id"), F.lit(parts))).sortWithinPartitions("list", "vec_id"), "postings")
    asked = usable.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not block:
            continue
        ids = np.array([r["vec_id"] for r in block], np.int64)
        queries = np.stack([np.frombuffer(r["v"], np.float64) for r in block])
        asked_rows = spark.createDataFrame([(i, bytes(r["v"])) for i, r in enumerate(block)], "q int, v binary").repartition(8)
        probes = asked_rows.mapInArrow(_probe(index_held, probe_ratio), "q int, list long").groupBy("list").agg(F.collect_list("q").alias("q")).collect()  # a block's queries by at most MAX_LISTS lists
        readers = {r["list"]: np.array(sorted(r["q"]), np.int64) for r in probes}
        held = spark.sparkContext.broadcast((queries, ids, readers))
        found = postings.mapInArrow(_search(index_held, held, k), "query_id long, vec_id long, score double").distinct()
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        ranked = scratch.keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "block")
        out = ranked if out is None else out.union(ranked)
    return out if out is not None else empty


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), Scratch(spark, "ann"))
