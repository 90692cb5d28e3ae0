"""Sharding by a k-d tree over document metadata.

The tree splits the bytes of the corpus until its leaves hold the target bytes. Each node is cut along its widest dimension
at the weighted quantile that gives both sides their share of leaves. The quantiles of all nodes of a level and of all
dimensions come from one histogram a digit; only these and the nodes' extents reach the driver, and the tree itself becomes
one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, table

#: A coordinate has 20 bits; 42 bits below it, a hash of the text and the dimension, order the groups that share a coordinate.
COORD_BITS, TIE_BITS, DIGIT = 20, 42, 10
#: A cut within this part of a leaf of its goal is good; else the next widest dimension is looked at, and the nearest cut taken.
NEAR = 0.01
#: Pieces that a leaf's bytes of one text are cut into, if all rows of this text weigh more than a leaf.
PIECES = 64
#: Row numbers are given within so many hash buckets of a shard.
SLOT_BUCKETS = 256


@dataclass
class Node:
    leaves: int
    first: int
    dim: str | None = None
    cut: int | None = None
    left: "Node | None" = None
    right: "Node | None" = None

    def open(self) -> list["Node"]:
        if self.dim is None:
            return [self]
        return self.left.open() + self.right.open()

    def expr(self, value) -> Column:
        if self.dim is None:
            return F.lit(value(self))
        return F.when(_key(self.dim) < F.lit(self.cut), self.left.expr(value)).otherwise(self.right.expr(value))


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(f"x_{dim}").cast("long"), TIE_BITS) + F.shiftrightunsigned(F.xxhash64("tie", F.lit(dim)), 64 - TIE_BITS)


def _cuts(held: DataFrame, dims: list[str], goal: dict[int, float], tolerance: int) -> dict[tuple[int, str], tuple[int, float]]:
    """Cut of each node along each dimension, and the weight by which the side below it misses the goal.

    Digits of the key are counted from the highest; only the digit that holds the goal is opened further.
    """
    todo = {(k, d) for k in goal for d in dims}
    prefix, below, cut = dict.fromkeys(todo, 0), dict.fromkeys(todo, 0), dict.fromkeys(todo, 0)
    found = set(todo)
    keys = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), _key(d).alias("key")) for d in dims])).alias("k")
    spread = held.select("node", "weight", keys).select("node", "weight", "k.dim", "k.key")
    shift = COORD_BITS + TIE_BITS
    while todo and shift > 0:
        high, shift = shift, max(0, shift - DIGIT)
        places = F.create_map(*[x for k, d in sorted(todo) for x in (F.lit(f"{k} {d}"), F.lit(prefix[k, d]))])
        inside = F.element_at(places, F.concat_ws(" ", F.col("node").cast("string"), F.col("dim"))) == F.shiftright("key", high)
        counted = spread.where(inside).groupBy("node", "dim", F.shiftright("key", shift).alias("digit")).agg(F.sum("weight").alias("w")).collect()  # 2**DIGIT rows a node and dimension at most
        seen: dict[tuple[int, str], list] = {}
        for r in counted:
            seen.setdefault((r["node"], r["dim"]), []).append((r["digit"], r["w"]))
        for at in list(todo):
            for digit, w in sorted(seen.get(at, [])):
                if below[at] + w <= goal[at[0]]:
                    below[at] += w
                    cut[at] = (digit + 1) << shift
                    continue
                cut[at], prefix[at] = digit << shift, digit
                if w <= tolerance or shift == 0:
                    if goal[at[0]] - below[at] > w / 2:
                        cut[at] = (digit + 1) << shift
                        below[at] += w
                    todo.discard(at)
                break
            else:
                todo.discard(at)
    return {at: (cut[at], abs(below[at] - goal[at[0]])) for at in found}


def _split(points: DataFrame, root: Node, dims: list[str], target: int) -> None:
    """Cut all nodes that still hold several leaves, each at its weighted quantile along its widest dimension.

    Where a few heavy groups keep that cut off its goal, the next widest dimensions are tried, and the nearest cut is taken.
    """
    nodes = {n.first: n for n in root.open() if n.leaves > 1}
    held = points.withColumn("node", root.expr(lambda n: n.first)).where(F.col("node").isin(list(nodes)))
    extents = {
        r["node"]: r
        for r in held.groupBy("node").agg(
            F.sum("weight").alias("w"), *[F.min(f"x_{d}").alias(f"lo_{d}") for d in dims], *[F.max(f"x_{d}").alias(f"hi_{d}") for d in dims]
        ).collect()
    }
    goal = {k: extents[k]["w"] * (nodes[k].leaves // 2) / nodes[k].leaves for k in extents}
    cuts = _cuts(held, dims, goal, max(1, target // 256)) if goal else {}
    for k, n in nodes.items():
        n.dim, n.cut = dims[0], 0
        if k in extents:
            e = extents[k]
            widest = sorted(dims, key=lambda d: (e[f"lo_{d}"] - e[f"hi_{d}"], dims.index(d)))  # noqa: B023
            n.dim = next((d for d in widest if cuts[k, d][1] <= NEAR * target), min(widest, key=lambda d: cuts[k, d][1]))  # noqa: B023
            n.cut = cuts[k, n.dim][0]
        half = n.leaves // 2
        n.left, n.right = Node(half, n.first), Node(n.leaves - half, n.first + half)


def kd_shards(docs: DataFrame, scratch: Scratch, n_shards: int | None = 24, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source"), target_bytes: int | None = None) -> DataFrame:
    """Shard, slot, size and text checksum of every row.

    Nodes are cut until they are one leaf's share: of ``n_shards``, or, with ``target_bytes``, of as many as it takes for
    leaves of that size. Sizes are UTF-8 bytes plus 8; a null text has none. Dimensions are the columns ``dims``, whose
    values, nulls included, lie at a hash of theirs, and the logarithms of the size, the characters and the line ends. Rows
    of equal texts stay together (at the smallest of their values) unless they weigh more than a leaf; then they are dealt
    out in pieces by a hash of the id. Repeated rows count each. An empty table gives no rows. Missing ``dims`` columns are
    left out; other columns are ignored.
    """
    dims = tuple(d for d in dims if d in docs.columns)
    plain = F.coalesce(F.col(text_col), F.lit(""))
    text = plain.cast("binary")
    rows = scratch.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.char_length(plain).cast("long").alias("chars"),
            F.octet_length(F.regexp_replace(plain, "[^\n]+", "")).cast("long").alias("breaks"),
            *[F.col(d).cast("string").alias(f"v_{d}") for d in dims],
        ),
        "rows",
    )
    same = ["h", "text_crc32", "size"]
    total = rows.agg(F.sum("size").alias("w"), F.max("size").alias("most")).first()
    if target_bytes:
        n_shards = max(1, -(-(total["w"] or 0) // target_bytes))
    target = max(1, (total["w"] or 0) // n_shards)
    groups = rows.groupBy(*same).agg(F.count("*").alias("n"), F.min("chars").alias("chars"), F.min("breaks").alias("breaks"), *[F.min(f"v_{d}").alias(f"v_{d}") for d in dims])
    weight = F.col("n") * F.col("size")
    pieces = F.when(weight > F.lit(target), F.ceil(weight * F.lit(PIECES) / F.lit(target))).otherwise(F.lit(1)).cast("long")
    top = F.lit((1 << COORD_BITS) - 1)
    spread = F.ln(F.lit(float((total["most"] or 0) + 2)))
    along = lambda n: F.floor(F.ln(n + 1) / spread * top).cast("long")
    # written before the join, whose large partitions can then be split: a frequent text is one row there
    groups = scratch.keep(groups.withColumn("pieces", F.least(pieces, F.col("n"))), "groups")
    pieced = rows.select("doc_id", *same).join(groups.select(*same, "pieces", "chars", "breaks", *[F.col(f"v_{d}").alias(f"g_{d}") for d in dims]), same)
    piece = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.col("pieces"))
    tie = F.xxhash64("h", "text_crc32", "size", "piece")
    placed = scratch.keep(
        pieced.withColumn("piece", piece).select(
            "doc_id", "size", "text_crc32", tie.alias("tie"),
            along(F.col("size") - 8).alias("x_size"), along(F.col("chars")).alias("x_chars"), along(F.col("breaks")).alias("x_breaks"),
            *[F.shiftright(F.crc32(F.coalesce(F.concat(F.lit("="), F.col(f"g_{d}")), F.lit("")).cast("binary")), 32 - COORD_BITS).alias(f"x_{d}") for d in dims],
        ),
        "placed",
    )
    scratch.drop(rows)
    names = [*dims, "size", "chars", "breaks"]
    points = scratch.keep(placed.groupBy("tie", *[f"x_{d}" for d in names]).agg(F.sum("size").alias("weight")), "points")
    root = Node(n_shards, 0)
    while any(n.leaves > 1 for n in root.open()):
        _split(points, root, names, target)
    sharded = placed.select("doc_id", "size", "text_crc32", "tie", root.expr(lambda n: n.first).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"))
    counts = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "tie")
    numbered = sharded.withColumn("nth", F.row_number().over(inside) - 1)
    # n_shards * SLOT_BUCKETS rows at most
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet, a folder for each shard. Rows with one id and one text share a place in ``shards``."""
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    where = shards.groupBy(F.col("doc_id").alias("id_"), F.col("text_crc32").alias("crc_")).agg(F.min("shard").alias("shard"))
    held = docs.join(where, F.col(id_col).eqNullSafe(F.col("id_")) & (crc == F.col("crc_"))).drop("id_", "crc_")
    held.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(16))).write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), Scratch(spark, "shards"))
