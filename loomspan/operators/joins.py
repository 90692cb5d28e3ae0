"""Joins: pairs, set intersections, bands, breakpoints, orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.numbering import global_index


#: Rows of a dimension that is paired with itself.
MAX_PAIRED = 5000


def pairs(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """All unordered pairs a < b of a small dimension (contigs, groups), which is broadcast; a larger table is refused."""
    if df.limit(MAX_PAIRED + 1).count() > MAX_PAIRED:
        raise ValueError(f"all pairs of over {MAX_PAIRED} rows: join on what the rows share instead")
    a = df.select(*[F.col(c).alias(f"{c}_a") for c in cols])
    b = df.select(*[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(F.broadcast(b), F.col(f"{key}_a") < F.col(f"{key}_b"))


def shared_members(df: DataFrame, group: str, member: str, extra: list[str] | None = None) -> DataFrame:
    """Size of the intersection of every two groups that meet: an equi-join on the member, not a product of groups."""
    extra = extra or []
    rows = df.select(group, member, *extra).distinct()
    a = rows.select(member, F.col(group).alias("a"), *[F.col(c).alias(f"{c}_a") for c in extra])
    b = rows.select(member, F.col(group).alias("b"), *[F.col(c).alias(f"{c}_b") for c in extra])
    keys = ["a", "b", *[f"{c}_{s}" for c in extra for s in "ab"]]
    return a.join(b, member).where("a < b").groupBy(*keys).agg(F.count("*").alias("common"))


def overlaps(df: DataFrame, group: str, member: str, within: Column | None = None) -> DataFrame:
    """a, b (a < b), common, n: every two groups that meet, with the size of their intersection and of the smaller of the two.

    Pairs aren't shuffled one by one: a member sends each of its groups the list of those that follow it by (size, group),
    so a pair is counted where its smaller group is. ``within``: an expression of the group ``g`` that both must share. A
    null member adds to the size and meets none.
    """
    rows = df.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g IS NOT NULL").repartition("g").distinct()
    keys = ["m"] if within is None else ["m", "w"]
    rows = rows.select("g", "m", F.count("*").over(Window.partitionBy("g")).alias("n"), *([] if within is None else [within.alias("w")])).where("m IS NOT NULL")
    lists = rows.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("l")).where(F.size("l") > 1)
    flat = lists.select(F.col("l.n").alias("ns"), F.col("l.g").alias("gs"))
    sent = flat.select("ns", "gs", F.posexplode("gs").alias("i", "g")).where(F.col("i") < F.size("gs") - 1)
    sent = sent.select("g", F.get("ns", F.col("i")).alias("n"), F.slice("gs", F.col("i") + 2, F.size("gs")).alias("others")).repartition("g")
    counts = sent.select("g", "n", F.explode("others").alias("o")).groupBy("g", "n", "o").agg(F.count("*").alias("common"))
    return counts.select(F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b"), "common", "n")


def band(df: DataFrame, part: list[str], ix: str, last: str, cols: list[str]) -> DataFrame:
    """Each row with the rows after it up to its own ``last`` (numbers without gaps): an equi-join on (group, index) after
    exploding a row's reach, so no more rows are made than there are pairs, and a long group isn't one key."""
    reach = F.sequence(F.col(ix) + 1, F.col(last).cast(df.schema[ix].dataType))
    a = df.where(F.col(last) > F.col(ix)).select(*part, F.col(ix).alias("u"), F.explode(reach).alias("v"), *[F.col(c).alias(f"{c}_u") for c in cols])
    b = df.select(*part, F.col(ix).alias("v"), *[F.col(c).alias(f"{c}_v") for c in cols])
    return a.join(b, [*part, "v"])


def sub_contig(df: DataFrame, breaks: DataFrame, key: str, pos: str, left: str = "left") -> DataFrame:
    """``piece``: 1 + breakpoints of the row's key whose left end is below its position."""
    per_key = breaks.groupBy(key).agg(F.array_sort(F.collect_list(left)).alias("_breaks"))
    below = F.size(F.filter("_breaks", lambda x: x < F.col(pos)))
    return df.join(per_key, key, "left").withColumn("piece", F.when(F.col("_breaks").isNull(), 1).otherwise(1 + below).cast("long")).drop("_breaks")


def pieces(df: DataFrame, spans: Column, seq: str) -> DataFrame:
    """Sub-sequences of 1-based closed spans (array of structs start, stop), numbered from 1."""
    out = df.select("*", F.posexplode(spans).alias("_n", "_s"))
    return out.withColumn("piece", F.col("_n") + 1).withColumn("part", F.substring(F.col(seq), F.col("_s.start").cast("int"), (F.col("_s.stop") - F.col("_s.start") + 1).cast("int"))).drop("_n", "_s")


def oriented(rf: list[Column], sign_a: Column, sign_b: Column) -> Column:
    """Of the four fractions (ss, se, es, ee) the one for the strands: a's far end meets b's near end."""
    return F.when(sign_a == "+", F.when(sign_b == "+", rf[2]).otherwise(rf[3])).otherwise(F.when(sign_b == "+", rf[0]).otherwise(rf[1]))


def symmetric(df: DataFrame, a: str, b: str, rf: list[str]) -> DataFrame:
    """Both directions of each pair; the second and third fraction change places."""
    names = {a: b, b: a, rf[1]: rf[2], rf[2]: rf[1]}
    other = df.select(*[F.col(names.get(c, c)).alias(c) for c in df.columns])
    return df.unionByName(other)


def zipped(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """The rows of two lists paired one to one by their (total) orders."""
    return global_index(left, left_order, "_n").join(global_index(right, right_order, "_n"), "_n").drop("_n")


def subsets_removed(sets: DataFrame, key: str, member: str) -> DataFrame:
    """Keys whose members aren't a proper subset of another's (of equal sets the smallest key stays).

    A set that holds another holds its rarest member too, so only the sets with that member are compared with it.
    """
    rows = sets.select(key, member).distinct()
    often = rows.groupBy(member).agg(F.count("*").alias("often"))
    held = rows.join(often, member).groupBy(key).agg(F.min_by(member, F.struct("often", member)).alias("rare"), F.array_sort(F.collect_list(member)).alias("members"))
    small = held.select(F.col(key).alias("a"), F.col("rare").alias(member), F.col("members").alias("ma"))
    large = rows.join(held.select(key, F.col("members").alias("mb")), key).withColumnRenamed(key, "b")
    larger = (F.size("mb") > F.size("ma")) | (F.size("mb") == F.size("ma")) & (F.col("b") < F.col("a"))
    gone = small.join(large, member).where(larger & (F.size(F.array_except("ma", "mb")) == 0))
    return held.select(key, F.size("members").cast("long").alias("size")).join(gone.select(F.col("a").alias(key)).distinct(), key, "left_anti")
