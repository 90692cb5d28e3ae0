"""Mixing sources to target weights by budgets on a domain-language-source tree.

A node's budget is poured over its children in proportion to their weights; a child that can't use its share (its
documents, read ``max_epochs`` times, hold fewer tokens) is filled and the rest goes to its siblings. As capacities are
summed from below first, a shortage reaches a node's own siblings only when the whole node is full. Each leaf then takes
whole epochs and the prefix of one more, in an order seeded for each epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

#: Order keys have 60 bits; the first 10 are a bucket, summed before any row is sorted.
KEY_DIGITS, BUCKET_SHIFT = 15, 50
#: Leaf tables of at most so many rows are broadcast (about 100 bytes a row).
BROADCAST_LEAVES = 20_000
LEVELS = ("domain", "lang", "source")
#: Parts of the budget; a name that isn't listed has weight 1.
WEIGHTS = {"domain": {"d0": 3, "d1": 2, "d2": 1}, "lang": {"en": 4, "de": 3, "fr": 2, "es": 1}, "source": {}}
WORD = r"[^\x20\x09-\x0D]+"


def order_key(seed: int, epoch: Column, ident: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_DIGITS), 16, 10).cast("long")


def default_domain(source: str = "source") -> Column:
    """A stand-in for a domain: three groups of sources by a digit of the hash of their names."""
    digit = F.conv(F.substring(F.md5(F.coalesce(F.col(source), F.lit("")).cast("binary")), 1, 1), 16, 10).cast("long")
    return F.concat(F.lit("d"), (digit % 3).cast("string"))


def _weight(level: str, table_: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in table_.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _pour(children: DataFrame, parent: list[str], budget: Column, capacity: str, weight: str, out: str, order: list[str]) -> DataFrame:
    """Water-filling among siblings: least(capacity, level * weight), rounded down, where the level uses up the budget."""
    ranked = [F.col(capacity) / F.col(weight), *[F.col(o) for o in order]]
    all_ = Window.partitionBy(*parent)
    before = all_.orderBy(*ranked).rowsBetween(Window.unboundedPreceding, -1)
    df = children.withColumn("_b", budget).withColumn("_cap", F.coalesce(F.sum(capacity).over(before), F.lit(0))).withColumn("_w", F.sum(weight).over(all_) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    # the level if this child and all after it were not full; the first child that isn't full sets it
    df = df.withColumn("_open", F.col(capacity) * F.col("_w") > (F.col("_b") - F.col("_cap")) * F.col(weight))
    at = lambda c: F.min(F.when(F.col("_open"), F.struct(F.col(capacity) / F.col(weight), *[F.col(o) for o in order], F.col(c).alias("_v")))).over(all_)["_v"]
    df = df.withColumn("_left", F.col("_b") - F.col("_cap"))
    df = df.withColumn("_l", at("_left")).withColumn("_lw", at("_w"))
    share = F.when(F.col("_l").isNull(), F.col(capacity)).otherwise(F.least(F.col(capacity), F.expr(f"(_l * {weight}) div _lw")))
    return df.withColumn(out, F.greatest(share, F.lit(0)).cast("long")).drop("_b", "_cap", "_w", "_open", "_left", "_l", "_lw")


def leaf_budgets(leaves: DataFrame, total: int, max_epochs: int, weights: dict[str, dict[str, int]], levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Budget of each leaf (rows: the levels, ``tokens``). Names count as they are; nulls are a name of their own ('')."""
    df = leaves.withColumn("capacity_", F.col("tokens") * F.lit(max_epochs))
    budget: Column = F.lit(int(total)).cast("long")
    done: DataFrame | None = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = df.groupBy(*path).agg(F.sum("capacity_").cast("long").alias("capacity")).where("capacity > 0").withColumn("weight", _weight(level, weights.get(level, {})))
        if done is None:
            poured = _pour(nodes.withColumn("_root", F.lit(0)), ["_root"], budget, "capacity", "weight", "budget", [level]).drop("_root")
        else:
            above = done.select(*path[:-1], F.col("budget").alias("_above"))
            poured = _pour(nodes.join(above, path[:-1]), path[:-1], F.col("_above"), "capacity", "weight", "budget", [level]).drop("_above")
        done = poured
    return df.drop("capacity_").join(done.select(*levels, "budget"), list(levels))


def cuts(light: DataFrame, scratch: Scratch, fraction: float, max_epochs: int, seed: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Per leaf: ``full`` epochs, and the last (bucket, key, id) of the partial one. ``light``: doc_id, levels, tokens."""
    leaves = scratch.keep(light.groupBy(*LEVELS).agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("docs")), "leaves")
    corpus = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, int(corpus * fraction), max_epochs, weights)
    budgets = scratch.keep(budgets.withColumn("full", F.expr("budget div tokens")).withColumn("rest", F.col("budget") % F.col("tokens")), "budgets")
    small = budgets.count() <= BROADCAST_LEAVES
    near = F.broadcast(budgets) if small else budgets
    keyed = light.join(near.select(*LEVELS, "full", "rest"), list(LEVELS)).withColumn("key", order_key(seed, F.col("full"), F.col("doc_id"))).withColumn("bucket", F.shiftright("key", BUCKET_SHIFT))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    up = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sums.withColumn("upto", F.sum("t").over(up)).where(F.col("upto") > F.col("rest")).groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("t")).alias("room"))).alias("c")).select(*LEVELS, F.col("c.bucket").alias("cut_bucket"), F.col("c.room").alias("room"))
    cut = scratch.keep(cut, "cut")
    near = F.broadcast(cut) if small else cut
    inside = keyed.join(near, list(LEVELS)).where("bucket = cut_bucket")
    rows = Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.sum("tokens").over(rows)).where(F.col("upto") <= F.col("room")).groupBy(*LEVELS).agg(F.max(F.struct("key", "doc_id")).alias("last"))
    return scratch.keep(budgets.join(cut, list(LEVELS), "left").join(last, list(LEVELS), "left").select(*LEVELS, "budget", "full", "rest", F.coalesce("cut_bucket", F.lit(1 << 10)).alias("cut_bucket"), F.col("last.key").alias("cut_key"), F.col("last.doc_id").alias("cut_id")), "cuts")


def take(rows: DataFrame, chosen: DataFrame, seed: int) -> DataFrame:
    """Rows once for each epoch that selects them, with ``epoch``. ``rows`` has doc_id and the levels."""
    near = F.broadcast(chosen) if chosen.count() <= BROADCAST_LEAVES else chosen
    key = order_key(seed, F.col("full"), F.col("doc_id"))
    df = rows.join(near, list(LEVELS)).withColumn("_key", key)
    bucket = F.shiftright("_key", BUCKET_SHIFT)
    inside = (F.col("_key") < F.col("cut_key")) | ((F.col("_key") == F.col("cut_key")) & (F.col("cut_id").isNull() | (F.col("doc_id") <= F.col("cut_id"))))
    partial = (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & F.coalesce(inside, F.lit(False)))
    partial = partial & (F.col("rest") > 0)
    times = F.col("full") + partial.cast("long")
    return df.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("_key", "cut_bucket", "cut_key", "cut_id", "rest", "full")


def with_levels(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", default_domain()).withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("lang", "source")})


def mix(docs: DataFrame, scratch: Scratch, fraction: float = 0.5, max_epochs: int = 2, seed: int = 17, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """The selected rows (doc_id, domain, lang, source, n_tokens) once for each epoch, with the leaf's budget.

    ``fraction`` of the corpus's tokens (words of the whole text) is the budget of the root. A leaf's partial epoch is
    the longest prefix within its budget. Null languages and sources are one name, ''; texts without words weigh nothing
    and come with the prefix they fall into; leaves without tokens give no rows. Repeated rows count each and tie.
    """
    light = scratch.keep(with_levels(docs).select("doc_id", *LEVELS, F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("tokens")), "light")
    chosen = cuts(light, scratch, fraction, max_epochs, seed, weights or WEIGHTS)
    return take(light, chosen, seed).select("doc_id", *LEVELS, F.col("tokens").alias("n_tokens"), "epoch", "budget")


def mix_documents(docs: DataFrame, scratch: Scratch, fraction: float = 0.5, max_epochs: int = 2, seed: int = 17, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """As ``mix``, but the selected documents themselves, repeated as their epochs say."""
    keep = docs.columns
    hidden = [F.col(c).alias(f"_{c}") for c in keep]
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("tokens")
    light = scratch.keep(with_levels(docs).select("doc_id", *LEVELS, tokens), "light")
    chosen = cuts(light, scratch, fraction, max_epochs, seed, weights or WEIGHTS)
    held = with_levels(docs.select("*", F.struct(*hidden).alias("_row"))).select("doc_id", *LEVELS, "_row")
    return take(held, chosen, seed).select(*[F.col(f"_row._{c}").alias(c) for c in keep])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), Scratch(spark, "mixing"))


def _sql_level(depth: int) -> str:
    path = ", ".join(LEVELS[: depth + 1])
    level = LEVELS[depth]
    weight = "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS[level] else "1"
    parent = ", ".join(LEVELS[:depth]) or "1"
    above = "(SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) FROM leaves)" if depth == 0 else "p.budget"
    join = "" if depth == 0 else f" JOIN l{depth - 1} p USING ({', '.join(LEVELS[:depth])})"
    return f"""n{depth} AS (SELECT n.*, CAST({above} AS BIGINT) AS b FROM (SELECT {path}, CAST(sum(tokens) * 2 AS BIGINT) AS cap, CAST({weight} AS BIGINT) AS w FROM leaves GROUP BY {path} HAVING sum(tokens) > 0) n{join}),
o{depth} AS (SELECT *, CAST(coalesce(sum(cap) OVER q, 0) AS BIGINT) AS pc, CAST(sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER q, 0) AS BIGINT) AS pw FROM n{depth}
  WINDOW q AS (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{depth} AS (SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY CASE WHEN CAST(cap AS HUGEINT) * pw > CAST(b - pc AS HUGEINT) * w THEN 0 ELSE 1 END, CAST(cap AS DOUBLE) / w, {level}) AS nth, CAST(cap AS HUGEINT) * pw > CAST(b - pc AS HUGEINT) * w AS is_open FROM o{depth}),
l{depth} AS (SELECT {path}, CAST(greatest(0, CASE WHEN NOT first_value(is_open) OVER z THEN cap ELSE least(cap, CAST(CAST(first_value(b - pc) OVER z AS HUGEINT) * w // first_value(pw) OVER z AS BIGINT)) END) AS BIGINT) AS budget FROM f{depth} WINDOW z AS (PARTITION BY {parent} ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


OP9_SQL = f"""WITH light AS (SELECT doc_id, 'd' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 1) AS BIGINT) % 3) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM light GROUP BY ALL),
{", ".join(_sql_level(d) for d in range(3))},
full_ AS (SELECT l2.*, budget // leaves.tokens AS fully, budget % leaves.tokens AS rest FROM l2 JOIN leaves USING (domain, lang, source)),
keyed AS (SELECT light.*, budget, fully, rest, CAST('0x' || substr(md5('17:' || fully || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS k FROM light JOIN full_ USING (domain, lang, source)),
cum AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, CAST(unnest(range(fully + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS BIGINT) AS epoch, budget FROM cum"""
