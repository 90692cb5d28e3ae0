"""Quality classifier: a linear model on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are trigrams of byte shapes (letter case, digits and each punctuation mark apart), words and word pairs, and
runs of one repeated word. Their class counts come from all labelled training documents; the hinge-loss model is fitted
by dual coordinate descent on a bounded sample of these, and its margins become probabilities by a logistic fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, Scratch, give_back, lower_ascii, ngram_hashes, released, small_batches, span_hashes, table, text_chunks, words

#: Shapes of a byte: a, A, 0, non-ASCII, space, control, and each punctuation mark.
_SHAPE = np.full(256, 5, np.int64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 0, 1, 2, 3
_SHAPE[_SPACE] = 4
_marks = [c for c in range(33, 127) if _SHAPE[c] == 5]
_SHAPE[_marks] = np.arange(6, 6 + len(_marks))
SHAPES = 6 + len(_marks)
WORD_BITS = 17
RUNS = 8
DIM = SHAPES**3 + (1 << WORD_BITS) + RUNS
#: Labelled rows that the linear model is fitted on, about; counts use all labelled rows.
SAMPLE = 6000
CHUNK, CHUNK_ROWS = 1 << 18, 100
ALPHA, COST, EPOCHS = 1.0, 1.0, 15


def features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, indicator) of the distinct indicators of each row, sorted by both."""
    n = len(rows) - 1
    shape = _SHAPE[data]
    tri = (shape[:-2] * SHAPES + shape[1:-1]) * SHAPES + shape[2:] if len(data) > 2 else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), np.diff(rows))
    whole = row[:-2] == row[2:] if len(data) > 2 else np.zeros(0, bool)
    seen = np.zeros((n, SHAPES**3), bool)
    seen[row[:-2][whole], tri[whole]] = True
    r1, f1 = np.nonzero(seen)
    starts, ends, wrow = words(data, rows)
    hashes = span_hashes(lower_ascii(data), starts, ends)
    mask = np.uint64((1 << WORD_BITS) - 1)
    pair = ngram_hashes(hashes, 2)
    inside = wrow[1:] == wrow[:-1]
    key = np.concatenate(((wrow << WORD_BITS) | (hashes & mask).astype(np.int64), ((wrow[:-1] << WORD_BITS) | (pair & mask).astype(np.int64))[inside]))
    key = np.unique(key)
    r2, f2 = key >> WORD_BITS, (key & int(mask)) + SHAPES**3
    # runs: k-th indicator if some word is repeated 2**k times on end
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & inside)) if len(hashes) else np.zeros(0, bool)
    index = np.arange(len(same))
    length = index - np.maximum.accumulate(np.where(same, 0, index)) + 1 if len(same) else index
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, wrow, length)
    r3, f3 = np.nonzero(longest[:, None] >= (2 << np.arange(RUNS))[None, :])
    r, f = np.concatenate((r1, r2, r3)), np.concatenate((f1, f2, f3 + SHAPES**3 + (1 << WORD_BITS)))
    order = np.argsort(r, kind="stable")
    return r[order], f[order]


def _small_chunks(column):
    """Chunks of few enough rows for a table of all shape trigrams."""
    for at, data, rows in text_chunks(column, CHUNK):
        for i in range(0, len(rows) - 1, CHUNK_ROWS):
            part = rows[i : i + CHUNK_ROWS + 1]
            yield at + i, data[part[0] : part[-1]], part - part[0]


def _count(batches):
    """Class counts of a task's indicators, and the sampled rows' indicators (packed). Rows: text, y, sampled."""
    counts = np.zeros((2, DIM), np.int64)

    def out(packed, *numbers):
        return pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *[pa.array(x, pa.int64()) for x in numbers]], ["packed", "indicator", "neg", "pos"])

    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        sampled = batch.column(2).to_numpy(zero_copy_only=False)
        rows_ = []
        for at, data, rows in _small_chunks(batch.column(0)):
            r, f = features(data, rows)
            own = y[at : at + len(rows) - 1]
            for c in (0, 1):
                counts[c] += np.bincount(f[own[r] == c], minlength=DIM)
            ends = np.searchsorted(r, np.arange(len(rows)))
            for i in np.flatnonzero(sampled[at : at + len(rows) - 1]):
                rows_.append(np.concatenate(([own[i]], f[ends[i] : ends[i + 1]])).astype("<i4").tobytes())
        none = np.zeros(len(rows_), np.int64)
        yield out(rows_, none - 1, none, none)
    used = np.flatnonzero(counts.any(axis=0))
    for i in range(0, len(used), 10_000):
        part = used[i : i + 10_000]
        yield out([None] * len(part), part, counts[0, part], counts[1, part])


@dataclass
class Model:
    coef: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, r: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        size = np.maximum(np.bincount(r, minlength=n), 1)
        return np.bincount(r, weights=self.coef[f], minlength=n) / np.sqrt(size) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def dual_descent(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model: each step sets one row's dual variable, in [0, cost], to its optimum with the others fixed."""
    w, bias = np.zeros(dim), 0.0
    alpha = np.zeros(len(y))
    norm = np.array([float(v @ v) + 1 for _, v in xs])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            f, v = xs[i]
            gradient = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if (step := new - alpha[i]) != 0:
                worst = max(worst, abs(step))
                alpha[i] = new
                w[f] += step * y[i] * v
                bias += step * y[i]
        if worst < 1e-3:
            break
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton's method with targets drawn off 0 and 1."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, w = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[w @ margins**2 + 1e-6, w @ margins], [w @ margins, w.sum() + 1e-6]])
        step = np.linalg.solve(h, [g @ margins, g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def held_out(ident: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """A model of quality from the labelled rows that aren't held out. Without both classes it gives the classes' share.

    The sampled rows are on the driver while it fits; afterwards its Python gives their memory back.
    """
    try:
        return _fit(docs, labels, scratch, sample)
    finally:
        give_back()


def _fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int) -> Model:
    known = scratch.keep(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).where(~held_out(F.col("doc_id"))), "labels")
    share = known.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    n, pos = share["n"], share["pos"] or 0
    if not pos or pos == n:
        p = (pos + 1) / (n + 2)
        return Model(np.zeros(DIM, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    picked = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < F.lit(min(1 << 30, int((1 << 30) * sample / n)))
    train = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(known.hint("shuffle_hash"), "doc_id").select("text", "y", picked.alias("sampled"))
    counted = scratch.keep(train.mapInArrow(released(_count), "packed binary, indicator long, neg long, pos long"), "counts")
    sums = counted.where("indicator >= 0").groupBy("indicator").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toArrow()  # DIM rows at most
    counts = np.zeros((2, DIM))
    for c, name in enumerate(("neg", "pos")):
        counts[c, sums.column("indicator").to_numpy()] = sums.column(name).to_numpy()
    counts += ALPHA
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    with small_batches(docs.sparkSession):
        packed = counted.where("indicator < 0").select("packed").limit(2 * sample).toArrow().column("packed")
    drawn = [np.frombuffer(x.as_buffer(), "<i4") for x in packed]
    drawn.sort(key=lambda x: x.tobytes())
    y = np.array([1.0 if x[0] else -1.0 for x in drawn])
    if len(set(y)) < 2:
        p = (pos + 1) / (n + 2)
        return Model(np.zeros(DIM, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    xs = [(x[1:], ratio[x[1:]] / np.sqrt(max(1, len(x) - 1))) for x in drawn]
    # the logistic curve is fitted on margins of rows that a model of the others gives
    fold = np.arange(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3):
        w, bias = dual_descent([xs[i] for i in np.flatnonzero(fold != k)], y[fold != k], DIM)
        margins[fold == k] = [w[f] @ v + bias for f, v in (xs[i] for i in np.flatnonzero(fold == k))]
    w, bias = dual_descent(xs, y, DIM)
    return Model((w * ratio).astype(np.float32), float(bias), *_logistic(margins, y))


def score(docs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """All rows of ``docs`` (id and text) with held_out, score and predicted.

    The score uses the text alone; null and empty texts have the model's bias as their margin. Rows without an id aren't
    held out. Repeated rows are scored each; an empty table gives no rows. The model has a fixed size (1.5 MB).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for batch in batches:
            margins = np.zeros(batch.num_rows)
            for at, data, rows in _small_chunks(batch.column(1)):
                r, f = features(data, rows)
                margins[at : at + len(rows) - 1] = own.margins(r, f, len(rows) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own.scores(margins))], ["doc_id", "held_out", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(released(run), f"doc_id {key}, held_out boolean, score double")
    return scratch.keep(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "scores")


def keep_good(docs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """The documents whose score is at least one half, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for batch in batches:
            margins = np.zeros(batch.num_rows)
            for at, data, rows in _small_chunks(batch.column("text")):
                r, f = features(data, rows)
                margins[at : at + len(rows) - 1] = own.margins(r, f, len(rows) - 1)
            yield batch.filter(pa.array(own.scores(margins) >= 0.5))

    return scratch.keep(docs.mapInArrow(released(run), docs.schema), "good")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "quality")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), scratch), scratch)
