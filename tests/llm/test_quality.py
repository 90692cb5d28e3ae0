import random
import zlib

import numpy as np
import pytest

from loomspan.llm import quality
from loomspan.llm.common import Scratch, text_chunks


def corpus(n=900, seed=3):
    r = random.Random(seed)
    good = lambda: ". ".join(" ".join(r.choice(["river", "stone", "light", "under", "walks", "slowly", "bright"]) for _ in range(9)).capitalize() for _ in range(4)) + "."
    bad = lambda: " | ".join(r.choice(["buy", "now", "$$$", "CLICK!!", "free"]) for _ in range(30))
    return [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(n)]


def test_held_out_accuracy_and_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], None) for r in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, Scratch(spark, "t"))
    got = {r.doc_id: r for r in quality.score(docs, model, Scratch(spark, "t")).collect()}
    assert len(got) == len(rows)
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == y == int(got[i].score >= 0.5) and 0 <= got[i].score <= 1
    assert quality.keep_good(docs, model, Scratch(spark, "t")).count() == sum(r[2] for r in rows)


def test_held_out_labels_are_never_read(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]
    fits = []
    for flip in (False, True):
        labels = spark.createDataFrame([(r[0], 1 - r[2] if flip and h else r[2]) for r, h in zip(rows, held, strict=True)], "doc_id long, quality int")
        fits.append(quality.fit(docs, labels, Scratch(spark, "t")))
    assert np.array_equal(fits[0].coef, fits[1].coef) and fits[0].bias == fits[1].bias


def test_query(spark, sf):
    rows = quality.op8_quality(spark, sf)
    truth = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert truth.where("quality = predicted").count() >= 0.9 * truth.count()


def test_dual_descent_reaches_the_optimum():
    """The duality gap of a small problem closes."""
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 4))
    y = np.where(x[:, 0] + 0.3 * r.normal(size=60) > 0, 1.0, -1.0)
    f = np.arange(4)
    w, b = quality.dual_descent([(f, v) for v in x], y, 4, cost=0.5, epochs=3000)
    primal = lambda w, b: 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = primal(w, b)
    assert all(best <= primal(w + d[:4], b + d[4]) + 1e-3 for d in 0.05 * r.normal(size=(300, 5)))


def test_indicators_by_hand():
    import pyarrow as pa

    (_, data, rows), = text_chunks(pa.array(["go go go go", "ab", "", "A1!"]))
    r, f = quality.features(data, rows)
    tri = {k: {x for x, y in zip(f.tolist(), r.tolist(), strict=True) if y == k and x < quality.SHAPES**3} for k in range(4)}
    assert len(tri[0]) == 3 and not tri[1] and not tri[2] and len(tri[3]) == 1
    runs = [x - quality.SHAPES**3 - (1 << quality.WORD_BITS) for x, y in zip(f.tolist(), r.tolist(), strict=True) if y == 0 and x >= quality.SHAPES**3 + (1 << quality.WORD_BITS)]
    assert runs == [0, 1]
    assert len(set(zip(r.tolist(), f.tolist(), strict=True))) == len(r)


def test_edges(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([*[r[:2] for r in rows], (1, None), (None, ""), (None, "x" * 300000), (1, "a")], "doc_id long, text string").selectExpr("*", "1 AS y", "2 AS held_out", "'s' AS score", "true AS sampled")
    labels = spark.createDataFrame([*[(r[0], r[2]) for r in rows], (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, Scratch(spark, "t"))
    got = quality.score(docs, model, Scratch(spark, "t")).collect()
    assert len(got) == 124 and all(0 <= r.score <= 1 for r in got)
    flat = quality.fit(docs, labels.limit(0), Scratch(spark, "t"))
    assert {r.score for r in quality.score(docs, flat, Scratch(spark, "t")).collect()} == {0.5}
    assert quality.score(docs.limit(0), flat, Scratch(spark, "t")).count() == 0
    assert quality.fit(docs.limit(0), labels, Scratch(spark, "t")).scores(np.zeros(1))[0] > 0.5

def test_counts_and_ratios_against_plain_counting(spark, monkeypatch):
    """With a linear model of ones the coefficients are the log-count ratios."""
    import math

    docs, labels = [], []
    for i in range(120):
        good = i % 2
        docs.append((i, " ".join(f"{'calm' if good else 'LOUD!!'}{(i * k) % 7} text" for k in range(1, 6 + i % 4))))
        labels.append((i, good))
    monkeypatch.setattr(quality, "dual_descent", lambda xs, y, dim, **k: (np.ones(dim), 0.0))
    spark_docs = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(spark_docs, spark.createDataFrame(labels, "doc_id long, quality int"), Scratch(spark, "t"))
    train = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 != 1]
    counts = [[1.0] * quality.DIM, [1.0] * quality.DIM]
    for i in train:
        text = docs[i][1].encode()
        for f in quality.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[1].tolist():
            counts[i % 2][f] += 1
    totals = [math.fsum(c) for c in counts]
    want = [math.log(p / totals[1]) - math.log(n / totals[0]) for n, p in zip(*counts, strict=True)]
    assert np.abs(model.coef - np.array(want)).max() < 1e-5


def test_dual_descent_against_a_dense_solver():
    """The hinge-loss objective of the fitted model is that of long projected gradient steps on the whole dual."""
    r = np.random.default_rng(3)
    n, dim = 60, 12
    dense = np.where(r.random((n, dim)) < 0.4, r.normal(size=(n, dim)), 0)
    y = np.where(dense[:, 0] + 0.5 * r.normal(size=n) > 0, 1.0, -1.0)
    xs = [(np.flatnonzero(x), x[x != 0]) for x in dense]
    w, b = quality.dual_descent(xs, y, dim, epochs=400)
    full = np.hstack((dense, np.ones((n, 1)))) * y[:, None]
    gram, alpha = full @ full.T, np.zeros(n)
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, quality.COST)
    best = full.T @ alpha
    loss = lambda v: 0.5 * v @ v + quality.COST * np.maximum(0, 1 - full @ v).sum()
    assert abs(loss(np.append(w, b)) - loss(best)) < 0.01 * loss(best)


def test_the_driver_gives_the_sample_back_after_a_fit(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    calls, inner = [], quality._fit

    def fitted(*args):
        found = inner(*args)
        calls.append("fitted")
        return found

    monkeypatch.setattr(quality, "_fit", fitted)
    monkeypatch.setattr(quality, "give_back", lambda: calls.append("given back"))
    model = quality.fit(docs, labels, Scratch(spark, "t"))
    assert calls == ["fitted", "given back"] and model.coef.any()
    with pytest.raises(Exception):
        quality.fit(docs, labels.drop("quality"), Scratch(spark, "t"))
    assert calls == ["fitted", "given back", "given back"]
