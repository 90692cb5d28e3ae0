"""Run tables, slices, enumerations, likelihoods of parts, exact tests and read synthesis."""

from itertools import permutations
from math import comb, factorial, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import combinatorics as C
from loomspan.operators import phasing, runs, segregation, simulate
from loomspan.operators.kernels import hmm, linkage


def test_enumerations():
    for n in range(1, 6):
        met = C.orders_by_swaps(n)
        assert sorted(met) == sorted(permutations(range(n))) and met[0] == tuple(range(n))
    assert [len(C.set_partitions(n)) for n in range(7)] == [1, 1, 2, 5, 15, 52, 203]
    assert len(C.multicombinations(5, 3)) == comb(7, 3) and len(C.combinations(7, 3)) == comb(7, 3)
    assert C.multipermutations("aab") == [("a", "a", "b"), ("a", "b", "a"), ("b", "a", "a")]


def test_slices(spark):
    row = spark.createDataFrame([("c", list("abcdef"), [10, 20, 30, 40, 50, 60], [[1, 1, 2, 2, 1, 1], [3, 4, 4, 3, 3, 4]], [[0, 1, 1, 0]] * 6)], "contig string, v array<string>, p array<int>, h array<array<int>>, a array<array<int>>")
    got = row.select(
        runs.by_index(F.col("v"), F.array(F.lit(5), F.lit(0), F.lit(9))).alias("i"), runs.by_range(F.col("v"), F.lit(1), F.lit(3)).alias("r"), runs.by_range(F.col("v"), F.lit(3), F.lit(1)).alias("b"), runs.by_range(F.col("v"), F.lit(2), F.lit(2)).alias("one"),
        runs.marker_ids(F.col("contig"), F.col("p"), F.lit(2), F.lit(1)).alias("n"), runs.phased_calls(F.col("h"), F.col("a"), F.lit(0), F.lit(2)).alias("c"), runs.phased_calls(F.col("h"), F.col("a"), F.lit(2), F.lit(0)).alias("d"),
    ).first()
    assert got.i == ["f", "a", None] and got.r == ["b", "c", "d"] and got.b == ["d", "c", "b"] and got.one == ["c"]
    assert got.n == ["c_30", "c_20"] and got.c == ["0|1", "0|0", "1|0"] and got.d == got.c[::-1]


def test_members_and_corrupt_runs(spark, tmp_path, caplog):
    rows = [("x", 0, 1, -5.0, 3, 2, 0, "P1", False, [[1, 1]], [0, 0], [[0.1, 0.9]], [0.1], [5, 9], [-5.0], 0), ("x", 0, 1, -5.0, 3, 2, 1, "F1", False, [[1, 2]], [0, 1], None, None, None, None, 3)]
    fits = spark.createDataFrame(rows, phasing.SCHEMA)
    runs.write_runs(fits, str(tmp_path / "runs"))
    (tmp_path / "runs" / "contig=x" / "rep=1").mkdir()
    (tmp_path / "runs" / "contig=x" / "rep=1" / "part-0.parquet").write_bytes(b"nothing")
    back = runs.read_runs(spark, str(tmp_path / "runs"), phasing.SCHEMA)
    assert back.count() == 2
    with caplog.at_level("WARNING"):
        assert [tuple(r) for r in runs.skipped_runs(spark, str(tmp_path / "runs"), phasing.SCHEMA).collect()] == [("x", "1")]
    assert "rep=1" in caplog.text
    assert {m: runs.member(back, m).count() for m in runs.MEMBERS} == {"haplotype": 2, "genotype": 2, "dosage": 2, "runinfo": 1, "emission": 1, "transition": 1, "snp": 1}
    with pytest.raises(ValueError):
        runs.member(back, "other")


def test_likelihood_of_a_part_of_a_chain():
    r = np.random.default_rng(2)
    data = hmm.Data(r.integers(0, 8, (8, 6)), r.integers(0, 8, (8, 6)), np.arange(6) * 1000.0, (0, 1), 2, (2,))
    fit = hmm.fit(data, 3, max_iter=5)
    log_e = hmm.log_emissions(data, fit.emissions)
    steps = [hmm.transition(2, float(j)) for j in fit.jumps]
    for a, b in ((0, 6), (0, 3), (3, 6), (4, 5)):
        want = log_e[0, a:b, 0].sum() + log_e[1, a:b, 1].sum()
        for i in range(2, 8):
            # the sum over all paths
            total = 0.0
            paths = [()]
            for _ in range(b - a):
                paths = [(*p, k) for p in paths for k in range(4)]
            for p in paths:
                value = 0.25 * np.exp(log_e[i, a, 2 + p[0]])
                for t in range(1, b - a):
                    value *= steps[a + t - 1][p[t - 1], p[t]] * np.exp(log_e[i, a + t, 2 + p[t]])
                total += value
            want += log(total)
        assert hmm.segment_loglik(data, fit, a, b) == pytest.approx(want)
    assert hmm.part_logliks(data, fit) == pytest.approx([hmm.segment_loglik(data, fit, 0, 3), hmm.segment_loglik(data, fit, 3, 6)])
    assert fit.whole[:2].tolist() == [0, 1] and set(fit.whole[2:]) <= {2, 3, 4, 5}


def test_multinomial_against_listing():
    ratio = (0.25, 0.5, 0.25)
    for counts in ((3, 4, 2), (9, 0, 0), (2, 2, 5)):
        n = sum(counts)
        mass = {(i, j): factorial(n) / factorial(i) / factorial(j) / factorial(n - i - j) * 0.25 ** (n - j) * 0.5**j for i in range(n + 1) for j in range(n + 1 - i)}
        own = mass[counts[0], counts[1]]
        assert segregation.multinomial_p(list(counts), ratio) == pytest.approx(sum(m for m in mass.values() if m <= own * (1 + 1e-9)))
    both = segregation.multinomial_p([[50, 100, 50], [70, 80, 50]], ratio)
    drawn = segregation.multinomial_p([[50, 100, 50], [70, 80, 50]], ratio, exact=1)
    assert np.abs(both - drawn).max() < 0.01


def test_reads_are_reproducible_and_have_overhangs(spark):
    seqs = spark.createDataFrame([("s", "A" * 150 + "GCAGC" + "T" * 160 + "GCTGC" + "C" * 150)], "name string, seq string")
    pieces = simulate.fragments(seqs, "ApeKI", 1.0)
    got = pieces.orderBy("n").collect()
    assert [(r.left_site, r.right_site) for r in got] == [("", "GCAGC"), ("GCAGC", "GCTGC"), ("GCTGC", "")]
    assert simulate.overhang("GCAGC", 4) == ("", "CAG") and simulate.overhang("CTGCAG", 1) == ("TGCA", "")
    make = lambda df: sorted(map(tuple, simulate.reads(df, 3, 1, "ACTG", 5).collect()))
    first = make(pieces)
    assert first == make(pieces.repartition(3)) and all(len(s) == len(q) == 101 for _, s, q in first)
    assert any(s.startswith("ACTGCAGC" + "T" * 60) for _, s, _ in first) or any("T" * 60 in s for _, s, _ in first)
    assert len({q for _, _, q in first}) == len(first)


def test_quality_chain_is_read(spark, tmp_path):
    k, rows = 42, ["#missing", ",".join(["0"] * 101), "#on", ",".join(["0"] * 101)]
    for _ in range(101):
        rows += ["#first", ",".join("1" if i == 7 else "0" for i in range(k)), "#moves", *[",".join("1" if j == (i + 1) % k else "0" for j in range(k)) if i != 20 else ",".join(["0"] * k) for i in range(k)]]
    (tmp_path / "chain.cfg").write_text("\n".join(rows))
    chain = simulate.read_quality_chain(spark, str(tmp_path / "chain.cfg"))
    out = simulate._fastq(chain, ["a"], ["A" * 101], np.array([1], np.uint64))
    # from 7 upwards one a base; 20 was never left, so it goes on as a read begins
    want = [7 + i % 14 for i in range(101)]
    assert [ord(c) - 33 for c in out.qual[0]] == want and out.seq[0] == "A" * 101


def test_barcode_files():
    assert simulate.barcode_source("apeki") == "barcodes-ApeKI.csv" and simulate.barcode_source("MspI", "own.csv") == "own.csv"
    with pytest.raises(ValueError):
        simulate.barcode_source("MspI")


def test_walks_are_near_the_optimum():
    r = np.random.default_rng(5)
    for _ in range(4):
        n = 10
        place, names = np.sort(r.random(n)), [f"c{i}" for i in r.permutation(n)]
        rf = {}
        for i in range(n):
            for j in range(i + 1, n):
                rf[names[i], names[j]] = tuple(min(0.49, abs(place[i] - place[j]) * 0.3 + 0.01 * (k % 3) + r.random() * 0.02) for k in range(4))
        best, found = (sum(x[2] for x in linkage.order(sorted(names), rf, exact=e)) for e in (10, 2))
        assert found <= 1.1 * best


def test_scaled_axis_finds_a_row():
    r = np.random.default_rng(9)
    place = np.sort(r.random(15)) * 0.6
    far = np.abs(place[:, None] - place[None])
    rf = 0.5 * np.tanh(2 * far)
    axis = linkage.scaled_axis(rf, 50 * (1 - 2 * rf))
    order = np.argsort(axis).tolist()
    assert order in (list(range(15)), list(range(15))[::-1])
    names = [f"c{i:02d}" for i in range(15)]
    pairs = {(names[i], names[j]): tuple(min(0.49, float(rf[i, j]) + 0.001 * k) for k in range(4)) for i in range(15) for j in range(i + 1, 15)}
    walk = linkage.order(names, pairs, scores={k: 50 * (1 - 2 * v[0]) for k, v in pairs.items()})
    assert [c for c, _, _ in walk] in (names, names[::-1])
