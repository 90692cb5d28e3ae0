import itertools
import random

import numpy as np
import pytest

from loomspan.operators import evaluate, mapping, phasing, simulate, twopoint
from loomspan.operators.kernels import hmm, linkage
from loomspan.plans import programs


def test_state_counts():
    assert [hmm.states(h).count for h in (2, 4, 6, 8)] == [6, 38, 402, 4902]


@pytest.mark.parametrize("ploidy", [2, 4])
def test_transitions_are_distributions(ploidy):
    t = hmm.transition(ploidy, 0.1)
    assert np.allclose(t.sum(axis=1), 1) and np.allclose(t, t.T)
    assert np.allclose(hmm.transition(ploidy, 1e-12), np.eye(len(t)), atol=1e-9)


def test_poisson_binomial_by_enumeration():
    p = np.array([0.2, 0.5, 0.9])
    want = np.zeros(4)
    for bits in itertools.product((0, 1), repeat=3):
        want[sum(bits)] += np.prod([x if b else 1 - x for x, b in zip(p, bits, strict=True)])
    assert np.allclose(hmm.poisson_binomial(p), want)


def test_forward_and_viterbi_by_enumeration():
    rng = np.random.default_rng(1)
    log_e = np.log(rng.random((4, 4)))
    steps = [hmm.transition(2, x) for x in (0.1, 0.3, 0.05)]
    start = np.full(4, 0.25)
    total, best = 0.0, (-np.inf, None)
    for path in itertools.product(range(4), repeat=4):
        lik = start[path[0]] * np.prod([steps[t][path[t], path[t + 1]] for t in range(3)]) * np.exp(sum(log_e[t, k] for t, k in enumerate(path)))
        total += lik
        best = max(best, (lik, path))
    loglik, post, _ = hmm.forward_backward(log_e, steps, start)
    assert loglik == pytest.approx(np.log(total)) and np.allclose(post.sum(axis=1), 1)
    assert tuple(hmm.viterbi(log_e, steps, start)) == best[1]


def test_slots_keep_founders_in_place():
    assert hmm.slots(np.array([[1, 3], [3, 4], [4, 5]])).tolist() == [[1, 4, 4], [3, 3, 5]]


ENDS = {"A": {"F1": ("1111", "3333"), "F2": ("2222", "4444"), "F3": ("1122", "3333"), "F4": ("2222", "3344")}, "B": {"F1": ("1111", "3333"), "F2": ("2222", "4444"), "F3": ("2222", "3333"), "F4": ("2222", "4444")}}


def end_rows(data, shuffled=None):
    rename = shuffled or {}
    return [(c, 0, f, p + 1, e, p, int(rename.get((c, h[0 if e == "s" else -1]), h[0 if e == "s" else -1])) - 2 * p) for c, fs in data.items() for f, pair in fs.items() for p, h in enumerate(pair) for e in "se"]


SCHEMA = "contig string, run int, progeny string, parent int, end string, slot int, hap int"


def fractions(spark, rows):
    return [(r.a, r.b, r.n, r.rf_ss, r.rf_se, r.rf_es, r.rf_ee, r.rf_min) for r in twopoint.two_point(spark.createDataFrame(rows, SCHEMA), 2).collect()]


def test_two_point_by_hand(spark):
    assert fractions(spark, end_rows(ENDS)) == [("A", "B", 8, 0.25, 0.25, 0.0, 0.0, 0.0)]


def test_two_point_ignores_founder_names_and_turns_with_contigs(spark):
    swapped = {("B", "1"): "2", ("B", "2"): "1"}
    assert fractions(spark, end_rows(ENDS, swapped)) == fractions(spark, end_rows(ENDS))
    turned = {**ENDS, "A": {f: tuple(x[::-1] for x in p) for f, p in ENDS["A"].items()}}
    assert fractions(spark, end_rows(turned)) == [("A", "B", 8, 0.0, 0.0, 0.25, 0.25, 0.0)]


def test_shortest_path():
    r = random.Random(3)
    for _ in range(20):
        n = 7
        edges = [(u, v, r.random()) for u in range(n) for v in range(u + 1, n) if v - u <= 3]
        path, cost = linkage.shortest_path(n, edges)
        w = {(u, v): x for u, v, x in edges}
        best = min(sum(w[a, b] for a, b in zip(p, p[1:], strict=False)) for k in range(n) for mid in itertools.combinations(range(1, n - 1), k) for p in [[0, *mid, n - 1]] if all((a, b) in w for a, b in zip(p, p[1:], strict=False)))
        assert cost == pytest.approx(best) and path[0] == 0 and path[-1] == n - 1
    assert linkage.shortest_path(3, [(0, 1, 1.0)]) == ([], float("inf"))


def chain(names, flips, step=0.05):
    """Fractions between the ends of contigs that stand in a row, some turned."""
    at = {}
    for i, (c, f) in enumerate(zip(names, flips, strict=True)):
        ends = (2 * i, 2 * i + 1)
        at[c, "s"], at[c, "e"] = ends[::-1] if f else ends
    out = []
    for a, b in itertools.combinations(sorted(names), 2):
        out.append((a, b, tuple(min(0.5, step * abs(at[a, x] - at[b, y])) for x in "se" for y in "se")))
    return out


def test_join_ends_rebuilds_a_row():
    names, flips = list("dacbe"), [False, True, False, True, False]
    (found,) = linkage.join_ends(names, chain(names, flips), 0.2)
    order, turned = [c for c, _, _ in found], [r for _, r, _ in found]
    assert (order, turned) in ((names, flips), (names[::-1], [not f for f in flips[::-1]]))
    assert [round(g, 9) for _, _, g in found[:-1]] == [0.05] * 4 and found[-1][2] is None
    assert len(linkage.join_ends(names, chain(names, flips), 0.01)) == 5


def test_ties_go_to_the_pair_whose_other_ends_lead_on():
    """a's end is as near to both ends of b; only b's start has a neighbour, so b's end is the one to join."""
    far = 0.5
    pairs = [("a", "b", (far, far, 0.1, 0.1)), ("b", "c", (0.15, far, far, far)), ("a", "c", (far, far, far, far))]
    (found,) = linkage.join_ends(["a", "b", "c"], pairs, 0.2)
    assert [(c, r) for c, r, _ in found] == [("a", False), ("b", True), ("c", False)] and [g for _, _, g in found] == [0.1, 0.15, None]
    # ends inside a chain are used up: d is near to a's joined end alone
    pairs += [("a", "d", (far, far, 0.12, 0.12)), ("b", "d", (far,) * 4), ("c", "d", (far,) * 4)]
    assert [[c for c, _, _ in x] for x in linkage.join_ends(["a", "b", "c", "d"], pairs, 0.2)] == [["a", "b", "c"], ["d"]]


@pytest.mark.parametrize("n", [5, 13])
def test_order_rebuilds_a_row(n):
    r = random.Random(n)
    names = [f"c{i:02d}" for i in range(n)]
    r.shuffle(names)
    flips = [r.random() < 0.5 for _ in names]
    walk = linkage.order(sorted(names), {(a, b): f for a, b, f in chain(names, flips, 0.02)})
    found = ([c for c, _, _ in walk], [x for _, x, _ in walk])
    assert found in ((names, flips), (names[::-1], [not f for f in flips[::-1]]))


def test_communities():
    edges = [(a, b, 10.0) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)] + [("d", "w", 1.0)]
    found = linkage.communities(list("abcdwxyz"), edges)
    assert len(set(found.values())) == 2 and len({found[x] for x in "abcd"}) == 1


def test_superscaffolds_and_groups(spark):
    rows = [(a, b, *f, min(f), 10.0) for a, b, f in [*chain(["a", "b", "c"], [False] * 3), *chain(["x", "y"], [True, False])]]
    pairs = spark.createDataFrame(rows, "a string, b string, rf_ss double, rf_se double, rf_es double, rf_ee double, rf_min double, lod double")
    contigs = spark.createDataFrame([(c,) for c in "abcxyz"], "contig string")
    got = {}
    for r in mapping.superscaffolds(pairs, contigs, 0.2).collect():
        got.setdefault(r.cluster, []).append((r.ord, r.contig))
    assert sorted([c for _, c in sorted(v)] for v in got.values()) == [["a", "b", "c"], ["x", "y"], ["z"]]
    groups = mapping.linkage_groups(pairs, contigs)
    assert {r.contig: r.lg for r in groups.collect()} == {"a": 1, "b": 1, "c": 1, "x": 2, "y": 2, "z": 3}
    ordered = mapping.ordered_groups(pairs, groups)
    assert [r.contig for r in ordered.where("lg = 1").orderBy("ord").collect()] == ["a", "b", "c"]


@pytest.fixture(scope="module")
def family(spark):
    chromosomes = spark.createDataFrame([("k1", 60_000), ("k2", 60_000)], "chrom string, length long")
    truth = programs.popsimulation(spark, chromosomes, 42, 2, 5).where("marker_ix < 24").localCheckpoint()
    calls = simulate.depths(truth, 12, 5).localCheckpoint()
    fits = programs.haplotyper(calls, ["P1", "P2"], 2, repeats=3, seed=1, max_iter=30).localCheckpoint()
    return truth, calls, fits


def test_planted_phase_is_recovered(spark, family):
    truth, _, fits = family
    assert fits.select("contig", "rep").distinct().count() == 6
    for r in programs.evaluator(truth.withColumnRenamed("chrom", "contig"), fits, 2).collect():
        assert r.accuracy > 0.85
    assert fits.where("emissions IS NOT NULL").count() == 6


def test_fits_are_reproducible(spark, family):
    _, calls, fits = family
    again = programs.haplotyper(calls, ["P1", "P2"], 2, repeats=3, seed=1, max_iter=30)
    key = lambda df: sorted((r.contig, r.rep, round(r.loglik, 9)) for r in phasing.run_rows(df).collect())
    assert key(again) == key(fits)


def test_rates_and_fractions_of_fits(spark, family):
    _, _, fits = family
    maps = programs.single_point(fits, ["P1", "P2"], 2).collect()
    assert {r.contig for r in maps} == {"k1", "k2"}
    assert all(0 <= x <= 1 for r in maps for x in r.rf) and all(len(r.rf) == len(r.dist) for r in maps)
    (pair,) = programs.two_point(fits, ["P1", "P2"], 2).collect()
    assert 0 <= pair.rf_min <= 1 and pair.n == 2 * 40
    rates = phasing.adjacent_rates(fits, ["P1", "P2"])
    assert rates.where("rate < 0 OR rate > 1").count() == 0 and phasing.assembly_errors(rates, 2.0).count() == 0


def test_simulator_is_deterministic_and_consistent(spark, family):
    truth, _, _ = family
    parents = truth.where("role < 2").select("founders").distinct().collect()
    assert sorted(r.founders for r in parents) == [[1, 2], [3, 4]]
    assert truth.where("size(founders) <> 2").count() == 0
    seqs = spark.createDataFrame([("s", "ACGT" * 40 + "GCAGC" + "TTGA" * 60 + "GCTGC" + "ACCA" * 50)], "name string, seq string")
    pieces = simulate.fragments(seqs, "ApeKI", efficiency=1.0).orderBy("n").collect()
    assert "".join(p.fragment for p in pieces) == seqs.first().seq and len(pieces) == 3
    reads = programs.gbssimulation(seqs, "ApeKI", 3, 1, "TTT", 4).collect()
    assert reads and all(len(r.seq) == len(r.qual) == 101 for r in reads)
    assert sorted(reads) == sorted(programs.gbssimulation(seqs, "ApeKI", 3, 1, "TTT", 4).collect())


def test_accuracy_under_renaming(spark):
    truth = spark.createDataFrame([("c", s, m, [1 + (m + i) % 2, 3]) for i, s in enumerate("xyz") for m in range(5)], "contig string, sample string, marker_ix int, founders array<int>")
    swapped = truth.selectExpr("contig", "sample", "marker_ix", "transform(founders, x -> case when x < 3 then 3 - x else 7 - x end) AS founders")
    assert evaluate.phasing_accuracy(truth, swapped, 2).first().accuracy == 1.0


def test_unknown_program_is_an_error():
    with pytest.raises(SystemExit):
        programs.main(["nothing", "--input", "x", "--output", "y"])
