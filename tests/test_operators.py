"""Operators that no query covers, on small literals."""

import random

from pyspark.sql import functions as F

from loomspan.operators import aggregates as A
from loomspan.operators import filters as P
from loomspan.operators import joins as J
from loomspan.operators import sets as U
from loomspan.operators import windows as W
from loomspan.operators.grouping import connected_components


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = connected_components(spark.createDataFrame(edges, "a int, b int"))
    assert dict(rows(got, "v", "label")) == {v: find(v) for v in parent}


def test_bounds_by_a_loop(spark):
    """The dual-bound windows of the literal, and of random positions against a loop."""
    def forward(pos, j, n, bp):
        far = next((k for k in range(j, len(pos)) if pos[k] - pos[j] >= bp), len(pos) - 1)
        return min(len(pos) - 1, max(j + n, far))

    assert forward([0, 10, 20, 30, 40, 900], 0, 2, 35) == 4 and forward([0, 10, 20, 30, 40, 900], 3, 2, 35) == 5
    r = random.Random(3)
    for _ in range(3):
        pos = sorted(r.sample(range(500), 25))
        df = W.numbered(spark.createDataFrame([("g", p) for p in pos], "g string, pos long"), ["g"], ["pos"])
        got = W.forward_bound(df, ["g"], "pos", 3, 40)
        assert [x.last for x in got.orderBy("pos").collect()] == [forward(pos, j, 3, 40) for j in range(25)]
        turned = [500 - p for p in pos[::-1]]
        back = [24 - forward(turned, 24 - j, 3, 40) for j in range(25)]
        assert [x.first for x in W.backward_bound(df, ["g"], "pos", 3, 40).orderBy("pos").collect()] == back


def test_terminal_majority_ties(spark):
    df = W.numbered(spark.createDataFrame([("g", i, s) for i, s in enumerate("abbaccddcc")], "g string, i int, state string"), ["g"], ["i"])
    assert W.terminal_majority(df, ["g"], "state", "start", 4).first().state_start == "a"
    assert W.terminal_majority(df, ["g"], "state", "end", 3).first().state_end == "c"


def test_bands_agree(spark):
    df = W.numbered(spark.createDataFrame([("g", p) for p in range(0, 100, 7)], "g string, pos long"), ["g"], ["pos"])
    df = W.forward_bound(df, ["g"], "pos", 3, 20)
    reach = {r.ix: (r.last, r.pos) for r in df.collect()}
    want = sorted((u, v, reach[u][1], reach[v][1]) for u in reach for v in reach if u < v <= reach[u][0])
    assert sorted(rows(J.band(df, ["g"], "ix", "last", ["pos"]), "u", "v", "pos_u", "pos_v")) == want


def test_filters(spark):
    df = spark.createDataFrame([("r1", f"s{i}", i % 4) for i in range(40)] + [("r2", "s1", 1)], "run string, sample string, label int")
    assert rows(P.enough_progeny(df, "run"), "run") == [("r1",)] and rows(P.all_founders(df, "run", 4), "run") == [("r1",)]
    missing = spark.createDataFrame([("a", 3), ("b", 8)], "sample string, missing int")
    assert rows(P.samples_kept(missing, 10), "sample") == [("a",)]
    pieces = spark.createDataFrame([("s", i, n) for i, n in enumerate((500, 120, 90, 300))], "s string, i int, n int")
    assert rows(P.inner_fragments(pieces, ["s"], ["i"], F.col("n")), "i") == [(1,)]
    snp = spark.createDataFrame([(3, 5, 50, 10.0, 2), (2, 5, 50, 10.0, 2), (3, 5, 50, 60.0, 2)], "hom int, het int, called int, mean double, classes int")
    assert snp.where(P.snp_ok(*(F.col(c) for c in snp.columns))).count() == 1
    assert P.without_markers(pieces, "i", [0, 1]).count() == 2 and P.first_samples(pieces, "i", 3).count() == 3
    alts = spark.createDataFrame([("A",), ("A,C",)], "alt string")
    assert alts.where(P.biallelic(F.col("alt"))).count() == 1


def test_sets_and_joins(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2, 2], [2, 3]))
    assert rows(U.union(a, b), "k") == [(1,), (2,), (3,)] and rows(U.append(a, b), "k") == [(1,), (2,), (2,), (2,), (3,)]
    assert rows(U.renumbered([a, b]), "lg", "k") == [("LG01", 1), ("LG01", 2), ("LG01", 2), ("LG02", 2), ("LG02", 3)]
    chain = spark.range(1).select(U.chain_arrays(F.array(F.lit(1), F.lit(2)), F.lit(True), F.array(F.lit(3)), F.lit(False)).alias("x"))
    assert chain.first().x == [2, 1, 3]
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1), ("d", 2), ("e", 9)], "k string, m int")
    assert rows(J.subsets_removed(sets, "k", "m"), "k") == [("a",), ("e",)]
    calls = spark.createDataFrame([(1, 3, 1), (1, 0, 3), (2, 0, 5)], "site int, a int, b int")
    assert rows(calls.groupBy("site").agg(A.allele_fraction(F.col("a"), F.col("b")).alias("f")), "site", "f") == [(1, 4 / 7), (2, 0.5)]


def test_global_index(spark):
    from loomspan.operators.numbering import global_index

    r = random.Random(5)
    values = r.sample(range(10_000), 500)
    got = global_index(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), ["v"])
    assert rows(got, "v", "n") == [(v, i) for i, v in enumerate(sorted(values))]
    assert global_index(got.limit(0).drop("n"), ["v"]).count() == 0


def test_means_sum_from_the_last_row(spark):
    """Sums of the same numbers in two orders differ in their last bits; groups of every length, in any order of rows."""
    r = random.Random(5)
    values = {(g, i): r.choice([None, r.randrange(1000) / 10]) if g % 5 == 0 else r.randrange(1000) / 10 for g in range(400) for i in range(1 + g % 9)}
    cells = [(g, i, x) for (g, i), x in values.items()] + [(400, 0, None)]
    r.shuffle(cells)
    want = {400: None}
    for g in range(400):
        back = [x for i in range(g % 9, -1, -1) if (x := values[g, i]) is not None]
        total = 0.0
        for x in back:
            total += x
        want[g] = total / len(back) if back else None
    found = W.mean_from_last(spark.createDataFrame(cells, "g long, i long, x double").repartition(7, "i"), ["g"], "i", F.col("x"), "mean")
    assert dict(rows(found, "g", "mean")) == want


def test_windows_at_the_bound_of_errors(spark, tmp_path):
    """Nearest windows whose mean is five, up to the last bits: as in SQL."""
    import duckdb

    from loomspan.plans import catalog

    r = random.Random(11)
    steps = [s for s in ([r.randrange(1, 148) / 10 for _ in range(2)] for _ in range(4000)) if s[0] + s[1] < 14.9]
    events = []
    for user, (a, b) in enumerate(steps):
        events += [(user, i, x) for i, x in enumerate([0.0, a, b, round(15 - a - b, 1)])] + [(user, 4 + i, 1000.0 * (i + 1) ** 2) for i in range(4)]
    path = f"{tmp_path}/events.parquet"
    frame = spark.createDataFrame(events, "user_id long, i long, value double")
    frame.select((F.col("user_id") * 10 + F.col("i")).alias("event_id"), "user_id", F.lit("view").alias("event_type"), "value", F.timestamp_seconds(F.lit(1704067200) + F.col("i") * 100000).alias("ts")).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = {x[0]: x for x in con.execute(catalog.ORACLE_SQL["error_detection"]).fetchall()}
    got = {x[0]: tuple(x) for x in catalog.error_detection(spark, str(tmp_path)).collect()}
    assert 0 < len(want) < len(steps) and got == want


def test_overlaps_by_brute_force(spark):
    r = random.Random(3)
    cells = [(r.randrange(40), r.choice([None, *range(25)])) for _ in range(400)] + [(None, 3), (50, 3), (51, 99)]
    sets = {}
    for g, m in cells:
        if g is not None:
            sets.setdefault(g, set()).add(m)
    pairs = [(a, b, len(sets[a] & sets[b] - {None}), min(len(sets[a]), len(sets[b]))) for a in sets for b in sets if a < b]
    want = sorted(p for p in pairs if p[2])
    df = spark.createDataFrame(cells, "g_ long, m_ long")
    assert rows(J.overlaps(df, "g_", "m_"), "a", "b", "common", "n") == want
    assert rows(J.overlaps(df, "g_", "m_", F.col("g") % 3), "a", "b", "common", "n") == [p for p in want if p[0] % 3 == p[1] % 3]


def test_pairs_of_suppliers_are_not_shuffled(spark, sf):
    """Rows, lists by part, lists by supplier: no exchange after the lists are opened."""
    from loomspan.plans.views import supplier_pairs

    plan = supplier_pairs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan


def test_nearest_of_a_group(spark):
    from loomspan.operators import mapping

    pairs = spark.createDataFrame([("A", "B", 0.1), ("A", "C", 0.4), ("B", "D", 0.2), ("C", "D", 0.05)], "a string, b string, rf_min double")
    groups = spark.createDataFrame([("A", 1), ("B", 2), ("C", 1), ("D", 2)], "contig string, lg long")
    assert rows(mapping.nearest_in_group(pairs, groups), "contig", "least") == [("A", 0.4), ("B", 0.2), ("C", 0.4), ("D", 0.2)]
    assert rows(mapping.nearest_in_group(pairs, None), "contig", "least") == [("A", 0.1), ("B", 0.1), ("C", 0.05), ("D", 0.05)]
    assert rows(mapping.chimeras(pairs, groups, 0.3), "contig", "least") == [("A", 0.4), ("C", 0.4)]
