from collections import defaultdict

import duckdb

from loomspan.llm.common import Scratch
from loomspan.llm.mixing import OP9_SQL, leaf_budgets, mix, mix_documents, op9_mixing


def pour(budget, caps, weights):
    """Water-filling by rounds: fill what is full, share the rest again."""
    left, todo, out = budget, set(range(len(caps))), [0] * len(caps)
    while todo:
        whole = sum(weights[i] for i in todo)
        full = [i for i in todo if caps[i] * whole <= left * weights[i]]
        if not full:
            for i in todo:
                out[i] = left * weights[i] // whole
            break
        for i in full:
            out[i] = caps[i]
        left -= sum(caps[i] for i in full)
        todo -= set(full)
    return out


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s1", 1000), ("b", "en", "s1", 1000)]
    got = {tuple(r[:3]): r.budget for r in leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), 800, 1, {}).collect()}
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 190, ("a", "de", "s1"): 200, ("b", "en", "s1"): 400}


def test_against_rounds(spark):
    import random

    r = random.Random(5)
    for _ in range(3):
        leaves = [("d", "l", f"s{i}", r.randint(1, 500)) for i in range(12)]
        weights = {"source": {f"s{i}": r.randint(1, 5) for i in range(12)}}
        total = r.randint(100, 4000)
        got = {x.source: x.budget for x in leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), total, 2, weights).collect()}
        want = pour(min(total, sum(2 * x[3] for x in leaves)), [2 * x[3] for x in leaves], [weights["source"][f"s{i}"] for i in range(12)])
        assert all(abs(got[f"s{i}"] - want[i]) <= 1 for i in range(12)) and sum(got.values()) <= total


def test_prefix_and_epochs(spark):
    docs = [(i, "w " * (1 + i % 7), "en", "s1" if i % 2 else "s2") for i in range(400)]
    rows = mix(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), Scratch(spark, "t"), fraction=1.6, max_epochs=2).collect()
    used, seen = defaultdict(int), defaultdict(list)
    for r in rows:
        used[r.source] += r.n_tokens
        seen[r.doc_id].append(r.epoch)
    assert all(used[r.source] <= r.budget < used[r.source] + 7 for r in rows)
    assert all(sorted(v) == list(range(len(v))) for v in seen.values()) and max(map(len, seen.values())) == 2


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "one two", None, "a"), (4, "x " * 50000, "en", "b")], "doc_id long, text string, lang string, source string").selectExpr("*", "9 AS domain", "8 AS tokens", "7 AS full", "'z' AS epoch")
    kept = mix_documents(docs, Scratch(spark, "t"), fraction=5.0, max_epochs=2)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 4, 2} - ({2} if not kept.where("doc_id = 2").count() else set())
    assert mix(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, op9_mixing(spark, sf).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "budget").collect())) == sorted(con.execute(f"SELECT doc_id, domain, lang, source, n_tokens, epoch, budget FROM ({OP9_SQL})").fetchall())
