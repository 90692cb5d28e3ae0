import duckdb
import numpy as np
import pytest

from loomspan.llm import ann, topk
from loomspan.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=700, dim=12, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[::9] = x[0]  # a group of equal vectors, queries among them
    return [(i, v.tolist(), 0) for i, v in enumerate(x)]


ODD = [(9000, None, 0), (9100, [1.0, None] + [0.0] * 10, 0), (9200, [float("nan")] * 12, 0), (9300, [float("inf")] * 12, 0), (None, [0.5] * 12, 0), (9400, [], 0)]


def brute(rows, k=10):
    use = [(i, topk.scaled(np.array(v, np.float64)).astype(np.int64)) for i, v, _ in rows]
    out = []
    for q, x in use:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in use if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_against_all_scores(spark):
    rows = vectors()
    df = spark.createDataFrame(rows + ODD, SCHEMA).selectExpr("*", "1 AS cid", "2 AS q", "'s' AS score", "3 AS list")
    assert sorted(map(tuple, topk.exact_top_k(df, Scratch(spark, "t")).collect())) == brute(rows)


def test_top_k_of_few_and_none(spark):
    for n in (1, 2, 5):
        rows = vectors(n)
        assert sorted(map(tuple, topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect())) == brute(rows)
    for rows in ([], ODD[:3]):
        assert topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).count() == 0


def test_top_k_beyond_double_precision(spark):
    rows = [(i, [1e6 * (i % 5) + 0.001 * i, 2e6 - i, 3.0], 0) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, topk.exact_top_k(df, Scratch(spark, "t")).collect())) == brute(rows)


def test_top_k_of_more_equal_vectors_than_ten(spark):
    rows = [(i, [9.0, 9.0] if 0 < i < 16 else [1.0, i / 100], 0) for i in range(60)]
    assert sorted(map(tuple, topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"), k=20).collect())) == brute(rows, 20)


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rows = vectors()
    assert sorted(map(tuple, topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect())) == brute(rows)


def test_top_k_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op5_exact_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect())) == sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.OP5_SQL})").fetchall())


def nearest(rows, k=10):
    use = [(i, np.array(v, np.float64)) for i, v, _ in rows if any(v)]
    out = []
    for q, x in use:
        if q % 100 == 0:
            best = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in use if i != q)[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_all_lists_give_the_exact_answer(spark):
    rows = vectors()
    df = spark.createDataFrame(rows + ODD + [(9500, [0.0] * 12, 0)], SCHEMA).selectExpr("*", "1 AS list", "2 AS v", "'s' AS score")
    got = sorted(map(tuple, ann.nearest(df, Scratch(spark, "t"), probe_ratio=float("inf")).collect()))
    want = nearest(rows)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12)


def test_repeated_rows_push_out_no_neighbour(spark):
    rows = vectors(40)
    got = ann.nearest(spark.createDataFrame(rows * 12, SCHEMA).coalesce(1), Scratch(spark, "t"), probe_ratio=float("inf")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [x[:3] for x in nearest(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_recall(spark, seed):
    rows = vectors(4000, 24, seed)
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    want = {(q, i) for q, _, i, _ in nearest(rows)}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_query_recall(spark, sf):
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in nearest(rows)}
    got = {(r.query_id, r.vec_id) for r in ann.op6_nearest(spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_nearest_of_few_and_none(spark):
    for rows in (vectors(1), vectors(3), [(0, [1.0] * 4, 0), (0, [1.0] * 4, 0), (100, [1.0] * 4, 0)]):
        got = {(r.query_id, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()}
        assert got == {(q, i) for q, _, i, _ in nearest(rows)}
    assert ann.nearest(spark.createDataFrame(ODD, SCHEMA).where("vec_id >= 9000"), Scratch(spark, "t")).count() == 0


def neighbours(rows, k=10):
    use = [(i, np.array(v, np.float64)) for i, v, _ in rows]
    out = []
    for q, x in use:
        if q % 100 == 0:
            best = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in use if i != q)[:k]
            out += [(q, n + 1, i) for n, (_, i) in enumerate(best)]
    return sorted(out)


def test_vectors_far_from_the_origin(spark):
    r = np.random.default_rng(6)
    rows = [(i, (1e5 + r.normal(size=8)).tolist(), 0) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = ann.nearest(df, Scratch(spark, "t"), probe_ratio=float("inf")).collect()
    assert sorted((x.query_id, x.rank, x.vec_id) for x in got) == neighbours(rows)


def test_groups_far_from_each_other(spark):
    r = np.random.default_rng(7)
    rows = [(i, (1e7 * (i % 3) + 1e-2 * r.normal(size=8)).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = ann.nearest(df, Scratch(spark, "t"), probe_ratio=float("inf")).collect()
    assert sorted((x.query_id, x.rank, x.vec_id) for x in got) == neighbours(rows)


def test_a_row_repeated_more_often_than_k(spark):
    r = np.random.default_rng(8)
    rows = [(100, [0.0, 1.0, 0.0], 0)] + [(7, [0.0, 1.0, 0.1], 0)] * 14 + [(200 + i, r.normal(size=3).tolist(), 0) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = ann.nearest(df, Scratch(spark, "t"), probe_ratio=float("inf")).collect()
    assert len({x.vec_id for x in got if x.query_id == 100}) == 10 == len([x for x in got if x.query_id == 100])
