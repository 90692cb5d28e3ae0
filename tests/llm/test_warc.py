import hashlib

import duckdb

from loomspan.llm import warc
from loomspan.llm.common import Scratch

SCHEMA = "file string, offset long, record binary"


def run(spark, a, b):
    rows = warc.audit(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), Scratch(spark, "t")).collect()
    return sorted((r.file, r.offset, r.kind, r.length, r.replica_length) for r in rows)


def records(files=3, n=400, size=3000):
    out = []
    for f in range(files):
        at = 0
        for i in range(n):
            body = bytes([i % 251]) * (size + i % 7)
            out.append((f"f{f}", at, body))
            at += len(body)
    return out


def test_each_kind_is_located(spark):
    a = records()
    b = list(a)
    b[5] = (*a[5][:2], a[5][2][:-1] + b"!")
    b[700] = (*a[700][:2], a[700][2][:10])
    gone = b.pop(900)
    b.append(("f2", 10**9, b"more"))
    assert run(spark, a, b) == sorted([(*a[5][:2], "changed", len(a[5][2]), len(a[5][2])), (*a[700][:2], "changed", len(a[700][2]), 10), (*gone[:2], "missing", len(gone[2]), None), ("f2", 10**9, "extra", None, 4)])
    assert run(spark, a, a) == []


def test_only_differing_branches_are_read(spark):
    a = records(files=2, n=1500)
    b = list(a)
    b[3] = (*a[3][:2], b"x")
    tree = warc.Tree(spark.createDataFrame(a, SCHEMA), Scratch(spark, "t"), "a")
    tree.grow(tree.depth)
    assert tree.depth == 2 and tree.levels[-1].count() == 2 and tree.levels[0].count() > 100
    assert [x[:3] for x in run(spark, a, b)] == [(*a[3][:2], "changed")]


def test_edges(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("f", 0, b"a")], []) == [("f", 0, "missing", 1, None)]
    assert run(spark, [], [(None, None, None)]) == [("", -1, "extra", None, 0)]
    twice = [("f", 0, b"a"), ("f", 0, b"a"), ("f", 0, b"b")]
    assert run(spark, twice, twice) == []
    assert run(spark, twice, [("f", 0, b"a"), ("f", 0, b"a")]) == [("f", 0, "missing", 1, None)]
    assert run(spark, [("f", 0, b"a" * 400000)], [("f", 0, b"a" * 400001)]) == [("f", 0, "changed", 400000, 400001)]
    same = spark.createDataFrame([("f", 0, b"a")], SCHEMA).selectExpr("*", "1 AS k", "2 AS hash", "3 AS length", "4 AS l")
    assert warc.audit(same, same, Scratch(spark, "t")).count() == 0


def test_records_and_sql(spark, sf):
    rows = warc.page_records(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: (r.file, r.offset)):
        assert r.offset == by_file.get(r.file, 0) and bytes(r.record).startswith(b"WARC/1.1\r\n")
        by_file[r.file] = r.offset + len(r.record)
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert int(head.rsplit(b"Content-Length: ", 1)[1]) == len(body) - 4
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = sorted(map(str, map(tuple, warc.op7_warc_fixity(spark, sf).collect())))
    assert got == sorted(str(tuple(x)) for x in con.execute(warc.OP7_SQL).fetchall())
    assert hashlib.sha256(rows[0].record).hexdigest()


def test_files_are_read_back(spark, sf, tmp_path):
    records_ = warc.page_records(spark.read.parquet(f"{sf}/pages.parquet").limit(40), per_file=15)
    rows = sorted((r.file, r.offset, bytes(r.record)) for r in records_.collect())
    for name in {r[0] for r in rows}:
        (tmp_path / name).write_bytes(b"".join(r[2] for r in rows if r[0] == name))
    back = warc.read_records(spark, str(tmp_path))
    assert sorted((r.file, r.offset, bytes(r.record)) for r in back.collect()) == rows
    assert warc.audit(records_, back, Scratch(spark, "t")).count() == 0
