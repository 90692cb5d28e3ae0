import random
import re

import duckdb
import pytest

from loomspan.llm.common import Scratch
from loomspan.llm.line_dedup import OP4_SQL, dedup_lines, op4_line_dedup


def brute(docs, min_words):
    """Delete each line that lies in a run of enough words which also stands at an earlier position."""
    rows = sorted(docs)
    lines = {d: [(i, x) for i, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for d, t in rows if t is not None}
    count = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    seen, gone = {}, {d: set() for d in lines}
    places = [(d, s) for d, _ in rows if d in lines for s in range(len(lines[d]))]
    for rank, (d, s) in enumerate(places):
        words, own = 0, []
        for e in range(s, len(lines[d])):
            words += count(lines[d][e][1])
            own.append(lines[d][e][1])
            if words >= min_words:
                if seen.setdefault(tuple(own), rank) < rank:
                    gone[d].update(range(s, e + 1))
    out = {}
    for d, t in rows:
        if t is None or not gone[d]:
            out[d] = t
            continue
        cut, run = set(), []
        for k in sorted(gone[d]):
            if run and run[-1] != k - 1:
                cut.update(range(lines[d][run[0]][0], lines[d][run[-1]][0] + 1))
                run = []
            run.append(k)
        cut.update(range(lines[d][run[0]][0], lines[d][run[-1]][0] + 1))
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 5))) for _ in range(9)]
    docs = [(d, "\n".join(r.choice(pool) for _ in range(r.randint(1, 25)))) for d in range(30)]
    docs += [(100 + i, docs[i][1]) for i in range(3)]
    for min_words in (4, 11):
        got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "t"), min_words).collect()}
        assert got == brute(docs, min_words)


def test_edges(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = [(1, None, 0), (2, "", 0), (3, "\n\n", 0), (4, f"{passage}\n\nown line", 0), (5, f"x\n{passage}", 0), (5, f"x\n{passage}", 0), (None, passage, 0), (6, f"{passage}\n" * 300, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, rank int").selectExpr("*", "1 AS pos", "2 AS did", "'q' AS removed_runs", "3 AS row_")
    got = sorted((x.doc_id or 0, x.text or "") for x in dedup_lines(df, Scratch(spark, "t")).collect())
    assert got == [(0, passage), (1, ""), (2, ""), (3, "\n\n"), (4, "\nown line"), (5, "x"), (5, "x"), (6, "")]
    assert dedup_lines(df.limit(0), Scratch(spark, "t")).count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, op4_line_dedup(spark, sf).collect())) == sorted(con.execute(OP4_SQL).fetchall())
