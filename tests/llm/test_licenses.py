import duckdb

from loomspan.llm import licenses
from loomspan.llm.common import Scratch


def scan(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 AS t", "2 AS w", "'x' AS kind", "3 AS licence", "4 AS dir")
    return {(r.path, r.licence, r.licence_from, r.licence_dir) for r in licenses.license_scan(df, Scratch(spark, "t")).collect()}


def template(licence, kind):
    return next(text for name, own, text in licenses.TEMPLATES if (name, own) == (licence, kind))


def wrapped(text, prefix, width=60):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line += f" {word}"
    return "\n".join(prefix + x for x in [*lines, line])


def test_whole_wrapped_and_embedded_statements(spark):
    """Whole licences with their own names in them, notices wrapped as comments, and notices among other lines."""
    notice = {name: next(t for n, k, t in licenses.TEMPLATES if (n, k) == (name, "header") and len(t) > 200) for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1")}
    rows = [(f"f{i}", " ".join(f"word{i}x{j}" for j in range(40))) for i in range(60)]
    rows += [(f"{n}/code.c", f"/*\n{wrapped(t, ' * ')}\n */\n\nint main(void) {{ return 0; }}\n") for n, t in notice.items()]
    rows += [("mit/LICENSE", f"MIT License\n\nCopyright (c) 2020 Some Body\n\n{wrapped(template('MIT', 'file'), '')}\n"), ("b2/LICENSE", f"Copyright 1999 Some Body. All rights reserved.\n{template('BSD-2-Clause', 'file')}"), ("b3/LICENSE", wrapped(template("BSD-3-Clause", "file"), "  "))]
    rows += [("gpl/COPYING", wrapped(template("GPL-3.0", "opening"), "  ") + "\n" + " ".join(f"clause{i}" for i in range(3000))), ("gpl2/COPYING", template("GPL-2.0", "opening") + "\n" + " ".join(f"clause{i}" for i in range(3000)))]
    rows += [("cc/a.txt", "Some words\nLicensed under CC BY-NC 4.0.\nand more"), ("cc/b.txt", "Licensed under CC BY-NC-ND 4.0."), ("cc/c.txt", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")]
    got = {path: licence for path, licence, origin, _ in scan(spark, rows) if origin == "own"}
    want = {f"{n}/code.c": n for n in notice} | {"mit/LICENSE": "MIT", "b2/LICENSE": "BSD-2-Clause", "b3/LICENSE": "BSD-3-Clause", "gpl/COPYING": "GPL-3.0", "gpl2/COPYING": "GPL-2.0", "cc/a.txt": "CC-BY-NC-4.0", "cc/b.txt": "CC-BY-NC-ND-4.0", "cc/c.txt": "CC-BY-SA-4.0"}
    assert got == want


def test_own_inherited_and_nearest(spark):
    mit = template("MIT", "file")
    rows = [
        ("LICENSE", "Released under the MIT License."),
        ("a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/x.py", "print(1)"),
        ("a/y.py", "some words\nThis work is licensed under the GNU General Public License, version 3!\nmore"),
        ("a/z.py", "the license of the public is under version"),
        ("d/LICENSE", mit),
        ("d/e.txt", "plain"),
        ("ab/c", "plain"),
    ]
    assert scan(spark, rows) == {
        ("LICENSE", "MIT", "own", None), ("a/b/COPYING.txt", "Apache-2.0", "own", None), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b"), ("a/y.py", "GPL-3.0", "own", None),
        ("a/z.py", "MIT", "inherited", ""), ("d/LICENSE", "MIT", "own", None), ("d/e.txt", "MIT", "inherited", "d"), ("ab/c", "MIT", "inherited", ""),
    }


def test_edges(spark):
    assert scan(spark, []) == set()
    assert scan(spark, [(None, None), ("a", ""), ("a", ""), ("b/c", "x " * 100000)]) == {(None, None, "none", None), ("a", None, "none", None), ("b/c", None, "none", None)}


def test_anchors_bound_the_rest():
    w = {"a": 3.0, "b": 2.0, "c": 1.0, "d": 0.5}
    for threshold in (0.3, 0.6, 0.9):
        kept = licenses.anchors(w, threshold)
        rest = sum(v * v for t, v in w.items() if t not in kept)
        assert rest < threshold**2 * sum(v * v for v in w.values())


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(str, map(tuple, licenses.op2_license_scan(spark, sf).collect()))) == sorted(map(str, con.execute(licenses.OP2_SQL).fetchall()))
