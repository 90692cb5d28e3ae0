import zlib
from collections import Counter, defaultdict

from loomspan.llm.common import Scratch
from loomspan.llm.sharding import kd_shards, op3_sharding, write_shards


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query_balances_bytes(spark, sf):
    rows = op3_sharding(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r["size"] == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    check_slots(rows)
    weight = Counter()
    for r in rows:
        weight[r.shard] += r["size"]
    heaviest = max(Counter({t: len(t.encode()) + 8 for t in docs.values()}).values())
    mean = sum(weight.values()) / 24
    assert set(weight) == set(range(24)) and max(weight.values()) - mean < heaviest / 2 + 0.05 * mean and mean - min(weight.values()) < heaviest / 2 + 0.05 * mean


def kd_brute(points, leaves, first=0):
    """Shard of each point (coordinates by dimension, weight): sort along the widest dimension, cut nearest to the goal."""
    if leaves == 1 or not points:
        return {p[0]: first for p in points}
    spans = [max(p[1][d] for p in points) - min(p[1][d] for p in points) for d in range(len(points[0][1]))]
    dim = spans.index(max(spans))
    rows = sorted(points, key=lambda p: p[1][dim])
    goal, below, cut = sum(p[2] for p in rows) * (leaves // 2) / leaves, 0, 0
    while cut < len(rows) and below + rows[cut][2] <= goal:
        below += rows[cut][2]
        cut += 1
    if cut < len(rows) and goal - below > rows[cut][2] / 2:
        cut += 1
    return kd_brute(rows[:cut], leaves // 2, first) | kd_brute(rows[cut:], leaves - leaves // 2, first + leaves // 2)


def test_against_brute_force(spark, monkeypatch):
    """Sizes and characters differ, so every cut is along one of these and no hash decides."""
    import math

    from loomspan.llm import sharding

    monkeypatch.setattr(sharding, "NEAR", 1e9)
    texts = {}
    for i in range(400):
        t = "é" * (40 + 7 * i) + "x" * (i * 37 % 1501)
        if all(len(t) != len(u) and len(t.encode()) != len(u.encode()) for u in texts.values()):
            texts[i] = t
    rows = kd_shards(spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string"), Scratch(spark, "t"), 7).collect()
    most = max(len(t.encode()) + 8 for t in texts.values())
    at = lambda n: math.floor(math.log(n + 1) / math.log(most + 2) * ((1 << 20) - 1))
    points = [(i, (at(len(t.encode())), at(len(t))), len(t.encode()) + 8) for i, t in texts.items()]
    assert len(points) > 150 and {r.doc_id: r.shard for r in rows} == kd_brute(points, 7)
    only = [(i, "x" * (40 + 7 * i), "en") for i in range(150)]
    got = {r.doc_id: r.shard for r in kd_shards(spark.createDataFrame(only, "doc_id long, text string, lang string"), Scratch(spark, "t"), 7).collect()}
    assert got == kd_brute([(i, (len(t),), len(t) + 8) for i, t, _ in only], 7)


def test_target_bytes(spark):
    data = [(i, "w" * (50 + i % 37) + str(i)) for i in range(500)]
    rows = kd_shards(spark.createDataFrame(data, "doc_id long, text string"), Scratch(spark, "t"), target_bytes=5000).collect()
    weight = Counter()
    for r in rows:
        weight[r.shard] += r["size"]
    assert len(weight) == -(-sum(weight.values()) // 5000) and max(weight.values()) < 5000 * 1.1


def test_texts_under_a_leaf_stay_whole(spark):
    """Groups of up to nine tenths of a leaf stay together; one of three leaves is dealt out."""
    data = [(i, f"{i % 40:03d}" + "x" * 100) for i in range(0, 2000)] + [(5000 + i, "y" * 103) for i in range(1000)]
    rows = kd_shards(spark.createDataFrame(data, "doc_id long, text string"), Scratch(spark, "t"), 24).collect()
    text, homes, weight = dict(data), defaultdict(set), Counter()
    for r in rows:
        homes[text[r.doc_id]].add(r.shard)
        weight[r.shard] += r["size"]
    assert all(len(v) == 1 for t, v in homes.items() if t[0] != "y") and len(homes["y" * 103]) >= 8
    assert len(rows) == 3000


def test_even_leaves_and_whole_groups(spark):
    data = [(i, "w" * (50 + i % 37) + str(i // 3), ["en", "de", None][i % 3], f"s{i % 5}") for i in range(3000)]
    rows = kd_shards(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), Scratch(spark, "t"), 24).collect()
    weight, homes = Counter(), defaultdict(set)
    text = {d[0]: d[1] for d in data}
    for r in rows:
        weight[r.shard] += r["size"]
        homes[text[r.doc_id]].add(r.shard)
    assert len(weight) == 24 and max(weight.values()) < 1.05 * min(weight.values())
    assert all(len(v) == 1 for v in homes.values())
    check_slots(rows)


def test_one_text_for_a_third_and_edges(spark):
    data = [(i, "same text" if i % 3 == 0 else f"text {i}", None, "a") for i in range(1200)] + [(1, None, None, None), (1, None, None, None), (None, "", None, None), (5, "x" * 100000, "en", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS shard", "2 AS h", "3 AS tie")
    rows = kd_shards(docs, Scratch(spark, "t"), 4).collect()
    assert len(rows) == 1204
    check_slots(rows)
    weight = Counter()
    for r in rows:
        weight[r.shard] += r["size"] if r["size"] < 50000 else 0
    # one text weighs more than all others and can't be cut: the others still aren't in one leaf
    assert max(weight.values()) <= 0.6 * sum(weight.values())
    assert kd_shards(docs.limit(0), Scratch(spark, "t"), 4).count() == 0


def test_shards_are_written(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shards = kd_shards(docs, Scratch(spark, "t"), 4)
    write_shards(docs, shards, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.shard, r.text) for r in back.collect()) == sorted((r.doc_id, r.shard, r.text) for r in docs.join(shards.select("doc_id", "shard"), "doc_id").collect())
