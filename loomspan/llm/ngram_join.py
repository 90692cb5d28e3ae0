"""Jaccard self-join of word-shingle sets by a prefix-tree join.

1. Every text becomes a set of 64-bit shingle hashes. Equal sets are one class, so copies cost one set.
2. The global order puts shingles that many documents share last and orders the rest by hash. A class posts the shingles
   of its prefix, extended by a tenth of the set: two classes that reach the similarity share as many of them. Postings
   travel packed, in buckets whose size is set by the count of postings; shingles posted once can link nothing and go, and
   so do classes with too few shared ones.
3. Candidates come from the classes that share a posted shingle and whose sizes allow the overlap. First, of each shingle
   the class that shares most is a pivot for the others; next, each class tries the few that look likeliest; the last
   round takes all pairs that no link connects so far, so no link between components is lost, yet a group of near copies
   isn't paired up in full. Signatures of the sets bound a pair's overlap from above; most pairs that only share a passage
   end there.
4. A pivot's candidates are stored as a trie (sequences in lexicographic order with their common prefixes); the walk
   counts the overlap with the pivot once for a shared path and leaves a path when what remains can't reach the bound.
5. No link leaves a component, so the links are counted in each one: all pairs of its classes get their exact overlap, by
   pairs of blocks. Only counts leave a block; the pairs themselves are never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, mix, ngram_hashes, released, span_hashes, table, text_chunks, words
from .components import components

SHINGLE = 5
#: Similarity as a ratio of integers: 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
#: Prefixes are longer by this percentage of the set, so that a class must share as many more shingles to link with any.
EXTENSION = 10
#: A shingle goes last in the order if classes that share it with one nearby (in a window of so many shingles of a task)
#: come to this many; of more than the bound the most frequent ones (8 bytes each are broadcast). The order is the same for
#: all sets whatever is in it, so it bears on speed alone.
HEAVY_LEAST, MAX_HEAVY, WINDOW = 24, 1 << 18, 1_000_000
#: Fewest shingles of a set that can reach the similarity with a different one: below three, one shingle too many is a third.
LEAST = 3
#: Bits of a class's number. Classes that share one are told apart by a second hash; their numbers are broadcast, and so many
#: are allowed (chance makes some thirty among 25 thousand million different texts).
CLASS_BITS, MAX_SPLIT = 63, 1 << 20
#: Classes that a task remembers.
MAX_SEEN = 1 << 17
#: Postings of a bucket, postings that a task holds before it sends them, members of a salted group of a heavy shingle.
BUCKET, FLUSH, GROUP = 200_000, 200_000, 200_000
#: Shingles of a pivot's candidates in one trie.
TRIE_TOKENS = 200_000
#: Partners that the round before the last tries for each class, and the block of members that is paired at once.
BEST, BLOCK = 3, 1000
#: Bytes of a block's signatures, about.
BLOCK_BYTES = 1 << 21
#: Least and most bits of a set's signature, four a shingle between; an upper bound of two sets' overlap follows from them.
SIGNATURE = (512, 1 << 18)
PAIRS = "a long, b long, least long, met long"
#: Cells of the matrix that counts overlaps, and most sets that hold a shingle whose pairs are listed instead.
CELLS, FEW = 1 << 22, 8
#: Bits of the fixed-size filter that picks the texts whose sets are needed; a full filter only costs time.
FILTER_BITS = 1 << 23


def extension(n):
    """Shingles that two classes share in their extended prefixes, by the smaller one's size."""
    return np.maximum(1, n * EXTENSION // 100)


def prefix_length(n):
    return n - (NUM * n + DEN - 1) // DEN + extension(n)


def required(n, m):
    return (NUM * (n + m) + NUM + DEN - 1) // (NUM + DEN)


def shingle_sets(data: np.ndarray, rows: np.ndarray, n: int = SHINGLE, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by both; hashes of another ``key`` are independent."""
    starts, ends, row = words(data, rows)
    hashes = span_hashes(lower_ascii(data), starts, ends, key)
    grams = ngram_hashes(hashes, n)
    whole = row[: len(grams)] == row[n - 1 :] if len(grams) else np.zeros(0, bool)
    r, h = [row[: len(grams)][whole]], [grams[whole]]
    count = np.bincount(row, minlength=len(rows) - 1)
    first = np.searchsorted(row, np.arange(len(rows) - 1))
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            r.append(short)
            h.append(mix(ngram_hashes(hashes, k)[first[short]] + np.uint64(k)))
    r, h = np.concatenate(r), np.concatenate(h)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


def fingerprints(r: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and a 63-bit hash of the set, for each row."""
    n = np.bincount(r, minlength=n_rows).astype(np.int64)
    sums = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(h), out=sums[1:])
        ends = np.cumsum(n)
        total = sums[ends] - sums[ends - n]
        fp = mix(total + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    return n, fp.astype(np.int64)


def classes(data: np.ndarray, rows: np.ndarray, split: np.ndarray, bits: int):
    """(row, hash) of the shingles, and each row's set size and class; classes in ``split`` are told apart by a second hash."""
    r, h = shingle_sets(data, rows)
    n, fp = fingerprints(r, h, len(rows) - 1)
    fp &= (1 << bits) - 1
    if len(split):
        at = np.minimum(np.searchsorted(split, fp), len(split) - 1)
        fp = np.where(split[at] == fp, fp ^ fingerprints(*shingle_sets(data, rows, key=1), len(rows) - 1)[1], fp)
    return r, h, n, fp


def signatures(r: np.ndarray, h: np.ndarray, n_rows: int) -> list[bytes]:
    """Bitmaps of the sets' hashes. The bits in which two differ each stand for a shingle that only one of them has."""
    n = np.bincount(r, minlength=n_rows)
    ends = np.cumsum(n)
    size = np.clip(2 ** np.ceil(np.log2(np.maximum(4 * n, 1))).astype(np.int64), *SIGNATURE)
    spot = mix(h)
    out: list[bytes] = [b""] * n_rows
    for bits in np.unique(size):
        rows = np.flatnonzero(size == bits)
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            table_ = np.zeros((len(part), bits), bool)
            for k, row in enumerate(part.tolist()):
                table_[k, (spot[ends[row] - n[row] : ends[row]] % np.uint64(bits)).astype(np.int64)] = True
            for row, x in zip(part.tolist(), np.packbits(table_, axis=1), strict=True):
                out[row] = x.tobytes()
    return out


def _scan(bits: int):
    """Documents' fingerprints and signatures, and counts of the shingles that are frequent in a window of the task's classes."""

    def run(batches):
        seen, held, size = _Seen(), [], 0

        def flush():
            h, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 2
            return h[often].view(np.int64), counts[often]

        def out(ids, fp, other, n, signs, shingle, count):
            k = len(shingle)
            none = np.zeros(k, np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids, pa.nulls(k, ids.type)]),
                    *[pa.array(np.concatenate((x, none))) for x in (fp, other, n)],
                    pa.array([*signs, *[None] * k], pa.binary()),
                    pa.array(np.concatenate((np.zeros(len(fp), np.int64), shingle))),
                    pa.array(np.concatenate((np.zeros(len(fp), np.int64), count.astype(np.int64)))),
                ],
                ["doc_id", "fp", "other", "n", "sign", "shingle", "count"],
            )

        none = np.zeros(0, np.int64)
        last = None
        for batch in batches:
            last = batch.column(0)
            for at, data, rows in text_chunks(batch.column(1)):
                k = len(rows) - 1
                r, h, n, fp = classes(data, rows, none, bits)
                other = fingerprints(*shingle_sets(data, rows, key=1), k)[1]
                yield out(batch.column(0).slice(at, k), fp, other, n, signatures(r, h, k), none, none)
                fresh = seen.fresh(fp, n >= LEAST)
                held.append(h[fresh[r]])
                size += len(held[-1])
                if size >= WINDOW:
                    yield out(batch.column(0).slice(0, 0), none, none, none, [], *flush())
                    held, size = [], 0
        if held:
            yield out(last.slice(0, 0), none, none, none, [], *flush())

    return released(run)


class _Seen:
    """Classes that a task has met, up to a bound; one that is forgotten only costs work again."""

    def __init__(self):
        self.held = np.zeros(0, np.int64)

    def fresh(self, fp: np.ndarray, use: np.ndarray) -> np.ndarray:
        """The first row of each class, of those to use, that the task hasn't met."""
        out = np.zeros(len(fp), bool)
        out[np.unique(fp, return_index=True)[1]] = True
        out &= use
        if len(self.held):
            out &= self.held[np.minimum(np.searchsorted(self.held, fp), len(self.held) - 1)] != fp
        self.held = np.union1d(self.held if len(self.held) < MAX_SEEN else self.held[:0], fp[out])
        return out


def _ordered(r: np.ndarray, h: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles as their places in the global order, sorted within each row."""
    key = h >> np.uint64(1)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
        key = key | ((heavy[at] == h).astype(np.uint64) << np.uint64(63))
    order = np.lexsort((key, r))
    return r[order], key[order]


def _post(heavy_held, split_held, bits: int, buckets: int):
    """Postings of the classes' prefixes, packed by bucket: shingle, class, and size and place."""

    def run(batches):
        heavy, seen, held, size = heavy_held.value, _Seen(), [], 0

        def flush():
            key, fp, place = (np.concatenate(x) for x in zip(*held, strict=True))
            often = key >> np.uint64(63) == 1
            bucket = (mix(np.where(often, key ^ mix(fp.view(np.uint64)), key)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, packed = bucket[order], np.stack((key.view(np.int64), fp, place), axis=1)[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            for i in range(0, len(cuts) - 1, 256):
                part = cuts[i : i + 257]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[part[:-1]]), pa.array([packed[a:b].tobytes() for a, b in zip(part[:-1], part[1:], strict=True)], pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for _, data, rows in text_chunks(batch.column(0)):
                r, h, n, fp = classes(data, rows, split_held.value, bits)
                fresh = seen.fresh(fp, n >= LEAST)
                use = fresh[r]
                r, key = _ordered(r[use], h[use], heavy)
                kept = np.where(fresh, n, 0)
                place = np.arange(len(r)) - (np.cumsum(kept) - kept)[r]
                use = place < prefix_length(n[r])
                r, key, place = r[use], key[use], place[use]
                held.append((key, fp[r], (n[r] << 32) | place))
                size += len(r)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return released(run)


def _shared(bucket: pa.Table) -> pa.Table:
    """A bucket's postings whose shingle is in several classes."""
    packed = [np.frombuffer(v.as_buffer(), np.int64).reshape(-1, 3) for v in bucket.column("packed")]
    rows = np.concatenate(packed)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    rows = rows[new]
    same = np.zeros(len(rows) + 1, bool)
    same[1:-1] = rows[1:, 0] == rows[:-1, 0]
    rows = rows[same[1:] | same[:-1] | (rows[:, 0] < 0)]
    return pa.table({name: np.ascontiguousarray(rows[:, i]) for i, name in enumerate(("key", "fp", "place"))})


def _possible(np_a: np.ndarray, np_b: np.ndarray) -> np.ndarray:
    """Whether sizes and places of a common shingle allow the similarity."""
    n, m, i, j = np_a >> 32, np_b >> 32, np_a & 0xFFFFFFFF, np_b & 0xFFFFFFFF
    most = np.minimum(i, j) + np.minimum(n - i, m - j)
    return (NUM * np.maximum(n, m) <= DEN * np.minimum(n, m)) & (most >= required(n, m))


def _least(place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
    """Shingles that a pair must share in its extended prefixes."""
    return extension(np.minimum(place_a >> 32, place_b >> 32))


def _pairs_batch(pairs: list[np.ndarray]):
    """Distinct (a, b, least) with the shingles at which they were met."""
    if pairs and (all_ := np.concatenate(pairs)).size:
        rows, met = np.unique(all_, axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], pa.array(met.astype(np.int64))], ["a", "b", "least", "met"])


def _stars(pivots: int):
    """Pairs of each group's first members with the others. Rows: key, salt, fp, place, label; sorted by group and rank."""

    def run(batches):
        carry, held, size = None, [], 0
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            lead = 0
            if carry is not None:
                rows, lead = np.concatenate((carry, rows)), len(carry)
            index = np.arange(len(rows))
            start = np.ones(len(rows), bool)
            start[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            head = np.maximum.accumulate(np.where(start, index, 0))
            for j in range(pivots):
                at = head + j
                use = np.flatnonzero((at < index) & (index >= lead))
                a, b = rows[at[use]], rows[use]
                use = (a[:, 4] != b[:, 4]) & _possible(a[:, 3], b[:, 3])
                held.append(np.stack((a[use, 2], b[use, 2], _least(a[use, 3], b[use, 3])), axis=1))
                size += int(use.sum())
            carry = rows[head[-1] : head[-1] + pivots]
            if size >= 500_000:
                yield from _pairs_batch(held)
                held, size = [], 0
        yield from _pairs_batch(held)

    return released(run)


def _likeliest(rows: np.ndarray, best: int) -> np.ndarray:
    """Of rows (a, b, score) those among the ``best`` of a or of b."""
    keep = np.zeros(len(rows), bool)
    for side in (0, 1):
        order = np.lexsort((rows[:, 1 - side], -rows[:, 2], rows[:, side]))
        own = rows[order, side]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], own[1:] != own[:-1])), np.arange(len(own)), 0))
        keep[order[np.arange(len(own)) - first < best]] = True
    return rows[keep]


def _blocks(best: int):
    """Pairs of a group's two blocks with different labels, whose sizes and signatures allow the similarity.

    Rows: pivot, s, t, side, fp, label, n, sign; sorted by the first five. With ``best``, of each class only so many.
    """
    return released(lambda batches: _paired(batches, best))


def _paired(batches, best: int):
    held, size = [], 0
    for rows, signs in _groups(batches):
        own_pairs = []
        inside = rows[0, 1] == rows[0, 2]
        words_ = np.array([len(x) // 8 for x in signs])
        for w in np.unique(words_):
            # sizes of a link differ by a third at most, so their signatures are as long or one is twice as long
            left, twice = np.flatnonzero(words_ == w), np.flatnonzero(words_ == 2 * w)
            own = np.stack([np.frombuffer(signs[i], np.uint64) for i in left])
            if len(twice):
                longer = np.stack([np.frombuffer(signs[i], np.uint64) for i in twice])
                both, bits = np.concatenate((left, twice)), np.concatenate((own, longer[:, :w] | longer[:, w:]))
            else:
                both, bits = left, own
            step = max(1, (1 << 19) // (len(both) * int(w)))
            for i in range(0, len(left), step):
                x = left[i : i + step]
                n, m = rows[x, 6][:, None], rows[both, 6][None, :]
                ok = (rows[x, 5][:, None] != rows[both, 5][None, :]) & (NUM * np.maximum(n, m) <= DEN * np.minimum(n, m))
                # of equally long signatures each pair once; of two blocks only pairs across
                ok &= (rows[x, 4][:, None] < rows[both, 4][None, :]) | (np.arange(len(both)) >= len(left))[None, :]
                if not inside:
                    ok &= rows[x, 3][:, None] != rows[both, 3][None, :]
                u, v = np.nonzero(ok)
                for k in range(0, len(u), max(1, (1 << 18) // int(w))):
                    p, q = u[k : k + max(1, (1 << 18) // int(w))], v[k : k + max(1, (1 << 18) // int(w))]
                    apart = np.bitwise_count(own[i + p] ^ bits[q]).sum(axis=1, dtype=np.int64)
                    n1, n2 = rows[x[p], 6], rows[both[q], 6]
                    use = (n1 + n2 - apart) // 2 >= required(n1, n2)
                    f, g = rows[x[p[use]], 4], rows[both[q[use]], 4]
                    # overlap of the bound in millionths of the union
                    most = ((n1 + n2 - apart) // 2)[use]
                    own_pairs.append(np.stack((np.minimum(f, g), np.maximum(f, g), most * 1_000_000 // (n1 + n2)[use]), axis=1))
        if own_pairs and (met := np.concatenate(own_pairs)).size:
            held.append((_likeliest(met, best) if best else met)[:, :2])
            size += len(held[-1])
        if size >= 200_000:
            yield _distinct(held)
            held, size = [], 0
    if size:
        yield _distinct(held)


def _distinct(pairs: list[np.ndarray]):
    rows = np.unique(np.concatenate(pairs), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(2)], ["a", "b"])


def _groups(batches, keys: int = 3):
    """Runs of rows that agree in their first ``keys`` columns: the numbers, and the last column's bytes."""
    held: list[tuple[np.ndarray, list[bytes]]] = []

    def done():
        return np.concatenate([x for x, _ in held]), [y for _, part in held for y in part]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], axis=1)
        signs = batch.column(batch.num_columns - 1).to_pylist()
        cuts = [0, *(np.flatnonzero((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (held[-1][0][0, :keys] != rows[lo, :keys]).any():
                yield done()
                held = []
            held.append((rows[lo:hi], signs[lo:hi]))
    if held:
        yield done()


def _near(batches):
    """Pairs whose signatures allow the similarity. Rows: a, b, sizes and signatures of both."""
    for batch in batches:
        n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        x, y = ([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(i)] for i in (4, 5))
        apart = np.zeros(len(n), np.int64)
        for i, (u, v) in enumerate(zip(x, y, strict=True)):
            # the longer bitmap folds to the shorter: places are hashes modulo powers of two
            if len(u) > len(v):
                u = np.bitwise_or.reduce(u.reshape(-1, len(v)), axis=0)
            elif len(v) > len(u):
                v = np.bitwise_or.reduce(v.reshape(-1, len(u)), axis=0)
            apart[i] = np.bitwise_count((u ^ v).view(np.uint64)).sum(dtype=np.int64)
        yield batch.select(["a", "b"]).filter(pa.array((n + m - apart) // 2 >= required(n, m)))


def trie(sets: list[np.ndarray]) -> tuple[list[int], list[tuple[int, int, int, int, int]]]:
    """The sets (ascending arrays) as a prefix tree: their lexicographic order, and the inner nodes, parents first.

    A node is (first, past, depth, least, most): the sets of that range of the order share their first ``depth`` shingles
    and have ``least`` to ``most`` of them. A node's children are the largest nodes inside its range, and single sets.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    sizes = [len(sets[i]) for i in order]
    shared = [0]
    for i, j in zip(order, order[1:], strict=False):
        n = min(len(sets[i]), len(sets[j]))
        differ = np.flatnonzero(sets[i][:n] != sets[j][:n])
        shared.append(int(differ[0]) if len(differ) else n)
    nodes, open_ = [], [(0, 0, sizes[0], sizes[0])]
    for k in range(1, len(order) + 1):
        depth = shared[k] if k < len(order) else -1
        first, least, most = k - 1, sizes[k - 1], sizes[k - 1]
        while open_ and open_[-1][0] > depth:
            d, first, lo, hi = open_.pop()
            least, most = min(least, lo), max(most, hi)
            nodes.append((first, k, d, least, most))
        if open_ and open_[-1][0] == depth:
            d, at, lo, hi = open_.pop()
            open_.append((d, at, min(lo, least), max(hi, most)))
        else:
            open_.append((depth, first, least, most))
        if k < len(order):
            d, at, lo, hi = open_.pop()
            open_.append((d, at, min(lo, sizes[k]), max(hi, sizes[k])))
    return order, sorted((n for n in nodes if n[2] >= 0), key=lambda n: (n[0], -n[1]))


def trie_join(pivot: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Indices of the sets (ascending arrays) that reach the similarity with the pivot.

    A walk of their prefix tree counts the overlap of a shared path with the pivot once. Below a path with so many shingles
    of the pivot, a set of some size gets at most what is left of it or of the pivot besides; if no size of a subtree can
    reach the bound so, the walk passes over the whole subtree.
    """
    if not sets:
        return []
    order, nodes = trie(sets)
    size, found = len(pivot), []

    def walk(own: np.ndarray, depth: int, to: int, overlap: int, used: int, least: int, most: int) -> tuple[int, int] | None:
        """Overlap and used shingles of the pivot after own[:to]; None if no size between can reach the bound."""
        step = 64
        while depth < to:
            part = own[depth : min(to, depth + step)]
            at = np.searchsorted(pivot, part)
            hit = pivot[np.minimum(at, size - 1)] == part
            overlap += int(hit.sum())
            used = int(at[-1] + hit[-1])
            depth += len(part)
            step *= 4
            # the bound is slackest for the size that could use up the pivot exactly
            n = min(max(depth + size - used, least), most)
            if overlap + min(n - depth, size - used) < required(size, n):
                return None
        return overlap, used

    # nodes above, outermost first: past, depth, overlap, used
    above: list[tuple[int, int, int, int]] = [(len(order), 0, 0, 0)]
    at, k = 0, 0
    while at < len(order):
        while above[-1][0] <= at:
            above.pop()
        _, depth, overlap, used = above[-1]
        while k < len(nodes) and nodes[k][0] < at:
            k += 1
        own = sets[order[at]]
        if k < len(nodes) and nodes[k][0] == at and nodes[k][2] >= depth and nodes[k][1] <= above[-1][0] and nodes[k][1] > at + 1:
            _, past, to, least, most = nodes[k]
            k += 1
            reached = walk(own, depth, to, overlap, used, least, most)
            if reached is None:
                at = past
            else:
                above.append((past, to, *reached))
            continue
        reached = walk(own, depth, len(own), overlap, used, len(own), len(own))
        if reached is not None and reached[0] >= required(size, len(own)):
            found.append(order[at])
        at += 1
    return found


def _verify(batches):
    """Links of each pivot's trie. Rows: a, chunk, b (null: the pivot's own set), set; sorted by a, chunk, b, pivot first."""
    pivot, members, sets, at = None, [], [], None

    def done():
        if pivot is None or not sets:
            return [], []
        hits = trie_join(pivot, sets)
        return [at[0]] * len(hits), [members[i] for i in hits]

    for batch in batches:
        a, b = [], []
        for key, chunk, member, packed in zip(*(batch.column(i) for i in range(4)), strict=True):
            key = (key.as_py(), chunk.as_py())
            if key != at:
                x, y = done()
                a += x
                b += y
                pivot, members, sets, at = None, [], [], key
            own = np.frombuffer(packed.as_buffer(), np.uint64)
            if not member.is_valid:
                pivot = own
            else:
                members.append(member.as_py())
                sets.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    a, b = done()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Common shingles of each of the first ``left`` sets and each of the others; of all sets with each other if there are none."""
    total = len(sets)
    first, across = (left, True) if left < total else (0, False)
    height, width = (left, total - left) if across else (total, total)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(total), [len(x) for x in sets])
    # the columns of few sets come first, each with its rows side by side
    order = np.lexsort((row, column, held[column]))
    row, count = row[order], held[column[order]]
    out = np.zeros(height * width, np.int64)
    for n in range(2, FEW + 1):
        lo, hi = np.searchsorted(count, (n, n + 1))
        same = row[lo:hi].reshape(-1, n)
        for i in range(n if len(same) else 0):
            for j in range(i + 1, n):
                a, b = same[:, i], same[:, j]
                if across:
                    use = (a < left) & (b >= left)
                    a, b = a[use], b[use]
                np.add.at(out, a * width + b - first, 1)
    out = out.reshape(height, width)
    if not across:
        out += out.T
    at = int(np.searchsorted(count, FEW + 1))
    own, row = column[order[at:]], row[at:]
    place = np.cumsum(np.concatenate(([0], own[1:] != own[:-1]))) if len(own) else own
    step = max(1, CELLS // total)
    for i in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        lo, hi = np.searchsorted(place, (i, i + step))
        cells = np.zeros((total, min(step, int(place[-1]) + 1 - i)), np.float32)
        cells[row[lo:hi], place[lo:hi] - i] = 1
        # a product of ones is exact below 2**24 columns
        out += (cells[:left] @ cells[first:].T).astype(np.int64)
    return out


def _count_links(batches):
    """Links of each class within a group of rows. Rows: label, s, t, side, fp, set; sorted by the first five."""
    for rows, packed in _groups(batches):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 3:] != rows[:-1, 3:]).any(axis=1)
        rows, sets = rows[new], [np.frombuffer(x, np.uint64) for x, use in zip(packed, new, strict=True) if use]
        inside = rows[0, 1] == rows[0, 2]
        left = len(rows) if inside else int((rows[:, 3] == 0).sum())
        if not inside and left in (0, len(rows)):
            continue
        n = np.array([len(x) for x in sets], np.int64)
        first = 0 if inside else left
        both = overlaps(sets, left)
        linked = DEN * both >= NUM * (n[:left, None] + n[None, first:] - both)
        if inside:
            np.fill_diagonal(linked, False)
        links = linked.sum(axis=1) if inside else np.concatenate((linked.sum(axis=1), linked.sum(axis=0)))
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(rows[some, 4]), pa.array(links[some].astype(np.int64))], ["fp", "links"])


def _link_counts(labels: DataFrame, known: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, n_links) of the classes of components: how many other classes each one links with."""
    members = scratch.keep(labels.select(F.col("v").alias("fp"), "label").join(known.select("fp", "n"), "fp"), "members")
    sizes = scratch.keep(members.groupBy("label").agg(F.count("*").alias("classes"), F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(TRIE_TOKENS))).cast("long").alias("blocks")), "sizes")
    sized = scratch.keep(members.join(sizes, "label"), "sized")
    held = sized.where("classes > 2").join(sets, "fp").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "label", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), (F.col("own") > F.col("other")).cast("long").alias("side"), "fp", "set"
    )
    met = rows.repartition("label", "s", "t").sortWithinPartitions("label", "s", "t", "side", "fp").mapInArrow(_count_links, "fp long, links long")
    # two classes are a component by their one link
    return scratch.keep(met.union(sized.where("classes = 2").select("fp", F.lit(1).cast("long"))).groupBy("fp").agg(F.sum("links").alias("n_links")), "counts")


def _bit(ident: Column) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(FILTER_BITS))


def _needed_sets(docs: DataFrame, wanted: DataFrame, heavy_held, split_held, bits: int) -> DataFrame:
    """(fp, set) of the documents ``wanted`` (fp, doc_id), and of a few more that a fixed-size filter lets through."""
    spark = docs.sparkSession
    marked = wanted.select(_bit(F.col("doc_id")).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 64) AS int))")).alias("bits")).toPandas()
    words_ = np.zeros(FILTER_BITS // 64, np.int64)
    words_[marked["word"].to_numpy(np.int64)] = marked["bits"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(words_.view(np.uint64))

    def run(batches):
        heavy, filled, seen = heavy_held.value, held.value, _Seen()
        for batch in batches:
            bit = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            batch = batch.filter(pa.array((filled[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1))
            for _, data, rows in text_chunks(batch.column(1)):
                r, h, n, fp = classes(data, rows, split_held.value, bits)
                fresh = seen.fresh(fp, n > 0)
                r, key = _ordered(r, h, heavy)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(fp[fresh]), pa.array([key[e - k : e].tobytes() for k, e in zip(n[fresh].tolist(), ends[fresh].tolist(), strict=True)], pa.binary())], ["fp", "set"])

    found = docs.where("doc_id IS NOT NULL").select(_bit(F.col("doc_id")).alias("bit"), "text").mapInArrow(released(run), "fp long, set binary")
    # a missing id hashes to the seed, 42: texts without any id are picked by their sets
    if not words_[0] >> 42 & 1:
        return found
    idless = docs.where("doc_id IS NULL").select(_bit(F.col("doc_id")).alias("bit"), "text").mapInArrow(released(run), "fp long, set binary")
    return found.union(idless.join(wanted.where("doc_id IS NULL").select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))


def ngram_components(docs: DataFrame, scratch: Scratch, count_links: bool = True, class_bits: int = CLASS_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of every row; ``docs`` has doc_id and text.

    A class is the rows with equal sets, named by its smallest doc_id that isn't null. A row's n_links are the other classes
    that its own reaches the similarity with, all of them: copies of one text are one class, and its copies aren't links.
    Without ``count_links`` the last column is missing and only the links that connect components are found.
    Sets are of 64-bit keyed hashes of the words' bytes; a class is named by 126 bits, and different classes are linked by at
    least three equal shingles (smaller sets reach the similarity with no other), so no chance collision makes a link. Texts without words (null and empty ones too) have an empty set and
    link with nothing. A component is named by its smallest doc_id that isn't null. Repeated rows and copies share a
    class and so a component. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = scratch.keep(docs.mapInArrow(_scan(class_bits), "doc_id long, fp long, other long, n long, sign binary, shingle long, count long"), "scan")
    rows = scan.where("count = 0").select("doc_id", "fp", "n", "other", "sign")
    double = rows.where("n > 0").groupBy("fp").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo < hi").select("fp").limit(MAX_SPLIT + 1).collect()
    if len(double) > MAX_SPLIT:
        raise ValueError(f"over {MAX_SPLIT} classes share their numbers: raise class_bits")
    split = np.sort(np.array([r[0] for r in double], np.int64))
    split_held = spark.sparkContext.broadcast(split)
    if len(split):
        rows = scratch.keep(rows.join(spark.createDataFrame([(int(x),) for x in split], "fp long").withColumn("twice", F.lit(True)), "fp", "left").select("doc_id", F.when(F.col("twice"), F.col("fp").bitwiseXOR(F.col("other"))).otherwise(F.col("fp")).alias("fp"), "n", "sign"), "rows")
    stats = rows.agg(F.count("*").alias("rows"), F.sum(F.expr(f"CASE WHEN n > 0 THEN n - (({NUM} * n + {DEN - 1}) div {DEN}) + greatest(1, n * {EXTENSION} div 100) END")).alias("postings")).first()
    often = scan.where("count > 0").groupBy("shingle").agg(F.sum("count").alias("count")).where(F.col("count") >= HEAVY_LEAST).orderBy(F.desc("count"), "shingle").limit(MAX_HEAVY)
    heavy_held = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64)))
    buckets = max(1, -(-(stats["postings"] or 0) // BUCKET))
    packed = docs.select("text").mapInArrow(_post(heavy_held, split_held, class_bits, buckets), "bucket long, packed binary")
    shared = scratch.keep(packed.groupBy("bucket").applyInArrow(_shared, "key long, fp long, place long"), "shared")
    for _ in range(2):
        # the smallest partner of a class has three quarters of its size
        least = F.expr(f"greatest(1, (({NUM} * any_value(shiftright(place, 32)) + {DEN - 1}) div {DEN}) * {EXTENSION} div 100)")
        able = shared.groupBy("fp").agg(F.count("*").alias("shared"), least.alias("least")).where("shared >= least").select("fp")
        held = scratch.keep(shared.join(able, "fp", "left_semi"), "held")
        several = held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        scratch.drop(shared)
        shared = scratch.keep(held.join(several, "key", "left_semi"), "shared")
        scratch.drop(held)
    # classes that share most of their prefix come first; heavy shingles' groups are dealt out by class
    share = scratch.keep(shared.groupBy("fp").agg((F.lit(0) - F.count("*")).alias("rank")), "share")
    ranked = shared.join(share, "fp")
    wide = shared.where("key < 0").groupBy("key").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("long").alias("salts")).where("salts > 1")
    ranked = scratch.keep(ranked.join(wide, "key", "left").select("key", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod("fp", "salts")).cast("long").alias("salt"), "fp", "place", "rank"), "ranked")
    scratch.drop(shared)
    known = rows.where("n > 0").join(share.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sign").alias("sign"))
    known = scratch.keep(known, "known")
    sets = None
    labels = spark.createDataFrame([], "v long, label long")
    links = spark.createDataFrame([], "a long, b long")
    tested = spark.createDataFrame([], "a long, b long")

    def with_labels(df: DataFrame) -> DataFrame:
        return df.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))

    families = None
    for step in ("first", "best", "last"):
        if step == "first":
            met = with_labels(ranked).repartition("key", "salt").sortWithinPartitions("key", "salt", "rank", "fp").select("key", "salt", "fp", "place", "label").mapInArrow(_stars(1), PAIRS)
            # later rounds see to what this one met too seldom
            found = met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.first("least").alias("least")).where("met >= least").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            found = _near_pairs(found, known)
        else:
            families = _families(with_labels(ranked), scratch) if families is None else families
            members = scratch.keep(with_labels(families), "labelled")
            found = _cross(members, known, scratch, BEST if step == "best" else 0).distinct()
        pairs = scratch.keep(found.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
            wanted = wanted if sets is None else wanted.join(sets, "fp", "left_anti")
            new = scratch.keep(_needed_sets(docs, wanted.join(known, "fp").select("fp", "doc_id"), heavy_held, split_held, class_bits), "sets")
            sets = new if sets is None else sets.union(new)
            linked = scratch.keep(_links(pairs, sets), "links")
            links, tested = links.union(linked), tested.union(pairs)
            labels = components(links, scratch)
    held = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("class_id")).join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    names = ["component_id", "class_id"]
    if count_links:
        counts = _link_counts(labels, known, sets, scratch) if sets is not None else spark.createDataFrame([], "fp long, n_links long")
        held = held.join(counts, "fp", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
        names.append("n_links")
    # each side of a join is written before it, so that a large component's or class's rows can be split there
    held = scratch.keep(held, "classes")
    first = scratch.keep(held.groupBy("label").agg(F.min("class_id").alias("component_id")), "components")
    named = scratch.keep(held.join(first, "label").select("fp", *names), "named")
    whole = rows.where("n > 0").select("doc_id", "fp", F.col("n").alias("n_shingles")).join(named, "fp").select("doc_id", "n_shingles", *names)
    alone = {"n_links": F.lit(0).cast("long")}
    return whole.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), *[alone.get(x, F.col("doc_id")).alias(x) for x in names]))


def _near_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    first, second = (known.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sign").alias(f"s{x}")) for x in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near, "a long, b long")


def _families(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(pivot, fp, rank): the classes that share a shingle whose first class is the pivot.

    The groups of all shingles with one first class are one family, in which a pair is met once: most shingles of a group
    of near copies have the same. Shingles whose classes are connected already are left out.
    """
    split = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("rank", "fp"))["fp"].alias("pivot")).where("lo < hi").select("key", "pivot")
    heads = scratch.keep(split, "heads")
    return scratch.keep(labelled.join(heads, "key").select("pivot", "fp", "rank").distinct(), "families")


def _cross(members: DataFrame, known: DataFrame, scratch: Scratch, best: int) -> DataFrame:
    """Possible pairs with different labels of each family; with ``best``, of each class so many of a block, the likeliest.
    A large family is blocks of members, and each pair of blocks is a group of rows."""
    # a signature has under eight bits a shingle, and SIGNATURE's bounds
    own_bytes = F.least(F.greatest("n", F.lit(SIGNATURE[0] // 8)), F.lit(SIGNATURE[1] // 8))
    members = scratch.keep(members.join(known.select("fp", "n"), "fp"), "members")
    sizes = members.groupBy("pivot").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum(own_bytes) / F.lit(BLOCK_BYTES))).cast("long").alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    sizes = scratch.keep(sizes.select("pivot", "blocks"), "sizes")
    held = members.join(sizes, "pivot").join(known.select("fp", "sign"), "fp").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "pivot", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), (F.col("own") > F.col("other")).cast("long").alias("side"), "fp", "label", "n", "sign"
    )
    return rows.repartition("pivot", "s", "t").sortWithinPartitions("pivot", "s", "t", "side", "fp").mapInArrow(_blocks(best), "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that reach the similarity: each pivot's candidates, in chunks of bounded size, against the pivot."""
    # a candidate's set has at most 4/3 of the pivot's shingles
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    sized = counts.join(sets.select(F.col("fp").alias("a"), "set"), "a").withColumn("chunks", F.ceil(F.col("n") * F.octet_length("set") * DEN / NUM / 8 / TRIE_TOKENS).cast("long"))
    pivots = sized.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "set")
    chosen = pairs.join(sized.select("a", "chunks"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b")
    dealt = chosen.join(sets.select(F.col("fp").alias("b"), "set"), "b").select("a", "chunk", "b", "set")
    return dealt.union(pivots).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first()).mapInArrow(_verify, "a long, b long")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), Scratch(spark, "ngram"))
