"""Kernels on one linkage group: shortest marker path, joining of contig ends, grouping, ordering."""

from __future__ import annotations

import heapq

import numpy as np


def kosambi(r):
    r = np.minimum(r, 0.4999999)
    return 0.25 * np.log((1 + 2 * r) / (1 - 2 * r))


def shortest_path(n: int, edges: list[tuple[int, int, float]]) -> tuple[list[int], float]:
    """Lightest path 0..n-1 over edges (u < v, weight); of equal predecessors the lowest wins."""
    cost, back = [0.0] + [float("inf")] * (n - 1), [-1] * n
    by_end: dict[int, list[tuple[int, float]]] = {}
    for u, v, w in edges:
        by_end.setdefault(v, []).append((u, w))
    for v in range(1, n):
        for u, w in sorted(by_end.get(v, [])):
            if cost[u] + w < cost[v]:
                cost[v], back[v] = cost[u] + w, u
    if n > 1 and back[n - 1] < 0:
        return [], float("inf")
    path = [n - 1]
    while path[-1] > 0:
        path.append(back[path[-1]])
    return path[::-1], cost[-1]


def join_ends(contigs: list[str], pairs: list[tuple[str, str, tuple[float, float, float, float]]], threshold: float) -> list[list[tuple[str, bool, float | None]]]:
    """Chains of (contig, reversed, fraction to the next) by repeatedly joining the two nearest free ends.

    ``pairs`` has the fractions (ss, se, es, ee) of a's and b's ends. Only fractions up to the threshold join. The ends
    inside a chain are used up, so a joined chain's four fractions to another are those of its two outer ends, and the
    queue drops what they aren't. Of equal fractions, pair and orientation are the ones whose two other ends, which stay
    free, have the least fractions to further ends (their sum); then the smaller names.
    """
    ends = ("s", "e")
    near: dict[tuple[str, str], dict[tuple[str, str], float]] = {(c, e): {} for c in contigs for e in ends}
    queue: list[tuple[float, tuple[str, str], tuple[str, str]]] = []
    for a, b, four in pairs:
        for k, x in enumerate(four):
            if x is not None and x == x:
                p, q = sorted(((a, ends[k // 2]), (b, ends[k % 2])))
                near[p][q] = near[q][p] = x
                if x <= threshold:
                    queue.append((x, p, q))
    heapq.heapify(queue)
    chain_of = {c: c for c in contigs}
    chains: dict[str, list[tuple[str, bool, float | None]]] = {c: [(c, False, None)] for c in contigs}

    def free(c: str) -> tuple[tuple[str, str], tuple[str, str]]:
        first, last = chains[c][0], chains[c][-1]
        return (first[0], "e" if first[1] else "s"), (last[0], "s" if last[1] else "e")

    def open_(end: tuple[str, str]) -> bool:
        return end in free(chain_of[end[0]])

    def outward(end: tuple[str, str], other: tuple[str, str]) -> float:
        """Least fraction of the chain's other end to a free end of a third chain."""
        first, last = free(chain_of[end[0]])
        own = {chain_of[end[0]], chain_of[other[0]]}
        return min((x for q, x in near[last if first == end else first].items() if chain_of[q[0]] not in own and open_(q)), default=float("inf"))

    while queue:
        tied = [heapq.heappop(queue)]
        while queue and queue[0][0] == tied[0][0]:
            tied.append(heapq.heappop(queue))
        tied = [t for t in tied if chain_of[t[1][0]] != chain_of[t[2][0]] and open_(t[1]) and open_(t[2])]
        if not tied:
            continue
        best = min(tied, key=lambda t: (outward(t[1], t[2]) + outward(t[2], t[1]), t[1], t[2])) if len(tied) > 1 else tied[0]
        for t in tied:
            if t is not best:
                heapq.heappush(queue, t)
        x, (a, ea), (b, eb) = best
        left, right = chains.pop(chain_of[a]), chains.pop(chain_of[b])
        if (left[-1][0], "s" if left[-1][1] else "e") != (a, ea):
            left = _turned(left)
        if (right[0][0], "e" if right[0][1] else "s") != (b, eb):
            right = _turned(right)
        joined = [*left[:-1], (left[-1][0], left[-1][1], x), *right]
        name = joined[0][0]
        chains[name] = joined
        for c, _, _ in joined:
            chain_of[c] = name
    out = []
    for chain in chains.values():
        out.append(min(chain, _turned(chain), key=lambda c: (c[0][0], c[0][1])))
    return sorted(out, key=lambda c: (-len(c), c[0][0]))


def _turned(chain):
    gaps = [g for _, _, g in chain[:-1]][::-1]
    return [(c, not r, gaps[i] if i < len(gaps) else None) for i, (c, r, _) in enumerate(chain[::-1])]


def communities(nodes: list, edges: list[tuple], passes: int = 20) -> dict:
    """Groups of a weighted graph by local moves that raise modularity, then the same on the groups (ties: smallest name)."""
    group = {v: v for v in nodes}
    level_nodes, level_edges = list(nodes), [(a, b, w) for a, b, w in edges if w > 0]
    while True:
        near: dict = {v: {} for v in level_nodes}
        degree = dict.fromkeys(level_nodes, 0.0)
        whole = 0.0
        for a, b, w in level_edges:
            degree[a] += w
            degree[b] += w
            whole += w
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        if not whole:
            return group
        own = {v: v for v in level_nodes}
        mass = dict(degree)
        for _ in range(passes):
            moved = False
            for v in sorted(level_nodes):
                mass[own[v]] -= degree[v]
                links: dict = {}
                for u, w in near[v].items():
                    links[own[u]] = links.get(own[u], 0.0) + w
                gain = lambda g: links.get(g, 0.0) - degree[v] * mass[g] / (2 * whole)  # noqa: B023, E731
                best = max(sorted({*links, own[v]}), key=lambda g: (round(gain(g), 12), g == own[v]))  # noqa: B023
                moved |= best != own[v]
                own[v] = best
                mass[best] += degree[v]
            if not moved:
                break
        if all(own[v] == v for v in level_nodes):
            return group
        group = {v: own[group[v]] for v in group}
        merged: dict = {}
        for a, b, w in level_edges:
            key = tuple(sorted((own[a], own[b])))
            merged[key] = merged.get(key, 0.0) + w
        level_nodes = sorted(set(own.values()))
        level_edges = [(a, b, w) for (a, b), w in merged.items()]


def smacof(distance: np.ndarray, dims: int = 1, rounds: int = 200, seed: int = 0, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Multidimensional scaling by majorisation, started from classical scaling; the points and their stress-1."""
    n = len(distance)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ distance**2 @ centre)
    x = vectors[:, ::-1][:, :dims] * np.sqrt(np.maximum(values[::-1][:dims], 0))
    x = x + 1e-9 * np.random.default_rng(seed).normal(size=x.shape)
    w = np.ones_like(distance) if weights is None else weights.astype(float).copy()
    np.fill_diagonal(w, 0)
    inverse = np.linalg.pinv(np.diag(w.sum(axis=1)) - w)
    for _ in range(rounds):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        b = -w * np.divide(distance, d, out=np.zeros_like(d), where=d > 1e-12)
        b[np.arange(n), np.arange(n)] = -b.sum(axis=1)
        new = inverse @ (b @ x)
        if np.abs(new - x).max() < 1e-9:
            break
        x = new
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return x, float(np.sqrt((w * (d - distance) ** 2).sum() / max((w * d**2).sum(), 1e-12)))


def scaled_axis(rf: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places along the main axis of the scaling with the least stress-1 of twelve.

    They are two and three dimensions, weights by the LOD and its square, and distances by either map function or none.
    """
    r = np.clip(rf, 0, 0.4999999)
    maps = (100 * kosambi(r), -50 * np.log(1 - 2 * r), 100 * r)
    best, points = np.inf, None
    for distance in maps:
        for power in (1, 2):
            for dims in (2, 3):
                x, stress = smacof(distance, min(dims, len(rf) - 1), weights=np.maximum(score, 1e-6) ** power)
                if stress < best:
                    best, points = stress, x
    points = points - points.mean(axis=0)
    return points @ np.linalg.svd(points, full_matrices=False)[2][0]


def order(contigs: list[str], rf: dict[tuple[str, str], tuple[float, float, float, float]], exact: int = 9, scores: dict[tuple[str, str], float] | None = None) -> list[tuple[str, bool, float]]:
    """(contig, reversed, cM to the next) of the shortest walk through all contigs with either orientation.

    Up to ``exact`` contigs by dynamic programming; more by nearest insertion along a scaled axis (with ``scores``, LODs of
    the pairs, the best of twelve scalings), then moves that turn, shift or reverse stretches until none helps.
    """
    n = len(contigs)
    cost = np.full((n, 2, n, 2), 25 * np.log((1 + 2 * 0.4999999) / (1 - 2 * 0.4999999)))
    for i, a in enumerate(contigs):
        for j, b in enumerate(contigs):
            four = rf.get((a, b))
            if four is None and (b, a) in rf:
                ss, se, es, ee = rf[b, a]
                four = (ss, es, se, ee)
            if i != j and four is not None:
                for ri in (0, 1):
                    for rj in (0, 1):
                        # leaving end of a, entering end of b
                        cost[i, ri, j, rj] = 100 * kosambi(four[2 * (1 - ri) + rj])
    if n == 1:
        return [(contigs[0], False, 0.0)]
    if n <= exact:
        walk = _exact(cost)
    else:
        axis = None
        if scores:
            least, score = np.full((n, n), 0.4999999), np.zeros((n, n))
            np.fill_diagonal(least, 0)
            at = {c: i for i, c in enumerate(contigs)}
            for (a, b), four in rf.items():
                i, j = at[a], at[b]
                least[i, j] = least[j, i] = min(four)
                score[i, j] = score[j, i] = scores.get((a, b), scores.get((b, a), 0.0))
            axis = scaled_axis(least, score)
        walk = _search(cost, axis)
    if (contigs[walk[0][0]] > contigs[walk[-1][0]]):
        walk = [(i, 1 - r) for i, r in walk[::-1]]
    return [(contigs[i], bool(r), float(cost[i, r, *walk[k + 1]]) if k + 1 < n else 0.0) for k, (i, r) in enumerate(walk)]


def _exact(cost):
    n = cost.shape[0]
    best = {(1 << i, i, r): (0.0, None) for i in range(n) for r in (0, 1)}
    for mask in range(1, 1 << n):
        for i in range(n):
            for r in (0, 1):
                if (mask, i, r) not in best:
                    continue
                c = best[mask, i, r][0]
                for j in range(n):
                    if not mask >> j & 1:
                        for q in (0, 1):
                            key, new = (mask | 1 << j, j, q), c + cost[i, r, j, q]
                            if key not in best or new < best[key][0] - 1e-12:
                                best[key] = (new, (mask, i, r))
    full = (1 << n) - 1
    at = min(((best[full, i, r][0], i, r) for i in range(n) for r in (0, 1)))
    key, walk = (full, at[1], at[2]), []
    while key:
        walk.append((key[1], key[2]))
        key = best[key][1]
    return walk[::-1]


def _search(cost, axis=None):
    """A short walk: insertion along a scaled axis, then turned and shifted stretches while one of them helps.

    A stretch costs the same in either direction, so every move is judged by the few steps at its ends.
    """
    n = cost.shape[0]
    if axis is None:
        near = cost.min(axis=(1, 3))
        near = np.minimum(near, near.T)
        np.fill_diagonal(near, 0)
        axis = smacof(near, 1)[0][:, 0]
    step = cost.tolist()

    def between(a, b):
        """Cost of the step from a to b; nothing at the walk's ends."""
        return 0.0 if a is None or b is None else step[a[0]][a[1]][b[0]][b[1]]

    def at(walk, k):
        return walk[k] if 0 <= k < len(walk) else None

    turned = lambda part: [(c, 1 - r) for c, r in reversed(part)]
    walk: list = []
    for i in np.argsort(axis, kind="stable").tolist():
        added = [(between(at(walk, k - 1), (i, r)) + between((i, r), at(walk, k)) - between(at(walk, k - 1), at(walk, k)), k, r) for k in range(len(walk) + 1) for r in (0, 1)]
        _, k, r = min(added)
        walk.insert(k, (i, r))
    better = True
    while better:
        better = False
        for i in range(n):
            for j in range(i + 1, n + 1):
                before, first, last, after = at(walk, i - 1), walk[i], walk[j - 1], at(walk, j)
                gain = between(before, first) + between(last, after) - between(before, (last[0], 1 - last[1])) - between((first[0], 1 - first[1]), after)
                if gain > 1e-9:
                    walk[i:j] = turned(walk[i:j])
                    better = True
        for size in (1, 2, 3):
            for i in range(n - size + 1):
                part, rest = walk[i : i + size], walk[:i] + walk[i + size :]
                freed = between(at(walk, i - 1), part[0]) + between(part[-1], at(walk, i + size)) - between(at(rest, i - 1), at(rest, i))
                options = [(between(at(rest, k - 1), p[0]) + between(p[-1], at(rest, k)) - between(at(rest, k - 1), at(rest, k)), k, t) for t, p in enumerate((part, turned(part))) for k in range(len(rest) + 1)]
                cheapest, k, t = min(options)
                if cheapest < freed - 1e-9:
                    walk = rest[:k] + (turned(part) if t else part) + rest[k:]
                    better = True
    return walk
