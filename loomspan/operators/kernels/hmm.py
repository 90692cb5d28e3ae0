"""Haplotype model of an outbred F1 family: an EM start without transitions, then Baum-Welch, then Viterbi.

A progeny's hidden state at a marker is half of each parent's founder haplotypes; a parent's is all of its own. Emissions
are Bernoulli allele probabilities of the founders; depths are binomial in the state's mean, genotypes Poisson-binomial.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np

#: Clamps and pseudocounts of the model.
P_MIN, JUMP_MIN, PSEUDO = 1e-6, 1e-8, 0.1
EMISSION_WEIGHT, JUMP_WEIGHT, PER_BP = 10.0, 1e5, 1e-8


@dataclass(frozen=True)
class States:
    ploidy: int
    members: np.ndarray  # (K, 2H) indicator of founders
    first: np.ndarray  # (K-2, H/2) founders of parent 1, of the progeny states
    second: np.ndarray

    @property
    def count(self) -> int:
        return len(self.members)


@lru_cache(maxsize=8)
def states(ploidy: int) -> States:
    """States 0 and 1 are the parents; the rest are all pairs of halves: C(H, H/2)**2 + 2 in all."""
    if ploidy < 2 or ploidy % 2:
        raise ValueError("the ploidy must be even")
    half = list(combinations(range(ploidy), ploidy // 2))
    pairs = [(a, b) for a in half for b in half]
    members = np.zeros((len(pairs) + 2, 2 * ploidy))
    members[0, :ploidy] = 1
    members[1, ploidy:] = 1
    for k, (a, b) in enumerate(pairs, 2):
        members[k, list(a)] = 1
        members[k, [ploidy + x for x in b]] = 1
    return States(ploidy, members, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))


@lru_cache(maxsize=8)
def _matchings(ploidy: int) -> np.ndarray:
    """(overlap, fixed) -> matchings of two halves with that overlap that leave so many founders where they are."""
    h = ploidy // 2
    out = np.zeros((h + 1, h + 1))
    for c in range(h + 1):
        left, right = list(range(h)), [*range(c), *range(ploidy, ploidy + h - c)]
        for p in permutations(right):
            out[c, sum(x == y for x, y in zip(left, p, strict=True))] += 1
    return out


@lru_cache(maxsize=8)
def _overlaps(ploidy: int) -> tuple[np.ndarray, np.ndarray]:
    s = states(ploidy)
    a, b = s.members[2:, :ploidy], s.members[2:, ploidy:]
    return (a @ a.T).astype(int), (b @ b.T).astype(int)


def transition(ploidy: int, jump: float) -> np.ndarray:
    """Rows of progeny states: each founder stays with 1 - jump or moves to one of the others."""
    h = ploidy // 2
    fixed = np.arange(h + 1)
    weight = _matchings(ploidy) @ ((jump / (ploidy - 1)) ** (h - fixed) * (1 - jump) ** fixed)
    c1, c2 = _overlaps(ploidy)
    t = weight[c1] * weight[c2]
    return t / t.sum(axis=1, keepdims=True)


@dataclass
class Data:
    """One contig or a chain of contigs: depths (N, M) of either allele, positions, parents' rows, last markers of parts."""

    ref: np.ndarray
    alt: np.ndarray
    positions: np.ndarray
    parents: tuple[int, int]
    ploidy: int
    conjunctions: tuple[int, ...] = ()
    field: str = "AD"

    @property
    def shape(self) -> tuple[int, int]:
        return self.ref.shape


@dataclass
class Fit:
    loglik: float
    iterations: int
    emissions: np.ndarray
    jumps: np.ndarray
    path: np.ndarray
    haplotypes: np.ndarray
    dropped: np.ndarray
    trace: list[float] = field(default_factory=list)
    whole: np.ndarray | None = None  # each sample's best single state for the whole contig, before states change; -1 if dropped


def poisson_binomial(p: np.ndarray) -> np.ndarray:
    """(..., n) success probabilities to (..., n + 1) probabilities of each count."""
    out = np.zeros((*p.shape[:-1], p.shape[-1] + 1))
    out[..., 0] = 1
    for i in range(p.shape[-1]):
        q = p[..., i : i + 1]
        moved = out[..., :-1] * q
        out *= 1 - q
        out[..., 1:] += moved
    return out


def log_emissions(data: Data, e: np.ndarray) -> np.ndarray:
    """(N, M, K) log likelihoods, without constants of the data; a missing call says nothing."""
    s = states(data.ploidy)
    if data.field == "GT":
        dist = np.stack([poisson_binomial(e[:, row > 0]) for row in s.members], axis=1)  # M, K, H + 1
        n, m = data.shape
        called = data.ref + data.alt == data.ploidy
        lik = dist[np.arange(m)[None, :], :, np.where(called, data.ref, 0)]
        return np.where(called[..., None], np.log(np.maximum(lik, 1e-300)), 0.0)
    p = np.clip(e @ s.members.T / data.ploidy, P_MIN, 1 - P_MIN)
    return data.ref[..., None] * np.log(p)[None] + data.alt[..., None] * np.log1p(-p)[None]


def _allowed(data: Data) -> np.ndarray:
    """(N, K): parents have their own state, progeny the others."""
    ok = np.zeros((data.shape[0], states(data.ploidy).count), bool)
    ok[:, 2:] = True
    for k, row in enumerate(data.parents):
        ok[row] = False
        ok[row, k] = True
    return ok


def _update_emissions(data: Data, e: np.ndarray, posterior: np.ndarray, prior: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected reads of each founder: a state's reads are shared by the founders' parts in its mean."""
    s = states(data.ploidy)
    total_a = np.maximum(e @ s.members.T, 1e-12)
    total_b = np.maximum((1 - e) @ s.members.T, 1e-12)
    a = np.einsum("n,nm,nmk->mk", weight, data.ref, posterior) / total_a
    b = np.einsum("n,nm,nmk->mk", weight, data.alt, posterior) / total_b
    ea, eb = e * (a @ s.members), (1 - e) * (b @ s.members)
    return np.clip((ea + PSEUDO * prior) / (ea + eb + PSEUDO), P_MIN, 1 - P_MIN)


def forward_backward(log_e: np.ndarray, steps: list[np.ndarray], start: np.ndarray) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """Log likelihood, posteriors (M, K) and pair posteriors of one progeny, scaled by column."""
    m, k = log_e.shape
    top = log_e.max(axis=1, keepdims=True)
    e = np.exp(log_e - top)
    f, scale = np.zeros((m, k)), np.zeros(m)
    f[0] = start * e[0]
    scale[0] = f[0].sum()
    f[0] /= scale[0]
    for t in range(1, m):
        f[t] = (f[t - 1] @ steps[t - 1]) * e[t]
        scale[t] = f[t].sum()
        f[t] /= scale[t]
    b = np.ones((m, k))
    for t in range(m - 2, -1, -1):
        b[t] = steps[t] @ (b[t + 1] * e[t + 1]) / scale[t + 1]
    pair = [f[t][:, None] * steps[t] * (b[t + 1] * e[t + 1])[None] / scale[t + 1] for t in range(m - 1)]
    loglik = float(np.log(scale).sum() + top.sum())
    backward = float(np.log((start * e[0] * b[0]).sum()) + np.log(scale[1:]).sum() + top.sum())
    if abs(backward - loglik) > 1e-6 * max(1.0, abs(loglik)):
        raise ArithmeticError(f"forward {loglik} and backward {backward} differ")
    return loglik, f * b, pair


def viterbi(log_e: np.ndarray, steps: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    """Most likely path; ties keep the state, else the smallest."""
    m, k = log_e.shape
    score = np.log(start) + log_e[0]
    back = np.zeros((m, k), int)
    for t in range(1, m):
        step = score[:, None] + np.log(np.maximum(steps[t - 1], 1e-300))
        best = step.max(axis=0)
        stay = np.arange(k)
        back[t] = np.where(step[stay, stay] >= best - 1e-12, stay, step.argmax(axis=0))
        score = step[back[t], stay] + log_e[t]
    path = np.zeros(m, int)
    path[-1] = int(score.argmax())
    for t in range(m - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def slots(founders: np.ndarray) -> np.ndarray:
    """(M, H) founder sets as (H, M) rows in which a founder keeps its place while it stays."""
    m, h = founders.shape
    out = np.zeros((m, h), founders.dtype)
    out[0] = founders[0]
    for t in range(1, m):
        now, free = set(founders[t].tolist()), []
        for i in range(h):
            if out[t - 1, i] in now:
                out[t, i] = out[t - 1, i]
                now.discard(int(out[t, i]))
            else:
                free.append(i)
        for i, x in zip(free, sorted(now), strict=True):
            out[t, i] = x
    return out.T


def fit(data: Data, seed: int, max_iter: int = 1000, tolerance: float = 1e-4, train_jumps: bool = True) -> Fit:
    """One randomly started fit. Samples without data at over max(3, 30 %) of the markers are dropped; parents stay."""
    rng = np.random.default_rng(seed)
    n, m = data.shape
    s = states(data.ploidy)
    missing = (data.ref + data.alt == 0).sum(axis=1)
    dropped = missing > m - max(3, 0.3 * m)
    dropped[list(data.parents)] = False
    use = ~dropped
    ref_all, alt_all = data.ref.sum(axis=0), data.alt.sum(axis=0)
    baf = np.where((ref_all == 0) | (alt_all == 0), 0.5, alt_all / np.maximum(ref_all + alt_all, 1))
    e = np.clip(rng.beta((1 - baf[:, None]) * EMISSION_WEIGHT, baf[:, None] * EMISSION_WEIGHT, size=(m, 2 * data.ploidy)), P_MIN, 1 - P_MIN)
    prior = e.copy()
    gaps = np.abs(np.diff(data.positions))
    stay = np.exp(-2 * gaps * PER_BP)
    jumps = np.clip(0.5 * rng.beta(np.maximum((1 - stay) * JUMP_WEIGHT, 1e-3), np.maximum(stay * JUMP_WEIGHT, 1e-3)), JUMP_MIN, 0.5 - JUMP_MIN) if m > 1 else np.zeros(0)
    allowed = _allowed(data)
    weight = use.astype(float)
    if data.field == "GT":
        weight[list(data.parents)] = max(1.0, (use.sum() - 2) / 2)
    trace: list[float] = []

    def converged(now: float) -> bool:
        trace.append(now)
        return now == 0 or len(trace) > 1 and (trace[-2] - now) / trace[-2] < tolerance

    # one state for the whole contig
    for _ in range(max_iter):
        log_e = log_emissions(data, e)
        whole = np.where(allowed, log_e.sum(axis=1), -np.inf)
        top = whole.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(whole - top).sum(axis=1)) - np.log(allowed.sum(axis=1))
        post = np.exp(whole - top)
        post /= post.sum(axis=1, keepdims=True)
        if converged(float((weight * total)[use].sum())):
            break
        e = _update_emissions(data, e, np.repeat(post[:, None], m, axis=1), prior, weight)
    trace.append(-np.inf)
    single = np.where(dropped, -1, whole.argmax(axis=1))
    # states that change along the markers
    start = np.full(s.count - 2, 1 / (s.count - 2))
    parents = set(data.parents)
    h2 = data.ploidy // 2
    c1, c2 = _overlaps(data.ploidy)
    moved = (2 * h2 - c1 - c2) / (2 * h2)
    iterations = len(trace) - 1
    loglik = -np.inf
    for _ in range(max_iter):
        iterations += 1
        steps = [transition(data.ploidy, float(j)) for j in jumps]
        log_e = log_emissions(data, e)
        post = np.zeros((n, m, s.count))
        jumped = np.zeros(max(m - 1, 0))
        new = 0.0
        for i in np.flatnonzero(use):
            if i in parents:
                k = data.parents.index(i)
                post[i, :, k] = 1
                new += weight[i] * log_e[i, :, k].sum()
                continue
            own, gamma, pair = forward_backward(log_e[i][:, 2:], steps, start)
            post[i, :, 2:] = gamma
            new += weight[i] * own
            for t in data.conjunctions:
                if t < m - 1:
                    jumped[t] += (pair[t] * moved).sum()
        done = np.isfinite(loglik) and (new == 0 or (loglik - new) / loglik < tolerance)
        loglik = new
        trace.append(new)
        if done:
            break
        e = _update_emissions(data, e, post, prior, weight)
        if train_jumps:
            progeny = max(1, int(use.sum()) - 2)
            for t in data.conjunctions:
                if t < m - 1:
                    jumps[t] = np.clip((jumped[t] + PSEUDO * jumps[t]) / (progeny + PSEUDO), JUMP_MIN, 0.5 - JUMP_MIN)
    steps = [transition(data.ploidy, float(j)) for j in jumps]
    log_e = log_emissions(data, e)
    path = np.full((n, m), -1)
    haplotypes = np.zeros((n, data.ploidy, m), int)
    for i in np.flatnonzero(use):
        path[i] = data.parents.index(i) if i in parents else viterbi(log_e[i][:, 2:], steps, start) + 2
        founders = np.array([np.flatnonzero(s.members[k]) + 1 for k in path[i]])
        haplotypes[i] = slots(founders)
    return Fit(float(loglik), iterations, e, jumps, path, haplotypes, dropped, [x for x in trace if np.isfinite(x)], single)


def segment_loglik(data: Data, fit_: Fit, start: int, stop: int) -> float:
    """Log likelihood of the markers from ``start`` to before ``stop``, as if the chain began there in any allowed state."""
    if not 0 <= start < stop <= data.shape[1]:
        raise ValueError(f"no markers {start} to {stop}")
    log_e, allowed = log_emissions(data, fit_.emissions)[:, start:stop], _allowed(data)
    steps = [transition(data.ploidy, float(j)) for j in fit_.jumps[start : stop - 1]]
    out = 0.0
    for i in np.flatnonzero(~fit_.dropped):
        if i in data.parents:
            out += float(log_e[i][:, allowed[i]].sum())
            continue
        own = log_e[i][:, 2:]
        f = np.full(own.shape[1], 1 / own.shape[1])
        for t in range(len(own)):
            top = own[t].max()
            f = (f if t == 0 else f @ steps[t - 1]) * np.exp(own[t] - top)
            out += float(np.log(f.sum()) + top)
            f /= f.sum()
    return out


def part_logliks(data: Data, fit_: Fit) -> list[float]:
    """One for each contig of a chain; a contig alone has one."""
    ends = sorted({*[t + 1 for t in data.conjunctions if t + 1 < data.shape[1]], data.shape[1]})
    return [segment_loglik(data, fit_, a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def calls(fit_: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Dosage of the reference allele (N, M; -1 for dropped samples) and phased alleles (N, H, M; 0 reference)."""
    is_ref = fit_.emissions >= 0.5
    m = np.arange(is_ref.shape[0])
    allele = np.where(is_ref[m[None, None, :], np.maximum(fit_.haplotypes - 1, 0)], 0, 1)
    dosage = (allele == 0).sum(axis=1)
    dosage[fit_.dropped] = -1
    allele[fit_.dropped] = -1
    return dosage, allele
