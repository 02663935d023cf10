"""Forward, backward and Viterbi over many reads at once, in memory that grows with the square root of a read's length.

A step takes the frames at one place of all reads of a group that are so long; what the reads' bands have for edges is laid
end to end, sorted once for each pair of bands that follow each other. Forward values are kept at the last frame of
each block of frames only, and a block's are computed again when the backward pass, or the trace of the best path,
comes to it. A group has as many reads as fit ``ENTRIES`` numbers a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np

from ..functions.kernels import aggregate_segments
from ..sources.models import Model

#: Frames of a block at least (a block of a longer read has the square root of its length), and numbers that a block of a group may have.
BLOCK, ENTRIES = 512, 6_000_000
#: Pairs of bands whose edges a task remembers.
PAIRS = 200_000


def _lse_at(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Logsumexp of the runs of values that begin at ``first``."""
    m = np.maximum.reduceat(values, first)
    safe = np.where(np.isfinite(m), m, 0.0)
    size = np.diff(np.append(first, len(values)))
    with np.errstate(divide="ignore"):
        return safe + np.log(np.add.reduceat(np.exp(values - np.repeat(safe, size)), first))


def _ragged(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, index) of all indexes of the ranges start .. start + count."""
    rep = np.repeat(np.arange(len(start)), count)
    return rep, np.arange(len(rep)) + np.repeat(start - np.cumsum(count) + count, count)


def _firsts(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


class Lattice:
    """The bands of a model's labels, numbered as they are first asked for, and the edges between bands that follow each other."""

    def __init__(self, model: Model, width: int | None):
        """``width``: a band has the states up to so many places from a segment's; None: one band of all states."""
        self.model, self.width = model, width
        self.out = np.searchsorted(model.edges[:, 0], np.arange(model.states + 1)) if len(model.edges) else np.zeros(model.states + 1, int)
        self.kinds = sorted(set(model.key))
        self.kind_of = np.searchsorted(self.kinds, model.key)
        self.bands: list[np.ndarray] = [] if width is not None else [np.arange(model.states)]
        self._first: dict[str, tuple[int, int] | None] = {}
        self._pairs: dict[int, tuple[np.ndarray, ...]] = {}

    def walk(self, chrom: str | None, mv: np.ndarray | None, n: int) -> np.ndarray | None:
        """The band of each of a read's frames; None for a label that the model doesn't have."""
        if self.width is None:
            return np.zeros(n, int)
        name = next(iter(self.model.bands)) if len(self.model.bands) == 1 else chrom or ""
        if name not in self._first:
            positions = self.model.positions(chrom)
            self._first[name] = None if positions is None else (len(self.bands), len(positions))
            for j in range(len(positions or [])):
                self.bands.append(np.unique(np.concatenate([np.zeros(0, int), *positions[max(0, j - self.width) : min(len(positions), j + self.width + 1)]])))
        at = self._first[name]
        return None if at is None else at[0] + aggregate_segments(mv, at[1])

    def pair(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """(edge, row in a, row in b) of the edges from band a to band b, sorted by row in a, and their order by row in b."""
        key = 2 * a + (b != a)
        if key not in self._pairs:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            x, y = self.bands[a], self.bands[b]
            size = self.out[x + 1] - self.out[x]
            row, edge = _ragged(self.out[x], size)
            target = self.model.edges[edge, 1]
            at = np.searchsorted(y, target)
            ok = y[np.minimum(at, len(y) - 1)] == target if len(y) else np.zeros(len(edge), bool)
            edge, row, at = edge[ok], row[ok], at[ok]
            self._pairs[key] = edge, row, at, np.argsort(at, kind="stable")
        return self._pairs[key]


class _Group:
    """Reads of a group, the longest first, with their bands and pairs renumbered from 0."""

    def __init__(self, lattice: Lattice, xs: list[np.ndarray], walks: list[np.ndarray]):
        model = lattice.model
        self.size = np.array([len(x) for x in xs])
        self.first = np.cumsum(self.size) - self.size
        self.x, walk = np.concatenate(xs), np.concatenate(walks)
        self.n = int(self.size[0])
        self.alive = np.searchsorted(-self.size, -np.arange(self.n + 1), "left")
        used, self.band = np.unique(walk, return_inverse=True)
        bands = [lattice.bands[b] for b in used.tolist()]
        self.width = max(map(len, bands))
        self.states = np.full((len(bands), self.width), -1)
        for k, b in enumerate(bands):
            self.states[k, : len(b)] = b
        kind = np.where(self.states >= 0, lattice.kind_of[self.states], -1)
        of = np.unique(kind[kind >= 0])
        self.kinds = [lattice.kinds[k] for k in of.tolist()]
        self.kind = np.where(kind >= 0, np.searchsorted(of, kind), len(of))  # the last column is for places beyond a band
        self.emissions = [model.emissions[k] for k in self.kinds]
        after = np.append(walk[1:], walk[-1:])
        after[self.first + self.size - 1] = walk[self.first + self.size - 1]
        pairs, self.pair = np.unique(2 * walk + (after != walk), return_inverse=True)
        found = [lattice.pair(p // 2, p // 2 + p % 2) for p in pairs.tolist()]
        self.count = np.array([len(f[0]) for f in found])
        self.start = np.cumsum(self.count) - self.count
        self.edge, self.src, self.dst = (np.concatenate([f[k] for f in found]) for k in range(3))
        self.by_dst = np.concatenate([s + f[3] for s, f in zip(self.start.tolist(), found)])
        self.logp = model.logp[self.edge]
        self.block = max(BLOCK, isqrt(self.n))

    def blocks(self) -> list[tuple[int, int]]:
        return [(t, min(t + self.block, self.n)) for t in range(0, self.n, self.block)]

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.alive[t]] + t

    def densities(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(frames of a block by time, their log densities by kind and minus infinity, where each time begins)."""
        frames = np.concatenate([self.at(t) for t in range(lo, hi)])
        x = self.x[frames]
        dens = np.full((len(frames), len(self.kinds) + 1), -np.inf)
        for k, e in enumerate(self.emissions):
            dens[:, k] = e.log_density(x)
        return frames, dens, np.concatenate([[0], np.cumsum(self.alive[lo:hi])])

    def emit(self, dens: np.ndarray, begin: int, t: int) -> np.ndarray:
        at = self.at(t)
        return dens[begin + np.arange(len(at))[:, None], self.kind[self.band[at]]]

    def ahead(self, alpha: np.ndarray, t: int) -> np.ndarray:
        """Forward values before the emissions of frame t, from those of frame t - 1."""
        k = self.alive[t]
        pair = self.pair[self.first[:k] + t - 1]
        rep, flat = _ragged(self.start[pair], self.count[pair])
        flat = self.by_dst[flat]
        out = np.full(k * self.width, -np.inf)
        if len(flat):
            to = rep * self.width + self.dst[flat]
            first = _firsts(to)
            out[to[first]] = _lse_at(alpha[rep, self.src[flat]] + self.logp[flat], first)
        return out.reshape(k, self.width)


def _scaled(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = a.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        total = safe + np.log(np.exp(a - safe[:, None]).sum(axis=1))
    return a - np.where(np.isfinite(total), total, 0.0)[:, None], total


def _forward(g: _Group, logpi: np.ndarray, lo: int, hi: int, alpha: np.ndarray | None, coeff: np.ndarray, dens: np.ndarray, begin: np.ndarray, keep: bool) -> list[np.ndarray]:
    """Forward values of the frames lo .. hi - 1 from those of frame lo - 1: of all of them, or of the last only."""
    held = []
    for t in range(lo, hi):
        emit = g.emit(dens, int(begin[t - lo]), t)
        if t:
            a = g.ahead(alpha, t) + emit
        else:
            states = g.states[g.band[g.at(0)]]
            a = np.where(states >= 0, logpi[states], -np.inf) + emit
        alpha, coeff[g.at(t)] = _scaled(a)
        if keep:
            held.append(alpha)
    return held if keep else [alpha]


def _groups(lattice: Lattice, xs: list[np.ndarray], walks: list[np.ndarray]) -> Iterator[list[int]]:
    """Reads with frames, the longest first, in groups whose blocks have ENTRIES numbers at most or that are one read."""
    order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: -len(xs[i]))
    width = max(map(len, lattice.bands), default=1)
    at = 0
    while at < len(order):
        n = len(xs[order[at]])
        most = max(1, ENTRIES // (min(n, max(BLOCK, isqrt(n))) * 2 * (width + min(width, len(lattice.kinds)) + 1)))
        yield order[at : at + most]
        at += most


def expected_counts(lattice: Lattice, xs: list[np.ndarray], walks: list[np.ndarray]) -> tuple[dict[tuple, float], int]:
    """(expected counts of the reads by (kind, key, comp, i, j), how many of them have no path in their bands).

    ``xs``: frames by dimensions of each read; ``walks``: the band of each frame. Posteriors of states and edges are normalised at each step.
    """
    total: dict[tuple, float] = {}
    lost = 0

    def add(key: tuple, value: float) -> None:
        total[key] = total.get(key, 0.0) + value

    model = lattice.model
    for group in _groups(lattice, xs, walks):
        while group:
            g = _Group(lattice, [xs[i] for i in group], [walks[i] for i in group])
            coeff, blocks, alpha, lasts = np.empty(len(g.x)), g.blocks(), None, []
            for lo, hi in blocks:
                frames, dens, begin = g.densities(lo, hi)
                held = _forward(g, model.logpi, lo, hi, alpha, coeff, dens, begin, len(blocks) == 1)
                alpha = held[-1]
                lasts.append(alpha)
            per_read = np.add.reduceat(coeff, g.first)
            if np.isfinite(per_read).all():
                break
            lost += int((~np.isfinite(per_read)).sum())
            group = [i for i, ok in zip(group, np.isfinite(per_read)) if ok]
        else:
            continue
        add(("score", "", 0, 0, 0), float((per_read / g.size).sum()))
        add(("loglik", "", 0, 0, 0), float(per_read.sum()))
        add(("reads", "", 0, 0, 0), float(len(group)))
        xi, pi = np.zeros(len(model.edges)), np.zeros(model.states)
        ahead = np.zeros((0, g.width))
        for b in range(len(blocks) - 1, -1, -1):
            lo, hi = blocks[b]
            if len(blocks) > 1:
                frames, dens, begin = g.densities(lo, hi)
                held = _forward(g, model.logpi, lo, hi, lasts[b - 1] if b else None, coeff, dens, begin, True)
            gamma = np.zeros((len(frames), g.width))
            for t in range(hi - 1, lo - 1, -1):
                k, on = g.alive[t], g.alive[t + 1]
                a, beta = held[t - lo], np.zeros((k, g.width))
                if on:
                    pair = g.pair[g.first[:on] + t]
                    rep, flat = _ragged(g.start[pair], g.count[pair])
                    src = g.src[flat]
                    rest = g.logp[flat] + ahead[rep, g.dst[flat]]
                    back = np.full(on * g.width, -np.inf)
                    of = rep * g.width + src
                    first = _firsts(of)
                    back[of[first]] = _lse_at(rest, first)
                    beta[:on] = back.reshape(on, g.width)
                    step = a[rep, src] + rest
                    edge_of = _firsts(rep)
                    top = np.maximum.reduceat(step, edge_of)
                    p = np.exp(step - top[rep])
                    np.add.at(xi, g.edge[flat], p / np.add.reduceat(p, edge_of)[rep])
                p = a + beta
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                gamma[begin[t - lo] : begin[t - lo + 1]] = p
                ahead = beta + g.emit(dens, int(begin[t - lo]), t) - coeff[g.at(t)][:, None]
            # a state stands once in a band, but several states of it may have one emission
            width = len(g.kinds) + 1
            place = np.arange(len(frames))[:, None] * width + g.kind[g.band[frames]]
            weight = np.bincount(place.ravel(), gamma.ravel(), len(frames) * width).reshape(-1, width)
            x = g.x[frames]
            for k, (name, e) in enumerate(zip(g.kinds, g.emissions)):
                if weight[:, k].any():
                    for (kind, comp, i, j), v in e.sums(x, weight[:, k]).items():
                        add((kind, name, comp, i, j), v)
            if not lo:
                states = g.states[g.band[g.at(0)]]
                np.add.at(pi, states[states >= 0], gamma[: len(states)][states >= 0])
        for e in np.flatnonzero(xi).tolist():
            add(("xi", "", 0, int(model.edges[e, 0]), int(model.edges[e, 1])), float(xi[e]))
        seen = g.states[g.band[g.at(0)]]
        for s in np.unique(seen[seen >= 0]).tolist():
            add(("pi", "", 0, s, 0), float(pi[s]))
    return total, lost


def log_likelihoods(lattice: Lattice, xs: list[np.ndarray], walks: list[np.ndarray]) -> np.ndarray:
    """ln P(read); of no frames, minus infinity."""
    out = np.full(len(xs), -np.inf)
    for group in _groups(lattice, xs, walks):
        g = _Group(lattice, [xs[i] for i in group], [walks[i] for i in group])
        coeff, alpha = np.empty(len(g.x)), None
        for lo, hi in g.blocks():
            _, dens, begin = g.densities(lo, hi)
            alpha = _forward(g, lattice.model.logpi, lo, hi, alpha, coeff, dens, begin, False)[0]
        out[group] = np.add.reduceat(coeff, g.first)
    return out


def best_paths(model: Model, xs: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """(log-probability, states) of each read's best path over all states; of equal sources the lowest wins. Without a path: minus infinity and zeros."""
    out: list[tuple[float, np.ndarray]] = [(0.0 if not len(x) else float("-inf"), np.zeros(len(x), np.int32)) for x in xs]
    lattice, s = Lattice(model, None), model.states
    order = np.lexsort((model.edges[:, 0], model.edges[:, 1])) if len(model.edges) else np.zeros(0, int)
    src, dst, logp = model.edges[order, 0], model.edges[order, 1], model.logp[order]
    first = _firsts(dst) if len(dst) else np.zeros(0, int)
    size, place = np.diff(np.append(first, len(dst))), np.arange(len(dst))
    for group in _groups(lattice, xs, []):
        walks = [np.zeros(len(xs[i]), int) for i in group]
        g = _Group(lattice, [xs[i] for i in group], walks)
        blocks, delta, lasts = g.blocks(), np.zeros((0, s)), []
        score, last = np.zeros(len(group)), np.zeros(len(group), np.int32)

        def run(lo: int, hi: int, delta: np.ndarray, back: np.ndarray | None, begin: np.ndarray, dens: np.ndarray) -> np.ndarray:
            """Best values from those of frame lo - 1 to those of hi - 1; ``back`` takes each state's source, or without it scores are summed."""
            for t in range(lo, hi):
                k = g.alive[t]  # noqa: B023
                emit = g.emit(dens, int(begin[t - lo]), t)  # noqa: B023
                if not t:
                    best = np.tile(model.logpi, (k, 1))
                else:
                    best = np.full((k, s), -np.inf)
                    if len(dst):
                        v = delta[:k, src] + logp
                        top = np.maximum.reduceat(v, first, axis=1)
                        best[:, dst[first]] = top
                        if back is not None:
                            hit = np.minimum.reduceat(np.where(v == np.repeat(top, size, axis=1), place, len(dst) - 1), first, axis=1)
                            back[t - lo, :k, dst[first]] = src[hit].T
                delta = best + emit
                m = _scaled(delta)[1]
                delta = delta - np.where(np.isfinite(m), m, 0.0)[:, None]
                if back is None or len(blocks) == 1:  # noqa: B023
                    score[:k] += m  # noqa: B023
                    ends = slice(int(g.alive[t + 1]), int(k))  # noqa: B023
                    last[ends] = delta[ends].argmax(axis=1)  # noqa: B023
                    score[ends] += delta[ends].max(axis=1)  # noqa: B023
            return delta

        back = np.zeros((0, 0, 0), np.int32)
        for lo, hi in blocks:
            _, dens, begin = g.densities(lo, hi)
            back = np.zeros((hi - lo, len(group), s), np.int32) if len(blocks) == 1 else None
            delta = run(lo, hi, delta, back, begin, dens)
            lasts.append(delta)
        state, paths = np.zeros(len(group), np.int32), np.zeros(len(g.x), np.int32)
        for b in range(len(blocks) - 1, -1, -1):
            lo, hi = blocks[b]
            if len(blocks) > 1:
                _, dens, begin = g.densities(lo, hi)
                back = np.zeros((hi - lo, len(group), s), np.int32)
                run(lo, hi, lasts[b - 1] if b else delta[:0], back, begin, dens)
            for t in range(hi - 1, lo - 1, -1):
                k = g.alive[t]
                state[g.alive[t + 1] : k] = last[g.alive[t + 1] : k]
                paths[g.at(t)] = state[:k]
                if t:
                    state[:k] = back[t - lo, np.arange(k), state[:k]]
        for i, at, n, v in zip(group, g.first.tolist(), g.size.tolist(), score.tolist()):
            if np.isfinite(v):
                out[i] = v, paths[at : at + n]
    return out
