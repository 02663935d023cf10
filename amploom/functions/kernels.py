"""Numpy kernels over one signal: the sequential recurrences that column expressions can't say.

Each takes and returns arrays and knows nothing of Spark; ``operators`` wrap them as Arrow-batched functions.
Defaults follow the documented intent. Where the known behaviour of older files differs, a flag asks for it.
"""

from __future__ import annotations

import heapq
from math import isqrt

import numpy as np

NEG = -np.inf
_LN2PI = float(np.log(2 * np.pi))


def logsumexp(x: np.ndarray) -> float:
    """ln(sum(exp(x))); of nothing or only impossible terms, minus infinity."""
    m = np.max(x, initial=NEG)
    return float(m) if np.isinf(m) else float(m + np.log(np.exp(x - m).sum()))


def min_window_std(x: np.ndarray, window: int = 12) -> float:
    """The least population deviation of a full window; of a signal that is shorter, that of the whole."""
    if not len(x):
        return 0.0
    view = np.lib.stride_tricks.sliding_window_view(x, min(window, len(x)))
    return float(np.sqrt(view.var(axis=1).min()))


def min_window_variance(x: np.ndarray, window: int = 6, compat: bool = False) -> float:
    """The least variance of a full window. ``compat``: the running update that adds the outgoing square instead of taking it off."""
    if not compat or len(x) <= window:
        return min_window_std(x, window) ** 2
    s1, s2 = float(x[:window].sum()), float((x[:window] ** 2).sum())
    least = s2 / window - (s1 / window) ** 2
    for i in range(window, len(x)):
        s1 += x[i] - x[i - window]
        s2 += x[i] ** 2 + x[i - window] ** 2
        least = min(least, s2 / window - (s1 / window) ** 2)
    return least


def cusum(x: np.ndarray, sigma: float = 1.0, h: float = 3.0, window: int = 12, floor: float | None = None) -> np.ndarray:
    """Segment ids from 0: a two-sided cumulative sum of log-likelihood ratios; an alarm at i starts a segment at i.

    ``floor``: the least deviation, by default that of the quietest window. A signal whose deviation is 0 throughout
    has one segment up to the first change.
    """
    out = np.zeros(len(x), np.int32)
    if not len(x):
        return out
    floor = min_window_std(x, window) if floor is None else floor
    m1, m2, n, gp, gn, seg = float(x[0]), 0.0, 1, 0.0, 0.0, 0
    for i in range(1, len(x)):
        v = float(x[i])
        n += 1
        d = v - m1
        m1 += d / n
        m2 += d * (v - m1)
        sd = max(floor, (m2 / n) ** 0.5)
        if sd > 0:
            gp = max(0.0, gp + sigma / sd * (v - m1 - sigma * sd / 2))
            gn = max(0.0, gn - sigma / sd * (v - m1 + sigma * sd / 2))
        if gp >= h or gn >= h:
            seg += 1
            m1, m2, n, gp, gn = v, 0.0, 1, 0.0, 0.0
        out[i] = seg
    return out


def cusum_many(signals: list[np.ndarray], sigma: float = 1.0, h: float = 3.0, window: int = 12) -> list[np.ndarray]:
    """``cusum`` of each signal: a step takes the samples at one place of all signals that are so long."""
    if len(signals) < 16:
        return [cusum(x, sigma, h, window) for x in signals]
    order = sorted(range(len(signals)), key=lambda i: -len(signals[i]))
    size = np.array([len(signals[i]) for i in order])
    floor = np.array([min_window_std(signals[i], window) for i in order])
    first = np.cumsum(size) - size
    flat = np.concatenate([np.zeros(0), *(signals[i] for i in order)])
    out = np.zeros(len(flat), np.int32)
    there = int(np.count_nonzero(size))
    m1, m2, n, gp, gn, seg = flat[first[:there]].copy(), np.zeros(there), np.ones(there), np.zeros(there), np.zeros(there), np.zeros(there, np.int32)
    alive = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # signals longer than each place
    for t in range(1, len(alive)):
        k = int(alive[t])
        v, a1, a2 = flat[first[:k] + t], m1[:k], m2[:k]
        n[:k] += 1
        d = v - a1
        a1 += d / n[:k]
        a2 += d * (v - a1)
        sd = np.maximum(floor[:k], np.sqrt(a2 / n[:k]))
        ok = sd > 0
        unit = np.where(ok, sd, 1.0)
        gp[:k] = np.where(ok, np.maximum(0.0, gp[:k] + sigma / unit * (v - a1 - sigma * sd / 2)), gp[:k])
        gn[:k] = np.where(ok, np.maximum(0.0, gn[:k] - sigma / unit * (v - a1 + sigma * sd / 2)), gn[:k])
        alarm = np.flatnonzero((gp[:k] >= h) | (gn[:k] >= h))
        seg[alarm] += 1
        m1[alarm], m2[alarm], n[alarm], gp[alarm], gn[alarm] = v[alarm], 0.0, 1, 0.0, 0.0
        out[first[:k] + t] = seg[:k]
    parts: list[np.ndarray] = [out[:0]] * len(signals)
    for i, a, b in zip(order, first.tolist(), size.tolist()):
        parts[i] = out[a : a + b]
    return parts


def dwell_cost(length: np.ndarray, mean: float, var: float) -> np.ndarray:
    """Minus the log density of an inverse Gaussian dwell of this mean and variance."""
    lam = mean**3 / var
    length = np.asarray(length, float)
    return 0.5 * np.log(2 * np.pi * length**3 / lam) + lam * (length - mean) ** 2 / (2 * mean**2 * length)


def _path(previous: list[int], n: int) -> np.ndarray:
    ends, at = [], n
    while at > 0:
        ends.append(at)
        at = previous[at]
    out = np.zeros(n, np.int32)
    for k, end in enumerate(reversed(ends[1:])):
        out[end:] = k + 1
    return out


def pelt(x: np.ndarray, dwell_mean: float, dwell_var: float, max_run: int, prune: str = "none", minvar: str = "exact") -> np.ndarray:
    """Segment ids of the cheapest segmentation: Gaussian cost and an inverse Gaussian prior on lengths up to ``max_run``.

    ``prune="none"`` is the exact optimum. ``prune="reference"`` drops a start once its cost and the cheapest cost of
    a segment of its length are not below the best end, which is fast and not always optimal.
    ``minvar="reference"`` takes the least variance from the running update of ``min_window_variance(compat=True)``.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int32)
    s1, s2 = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    least = max(min_window_variance(x, 6, minvar == "reference"), 1e-12)
    dwell = np.concatenate([[np.inf], dwell_cost(np.arange(1, max_run + 1), dwell_mean, dwell_var)])
    best, previous = np.full(n + 1, np.inf), [0] * (n + 1)
    best[0] = 0.0
    starts = np.array([0])
    for j in range(1, n + 1):
        i = starts[j - starts <= max_run]
        length = j - i
        mean = (s1[j] - s1[i]) / length
        var = np.maximum((s2[j] - s2[i]) / length - mean * mean, least)
        cost = best[i] + 0.5 * length * (_LN2PI + np.log(var) + 1) + dwell[length]
        k = int(np.argmin(cost))
        best[j], previous[j] = cost[k], int(i[k])
        if prune == "reference":
            bound = best[i] + 0.5 * length * (_LN2PI + np.log(least) + 1) + dwell[length]
            i = i[(j - i < max_run) & (bound < best[j])]
        starts = np.append(i, j)
    return _path(previous, n)


class PeltBlock:
    """A block of a signal's cuts, ``s`` < cut <= ``s + length``, for ``pelt`` by parts: the cheapest ways through it.

    ``x``: the block's samples after up to ``max_run`` - 1 or five of those before it, whichever are more. As no run is
    longer than ``max_run``, a way through depends on what is before by its last cut alone, one of the ``max_run`` places up to s,
    and hands on the same to the next block: the block is a matrix of costs between them.
    """

    def __init__(self, x: np.ndarray, length: int, dwell_mean: float, dwell_var: float, max_run: int, least: float):
        self.x, self.s, self.e, self.run, self.least = x, len(x) - length, len(x), max_run, least
        self.s1, self.s2 = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
        self.dwell = np.concatenate([[np.inf], dwell_cost(np.arange(1, max_run + 1), dwell_mean, dwell_var)])

    def _cost(self, i: np.ndarray, j: int) -> np.ndarray:
        length = j - i
        mean = (self.s1[j] - self.s1[i]) / length
        var = np.maximum((self.s2[j] - self.s2[i]) / length - mean * mean, self.least)
        return 0.5 * length * (_LN2PI + np.log(var) + 1) + self.dwell[length]

    def ways(self, first: bool = False, final: bool = False) -> np.ndarray:
        """(max_run, max_run): the least cost from the last cut k places before s to the last cut l places before the block's end; infinite where there is none.

        ``first``: the row k = 0 alone, ``final``: the column l = 0 alone.
        """
        n, run = self.e - self.s, self.run
        best = np.full((1 if first else run, n + 1), np.inf)  # column j: a cut at s + j, of which j = 0 is no new one
        for j in range(1, n + 1):
            end = self.s + j
            lo = max(1, j - run)
            if lo < j:
                best[:, j] = (best[:, lo:j] + self._cost(np.arange(self.s + lo, end), end)).min(axis=1)
            k = np.arange(0, min(self.s, run - j, len(best) - 1) + 1) if j <= run else np.zeros(0, int)  # runs that began before s
            if len(k):
                best[k, j] = np.minimum(best[k, j], self._cost(self.s - k, end))
        if final:
            return best[:, n:].copy()
        out = np.full((len(best), run), np.inf)
        last = min(run, n)
        out[:, :last] = best[:, n : n - last : -1]
        return out

    def trace(self, k: int, before: int) -> list[tuple[int, int]]:
        """(start, length) of the cheapest way's runs, from a cut ``k`` places before s to one ``before`` places before the end; starts count from s."""
        n = self.e - self.s - before
        best, previous = {-k: 0.0}, {}
        for j in range(1, n + 1):
            i = np.array([c for c in (-k, *range(max(1, j - self.run), j)) if j - c <= self.run and c in best], int)
            if len(i):
                cost = np.array([best[c] for c in i.tolist()]) + self._cost(self.s + i, self.s + j)
                at = int(np.argmin(cost))
                best[j], previous[j] = float(cost[at]), int(i[at])
        runs, j = [], n
        while j != -k:
            runs.append((previous[j], j - previous[j]))
            j = previous[j]
        return runs[::-1]


def jarque_bera(s: tuple[np.ndarray, ...], i: np.ndarray, j: int) -> np.ndarray:
    """|n/6 (skewness^2 + excess kurtosis^2 / 4)| of x[i:j] from prefix sums of its powers."""
    n = j - i
    m1, r2, r3, r4 = ((c[j] - c[i]) / n for c in s)
    m2 = r2 - m1**2
    m3 = r3 - 3 * m1 * r2 + 2 * m1**3
    m4 = r4 - 4 * m1 * r3 + 6 * m1**2 * r2 - 3 * m1**4
    ok = m2 > 1e-12
    m2 = np.where(ok, m2, 1.0)
    return np.where(ok, np.abs(n / 6 * (m3**2 / m2**3 + (m4 / m2**2 - 3) ** 2 / 4)), 0.0)


def power_sums(x: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([[0.0], np.cumsum(x**k)]) for k in (1, 2, 3, 4))


def jb_segments(x: np.ndarray, penalty: float = 0.9, least: int = 4) -> np.ndarray:
    """Segment ids of the segmentation with the smallest sum of Jarque-Bera statistics and penalties, no segment under ``least`` samples."""
    n = len(x)
    sd = x.std() if n else 0.0
    if n < 2 * least or sd == 0:
        return np.zeros(n, np.int32)
    s = power_sums((x - x.mean()) / sd)
    best, previous = np.full(n + 1, np.inf), [0] * (n + 1)
    best[0] = -penalty
    for j in range(least, n + 1):
        i = np.arange(0, j - least + 1)
        i = i[np.isfinite(best[i])]
        cost = best[i] + jarque_bera(s, i, j) + penalty
        k = int(np.argmin(cost))
        best[j], previous[j] = cost[k], int(i[k])
    return _path(previous, n)


def hazard(most: int, mean: float, sigma: float) -> np.ndarray:
    """(ln h(r), ln(1 - h(r))) for run lengths r = 1 .. most - 1 of an inverse Gaussian dwell: h is the density over what is left."""
    r = np.arange(1, most)
    logp = -dwell_cost(r, mean, sigma**2)
    left = np.logaddexp.accumulate(logp[::-1])[::-1]
    h = np.minimum(logp - left, -1e-12)
    return np.stack([h, np.log(-np.expm1(h))], axis=1)


def beam_changes(x: np.ndarray, states: np.ndarray, beam: int, table: np.ndarray) -> np.ndarray:
    """State ids of a beam search over semi-Markov paths: states are rows (mean, var), costs are squared distances and minus log hazards."""
    n, k = len(x), len(states)
    if not n:
        return np.zeros(0, np.int32)
    mean, var = states[:, 0], states[:, 1]
    stay, move = -table[:, 1], -table[:, 0]
    fit = (x[0] - mean) ** 2 / var
    front = [(fit[s], s, 1, -1) for s in range(k)]
    trail = [front]
    for t in range(1, n):
        kept = sorted(range(len(front)), key=lambda i: (front[i][0], front[i][1], front[i][2]))[:beam]
        fit, new = (x[t] - mean) ** 2 / var, {}
        for i in kept:
            cost, s, run, _ = front[i]
            r = min(run, len(stay)) - 1
            options = [(s, run + 1, cost + fit[s] + stay[r])] + [(o, 1, cost + fit[o] + move[r]) for o in range(k) if o != s]
            for o, length, c in options:
                if (o, length) not in new or c < new[o, length][0]:
                    new[o, length] = (c, o, length, i)
        front = list(new.values())
        trail.append(front)
    i = min(range(len(front)), key=lambda i: front[i][:3])
    out = np.zeros(n, np.int32)
    for t in range(n - 1, -1, -1):
        out[t], i = trail[t][i][1], trail[t][i][3]
    return out


def bocpd(x: np.ndarray, rate: float = 0.01, most: int = 200, prior: tuple[float, float, float, float] | None = None, table: np.ndarray | None = None, window: int | None = None) -> np.ndarray:
    """Segment ids by Bayesian online change-point detection: Normal-inverse-gamma model, run lengths up to ``most``.

    ``table``: a row (ln h, ln(1 - h)) for each run length from 1, the last one for all longer, as ``hazard`` makes it;
    without it the hazard is ``rate`` throughout. ``window``: the prior of a run is the mean and variance of that many
    samples from its start (near the end, of the last so many); without it, of the whole signal.
    """
    return bocpd_many([x], rate, most, prior, table, window)[0]


def bocpd_many(signals: list[np.ndarray], rate: float = 0.01, most: int = 200, prior: tuple[float, float, float, float] | None = None, table: np.ndarray | None = None, window: int | None = None) -> list[np.ndarray]:
    """``bocpd`` of each signal; those of like length are stepped together, up to 256 of them and four million samples."""
    steps = np.array([[np.log(rate), np.log1p(-rate)]]) if table is None else np.asarray(table, float)
    out = [np.zeros(len(x), np.int32) for x in signals]
    order = sorted((i for i in range(len(signals)) if len(signals[i])), key=lambda i: -len(signals[i]))
    while order:
        some = order[: max(1, min(256, (1 << 22) // len(signals[order[0]])))]
        del order[: len(some)]
        for i, arg in zip(some, _bocpd_together([np.asarray(signals[i], float) for i in some], most, prior, steps, window)):
            at = len(arg) - 1
            while at >= 0:
                start = max(0, at - int(arg[at]) + 1)
                out[i][start] = start > 0
                at = start - 1
            np.cumsum(out[i], out=out[i])
    return out


def _run_priors(x: np.ndarray, prior: tuple[float, float, float, float] | None, window: int | None) -> tuple[np.ndarray | float, np.ndarray | float]:
    """Mean and scale of a run that begins at each sample and at the end, or one of each for all."""
    if prior:
        return prior[0], prior[3]
    if not window:
        return float(x.mean()), max(float(x.var()), 1e-6)
    view = np.lib.stride_tricks.sliding_window_view(x, min(window, len(x)))
    at = np.minimum(np.arange(len(x) + 1), len(view) - 1)
    return view.mean(axis=1)[at], np.maximum(view.var(axis=1), 1e-6)[at]


def _bocpd_together(signals: list[np.ndarray], most: int, prior: tuple[float, float, float, float] | None, steps: np.ndarray, window: int | None) -> list[np.ndarray]:
    """The likeliest run length at each sample of signals, the longest first: a row a signal, a column a run length.

    Kappa, alpha and what follows from them depend on the run length alone and are made once.
    """
    from math import lgamma

    size, kappa0, alpha0 = np.array([len(x) for x in signals]), prior[1] if prior else 0.1, prior[2] if prior else 1.0
    width = min(most, int(size[0])) + 1
    kappa, alpha = kappa0 + np.arange(width), alpha0 + 0.5 * np.arange(width)
    nu = 2 * alpha
    lg = np.array([lgamma((a + 1) / 2) - lgamma(a / 2) for a in nu]) - 0.5 * np.log(nu * np.pi)
    widen, power, keep = (kappa + 1) / (alpha * kappa), (nu + 1) / 2, steps[np.minimum(np.arange(width), len(steps) - 1)]  # with a sample a run is one longer than before
    xs, mu0, beta0 = np.zeros((size[0], len(signals))), np.zeros((size[0] + 1, len(signals))), np.ones((size[0] + 1, len(signals)))
    for i, x in enumerate(signals):
        xs[: len(x), i] = x
        mu0[: len(x) + 1, i], beta0[: len(x) + 1, i] = _run_priors(x, prior, window)
    mu, beta, logr = np.zeros((len(signals), width)), np.ones((len(signals), width)), np.full((len(signals), width), -np.inf)
    mu[:, 0], beta[:, 0], logr[:, 0] = mu0[0], beta0[0], 0.0
    arg = np.ones((size[0], len(signals)), np.int32)
    for t in range(int(size[0])):
        live, n = int(np.searchsorted(-size, -t)), min(t + 1, width)  # those with a sample t, and the run lengths they may have
        v, m, b = xs[t, :live, None], mu[:live, :n], beta[:live, :n]
        scale, gap = b * widen[:n], (v - m) ** 2
        w = logr[:live, :n] + (lg[:n] - 0.5 * np.log(scale) - power[:n] * np.log1p(gap / (nu[:n] * scale)))
        ends = w + keep[:n, 0]
        top = ends.max(axis=1)
        k = min(n, width - 1)
        r = logr[:live, : k + 1]
        r[:, 1:] = (w + keep[:n, 1])[:, :k]
        r[:, 0] = top + np.log(np.exp(ends - top[:, None]).sum(axis=1))
        top = r.max(axis=1)
        r -= (top + np.log(np.exp(r - top[:, None]).sum(axis=1)))[:, None]
        grown_mu, grown_beta = (kappa[:n] * m + v) / (kappa[:n] + 1), b + kappa[:n] * gap / (2 * (kappa[:n] + 1))
        mu[:live, 1 : k + 1], beta[:live, 1 : k + 1] = grown_mu[:, :k], grown_beta[:, :k]
        mu[:live, 0], beta[:live, 0] = mu0[t + 1, :live], beta0[t + 1, :live]
        if k:
            arg[t, :live] = r[:, 1:].argmax(axis=1) + 1
    return [arg[:n, i] for i, n in enumerate(size.tolist())]


# Points of chi-square with 1 degree of freedom that a share p of it is below, and with 2 that it is above.
_LEVELS = (0.005, 0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99, 0.995)
_CHI1 = (0.00004, 0.00016, 0.001, 0.004, 0.016, 2.706, 3.841, 5.024, 6.635, 7.879)
_CHI2 = (10.597, 9.210, 7.378, 5.991, 4.605, 0.211, 0.103, 0.051, 0.02, 0.01)


def two_window(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Z squared between the windows that end and begin at each sample, and the Jarque-Bera statistic of the second, for w <= i < n - w."""
    n = len(x)
    i = np.arange(w, n - w)
    v = np.lib.stride_tricks.sliding_window_view(x, w)
    a, b = v[i - w + 1], v[i + 1]
    spread = (a.var(axis=1) + b.var(axis=1)) * w / (w * (w - 1))
    z2 = np.where(spread > 0, (a.mean(axis=1) - b.mean(axis=1)) ** 2 / np.where(spread > 0, spread, 1), 0.0)
    c = b - b.mean(axis=1, keepdims=True)
    m2 = (c**2).mean(axis=1)
    safe = np.where(m2 > 1e-12, m2, 1)
    jb = np.where(m2 > 1e-12, w / 6 * ((c**3).mean(axis=1) ** 2 / safe**3 + ((c**4).mean(axis=1) / safe**2 - 3) ** 2 / 4), 0.0)
    return z2, jb


def two_window_segments(x: np.ndarray, p: float = 0.9, w: int = 10) -> np.ndarray:
    """Segment ids: a change opens where Z squared passes its threshold and is placed at the largest until the second window looks normal, or the windows end; then w samples are skipped."""
    n = len(x)
    out = np.zeros(n, np.int32)
    if n <= 2 * w:
        return out
    z2, jb = two_window(x, w)
    th_z, th_jb = np.interp(p, _LEVELS, _CHI1), np.interp(p, _LEVELS, _CHI2)
    k, opened, top = 0, False, -1
    while k < len(z2):
        if not opened and z2[k] < th_z:
            k += 1
            continue
        if not opened:
            opened, top = True, k
        if jb[k] <= th_jb:
            out[top + w :] += 1
            opened = False
            k += w
        else:
            top = k if z2[k] > z2[top] else top
            k += 1
    if opened:
        out[top + w :] += 1
    return out


def dtw(a: np.ndarray, b: np.ndarray, block: int | None = None) -> tuple[float, list[tuple[int, int]]]:
    """``dtw_path`` with the path as pairs."""
    dist, path = dtw_path(a, b, block)
    return dist, list(zip(*path.T.tolist()))


def dtw_path(a: np.ndarray, b: np.ndarray, block: int | None = None) -> tuple[float, np.ndarray]:
    """(distance, warping path from the start): squared local costs, ties diagonal first, then up, then left. Rows are points.

    Costs are computed by anti-diagonals, which depend on the two before only. Two of every ``block`` (the square root of
    their number) are kept; the path goes back through one block after the other, whose steps are computed again as a byte a cell.
    """
    a, b = (np.asarray(v, float).reshape(len(v), -1 if len(v) else 1) for v in (a, b))
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, np.zeros((0, 2), np.int32)
    block = block or max(64, isqrt(n + m))

    def run(lo: int, hi: int, before: np.ndarray, last: np.ndarray, steps: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Anti-diagonals lo .. hi - 1 from the two before; a cell (i, d - i) stands at i. ``steps`` takes 0 diagonal, 1 up, 2 left."""
        for d in range(lo, hi):
            i0, i1 = max(1, d - m), min(n, d - 1)
            here = np.full(n + 1, np.inf)
            if i0 <= i1:
                diag, up, left = before[i0 - 1 : i1], last[i0 - 1 : i1], last[i0 : i1 + 1]
                gap = a[i0 - 1 : i1] - b[d - i1 - 1 : d - i0][::-1]
                local = gap[:, 0] * gap[:, 0] if gap.shape[1] == 1 else (gap * gap).sum(axis=1)
                side = np.minimum(up, left)
                here[i0 : i1 + 1] = local + np.minimum(diag, side)
                if steps is not None:
                    steps[d - lo, i0 : i1 + 1] = np.where(diag <= side, 0, np.where(up <= left, 1, 2))
            before, last = last, here
        return before, last

    none = np.full(n + 1, np.inf)
    start = none.copy()
    start[0] = 0.0
    kept, now = [], (start, none)  # anti-diagonals 0 and 1
    for lo in range(2, n + m + 1, block):
        kept.append((lo, *now))
        now = run(lo, min(lo + block, n + m + 1), *now, None)
    path, at, i, j = np.empty((n + m, 2), np.int32), n + m, n, m
    for lo, before, last in reversed(kept):
        steps = np.zeros((min(block, n + m + 1 - lo), n + 1), np.uint8)
        run(lo, lo + len(steps), before, last, steps)
        while i and j and i + j >= lo:
            at -= 1
            path[at] = i - 1, j - 1
            step = steps[i + j - lo, i]
            i, j = i - (step != 2), j - (step != 1)
    return float(now[1][n]), path[at:]


def run_ids(mv: np.ndarray) -> np.ndarray:
    """Run numbers from 0: a new run where the value changes."""
    mv = np.asarray(mv)
    return np.concatenate([[0], np.cumsum(mv[1:] != mv[:-1])]).astype(np.int32) if len(mv) else np.zeros(0, np.int32)


def aggregate_segments(mv: np.ndarray, most: int) -> np.ndarray:
    """Runs numbered from 0; while there are more than ``most``, the shortest (first of equals) joins its shorter neighbour (left of equals)."""
    runs = run_ids(mv)
    if not len(runs) or runs[-1] + 1 <= most:
        return runs
    size = np.bincount(runs).tolist()
    count = len(size)
    owner, left, right = list(range(count)), list(range(-1, count - 1)), [*range(1, count), -1]
    heap = [(s, i) for i, s in enumerate(size)]
    heapq.heapify(heap)
    alive = [True] * count
    n = count
    while n > max(most, 1):
        s, i = heapq.heappop(heap)
        if not alive[i] or s != size[i]:
            continue
        lo, hi = left[i], right[i]
        into = lo if hi < 0 or (lo >= 0 and size[lo] <= size[hi]) else hi
        a, b = (into, i) if into < i else (i, into)  # b joins a, which is to its left
        size[a] += size[b]
        alive[b], owner[b] = False, a
        right[a] = right[b]
        if right[b] >= 0:
            left[right[b]] = a
        heapq.heappush(heap, (size[a], a))
        n -= 1
    root, number = [], -1
    for i in range(count):
        if alive[i]:
            number += 1
        root.append(number)
    return np.array(root, np.int32)[runs]
