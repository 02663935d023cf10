import json
import tracemalloc

import numpy as np
import pytest

from amploom.functions.kernels import aggregate_segments
from amploom.operators import families as FA
from amploom.operators import hmm as H
from amploom.operators import lattice as L
from amploom.sources.models import dump_model, parse_model


def model_of(rng, positions=6, shared=True, labels=("1", "2")):
    """States at places in a row, some with an emission that another has; one label's own states and those of all."""
    nodes, links = [], []
    for p in range(positions):
        for label in ("*", *labels[: rng.integers(0, 3)]) if p else ("*", *labels):
            nodes.append({"id": len(nodes), "seq_id": p, "kmer": "ACGT"[p % (2 if shared else 4)], "label": label})
    for a in nodes:
        for b in nodes:
            if b["seq_id"] - a["seq_id"] in (0, 1) and rng.random() < 0.8 or a is b:
                links.append({"source": a["id"], "target": b["id"], "prob": float(rng.random())})
    emission = {f"{n['kmer']}_{n['label']}": {"peak": 2, "dim": 1, "params": [0.3, float(rng.normal()), 1.0, 0.7, float(rng.normal()), 2.0]} for n in nodes}
    return parse_model(json.dumps({"nodes": nodes, "links": links, "emission": emission}))


def plain(model, x, chrom, mv, width):
    """Expected counts of one read: dense matrices over all states, a band is a mask, nothing is kept for later."""
    positions = model.positions(chrom)
    seg, n, s = aggregate_segments(mv, len(positions)), len(x), model.states
    mask = np.full((n, s), -np.inf)
    for t, j in enumerate(seg):
        for p in range(max(0, j - width), min(len(positions), j + width + 1)):
            mask[t, positions[p]] = 0
    emit = np.stack([model.emissions[k].log_density(x) for k in model.key], axis=1) + mask
    move = np.full((s, s), -np.inf)
    move[model.edges[:, 0], model.edges[:, 1]] = model.logp
    lse = lambda v, axis: np.logaddexp.reduce(v, axis=axis)
    a, b = np.empty((n, s)), np.zeros((n, s))
    with np.errstate(invalid="ignore"):
        a[0] = model.logpi + emit[0]
        for t in range(1, n):
            a[t] = lse(a[t - 1][:, None] + move, 0) + emit[t]
        for t in range(n - 2, -1, -1):
            b[t] = lse(move + (emit[t + 1] + b[t + 1])[None], 1)
    ll = lse(a[-1], 0)
    if not np.isfinite(ll):
        return None
    gamma = np.exp(a + b - ll)
    out = {("score", "", 0, 0, 0): ll / n, ("loglik", "", 0, 0, 0): ll, ("reads", "", 0, 0, 0): 1.0}
    for k in set(model.key):
        w = gamma[:, [i for i, key in enumerate(model.key) if key == k]].sum(axis=1)
        out |= {(kind, k, *at): v for (kind, *at), v in model.emissions[k].sums(x, w).items()}
    for i, j in model.edges.tolist():
        out["xi", "", 0, i, j] = sum(np.exp(a[t, i] + move[i, j] + emit[t + 1, j] + b[t + 1, j] - ll) for t in range(n - 1))
    return out | {("pi", "", 0, i, 0): gamma[0, i] for i in range(s)}


def reads_of(rng, many=14):
    out = []
    for i in range(many):
        n = int(rng.integers(1, 40))
        out.append((rng.normal(0, 1.5, (n, 1)), str(1 + i % 2), np.sort(rng.integers(0, 6, n)) if i % 3 else rng.integers(0, 3, n)))
    return out


@pytest.mark.parametrize("block,entries", [(512, 6_000_000), (3, 6_000_000), (4, 200), (1, 1)])
def test_expected_counts_are_those_of_each_read(monkeypatch, block, entries):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "ENTRIES", entries)
    rng = np.random.default_rng(4)
    for _ in range(4):
        model, reads = model_of(rng), reads_of(rng)
        for width in (0, 1, 20):
            lattice = L.Lattice(model, width)
            got, lost = L.expected_counts(lattice, [r[0] for r in reads], [lattice.walk(c, mv, len(x)) for x, c, mv in reads])
            want, none = {}, 0
            for x, c, mv in reads:
                one = plain(model, x, c, mv, width)
                none += one is None
                for k, v in (one or {}).items():
                    want[k] = want.get(k, 0.0) + v
            assert lost == none
            for k in set(got) | set(want):
                assert got.get(k, 0.0) == pytest.approx(want.get(k, 0.0), rel=1e-7, abs=1e-7), k


def test_unknown_labels_and_reads_without_a_path_are_dropped(spark):
    model = model_of(np.random.default_rng(1))
    rows = [(0, "1", [0.1, 0.2], [0, 1]), (1, "9", [0.1, 0.2], [0, 1]), (2, "2", [], []), (3, "2", [0.4], [0])]
    df = spark.createDataFrame(rows, "read_index long, chrom string, signal array<double>, mv array<int>")
    stats = H.by_key(H.e_step(df, model, 3))
    assert (stats["reads", "", 0, 0, 0], stats["dropped", "", 0, 0, 0]) == (2.0, 2.0)


def best_by_table(model, x):
    n, s = len(x), model.states
    emit = np.stack([model.emissions[k].log_density(x) for k in model.key], axis=1)
    move = np.full((s, s), -np.inf)
    move[model.edges[:, 0], model.edges[:, 1]] = model.logp
    d, back = emit[0] + model.logpi, []
    for t in range(1, n):
        v = d[:, None] + move
        back.append(v.argmax(axis=0))
        d = v.max(axis=0) + emit[t]
    path = [int(d.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return float(d.max()), path[::-1]


@pytest.mark.parametrize("block,entries", [(512, 6_000_000), (3, 6_000_000), (5, 300), (1, 1)])
def test_best_paths_and_likelihoods_are_those_of_each_read(monkeypatch, block, entries):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "ENTRIES", entries)
    rng = np.random.default_rng(9)
    model = model_of(rng)
    xs = [x for x, _, _ in reads_of(rng)] + [np.zeros((0, 1))]
    likely = H.forward_loglik(model, *xs)
    for x, (score, path), ll in zip(xs[:-1], L.best_paths(model, xs), likely):
        want = best_by_table(model, x)
        assert score == pytest.approx(want[0]) and path.tolist() == want[1]
        one = plain(model, x, "1", np.zeros(len(x), int), 20) if len(model.bands) == 1 else None
        assert ll >= score - 1e-9 and (one is None or ll == pytest.approx(one["loglik", "", 0, 0, 0]))
    assert L.best_paths(model, xs)[-1][0] == 0.0 and likely[-1] == -np.inf


def test_a_read_without_a_path():
    model = model_of(np.random.default_rng(2))
    model.logpi = np.full(model.states, -np.inf)
    score, path = H.viterbi(model, np.zeros((4, 1)))
    assert score == -np.inf and path.tolist() == [0] * 4 and H.forward_loglik(model, np.zeros((4, 1)))[0] == -np.inf


def chain(states):
    nodes = [{"id": i, "seq_id": 0, "kmer": f"k{i}", "label": "*"} for i in range(states)]
    links = [{"source": i, "target": (i + d) % states, "prob": p} for i in range(states) for d, p in ((0, 0.8), (1, 0.2))]
    emission = {f"k{i}_*": {"peak": 1, "dim": 1, "params": [1.0, float(i % 7), 1.0]} for i in range(states)}
    return parse_model(json.dumps({"nodes": nodes, "links": links, "emission": emission}))


def test_memory_grows_with_the_square_root():
    """20,000 frames of 120 states: all values would be 19 MB in each direction, and sources 10 MB."""
    model, x = chain(120), np.random.default_rng(0).normal(3, 2, (20_000, 1))
    for work in (lambda: L.best_paths(model, [x]), lambda: L.expected_counts(lat := L.Lattice(model, None), [x], [lat.walk(None, None, len(x))])):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 9e6


@pytest.mark.parametrize("family", ["histogram", "gaussian"])
def test_families_train(spark, family):
    rng = np.random.default_rng(0)
    shape = {"histogram": {"low": [-3], "high": [12], "bins": [30]}, "gaussian": {"dim": 1}}[family]
    guess = {"A_*": 0.5, "C_*": 4.0, "G_*": 7.5}
    nodes = [{"id": i, "seq_id": i, "kmer": k[0], "label": "*"} for i, k in enumerate(guess)]
    links = [{"source": i, "target": j, "prob": p} for i, j, p in ((0, 0, 0.9), (0, 1, 0.1), (1, 1, 0.9), (1, 2, 0.1), (2, 2, 1.0))]
    grid = np.arange(-2.75, 12, 0.5)
    params = lambda m: (np.exp(-0.5 * (grid - m) ** 2) / np.exp(-0.5 * (grid - m) ** 2).sum()).tolist() if family == "histogram" else [m, 1.0]
    model = parse_model(json.dumps({"nodes": nodes, "links": links, "emission": {k: {"family": family, "params": params(m)} | shape for k, m in guess.items()}}))
    rows = []
    for i in range(12):
        runs = [int(n) for n in rng.integers(15, 30, 3)]
        rows.append((i, "", np.concatenate([rng.normal(m, 0.5, n) for m, n in zip((0, 5, 9), runs)]).tolist(), np.repeat([0, 1, 2], runs).tolist()))
    df = spark.createDataFrame(rows, "read_index long, chrom string, signal array<double>, mv array<int>")
    trained, history = H.train(df, model, 5, 2, "et", 10)
    scores = [h[1] for h in history]
    assert all(b >= a - 1e-3 for a, b in zip(scores, scores[1:])) and scores[-1] > scores[0] + 1
    again = parse_model(dump_model(trained))
    for k, want in zip(guess, (0, 5, 9)):
        mean = float((np.exp(again.emissions[k].of.logp) * grid).sum()) if family == "histogram" else float(again.emissions[k].of.mean[0])
        assert mean == pytest.approx(want, abs=0.3)


def test_sums_of_parts_add_up_and_equal_the_columns(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(90, 2)), rng.random(90)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, w)], "a double, b double, w double")
    for e in (FA.GaussianEmission(FA.Gaussian.standard(2)), FA.HistogramEmission(FA.Histogram((-1.0, -2.0), (1.0, 2.0), (3, 4)))):
        parts = {}
        for lo, hi in ((0, 20), (20, 21), (21, 90)):
            for k, v in e.sums(x[lo:hi], w[lo:hi]).items():
                parts[k] = parts.get(k, 0.0) + v
        new, want = e.updated(parts), e.of.update(df, "w", "a", "b")
        assert np.allclose(new.log_density(x), type(e)(want).log_density(x)) and e.updated({}) is e
