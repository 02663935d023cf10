import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amploom.functions import kernels as K
from amploom.functions.kmers import moves_band
from amploom.operators import hmm as H
from amploom.sources.models import Mixture, dump_model, parse_model
from amploom.plans.registry import TWO_STATES

SMALL = """{"note": "kept", "nodes":[{"id":0,"seq_id":0,"kmer":"AAA","label":"*"},{"id":1,"seq_id":0,"kmer":"AAC","label":"*"}],
 "links":[{"source":0,"target":0,"prob":0.7},{"source":0,"target":1,"prob":0.3},{"source":1,"target":0,"prob":0.4},{"source":1,"target":1,"prob":0.6}],
 "emission":{"AAA_*":{"peak":1,"dim":1,"params":[1.0,0.0,1.0]},"AAC_*":{"peak":1,"dim":1,"params":[1.0,3.0,1.0]}}}"""


def test_goldens():
    assert K.logsumexp(np.array([-1.0, -2.0, -3.0])) == pytest.approx(-0.592394036)
    assert K.dwell_cost([5, 15, 30], 15, 60) == pytest.approx([3.818192, 2.966111, 4.943332], abs=1e-6)
    x = np.array([1.0, 2.0, 4.0, 9.0])
    assert K.jarque_bera(K.power_sums(x), np.array([0]), 4)[0] == pytest.approx(0.560310, abs=1e-6)
    two = Mixture.unpack([0.25, -1, 1, 0.75, 1, 4], 2, 1)
    assert two.log_density(np.zeros((1, 1)))[0] == pytest.approx(-1.647569889)
    assert K.aggregate_segments([0, 0, 0, 1, 2, 2, 3, 3, 3, 3], 2).tolist() == [0] * 6 + [1] * 4
    assert K.aggregate_segments([5, 5, 7], 4).tolist() == [0, 0, 1]
    assert K.aggregate_segments([0, 1, 2, 3, 4], 2).tolist() == [0, 0, 1, 1, 1]
    assert K.cusum(np.array([1.0, 2.0] * 8 + [11.0, 12.0] * 8)).tolist() == [0] * 16 + [1] * 16
    assert K.dtw(np.array([1.0, 2, 3]), np.array([1.0, 1, 3]))[0] == 1
    assert moves_band(np.array([0, 0, 1, 1]), 4, 2) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 2), (2, 3), (3, 2), (3, 3)]


def test_empty_and_constant_signals():
    for f in (K.cusum, K.bocpd, K.jb_segments, K.two_window_segments, lambda x: K.pelt(x, 15, 60, 60)):
        assert len(f(np.zeros(0))) == 0
        assert len(f(np.ones(40))) == 40
    assert K.cusum(np.ones(40)).max() == 0


def test_forward_and_viterbi_by_enumeration():
    m = parse_model(SMALL)
    m.logpi = np.log([0.6, 0.4])
    x = np.array([0.0, 1, 3, 2]).reshape(-1, 1)
    a = np.log([[0.7, 0.3], [0.4, 0.6]])
    e = np.stack([m.emissions[k].log_density(x) for k in m.key], axis=1)
    paths = {p: m.logpi[p[0]] + sum(e[t, s] for t, s in enumerate(p)) + sum(a[i, j] for i, j in zip(p, p[1:])) for p in itertools.product(range(2), repeat=4)}
    score, path = H.viterbi(m, x)
    assert tuple(path) == max(paths, key=paths.get) == (0, 0, 1, 1)
    assert score == pytest.approx(max(paths.values())) == pytest.approx(-7.258053129)
    assert H.forward_loglik(m, x)[0] == pytest.approx(K.logsumexp(np.array(list(paths.values())))) == pytest.approx(-6.923398327)


def test_pelt_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(5):
        x = rng.normal(size=9)
        s1, s2 = np.cumsum(np.append(0, x)), np.cumsum(np.append(0, x * x))
        least = max(K.min_window_variance(x, 6), 1e-12)

        def cost(cuts):
            total = 0.0
            for i, j in zip(cuts, cuts[1:]):
                n = j - i
                var = max((s2[j] - s2[i]) / n - ((s1[j] - s1[i]) / n) ** 2, least)
                total += 0.5 * n * (np.log(2 * np.pi * var) + 1) + K.dwell_cost(n, 3, 2)
            return total

        best = min(([0, *c, 9] for k in range(9) for c in itertools.combinations(range(1, 9), k)), key=cost)
        got = K.pelt(x, 3, 2, 9)
        assert cost([0, *(np.flatnonzero(np.diff(got)) + 1).tolist(), 9]) == pytest.approx(cost(best))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.lists(st.integers(0, 3), min_size=1, max_size=7))
def test_dtw_by_recursion(a, b):
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        here = (a[i] - b[j]) ** 2
        return here + (0 if i == j == 0 else min(d(p, q) for p, q in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p >= 0 and q >= 0))

    dist, path = K.dtw(np.array(a), np.array(b))
    assert dist == d(len(a) - 1, len(b) - 1)
    assert path[0] == (0, 0) and path[-1] == (len(a) - 1, len(b) - 1)


def _dtw_by_table(a, b):
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            cost[i + 1, j + 1] = ((a[i] - b[j]) ** 2).sum() + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    path, i, j = [], len(a), len(b)
    while i and j:
        path.append((i - 1, j - 1))
        diag, up, left = cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1]
        i, j = (i - 1, j - 1) if diag <= up and diag <= left else (i - 1, j) if up <= left else (i, j - 1)
    return cost[-1, -1], path[::-1]


@pytest.mark.parametrize("block", [None, 1, 2, 7])
def test_dtw_path_by_blocks(block):
    rng = np.random.default_rng(2)
    for n, m, d in ((1, 1, 1), (1, 9, 1), (8, 1, 2), (17, 23, 1), (30, 12, 3), (25, 25, 1)):
        a, b = rng.integers(0, 4, (n, d)).astype(float), rng.integers(0, 4, (m, d)).astype(float)
        dist, path = K.dtw(a, b, block)
        assert (dist, path) == (pytest.approx(_dtw_by_table(a, b)[0]), _dtw_by_table(a, b)[1])


def test_dtw_memory():
    """3,000 by 3,000 costs are 72 MB."""
    import tracemalloc

    x = np.cumsum(np.random.default_rng(0).normal(size=3000))
    tracemalloc.start()
    dist, path = K.dtw(x, x[::-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 and path[0] == (0, 0) and path[-1] == (2999, 2999) and dist == pytest.approx(sum((x[i] - x[::-1][j]) ** 2 for i, j in path))


def test_pelt_by_blocks_is_pelt(spark):
    from amploom.operators import reads as R

    rng = np.random.default_rng(4)
    signals = {k: np.repeat(rng.normal(0, 5, n // 9 + 1), 9)[:n] + rng.normal(0, 0.5, n) for k, n in enumerate((1, 3, 19, 20, 21, 60, 157, 160))}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)], "k long, pos long, x double").repartition(3)
    for run, block in ((6, 20), (20, 20), (3, 7)):
        got = {k: [] for k in signals}
        for r in R.pelt_by_blocks(df, "k", "x", 9.0, 30.0, run, block).collect():
            got[r.k].append((r.start, r.length))
        for k, x in signals.items():
            seg = K.pelt(x, 9.0, 30.0, run)
            assert sorted(got[k]) == [(int(np.flatnonzero(seg == i)[0]), int((seg == i).sum())) for i in range(seg[-1] + 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=30), st.integers(1, 6))
def test_aggregate_segments_by_scanning(mv, most):
    runs = [len(list(g)) for _, g in itertools.groupby(mv)]
    while len(runs) > most:
        i = runs.index(min(runs))
        j = i - 1 if i and (i == len(runs) - 1 or runs[i - 1] <= runs[i + 1]) else i + 1
        lo = min(i, j)
        runs[lo : lo + 2] = [runs[lo] + runs[lo + 1]]
    assert K.aggregate_segments(mv, most).tolist() == [k for k, n in enumerate(runs) for _ in range(n)]


def test_model_round_trip():
    import json

    m = parse_model(SMALL)
    doc = json.loads(dump_model(m))
    assert doc["note"] == "kept"
    assert doc["links"][1]["prob"] == pytest.approx(0.3)
    with pytest.raises(ValueError, match="without emission"):
        parse_model(SMALL.replace('"AAC_*"', '"AAG_*"'))
    assert parse_model(TWO_STATES).states == 2


def test_training_improves_and_recovers(spark):
    text = """{"nodes":[{"id":0,"seq_id":0,"kmer":"A","label":"*"},{"id":1,"seq_id":1,"kmer":"C","label":"*"},{"id":2,"seq_id":2,"kmer":"G","label":"*"}],
     "links":[{"source":0,"target":0,"prob":0.9},{"source":0,"target":1,"prob":0.1},{"source":1,"target":1,"prob":0.9},{"source":1,"target":2,"prob":0.1},{"source":2,"target":2,"prob":1.0}],
     "emission":{"A_*":{"peak":1,"dim":1,"params":[1,0.5,1]},"C_*":{"peak":1,"dim":1,"params":[1,4.0,1]},"G_*":{"peak":1,"dim":1,"params":[1,7.5,1]}}}"""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(12):
        runs = [int(n) for n in rng.integers(15, 30, 3)]
        x = np.concatenate([rng.normal(m, 0.5, n) for m, n in zip((0, 5, 9), runs)])
        rows.append((i, "", x.tolist(), np.repeat([0, 1, 2], runs).tolist()))
    df = spark.createDataFrame(rows, "read_index long, chrom string, signal array<double>, mv array<int>")
    model, history = H.train(df, parse_model(text), 5, 2, "et", 10)
    scores = [h[1] for h in history]
    assert all(b >= a - 1e-6 for a, b in zip(scores, scores[1:]))
    assert [float(model.emissions[k].mean[0, 0]) for k in ("A_*", "C_*", "G_*")] == pytest.approx([0, 5, 9], abs=0.2)
    one = H.e_step(df.coalesce(1), model, 2).orderBy("kind", "key", "comp", "i", "j").collect()
    many = H.e_step(df.repartition(8), model, 2).orderBy("kind", "key", "comp", "i", "j").collect()
    assert [r.val for r in one] == pytest.approx([r.val for r in many], rel=1e-9)


def test_cusum_many_is_cusum_of_each():
    rnd = np.random.default_rng(3)
    signals = [rnd.normal(rnd.integers(0, 3), 1, int(n)) + np.repeat(rnd.normal(0, 4, 9), 12)[: int(n)] for n in rnd.integers(0, 100, 60)] + [np.ones(40), np.zeros(0), np.repeat([1.0, 5.0], 15)]
    for x, got in zip(signals, K.cusum_many(signals)):
        assert got.tolist() == K.cusum(x).tolist()


def test_families(spark):
    from amploom.operators import families as FA

    rnd = np.random.default_rng(5)
    x, w = rnd.normal(size=(200, 2)) @ np.array([[2.0, 0.3], [0.0, 0.5]]) + [1.0, -2.0], rnd.random(200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, w)], "a double, b double, w double")
    g = FA.Gaussian.standard(2).update(df, "w", "a", "b")
    mean = (w[:, None] * x).sum(0) / w.sum()
    cov = (w[:, None, None] * (x - mean)[:, :, None] * (x - mean)[:, None, :]).sum(0) / (w.sum() - (w**2).sum() / w.sum())
    assert np.allclose(g.mean, mean) and np.allclose(g.factor @ g.factor.T, cov) and np.allclose(FA.Gaussian.unpack(g.pack(), 2).factor, g.factor)
    lp = [r.lp for r in df.select(g.log_density(F.col("a"), F.col("b")).alias("lp")).collect()]
    inv = np.linalg.inv(cov)
    want = [-0.5 * (v - mean) @ inv @ (v - mean) - np.log(2 * np.pi) - 0.5 * np.log(np.linalg.det(cov)) for v in x]
    assert np.allclose(lp, want)
    nothing = FA.Gaussian.standard(2).update(df.limit(0), "w", "a", "b")
    assert nothing.mean.tolist() == [0, 0] and nothing.factor.tolist() == [[1, 0], [0, 1]]
    h = FA.Histogram((-1.0, -3.0), (3.0, 0.0), (4, 3))
    counts, _, _ = np.histogram2d(np.clip(x[:, 0], -1, 2.999), np.clip(x[:, 1], -3, -1e-9), bins=[4, 3], range=[[-1, 3], [-3, 0]], weights=w)
    assert np.allclose(h.update(df, "w", "a", "b").pack(), counts.T.ravel() / w.sum(), atol=1e-12) and np.allclose(h.pack(), 1 / 12)


def test_functions_in_sql(spark):
    from amploom.operators.reads import register_functions

    register_functions(spark)
    got = spark.sql("select * from run_lengths(array(3, 3, 1, 1, 1, 3))").collect()
    assert [tuple(r) for r in got] == [(0, 3, 0, 2), (1, 1, 2, 3), (2, 3, 5, 1)]
    assert spark.sql("select aggregate_segments(array(1, 1, 2, 3, 3, 3), 2) as s").first().s == [0, 0, 0, 1, 1, 1]


def _online(x, table, prior, most):
    """ln P(run length | samples) after each sample, from every run's predictive density by its own samples."""
    from math import lgamma

    def density(t, r):  # of sample t after the r samples before it
        m0, k0, a0, b0 = prior(t - r)
        y = x[t - r : t]
        mean = y.mean() if r else 0.0
        k, a = k0 + r, a0 + r / 2
        m = (k0 * m0 + r * mean) / k
        b = b0 + 0.5 * ((y - mean) ** 2).sum() + k0 * r * (mean - m0) ** 2 / (2 * k)
        nu, scale = 2 * a, b * (k + 1) / (a * k)
        return lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(nu * np.pi * scale) - (nu + 1) / 2 * np.log1p((x[t] - m) ** 2 / (nu * scale))

    joint, found = {0: 0.0}, []
    for t in range(len(x)):
        new = {0: K.NEG}
        for r, p in joint.items():
            h, stay = table[min(r, len(table) - 1)]
            p += density(t, r)
            new[0] = np.logaddexp(new[0], p + h)
            if r + 1 <= most:
                new[r + 1] = p + stay
        total = K.logsumexp(np.array(list(new.values())))
        joint = {r: p - total for r, p in new.items()}
        found.append(joint)
    return found


@pytest.mark.parametrize("most,dwell,window", [(200, None, None), (200, (9.0, 4.0), 6), (7, (9.0, 4.0), None), (200, None, 50)])
def test_online_change_points_by_run(most, dwell, window):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1.0, n) for m, n in ((0, 11), (9, 14), (-4, 8), (3, 3))])
    n = len(x)
    table = K.hazard(40, *dwell) if dwell else np.array([[np.log(0.01), np.log(0.99)]])
    size = min(window or n, n)

    def prior(start):
        y = x[min(start, n - size) :][:size]
        return y.mean(), 0.1, 1.0, max(y.var(), 1e-6)

    end, cuts = n, []
    run = [max((r for r in p if r), key=p.get) for p in _online(x, table, prior, most)]
    while end > 0:
        end = max(0, end - run[end - 1])
        cuts.append(end)
    want = [sum(c <= i for c in cuts if c) for i in range(n)]
    assert K.bocpd(x, most=most, table=table if dwell else None, window=window).tolist() == want and (most < 10 or max(want) >= 1)


def test_kernels_in_sql_take_nulls(spark):
    from amploom.operators.reads import register_functions

    register_functions(spark)
    r = spark.sql(
        "select beam_changes(s, array(0D, 9D), array(1D, 1D)) as beam, dtw(s, s).dist as dist, size(dtw(s, s).path) as steps, moves_band(m, 4, 2) as near"
        " from values (array(0D, 0D, 9D), array(0, 0, 1, 1)) v(s, m)"
    ).first()
    table = K.hazard(60, 15.0, 8.0)
    assert r.beam == K.beam_changes(np.array([0.0, 0.0, 9.0]), np.array([[0.0, 1.0], [9.0, 1.0]]), 16, table).tolist()
    assert (r.dist, r.steps) == (0.0, 3) and [tuple(p) for p in r.near] == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 2), (2, 3), (3, 2), (3, 3)]
    assert spark.sql("select beam_changes(n, array(0D), array(1D)) as a, dtw(n, n).dist as d, moves_band(m, 4, 2) as b from values (cast(null as array<double>), cast(null as array<int>)) v(n, m)").first() == (None, None, None)


def test_median_by_counting(spark):
    """Medians by counting and by sorting are the same, on hot keys, ties, extreme ranges, infinities, NaN and NULL."""
    from amploom.functions.windows import median_by, robust_zscore

    rng = np.random.default_rng(11)
    inf, nan = float("inf"), float("nan")
    keys = {
        "plain": rng.normal(size=3001).tolist(),
        "even": rng.normal(size=800).tolist(),
        "ties": [1.0] * 500 + [2.0] * 500,
        "one": [7.5] * 300,
        "scales": (10.0 ** rng.uniform(-300, 300, 1500) * rng.choice([-1, 1], 1500)).tolist(),
        "ends": [-1.7e308, 1.7e308] * 100 + [0.25],
        "tiny": (np.arange(400) * 5e-324).tolist(),
        "special": [inf] * 90 + [-inf] * 60 + [nan] * 20 + rng.normal(size=31).tolist() + [None] * 9,
        "none": [None] * 50,
        "infinite": [inf] * 120,
        "few": [3.0, 1.0],
    }
    rows = [(k, i, x) for k, xs in keys.items() for i, x in enumerate(xs)] + [(None, 0, 1.0)]
    s = spark.createDataFrame(rows, "key string, pos long, x double").repartition(5)
    want = {r.key: r.m for r in s.where("key is not null").groupBy("key").agg({"x": "median"}).toDF("key", "m").collect()}
    for most in (10, 100000):
        got = {r.key: r.med for r in median_by(s, "key", most=most).collect()}
        assert set(got) == set(want) and all(repr(got[k]) == repr(want[k]) for k in want if k != "ends"), {k: (got[k], want[k]) for k in want}
        assert got["ends"] == 0.25
    assert median_by(s.limit(0), "key").collect() == []
    part = s.where("key in ('plain', 'even', 'few')")
    assert sorted(map(tuple, robust_zscore(part, "key", most=50).collect())) == sorted(map(tuple, robust_zscore(part, "key").collect()))


def test_table_functions_and_parameters_in_sql(spark):
    """SQL's k-mers and bands are those of the column expressions, with nulls, empty and short sequences; kernels take parameters."""
    from pyspark.sql import functions as F

    from amploom.functions import kmers as KM
    from amploom.operators.reads import register_functions

    register_functions(spark)
    v = spark.createDataFrame([(1, "ACGTTGCA", 25), (2, "AC", 9), (3, "", 5), (4, None, 7), (5, "nnACGt", None), (6, "GGATTACA", 6)], "id int, q string, n long")
    v.createOrReplaceTempView("seqs")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.sql("select id, pos, code from seqs, lateral kmers(q, 3)")) == rows(v.select("id", F.posexplode(KM.kmer_codes(F.col("q"), 3))))
    assert rows(spark.sql("select id, t, position from seqs, lateral uniform_band(n, 6, 3)")) == rows(v.select("id", F.inline(KM.uniform_band(F.col("n"), 6, 3))))
    assert rows(spark.sql("select id, t, code from seqs, lateral coarse_band(q, n, 3, 4)")) == rows(v.select("id", F.inline(KM.coarse_band(F.col("q"), F.col("n"), 3, 4))))
    x = np.random.default_rng(4).normal(size=80) + np.repeat([0, 5, 1, 9], 20)
    spark.createDataFrame([(x.tolist(),), (None,)], "s array<double>").createOrReplaceTempView("signals")
    got = spark.sql("select cusum(s) as a, cusum(s, 0.5, 2) as b, pelt(s, 20, 30.0, 40) as c, bocpd(s, 0.05) as d, jb_segments(s, 0.5) as e, two_window_segments(s, 0.95, 8) as f, cusum(s, null) as g from signals order by s is null").collect()
    want = (K.cusum(x), K.cusum(x, 0.5, 2.0), K.pelt(x, 20.0, 30.0, 40), K.bocpd(x, 0.05), K.jb_segments(x, 0.5), K.two_window_segments(x, 0.95, 8))
    assert tuple(got[0][:6]) == tuple(w.tolist() for w in want) and got[0].g is None and set(got[1]) == {None}


def test_ways_through_first_and_final_blocks():
    x = np.random.default_rng(8).normal(size=27)
    for length in (27, 20):
        block = K.PeltBlock(x, length, 9.0, 30.0, 8, 1e-3)
        whole = block.ways()
        assert block.ways(final=True).tolist() == whole[:, :1].tolist()
        assert block.ways(first=True).tolist() == whole[:1].tolist() and block.ways(True, True).tolist() == whole[:1, :1].tolist()


def test_pelt_by_blocks_hands_matrices_on_in_pieces(spark):
    """Batches were of as many matrices as rows came in, 10,000 of 29 KB at most."""
    from amploom.operators import reads as R

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert R.PIECE * 60 * 60 * 8 < 2 << 20
    rng = np.random.default_rng(3)
    signals = rng.normal(size=(40, 150)) + np.repeat(rng.normal(0, 6, (40, 10)), 15, axis=1)
    df = spark.createDataFrame([(k, i, float(v)) for k, x in enumerate(signals) for i, v in enumerate(x)], "k long, pos long, x double")
    got = {k: [] for k in range(40)}
    for r in R.pelt_by_blocks(df, "k", block=64).collect():
        got[r.k].append((r.start, r.length))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    for k, x in enumerate(signals):
        seg = K.pelt(x, 15.0, 60.0, 60)
        assert sorted(got[k]) == [(int(np.flatnonzero(seg == i)[0]), int((seg == i).sum())) for i in range(seg[-1] + 1)]


def test_moves_bands_are_arrays(spark):
    """Made of objects a batch of 2,000 reads of 100 samples held over 100 MB; as numbers it is 6 MB."""
    import tracemalloc

    from amploom.functions import kmers as KM
    from amploom.operators import reads as R

    rng = np.random.default_rng(6)
    moves = [rng.integers(-1, 5, 100) for _ in range(2000)]
    tracemalloc.start()
    got = KM.moves_bands([*moves, None, np.zeros(0, int)], [10] * 2002, [4] * 2002)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and got[2000].as_py() is None and got[2001].as_py() == []
    assert all([tuple(z.values()) for z in got[i].as_py()] == KM.moves_band(moves[i], 10, 4) for i in range(0, 2000, 97))
    df = spark.createDataFrame([(0, [0, 0, 1, 1]), (1, None), (2, []), (3, [-1, -1])], "id int, mv array<int>").coalesce(1)
    rows = df.orderBy("id").select(R.moves_band("mv", 4, 2)).collect()
    assert [None if r[0] is None else [tuple(z) for z in r[0]] for r in rows] == [[(0, 1), (0, 2), (1, 1), (1, 2), (2, 2), (2, 3), (3, 2), (3, 3)], None, [], []]


def test_dtw_paths_are_arrays(spark):
    """A path was a list of objects of two fields, now it is numbers in a row; null signals have null fields."""
    from pyspark.sql import functions as F

    from amploom.operators import reads as R

    rng = np.random.default_rng(7)
    dist, path = K.dtw_path(rng.normal(size=50), rng.normal(size=30))
    assert path.dtype == np.int32 and path.shape[1] == 2
    pairs = [(rng.integers(0, 4, 9).astype(float).tolist(), rng.integers(0, 4, 12).astype(float).tolist()), (None, [1.0]), ([], [1.0]), ([2.0], [2.0])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, a array<double>, b array<double>").coalesce(1)
    got = [r.z for r in df.orderBy("id").select(R.dtw("a", "b").alias("z")).collect()]
    assert (got[0].dist, [tuple(z) for z in got[0].path]) == K.dtw(np.array(pairs[0][0]), np.array(pairs[0][1]))
    assert tuple(got[1]) == (None, None) and tuple(got[2]) == (0.0, []) and [tuple(z) for z in got[3].path] == [(0, 0)]
    points = df.where("id = 0").select(R.dtw(F.transform("a", lambda x: F.array(x, x)), F.transform("b", lambda x: F.array(x, x))).alias("z")).first().z
    assert points.dist == 2 * got[0].dist and points.path == got[0].path


@pytest.mark.parametrize("options", [{}, {"most": 7}, {"window": 10, "table": K.hazard(200, 15.0, 8.0)}, {"prior": (1.0, 0.5, 2.0, 3.0)}])
def test_bocpd_of_many_is_that_of_each(options):
    rng = np.random.default_rng(9)
    signals = [np.repeat(rng.normal(0, 9, n // 9 + 1), 9)[:n] + rng.normal(size=n) for n in (40, 0, 1, 7, 300, 64, 2, 40)] + [np.ones(30)]
    got = K.bocpd_many(signals, **options)
    assert [g.tolist() for g in got] == [K.bocpd(x, **options).tolist() for x in signals]
    assert all(g.dtype == np.int32 and len(g) == len(x) for g, x in zip(got, signals)) and max(g.max(initial=0) for g in got) > 2
