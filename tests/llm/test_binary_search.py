import tracemalloc

import numpy as np
import pytest
from amploom.llm import binary_search as B


def rank(codes, ids, queries, k):
    """(query, id, distance) by comparing all."""
    out = []
    for q, code in enumerate(queries):
        d = np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)
        out += [(q, int(ids[i]), int(d[i])) for i in np.lexsort((ids, d))[:k]]
    return out


def test_second_pass_has_the_rest():
    rnd = np.random.default_rng(6)
    codes = np.packbits(rnd.random((3000, 64)) < np.where(rnd.random((3000, 1)) < 0.3, 0.1, 0.5), axis=1, bitorder="little").view(np.uint64)
    ids, queries = rnd.permutation(3000), codes[:200]
    index = B.MultiIndex(codes, ids)
    want = rank(codes, ids, queries, 10)
    bound = np.array([d for _, _, d in want[9::10]])
    for first in (1, 2, 3):
        parts = [list(zip(*(x.tolist() for x in index.search(queries, 10, *how)))) for how in ((None, 0, first), (bound, first, None))]
        assert parts[1] and not set(parts[0]) & set(parts[1])
        both = sorted(parts[0] + parts[1], key=lambda x: (x[0], x[2], x[1]))
        assert [x for q in range(200) for x in [y for y in both if y[0] == q][:10]] == want


def test_many_candidates_are_not_held():
    rnd = np.random.default_rng(3)
    codes = rnd.integers(0, 1 << 63, (20000, 1), np.uint64) >> np.uint64(14) << np.uint64(14)  # all have the first segment's value
    ids = np.arange(1, len(codes) + 1)
    index = B.MultiIndex(codes, ids)
    tracemalloc.start()
    found = index.search(codes[:500], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # ten million candidates
    part = found[0] < 20
    assert list(zip(*(x[part].tolist() for x in found))) == rank(codes, ids, codes[:20], 10)


def test_long_codes_are_held_once():
    codes = np.random.default_rng(4).integers(0, 1 << 63, (20000, 12), np.uint64)
    tracemalloc.start()
    index = B.MultiIndex(codes, np.arange(len(codes)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(index.tables) > 40 and held < 20 << 20  # a copy for each would be 100 MB


@pytest.mark.parametrize("words, rows, distinct, used", [(1, 4000, 4000, 64), (1, 3000, 700, 64), (1, 2000, 90, 9), (2, 1500, 1500, 100), (12, 60, 60, 768), (1, 6, 6, 64), (1, 1, 1, 64), (1, 400, 1, 64)])
@pytest.mark.parametrize("piece", [None, 50])
def test_index_against_all_pairs(monkeypatch, words, rows, distinct, used, piece):
    if piece:
        monkeypatch.setattr(B, "PIECE", piece)
    rnd = np.random.default_rng(rows + words)
    bits = rnd.random((distinct, words * 64)) < 0.5
    bits[:, used:] = False
    codes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[rnd.integers(0, distinct, rows)]
    ids = rnd.permutation(rows) - 5
    near = codes[: min(rows, 25)] ^ (np.uint64(1) << rnd.integers(0, 60, (min(rows, 25), words), np.uint64))
    for queries in (codes[:25], near, ~codes[:5]):
        found = B.MultiIndex(codes, ids).search(queries, 10)
        assert list(zip(*(x.tolist() for x in found))) == rank(codes, ids, queries, 10)


@pytest.mark.parametrize("first", [1, 3])
def test_shards_and_parts(spark, monkeypatch, first):
    monkeypatch.setattr(B, "FIRST", first)
    monkeypatch.setattr(B, "SHARD", 150)
    monkeypatch.setattr(B, "PART", 7)
    monkeypatch.setattr(B, "TASKS", 12)
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(500, 64))
    x[300:] = x[rnd.integers(0, 300, 200)] * np.where(rnd.random((200, 64)) < 0.03, -1, 1)  # near copies and copies
    x[480:] = x[0]
    df = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    codes = np.packbits(x > 0, axis=1, bitorder="little").view(np.uint64)
    got = B.top_k(df, df.where("vec_id % 20 = 0")).collect()
    assert len({(r.query_id, r["rank"]) for r in got}) == len(got) == 2500
    ids = np.arange(500) * 10
    assert [(r.query_id // 20, r.vec_id, r.distance) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == rank(codes, ids, codes[::2], 10)
