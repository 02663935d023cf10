import itertools
import math

import duckdb
import pytest

from amploom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "part", "lineitem", "events", "documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.ORACLES[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    pick = df.select(*cols).collect()
    assert sorted(map(repr, (tuple(r) for r in pick))) == sorted(map(repr, got.fetchall()))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_have_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(5).collect()


def test_entry_needs_no_optional_part(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def _band(q, n, k, width):
    """(t, code) by the reference's loop: the base moves on every n div length samples, the first included."""
    codes = [sum("ATCG".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(q[i : i + k])) for i in range(len(q) - k + 1)]
    out, base = [], 0
    if not codes or n <= len(codes):
        return out
    for t in range(n):
        base = min(base + (t % (n // len(codes)) == 0), len(codes) - 1)
        near = [min(max(base + j - width // 2, 0), len(codes) - 1) for j in range(width)]
        out += [(t, codes[p]) for p in dict.fromkeys(near)]
    return out


def test_coarse_band_has_all_documents(spark, tmp_path):
    rows = [(1, "gattaca and a cat " * 40), (2, "A"), (3, None), (4, ""), (5, "Tag"), (6, "acgt gcat"), (7, "tactgc" * 11), (8, "\u00e9")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.QUERIES["coarse_band"](spark, str(tmp_path)).collect()]
    want = []
    for d, text in rows:
        q = "".join(c for c in (text or "").upper() if c in "ACGT")
        want += [(d, t, code) for t, code in _band(q, 3 * len(q), 3, 4)]
    assert sorted(got) == sorted(want) and {d for d, _, _ in got} == {1, 5, 6, 7}


def test_classify_reads_by_enumeration(spark, tmp_path):
    values = {1: [15.0, 30.0, 22.0], 2: [150.0, 90.0, 20.0, 10.0], 3: [25.0, 100.0, 130.0, 95.0], 4: [120.0], 6: [40.0, 180.0, 170.0, 200.0, 160.0], 7: [10.0, 5.0]}
    rows = [(100 * u + i, i, u, x) for u, xs in values.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.uuid: (r.label_real, r.label_predict) for r in registry.QUERIES["classify_reads"](spark, str(tmp_path)).collect()}
    density = lambda s, x: -math.log((20.0, 60.0)[s]) - 0.5 * ((x - (20.0, 90.0)[s]) / (20.0, 60.0)[s]) ** 2
    want = {}
    for u, xs in values.items():
        score = lambda p: sum(density(s, x) for s, x in zip(p, xs)) + sum(math.log(0.9 if a == b else 0.1) for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(2), repeat=len(xs)), key=score)
        want["00000000-0000-0000-0000-" + str(u).zfill(12)] = (float(u % 2 + 1), float(best[0] + 1))
    assert got == want and {p for _, p in got.values()} == {1.0, 2.0}


def test_run_means_by_grouping(spark):
    from amploom.operators import hmm, reads

    df = registry._reads(spark, SF).limit(12).withColumn("mv", reads.cusum("signal")).cache()
    want = {}
    for r in df.collect():
        runs = [[x for x, _ in g] for _, g in itertools.groupby(zip(r.signal, r.mv), key=lambda z: z[1])]
        want[r.uuid] = [sum(x[:50]) / len(x[:50]) for x in runs[:50]]
    got = {r.read_id: [x for x in r[2:] if x is not None] for r in hmm.run_means(df).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and max(map(len, want.values())) > 1
