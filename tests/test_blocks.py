import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from amploom.functions import kmers as KM
from amploom.operators import blocks as B

LINKS, VEC = "source long, target long, lp double", "series long, id long, v double"


bell = lambda x, mean: -0.5 * (x - mean) ** 2  # noqa: E731  (workers don't import this module, and a lambda goes by value)


def made(n=23, seed=5):
    rnd = random.Random(seed)
    links = [(rnd.randrange(n), rnd.randrange(n), rnd.choice([-0.5, -1.0, -2.5])) for _ in range(3 * n)]
    dense = np.zeros((n, n))
    for a, b, lp in links + links[:4]:
        dense[a, b] += np.exp(lp)
    return [*links, *links[:4], (0, 1, None)], dense  # the same link twice, and one without a chance


def test_product_and_its_transpose(spark):
    links, dense = made()
    table = spark.createDataFrame(links, LINKS)
    vec = spark.createDataFrame([(s, i, -0.1 * i * s) for s in (1, 2) for i in range(0, 23, s)] + [(1, 5, None)], VEC)
    turned = table.select(F.col("target").alias("source"), F.col("source").alias("target"), "lp")
    for rows, m in ((table, dense), (turned, dense.T)):
        got = {(r.series, r.id): r.v for r in B.unpack(B.vec_mat(B.pack(vec, 4), B.link_tiles(rows, 4), 4), 4).collect()}
        want = {}
        for s in (1, 2):
            v = np.zeros(23)
            v[::s] = np.exp(-0.1 * s * np.arange(0, 23, s))
            want |= {(s, i): np.log(x) for i, x in enumerate(v @ m) if x}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("cut", [1, 8])
def test_forward_of_series_of_different_lengths(spark, cut):
    links, dense = made()
    mean = np.arange(23) / 7
    states = spark.createDataFrame([(i, float(m)) for i, m in enumerate(mean)][:-1], "id long, mean double")  # the last one has no emission
    starts = [(s, i, -1.0 - i) for s in (1, 2, 3) for i in (0, s, 9)] + [(4, 3, 0.0)]
    xs = {1: [0.3], 2: [1.0, 2.0, 0.5], 3: [2.0, 0.1, 0.2, 3.0, 1.5]}  # series 4 has no frames
    frames = spark.createDataFrame([(s, t, x) for s, v in xs.items() for t, x in enumerate(v)], "series long, t int, x double")
    out = B.forward(spark.createDataFrame(links, LINKS), spark.createDataFrame(starts, VEC), states, frames, bell, size=4, cut=cut)
    got = {(r.series, r.id): r.v for r in out.collect()}
    want = {}
    for s, values in xs.items():
        a = np.zeros(23)
        for _, i, v in (r for r in starts if r[0] == s):
            a[i] += np.exp(v)
        for t, x in enumerate(values):
            e = np.exp(bell(x, mean))
            e[22] = 0
            a = (a @ dense if t else a) * e
        want |= {(s, i): np.log(x) for i, x in enumerate(a) if x}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_forward_of_nothing(spark):
    links, states = spark.createDataFrame([], LINKS), spark.createDataFrame([(0, 1.0)], "id long, mean double")
    start, frames = spark.createDataFrame([(1, 0, 0.0)], VEC), spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0)], "series long, t int, x double")
    assert B.forward(links, start, states, frames, bell).count() == 0
    assert B.forward(links, start, states, frames.where("t < 0"), bell).count() == 0
    assert [r.id for r in B.forward(links, start, states, frames.where("t < 1"), bell).collect()] == [0]


def test_two_emissions_of_a_state_are_an_error(spark):
    states = spark.createDataFrame([(0, 1.0), (0, 2.0)], "id long, mean double")
    start, frames = spark.createDataFrame([(1, 0, 0.0)], VEC), spark.createDataFrame([(1, 0, 1.0)], "series long, t int, x double")
    with pytest.raises(Exception, match="two emissions"):
        B.forward(spark.createDataFrame([], LINKS), start, states, frames, bell).collect()


def test_kmers_are_counted_like_the_column(spark):
    rows = [(0, "gattaca-GATTACA"), (1, None), (2, ""), (3, "acg"), (4, "xÄaçCßgtT"), (5, "acgt" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = docs.select(F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", "")).alias("q"))
    codes = clean.select(KM.kmer_codes(F.col("q"), 4).alias("c"))
    want = codes.select(F.explode("c").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    assert sorted(KM.count_kmers(docs, "text", 4).collect()) == sorted(want.collect())
    begin = codes.select(F.get("c", F.lit(0)).alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n"))
    assert sorted(KM.count_kmers(docs, "text", 4, first=True).collect()) == sorted(begin.collect())


def test_kmers_of_any_letters(spark):
    """Nulls, letters of several bytes, capitals of several letters, slices of batches, and long sequences."""
    texts = [None, "", "A", "AC", "ACG", "gattacaXn", "aÄcgt", "ßa", "\U0001d538CGT", "straße", "TGCA" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, q string").coalesce(1)
    code = lambda z: sum("ATCG".find(c) * 4 ** (len(z) - 1 - i) if c in "ATCG" else 0 for i, c in enumerate(z))
    got = df.select("id", KM.kmer_codes(F.col("q"), 3).alias("c"), KM.kmer_strings(F.col("q"), 3, 1).alias("s"), KM.kmer_strings(F.col("q"), 4, 0, "--").alias("w")).collect()
    for r in got:
        q = texts[r.id] or ""
        up = q.upper()
        assert r.c == ([code(up[i : i + 3]) for i in range(len(up) - 2)] if len(q) >= 3 else [])
        full, wide = "N" + q + "N", q + "-" * 6
        assert r.s == [full[i : i + 3] for i in range(len(q))] and r.w == [wide[i : i + 4] for i in range(len(q))]
    lists = spark.createDataFrame([(0, [11, 45, 53, 20]), (1, []), (2, None), (3, [27]), (4, [None, 5, 2]), (5, [6, None, 3, 1, 2])], "id int, c array<bigint>").coalesce(1)
    back = lists.orderBy("id").select(KM.kmers_of_codes(F.col("c"), 3).alias("a"), KM.kmers_of_codes(F.col("c"), 3, True).alias("b")).collect()
    assert [tuple(r) for r in back] == [("ACGTTA", "ACGA"), ("", ""), ("", ""), ("TCG",) * 2, ("TC", ""), ("ATCGTC", "ATCTC")]


def test_letters_are_those_of_sql(spark, tmp_path):
    """A text was matched by a regular expression, twice where a filter asks for the letters' number."""
    from amploom.plans import registry

    texts = [None, "", "x", "A-c\n g\x00T", "\u212aÇß\u0130 ağ", "\U0001d538CGT", "No cat\u0301", "gattaca " * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = docs.select("doc_id", F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", "")).alias("q"))
    got = docs.select("doc_id", KM.letters(F.col("text")).alias("q"))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    back = registry.QUERIES["kmer_round_trip"](spark, str(tmp_path))
    assert sorted(back.collect()) == sorted(want.where("length(q) >= 3").collect())
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("go(text") == 1


def test_entries_are_counted_where_they_are(spark, tmp_path):
    """Every k-mer of every text was a row before it was counted."""
    from amploom.plans import registry

    lists = [["b", "a", "b"], [], None, ["a", None, None], ["é"], ["b"] * 9 + ["a"]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, v array<string>").coalesce(1)
    got = {r.id: sorted(map(tuple, r.c), key=str) for r in df.select("id", KM.counts(F.col("v"), "string").alias("c")).collect()}
    assert got == {i: sorted(((x, v.count(x), v.index(x)) for x in set(v)), key=str) for i, v in enumerate(z or [] for z in lists)}
    rnd = np.random.default_rng(4)
    edge = np.array([0, 0, 700, 700, 1500])
    code = rnd.integers(0, 50, 1500)
    for span in (50, 1 << 40):  # counted in bins, and sorted
        ends, value, n, first = KM._counted(code, edge, span)
        for i in range(4):
            own, to = code[edge[i] : edge[i + 1]].tolist(), slice(ends[i], ends[i + 1])
            assert list(zip(value[to].tolist(), n[to].tolist(), first[to].tolist())) == [(x, own.count(x), own.index(x)) for x in sorted(set(own))]
    spark.createDataFrame([(1, "gattaca"), (1, "Gat tag"), (2, None), (3, "c"), (4, "-")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for d, q in ((1, "NGATTACAN"), (1, "NGATTAGN"), (3, "NCN")):
        for i in range(len(q) - 2):
            want[d, q[i : i + 3]] = want.get((d, q[i : i + 3]), 0) + 1
    strings = registry.QUERIES["kmer_strings"](spark, str(tmp_path))
    assert strings.dtypes == [("doc_id", "bigint"), ("kmer", "string"), ("n", "bigint")]
    assert {(r.doc_id, r.kmer): r.n for r in strings.collect()} == want and strings.count() == len(want)
    assert {(r.doc_id, "".join("ATCG"[r.code >> s & 3] for s in (4, 2, 0))): r.n for r in registry.QUERIES["kmer_codes"](spark, str(tmp_path)).collect()} == {k: n for k, n in want.items() if "N" not in k[1]}
    for name in ("kmer_strings", "kmer_codes"):
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "explode" not in plan and "inline" in plan


def test_coarse_band_rows_are_the_columns(spark):
    v = spark.createDataFrame([(1, "ACGTTGCA", 25), (2, "AC", 9), (3, "", 5), (4, None, 7), (5, "nnACGt", None), (6, "GGATTACA", 7), (7, "ACG", 5), (8, "GGATTACA", 6), (9, "GATTA" * 20, 199)], "id int, q string, n long")
    for k, width in ((3, 4), (2, 1), (3, 7)):
        want = v.select("id", F.inline(KM.coarse_band(F.col("q"), F.col("n"), k, width))).collect()
        rows = KM.coarse_band_rows(v, ["id"], F.col("q"), F.col("n"), k, width)
        assert rows.dtypes == [("id", "int"), ("t", "bigint"), ("code", "bigint")] and sorted(map(tuple, rows.collect())) == sorted(map(tuple, want)) and want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("Generate explode") == 3


def test_nodes_are_found_once(spark):
    """Labels, own and shared nodes were each found from all documents again."""
    from amploom.plans import registry

    plan = registry.QUERIES["wildcard_label_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "amploom-table" in plan


def test_kmers_are_counted_in_pieces(spark):
    """A long text's codes were all in memory at once."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("acgt-", k=n)) for n in (700_000, 3, 800_000)]
    got = {r.code: r.n for r in KM.count_kmers(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text", 3).collect()}
    want = {}
    for t in texts:
        q = t.replace("-", "").upper()
        for i in range(len(q) - 2):
            want[q[i : i + 3]] = want.get(q[i : i + 3], 0) + 1
    assert KM.PIECE < 560_000 and got == {sum("ATCG".index(c) * 4 ** (2 - j) for j, c in enumerate(z)): n for z, n in want.items()}
