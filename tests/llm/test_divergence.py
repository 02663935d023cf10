import random
import re
from collections import Counter, defaultdict

import pytest
from amploom.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, value string, z int"


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute(rows, least=30, top=50):
    docs = [(lang or "", source or "", terms_of(text)) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = [w for w, n in df.items() if n >= least]
        count = defaultdict(Counter)
        for _, source, words in mine:
            count[source].update(w for w in words if df[w] >= least)
        share = lambda c: {w: 1 + (10**9 * (c[w] + 5)) // (sum(c.values()) + 5 * len(kept)) for w in kept}  # noqa: E731, B023
        q = share(sum(count.values(), Counter()))
        p = {s: share(c) for s, c in count.items()}
        for s in p:
            pairs = [(t, sum(abs(p[s][w] - p[t][w]) for w in kept)) for t in p if t != s]
            more = [(w, p[s][w] - q[w]) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", more, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i % 9, *r, "own", 7) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def sample(sources, n=400):
    rng = random.Random(11)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Éa", "éa", "ÉA", "中文", "\u0085", "Ab", "aB"]
    out = []
    for _ in range(n):
        s = int(rng.paretovariate(0.8)) % sources
        own = [words[(s * 3 + k) % len(words)] for k in range(6)] + words[:4]
        out.append((rng.choice([" ", "7", "-", "\x00"]).join(rng.choices(own, k=rng.randrange(0, 40))), rng.choice(["en", "en", "fr", None, ""]), f"s{s}"))
    return out + [(None, "en", "silent"), ("", "de", "alone"), ("1 2 3", "de", None), ("word", "xx", "only"), ("a" * 50 + " b", None, None)]


@pytest.mark.parametrize("heavy,tile", [(8, 512), (2, 3), (0, 4), (100, 512)])
def test_equals_brute_force(spark, heavy, tile):
    rows = sample(14)
    got = D.divergence(table(spark, rows), least_docs=4, top=7, heavy=heavy, tile=tile)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 7)


def test_blocks_of_sources(spark):
    rows = sample(15, 250)
    for heavy in (2, 4):
        assert sorted(map(tuple, D.divergence(table(spark, rows), least_docs=3, heavy=heavy, tile=5, block=4).collect())) == brute(rows, 3)


def test_many_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_GROUPS", 0)
    rows = sample(12, 200)
    assert sorted(map(tuple, D.divergence(table(spark, rows), least_docs=3, heavy=3, tile=5).collect())) == brute(rows, 3)


def test_counts_leave_in_parts(spark):
    rows = sample(9, 120)
    got = D.term_counts(table(spark, rows), flush=200).where("term <> ''").groupBy("lang", "source", "term").sum("n", "docs").collect()
    n, docs = Counter(), Counter()
    for text, lang, source in rows:
        for w, k in Counter(terms_of(text)).items():
            n[lang or "", source or "", w] += k
            docs[lang or "", source or "", w] += 1
    assert {tuple(r[:3]): (r[3], r[4]) for r in got} == {k: (n[k], docs[k]) for k in n}


def test_very_long_texts(spark):
    rows = [("common words here " * 400_000, "en", "a"), ("common " + "x" * 5_000_000, "en", "b"), ("here", "en", "c")]
    assert sorted(map(tuple, D.divergence(table(spark, rows), least_docs=2).collect())) == brute(rows, 2)


def test_no_rows_and_no_kept_terms(spark):
    assert D.divergence(table(spark, [("x", "en", "a")]).where("false")).collect() == []
    rows = [("some text", "en", "a"), ("other text", "en", "b"), (None, None, None)]
    assert sorted(map(tuple, D.divergence(table(spark, rows)).collect())) == brute(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_of_huge_counts(spark):
    from pyspark.sql import functions as F

    n = 4 * 10**18
    row = spark.range(1).select(D.share(F.lit(n), F.lit(2 * n), F.lit(3)).alias("p"), D.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (2 * n + 15) and row.none is None
