import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from amploom.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, kept string, _n int"


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    of = defaultdict(list)
    for i, t in enumerate(norm):
        of[t].append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in of[norm[i]]]
        least = min((x for x in ids if x is not None), default=None)
        out.append((d, least, len(ids), hashlib.sha256(norm[i].encode()).hexdigest()))
    return out


def table(spark, rows, parts=5):
    return spark.createDataFrame([(d, t, "own", 7) for d, t in rows], SCHEMA).repartition(parts)


def check(spark, rows, **how):
    from pyspark.sql import functions as F

    docs = table(spark, rows).withColumn("sha", F.sha2(X.normalised(F.col("text")).cast("binary"), 256))
    got = X.exact_groups(docs, ("doc_id", "sha"), **how).collect()
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.sha) for r in got))) == sorted(map(repr, brute(rows)))
    stay = [r for r in got if r.kept]
    assert sorted(r.sha for r in stay) == sorted({r.sha for r in got})  # one of each text
    assert all(r.doc_id == r.keep_id for r in stay)


def sample(n=300):
    rng = random.Random(3)
    base = ["", None, " ", "\n\n", "a b", "a\tb", "a  b", "a b ", "é \u0085x", "é x", "\x00", "long words " * 30]
    base += [" ".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(20)]
    return [(i * 7 % n, rng.choice(base)) for i in range(n)]


def test_equals_brute_force(spark):
    check(spark, sample() + [(5, "twice"), (5, "twice"), (5, "other"), (None, "no id"), (None, "no id"), (None, "a b"), (-3, "a b")])


def test_chunks_of_long_texts_compose(spark):
    check(spark, sample() + [(900 + i, "word after word " * 40) for i in range(4)] + [(950, "word after word " * 39 + "word before word ")], chunk=16)


def test_texts_that_collide_are_told_apart(spark):
    """Of one small prime nearly all fingerprints of a length are shared; the comparison finds it, also in a chunk."""
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab") for _ in range(12))) for i in range(120)]
    check(spark, rows, lanes=((5, 2),))
    check(spark, rows, lanes=((5, 2),), chunk=5)


def test_many_groups_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_GROUPS", 0)
    check(spark, sample() + [(1000 + i, "very common") for i in range(400)], chunk=64)


def test_very_long_texts(spark):
    long = "some words, é " * 500_000
    check(spark, [(1, long), (2, long.replace(" ", "\n ")), (3, long[:-1] + "x"), (4, "x" + long[1:]), (5, "short")])


def test_rows_that_stay_keep_their_columns(spark):
    out = X.deduplicate(table(spark, [(3, "a  b"), (2, "a b"), (2, "a b"), (9, None)]).drop("kept"))
    assert out.columns == ["doc_id", "text", "_n"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(2, "a b", 7), (9, None, 7)]))


def test_empty_table(spark):
    got = X.exact_groups(table(spark, [(1, "x")]).where("false"))
    assert got.collect() == [] and got.columns == ["doc_id", "keep_id", "group_size", "kept"]


@pytest.mark.parametrize("cut", [0, 1, 4, 10])
def test_fingerprints_compose(cut):
    text, lanes = b"0123456789", X.LANES
    plain = [sum((c + 1) * base ** (len(text) - 1 - i) for i, c in enumerate(text)) % p for p, base in lanes]
    buf = np.frombuffer(text, np.uint8)
    parts = X.hash_parts(buf, np.array([0, cut, len(text)]), np.array([len(text) - cut, 0]), lanes)
    assert [int(x) % p for x, (p, _) in zip(parts.sum(axis=1), lanes)] == plain
