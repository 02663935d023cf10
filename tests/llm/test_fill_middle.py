import hashlib
import random
import re

import numpy as np
import pytest
from amploom.llm import fill_middle as M
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n string, OUTPUT string, _hash int"


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return doc_id, len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), out


def made(spark, rows):
    df = spark.createDataFrame([(d, t, "own", "own", 7) for d, t in rows], SCHEMA).repartition(3)
    return M.fill_in_middle(df)


def texts():
    rng = random.Random(5)
    pick = ["a", "Zz", "é", "中", "\U0001f600", " ", "\n", "\x00", "<", ">", "P", "<S", " ", "\u0085", "7"]
    out = [None, "", " ", "a", "\n", "<P>", "x<M>y", "<", "<<S", "word " * 9, "café 中文", "end\r\n"]
    return out + ["".join(rng.choice(pick) for _ in range(rng.randrange(1, 60))) for _ in range(150)]


def test_equals_brute_force_and_restores(spark):
    rows = list(enumerate(texts())) + [(3, "again and again"), (3, "again and again"), (None, "no id, same ranks"), (2**62, "large"), (-5, "below zero")]
    df = made(spark, rows)
    got = df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, (brute(*r) for r in rows)))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert df.where(M.restore(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0
    assert df.columns == ["doc_id", "text", "_hash", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r["_hash"] for r in df.select("_hash").collect()} == {7}


def test_empty_table(spark):
    assert made(spark, [(1, "x")]).where("false").count() == 0
    assert made(spark, []).collect() == []


@pytest.mark.parametrize("text", ["ab, cé " * 900_000, "x" * 7_000_000, "+/9éQ" * 1_300_000], ids=["words", "one letter run", "one word of many tokens"])
def test_texts_over_a_slice(spark, text):
    rows = [(k, text) for k in (1, 2)] + [(3, "short")]
    got = {r.doc_id: r for r in made(spark, rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("h")).collect()}
    for d, t in rows:
        want = brute(d, t)
        assert tuple(got[d])[:5] == want[:5] and got[d].h == hashlib.sha256(want[5].encode()).hexdigest()


def test_long_words_are_cut_where_tokens_end():
    text = "abc1" * 50 + " " + "z" * 300 + "éé" * 40 + "q"
    whole = text.encode() + b"next text"
    buf, offs = np.frombuffer(whole, np.uint8), np.array([0, len(text.encode()), len(whole)])
    ends, begin = M.token_ends(buf, offs, piece=16)
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text) + ["next", " ", "text"]
    assert ends.tolist() == np.cumsum([len(u) for u in units]).tolist() and begin.tolist() == [0, len(text), len(text) + 9]


def test_percentages_are_parameters(spark):
    df = spark.createDataFrame([(i, "some words here") for i in range(300)], "doc_id long, text string")
    assert {r.form for r in M.fill_in_middle(df, plain=0, suffix_first=100).select("form").distinct().collect()} == {"spm"}
    assert {r.form for r in M.fill_in_middle(df, plain=100).select("form").distinct().collect()} == {"plain"}
