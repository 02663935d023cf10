"""Surrogates against a plain version of the same rules, and the properties that they promise."""

import hashlib
import hmac as pyhmac

import pytest
import regex
from pyspark.sql import functions as F

from amploom.llm import surrogates as S

SF = "/root/testdata/sf0.001"
KEY = "another key"


def mac(*of):
    return pyhmac.new(KEY.encode(), "\x1f".join(map(str, of)).encode(), hashlib.sha256).hexdigest()


def byte(h, i):
    return int(h[2 * (i % 32) : 2 * (i % 32) + 2], 16)


def permuted(tweak, a, b, m, n):
    f = lambda i, x: int(mac(tweak, m, n, i, x)[:15], 16)
    for i in range(S.TURNS):
        a, b = ((a + f(i, b)) % m, b) if i % 2 == 0 else (a, (b + f(i, a)) % n)
    v = (a * n + b + 1 + int(mac(tweak, m, n)[:15], 16) % (m * n - 1)) % (m * n)
    a, b = divmod(v, n)
    for i in reversed(range(S.TURNS)):
        a, b = ((a - f(i, b)) % m, b) if i % 2 == 0 else (a, (b - f(i, a)) % n)
    return a, b


def digits(tweak, d):
    hi = len(d) // 2
    a, b = permuted(tweak, int(d[:hi]), int(d[hi:]), 10**hi, 10 ** (len(d) - hi))
    return f"{a:0{hi}d}{b:0{len(d) - hi}d}"


def check(stem):
    return -sum((int(c) * 2 - 9 * (int(c) > 4) if i % 2 == 0 else int(c)) for i, c in enumerate(reversed(stem))) % 10


def number(kind, canon):
    if kind == "ip":
        p = list(map(int, canon.split(".")))
        if p[0] in (0, 169, 172, 192) or p[0] >= 224:
            return ".".join(map(str, [*p[:2], *permuted(f"ip{p[0]}.{p[1]}", p[2], p[3], 256, 256)]))
        if p[0] in (10, 127):
            a, b = permuted(f"ip{p[0]}", p[1], p[2] * 256 + p[3], 256, 65536)
            return ".".join(map(str, [p[0], a, *divmod(b, 256)]))
        first = [x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)]
        a, b = permuted("ip", first.index(p[0]) * 256 + p[1], p[2] * 256 + p[3], 256 * len(first), 65536)
        return ".".join(map(str, [first[a // 256], a % 256, *divmod(b, 256)]))
    if kind == "card":
        off = (int(canon[-1]) - check(canon[:-1])) % 10
        stem = canon[0] + digits(f"card{off}", canon[1:-1])
        return stem + str((check(stem) + off) % 10)
    head, _, rest = canon.rpartition(":")
    return head + digits(kind, rest)


def shaped(s, h):
    return "".join(chr(48 + byte(h, i) % 10) if "0" <= c <= "9" else chr(97 + byte(h, i) % 26) if "a" <= c <= "z" else c for i, c in enumerate(s))


def made_up(script, h, attempt):
    t = S.SYLLABLES[script]
    return "".join(t[byte(h, 8 + i) % len(t)] for i in range(3 + attempt)).capitalize()


def drawn(kind, canon, sex, attempt):
    h = mac(kind, canon, attempt)
    script = "cyrillic" if regex.search(r"\p{IsCyrillic}", canon) else "latin"
    if kind == "email":
        tld = canon.rsplit(".", 1)[1]
        return "".join(chr(97 + byte(h, 31 - i) % 26) for i in range(1, attempt + 1)) + shaped(canon[: -len(tld)], h) + tld
    if kind == "family":
        return made_up(script, h, attempt)
    names = S.NAMES[script, sex]
    return names[(byte(h, 0) * 256 + byte(h, 1)) % len(names)] + (made_up(script, h, attempt).lower() if attempt else "")


def matches(text):
    return [m.group() for m in regex.finditer(S.ANY, text or "")]


def kind_of(m):
    return next((k for k in list(S.KINDS)[:-1] if regex.fullmatch(S.KINDS[k], m)), "name")


def entities(m):
    k = kind_of(m)
    if k == "name":
        w = regex.split(S.GAP, m)
        sex = "m" if regex.match(rf"(?:{S.TITLES['m']})\b", m) else "f" if regex.match(rf"(?:{S.TITLES['f']})\b", m) else "u"
        return [("first", w[1].lower(), sex), ("family", w[2].lower(), "u")] if len(w) > 2 else [("family", w[1].lower(), "u")]
    d = "".join(c for c in m if "0" <= c <= "9")
    if k == "phone":
        n = next(n for n in (1, 2, 3) if n == 3 or d[:n] in CODES) if m[0] == "+" else min(len(d) - len(d.lstrip("0")), len(d) - 2)
        return [(k, f"{d[:n]}:{d[n:]}", "u")]
    return [(k, m.lower() if k == "email" else m if k == "ip" else d, "u")]


CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def is_name(text, a, b, words):
    """A common word is a name beside another of the names, or within a sentence and not after an article."""
    if text[a:b].lower() not in S.COMMON:
        return True
    before, after = text[:a], text[b:]
    beside = regex.search(r"(?<!\p{L})(\p{Lu}[\p{L}'-]*)[ \t\u00a0]$", before)
    ahead = regex.match(S.GAP + r"(\p{Lu}[\p{L}'-]*)", after)
    if beside and beside[1] in words or ahead and ahead[1] in words:
        return True
    word = regex.search(r"(\p{L}*)[ \t\u00a0\n]$", before)
    return bool(regex.search(r"[\p{L}\p{N},;:)][ \t\u00a0\n]$", before)) and not (word and word[1] in {x for y in S.ARTICLES for x in (y, y.capitalize())})


def brute(rows):
    """The corpus by hand: one surrogate an entity, then text by text."""
    sexes, attempt = {}, {}
    for _, t in rows:
        for k, c, g in (e for m in matches(t) for e in entities(m)):
            if k in ("first", "family", "email"):
                sexes.setdefault((k, c), set()).add(g)
                attempt[k, c] = 0
    sex = {e: "m" if "m" in g and "f" not in g else "f" if "f" in g and "m" not in g else "u" for e, g in sexes.items()}
    spark_hash = {(r.kind, r.canon): r.h for r in _hashes(attempt)}
    while True:
        held = {}
        for e, a in attempt.items():
            held.setdefault((e[0], drawn(*e, sex[e], a).lower()), []).append(e)
        again = [e for (_, s), es in held.items() for e in es if e[1] == s or e != min(es, key=lambda e: (attempt[e], spark_hash[e], e[1]))]
        if not again:
            break
        for e in again:
            attempt[e] += 1
    new = lambda e: drawn(*e[:2], sex[e[:2]], attempt[e[:2]]) if e[0] in ("first", "family", "email") else number(*e[:2])
    cased = lambda w, s: s.upper() if len(w) > 1 and w == w.upper() else s

    def whole(m):
        es = entities(m)
        if kind_of(m) == "name":
            w, gaps = regex.split(S.GAP, m), regex.findall(S.GAP, m)
            return w[0] + "".join(g + cased(x, new(e)) for g, x, e in zip(gaps, w[1:], es))
        s = new(es[0])
        if kind_of(m) in ("phone", "card", "ssn"):
            it = iter(s)
            return "".join(next(it) if "0" <= c <= "9" else c for c in m)
        if kind_of(m) == "email":
            k = len(s) - len(m)
            return s[:k] + "".join(c.upper() if o.isupper() else c for c, o in zip(s[k:], m))
        return s

    def text(t):
        if not t:
            return t
        people = [m for m in matches(t) if kind_of(m) == "name"]
        names = {}
        for kind in ("first", "family"):  # a family name wins
            names |= {e[1]: new(e) for m in people for e in entities(m) if e[0] == kind}
        words = {x for m in people for w in regex.split(S.GAP, m)[1:3] for x in (w, w.upper())}
        out, at = [], 0
        bare = regex.compile(r"(?<!\p{L})(?:" + "|".join(sorted(words, reverse=True)) + r")(?!\p{L})") if words else None
        for m in [*regex.finditer(S.ANY, t), None]:
            piece = t[at : m.start() if m else None]
            out.append(bare.sub(lambda x: cased(x.group(), names[x.group().lower()]) if is_name(x.string, *x.span(), words) else x.group(), piece) if bare else piece)  # noqa: B023
            if m:
                out.append(whole(m.group()))
                at = m.end()
        return "".join(out)

    return [(d, text(t), len(matches(t))) for d, t in rows]


def _hashes(keys):
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    return s.createDataFrame(list(keys) or [("", "")], "kind string, canon string").withColumn("h", F.xxhash64("kind", "canon")).collect()


ROWS = [
    (1, "Dr Anna Smith met us. Mrs Anna Smith left. Anna Smith wrote; Smith said so. SMITH'S hat, Anna-Maria and Smithson"),
    (2, "Mr. John Smith and Mrs Smith; Госпожа Анна Иванова, потом Иванова"),
    (3, "call +1 (904) 555-1234 or 904-555-1234 or +49 30 1234567, card 4111 1111 1111 1111, 4111111111111111 or 4111 1111 1111 1112"),
    (3, "ssn 123-45-6789, ip 10.1.2.3 127.0.0.1 192.168.0.9 8.8.8.8 255.1.2.3, Mr JOHN SMITH"),
    (4, None),
    (None, ""),
    (6, "a.b@mail1.example.com A.B@MAIL1.example.com x@y.co y@y.co"),
    (7, "Prof. Sam O'Neil-Roth saw O'Neil-Roth, Sam and Mr Sam Brown; Mrs Brown Sam"),
    (8, "Herr Li Wu und Frau Wu Li: Li Wu, Wu Li, Li"),
    (9, " ".join(f"Mr Name{chr(97 + i // 26)}{chr(97 + i % 26)} Kin{chr(97 + i % 26)}" for i in range(300)).replace("Namea", "Na")),
    (10, "Mr Will Green came. Will you come? The Green party, Will and Will Green; die Green ist, so GREEN and Green. Green Will"),
    (11, "Mr  Smith, Ms.\tAnna  Smith\nNext line; Dr\nThe"),
    (12, "+1 (212) 555-0100 or (212) 555-0100, +44 (212) 555-0100, +1-212-555-0100, (030) 123-4567 or +49 30 1234567, (000) 000-0000"),
    (13, "Anna.Smith@Example.com anna.smith@example.com ANNA.SMITH@EXAMPLE.COM"),
]


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.n_entities) for r in df.collect()), key=repr)


def test_against_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for rows in (ROWS, docs):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert rows_of(S.rewrite(df, KEY)) == sorted(brute(rows), key=repr)
    again = S.drawn_again(spark.createDataFrame([e for _, t in ROWS for m in matches(t) for e in entities(m) if e[0] in ("first", "family", "email")], "kind string, canon string, gender string"), KEY)
    assert again.where("attempt > 0").count() > 50 and again.where("mixed").count() > 0


def test_large_maps_take_the_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_MAPS", 0)
    monkeypatch.setattr(S, "BROADCAST_ENTRIES", 0)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert rows_of(S.rewrite(df, KEY)) == sorted(brute(ROWS), key=repr)


def test_a_full_range_of_addresses(spark):
    n = F.col("doc_id")
    df = spark.range(65536).withColumnRenamed("id", "doc_id").withColumn("text", F.concat(F.lit("from 192.168."), F.floor(n / 256).cast("string"), F.lit("."), (n % 256).cast("string"), F.lit(" on")))
    out = S.rewrite(df, KEY).select("doc_id", F.col("text").alias("new")).join(df, "doc_id")
    same, distinct = out.agg(F.sum((F.col("new") == F.col("text")).cast("int")), F.count_distinct("new")).first()
    assert same == 0 and distinct == 65536 and out.where(~F.col("new").rlike(r"^from 192\.168\.\d+\.\d+ on$")).count() == 0


@pytest.mark.parametrize("size", [2, 3, 4])
def test_digits_are_a_bijection_without_fixed_points(spark, size):
    df = spark.range(10**size).select(F.lpad(F.col("id").cast("string"), size, "0").alias("c"))
    out = df.select("c", S.other_digits(KEY, F.lit("t"), F.col("c")).alias("o"))
    assert out.select("o").distinct().count() == 10**size and out.where("c = o").count() == 0


def test_key_and_odd_columns(spark):
    df = spark.createDataFrame([(*r, "a", 1, None) for r in ROWS], "doc_id long, text string, _known string, _found int, n_entities string")
    out = S.rewrite(df, KEY)
    assert out.columns == ["doc_id", "text", "_known", "_found", "n_entities"] and out.where("_known = 'a' and _found = 1").count() == len(ROWS)
    assert rows_of(out) == sorted(brute(ROWS), key=repr) != rows_of(S.rewrite(df, KEY + "."))
    assert S.rewrite(df.limit(0), KEY).count() == 0
    long = "Mr Long " + "word Long " * 200000 + "+1 904 555 1234"
    got = S.rewrite(spark.createDataFrame([(1, long)], "doc_id long, text string"), KEY).first()
    assert len(got.text) > 1 << 21 and "Long" not in got.text and got.n_entities == 2


def test_references_agree(spark):
    rows = [
        "+1 (212) 555-0100 or (212) 555-0100 or 212-555-0100, +49 (30) 123-4567 or (030) 123-4567",
        "Anna.Smith@Example.com or anna.smith@example.com",
        "Mr Will Green came. Will you come? The Green party met Green and Will Green.",
        "Mr  Jones and Jones",
    ]
    got = [r.text for r in S.rewrite(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    a, b, c, d, e = regex.findall(r"(?:\+\d+ )?(?:\(\d+\) |\d{3}-)\d{3}-\d{4}", got[0])
    tail = lambda x: regex.sub(r"\D", "", x)[-10:]
    assert a.startswith("+1 (") and tail(a) == tail(b) == tail(c) and d.startswith("+49 (") and e.startswith("(0") and tail(d)[-9:] == tail(e)[-9:]
    x, y = got[1].split(" or ")
    assert x.lower() == y and [ch.isupper() for ch in x] == [ch.isupper() for ch in "Anna.Smith@Example.com"] and y != "anna.smith@example.com"
    first, family = regex.match(r"Mr (\w+) (\w+) came\.", got[2]).groups()
    assert {first, family}.isdisjoint({"Will", "Green"}) and got[2].endswith(f" came. Will you come? The Green party met {family} and {first} {family}.")
    assert regex.fullmatch(r"Mr  (\w+) and \1", got[3]) and "Jones" not in got[3]
