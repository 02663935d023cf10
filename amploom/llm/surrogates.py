"""PII: detected entities get keyed surrogates of their own type and format, in DataFrame functions only.

Entities are e-mail addresses, card numbers, telephone numbers, social security numbers, IPv4 addresses and names
after a title. The canonical form makes the same number in two formats, or a name with and without first name, one
entity, so references still agree; a first name is one entity whatever the title. A name that a document gives with a
title is replaced in the rest of that document too, where it stands alone (capitalised as there, or in capitals). Of
the words in ``COMMON``, which are names and everyday words, only those beside another of these names or within a
sentence and not after an article are taken for names. Names without a title anywhere in their document, or in lower case, stay.

Numbers: a keyed bijection of their own space (a Feistel network P, and P^-1(P(x) + shift)), so distinct numbers get
distinct surrogates by construction, however full the space is, and none stands for itself. A telephone number's country
code after a plus or zeros at its beginning, a card's first digit and whether its check digit is right, and an address's
private range stay; what follows the country code or zeros is one number, whichever of them it has.

Names and e-mail addresses: drawn by the keyed hash of type, canonical form and an attempt number, in their letter
case, script and the gender of the title. A first name's gender is settled over the corpus: by the titles that have
one, unless they differ. Collision check: over all documents the distinct entities are grouped by surrogate; of those
with one surrogate all but the first, and any that would stand for itself, draw again with the next attempt number,
which draws from a larger space each time. Entities with an attempt above 0, or with titles of several genders, are few;
they are looked up per document.

The hash is HMAC-SHA256 with the caller's key. The key is a literal of the plan: who can read plans can read it.

Nulls and odd rows: a null text stays null and has no entities; doc_id may be null or repeated, each row is
rewritten alone, equal entities alike; an empty table gives no rows; all other columns pass through, one named
n_entities is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, own_names, settle

#: The key of the query and the tests; real data needs one of its own.
TEST_KEY = "a key for tests"
#: Rounds of new draws; each draws from a space at least 26 times as large, and a rest is an error, not a silent clash.
ROUNDS = 20
#: Rounds of the Feistel network.
TURNS = 8
#: Documents and entities that a broadcast of attempts may hold.
BROADCAST_MAPS, BROADCAST_ENTRIES = 100_000, 500_000

# Titles by gender, and first names and syllables by script and gender.
TITLES = {"m": "Mr|Herr|Monsieur|Señor|Sr|Господин", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Госпожа", "u": "Dr|Prof|Mx"}
NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Quentin Robert Simon Theo Ulrich Victor Walter Xavier Yann Zeno".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Fiona Greta Helga Irene Julia Karin Laura Maria Nina Olga Paula Queenie Rosa Sara Tina Ursula Vera Wanda Xenia Yvonne Zoe".split(),
    ("latin", "u"): "Alex Robin Kim Sascha Jean Dominique Noel Sam Charlie Jamie Quinn Riley".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Григорий Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Пётр Роман Степан".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Марина Нина Ольга Полина Раиса Софья".split(),
    ("cyrillic", "u"): "Саша Женя Валя Паша Шура Слава".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ho ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va ve".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те то ва ве".split(),
}

# Names that are also everyday words, articles, and country codes of one and two digits (all others have three).
COMMON = "will may mark grace hope faith joy rose dawn grant bill jack art rich chase guy king young long short green brown white black gray grey wood stone hill bush love wise best day winter summer klein gross lang kurz weiß schwarz braun petit grand blanc roux rey".split()
ARTICLES = "the a an der die das ein eine le la les un une el los las una".split()
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

#: Space within a name; a new line ends it.
GAP = "[ \t\u00a0]{1,3}"
NAME = r"(?:" + "|".join(TITLES.values()) + rf")\.?{GAP}\p{{Lu}}[\p{{L}}'-]+(?:{GAP}\p{{Lu}}[\p{{L}}'-]+)?"
#: Java regexes in the order in which they are tried at a position.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.A-Za-z])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": r"(?<![\p{L}])" + NAME + r"(?![\p{L}])",
}
ANY = "|".join(f"(?:{x})" for x in KINDS.values())
#: What every entity has, so that other texts are not searched further.
HINT = r"[0-9@]|" + "|".join(TITLES.values())


def kind_of(s: Column) -> Column:
    """The kind of a match: the first whose regex is the whole of it."""
    return reduce(lambda rest, k: F.when(s.rlike("^(?:" + KINDS[k] + ")$"), F.lit(k)).otherwise(rest), reversed(list(KINDS)[:-1]), F.lit("name"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, evaluated once: a column used several times, or in a lambda, would be computed each time."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def hmac(key: str, *of: Column) -> Column:
    """HMAC-SHA256 in hexadecimal digits of the columns, joined by a control character."""
    from hashlib import sha256

    k = key.encode()
    k = (sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(c ^ pad for c in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(F.concat_ws("\x1f", *of), "UTF-8")), 256))), 256)


def _byte(h: Column, i: Column) -> Column:
    """Byte i of a hash, by 32 in turn."""
    return F.conv(F.substring(h, 1 + 2 * F.pmod(i, F.lit(32)), F.lit(2)), 16, 10).cast("int")


def _number(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def permuted(key: str, tweak: Column, a: Column, b: Column, m: Column, n: Column) -> Column:
    """struct<a, b> for a pair with a < m and b < n: a keyed bijection of all such pairs that leaves none where it is."""

    def turn(acc: Column, i: Column, sign: int) -> Column:
        f = lambda x: _number(hmac(key, tweak, m.cast("string"), n.cast("string"), i.cast("string"), x.cast("string")))
        even = i % 2 == 0
        return F.struct(F.when(even, F.pmod(acc["a"] + sign * f(acc["b"]), m)).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + sign * f(acc["a"]), n)).alias("b"))

    size = m * n
    shift = 1 + F.pmod(_number(hmac(key, tweak, m.cast("string"), n.cast("string"))), size - 1)
    there = F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda acc, i: turn(acc, i, 1))
    moved = _let(there, lambda p: _let((p["a"] * n + p["b"] + shift) % size, lambda v: F.struct(_div(v, n).alias("a"), (v % n).alias("b"))))
    return F.aggregate(F.sequence(F.lit(TURNS - 1), F.lit(0)), moved, lambda acc, i: turn(acc, i, -1))


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def other_digits(key: str, tweak: Column, digits: Column) -> Column:
    """A string of at least two digits replaced by another of its length."""
    n = F.length(digits)
    hi = F.floor(n / 2).cast("int")
    made = permuted(key, tweak, F.substring(digits, F.lit(1), hi), F.substring(digits, hi + 1, n), _ten(hi), _ten(n - hi))
    return _let(made, lambda p: F.concat(F.lpad(p["a"].cast("string"), hi, "0"), F.lpad(p["b"].cast("string"), n - hi, "0")))


def _luhn(d: Column) -> Column:
    """The sum that is a multiple of 10 for a valid card number."""
    worth = lambda c, i: F.when((F.length(d) - i) % 2 == 0, F.when(2 * c > 9, 2 * c - 9).otherwise(2 * c)).otherwise(c)
    return F.aggregate(F.transform(_chars(d), lambda c, i: worth(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def _check(stem: Column) -> Column:
    return F.pmod(-_luhn(F.concat(stem, F.lit("0"))), F.lit(10))


def other_card(key: str, d: Column) -> Column:
    """The digits between the first and the last are replaced; the last is as far from the right check digit as before."""
    off = F.pmod(F.substring(d, -1, 1).cast("int") - _check(F.substring(d, F.lit(1), F.length(d) - 1)), F.lit(10))
    stem = F.concat(F.substring(d, 1, 1), other_digits(key, F.concat(F.lit("card"), off.cast("string")), F.substring(d, F.lit(2), F.length(d) - 2)))
    return _let(stem, lambda s: F.concat(s, F.pmod(_check(s) + off, F.lit(10)).cast("string")))


#: First bytes of addresses whose whole range is public: these change too.
_PLAIN = [x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)]


def other_ip(key: str, s: Column) -> Column:
    """Within 10/8 and 127/8 three bytes change, within 169, 172, 192, 0 and 224 and above the last two; else all four, the first among the plain ones."""

    def of(p: Column) -> Column:
        byte = lambda i: F.get(p, F.lit(i))
        plain = F.array(*map(F.lit, _PLAIN))
        place = F.array_position(plain, byte(0)) - 1
        three, two = byte(0).isin(10, 127), byte(0).isin(169, 172, 192, 0) | (byte(0) >= 224)
        tweak = F.concat(F.lit("ip"), F.when(two, F.concat_ws(".", byte(0), byte(1))).when(three, byte(0).cast("string")).otherwise(""))
        a = F.when(two, byte(2)).when(three, byte(1)).otherwise(place * 256 + byte(1))
        b = F.when(two, byte(3)).otherwise(byte(2) * 256 + byte(3))
        made = permuted(key, tweak, a, b, F.when(two | three, 256).otherwise(256 * len(_PLAIN)).cast("long"), F.when(two, 256).otherwise(65536).cast("long"))
        high, low = (lambda x: _div(x["a"], F.lit(256)).cast("int")), (lambda x: F.concat_ws(".", _div(x["b"], F.lit(256)), x["b"] % 256))
        return _let(made, lambda x: F.when(two, F.concat_ws(".", byte(0), byte(1), x["a"], x["b"])).when(three, F.concat_ws(".", byte(0), x["a"], low(x))).otherwise(F.concat_ws(".", F.get(plain, high(x)), x["a"] % 256, low(x))))

    return _let(F.transform(F.split(s, r"\."), lambda x: x.cast("int")), of)


def _same_shape(s: Column, h: Column) -> Column:
    """``s`` with keyed letters for letters, in their case, and keyed digits for digits."""

    def one(c, i):
        b = _byte(h, i)
        return F.when(c.between("0", "9"), F.chr(48 + b % 10)).when(c.between("a", "z"), F.chr(97 + b % 26)).when(c.between("A", "Z"), F.chr(65 + b % 26)).otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def _refill(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced by ``digits``, in turn."""
    return F.array_join(F.transform(_chars(s), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(s, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _pick(values: list[str], h: Column, at: int) -> Column:
    table = F.array(*map(F.lit, values))
    return F.get(table, (_byte(h, F.lit(at)) * 256 + _byte(h, F.lit(at + 1))) % len(values))


def _made_up(script: str, h: Column, attempt: Column) -> Column:
    """A family name of three syllables, and one more for each further attempt."""
    table = F.array(*map(F.lit, SYLLABLES[script]))
    parts = F.transform(F.sequence(F.lit(0), 2 + attempt), lambda i: F.get(table, _byte(h, 8 + i) % len(SYLLABLES[script])))
    return F.initcap(F.array_join(parts, ""))


def gender(s: Column) -> Column:
    return F.when(s.rlike(f"^(?:{TITLES['m']})\\b"), "m").when(s.rlike(f"^(?:{TITLES['f']})\\b"), "f").otherwise("u")


def parts_of(s: Column) -> Column:
    """The entities in a match: array<struct<kind, canon, gender>>. A name has a family name and maybe a first name, each an entity."""
    kind = kind_of(s)
    words = F.split(s, GAP)
    low = lambda i: F.lower(F.get(words, F.lit(i)))
    one = lambda k, c, g="u": F.struct(k.alias("kind"), c.alias("canon"), (g if isinstance(g, Column) else F.lit(g)).alias("gender"))
    name = F.when(F.size(words) > 2, F.array(one(F.lit("first"), low(1), gender(s)), one(F.lit("family"), low(2)))).otherwise(F.array(one(F.lit("family"), low(1))))
    # A telephone number is its country code or zeros, a colon, and the rest.
    head = F.when(s.startswith("+"), F.regexp_extract(_digits(s), f"^(?:{COUNTRY})", 0)).otherwise(F.regexp_extract(_digits(s), "^0*(?=[0-9]{2})", 0))
    phone = F.concat(head, F.lit(":"), F.substring(_digits(s), F.length(head) + 1, F.length(s)))
    canon = F.when(kind == "email", F.lower(s)).when(kind == "ip", s).when(kind == "phone", phone).otherwise(_digits(s))
    return F.when(kind == "name", name).otherwise(F.array(one(kind, canon)))


def drawn(key: str, kind: Column, canon: Column, sex: Column, attempt: Column) -> Column:
    """The surrogate of a name or e-mail address; each further attempt is longer than the one before."""

    def of(h: Column) -> Column:
        tld = F.substring_index(canon, ".", -1)
        more = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i > 0, F.chr(97 + _byte(h, 31 - i) % 26)).otherwise("")), "")
        email = F.concat(more, _same_shape(F.substring(canon, F.lit(1), F.length(canon) - F.length(tld)), h), tld)
        cyr = canon.rlike(r"\p{IsCyrillic}")
        names = F.lit(None).cast("string")
        for (script, s), values in NAMES.items():
            longer = F.when(attempt > 0, F.lower(_made_up(script, h, attempt))).otherwise(F.lit(""))
            names = F.when((sex == s) & (cyr == (script == "cyrillic")), F.concat(_pick(values, h, 0), longer)).otherwise(names)
        family = F.when(cyr, _made_up("cyrillic", h, attempt)).otherwise(_made_up("latin", h, attempt))
        return F.when(kind == "email", email).when(kind == "family", family).otherwise(names)

    return _let(hmac(key, kind, canon, attempt.cast("string")), of)


def surrogate(key: str, kind: Column, canon: Column, sex: Column, attempt: Column) -> Column:
    """The canonical surrogate of an entity: for numbers the digits, for names the capitalised word."""
    rest = F.substring_index(canon, ":", -1)
    digits = F.concat(F.substring(canon, F.lit(1), F.length(canon) - F.length(rest) - 1), other_digits(key, kind, rest))
    return F.when(kind == "card", other_card(key, canon)).when(kind == "ip", other_ip(key, canon)).when(kind.isin("phone", "ssn"), digits).otherwise(drawn(key, kind, canon, sex, attempt))


def drawn_again(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, gender, attempt, mixed) of the names and addresses that a document's own matches don't settle: with an attempt above 0, or with titles of several genders.

    ``entities``: rows (kind, canon, gender). Of those that hold one surrogate the first (the lowest attempt, then the
    least hash) keeps it; the others draw again, until each surrogate is held once.
    """
    has = lambda g: F.max(F.col("gender") == g)
    sex = F.when(has("m") & ~has("f"), "m").when(has("f") & ~has("m"), "f").otherwise("u")
    mixed = F.min("gender") != F.max("gender")
    once = entities.groupBy("kind", "canon").agg(sex.alias("gender"), mixed.alias("mixed"))
    draw = lambda df: settle(df.withColumn("s", F.lower(drawn(key, F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt")))), "entities")
    spread = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = draw(once.withColumn("attempt", F.lit(0)).repartition(spread, "kind", "canon"))
    for _ in range(ROUNDS):
        order = F.struct("attempt", F.xxhash64("kind", "canon").alias("h"), "canon")
        # one winner a surrogate by an aggregate: a very common surrogate is reduced before the shuffle
        held = known.groupBy("kind", "s").agg(F.min(order).alias("w"), F.count("*").alias("c")).where("c > 1").select("kind", "s", F.col("w.canon").alias("winner"))
        clash = known.join(held, ["kind", "s"], "left").where((F.col("winner") != F.col("canon")) | (F.col("s") == F.col("canon")))
        losers = settle(clash.select("kind", "canon", "gender", "mixed", (F.col("attempt") + 1).alias("attempt")), "again")
        if losers.isEmpty():
            return known.where("attempt > 0 or mixed").drop("s")
        stay = known.join(losers.select("kind", "canon"), ["kind", "canon"], "left_anti")
        known = settle(stay.unionByName(draw(losers.repartition(spread, "kind", "canon"))), "entities")
    raise RuntimeError("surrogates still clash")


def found(text: Column) -> Column:
    """All matches in a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _settled(key: str, e: Column, known: Column) -> Column:
    """An entity's surrogate; ``known``: map from kind and canonical form to attempt and gender, for those drawn again."""
    return _let(F.element_at(known, F.concat_ws("\x1f", e["kind"], e["canon"])), lambda x: surrogate(key, e["kind"], e["canon"], F.coalesce(x["gender"], e["gender"]), F.coalesce(x["attempt"], F.lit(0))))


def _cased(word: Column, new: Column) -> Column:
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(new)).otherwise(new)


def _cased_as(match: Column, new: Column) -> Column:
    """``new`` with capitals where ``match`` has them; a longer one has more letters at its beginning."""
    more = F.length(new) - F.length(match)
    return F.array_join(F.transform(_chars(new), lambda c, i: F.when((i >= more) & F.substring(match, i - more + 1, F.lit(1)).between("A", "Z"), F.upper(c)).otherwise(c)), "")


def replaced(key: str, match: Column, known: Column) -> Column:
    """A match rewritten: its entities' surrogates in its own format."""
    kind = kind_of(match)

    def of(subs: Column) -> Column:
        one = F.get(subs, F.lit(0))
        words, gaps = F.split(match, GAP), F.regexp_extract_all(match, F.lit(GAP), F.lit(0))
        name = F.concat(F.get(words, F.lit(0)), F.array_join(F.transform(subs, lambda s, i: F.concat(F.get(gaps, i), _cased(F.get(words, i + 1), s))), ""))
        email = F.when(match.rlike("[A-Z]"), _cased_as(match, one)).otherwise(one)
        return F.when(kind == "name", name).when(kind.isin("phone", "card", "ssn"), _refill(match, one)).when(kind == "email", email).otherwise(one)

    return _let(F.transform(parts_of(match), lambda e: _settled(key, e, known)), of)


def _woven(pieces: Column, subs: Column) -> Column:
    return F.array_join(F.flatten(F.zip_with(pieces, F.concat(subs, F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")


def _rewritten(key: str, text: Column, matches: Column, known: Column) -> Column:
    """The text with its matches replaced, and the names among them wherever else they stand."""
    people = F.filter(matches, lambda m: m.rlike("^" + NAME + "$"))
    words = F.array_distinct(F.flatten(F.transform(people, lambda m: F.slice(F.split(m, GAP), F.lit(2), F.lit(2)))))
    both = F.sort_array(F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w))))), asc=False)  # a longer name before its own beginning
    article = "|".join(x for a in ARTICLES for x in (a, a.capitalize()))
    inside = F.lit(rf"(?<=[\p{{L}}\p{{N}},;:)][ \t\u00a0\n])(?<!(?<![\p{{L}}])(?:{article})[ \t\u00a0\n])")

    def one_of(all_names: Column) -> Column:
        beside = F.concat(F.lit(r"|(?<=(?<![\p{L}])(?:"), all_names, F.lit(")[ \t\u00a0])|"))
        common = lambda w: F.concat(F.lit("(?:"), inside, beside, F.lit("(?="), w, F.lit(GAP), F.lit("(?:"), all_names, F.lit(r")(?![\p{L}])))"), w)
        return F.array_join(F.transform(both, lambda w: F.when(F.lower(w).isin(COMMON), common(w)).otherwise(w)), "|")

    pattern = F.concat(F.lit(r"(?<![\p{L}])(?:"), _let(F.array_join(both, "|"), one_of), F.lit(r")(?![\p{L}])"))

    def bare(p: Column, names: Column, pat: Column) -> Column:
        new = lambda w: _cased(w, F.element_at(names, F.lower(w)))
        return F.when(F.rlike(p, pat), _woven(F.split(p, pat, -1), F.transform(F.regexp_extract_all(p, pat, F.lit(0)), new))).otherwise(p)

    # A word that is a first and a family name stands for the family where it is alone.
    parts = F.array_distinct(F.flatten(F.transform(people, parts_of)))
    family = F.transform(F.filter(parts, lambda e: e["kind"] == "family"), lambda e: e["canon"])
    ones = _let(family, lambda fam: F.filter(parts, lambda e: (e["kind"] == "family") | ~F.array_contains(fam, e["canon"])))
    entries = F.transform(ones, lambda e: F.struct(e["canon"].alias("k"), _settled(key, e, known).alias("v")))
    names = F.map_from_entries(F.array_distinct(entries))  # titles of several genders are settled alike
    pieces = F.split(text, ANY, -1)
    others = F.when(F.size(people) > 0, _let(F.struct(names.alias("n"), pattern.alias("p")), lambda x: F.transform(pieces, lambda p: bare(p, x["n"], x["p"])))).otherwise(pieces)
    return _woven(others, F.transform(matches, lambda m: replaced(key, m, known)))


def rewrite(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in text, and n_entities."""
    docs = docs.drop("n_entities")
    mine = own_names(docs, "found", "key", "known")
    matches = docs.withColumn(mine["found"], found(F.col("text")))
    has = F.size(mine["found"]) > 0
    row = F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))
    # Only names and e-mail addresses are drawn; their distinct forms are few beside the texts.
    drawn_parts = F.array_distinct(F.filter(F.flatten(F.transform(mine["found"], parts_of)), lambda e: e["kind"].isin("first", "family", "email")))
    listed = settle(matches.where(has).select(row.alias("key"), drawn_parts.alias("parts")).where("size(parts) > 0"), "matches")
    again = settle(drawn_again(listed.select(F.explode("parts").alias("e")).select("e.*").distinct(), key), "again")
    lookup = F.col(mine["found"])
    if again.isEmpty():
        return _finish(matches.withColumn(mine["known"], F.lit(None).cast("map<string,struct<attempt:int,gender:string>>")), mine, key, lookup)
    spots = listed.select("key", F.explode("parts").alias("e")).select("key", "e.kind", "e.canon").distinct()
    entry = F.struct(F.concat_ws("\x1f", "kind", "canon").alias("k"), F.struct("attempt", "gender").alias("v"))
    few = again.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    maps = settle(spots.join(F.broadcast(again) if few else again, ["kind", "canon"]).groupBy("key").agg(F.map_from_entries(F.collect_list(entry)).alias("known")), "attempts")
    rows, entries = maps.agg(F.count("*"), F.coalesce(F.sum(F.size("known")), F.lit(0))).first()
    maps = maps.withColumnsRenamed({"key": mine["key"], "known": mine["known"]})
    keyed = matches.withColumn(mine["key"], F.when(has, row))
    if rows <= BROADCAST_MAPS and entries <= BROADCAST_ENTRIES:
        return _finish(keyed.join(F.broadcast(maps), mine["key"], "left"), mine, key, lookup)
    # Texts without an entity are not shuffled, whose null keys would all go to one task.
    none = F.lit(None).cast(maps.schema[mine["known"]].dataType)
    joined = _finish(keyed.where(has).join(maps, mine["key"], "left"), mine, key, lookup)
    return joined.unionByName(_finish(keyed.where(~has).withColumn(mine["known"], none), mine, key, lookup))


def _finish(rows: DataFrame, mine: dict[str, str], key: str, matches: Column) -> DataFrame:
    new = F.when(F.size(matches) > 0, _rewritten(key, F.col("text"), matches, F.col(mine["known"]))).otherwise(F.col("text"))
    counted = rows.withColumns({"text": new, "n_entities": F.size(matches).cast("long")})
    return counted.drop(*mine.values())


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite(documents(spark, sf_dir).select("doc_id", "text"), TEST_KEY)


QUERIES = {"op10_surrogates": op10_surrogates}
ORACLES: dict[str, str] = {}
