"""Source divergence audit: how differently the sources of a language use its words, in exact integers.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A language keeps the V terms in at least
``LEAST_DOCS`` of its documents. A group, a source of a language or the language itself, gives a kept term that occurs ``count`` times in
it p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being its kept terms' occurrences. Two sources differ by the sum of
abs(p - q) over all kept terms.

That sum is split. Terms in more than ``HEAVY`` sources of their language are dense: a tile of ``TILE`` terms by
``BLOCK`` sources is a numpy matrix, absent terms included, and each pair of blocks adds up its rows' differences. The
others are sparse. With z the value of an absent term, a light term adds abs(z_s - z_t), whoever has it; each
posting (s, term) corrects that for all t by abs(p - z_t) - abs(z_s - z_t), which a sorted histogram of s's values
gives for all t at once, and each pair of postings of one term corrects the two corrections. All parts are integers, so their sum is exact.

Words are counted in tasks before the shuffle, so a very common word is a row a task and source. A term's postings are
collected only if at most HEAVY or BLOCK of them can meet. Result and work on pairs grow with the square of a language's sources.

Nulls and odd rows: a null text, lang or source is ''; rows that repeat a doc_id are documents of their own; a source without
terms is a group whose counts are 0; a language without kept terms has pairs of value 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, in_arrow, lowered, settle, stream_groups, text_slices, word_array, word_spans

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Sources of a language beyond which a term is dense.
HEAVY = 8
#: Terms and sources of a dense tile.
TILE, BLOCK = 128, 128
#: Groups that a broadcast may hold (a row of some 100 bytes each), and beyond it the tasks that share a group's rows.
BROADCAST_GROUPS, SALTS = 100_000, 64
#: Bytes of text whose counts a task holds before it hands them on.
FLUSH = 32 << 20

_GAP = np.ones(256, bool)
_GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def term_counts(docs: DataFrame, flush: int = FLUSH) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by task, any number of rows a key; each group has a row for the term '' too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held: list[pa.Table] = []
        size = 0

        def add(buf: np.ndarray, offs: np.ndarray, group: np.ndarray) -> None:
            starts, ends, at = word_spans(buf, offs, _GAP)
            words = word_array(buf, starts, ends, _GAP).dictionary_encode()
            doc = np.repeat(np.arange(len(group)), np.diff(at))
            code = words.indices.to_numpy().astype(np.int64)
            width = max(len(words.dictionary), 1)
            each, n = np.unique(doc * width + code, return_counts=True)  # terms of a document
            key, inverse = np.unique(group[each // width] * width + each % width, return_inverse=True)
            held.append(pa.table([pa.array(key // width), words.dictionary.take(pa.array(key % width)), pa.array(np.bincount(inverse, n, len(key)).astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(key)).astype(np.int64))], names=["g", "term", "n", "docs"]))

        def out() -> Iterator[pa.RecordBatch]:
            names = list(groups)
            t = pa.concat_tables(held).group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            g = t["g"].combine_chunks()
            for i, of in enumerate(("lang", "source")):
                t = t.append_column(of, pa.array([x[i] for x in names], pa.string()).take(g))
            cols = [t["lang"], t["source"], t["term"].cast(pa.string()), t["n_sum"], t["docs_sum"]]
            yield from pa.table(cols, names=["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=1 << 16)
            held.clear()

        for b in batches:
            langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
            group = np.array([groups.setdefault(k, len(groups)) for k in zip(langs, sources)], np.int64)
            for lo, hi, buf, offs in text_slices(b):
                add(lowered(buf), offs, group[lo:hi])
                size += len(buf)
                if size >= flush:
                    yield from out()
                    size = 0
        if held:
            yield from out()
        if groups:
            lang, source = zip(*groups)
            none = pa.array(np.zeros(len(groups), np.int64))
            yield pa.record_batch([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([""] * len(groups)), none, none], names=["lang", "source", "term", "n", "docs"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return in_arrow(docs.select(empty("lang"), empty("source"), empty("text")), count, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)), in decimals as the product may pass 64 bits; null if nothing is kept."""
    top, low = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total + terms * PRIOR
    return F.when(low > 0, F.call_function("div", top, low.cast("decimal(20,0)")) + 1)


def _tiles(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Sums of absolute differences of dense tiles: rows (lang, tile, a, b, side, term, z, idx, p) sorted by the first six; each side's first row has its sources' z, the others a term's sources and values."""
    of = ["lang", "tile", "a", "b"]
    for t in stream_groups(batches, of):
        cols = {c: t[c].to_pylist() for c in (*of, "side", "z", "idx", "p")}
        edge = [i for i in range(t.num_rows) if not i or any(cols[c][i] != cols[c][i - 1] for c in of)] + [t.num_rows]
        for lo, hi in zip(edge[:-1], edge[1:]):
            rows: list[list[np.ndarray]] = [[], []]
            none = [np.zeros(0, np.int64)] * 2
            for i in range(lo, hi):
                side = cols["side"][i]
                if cols["z"][i] is not None:
                    none[side] = np.array(cols["z"][i], np.int64)
                    continue
                v = none[side].copy()
                v[np.array(cols["idx"][i] or [], np.int64) % block] = cols["p"][i] or []
                rows[side].append(v)
            a, b = cols["a"][lo], cols["b"][lo]
            left = np.stack(rows[0], axis=1) if rows[0] else np.zeros((len(none[0]), 0), np.int64)
            right = left if a == b else np.stack(rows[1], axis=1) if rows[1] else np.zeros((len(none[1]), 0), np.int64)
            sums = np.stack([np.abs(right - x).sum(axis=1) for x in left])
            s, u = np.indices(sums.shape)
            s, u = s + a * block, u + b * block
            keep = s < u
            yield pa.record_batch([pa.array([cols["lang"][lo]] * int(keep.sum()), pa.string()), pa.array(s[keep]), pa.array(u[keep]), pa.array(sums[keep])], names=["lang", "s", "t", "value"])


def _against(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """For each source and block of sources: its light terms' values against the sources' values of absent terms."""
    for batch in batches:
        for r in batch.to_pylist():
            z, n = np.array(r["zs"], np.int64), len(r["zs"])
            p = np.array([x["p"] for x in r["hist"] or []], np.int64)
            m = np.array([x["m"] for x in r["hist"] or []], np.int64)
            order = np.argsort(p)
            p, m = p[order], m[order]
            count, mass = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(m * p)])
            k = np.searchsorted(p, z)
            above = (mass[-1] - mass[k]) - z * (count[-1] - count[k])
            apart = np.abs(z - (r["z"] or 0))
            total = above + z * count[k] - mass[k] - count[-1] * apart
            # a pair's common part is added once, by its smaller source
            t = np.arange(n) + r["block"] * block
            total += np.where(t > r["s"], (r["light"] or 0) * apart, 0)
            keep = t != r["s"]
            s = np.full(n, r["s"])
            yield pa.record_batch([pa.array([r["lang"]] * int(keep.sum()), pa.string()), pa.array(np.minimum(s, t)[keep]), pa.array(np.maximum(s, t)[keep]), pa.array(total[keep])], names=["lang", "s", "t", "value"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, heavy: int = HEAVY, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language, part ``term`` the ``top`` terms that a source has more of than its language."""
    dealt = settle(term_counts(docs), "counts")
    # Dealt by (lang, term) once: sums by source, and over them those of the language and the number of sources, need no other shuffle.
    by_source = dealt.where("term <> ''").repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    summed = by_source.select("lang", "term", "source", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("ln"), F.count("*").over(of_term).alias("sources"))
    posts = settle(summed.where(F.col("docs") >= least_docs).drop("docs"), "postings")
    kept = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = posts.select("lang", "term", "sources", "ln").distinct()
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("ln").alias("lang_total"), F.count_if(F.col("sources") <= heavy).alias("light"), F.count_if(F.col("sources") > heavy).alias("dense"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = dealt.where("term = ''").select("lang", "source").distinct().join(kept, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *map(none, ("total", "v", "lang_total", "light", "dense"))).withColumn("z", F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(0).cast("long")))
    groups = settle(groups.withColumn("s", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long")), "groups")  # a row a source
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS

    def near(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
        """Join to a table with a row a group or fewer: sent to every task if it has few rows, else to SALTS tasks a key, which share the key's rows."""
        if small:
            return rows.join(F.broadcast(table), keys)
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS))).join(salted, [*keys, "salt"]).drop("salt")

    valued = near(posts, groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", share(F.col("ln"), F.col("lang_total"), F.col("v")))
    more = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = more.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    in_block = F.floor(F.col("s") / block).alias("block")
    whole = W.partitionBy("lang")
    blocks = groups.groupBy("lang", in_block).agg(F.array_sort(F.collect_list(F.struct("s", "z"))).alias("x"), F.max("dense").alias("dense"))
    blocks = blocks.select("lang", "block", F.transform("x", lambda v: v["z"]).alias("z"), F.ceil(F.col("dense") / tile).alias("tiles"), F.max("block").over(whole).alias("last"))
    # dense terms: their postings by block of sources, and every pair of blocks
    dense_terms = terms.where(F.col("sources") > heavy).select("lang", "term")
    packed = valued.where(F.col("sources") > heavy).groupBy("lang", "term", in_block).agg(F.collect_list(F.struct("s", "p")).alias("e"))  # at most a block of them
    everywhere = near(dense_terms, blocks.select("lang", "block", "tiles", "last"), ["lang"]).join(packed, ["lang", "term", "block"], "left")
    of_terms = everywhere.select("lang", "block", "last", F.pmod(F.xxhash64("term"), "tiles").alias("tile"), "term", F.lit(None).cast("array<long>").alias("z"), F.col("e.s").alias("idx"), F.col("e.p").alias("p"))
    of_blocks = blocks.where("tiles > 0").select("lang", "block", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.lit("").alias("term"), "z", F.lit(None).cast("array<long>").alias("idx"), F.lit(None).cast("array<long>").alias("p"))
    spread = of_terms.unionByName(of_blocks).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    rows = spread.select("lang", "tile", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") > F.col("other")).cast("int").alias("side"), "term", "z", "idx", "p")
    dense = rows.repartition("lang", "tile", "a", "b").sortWithinPartitions("lang", "tile", "a", "b", "side", "term").mapInArrow(lambda x: _tiles(x, block), "lang string, s long, t long, value long")

    # light terms: a histogram of each source's values against all others' value of an absent term, and pairs of postings
    light = valued.where(F.col("sources") <= heavy)
    hist = light.groupBy("lang", "s", "p").agg(F.count("*").alias("m")).groupBy("lang", "s").agg(F.collect_list(F.struct("p", "m")).alias("hist"))  # an entry a count
    one = groups.select("lang", "s", "z", "light").join(hist, ["lang", "s"], "left").join(blocks.select("lang", "block", F.col("z").alias("zs")), "lang")
    alone = one.mapInArrow(lambda x: _against(x, block), "lang string, s long, t long, value long")
    few = light.where("sources > 1").groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("s", "p", "z"))).alias("e"))  # at most HEAVY of them
    first_of = few.select("lang", "e", F.posexplode("e").alias("i", "x"))
    two = first_of.select("lang", "x", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("y"))
    apart = lambda u, w: F.abs(F.col(u) - F.col(w))
    both = two.select("lang", F.col("x.s").alias("s"), F.col("y.s").alias("t"), (apart("x.p", "y.p") + apart("x.z", "y.z") - apart("x.p", "y.z") - apart("y.p", "x.z")).alias("value"))

    pairs = dense.unionByName(alone).unionByName(both).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    each = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("s").alias("me"), F.col("t").alias("you")), F.struct(F.col("t").alias("me"), F.col("s").alias("you")))).alias("x")).select("lang", "value", "x.me", "x.you")
    names = groups.select("lang", "s", "source")
    named = each.join(names.withColumnRenamed("s", "me"), ["lang", "me"]).join(names.withColumnsRenamed({"s": "you", "source": "item"}), ["lang", "you"])
    apart_pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return apart_pairs.unionByName(first).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir).select("lang", "source", "text"))


ORACLE = r"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as l from documents),
w as (select row, lang, source, unnest(l) as term from d),
k as (select lang, term from w group by 1, 2 having count(distinct row) >= 30),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by 1, 2, 3),
v as (select lang, count(*) as v from k group by 1),
g as (select d.lang, d.source, coalesce(any_value(t.total), 0) as total, coalesce(any_value(v.v), 0) as v from (select distinct lang, source from d) d left join (select lang, source, sum(n) as total from c group by 1, 2) t using (lang, source) left join v on v.lang = d.lang group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v)::hugeint)::bigint as p from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select lang, sum(n) as total, count(distinct term) as v from c group by 1),
q as (select c.lang, c.term, (1 + (1000000000::hugeint * (sum(c.n) + 5)) // (any_value(s.total) + 5 * any_value(s.v))::hugeint)::bigint as q from c join s using (lang) group by 1, 2),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from x)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 50
"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {"op13_source_divergence": ORACLE}
