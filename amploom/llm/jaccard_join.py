"""N-gram Jaccard join: every link between texts whose word-shingle sets reach a similarity, as components.

1. Each text becomes a sorted array of 64-bit shingle hashes. Texts with equal sets are one class.
2. A fixed-size table of hashed shingle counts orders shingles from rare to frequent. Two sets that link share
   a shingle among the first n - ceil(t n) + 1 of that order (any one order serves), so only these are keys.
3. Tiles: the classes that hold one key, banded by set size so that a tile only holds sizes that can link.
4. In a tile, hashed parity bitmaps bound the overlap from above: each bit in which two bitmaps differ is at
   least one shingle in one set only, so |A and B| <= (|A| + |B| - differing bits) / 2. A row of a tile carries a
   large bitmap folded in half (still a bound, as XOR can only hide differences), since a set is in many tiles; pairs
   that pass it meet the whole bitmaps, and what then passes is verified by intersecting the sorted arrays.

Large groups of near copies are joined up before the tiles: each class is first compared with one hub of each of
its keys (a linear number of pairs), and a tile then only compares classes that are not yet in one component; ``jaccard_links``
compares all of a tile's classes and returns the links. A tile of many rows is cut into blocks, and pairs of blocks are separate groups, so no task holds a whole tile.

Nulls and odd rows: a text that is null, empty or without words has an empty set and links with nothing; a null
doc_id is left out of links (its component_id is null); rows that repeat a doc_id are one document whose set is
that of the text with the smallest hash, and each of the rows is returned; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, by_ids, documents, in_arrow, join_classes, lowered, mix, runs, settle, shared_pairs, shingle_hashes, stream_groups, text_slices, word_hashes, word_spans
from .components import components

#: Counters of the shingle table: as many as the input has KB, between these bounds (4 bytes each on the wire).
LEAST_COUNTERS, MOST_COUNTERS = 1 << 18, 1 << 20
SLICES = 64
#: Bytes of text that one step makes sets of: their arrays take about 26 times as much.
SLICE = 1 << 20
#: Classes of one tile that are compared in one group.
BLOCK = 1024
#: A bitmap of more words than this is folded in half in a tile: one or two bits a shingle, of which unrelated sets differ in nearly half and
#: sets that are 80 % alike in 0.18 a shingle, against 0.17 at most of a link. In fewer bits chance lets too many pairs pass.
WHOLE_WORDS = 16


def _sets(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    buf = lowered(buf)
    starts, ends, at = word_spans(buf, offs)
    return shingle_hashes(word_hashes(buf, starts, ends), at, words)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def counters_for(docs: DataFrame) -> int:
    """A power of 2 that follows the optimiser's estimate of the input's size; it decides the order of shingles, never a result."""
    kb = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() - 10
    return 1 << min(max(kb, LEAST_COUNTERS.bit_length() - 1), MOST_COUNTERS.bit_length() - 1)


def set_table(docs: DataFrame, words: int, counters: int) -> DataFrame:
    """doc_id, n (set size), h1 and h2 (128 bits that stand for the set); and, in rows with a number k, a task's counts of a slice of the counters."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int32)
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch, limit=SLICE):
                h, at = _sets(buf, offs, words)
                total += np.bincount(_counter(h, counters), minlength=counters).astype(np.int32)
                n = np.diff(at)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)))]) for salt in (0x5BD1E995, 0x27D4EB2F165667C5)]
                h1, h2 = ((s[at[1:]] - s[at[:-1]]).astype(np.int64) for s in sums)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(h1), pa.array(h2), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names=["doc_id", "n", "h1", "h2", "k", "c"])
        none = pa.nulls(SLICES, pa.int64())
        yield pa.record_batch([none, none, none, none, pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], names=["doc_id", "n", "h1", "h2", "k", "c"])

    return in_arrow(_texts(docs), go, "doc_id long, n long, h1 long, h2 long, k int, c binary")


def _counter(h: np.ndarray, counters: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % counters


def shingle_counts(parts: DataFrame, counters: int) -> np.ndarray:
    """How many sets hold a shingle of each counter, over all documents: the tasks' counts added up, slice by slice."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("k").to_pylist(), b.column("c").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int32).astype(np.int64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["k", "c"])

    table = np.zeros((SLICES, counters // SLICES), np.int64)
    for k, c in in_arrow(parts.repartition("k"), add, "k int, c binary").collect():  # as many numbers as counters
        table[k] = np.frombuffer(bytes(c), np.int64)
    return table.ravel()


def _prefixes(h: np.ndarray, at: np.ndarray, counts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the text) of each set's prefix in the order rare to frequent."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, counts[_counter(h, len(counts))], doc))
    place = np.arange(len(h)) - at[:-1][doc]
    keep = place < (n - (t * n + 99) // 100 + 1)[doc]
    return h[order][keep], doc[keep]


def _spread(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.repartition(*cols).sortWithinPartitions(*cols)


def set_rows(docs: DataFrame, ids: DataFrame, one: DataFrame, repeated: DataFrame | None, words: int, arrays: bool) -> DataFrame:
    """(doc_id, n, data) of the named documents: the sorted array of the set, or its bitmap. One row a doc_id."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch, limit=SLICE):
                h, at = _sets(buf, offs, words)
                rows = [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                data = [x.tobytes() if arrays else bitmap(x, _bits(len(x))).tobytes() for x in rows]
                first = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5BD1E995)))])
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at)), pa.array((first[at[1:]] - first[at[:-1]]).astype(np.int64)), pa.array(data, pa.binary())], names=["doc_id", "n", "h1", "data"])

    schema = "doc_id long, n long, h1 long, data binary"
    wanted = by_ids(docs, ids, "doc_id", "left_semi")
    if repeated is None:
        return settle(in_arrow(wanted, go, schema).drop("h1"), "sets")
    single = in_arrow(by_ids(wanted, repeated, "doc_id", "left_anti"), go, schema)
    several = in_arrow(by_ids(wanted, repeated, "doc_id", "left_semi"), go, schema).join(one.select("doc_id", "h1"), ["doc_id", "h1"]).dropDuplicates(["doc_id"])
    return settle(single.drop("h1").unionByName(several.drop("h1")), "sets")


def _joined(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = lambda c, x: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("data").alias(x))
    return pairs.join(one("a", "x"), "a").join(one("b", "y"), "b").select("a", "b", "na", "nb", "x", "y")


def _kept(rows: DataFrame, both: Callable[[bytes, bytes, int], int], t: int) -> DataFrame:
    """The pairs whose overlap by ``both`` (of x, y and the sum of sizes) reaches the similarity."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).tolist()
            k = [both(x.as_py(), y.as_py(), n) for x, y, n in zip(batch.column("x"), batch.column("y"), total)]
            mask = pa.array([100 * c >= t * (n - c) for c, n in zip(k, total)], pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return in_arrow(rows, go, "a long, b long")


def _overlap(x: bytes, y: bytes, total: int) -> int:
    """The intersection of two sorted arrays."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(p) > len(q):
        p, q = q, p
    return int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)) if len(p) else 0


def _bound(x: bytes, y: bytes, total: int) -> int:
    """The most that two sets of these bitmaps can have in common."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    width = min(len(p), len(q))
    return (total - int(np.bitwise_count(_fold(p, width) ^ _fold(q, width)).sum())) // 2


def _bits(n: int) -> int:
    return 64 << max(0, (2 * n - 1).bit_length() - 6)


def bitmap(h: np.ndarray, bits: int) -> np.ndarray:
    """The parity bitmap of a set: each shingle flips one bit. A bitmap half as long is its two halves, one XOR the other."""
    if not len(h):
        return np.zeros(bits // 64, np.uint64)
    p = np.sort((h >> np.uint64(3)) & np.uint64(bits - 1))
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    odd = p[first[np.diff(np.append(first, len(p))) % 2 == 1]]
    flags = np.zeros(bits, np.uint8)
    flags[odd.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _fold(b: np.ndarray, words: int) -> np.ndarray:
    while len(b) > words:
        half = len(b) // 2
        b = b[:half] ^ b[half:]
    return b


def narrowed(maps: DataFrame) -> DataFrame:
    """(doc_id, bitmap): those of more than WHOLE_WORDS words folded in half."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("data")]
            yield pa.record_batch([batch.column("doc_id"), pa.array([_fold(x, len(x) // 2 if len(x) > WHOLE_WORDS else len(x)).tobytes() for x in wide], pa.binary())], names=["doc_id", "bitmap"])

    return in_arrow(maps.select("doc_id", "data"), go, "doc_id long, bitmap binary")


def _tile_pairs(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    keys = ["key", "band", "p", "q"]
    for table in stream_groups(batches, keys):
        cols = {c: table[c].to_numpy() for c in (*keys, "doc_id", "n", "label", "blk", "guest")}
        maps = [np.frombuffer(x, np.uint64) for x in table["bitmap"].to_pylist()]
        found = []
        edge = runs(*(cols[k] for k in keys))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo < 2:
                continue
            doc, n, label, blk, guest = (cols[c][lo:hi] for c in ("doc_id", "n", "label", "blk", "guest"))
            p, q = cols["p"][lo], cols["q"][lo]
            width = min(map(len, maps[lo:hi]))
            folded = np.stack([_fold(m, width) for m in maps[lo:hi]])
            for i in range(hi - lo - 1):
                j = slice(i + 1, hi - lo)
                total = n[i] + n[j]
                most = (total - np.bitwise_count(folded[j] ^ folded[i]).sum(axis=1, dtype=np.int64)) // 2
                ok = (label[j] != label[i]) & ~(guest[j] & guest[i]) & (100 * most >= t * (total - most))
                if p != q:
                    ok &= blk[j] != blk[i]
                for k in np.flatnonzero(ok).tolist():
                    found.append(tuple(sorted((int(doc[i]), int(doc[i + 1 + k])))))
        found = sorted(set(found))
        yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def _linked(docs: DataFrame, words: int, t: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Set sizes by row, sets by doc_id, classes of equal sets, and links between classes: enough for the components, or every one."""
    if not 50 <= t <= 100:
        raise ValueError("the similarity is 50 to 100 hundredths: a tile holds the sizes of one band and the next")
    spark = docs.sparkSession
    docs = _texts(docs)
    counters = counters_for(docs)
    made = settle(set_table(docs, words, counters), "sets")
    table = made.where("k is null").select("doc_id", "n", "h1", "h2")
    one = table.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n")).alias("s")).select("doc_id", "s.*")
    classes = settle(one.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes")
    counts = spark.sparkContext.broadcast(shingle_counts(made.where("k is not null").select("k", "c"), counters))

    # The keys that two classes share. Documents that stand for no class are left out, so that copies are not pairs.
    def keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _prefixes(*_sets(buf, offs, words), counts.value, t)

    others = one.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").select("doc_id")
    unique = by_ids(docs.where("doc_id is not null"), settle(others, "others"), "doc_id", "left_anti")
    buckets = bucket_count(spark, 6 * table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    tiles = settle(shared_pairs(unique, keys, buckets, limit=SLICE).withColumnRenamed("hash", "key").distinct(), "tiles")

    size = one.select("doc_id", "n")
    several = table.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select("doc_id")
    repeated = settle(several, "repeated")
    repeated = None if repeated.isEmpty() else repeated
    involved = settle(tiles.select("doc_id").distinct(), "involved")
    maps = set_rows(docs, involved, one, repeated, words, arrays=False)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs that the bitmaps let pass, those that link; only their sets are made."""
        pairs = settle(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        sets = set_rows(docs, settle(ids, "ids"), one, repeated, words, arrays=True)
        return settle(_kept(_joined(pairs, sets), _overlap, t), "links")

    # Hubs: of each key the class that shares most of its keys; a near copy's own changes are keys that nobody shares.
    weight = tiles.groupBy("doc_id").agg(F.count("*").alias("w")).join(size, "doc_id")
    weighed = tiles.join(weight, "doc_id")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("w", F.col("doc_id").alias("hub"), F.col("n").alias("hn"))).alias("m")).select("key", "m.hub", "m.hn")
    near = weighed.join(hubs, "key").where("doc_id <> hub").where(F.expr(f"100 * least(n, hn) >= {t} * greatest(n, hn)"))
    first = settle(near.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct(), "hubs")
    links = verified(_kept(_joined(first, maps), _bound, t))

    # Tiles that still hold more than one component, by size band and pair of blocks. For every link each class is its own.
    labelled = tiles.select("key", "doc_id").join(size, "doc_id")
    if every:
        labelled = labelled.withColumn("label", F.col("doc_id"))
    else:
        label = components(links).withColumnsRenamed({"id": "doc_id", "component": "label"})
        labelled = labelled.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / t))) + 1e-9).cast("int")
    members = labelled.join(mixed, "key").withColumn("own", band)
    members = settle(members.withColumn("x", F.explode(F.array(F.struct(F.col("own").alias("band"), F.lit(False).alias("guest")), F.struct((F.col("own") + 1).alias("band"), F.lit(True).alias("guest"))))).select("key", "doc_id", "n", "label", "x.*"), "members")
    sized = members.groupBy("key", "band").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("guest").alias("g")).where("c > 1 and lo < hi and not g")
    blocks = members.join(sized.select("key", "band", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb")), ["key", "band"]).withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("nb").cast("bigint")).cast("int"))
    dealt = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", "band", F.least("blk", "o").alias("p"), F.greatest("blk", "o").alias("q"), "blk", "doc_id", "n", "label", "guest")
    with_maps = dealt.join(narrowed(maps), "doc_id")
    passing = in_arrow(_spread(with_maps, ["key", "band", "p", "q"]), lambda b: _tile_pairs(b, t), "a long, b long").distinct()
    more = verified(_kept(_joined(passing.join(first, ["a", "b"], "left_anti"), maps), _bound, t))
    return table, one, classes, links.union(more)


def jaccard_links(docs: DataFrame, words: int = 4, t: int = 85) -> DataFrame:
    """a, b (a < b): every link between different sets, each set named by the smallest doc_id that has it. Links in a group of near copies grow with the square of its size."""
    return _linked(docs, words, t, every=True)[3]


def jaccard_join(docs: DataFrame, words: int = 4, t: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``. ``t``: the similarity in hundredths, at least 50."""
    table, one, classes, links = _linked(docs, words, t, every=False)
    joined = components(links).withColumnsRenamed({"id": "rep", "component": "top"})

    # A class learns its component before its documents learn theirs: a large class is one row there.
    placed = classes.join(joined, "rep", "left")
    own = join_classes(one.where("n > 0"), placed, ["h1", "h2", "n"], classes.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    own = own.unionByName(one.where("n = 0"), allowMissingColumns=True)
    part = own.select("doc_id", F.coalesce("top", "rep", "doc_id").alias("component_id"), F.col("n").alias("n_shingles"))
    return table.select("doc_id", "n").join(part, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", "n").alias("n_shingles"), "component_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


#: The same by definition: word-shingle sets, all links, smallest reachable id.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3])) end as sh from w),
c as (select min(doc_id) as rep, list_sort(sh) as sh, len(sh) as n from s where len(sh) > 0 group by list_sort(sh), len(sh)),
x as (select rep, n, unnest(sh) as g from c),
p as (select a.rep as a, b.rep as b, a.n as na, b.n as nb, count(*) as k from x a join x b on a.g = b.g and a.rep < b.rep
  where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2, 3, 4),
l as (select a, b from p where 100 * k >= 85 * (na + nb - k)),
e as (select a, b from l union all select b, a from l),
r as (select rep as id, rep as top from c union select e.b, r.top from r join e on e.a = r.id),
t as (select id, min(top) as top from r group by 1)
select s.doc_id, len(s.sh)::bigint as n_shingles, coalesce(t.top, s.doc_id) as component_id
from s left join c on c.sh = list_sort(s.sh) left join t on t.id = c.rep
"""

QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES = {"op3_jaccard_join": ORACLE}
