"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id.

Suffixes are only of interest for their first ``LENGTH`` bytes. They are dealt into buckets by content: the least
hash among the 16-byte strings inside a suffix's first 50 bytes, so equal 50-byte strings always meet, whatever
surrounds them. Consecutive suffixes with the same bucket hash form one run of text.

1. A hash that only one document has cannot hold a match. Each task reduces its hashes to two documents at most
   and deals them out; what comes back are the (document, hash) pairs that are shared.
2. The runs of shared hashes are dealt by hash. A task takes one bucket at a time and builds the suffix order of
   its distinct runs blockwise: suffixes are grouped by leading bytes, each block is sorted by 16 bytes, and
   longer ties are settled by the precomputed ranks of a difference-cover sample of period 16.
3. Neighbours in that order that agree in 50 bytes form classes; the smallest doc_id of a class keeps its bytes.

Memory is bounded by the bucket, whose number follows the input. A run that a smaller doc_id of the same task has is
removed there and then and sends no bytes, so a very common passage costs its bucket a few rows a task, not one a
document. Exact copies of a text are left out beforehand:
all bytes of a copy go if it has 50 or more, whatever the order says.

Nulls and odd rows: a null text is empty; a null doc_id ranks as the greatest one, 2**63 - 1, and documents with equal doc_id
never remove each other's bytes (rows that repeat a doc_id are one document each, judged against smaller ids: byte
ranges belong to a doc_id and a text, by ``row_key``); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, by_ids, documents, join_classes, mix, runs, settle, shared_pairs, stream_groups, text_slices

LENGTH = 50
GRAM = 16
PERIOD = 16
#: Suffixes sorted at a time, and rows of one step that settles ties.
BLOCK, PAIRS = 1 << 18, 1 << 20
#: Times that a run is in a slice for the task to remember it, and the runs that it remembers.
OFTEN, REMEMBERED = 16, 4096
_LAST = np.int64(2**63 - 1)


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo ``period`` is one of two of them."""
    cover, have = [0, 1], {0, 1, period - 1}
    while len(have) < period:
        best = max(range(period), key=lambda c: (len({(c - x) % period for x in cover} | {(x - c) % period for x in cover} | have), -c))
        have |= {(best - x) % period for x in cover} | {(x - best) % period for x in cover}
        cover.append(best)
    return sorted(cover)


def _words(text: np.ndarray, big: bool) -> np.ndarray:
    """The 8 bytes from each position as a number."""
    n = len(text) - 7
    view = np.ndarray((max(n, 0),), ">u8" if big else "<u8", buffer=text.tobytes(), strides=(1,))
    return view.astype(np.uint64)


def bucket_hashes(buf: np.ndarray) -> np.ndarray:
    """For each position with 50 bytes ahead, the least hash of the 16-byte strings in them."""
    if len(buf) < LENGTH:
        return np.zeros(0, np.uint64)
    w = _words(buf, False)
    h = mix(w[: len(buf) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) + mix(w[8:]))
    width, k = LENGTH - GRAM + 1, 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if k < width else h


def text_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, text, first suffix, last suffix) of each run of suffixes with one bucket hash; positions are in ``buf``."""
    low = bucket_hashes(buf)
    count = np.maximum(np.diff(offs) - LENGTH + 1, 0)
    if not count.sum():
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    doc = np.repeat(np.arange(len(count)), count)
    at = offs[:-1][doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    value = low[at]
    edge = runs(value, doc)
    return value[edge[:-1]], doc[edge[:-1]], at[edge[:-1]], at[edge[1:] - 1]


def _refine(text_words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of positions by ``depth`` bytes, and the number of the class of equals of each in that order."""
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    for step in range(0, depth, 8):
        key = text_words[at[order[todo]] + step]
        if depth - step < 8:
            key = key >> np.uint64(8 * (8 - (depth - step)))
        sub = np.lexsort((key, group[todo]))
        order[todo] = order[todo][sub]
        key = key[sub]
        new = np.zeros(len(order), bool)
        g = group[todo]
        new[todo[1:]] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        group = group + np.cumsum(new)
        size = np.bincount(group)
        todo = np.flatnonzero(size[group] > 1)
        if not len(todo):
            break
    return order, group


class CoverSample:
    """Ranks, by their first 50 bytes, of the suffixes at positions whose residue is in the difference cover."""

    def __init__(self, words: np.ndarray):
        cover = np.array(difference_cover(PERIOD))
        inside = np.zeros(PERIOD, bool)
        inside[cover] = True
        at = np.flatnonzero(inside[np.arange(len(words) - LENGTH - 8) % PERIOD])
        order, group = _refine(words, at, LENGTH)
        self.rank = np.zeros(len(words), np.int64)
        self.rank[at[order]] = group
        # for two residues the least distance that leads both into the cover
        self.delta = np.array([[min(d for d in range(PERIOD) if inside[(i + d) % PERIOD] and inside[(j + d) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)])

    def order(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of positions by group and, in a group, by their first 50 bytes, where positions of a group (which are side by side) agree in PERIOD bytes.

        Two positions are compared by the ranks of the sampled positions a common distance ahead of them, which
        depends on their residues only. So for each pair of residues in a group one sort by those ranks tells each
        position how many of the other residue are less; the sum over residues is its place.
        """
        phase = at % PERIOD
        have = np.unique(group * PERIOD + phase)
        lo, hi = np.searchsorted(have // PERIOD, group), np.searchsorted(have // PERIOD, group, "right")
        less = np.zeros(len(at), np.int64)
        upto = np.cumsum(hi - lo)
        start = 0
        while start < len(at):  # as many whole groups as make PAIRS rows, one at least
            stop = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right"))
            stop = int(np.searchsorted(group, group[max(stop - 1, start)], "left" if stop < len(at) and group[max(stop - 1, start)] != group[start] else "right"))
            one, nth = _spread(hi[start:stop] - lo[start:stop])
            one += start
            p, q = phase[one], have[lo[one] + nth] % PERIOD
            rank = self.rank[at[one] + self.delta[p, q]]
            key = (group[one] * PERIOD + np.minimum(p, q)) * PERIOD + np.maximum(p, q)
            sort = np.lexsort((rank, key))
            one, key, rank, upper, both = one[sort], key[sort], rank[sort], (p >= q)[sort], (p != q)[sort]
            before = np.concatenate([[0], np.cumsum(upper)])  # of the greater residue, or the only one
            first, tie = (edge[np.searchsorted(edge, np.arange(len(key)), "right") - 1] for edge in (runs(key)[:-1], runs(key, rank)[:-1]))
            greater = before[tie] - before[first]
            less += np.bincount(one, np.where(upper & both, tie - first - greater, greater), minlength=len(at)).astype(np.int64)
            start = stop
        return np.lexsort((less, group))


def suffix_order(words: np.ndarray, at: np.ndarray, sample: CoverSample) -> np.ndarray:
    """Positions ordered by their first 50 bytes (beyond that, in any order), one block of leading bytes at a time."""
    lead = (words[at] >> np.uint64(48)).astype(np.int64)
    by_lead = np.argsort(lead, kind="stable")
    edge = runs(lead[by_lead])
    out, lo = [], 0
    cuts = [0]
    for e in edge[1:].tolist():  # whole runs of leading bytes, as many as fit in a block
        if e - lo >= BLOCK:
            cuts.append(e)
            lo = e
    if cuts[-1] != len(at):
        cuts.append(len(at))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        block = at[by_lead[lo:hi]]
        order, group = _refine(words, block, PERIOD)
        block = block[order]
        tied = np.bincount(group)[group] > 1
        block[tied] = block[tied][sample.order(block[tied], group[tied])]
        out.append(block)
    return np.concatenate(out) if out else at


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many items: each item's row, and its place in it."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - (np.cumsum(size) - size)[row]


def earliest(data: np.ndarray, offs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place, document) of each 50-byte string in distinct runs of text: the smallest document that has the string.

    ``data`` and ``offs``: the runs side by side; ``docs``: the smallest document that has the run.
    """
    size = np.diff(offs)
    # Each run is laid so that its least 16-byte string stands at a multiple of the period: equal strings then have one phase.
    low = _words(data, False)
    gram = mix(low[:-8] * np.uint64(0x9E3779B97F4A7C15) + mix(low[8:]))
    row, place = _spread(size - GRAM + 1)
    flat = gram[offs[:-1][row] + place]
    least = np.minimum.reduceat(flat, np.flatnonzero(place == 0))
    hit = np.flatnonzero(flat == least[row])
    at_least = np.full(len(size), 1 << 40)
    at_least[row[hit][::-1]] = place[hit][::-1]
    shift = -at_least % PERIOD
    room = (shift + size + PERIOD - 1) // PERIOD * PERIOD
    begin = np.cumsum(room) - room + shift
    text = np.zeros(int(room.sum()) + 3 * LENGTH, np.uint8)
    row, place = _spread(size)
    text[begin[row] + place] = data
    words = _words(text, True)
    row, place = _spread(size - LENGTH + 1)
    at = begin[row] + place
    order = suffix_order(words, at, CoverSample(words))
    which = np.zeros(len(text), np.int32)
    which[at] = np.arange(len(at))
    w = which[order]
    same = np.ones(max(len(order) - 1, 0), bool)
    for step in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        col = words[order + step]
        same &= col[1:] == col[:-1]
    start = np.append(0, np.flatnonzero(~same) + 1)
    low_doc = np.minimum.reduceat(docs[row[w]], start)
    out = np.zeros(len(at), np.int64)
    out[w] = np.repeat(low_doc, np.diff(np.append(start, len(order))))
    return row, place, out


def _rows(**cols) -> pa.RecordBatch:
    return pa.record_batch(list(cols.values()), names=list(cols))


def shared_hashes(docs: DataFrame, buckets: int) -> DataFrame:
    """(row, hash) for every bucket hash that two texts have; a pair may come twice."""
    texts = docs.select(F.col("row").alias("doc_id"), "text")
    return shared_pairs(texts, lambda buf, offs: text_runs(buf, offs)[:2], buckets).withColumnRenamed("doc_id", "row")


def shared_runs(docs: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(bucket, doc_id, row, lo, hi, run): the runs of text under the shared hashes, and their byte range in the text.

    Where the task knows of a smaller doc_id with the run, the range goes whatever else is found: it has no run, and its bucket is any.
    """
    each = shared.groupBy("row").agg(F.collect_set("hash").alias("hashes"))
    rows = by_ids(docs, shared.select("row").distinct(), "row", "left_semi").join(each, "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}  # the smallest doc_id of runs that this task has met often
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            hashes = batch.column("hashes")
            for lo, hi, buf, offs in text_slices(batch):
                value, doc, a, b = text_runs(buf, offs)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                keep = np.zeros(len(value), bool)
                for i in range(hi - lo):
                    mine = hashes[lo + i].values.to_numpy().view(np.uint64)
                    keep[edge[i] : edge[i + 1]] = np.isin(value[edge[i] : edge[i + 1]], mine)
                value, doc, a, b = value[keep], doc[keep], a[keep], b[keep]
                size = b - a + LENGTH
                upto = np.concatenate([[0], np.cumsum(size)])
                flat = buf[np.repeat(a - upto[:-1], size) + np.arange(upto[-1])]
                run = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
                at, owner, key = a - offs[doc], ids[lo:hi][doc], keys[lo:hi][doc]
                code = run.dictionary_encode()
                k, distinct = code.indices.to_numpy(), code.dictionary
                low = np.full(len(distinct), _LAST)
                np.minimum.at(low, k, owner)
                if known:
                    low = np.minimum(low, np.array([known.get(x, _LAST) for x in distinct.to_pylist()], np.int64))
                if len(known) > REMEMBERED:
                    known.clear()
                for i in np.flatnonzero(np.bincount(k, minlength=len(distinct)) >= OFTEN).tolist():
                    known[distinct[i].as_py()] = int(low[i])
                gone = owner > low[k]
                bucket = np.where(gone, mix(key.view(np.uint64)), value) >> np.uint64(32)
                sent = pa.compute.if_else(pa.array(gone), pa.scalar(None, pa.binary()), run)
                yield _rows(bucket=pa.array((bucket % np.uint64(buckets)).astype(np.int64)), doc_id=pa.array(owner), row=pa.array(key), lo=pa.array(at), hi=pa.array(at + size), run=sent)

    return rows.select("doc_id", "row", "text", "hashes").mapInArrow(cut, "bucket long, doc_id long, row long, lo long, hi long, run binary")


def repeats(run_rows: DataFrame) -> DataFrame:
    """(row, lo, hi): byte ranges that go; ranges of one text may overlap."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stream_groups(batches, ["bucket"]):
            told = t.filter(t["run"].is_null())
            yield from told.select(["row", "lo", "hi"]).to_batches()
            t = t.filter(t["run"].is_valid())
            edge = runs(t["bucket"].to_numpy())
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                part = t.slice(lo, hi - lo)
                code = part["run"].combine_chunks().dictionary_encode()
                code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
                doc, key, start = part["doc_id"].to_numpy(), part["row"].to_numpy(), part["lo"].to_numpy()
                k, text = code.indices.to_numpy(), code.dictionary
                offs = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
                data = np.frombuffer(text.buffers()[2], np.uint8)[offs[0] : offs[-1]]
                offs -= offs[0]
                size = np.diff(offs)
                low = np.full(len(text), _LAST)
                np.minimum.at(low, k, doc)
                later = doc > low[k]
                row, place, before = earliest(data, offs, low)
                gone = before < low[row]
                row, place = row[gone], place[gone]
                edge_of = np.ones(len(row) + 1, bool)
                edge_of[1:-1] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
                e = np.flatnonzero(edge_of)
                span_row, span_lo, span_hi = row[e[:-1]], place[e[:-1]], place[e[1:] - 1] + LENGTH
                first = np.flatnonzero(~later)  # a text may hold a run several times
                n_of = np.bincount(span_row, minlength=len(size))
                upto = np.cumsum(n_of) - n_of
                one, nth = _spread(n_of[k[first]])
                pick = upto[k[first]][one] + nth
                r = np.concatenate([key[later], key[first][one]])
                a = np.concatenate([start[later], start[first][one] + span_lo[pick]])
                b = np.concatenate([start[later] + size[k[later]], start[first][one] + span_hi[pick]])
                yield _rows(row=pa.array(r), lo=pa.array(a), hi=pa.array(b))

    return run_rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort, "row long, lo long, hi long")


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def row_key(repeated: bool) -> Column:
    """What tells texts apart: doc_id, or a hash of doc_id and md5 if some doc_id has several texts."""
    return F.xxhash64("doc_id", "md5") if repeated else F.col("doc_id")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans (array of byte ranges lo, hi that go, in order) and copy (all goes as an exact copy): one row per row of ``docs``."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(F.coalesce(doc_id, F.lit(int(_LAST))).alias("doc_id"), doc_id.isNull().alias("unnamed"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = settle(docs.select("doc_id", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("md5")), "texts")
    total = ids.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    repeated = not ids.groupBy("doc_id").agg(F.min("md5").alias("a"), F.max("md5").alias("b")).where("a < b").isEmpty()
    long = ids.where(f"n_bytes >= {LENGTH}").withColumn("row", row_key(repeated))
    first = settle(long.groupBy("md5").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1"), "classes")
    held = first.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    copies = settle(join_classes(long, first, ["md5"], held).where("doc_id > rep").select("row").distinct(), "copies")
    marked = docs.withColumn("md5", F.md5("text")).withColumn("row", row_key(repeated)).drop("md5")
    unique = by_ids(marked.select("doc_id", "row", "text"), copies, "row", "left_anti")
    buckets = bucket_count(spark, total)
    shared = settle(shared_hashes(unique, buckets), "shared")
    # hashes that only rows of one doc_id share are candidates too; repeats compares doc_ids
    spans = repeats(shared_runs(unique, shared, buckets))
    return _apply(marked, copies, spans)


def _apply(marked: DataFrame, copies: DataFrame, spans: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    found = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).withColumn("copy", F.lit(False))
    marks = settle(found.unionByName(copies.select("row", none.alias("spans"), F.lit(True).alias("copy"))), "marks")
    doc_id = F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id")
    hit = marks.select("row")
    with_marks = by_ids(marked, hit, "row", "left_semi").join(marks, "row").select(doc_id, "text", "spans", "copy")
    return with_marks.unionByName(by_ids(marked, hit, "row", "left_anti").select(doc_id, "text", none.alias("spans"), F.lit(False).alias("copy")))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay): one row per row of ``docs``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copy, spans = batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("spans")
            for lo, hi, buf, offs in text_slices(batch):
                out = []
                for i in range(lo, hi):
                    text = buf[offs[i - lo] : offs[i - lo + 1]].tobytes()
                    gone = [(0, len(text))] if copy[i] else _merged(spans[i].as_py())
                    gone = [(a, min(b, len(text))) for a, b in gone if a < len(text)]
                    keep, at = [], 0
                    for a, b in gone:
                        keep.append(text[at:a])
                        at = b
                    keep = b"".join([*keep, text[at:]])
                    out.append((ids[i], len(text), len(text) - len(keep), len(gone), hashlib.sha256(keep).hexdigest(), keep))
                cols = list(zip(*out))
                yield _rows(doc_id=pa.array(cols[0], pa.int64()), n_bytes=pa.array(cols[1], pa.int64()), n_removed=pa.array(cols[2], pa.int64()), n_spans=pa.array(cols[3], pa.int64()), kept_sha256=pa.array(cols[4]), kept=pa.array(cols[5], pa.binary()))

    return removed(docs).mapInArrow(go, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("kept")


def brute(rows: list[tuple[int, str]]) -> dict[int, tuple]:
    """Every 50-byte string of every text in a dictionary: what tests compare with."""
    low: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - LENGTH + 1):
            s = b[i : i + LENGTH]
            low[s] = min(low.get(s, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - LENGTH + 1):
            if low[b[i : i + LENGTH]] < d:
                gone[i + 1 : i + 1 + LENGTH] = True
        keep = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out[d] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(keep).hexdigest())
    return out


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES: dict[str, str] = {}
