"""What the operators share: the folder all machines see, Arrow slices of bounded size, words as numpy arrays.

Nothing here keeps state on a machine: tables that cut lineage go to the folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
SLICE_BYTES = 4 << 20
#: Ids that a broadcast may hold (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Entries of a row of pairs that need no meeting.
SURE_ROW = 4096
#: A class with more than this part of the rows is hot.
HOT = 1000
#: Rows and bytes of an Arrow batch of texts; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

_own_dir: list[str] = []
#: Paths that ``scratch`` gave since the innermost ``tidied`` began.
_given: ContextVar[list[str] | None] = ContextVar("given", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:  # a path without a scheme is of the default file system, not of whoever opens it
        at = spark._jvm.org.apache.hadoop.fs.Path(base)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="amploom-"))
    return _own_dir[0]


def scratch(spark: SparkSession, what: str = "table") -> str:
    path = f"{shared_dir(spark)}/amploom-{what}-{uuid.uuid4().hex}"
    if (given := _given.get()) is not None:
        given.append(path)
    return path


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """At its end, also after an error, the tables that operators wrote inside are deleted from the shared folder.

    A result is computed from them when it is written or collected, so do that inside too.
    """
    given: list[str] = []
    before = _given.set(given)
    try:
        yield
    finally:
        _given.reset(before)
        for path in given:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again: later steps neither recompute it nor lose it."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_ids(df: DataFrame, ids: DataFrame, col: str, how: str) -> DataFrame:
    """Semi or anti join on one long column; ``ids`` is sent to every executor only if it has at most BROADCAST_IDS rows."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, col, how)


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """Left join of ``rows`` to a table with one row a key and the number ``c`` of its rows, none of whose keys gathers its rows in a task.

    A class with more than a HOT-th of the rows is sent to every task (there are fewer than HOT of them); the others' rows are shuffled.
    """
    hot = F.col("c") * HOT > n_rows
    few = F.broadcast(classes.where(hot).drop("c"))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(classes.where(~hot).drop("c"), keys, "left")
    return rows.join(few, keys).unionByName(rest)


def own_names(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name one for a column of the operator's own that ``df`` doesn't have."""
    taken, tag = [c.lower() for c in df.columns], "_"
    while any(c.startswith(tag + n) for c in taken for n in names):
        tag += "_"
    return {n: tag + n for n in names}


def bounded_batches(spark: SparkSession) -> None:
    """Lower this session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes: the JVM and the worker each hold a whole batch of texts."""
    name = "spark.sql.execution.arrow.max%sPerBatch"
    for what, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        now = spark.conf.get(name % what, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name % what, most)


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in bounded batches, after which the worker, which outlives its tasks, hands its free memory back."""
    bounded_batches(df.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return df.mapInArrow(go, schema)


def release() -> None:
    """Give freed memory back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of a batch, each of at most ``limit`` bytes unless one text is longer; a null is empty."""
    arr = batch.column(column)
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offs = np.frombuffer(arr.buffers()[1], np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return _LOWER[buf]


def word_spans(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of each text, and for each text the number of words before it (one more entry at the end).

    ``gap``: for each byte if it stands between words, by default ASCII white space.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ink = ~gap[buf]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] = ink[cuts]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[cuts - 1] = ink[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, start: int = 1) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = start
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.concatenate([[0], np.cumsum(lens)])
    flat = buf[~_SPACE[buf]].astype(np.uint64)
    flat += np.uint64(1)
    flat *= _powers(int(lens.max()))[np.arange(at[-1]) - np.repeat(at[:-1], lens)]
    return mix(np.add.reduceat(flat, at[:-1]) + lens.astype(np.uint64))


def word_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray = _SPACE) -> pa.Array:
    """The words as one Arrow binary array, their bytes side by side."""
    lens = ends - starts
    at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    flat = np.ascontiguousarray(buf[~gap[buf]])
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(at), pa.py_buffer(flat)])


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text (of all its words if it has fewer, none if it has none), sorted and distinct within a text, with each text's offset.

    ``words``: hashes of all words; ``at``: for each text the number of words before it.
    """
    count = np.diff(at)
    full = np.maximum(count - n + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(full)])
    doc = np.repeat(np.arange(len(count)), full)
    pos = at[:-1][doc] + np.arange(out[-1]) - out[:-1][doc]
    left = at[1:][doc]
    c = _powers(n + 1, 0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        h = np.zeros(len(pos), np.uint64)
        for k in range(n):
            there = pos + k < left
            h += np.where(there, words[np.minimum(pos + k, max(len(words) - 1, 0))], np.uint64(k + 77)) * c[k] if len(words) else h
        h = mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``: a group that goes on in the next batch waits for it."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.ones(b.num_rows - 1, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            same &= v[1:] == v[:-1]
        cut = np.flatnonzero(~same)
        if rest and all(rest[-1].column(k)[-1].as_py() == b.column(k)[0].as_py() for k in keys):
            if not len(cut):
                rest.append(b)
                continue
            head = int(cut[0]) + 1
            yield pa.Table.from_batches([*rest, b.slice(0, head)])
            b = b.slice(head)
            cut = cut[1:] - head
        elif rest:
            yield pa.Table.from_batches(rest)
        if len(cut):
            yield pa.Table.from_batches([b.slice(0, int(cut[-1]) + 1)])
            b = b.slice(int(cut[-1]) + 1)
        rest = [b]
    if rest:
        yield pa.Table.from_batches(rest)


def runs(*cols: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins, and the length at the end."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _record(**cols) -> pa.RecordBatch:
    return pa.record_batch(list(cols.values()), names=list(cols))


def shared_pairs(docs: DataFrame, values: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], buckets: int, flush_bytes: int = 48 << 20, limit: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, hash) for every 64-bit value that two documents have; a pair may come twice.

    ``values`` gives, for the texts of a slice of ``limit`` bytes, values and the number of the text of each. A task sorts the pairs
    of ``flush_bytes`` of text and deals them out as one binary row a bucket. Of a value that several documents
    have there it deals two only, which is enough for the other tasks to learn that it is shared: a very common
    value costs its bucket two entries a flush, and no row of the shuffle stands for a single value. The other
    entries are known to be shared; they go to all buckets alike, only to be handed on.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def row(bucket: int, sure: bool, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
            return _record(bucket=pa.array([bucket]), sure=pa.array([sure]), v=pa.array([v.tobytes()], pa.binary()), d=pa.array([d.tobytes()], pa.binary()))

        def flush() -> Iterator[pa.RecordBatch]:
            value, doc = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            new = runs(value, doc)[:-1]
            value, doc = value[new], doc[new]
            edge = runs(value)
            ends = np.zeros(len(value), bool)
            ends[edge[:-1]] = True
            ends[edge[1:] - 1] = True
            v, d = value[~ends], doc[~ends]
            for i in range(0, len(v), SURE_ROW):
                yield row(int((v[i] + np.uint64(i)) % np.uint64(buckets)), True, v[i : i + SURE_ROW], d[i : i + SURE_ROW])
            v, d = value[ends], doc[ends]
            bucket = (v >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            v, d, bucket = v[order], d[order], bucket[order].astype(np.int64)
            e = runs(bucket)
            for lo, hi in zip(e[:-1].tolist(), e[1:].tolist()):
                yield row(int(bucket[lo]), False, v[lo:hi], d[lo:hi])
            held.clear()

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, buf, offs in text_slices(batch, limit=limit):
                value, doc = values(buf, offs)
                if len(value):
                    held.append((value, ids[lo:hi][doc]))
                size += len(buf)
                if size >= flush_bytes and held:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stream_groups(batches, ["bucket"]):
            edge = runs(t["bucket"].to_numpy())
            sure, vs, ds = t["sure"].to_pylist(), t["v"], t["d"]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                load = lambda col, kind, flag: np.concatenate([np.zeros(0, kind), *(np.frombuffer(col[i].as_py(), kind) for i in range(lo, hi) if sure[i] is flag)])  # noqa: E731, B023
                value, doc = load(vs, np.uint64, False), load(ds, np.int64, False)
                order = np.lexsort((doc, value))
                value, doc = value[order], doc[order]
                new = runs(value, doc)[:-1]
                value, doc = value[new], doc[new]
                n = np.diff(runs(value))
                keep = np.repeat(n, n) > 1
                value = np.concatenate([value[keep], load(vs, np.uint64, True)])
                doc = np.concatenate([doc[keep], load(ds, np.int64, True)])
                yield _record(doc_id=pa.array(doc), hash=pa.array(value.view(np.int64)))

    dealt = in_arrow(docs, deal, "bucket long, sure boolean, v binary, d binary")
    return in_arrow(dealt.repartition("bucket").sortWithinPartitions("bucket"), meet, "doc_id long, hash long")


def bucket_count(spark: SparkSession, n_bytes: int) -> int:
    """Buckets for a text of so many bytes: about 4 MB of it for each, and some for every task."""
    return max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes >> 22)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
