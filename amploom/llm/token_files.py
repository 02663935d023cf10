"""Token-ID output: Arrow stream-file shards of fixed-size-list batches, for zero-copy random access to equal-length sequences and masks.

``write_tokens`` deals documents by ranges of doc_id into shards. A shard is one Arrow file whose columns are
``ids`` (fixed-size list of 16-bit ids, 32-bit if the vocabulary needs it) and ``mask`` (fixed-size list of
bytes: 1 for a token, 0 for the padding after the shard's last). Each document's ids and its end id
follow each other across sequences. ``TokenFile`` maps a file and hands out numpy views.

A shard is written under a temporary name and renamed, so a task that runs again after a lost executor
finds its own file with the same bytes, or writes it; a task that fails removes what it began.

Nulls and odd rows: a null or empty text is just the end id; a null doc_id sorts before all others; rows that
repeat a doc_id stay, ordered by a hash of the text; an empty table gives no shards and an empty index; other columns are
not read, whatever they are called.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, scratch, settle, stream_groups, text_slices, word_array, word_spans

SEQUENCE = 1024
#: Bytes of text encoded at a time.
SLICE = 6 << 20
#: Words whose ids a worker remembers, over its tasks; then it starts anew.
WORDS = 1_400_000
BATCH_SEQUENCES = 512
END_ID = 2


def _open(path: str):
    if path.startswith("/") or urlparse(path).scheme == "file":
        return pa.fs.LocalFileSystem(), urlparse(path).path
    return pa.fs.FileSystem.from_uri(path)


_known: dict[bytes, bytes] = {}


@lru_cache(1)
def _tokenizer(path: str):
    _known.clear()
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_slice(tokenizer, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a slice side by side, and each text's offset.

    The pre-tokenizer never joins what ASCII white space divides, so each distinct word is encoded once.
    """
    starts, ends, at = word_spans(buf, offs)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    words = word_array(buf, starts, ends).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    known = _known
    fresh = [w for w in distinct if w not in known]
    if len(known) + len(fresh) > WORDS:
        known.clear()
        fresh = distinct
    for w, e in zip(fresh, tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)):
        known[w] = array("i", e.ids).tobytes()
    each = [known[w] for w in distinct]
    size = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat = np.frombuffer(b"".join(each), np.int32)
    first = np.cumsum(size) - size
    which = words.indices.to_numpy()
    n = size[which]
    upto = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(first[which] - upto[:-1], n) + np.arange(upto[-1])]
    return ids, upto[at]


class _Shard:
    """Writes one shard file; sequences leave in full batches."""

    def __init__(self, path: str, width, sequence: int):
        self.fs, self.path = _open(path)
        self.tmp = f"{self.path}.{os.getpid()}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.sequence, self.width, self.rest, self.n = sequence, width, np.zeros(0, width), 0
        kind = pa.from_numpy_dtype(width)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.uint8(), sequence))])
        self.sink = self.fs.open_output_stream(self.tmp)
        self.out = pa.ipc.new_file(self.sink, self.schema)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = (np.arange(len(ids)) < real).view(np.uint8)  # a byte each: Arrow packs booleans, which no view could be of
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(cols, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids.astype(self.width)])
        step = self.sequence * BATCH_SEQUENCES
        whole = len(ids) // step * step
        for i in range(0, whole, step):
            self._batch(ids[i : i + step], step)
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            real = len(self.rest)
            self._batch(np.pad(self.rest, (0, -real % self.sequence)), real)
        self.out.close()
        self.sink.close()
        # A task that runs again, as its executor was lost, writes the same bytes; some file systems don't rename over a file.
        there, made = self.fs.get_file_info([self.path, self.tmp])
        if there.type == pa.fs.FileType.File:
            if there.size == made.size:
                return self.fs.delete_file(self.tmp)
            self.fs.delete_file(self.path)
        self.fs.move(self.tmp, self.path)

    def abort(self) -> None:
        self.sink.close()
        self.fs.delete_file(self.tmp)


class TokenFile:
    """Random access to a shard: ``ids(i)`` and ``mask(i)`` of sequence i, and ``span`` of the token stream, without copies where one batch holds it."""

    def __init__(self, path: str):
        fs, p = _open(path)
        source = pa.memory_map(p) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(p)
        self._file = pa.ipc.open_file(source)
        self._batches: dict[int, pa.RecordBatch] = {}
        self.sequence = self._file.schema.field("ids").type.list_size

    def _values(self, b: int, column: str) -> np.ndarray:
        if b not in self._batches:
            self._batches = {b: self._file.get_batch(b)}
        values = self._batches[b].column(column).flatten()
        return values.to_numpy(zero_copy_only=True)

    def _one(self, i: int, column: str) -> np.ndarray:
        b, k = divmod(i, BATCH_SEQUENCES)
        return self._values(b, column)[k * self.sequence : (k + 1) * self.sequence]

    def ids(self, i: int) -> np.ndarray:
        return self._one(i, "ids")

    def mask(self, i: int) -> np.ndarray:
        return self._one(i, "mask")

    def span(self, start: int, n: int) -> np.ndarray:
        step, parts = self.sequence * BATCH_SEQUENCES, []
        while n > 0:
            b, k = divmod(start, step)
            part = self._values(b, "ids")[k : k + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID, sequence: int = SEQUENCE, shards: int | None = None) -> DataFrame:
    """Writes the shards under ``out`` and returns the index: doc_id, shard, file, local_start, n_tokens, one row per row of ``docs``."""
    spark = docs.sparkSession
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("doc_id").rdd.getNumPartitions())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        width = np.uint16 if max(tok.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else np.uint32
        part = TaskContext.get().partitionId()
        name, shard = f"{out}/part-{part:06d}.arrow", None
        try:
            for batch in batches:
                for lo, hi, buf, offs in text_slices(batch, limit=SLICE):
                    shard = shard or _Shard(name, width, sequence)
                    ids, at = encode_slice(tok, buf, offs)
                    size = np.diff(at)
                    ids = np.insert(ids, at[1:], end_id)
                    start = shard.n + at[:-1] + np.arange(hi - lo)
                    shard.add(ids)
                    yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(np.full(hi - lo, part, np.int64)), pa.array([name] * (hi - lo)), pa.array(start), pa.array(size + 1)], names=["doc_id", "shard", "file", "local_start", "n_tokens"])
        except BaseException:
            if shard:
                shard.abort()
            raise
        if shard:
            shard.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash splits the rows of one doc_id, or of none, among several ranges
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return settle(dealt.mapInArrow(write, "doc_id long, shard long, file string, local_start long, n_tokens long"), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it, in file order), n_tokens, ids_crc32."""
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))  # a row a shard, not a document
    rows = index.join(before, "shard").repartition("shard").sortWithinPartitions("shard", "local_start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for t in stream_groups(batches, ["shard"]):
            crc = []
            for path, start, n in zip(t["file"].to_pylist(), t["local_start"].to_pylist(), t["n_tokens"].to_pylist()):
                if path != name:
                    name, f = path, TokenFile(path)
                crc.append(zlib.crc32(f.span(start, n).astype("<u4").tobytes()))
            start = pa.compute.add(t["shard_start"], t["local_start"])
            yield from pa.table([t["doc_id"], start, t["n_tokens"], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]).to_batches()

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    index = write_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "tokens"))
    return read_tokens(index)


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
