"""``format("signalbin")``: a Python data source for files of Zstd read records.

A record is uuid[36], int32 length and chrom, int32 length and one Zstd frame, all little-endian. The frame holds
int32 byte count and float32 samples, int32 byte count and int32 moves, and maybe int32 byte count and sequence
characters.

A partition is a byte range from one mark to another, and its headers are read where its payloads are. A mark is where
a range of records begins: its first number and offset, the least and greatest uuid and a Bloom filter of them, and the
labels if they are few. Each write leaves the marks of its files in a file of its own in the folder ``_signalbin``, so
writes at the same time don't meet, and the driver opens no file of records; of other files it walks the headers once.

Options: ``path`` (file or folder), ``headerOnly`` (no payload is read; signal and mv are NULL), ``partitionBytes``,
and ``readIndex``, ``uuid`` or ``chrom`` to read those records only: ranges that can't have them are not opened, and
of the others no payloads but theirs are read.

The writer makes one file per task, in read_index order if the rows come so, and commits by renaming; a failed or
repeated task leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid as uuidlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "read_index bigint, uuid string, chrom string, signal array<double>, mv array<int>, sequence string"
LEVEL = 4
MARKS = "_signalbin"
#: Bits a record and hashes of a range's Bloom filter, and labels that a mark lists at most.
BLOOM_BITS, BLOOM_HASHES, LABELS = 12, 6, 16
#: Bytes between the marks that the writer leaves, and records and payload bytes of an Arrow batch.
MARK_BYTES, BATCH_RECORDS, BATCH_BYTES = 4 << 20, 1024, 16 << 20
TYPES = {"read_index": pa.int64(), "uuid": pa.string(), "chrom": pa.string(), "signal": pa.list_(pa.float64()), "mv": pa.list_(pa.int32()), "sequence": pa.string()}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("/") or urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def encode_record(uuid: str, chrom: str, signal, mv, sequence: str | None = None, trailing: bool = False) -> bytes:
    """``trailing``: eight zero bytes end the payload, as older files have."""
    import zstandard

    name, group = uuid.encode(), (chrom or "").encode()
    if len(name) != 36:
        raise ValueError(f"uuid must have 36 bytes: {uuid!r}")
    x, m = np.asarray(signal if signal is not None else [], "<f4").tobytes(), np.asarray(mv if mv is not None else [], "<i4").tobytes()
    payload = struct.pack("<i", len(x)) + x + struct.pack("<i", len(m)) + m
    if sequence is not None:
        s = sequence.encode()
        payload += struct.pack("<i", len(s)) + s
    elif trailing:
        payload += bytes(8)
    frame = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(payload)
    return name + struct.pack("<i", len(group)) + group + struct.pack("<i", len(frame)) + frame


def decode_arrays(frame: bytes) -> tuple[np.ndarray, np.ndarray, str | None]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(frame)
    (n,) = struct.unpack_from("<i", data, 0)
    signal = np.frombuffer(data, "<f4", n // 4, 4)
    at = 4 + n
    (n,) = struct.unpack_from("<i", data, at)
    mv = np.frombuffer(data, "<i4", n // 4, at + 4)
    at += 4 + n
    sequence = None
    if at + 4 <= len(data):
        (n,) = struct.unpack_from("<i", data, at)
        sequence = data[at + 4 : at + 4 + n].decode() if n else None
    return signal, mv, sequence


def decode_payload(frame: bytes) -> tuple[list[float], list[int], str | None]:
    signal, mv, sequence = decode_arrays(frame)
    return signal.astype(float).tolist(), mv.tolist(), sequence


def _exactly(f, n: int, at: int, path: str) -> bytes:
    b = f.read(n)
    if len(b) != n:
        raise ValueError(f"{path}: record at byte {at} is cut short")
    return b


def headers(path: str, start: int = 0, stop: int | None = None, f=None) -> Iterator[tuple[str, str, int, int]]:
    """(uuid, chrom, offset, length of the frame) of each record that begins in a byte range; payloads are skipped."""
    fs, p = filesystem(path)
    size = fs.get_file_info(p).size
    own = f is None
    f = fs.open_input_file(p) if own else f
    try:
        at, stop = start, size if stop is None else stop
        while at < stop:
            f.seek(at)
            head = _exactly(f, 40, at, path)
            (n,) = struct.unpack("<i", head[36:])
            if n < 0:
                raise ValueError(f"{path}: record at byte {at} has a negative length")
            rest = _exactly(f, n + 4, at, path)
            (z,) = struct.unpack("<i", rest[n:])
            if z < 0 or at + 44 + n + z > size:
                raise ValueError(f"{path}: record at byte {at} is cut short")
            yield head[:36].decode(), rest[:n].decode(), at + 44 + n, z
            at += 44 + n + z
    finally:
        if own:
            f.close()


def _spots(uuid: str, bits: int) -> list[int]:
    a = hashlib.blake2b(uuid.encode(), digest_size=16).digest()
    x, y = int.from_bytes(a[:8], "little"), int.from_bytes(a[8:], "little") | 1
    return [(x + k * y) % bits for k in range(BLOOM_HASHES)]


class Marker:
    """Makes the marks of a file as its records pass, each ``every`` bytes."""

    def __init__(self, every: int):
        self.every, self.marks, self.count, self.size = every, [], 0, 0
        self._uuids: list[str] = []
        self._labels: set[str] = set()

    def _close(self) -> None:
        if not self._uuids:
            return
        bits = max(64, BLOOM_BITS * len(self._uuids))
        bloom = bytearray(bits // 8 + 1)
        for u in self._uuids:
            for b in _spots(u, bits):
                bloom[b >> 3] |= 1 << (b & 7)
        labels = sorted(self._labels) if len(self._labels) <= LABELS else None
        self.marks[-1] |= {"uuids": [min(self._uuids), max(self._uuids)], "bits": bits, "bloom": bloom.hex(), "labels": labels}
        self._uuids, self._labels = [], set()

    def add(self, uuid: str, chrom: str, end: int) -> None:
        """A record that ends before byte ``end``."""
        if not self.marks or self.size - self.marks[-1]["at"] >= self.every:
            self._close()
            self.marks.append({"n": self.count, "at": self.size})
        self._uuids.append(uuid)
        self._labels.add(chrom)
        self.count, self.size = self.count + 1, end

    def done(self) -> dict:
        self._close()
        return {"size": self.size, "count": self.count, "marks": self.marks}


def marks_of(path: str, every: int) -> dict:
    """size, count and marks of a file: the first record, and the next after each ``every`` bytes."""
    marker = Marker(every)
    for uuid, chrom, offset, length in headers(path):
        marker.add(uuid, chrom, offset + length)
    return marker.done()


def may_have(mark: dict, uuid: str | None, chrom: str | None) -> bool:
    """False only if no record of the mark's range is so called."""
    if uuid is not None and "uuids" in mark:
        bloom = bytes.fromhex(mark["bloom"])
        if not mark["uuids"][0] <= uuid <= mark["uuids"][1] or not all(bloom[b >> 3] >> (b & 7) & 1 for b in _spots(uuid, mark["bits"])):
            return False
    return chrom is None or mark.get("labels") is None or chrom in mark["labels"]


def _listed(path: str) -> tuple[list[str], list[str]]:
    """(files of records, files of marks) of a file or folder, those in folders below too."""
    fs, p = filesystem(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path], []
    found = [x.path for x in fs.get_file_info(pafs.FileSelector(p, recursive=True)) if x.type == pafs.FileType.File]
    below = lambda x: x[len(p.rstrip("/")) + 1 :].split("/")
    names = sorted(x for x in found if not any(part.startswith(("_", ".")) for part in below(x)))
    marks = sorted(x for x in found if below(x)[-2:-1] == [MARKS] and x.endswith(".json"))
    head = path.split("://")[0] + "://" if "://" in path and not path.startswith("file") else ""
    return [head + n for n in names], [head + n for n in marks]


def _files(path: str) -> list[str]:
    return _listed(path)[0]


def _load_marks(files: list[str]) -> dict[str, dict]:
    """What writers left, by the whole path of a file of records."""
    out = {}
    for path in files:
        fs, p = filesystem(path)
        with fs.open_input_stream(p) as f:
            folder = path.rsplit("/", 2)[0]
            out |= {f"{folder}/{name}": marks for name, marks in json.loads(f.read()).items()}
    return out


@dataclass
class Range(InputPartition):
    path: str
    first: int
    start: int
    stop: int


class SignalBinReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], [f.name for f in schema.fields]
        self.header_only = str(options.get("headeronly", options.get("headerOnly", "false"))).lower() == "true"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20)))
        # Chosen by option: a filter pushed by the optimiser would stay with a table that another query reads again.
        only = {"read_index": "readindex", "uuid": "uuid", "chrom": "chrom"}
        self.wanted = {k: int(options[o]) if k == "read_index" else options[o] for k, o in only.items() if o in options}

    def partitions(self) -> list[Range]:
        out, index = [], 0
        files, marks = _listed(self.path)
        left = _load_marks(marks)
        number, names = self.wanted.get("read_index"), (self.wanted.get("uuid"), self.wanted.get("chrom"))
        for path in files:
            fs, p = filesystem(path)
            known = left.get(path)
            if not known or known["size"] != fs.get_file_info(p).size:
                known = marks_of(path, self.most)
            ends = [*known["marks"][1:], {"n": known["count"], "at": known["size"]}]
            for mark, end in zip(known["marks"], ends):
                if number is not None and not index + mark["n"] <= number < index + end["n"] or not may_have(mark, *names):
                    continue
                last = out[-1] if out else None
                if last and last.path == path and last.stop == mark["at"] and last.stop - last.start < self.most:
                    last.stop = end["at"]
                else:
                    out.append(Range(path, index + mark["n"], mark["at"], end["at"]))
            index += known["count"]
        return out or [Range(self.path, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.stop <= partition.start:
            return
        fs, p = filesystem(partition.path)
        with fs.open_input_file(p) as f:
            rows: dict[str, list] = {k: [] for k in TYPES}
            held = 0
            for i, (uuid, chrom, offset, length) in enumerate(headers(partition.path, partition.start, partition.stop, f)):
                row = {"read_index": partition.first + i, "uuid": uuid, "chrom": chrom}
                if any(row[k] != v for k, v in self.wanted.items()):
                    continue
                if not self.header_only:
                    f.seek(offset)
                    row["signal"], row["mv"], row["sequence"] = decode_arrays(_exactly(f, length, offset, partition.path))
                    held += row["signal"].nbytes + row["mv"].nbytes
                for k, v in rows.items():
                    v.append(row.get(k))
                if len(rows["uuid"]) == BATCH_RECORDS or held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = {k: [] for k in TYPES}, 0
            if rows["uuid"]:
                yield self._batch(rows)

    def _batch(self, rows: dict[str, list]) -> pa.RecordBatch:
        def column(name: str) -> pa.Array:
            values, kind = rows[name], TYPES[name]
            if not pa.types.is_list(kind) or values[0] is None:
                return pa.array(values, kind)
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(kind.value_type.to_pandas_dtype())), kind)

        return pa.record_batch([column(n) for n in self.names], names=self.names)


@dataclass
class Written(WriterCommitMessage):
    tmp: str
    path: str
    marks: dict


class SignalBinWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.job = options["path"], overwrite, uuidlib.uuid4().hex[:12]
        self.trailing = str(options.get("trailing", "false")).lower() == "true"

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, folder = filesystem(self.folder)
        fs.create_dir(folder, recursive=True)
        name = f"part-{context.partitionId():06d}-{self.job}.bin"
        tmp, at, marker = f"{folder}/_{name}.{context.taskAttemptId()}", 0, Marker(MARK_BYTES)
        try:
            with fs.open_output_stream(tmp) as f:
                for r in rows:
                    d = r.asDict()
                    record = encode_record(d["uuid"], d.get("chrom"), d.get("signal"), d.get("mv"), d.get("sequence"), self.trailing)
                    f.write(record)
                    at += len(record)
                    marker.add(d["uuid"], d.get("chrom") or "", at)
        except BaseException:
            if fs.get_file_info(tmp).type == pafs.FileType.File:
                fs.delete_file(tmp)
            raise
        if not marker.count:
            fs.delete_file(tmp)
            return Written("", "", {})
        return Written(tmp, f"{folder}/{name}", marker.done())

    def commit(self, messages: list[Written | None]) -> None:
        """Files get their names, then their marks are left; an overwrite deletes what was there before, marks last."""
        fs, folder = filesystem(self.folder)
        log = f"{folder}/{MARKS}"
        of = lambda at: [x.path for x in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if x.type == pafs.FileType.File and not os.path.basename(x.path).startswith("_")]
        old = [*of(folder), *of(log)] if self.overwrite else []
        marks = {}
        for m in messages:
            if m and m.tmp:
                fs.move(m.tmp, m.path)
                marks[os.path.basename(m.path)] = m.marks
        if marks:
            fs.create_dir(log, recursive=True)
            with fs.open_output_stream(f"{log}/_{self.job}.tmp") as f:
                f.write(json.dumps(marks).encode())
            fs.move(f"{log}/_{self.job}.tmp", f"{log}/{self.job}.json")
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.folder)
        for m in messages:
            if m and m.tmp:
                fs.delete_file(m.tmp)


class SignalBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signalbin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SignalBinReader:
        return SignalBinReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> SignalBinWriter:
        return SignalBinWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SignalBin)
