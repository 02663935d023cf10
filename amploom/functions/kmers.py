"""K-mers and candidate bands as column expressions and explodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches


#: K-mers that are counted at once.
PIECE = 1 << 19

_BASES = np.frombuffer(b"ATCG", np.uint8)
_DIGIT = np.zeros(256, np.uint8)
for _i, _c in enumerate(b"ATCG"):
    _DIGIT[[_c, _c | 0x20]] = _i


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and where each one begins and ends; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, edge - edge[0]


def _lists(edge: np.ndarray, values: pa.Array, missing: np.ndarray | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), values, mask=None if missing is None or not missing.any() else pa.array(missing))


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


_CAPITALS = bytes.maketrans(b"acgt", b"ACGT")
_OTHERS = bytes(set(range(256)) - set(b"ACGTacgt"))


def letters(text: Column) -> Column:
    """The letters A, C, G, T of a text, in either case, as capitals; null stays null. No other letter of Unicode has one of them as its small form."""

    @F.arrow_udf("string")
    def go(column: pa.Array) -> pa.Array:
        return pa.array([t and t.translate(_CAPITALS, _OTHERS) for t in column.cast(pa.large_binary()).to_pylist()], pa.binary()).cast(pa.string())

    return go.asNondeterministic()(text)  # else filters go below it and have it done twice


def kmer_codes(seq: Column, k: int) -> Column:
    """Codes of all k-mers, two bits a base, most significant first; none if the sequence is shorter than k.

    A, T, C, G are 0, 1, 2, 3 in either case; any other letter counts as A. numpy does a batch of sequences at once.
    """
    return _kmer_codes(k)(seq)


def _kmer_codes(k: int):
    @F.arrow_udf("array<bigint>")
    def go(column: pa.Array) -> pa.Array:
        data, edge = _texts(column)
        enough = np.diff(edge) >= k
        if (data > 127).any():  # letters of several bytes, and those whose capitals are several letters
            texts = [t or "" for t in column.to_pylist()]
            enough = np.array([len(t) >= k for t in texts], bool)
            points = [np.frombuffer(t.upper().encode("utf-32-le"), np.uint32) for t in texts]
            edge = _edges([len(x) for x in points])
            data = np.minimum(np.concatenate(points), 255).astype(np.uint8)
        digits = _DIGIT[data]
        n = max(0, len(digits) - k + 1)
        code = np.zeros(n, np.int64)
        for i in range(k):
            code *= 4
            code += digits[i : n + i]
        whole = np.ones(len(digits), bool)
        for i in range(1, k):  # those that would go on into the next sequence
            at = edge[1:] - i
            whole[at[at >= edge[:-1]]] = False
        whole[np.repeat(~enough, np.diff(edge))] = False
        return _lists(_edges(np.where(enough, np.diff(edge) - k + 1, 0)), pa.array(code[whole[:n]]))

    return go


def kmers_of_codes(codes: Column, k: int, compat: bool = False) -> Column:
    """The sequence of codes: the first whole, then the last base of each later one. ``compat``: skips the codes 1 .. k - 1. Missing codes have no bases."""
    skip = k if compat else 1

    @F.arrow_udf("string")
    def go(column: pa.Array) -> pa.Array:
        column = pa.array(column.fill_null([]) if column.null_count else column)
        edge, flat = column.offsets.to_numpy().astype(np.int64), column.values
        known = flat.is_valid().to_numpy(zero_copy_only=False)[edge[0] : edge[-1]]
        values, edge = flat.fill_null(0).to_numpy()[edge[0] : edge[-1]], edge - edge[0]
        sizes = np.diff(edge)
        some = np.flatnonzero(sizes)
        out = _edges(np.where(sizes > 0, k + np.maximum(0, sizes - skip), 0))
        letters, there, later = np.zeros(out[-1], np.uint8), np.ones(out[-1], bool), np.ones(out[-1], bool)
        for i in range(k):
            at = out[some] + i
            letters[at], there[at], later[at] = _BASES[(values[edge[some]] >> 2 * (k - 1 - i)) & 3], known[edge[some]], False
        rest = np.ones(len(values), bool)
        for i in range(skip):
            at = edge[some] + i
            rest[at[at < edge[some + 1]]] = False
        letters[later], there[later] = _BASES[values[rest] & 3], known[rest]
        kept = _edges(there)
        return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(kept[out].astype(np.int64)), pa.py_buffer(letters[there])]).cast(pa.string())

    return go(codes)


def kmer_strings(seq: Column, k: int, pad: int, char: str = "N") -> Column:
    """One k-mer a base: ``pad`` filler on the left and k - pad - 1 on the right."""

    @F.arrow_udf("array<string>")
    def go(column: pa.Array) -> pa.Array:
        data, edge = _texts(column)
        if (data > 127).any() or len(char) != 1 or not char.isascii() or not 0 <= pad < k:
            full = [(t or "", char * pad + (t or "") + char * (k - pad - 1)) for t in column.to_pylist()]
            return pa.array([[f[i : i + k] for i in range(len(t))] for t, f in full], pa.list_(pa.string()))
        own = np.repeat(np.arange(len(column)) * (k - 1), np.diff(edge)) + np.arange(len(data))  # each base's k-mer begins here
        padded = np.full(len(data) + len(column) * (k - 1), ord(char), np.uint8)
        padded[own + pad] = data
        letters = np.empty((len(data), k), np.uint8)
        for i in range(k):
            letters[:, i] = padded[own + i]
        each = pa.Array.from_buffers(pa.large_string(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1) * k), pa.py_buffer(letters)])
        return _lists(edge, each.cast(pa.string()))

    return go(seq)


def _counted(code: np.ndarray, edge: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of numbers below ``span``: where each row's different numbers begin and end, these, how often each is in its row, and where first."""
    rows, span = len(edge) - 1, max(1, span)
    row = np.repeat(np.arange(rows), np.diff(edge))
    key = row * span + code
    if rows * span <= max(PIECE, 2 * len(code)):
        n = np.bincount(key, minlength=rows * span)
        at = np.empty(len(n), np.int64)
        at[key[::-1]] = np.arange(len(key))[::-1]  # the last one set is the first in the row
        key = np.flatnonzero(n)
        n, at = n[key], at[key]
    else:
        key, at, n = np.unique(key, return_index=True, return_counts=True)
    return np.searchsorted(key, np.arange(rows + 1) * span), key % span, n, at - edge[row[at]]


def counts(values: Column, kind: str) -> Column:
    """array<struct<value, n, first>>: the different entries of an array of ``kind`` (an SQL type), how often each is there and where first (from 0). None if the array is missing."""

    @F.arrow_udf(f"array<struct<value:{kind},n:bigint,first:bigint>>")
    def go(column: pa.Array) -> pa.Array:
        each = column.flatten().dictionary_encode("encode")
        edge, code, n, at = _counted(each.indices.to_numpy(), _edges(column.value_lengths().fill_null(0).to_numpy()), len(each.dictionary))
        return _lists(edge, pa.StructArray.from_arrays([each.dictionary.take(pa.array(code)), pa.array(n), pa.array(at)], names=["value", "n", "first"]))

    return go(values)


def kmer_graph(spark: SparkSession, k: int, stay: float) -> DataFrame:
    """(source, target, prob) of the De Bruijn graph: ``stay`` on itself and the rest over the four successors; self edges are one."""
    n = 4**k
    step = spark.range(n).select(F.col("id").alias("source"), F.explode(F.array(*map(F.lit, range(4)))).alias("b"))
    moves = step.select("source", F.pmod(F.col("source") * 4 + F.col("b"), F.lit(n)).alias("target"), F.lit((1 - stay) / 4).alias("p"))
    stays = spark.range(n).select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(float(stay)).alias("p"))
    return moves.union(stays).groupBy("source", "target").agg(F.sum("p").alias("prob"))


def moved_samples(signal: Column, mv: Column) -> Column:
    """The samples whose move is not 0."""
    return F.transform(F.filter(F.arrays_zip(signal.alias("s"), mv.alias("m")), lambda z: z["m"] != 0), lambda z: z["s"])


def band(frames: DataFrame, seg: str, width: int, length: int) -> DataFrame:
    """Frames by candidate position: those within ``width`` of the frame's segment, clamped to the model. An explode that later equi-joins on position."""
    lo, hi = F.greatest(F.lit(0), F.col(seg) - width), F.least(F.lit(length - 1), F.col(seg) + width)
    return frames.where(lo <= hi).withColumn("position", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))


def uniform_band(n: Column, length: int, width: int, first: int = 0) -> Column:
    """array<struct<t, position>>: the base moves on every n div length samples from ``first`` and stays within the model; none if n <= length."""
    skip = F.greatest(F.lit(1), F.floor(n / length))
    one = lambda t: F.transform(F.sequence(F.lit(-(width // 2)), F.lit(width - width // 2 - 1)), lambda o: F.struct(t.cast("long").alias("t"), (F.least(F.lit(length - 1), F.floor(t / skip) + first) + o).cast("long").alias("position")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), one))
    return F.when(n > length, F.filter(pairs, lambda z: (z["position"] >= 0) & (z["position"] < length))).otherwise(F.array().cast("array<struct<t:bigint,position:bigint>>"))


def coarse_band(seq: Column, n: Column, k: int, width: int) -> Column:
    """array<struct<t, code>>: the k-mers near each sample, positions clamped and duplicates off."""

    def pairs(z: Column) -> Column:
        codes, n = z["codes"], z["n"]
        length = F.size(codes)
        skip = F.greatest(F.lit(1), F.floor(n / length))
        near = lambda p: F.array_distinct(F.transform(F.sequence(F.lit(-(width // 2)), F.lit(width - width // 2 - 1)), lambda o: F.least(length - 1, F.greatest(F.lit(0), p + o))))
        around = F.transform(F.sequence(F.lit(0), length - 1), lambda p: F.transform(near(p), lambda q: F.get(codes, q)))
        at = lambda t: F.least(length - 1, (F.floor(t / skip) + 1).cast("int"))
        each = lambda around: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda t: F.transform(F.get(around, at(t)), lambda c: F.struct(t.alias("t"), c.alias("code"))))
        found = F.flatten(F.get(F.transform(F.array(around), each), F.lit(0)))
        return F.when((n > length) & (length > 0), found).otherwise(F.array().cast("array<struct<t:bigint,code:bigint>>"))

    # Codes, n and the codes around each position are bound once: inside the lambdas they would be made again for every entry.
    return F.get(F.transform(F.array(F.struct(kmer_codes(seq, k).alias("codes"), n.cast("long").alias("n"))), pairs), F.lit(0))


def coarse_band_rows(df: DataFrame, keep: list[str], seq: Column, n: Column, k: int, width: int) -> DataFrame:
    """(``keep``, t, code): a row for each entry of ``coarse_band``.

    A position has its samples and its neighbours as two short arrays, which are exploded one after the other: no array
    is as long as the rows of a sequence, and all that is done for a row is compiled.
    """
    bounded_batches(df.sparkSession)
    codes = df.select(*keep, _kmer_codes(k).asNondeterministic()(seq).alias("_codes"), n.cast("long").alias("_n"))  # else filters go below it and have it done twice
    codes = codes.where("size(_codes) > 0 and _n > size(_codes)").withColumns({"_last": F.size("_codes") - 1, "_skip": F.expr("_n div size(_codes)")})
    places = codes.withColumn("_p", F.explode(F.expr("sequence(least(1, _last), _last)")))
    near = F.array_distinct(F.array(*(F.least("_last", F.greatest(F.lit(0), F.col("_p") + o)) for o in range(-(width // 2), width - width // 2))))
    spans = places.withColumns({"_ts": F.expr("sequence(greatest(0, _p - 1) * _skip, if(_p = _last, _n, _p * _skip) - 1)"), "_near": near})
    rows = spans.withColumn("t", F.explode("_ts")).withColumn("_q", F.explode("_near"))
    return rows.select(*keep, "t", F.get("_codes", F.col("_q")).alias("code"))


def _moves_band(mv: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``moves_band`` as an array of t and one of positions."""
    mv = np.asarray(mv)
    if not len(mv) or not (mv >= 0).any():
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    skip = np.float32(length / (int(mv.max()) - int(mv[mv >= 0].min()) + 1))
    change = np.append(True, mv[1:] != mv[:-1])
    cursor = np.cumsum(np.where(change, skip, np.float32(0)), dtype=np.float32)  # adds one after the other, as a loop does
    p = np.clip(cursor.astype(int), 0, length - 1)[:, None] + np.arange(-(width // 2), width - width // 2)
    t, o = np.nonzero((p >= 0) & (p < length))
    return t.astype(np.int32), p[t, o].astype(np.int32)


def moves_band(mv: np.ndarray, length: int, width: int) -> list[tuple[int, int]]:
    """(t, position): a single-precision cursor goes on by length / (max - least non-negative + 1) at every change of the moves, the first sample included, and stays within the model."""
    return list(zip(*(x.tolist() for x in _moves_band(mv, length, width))))


def moves_bands(moves: list[np.ndarray | None], sizes: list[int], widths: list[int]) -> pa.ListArray:
    """array<struct<t, position>> of each ``moves``, made of numbers in a row, not of objects; null where they are."""
    none = np.zeros(0, np.int32)
    found = [(none, none) if m is None else _moves_band(m, n, w) for m, n, w in zip(moves, sizes, widths)]
    t, p = (pa.array(np.concatenate([none, *(f[i] for f in found)]), pa.int32()) for i in (0, 1))
    return _lists(_edges([len(f[0]) for f in found]), pa.StructArray.from_arrays([t, p], names=["t", "position"]), np.array([m is None for m in moves], bool))


def count_kmers(texts: DataFrame, text: str, k: int, first: bool = False) -> DataFrame:
    """(code, n): how often each k-mer of the letters a, c, g, t (in either case, others left out) stands in the texts; ``first``: at a text's start.

    A batch of texts is counted by numpy, ``PIECE`` k-mers and a text's piece at a time, before anything is shuffled. k is at most 31. A null text, or one with fewer letters, has none.
    """
    digit = np.full(256, 4, np.uint8)
    for i, c in enumerate(b"ATCG"):
        digit[[c, c | 0x20]] = i

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(found):
            code, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.record_batch([pa.array(code), pa.array(n)], names=["code", "n"])

        for b in batches:
            found, held = [], 0
            for raw in b.column(0):
                d = digit[np.frombuffer(raw.as_py() or b"", np.uint8)]
                d = d[d < 4][: k if first else None]
                for lo in range(0, len(d) - k + 1, PIECE):
                    n = min(PIECE, len(d) - k + 1 - lo)
                    code = np.zeros(n, np.int64)
                    for i in range(k):
                        code = code * 4 + d[lo + i : lo + i + n]
                    found.append(code)
                    held += n
                    if held >= PIECE:
                        yield counted(found)
                        found, held = [], 0
            if found:
                yield counted(found)

    return texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(go, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def kmer_links(texts: DataFrame, text: str, k: int) -> DataFrame:
    """(source, target, prob): k-mers that follow each other in the texts, by how often; logs and sums to 1 are ``log_links``' work."""
    longer = count_kmers(texts, text, k + 1)
    return longer.select(F.floor(F.col("code") / 4).alias("source"), (F.col("code") % 4**k).alias("target"), F.col("n").cast("double").alias("prob"))
