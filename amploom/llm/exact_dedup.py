"""Exact duplicates by composable polynomial fingerprints, and a comparison of the texts that have the same one.

Texts are equal if they are after each run of ASCII white space has become one space. A text's fingerprint is, for
each of some primes p, the sum of (byte + 1) x base ^ (bytes after it) mod p, beside its length. It composes: the
fingerprint of two parts is the first's times base ^ (length of the second) plus the second's. A text over ``CHUNK``
bytes is dealt out by chunks, each task hashes chunks shifted by the bytes after them, and their sum is the text's.

Equal fingerprints prove nothing, so texts that share one are read again and compared chunk by chunk: the least and
the largest bytes at each place of each fingerprint, a pair of chunks a task and place, meet, and where they
differ all texts get more primes. Tasks reduce their rows first, so a text that a third of all rows repeat sends a row a task.

Nulls and odd rows: a null text is empty; all empty texts are equal, and a text of white space equals one space; of rows
that repeat a doc_id and an equal text one stays; a null doc_id stands after all others, and keep_id is null only if
no row of its group has a doc_id; an empty table gives no rows; other columns are returned if asked for, and one named keep_id,
group_size or kept is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, join_classes, settle, text_slices

#: Bytes of a chunk: longer texts are hashed by several tasks.
CHUNK = 1 << 20
#: Groups whose keys a broadcast may hold (32 bytes each).
BROADCAST_GROUPS = 1_000_000
#: Primes below 2^31, so that products fit 64 bits, with their bases; when texts collide, more are made.
LANES = ((2147483647, 1103515245), (2147483629, 1664525), (2147483587, 22695477))


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


@lru_cache(16)
def _powers(p: int, base: int, n: int) -> np.ndarray:
    """base ^ 0 .. base ^ (n - 1) mod p, each part made from the one before it."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = pow(base, done, p)
        part = out[: min(done, n - done)] * np.uint64(step) % np.uint64(p)
        out[done : done + len(part)] = part
        done += len(part)
    return out


def hash_parts(buf: np.ndarray, offs: np.ndarray, after: np.ndarray, lanes) -> np.ndarray:
    """(lanes, parts): fingerprints of parts of texts side by side in ``buf``, each shifted by the ``after`` bytes that follow it in its text."""
    size = np.diff(offs)
    out = np.zeros((len(lanes), len(size)), np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    rest = np.repeat(offs[1:][full], size[full]) - np.arange(offs[0], offs[-1]) - 1
    value = buf.astype(np.uint64) + np.uint64(1)
    table = 1 << int(max(size.max(), 2) - 1).bit_length()
    for k, (p, base) in enumerate(lanes):
        h = np.add.reduceat(value * _powers(p, base, table)[rest], offs[:-1][full] - offs[0]) % np.uint64(p)  # 2^8 x 2^31 x 2^24 bytes fit
        shift = np.array([pow(base, int(a), p) for a in after[full]], np.uint64) if after.any() else np.uint64(1)
        out[k, full] = (h * shift % np.uint64(p)).astype(np.int64)
    return out


def _part_hash(part: Column, after: Column, lanes) -> Column:
    @F.arrow_udf("array<long>")
    def go(part: pa.Array, after: pa.Array) -> pa.Array:
        found = [np.zeros((len(lanes), 0), np.int64)]
        tail = after.to_numpy()
        for lo, hi, buf, offs in text_slices(pa.record_batch([part], names=["text"])):
            found.append(hash_parts(buf, offs, tail[lo:hi], lanes))
        flat = np.concatenate(found, axis=1).T.ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(lanes)), pa.int32()), pa.array(flat))

    return go(part, after)


def _chunked(rows: DataFrame, data: str, at: str, part: str, chunk: int) -> DataFrame:
    """``rows`` by chunks of the binary column ``data``: their number and bytes; an empty text has one, empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.length(data) / chunk)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(data), i * chunk + 1, F.lit(chunk)))
    return rows.select("*", F.posexplode(cut).alias(at, part)).drop(data)


def fingerprints(rows: DataFrame, lanes=LANES, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with bytes ``_b`` as a table without them, with their length ``_n``, lanes ``_f0``, ``_f1``, .. and a number ``_rid`` of the row's own; and (_rid, _b) of the texts over ``chunk``, if there are any.

    One pass over the texts. What is written on the way has a row a text, and the bytes of texts over ``chunk`` only.
    """
    bounded_batches(rows.sparkSession)
    names = [f"_f{k}" for k in range(len(lanes))]
    hashed = rows.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_n", F.length("_b").cast("long"))
    whole = F.col("_n") <= chunk
    hashed = hashed.withColumn("_h", _part_hash(F.when(whole, F.col("_b")), F.lit(0).cast("long"), lanes))
    table = settle(hashed.withColumns({"_b": F.when(~whole, F.col("_b"))} | {c: F.get("_h", F.lit(k)) for k, c in enumerate(names)}).drop("_h"), "fingerprints")
    large = table.where("_b is not null")
    if large.isEmpty():
        return table.drop("_b"), None
    parts = _chunked(large.select("_rid", "_n", "_b"), "_b", "_at", "_part", chunk).repartition("_rid", "_at")
    after = F.greatest(F.lit(0), F.col("_n") - (F.col("_at") + 1).cast("long") * chunk)
    dealt = parts.select("_rid", _part_hash(F.col("_part"), after, lanes).alias("_h"))
    summed = dealt.groupBy("_rid").agg(*(F.pmod(F.sum(F.get("_h", F.lit(k))), F.lit(p)).alias(c) for k, ((p, _), c) in enumerate(zip(lanes, names))))
    return settle(table.where("_b is null").drop("_b").unionByName(large.drop("_b", *names).join(summed, "_rid")), "fingerprints"), large.select("_rid", "_b")


def more_lanes(lanes):
    """``lanes`` and one more for each of LANES, whose base none has yet."""
    return (*lanes, *((p, pow(base, 3 + len(lanes), p)) for p, base in LANES))


def collisions(bodies: DataFrame, large: DataFrame | None, rows: DataFrame, groups: DataFrame, lanes, chunk: int = CHUNK) -> DataFrame:
    """The keys of ``groups`` (lengths and lanes, with the number ``c`` of their texts) whose texts differ somewhere, from the texts themselves."""
    names = [f"_f{k}" for k in range(len(lanes))]
    keys = ["_n", *names]
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    n_rows = rows.count()

    def chunks(texts: DataFrame) -> DataFrame:
        if few:
            mine = texts.join(F.broadcast(groups.select(*keys)), keys, "left_semi")
        else:
            mine = join_classes(texts, groups.select(*keys, "c", F.lit(True).alias("_in")), keys, n_rows).where("_in").drop("_in")
        return _chunked(mine, "_b", "_at", "_part", chunk).select(*keys, "_at", "_part")

    small = bodies.withColumn("_n", F.length("_b").cast("long")).where(F.col("_n") <= chunk).withColumn("_h", _part_hash(F.col("_b"), F.lit(0).cast("long"), lanes))
    parts = chunks(small.select("_n", "_b", *(F.get("_h", F.lit(k)).alias(c) for k, c in enumerate(names))))
    if large is not None:
        parts = parts.unionByName(chunks(large.join(rows.where(F.col("_n") > chunk).select("_rid", *keys), "_rid").select(*keys, "_b")))
    edges = parts.groupBy(*keys, "_at").agg(F.min("_part").alias("lo"), F.max("_part").alias("hi"))
    return edges.where("lo <> hi").select(*keys).distinct()


def exact_groups(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), lanes=LANES, chunk: int = CHUNK) -> DataFrame:
    """The ``columns`` of every row of ``docs`` (doc_id, text), with keep_id (doc_id of the row that stays), group_size and kept."""
    columns = tuple(c for c in columns if c.lower() not in ("keep_id", "group_size", "kept"))
    own = {f"c{i}": c for i, c in enumerate(columns)}
    bodies = docs.select(F.col("doc_id").alias("_id"), *(F.col(f"`{c}`").alias(k) for k, c in own.items()), normalised(F.col("text")).cast("binary").alias("_b"))
    while True:
        keys = ["_n", *(f"_f{k}" for k in range(len(lanes)))]
        rows, large = fingerprints(bodies, lanes, chunk)
        first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_rid")).alias("first")
        groups = settle(rows.groupBy(*keys).agg(F.count("*").alias("c"), first).where("c > 1"), "groups")
        if collisions(bodies.select("_b"), large, rows, groups, lanes, chunk).isEmpty():
            break
        lanes = more_lanes(lanes)  # other texts have the same fingerprint: all get more primes
    classes = groups.select(*keys, "c", F.col("c").alias("group_size"), F.col("first._id").alias("keep_id"), F.col("first._rid").alias("_keep"))
    found = join_classes(rows, classes, keys, rows.count())
    alone = F.col("group_size").isNull()
    return found.select(*(F.col(k).alias(c) for k, c in own.items()), F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("_rid") == F.col("_keep"))).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    return exact_groups(docs, tuple(docs.columns)).where("kept").select(*(f"`{c}`" for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    return exact_groups(docs, ("doc_id", "text_sha256")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
"""

QUERIES = {"op12_exact_dedup": op12_exact_dedup}
ORACLES = {"op12_exact_dedup": ORACLE}
