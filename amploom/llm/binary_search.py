"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit a dimension (set where the value is over 0). A code is cut into segments, and each
segment has a table from its value to the codes that have it. A query looks up its own segment values, then all
values one bit away, then two: a code that the first j of m tables haven't given at radius r, nor the others at r - 1,
differs by at least m x r + j bits, so the search ends when the k-th verified distance is below that.

Of equal codes the k rows with the smallest ids are kept, so very common vectors cost no more than others. Rows are
dealt by hash of the code into shards of a bounded size; a task has a shard and a part of the queries: it builds its
tables once, from the rows that come first in its partition, and searches the queries that follow as they stream by, a
block at a time. Every query goes to every shard, and the results of the shards are merged by rank; with several shards
the greater radii are a second pass, in which the k-th distance over all shards is the bound in each. A block's
candidates are compared in pieces, of which only rows no farther than the query's k-th so far are held: memory is that
of the shard's tables, however many candidates there are.

Nulls and odd rows: a null vector has no code and is neither found nor searched for, null elements count as 0; a
null vec_id is left out; rows that repeat a vec_id and code are one, with other codes each counts; vectors of
several lengths, in one table or the two, raise an error; ties are broken by vec_id; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, runs, settle

K = 10
#: Rows of a shard, where a code is one word of 64 bits; of longer codes fewer.
SHARD = 1 << 20
#: Bits of a segment at most.
SEGMENT = 16
#: With several shards, the radii of all shards' first pass are below this.
FIRST = 3
#: Queries searched at a time.
BLOCK = 1 << 13
#: Candidates compared at a time.
PIECE = 1 << 17
#: Queries of a part; there are fewer parts if shards and parts would make more than TASKS tasks.
PART, TASKS = 1 << 12, 48
#: Tasks at least, so that small inputs use all cores too.
LEAST_TASKS = 6


def binary_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, code, dim): the code as bytes, dimension 0 in the lowest bit, padded to whole 8 bytes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat = lists.flatten()
            x = flat.fill_null(0).to_numpy(zero_copy_only=False)
            n = len(lists)
            dim = len(x) // n if n else 0
            if dim * n != len(x) or (n and set(lists.value_lengths().to_pylist()) != {dim}):
                raise ValueError("vectors differ in length")
            bits = np.packbits((x > 0).reshape(n, dim), axis=1, bitorder="little")
            bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
            yield pa.record_batch([b.column("id"), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(np.full(n, dim, np.int32))], names=["id", "code", "dim"])

    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(go, "id long, code binary, dim int")


def flips(bits: int, radius: int) -> np.ndarray:
    """Masks of so many bits of which ``radius`` are set."""
    return np.fromiter((sum(1 << b for b in c) for c in combinations(range(bits), radius)), np.int32, comb(bits, radius))


class MultiIndex:
    """Segment tables over the rows of a shard, each a code and an id.

    Beside its tables a search holds the k best rows of each query so far, and PIECE candidates or those of one segment value.
    """

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")  # rows are numbered by id, so ties are settled by number
        self.ids, codes = ids[order], codes[order]
        self.width = codes.shape[1] * 64
        edge = np.linspace(0, self.width, -(-self.width // max(4, min(SEGMENT, int(np.log2(max(len(ids), 2)))))) + 1).astype(int).tolist()
        self.cuts = list(zip(edge[:-1], edge[1:]))
        self.codes, self.tables = codes, []
        for lo, hi in self.cuts:
            v = self.segment(codes, (lo, hi))
            order = np.argsort(v, kind="stable").astype(np.int32)
            start = np.zeros((1 << (hi - lo)) + 1, np.int32)
            np.cumsum(np.bincount(v, minlength=len(start) - 1), out=start[1:])
            self.tables.append((np.flatnonzero(np.diff(start)).astype(np.int32), start, order, codes[order] if codes.shape[1] == 1 else None))  # long codes are not copied for each table

    @staticmethod
    def segment(codes: np.ndarray, cut: tuple[int, int]) -> np.ndarray:
        lo, hi = cut
        w, s = divmod(lo, 64)
        v = codes[:, w] >> np.uint64(s)
        if s + hi - lo > 64:
            v = v | (codes[:, w + 1] << np.uint64(64 - s))
        return (v & np.uint64((1 << (hi - lo)) - 1)).astype(np.int32)

    def search(self, queries: np.ndarray, k: int, bound: np.ndarray | None = None, first: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of each query's k nearest rows, ties by id, in this order.

        ``bound``: greatest distance asked for, by query; ``first``, ``end``: only rows that a segment has given at radius ``first``
        to ``end`` - 1 and none before.
        """
        n, m = len(queries), len(self.cuts)
        low, high = len(self.ids).bit_length(), self.width.bit_length()  # a row found is one number: query, distance, row
        best, bound = np.zeros(0, np.int64), np.full(n, self.width, np.int64) if bound is None else bound.copy()

        def merge(found: list[np.ndarray]) -> np.ndarray:
            keys = np.sort(np.concatenate([best, *found]))
            keys = keys[runs(keys)[:-1]]  # several segments may give a row
            owner = keys >> (low + high)
            place = np.arange(len(keys)) - np.searchsorted(owner, np.arange(n))[owner]
            last = np.flatnonzero(place == k - 1)
            bound[owner[last]] = keys[last] >> low & (1 << high) - 1
            return keys[place < k]

        for radius in range(first, max(hi - lo for lo, hi in self.cuts) + 1 if end is None else end):
            for j, cut in enumerate(self.cuts):
                # a row not found yet differs by over radius bits in the segments before j, by radius or more in the others
                active = np.flatnonzero(bound >= m * radius + j)
                if not len(active):
                    break
                mine, found, held = self.segment(queries, cut), [], 0
                for owner, lo, size in self.lookups(j, radius, mine, active):
                    for who, dist, row in self.compared(j, queries, bound, owner, lo, size):
                        if first:
                            new = self.apart(queries[who], row) >= first
                            who, dist, row = who[new], dist[new], row[new]
                        found.append(who << (low + high) | dist << low | row)
                        held += len(row)
                        if held > PIECE:
                            best, found, held = merge(found), [], 0
                best = merge(found)
        return best >> (low + high), self.ids[best & (1 << low) - 1], best >> low & (1 << high) - 1

    def apart(self, queries: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The least number of bits by which a segment of a query and a row differ."""
        x = queries ^ self.codes[row]
        return np.min([np.bitwise_count(self.segment(x, cut)) for cut in self.cuts], axis=0)

    def lookups(self, j: int, radius: int, mine: np.ndarray, active: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, first place, number of places) in table ``j`` for its values that are ``radius`` bits away from an active query's."""
        values, start = self.tables[j][:2]
        bits = self.cuts[j][1] - self.cuts[j][0]
        if radius > bits:
            return
        few = comb(bits, radius) <= len(values)  # else it is less work to go through the values that there are
        masks = flips(bits, radius) if few else values
        step = max(1, PIECE // len(masks))
        for a in range(0, len(active), step):
            q = active[a : a + step]
            v = mine[q][:, None] ^ masks
            if few:
                v = v.ravel()
                lo = start[v]
                size = start[1:][v] - lo
                hit = np.flatnonzero(size)
                yield q[hit // len(masks)], lo[hit], size[hit]
            else:
                i, at = np.nonzero(np.bitwise_count(v) == radius)
                lo = start[values[at]]
                yield q[i], lo, start[values[at] + 1] - lo

    def compared(self, j: int, queries: np.ndarray, bound: np.ndarray, owner: np.ndarray, lo: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, distance, row) of the rows at such places that are no farther than the query's bound, a piece at a time."""
        order, codes = self.tables[j][2:]
        words = queries.shape[1]
        end = np.cumsum(size, dtype=np.int64)
        a = done = 0
        while a < len(owner):
            b = max(a + 1, int(np.searchsorted(end, done + PIECE // words, "right")))
            q, s = owner[a:b], size[a:b]
            at = np.repeat(lo[a:b] - (end[a:b] - s - done).astype(np.int32), s)
            at += np.arange(len(at), dtype=np.int32)
            if codes is not None:
                dist = np.bitwise_count(codes[:, 0].take(at) ^ np.repeat(queries[q, 0], s))
            else:
                dist = np.bitwise_count(self.codes[order[at]] ^ np.repeat(queries[q], s, axis=0)).sum(axis=1, dtype=np.int32)
            near = np.flatnonzero(dist <= int(bound[q].max()))
            who = q[np.searchsorted(end[a:b], near + done, "right")]
            far = dist[near].astype(np.int64)
            keep = far <= bound[who]
            yield who[keep], far[keep], order[at[near[keep]]].astype(np.int64)
            a, done = b, int(end[b - 1])


def _load(codes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint64).reshape(len(codes), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: for each row of ``queries`` the k rows of ``vectors`` with the least Hamming distance, ties by id."""
    first = settle(binary_codes(vectors, id_col, vec_col).distinct(), "codes")
    asked = settle(binary_codes(queries, id_col, vec_col).distinct(), "asked")
    least, most = first.select("dim").union(asked.select("dim")).agg(F.min("dim"), F.max("dim")).first()
    if least != most:
        raise ValueError(f"vectors of {least} and of {most} dimensions")
    kept = first.withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("r") <= k)
    entries = settle(kept.select("code", "id"), "entries")
    codes = settle(asked.select("code").distinct(), "asked")
    words = max(1, -(-(most or 0) // 64))
    shards = max(1, -(-entries.count() * words // SHARD))
    copy = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    ranked = lambda found: settle(found.withColumn("rank", F.row_number().over(W.partitionBy("code").orderBy("distance", "vec_id")).cast("long")).where(F.col("rank") <= k), "best")

    def search(asked: DataFrame, first: int, end: int | None) -> DataFrame:
        """(code, vec_id, distance) of what each shard has for the codes of ``asked``, by the bounds there."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, ids, index = [], [], None
            try:
                for b in batches:
                    n = int(np.count_nonzero(~b.column("asked").to_numpy(zero_copy_only=False)))  # entries are before all queries
                    if n:
                        codes.append(_load(b.column("code").slice(0, n)))
                        ids.append(np.array(b.column("x").slice(0, n)))
                    if n == b.num_rows or not (codes or index):
                        continue
                    if index is None:
                        index = MultiIndex(np.concatenate(codes), np.concatenate(ids))
                        codes.clear()
                        ids.clear()
                    for lo in range(n, b.num_rows, BLOCK):
                        block = b.column("code").slice(lo, BLOCK)
                        owner, found, dist = index.search(_load(block), k, np.array(b.column("x").slice(lo, BLOCK)), first, end)
                        yield pa.record_batch([block.take(pa.array(owner)), pa.array(found), pa.array(dist)], names=["code", "vec_id", "distance"])
            finally:
                index = None
                release()

        parts = max(-(-LEAST_TASKS // shards), min(-(-asked.count() // PART), TASKS // shards))
        left = entries.select(deal(shards).alias("shard"), copy(parts).alias("part"), F.lit(False).alias("asked"), "code", F.col("id").alias("x"))
        right = asked.select(copy(shards).alias("shard"), deal(parts).alias("part"), F.lit(True).alias("asked"), "code", F.col("bound").alias("x"))
        # one partition a shard and part, which adaptive execution leaves as it is
        dealt = left.unionByName(right).repartitionById(shards * parts, F.col("shard") * parts + F.col("part")).sortWithinPartitions("asked")
        return dealt.select("asked", "code", "x").mapInArrow(go, "code binary, vec_id long, distance long")

    everywhere = F.lit(64 * words).cast("long").alias("bound")
    if shards == 1:
        best = ranked(search(codes.select("code", everywhere), 0, None))
    else:  # the k-th over all shards is nearer than a shard's own, so most of them needn't look at all radii
        near = ranked(search(codes.select("code", everywhere), 0, FIRST)).drop("rank")
        kth = near.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("d")).where(F.col("n") == k)
        rest = settle(codes.join(kth, "code", "left").select("code", F.coalesce("d", everywhere).alias("bound")).where(F.col("bound") >= -(-64 * words // SEGMENT) * FIRST), "asked")
        best = ranked(near.unionByName(search(rest, FIRST, None)))
    lists = best.groupBy("code").agg(F.collect_list(F.struct("rank", "vec_id", "distance")).alias("x"))  # k rows a code
    return asked.select(F.col("id").alias("query_id"), "code").join(lists, "code").select("query_id", F.explode("x").alias("x")).select("query_id", "x.rank", "x.vec_id", "x.distance")


def op1_binary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE = """
with c as (select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as b from embeddings),
p as (select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.b, v.b), lambda z: abs(z[1] - z[2])))::bigint as distance from c q, c v where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from p)
select query_id, rank, vec_id, distance from r where rank <= 10
"""

QUERIES = {"op1_binary_search": op1_binary_search}
ORACLES = {"op1_binary_search": ORACLE}
