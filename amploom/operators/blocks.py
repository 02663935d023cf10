"""State graphs larger than one machine: products and forward values over blocks of states.

A block is a range of ``size`` state ids. Links become tiles, one row a pair of source and target block that any link
joins; a vector has one row a series and block, with the states reached only, so that its cost follows the frontier,
not the graph. A product joins vectors and tiles by source block, numpy adds each tile's links up, and one shuffle
brings the partial vectors of a target block together: at most one value a state and tile. Tiles and states are dealt by
block once and kept; nothing is collected but the numbers of frames that occur.

Values are logs; a state that isn't reached has no row, and links or start values that are NULL count as 0 chances.
Links, start values or states that occur twice add up, but two emissions of one state are an error. No links or no
frames: no rows. A state without an emission can't be left or reached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import written

SIZE = 1024
VECTOR = "series long, block long, at array<int>, v array<double>"


def _block(c: str, size: int):
    return F.floor(F.col(c) / size), (F.col(c) % size).cast("int")


def link_tiles(links: DataFrame, size: int = SIZE) -> DataFrame:
    """(block, target, src, dst, lp) of ``links`` (source, target, lp): ids are offsets in their blocks. At most size * size different links a row."""
    (sb, s), (tb, t) = _block("source", size), _block("target", size)
    one = links.where("lp is not null").groupBy("source", "target").agg(F.max("lp").alias("m"), F.collect_list("lp").alias("all"))
    total = F.col("m") + F.ln(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m"))))
    rows = one.select(sb.alias("block"), tb.alias("target"), F.struct(s.alias("s"), t.alias("t"), total.alias("lp")).alias("l"))
    return rows.groupBy("block", "target").agg(F.collect_list("l").alias("l")).select("block", "target", F.col("l.s").alias("src"), F.col("l.t").alias("dst"), F.col("l.lp").alias("lp"))


def pack(vec: DataFrame, size: int = SIZE) -> DataFrame:
    """VECTOR rows of (series, id, v)."""
    b, at = _block("id", size)
    rows = vec.where("v is not null").select(F.col("series").cast("long").alias("series"), b.alias("block"), F.struct(at.alias("at"), F.col("v").cast("double").alias("v")).alias("x"))
    return rows.groupBy("series", "block").agg(F.collect_list("x").alias("x")).select("series", "block", F.col("x.at").alias("at"), F.col("x.v").alias("v"))


def unpack(vec: DataFrame, size: int = SIZE) -> DataFrame:
    """(series, id, v) of VECTOR rows."""
    return vec.select("series", "block", F.inline(F.arrays_zip("at", "v"))).select("series", (F.col("block") * size + F.col("at")).alias("id"), "v")


def log_sums(at: np.ndarray, v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that occur and the logsumexp of each one's values."""
    top = np.full(size, -np.inf)
    np.maximum.at(top, at, v)
    sums = np.bincount(at, np.exp(v - np.where(np.isfinite(top), top, 0.0)[at]), size)
    some = np.flatnonzero(sums)
    return some, top[some] + np.log(sums[some])


def _rows(series, blocks, vectors, extra=()) -> pa.RecordBatch:
    at = pa.array([a.astype(np.int32) for a, _ in vectors], pa.list_(pa.int32()))
    v = pa.array([x for _, x in vectors], pa.list_(pa.float64()))
    return pa.record_batch([pa.array(series, pa.int64()), pa.array(blocks, pa.int64()), at, v, *(x for _, x in extra)], names=["series", "block", "at", "v", *(n for n, _ in extra)])


def _cells(column: pa.Array) -> Iterator[np.ndarray]:
    """Each list of a column, as a view."""
    edge, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return (flat[a:b] for a, b in zip(edge[:-1], edge[1:]))


def vec_mat(vec: DataFrame, tiles: DataFrame, size: int = SIZE, parts: int | None = None) -> DataFrame:
    """VECTOR rows of the product: by target the logsumexp over sources of v + lp. For links times a vector give the tiles of the links transposed."""
    parts = parts or int(vec.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            series, target, out = [], [], []
            for s, t, at, v, src, dst, lp in zip(b.column("series").to_pylist(), b.column("target").to_pylist(), *(_cells(b.column(c)) for c in ("at", "v", "src", "dst", "lp"))):
                full = np.full(size, -np.inf)
                full[at] = v
                moved = full[src] + lp
                on = moved > -np.inf
                if on.any():
                    series.append(s)
                    target.append(t)
                    out.append(log_sums(dst[on], moved[on], size))
            yield _rows(series, target, out)

    def together(table: pa.Table) -> pa.Table:
        if len(table) == 1:
            return table.select(["series", "block", "at", "v"])
        table = table.combine_chunks()
        flat = [table[c].combine_chunks().flatten().to_numpy() for c in ("at", "v")]
        return pa.Table.from_batches([_rows(table["series"].to_pylist()[:1], table["block"].to_pylist()[:1], [log_sums(*flat, size)])])

    partial = vec.join(tiles, "block").select("series", "target", "at", "v", "src", "dst", "lp").mapInArrow(step, VECTOR)
    return partial.repartition(parts, "block").groupBy("series", "block").applyInArrow(together, VECTOR)


def forward(links: DataFrame, start: DataFrame, states: DataFrame, frames: DataFrame, density: Callable[..., np.ndarray], size: int = SIZE, cut: int = 8) -> DataFrame:
    """(series, id, v): the forward values at each series' last frame.

    ``links`` (source, target, lp), ``start`` (series, id, v), ``states`` (id and parameters), ``frames`` (series, t from 0
    without gaps, x); ``density(x, *parameters)`` is the log-density of a block's states, parameters in the order of
    columns. Every ``cut`` frames the vectors are written to the shared folder, as are those of series that end.
    """
    spark = links.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in states.columns if c != "id"]
    b, at = _block("id", size)
    packed = states.select(b.alias("block"), F.struct(at.alias("at"), *(F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(names))).alias("x")).groupBy("block").agg(F.collect_list("x").alias("x"))
    params = [f"p{i}" for i in range(len(names))]
    packed = written(packed.select("block", F.col("x.at").alias("s_at"), *(F.col(f"x.{p}").alias(p) for p in params)))
    tiles = written(link_tiles(links, size))
    seen = written(frames.select(F.col("series").cast("long").alias("series"), "t", F.col("x").cast("double").alias("x")))
    ends = {r.n for r in seen.groupBy("series").agg(F.count("*").alias("n")).select("n").distinct().collect()}  # as many as there are lengths
    lengths = seen.groupBy("series").agg(F.count("*").alias("n"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series, block, out = [], [], []
            for s, k, x, at, v, own, *p in zip(*(batch.column(c).to_pylist() for c in ("series", "block", "x")), *(_cells(batch.column(c)) for c in ("at", "v", "s_at", *params))):
                if len(np.unique(own)) < len(own):
                    raise ValueError(f"a state of block {k} has two emissions")
                full = np.full(size, -np.inf)
                full[own] = density(x, *p)
                v = v + full[at]
                on = v > -np.inf
                if on.any():
                    series.append(s)
                    block.append(k)
                    out.append((at[on], v[on]))
            yield _rows(series, block, out)

    dealt = [t.repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK) for t in (tiles, packed)]
    try:
        vec, done = pack(start, size).repartition(parts, "block"), []
        for t in range(max(ends, default=0)):
            if t:
                vec = vec_mat(vec, dealt[0], size, parts)
            now = seen.where(F.col("t") == t).select("series", "x")
            vec = vec.join(now, "series").join(dealt[1], "block").mapInArrow(emit, VECTOR)
            if t + 1 in ends or (t + 1) % cut == 0:
                vec = written(vec)
            if t + 1 in ends:
                done.append(vec.join(lengths.where(F.col("n") == t + 1).select("series"), "series", "left_semi"))
    finally:
        for x in dealt:
            x.unpersist()
    out = unpack(spark.createDataFrame([], VECTOR), size)
    for x in done:
        out = out.unionByName(unpack(x, size))
    return out
