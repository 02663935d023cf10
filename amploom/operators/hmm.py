"""Hidden Markov models over reads: banded Baum-Welch training, Viterbi paths, labels, classes.

Training is a driver loop of one distributed pass an iteration: the model is broadcast (its size is the state
graph's, not the data's), ``mapInPandas`` runs forward and backward over each task's reads and adds their expected
counts up, and one ``groupBy(kind, key, ...)`` sums the tasks' rows. What returns to the driver has a row a
parameter. Counts are summed outside log space: posteriors are normalised at each step, so they can't overflow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.models import Mixture, Model, normalise_links, pooled_covariances
from .lattice import Lattice, best_paths, expected_counts, log_likelihoods

STATS = "kind string, key string, comp int, i int, j int, val double"


@dataclass(frozen=True)
class Options:
    """What an iteration updates: emissions, transitions, start; and whether covariances are tied."""

    emission: bool = True
    transition: bool = True
    start: bool = False
    tied: bool = False

    @classmethod
    def parse(cls, method: str) -> Options:
        if bad := set(method) - set("etps"):
            raise ValueError(f"unknown method letters: {''.join(sorted(bad))}")
        return cls("e" in method, "t" in method, "p" in method, "s" in method)


def e_step(reads: DataFrame, model: Model, width: int, dim: int = 1) -> DataFrame:
    """The reads' summed statistics: STATS rows. ``reads`` has chrom, signal and mv."""
    sent = reads.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, float] = {}
        lattice = Lattice(sent.value, width)
        for b in batches:
            xs, walks, dropped = [], [], 0
            for chrom, signal, mv in zip(b["chrom"], b["signal"], b["mv"]):
                x = np.asarray(signal, float)
                x = x[: len(x) // dim * dim].reshape(-1, dim)
                if len(mv) != len(x):
                    raise ValueError(f"{len(mv)} moves for {len(x)} frames")
                walk = lattice.walk(chrom, np.asarray(mv, int), len(x))
                if walk is None or not len(x):
                    dropped += 1
                else:
                    xs.append(x)
                    walks.append(walk)
            found, lost = expected_counts(lattice, xs, walks)
            if dropped + lost:
                found["dropped", "", 0, 0, 0] = float(dropped + lost)
            for k, v in found.items():
                total[k] = total.get(k, 0.0) + v
        if total:
            yield pd.DataFrame([(*k, v) for k, v in total.items()], columns=["kind", "key", "comp", "i", "j", "val"])

    made = reads.select("chrom", "signal", "mv").mapInPandas(go, STATS)
    return made.groupBy("kind", "key", "comp", "i", "j").agg(F.sum("val").alias("val"))


def by_key(stats: DataFrame) -> dict[tuple, float]:
    """STATS rows on the driver: a row a parameter."""
    return {(r.kind, r.key, r.comp, r.i, r.j): r.val for r in stats.collect()}


def m_step(model: Model, stats: dict[tuple, float], options: Options, keep_unseen_rows: bool = False) -> Model:
    """New parameters from summed statistics: each emission finishes its own sums. Tied covariances are of mixtures only."""
    emissions = dict(model.emissions)
    if options.emission:
        sums: dict[str, dict[tuple, float]] = {k: {} for k in emissions}
        for (kind, key, *at), v in stats.items():
            if key in sums:
                sums[key][kind, *at] = v
        pooled = pooled_covariances([(m, sums[k]) for k, m in emissions.items() if isinstance(m, Mixture)]) if options.tied else {}
        emissions = {k: m.updated(sums[k], pooled) if isinstance(m, Mixture) else m.updated(sums[k]) for k, m in emissions.items()}
    logp, logpi = model.logp, model.logpi
    with np.errstate(divide="ignore"):
        if options.transition:
            counts = np.array([stats.get(("xi", "", 0, int(a), int(b)), 0.0) for a, b in model.edges])
            logp = normalise_links(model.edges, np.log(counts), model.logp if keep_unseen_rows else None)
        if options.start:
            pi = np.array([stats.get(("pi", "", 0, s, 0), 0.0) for s in range(model.states)])
            logpi = np.log(pi / pi.sum()) if pi.sum() else logpi
    return replace(model, emissions=emissions, logp=logp, logpi=logpi)


def usable(reads: DataFrame, states: int, least: int = 3000, batch: int = 1, sampling: int = 0) -> DataFrame:
    """The reads that train: at least ``least`` samples and more than the model has states.

    ``sampling``: no more batches (of ``batch`` reads in read order, counted before the second filter) once so many are kept; 0: all.
    """
    long = reads.where(F.size("signal") >= least)
    kept = F.size("signal") > states
    if not sampling:
        return long.where(kept)
    # Batches are numbered from counts of read_index only, by blocks of indexes; the window over blocks has a row each.
    ids = long.select("read_index", kept.alias("k"), F.floor(F.col("read_index") / 65536).alias("block"))
    sizes = ids.groupBy("block").agg(F.count("*").alias("c"))
    offset = sizes.select("block", (F.sum("c").over(W.orderBy("block")) - F.col("c")).alias("first"))
    place = F.col("first") + F.row_number().over(W.partitionBy("block").orderBy("read_index")) - 1
    numbered = ids.join(offset, "block").withColumn("b", F.floor(place / batch)).select("read_index", "k", "b")
    sums = numbered.groupBy("b").agg(F.sum(F.col("k").cast("int")).alias("n"))
    before = sums.select("b", (F.sum("n").over(W.orderBy("b")) - F.col("n")).alias("before")).where(F.col("before") < sampling)
    chosen = numbered.join(before, "b").where("k").select("read_index")
    return long.join(chosen, "read_index", "left_semi")


def train(reads: DataFrame, model: Model, iterations: int = 10, width: int = 50, method: str = "et", least: int = 3000, batch: int = 1, sampling: int = 0, keep_unseen_rows: bool = False) -> tuple[Model, list[tuple[int, float, float]]]:
    """The trained model and (iteration, score, residual): the score is the sum over reads of the mean log-likelihood of a frame."""
    from pyspark.storagelevel import StorageLevel

    options, history, before = Options.parse(method), [], 0.0
    kept = usable(reads, model.states, least, batch, sampling).select("chrom", "signal", "mv").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for it in range(iterations):
            stats = by_key(e_step(kept, model, width, model.dim))
            score = stats.get(("score", "", 0, 0, 0), 0.0)
            history.append((it, score, score - before))
            before = score
            model = m_step(model, stats, options, keep_unseen_rows)
    finally:
        kept.unpersist()
    return model, history


def viterbi(model: Model, x: np.ndarray) -> tuple[float, np.ndarray]:
    """(log-probability, states) of the best path over all states; of equal sources the lowest wins."""
    return best_paths(model, [x])[0]


def forward_loglik(model: Model, *xs: np.ndarray) -> np.ndarray:
    """ln P of each read over all states; of no frames, minus infinity."""
    return log_likelihoods(Lattice(model, None), list(xs), [np.zeros(len(x), int) for x in xs])


def with_paths(reads: DataFrame, model: Model, score: str = "score", path: str = "path") -> DataFrame:
    """``reads`` with the Viterbi score and states of each; signals go through Arrow in batches."""
    sent = reads.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score:double,path:array<int>>")
    def best(signal: pd.Series) -> pd.DataFrame:
        dim = sent.value.dim
        got = best_paths(sent.value, [np.asarray(s, float)[: len(s) // dim * dim].reshape(-1, dim) for s in signal])
        return pd.DataFrame({"score": [g[0] for g in got], "path": [g[1] for g in got]})

    out = reads.withColumn("_v", best("signal"))
    return out.withColumn(score, F.col("_v.score")).withColumn(path, F.col("_v.path")).drop("_v")


def label_reads(reads: DataFrame, model: Model) -> DataFrame:
    """``reads`` with mv replaced by the position of each frame's state."""
    table = F.array(*(F.lit(int(p)) for p in model.position))
    return with_paths(reads, model).withColumn("mv", F.transform("path", lambda s: F.get(table, s))).drop("path")


def classify_reads(reads: DataFrame, model: Model) -> DataFrame:
    """(uuid, label_real, label_predict): the last character of chrom as a digit, and of the first frame's state's label."""
    digits = F.array(*(F.lit(float(ord(x[-1:] or "0") - 48)) for x in model.label))
    return with_paths(reads, model).select("uuid", (F.ascii(F.right("chrom", F.lit(1))) - 48).cast("double").alias("label_real"), F.get(digits, F.get("path", F.lit(0))).alias("label_predict"))


def run_means(reads: DataFrame, runs: int = 50, most: int = 50, drop_last_run: bool = False) -> DataFrame:
    """read_id, label, c0 .. c49: the mean of the first ``most`` samples of each of the first ``runs`` runs of mv."""
    long = reads.select("uuid", "chrom", F.posexplode(F.arrays_zip("signal", "mv")).alias("pos", "z")).select("uuid", "chrom", "pos", F.col("z.signal").alias("x"), F.col("z.mv").alias("mv"))
    w = W.partitionBy("uuid").orderBy("pos")
    seg = long.withColumn("c", F.when(F.col("mv") != F.lag("mv").over(w), 1).otherwise(0)).withColumn("seg", F.sum("c").over(w))
    place = seg.withColumn("k", F.row_number().over(W.partitionBy("uuid", "seg").orderBy("pos")) - 1).withColumn("last", F.max("seg").over(W.partitionBy("uuid")))
    rows = place.where((F.col("seg") < runs) & (F.col("k") < most))
    rows = rows.where("seg < last") if drop_last_run else rows
    label = (F.ascii(F.right("chrom", F.lit(1))) - 48).cast("int").alias("label")
    out = rows.groupBy(F.col("uuid").alias("read_id"), label).pivot("seg", list(range(runs))).agg(F.avg("x"))
    return out.withColumnsRenamed({str(i): f"c{i}" for i in range(runs)})
