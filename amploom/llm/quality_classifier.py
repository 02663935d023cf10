"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 junk, 1 toxic, 2 sound. P(grade <= k | x) = sigmoid(threshold_k - w.x): all thresholds share
the weights w of hashed text features, and the thresholds are ordered by construction. A document's expected
grade and its tail probability P(grade >= 2) come from one score; it is kept when the tail probability is at
least ``KEEP``.

Features are hashes of the whole text's words (lower-cased, punctuation off), of their beginnings, of word shapes (letters, capitals,
digits and punctuation, runs collapsed) and of coarse measures. The model is fitted on at most ``SAMPLE``
labelled documents, those with the least hash of their doc_id; a feature needs ``LEAST`` of them and grades that
differ from the sample's beyond chance, so the weights that go to executors are bounded too.

Nulls and odd rows: a null text is empty and scored as such; a null doc_id is scored but never trained on; rows
that repeat a doc_id are each scored, and one of them, that with the least features, is trained on; a document with several labels takes the lowest grade; with no labelled
document at all every document has the top grade and is kept; an empty table gives no rows; other columns pass
through ``classify`` unless they bear the name of one made here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_ids, documents, in_arrow, lowered, mix, runs, settle, text_slices, word_hashes, word_spans

SAMPLE = 12000
STEMS = (5, 7)
LEAST = 4
#: Standard deviations by which a feature's grades must differ from all documents'.
APART = 4.5
KEEP = 0.5
GRADES = 3
#: Bytes of text that one step makes features of: their arrays take about 40 times as much.
SLICE = 1 << 20

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature hashes of each text of a slice, and each text's offset."""
    n = len(offs) - 1
    plain = np.where(_PUNCT[buf], np.uint8(32), lowered(buf))
    s, e, at = word_spans(plain, offs)
    words = word_hashes(plain, s, e)
    doc = np.repeat(np.arange(n), np.diff(at))

    # Beginnings of words, with a feature more for the second and third time: some vocabularies show in stems only.
    stems, stem_docs = [], []
    for size in STEMS:
        long = e - s >= size
        stem = np.zeros(int(long.sum()), np.uint64)
        for k in range(size):
            stem = (stem << np.uint64(8)) | plain[s[long] + k].astype(np.uint64)
        stem, owner = mix(stem ^ np.uint64(size << 58)), doc[long]
        order = np.lexsort((stem, owner))
        stem, owner = stem[order], owner[order]
        edge = runs(owner, stem)
        times = np.diff(edge)
        stem, owner = stem[edge[:-1]], owner[edge[:-1]]
        for t in (1, 2, 3):
            stems.append(mix(stem[times >= t] + np.uint64(t)))
            stem_docs.append(owner[times >= t])

    shape = _SHAPE[buf]
    s2, e2, at2 = word_spans(shape, offs)
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[s2] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    small = shape[keep]
    shapes = mix(word_hashes(small, place[s2], place[e2]) ^ np.uint64(0x51A9E)) if len(s2) else np.zeros(0, np.uint64)
    doc2 = np.repeat(np.arange(n), np.diff(at2))

    size = np.maximum(np.diff(offs), 1)
    share = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offs]) / size
    count = np.diff(at)
    order = np.lexsort((words, doc))
    fresh = np.bincount(doc[order][runs(doc[order], words[order])[:-1]], minlength=n) if len(words) else np.zeros(n)
    measures = [
        np.minimum(20 * share(_PUNCT[buf]), 12).astype(np.int64),
        np.minimum(20 * share((buf >= 65) & (buf <= 90)), 20).astype(np.int64),
        np.minimum(np.log2(count + 1), 6).astype(np.int64),
        (10 * fresh / np.maximum(count, 1) * np.minimum(1, np.sqrt(np.maximum(count, 1) / 400))).astype(np.int64),
    ]
    h = [words, shapes, *stems, *(mix((m + 1000 * (k + 1)).astype(np.uint64)) for k, m in enumerate(measures))]
    d = [doc, doc2, *stem_docs, *[np.arange(n)] * len(measures)]
    h, d = np.concatenate(h), np.concatenate(d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    first = runs(d, h)[:-1]
    return h[first], np.searchsorted(d[first], np.arange(n + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Ordinal:
    """Weights by sorted feature hash, and ordered thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(self.keys) or not len(h):
            return np.zeros(len(at) - 1)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        w = np.where(self.keys[i] == h, self.weights[i], 0.0)
        return np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), w, len(at) - 1)  # of each text alone, whatever stands beside it

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a column each."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit(h: np.ndarray, at: np.ndarray, grade: np.ndarray, rounds: int = 500, ridge: float = 1e-4) -> Ordinal:
    """Maximum penalised likelihood by Adam over the whole sample."""
    n = len(grade)
    if not n:
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, -30.0))
    keys, col, count = np.unique(h, return_inverse=True, return_counts=True)
    # Only features that go with a grade far beyond chance: the others would make the score a measure of length.
    at_most = [np.bincount(col, (grade <= k)[np.repeat(np.arange(n), np.diff(at))], len(keys)) for k in range(GRADES - 1)]
    shares = [(grade <= k).mean() for k in range(GRADES - 1)]
    common = (count >= LEAST) & np.any([np.abs(o - count * p) >= APART * np.sqrt(count * max(p * (1 - p), 1e-6)) for o, p in zip(at_most, shares)], axis=0)
    slot = np.cumsum(common) - 1
    row = np.repeat(np.arange(n), np.diff(at))[common[col]]
    col = slot[col[common[col]]]
    keys = keys[common]
    share = np.array([(grade <= k).mean() for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    par = np.concatenate([np.zeros(len(keys)), [theta[0]], np.log(np.maximum(np.diff(theta), 0.1))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, rounds + 1):
        w = par[: len(keys)]
        gaps = np.exp(par[len(keys) + 1 :])
        theta = par[len(keys)] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, w[col], n)
        edge = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None, :] - z[:, None]), np.ones((n, 1))], axis=1)
        p = np.maximum(edge[np.arange(n), grade + 1] - edge[np.arange(n), grade], 1e-12)
        slope = edge * (1 - edge)
        dz = (slope[np.arange(n), grade + 1] - slope[np.arange(n), grade]) / p / n  # of minus the log-likelihood
        dtheta = np.array([(((grade == k) * slope[:, k + 1] - (grade == k + 1) * slope[:, k + 1]) / p).sum() / -n for k in range(GRADES - 1)])
        g = np.concatenate([np.bincount(col, dz[row], len(keys)) + ridge * w / 10, [dtheta.sum()], dtheta[::-1].cumsum()[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    theta = par[len(keys)] + np.concatenate([[0], np.cumsum(np.exp(par[len(keys) + 1 :]))])
    return Ordinal(keys, par[: len(keys)], theta)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade from quality and toxic ratings; unrated rows go."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model from at most ``sample`` labelled documents, chosen by hash."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    grades = dict(map(tuple, chosen.collect()))
    ids = docs.sparkSession.createDataFrame([(k,) for k in grades] or [(None,)], "doc_id long").where("doc_id is not null")
    # Written once: at most the rows of ``sample`` documents, which are read three times, and the texts of all others once.
    rows = settle(by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ids, "doc_id", "left_semi"), "sample")

    sent = docs.sparkSession.sparkContext.broadcast(grades)  # at most ``sample`` numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([sent.value[d] for d in batch.column("doc_id").to_pylist()], np.int64)
            for lo, hi, buf, offs in text_slices(batch, limit=SLICE):
                h, at = features(buf, offs)
                keys, col = np.unique(h, return_inverse=True)
                grade = np.repeat(own[lo:hi], np.diff(at))
                n = [np.bincount(col, grade == g, len(keys)).astype(np.int64) for g in range(GRADES)]
                yield pa.record_batch([pa.array(keys.view(np.int64)), *map(pa.array, n)], names=["h", *(f"n{g}" for g in range(GRADES))])

    # The features to use are counted and screened where the documents are; the driver sees those that pass.
    there = [sum(1 for d, in rows.select("doc_id").distinct().collect() if grades[d] == g) for g in range(GRADES)]
    total = max(1, sum(there))
    sums = in_arrow(rows, count, "h long, " + ", ".join(f"n{g} long" for g in range(GRADES))).groupBy("h").agg(*(F.sum(f"n{g}").alias(f"n{g}") for g in range(GRADES)))
    n = sum((F.col(f"n{g}") for g in range(1, GRADES)), F.col("n0"))
    odd = F.lit(False)
    for k in range(GRADES - 1):
        p = sum(there[: k + 1]) / total
        most = sum((F.col(f"n{g}") for g in range(1, k + 1)), F.col("n0"))
        odd = odd | (F.abs(most - n * p) >= APART * F.sqrt(n * max(p * (1 - p), 1e-6)))
    keys = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.h for r in sums.where((n >= LEAST) & odd).select("h").collect()], np.int64).view(np.uint64)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch, limit=SLICE):
                h, at = features(buf, offs)
                use = np.isin(h, keys.value)
                upto = np.concatenate([[0], np.cumsum(use)])[at]
                h = h[use]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array([h[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:])], pa.binary())], names=["doc_id", "h"])

    least: dict[int, bytes] = {}  # of rows that repeat a doc_id the one with the least features, in whatever order they come
    for d, b in in_arrow(rows, go, "doc_id long, h binary").collect():
        least[d] = min(least.get(d, bytes(b)), bytes(b))
    got = sorted(least.items())
    each = [np.frombuffer(b, np.uint64) for _, b in got]
    at = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return fit(np.concatenate([np.zeros(0, np.uint64), *each]), at, np.array([grades[d] for d, _ in got], np.int64))


def classify(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """``docs`` with score, expected_grade, p_top (P(grade >= 2)) and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    made = ["score", "expected_grade", "p_top", "kept"]
    docs = docs.drop(*made)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch, limit=SLICE):
                score = sent.value.scores(*features(buf, offs))
                tail = sent.value.tails(score)
                out = batch.slice(lo, hi - lo)
                cols = [*out.columns, *(pa.array(x) for x in (np.round(score, 9), np.round(tail.sum(axis=1), 9), np.round(tail[:, -1], 9), tail[:, -1] >= keep))]
                yield pa.record_batch(cols, names=[*out.schema.names, *made])

    schema = docs.schema
    for name, kind in zip(made, ("double", "double", "double", "boolean")):
        schema = schema.add(name, kind)
    return in_arrow(docs.withColumn("text", F.col("text").cast("string")), go, schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs.select("doc_id", "text"), model).drop("text")


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
