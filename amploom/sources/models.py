"""Model JSON and FASTA.

A model has nodes (id, seq_id, kmer, label), links (source, target, prob) and an object of emissions by
"kmer_label" (peak, dim, params, and family if it is no Gaussian mixture). Unknown fields of the JSON survive a save, which replaces the emissions' params
and the links only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id int, seq_id int, kmer string, label string"
LINKS = "source int, target int, prob double"
EMISSIONS = "key string, peak int, dim int, params array<double>"


class Emission(Protocol):
    """What training asks of a state's emission. Parts of the frames are summed apart, in tasks, and added up."""

    dim: int

    def log_density(self, x: np.ndarray) -> np.ndarray: ...
    def sums(self, x: np.ndarray, w: np.ndarray) -> dict[tuple, float]: ...
    def updated(self, sums: dict[tuple, float]) -> Emission: ...
    def pack(self) -> list[float]: ...


def _total(c: np.ndarray) -> np.ndarray:
    m = c.max(axis=1, keepdims=True)
    return m + np.log(np.exp(c - m).sum(axis=1, keepdims=True))


@dataclass
class Mixture:
    """Gaussian mixture in ``dim`` dimensions: log weights (K), means (K, D), covariances (K, D, D)."""

    logw: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    @classmethod
    def unpack(cls, params: list[float], peak: int, dim: int, seed: int = 42) -> Mixture:
        """From [weight, mean, covariance by rows] a component; no params: means 0, variances near 0.145, equal weights."""
        if not params:
            var = np.random.default_rng(seed).uniform(0.14, 0.15, (peak, dim))
            return cls(np.full(peak, -np.log(peak)), np.zeros((peak, dim)), np.stack([np.diag(v) for v in var]))
        p = np.asarray(params, float)
        if len(p) != peak * (dim * dim + dim + 1):
            raise ValueError(f"{len(p)} parameters for {peak} components in {dim} dimensions")
        p = p.reshape(peak, -1)
        with np.errstate(divide="ignore"):
            return cls(np.log(p[:, 0]), p[:, 1 : dim + 1], p[:, dim + 1 :].reshape(peak, dim, dim))

    def pack(self) -> list[float]:
        return np.concatenate([np.exp(self.logw)[:, None], self.mean, self.cov.reshape(len(self.logw), -1)], axis=1).ravel().tolist()

    def log_components(self, x: np.ndarray) -> np.ndarray:
        """(T, K) log density of each component, weights included."""
        out = np.empty((len(x), len(self.logw)))
        for k, (w, m, c) in enumerate(zip(self.logw, self.mean, self.cov)):
            low = np.linalg.cholesky(c)
            y = np.linalg.solve(low, (x - m).T)
            out[:, k] = w - 0.5 * x.shape[1] * np.log(2 * np.pi) - np.log(np.maximum(np.diag(low), 1e-12)).sum() - 0.5 * (y * y).sum(axis=0)
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return _total(self.log_components(x))[:, 0]

    score = log_density

    @property
    def dim(self) -> int:
        return self.mean.shape[1]

    def sums(self, x: np.ndarray, w: np.ndarray) -> dict[tuple, float]:
        """Of weighted frames, by (kind, component, i, j): weight, weighted values and products. Sums of two parts add up to those of both."""
        c = self.log_components(x)
        r = np.exp(c - _total(c)) * w[:, None]
        out: dict[tuple, float] = {}
        for m in range(r.shape[1]):
            out["g", m, 0, 0] = float(r[:, m].sum())
            for i in range(x.shape[1]):
                out["x", m, i, 0] = float(r[:, m] @ x[:, i])
                for j in range(i + 1):
                    out["xx", m, i, j] = float(r[:, m] @ (x[:, i] * x[:, j]))
        return out

    def moments(self, sums: dict[tuple, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, d = self.mean.shape
        g = np.array([sums.get(("g", c, 0, 0), 0.0) for c in range(n)])
        x = np.array([[sums.get(("x", c, i, 0), 0.0) for i in range(d)] for c in range(n)])
        xx = np.array([[[sums.get(("xx", c, max(i, j), min(i, j)), 0.0) for j in range(d)] for i in range(d)] for c in range(n)])
        return g, x, xx

    def updated(self, sums: dict[tuple, float], covariances: dict[int, np.ndarray] | None = None) -> Mixture:
        """From summed ``sums``; ``covariances`` by component go before its own. A component whose covariance is not positive definite keeps all of its own."""
        g, x, xx = self.moments(sums)
        if g.sum() <= 1e-8:
            return self
        logw, mean, cov = self.logw.copy(), self.mean.copy(), self.cov.copy()
        for c in np.flatnonzero(g > 1e-12).tolist():
            mu = x[c] / g[c]
            sigma = (covariances or {}).get(c, xx[c] / g[c] - np.outer(mu, mu))
            try:
                np.linalg.cholesky(sigma)
            except np.linalg.LinAlgError:
                continue
            logw[c], mean[c], cov[c] = np.log(g[c] / g.sum()), mu, sigma
        return Mixture(logw, mean, cov)


def pooled_covariances(parts: list[tuple[Mixture, dict[tuple, float]]]) -> dict[int, np.ndarray]:
    """The covariance of all mixtures' frames, by component."""
    out: dict[int, np.ndarray] = {}
    sums = [m.moments(s) for m, s in parts]
    for c in range(max((len(s[0]) for s in sums), default=0)):
        g = sum(s[0][c] for s in sums if len(s[0]) > c)
        if g > 1e-8:
            mean = sum(s[1][c] for s in sums if len(s[0]) > c) / g
            out[c] = sum(s[2][c] for s in sums if len(s[0]) > c) / g - np.outer(mean, mean)
    return out


@dataclass
class Model:
    """A state graph with its emissions, as arrays small enough to send to every task."""

    source: dict
    position: np.ndarray
    label: list[str]
    key: list[str]
    edges: np.ndarray  # (E, 2), sorted by source and target
    logp: np.ndarray
    emissions: dict[str, Emission]
    logpi: np.ndarray
    bands: dict[str, list[np.ndarray]] = field(default_factory=dict)

    @property
    def states(self) -> int:
        return len(self.position)

    @property
    def dim(self) -> int:
        return next(iter(self.emissions.values())).dim

    def positions(self, chrom: str | None) -> list[np.ndarray] | None:
        """The states at each position for a read's label; a model with one label uses it for all reads."""
        return next(iter(self.bands.values())) if len(self.bands) == 1 else self.bands.get(chrom or "")


def normalise_links(edges: np.ndarray, logp: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Rows of log-probabilities made to sum to 1. A row without any stays impossible, or takes the values of ``keep``."""
    out = logp.copy()
    if len(edges):
        first = np.flatnonzero(np.append(True, edges[1:, 0] != edges[:-1, 0]))
        size = np.diff(np.append(first, len(edges)))
        total = np.repeat(np.logaddexp.reduceat(logp, first), size)
        seen = np.isfinite(total)
        out[seen] -= total[seen]
        if keep is not None:
            out[~seen] = keep[~seen]
    return out


def _emission(e: dict) -> Emission:
    """``family``: mixture (the default), gaussian (mean and covariance by rows) or histogram (low, high and bins by dimension, probabilities of cells)."""
    from ..operators.families import GaussianEmission, HistogramEmission

    family, params = e.get("family", "mixture"), e.get("params") or []
    if family == "mixture":
        return Mixture.unpack(params, e["peak"], e["dim"])
    if family == "gaussian":
        return GaussianEmission.unpack(params, e["dim"])
    if family == "histogram":
        return HistogramEmission.unpack(params, e["low"], e["high"], e["bins"])
    raise ValueError(f"no emission family {family}")


def parse_model(text: str) -> Model:
    doc = json.loads(text)
    nodes = sorted(doc["nodes"], key=lambda n: n["id"])
    if [n["id"] for n in nodes] != list(range(len(nodes))):
        raise ValueError("node ids must be 0, 1, 2, ...")
    emissions = {k: _emission(e) for k, e in doc["emission"].items()}
    key = [f"{n['kmer']}_{n['label']}" for n in nodes]
    if missing := sorted(set(key) - set(emissions)):
        raise ValueError(f"nodes without emission: {', '.join(missing[:5])}")
    if len({m.dim for m in emissions.values()}) > 1:
        raise ValueError("emissions differ in dimension")
    links = sorted((x["source"], x["target"], x["prob"]) for x in doc["links"])
    edges = np.array([x[:2] for x in links], int).reshape(-1, 2)
    with np.errstate(divide="ignore"):
        logp = normalise_links(edges, np.log(np.array([x[2] for x in links], float)))
    label, position = [n["label"] for n in nodes], np.array([n["seq_id"] for n in nodes])
    names = sorted(set(label) - {"*"}) or [""]
    bands = {}
    for name in names:
        mine = [i for i in range(len(nodes)) if label[i] in (name, "*")]
        by: list[list[int]] = [[] for _ in range(max((position[i] for i in mine), default=-1) + 1)]
        for i in mine:
            by[position[i]].append(i)
        bands[name] = [np.array(sorted(b), int) for b in by]
    logpi = np.where(position == 0, 0.0, -np.inf)
    return Model(doc, position, label, key, edges, logp, emissions, logpi, bands)


def load_model(path: str) -> Model:
    from .signalbin import filesystem

    fs, p = filesystem(path)
    with fs.open_input_stream(p) as f:
        return parse_model(f.read().decode())


def dump_model(model: Model) -> str:
    doc = json.loads(json.dumps(model.source))
    for k, m in model.emissions.items():
        doc["emission"][k]["params"] = m.pack()
    doc["links"] = [{"source": int(a), "target": int(b), "prob": float(np.exp(p))} for (a, b), p in zip(model.edges, model.logp)]
    return json.dumps(doc, indent=4)


def save_model(model: Model, path: str) -> None:
    from .signalbin import filesystem

    fs, p = filesystem(path)
    with fs.open_output_stream(p) as f:
        f.write(dump_model(model).encode())


def frames_of(spark: SparkSession, model: Model) -> dict[str, DataFrame]:
    """The model as tables: nodes, links, emission, and expand_seq (label, seq_id, states)."""
    nodes = [(n["id"], n["seq_id"], n["kmer"], n["label"]) for n in model.source["nodes"]]
    links = [(int(a), int(b), float(np.exp(p))) for (a, b), p in zip(model.edges, model.logp)]
    emission = [(k, int(model.source["emission"][k].get("peak", 1)), m.dim, m.pack()) for k, m in model.emissions.items()]
    seq = [(label, i, s.tolist()) for label, band in model.bands.items() for i, s in enumerate(band)]
    return {"nodes": spark.createDataFrame(nodes, NODES), "links": spark.createDataFrame(links, LINKS), "emission": spark.createDataFrame(emission, EMISSIONS), "expand_seq": spark.createDataFrame(seq, "label string, seq_id int, states array<int>")}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of files without what stands before a file's first ">": a split's rows follow each other, and only a file's first piece can still show the sign."""
    seen = None
    for b in batches:
        keep = []
        for value, file, at in zip(b["value"], b["file"].to_pylist(), b["at"].to_pylist()):
            first = at == 0 and seen != (file, at)
            seen = file, at
            keep.append(not first or value.as_py()[:1] == ">")
        yield pa.record_batch([b["value"].filter(pa.array(keep, pa.bool_()))], names=["value"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence) of every record: the id is what stands before the first space; line breaks go, as does what stands before a file's first ">"."""
    # A record begins at a ">" that is the first character of a line, wherever else the character stands.
    pieces = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    rows = pieces.mapInArrow(_records, "value string").select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r$", "")
    body = F.when(F.instr("value", "\n") > 0, F.substring(F.col("value"), F.instr("value", "\n") + 1, F.length("value"))).otherwise("")
    return rows.select(F.substring_index(head, " ", 1).alias("id"), F.regexp_replace(body, r"[\r\n]", "").alias("sequence"))


def fasta_sequence(spark: SparkSession, path: str, name: str) -> str:
    """One record's sequence; empty if there is none."""
    row = read_fasta(spark, path).where(F.col("id") == name).first()
    return row["sequence"] if row else ""
