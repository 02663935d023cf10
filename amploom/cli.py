"""``python -m amploom.cli``: list and show reads, train a model.

Exit codes: 0 on success and help, 2 on wrong arguments, 1 on an unknown label or empty data.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hmm as H
from .operators import reads as R
from .session import session
from .sources import signalbin
from .sources.models import load_model, save_model


def load_reads(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    signalbin.register(spark)
    return spark.read.format("signalbin").load(path)


def summary_lines(reads: DataFrame, n: int) -> list[str]:
    """Tab-separated, in index order; n = 0 is all."""
    rows = R.summary(reads, n or None).orderBy("read_index").toLocalIterator()
    return ["INDEX\tUUID\tCHROM\tSIGNAL_COUNT", *(f"{r.read_index}\t{r.uuid}\t{r.chrom}\t{r.signal_count}" for r in rows)]


def show_lines(reads: DataFrame, index: int) -> list[str]:
    row = reads.where(F.col("read_index") == index).first()
    if row is None:
        raise SystemExit(f"no read {index}")
    mv = row.mv or []
    body = [f"{x:14.3f}{str(mv[i]) if i < len(mv) else '-':>12}" for i, x in enumerate(row.signal or [])]
    return [f"Index: {index}", f"UUID: {row.uuid}", f"Chrom: {row.chrom}", "", f"{'Signal':>14}{'MV':>12}", *body]


def _count(s: str) -> int:
    if s == "all":
        return 0
    if not s.isdigit():
        raise argparse.ArgumentTypeError("a number or all")
    return int(s)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="amploom")
    sub = p.add_subparsers(dest="command", required=True)
    view = sub.add_parser("viewbin", help="list or show reads of a record file")
    view.add_argument("file")
    mode = view.add_subparsers(dest="mode", required=True)
    mode.add_parser("summary").add_argument("count", type=_count)
    mode.add_parser("show").add_argument("index", type=int)
    for name in ("train", "hmm"):
        t = sub.add_parser(name, help="train a hidden Markov model")
        t.add_argument("--input", "--data", dest="input", required=True)
        t.add_argument("--model", required=True)
        t.add_argument("--output", "--out", dest="output", required=True)
        t.add_argument("--batch-size", type=int, default=1)
        t.add_argument("--sampling-number", type=int, default=1)
        t.add_argument("--iter-max", "--max-iter", dest="iter_max", type=int, default=10)
        t.add_argument("--band", "--max-band", dest="band", type=int, default=50)
        t.add_argument("--method", default="et")
        t.add_argument("--min-samples", type=int, default=3000)
    for name in ("label", "segment", "score"):
        t = sub.add_parser(name, help=f"{name} reads")
        t.add_argument("--input", required=True)
        t.add_argument("--output", required=True)
        if name != "segment":
            t.add_argument("--model", required=True)
            t.add_argument("--min-samples", type=int, default=3000)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session("amploom")
    reads = load_reads(spark, a.file if a.command == "viewbin" else a.input)
    if a.command == "viewbin":
        print("\n".join(summary_lines(reads, a.count) if a.mode == "summary" else show_lines(reads, a.index)))
    elif a.command in ("train", "hmm"):
        print(f"HMM: {datetime.now():%Y-%m-%d %H:%M:%S}")
        model, history = H.train(reads, load_model(a.model), a.iter_max, a.band, a.method, a.min_samples, a.batch_size, a.sampling_number)
        for it, score, residual in history:
            print(f"Iter: {it}, Prob: {score:.4f}, Residual: {residual:.6f}")
        save_model(model, a.output)
        print(f"Finish: {datetime.now():%Y-%m-%d %H:%M:%S}")
    elif a.command == "segment":
        signalbin.register(spark)
        R.segment_reads(reads).write.format("signalbin").mode("overwrite").save(a.output)
    elif a.command == "label":
        signalbin.register(spark)
        labelled = H.label_reads(R.min_length(reads, a.min_samples), load_model(a.model))
        labelled.select("read_index", "uuid", "chrom", "signal", "mv").write.format("signalbin").mode("overwrite").save(a.output)
        H.run_means(labelled).write.mode("overwrite").csv(f"{a.output.rstrip('/')}.runs", sep="\t", header=True)
    else:
        H.classify_reads(R.min_length(reads, a.min_samples), load_model(a.model)).write.mode("overwrite").csv(a.output, sep="\t", header=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
