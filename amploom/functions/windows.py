"""Statistics over signals in long form, as Catalyst expressions: aggregates, frames in sample order, log-space algebra.

A signal table has a key, a position from 0 and a value. Every window has a total order. Log-probability zero is
NULL here, which SUM and MAX skip; the numpy kernels use minus infinity and convert at their border.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def samples(df: DataFrame, key: str, order: list[str], value: str | Column) -> DataFrame:
    """(key, pos, x): one row a sample, numbered from 0 in ``order`` within its key."""
    x = F.col(value) if isinstance(value, str) else value
    return df.select(F.col(key), (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).cast("long").alias("pos"), x.alias("x"))


def _by(key: str):
    return W.partitionBy(key).orderBy("pos")


def trailing_variance(s: DataFrame, key: str, w: int) -> DataFrame:
    """Population variance of the last min(pos + 1, w) samples."""
    return s.select(key, "pos", F.greatest(F.lit(0.0), F.var_pop("x").over(_by(key).rowsBetween(1 - w, 0))).alias("v"))


def centred_std(s: DataFrame, key: str, w: int) -> DataFrame:
    """The sample and the population deviation of the w samples around it (w odd); near the ends, of the nearest full window."""
    h = w // 2
    sd = s.select(key, "pos", "x", F.stddev_pop("x").over(_by(key).rowsBetween(-h, h)).alias("sd"), F.count("*").over(W.partitionBy(key)).alias("n"))
    # the first and last full windows are those of fixed rows, so no self-join is needed
    whole = W.partitionBy(key)
    first = F.max(F.when(F.col("pos") == h, F.col("sd"))).over(whole)
    last = F.max(F.when(F.col("pos") == F.col("n") - 1 - h, F.col("sd"))).over(whole)
    return sd.select(key, "pos", "x", F.when(F.col("pos") < h, first).when(F.col("pos") > F.col("n") - 1 - h, last).otherwise(F.col("sd")).alias("sd"))


def min_window_std(s: DataFrame, key: str, w: int) -> DataFrame:
    """The least population deviation of a full window, a row a key that has one."""
    return trailing_variance(s, key, w).where(F.col("pos") >= w - 1).groupBy(key).agg(F.sqrt(F.min("v")).alias("min_std"))


def smooth3(s: DataFrame, key: str) -> DataFrame:
    return s.select(key, "pos", F.avg("x").over(_by(key).rowsBetween(-1, 1)).alias("smooth"))


def run_lengths(s: DataFrame, key: str, value: str = "x") -> DataFrame:
    """(key, run, value, start, length) of each run of equal neighbours."""
    changed = F.when(F.col(value) != F.lag(value).over(_by(key)), 1).otherwise(0)
    marked = s.withColumn("_c", changed).withColumn("run", F.sum("_c").over(_by(key)))
    return marked.groupBy(key, "run").agg(F.min(value).alias("value"), F.min("pos").alias("start"), F.count("*").alias("length"))


def prefix_moments(s: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    x = F.col("x") / scale
    frame = _by(key).rowsBetween(W.unboundedPreceding, 0)
    return s.select(key, "pos", *(F.sum(F.pow(x, k)).over(frame).alias(f"s{k}") for k in (1, 2, 3, 4)))


def _central(x: str, frame, w: int) -> list[Column]:
    """Mean and 2nd to 4th central moments over a frame, from raw moments."""
    r = [F.avg(F.pow(F.col(x), k)).over(frame) for k in (1, 2, 3, 4)]
    m1, r2, r3, r4 = r
    return [m1, r2 - m1 * m1, r3 - 3 * m1 * r2 + 2 * m1 * m1 * m1, r4 - 4 * m1 * r3 + 6 * m1 * m1 * r2 - 3 * m1 * m1 * m1 * m1]


def two_window(s: DataFrame, key: str, w: int) -> DataFrame:
    """Z squared of the windows on both sides of each sample and the Jarque-Bera statistic of the later one."""
    a, b = _by(key).rowsBetween(1 - w, 0), _by(key).rowsBetween(1, w)
    wide = s.withColumn("n", F.count("*").over(W.partitionBy(key)))
    m, v2, v3, v4 = _central("x", b, w)
    out = wide.select(key, "pos", "n", F.avg("x").over(a).alias("ma"), F.var_pop("x").over(a).alias("va"), m.alias("mb"), F.var_pop("x").over(b).alias("vb"), v2.alias("m2"), v3.alias("m3"), v4.alias("m4"))
    z2 = F.try_divide(F.pow(F.col("ma") - F.col("mb"), 2), (F.col("va") + F.col("vb")) / (w - 1))
    jb = F.lit(w / 6) * (F.try_divide(F.pow("m3", 2), F.pow("m2", 3)) + F.pow(F.try_divide(F.col("m4"), F.pow("m2", 2)) - 3, 2) / 4)
    return out.where((F.col("pos") >= w) & (F.col("pos") < F.col("n") - w)).select(key, "pos", z2.alias("z2"), jb.alias("jb"))


def zscore(s: DataFrame, key: str) -> DataFrame:
    """(x - mean) / population deviation; NULL for a constant signal."""
    g = W.partitionBy(key)
    return s.select(key, "pos", F.try_divide(F.col("x") - F.avg("x").over(g), F.nullif(F.stddev_pop("x").over(g), F.lit(0.0))).alias("z"))


#: Values of a key that one task may sort; the median of a larger one is found by counting.
SORTED = 1_000_000
#: Parts that a range is cut in for each count.
_PARTS = 4096


def _scale(x: Column) -> Column:
    """Sign and logarithm of a finite number in one that never falls as it grows: less than 0 below 0, more than 0 above."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 746))


def median_by(s: DataFrame, key: str, value: str = "x", most: int = SORTED) -> DataFrame:
    """(key, med): the exact median of each key's values, in memory bounded by ``most`` values however many a key has.

    Keys of at most ``most`` values are sorted in a task. The values of larger ones are written to the shared folder
    and counted in 4096 parts of the range that holds the wanted rank, whose least and greatest value are the next
    range; each count is combined before its shuffle to a row a part and key. Once a range holds at most ``most``
    values, or one value only, its rank is read off. Ranges over several magnitudes are cut by magnitude, others
    evenly, so at most about seven counts are needed; a range shrinks with every one, as its ends lie in different
    parts. Values order as in Spark: NaN is the greatest. NULL values are left out, a key with no others gets NULL,
    and rows without a key are left out.
    """
    x = s.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_x")).where("_k is not null")
    finite = F.abs("_x") < float("inf")
    sizes = x.groupBy("_k").agg(F.count("_x").alias("n"), F.min(F.when(finite, F.col("_x"))).alias("lo"), F.max(F.when(finite, F.col("_x"))).alias("hi"))
    large = written(sizes.where(F.col("n") > most))
    small = lambda rows: rows.groupBy("_k").agg(F.median("_x").alias("med"))
    named = [F.col("_k").alias(key), "med"]
    if large.isEmpty():
        return small(x).select(*named)
    rows = written(x.where("_x is not null").join(large.select("_k"), "_k", "left_semi"))
    ranks = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    # "which" names the rank among all values, "rank" is its place among those of the range
    want, found = large.select("_k", F.explode(ranks).alias("which"), "lo", "hi").withColumn("rank", F.col("which")), []
    within = F.lit(True)
    while True:
        wide = _scale(F.col("hi")) - _scale(F.col("lo"))
        share = F.when(wide > 1, (_scale(F.col("_x")) - _scale(F.col("lo"))) / wide).otherwise(F.try_divide(F.col("_x") - F.col("lo"), F.col("hi") - F.col("lo")))
        part = F.when(finite, F.least(F.lit(_PARTS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * _PARTS).cast("int"))).when(F.isnan("_x"), _PARTS + 1).when(F.col("_x") > 0, _PARTS).otherwise(-1)
        counts = rows.join(want, "_k").where(within).groupBy("_k", "which", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        upto = F.sum("n").over(W.partitionBy("_k", "which").orderBy("part"))  # at most a row a part
        held = counts.withColumn("before", upto - F.col("n")).where("before <= rank and rank < before + n")
        next_ = written(held.select("_k", "which", (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi"))
        found.append(next_.where("lo = hi").select("_k", F.col("lo").alias("v")))
        few = next_.where(f"lo < hi and n <= {most}")
        within = F.col("_x").between(F.col("lo"), F.col("hi"))
        if not few.isEmpty():
            last = rows.join(few, "_k").where(within).groupBy("_k", "which", "rank").agg(F.sort_array(F.collect_list("_x")).alias("xs"))
            found.append(last.select("_k", F.get("xs", F.col("rank").cast("int")).alias("v")))
        want = next_.where(f"lo < hi and n > {most}").drop("n")
        if want.isEmpty():
            break
    values = found[0]
    for f in found[1:]:
        values = values.union(f)
    lower, upper = F.min("v"), F.max("v")
    by_count = values.groupBy("_k").agg(F.when(lower == upper, lower).otherwise(lower * 0.5 + upper * 0.5).alias("med"))
    return small(x.join(large, "_k", "left_anti")).union(by_count).select(*named)


def robust_zscore(s: DataFrame, key: str, most: int = SORTED) -> DataFrame:
    """(x - median) / (1.4826 x median absolute deviation); NULL where that is 0. ``most``: as in ``median_by``."""
    dev = s.join(median_by(s, key, most=most), key).withColumn("d", F.abs(F.col("x") - F.col("med")))
    mad = median_by(dev, key, "d", most).withColumnRenamed("med", "mad")
    return dev.join(mad, key).select(key, "pos", F.try_divide(F.col("x") - F.col("med"), F.nullif(1.4826 * F.col("mad"), F.lit(0.0))).alias("z"))


def l1_normalise(s: DataFrame, key: str) -> DataFrame:
    """x over the sum of its key, and that sum; NULL share where the sum is 0."""
    total = F.sum("x").over(W.partitionBy(key))
    return s.select(key, "pos", F.try_divide(F.col("x"), F.nullif(total, F.lit(0.0))).alias("share"), total.alias("total"))


#: Values are summed by blocks so wide, in which exp neither overflows nor vanishes.
_BLOCK = 500.0


def logsumexp_by(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Group logsumexp without overflow, by two aggregates that tasks combine beforehand: sums of each block of values, and of a group's two highest blocks (lower ones are below a double's precision)."""
    block = F.floor(F.col(value) / _BLOCK)
    part = df.groupBy(*keys, block.alias("_b")).agg(F.sum(F.exp(F.col(value) - _BLOCK * block)).alias("_s"))
    held = F.sort_array(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_s"))), asc=False)
    top, next_ = F.get("_l", F.lit(0)), F.get("_l", F.lit(1))
    total = top["_s"] + F.coalesce(next_["_s"] * F.exp(_BLOCK * (next_["_b"] - top["_b"])), F.lit(0.0))
    return part.groupBy(*keys).agg(held.alias("_l")).select(*keys, (_BLOCK * top["_b"] + F.ln(total)).alias(out))


def log_normalise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` less the logsumexp of its group; without keys, of all rows."""
    total = logsumexp_by(df, keys, value, "_t")
    rows = df.join(total, keys) if keys else df.crossJoin(F.broadcast(total))  # one row
    return rows.withColumn(value, F.col(value) - F.col("_t")).select(*df.columns)


def logsumexp_array(a: Column) -> Column:
    """Of an array of log values; NULL if it is empty or has only NULLs."""
    m = F.array_max(a)
    return m + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(F.exp(x - m), F.lit(0.0))))


def logaddexp(x: Column, y: Column) -> Column:
    return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))))


def logdiff(x: Column, y: Column) -> Column:
    """ln(e^x - e^y); NULL where y >= x."""
    return F.when(y.isNull(), x).when(y < x, x + F.log1p(-F.exp(y - x)))


def jarque_bera_by(s: DataFrame, key: str) -> DataFrame:
    moments = s.groupBy(key).agg(F.count("x").alias("n"), F.skewness("x").alias("g"), F.kurtosis("x").alias("k"))  # both population, kurtosis in excess
    return moments.select(key, F.abs(F.col("n") / 6 * (F.pow("g", 2) + F.pow("k", 2) / 4)).alias("jb"))


def mean_var_by(s: DataFrame, key: str) -> DataFrame:
    return s.groupBy(key).agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def kahan_sum(a: Column) -> Column:
    """Compensated sum of an array, in its order."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(acc, v):
        y = v - acc["c"]
        t = acc["s"] + y
        return F.struct(t.alias("s"), ((t - acc["s"]) - y).alias("c"))

    return F.aggregate(a, zero, add)["s"]


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def argmin(a: Column) -> Column:
    """Place from 0 of the first least element."""
    return F.array_position(a, F.array_min(a)) - 1


def argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)) - 1


def top_k(df: DataFrame, keys: list[str], cost: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows of each group with the least cost; Spark prunes each task to k rows a group before the shuffle."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(cost, *ties))
    return df.withColumn("rank", r.cast("long")).where(F.col("rank") <= k)


def gaussian_logpdf(x: Column, mean: Column | float, var: Column | float) -> Column:
    mean, var = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mean, var))
    return F.lit(-0.5 * math.log(2 * math.pi)) - 0.5 * F.ln(var) - 0.5 * F.pow(x - mean, 2) / var


def mixture_logpdf(x: Column, parts: list[tuple[float, float, float]]) -> Column:
    """ln of a one-dimensional Gaussian mixture given as (weight, mean, variance)."""
    return logsumexp_array(F.array(*(math.log(w) + gaussian_logpdf(x, m, v) for w, m, v in parts)))


def responsibilities(x: Column, parts: list[tuple[float, float, float]]) -> list[Column]:
    """Posterior weight of each part."""
    total = mixture_logpdf(x, parts)
    return [F.exp(math.log(w) + gaussian_logpdf(x, m, v) - total) for w, m, v in parts]


def histogram(s: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n, log_prob): counts with values outside clamped to the edge bins."""
    width = (hi - lo) / bins
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("x") - lo) / width))).cast("long")
    counts = s.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", F.ln(F.col("n") / F.col("t")).alias("log_prob"))  # one row


def vec_add(a: Column, b: Column | float) -> Column:
    """Array plus array, or plus a number."""
    return F.zip_with(a, b, lambda x, y: x + y) if isinstance(b, Column) else F.transform(a, lambda x: x + b)


def vec_scale(a: Column, b: float) -> Column:
    return F.transform(a, lambda x: x * b)


def vec_multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def segment_loglik(x: Column | str) -> Column:
    """An aggregate: the log-likelihood of a segment under its own mean and variance; 0 without samples, NULL without variance."""
    n, var = F.count(x), F.var_pop(x)
    return F.when(n == 0, 0.0).when(var > 0, -0.5 * n * (math.log(2 * math.pi) + 1 + F.ln(var)))
