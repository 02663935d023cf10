"""Queries over the driver's tables and the SQL that says the same.

A read is an events user in (ts, event_id) order, a lineitem supplier in the order of all columns, or a document's
letters a, c, g, t. Values are rounded where summation order shows.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kmers as KM
from ..functions import windows as N
from ..operators import blocks as BL
from ..operators import families as FA
from ..operators import graph as G
from ..operators import hmm as H
from ..operators import reads as R
from ..session import bounded_batches, written
from ..sources.models import parse_model

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PARTS = [(0.4, 20.0, 400.0), (0.6, 70.0, 2500.0)]
TWO_STATES = json.dumps({
    "nodes": [{"id": 0, "seq_id": 0, "kmer": "A", "label": "*"}, {"id": 1, "seq_id": 0, "kmer": "C", "label": "*"}],
    "links": [{"source": 0, "target": 0, "prob": 0.9}, {"source": 0, "target": 1, "prob": 0.1}, {"source": 1, "target": 0, "prob": 0.1}, {"source": 1, "target": 1, "prob": 0.9}],
    "emission": {"A_*": {"peak": 1, "dim": 1, "params": [1.0, 20.0, 400.0]}, "C_*": {"peak": 1, "dim": 1, "params": [1.0, 90.0, 3600.0]}},
})

S = "with s as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, value as x from events)"
LINE = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
L = f"with s as (select l_suppkey, row_number() over (partition by l_suppkey order by {LINE}) - 1 as pos, l_extendedprice / l_quantity as x from lineitem)"
D = "with d as (select doc_id, upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) as q from documents)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return N.samples(spark.read.parquet(f"{d}/events.parquet"), "user_id", ["ts", "event_id"], "value")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return N.samples(spark.read.parquet(f"{d}/lineitem.parquet"), "l_suppkey", LINE.split(", "), F.col("l_extendedprice") / F.col("l_quantity"))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    bounded_batches(spark)
    return R.as_reads(spark.read.parquet(f"{d}/events.parquet"), "user_id", ["ts", "event_id"], "value")


def _letters(spark: SparkSession, d: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", KM.letters(F.col("text")).alias("q"))


def r6(c: str | Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


@query("read_summary", "select user_id as read_index, '00000000-0000-0000-0000-' || lpad(user_id::varchar, 12, '0') as uuid, '' as chrom, count(*)::int as signal_count from events group by user_id")
def read_summary(spark, d):
    return R.summary(_reads(spark, d))


@query("read_samples", f"{S} select user_id as read_index, pos, x as value from s")
def read_samples(spark, d):
    return R.long_form(_reads(spark, d)).select("read_index", "pos", "value")


@query("min_length_filter", "select user_id as read_index, count(*)::int as n from events group by 1 having count(*) >= 65")
def min_length_filter(spark, d):
    return R.min_length(_reads(spark, d), 65).select("read_index", F.size("signal").alias("n"))


@query("stop_at_first_short", "with n as (select user_id as read_index, count(*)::int as n from events group by 1) select * from n where n >= 55 and read_index < coalesce((select min(read_index) from n where n < 55), 1e18)")
def stop_at_first_short(spark, d):
    return R.min_length(_reads(spark, d), 55, True).select("read_index", F.size("signal").alias("n"))


@query("sampling_batches", """with n as (select user_id as read_index, count(*) as n from events group by 1 having count(*) >= 55),
  b as (select *, floor((row_number() over (order by read_index) - 1) / 8) as b from n), s as (select b, sum(case when n > 66 then 1 else 0 end) as k from b group by b),
  c as (select b, sum(k) over (order by b) - k as before from s) select read_index from b join c using (b) where before < 20 and n > 66""")
def sampling_batches(spark, d):
    return H.usable(_reads(spark, d), 66, 55, 8, 20).select("read_index")


@query("trailing_variance", f"{S} select user_id, pos, round(greatest(0, var_pop(x) over (partition by user_id order by pos rows between 11 preceding and current row)), 6) as v from s")
def trailing_variance(spark, d):
    return N.trailing_variance(_events(spark, d), "user_id", 12).select("user_id", "pos", r6("v", "v"))


@query("centred_std", f"""{S}, c as (select user_id, pos, x, stddev_pop(x) over (partition by user_id order by pos rows between 2 preceding and 2 following) as sd, count(*) over (partition by user_id) as n from s)
  select c.user_id, c.pos, c.x, round(e.sd, 6) as sd from c join c e on e.user_id = c.user_id and e.pos = least(greatest(c.pos, 2), c.n - 3)""")
def centred_std(spark, d):
    return N.centred_std(_events(spark, d), "user_id", 5).select("user_id", "pos", "x", r6("sd", "sd"))


@query("min_window_std", f"{S}, v as (select user_id, pos, var_pop(x) over (partition by user_id order by pos rows between 11 preceding and current row) as v from s) select user_id, round(sqrt(min(v)), 6) as min_std from v where pos >= 11 group by 1")
def min_window_std(spark, d):
    return N.min_window_std(_events(spark, d), "user_id", 12).select("user_id", r6("min_std", "min_std"))


@query("smooth3", f"{S} select user_id, pos, round(avg(x) over (partition by user_id order by pos rows between 1 preceding and 1 following), 6) as smooth from s")
def smooth3(spark, d):
    return N.smooth3(_events(spark, d), "user_id").select("user_id", "pos", r6("smooth", "smooth"))


@query("run_length_encode", f"""{S}, c as (select user_id, pos, (x > 50)::int as b, case when (x > 50) <> lag(x > 50) over (partition by user_id order by pos) then 1 else 0 end as c from s),
  r as (select *, sum(c) over (partition by user_id order by pos) as run from c) select user_id, run::bigint as run, min(b) as value, min(pos) as start, count(*) as length from r group by 1, 2""")
def run_length_encode(spark, d):
    return N.run_lengths(_events(spark, d).withColumn("x", (F.col("x") > 50).cast("int")), "user_id")


@query("prefix_moments", f"{S} select user_id, pos, " + ", ".join(f"round(sum(pow(x / 101, {k})) over (partition by user_id order by pos), 6) as s{k}" for k in (1, 2, 3, 4)) + " from s")
def prefix_moments(spark, d):
    return N.prefix_moments(_events(spark, d), "user_id", 101.0).select("user_id", "pos", *(r6(f"s{k}", f"s{k}") for k in (1, 2, 3, 4)))


@query("two_window_z_jb", f"""{L}, m as (select l_suppkey, pos, count(*) over (partition by l_suppkey) as n,
  avg(x) over a as ma, var_pop(x) over a as va, avg(x) over b as mb, var_pop(x) over b as vb, avg(pow(x, 2)) over b as r2, avg(pow(x, 3)) over b as r3, avg(pow(x, 4)) over b as r4 from s
  window a as (partition by l_suppkey order by pos rows between 9 preceding and current row), b as (partition by l_suppkey order by pos rows between 1 following and 10 following)),
  k as (select *, r2 - mb*mb as m2, r3 - 3*mb*r2 + 2*pow(mb, 3) as m3, r4 - 4*mb*r3 + 6*mb*mb*r2 - 3*pow(mb, 4) as m4 from m)
  select l_suppkey, pos, round(pow(ma - mb, 2) / ((va + vb) / 9), 4) as z2, round(10.0/6 * (pow(m3, 2) / pow(m2, 3) + pow(m4 / pow(m2, 2) - 3, 2) / 4), 3) as jb from k where pos >= 10 and pos < n - 10""")
def two_window_z_jb(spark, d):
    return N.two_window(_lines(spark, d), "l_suppkey", 10).select("l_suppkey", "pos", r6("z2", "z2", 4), r6("jb", "jb", 3))


@query("zscore", f"{S} select user_id, pos, round((x - avg(x) over (partition by user_id)) / nullif(stddev_pop(x) over (partition by user_id), 0), 6) as z from s")
def zscore(spark, d):
    return N.zscore(_events(spark, d), "user_id").select("user_id", "pos", r6("z", "z"))


@query("robust_zscore", f"{S}, m as (select user_id, median(x) as med from s group by 1), k as (select user_id, median(abs(x - med)) as mad from s join m using (user_id) group by 1) select user_id, pos, round((x - med) / nullif(1.4826 * mad, 0), 6) as z from s join m using (user_id) join k using (user_id)")
def robust_zscore(spark, d):
    return N.robust_zscore(_events(spark, d), "user_id").select("user_id", "pos", r6("z", "z"))


@query("median_by_flag", "select l_returnflag, median(l_extendedprice / l_quantity) as med from lineitem group by 1")
def median_by_flag(spark, d):
    """A few keys that hold all rows, by counting."""
    prices = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return N.median_by(prices, "l_returnflag", most=100)


@query("l1_normalise", f"{S} select user_id, pos, round(x / nullif(sum(x) over (partition by user_id), 0), 9) as share, round(sum(x) over (partition by user_id), 4) as total from s")
def l1_normalise(spark, d):
    return N.l1_normalise(_events(spark, d), "user_id").select("user_id", "pos", r6("share", "share", 9), r6("total", "total", 4))


@query("logsumexp_group", f"{S}, m as (select user_id, max(-x / 100) as m from s group by 1) select user_id, round(max(m) + ln(sum(exp(-x / 100 - m))), 6) as lse from s join m using (user_id) group by 1")
def logsumexp_group(spark, d):
    return N.logsumexp_by(_events(spark, d).withColumn("x", -F.col("x") / 100), ["user_id"], "x", "lse").select("user_id", r6("lse", "lse"))


@query("log_normalise", f"{S}, m as (select user_id, max(-x / 100) as m from s group by 1), t as (select user_id, max(m) + ln(sum(exp(-x / 100 - m))) as lse from s join m using (user_id) group by 1) select user_id, pos, round(-x / 100 - lse, 6) as x from s join t using (user_id)")
def log_normalise(spark, d):
    return N.log_normalise(_events(spark, d).withColumn("x", -F.col("x") / 100), ["user_id"], "x").select("user_id", "pos", r6("x", "x"))


@query("jarque_bera", f"""{S}, m as (select user_id, count(*) as n, avg(x) as m from s group by 1), c as (select user_id, any_value(n) as n, avg(pow(x - m, 2)) as m2, avg(pow(x - m, 3)) as m3, avg(pow(x - m, 4)) as m4 from s join m using (user_id) group by 1)
  select user_id, round(abs(n / 6.0 * (pow(m3, 2) / pow(m2, 3) + pow(m4 / pow(m2, 2) - 3, 2) / 4)), 5) as jb from c""")
def jarque_bera(spark, d):
    return N.jarque_bera_by(_events(spark, d), "user_id").select("user_id", r6("jb", "jb", 5))


@query("mean_var", f"{S} select user_id, round(avg(x), 6) as mean, round(var_samp(x), 5) as var from s group by 1")
def mean_var(spark, d):
    return N.mean_var_by(_events(spark, d), "user_id").select("user_id", r6("mean", "mean"), r6("var", "var", 5))


@query("array_kernels", f"""{S}, a as (select user_id, list(x order by pos) as a from s group by 1) select user_id, round(list_sum(a), 5) as total, (list_position(a, list_min(a)) - 1)::bigint as lo, (list_position(a, list_max(a)) - 1)::bigint as hi,
  round(list_sum(list_transform(a, lambda v: (v - 50) * (v - 50))), 3) as d2 from a""")
def array_kernels(spark, d):
    a = F.col("signal")
    fifty = F.transform(a, lambda _: F.lit(50.0))
    return _reads(spark, d).select(F.col("read_index").alias("user_id"), r6(N.kahan_sum(a), "total", 5), N.argmin(a).cast("long").alias("lo"), N.argmax(a).cast("long").alias("hi"), r6(N.squared_distance(a, fifty), "d2", 3))


@query("vector_ops", f"{S}, a as (select user_id, list(x order by pos) as a from s group by 1) select user_id, list_transform(a, lambda v: round(v + v, 6)) as twice, list_transform(a, lambda v: round(v + 1.5, 6)) as more, list_transform(a, lambda v: round(v * 0.25, 6)) as scaled, list_transform(a, lambda v: round(v * v, 6)) as squared from a")
def vector_ops(spark, d):
    a = F.col("signal")
    made = {"twice": N.vec_add(a, a), "more": N.vec_add(a, 1.5), "scaled": N.vec_scale(a, 0.25), "squared": N.vec_multiply(a, a)}
    return _reads(spark, d).select(F.col("read_index").alias("user_id"), *(F.transform(c, lambda x: F.round(x, 6)).alias(k) for k, c in made.items()))


@query("segment_loglik", f"{S} select user_id, pos // 8 as seg, round(-0.5 * count(*) * ln(2 * pi() * exp(1) * var_pop(x)), 5) as loglik from s group by 1, 2 having var_pop(x) > 0")
def segment_loglik(spark, d):
    seg = F.floor(F.col("pos") / 8).alias("seg")
    return _events(spark, d).groupBy("user_id", seg).agg(r6(N.segment_loglik("x"), "loglik", 5)).where("loglik is not null")


@query("seeded_shuffle", "select distinct user_id as read_index, md5('42:' || user_id::varchar) as \"order\" from events")
def seeded_shuffle(spark, d):
    return R.shuffled(_reads(spark, d)).select("read_index", "order")


@query("move_extremes", f"{S}, m as (select user_id, floor(x / 40)::int - 1 as mv from s) select user_id, max(mv) as most, min(mv) filter (mv >= 0) as least from m group by 1")
def move_extremes(spark, d):
    mv = F.transform("signal", lambda x: (F.floor(x / 40) - 1).cast("int"))
    return _reads(spark, d).select(F.col("read_index").alias("user_id"), F.array_max(mv).alias("most"), F.array_min(F.filter(mv, lambda v: v >= 0)).alias("least"))


@query("beam_top_k", f"{S}, r as (select user_id, pos, x, row_number() over (partition by user_id order by x, pos) as rank from s) select * from r where rank <= 5")
def beam_top_k(spark, d):
    return N.top_k(_events(spark, d), ["user_id"], "x", 5, ["pos"])


@query("moved_samples", f"{S} select user_id, list(x order by pos) as kept from s where floor(x)::int % 3 <> 0 group by 1")
def moved_samples(spark, d):
    r = _reads(spark, d).withColumn("mv", F.transform("signal", lambda x: (F.floor(x) % 3).cast("int")))
    return r.select(F.col("read_index").alias("user_id"), KM.moved_samples(F.col("signal"), F.col("mv")).alias("kept")).where("size(kept) > 0")


@query("histogram_density", f"{S}, b as (select least(9, greatest(0, floor((x - 0) / 20)))::bigint as bin, count(*) as n from s group by 1) select bin, n, round(ln(n / (select sum(n) from b)), 6) as log_prob from b")
def histogram_density(spark, d):
    return N.histogram(_events(spark, d), 0.0, 200.0, 10).select("bin", "n", r6("log_prob", "log_prob"))


_G = [f"(ln({w}) - 0.5 * ln(2 * pi()) - 0.5 * ln({v}) - 0.5 * pow(x - {m}, 2) / {v})" for w, m, v in PARTS]
_LSE = f"(greatest({_G[0]}, {_G[1]}) + ln(1 + exp(-abs({_G[0]} - {_G[1]}))))"


@query("gaussian_logpdf", f"{S} select user_id, pos, round(-0.5 * ln(2 * pi()) - 0.5 * ln(900.0) - 0.5 * pow(x - 50, 2) / 900, 6) as lp from s")
def gaussian_logpdf(spark, d):
    return _events(spark, d).select("user_id", "pos", r6(N.gaussian_logpdf(F.col("x"), 50, 900), "lp"))


@query("gmm_logpdf", f"{S} select user_id, pos, round({_LSE}, 6) as lp from s")
def gmm_logpdf(spark, d):
    return _events(spark, d).select("user_id", "pos", r6(N.mixture_logpdf(F.col("x"), PARTS), "lp"))


@query("gmm_responsibility", f"{S} select user_id, pos, round(exp({_G[0]} - {_LSE}), 6) as r0, round(exp({_G[1]} - {_LSE}), 6) as r1 from s")
def gmm_responsibility(spark, d):
    a, b = N.responsibilities(F.col("x"), PARTS)
    return _events(spark, d).select("user_id", "pos", r6(a, "r0"), r6(b, "r1"))


ONE_STATE = json.dumps({"nodes": [{"id": 0, "seq_id": 0, "kmer": "A", "label": "*"}], "links": [{"source": 0, "target": 0, "prob": 1.0}], "emission": {"A_*": {"peak": 2, "dim": 1, "params": [v for part in PARTS for v in part]}}})


def _steps(spark, d):
    """The mixture as a model of one state: its expected counts, a row a parameter."""
    model = parse_model(ONE_STATE)
    return model, H.e_step(_reads(spark, d), model, 1)


_SUMS = ", ".join(f"sum(r{k}) as g{k}, sum(r{k} * x) as x{k}, sum(r{k} * x * x) as xx{k}" for k in (0, 1))
_RESP = f"{S}, r as (select x, exp({_G[0]} - {_LSE}) as r0, exp({_G[1]} - {_LSE}) as r1 from s), t as (select {_SUMS} from r)"


@query("gmm_sufficient_stats", _RESP + " select " + ", ".join(f"round(g{k}, 4) as g{k}, round(x{k}, 3) as x{k}, round(xx{k}, 2) as xx{k}" for k in (0, 1)) + " from t")
def gmm_sufficient_stats(spark, d):
    of = lambda kind, k: F.max(F.when((F.col("kind") == kind) & (F.col("comp") == k), F.col("val")))
    return _steps(spark, d)[1].agg(*(F.round(of(kind, k), digits).alias(f"{kind}{k}") for k in (0, 1) for kind, digits in (("g", 4), ("x", 3), ("xx", 2))))


@query("gmm_m_step", _RESP + " select " + ", ".join(f"round(g{k} / (g0 + g1), 6) as w{k}, round(x{k} / g{k}, 5) as m{k}, round(xx{k} / g{k} - pow(x{k} / g{k}, 2), 4) as v{k}" for k in (0, 1)) + " from t")
def gmm_m_step(spark, d):
    model, stats = _steps(spark, d)
    new = H.m_step(model, H.by_key(stats), H.Options()).emissions["A_*"]  # a row a parameter comes to the driver
    row = [float(v) for k in (0, 1) for v in (np.exp(new.logw[k]), new.mean[k, 0], new.cov[k, 0, 0])]
    made = spark.createDataFrame([row], ", ".join(f"w{k} double, m{k} double, v{k} double" for k in (0, 1)))
    return made.select(*(F.round(f"{c}{k}", n).alias(f"{c}{k}") for k in (0, 1) for c, n in (("w", 6), ("m", 5), ("v", 4))))


@query("tied_covariance", "with x as (select label, embedding[1]::double as x from embeddings), p as (select var_pop(x) as v from x) select label, count(*) as n, round(avg(x), 6) as mean, round(any_value(p.v), 6) as var from x, p group by label")
def tied_covariance(spark, d):
    x = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    pooled = x.agg(F.var_pop("x").alias("v"))  # one row
    return x.groupBy("label").agg(F.count("*").alias("n"), F.avg("x").alias("mean")).crossJoin(F.broadcast(pooled)).select("label", "n", r6("mean", "mean"), r6("v", "var"))


_POINTS = "with q as (select l_suppkey, l_quantity::double as a, l_discount::double as b, l_tax::double + 0.01 as w from lineitem)"


def _points(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    return x.select("l_suppkey", F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"), (F.col("l_tax").cast("double") + 0.01).alias("w"))


@query("weighted_gaussian", _POINTS + """, t as (select l_suppkey, sum(w) as w, sum(w * w) as w2, sum(w * a) as xa, sum(w * b) as xb, sum(w * a * a) as aa, sum(w * a * b) as ab, sum(w * b * b) as bb from q group by 1), u as (select *, w - w2 / w as n from t)
  select l_suppkey, round(n, 6) as n_eff, round(xa / w, 5) as m0, round(xb / w, 6) as m1, round((aa - xa * xa / w) / n, 4) as c00, round((ab - xa * xb / w) / n, 6) as c10, round((bb - xb * xb / w) / n, 7) as c11 from u where n > 1e-9""")
def weighted_gaussian(spark, d):
    got = FA.weighted_gaussian(_points(spark, d), ["l_suppkey"], "w", "a", "b").where("n_eff > 1e-9")
    return got.select("l_suppkey", *(r6(c, c, n) for c, n in (("n_eff", 6), ("m0", 5), ("m1", 6), ("c00", 4), ("c10", 6), ("c11", 7))))


@query("gaussian_2d", _POINTS + """, z as (select l_suppkey, a, b, (a - 25) / 15.0 as y0, (b - 0.05 - 0.001 * (a - 25) / 15.0) / 0.03 as y1 from q)
  select l_suppkey, a, b, round(-0.5 * (y0 * y0 + y1 * y1) - ln(2 * pi()) - ln(15.0) - ln(0.03), 6) as lp, round(5 - y0 * y0 - y1 * y1, 6) as score from z""")
def gaussian_2d(spark, d):
    g = FA.Gaussian(np.array([25.0, 0.05]), np.array([[15.0, 0.0], [0.001, 0.03]]))
    a, b = F.col("a"), F.col("b")
    return _points(spark, d).select("l_suppkey", "a", "b", r6(g.log_density(a, b), "lp"), r6(g.score(a, b), "score"))


_GRID = FA.Histogram((0.0, 0.0), (50.0, 0.1), (10, 4))


@query("histogram_2d", _POINTS + """, c as (select least(9, greatest(0, floor(a / 5.0)))::bigint + 10 * least(3, greatest(0, floor(b / 0.025)))::bigint as cell, w from q), h as (select cell, sum(w) as n from c group by 1),
  g as (select unnest(range(0, 40)) as cell), v as (select g.cell, ln(exp(-50) + coalesce(n, 0)) as v from g left join h on h.cell = g.cell) select cell, round(exp(v) / (select sum(exp(v)) from v), 8) as p from v""")
def histogram_2d(spark, d):
    """The grid's cells after one update, empty ones too."""
    p = _GRID.update(_points(spark, d), "w", "a", "b").pack()
    return spark.createDataFrame(list(enumerate(p)), "cell long, p double").select("cell", r6("p", "p", 8))


@query("histogram_lookup", _POINTS + """, k as (select l_suppkey, least(9, greatest(0, floor(a / 5.0)))::bigint + 10 * least(3, greatest(0, floor(b / 0.025)))::bigint as cell, w from q), h as (select cell, ln(sum(w)) as v from k group by 1)
  select l_suppkey, cell, count(*) as n, round(min(v) - ln((select sum(exp(v)) from h)), 6) as lp from k join h using (cell) group by 1, 2""")
def histogram_lookup(spark, d):
    x = _points(spark, d)
    g = _GRID.update(x, "w", "a", "b")
    a, b = F.col("a"), F.col("b")
    return x.groupBy("l_suppkey", g.cell(a, b).alias("cell")).agg(F.count("*").alias("n"), r6(F.min(g.log_density(a, b)), "lp"))


@query("transition_update", "with e as (select n_regionkey as source, (n_regionkey + n_nationkey) % 5 as target, n_nationkey / 7.0 as xi from nation), u as (select source, target, sum(exp(xi)) as p from e group by 1, 2) select source, target, round(ln(p / sum(p) over (partition by source)), 6) as lp from u")
def transition_update(spark, d):
    """New log-probabilities of the edges out of one state and into another, from expected counts in logs."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    counts = n.select(F.col("n_regionkey").alias("source"), ((F.col("n_regionkey") + F.col("n_nationkey")) % 5).alias("target"), (F.col("n_nationkey") / 7.0).alias("xi"))
    return FA.Links(counts.limit(0)).update(counts).table.select("source", "target", r6("lp", "lp"))


_C = [(i, j) for i in range(4) for j in range(i + 1)]


@query("class_mean_cov", "select label, " + ", ".join(f"round(avg(embedding[{i + 1}]::double), 6) as m{i}" for i in range(4)) + ", " + ", ".join(f"round(covar_pop(embedding[{i + 1}]::double, embedding[{j + 1}]::double), 6) as c{i}{j}" for i, j in _C) + " from embeddings group by label")
def class_mean_cov(spark, d):
    x = spark.read.parquet(f"{d}/embeddings.parquet").select("label", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(4)))
    return x.groupBy("label").agg(*(r6(F.avg(f"e{i}"), f"m{i}") for i in range(4)), *(r6(F.covar_pop(f"e{i}", f"e{j}"), f"c{i}{j}") for i, j in _C))


def _pairs(spark, d):
    """label, i, j, a, b: a row for each vector and pair of its dimensions, j at most i."""
    x = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    one = x.select("label", "x", F.posexplode("x").alias("i", "a"))
    return one.select("label", "i", "a", F.posexplode(F.slice("x", F.lit(1), F.col("i") + 1)).alias("j", "b"))


_PAIRS = "with e as (select label, embedding as x, unnest(range(len(embedding))) as i from embeddings), p as (select label, x, i, unnest(range(i + 1)) as j from e), q as (select label, i, j, x[i + 1]::double as a, x[j + 1]::double as b from p)"


@query("class_mean_cov_all", _PAIRS + " select label, i, j, count(*) as n, round(avg(a), 6) + 0.0 as mean, round(covar_pop(a, b), 6) + 0.0 as cov from q group by 1, 2, 3")
def class_mean_cov_all(spark, d):
    """Mean of dimension i and covariance with dimension j, over all dimensions."""
    return _pairs(spark, d).groupBy("label", "i", "j").agg(F.count("*").alias("n"), (F.round(F.avg("a"), 6) + 0.0).alias("mean"), (F.round(F.covar_pop("a", "b"), 6) + 0.0).alias("cov"))


_CHAIN = "with e as (select n_regionkey as source, (n_regionkey + n_nationkey) % 5 as target, sum(n_nationkey + 1)::double as p from nation group by 1, 2), l as (select source, target, ln(p / sum(p) over (partition by source)) as lp from e), v as (select r_regionkey as id, -r_regionkey / 3.0 as v from region)"


def _chain(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    links = n.groupBy(F.col("n_regionkey").alias("source"), ((F.col("n_regionkey") + F.col("n_nationkey")) % 5).alias("target")).agg(F.sum(F.col("n_nationkey") + 1).cast("double").alias("prob"))
    return G.log_links(links), spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("id"), (-F.col("r_regionkey") / 3.0).alias("v"))


@query("edge_slices", _CHAIN + " select 'row' as what, source, target, round(lp, 6) as lp from l where source = 2 union all select 'column', source, target, round(lp, 6) from l where target = 3")
def edge_slices(spark, d):
    links = FA.Links(_chain(spark, d)[0])
    both = links.row(2).withColumn("what", F.lit("row")).unionByName(links.column(3).withColumn("what", F.lit("column")))
    return both.select("what", "source", "target", r6("lp", "lp"))


@query("row_normalise", _CHAIN + " select source, target, round(lp, 6) as lp from l")
def row_normalise(spark, d):
    return _chain(spark, d)[0].select("source", "target", r6("lp", "lp"))


@query("sparse_vec_mat", _CHAIN + " select target as id, round(ln(sum(exp(v + lp))), 6) as v from l join v on v.id = source group by 1")
def sparse_vec_mat(spark, d):
    links, v = _chain(spark, d)
    return G.vec_mat(v, links).select("id", r6("v", "v"))


@query("sparse_mat_vec", _CHAIN + " select source as id, round(ln(sum(exp(v + lp))), 6) as v from l join v on v.id = target group by 1")
def sparse_mat_vec(spark, d):
    links, v = _chain(spark, d)
    return G.mat_vec(v, links).select("id", r6("v", "v"))


@query("edge_xi", _CHAIN + ", x as (select source, target, a.v + lp + b.v as x from l join v a on a.id = source join v b on b.id = target) select source, target, round(x - (select ln(sum(exp(x))) from x), 6) as xi from x")
def edge_xi(spark, d):
    links, v = _chain(spark, d)
    return G.edge_posteriors(v, v, links).select("source", "target", r6("xi", "xi"))


@query("transition_transpose", _CHAIN + " select target as source, source as target, round(lp, 6) as lp from l")
def transition_transpose(spark, d):
    return G.transpose(_chain(spark, d)[0]).select("source", "target", r6("lp", "lp"))


@query("shared_emission_groups", "select p_brand, min(p_partkey) as first, list(p_partkey order by p_partkey) as states from part group by 1")
def shared_emission_groups(spark, d):
    return G.shared_emission_groups(spark.read.parquet(f"{d}/part.parquet"), "p_brand", "p_partkey")


#: States for the 3-mers of documents by language, those whose code 4 divides for all languages; a state's place is where its k-mer first stands.
_NODES = D.replace("select doc_id,", "select doc_id, lang,") + """, c as (select lang, unnest(range(1, len(q) - 1)) as i, translate(q, 'ATCG', '0123') as t from d where len(q) >= 3),
  k as (select lang, i - 1 as pos, substr(t, i, 1)::bigint * 16 + substr(t, i + 1, 1)::bigint * 4 + substr(t, i + 2, 1)::bigint as code from c),
  m as (select code, case when code % 4 = 0 then '*' else lang end as label, min(pos)::int as seq_id from k group by 1, 2),
  n as (select code * 1000 + 2 * ascii(label) + ascii(right(label, 1)) as id, seq_id, 'ATCG'[code // 16 + 1] || 'ATCG'[code // 4 % 4 + 1] || 'ATCG'[code % 4 + 1] as kmer, label from m)"""


def _nodes(spark, d) -> DataFrame:
    """Written once, as they are a model's and read several times: else each time all documents are."""
    bounded_batches(spark)
    codes = spark.read.parquet(f"{d}/documents.parquet").select("lang", KM.letters(F.col("text")).alias("q")).select("lang", F.inline(KM.counts(KM.kmer_codes(F.col("q"), 3), "bigint"))).withColumnRenamed("value", "code")
    seen = codes.groupBy("code", F.when(F.col("code") % 4 == 0, "*").otherwise(F.col("lang")).alias("label")).agg(F.min("first").cast("int").alias("seq_id"))
    return written(seen.select((F.col("code") * 1000 + 2 * F.ascii("label") + F.ascii(F.right("label", F.lit(1)))).alias("id"), "seq_id", KM.kmers_of_codes(F.array("code"), 3).alias("kmer"), "label"))


@query("wildcard_label_join", _NODES + ", l as (select distinct label from n where label <> '*') select l.label, seq_id, list(id order by id) as states from n join l on n.label = l.label or n.label = '*' group by 1, 2")
def wildcard_label_join(spark, d):
    return G.expand_labels(_nodes(spark, d))


@query("emission_join", _NODES + ", e as (select kmer || '_' || label as key, count(*)::int as peak, 1 as dim from n group by 1) select key, id, seq_id, kmer, label, peak, dim from n join e on e.key = kmer || '_' || label")
def emission_join(spark, d):
    n = _nodes(spark, d)
    return G.with_emissions(n, n.groupBy(F.concat_ws("_", "kmer", "label").alias("key")).agg(F.count("*").cast("int").alias("peak"), F.lit(1).alias("dim")))


@query("band_candidates", f"{S}, f as (select user_id, pos, pos // 5 as seg from s) select user_id, pos, seg, unnest(range(greatest(0, seg - 2), least(9, seg + 2) + 1)) as position from f where seg - 2 <= 9")
def band_candidates(spark, d):
    f = _events(spark, d).select("user_id", "pos", F.floor(F.col("pos") / 5).alias("seg"))
    return KM.band(f, "seg", 2, 10)


@query("uniform_band", f"{S}, n as (select user_id, count(*) as n from s group by 1), t as (select s.user_id, pos as t, n.n // 10 as skip from s join n using (user_id) where n.n > 10) select user_id, t, least(9, t // skip) + o as position from t, (select unnest(range(-2, 2)) as o) o where least(9, t // skip) + o between 0 and 9")
def uniform_band(spark, d):
    return _reads(spark, d).select(F.col("read_index").alias("user_id"), F.inline(KM.uniform_band(F.size("signal"), 10, 4)))


@query("moves_band", S.replace("with s", "with recursive s0") + """, s as (select user_id, pos, floor(x / 40)::int as mv from s0),
  k as (select user_id, (10 / (max(mv) - min(mv) filter (mv >= 0) + 1)::double)::float as skip from s group by 1 having max(mv) >= 0),
  c as (select user_id, pos, mv, skip as cur, skip from s join k using (user_id) where pos = 0 union all select c.user_id, s.pos, s.mv, case when s.mv <> c.mv then c.cur + c.skip else c.cur end, c.skip from c join s on s.user_id = c.user_id and s.pos = c.pos + 1)
  select user_id, pos::int as t, p::int as position from (select user_id, pos, least(9, floor(cur)::int) + unnest([-2, -1, 0, 1]) as p from c) z where p between 0 and 9""")
def moves_band(spark, d):
    r = _reads(spark, d).withColumn("mv", F.transform("signal", lambda x: (F.floor(x / 40)).cast("int")))
    return r.select(F.col("read_index").alias("user_id"), F.inline(R.moves_band("mv", 10, 4)))


@query("kmer_codes", D + """, c as (select doc_id, unnest(range(1, len(q) - 1)) as i, translate(q, 'ATCG', '0123') as t from d where len(q) >= 3)
  select doc_id, substr(t, i, 1)::bigint * 16 + substr(t, i + 1, 1)::bigint * 4 + substr(t, i + 2, 1)::bigint as code, count(*) as n from c group by 1, 2""")
def kmer_codes(spark, d):
    return _letters(spark, d).select("doc_id", F.inline(KM.counts(KM.kmer_codes(F.col("q"), 3), "bigint"))).groupBy("doc_id", F.col("value").alias("code")).agg(F.sum("n").alias("n"))


@query("kmer_strings", D + ", c as (select doc_id, unnest(range(1, len(q) + 1)) as i, 'N' || q || 'N' as t from d where len(q) > 0) select doc_id, substr(t, i, 3) as kmer, count(*) as n from c group by 1, 2")
def kmer_strings(spark, d):
    return _letters(spark, d).select("doc_id", F.inline(KM.counts(KM.kmer_strings(F.col("q"), 3, 1), "string"))).groupBy("doc_id", F.col("value").alias("kmer")).agg(F.sum("n").alias("n"))


@query("kmer_round_trip", D + " select doc_id, q as back from d where len(q) >= 3")
def kmer_round_trip(spark, d):
    return _letters(spark, d).where("length(q) >= 3").select("doc_id", KM.kmers_of_codes(KM.kmer_codes(F.col("q"), 3), 3).alias("back"))


@query("kmer_graph", D + """, c as (select unnest(range(1, len(q) - 1)) as i, translate(q, 'ATCG', '0123') as t from d where len(q) >= 3), s as (select distinct substr(t, i, 1)::bigint * 16 + substr(t, i + 1, 1)::bigint * 4 + substr(t, i + 2, 1)::bigint as source from c),
  e as (select source, (source * 4 + b) % 64 as target, 0.1 as p from s, (select unnest(range(0, 4)) as b) b union all select source, source, 0.6 from s) select source, target, round(sum(p)::double, 9) as prob from e group by 1, 2""")
def kmer_graph(spark, d):
    """The edges that leave 3-mers of documents."""
    bounded_batches(spark)
    seen = KM.count_kmers(spark.read.parquet(f"{d}/documents.parquet"), "text", 3).select(F.col("code").alias("source"))
    return KM.kmer_graph(spark, 3, 0.6).join(seen, "source", "left_semi").select("source", "target", r6("prob", "prob", 9))


#: Frames are the mean values of the event types; links and start are 9-mers of all documents, a state's Gaussian follows from its code.
_FORWARD = D.replace("select doc_id, upper(", "select doc_id, translate(upper(").replace(" as q from", ", 'ATCG', '0123') as q from") + """,
  g as (select s, count(*) as n from (select substr(q, unnest(range(1, len(q) - 8)), 10) as s from d where len(q) >= 10) group by 1),
  h as (select list_reduce(list_transform(string_split(s, ''), lambda c: c::bigint), lambda a, c: a * 4 + c) as code, n from g),
  l as (select code // 4 as source, code % 262144 as target, ln(n / sum(n) over (partition by code // 4)) as lp from h),
  b as (select list_reduce(list_transform(string_split(q[1:9], ''), lambda c: c::bigint), lambda a, c: a * 4 + c) as id from d where len(q) >= 9),
  p as (select id, ln(count(*) / (select count(*) from b)) as v from b group by 1),
  f as (select row_number() over (order by event_type) - 1 as t, avg(value) as x from events group by event_type),
  a0 as (select id, v - 0.5 * ln(2 * pi() * (100 + id % 89)) - (x - (30 + id % 41)) ** 2 / (2 * (100 + id % 89)) as v from p, f where t = 0)""" + "".join(
    f""",
  m{t} as (select target as id, max(v + lp) as m from a{t - 1} join l on l.source = a{t - 1}.id group by 1),
  s{t} as (select m{t}.id, any_value(m) + ln(sum(exp(v + lp - m))) as v from a{t - 1} join l on l.source = a{t - 1}.id join m{t} on m{t}.id = l.target group by 1),
  a{t} as (select id, v - 0.5 * ln(2 * pi() * (100 + id % 89)) - (x - (30 + id % 41)) ** 2 / (2 * (100 + id % 89)) as v from s{t}, f where t = {t})"""
    for t in range(1, 5)
) + " select id, round(v, 4) as v from a4"


def _bell(x: float, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * np.log(2 * np.pi * var) - (x - mean) ** 2 / (2 * var)


@query("forward_kmer_graph", _FORWARD)
def forward_kmer_graph(spark, d):
    """Forward values over the graph of the 9-mers of documents, in blocks of states."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    links = written(G.log_links(KM.kmer_links(docs, "text", 9)))
    ends = links.select(F.explode(F.array("source", "target")).alias("id"))
    begin = written(KM.count_kmers(docs, "text", 9, first=True)).select(F.lit(0).alias("series"), F.col("code").alias("id"), F.col("n").cast("double").alias("n"))
    start = N.log_normalise(begin.select("series", "id", F.ln("n").alias("v")), ["series"], "v")
    states = ends.union(begin.select("id")).distinct().select("id", (30 + F.col("id") % 41).alias("mean"), (100 + F.col("id") % 89).alias("var"))
    kinds = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.avg("value").alias("x"))
    frames = kinds.select(F.lit(0).alias("series"), (F.row_number().over(W.orderBy("event_type")) - 1).alias("t"), "x")  # a row an event type
    return BL.forward(links, start, states, frames, _bell).select("id", r6("v", "v", 4))


@query("coarse_band", D + """, c as (select doc_id, length(q) * 3 as n, length(q) - 2 as size, list_transform(range(1, length(q) - 1), lambda i: (position(q[i] in 'ATCG') - 1) * 16 + (position(q[i + 1] in 'ATCG') - 1) * 4 + position(q[i + 2] in 'ATCG') - 1) as codes from d where length(q) >= 3),
  t as (select doc_id, size, codes, unnest(range(0, n)) as t, n // size as skip from c)
  select doc_id, t, unnest(list_transform(list_distinct(list_transform([-2, -1, 0, 1], lambda o: greatest(0, least(size - 1, least(size - 1, t // skip + 1) + o)))), lambda p: codes[p + 1]))::bigint as code from t""")
def coarse_band(spark, d):
    return KM.coarse_band_rows(_letters(spark, d), ["doc_id"], F.col("q"), F.length("q") * 3, 3, 4)


#: The recurrence as a recursive query: one row a sample, the running state carried along.
CUSUM = S.replace("with s", "with recursive s") + """,
q as (select user_id, pos, var_pop(x) over (partition by user_id order by pos rows between 11 preceding and current row) as v from s),
f as (select user_id, sqrt(min(v)) as fl from q where pos >= 11 group by 1),
r as (
  select user_id, pos, x as m1, 0.0::double as m2, 1 as n, 0.0::double as gp, 0.0::double as gn, 0 as seg from s where pos = 0
  union all
  select user_id, pos, if(a, x, m1), if(a, 0.0::double, m2), if(a, 1, n), if(a, 0.0::double, gp), if(a, 0.0::double, gn), if(a, seg + 1, seg) from (
    select *, gp >= 3 or gn >= 3 as a from (
      select user_id, pos, x, m1, m2, n, seg, greatest(0.0, gp + (x - m1 - sd / 2) / sd) as gp, greatest(0.0, gn - (x - m1 + sd / 2) / sd) as gn from (
        select *, greatest(fl, sqrt(m2 / n)) as sd from (
          select r.user_id, s.pos, s.x, r.n + 1 as n, r.m1 + (s.x - r.m1) / (r.n + 1) as m1, r.m2 + (s.x - r.m1) * (s.x - (r.m1 + (s.x - r.m1) / (r.n + 1))) as m2, r.gp, r.gn, r.seg, f.fl
          from r join s on s.user_id = r.user_id and s.pos = r.pos + 1 join f on f.user_id = r.user_id))))) 
"""


@query("cusum_segments", CUSUM + " select user_id, pos, seg from r")
def cusum_segments(spark, d):
    r = R.segment_reads(_reads(spark, d))
    return R.long_form(r).select(F.col("read_index").alias("user_id"), "pos", F.col("mv").alias("seg"))


@query("segment_means", CUSUM + " select user_id as read_index, seg::bigint as seg, min(pos) as start, count(*) as n, round(avg(x), 6) as mean from r join s using (user_id, pos) group by 1, 2")
def segment_means(spark, d):
    return R.segment_means(R.segment_reads(_reads(spark, d))).select("read_index", "seg", "start", "n", r6("mean", "mean"))


@lru_cache(1)
def _two():
    return parse_model(TWO_STATES)


#: Two states, N(20, 20^2) and N(90, 60^2), each kept with 0.9 and started with weight 1.
VITERBI = S.replace("with s", "with recursive s0") + """,
s as (select user_id, pos, -0.5 * ln(2 * pi()) - ln(20.0) - 0.5 * pow((x - 20) / 20, 2) as e0, -0.5 * ln(2 * pi()) - ln(60.0) - 0.5 * pow((x - 90) / 60, 2) as e1 from s0),
v as (select user_id, pos, e0 as d0, e1 as d1, e0 as a0, e1 as a1, 0 as b0, 0 as b1 from s where pos = 0
  union all select v.user_id, s.pos, greatest(d0 + ln(0.9), d1 + ln(0.1)) + e0, greatest(d0 + ln(0.1), d1 + ln(0.9)) + e1,
    greatest(a0 + ln(0.9), a1 + ln(0.1)) + ln(1 + exp(-abs(a0 + ln(0.9) - a1 - ln(0.1)))) + e0, greatest(a0 + ln(0.1), a1 + ln(0.9)) + ln(1 + exp(-abs(a0 + ln(0.1) - a1 - ln(0.9)))) + e1,
    if(d1 + ln(0.1) > d0 + ln(0.9), 1, 0), if(d1 + ln(0.9) > d0 + ln(0.1), 1, 0) from v join s on s.user_id = v.user_id and s.pos = v.pos + 1),
l as (select user_id, max(pos) as n from v group by 1),
b as (select v.user_id, v.pos, if(d1 > d0, 1, 0) as st, greatest(d0, d1) as score from v join l on l.user_id = v.user_id and l.n = v.pos
  union all select b.user_id, v.pos, if(b.st = 1, n.b1, n.b0), b.score from b join v n on n.user_id = b.user_id and n.pos = b.pos join v on v.user_id = b.user_id and v.pos = b.pos - 1)
"""


@query("viterbi_path", VITERBI + " select user_id, pos, st as state, round(score, 5) as score from b")
def viterbi_path(spark, d):
    r = H.with_paths(_reads(spark, d), _two())
    return r.select(F.col("read_index").alias("user_id"), F.round("score", 5).alias("score"), F.posexplode("path").alias("pos", "state")).select("user_id", F.col("pos").cast("long").alias("pos"), "state", "score")


@query("forward_loglik", VITERBI + " select v.user_id, round(greatest(a0, a1) + ln(1 + exp(-abs(a0 - a1))), 5) as loglik from v join l on l.user_id = v.user_id and l.n = v.pos")
def forward_loglik(spark, d):
    sent = spark.sparkContext.broadcast(_two())

    @F.pandas_udf("double")
    def go(signal: pd.Series) -> pd.Series:
        return pd.Series(H.forward_loglik(sent.value, *(np.asarray(s, float).reshape(-1, 1) for s in signal)))

    return _reads(spark, d).select(F.col("read_index").alias("user_id"), r6(go("signal"), "loglik", 5))


#: Forward values a0, a1 of VITERBI with backward values: posteriors of states and edges, and the sums that an iteration needs.
EM = VITERBI + """,
w as (select user_id, pos, 0.0::double as w0, 0.0::double as w1 from l join (select user_id, pos from v) using (user_id) where pos = l.n
  union all select w.user_id, s.pos - 1, greatest(ln(0.9) + e0 + w0, ln(0.1) + e1 + w1) + ln(1 + exp(-abs(ln(0.9) + e0 + w0 - ln(0.1) - e1 - w1))),
    greatest(ln(0.1) + e0 + w0, ln(0.9) + e1 + w1) + ln(1 + exp(-abs(ln(0.1) + e0 + w0 - ln(0.9) - e1 - w1)))
  from w join s on s.user_id = w.user_id and s.pos = w.pos where w.pos > 0),
k as (select v.user_id, l.n + 1 as n, greatest(a0, a1) + ln(1 + exp(-abs(a0 - a1))) as ll from v join l on l.user_id = v.user_id and l.n = v.pos),
g as (select v.user_id, v.pos, s0.x, exp(a0 + w0 - ll) as g0, exp(a1 + w1 - ll) as g1 from v join w using (user_id, pos) join k using (user_id) join s0 using (user_id, pos)),
x as (select exp(a0 + ln(0.9) + e0 + w0 - ll) as x00, exp(a0 + ln(0.1) + e1 + w1 - ll) as x01, exp(a1 + ln(0.1) + e0 + w0 - ll) as x10, exp(a1 + ln(0.9) + e1 + w1 - ll) as x11
  from v join s on s.user_id = v.user_id and s.pos = v.pos + 1 join w on w.user_id = s.user_id and w.pos = s.pos join k on k.user_id = v.user_id),
st as (
  select 'score' as kind, '' as key, 0 as i, 0 as j, sum(ll / n) as val from k union all select 'loglik', '', 0, 0, sum(ll) from k union all select 'reads', '', 0, 0, count(*) from k
  union all select 'g', 'A_*', 0, 0, sum(g0) from g union all select 'x', 'A_*', 0, 0, sum(g0 * x) from g union all select 'xx', 'A_*', 0, 0, sum(g0 * x * x) from g
  union all select 'g', 'C_*', 0, 0, sum(g1) from g union all select 'x', 'C_*', 0, 0, sum(g1 * x) from g union all select 'xx', 'C_*', 0, 0, sum(g1 * x * x) from g
  union all select 'pi', '', 0, 0, sum(g0) from g where pos = 0 union all select 'pi', '', 1, 0, sum(g1) from g where pos = 0
  union all select 'xi', '', 0, 0, sum(x00) from x union all select 'xi', '', 0, 1, sum(x01) from x union all select 'xi', '', 1, 0, sum(x10) from x union all select 'xi', '', 1, 1, sum(x11) from x)
"""
#: Sums of squares are large, so fewer of their decimals are the same in any order of summation.
_DIGITS = {"xx": 1, "x": 2, "loglik": 3}


@query("em_one_step", EM + " select kind, key, 0 as comp, i, j, case kind when 'xx' then round(val, 1) when 'x' then round(val, 2) when 'loglik' then round(val, 3) else round(val, 4) end as val from st")
def em_one_step(spark, d):
    """Expected counts of one pass over all reads, summed over the cluster."""
    stats = H.e_step(_reads(spark, d), _two(), 5)
    val = F.round("val", 4)
    for kind, n in _DIGITS.items():
        val = F.when(F.col("kind") == kind, F.round("val", n)).otherwise(val)
    return stats.select("kind", "key", "comp", "i", "j", val.alias("val"))


def _updated(spark, d, method: str):
    """Emissions and edges of the two states after one iteration: (what, i, j, val)."""
    model = H.m_step(_two(), H.by_key(H.e_step(_reads(spark, d), _two(), 5)), H.Options.parse(method))
    rows = [(f"{what}", i, 0, float(v)) for i, k in enumerate(model.key) for what, v in (("mean", model.emissions[k].mean[0, 0]), ("var", model.emissions[k].cov[0, 0, 0]))]
    rows += [("link", int(a), int(b), float(np.exp(p))) for (a, b), p in zip(model.edges, model.logp)] + [("start", i, 0, float(np.exp(p))) for i, p in enumerate(model.logpi)]
    return spark.createDataFrame(rows, "what string, i int, j int, val double").select("what", "i", "j", r6("val", "val", 5))


_NEW = """, p as (select max(val) filter (kind = 'g' and key = 'A_*') as g0, max(val) filter (kind = 'g' and key = 'C_*') as g1, max(val) filter (kind = 'x' and key = 'A_*') as s0, max(val) filter (kind = 'x' and key = 'C_*') as s1,
  max(val) filter (kind = 'xx' and key = 'A_*') as q0, max(val) filter (kind = 'xx' and key = 'C_*') as q1 from st),
r as (select 'link' as what, i, j, val / sum(val) over (partition by i) as val from st where kind = 'xi' union all select 'start', i, 0, val / sum(val) over () from st where kind = 'pi'
  union all select 'mean', 0, 0, s0 / g0 from p union all select 'mean', 1, 0, s1 / g1 from p"""


@query("hmm_m_step", EM + _NEW + " union all select 'var', 0, 0, q0 / g0 - pow(s0 / g0, 2) from p union all select 'var', 1, 0, q1 / g1 - pow(s1 / g1, 2) from p) select what, i, j, round(val, 5) as val from r")
def hmm_m_step(spark, d):
    return _updated(spark, d, "etp")


@query("hmm_m_step_tied", EM + _NEW + " union all select 'var', i, 0, (q0 + q1) / (g0 + g1) - pow((s0 + s1) / (g0 + g1), 2) from p, (select unnest([0, 1]) as i) t) select what, i, j, round(val, 5) as val from r")
def hmm_m_step_tied(spark, d):
    """One covariance for both states."""
    return _updated(spark, d, "etps")


#: The two states with other families: shares of ten cells from 0 to 200, or a mean and a variance.
CELLS = [[0.3, 0.25, 0.15, 0.1, 0.06, 0.05, 0.04, 0.03, 0.01, 0.01], [0.05, 0.07, 0.1, 0.14, 0.16, 0.15, 0.13, 0.1, 0.06, 0.04]]


def _family(family: str, shape: dict, params: list) -> str:
    doc = json.loads(TWO_STATES)
    doc["emission"] = {k: {"family": family, "params": p} | shape for k, p in zip(("A_*", "C_*"), params)}
    return json.dumps(doc)


_CELL = "least(9, greatest(0, floor(x / 20)))::int"
_HISTOGRAMS = EM.replace("-0.5 * ln(2 * pi()) - ln(20.0) - 0.5 * pow((x - 20) / 20, 2) as e0", f"ln({CELLS[0]}[{_CELL} + 1]) as e0").replace("-0.5 * ln(2 * pi()) - ln(60.0) - 0.5 * pow((x - 90) / 60, 2) as e1", f"ln({CELLS[1]}[{_CELL} + 1]) as e1")


@query("em_histogram", _HISTOGRAMS + f""", h as (select {_CELL} as cell, sum(g0) as n0, sum(g1) as n1 from g group by 1), c as (select unnest(range(0, 10))::int as cell),
  n as (select 0 as state, c.cell, coalesce(n0, 0) as n from c left join h on h.cell = c.cell union all select 1, c.cell, coalesce(n1, 0) from c left join h on h.cell = c.cell)
  select state, cell, round((exp(-50) + n) / sum(exp(-50) + n) over (partition by state), 6) as p from n""")
def em_histogram(spark, d):
    """Shares of cells after one iteration of a model whose emissions are histograms."""
    model = parse_model(_family("histogram", {"low": [0], "high": [200], "bins": [10]}, CELLS))
    new = H.m_step(model, H.by_key(H.e_step(_reads(spark, d), model, 5)), H.Options())
    rows = [(i, c, p) for i, k in enumerate(new.key) for c, p in enumerate(new.emissions[k].pack())]
    return spark.createDataFrame(rows, "state int, cell int, p double").select("state", "cell", r6("p", "p"))


@query("em_gaussian_family", EM + """, u as (select 0 as state, g0 as w, x from g union all select 1, g1, x from g), t as (select state, sum(w) as w, sum(w * w) as w2, sum(w * x) as x, sum(w * x * x) as xx from u group by 1)
  select state, round(w - w2 / w, 4) as n_eff, round(x / w, 5) as mean, round((xx - x * x / w) / (w - w2 / w), 3) as var from t""")
def em_gaussian_family(spark, d):
    """Weighted Gaussians after one iteration; the divisor of the covariance is sum w - sum w^2 / sum w."""
    model = parse_model(_family("gaussian", {"dim": 1}, [[20.0, 400.0], [90.0, 3600.0]]))
    new = H.m_step(model, H.by_key(H.e_step(_reads(spark, d), model, 5)), H.Options())
    rows = [(i, g.weight, float(g.mean[0]), float(g.factor[0, 0] ** 2)) for i, g in enumerate(new.emissions[k].of for k in new.key)]
    return spark.createDataFrame(rows, "state int, n_eff double, mean double, var double").select("state", r6("n_eff", "n_eff", 4), r6("mean", "mean", 5), r6("var", "var", 3))


#: Four states at three places; the first and the last share an emission. Moves cut a read into runs of 20 samples, three at most.
BANDED = json.dumps({
    "nodes": [{"id": i, "seq_id": p, "kmer": k, "label": "*"} for i, (p, k) in enumerate(((0, "A"), (1, "C"), (1, "G"), (2, "A")))],
    "links": [{"source": i, "target": j, "prob": p} for i, j, p in ((0, 0, 0.7), (0, 1, 0.2), (0, 2, 0.1), (1, 1, 0.6), (1, 3, 0.4), (2, 2, 0.5), (2, 1, 0.2), (2, 3, 0.3), (3, 3, 1.0))],
    "emission": {k: {"peak": 1, "dim": 1, "params": [1.0, m, v]} for k, m, v in (("A_*", 30.0, 900.0), ("C_*", 70.0, 1600.0), ("G_*", 120.0, 2500.0))},
})


def _banded_sql() -> str:
    """Forward and backward values of BANDED as a column a state; what the band or the start forbids weighs exp(-1e6)."""
    doc = json.loads(BANDED)
    place, key = [n["seq_id"] for n in doc["nodes"]], [f"{n['kmer']}_*" for n in doc["nodes"]]
    link, every = {(x["source"], x["target"]): x["prob"] for x in doc["links"]}, range(len(place))
    density = lambda k: f"-0.5 * ln(2 * pi() * {doc['emission'][k]['params'][2]}) - 0.5 * pow(x - {doc['emission'][k]['params'][1]}, 2) / {doc['emission'][k]['params'][2]}"
    many = lambda terms: f"greatest({', '.join(terms)}) + ln({' + '.join(f'exp({t} - greatest({chr(44).join(terms)}))' for t in terms)})"
    emit = ", ".join(f"case when abs(least(2, pos // 20) - {place[i]}) <= 1 then {density(key[i])} else -1e6 end as e{i}" for i in every)
    ahead = ", ".join(f"{many([f'a{i} + ln({link[i, j]})' for i in every if (i, j) in link])} + e{j}" for j in every)
    back = ", ".join(many([f"ln({link[i, j]}) + e{j} + w{j}" for j in every if (i, j) in link]) for i in every)
    xi = " union all ".join(f"select 'xi' as kind, '' as key, {i} as i, {j} as j, sum(exp(v.a{i} + ln({p}) + s.e{j} + w.w{j} - ll)) as val from v join s on s.user_id = v.user_id and s.pos = v.pos + 1 join w on w.user_id = s.user_id and w.pos = s.pos join k on k.user_id = v.user_id" for (i, j), p in link.items())
    of = lambda k: " + ".join(f"g{i}" for i in every if key[i] == k)
    sums = " union all ".join(f"select '{kind}', '{k}', 0, 0, sum(({of(k)}){by}) from g" for k in sorted(set(key)) for kind, by in (("g", ""), ("x", " * x"), ("xx", " * x * x")))
    return S.replace("with s", "with recursive s0") + f""",
      s as (select user_id, pos, {emit} from s0),
      v as (select user_id, pos, {", ".join(f"e{i} + {0.0 if place[i] == 0 else -1e6} as a{i}" for i in every)} from s where pos = 0 union all select v.user_id, s.pos, {ahead} from v join s on s.user_id = v.user_id and s.pos = v.pos + 1),
      l as (select user_id, max(pos) as n from v group by 1),
      w as (select user_id, n as pos, {", ".join(f"0.0::double as w{i}" for i in every)} from l union all select w.user_id, s.pos - 1, {back} from w join s on s.user_id = w.user_id and s.pos = w.pos where w.pos > 0),
      k as (select v.user_id, n + 1 as n, {many([f"a{i}" for i in every])} as ll from v join l on l.user_id = v.user_id and l.n = v.pos),
      g as (select v.pos, s0.x, {", ".join(f"exp(a{i} + w{i} - ll) as g{i}" for i in every)} from v join w using (user_id, pos) join k using (user_id) join s0 using (user_id, pos)),
      st as ({xi} union all {sums} union all select 'loglik', '', 0, 0, sum(ll) from k union all select 'reads', '', 0, 0, count(*) from k)
      select kind, key, i, j, round(val, case kind when 'xx' then 1 when 'x' then 2 when 'loglik' then 3 else 4 end) + 0.0 as val from st"""


@query("em_banded", _banded_sql())
def em_banded(spark, d):
    """Expected counts of a model with bands of several places, two of whose states share an emission."""
    model = parse_model(BANDED)
    reads = _reads(spark, d).withColumn("mv", F.transform("signal", lambda x, i: F.least(F.lit(2), F.floor(i / 20)).cast("int")))
    stats = H.e_step(reads, model, 1).where("kind in ('xi', 'g', 'x', 'xx', 'loglik', 'reads')")
    val = F.round("val", 4)
    for kind, n in _DIGITS.items():
        val = F.when(F.col("kind") == kind, F.round("val", n)).otherwise(val)
    return stats.select("kind", "key", "i", "j", (val + 0.0).alias("val"))


#: The two states as classes 1 and 2.
CLASSES = TWO_STATES.replace('"A", "label": "*"', '"A", "label": "1"').replace('"C", "label": "*"', '"C", "label": "2"').replace("A_*", "A_1").replace("C_*", "C_2")


@query("classify_reads", VITERBI + " select '00000000-0000-0000-0000-' || lpad(user_id::varchar, 12, '0') as uuid, (user_id % 2 + 1)::double as label_real, (st + 1)::double as label_predict from b where pos = 0")
def classify_reads(spark, d):
    """A read's chrom ends in its user's class, 1 or 2."""
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("chrom", F.concat(F.lit("chr"), F.pmod("user_id", F.lit(2)) + 1))
    return H.classify_reads(R.as_reads(rows, "user_id", ["ts", "event_id"], "value", label="chrom"), parse_model(CLASSES))


_RUNS = ", ".join(f"round(avg(x) filter (seg = {i} and k <= 50), 6) as c{i}" for i in range(50))


@query("run_means", CUSUM + f", k as (select user_id, seg, x, row_number() over (partition by user_id, seg order by pos) as k from r join s using (user_id, pos)) select '00000000-0000-0000-0000-' || lpad(user_id::varchar, 12, '0') as read_id, -48 as label, {_RUNS} from k group by user_id")
def run_means(spark, d):
    return H.run_means(R.segment_reads(_reads(spark, d))).select("read_id", "label", *(r6(f"c{i}", f"c{i}") for i in range(50)))


def _positions(column):
    def go(spark, d):
        r = _reads(spark, d).withColumn("mv", column(F.col("signal")))
        return R.long_form(r).select(F.col("read_index").alias("user_id"), "pos", F.col("mv").alias("seg"))

    return go


_SEGMENTS = """,
  last as (select user_id, previous, n from t where j = n),
  ends as (select user_id, previous, n as stop from last union all select user_id, previous, previous[stop + 1] from ends where previous[stop + 1] > 0),
  cuts as (select user_id, list(stop) as cuts from ends group by 1)
  select user_id, pos, len(list_filter(cuts, lambda c: c <= pos))::int as seg from s join cuts using (user_id)"""

#: Dynamic programming with one row a read and end: the best costs and starts so far are lists.
query("pelt_segments", S.replace("with s", "with recursive s") + f""",
  q as (select user_id, pos, var_pop(x) over (partition by user_id order by pos rows between 5 preceding and current row) as v, count(*) over (partition by user_id) as n from s),
  f as (select user_id, greatest(1e-12, min(v)) as least from q where pos >= least(5, n - 1) group by 1),
  p as (select user_id, [0.0::double] || list(s1 order by pos) as s1, [0.0::double] || list(s2 order by pos) as s2, count(*) as n from (
    select user_id, pos, sum(x) over (partition by user_id order by pos) as s1, sum(x * x) over (partition by user_id order by pos) as s2 from s) z group by 1),
  t as (select user_id, 0::bigint as j, [0.0::double] as best, [0::bigint] as previous, n from p
    union all select user_id, j, best || [list_min(c)], previous || [list_position(c, list_min(c)) - 1 + lo], n from (
      select t.user_id, t.j + 1 as j, best, previous, p.n, greatest(0, t.j + 1 - 60) as lo, list_transform(range(greatest(0, t.j + 1 - 60), t.j + 1), lambda i: best[i + 1]
        + 0.5 * (t.j + 1 - i) * (ln(2 * pi()) + ln(greatest(least, (s2[t.j + 2] - s2[i + 1]) / (t.j + 1 - i) - pow((s1[t.j + 2] - s1[i + 1]) / (t.j + 1 - i), 2))) + 1)
        + 0.5 * ln(2 * pi() * pow(t.j + 1 - i, 3) / 56.25) + 56.25 * pow(t.j + 1 - i - 15, 2) / (2 * 225.0 * (t.j + 1 - i))) as c
      from t join p on p.user_id = t.user_id join f on f.user_id = t.user_id where t.j < t.n) y){_SEGMENTS}""")(_positions(R.pelt))


@query("pelt_by_blocks", f"select user_id, min(pos)::bigint as start, count(*) as length from ({ORACLES['pelt_segments']}) z group by user_id, seg")
def pelt_by_blocks(spark, d):
    """The runs of pelt_segments, each read cut by several tasks."""
    return R.pelt_by_blocks(_events(spark, d), "user_id", block=64)


def _hazard(most: int) -> str:
    """hk(r, h, k): ln h and ln(1 - h) of an inverse Gaussian dwell of mean 15 and deviation 8 by run length below ``most``: its density over what is left."""
    return f"""
  g as (select r, -(0.5 * ln(2 * pi() * pow(r, 3) / (3375.0 / 64)) + 3375.0 / 64 * pow(r - 15, 2) / (2 * 225.0 * r)) as logp from (select unnest(range(1, {most})) as r) q),
  hl as (select x.r, x.logp, max(y.logp) as top from g x join g y on y.r >= x.r group by 1, 2),
  l as (select hl.r, least(hl.logp - top - ln(sum(exp(g.logp - top))), -1e-12) as h from hl join g on g.r >= hl.r group by hl.r, hl.logp, top),
  hk as (select r, h, case when h > -1e-8 then ln(-h) else ln(1 - exp(h)) end as k from l)"""


def _lse(v: str) -> str:
    return f"list_max({v}) + ln(list_sum(list_transform({v}, lambda z: exp(z - list_max({v})))))"


def _bocpd(p: str) -> str:
    """One row a read and sample: means, scales and log probabilities by run length; kappa and alpha follow from the run length.

    ``p``: user_id, xs, n, the priors mus and betas and the logs hs and ks of hazards, of which the last holds for all later places.
    """
    return S.replace("with s", "with recursive s") + f""",{p},
  t as (select user_id, 0::bigint as j, mus[:1] as mu, betas[:1] as beta, [0.0::double] as logr, [0::bigint] as previous, n from p
    union all select user_id, j, ([mu0] || list_transform(range(1, len(mu) + 1), lambda i: (mu[i] * (i - 0.9) + x) / (i + 0.1)))[1:201],
      ([beta0] || list_transform(range(1, len(mu) + 1), lambda i: beta[i] + (i - 0.9) * pow(x - mu[i], 2) / (2 * (i + 0.1))))[1:201],
      list_transform(g, lambda z: z - total), previous || [greatest(0, j - list_position(g[2:], list_max(g[2:])))], n from (
        select *, {_lse("g")} as total from (
          select *, ([{_lse("ends")}] || list_transform(range(1, len(w) + 1), lambda i: w[i] + ks[least(i, len(ks))]))[1:201] as g from (
            select *, list_transform(range(1, len(w) + 1), lambda i: w[i] + hs[least(i, len(hs))]) as ends from (
              select *, list_transform(range(1, len(mu) + 1), lambda i: logr[i] + lgamma((i + 2) / 2.0) - lgamma((i + 1) / 2.0) - 0.5 * ln(pi() * (i + 1) * scale[i]) - (i + 2) / 2.0 * ln(1 + pow(x - mu[i], 2) / ((i + 1) * scale[i]))) as w from (
                select t.user_id, t.j + 1 as j, mu, beta, logr, previous, mus[least(len(mus), t.j + 2)] as mu0, betas[least(len(betas), t.j + 2)] as beta0, hs, ks, p.n, xs[t.j + 1] as x,
                  list_transform(range(1, len(mu) + 1), lambda i: beta[i] * (i + 0.1) / ((i + 1) / 2.0 * (i - 0.9))) as scale
                from t join p on p.user_id = t.user_id where t.j < p.n) y) v) u) o) q){_SEGMENTS}"""


query("bocpd_segments", _bocpd("""
  p as (select user_id, list(x order by pos) as xs, count(*) as n, [avg(x)] as mus, [greatest(var_pop(x), 1e-6)] as betas, [ln(0.01)] as hs, [ln(0.99)] as ks from s group by 1)"""))(_positions(R.bocpd))
query("bocpd_dwell_segments", _bocpd(_hazard(200) + """,
  a as (select list(h order by r) as hs, list(k order by r) as ks from hk),
  w as (select user_id, pos, x, avg(x) over ten as m, greatest(var_pop(x) over ten, 1e-6) as v, count(*) over (partition by user_id) as n from s window ten as (partition by user_id order by pos rows between current row and 9 following)),
  f as (select user_id, list(x order by pos) as xs, count(*) as n, list(m order by pos) filter (pos <= greatest(0, n - 10)) as mus, list(v order by pos) filter (pos <= greatest(0, n - 10)) as betas from w group by 1),
  p as (select * from f, a)"""))(_positions(lambda c: R.bocpd(c, dwell=(15.0, 8.0), window=10)))
query("jb_segments", S.replace("with s", "with recursive s") + f""",
  u as (select user_id, pos, (x - avg(x) over (partition by user_id)) / nullif(stddev_pop(x) over (partition by user_id), 0) as z from s),
  p as (select user_id, {", ".join(f"[0.0::double] || list(s{k} order by pos) as s{k}" for k in (1, 2, 3, 4))}, count(*) as n from (
    select user_id, pos, {", ".join(f"sum(pow(z, {k})) over (partition by user_id order by pos) as s{k}" for k in (1, 2, 3, 4))} from u) z group by 1),
  t as (select user_id, 0::bigint as j, [-0.9::double] as best, [0::bigint] as previous, n from p
    union all select user_id, j, best || [coalesce(list_min(c), 'inf'::double)], previous || [coalesce(list_position(c, list_min(c)) - 1, 0)], n from (
      select user_id, j, best, previous, n, list_transform(m, lambda w: w.b + 0.9 + case when w.m2 > 1e-12 then abs(w.l / 6.0 * (pow(w.r3 - 3 * w.m1 * w.r2 + 2 * pow(w.m1, 3), 2) / pow(w.m2, 3)
          + pow((w.r4 - 4 * w.m1 * w.r3 + 6 * w.m1 * w.m1 * w.r2 - 3 * pow(w.m1, 4)) / pow(w.m2, 2) - 3, 2) / 4)) else 0 end) as c from (
        select t.user_id, t.j + 1 as j, best, previous, p.n, list_transform(range(0, greatest(0, t.j + 1 - 3)), lambda i: {{b: best[i + 1], l: t.j + 1 - i, m1: (s1[t.j + 2] - s1[i + 1]) / (t.j + 1 - i), r2: (s2[t.j + 2] - s2[i + 1]) / (t.j + 1 - i),
          r3: (s3[t.j + 2] - s3[i + 1]) / (t.j + 1 - i), r4: (s4[t.j + 2] - s4[i + 1]) / (t.j + 1 - i), m2: (s2[t.j + 2] - s2[i + 1]) / (t.j + 1 - i) - pow((s1[t.j + 2] - s1[i + 1]) / (t.j + 1 - i), 2)}}) as m
        from t join p on p.user_id = t.user_id where t.j < t.n) y) x){_SEGMENTS}""")(_positions(R.jb_segments))
query("two_window_segments", S.replace("with s", "with recursive s") + """,
  m as (select user_id, pos, count(*) over (partition by user_id) as n, avg(x) over a as ma, var_pop(x) over a as va, avg(x) over b as mb, var_pop(x) over b as vb, avg(pow(x, 2)) over b as r2, avg(pow(x, 3)) over b as r3, avg(pow(x, 4)) over b as r4 from s
    window a as (partition by user_id order by pos rows between 9 preceding and current row), b as (partition by user_id order by pos rows between 1 following and 10 following)),
  k as (select *, r2 - mb*mb as m2, r3 - 3*mb*r2 + 2*pow(mb, 3) as m3, r4 - 4*mb*r3 + 6*mb*mb*r2 - 3*pow(mb, 4) as m4 from m),
  z as (select user_id, pos, pow(ma - mb, 2) / ((va + vb) / 9) as z, 10.0/6 * (pow(m3, 2) / pow(m2, 3) + pow(m4 / pow(m2, 2) - 3, 2) / 4) as jb from k where pos >= 10 and pos < n - 10),
  t as (select distinct user_id, 0 as step, 10::bigint as i, false as o, 0::bigint as best, 0.0::double as top, []::bigint[] as cuts from s
    union all select t.user_id, step + 1, case when not o and z >= 2.706 then i when o and jb <= 0.211 then i + 10 else i + 1 end, case when not o then z >= 2.706 else jb > 0.211 end,
      case when not o or (jb > 0.211 and z > top) then i else best end, case when not o or (jb > 0.211 and z > top) then z else top end, case when o and jb <= 0.211 then cuts || [best] else cuts end
    from t join z on z.user_id = t.user_id and z.pos = t.i),
  e as (select user_id, case when o then cuts || [best] else cuts end as cuts from t qualify row_number() over (partition by user_id order by step desc) = 1)
  select user_id, pos, len(list_filter(cuts, lambda c: c <= pos))::int as seg from s join e using (user_id)""")(_positions(R.two_window_segments))
#: One row a read, sample and path of the beam.
query("beam_changes", S.replace("with s", "with recursive s") + f""",{_hazard(60)},
  h as (select r, -h as move, -k as stay from hk),
  o as (select * from (values (0, 20.0::double, 400.0::double), (1, 90.0::double, 3600.0::double)) v(st, mean, var)),
  c as (select user_id, pos, st, 1::bigint as run, pow(x - mean, 2) / var as cost, [st] as path from s, o where pos = 0
    union all select user_id, pos, st, run, cost, path from (
      select *, row_number() over (partition by user_id, st, run order by cost, place) as nth from (
        select k.user_id, k.pos + 1 as pos, o.st, case when o.st = k.st then k.run + 1 else 1 end as run, k.cost + pow(s.x - o.mean, 2) / o.var + case when o.st = k.st then h.stay else h.move end as cost, k.path || [o.st] as path, k.place
        from (select *, row_number() over (partition by user_id order by cost, st, run) as place from c) k join s on s.user_id = k.user_id and s.pos = k.pos + 1 join h on h.r = least(k.run, 59), o where k.place <= 16) y) z where nth = 1),
  e as (select user_id, path, len(path) as n from c qualify row_number() over (partition by user_id order by pos desc, cost, st, run) = 1)
  select user_id, unnest(range(0, n)) as pos, unnest(path)::int as seg from e""")(_positions(lambda c: R.beam_changes(c, [(20.0, 400.0), (90.0, 3600.0)])))


#: One row a read and merge: sizes and starts of the runs that are left.
@query("aggregate_segments", S.replace("with s", "with recursive s0") + """, s as (select user_id, pos, floor(x / 40)::int as mv from s0),
  f as (select *, mv is distinct from lag(mv) over (partition by user_id order by pos) as fresh, count(*) over (partition by user_id) as n from s),
  b as (select user_id, list(pos order by pos) || [any_value(n)] as cut from f where fresh group by 1),
  m as (select user_id, 0 as step, list_transform(range(1, len(cut)), lambda i: cut[i + 1] - cut[i]) as size, cut[1:len(cut) - 1] as start from b
    union all select user_id, step + 1, size[1:lo - 1] || [size[lo] + size[lo + 1]] || size[lo + 2:], start[1:lo] || start[lo + 2:] from (
      select *, case when i = len(size) or (i > 1 and size[i - 1] <= size[i + 1]) then i - 1 else i end as lo from (
        select *, list_position(size, list_min(size)) as i from m where len(size) > 8) y) z),
  e as (select user_id, start from m qualify row_number() over (partition by user_id order by step desc) = 1)
  select user_id, pos, len(list_filter(start, lambda c: c <= pos))::int - 1 as seg from s join e using (user_id)""")
def aggregate_segments(spark, d):
    r = _reads(spark, d).withColumn("mv", F.transform("signal", lambda x: (F.floor(x / 40)).cast("int")))
    return R.long_form(r.withColumn("mv", R.aggregate_segments("mv", 8))).select(F.col("read_index").alias("user_id"), "pos", F.col("mv").alias("seg"))


#: One row a pair of reads and anti-diagonal: costs and path lengths of the two before, by place in the first read.
@query("dtw_distance", S.replace("with s", "with recursive s") + """, r as (select user_id as read_index, list(x order by pos) as a, count(*)::int as n from s group by 1),
  p as (select x.read_index, x.a, y.a as b, x.n, y.n as m from r x join r y on y.read_index = x.read_index + 1),
  t as (select read_index, a, b, n, m, 0 as d, list_transform(range(0, n + 1), lambda i: case when i = 0 then 0.0::double else 'inf'::double end) as c1, list_transform(range(0, n + 1), lambda i: 'inf'::double) as c2, list_transform(range(0, n + 1), lambda i: 0) as k1, list_transform(range(0, n + 1), lambda i: 0) as k2 from p
    union all select read_index, a, b, n, m, d, list_transform(w, lambda z: z[1]), c1, list_transform(w, lambda z: z[2]::int), k1 from (
      select read_index, a, b, n, m, d + 1 as d, c1, k1, list_transform(range(0, n + 1), lambda i: case when i >= 1 and d + 1 - i between 1 and m then
        [pow(a[i] - b[d + 1 - i], 2) + least(c2[i], c1[i], c1[i + 1]), 1 + case when c2[i] <= c1[i] and c2[i] <= c1[i + 1] then k2[i] when c1[i] <= c1[i + 1] then k1[i] else k1[i + 1] end] else ['inf'::double, 0.0] end) as w from t where d < n + m) y)
  select read_index, round(c1[n + 1], 4) as dist, k1[n + 1]::int as steps from t where d = n + m""")
def dtw_distance(spark, d):
    """Each read against the next by index."""
    r = _reads(spark, d).select("read_index", "signal")
    pairs = r.join(r.select((F.col("read_index") - 1).alias("read_index"), F.col("signal").alias("other")), "read_index")
    z = pairs.withColumn("z", R.dtw("signal", "other"))
    return z.select("read_index", F.round("z.dist", 4).alias("dist"), F.size("z.path").alias("steps"))


def _in_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    R.register_functions(spark)
    return spark.sql(text, **tables)


@query("kmers_in_sql", D + """, c as (select doc_id, unnest(range(1, len(q) - 2)) as i, translate(q, 'ATCG', '0123') as t from d where len(q) >= 4)
  select doc_id, substr(t, i, 1)::bigint * 64 + substr(t, i + 1, 1)::bigint * 16 + substr(t, i + 2, 1)::bigint * 4 + substr(t, i + 3, 1)::bigint as code, min(i - 1)::int as first, count(*) as n from c group by 1, 2""")
def kmers_in_sql(spark, d):
    return _in_sql(spark, "select doc_id, code, min(pos) as first, count(*) as n from {docs}, lateral kmers(q, 4) group by doc_id, code", docs=_letters(spark, d))


@query("bands_in_sql", ORACLES["uniform_band"].replace("n.n // 10", "n.n // 8").replace("n.n > 10", "n.n > 8").replace("least(9, ", "least(7, ").replace("between 0 and 9", "between 0 and 7"))
def bands_in_sql(spark, d):
    return _in_sql(spark, "select read_index as user_id, t, position from {reads}, lateral uniform_band(size(signal), 8, 4)", reads=_reads(spark, d))


@query("cusum_in_sql", CUSUM.replace("gp >= 3 or gn >= 3", "gp >= 4 or gn >= 4") + " select user_id, seg, min(pos)::int as start, count(*)::int as length from r group by 1, 2")
def cusum_in_sql(spark, d):
    return _in_sql(spark, "select read_index as user_id, value as seg, start, length from {reads}, lateral run_lengths(cusum(signal, 1, 4))", reads=_reads(spark, d))
