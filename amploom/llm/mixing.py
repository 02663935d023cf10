"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is (its target weight x the rows wanted) / its rows. Each document is repeated a Poisson number
of times with that mean: the number is the inverse of the distribution at a uniform value hashed from the seed,
the doc_id and the text, so it depends on neither partitions nor order and a lost task draws the same again.
Documents are exploded by their count, dealt to tasks by a hash of document and copy and sorted by it within each: a global shuffle.

Rates over ``PART`` are split into equal parts with draws of their own, whose sum is again Poisson.

Nulls and odd rows: a null source is a source of its own; a null doc_id or text hashes as empty; rows that repeat
a doc_id and text are drawn alike; an empty table gives no rows; all other columns pass through, those named copy_no,
rate or shuffle_key are replaced. Weights: those of a source's rows add up; a source without one, or with a null one,
gets none; a source that the table doesn't have takes no part; a negative or NaN weight, or none above 0 among the
table's sources, is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, own_names

SEED = 17
PART = 32.0
#: Sources that a broadcast of the rates may hold; beyond it rates are joined with salted keys.
BROADCAST_SOURCES = 100_000
SALTS = 64


def uniform(*of: Column) -> Column:
    """A value in [0, 1) from 52 bits of a hash, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *of)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate, parts, cdf): a row a source. ``weights``: (source, weight), else the sources' shares to the power ``temperature``."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = n.withColumn("weight", F.pow(F.col("n").cast("double"), temperature))
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        if bad := weights.where("weight < 0 or isnan(cast(weight as double))").select("source").first():
            raise ValueError(f"the weight of source {bad.source} is negative or no number")
        w = n.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = w.agg(F.sum("weight").alias("tw"), F.sum("n").alias("tn"))
    if weights is not None:
        none = F.raise_error(F.lit("no source of the table has a weight above 0")).cast("double")
        total = total.select(F.when(F.col("tn").isNull() | (F.col("tw") > 0), F.col("tw")).otherwise(none).alias("tw"), "tn")
    rated = w.crossJoin(F.broadcast(total)).select("source", (epochs * F.col("tn") * F.col("weight") / F.col("tw") / F.col("n")).alias("rate"))  # one row
    parts = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("each", F.col("rate") / F.col("parts"))
    most = int(PART + 12 * math.sqrt(PART) + 40)
    steps = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.exp(-F.col("each") + F.when(k == 0, 0.0).otherwise(k * F.log(F.greatest("each", F.lit(1e-300)))) - F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))))
    cdf = F.aggregate("pmf", F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("c")), lambda a, p: F.struct((a["s"] + p).alias("s"), F.concat(a["c"], F.array(a["s"] + p)).alias("c")))["c"]
    return parts.withColumn("pmf", steps).select("source", F.when(F.col("rate") > 0, F.col("rate")).otherwise(0.0).alias("rate"), "parts", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as drawn, in a global random order, plus rate, copy_no (from 0) and shuffle_key."""
    docs = docs.drop("rate", "copy_no", "shuffle_key")
    mine = own_names(docs, "src", "parts", "cdf", "salt", "to", "key", "n")
    col = {k: F.col(v) for k, v in mine.items()}
    table = rates(docs, weights, temperature, epochs).withColumnsRenamed({"source": mine["src"], "parts": mine["parts"], "cdf": mine["cdf"]})
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rated = docs.join(F.broadcast(table), F.col("source").eqNullSafe(col["src"]))
    else:  # the hot source's rows go to SALTS tasks
        salted = table.withColumn(mine["to"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = docs.withColumn(mine["salt"], F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(col["src"]) & (col["salt"] == col["to"]))
    key = F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    # The uniform value is bound once, as the only element of an array: as a column it would be inlined into the filter and hashed for every entry.
    draw = lambda part: F.get(F.transform(F.array(uniform(F.lit(str(seed)), col["key"], part.cast("string"))), lambda u: F.size(F.filter(col["cdf"], lambda c: c <= u))), F.lit(0))
    count = F.when(F.col("rate") <= 0, 0).when(col["parts"] == 1, draw(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(0), col["parts"] - 1), F.lit(0), lambda a, p: a + draw(p)))
    drawn = rated.withColumn(mine["key"], key).withColumn(mine["n"], count).where(col["n"] > 0)
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), col["n"].cast("long") - 1))).withColumn("shuffle_key", F.md5(F.concat_ws("\x1f", F.lit(f"order{seed}"), col["key"], F.col("copy_no").cast("string"))))
    # The key is uniform, so hashing it deals rows out evenly without the sampling pass of a range sort.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key").drop(*mine.values())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "source", F.round("rate", 9).alias("rate"), "copy_no", "shuffle_key", "text")


ORACLE = r"""
with n as (select source, count(*) as n from documents group by source),
r as (select source, (select sum(n) from n) * sqrt(n::double) / (select sum(sqrt(n::double)) from n) / n as rate from n),
c as (select source, any_value(rate) as rate, list(p order by k) as pmf from (
  select source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) as p from r, (select unnest(range(0, 141)) as k) s) x group by source),
f as (select source, rate, list_transform(range(1, 142), lambda i: list_sum(pmf[1:i])) as cdf from c),
d as (select doc_id, documents.source, text, rate, cdf, coalesce(doc_id::varchar, '') || chr(31) || md5(coalesce(text, '')) as key from documents join f on documents.source = f.source),
u as (select *, ('0x' || substr(md5('17' || chr(31) || key || chr(31) || '0'), 1, 13))::bigint / 4503599627370496.0 as u from d),
m as (select *, len(list_filter(cdf, lambda x: x <= u)) as n from u),
x as (select doc_id, source, rate, text, key, unnest(range(0, n)) as copy_no from m where n > 0)
select doc_id, source, round(rate, 9) as rate, copy_no, md5('order17' || chr(31) || key || chr(31) || copy_no::varchar) as shuffle_key, text from x
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": ORACLE}
