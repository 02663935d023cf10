"""The model's joins and aggregates in relational form: emissions, labels, sparse products, transition updates.

Log-probabilities of 0 are NULL. Nodes, links and emissions are a model's tables, whose size the state graph sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import log_normalise, logsumexp_by


def with_emissions(nodes: DataFrame, emission: DataFrame) -> DataFrame:
    """Nodes with their emission by "kmer_label"; a node without one is an error when its row is made."""
    key = F.concat_ws("_", "kmer", "label")
    joined = nodes.withColumn("key", key).join(emission, "key", "left")
    return joined.withColumn("peak", F.when(F.col("peak").isNull(), F.raise_error(F.concat(F.lit("no emission for "), "key"))).otherwise(F.col("peak")))


def expand_labels(nodes: DataFrame) -> DataFrame:
    """(label, seq_id, states): nodes of each label and of "*", by position. The "*" nodes are exploded over the labels, so the join is an equi-join."""
    labels = nodes.where("label <> '*'").select("label").distinct()
    own = nodes.where("label <> '*'").select("label", "seq_id", "id")
    shared = labels.withColumn("_one", F.lit(1)).join(nodes.where("label = '*'").select("seq_id", "id", F.lit(1).alias("_one")), "_one").select("label", "seq_id", "id")
    return own.union(shared).groupBy("label", "seq_id").agg(F.sort_array(F.collect_list("id")).alias("states"))


def shared_emission_groups(nodes: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """States by the emission they share, each group under its lowest state."""
    return nodes.groupBy(key).agg(F.min(id_col).alias("first"), F.sort_array(F.collect_list(id_col)).alias("states"))


def log_links(links: DataFrame) -> DataFrame:
    """(source, target, lp): links with rows made to sum to 1, in logs."""
    lp = links.select("source", "target", F.when(F.col("prob") > 0, F.ln("prob")).alias("lp"))
    return log_normalise(lp, ["source"], "lp")


def vec_mat(vec: DataFrame, links: DataFrame) -> DataFrame:
    """(id, v): logsumexp over sources of v + lp, by target."""
    return logsumexp_by(links.join(vec.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id"), (F.col("v") + F.col("lp")).alias("t")), ["id"], "t", "v")


def mat_vec(vec: DataFrame, links: DataFrame) -> DataFrame:
    """(id, v): logsumexp over targets of lp + v, by source."""
    return logsumexp_by(links.join(vec.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id"), (F.col("v") + F.col("lp")).alias("t")), ["id"], "t", "v")


def edge_posteriors(alpha: DataFrame, beta: DataFrame, links: DataFrame) -> DataFrame:
    """(source, target, xi): alpha + lp + beta, made to sum to 1 over all edges of a step."""
    rows = links.join(alpha.select(F.col("id").alias("source"), F.col("v").alias("a")), "source").join(beta.select(F.col("id").alias("target"), F.col("v").alias("b")), "target")
    step = rows.select("source", "target", (F.col("a") + F.col("lp") + F.col("b")).alias("xi"))
    return log_normalise(step, [], "xi")


def transition(links: DataFrame, i: int, j: int) -> DataFrame:
    """lp of one edge; no row if it isn't there."""
    return links.where((F.col("source") == i) & (F.col("target") == j)).select("lp")


def transpose(links: DataFrame) -> DataFrame:
    return links.select(F.col("target").alias("source"), F.col("source").alias("target"), *[c for c in links.columns if c not in ("source", "target")])
