"""From raw documents to token ids: quality classifier, near-duplicate removal, PII surrogates, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the
columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it again.

Nulls and odd rows follow the operators: a null or empty text is scored like any other and may stay; documents
without words, or with a null doc_id, are nobody's copy; of rows that repeat a doc_id, those with one text count as one document
and one of them stays, and those with different texts are different documents; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amploom.llm.common import by_ids, documents, settle
from amploom.llm.jaccard_join import jaccard_join
from amploom.llm.mixing import mix
from amploom.llm.pieces import encode
from amploom.llm.quality_classifier import classify, train
from amploom.llm.surrogates import TEST_KEY, rewrite

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share this many hundredths of their five-word shingles.
SHINGLE_WORDS, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least a half."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    docs = docs.select(*COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long"))
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        copies = settle(jaccard_join(docs, SHINGLE_WORDS, SIMILAR).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
        return by_ids(docs, copies, "doc_id", "left_anti").select(*COLUMNS)
    # Rows repeat a doc_id: each doc_id and text is a document with a key of its own, and the smallest doc_id of a group stays.
    keyed = docs.withColumn("md5", F.coalesce(F.md5("text"), F.lit(""))).withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "md5")))
    groups = jaccard_join(keyed.select(F.col("key").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR).select(F.col("doc_id").alias("key"), "component_id").where("key is not null").distinct()
    ranked = settle(keyed.select("key", "doc_id", "md5").distinct().join(groups, "key"), "groups")
    stays = ranked.groupBy("component_id").agg(F.min(F.struct("doc_id", "md5", "key")).alias("s")).select("s.key")
    kept = by_ids(keyed, settle(ranked.join(stays, "key", "left_anti").select("key"), "copies"), "key", "left_anti")
    more = settle(kept.where("key is not null").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "repeated")
    once = by_ids(kept, more, "key", "left_semi").dropDuplicates(["key"])
    return by_ids(kept, more, "key", "left_anti").select(*COLUMNS).union(once.select(*COLUMNS))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars follows the new text."""
    return rewrite(docs.select(*COLUMNS), TEST_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, in a global random order."""
    return mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_ids of each row."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("n_ids", F.size("ids"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("PII", private), ("mixing sources", mixture), ("SentencePiece", tokens)]

#: Trained weights and fixed-size hash tables are not SQL. Tests hold the classifier and surrogates against plain
#: versions that take one text at a time, the near-duplicate stage against brute force, op4's mixing against SQL, and
#: the token stage against the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
