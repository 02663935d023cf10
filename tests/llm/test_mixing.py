from collections import Counter

import pytest
from amploom.llm import mixing as X

SOURCES = ["a"] * 600 + ["b"] * 600 + [None] * 300


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"text {i}", s) for i, s in enumerate(SOURCES)], "doc_id long, text string, source string")


def weights(spark, *rows):
    return spark.createDataFrame(rows, "source string, weight double")


def counts(df):
    return Counter(r.source for r in df.select("source").collect())


def test_weights_of_a_source_add_up(spark, docs):
    one = X.rates(docs, weights(spark, ("a", 2.0), ("b", 1.0))).collect()
    two = X.rates(docs, weights(spark, ("a", 1.0), ("a", 1.0), ("b", 1.0), ("nosuch", 7.0), (None, None))).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two)) and {r.source: r.rate for r in one} == {"a": 1000 / 600, "b": 500 / 600, None: 0.0}
    got = counts(X.mix(docs, weights(spark, ("a", 1.0), ("a", 1.0), ("b", 1.0))))
    assert got[None] == 0 and abs(got["a"] - 1000) < 150 and abs(got["b"] - 500) < 110


def test_a_null_source_has_a_weight(spark, docs):
    got = counts(X.mix(docs, weights(spark, (None, 1.0), ("a", 0.0))))
    assert set(got) == {None} and abs(got[None] - 1500) < 190


@pytest.mark.parametrize("rows", [[("a", -1.0), ("b", 2.0)], [("a", float("nan"))], [("nosuch", -0.5)]])
def test_weights_that_are_none(spark, docs, rows):
    with pytest.raises(ValueError, match="negative or no number"):
        X.mix(docs, weights(spark, *rows))


@pytest.mark.parametrize("rows", [[("nosuch", 1.0)], [("a", 0.0), ("b", 0.0)], [("a", None)]])
def test_no_source_has_a_weight(spark, docs, rows):
    with pytest.raises(Exception, match="no source of the table has a weight above 0"):
        X.mix(docs, weights(spark, *rows)).collect()
    assert X.mix(docs.where("false"), weights(spark, *rows)).collect() == []
