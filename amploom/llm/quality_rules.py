"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule votes that a document is good (1), bad (-1), or abstains (0) where its measure is neither plainly usual nor
plainly odd. The rules look at different things (symbols, capitals, repetition, function words, variety, ...), so
they overlap and contradict each other. A vote is right with an accuracy of the rule that depends on what the
document is, good or bad; an abstention says nothing; rules are independent given the truth. Expectation-maximisation
estimates the accuracies and the share of good documents from how the votes agree over all documents that pass the
base rule (the others are out whatever the votes, and would teach it that rule over again), and a document is kept when the posterior probability that it is good is at least ``KEEP``: a bad vote of a rule that is often
wrong is outvoted, and a good vote that bad documents get as often counts for little. This replaces "must pass every rule".

The model is fitted on counts of vote patterns: the shuffle carries one row per pattern and task, and the
driver sees at most 3 ** 11 patterns (eleven rules) whatever the input's size.

Nulls and odd rows: a null text has no words and fails the base rule; doc_id may be null or repeated, each row
is judged alone; an empty table gives no rows; other columns than text pass through ``judge`` untouched unless they
bear the name of a column made here, which replaces them; text is left out, as the measures are written once.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, own_names, settle

WS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
KEEP = 0.5
#: Rounds of expectation-maximisation at most, and the change of any parameter under which they end.
ROUNDS, SETTLED = 500, 1e-9
#: Votes that a rule is taken to have cast beforehand on good and on bad documents, and their accuracy there: good
#: documents seldom get a bad vote, while a bad one is odd in some ways and usual in the others.
BEFOREHAND, ACCURACY = 4.0, (0.95, 0.4)
# Function words of English, German, French and Spanish.
FUNCTION_WORDS = "a an and are as at be by for from have he in is it not of on or that the this to was with der die das und den von zu mit des dem ein eine für auf ist im nicht sich als auch le la les et des du un une dans pour par sur que qui est au el los las y del con se por una para su al lo".split()


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules read besides (n_lines, n_upper, n_digits, n_stops, n_distinct, n_function), all exact over the whole text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    mine = own_names(docs, "words", "lines", "windows", "sorted", "places", "distinct")
    col = {k: F.col(v) for k, v in mine.items()}
    bare = lambda x: F.translate(x, WS, "")
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    with_words = docs.withColumns(
        {
            mine["words"]: F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            mine["lines"]: F.filter(F.split(t, "\n"), lambda x: bare(x) != ""),
            "word_chars": F.length(bare(t)).cast("long"),
            "n_symbols": count(SYMBOLS),
            "n_upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "n_digits": count("0123456789"),
            "n_stops": count(".,;:!?"),
        }
    )
    n = F.size(col["words"])
    windows = with_words.withColumns(
        {
            "n_words": n.cast("long"),
            "n_lines": F.size(col["lines"]).cast("long"),
            "n_dup_lines": (F.size(col["lines"]) - F.size(F.array_distinct(col["lines"]))).cast("long"),
            mine["distinct"]: F.array_distinct(col["words"]),
            mine["windows"]: F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(col["words"], i), F.get(col["words"], i + 1), F.get(col["words"], i + 2)))).otherwise(F.array().cast("array<bigint>")),
        }
    )
    windows = windows.withColumns({"n_distinct": F.size(col["distinct"]).cast("long"), "n_function": F.size(F.array_intersect(col["distinct"], F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long")})
    # Only texts with a repeated window sort theirs: equal hashes then stand side by side with their places.
    repeated = F.size(F.array_distinct(col["windows"])) < F.size(col["windows"])
    ordered = windows.withColumn(mine["sorted"], F.when(repeated, F.sort_array(F.transform(col["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, i: (F.get(col["sorted"], i - 1)["h"] == x["h"]) | (F.get(col["sorted"], i + 1)["h"] == x["h"])
    places = ordered.withColumn(mine["places"], F.when(col["sorted"].isNotNull(), F.sort_array(F.transform(F.filter(col["sorted"], lambda x, i: F.coalesce(twin(x, i), F.get(col["sorted"], i + 1)["h"] == x["h"], F.get(col["sorted"], i - 1)["h"] == x["h"])), lambda x: x["i"]))))
    covered = F.aggregate(F.transform(col["places"], lambda p, i: F.least(F.lit(3), F.coalesce(F.get(col["places"], i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(*mine.values())


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules over the measures, each with a usual range (good), an odd one (bad) and silence between them."""
    per = lambda c, of="n_words": F.try_divide(F.col(c), F.col(of))
    inside = lambda x, lo, hi: (x >= lo) & (x <= hi)
    outside = lambda x, lo, hi: (x < lo) | (x > hi)
    symbols, upper, digits, long = per("n_symbols"), per("n_upper", "word_chars"), per("n_digits", "word_chars"), per("word_chars")
    lines, again, stops, words = per("n_dup_lines", "n_lines"), per("n_repeat_words"), per("n_stops"), F.col("n_words")
    letters = 1 - F.try_divide(F.col("n_symbols") + F.col("n_digits") + F.col("n_stops"), F.col("word_chars"))
    rich = F.try_divide(F.col("n_distinct"), F.sqrt("n_words"))  # hardly depends on the length
    function = F.when(words >= 20, F.col("n_function"))
    return {
        "symbols": _vote(symbols, symbols <= 0.02, symbols > 0.1),
        "capitals": _vote(upper, inside(upper, 0.002, 0.1), upper > 0.3),
        "letters": _vote(letters, letters >= 0.93, letters < 0.85),
        "digits": _vote(digits, digits <= 0.02, digits > 0.15),
        "word_length": _vote(long, inside(long, 3.5, 8), outside(long, 2.5, 12)),
        "lines": _vote(F.when(F.col("n_lines") >= 3, lines), lines == 0, lines > 0.3),
        "repeats": _vote(again, again <= 0.05, again > 0.2),
        "stops": _vote(stops, inside(stops, 0.03, 0.3), outside(stops, 0.01, 0.6)),
        "variety": _vote(rich, rich >= 5, rich < 2.5),
        "function_words": _vote(function, function >= 5, function == 0),
        "length": _vote(words, words >= 100, words < 30),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """The share of good documents, and each rule's accuracy on good and on bad ones, by expectation-maximisation over (votes, count) patterns.

    The first round takes all rules for alike. A rule may turn out worse than chance on one side.
    """
    votes = np.array([v for v, _ in patterns], np.int8).reshape(-1, n_rules)
    n = np.array([c for _, c in patterns], float)
    good, bad = (votes > 0).astype(float), (votes < 0).astype(float)
    prior, acc = 0.5, np.tile(np.array(ACCURACY, float), (n_rules, 1))
    for _ in range(rounds):
        up, down = np.array([weights(tuple(a)) for a in acc]).reshape(-1, 2).T
        odds = math.log(prior / (1 - prior)) + good @ up + bad @ down
        p = 1 / (1 + np.exp(-odds.clip(-700, 700)))
        sure, unsure = n * p, n * (1 - p)
        right = np.column_stack([good.T @ sure, bad.T @ unsure])
        cast = right + np.column_stack([bad.T @ sure, good.T @ unsure])
        new = (right + BEFOREHAND * np.array(ACCURACY)) / (cast + BEFOREHAND)
        share = float((sure.sum() + 1) / (n.sum() + 2))
        moved = max(abs(share - prior), float(np.abs(new - acc).max(initial=0.0)))
        prior, acc = share, new
        if moved < SETTLED:
            break
    return prior, [tuple(a) for a in acc.tolist()]


def weights(acc: tuple[float, float]) -> tuple[float, float]:
    """What a good and a bad vote of a rule add to the log odds of good."""
    good, bad = acc
    return math.log(good / (1 - bad)), math.log((1 - good) / bad)


def posterior(votes: tuple[int, ...], prior: float, acc: list[tuple[float, float]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(weights(a)[v < 0] for v, a in zip(votes, acc) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """``docs`` without text, with the measures, each rule's vote, base_failed, p_good and kept. The measures are written once and read for both the fit and the verdict."""
    votes = rules()
    rows = settle(measured(docs).withColumns({f"vote_{k}": v for k, v in votes.items()}).drop("text"), "votes")
    cols = [f"vote_{k}" for k in votes]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    patterns = rows.where(~failed).groupBy(*cols).count().collect()  # at most 3 ** 11 rows
    prior, acc = fit(sorted((tuple(r[:-1]), r[-1]) for r in patterns), len(cols))
    odds = F.lit(math.log(prior / (1 - prior)))
    for c, a in zip(cols, acc):
        good, bad = weights(a)
        odds = odds + F.when(F.col(c) > 0, F.lit(good)).when(F.col(c) < 0, F.lit(bad)).otherwise(F.lit(0.0))
    return rows.withColumns({"base_failed": failed, "p_good": F.round(1 / (1 + F.exp(-odds)), 6)}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES: dict[str, str] = {}
