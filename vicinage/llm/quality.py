"""Quality rules combined by weak supervision. DataFrame functions only.

Seven rules vote good (1) or bad (0) on a text or abstain (-1). Expectation-maximisation over the
histogram of vote patterns (at most 3^7 rows, whatever the corpus) estimates how each rule votes on
good and on bad documents; the posterior probability of 'good' replaces 'all rules must pass'. Two
base limits stand before it: fewer than 10 words, or more than 20 % of the words in 5-word windows
that occur twice, fail a document outright.

Null or blank text has no words, so it fails. Rows that repeat a doc_id are judged alike. An empty
table gives an empty result. Input columns whose names clash with the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import BLANK, cut

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def _windows(words: Column) -> Column:
    """A hash for each 5-word window, in order."""

    def over(h: Column) -> Column:
        return F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def _covered(windows: Column) -> Column:
    """Words that lie in a window found twice or more."""

    def count(s: Column) -> Column:
        twin = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        starts = F.sort_array(F.transform(twin, lambda x: x["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")))["n"]

    return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), count)


def base_counts(docs: DataFrame) -> DataFrame:
    """docs' doc_id with the base counts and what the rules need besides."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
    step = docs.select("doc_id", text.alias("_text"), words_of(F.col("text")).alias("_words"), lines.alias("_lines"))
    step = step.select(
        "doc_id", "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("_words")).alias("_windows"),
    )
    repeats = F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long")).otherwise(_covered(F.col("_windows")))
    twice = F.size(F.filter("_words", lambda w, i: w == F.get(F.col("_words"), i - 1))).cast("long")
    return step.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"), twice.alias("n_stutters"))


def rule_votes() -> dict[str, Column]:
    """1, 0 or -1 (abstains) for each rule, over the columns of base_counts()."""
    n = F.greatest("n_words", F.lit(1))
    symbols, dup = F.col("n_symbols") / n, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    repeat, stutter, length = F.col("n_repeat_words") / n, F.col("n_stutters") / n, F.col("word_chars") / n

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    return {
        "symbols": vote(symbols >= 0.1, symbols == 0),
        "dup_lines": vote(dup > 0.34, (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 2)),
        "repeats": vote(repeat > 0.15, repeat <= 0.05),
        "stutter": vote(stutter > 0.2, stutter <= 0.05),
        "word_length": vote((length < 2.5) | (length > 9), (length >= 3.5) & (length <= 6.5)),
        "length": vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 50),
        "layout": vote((F.col("n_lines") > 20) & (F.col("n_words") < 2 * F.col("n_lines")), (F.col("n_words") >= 4 * F.col("n_lines"))),
    }


def fit(patterns: DataFrame, rules: list[str], rounds: int = 12) -> tuple[float, dict[str, dict[int, float]]]:
    """Expectation-maximisation on patterns(*rules, n): the log odds of the prior, and each vote's log likelihood ratio good : bad.

    Each round is one aggregate whose single row comes back as constants of the next.
    """
    import math

    votes_bad = sum((F.col(r) == 0).cast("int") for r in rules)
    posterior = F.when(votes_bad == 0, 0.95).when(votes_bad == 1, 0.35).otherwise(0.05)
    prior, ratio = 0.0, {r: {v: 0.0 for v in (1, 0, -1)} for r in rules}
    for _ in range(rounds):
        p = patterns.withColumn("_p", posterior)
        sums = [F.sum(F.col("n") * F.col("_p")).alias("good"), F.sum(F.col("n") * (1 - F.col("_p"))).alias("bad")]
        sums += [F.sum(F.when(F.col(r) == v, F.col("n") * x)).alias(f"{r}.{v}.{side}") for r in rules for v in (1, 0, -1) for side, x in (("g", F.col("_p")), ("b", 1 - F.col("_p")))]
        s = p.agg(*sums).first().asDict()
        good, bad = (s["good"] or 0.0) + 1, (s["bad"] or 0.0) + 1
        was, prior = prior, math.log(good / bad)
        # one pseudo-count a vote keeps every likelihood above 0
        ratio = {r: {v: math.log(((s[f"{r}.{v}.g"] or 0.0) + 1) / (good + 3) / (((s[f"{r}.{v}.b"] or 0.0) + 1) / (bad + 3))) for v in (1, 0, -1)} for r in rules}
        posterior = posterior_of(prior, ratio)
        if abs(was - prior) < 1e-6:
            break
    return prior, ratio


def posterior_of(prior: float, ratio: dict[str, dict[int, float]]) -> Column:
    """Probability of 'good' given the votes."""
    odds = F.lit(prior)
    for rule, by_vote in ratio.items():
        odds = odds + F.when(F.col(rule) == 1, by_vote[1]).when(F.col(rule) == 0, by_vote[0]).otherwise(by_vote[-1])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a document: the base counts, base_failed, posterior and kept."""
    votes = rule_votes()
    rows = cut(base_counts(docs).withColumns(votes))
    patterns = cut(rows.groupBy(*votes).agg(F.count("*").alias("n")))
    prior, ratio = fit(patterns, list(votes))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("posterior", posterior_of(prior, ratio)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior"
    )
