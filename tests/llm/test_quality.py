import math
import re
from collections import Counter, defaultdict

from vicinage.llm import quality
from vicinage.llm.quality import judge

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def counts(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def same(df, docs):
    want = sorted((str(r["doc_id"]), *counts(r["text"] or "")) for r in docs.collect())
    got = df.collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    return {r["doc_id"]: r for r in got}


def test_counts_match_brute_force(corpus):
    same(judge(corpus), corpus)


def test_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["kept"] for r in judge(docs).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.3 * len(bad)


def test_overlapping_repeats(frame):
    docs = frame((1, "a a a a a a a", "s"), (2, "a b c d e x a b c d e", "s"), (3, "a b c d e\na b c d e\n\n \na b c d e", "s"), (4, "a b c d", "s"))
    same(judge(docs), docs)


def test_edge_cases(edge, empty):
    got = same(judge(edge), edge)
    assert got[1]["base_failed"] and got[2]["base_failed"]
    assert judge(empty).count() == 0


def expectation_maximisation(votes, rounds=12):
    """Posteriors of vote rows (lists of 1, 0, -1), row by row and without patterns."""
    p = [0.95 if v.count(0) == 0 else 0.35 if v.count(0) == 1 else 0.05 for v in votes]
    prior = 0.0
    for _ in range(rounds):
        good, bad = sum(p) + 1, sum(1 - x for x in p) + 1
        was, prior = prior, math.log(good / bad)
        ratio = []
        for k in range(len(votes[0])):
            g, b = Counter(), Counter()
            for v, x in zip(votes, p, strict=True):
                g[v[k]] += x
                b[v[k]] += 1 - x
            ratio.append({c: math.log((g[c] + 1) / (good + 3) / ((b[c] + 1) / (bad + 3))) for c in (1, 0, -1)})
        p = [1 / (1 + math.exp(-(prior + sum(r[c] for r, c in zip(ratio, v, strict=True))))) for v in votes]
        if abs(was - prior) < 1e-6:
            break
    return p


def test_posteriors_match_plain_expectation_maximisation(corpus):
    """All votes of all documents, by a loop over rows."""
    rules = list(quality.rule_votes())
    votes = {r["doc_id"]: [r[x] for x in rules] for r in quality.base_counts(corpus).withColumns(quality.rule_votes()).collect()}
    want = dict(zip(votes, expectation_maximisation(list(votes.values())), strict=True))
    for r in judge(corpus).collect():
        assert abs(r["posterior"] - want[r["doc_id"]]) < 1e-9 and r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= 0.5)
