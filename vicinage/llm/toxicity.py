"""Toxicity from a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, strips accents, and turns look-alikes from other scripts and digit and sign
substitutions into letters. Lexicon entries are words or word beginnings, each with a weight: the
smoothed log odds of toxic against other documents, learned from labelled rows. Exception phrases
are a lexicon word with the word before or after it where the pair is found in harmless documents
only; a hit inside one does not count. A document's hits are summed by weight and normalised by
length; the probability for that value is calibrated on the same rows, never falling as it rises.

Learning takes at most SAMPLE labelled rows, those with the smallest hashes of doc_id; everything
else covers all rows. The lexicon and the exceptions are as large as that sample gives evidence for. Null or empty text
scores as a text without hits; very long ones are scored whole, one at a time. Rows that repeat a doc_id
are scored each by its text. Without labelled rows of both kinds the lexicon is empty and all scores are equal. Columns beside
doc_id and text are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import cut, in_slices, make_room

#: Most labelled rows that learning reads, least evidence (G2) of an entry.
SAMPLE = 20_000
EVIDENCE = 30.0
THRESHOLD = 0.7
#: Beginnings of words that may become entries.
PREFIX = range(4, 9)
#: Look-alike letters of Greek and Cyrillic, full-width letters, and digit and sign substitutions.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "£": "l",
    "​": "", "‌": "", "‍": "", "⁠": "", "­": "", "﻿": "",
}
#: Combining accents go once NFKD has parted them from their letters.
_FOLD = {ord(a): b for a, b in LOOK_ALIKES.items()} | {k: "" for k in range(0x300, 0x370)}
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    low = text.lower()
    return (low if low.isascii() else unicodedata.normalize("NFKD", low)).translate(_FOLD)


def training_part(doc_id: Column) -> Column:
    """Rows that learning may use: those whose crc32 of doc_id as text leaves another remainder than 1 by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic, n): documents that hold a word, or a word beginning (ends in *)."""

    def out(c: dict[int, Counter]) -> pa.RecordBatch:
        keys = [(t, x, n) for x, ts in c.items() for t, n in ts.items()]
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["token", "toxic", "n"])

    make_room()
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for b in in_slices(batches):
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall(fold(text or "")))
            counts[toxic].update(words)
            counts[toxic].update({w[:k] + "*" for w in words for k in PREFIX if k <= len(w)})
            counts[toxic][""] += 1
        if sum(map(len, counts.values())) > 150_000:
            yield out(counts)
            counts = {0: Counter(), 1: Counter()}
    yield out(counts)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows that learning reads; at most `sample`, so that their ids can be broadcast."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(training_part(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # copies of one text would lend chance words the weight of many documents
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").dropDuplicates(["text", "toxic"])


def learn_lexicon(rows: DataFrame, evidence: float = EVIDENCE) -> dict[str, float]:
    """Entries with weights; those that end in * are word beginnings. What reaches the driver is bounded as rows are."""
    counts = rows.mapInArrow(_token_counts, "token string, toxic int, n long").groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("fine"))
    counts = cut(counts)
    all_rows = counts.where("token = ''").first()
    if all_rows is None or not all_rows["bad"] or not all_rows["fine"]:
        return {}
    nb, nf = all_rows["bad"], all_rows["fine"]
    weight = F.log((F.col("bad") + 0.5) / (nb + 1)) - F.log((F.col("fine") + 0.5) / (nf + 1))
    mean = (F.col("bad") + F.col("fine")) / (nb + nf)
    part = lambda n, total: F.when(n > 0, n * F.log(n / (mean * total))).otherwise(0.0)
    g2 = 2 * (part(F.col("bad"), nb) + part(F.col("fine"), nf))
    found = counts.where("token <> ''").select("token", "bad", weight.alias("weight"), g2.alias("g2")).where((F.col("weight") > 2) & (F.col("g2") >= evidence)).orderBy(F.desc("g2"), "token").collect()
    by = {r["token"]: (r["bad"], r["weight"]) for r in found}
    keep: dict[str, float] = {}
    for token, (bad, weight) in by.items():
        if token.endswith("*"):
            stem = token[:-1]
            longer = [t for t in by if t != token and t.startswith(stem) and by[t][0] >= 0.9 * bad]
            shorter = [t for t in by if t.endswith("*") and t != token and stem.startswith(t[:-1]) and 0.9 * by[t][0] > bad]
            if longer or shorter:  # a longer one says the same, or a shorter one says more
                continue
            keep[token] = weight
        elif not any(t.endswith("*") and token.startswith(t[:-1]) and 0.9 * by[t][0] > bad for t in by):
            keep[token] = weight
    return keep


class Matcher:
    """The lexicon as an automaton."""

    def __init__(self, lexicon: dict[str, float], exceptions: frozenset[str] = frozenset()):
        import ahocorasick

        self.auto, self.exceptions = ahocorasick.Automaton(), exceptions
        for token, weight in lexicon.items():
            stem = token.rstrip("*")
            self.auto.add_word(stem, (len(stem), token[-1] == "*", weight))
        self.empty = not lexicon
        if lexicon:
            self.auto.make_automaton()

    def hits(self, folded: str) -> Iterator[tuple[int, int, float]]:
        """(start, end of the word, weight) of entries that begin at a word's start and, unless beginnings, end at its end."""
        if self.empty:
            return
        for at, (n, beginning, weight) in self.auto.iter(folded):
            start, end = at - n + 1, at + 1
            if start and folded[start - 1].isalnum():
                continue
            if end < len(folded) and folded[end].isalnum():
                if not beginning:
                    continue
                while end < len(folded) and folded[end].isalnum():
                    end += 1
            yield start, end, weight

    def phrases(self, folded: str, start: int, end: int) -> tuple[str, str]:
        """The hit with the word before it, and with the word after it."""
        word, after, at = folded[start:end], _WORD.search(folded, end), start
        while at and not folded[at - 1].isalnum():
            at -= 1
        stop = at
        while at and folded[at - 1].isalnum():
            at -= 1
        return (f"{folded[at:stop]} {word}" if at < stop else ""), (f"{word} {after[0]}" if after else "")

    def value(self, text: str | None) -> float:
        """Summed weights, normalised by the square root of the length in words."""
        folded, total = fold(text or ""), 0.0
        for start, end, weight in self.hits(folded):
            if self.exceptions and any(p in self.exceptions for p in self.phrases(folded, start, end)):
                continue
            total += weight
        return total / math.sqrt(1 + len(folded) / 6) if total else 0.0


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float], least: int = 8) -> frozenset[str]:
    """Phrases around hits that `least` harmless rows or more hold and no toxic one; bounded as rows are."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        matcher = Matcher(lexicon)
        for b in in_slices(batches):
            found: list[tuple[str, int]] = []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                folded = fold(text or "")
                found += [(p, toxic) for p in {p for s, e, _ in matcher.hits(folded) for p in matcher.phrases(folded, s, e) if p}]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([x for _, x in found], pa.int32())], names=["phrase", "toxic"])

    if not lexicon:
        return frozenset()
    found = rows.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    return frozenset(r["phrase"] for r in found.where((F.col("bad") == 0) & (F.col("n") >= least)).select("phrase").collect())


#: Values are put in so many bins a doubling.
_BINS = 4


def _bin(value: float) -> int:
    return 0 if value <= 0 else max(1, min(63, 1 + int(_BINS * (math.log2(value) + 6))))


def _values(matcher_args: tuple, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        matcher = Matcher(*matcher_args)
        for b in in_slices(batches):
            value = [matcher.value(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(column), pa.array(value, pa.float64())], names=[column, "value"])

    return run


def calibrate(rows: DataFrame, lexicon: dict[str, float], exceptions: frozenset[str]) -> list[float]:
    """The probability of 'toxic' for each bin of values: smoothed shares, pooled until they never fall."""
    value = rows.mapInArrow(_values((lexicon, exceptions), "toxic"), "toxic int, value double")
    bin_of = F.when(F.col("value") <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(63), 1 + (_BINS * (F.log2("value") + 6)).cast("int"))))
    seen = {r["bin"]: (r["bad"], r["n"]) for r in value.groupBy(bin_of.alias("bin")).agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()}
    pools: list[list[float]] = []
    share = lambda rows: (sum(b for b, _ in rows) + 0.5) / (sum(n for _, n in rows) + 1)
    # a bin's share leans, by the weight of one row, to that of all rows with, or without, a hit
    hit, none = share([v for k, v in seen.items() if k]), share([v for k, v in seen.items() if not k])
    for k in range(64):
        bad, n = seen.get(k, (0, 0))
        pools.append([bad, n, 1])
        while len(pools) > 1 and pools[-2][1] and pools[-1][1] and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    out: list[float] = []
    for bad, n, bins in pools:
        base = hit if out else none
        p = (bad + base) / (n + 1) if n else (out[-1] if out else base)
        out += [max(p, out[-1]) if out else p] * int(bins)
    # bins without rows between none and the first seen one take the first seen one's value
    first = next((k for k in range(1, 64) if seen.get(k, (0, 0))[1]), None)
    return out if first is None else [out[0]] + [out[first]] * (first - 1) + out[first:]


def _scores(matcher: Matcher, curve: list[float], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Values and scores; the score rises a little with the value inside a bin."""
    value = np.array([matcher.value(t) for t in texts], dtype=np.float64)
    return value, 0.98 * np.array([curve[_bin(v)] for v in value], dtype=np.float64) + 0.02 * value / (1 + value)


def score_documents(docs: DataFrame, lexicon: dict[str, float], exceptions: frozenset[str], curve: list[float]) -> DataFrame:
    """(doc_id, value, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        matcher = Matcher(lexicon, exceptions)
        for b in in_slices(batches):
            value, score = _scores(matcher, curve, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(value, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "value", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, value double, score double")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], frozenset[str], list[float]]:
    """Lexicon, exception phrases and calibration curve."""
    rows = training_rows(docs, labels, sample)
    lexicon = learn_lexicon(rows)
    exceptions = learn_exceptions(rows, lexicon)
    return lexicon, exceptions, calibrate(rows, lexicon, exceptions)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: (doc_id, held_out, score, predicted, value)."""
    scored = score_documents(docs, *learn(docs, labels))
    return scored.select("doc_id", F.coalesce(~training_part(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "value")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more; all columns are kept."""
    lexicon, exceptions, curve = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        matcher = Matcher(lexicon, exceptions)
        for b in in_slices(batches):
            yield b.filter(pa.array(_scores(matcher, curve, b.column("text").to_pylist())[1] < threshold))

    return docs.mapInArrow(run, docs.schema)
