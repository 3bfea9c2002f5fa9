import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vicinage.llm import variants
from vicinage.llm.variants import Filters, polynomial, positives


def near(a, b):
    """By the definition: one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, misspelt):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if misspelt and h % misspelt == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    # words that are near share a word with one place left open, or one with a place cut out
    open_at = {}
    for w in n:
        for i in range(len(w)):
            open_at.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            open_at.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    form, n_near = {}, {}
    for w in n:
        maybe = {v for i in range(len(w)) for k in ((w[:i], w[i + 1 :]),) for v in open_at[k]} | open_at.get(w, set()) | {v for i in range(len(w)) if (v := w[:i] + w[i + 1 :]) in n}
        around = [v for v in maybe if near(w, v)]
        n_near[w] = len(around)
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], n_near[w], n[form[w]] if form[w] else None) for w in n)


def rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.fixture(scope="module")
def words():
    """Words of a small alphabet around a few frequent ones, in chains of forms."""
    draw = random.Random(4)
    out = []
    for i in range(60):
        text = []
        for stem, times in (("étable", 40), ("étables", 7), ("étabxes", 1), ("xtabxes", 1), ("Banana", 9), ("bananna", 1), ("aaaaaa", 12), ("aaaaaaa", 2), ("ÀÀbbcc", 1)):
            for _ in range(times * draw.randint(0, 2)):
                w = list(stem)
                if draw.random() < 0.15:
                    k = draw.randrange(len(w))
                    w[k : k + draw.randint(0, 1)] = draw.choice("aéb")
                text.append("".join(w))
        out.append((i, " ".join(text) + " it's_x×÷1"))
    return out


@pytest.mark.parametrize("misspelt", [None, 7, 199])
def test_small_words_against_brute_force(spark, words, misspelt):
    got = rows(variants.spelling_variants(spark.createDataFrame(words, "doc_id long, text string"), misspelt))
    assert got == brute(words, misspelt)
    assert any(r[1] and r[1] != r[2] for r in got) and any(r[4] > 3 for r in got)


def test_full_filters_lose_nothing(spark, words, monkeypatch):
    monkeypatch.setattr(variants, "MOST_BITS", 64)
    monkeypatch.setattr(variants, "SLICE", 64)
    monkeypatch.setattr(variants, "HELD", 3)
    assert rows(variants.spelling_variants(spark.createDataFrame(words, "doc_id long, text string"), 199)) == brute(words, 199)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows(variants.spelling_variants(docs, 199)) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 199)


def test_hashes_of_edits_are_those_of_the_edited_words():
    draw = random.Random(8)
    for _ in range(200):
        w = "".join(draw.choices("abcé", k=draw.randint(2, 12)))
        symbols = np.array(sorted(map(ord, set(w) | {"z"})), dtype=np.int64)
        full = Filters(np.arange(variants.SHARDS + 2), np.full(variants.SHARDS + 1, -1, dtype=np.int64).view(np.uint64))
        found = [e for _, edits in positives([w], full, symbols) for e in edits]
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + chr(s) + w[i + 1 :] for i in range(len(w)) for s in symbols if s > ord(w[i])}
        assert sorted(found) == sorted(want)
        # and a filter that holds just these words says yes to each of them
        sized = Filters.sized(Counter(len(x) for x in want))
        sized.blocks = np.zeros(int(sized.first[-1]), dtype=np.uint64)
        for x in want:
            codes = np.array([[ord(c) for c in x]], dtype="<u4")
            block, bits = sized.places(polynomial(codes), len(x))
            sized.blocks[block] |= bits
        assert sorted(e for _, edits in positives([w], sized, symbols) for e in edits) == sorted(want)


def test_odd_rows(edge, empty, spark):
    given = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert rows(variants.spelling_variants(edge, 199)) == brute(given, 199)
    assert variants.spelling_variants(empty).collect() == []
    long = "ab" * 40_000
    odd = [(k, f"{long} {long}a {'q' * 50} {'q' * 49}") for k in range(5)]
    got = rows(variants.spelling_variants(spark.createDataFrame(odd, "doc_id long, text string")))
    assert [r[4] for r in got] == [1, 1, 1, 1]
