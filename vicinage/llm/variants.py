"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words are counted per task before the shuffle. Blocked Bloom filters, one a word length, hold the vocabulary: a
block is one 64-bit number, and a word sets some bits of one block. Each word's neighbourhood is probed
in them: every deletion, and every replacement by a later symbol. (The other half of the neighbourhood, insertions
and earlier symbols, is the same set of pairs seen from the other word.) Hashes of edits come from the word's own
polynomial hash in numpy, and only positives become strings; these meet the vocabulary in an exact join, where false positives go.

The filters have BITS_A_WORD bits a word and MOST_BITS in all, whatever the vocabulary's size: a fuller filter lets more
false positives through to the join and loses nothing.

Rows without text have no words. A null doc_id counts as an empty text in the draw of misspellings. Rows that repeat count each, and
so do ids. A word may be as long as a text: its edits are hashed in slices. Ties of frequency go to the
smaller word in code-point order. Of the columns only doc_id and text are read, so names cannot clash. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import Scratch, cut, in_slices

#: Fixed values of the contract: letters of words, one word occurrence in MISSPELT loses a letter, least length and count, and how much more frequent a form is.
LETTERS = "a-zA-ZÀ-ÿ"
MISSPELT, LEAST_CHARS, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Size of the filters, bits that a word sets, and lengths that have a filter of their own; longer words share the last.
BITS_A_WORD, MOST_BITS, BITS_SET, SHARDS = 32, 1 << 26, 5, 48
#: Distinct words that a task holds before it passes their counts on, and edits that are hashed at once.
HELD, SLICE = 200_000, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers: multiplications and shifts, each of which can be undone."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def symbol_values(codes: np.ndarray) -> np.ndarray:
    return _mix(codes.astype(np.uint64) + _ODD)


def powers(n: int) -> np.ndarray:
    """_ODD to the powers 0 to n - 1."""
    out = np.ones(n, dtype=np.uint64)
    out[1:] = _ODD
    return np.multiply.accumulate(out)


def polynomial(words: np.ndarray) -> np.ndarray:
    """The hash of each row of a matrix of code points: the sum of symbol values times powers."""
    return (symbol_values(words) * powers(words.shape[1])).sum(axis=1, dtype=np.uint64)


def shard(length: int) -> int:
    return min(length, SHARDS)


class Filters:
    """The blocks of all lengths in one array; shard k has blocks first[k] to first[k + 1]."""

    def __init__(self, first: np.ndarray, blocks: np.ndarray | None = None):
        self.first, self.blocks = first, blocks

    @classmethod
    def sized(cls, words_by_shard: dict[int, int]) -> Filters:
        """Blocks in proportion to the words of each length, MOST_BITS in all at most."""
        bits = np.array([words_by_shard.get(k, 0) * BITS_A_WORD for k in range(SHARDS + 1)], dtype=np.float64)
        bits *= min(1.0, MOST_BITS / max(1.0, bits.sum()))
        return cls(np.concatenate([[0], np.cumsum(np.ceil(bits / 64))]).astype(np.int64))

    def places(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits of each word of a length; the length's shard must have a block."""
        k = shard(length)
        mixed = _mix(hashes)
        n = np.uint64(self.first[k + 1] - self.first[k])
        block = (((mixed >> np.uint64(32)) * n) >> np.uint64(32)).astype(np.int64) + self.first[k]
        bits = np.zeros(len(mixed), dtype=np.uint64)
        for i in range(BITS_SET):
            bits |= np.uint64(1) << ((mixed >> np.uint64(6 * i)) & np.uint64(63))
        return block, bits

    def has(self, hashes: np.ndarray, length: int) -> np.ndarray:
        k = shard(length)
        if self.first[k] == self.first[k + 1]:
            return np.zeros(len(hashes), dtype=bool)
        block, bits = self.places(hashes, length)
        return (self.blocks[block] & bits) == bits


def occurrences(docs: DataFrame, misspelt: int | None = None) -> DataFrame:
    """(word, n) sums of parts of the table, one row or more a word, of words of LEAST_CHARS or more.

    With misspelt, the occurrences whose draw it divides lose the letter that the draw points at.
    """
    word = re.compile(f"[{LETTERS}]{{{LEAST_CHARS},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in in_slices(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                # bytes.lower() knows the letters A to Z alone
                own = Counter(word.findall((t or "").encode().lower().decode()))
                if misspelt:
                    seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for w in [w for w in own if not zlib.crc32(w.encode(), seed) % misspelt]:
                        at = zlib.crc32(w.encode(), seed) % len(w)
                        n = own.pop(w)
                        if len(w) > LEAST_CHARS:
                            held[w[:at] + w[at + 1 :]] += n
                held.update(own)
                if len(held) >= HELD:
                    yield told()
        if held:
            yield told()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long")


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(length, words, their code points as a matrix)."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, own in groups.items():
        yield n, own, np.frombuffer("".join(own).encode("utf-32-le"), dtype="<u4").reshape(len(own), n)


def filters_of(vocabulary: DataFrame) -> tuple[Filters, np.ndarray]:
    """The filters of vocabulary(word), and its symbols in order. The driver gets counts by length, the symbols and the blocks: MOST_BITS at most."""
    lengths = vocabulary.groupBy(F.least(F.length("word"), F.lit(SHARDS)).alias("k")).agg(F.count("*").alias("n")).collect()
    filters = Filters.sized({r["k"]: r["n"] for r in lengths})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for n, _, codes in _by_length(b.column("word").to_pylist()):
                seen.update(np.unique(codes).tolist())
                block, bits = filters.places(polynomial(codes), n)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], names=["block", "bits"])
        # symbols go along as blocks below 0
        yield pa.RecordBatch.from_arrays([pa.array([-1 - c for c in seen], pa.int64()), pa.array([0] * len(seen), pa.int64())], names=["block", "bits"])

    merged = vocabulary.select("word").mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toPandas()
    place, bits = merged["block"].to_numpy(dtype=np.int64), merged["bits"].to_numpy(dtype=np.int64)
    filters.blocks = np.zeros(int(filters.first[-1]), dtype=np.uint64)
    filters.blocks[place[place >= 0]] = bits[place >= 0].view(np.uint64)
    return filters, np.sort(-1 - place[place < 0])


def positives(words: list[str], filters: Filters, symbols: np.ndarray) -> Iterator[tuple[list[str], list[str]]]:
    """(words, edits of them) whose filter answers yes: deletions, and replacements by a greater symbol; each edit once a word."""
    worth = symbol_values(symbols)
    for n, own, codes in _by_length(words):
        power = powers(n)
        many = max(1, SLICE // n)
        for r in range(0, len(own), many):
            c = codes[r : r + many]
            terms = symbol_values(c) * power
            sums = np.concatenate([np.zeros((len(c), 1), dtype=np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
            whole = sums[:, -1:]
            # what stands behind a deleted symbol moves down by one power, which the inverse of _ODD does
            shorter = sums[:, :-1] + (whole - sums[:, 1:]) * _INVERSE
            fresh = np.ones(c.shape, dtype=bool)
            fresh[:, 1:] = c[:, 1:] != c[:, :-1]  # of equal neighbours the first one's deletion stands for all
            row, at = np.nonzero(fresh)
            hit = filters.has(shorter[row, at], n - 1)
            yield from _told(own, r, ((k, i, "") for k, i in zip(row[hit].tolist(), at[hit].tolist(), strict=True)))
            wide = max(1, SLICE // (len(c) * len(symbols)))
            for i in range(0, n, wide):
                part = c[:, i : i + wide]
                row, at, by = np.nonzero(symbols > part[:, :, None])
                hashes = whole[row, 0] + (worth[by] - symbol_values(part[row, at])) * power[at + i]
                hit = filters.has(hashes, n)
                yield from _told(own, r, ((k, j + i, chr(symbols[s])) for k, j, s in zip(row[hit].tolist(), at[hit].tolist(), by[hit].tolist(), strict=True)))


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _told(own: list[str], first: int, edits: Iterator[tuple[int, int, str]]) -> Iterator[tuple[list[str], list[str]]]:
    found = [(own[first + k], i, s) for k, i, s in edits]
    if found:
        yield [w for w, _, _ in found], [w[:i] + s + w[i + 1 :] for w, i, s in found]


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n) of all words of vocabulary(word, n) that are one edit apart, both ways."""
    filters, symbols = filters_of(vocabulary)
    sent = vocabulary.sparkSession.sparkContext.broadcast((filters.first, filters.blocks, symbols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, blocks, known = sent.value
        for b in in_slices(batches, 4096):
            words, n = b.column("word").to_pylist(), dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True))
            for own, edits in positives(words, Filters(first, blocks), known):
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([n[w] for w in own], pa.int64()), pa.array(edits, pa.string())], names=["own", "own_n", "word"])

    maybe = vocabulary.select("word", "n").mapInArrow(run, "own string, own_n long, word string")
    pairs = maybe.join(vocabulary.select("word", "n"), "word")
    ways = F.array(F.struct(F.col("own").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")), F.struct(F.col("word").alias("word"), F.col("own").alias("near"), F.col("own_n").alias("near_n")))
    return pairs.select(F.explode(ways).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): where the chain of forms ends.

    Pointers double in each round. A form is TIMES as frequent as its word, so chains have some 27 links at most and five or six rounds do.
    """
    at = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        step = cut(at.join(ahead, "root", "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        at = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, misspelt: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with LEAST_COUNT occurrences or more."""
    with Scratch(docs.sparkSession) as scratch:
        counts = occurrences(docs, misspelt).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
        vocabulary = scratch.table("vocabulary", counts)
        best = F.min(F.struct((-F.col("near_n")).alias("_m"), F.col("near").alias("form")))
        near = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_b"))
        usual = -F.col("_b._m") >= TIMES * F.col("n")
        forms = vocabulary.join(near, "word", "left").select("word", F.when(usual, F.col("_b.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, -F.col("_b._m")).alias("form_n"))
        forms = scratch.table("forms", forms)
        out = forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return cut(out)
