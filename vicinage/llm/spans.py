"""Substring dedup by sliding spans of sentences.

A text is cut into sentences at full stops, question and exclamation marks and line ends; long ones
are cut further, into pieces of about five words, before each word whose hash is the least among its
NEAR neighbours on both sides. As only near words decide, and sentence ends fewer than EDGE words
away, a passage is cut alike wherever it stands, but for its first and last few words. (A stretch of
one or two words over and over has no least word and is one piece.) Hashed and joined globally are the run of SPAN
consecutive sentences from the start of each, however short they are, and from every piece the run of SPAN pieces
or more that has MIN_WORDS words; of two runs from one place the shorter one serves, as runs from the next
places go on. A dot counts as a sentence's end here only before a blank. The first place of a run (the smallest doc_id, then the text's
hash, then the place in it) stays; the pieces that any later one covers are removed.

So three short lines that many texts share go from all but one. Who wants such lines to stay asks for spans of `least` words or more.

Null text stays null; a text shorter than a span is left as it is. A very long text is
taken whole: a task holds one with some 60 bytes for each of its own. A document is known by its
doc_id, which may be null, and a hash of its text: rows that share both are one document to this
operator, and all stay as the first one does; rows that share only one are different documents. Columns of the input that are
named like the two that are added are replaced. A text
of which all is covered becomes empty. All columns of the input are kept, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vicinage.llm.common import cut, in_slices, make_room
from vicinage.llm.jaccard import _mix, _power_tables

SPAN = 3
#: Words of a run of pieces at least, if it is not one of whole sentences: a lone sentence of fewer words is no span though it may have three pieces.
MIN_WORDS = 20
#: A word starts a piece if its hash is the least of NEAR words on either side, so pieces have more than NEAR words.
NEAR = 2
#: Words at least in the first and in the last piece of a cut sentence.
EDGE = 6
#: Low bits of a place that number the run; those above are the text's hash. A text has fewer runs than bytes, so 2^31 at most.
RUN_BITS = 31
#: Bits of the filter over run hashes (a fixed 4 MB, whatever the corpus).
FILTER_BITS = 25
_WIDE_BLANK = re.compile(r"[^\S\x00-\x7f]")


def _shadow(text: str) -> bytes:
    """The text's bytes with every other white space than ASCII as spaces, place by place."""
    return (text if text.isascii() else _WIDE_BLANK.sub(lambda m: " " * len(m.group().encode()), text)).encode()


class Pieces:
    """The pieces of a list of texts: byte places, and hashes and words of those that are not blank."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        self.base = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        seen = np.frombuffer(b"\n".join(r if len(t or "") == len(r) else _shadow(t or "") for t, r in zip(texts, raw, strict=True)) + b"\n", dtype=np.uint8)
        n = len(seen)
        blank = (seen == 32) | ((seen >= 9) & (seen <= 13)) | ((seen >= 28) & (seen <= 31))
        ends = (seen == 10) | (seen == 46) | (seen == 33) | (seen == 63)
        space = blank & (seen != 10)
        # a sentence starts where the last byte that is no space ends one, unless the run of end marks goes on
        last = np.maximum.accumulate(np.where(space, -1, np.arange(n)))
        starts = np.zeros(n, dtype=bool)
        after_end = (last[:-1] >= 0) & ends[last[:-1]]
        starts[1:] = after_end & ~space[1:] & ~(ends[1:] & (last[:-1] == np.arange(n - 1)))
        starts[self.base[:-1]] = True
        sentence = np.cumsum(starts)
        fresh = starts.copy()
        fresh[1:] &= blank[:-1]
        # words: stretches without blanks, parted where a sentence starts
        word_at = ~blank
        word_at[1:] &= blank[:-1] | starts[1:]
        first = np.flatnonzero(word_at)
        stop = ~blank
        stop[:-1] &= blank[1:] | starts[1:]
        end = np.flatnonzero(stop) + 1
        power, inverse = _power_tables(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
        own = _mix((total[end] - total[first]) * inverse[first])
        of = sentence[first]
        n_words = np.bincount(of, minlength=int(sentence[-1]) + 1)
        from_start = np.arange(len(of)) - (np.cumsum(n_words) - n_words)[of]
        least = (from_start >= EDGE) & (n_words[of] - from_start >= EDGE)
        for k in range(1, NEAR + 1):
            least[k:] &= own[k:] < own[:-k]
            least[:-k] &= own[:-k] <= own[k:]
        starts[first[least]] = True
        #: start of every piece, blank ones too, in the joined bytes; the line end after a text belongs to none
        self.at = np.flatnonzero(starts)
        piece = np.cumsum(starts)[first] - 1
        new = np.flatnonzero(np.diff(piece, prepend=-1))
        close = np.append(new[1:], len(piece))[: len(new)] - 1
        #: places in `at` of those that are not blank, from their first word to their last one
        self.full = piece[new]
        a, b = first[new], end[close]
        self.hash = _mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        gaps = np.concatenate([np.zeros(1, np.int64), np.cumsum(data == 32)])
        self.words = gaps[b] - gaps[a] + 1
        #: whether a sentence starts with the piece: behind a blank, so that dots inside numbers, names and addresses count for nothing
        self.whole = np.zeros(len(self.full), dtype=bool)
        begins = self.at[self.full]
        self.whole[:] = fresh[begins]
        #: bounds of each text in `at` and in `full`
        self.bounds = np.searchsorted(self.at, self.base)
        self.full_bounds = np.searchsorted(self.full, self.bounds)

    def runs(self, span: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start in `full`, end, text) of the run from every piece: `span` whole sentences of at least `least` words, or `span` pieces or more of MIN_WORDS words, whatever ends first."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.words)])
        n = len(self.full)
        start = np.arange(n)
        end = np.maximum(start + span, np.searchsorted(total, total[:-1] + MIN_WORDS))
        text = np.repeat(np.arange(len(self.full_bounds) - 1), np.diff(self.full_bounds))
        # a text's end ends a sentence, as does the start of the next one
        opens = np.unique(np.concatenate([np.flatnonzero(self.whole), self.full_bounds]))
        own = np.searchsorted(opens, start)
        sentences = np.append(opens, np.full(span + 1, n + 1))[own + span]
        said = total[np.minimum(sentences, n)] - total[:-1]
        end = np.where(self.whole & (said >= least), np.minimum(end, sentences), end)
        ok = end <= self.full_bounds[1:][text]
        return start[ok], end[ok], text[ok]


def sentences(text: str) -> list[str]:
    """The text in pieces that join to it again."""
    p, raw = Pieces([text]), text.encode()
    at = p.at[p.at < len(raw)].tolist()
    return [raw[a:b].decode() for a, b in zip(at, [*at, len(raw)][1:], strict=True)]


def span_hashes(texts: list[str | None], span: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the runs of all texts: hash, text, and place of the first piece among those of its text that are not blank."""
    p = Pieces(texts)
    start, end, text = p.runs(span, least)
    h = np.zeros(len(start), dtype=np.uint64)
    for k in range(int((end - start).max(initial=0))):
        more = slice(None) if k < span else np.flatnonzero(start + k < end)
        h[more] = _mix(h[more] * np.uint64(0x9E3779B97F4A7C15) + p.hash[start[more] + k])
    return h.view(np.int64), text, start - p.full_bounds[text]


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of about `most` characters with their texts."""
    make_room()
    for whole in in_slices(batches, 1024):
        texts, first, size = whole.column("text").to_pylist(), 0, 0
        for k, t in enumerate(texts):
            size += len(t or "") + 1
            if size >= most or k + 1 == len(texts):
                yield whole.slice(first, k + 1 - first), texts[first : k + 1]
                first, size = k + 1, 0


def _spans(span: int, least: int, repeated: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _slices(batches):
            h, row, pos = span_hashes(texts, span, least)
            if repeated is not None:
                at = h & ((1 << FILTER_BITS) - 1)
                some = np.flatnonzero((repeated.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
                h, row, pos = h[some], row[some], pos[some]
            high = b.column("text_id").to_numpy(zero_copy_only=False)[row] >> RUN_BITS << RUN_BITS
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column("doc_id").take(pa.array(row)), pa.array(high | pos)], names=["h", "doc_id", "place"])

    return run


def _text_id(text: Column) -> Column:
    return F.xxhash64(text)


def spans(docs: DataFrame, span: int = SPAN, least: int = 1, repeated: Broadcast | None = None) -> DataFrame:
    """(h, doc_id, place): every run, or those that the filter lets through; place is the text's hash and the run's number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id(F.col("text")).alias("text_id"), "text")
    return rows.mapInArrow(_spans(span, least, repeated), "h long, doc_id long, place long")


def remove(texts: list[str | None], places: list[list[int] | None], span: int = SPAN, least: int = 1) -> list[tuple[str | None, int, int]]:
    """Each text without the runs that start at the given places, its pieces, and those removed."""
    p = Pieces(texts)
    start, end, _ = p.runs(span, least)
    until = np.zeros(len(p.full), dtype=np.int64)
    until[start] = end
    out = []
    for k, (t, some) in enumerate(zip(texts, places, strict=True)):
        if t is None:
            out.append((None, 0, 0))
            continue
        raw, base = t.encode(), int(p.base[k])
        at = p.at[p.bounds[k] : p.bounds[k + 1]] - base
        at = at[at < len(raw)]
        if not some:
            out.append((t, len(at), 0))
            continue
        lo, hi = p.full_bounds[k : k + 2]
        # +1 where a run starts, -1 where it ends: pieces inside any run are covered
        runs = np.asarray(some, dtype=np.int64)
        steps = np.bincount(runs, minlength=hi - lo + 1) - np.bincount(until[lo + runs] - lo, minlength=hi - lo + 1)
        gone = p.full[lo:hi][np.cumsum(steps)[:-1] > 0] - p.bounds[k]
        stay = np.ones(len(at), dtype=bool)
        stay[gone] = False
        stops = np.append(at, len(raw))[1:]
        kept = b"".join(raw[a:b] for a, b in zip(at[stay].tolist(), stops[stay].tolist(), strict=True)).decode()
        out.append((kept if kept.strip() else "", len(at), len(gone)))
    return out


def _rebuild(span: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _slices(batches):
            done = remove(texts, b.column("starts").to_pylist(), span, least)
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array([t for t, _, _ in done], pa.string()), pa.array([n for _, n, _ in done], pa.int64()), pa.array([n for _, _, n in done], pa.int64())], names=["rest", "text", "n_sentences", "n_removed"])

    return run


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each remainder of an id that is among ids[column]: 2^FILTER_BITS bits, merged by Spark."""
    place = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = ids.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def repeated_places(docs: DataFrame, span: int = SPAN, least: int = 1) -> DataFrame:
    """(doc_id, place) of every repeated run but its first. Counts are summed before the shuffle, so a hot run is one row a task there."""
    at = F.struct("doc_id", "place")
    firsts = spans(docs, span, least).groupBy("h").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("NOT (first <=> last)").select("h", "first")
    # a filter of fixed size saves most of the second shuffle, until repeated runs are as many as its bits
    firsts = cut(firsts)
    repeated = docs.sparkSession.sparkContext.broadcast(id_filter(firsts, "h"))
    # many spans of one hash split over tasks (adaptive skew join), as the other side has one row a hash
    return spans(docs, span, least, repeated).join(firsts, "h").where(~at.eqNullSafe(F.col("first"))).select("doc_id", "place")


def dedup_spans(docs: DataFrame, span: int = SPAN, least: int = 1) -> DataFrame:
    """docs with repeated pieces removed from text, and n_sentences and n_removed. least: words of `span` whole sentences that count as a span."""
    number, high = F.col("place").bitwiseAND(F.lit((1 << RUN_BITS) - 1)), lambda c: F.shiftright(c, RUN_BITS)
    found = repeated_places(docs, span, least).groupBy("doc_id", high(F.col("place")).alias("high")).agg(F.collect_set(number).alias("starts"))
    # the input's other columns travel as one, so that none of their names can clash
    rest = [c for c in docs.columns if c not in ("text", "n_sentences", "n_removed")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), "text")
    same = rows["rest"]["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (high(_text_id(rows["text"])) == found["high"])
    schema = StructType([rows.schema["rest"], StructField("text", StringType()), StructField("n_sentences", LongType()), StructField("n_removed", LongType())])
    done = rows.join(found, same, "left").select("rest", "text", "starts").mapInArrow(_rebuild(span, least), schema)
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    return done.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in kept), "n_sentences", "n_removed")
