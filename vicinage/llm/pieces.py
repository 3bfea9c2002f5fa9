"""SentencePiece encoding with exact N-best segmentations, and decoding.

The lattice of a text has a node before and after each character and an edge for each piece that
matches. Forward Viterbi gives each node its best score from the start; these scores are exact
heuristics for an A* search that runs backward from the end, so complete paths leave its heap in
order of their scores. If no piece of the model goes on into white space, the lattice falls apart into short
chunks at every space; each chunk is solved once and remembered, and the best combinations over
a whole text come from the chunks with the smallest gaps to their next paths, by the same search.
With other models a text is one chunk.

A path's score is the sum of the model's own scores. Those of a model of the BPE kind are merge ranks (-r), whose
sums need not give the model's own merges; on request a piece of rank r counts -ln(r + 2) (Zipf's law) instead. A
character without a piece costs more than any piece and becomes its UTF-8 bytes' pieces, and so
does a literal U+2581, so that decoding gives back every text exactly. Equal scores are decided by
the order of the search, which is fixed.

Null text counts as empty, which has one segmentation, of no pieces. Repeated rows are encoded alike. A very long text is held
whole in one task, with some 50 bytes for each of its chunks; a chunk of n characters takes some 100 n bytes while it is
solved. Of the columns only doc_id and text are read, so names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import kept

SPACE = "▁"
#: Stands for a literal U+2581 inside the lattice; no valid text holds a lone surrogate.
LITERAL = "\ud800"
N_BEST = 3
#: Solved chunks that a Python worker remembers, and characters in one of them; longer ones are solved each time.
MEMO, LONGEST = 500_000, 64
_CHUNK = re.compile(r" *[^ \n]+|\n| +")
#: Where no piece joins a letter with a mark behind it, a word's marks are chunks of their own.
_MARKS = ",.!?;:"
_WHOLE = re.compile("(?s).+")
_FINE = re.compile(r" *[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ ,.!?;:\n]|$)| *[^ \n]+|\n| +")


class Lattice:
    """Pieces and scores of a model, and the search over one chunk."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: float):
        self.byte_ids, self.unknown = byte_ids, unknown
        #: Every beginning of a piece; those that are pieces have their id and score.
        self.starts: dict[str, tuple] = {p[:k]: () for p in pieces for k in range(1, len(p))}
        self.starts |= {p: ((k,), score) for p, (k, score) in pieces.items()}
        #: the same pieces as an automaton, for text of which every character is one
        self.single = {p for p in pieces if len(p) == 1}
        self.matches = ahocorasick.Automaton()
        for p, (k, score) in pieces.items():
            self.matches.add_word(p, (len(p) - 1, score, (k,)))
        self.matches.make_automaton()

    def forward(self, s: str) -> tuple[list[float], list[list[tuple[float, int, float, tuple[int, ...]]]]]:
        """Viterbi: each node's best score from the start, and its incoming edges (best score over the edge, start, score, ids)."""
        return self._with_bytes(s) if not self.single.issuperset(s) else self._by_matches(s)

    def _by_matches(self, s: str) -> tuple[list[float], list[list[tuple[float, int, float, tuple[int, ...]]]]]:
        """Matches come by their end, so all edges into a node are known before one leaves it."""
        best, into = [0.0], [[]]
        last, edges, top = -1, into[0], 0.0
        for end, (back, score, ids) in self.matches.iter(s):
            if end != last:
                last, edges, top = end, [], -math.inf
                into.append(edges)
                best.append(top)
            i = end - back
            total = best[i] + score
            edges.append((total, i, score, ids))
            if total > top:
                top = best[-1] = total
        return best, into

    def _with_bytes(self, s: str) -> tuple[list[float], list[list[tuple[float, int, float, tuple[int, ...]]]]]:
        """By the beginnings of pieces at each node; a character without a piece becomes bytes."""
        n, find = len(s), self.starts.get
        best = [0.0] + [-math.inf] * n
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            here, single = best[i], False
            for j in range(i + 1, n + 1):
                hit = find(s[i:j])
                if hit is None:
                    break
                if hit:
                    ids, score = hit
                    total = here + score
                    into[j].append((total, i, score, ids))
                    if total > best[j]:
                        best[j] = total
                    single |= j == i + 1
            if not single:
                char = SPACE if s[i] == LITERAL else s[i]
                total = here + self.unknown
                into[i + 1].append((total, i, self.unknown, tuple(self.byte_ids[b] for b in char.encode())))
                best[i + 1] = max(best[i + 1], total)
        return best, into

    def n_best(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of s, best first.

        A heap entry is a path from the end with the edge it takes next, as good as its best completion. From the
        entry that is taken, best edges lead on to the start without a loss, so these need not pass through the heap;
        the next best edge beside each of them enters it.
        """
        _, into = self.forward(s)
        for edges in into:
            if len(edges) > 1:
                edges.sort(reverse=True)
        heap: list[tuple] = []
        out: list[tuple[float, list[int]]] = []
        count, at, k, behind, path = 0, len(s), 0, 0.0, ()
        while True:
            last = len(out) == n - 1
            while at:
                edges = into[at]
                _, i, score, ids = edges[k]
                if not last and k + 1 < len(edges):
                    count += 1
                    heapq.heappush(heap, (-(edges[k + 1][0] + behind), count, at, k + 1, behind, path))
                behind, path, at, k = behind + score, (ids, path), i, 0
            ids = []
            while path:
                own, path = path
                ids += own
            out.append((behind, ids))
            if last or not heap:
                return out
            _, _, at, k, behind, path = heapq.heappop(heap)


def _nearest(gaps: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest gaps: only these chunks can differ from their best in one of the n + 1 best paths."""
    if len(gaps) <= n:
        return np.arange(len(gaps))
    return np.sort(np.argpartition(gaps, n - 1)[:n]) if n else np.zeros(0, dtype=np.int64)


def combine(gaps: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n smallest sums that take one entry of each list (each starts with 0 and ascends), with the entries taken."""
    heap = [(0.0, (0,) * len(gaps))]
    seen, out = {heap[0][1]}, []
    while heap and len(out) < n:
        cost, at = heapq.heappop(heap)
        out.append((cost, at))
        for k in range(len(gaps)):
            if at[k] + 1 < len(gaps[k]):
                up = (*at[:k], at[k] + 1, *at[k + 1 :])
                if up not in seen:
                    seen.add(up)
                    heapq.heappush(heap, (cost - gaps[k][at[k]] + gaps[k][up[k]], up))
    return out


class Coder:
    """Encoder and decoder of one model, kept for the life of a Python worker."""

    def __init__(self, path: str, zipf: bool = False):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces, self.byte_ids, self.bytes_of = {}, [0] * 256, [b""] * size
        for k in range(size):
            p = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(p[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(p[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                pieces[p] = (k, -math.log(2 - model.get_score(k)) if zipf else model.get_score(k))
                self.bytes_of[k] = p.replace(SPACE, " ").encode()
        joined = any(a.isalpha() and b in _MARKS for p in pieces for a, b in zip(p, p[1:], strict=False))
        apart = not any((a != SPACE and b == SPACE) or "\n" in a + b for p in pieces for a, b in zip(p, p[1:], strict=False))
        self.chunk = _WHOLE if not apart else _CHUNK if joined else _FINE
        self.lattice = Lattice(pieces, self.byte_ids, min(s for _, s in pieces.values()) - 10)
        self.forget()

    @classmethod
    def of(cls, path: str, zipf: bool = False) -> Coder:
        return kept(("pieces", path, zipf), lambda: cls(path, zipf))

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        #: the ids of each chunk's best segmentation; the next ones are solved again where a text takes them
        self.best: list[bytes] = []
        self.scores, self.gaps = np.zeros(1024), np.zeros((1024, N_BEST - 1))

    def _solve(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        return self.lattice.n_best(chunk.replace(SPACE, LITERAL).replace(" ", SPACE), n)

    def _remember(self, chunks: list[str]) -> None:
        """Solve chunks that are not known yet, each once."""
        first, scores, gaps = len(self.best), [], []
        for c in chunks:
            found = self._solve(c, N_BEST)
            self.index[c] = len(self.best)
            top, ids = found[0]
            self.best.append(array("I", ids).tobytes())
            scores.append(top)
            gaps.append([top - s for s, _ in found[1:]] + [math.inf] * (N_BEST - len(found)))
        while len(self.best) > len(self.scores):
            self.scores, self.gaps = (np.concatenate([a, np.zeros_like(a)]) for a in (self.scores, self.gaps))
        new = slice(first, len(self.best))
        self.scores[new], self.gaps[new] = scores, gaps

    def _split(self, text: str) -> list[str]:
        return self.chunk.findall(" " + text) if text else []

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The N_BEST best segmentations: score and ids (little-endian 32-bit), best first."""
        if len(self.index) > MEMO:
            self.forget()
        chunks, index = self._split(text), self.index
        try:
            at = np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks))
        except KeyError:
            self._remember([c for c in dict.fromkeys(chunks) if c not in index])
            at = np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks))
        total, first = float(self.scores[at].sum()), self.gaps[at, 0]
        near = _nearest(first, N_BEST - 1).tolist()
        lists = [[0.0, *(g for g in self.gaps[at[k]].tolist() if g < math.inf)] for k in near]
        parts = [self.best[k] for k in at.tolist()]
        solved: dict[int, list] = {}
        out = []
        for cost, taken in combine(lists, N_BEST):
            own = parts
            if any(taken):  # a few chunks take one of their next segmentations
                own = parts.copy()
                for k, r in zip(near, taken, strict=True):
                    if r:
                        solved[k] = solved.get(k) or self._solve(chunks[k], N_BEST)
                        own[k] = array("I", solved[k][r][1]).tobytes()
            out.append((total - cost, b"".join(own)))
        if len(chunks) and max(map(len, chunks)) > LONGEST:
            self._forget_long(chunks)
        return out

    def _forget_long(self, chunks: list[str]) -> None:
        for c in chunks:
            if len(c) > LONGEST and (k := self.index.pop(c, None)) is not None:
                self.best[k] = b""

    def encode_n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text, best first."""
        solved = [self._solve(c, n) for c in self._split(text)]
        near = _nearest(np.array([s[0][0] - s[1][0] if len(s) > 1 else np.inf for s in solved]), n - 1).tolist()
        total, out = sum(s[0][0] for s in solved), []
        for cost, taken in combine([[solved[k][0][0] - score for score, _ in solved[k]] for k in near], n):
            other = dict(zip(near, taken, strict=True))
            out.append((total - cost, [x for p, s in enumerate(solved) for x in s[other.get(p, 0)][1]]))
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[k] for k in np.frombuffer(ids, dtype="<u4").tolist()])[1:].decode()


def _encode_batches(path: str, keep_ids: bool, zipf: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vicinage.llm.tokenfile import _id_lists

        coder = Coder.of(path, zipf)
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                texts = [t or "" for t in b.column("text").to_pylist()]
                coded = [coder.encode(t) for t in texts]
                ids = [c[0][1] for c in coded]
                back = [coder.decode(c) for c in ids]
                columns = {
                    "doc_id": b.column("doc_id"),
                    "n_pieces": pa.array([len(c) // 4 for c in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(c) for c in ids], pa.int64()),
                    "text_crc32": pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                    "exact": pa.array([t == u for t, u in zip(texts, back, strict=True)]),
                    "scores": pa.array([[s for s, _ in c] for c in coded], pa.list_(pa.float64())),
                    "n_best_pieces": pa.array([[len(x) // 4 for _, x in c] for c in coded], pa.list_(pa.int64())),
                    "n_best_crc32": pa.array([[zlib.crc32(x) for _, x in c] for c in coded], pa.list_(pa.int64())),
                }
                if keep_ids:
                    columns["ids"] = _id_lists(ids)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_pieces(docs: DataFrame, model: str, keep_ids: bool = False, zipf: bool = False) -> DataFrame:
    """One row a document.

    n_pieces and crc32 of the best ids, crc32 of the text decoded from them, whether it is the text; scores, pieces and
    crc32 of the N_BEST best segmentations, best first; and the best ids on request.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, exact boolean, scores array<double>, n_best_pieces array<long>, n_best_crc32 array<long>" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode_batches(model, keep_ids, zipf), schema)
