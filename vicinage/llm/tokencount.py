"""Token counts of texts, without keeping any token.

Arrow batches are regrouped so that each call of the tokenizer gets about the same number of bytes,
and a long text is worked off in sections that end at safe boundaries: places that no token crosses.
Which places are safe follows from the tokenizer's file:

- a .model of the BPE kind that leaves text as it is (no normalisation, a space put before it): before a space behind
  another character, if no piece goes on from a character into a space; before a line end, if no piece holds one beside
  other characters. What starts at a dropped space gets the space back by the one put before it.
- a .json: those that tokenfile.Encoder cuts at.

What lies between two boundaries is encoded once and its length remembered. With other models texts are
encoded whole, still in batches of even size.

Null text counts as empty, which has no token. Rows are counted one by one, so repeated, tied and null ids stay as they
are. A text without a safe boundary is encoded whole in one task. Of the columns only doc_id and text are read, so names
cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vicinage.llm.common import kept
from vicinage.llm.tokenfile import Encoder

#: Bytes of text that are counted together, and characters after which a text is cut at the next safe boundary.
BATCH_BYTES, SECTION = 4 << 20, 1 << 20
#: Lengths that a Python worker remembers at most, half of them since the other half was last full, and characters of what has one.
MEMO, LONGEST = 800_000, 64
LIMIT = 4096
SPACE = "▁"
#: Behind a character that is no space (a literal U+2581 is one too) a space is dropped; nothing is dropped before a line end.
_CUT, _LINES_TOO = re.compile(f"(?<=[^ {SPACE}]) "), re.compile(f"(?<=[^ {SPACE}]) |(?=\n)")

Counter = Callable[[list[str]], list[int]]


class PieceCounter:
    """Lengths under a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        form = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            form.ParseFromString(f.read())
        plain = form.normalizer_spec
        pieces = [p.piece for p in form.pieces if p.type in (1, 4)]  # ordinary and user-defined ones
        self.in_parts = (
            form.trainer_spec.model_type == 2 and form.trainer_spec.byte_fallback and not form.trainer_spec.treat_whitespace_as_suffix
            and plain.add_dummy_prefix and plain.escape_whitespaces and not plain.remove_extra_whitespaces and not plain.precompiled_charsmap
            and SPACE in pieces and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        )
        self.lines = not any("\n" in p for p in pieces)
        self.cut = _LINES_TOO if self.lines else _CUT
        #: a lone space stands where nothing is left between two boundaries
        self.memo: dict[str, int] = {"": 1}
        self.old: dict[str, int] = {}

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def sections(self, text: str) -> Iterator[tuple[list[str], int]]:
        """Parts of each section of the text, and what their lengths count too much."""
        at, end, extra = 0, len(text), 0
        while True:
            found = self.cut.search(text, at + SECTION) if end - at > SECTION else None
            part = text[at : found.start()] if found else text[at:]
            if "  " in part or SPACE in part or part[:1] == " ":
                yield self.cut.split(part), extra
            else:
                yield (part.replace("\n", " \n") if self.lines else part).split(" "), extra
            if not found:
                return
            at = found.end()
            extra = int(found.end() == found.start())  # a section that starts with a line end has no space before it

    def counts(self, texts: list[str]) -> list[int]:
        if not self.in_parts:
            return self._lengths(texts)
        out = []
        for text in texts:
            total = 0
            for parts, extra in self.sections(text) if text else ():
                total += self._sum(parts) - extra
            out.append(total)
        return out

    def _sum(self, parts: list[str]) -> int:
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, parts))
        except KeyError:
            pass
        if 2 * len(memo) > MEMO:
            memo, self.old = {"": 1}, memo
            self.memo = memo
        missing, old = set(parts).difference(memo), self.old
        memo.update([(c, old[c]) for c in missing if c in old])
        new = [c for c in missing if c not in old]
        lone = self.lines
        memo.update((c, n - (lone and c[0] == "\n")) for c, n in zip(new, self._lengths(new), strict=True))
        total = sum(map(memo.__getitem__, parts))
        for c in new:
            if len(c) > LONGEST:
                del memo[c]
        return total


def counter(path: str) -> Counter:
    """The counting function of a tokenizer's file, kept for the life of a Python worker."""
    if path.endswith(".json"):
        encoder = Encoder.of(path)
        return lambda texts: [len(x) // 4 for x in encoder.encode(texts)]
    if path.endswith(".model"):
        return kept(("counts", path), lambda: PieceCounter(path)).counts
    raise ValueError(f"neither a .json nor a .model: {path}")


def by_bytes(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes together, at least one row each; no row lies in two."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, by the library for the file at path: tokenizers for .json, sentencepiece for .model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in by_bytes(sizes):
                n = np.array(count([t or "" for t in b.column("text").slice(i, j - i).to_pylist()]), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(sizes[i:j]), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
