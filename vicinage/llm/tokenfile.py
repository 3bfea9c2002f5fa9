"""Token ids in Parquet files that can be read selectively.

A file holds whole documents in ascending doc_id order with four columns: doc_id and at (tokens of
the same part before the document), delta encoded; n_tokens; and ids, a list column whose values
are dictionary encoded. Row groups and pages are of set sizes and carry page indexes, so that
a doc_id range, the lengths alone or single documents are read without the rest.

Null text counts as empty: such a document has the end id alone. Rows that repeat a doc_id follow
each other in the order of their texts' hashes; a null doc_id comes first. A very long text is encoded whole in one task, which
holds its pieces and ids. Of the columns only doc_id and text are read, so names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.llm.common import kept

END_ID = 2
#: Encodings, row groups and pages of the files.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#at": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}
SCHEMA = "doc_id long, part int, at long, n_tokens int, ids array<int>"
#: Encoded pieces of text that a Python worker remembers at most, half of them since the other half was last full, and characters
#: in one of them; longer ones are encoded each time.
MEMO, LONGEST = 900_000, 64
#: White space and the text up to the next; a word's own punctuation stands alone, and so does a lone line end. Byte-level BPE with
#: its usual pattern never joins what stands before a white-space character with it, unless that is white space too,
#: nor letters with what is no letter behind them, nor a line end with other characters; so pieces cut there are encoded alike alone.
_CHUNK = re.compile(r"(?<![ \n\t\r])\n(?=[^ \n\t\r])|[ \n\t\r]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?!\w)|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Other white space can join a run; texts with a piece that holds any are encoded whole.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")

#: With at most one space before them, letters are one unit of the usual pattern: a lone word.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_alphabet() -> dict[int, int]:
    """Byte-level BPE writes printable bytes as themselves, and the others, in order, as the characters from U+0100 on."""
    others = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
    return {b: 256 + k for k, b in enumerate(others)}


class Encoder:
    """The tokenizer with a memory of pieces, kept for the life of a Python worker.

    Pieces are told apart only where the tokenizer's file says that it is byte-level BPE with its usual pattern; with
    others, texts are encoded whole, and so are texts with a piece that holds an added token. special: whether the strings of control tokens
    in a text are ordinary text; by the library's default they are not.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special
        form = json.loads(self.tokenizer.to_str())
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        before = form["pre_tokenizer"] or {}
        self.in_pieces = form["normalizer"] is None and form["model"].get("type", "BPE") == "BPE" and not form["model"].get("dropout") and all(before.get(k) == v for k, v in usual.items())
        added = [t["content"] for t in form["added_tokens"] if not (special and t["special"])]
        self.in_pieces &= all(re.fullmatch(r"[^\w\s]\S*", t) for t in added)  # so that one lies within a piece
        self.in_pieces &= not form["truncation"] and not form["padding"]
        self.model_tokens, self.alphabet = self.tokenizer.model.tokenize, _byte_alphabet()
        self.odd = re.compile("|".join([_OTHER_SPACE.pattern, *map(re.escape, added)]))
        #: ids of each piece, None for one that does not stand for itself
        self.memo: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    @classmethod
    def of(cls, path: str, special: bool = False) -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        return kept(("tokens", path, special), lambda: cls(path, special))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes | None]]:
        """Each piece with its ids, or None if it does not stand for itself. A lone word is not cut further, so the library's model takes it without the steps before; other pieces go through all steps."""
        others, tokens, alphabet = [], self.model_tokens, self.alphabet
        for c in pieces:
            word = c.removeprefix(" ")
            if word.isascii() and word.isalpha():
                form = c.replace(" ", "Ġ")  # as the alphabet has it
            elif _LETTERS.fullmatch(word):
                form = c.encode().decode("latin-1").translate(alphabet)
            else:
                others.append(c)
                continue
            yield c, array("I", [t.id for t in tokens(form)]).tobytes()
        for c, ids in zip(others, self._encode(others), strict=True):
            yield c, None if self.odd.search(c) else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if not self.in_pieces:
            return self._encode(texts)
        if 2 * len(self.memo) > MEMO:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        chunks = [_CHUNK.findall(t) for t in texts]
        missing = set().union(*chunks).difference(memo)
        memo.update([(c, old[c]) for c in missing if c in old])
        new = [c for c in missing if c not in old]
        memo.update(self._encode_pieces(new))
        out = []
        for t, c in zip(texts, chunks, strict=True):
            try:
                out.append(b"".join(map(memo.__getitem__, c)))
            except TypeError:
                out += self._encode([t])
        for c in new:
            if len(c) > LONGEST:
                del memo[c]
        return out


def _id_lists(ids: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _encode_part(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at, end = Encoder.of(path), TaskContext.get().partitionId(), 0, np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                ids = [x + end for x in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int32)
                starts = at + np.cumsum(n, dtype=np.int64) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(starts), pa.array(n), _id_lists(ids)],
                    names=["doc_id", "part", "at", "n_tokens", "ids"],
                )

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every document and write the files: part k's documents all lie before part k+1's, by doc_id and then by the text's hash, so that a null or repeated id is not one part's."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_encode_part(tokenizer, end_id), SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, part, at, n_tokens, ids); a condition on doc_id prunes files, row groups and pages."""
    found = spark.read.schema(SCHEMA).parquet(path)
    return found if where is None else found.where(where)


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, first): ids of all parts before. Reads the lengths alone; one row a part is summed up."""
    parts = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("at"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, from the files: (doc_id, start, n_tokens, ids_crc32)."""
    rows = read_tokens(spark, path).select("doc_id", "part", "at", "ids").mapInArrow(_crc, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(read_starts(spark, path), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
