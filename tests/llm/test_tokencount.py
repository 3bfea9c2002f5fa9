import random

import numpy as np
import public_tokenizers
import pytest

from vicinage.llm import tokencount

PIECES, BYTES = (public_tokenizers.path(f) for f in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
BITS = ("a", "the", "The", " ", "  ", "\n", "\n\n", " \n", "\n ", "▁", "é", "漢字", "</s>", "<0x0A>", "\t", ".", "ing", "12", "\x00", " ", "😀", "   ", "<|endoftext|>")


def plain(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("section", [7, 40, 1 << 20])
@pytest.mark.parametrize("memo", [50, 800_000])
def test_odd_texts_in_sections_of_any_size(monkeypatch, section, memo):
    monkeypatch.setattr(tokencount, "SECTION", section)
    monkeypatch.setattr(tokencount, "MEMO", memo)
    draw = random.Random(section)
    texts = ["".join(draw.choices(BITS, k=draw.randrange(50))) for _ in range(4000)]
    counter = tokencount.PieceCounter(PIECES)
    assert counter.in_parts and counter.lines
    assert counter.counts(texts) == plain(PIECES, texts)


def test_ranges_of_even_size_cover_all_rows():
    draw = np.random.default_rng(3)
    for _ in range(300):
        sizes = draw.integers(0, 40, draw.integers(0, 60))
        found = list(tokencount.by_bytes(sizes, 64))
        assert [k for i, j in found for k in range(i, j)] == list(range(len(sizes)))
        assert all(sizes[i:j].sum() <= 64 or j == i + 1 for i, j in found)


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_documents_as_the_library_counts_them(corpus, path):
    texts = {r["doc_id"]: r["text"] or "" for r in corpus.collect()}
    want = dict(zip(texts, plain(path, list(texts.values())), strict=True))
    rows = tokencount.count_tokens(corpus, path, limit=300).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and len(rows) == len(texts)
    assert all(r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 300) for r in rows)


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_odd_rows(edge, empty, path):
    given = edge.collect()
    rows = tokencount.count_tokens(edge, path).collect()
    assert sorted(((r["doc_id"] or -1), r["n_tokens"]) for r in rows) == sorted(zip((r["doc_id"] or -1 for r in given), plain(path, [r["text"] or "" for r in given]), strict=True))
    assert tokencount.count_tokens(empty, path).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tokencount.counter("vocabulary.txt")
