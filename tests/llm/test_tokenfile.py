import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinage.llm import tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)  # as the library gives it
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check(spark, library, docs, path):
    tokenfile.write_tokens(docs, path, PATH)
    got = sorted(tokenfile.token_digests(spark, path).collect(), key=lambda r: r["start"])
    want = [[*library(r["text"] or ""), 2] for r in docs.collect()]
    crcs = sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in want)
    assert sorted(r["ids_crc32"] for r in got) == crcs
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])])[: len(got)].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    return {r["doc_id"]: r for r in got}


def test_corpus(spark, library, corpus, tmp_path):
    got = check(spark, library, corpus, f"file://{tmp_path}/t")
    for r in corpus.collect():
        ids = [*library(r["text"]), 2]
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_selective_reads(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/t"
    tokenfile.write_tokens(corpus, path, PATH)
    few = tokenfile.read_tokens(spark, path, F.col("doc_id").between(10, 19))
    assert few.count() == 10
    plan = few.select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_edge_cases(spark, library, edge, empty, tmp_path):
    check(spark, library, edge, f"file://{tmp_path}/a")
    assert len(check(spark, library, empty, f"file://{tmp_path}/b")) == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\r,.!?'\"()abZéß漢²3-_\x0b\x1c\x85\xa0\u2003\u3000ªµ", "'s", "don't", "<|endoftext|>"]), max_size=30).map("".join))
def test_pieces_are_encoded_as_the_whole(library, text):
    assert np.frombuffer(tokenfile.Encoder.of(PATH).encode([text])[0], "<u4").tolist() == library(text)


def test_control_strings_as_the_library_has_them(library):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    for text in ("x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c"):
        ids = lambda special: np.frombuffer(tokenfile.Encoder.of(PATH, special).encode([text])[0], "<u4").tolist()
        assert ids(False) == library(text) and 50256 in library(text)
        assert ids(True) == plain.encode(text, add_special_tokens=False).ids and 50256 not in ids(True)


def test_other_tokenizers_are_not_cut(frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    coder, library = tokenfile.Encoder(path), Tokenizer.from_file(path)
    texts = ["Words,  and More\nWords", "", "don't  stop"]
    assert not coder.in_pieces
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_pieces_are_not_remembered(library):
    coder = tokenfile.Encoder(PATH)
    text = "one " + "x7" * 500 + " two"
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library(text)
    assert max(map(len, coder.memo)) <= tokenfile.LONGEST


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x17F, categories=["L"]), min_size=1, max_size=12), st.sampled_from(["", " ", "  ", "\n"]))
def test_lone_words_by_the_model(library, word, before):
    coder = tokenfile.Encoder.of(PATH)
    ((piece, ids),) = coder._encode_pieces([before + word])
    assert piece == before + word and np.frombuffer(ids, "<u4").tolist() == library(piece)
