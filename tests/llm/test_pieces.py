import functools
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinage.llm import pieces
from vicinage.llm.pieces import LITERAL, N_BEST, SPACE, Coder, combine, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_paths(lattice, text, keep):
    """Every segmentation, best first, by plain recursion."""
    s = (" " + text).replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""

    @functools.cache
    def rest(i):
        if i == len(s):
            return [(0.0, ())]
        out, single = [], False
        for j in range(i + 1, len(s) + 1):
            if hit := lattice.starts.get(s[i:j]):
                single |= j == i + 1
                out += [(hit[1] + a, hit[0] + b) for a, b in rest(j)]
        if not single:
            char = SPACE if s[i] == LITERAL else s[i]
            out += [(lattice.unknown + a, tuple(lattice.byte_ids[x] for x in char.encode()) + b) for a, b in rest(i + 1)]
        return sorted(out, key=lambda x: -x[0])[:keep]

    return rest(0)


def score_of(coder, ids):
    """The score of a segmentation, from its ids: byte pieces come in runs, one for each character."""
    by_id = {k: score for hit in coder.lattice.starts.values() if hit for (k,), score in [hit]}
    raw = [k for k in ids if k not in by_id]
    chars = b"".join(coder.bytes_of[k] for k in raw).decode()
    return sum(by_id[k] for k in ids if k in by_id) + len(chars) * coder.lattice.unknown


@settings(max_examples=300, deadline=None)
@given(st.booleans(), st.lists(st.sampled_from([*"aeinrst ,.\n éçħ漢▁😀", "the", "ing", "tion", " and"]), max_size=12).map("".join))
def test_n_best_against_all_segmentations(zipf, text):
    coder = Coder.of(PATH, zipf)
    want = all_paths(coder.lattice, text, 8)
    best = coder.encode(text)
    assert np.allclose([s for s, _ in best], [s for s, _ in want[:N_BEST]])
    assert all(coder.decode(ids) == text for _, ids in best) and len({ids for _, ids in best}) == len(best)
    assert np.allclose([s for s, _ in best], [score_of(coder, np.frombuffer(ids, "<u4").tolist()) for _, ids in best])
    found = coder.encode_n_best(text, 5)
    assert np.allclose([s for s, _ in found], [s for s, _ in want[:5]])
    assert len({tuple(x) for _, x in found}) == len(found)
    assert all(coder.decode(np.array(x, "<u4").tobytes()) == text for _, x in found)


@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=3), min_size=1, max_size=4))
def test_combine(lists):
    lists = [[0, *sorted(x)] for x in lists]
    sums = [0]
    for x in lists:
        sums = [a + b for a in sums for b in x]
    assert [c for c, _ in combine(lists, 5)] == sorted(sums)[:5]


def test_corpus_round_trip(corpus, edge, empty):
    for docs in (corpus, edge):
        want = sorted(zlib.crc32((r["text"] or "").encode()) for r in docs.collect())
        got = encode_pieces(docs, PATH, keep_ids=True).collect()
        assert all(r["exact"] and len(r["ids"]) == r["n_pieces"] for r in got)
        for r in got:
            assert r["n_best_pieces"][0] == r["n_pieces"] and r["n_best_crc32"][0] == r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            assert len(r["scores"]) == len(r["n_best_pieces"]) == len(r["n_best_crc32"]) and r["scores"] == sorted(r["scores"], reverse=True)
        assert sorted(r["text_crc32"] for r in got) == want
    assert encode_pieces(empty, PATH).count() == 0


def test_library_decodes_alike(corpus):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r["doc_id"]: r["text"] for r in corpus.limit(50).collect()}
    for r in encode_pieces(corpus, PATH, keep_ids=True).collect():
        if r["doc_id"] in texts:
            assert model.decode(r["ids"]) == texts[r["doc_id"]]


def test_long_chunks_and_other_models(monkeypatch):
    """Text without spaces is solved whole and not remembered; without a safe cut a text is one chunk."""
    coder = Coder(PATH)
    long = "ab漢cd" * 400
    once = coder.encode(f"one {long} two")
    assert coder.decode(once[0][1]) == f"one {long} two" and not any(len(c) > 64 for c in coder.index)
    assert coder.encode(f"one {long} two") == once
    whole = Coder(PATH)
    whole.chunk = pieces._WHOLE
    for text in ("the cat, and the dog.\nThe end", "", " a  b "):
        assert np.allclose([s for s, _ in whole.encode(text)], [s for s, _ in coder.encode(text)]) and whole.decode(whole.encode(text)[0][1]) == text
