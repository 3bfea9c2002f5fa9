import random
import re

from hypothesis import given
from hypothesis import strategies as st

from vicinage.llm import spans


def brute(pairs, span=spans.SPAN, least=1):
    first, gone = {}, {}
    for i, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0])):
        parts = spans.sentences(text or "")
        full = [k for k, s in enumerate(parts) if s.strip()]
        before = ["".join(parts[:k]) for k in full]
        # a sentence starts the text, or stands behind an end mark and a blank, or a line end
        whole = [not t or bool(re.search(r"[.!?\n]\s+\Z|\n\Z", t)) for t in before]
        words = [len(re.findall(r"\S+", parts[k])) for k in full]
        gone[i] = set()
        for a in range(len(full)):
            stops = [e for e in range(a + span, len(full) + 1) if sum(words[a:e]) >= spans.MIN_WORDS][:1]
            if whole[a]:
                opens = [e for e in range(a + 1, len(full)) if whole[e]] + [len(full)]
                stops += [e for e in opens[span - 1 : span] if sum(words[a:e]) >= least]
            if not stops:
                continue
            key = tuple(parts[k].strip() for k in full[a : min(stops)])
            if first.setdefault(key, (i, a)) != (i, a):
                gone[i] |= set(full[a : min(stops)])
    out = {}
    for i, text in pairs:
        kept = "".join(s for k, s in enumerate(spans.sentences(text or "")) if k not in gone[i])
        out[i] = (text if not gone[i] else kept if kept.strip() else "", len(gone[i]))
    return out


def every_run(pairs, span=3):
    """All runs of `span` sentences by a cutter of its own, for sentences too short to be cut further: the texts that stay."""
    first, out = {}, {}
    for i, text in pairs:
        parts = re.findall(r"[^.!?]+[.!?]+\s*", text)
        gone = set()
        for a in range(len(parts) - span + 1):
            key = tuple(p.strip() for p in parts[a : a + span])
            if first.setdefault(key, (i, a)) != (i, a):
                gone |= set(range(a, a + span))
        out[i] = "".join(p for k, p in enumerate(parts) if k not in gone)
    return out


def check(df, pairs):
    want = brute(pairs)
    rows = spans.dedup_spans(df).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in rows} == want and len(rows) == len(pairs)


def test_passages(frame):
    rng = random.Random(4)
    sentence = lambda: " ".join(f"w{rng.randrange(10**4)}" for _ in range(rng.randrange(4, 40))).capitalize() + rng.choice([". ", "! ", ".\n", ", "])
    shared = ["".join(sentence() for _ in range(7)) for _ in range(5)]
    pairs = [(k, "".join(rng.choice(shared) if rng.random() < 0.2 else sentence() for _ in range(12))) for k in range(80)]
    check(frame(*((i, t, "s") for i, t in pairs)), pairs)


def test_a_shared_passage_stays_once(frame):
    passage = "It was the first of many days by the sea. Nobody spoke of what had been lost there. The boats came in late, as they always did. Then all was quiet again. "
    texts = [f"Doc {k} starts in its own way here. {passage}And ends with word{k} after that." for k in range(9)]
    rows = {r["doc_id"]: r for r in spans.dedup_spans(frame(*((k, t, "s") for k, t in enumerate(texts)))).collect()}
    assert rows[0]["text"] == texts[0]
    assert all("Nobody spoke" not in rows[k]["text"] and f"word{k}" in rows[k]["text"] and f"Doc {k}" in rows[k]["text"] for k in range(1, 9))


def test_repeats_inside_a_text(frame):
    line = "The same line of five. "
    pairs = [(1, line * 6), (2, "Short. No. Yes. Short. No. Yes."), (3, line * 2)]
    check(frame(*((i, t, "s") for i, t in pairs)), pairs)


def test_runs_of_short_sentences_are_spans(frame):
    """Three sentences of fifteen words in six texts, and six texts that are these sentences."""
    passage = "The tide went out early. Nobody saw the boats leave. All was quiet again."
    pairs = [(k, f"Own start of text {k} here. {passage} Own end number {k} follows.") for k in range(6)] + [(k, passage) for k in range(6, 12)]
    rows = {r["doc_id"]: r for r in spans.dedup_spans(frame(*((i, t, "s") for i, t in pairs))).collect()}
    assert rows[0]["text"] == pairs[0][1]
    assert all(rows[k]["text"] == f"Own start of text {k} here. Own end number {k} follows." for k in range(1, 6))
    assert all(rows[k]["text"] == "" and rows[k]["n_removed"] == 3 for k in range(6, 12))
    longer = {r["doc_id"]: r["n_removed"] for r in spans.dedup_spans(frame(*((i, t, "s") for i, t in pairs)), least=16).collect()}
    assert not any(longer[k] for k in range(6))


def test_every_run_by_another_cutter(frame):
    rng = random.Random(11)
    lines = [f"{' '.join(rng.choice('abcdefgh') * rng.randint(1, 3) for _ in range(rng.randint(1, 9)))}{rng.choice('.!?')} " for _ in range(25)]
    pairs = [(k, "".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for k in range(300)]
    want = every_run(pairs)
    rows = {r["doc_id"]: r["text"] for r in spans.dedup_spans(frame(*((i, t, "s") for i, t in pairs))).collect()}
    assert rows == {i: t if t.strip() else "" for i, t in want.items()}
    assert sum(rows[i] != t for i, t in pairs) > 20


def test_dots_inside_words_are_no_sentences(frame):
    """Parts of a number, a name or an address are pieces, but no span of whole sentences."""
    pairs = [(k, f"See www.example.com and 1.2.3 for item {k}") for k in range(5)]
    assert all(r["n_removed"] == 0 for r in spans.dedup_spans(frame(*((i, t, "s") for i, t in pairs))).collect())


def test_corpus(corpus):
    check(corpus, [(r["doc_id"], r["text"]) for r in corpus.collect()])


def test_edge_cases(edge, empty):
    rows = spans.dedup_spans(edge)
    assert rows.columns == [*edge.columns, "n_sentences", "n_removed"]
    got = rows.collect()
    assert len(got) == edge.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[7]["n_removed"] == 0
    assert spans.dedup_spans(empty).count() == 0


@given(st.text(alphabet="ab.,!?\n \t;é", max_size=200))
def test_sentences_join_to_the_text(text):
    assert "".join(spans.sentences(text)) == text


def test_unpunctuated_passages_in_varied_contexts(frame):
    """Passages of 51 to 80 words without a mark: each later copy loses most of its words, and no other words go."""
    rng, pairs, lengths = random.Random(5), [], []
    words = lambda n, own: [f"{own}{rng.randrange(10**6)}" for _ in range(n)]
    for n in range(51, 81):
        passage = words(n, "p")
        for _ in range(5):
            pairs.append((len(pairs), " ".join([*words(rng.randrange(40), "a"), *passage, *words(rng.randrange(40), "b")])))
            lengths.append(n)
    shares = []
    for r in spans.dedup_spans(frame(*((i, t, "s") for i, t in pairs))).collect():
        before, after = pairs[r["doc_id"]][1].split(), r["text"].split()
        if r["doc_id"] % 5 == 0:
            assert after == before
            continue
        assert [w for w in after if w[0] != "p"] == [w for w in before if w[0] != "p"]
        shares.append(1 - sum(w[0] == "p" for w in after) / lengths[r["doc_id"]])
    assert min(shares) > 0.4 and sum(shares) / len(shares) > 0.8


def test_rows_are_known_by_id_and_text(frame):
    """Null ids, and one id with several texts: each row loses its own repeats, and rows of one id are compared too."""
    passage = "It was the first of many days by the sea. Nobody spoke of what had been lost there. The boats came in late, as they did. "
    own = [f"Text {k} starts in its own way. {f"More of {k}. " * (k % 2)}" for k in range(6)]
    tail = [f"Then text {k} goes on about thing{k} for a while. And it ends at last with word{k}." for k in range(6)]
    ids = [None, None, 7, 7, 8, 7]
    texts = [own[k] + passage + tail[k] for k in range(6)]
    rows = spans.dedup_spans(frame(*((i, t, "s") for i, t in zip(ids, texts, strict=True)))).collect()
    left = sorted(r["text"] for r in rows)
    kept = [t for t in left if passage in t]
    assert len(rows) == 6 and len(kept) == 1 and kept[0] in texts[:2]
    assert left == sorted([kept[0], *(own[k] + tail[k] for k in range(6) if texts[k] != kept[0])])


def test_one_id_with_a_short_and_a_long_text(frame):
    passage = "".join(f"The same line of number {k} stands here. " for k in range(30))
    pairs = [(1, passage), (2, passage + "A tail of its own."), (2, "One line here. Two lines here.")]
    rows = spans.dedup_spans(frame(*((i, t, "s") for i, t in pairs))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [(1, passage), (2, "A tail of its own."), (2, pairs[2][1])]


def test_columns_of_any_name(spark):
    names = ["_doc", "_text", "_starts", "rest", "starts", "high", "n_removed", "a.b"]
    passage = "It was the first of many days by the sea. Nobody spoke of what had been lost there. The boats came in late, as they did. "
    rows = [(k, *(f"{n}{k}" for n in names), passage + f"End of {k}.") for k in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", *names, "text"])
    got = spans.dedup_spans(df)
    assert got.columns == ["doc_id", *(n for n in names if n != "n_removed"), "text", "n_sentences", "n_removed"]
    for r in got.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names if n != "n_removed")
        assert r["text"] == (passage if r["doc_id"] == 0 else "") + f"End of {r['doc_id']}."
