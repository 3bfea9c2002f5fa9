import random
import re
import zlib
from hashlib import sha256

import pytest

from vicinage.llm import runs


def every_run(w):
    """By comparing every word with the one a period before."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            at = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - at + q
            whole = w[at : at + length]
            if length >= max(6, 4 * q) and not any(whole[r:] == whole[:-r] for r in range(1, q)):
                out.append((at, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, planted):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = every_run(w)
    gone = {i for at, length, q in found for i in range(at + q, at + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    text = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    left = " ".join(v for i, v in enumerate(w) if i not in gone)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha256(text.encode()).hexdigest(), sha256(left.encode()).hexdigest())


def test_random_words_against_all_periods():
    draw = random.Random(5)
    for _ in range(3000):
        n, letters = draw.randrange(70), "abcd"[: draw.randint(1, 4)]
        w = draw.choices(letters, k=n)
        if n and draw.random() < 0.7:
            a, p = draw.randrange(n), draw.randint(1, 8)
            w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
        if n and draw.random() < 0.3:
            w[draw.randrange(n)] = "z"
        assert [tuple(r) for r in runs.find_runs(w).tolist()] == every_run(w), w


def test_extensions_against_comparison():
    draw = random.Random(6)
    import numpy as np

    for _ in range(300):
        n = draw.randint(1, 40)
        s = [draw.randint(1, 3) for _ in range(n)]
        common = runs.Extensions(s, 4)
        i, j = (np.array(x) for x in zip(*[(i, j) for i in range(n + 1) for j in range(n + 1) if i != j], strict=True))
        want = [next((k for k in range(n) if s[a + k : a + k + 1] != s[b + k : b + k + 1] or not s[a + k : a + k + 1]), n) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert common(i, j).tolist() == want


def test_runs_inside_runs_and_nested_periods():
    inner = ["a", "b"] * 4
    w = (inner + ["c"]) * 5
    assert [tuple(r) for r in runs.find_runs(w).tolist()] == every_run(w)
    assert len(every_run(w)) == 6


@pytest.mark.parametrize("planted", [False, True])
def test_documents_against_brute_force(corpus, planted):
    short = [r for r in corpus.collect() if len(r["text"] or "") < 9000]
    frame = corpus.where("text IS NULL OR length(text) < 9000")
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.periodic_runs(frame, planted).collect()}
    assert got == {r["doc_id"]: brute(r["doc_id"], r["text"], planted) for r in short}
    if planted:
        assert any(r[0] for r in got.values())


def test_odd_rows(edge, empty):
    rows = runs.periodic_runs(edge, planted=True).collect()
    assert len(rows) == edge.count()
    small = {r["doc_id"]: r["text"] for r in edge.collect() if r["doc_id"] not in (9, 6)}
    assert {r["doc_id"]: tuple(r)[1:] for r in rows if r["doc_id"] in small} == {i: brute(i, t, True) for i, t in small.items()}
    assert runs.periodic_runs(empty).collect() == []


def test_a_very_long_repeat():
    w = [str(k * k % 997) for k in range(900)] * 60
    (found,) = [r for r in runs.find_runs(w).tolist() if r[2] >= 800]
    assert found[0] == 0 and found[1] == len(w)
