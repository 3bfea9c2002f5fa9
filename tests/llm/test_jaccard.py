import random
import re
from collections import defaultdict

import numpy as np
import pytest

from vicinage.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(pairs):
    """(size, least reachable id) by comparing all pairs."""
    sets = [(i, frozenset(shingles(t))) for i, t in pairs]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i, len(s), least[top(k)]) for k, (i, s) in enumerate(sets))


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect())


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def families(seed):
    """Near copies at and around the threshold, chains of them, a common passage, short and blank texts."""
    rng, texts = random.Random(seed), []
    passage = [f"p{k}" for k in range(60)]
    for f in range(6):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(rng.choice([8, 40, 120]))]
        texts += [near(rng, base, rng.randrange(0, 1 + len(base) // 20)) for _ in range(rng.choice([2, 5, 30]))]
        chain = base
        for _ in range(6):
            chain = near(rng, chain, max(1, len(base) // 30)).split()
            texts.append(" ".join(chain))
    texts += [" ".join([f"u{k}x{j}" for j in range(rng.randrange(5, 60))] + passage) for k in range(40)]
    texts += ["a", "A", "a b", "a b c d", "A B c d", "", " \n", "x y z w v", "x y z w v u"]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(frame, seed):
    pairs = families(seed)
    assert got(frame(*((i, t, "s") for i, t in pairs))) == brute(pairs)


def test_groups_are_bounded_and_opened(frame, monkeypatch):
    """Without leader rounds the token-group matrix alone finds every link."""
    pairs = families(3)
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", 0)
    assert got(frame(*((i, t, "s") for i, t in pairs))) == brute(pairs)


def test_short_bit_maps_rule_out_no_link(frame, monkeypatch):
    """Two words of bits a set: maps say little, and links are as before."""
    pairs = families(4)
    for name, value in (("MAP", 2), ("PARITY", ["p0", "p1"]), ("UNION", ["u0", "u1"]), ("LEADER_ROUNDS", 0)):
        monkeypatch.setattr(jaccard, name, value)
    assert got(frame(*((i, t, "s") for i, t in pairs))) == brute(pairs)


def test_passages_of_most_of_a_text(frame):
    """Boilerplate of 60 to 95 percent in hundreds of texts, around the threshold."""
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(100)]
    pairs = [(k, " ".join([f"u{k}x{j}" for j in range(rng.randrange(5, 60))] + passage[: rng.choice([60, 100])])) for k in range(300)]
    assert got(frame(*((i, t, "s") for i, t in pairs))) == brute(pairs)


def test_corpus(corpus):
    pairs = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert got(corpus) == brute(pairs)


def test_edge_cases(edge, empty):
    rows = jaccard.jaccard_components(edge).collect()
    assert len(rows) == edge.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[6] == {(9, 5)} and by[8] == {(1, 7)}
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "None", "5", "7", "9", "10"])


def test_shingles_do_not_collide():
    words = ["to", "of", "a", "essh.", "x"]
    texts = [" ".join(words[(k // 5**j) % 5] for j in range(5)) for k in range(5**5)]
    assert len({int(s[0]) for s in jaccard.shingle_sets(texts)}) == 5**5


def linked_sets(seed):
    rng = np.random.default_rng(seed)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 10**6, n))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 10**6, int(rng.integers(0, 4)))]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            yield x, y


def test_prefix_of_linked_sets_meets():
    for x, y in linked_sets(5):
        shared = len(np.intersect1d(jaccard.prefix(x), jaccard.prefix(y)))
        assert shared >= -(-min(len(x), len(y)) // jaccard.EXTRA)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_first_screen_counts_shared_tokens(size):
    """Rows of several tasks, summed up in each and then by token, in batches of any size."""
    rng = np.random.default_rng(size)
    nodes = {i: np.unique(rng.integers(-30, 30, int(rng.integers(1, 12)))) for i in rng.integers(-(2**62), 2**62, 12).tolist()}
    tasks = [list(nodes)[k::3] + [next(iter(nodes))] * (k > 0) for k in range(3)]
    rows = [np.concatenate(c) for c in zip(*(jaccard.combined(np.concatenate([nodes[i] for i in t]), np.repeat(t, [len(nodes[i]) for i in t]), np.repeat([len(nodes[i]) for i in t], [len(nodes[i]) for i in t])) for t in tasks), strict=True)]
    order = np.argsort(rows[0], kind="stable")
    batches = [jaccard._row_batch([c[order][k : k + size] for c in rows]) for k in range(0, len(order), size)]
    got = {}
    for b in jaccard.credits(iter(batches)):
        for node, n, k in zip(*(b.column(c).to_pylist() for c in ("node", "n", "k")), strict=True):
            assert n == len(nodes[node]) and k > 0
            got[node] = got.get(node, 0) + k
    first = next(iter(nodes))
    want = {i: sum(any(h in y for j, y in nodes.items() if j != i) for h in x.tolist()) for i, x in nodes.items()}
    assert {i: k for i, k in got.items() if i != first} == {i: k for i, k in want.items() if i != first and k}
    assert got.get(first, 0) == 3 * want[first] or want[first] <= got.get(first, 0)  # a copy in each of three tasks counts each time


def test_bit_maps_bound_what_differs():
    ones = lambda words: int(np.bitwise_count(words.view(np.uint64)).sum())
    for x, y in linked_sets(6):
        a, b = jaccard.bit_maps([x, y])
        p, u = slice(0, jaccard.MAP), slice(jaccard.MAP, 2 * jaccard.MAP)
        assert ones(a[p] ^ b[p]) <= len(np.setxor1d(x, y)) and ones(a[u] & ~b[u]) <= len(np.setdiff1d(x, y))


def test_keep_one_knows_rows_by_id_and_text(frame):
    """Null ids, and one id with several texts: of each component one row stays, and rows without words all do."""
    a, b, c, d = ("".join(f"{k}{j} " for j in range(30)) for k in "abcd")
    pairs = [(None, a), (None, b), (None, c), (None, None), (None, ""), (1, d), (4, c), (4, d), (5, a + "end"), (5, a + "end"), (5, "its own text of a few words"), (6, None), (6, " ")]
    rows = jaccard.keep_one(frame(*((i, t, "s") for i, t in pairs))).collect()
    want = [(None, b), (None, None), (None, ""), (1, d), (4, c), (5, a + "end"), (5, "its own text of a few words"), (6, None), (6, " ")]
    assert sorted((r["doc_id"], r["text"]) for r in rows if r["text"] and r["doc_id"]) == sorted(x for x in want if x[0] and x[1])
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(str, want))
