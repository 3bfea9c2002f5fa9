import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vicinage.llm.mixing import mix, mixed_rows


def targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        over = {s for s in rest if w[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def test_against_brute_force(corpus):
    got = {r["doc_id"]: r for r in mix(corpus).collect()}
    sizes, taken, source = Counter(), Counter(), {}
    for r in corpus.collect():
        n = len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))
        assert got[r["doc_id"]]["size"] == n
        sizes[r["source"]] += n
        source[r["doc_id"]] = r["source"]
    want = targets(sizes)
    for i, r in got.items():
        assert r["source_size"] == sizes[source[i]] and abs(r["target"] - want[source[i]]) < 1e-6
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
        taken[source[i]] += r["taken"]
    largest = max(r["size"] for r in got.values())
    assert all(abs(taken[s] - want[s]) <= largest + 1 for s in want)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_reruns_agree(corpus):
    assert sorted(mix(corpus).collect()) == sorted(mix(corpus.repartition(7)).collect())


def test_hot_source(frame):
    docs = frame(*((i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 30}") for i in range(900)))
    by = defaultdict(lambda: [0, 0.0])
    for r in mix(docs, extra=["source"]).collect():
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(a - b) <= 10 for a, b in by.values())


def test_edge_cases(edge, empty):
    got = {(r["doc_id"], r["size"]): r for r in mix(edge).collect()}
    assert len(mix(edge).collect()) == edge.count()
    assert got[(1, 0)]["taken"] == 0 and got[(3, 0)]["source_size"] == 1  # the null source has one word, of document 8
    assert mix(empty).count() == 0 and mixed_rows(empty).count() == 0


def test_mixed_rows_repeat_as_taken(frame, edge):
    docs = frame((0, "", "x"), (9, None, None), (1, "a b c", "x"), (2, "d e", "x"), (2, "d e", "x"), (3, "f", "y"), (None, "g h", "z"))
    plan = mix(docs).collect()
    rows = mixed_rows(docs)
    assert rows.columns == docs.columns
    assert sum(len(r["text"].split()) for r in rows.collect()) == sum(r["taken"] for r in plan)
    assert mixed_rows(edge).count() > 0


def test_order_of_finish_times(frame):
    """Every copy by its finish time, in one sorted list, until the next one would pass the budget."""
    sizes = {i: 1 + i * 7919 % 23 for i in range(400)}
    source = lambda i: None if i % 11 == 0 else f"s{i % 5}"
    docs = frame(*((i, "w " * n, source(i)) for i, n in sizes.items()))
    got = {r["doc_id"]: r for r in mix(docs).collect()}
    target = {source(i): got[i]["target"] for i in sizes}
    total = Counter()
    for i, n in sizes.items():
        total[source(i)] += n
    hashes = docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(17)).alias("h"), F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(64)).alias("b")).collect()
    ends, copies = Counter(), []
    names = sorted(s for s in total if s is not None) + [None]
    for r in sorted(hashes, key=lambda r: (r["b"], r["h"], r["doc_id"])):
        s = source(r["doc_id"])
        ends[s] += sizes[r["doc_id"]]
        copies += [((ends[s] + k * total[s]) / target[s], names.index(s), ends[s] + k * total[s], r["doc_id"]) for k in range(2)]
    want, spent = Counter(), 0
    for _, _, _, i in sorted(copies):
        spent += sizes[i]
        if spent > 1.5 * sum(sizes.values()):
            break
        want[i] += sizes[i]
    assert {i: r["taken"] for i, r in got.items()} == {i: want[i] for i in sizes}


def test_rows_come_in_the_order_of_finish_times(frame):
    """Two sources of equal weight share and words of equal size alternate; a source that is gone through twice repeats its order."""
    docs = frame(*((i, "w w", "a" if i < 40 else "b" if i < 140 else "c") for i in range(300)))
    order = [r["doc_id"] for r in mixed_rows(docs).collect()]
    plan = {r["doc_id"]: r for r in mix(docs).collect()}
    assert Counter(order) == Counter({i: r["taken"] // 2 for i, r in plan.items() if r["taken"]})
    first = [i for i in order if i < 40]
    assert first[:40] == first[40:80] and len(set(first[:40])) == 40
    # the share of each source is near its weight all along
    half = Counter("abc"[(i >= 40) + (i >= 140)] for i in order[: len(order) // 2])
    whole = Counter("abc"[(i >= 40) + (i >= 140)] for i in order)
    assert all(abs(2 * half[s] - whole[s]) <= 4 for s in "abc")
