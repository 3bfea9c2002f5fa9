import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.llm import hamming


def brute(rows, queries, k):
    ids, codes = np.array([i for i, _ in rows]), np.array([c for _, c in rows], dtype=np.int64).view(np.uint64)
    out = []
    for q, c in queries:
        d = np.bitwise_count(codes ^ np.array([c], dtype=np.int64).view(np.uint64))
        best = np.lexsort((ids, d))[:k]
        out += [(q, r + 1, int(ids[j]), int(d[j])) for r, j in enumerate(best)]
    return sorted(out)


def check(spark, rows, queries, k=10):
    df = lambda x: spark.createDataFrame(x, "id long, code long")
    got = hamming.top_k(df(rows), df(queries), k).select("query_id", "rank", "id", "distance").collect()
    assert sorted(map(tuple, got)) == brute(rows, queries, k)


@pytest.mark.parametrize("m", [2, 4, 8])
def test_random_and_near_codes(spark, monkeypatch, m):
    monkeypatch.setattr(hamming, "SEGMENTS", ((None, m),))
    monkeypatch.setattr(hamming, "PARTS", 5)
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    codes = [int(b) for b in rng.integers(-(2**63), 2**63 - 1, 500)]
    codes += [int(base[i % 40] ^ (1 << int(rng.integers(0, 63)))) for i in range(400)]
    rows = list(enumerate(codes))
    check(spark, rows, [r for r in rows if r[0] % 50 == 0])


def test_near_codes_are_found_by_probes_alone(spark, monkeypatch):
    """Families of 20 codes near each other: every query ends at small radii."""
    most = []
    real = hamming._probe
    monkeypatch.setattr(hamming, "_probe", lambda *a: most.append(a[5]) or real(*a))
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 300)
    rows = list(enumerate(int(base[i % 300] ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63)))) for i in range(6000)))
    check(spark, rows, [r for r in rows if r[0] % 50 == 0])
    assert max(most) <= 2


@pytest.mark.parametrize("m", [2, 4, 8])
def test_steps_cover_what_they_say(m):
    """A code that is in no step's reach yet differs in more bits than are covered: the least such number of bits, segment by segment."""
    reach = [-1] * m
    for radius, segs, covered in hamming.steps(m):
        for s in segs:
            assert reach[s] == radius - 1
            reach[s] = radius
        assert covered == sum(r + 1 for r in reach) - 1
    assert reach == [hamming.BITS // m] * m


@pytest.mark.parametrize("lot", [0, 1024])
def test_far_neighbours(spark, monkeypatch, lot):
    """Few codes, all far from the queries: the search goes on to large radii, by flips or by the values that there are."""
    monkeypatch.setattr(hamming, "LOT", lot)
    monkeypatch.setattr(hamming, "SEGMENTS", ((None, 4),))
    rng = np.random.default_rng(5)
    codes = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)]
    queries = [(1000, ~codes[0]), (1001, codes[1] ^ 0x0F0F0F0F0F0F0F0F)]
    check(spark, list(enumerate(codes)), queries, k=3)


@pytest.mark.parametrize(("width", "radius"), [(8, 0), (8, 1), (8, 8), (16, 3)])
def test_flips(spark, width, radius):
    got = [r["flip"] for r in hamming.with_flips(spark.range(1), width, radius).collect()]
    assert sorted(got) == [x for x in range(1 << width) if x.bit_count() == radius]


def test_hot_code_and_few_rows(spark):
    rows = [(i, 7 if i % 3 else i) for i in range(300)]
    check(spark, rows, [r for r in rows if r[0] % 50 == 0])
    check(spark, rows[:4], rows[:2])


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, [0.5, -0.5, 0.0, None] * 16), (2, None), (3, [1.0] * 64), (4, [-1.0] * 64), (5, [1.0]), (6, [])], "id long, embedding array<float>")
    rows = df.select("id", hamming.sign_code(F.col("embedding")).alias("code"))
    codes = {r["id"]: r["code"] for r in rows.collect()}
    assert codes[2] is None and codes[3] == -1 and codes[4] == 0 and codes[5] == 1 and codes[6] == 0
    assert codes[1] == sum(1 << (4 * k) for k in range(15)) + (1 << 60)
    got = hamming.top_k(rows, rows, 3).collect()
    assert {r["query_id"] for r in got} == {1, 3, 4, 5, 6} and len(got) == 15
    with pytest.raises(Exception, match="more than 64"):
        spark.createDataFrame([(1, [1.0] * 65)], "id long, e array<float>").select(hamming.sign_code(F.col("e"))).collect()
    none = spark.createDataFrame([], "id long, code long")
    assert hamming.top_k(none, none).count() == 0 and hamming.top_k(none, rows).count() == 0
