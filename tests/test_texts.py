import bisect
import random

import pytest
from pyspark.sql import functions as F

from vicinage import params as P
from vicinage.functions import phrases
from vicinage.operators import corpus, enrich, histograms, render

DENSE = "id long, bucket string, n_doorstep int, n_radius int, nearest_m int, min_dist double"


def lists(df):
    return enrich.cat_lists(df)


def dense(spark, *rows):
    return spark.createDataFrame([(i, b, 0, n, m, float(m)) for i, b, n, m in rows], DENSE)


def test_percentile_is_a_bisect(spark):
    rng = random.Random(1)
    counts = {i: rng.randrange(0, 6) for i in range(60)}
    df = dense(spark, *((i, "bar", n, 10) for i, n in counts.items() if n), *((i, "x", 1, 10) for i in counts))
    got = {r["id"]: r["pct"] for r in corpus.scored(lists(df), corpus.histogram(df, 60)).where("bucket = 'bar'").collect()}
    ordered = sorted(counts.values())
    assert got == {i: bisect.bisect_left(ordered, n) / 60 for i, n in counts.items()}


def test_a_long_reference_is_joined(spark, monkeypatch):
    rng = random.Random(3)
    df = dense(spark, *((i, b, rng.randrange(1, 9), 10) for i in range(50) for b in ("bar", "cafe", "gym") if rng.random() < 0.7))
    hist, rows = corpus.histogram(df), lambda: sorted(map(tuple, corpus.scored(lists(df), corpus.histogram(df)).collect()))
    sent = rows()
    assert len(sent) == 3 * df.select("id").distinct().count()
    monkeypatch.setattr(corpus, "REFERENCE", 3)
    assert rows() == sent
    plan = corpus.scored(lists(df), hist)._jdf.queryExecution().executedPlan().toString()
    assert "n_radius" in plan


def test_scores_need_no_shuffle(spark, tmp_path):
    """Once records and the histogram are there, a relative text is made inside the row."""
    df = dense(spark, *((i, b, 1 + i % 5, 10) for i in range(30) for b in ("bar", "cafe")))
    for name, frame in (("hist", corpus.histogram(df)), ("rec", lists(df).withColumn("landmarks", F.array().cast("array<struct<name:string,dist_m:int>>")))):
        frame.write.parquet(f"{tmp_path}/{name}")
    rec, hist = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("rec", "hist"))
    plan = render.prompts(rec, "combined", hist)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "Window" not in plan and "SortMergeJoin" not in plan
    probe = plan[: plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in probe
    with pytest.raises(ValueError):
        render.prompts(rec, "combined")


def test_unseen_counts_have_the_share_below_them(spark):
    df = dense(spark, (1, "bar", 2, 1), (2, "bar", 5, 1), (3, "bar", 5, 1), (4, "gym", 1, 1))
    odd = dense(spark, *((n, "bar", n, 1) for n in range(1, 8)))
    got = {r["id"]: r["pct"] for r in corpus.scored(lists(odd), corpus.histogram(df)).where("bucket = 'bar'").collect()}
    assert got == {1: 0.25, 2: 0.25, 3: 0.5, 4: 0.5, 5: 0.5, 6: 1.0, 7: 1.0}


def test_counts_kept_up_to_date(spark):
    rng = random.Random(8)
    draw = lambda ids: dense(spark, *((i, b, rng.randrange(1, 4), 10) for i in ids for b in ("bar", "gym") if rng.random() < 0.8 or b == "bar"))
    old, new = draw(range(40)), draw(range(20, 60))
    part = lambda df, lo, hi: df.where(F.col("id").between(lo, hi))
    held = corpus.changed(corpus.counts(old), part(old, 0, 29), part(new, 20, 29))
    held = corpus.changed(held, part(old, 30, 39), part(new, 30, 59))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(corpus.from_counts(held)) == rows(corpus.histogram(new))
    gone = corpus.changed(held, new, new.limit(0))
    assert rows(corpus.from_counts(gone)) == [] and rows(gone) == [(None, 0, 0)]


def test_histogram_has_zero_rows(spark):
    df = dense(spark, (1, "bar", 2, 1), (2, "bar", 2, 1), (3, "gym", 1, 1))
    got = {(r["bucket"], r["cnt"]): (r["n"], r["n_lt"], round(r["present_frac"], 3)) for r in corpus.histogram(df, 3).collect()}
    assert got == {("bar", 0): (1, 0, 0.667), ("bar", 2): (2, 1, 0.667), ("gym", 0): (2, 0, 0.333), ("gym", 1): (1, 2, 0.333)}


@pytest.mark.parametrize(
    ("count", "pct", "present", "banded", "exact"),
    [
        (5, 0.95, 1.0, "far more than most blocks", "top 5% of NYC blocks"), (5, 0.80, 1.0, "well above average", "top 20% of NYC blocks"), (5, 0.65, 1.0, "above average", "top 35% of NYC blocks"),
        (5, 0.64, 1.0, None, None), (5, 0.5, 1.0, None, None), (5, 0.35, 1.0, "below average", "bottom 35% of NYC blocks"), (5, 0.2, 1.0, "well below average", "bottom 20% of NYC blocks"),
        (5, 0.05, 1.0, "almost none", "bottom 5% of NYC blocks"), (1, 0.0, 1.0, "almost none", "bottom 0% of NYC blocks"), (0, 0.0, 0.6, "none nearby", "none nearby (most NYC blocks have some)"), (0, 0.0, 0.59, None, None),
        (5, 0.985, 1.0, "far more than most blocks", "top 2% of NYC blocks"), (9, 1.0, 1.0, "far more than most blocks", "top 0% of NYC blocks"),
    ],
)
def test_phrases(spark, count, pct, present, banded, exact):
    args = F.lit(count), F.lit(pct), F.lit(present)
    r = spark.range(1).select(phrases.banded(*args)[0].alias("b"), phrases.exact(*args)[0].alias("e")).first()
    assert (r["b"], r["e"]) == (banded, exact)


def test_words(spark):
    words = [phrases.proximity(F.lit(m)) for m in (0, 50, 51, 150, 151)] + [phrases.landmark_band(F.lit(m)) for m in (100, 250, 500, 501)] + [phrases.share_band(F.lit(s)) for s in (0.3, 0.18, 0.1, 0.05, 0.02, 0.019)] + [phrases.label(F.lit(b)) for b in ("cafe", "no_such_one")]
    got = list(spark.range(1).select(*(w.alias(f"c{k}") for k, w in enumerate(words))).first())
    assert got == ["on the doorstep", "on the doorstep", "steps away", "steps away", "a short walk", "right by", "a couple minutes from", "a short walk from", "about 10 minutes from", "mostly", "lots of", "plenty of", "some", "a little", None, "cafes", "no such one"]


def test_top_deviations_and_ties(spark):
    rows = [(i, b, 1 + i, 10) for i in range(20) for b in ("cafe", "dining", "gym_x", "grocery", "shopping", "culture", "transit")]
    df = dense(spark, *rows)
    top = [r["label"] for r in render.deviations(corpus.scored_lists(lists(df), corpus.histogram(df, 20))).where("id = 19").orderBy("rank").collect()]
    assert top == sorted(["cafes", "dining", "gym x", "grocery stores", "shops", "museums & galleries", "subway & transit"])[:5]


CATS = "id long, cats array<struct<bucket:string,n_doorstep:int,n_radius:int,nearest_m:int>>, landmarks array<struct<name:string,dist_m:int>>"


def test_views(spark):
    rec = spark.createDataFrame([(1, [("cafe", 1, 30, 20), ("gym_x", 0, 60, 20), ("culture", 0, 1, 300)], [("A", 100), ("B", 101), ("C", 100), ("D", 501)]), (2, [("cafe", 0, 1, 400)], [])], CATS)
    text = {v: {r["id"]: r["text"] for r in render.prompts(rec, v, corpus.histogram(dense(spark, (1, "cafe", 30, 20), (2, "cafe", 1, 400)), 2)).collect()} for v in P.VIEWS}
    assert text["landmarks"] == {1: P.LANDMARK_HEADER + "\n- right by: A, C\n- a couple minutes from: B\n- about 10 minutes from: D", 2: P.NO_LANDMARKS}
    assert text["proximity"][1].startswith("How close each kind of place is:\n- cafes: on the doorstep\n- gym x: on the doorstep\n- museums & galleries: a short walk\n" + P.LANDMARK_HEADER)
    assert text["composition"][1].split("\n")[1:3] == ["- mostly gym x", "- mostly cafes"]
    assert text["deviation"][2] == "How this block compares with a typical New York block (only the ways it stands out are listed):\n- cafes: almost none\n" + P.NO_LANDMARKS
    assert text["deviation"][1].split("\n")[1] == "- (unremarkable — typical across the board)"
    assert text["deviation_exact"][2].split("\n")[1] == "- cafes: bottom 0% of NYC blocks"
    assert text["combined"][2].count("\n\n") == 3 and text["combined"][2].endswith(P.NO_LANDMARKS)
    noted = render.prompts(rec, "landmarks", note=F.lit("\nnote")).where("id = 2").first()["text"]
    assert noted == P.NO_LANDMARKS + "\nnote"
    with pytest.raises(ValueError):
        render.view_text("no such view")


def test_facts(spark):
    rows = [(1, 1, "A", "cafe", "", None, None), (1, 2, "A", None, "shop", None, None), (1, 3, None, "cafe", None, None, None), (1, 4, "", "cafe", None, None, None), (1, 5, "B", None, None, None, None), (2, 6, None, None, None, "zoo", "park")]
    df = spark.createDataFrame(rows, "id long, pos long, name string, amenity string, shop string, tourism string, leisure string")
    places = render.name_ids(df.drop("id"), "pos")
    facts = render.place_facts(df.select("id", "pos").join(places.select("pos", "name_id"), "pos"), places, place="pos")
    assert {(r["id"], k["kind"]): k["n"] for r in facts.collect() for k in r["kinds"]} == {(1, "cafe"): 3, (1, None): 1, (2, "zoo"): 1}
    text = {r["id"]: r["text"] for r in render.facts_block(facts).collect()}
    assert text == {1: "Place types (count): {'cafe': 3, None: 1}\nPlaces: A, B", 2: "Place types (count): {'zoo': 1}\nPlaces: (none)"}


def test_band_shares_sum_up(spark):
    df = dense(spark, *((i, "bar", i % 5, 40 * i) for i in range(1, 21) if i % 5))
    scored = corpus.scored(lists(df), corpus.histogram(df, 16))
    shares = histograms.deviation_bands(scored).groupBy("bucket").agg(F.sum("n").alias("n"), F.round(F.sum("share"), 6).alias("s")).first()
    assert (shares["n"], shares["s"]) == (16, 100.0)
    near = {r["band"]: r["n"] for r in histograms.proximity_bands(df).collect()}
    assert near == {"doorstep": 1, "steps": 2, "short walk": 13}


def test_facts_without_pairs_are_those_of_pairs(spark):
    """Names that recur at one point or around it, unnamed places, places without a kind; a hundred listings share two positions."""
    rng = random.Random(8)
    own = lambda k: (k, rng.choice([None, "", "Ann", "Bob", "Cy", "Dee"]), rng.choice([None, "", "cafe"]), None, rng.choice([None, "inn"]), None, float(rng.randrange(0, 900, 90)), float(rng.randrange(0, 900, 90)))
    places = render.name_ids(spark.createDataFrame([own(k) for k in range(400)], "poi_id long, name string, amenity string, shop string, tourism string, leisure string, x_m double, y_m double"))
    rows = spark.createDataFrame([(i, 450.0 * (i % 2), 90.0) for i in range(100)], "id long, x_m double, y_m double")
    sites = enrich.sites(rows)
    told = lambda facts: sorted((r["id"], sorted((str(k["kind"]), k["n"]) for k in r["kinds"]), r["names"]) for r in facts.collect())
    want = told(render.place_facts(enrich.places_within(rows, places.select("poi_id", "name_id", "x_m", "y_m"), 450.0), places))
    facts = render.facts_around(sites, places, 450.0)
    assert facts.count() == 2 and len(want) == 100
    assert told(enrich.spread(facts, sites, rows)) == want


def test_a_weight_counts_as_so_many_listings(spark):
    rows = [(i, b, 1 + i % 4, 10) for i in range(12) for b in ("bar", "cafe") if (i + len(b)) % 5]
    many = dense(spark, *((i + 100 * k, b, n, m) for i, b, n, m in rows for k in range(1 + i % 3)))
    few = dense(spark, *rows).withColumn("w", 1 + F.pmod("id", F.lit(3)))
    all_of = lambda df: sorted(map(tuple, df.collect()))
    assert all_of(corpus.histogram(few, weight="w")) == all_of(corpus.histogram(many))
    assert corpus.size(few, weight="w") == corpus.size(many)
    assert [r for r in all_of(corpus.counts(few, weight="w").where("bucket IS NOT NULL"))] == all_of(corpus.counts(many).where("bucket IS NOT NULL"))
    assert all_of(histograms.proximity_bands(few, "w")) == all_of(histograms.proximity_bands(many))
