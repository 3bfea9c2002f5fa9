from collections import Counter

from pyspark.sql import functions as F

from vicinage.operators import sample


def test_strata_round_half_to_even(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["a"] * 50 + ["b"] * 30 + ["c"] * 10 + [None] * 10)], "id long, neighbourhood string")
    assert Counter(r["neighbourhood"] for r in sample.stratified(df, 10, 1).collect()) == {"a": 5, "b": 3, "c": 1, None: 1}
    assert Counter(r["neighbourhood"] for r in sample.stratified(df, 5, 1).collect()) == {"a": 2, "b": 2}
    assert sample.stratified(df, 100, 1).count() == 100
    same = lambda d: sorted(r["id"] for r in sample.stratified(d, 20, 1).collect())
    assert same(df) == same(df.repartition(5)) and sample.stratified(df, 20, 1).columns == df.columns


def test_stratum_falls_back(spark):
    assert sample.stratified(spark.range(100).withColumn("room_type", F.lit("x")), 7, 1).count() == 7
    assert sample.stratified(spark.range(100), 7, 1).count() == 7


def test_large_stratum_is_exact_after_thinning(spark):
    df = spark.range(20_000).withColumn("room_type", F.when(F.col("id") % 100 == 0, "few").otherwise("many"))
    assert Counter(r["room_type"] for r in sample.stratified(df, 2_000, 5).collect()) == {"many": 1980, "few": 20}


def test_models(spark):
    slugs = ["openai/GPT-5.6-x:batch", "google/gemini-3.7-flash", "google/gemini-3-flash-lite", "google/gemini-2.5-flash"]
    got = {r["slug"]: (r["base"], r["kind"]) for r in sample.model_variants(spark.range(1), spark.createDataFrame([(s,) for s in slugs], "slug string")).collect()}
    assert got == {slugs[0]: ("openai/GPT-5.6-x", "thinking"), slugs[1]: (slugs[1], "thinking"), slugs[2]: (slugs[2], "plain"), slugs[3]: (slugs[3], "plain")}


def test_seeded_sample(spark):
    ids = [r["id"] for r in sample.seeded_sample(spark.range(300), 20, 4).collect()]
    assert len(ids) == 20 and ids == sorted(ids)
