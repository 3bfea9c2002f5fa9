import pytest
from pyspark.sql import functions as F

from vicinage.operators import clean


def test_aliases_first_present_wins(spark):
    df = spark.createDataFrame([("1", "2", "3")], ["review_scores_rating", "ratings", "other"])
    assert clean.select_aliases(df).collect()[0].asDict() == {"ratings": "2"}
    with pytest.raises(ValueError):
        clean.select_aliases(df.select("other"))


def test_types(spark):
    rows = [("$1,234.50", "4.5", " Yes "), ("n/a", "NaN", "maybe"), (None, "", "F"), ("-3", "x", "1"), ("$", " 7 ", None)]
    got = clean.set_types(spark.createDataFrame(rows, "price string, ratings string, is_superhost string")).collect()
    assert [r["price"] for r in got] == [1234.5, None, None, -3.0, None]
    assert [r["ratings"] for r in got] == [4.5, None, None, None, 7.0]
    assert [r["is_superhost"] for r in got] == [True, None, False, True, None]


def test_rooms_from_details(spark):
    rows = [("2", None, "3 bedrooms, 1.5 baths"), (None, "1", "3 Bedroom, 2 bathrooms"), (None, None, "12 beds"), (None, None, None), (None, None, "1.5 bath and 10.25 BEDROOMS")]
    df = clean.set_types(spark.createDataFrame(rows, "bedrooms string, bathrooms string, details string"))
    got = clean.derive_rooms(df)
    assert got.columns == ["bathrooms", "num_bedrooms", "num_baths"]
    assert [(r["num_bedrooms"], r["num_baths"]) for r in got.collect()] == [(2.0, 1.5), (3.0, 1.0), (None, None), (None, None), (10.25, 1.5)]
    alone = spark.createDataFrame([("4",)], "price string")
    assert clean.derive_rooms(alone).collect()[0].asDict() == {"price": "4", "num_bedrooms": None, "num_baths": None}


def test_prices_and_complete_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (0.0, "b"), (-1.0, "c"), (float("nan"), "d"), (None, "e"), (2.0, None)], "price double, room_type string")
    assert [r["room_type"] for r in clean.valid_prices(df).collect()] == ["a", None]
    assert clean.complete_rows(clean.valid_prices(df)).count() == 1
    nan = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    assert clean.complete_rows(nan).count() == 0


def test_cap_is_the_same_at_every_run(spark):
    df = spark.range(1000)
    one = {r["id"] for r in clean.capped(df, 50, "id", 3).collect()}
    assert len(one) == 50 and one == {r["id"] for r in clean.capped(df.repartition(5), 50, "id", 3).collect()}
    assert one != {r["id"] for r in clean.capped(df, 50, "id", 4).collect()}
    assert clean.capped(df, 5000, "id").count() == 1000


def test_cap_by_a_bound(spark, monkeypatch):
    """As many rows as asked for, in the order of the draw, whatever part of them is on the bound; repeated and null keys too."""
    df = spark.createDataFrame([(i % 300 if i % 7 else None, f"v{i % 450}") for i in range(900)], "id long, v string")
    full = sorted((r["d"], r["id"], r["v"]) for r in clean.stable_key(df, "h").withColumn("d", F.concat(F.coalesce(F.md5(F.concat(F.lit("0|"), F.col("id").cast("string")).cast("binary")), F.lit("")), F.lpad(F.lower(F.hex("h")), 16, "0"))).collect())
    for edge in (0, 1, 40):
        monkeypatch.setattr(clean, "EDGE", edge)
        for n in (0, 1, 13, 450, 899):
            got = clean.capped(df, n, "id")
            assert sorted((r["id"] or -1, r["v"]) for r in got.collect()) == sorted((i or -1, v) for _, i, v in full[:n]) and got.columns == df.columns
    same = spark.range(500).select(F.lit(1).alias("id"))
    assert clean.capped(same, 333, "id").count() == 333
    monkeypatch.setattr(clean, "EDGE", 100)
    plan = clean.capped(spark.range(3000), 2000, "id")._jdf.queryExecution().executedPlan().toString()
    assert "limit=2000" not in plan and "TakeOrderedAndProject(limit=2000" not in plan


def test_keys_and_leaks(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 3.0), (2, "x", 2.0, 3.0)], "host_id long, name string, latitude double, longitude double")
    assert clean.drop_leaks(df).columns == ["lat", "long"]
    assert clean.drop_leaks(df, ("name",)).columns == ["name", "lat", "long"]
    a = clean.stable_key(df).select("listing_key").distinct().collect()
    b = clean.stable_key(df.select(*reversed(df.columns)).repartition(3)).select("listing_key").distinct().collect()
    assert len(a) == 2 and sorted(a) == sorted(b)


def test_empty(spark):
    df = spark.createDataFrame([], "price string, lat string, details string, id long")
    assert clean.clean_listings(df, "id", cap=5).count() == 0
    assert clean.number(F.lit("1")) is not None
