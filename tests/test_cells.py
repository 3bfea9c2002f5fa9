"""Counts by cells against all pairs, and distances to shapes against all segments."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vicinage import params as P
from vicinage.operators import cells, enrich

LISTINGS, PLACES = "id long, x_m double, y_m double", "poi_id long, bucket string, x_m double, y_m double"


def counted(listings, places, p):
    out = {}
    for i, x, y in listings:
        for _, b, u, v in places:
            d = math.sqrt((x - u) * (x - u) + (y - v) * (y - v))
            if d <= p.radius:
                n, m, least = out.get((i, b), (0, 0, math.inf))
                out[i, b] = (n + (d <= p.doorstep), m + 1, min(least, d))
    return out


def summed(df):
    return {(r["id"], r["bucket"]): (r["n_doorstep"], r["n_radius"], r["min_dist"]) for r in df.collect()}


@pytest.mark.parametrize(("radius", "doorstep", "span", "grid"), [(450.0, 150.0, 1500, 1), (450.0, 150.0, 1200, 75), (100.0, 100.0, 250, 12.5), (33.3, 0.0, 90, 0.1)])
def test_counts_and_nearest_are_those_of_all_pairs(spark, monkeypatch, radius, doorstep, span, grid):
    monkeypatch.setattr(cells, "BLOCK", 7)
    draw = random.Random(radius)
    at = lambda: grid * draw.randrange(-int(span / grid), int(span / grid))
    rows = [(i, float(at()), float(at())) for i in range(60)]
    near = [(float(at()), float(at())) for _ in range(25)]
    places = [(k, draw.choice("abc"), *(draw.choice(near) if k % 3 else (float(at()), float(at())))) for k in range(700)]
    p = P.Params(radius=radius, doorstep=doorstep)
    got = enrich.density_around(spark.createDataFrame(rows, LISTINGS), spark.createDataFrame(places, PLACES), p)
    assert summed(got) == counted(rows, places, p)


def test_a_crowd_in_few_cells_is_dealt_out(spark, monkeypatch):
    """Most listings and places share a few cells: no block of pairs gets the crowd."""
    monkeypatch.setattr(cells, "BLOCK", 50)
    draw = random.Random(2)
    at = lambda k: (draw.uniform(1000, 1300), draw.uniform(1000, 1300)) if k % 4 else (draw.uniform(0, 9000), draw.uniform(0, 9000))
    rows = [(i, *at(i)) for i in range(400)]
    places = [(k, draw.choice("ab"), *at(k)) for k in range(1600)]
    left, right = spark.createDataFrame(rows, LISTINGS), spark.createDataFrame(places, PLACES)
    assert summed(enrich.density_around(left, right)) == counted(rows, places, P.DEFAULT)
    cell = lambda df: df.withColumns({"cx": F.floor(F.col("x_m") / 450), "cy": F.floor(F.col("y_m") / 450)})
    near, found = cells.dealt(cells.around(left, 450.0, "id"), cell(right), ["cx", "cy"], ["id"], ["poi_id"])
    met = [r["count"] for r in near.join(found, ["cx", "cy", "_lb", "_pb"]).groupBy("cx", "cy", "_lb", "_pb").count().collect()]
    assert max(met) < 3 * 50 * 50 and sum(met) > 50 * max(met)


def test_equal_places_and_an_address_that_holds_a_third_of_them(spark):
    places = [(k, "a", 5.0, 5.0) for k in range(300)] + [(k, "a", 37.0 * (k % 25), 11.0 * (k % 40)) for k in range(300, 900)]
    rows = [(1, 5.0, 5.0), (2, 455.0, 5.0), (3, 455.1, 5.0), (4, 0.0, 0.0)]
    assert summed(enrich.density_around(spark.createDataFrame(rows, LISTINGS), spark.createDataFrame(places, PLACES))) == counted(rows, places, P.DEFAULT)
    assert enrich.density_around(spark.createDataFrame([], LISTINGS), spark.createDataFrame(places, PLACES)).count() == 0
    assert enrich.density_around(spark.createDataFrame(rows, LISTINGS), spark.createDataFrame([], PLACES)).count() == 0


def test_places_of_all_shapes_add_up(spark):
    places = [(1, "a", 10.0, 0.0, "POINT (10 0)"), (2, "a", 0.0, 0.0, "POLYGON ((300 -50, 400 -50, 400 50, 300 50, 300 -50))"), (3, "a", 0.0, 0.0, "LINESTRING (0 -100, 0 -120)"), (4, "b", 0.0, 0.0, "LINESTRING (0 460, 9 460)"), (5, "c", 1.0, 1.0, None)]
    got = summed(enrich.density_around(spark.createDataFrame([(7, 0.0, 0.0)], LISTINGS), spark.createDataFrame(places, PLACES + ", wkt string")))
    assert got == {(7, "a"): (2, 3, 10.0), (7, "c"): (1, 1, math.sqrt(2))}


def wkt(*rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"


def measured(point, rings):
    """Least distance to any segment; 0 if a ray to the right meets an odd number of them."""
    x, y = point
    best, odd = math.inf, False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]], strict=True):
            dx, dy = x2 - x1, y2 - y1
            t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
            odd ^= ((y1 > y) != (y2 > y)) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return 0.0 if odd else best


@pytest.mark.parametrize("whole", [True, False])
def test_shapes_against_all_segments(spark, whole):
    draw = random.Random(9 + whole)
    number = (lambda n: float(draw.randrange(-n, n, 50))) if whole else (lambda n: draw.uniform(-n, n))
    shapes = {k: [[(number(900), number(900)) for _ in range(draw.randint(3, 9))] for _ in range(draw.randint(1, 3))] for k in range(40)}
    rows = [(i, number(1500), number(1500)) for i in range(80)]
    frame = spark.createDataFrame([(k, wkt(*r)) for k, r in shapes.items()], "poi_id long, wkt string")
    got = {(r["id"], r["poi_id"]): r["dist"] for r in enrich.shapes_within(spark.createDataFrame(rows, LISTINGS), frame, 120.0).collect()}
    want = {(i, k): d for i, x, y in rows for k, r in shapes.items() if (d := measured((x, y), r)) <= 120.0}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - d) < 1e-9 for k, d in want.items())
    assert any(d == 0 for d in got.values()) and any(d > 0 for d in got.values())


def test_an_area_of_many_corners(spark):
    """Listings meet the segments near them, not all of the outline's; those deep inside meet none."""
    n = 10_000
    outline = [((3000 + 40 * math.sin(k)) * math.cos(2 * math.pi * k / n), (3000 + 40 * math.cos(3 * k)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    draw = random.Random(1)
    rows = [(i, draw.uniform(-3600, 3600), draw.uniform(-3600, 3600)) for i in range(150)] + [(1000, 0.0, 0.0)]
    shape = spark.createDataFrame([(1, wkt(outline))], "poi_id long, wkt string")
    left = spark.createDataFrame(rows, LISTINGS)
    got = {r["id"]: r["dist"] for r in enrich.shapes_within(left, shape, 100.0).collect()}
    want = {i: d for i, x, y in rows if (d := measured((x, y), [outline])) <= 100.0}
    assert got.keys() == want.keys() and all(abs(got[k] - d) < 1e-9 for k, d in want.items())
    filed = cells.filed(enrich.segments(shape, "poi_id"), "poi_id", 100.0)
    assert filed.where("x1 IS NOT NULL").count() < 2 * n
    assert filed.where("x1 IS NOT NULL").groupBy("cx", "cy").count().agg(F.max("count")).first()[0] < n / 50


def test_few_listings_meet_wide_blocks_of_places(spark, monkeypatch):
    """Parts of a listing's facts follow the cells it meets, not the number of places there."""
    monkeypatch.setattr(cells, "BLOCK", 50)
    draw = random.Random(4)
    rows, places = [(1, 100.0, 100.0), (2, -449.0, 3.0)], [(k, draw.choice("abc"), draw.uniform(-600, 600), draw.uniform(-600, 600)) for k in range(1500)]
    left, right = spark.createDataFrame(rows, LISTINGS), spark.createDataFrame(places, PLACES)
    parts = cells.folded_around(left, right, 450.0, ["bucket"], [F.min("poi_id").alias("least"), F.count("*").alias("n")]).collect()
    assert len(parts) <= 2 * 4 * 3
    got = {}
    for r in parts:
        least, n = got.get((r["id"], r["bucket"]), (math.inf, 0))
        got[r["id"], r["bucket"]] = (min(least, r["least"]), n + r["n"])
    want = {}
    for i, x, y in rows:
        for k, b, u, v in places:
            if math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= 450.0:
                least, n = want.get((i, b), (math.inf, 0))
                want[i, b] = (min(least, k), n + 1)
    assert got == want


def test_listings_at_one_address_are_measured_once(spark):
    rows = [(i, float(i % 3), 0.0) for i in range(90)] + [(100, None, 0.0)]
    left = spark.createDataFrame(rows, LISTINGS)
    sites = enrich.sites(left)
    assert sorted((r["x_m"], r["n_rows"]) for r in sites.collect()) == [(0.0, 30), (1.0, 30), (2.0, 30)]
    right = spark.createDataFrame([(1, "a", 450.0, 0.0), (2, "a", 451.5, 0.0), (3, "b", 2.0, 0.0)], PLACES)
    found = enrich.density_around(sites, right)
    assert found.count() == 6
    assert summed(enrich.spread(found, sites, left)) == counted([r for r in rows if r[1] is not None], [(1, "a", 450.0, 0.0), (2, "a", 451.5, 0.0), (3, "b", 2.0, 0.0)], P.DEFAULT)
    assert enrich.spread(found, sites, left).columns == found.columns
