import math
from unittest import mock

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinage.functions import geo
from vicinage.operators import cells, enrich

#: Longitude, latitude, zone, easting, northing of points on the central meridian and off it.
UTM = [(-75.0, 0.0, 18, 500000.0, 0.0), (-79.387139, 43.642567, 17, 630084.0, 4833438.0), (9.0, 45.0, 32, 500000.0, 4982950.4)]


def test_utm_against_known_points(spark):
    for lon, lat, zone, east, north in UTM:
        x, y = geo.utm(F.lit(lon), F.lit(lat), zone)
        r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        assert abs(r["x"] - east) < 1.0 and abs(r["y"] - north) < 1.0


def test_utm_scale_near_the_meridian(spark):
    """A short step along the central meridian has the scale 0.9996."""
    (x1, y1), (x2, y2) = (geo.utm(F.lit(-75.0), F.lit(lat), 18) for lat in (40.0, 40.001))
    r = spark.range(1).select((y2 - y1).alias("dy"), (x2 - x1).alias("dx")).first()
    phi, e2 = math.radians(40.0005), 0.00669437999014
    arc = math.radians(0.001) * 6378137.0 * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5
    assert abs(r["dy"] - 0.9996 * arc) < 0.001 and abs(r["dx"]) < 1e-6


@pytest.mark.parametrize(
    ("wkt", "x", "y", "dist"),
    [
        ("POINT (3 4)", 0, 0, 5.0), ("POINT(3 4)", 3, 4, 0.0),
        ("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", 5, 5, 0.0), ("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", 13, 14, 5.0), ("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", 10, 5, 0.0),
        ("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2))", 5, 5, 3.0), ("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2))", 1, 1, 0.0),
        ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((10 0, 11 0, 11 1, 10 1, 10 0)))", 10.5, 0.5, 0.0), ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((10 0, 11 0, 11 1, 10 1, 10 0)))", 5.5, 0.5, 4.5),
        ("LINESTRING (0 0, 10 0, 10 10)", 5, 5, 5.0), ("LINESTRING (0 0, 10 0, 10 10)", -3, 4, 5.0),
    ],
)
def test_edge_distance(spark, wkt, x, y, dist):
    listings = spark.createDataFrame([(1, float(x), float(y))], "id long, x_m double, y_m double")
    shapes = spark.createDataFrame([(7, wkt)], "poi_id long, wkt string")
    got = enrich.shapes_within(listings, shapes, 20.0).collect()
    assert len(got) == 1 and got[0]["dist"] == pytest.approx(dist)


POINTS = st.lists(st.tuples(st.integers(-30, 30), st.integers(-30, 30)), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(POINTS, POINTS, st.sampled_from([1.0, 5.0, 7.5]), st.sampled_from([1, 3, 2000]))
def test_grid_join_is_the_plain_join(spark, a, b, radius, block):
    listings = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id long, x_m double, y_m double")
    places = spark.createDataFrame([(i, float(x), float(y), "c") for i, (x, y) in enumerate(b)], "poi_id long, x_m double, y_m double, bucket string")
    with mock.patch.object(cells, "BLOCK", block):
        got = sorted((r["id"], r["poi_id"]) for r in enrich.places_within(listings, places, radius).collect())
    assert got == sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if math.dist(p, q) <= radius)
