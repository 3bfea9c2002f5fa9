import json
import random
import struct

from pyspark.sql import functions as F

from vicinage.functions import geo
from vicinage.plans import fixtures as fx
from vicinage.plans import jobs
from vicinage.sources import readers, writers


def test_scrape_csv_and_clean_job(spark, tmp_path):
    (tmp_path / "in.csv").write_text('price,details,room_type,ratings\n"$1,000.00","2 bedrooms,\n1.5 baths, ""nice""",Entire,4.5\nn/a,,Private,\n$5,"1 bedroom, 1 bath",Shared,3\n')
    raw = readers.scrape_csv(spark, f"{tmp_path}/in.csv")
    assert raw.count() == 3 and raw.first()["details"] == '2 bedrooms,\n1.5 baths, "nice"'
    jobs.clean_job(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out")
    got = sorted(((r["price"], r["num_bedrooms"], r["num_baths"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [(5.0, 1.0, 1.0), (1000.0, 2.0, 1.5)]


def test_places_parquet(spark, tmp_path):
    schema = "id string, names struct<primary:string>, categories struct<primary:string>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, confidence double, geometry string"
    place = lambda n, c, x, y, f=0.9, g="POINT (-74 40.7)": (f"p{n}", (n,), (c,), (x, x, y, y), f, g)
    rows = [place("a", "bar", -74.0, 40.7), place("b", "dentist", -74.0, 40.7), place("c", "bar", -75.0, 40.7), place("d", "bar", -74.0, 40.7, 0.5), place("e", "bar", -74.0, 40.7, 0.9, None), place(None, "bus_stop", -74.0, 40.7)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/p")
    got = readers.places_parquet(spark, f"{tmp_path}/p", fx.taxonomy(spark), (-74.1, -73.9, 40.6, 40.8))
    assert sorted((r["poi_id"], str(r["name"])) for r in got.collect()) == [("pNone", "None"), ("pa", "a")]
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(bbox.xmin,-74.1)" in plan and "GreaterThanOrEqual(confidence,0.6)" in plan


def test_taxonomy_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿Category code; Taxonomy\nbar ; [eat_and_drink, bar]\nshort\nbar;[eat_and_drink,bar,late]\ngym;[active_life]\n", encoding="utf-8")
    got = {r["leaf"]: r["path"] for r in readers.taxonomy_csv(spark, f"{tmp_path}/t.csv").collect()}
    assert got == {"bar": ["eat_and_drink", "bar", "late"], "gym": ["active_life"]}


def test_landmarks_json(spark, tmp_path):
    marks = {"landmarks": {"Zed": {"lat": 40.7, "lon": -74.0, "type": "Point", "wkt": "POINT (-74 40.7)"}, "Ab": {"lat": 0, "lon": 0, "type": "Polygon", "wkt": "POLYGON ((-74 40.7, -73.9 40.7, -73.9 40.8, -74 40.7))"}}}
    (tmp_path / "l.json").write_text(json.dumps(marks, indent=1))
    plain = readers.landmarks_json(spark, f"{tmp_path}/l.json", None).orderBy("ord").collect()
    assert [(r["ord"], r["name"]) for r in plain] == [(0, "Zed"), (1, "Ab")]
    moved = readers.landmarks_json(spark, f"{tmp_path}/l.json").orderBy("ord")
    x, y = geo.utm(geo.F.lit(-74.0), geo.F.lit(40.7), 18)
    want = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    rings = [r["rings"] for r in moved.select(geo.wkt_rings(geo.F.col("wkt")).alias("rings")).collect()]
    assert abs(rings[0][0][0]["x"] - want["x"]) < 0.001 and abs(rings[1][0][0]["y"] - want["y"]) < 0.001 and len(rings[1][0]) == 4


def test_record_parse_of_odd_text(spark):
    texts = ['{"cats": {}, "landmarks": []}', '{"cats": {"b": [1, 2, 30], "a": [0, 1, 30]}, "landmarks": [["X, \\"Y\\"", 5]]}', "{}", "broken", None]
    rows = [r["r"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(readers.parse_record(geo.F.col("t")).alias("r")).collect()]
    assert [len(r["cats"]) for r in rows] == [0, 2, 0, 0, 0]
    assert [tuple(c) for c in rows[1]["cats"]] == [("b", 1, 2, 30), ("a", 0, 1, 30)] and tuple(rows[1]["landmarks"][0]) == ('X, "Y"', 5)


def test_table_writer(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb')], "id long, t string")
    writers.table(df, f"{tmp_path}/c", "csv", one_file=True)
    assert readers.scrape_csv(spark, f"{tmp_path}/c").first()["t"] == 'a "q"\nb'
    held = spark.createDataFrame([(1, 2.0, 3.0, "{}")], "id long, price double, lat double, surroundings string")
    writers.write_variants(held, "id", f"{tmp_path}/v", f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/v").columns == ["price"] and spark.read.parquet(f"{tmp_path}/e").columns == ["id", "price", "surroundings"]
    assert writers.published(held, "id").columns == ["price", "lat"]


def test_long_names_stay_whole(spark):
    name = 'x "q"]' + "y" * 3_000_000 + "]"
    df = spark.createDataFrame([([], [(name, 5)])], "cats array<struct<bucket:string,n_doorstep:int,n_radius:int,nearest_m:int>>, landmarks array<struct<name:string,dist_m:int>>")
    assert json.loads(df.select(writers.record_json(geo.F.col("cats"), geo.F.col("landmarks")).alias("t")).first()["t"]) == {"cats": {}, "landmarks": [[name, 5]]}


def test_wkb(spark):
    le = lambda form, *v: struct.pack("<" + form, *v)
    point, line = le("BIdd", 1, 1, 1.5, -2.0), le("BII4d", 1, 2, 2, 0.0, 0.0, 1.0, 1.0)
    area = le("BIII6d", 1, 3, 1, 3, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0)
    shapes = [point, line, area, le("BII", 1, 6, 1) + area, struct.pack(">BIIdd", 0, 0x20000001, 4326, 1.0, 2.0), le("BIddd", 1, 1001, 1.0, 2.0, 3.0), b"\x01", None]
    got = [r["w"] for r in spark.createDataFrame([(k, b) for k, b in enumerate(shapes)], "k int, b binary").select("k", geo.wkb_text("b").alias("w")).orderBy("k").collect()]
    assert got == ["POINT (1.5 -2.0)", "LINESTRING (0.0 0.0,1.0 1.0)", "POLYGON ((0.0 0.0,1.0 0.0,0.0 1.0))", "MULTIPOLYGON (((0.0 0.0,1.0 0.0,0.0 1.0)))", "POINT (1.0 2.0)", "POINT (1.0 2.0)", None, None]


def test_enrich_from_files(spark, tmp_path):
    """Places whose id is named like the listings' key, a park measured to its edge, and one far outside the extent."""
    schema = "id string, names struct<primary:string>, categories struct<primary:string>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, confidence double, geometry binary"
    point = lambda i, c, x, y: (i, (i,), (c,), (x, x, y, y), 0.9, struct.pack("<BIdd", 1, 1, x, y))
    ring = [(-73.99, 40.75), (-73.95, 40.75), (-73.95, 40.79), (-73.99, 40.79), (-73.99, 40.75)]
    park = ("park", ("park",), ("beach",), (-73.99, -73.95, 40.75, 40.79), 0.9, struct.pack("<BIII10d", 1, 3, 1, 5, *(v for p in ring for v in p)))
    spark.createDataFrame([point("a", "bar", -73.9951, 40.76), point("b", "bar", -73.0, 40.76), park], schema).write.parquet(f"{tmp_path}/p")
    listings = spark.createDataFrame([(7, "Entire", -73.995, 40.76), (8, "Private", -73.97, 40.77), (9, "Private", -73.9, 40.6)], "id long, room_type string, long double, lat double")
    marks = spark.createDataFrame([(0, "Mill", "POINT (0 0)")], "ord int, name string, wkt string")
    rows = {r["id"]: {c["bucket"]: (c["n_doorstep"], c["n_radius"], c["nearest_m"]) for c in r["cats"]} for r in jobs.enrich_files_job(listings, f"{tmp_path}/p", fx.taxonomy(spark), marks).collect()}
    assert set(rows) == {7, 8} and rows[8] == {"park_green": (1, 1, 0)}
    assert rows[7]["nightlife"][1:] == (1, 8) and rows[7]["park_green"][1] == 1 and 415 < rows[7]["park_green"][2] < 430


def scanned_files(df):
    """Files that the plan's scans have opened."""
    df.collect()
    plan, todo, n = df._jdf.queryExecution().executedPlan(), [], 0
    todo.append(plan)
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan"):
            n += p.metrics().apply("numFiles").value()
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return n


def test_places_along_a_curve(spark, tmp_path):
    """An extent opens the files of its zones; a zone with many places has several."""
    draw = random.Random(5)
    at = lambda k: (-73.98 + draw.random() / 50, 40.75 + draw.random() / 50) if k % 3 == 0 else (draw.uniform(-179, 179), draw.uniform(-89, 89))
    rows = [(k, (x, x, y, y)) for k in range(3000) for x, y in [at(k)]] + [(-1, (180.0, 180.0, 90.0, 90.0)), (-2, (-180.0, -180.0, -90.0, -90.0))]
    df = spark.createDataFrame(rows, "id long, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>")
    writers.places(df, f"{tmp_path}/p", levels=3, files=24)
    everything = spark.read.parquet(f"{tmp_path}/p")
    assert everything.count() == 3002 and "zone_3" in everything.columns
    total = sum(1 for _ in (tmp_path / "p").rglob("*.parquet"))
    assert everything.where(F.col("bbox.xmin").between(-74, -73.9)).select(F.input_file_name()).distinct().count() >= 3
    for box in ((-73.975, -73.965, 40.755, 40.765), (-74.0, -60.0, 30.0, 50.0), (-180.0, 180.0, -90.0, 90.0), (170.0, 200.0, 80.0, 95.0), (10.0, 10.0, 10.0, 10.0)):
        found = readers.places_in(spark, f"{tmp_path}/p", box)
        assert sorted(r["id"] for r in found.collect()) == sorted(i for i, (x, _, y, _) in rows if box[0] <= x <= box[1] and box[2] <= y <= box[3])
        assert found.columns == ["id", "bbox"]
    assert 0 < scanned_files(readers.places_in(spark, f"{tmp_path}/p", (-73.975, -73.965, 40.755, 40.765))) < total / 4


def test_ranges_cover_the_codes_of_a_box(spark):
    draw = random.Random(7)
    points = [(draw.uniform(-180, 180), draw.uniform(-90, 90)) for _ in range(400)]
    codes = [r["z"] for r in spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k long, x double, y double").select("k", geo.morton(F.col("x"), F.col("y"), 8).alias("z")).orderBy("k").collect()]
    for _ in range(40):
        (x0, x1), (y0, y1) = sorted(draw.uniform(-180, 180) for _ in range(2)), sorted(draw.uniform(-90, 90) for _ in range(2))
        ranges = geo.morton_ranges((x0, x1, y0, y1), 8)
        assert len(ranges) <= 70
        inside = [any(a <= z <= b for a, b in ranges) for z in codes]
        assert all(i for i, (x, y) in zip(inside, points, strict=True) if x0 <= x <= x1 and y0 <= y <= y1)
