"""Readers: scrapes, places, taxonomy, landmarks, density records, batch results."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage import params as P
from vicinage.functions import geo
from vicinage.operators.taxonomy import allowed_leaves

_RECORD = "cats MAP<STRING,ARRAY<INT>>, landmarks ARRAY<ARRAY<STRING>>"
_CALL = "STRUCT<choices:ARRAY<STRUCT<message:STRUCT<content:STRING>>>,usage:STRUCT<prompt_tokens:BIGINT,completion_tokens:BIGINT,cost:DOUBLE>>"
_ITEMS = f"ARRAY<STRUCT<custom_id:STRING,response:STRUCT<body:{_CALL}>>>"
_RESULT_KEYS = ("results", "output", "responses", "requests")


def scrape_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: every column a string; quoted fields may hold line ends and doubled quotes. Such a file is one task: give many."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def places_in(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """The rows of a nested dataset whose own box lies in the box; a dataset of writers.places() opens the files of the box' zones alone."""
    rows = spark.read.parquet(path)
    for zone in (c for c in rows.columns if re.fullmatch(r"zone_\d+", c)):
        spans = [F.col(zone).between(a, b) for a, b in geo.morton_ranges(box, int(zone[5:]))]
        rows = rows.where(reduce(lambda a, b: a | b, spans, F.lit(False))).drop(zone)
    return rows.where((F.col("bbox.xmin") >= box[0]) & (F.col("bbox.xmax") <= box[1]) & (F.col("bbox.ymin") >= box[2]) & (F.col("bbox.ymax") <= box[3]))


def places_parquet(spark: SparkSession, path: str, taxonomy: DataFrame, box: tuple[float, float, float, float], p: P.Params = P.DEFAULT) -> DataFrame:
    """SRC2: places of a nested dataset in the box (lon0, lon1, lat0, lat1), of enough confidence and an allowed category.

    The bounds are literals on nested fields, so they prune row groups. The point is the middle of a
    place's own box. The geometry (WKB, or WKT as text) becomes wkt on the metric plane. The dataset's id
    becomes poi_id; without one, a hash of the row stands for it.
    """
    rows = places_in(spark, path, box).where((F.col("confidence") >= p.min_confidence) & F.col("geometry").isNotNull())
    lon, lat = (F.col("bbox.xmin") + F.col("bbox.xmax")) / 2, (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2
    x, y = geo.utm(lon, lat, p.utm_zone)
    name, category = F.col("names.primary"), F.col("categories.primary")
    own = F.col("id") if "id" in rows.columns else F.xxhash64(name, category, "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax", "geometry")
    wkt = geo.wkb_text("geometry") if dict(rows.dtypes)["geometry"] == "binary" else F.col("geometry")
    out = rows.select(own.alias("poi_id"), name.alias("name"), category.alias("category"), "confidence", wkt.alias("wkt"), x.alias("x_m"), y.alias("y_m"))
    return project_wkt(out.join(allowed_leaves(taxonomy).withColumnRenamed("leaf", "category"), "category", "left_semi"), p.utm_zone)


def path_array(text: Column) -> Column:
    """'[a,b,c]' or 'a,b,c' as an array of trimmed parts."""
    return F.transform(F.split(F.regexp_replace(F.trim(text), r"^\[|\]$", ""), ","), lambda x: F.trim(x))


def taxonomy_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: (leaf, path) from `leaf;[group,...,leaf]` lines; header and short lines are skipped, the last line of a leaf counts."""
    lines = spark.read.schema("leaf STRING, path STRING").option("sep", ";").csv(path)
    lines = lines.select(F.trim(F.regexp_replace("leaf", "^﻿", "")).alias("leaf"), "path", F.monotonically_increasing_id().alias("_i"))
    lines = lines.where("leaf IS NOT NULL AND path IS NOT NULL AND leaf <> 'Category code'")
    return lines.groupBy("leaf").agg(F.max_by("path", "_i").alias("path")).select("leaf", path_array(F.col("path")).alias("path"))


def landmarks_json(spark: SparkSession, path: str, zone: int | None = P.DEFAULT.utm_zone) -> DataFrame:
    """SRC4: (ord, name, wkt) in the file's order; coordinates go to the metric plane unless zone is None."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "landmarks MAP<STRING,STRUCT<lat:DOUBLE,lon:DOUBLE,type:STRING,wkt:STRING>>")
    rows = text.select(F.posexplode(F.map_entries(parsed["landmarks"])).alias("ord", "_e")).select("ord", F.col("_e.key").alias("name"), F.col("_e.value.wkt").alias("wkt"))
    return rows if zone is None else project_wkt(rows, zone)


def project_wkt(rows: DataFrame, zone: int) -> DataFrame:
    """The points of wkt moved to a UTM zone, kind and rings kept."""
    def ring(r: Column) -> Column:
        def point(q: Column) -> Column:
            x, y = geo.utm(q["x"], q["y"], zone)
            return F.concat(x.cast("decimal(14,4)").cast("string"), F.lit(" "), y.cast("decimal(14,4)").cast("string"))

        return F.concat(F.lit("("), F.array_join(F.transform(r, point), ","), F.lit(")"))

    kind = F.upper(F.trim(F.regexp_extract("wkt", r"^\s*([A-Za-z]+)", 1)))
    moved = F.array_join(F.transform(geo.wkt_rings(F.col("wkt")), ring), ",")
    return rows.withColumn("wkt", F.concat(kind, F.when(kind.isin("POINT", "LINESTRING"), moved).otherwise(F.concat(F.lit("("), moved, F.lit(")")))))


def parse_record(text: Column, by_distance: bool = False) -> Column:
    """SRC5: density JSON as struct(cats, landmarks) of typed entries; cats in the text's order, or by nearest_m with ties in the text's order."""
    r = F.from_json(text, _RECORD)
    fields = ("bucket", "n_doorstep", "n_radius", "nearest_m")
    cats = F.transform(F.map_entries(r["cats"]), lambda e, i: F.struct(F.get(e["value"], F.lit(2)).alias("nearest_m"), i.alias("i"), e["key"].alias("bucket"), F.get(e["value"], F.lit(0)).alias("n_doorstep"), F.get(e["value"], F.lit(1)).alias("n_radius")))
    cats = F.transform(F.sort_array(cats) if by_distance else cats, lambda c: F.struct(*(c[f].alias(f) for f in fields)))
    marks = F.transform(r["landmarks"], lambda m: F.struct(F.get(m, F.lit(0)).alias("name"), F.get(m, F.lit(1)).cast("int").alias("dist_m")))
    return F.struct(F.coalesce(cats, F.array().cast("array<struct<bucket:string,n_doorstep:int,n_radius:int,nearest_m:int>>")).alias("cats"), F.coalesce(marks, F.array().cast("array<struct<name:string,dist_m:int>>")).alias("landmarks"))


def stored_records(df: DataFrame, column: str = "surroundings") -> DataFrame:
    """SRC5: a stored table with cats and landmarks in place of the JSON column."""
    return df.withColumn("_r", parse_record(F.col(column))).withColumns({"cats": F.col("_r.cats"), "landmarks": F.col("_r.landmarks")}).drop("_r", column)


def request_lines(spark: SparkSession, path: str) -> DataFrame:
    """SNK5: (value, batch_no): request lines as they were written; where there was no request, there is no folder that tells the number."""
    lines = spark.read.text(path)
    return lines if "batch_no" in lines.columns else lines.withColumn("batch_no", F.lit(None).cast("int"))


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: (value, seq): the lines of result files with their place, in the order of file names and of lines; for one object a file give whole lines."""
    lines = spark.read.text(path)
    seq = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select("value", seq.alias("seq"))


def parse_results(text: Column) -> Column:
    """SRC6: the items of a batch result: the first list that is not empty, without items that have no body."""
    r = F.from_json(text, ", ".join(f"{k} {_ITEMS}" for k in _RESULT_KEYS))
    items = F.coalesce(*(F.when(F.size(r[k]) > 0, r[k]) for k in _RESULT_KEYS))
    return F.filter(items, lambda x: x["response"]["body"].isNotNull())


def result_rows(batches: DataFrame, column: str = "value") -> DataFrame:
    """SRC6: (custom_id, content, prompt_tokens, completion_tokens, cost) of every item, and seq, its place, if the batches have one."""
    placed = "seq" in batches.columns
    item = batches.select(*(["seq"] if placed else []), F.posexplode(parse_results(F.col(column))).alias("_at", "_i"))
    body = F.col("_i.response.body")
    return item.select(*([F.struct("seq", "_at").alias("seq")] if placed else []), "_i.custom_id", F.get(body["choices"], F.lit(0))["message"]["content"].alias("content"), body["usage"]["prompt_tokens"].alias("prompt_tokens"), body["usage"]["completion_tokens"].alias("completion_tokens"), body["usage"]["cost"].alias("cost"))
