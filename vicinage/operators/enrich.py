"""Listings with the places and landmarks around them.

A taxonomy and a landmark list are dimension tables: Spark broadcasts them while they are below
spark.sql.autoBroadcastJoinThreshold and shuffles them beyond; no hint forces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage import params as P
from vicinage.functions import geo
from vicinage.operators import cells
from vicinage.operators.taxonomy import allowed_leaves, with_bucket
from vicinage.store import once


#: Listings of one task that spread() leaves to what comes behind it.
TASK = 5_000


def extent(listings: DataFrame, pad: float, x: str = "long", y: str = "lat") -> tuple[float, float, float, float] | None:
    """AGG1: least and greatest coordinates with a pad, as numbers that push down into a scan; None without listings."""
    r = listings.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    return None if r["x0"] is None else (r["x0"] - pad, r["x1"] + pad, r["y0"] - pad, r["y1"] + pad)


def gated(places: DataFrame, taxonomy: DataFrame, p: P.Params = P.DEFAULT, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """FLT3 and JON3: places of enough confidence and an allowed category, in the box if there is one, with their bucket."""
    kept = places.where(F.col("confidence") >= p.min_confidence)
    if box:
        kept = kept.where(F.col("x_m").between(box[0], box[1]) & F.col("y_m").between(box[2], box[3]))
    kept = kept.join(allowed_leaves(taxonomy).withColumnRenamed("leaf", "category"), "category", "left_semi")
    return with_bucket(kept, taxonomy)


def _positions(listings: DataFrame, key: str, least: tuple[str, ...] = ()) -> DataFrame:
    """(key, least values of columns, _at): the positions of each key in order, as (x_m, y_m, _m) for _m of its rows; counts around a key that comes several times add up over them."""
    lowest = [F.min(f"`{c}`").alias(c) for c in least]
    at = listings.where("x_m IS NOT NULL AND y_m IS NOT NULL").groupBy(key, "x_m", "y_m").agg(F.count("*").cast("int").alias("_m"), *lowest)
    return at.groupBy(key).agg(*lowest, F.sort_array(F.collect_list(F.struct("x_m", "y_m", "_m"))).alias("_at"))


def sites(listings: DataFrame, key: str = "id") -> DataFrame:
    """(key, x_m, y_m, n_rows): the distinct positions of listings, computed once and numbered, with how many listings each stands for.

    Such a table stands in for the listings, so that what depends on the position alone is worked out once for all of those at one address;
    spread() gives it back to them. A number has several rows where listings that come several times share all their positions.
    """
    at = _positions(listings, key).groupBy("_at").agg(F.count("*").alias("n_rows")).select(F.monotonically_increasing_id().alias(key), "_at", "n_rows")
    each = at.select(key, F.explode("_at").alias("_p"), "n_rows").select(key, "_p.*", "n_rows")
    return once(each.select(key, "x_m", "y_m", "n_rows", F.explode(F.sequence(F.lit(1), "_m"))).drop("col"))


def weighted(found: DataFrame, sites: DataFrame, key: str = "id") -> DataFrame:
    """found(key, ...) of sites with n_rows."""
    return found.join(sites.select(key, "n_rows").distinct(), key)


def members(listings: DataFrame, sites: DataFrame, key: str = "id", least: tuple[str, ...] = ()) -> DataFrame:
    """(key, least values of columns, _site): the number in sites() of each key."""
    at = _positions(sites.withColumnRenamed(key, "_site"), "_site")
    return _positions(listings, key, least).join(at, "_at").drop("_at")


def spread(found: DataFrame, sites: DataFrame, listings: DataFrame, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, ...): what was found for a site, for each key there, or with columns to keep for each row of it. Keys are dealt by their number first, as a few narrow files of them are the work of many tasks behind."""
    kept = [F.col(f"`{c}`") for c in (key, *keep)]
    tasks = 1 + (sites.select(key, "n_rows").distinct().agg(F.sum("n_rows")).first()[0] or 0) // TASK
    each = members(listings, sites, key)
    if keep:
        each = listings.join(each, key).select(*kept, "_site")
    own = found.withColumnRenamed(key, "_site")
    return each.repartition(tasks, "_site", key).join(own, "_site").select(*kept, *(F.col(f"`{c}`") for c in own.columns if c != "_site"))


def places_within(listings: DataFrame, places: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """JON1: pairs of a listing and a place at most `radius` apart, with the distance. Where counts are enough, density_around() sums them up in place.

    Both sides meet by grid cell of the radius' size. Listings go to the nine cells around them, so
    each pair meets in one cell, the place's own, and is found once. A cell with many listings or places is dealt to blocks, each
    of which pairs some of its listings with some of its places, by counts that are taken first. Of the places'
    columns, one that is named like the listings' key is left out.
    """
    near = cells.around(listings, radius, key)
    at = places.drop(key).withColumns({"cx": geo.cell(F.col("x_m"), radius), "cy": geo.cell(F.col("y_m"), radius)})
    on = ["cx", "cy"]
    near, at = cells.dealt(near, at, on, [key, "_lx", "_ly"], ["poi_id"] if "poi_id" in at.columns else ["x_m", "y_m"])
    pairs = near.join(at, [*on, "_lb", "_pb"]).withColumn("dist", geo.distance(F.col("_lx"), F.col("_ly"), F.col("x_m"), F.col("y_m")))
    return pairs.where(F.col("dist") <= radius).drop("cx", "cy", "_lb", "_pb", "_lx", "_ly", "x_m", "y_m")


def shapes_within(listings: DataFrame, shapes: DataFrame, radius: float, key: str = "id", shape_key: str = "poi_id") -> DataFrame:
    """JON1 for places that are lines or areas: distance to the edge, 0 inside. shapes(shape_key, wkt, ...).

    A listing meets the segments in the grid cells around it, not all of a shape's.
    """
    found = cells.edge_distances(listings, segments(shapes, shape_key), radius, key, shape_key)
    return found.join(shapes.drop("wkt", *([] if key == shape_key else [key])), shape_key)


def density_around(listings: DataFrame, places: DataFrame, p: P.Params = P.DEFAULT, key: str = "id") -> DataFrame:
    """JON1 and AGG2 for places of every shape: points counted by cells, lines and areas (a wkt of another kind) measured to their edge.

    (key, bucket, n_doorstep, n_radius, nearest_m, min_dist). Parts of the sums are dealt by the key once; the sums, and whatever is
    gathered by the key behind them, stay where they are.
    """
    if "wkt" not in places.columns:
        return _summed(cells.sums_around(listings, places, p, key), key)
    shaped = F.coalesce(~F.upper(F.ltrim("wkt")).startswith("POINT"), F.lit(False))
    points = cells.sums_around(listings, places.where(~shaped), p, key)
    pairs = shapes_within(listings, places.where(shaped).drop("x_m", "y_m"), p.radius, key)
    return _summed(points.unionByName(density(pairs, p, key).select(points.columns)), key)


def _summed(parts: DataFrame, key: str) -> DataFrame:
    total = lambda c: F.sum(c).cast("int").alias(c)
    sums = parts.repartition(key).groupBy(key, "bucket").agg(total("n_doorstep"), total("n_radius"), F.min("min_dist").alias("min_dist")).where("n_radius > 0")
    return sums.select(key, "bucket", "n_doorstep", "n_radius", F.rint("min_dist").cast("int").alias("nearest_m"), "min_dist")


def segments(shapes: DataFrame, shape_key: str) -> DataFrame:
    """(shape_key, area, x1, y1, x2, y2): every segment of every ring."""
    rings = shapes.select(shape_key, geo.is_area(F.col("wkt")).alias("area"), F.explode(geo.wkt_rings(F.col("wkt"))).alias("_r"))
    return rings.select(shape_key, "area", F.explode(geo.ring_segments(F.col("_r"))).alias("_s")).select(shape_key, "area", "_s.*").where("x1 IS NOT NULL AND y1 IS NOT NULL")


def landmarks_within(listings: DataFrame, landmarks: DataFrame, p: P.Params = P.DEFAULT, key: str = "id") -> DataFrame:
    """JON2: (key, ord, name, dist, dist_m) of landmarks at most landmark_radius away; distance to the edge, 0 inside."""
    names = landmarks.select("ord", "name")
    shapes = landmarks.select("ord", "wkt")
    found = shapes_within(listings, shapes, p.landmark_radius, key, "ord")
    return found.join(names, "ord").select(key, "ord", "name", "dist", F.rint("dist").cast("int").alias("dist_m"))


def density(pairs: DataFrame, p: P.Params = P.DEFAULT, key: str = "id") -> DataFrame:
    """AGG2: per listing and bucket the places at the doorstep and in the radius, and the nearest one's distance."""
    return pairs.groupBy(key, "bucket").agg(
        F.sum(F.when(F.col("dist") <= p.doorstep, 1).otherwise(0)).cast("int").alias("n_doorstep"),
        F.count("*").cast("int").alias("n_radius"),
        F.rint(F.min("dist")).cast("int").alias("nearest_m"),
        F.min("dist").alias("min_dist"),
    )


def landmark_lists(found: DataFrame, key: str = "id") -> DataFrame:
    """AGG3: (key, landmarks): names with rounded distances, nearest first, equal ones in the list's order."""
    ordered = F.sort_array(F.collect_list(F.struct("dist_m", "ord", "name")))
    return found.groupBy(key).agg(F.transform(ordered, lambda x: F.struct(x["name"].alias("name"), x["dist_m"].alias("dist_m"))).alias("landmarks"))


def cat_lists(dense: DataFrame, key: str = "id") -> DataFrame:
    """AGG4: (key, cats): buckets by the exact distance of their nearest place."""
    ordered = F.sort_array(F.collect_list(F.struct("min_dist", "bucket", "n_doorstep", "n_radius", "nearest_m")))
    fields = ("bucket", "n_doorstep", "n_radius", "nearest_m")
    return dense.groupBy(key).agg(F.transform(ordered, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("cats"))


def records(dense: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """AGG4 with FLT5: (key, cats, landmarks) of listings that have a place in the radius."""
    none = F.array().cast("array<struct<name:string,dist_m:int>>")
    return cat_lists(dense, key).join(landmark_lists(found, key), key, "left").withColumn("landmarks", F.coalesce("landmarks", none))
