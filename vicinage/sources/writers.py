"""Writers: tables, density JSON, request lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.functions import geo


def table(df: DataFrame, path: str, kind: str = "parquet", one_file: bool = False, mode: str = "overwrite") -> None:
    """SNK1: a table as Parquet or CSV; one file only on request, as that makes one task of it."""
    out = (df.coalesce(1) if one_file else df).write.mode(mode)
    out.option("header", True).option("quote", '"').option("escape", '"').csv(path) if kind == "csv" else out.format(kind).save(path)


def places(df: DataFrame, path: str, levels: int = 12, files: int | None = None) -> None:
    """SRC2's dataset along a space-filling curve: folders by zone (the first `levels` bits of each coordinate of a place's middle), files and row groups by ranges of the curve.

    readers.places_parquet() turns an extent into zones, so other files are not opened; inside a file the bounds of row groups are narrow. A
    dense zone has several files, as the ranges hold about as many places each. A zone of 12 bits is some 7 km wide at 40 degrees.
    """
    x, y = (F.col("bbox.xmin") + F.col("bbox.xmax")) / 2, (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2
    zone = f"zone_{levels}"
    rows = df.withColumn("_z", geo.morton(x, y)).withColumn(zone, F.shiftright("_z", 2 * (16 - levels)).cast("int"))
    rows = rows.repartitionByRange(files, "_z") if files else rows.repartitionByRange("_z")
    rows.sortWithinPartitions(zone, "_z").drop("_z").write.mode("overwrite").partitionBy(zone).parquet(path)


def vanilla(df: DataFrame, key: str) -> DataFrame:
    """SNK2: the tabular columns alone, without key, coordinates and density record."""
    return df.drop("surroundings", "cats", "landmarks", "lat", "long", "x_m", "y_m", key)


def enriched(df: DataFrame, key: str) -> DataFrame:
    """SNK3: key, tabular columns and the density record as JSON."""
    text = record_json(F.col("cats"), F.col("landmarks")) if "cats" in df.columns else F.col("surroundings")
    return df.withColumn("surroundings", text).drop("cats", "landmarks", "lat", "long", "x_m", "y_m").select(key, *(c for c in df.columns if c not in (key, "surroundings", "cats", "landmarks", "lat", "long", "x_m", "y_m")), "surroundings")


def write_variants(df: DataFrame, key: str, vanilla_path: str, enriched_path: str) -> None:
    """SNK2, SNK3: both variants of one frame, which is computed once: the tabular columns are read from the enriched table."""
    table(enriched(df, key), enriched_path)
    table(vanilla(df.sparkSession.read.parquet(enriched_path), key), vanilla_path)


def record_json(cats: Column, landmarks: Column) -> Column:
    """SNK4: {"cats": {bucket: [doorstep, radius, nearest]}, "landmarks": [[name, metres], ...]}, in the record's order."""
    text = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")
    cat = F.transform(cats, lambda c: F.concat(text(c["bucket"]), F.lit(": ["), F.concat_ws(", ", c["n_doorstep"].cast("string"), c["n_radius"].cast("string"), c["nearest_m"].cast("string")), F.lit("]")))
    mark = F.transform(landmarks, lambda m: F.concat(F.lit("["), text(m["name"]), F.lit(", "), m["dist_m"].cast("string"), F.lit("]")))
    return F.concat(F.lit('{"cats": {'), F.array_join(cat, ", "), F.lit('}, "landmarks": ['), F.array_join(mark, ", "), F.lit("]}"))


def request_lines(requests: DataFrame, path: str) -> None:
    """SNK5: JSON lines in a folder for each batch."""
    requests.select("batch_no", F.col("request").alias("value")).repartition("batch_no").write.mode("overwrite").partitionBy("batch_no").text(path)


def published(df: DataFrame, key: str) -> DataFrame:
    """SNK6: the described table: prose stays, key and density record go."""
    return df.drop("surroundings", "cats", "landmarks", key)
