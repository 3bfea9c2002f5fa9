"""Band distributions over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions import phrases


def _shares(rows: DataFrame, weight: str | None) -> DataFrame:
    """(bucket, band, n, share): share of the bucket's listings, in percent; with a weight, a row stands for so many listings."""
    counts = rows.groupBy("bucket", "band").agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    return counts.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("bucket")))


def deviation_bands(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """AGG8: every listing falls into one band of each bucket."""
    return _shares(scored.select("bucket", phrases.band(F.col("n_radius"), F.col("pct")).alias("band"), *([weight] if weight else [])), weight)


def proximity_bands(dense: DataFrame, weight: str | None = None) -> DataFrame:
    """AGG9: over listings that have the bucket."""
    return _shares(dense.select("bucket", phrases.proximity_band(F.col("nearest_m")).alias("band"), *([weight] if weight else [])), weight)
