"""Categories to signal buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage import params as P


def bucket(leaf: Column, path: Column) -> Column:
    """PRJ6: the bucket of a category; path is null for an unknown one. Rules apply from the top."""
    group = F.coalesce(F.get(path, F.lit(0)), leaf)
    sub = F.coalesce(F.get(path, F.lit(1)), group)
    eat = F.when(sub == "bar", "nightlife").when(sub == "cafe", "cafe").otherwise("dining")
    see = F.when(sub.isin(*P.PARKS), "park_green").when(sub.isin(*P.CULTURE), "culture").otherwise("landmark")
    return (
        F.when(leaf.isin(*P.TRANSIT), "transit")
        .when(leaf.isin(*P.GROCERY), "grocery")
        .when(group == "accommodation", "lodging")
        .when(group == "eat_and_drink", eat)
        .when(group == "retail", "shopping")
        .when(group == "active_life", "fitness_sport")
        .when(group == "arts_and_entertainment", "entertainment")
        .when(group == "attractions_and_activities", see)
        .otherwise(group)
    )


def allowed_leaves(taxonomy: DataFrame) -> DataFrame:
    """FLT4, SET1: categories of the kept groups, and the transit ones."""
    kept = taxonomy.where(F.get("path", F.lit(0)).isin(*P.KEPT_GROUPS)).select("leaf")
    transit = taxonomy.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, P.TRANSIT))).alias("leaf"))
    return kept.union(transit).distinct()


def leaf_dim(taxonomy: DataFrame) -> DataFrame:
    """(leaf, bucket, allowed) of every category of the taxonomy: the small side of JON3."""
    path, leaf = F.col("path"), F.col("leaf")
    allowed = F.coalesce(F.get(path, F.lit(0)).isin(*P.KEPT_GROUPS), F.lit(False)) | leaf.isin(*P.TRANSIT)
    return taxonomy.select("leaf", bucket(leaf, path).alias("bucket"), allowed.alias("allowed")).dropDuplicates(["leaf"])


def with_bucket(places: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """JON3: places with the bucket of their category; an unknown category is its own bucket."""
    dim = leaf_dim(taxonomy).select(F.col("leaf").alias("category"), "bucket")
    return places.join(dim, "category", "left").withColumn("bucket", F.coalesce("bucket", bucket(F.col("category"), F.lit(None).cast("array<string>"))))
