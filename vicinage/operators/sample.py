"""Samples that are the same at every run, and variants over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def seeded_sample(df: DataFrame, k: int, seed: int, key: str = "id") -> DataFrame:
    """TOP3: k rows by the hash of their key, in the order of the key."""
    return df.orderBy(draw(key, seed), key).limit(k).orderBy(key)


def stratified(df: DataFrame, n: int, seed: int, strata: tuple[str, ...] = ("neighbourhood", "room_type"), key: str = "id", total: int | None = None) -> DataFrame:
    """WIN5: about n rows, each stratum giving its share rounded half to even; all rows if there are no more than n.

    The stratum is the first of `strata` that is a column. Rows are first thinned out by a hash
    bound somewhat above the share, so that the ordering inside a large stratum sees few rows; in one of some
    10^20 draws a stratum gives fewer rows than its share for that. Rows without a key are never drawn.
    """
    total = df.count() if total is None else total
    if n >= total:
        return df
    stratum = next((F.col(c) for c in strata if c in df.columns), F.lit("all"))
    rows = df.withColumns({"_s": stratum.cast("string"), "_d": draw(key, seed)})
    sizes = rows.groupBy("_s").agg(F.count("*").alias("_c")).withColumn("_want", F.rint(F.lit(n / total) * F.col("_c")).cast("long"))
    rows = rows.join(sizes.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    # ten standard deviations above the share
    share = (F.col("_want") + 10 * F.sqrt(F.col("_want")) + 50) / F.col("_c")
    rows = rows.where(F.conv(F.substring("_d", 1, 8), 16, 10).cast("double") / float(1 << 32) < share)
    order = Window.partitionBy("_s").orderBy("_d", key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("_want")).drop("_s", "_d", "_c", "_want", "_n")


def prompt_variants(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """JON9: every row with every prompt; prompts(prompt_id, system) has FEW rows at most."""
    return rows.crossJoin(few(prompts))


#: Rows of a table that every row is paired with.
FEW = 10_000


def few(dim: DataFrame) -> DataFrame:
    """dim, after a check that it is as small as a table of prompts or models."""
    if dim.limit(FEW + 1).count() > FEW:
        raise ValueError(f"a table of more than {FEW} variants")
    return dim


def model_dim(models: DataFrame) -> DataFrame:
    """TXT11: models(slug) with base (without the batch suffix) and kind."""
    base = F.regexp_replace("slug", ":batch$", "")
    low = F.lower(base)
    thinks = low.contains("gpt-5") | (low.contains("gemini-3") & ~low.contains("lite"))
    return models.withColumns({"base": base, "kind": F.when(thinks, "thinking").otherwise("plain")})


def model_variants(rows: DataFrame, models: DataFrame) -> DataFrame:
    """JON10: every row with every model."""
    return rows.crossJoin(model_dim(few(models)))


def variant_dataset(described: DataFrame, columns: list[str], summary: str = "summary") -> DataFrame:
    """EXP1: the fixed columns and the prose of a variant; a missing column is an error."""
    missing = [c for c in columns if c not in described.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return described.select(*(c for c in ("prompt_id",) if c in described.columns), *columns, summary)
