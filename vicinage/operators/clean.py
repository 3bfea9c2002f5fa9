"""Scraped listings to typed, complete rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage import params as P


def select_aliases(df: DataFrame, keep: tuple[str, ...] = (), aliases: dict[str, tuple[str, ...]] = P.ALIASES) -> DataFrame:
    """PRJ1: the targets whose first present alias exists, after the columns to keep."""
    found = [(next((a for a in names if a in df.columns), None), target) for target, names in aliases.items()]
    chosen = [F.col(f"`{a}`").alias(target) for a, target in found if a]
    if not chosen:
        raise ValueError("no known listing column in the input")
    return df.select(*keep, *chosen)


def number(text: Column) -> Column:
    """A double, or null where the text is none; NaN is null too."""
    v = text.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def set_types(df: DataFrame) -> DataFrame:
    """PRJ2: money, numbers and flags from text; malformed text becomes null."""
    typed = {c: number(F.col(c)) for c in P.NUMBERS if c in df.columns}
    typed |= {c: F.trim(F.col(c).cast("string")).try_cast("boolean") for c in P.FLAGS if c in df.columns}
    if "price" in df.columns:
        typed["price"] = number(F.regexp_replace(F.col("price").cast("string"), "[$,]", ""))
    return df.withColumns(typed)


def derive_rooms(df: DataFrame) -> DataFrame:
    """PRJ3: room counts from their columns, else from the details text; the sources go."""

    def count(source: str, pattern: str) -> Column:
        text = F.coalesce(F.col("details"), F.lit("")) if "details" in df.columns else F.lit("")
        said = number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))
        return F.coalesce(F.col(source), said) if source in df.columns else said

    out = df.withColumns({"num_bedrooms": count("bedrooms", P.BEDROOMS_TOLD), "num_baths": count("bathrooms", P.BATHS_TOLD)})
    return out.drop("bedrooms", "details")


def valid_prices(df: DataFrame) -> DataFrame:
    """FLT1: prices above 0; NaN counts as missing."""
    return df.where((F.nanvl(F.col("price"), F.lit(None).cast("double"))) > 0)


def complete_rows(df: DataFrame) -> DataFrame:
    """FLT2: rows without a null or NaN in any column."""
    return df.na.drop("any")


#: Rows that are put in order to settle which of those with the bound's own digits stay.
EDGE = 1_000


def capped(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """TOP2, TOP3: n rows picked by the hash of their key, then of their content; the same ones at every run, and all of them if there are no more than n.

    The bound is found by counting rows by their hash's first digits, and again inside the digits that the bound falls into until at
    most EDGE rows have them; then one filter keeps what lies below, and only the rows on the bound are put in order. The driver
    gets 65,536 counts a time at most.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(f"`{key}`").cast("string")).cast("binary"))
    content = F.lpad(F.lower(F.hex(F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns))))), 16, "0")
    rows = df.withColumn("_draw", F.concat(F.coalesce(draw, F.lit("")), content))
    prefix, left = "", n
    while True:
        at = len(prefix) + 4
        digits = F.substring("_draw", 1, at)
        counts = sorted((r["d"], r["n"]) for r in rows.where(F.col("_draw").startswith(prefix)).groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect())
        if not prefix and sum(c for _, c in counts) <= n:
            return df
        for bound, size in counts:
            if size > left:
                break
            left -= size
        if size <= EDGE or at >= 48 or len(bound) < at:
            break
        prefix = bound
    below = rows.where(F.col("_draw") < bound)
    edge = rows.where(F.col("_draw").startswith(bound))
    if size > EDGE:  # all digits are equal, so are the rows: one of them stands for all
        edge = edge.limit(1).crossJoin(df.sparkSession.range(left).select(F.lit(None).alias("_again"))).drop("_again")
    elif left:
        edge = edge.orderBy("_draw").limit(left)
    return (below.unionByName(edge) if left else below).drop("_draw")


def clean_listings(raw: DataFrame, key: str | None = None, cap: int | None = None, seed: int = 0) -> DataFrame:
    """Workload 1 after the read: aliases, types, rooms, prices, complete rows, cap."""
    df = derive_rooms(set_types(select_aliases(raw, (key,) if key else ())))
    df = complete_rows(valid_prices(df) if "price" in df.columns else df)
    if cap is None:
        return df
    return capped(df, cap, key, seed) if key else capped(stable_key(df, "_key"), cap, "_key", seed).drop("_key")


def stable_key(df: DataFrame, name: str = "listing_key") -> DataFrame:
    """PRJ11: a key from the row's content, for tables that come without one."""
    return df.withColumn(name, F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns))))


def drop_leaks(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ4: without id-like columns, and with coordinates named lat and long."""
    renamed = df.withColumnsRenamed({"latitude": "lat", "longitude": "long"})
    return renamed.drop(*(c for c in P.LEAKS if c not in keep))
