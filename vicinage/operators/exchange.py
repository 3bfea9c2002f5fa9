"""What goes to an external text service and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage import params as P
from vicinage.store import once

# What counts as a name in prose (with Unicode letters), and the note on names that are not in the data.
_NAME = r"(?U)[A-Z][\w&'’]+(?:\s+[A-Z][\w&'’]+)*"
_NOTE = ("\n\nYour previous draft named places NOT in the list: ", ". Rewrite naming ONLY the listed places.")


def last_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, and seq if there is one): of each key's values that are not null the one with the greatest seq; of equal or no seq the greatest value, so that reruns agree."""
    rows = rows.where(F.col(value).isNotNull())
    if "seq" not in rows.columns:
        return rows.groupBy(key).agg(F.max(value).alias(value))
    return rows.groupBy(key).agg(F.max(F.struct("seq", value)).alias("_m")).select(key, f"_m.{value}", "_m.seq")


def usable(cache: DataFrame, key: str = "id", summary: str = "summary") -> DataFrame:
    """(key, summary): one summary a key, the last one."""
    return last_of(cache, key, summary).select(key, summary)


def attach_cached(listings: DataFrame, cache: DataFrame, key: str = "id", summary: str = "summary") -> DataFrame:
    """JON6: listings with the cached summary, null where there is none."""
    return listings.drop(summary).join(usable(cache, key, summary), key, "left")


def pending(listings: DataFrame, cache: DataFrame, key: str = "id", summary: str = "summary") -> DataFrame:
    """JON7: listings without a cached summary."""
    return listings.join(cache.where(F.col(summary).isNotNull()), key, "left_anti")


def upsert(cache: DataFrame, new: DataFrame, key: str = "id", summary: str = "summary") -> DataFrame:
    """SET2: the cache with the new summaries, which win; it never loses a key. For a cache that is stored, see summaries.Summaries, which rewrites only what changes."""
    fresh = usable(new, key, summary)
    return fresh.unionByName(usable(cache, key, summary).join(fresh, key, "left_anti").select(key, summary))


def batched(rows: DataFrame, size: int, key: str = "id", part_rows: int = 100_000) -> DataFrame:
    """WIN4: rows with batch_no, `size` rows a batch in the order of (part, key).

    Rows are numbered inside hash parts of about part_rows rows and moved up by the parts before, so no task numbers them all.
    """
    rows = once(rows)
    parts = max(1, -(-rows.count() // part_rows))
    part = rows.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(parts)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    number = F.col("_o") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return part.join(offsets, "_p").withColumn("batch_no", F.floor(number / size).cast("int")).drop("_p", "_o")


def requests(prompts: DataFrame, system: Column | str, p: P.Params = P.DEFAULT, key: str = "id", temperature: float = 0.0) -> DataFrame:
    """SNK5: (batch_no, custom_id, request): a JSON line for each prompt."""
    system = F.lit(system) if isinstance(system, str) else system
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(F.array(message("system", system), message("user", F.col("text"))).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(p.max_tokens).alias("max_tokens"), F.struct(F.lit(True).alias("include")).alias("usage"))
    rows = batched(prompts, p.batch_size, key).withColumn("custom_id", F.col(key).cast("string"))
    return rows.select("batch_no", "custom_id", F.to_json(F.struct("custom_id", body.alias("body"))).alias("request"))


def merge_results(listings: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """JON8: (key, summary, and seq if results have one) of results whose id is a listing's; of several the last answer stays."""
    known = listings.select(F.col(key), F.col(key).cast("string").alias("custom_id"))
    found = last_of(results, "custom_id", "content").withColumnRenamed("content", "summary")
    return known.join(found, "custom_id").select(key, *(c for c in ("summary", "seq") if c in found.columns))


def usage(results: DataFrame, by: tuple[str, ...] = (), done: int | None = None, p: P.Params = P.DEFAULT) -> DataFrame:
    """AGG11: calls, tokens and cost, per listing and for the full size; the reported cost unless it is 0."""
    sums = results.groupBy(*by).agg(F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("tokens_out"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("reported"), F.count("content").alias("_done"))
    estimate = F.col("tokens_in") * p.price_in + F.col("tokens_out") * p.price_out
    cost = F.when(F.col("reported") != 0, F.col("reported")).otherwise(estimate)
    per = cost / F.greatest(F.lit(done).cast("long") if done is not None else F.col("_done"), F.lit(1))
    return sums.select(*by, "calls", "tokens_in", "tokens_out", "reported", estimate.alias("estimate"), cost.alias("cost"), (per * 1000).alias("per_1k"), (per * p.full_size).alias("full_cost"))


def ungrounded(summary: Column, names: Column) -> Column:
    """FLT6: capitalised names in a text that no known name contains or is contained in."""
    lowered = F.transform(names, lambda n: F.lower(n))
    candidates = F.regexp_extract_all(F.coalesce(summary, F.lit("")), F.lit(_NAME), F.lit(0))
    return F.filter(candidates, lambda c: (F.length(c) > 3) & ~F.exists(lowered, lambda n: n.contains(F.lower(c)) | F.lower(c).contains(n)))


def retry_note(names: Column) -> Column:
    """TXT9: the note for a draft that names places that are not in the list."""
    listed = F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))
    return F.concat(F.lit(_NOTE[0]), listed, F.lit(_NOTE[1]))
