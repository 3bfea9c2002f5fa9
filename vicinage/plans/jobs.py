"""Whole jobs: clean, enrich, describe, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage import params as P
from vicinage.functions import geo
from vicinage.operators import clean, corpus, enrich, exchange, render, sample
from vicinage.sources import readers, writers
from vicinage.sources.summaries import Summaries
from vicinage.store import once


def clean_job(spark: SparkSession, csv_path: str, out_path: str, key: str | None = None, p: P.Params = P.DEFAULT, seed: int = 0) -> None:
    """Workload 1: scrape CSV to complete listings."""
    raw = readers.scrape_csv(spark, csv_path)
    df = clean.clean_listings(raw, key)
    if key is None:
        key, df = "listing_key", clean.stable_key(df)
    writers.table(df if p.max_listings is None else clean.capped(df, p.max_listings, key, seed), out_path)


def enrich_job(listings: DataFrame, places: DataFrame, taxonomy: DataFrame, landmarks: DataFrame, key: str = "id", p: P.Params = P.DEFAULT) -> DataFrame:
    """Workload 2: listings with cats and landmarks; listings without a place in the radius go.

    Coordinates are x_m, y_m, or lat and long, which are projected. Ids and leaks are dropped first. Places with a
    wkt that is no point are measured to their edge. Records are made once for each position, and kept while listings get theirs.
    """
    own = clean.drop_leaks(listings, (key,))
    if "x_m" not in own.columns:
        x, y = geo.utm(F.col("long"), F.col("lat"), p.utm_zone)
        own = own.withColumns({"x_m": x, "y_m": y})
    sites = enrich.sites(own, key)
    dense = enrich.density_around(sites, enrich.gated(places, taxonomy, p), p, key)
    marks = enrich.landmarks_within(sites, landmarks, p, key)
    kept = tuple(c for c in own.columns if c not in (key, "x_m", "y_m", "lat", "long"))
    found = enrich.spread(once(enrich.records(dense, marks, key)), sites, own, key, kept)
    return found.select(*(f"`{c}`" for c in own.columns if c in (key, *kept)), "cats", "landmarks")


def enrich_files_job(listings: DataFrame, places_path: str, taxonomy: DataFrame, landmarks: DataFrame, key: str = "id", p: P.Params = P.DEFAULT) -> DataFrame:
    """Workload 2 from a places dataset: the listings' extent, with a pad, prunes its row groups. Listings have lat and long in degrees."""
    own = clean.drop_leaks(listings, (key,))
    box = enrich.extent(own, p.pad_degrees)
    if box is None:
        raise ValueError("no listing has coordinates")
    places = readers.places_parquet(listings.sparkSession, places_path, taxonomy, box, p)
    return enrich_job(own, places, taxonomy, landmarks, key, p)


def flat_density(records: DataFrame, key: str = "id") -> DataFrame:
    """(key, bucket, n_doorstep, n_radius, nearest_m, min_dist) from records; min_dist keeps their order."""
    return records.select(key, F.posexplode("cats").alias("_i", "_c")).select(key, "_c.*", F.col("_i").cast("double").alias("min_dist"))


def describe_job(records: DataFrame, cache: DataFrame, view: str, k: int | None = None, seed: int | None = None, key: str = "id", p: P.Params = P.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """EXP2, the way out: (requests, counts) for listings that still lack a summary.

    The corpus reference covers all records, before any choice of rows: k takes the densest, with
    a seed a random sample.
    """
    dense = flat_density(records, key)
    hist = once(corpus.histogram(dense, key=key))
    chosen = records
    if k is not None:
        picked = corpus.densest(dense, k, key).select(key) if seed is None else sample.seeded_sample(records.select(key), k, seed, key)
        chosen = records.join(picked, key, "left_semi")
    todo = exchange.pending(chosen, cache, key)
    texts = render.prompts(todo, view, hist, p=p, key=key)
    counts = exchange.attach_cached(chosen.select(key), cache, key).agg(F.count("*").alias("chosen"), F.count("summary").alias("cached"), F.count_if(F.col("summary").isNull()).alias("pending"))
    return exchange.requests(texts, system_text(view), p, key), counts


#: What each view's text asks for, in our own words.
ASKS = {
    "deviation": "Say in one or two sentences in which ways the block differs from a typical one, keeping the strength of each listed difference.",
    "deviation_exact": "Say in one or two sentences where the block ranks among all blocks, and repeat the percentages as they are given.",
    "proximity": "Say in one or two sentences what is close by, with the nearest kinds of place first and their distance words as given.",
    "composition": "Say in one or two sentences what the block mostly consists of, in the order given.",
    "landmarks": "Say in one or two sentences which well-known places are near and how near; if there are none, say so.",
    "combined": "Describe the block in two or three sentences: how it differs, what is close by, what it consists of, and well-known places.",
}
_RULES = "Use only what is given, copy any listed name exactly, no price or rating, plain text."


def system_text(view: str) -> str:
    return f"{ASKS[view]} {_RULES}"


def collect_job(records: DataFrame, cache: DataFrame | Summaries, batches: DataFrame, key: str = "id", batch: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EXP2, the way back: (new cache, described table, counts of listings with a summary and of those still missing one).

    A stored cache gets the answers as a batch of that number, and only the buckets that they touch are rewritten.
    """
    new = exchange.merge_results(records.select(key), readers.result_rows(batches), key)
    if isinstance(cache, Summaries):
        cache.upsert(new, batch)
        held = cache.read()
    else:
        held = once(exchange.upsert(cache, new, key))
    described = exchange.attach_cached(records, held, key)
    counts = described.agg(F.count("summary").alias("described"), F.count_if(F.col("summary").isNull()).alias("missing"))
    return held, writers.published(described, key), counts


def retry_job(records: DataFrame, drafts: DataFrame, view: str, hist: DataFrame | None = None, key: str = "id", p: P.Params = P.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """EXP2, once more: (accepted drafts, requests with a note) for drafts(key, summary).

    A draft that names a place which is not among the record's landmarks is asked for again, with the names in a note.
    The caller sends the requests, and stops after as many rounds as it wants.
    """
    known = F.transform("landmarks", lambda x: x["name"])
    read = once(drafts.join(records.select(key, "landmarks"), key).select(key, "summary", exchange.ungrounded(F.col("summary"), known).alias("_bad")))
    again = read.where(F.size("_bad") > 0).select(key, exchange.retry_note(F.col("_bad")).alias("_note"))
    texts = render.prompts(records.join(again, key), view, hist, F.col("_note"), p, key)
    return read.where(F.size("_bad") == 0).select(key, "summary"), exchange.requests(texts, system_text(view), p, key)


def variants_job(records: DataFrame, prompts: DataFrame, n: int, seed: int, path: str, columns: list[str], key: str = "id") -> None:
    """EXP1: one sample, one dataset a prompt, written by prompt_id."""
    rows = sample.prompt_variants(sample.stratified(records, n, seed, key=key), prompts)
    sample.variant_dataset(rows.withColumn("summary", F.col("system")), columns).write.mode("overwrite").partitionBy("prompt_id").parquet(path)
