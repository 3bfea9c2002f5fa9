"""The registered queries: each applies operators to the driver's tables and returns flat rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage import params as P
from vicinage.functions import geo, phrases
from vicinage.operators import clean, corpus, enrich, exchange, features, histograms, render, sample
from vicinage.operators.taxonomy import allowed_leaves, with_bucket
from vicinage.plans import fixtures as fx
from vicinage.plans import jobs
from vicinage.sources import readers, writers
from vicinage.sources.summaries import Summaries
from vicinage.store import fresh, once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings' positions. Up to _spread(), id is a position's number."""
    return enrich.sites(fx.listings(spark, sf_dir))


def _spread(found: DataFrame, sites: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.spread(found, sites, fx.listings(spark, sf_dir))


def _dense(sites: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.density_around(sites, enrich.gated(fx.places(spark, sf_dir), fx.taxonomy(spark)))


def _marks(sites: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.landmarks_within(sites, fx.landmarks(spark, sf_dir))


def _records(sites: DataFrame, spark: SparkSession, sf_dir: str, dense: DataFrame | None = None) -> DataFrame:
    return enrich.records(_dense(sites, spark, sf_dir) if dense is None else dense, _marks(sites, spark, sf_dir))


def _corpus(sites: DataFrame, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Density, and the corpus' histogram, both computed once."""
    dense = once(_dense(sites, spark, sf_dir))
    return dense, once(_histogram(dense, sites))


def _histogram(dense: DataFrame, sites: DataFrame) -> DataFrame:
    """The histogram of all listings from the density of their positions."""
    rows = enrich.weighted(dense, sites)
    return corpus.histogram(rows, corpus.size(rows, weight="n_rows"), weight="n_rows")


def _lists(sites: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, hist = _corpus(sites, spark, sf_dir)
    return corpus.scored_lists(enrich.cat_lists(dense), hist)


def _scored(sites: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, hist = _corpus(sites, spark, sf_dir)
    return corpus.scored(enrich.cat_lists(dense), hist)


@query
def clean_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_listings(fx.raw_listings(spark, sf_dir), "id")


@query
def clean_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_listings(fx.raw_listings(spark, sf_dir), "id", cap=100).select("id")


@query
def taxonomy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = fx.taxonomy(spark)
    places = with_bucket(fx.places(spark, sf_dir), tax)
    kept = allowed_leaves(tax).withColumn("allowed", F.lit(True))
    counts = places.groupBy(F.col("category").alias("leaf"), "bucket").agg(F.count("*").alias("n"))
    return counts.join(kept, "leaf", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


@query
def places_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = fx.places(spark, sf_dir)
    box = enrich.extent(fx.listings(spark, sf_dir), 0.0, "x_m", "y_m")
    return enrich.gated(places, fx.taxonomy(spark), box=box).select("poi_id", "bucket")


@query
def listing_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship."""
    sites = _sites(spark, sf_dir)
    return _spread(_dense(sites, spark, sf_dir).drop("min_dist"), sites, spark, sf_dir)


@query
def listing_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings near landmark outlines taken as places, by grid cells of their boxes."""
    shapes = fx.landmarks(spark, sf_dir).select(F.col("ord").cast("long").alias("poi_id"), "wkt")
    return enrich.shapes_within(fx.listings(spark, sf_dir), shapes, P.DEFAULT.radius).select("id", "poi_id", F.rint("dist").cast("int").alias("dist_m"))


@query
def listing_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    lists = enrich.landmark_lists(_marks(sites, spark, sf_dir))
    rows = lists.select("id", F.posexplode("landmarks").alias("rank", "_l")).select("id", (F.col("rank") + 1).alias("rank"), "_l.name", "_l.dist_m")
    return _spread(rows, sites, spark, sf_dir)


@query
def density_record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    text = _records(sites, spark, sf_dir).select("id", writers.record_json(F.col("cats"), F.col("landmarks")).alias("record"))
    return _spread(text, sites, spark, sf_dir)


@query
def density_record_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from their text, with the place of each bucket in it."""
    sites = _sites(spark, sf_dir)
    text = _records(sites, spark, sf_dir).select("id", readers.parse_record(writers.record_json(F.col("cats"), F.col("landmarks"))).alias("r"))
    rows = text.select("id", F.size("r.landmarks").alias("n_landmarks"), F.posexplode("r.cats").alias("place", "_c")).select("id", "n_landmarks", "place", "_c.*")
    return _spread(rows, sites, spark, sf_dir)


@query
def total_places_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return corpus.top(_spread(corpus.totals(_dense(sites, spark, sf_dir)), sites, spark, sf_dir), 50)


@query
def corpus_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return _histogram(once(_dense(sites, spark, sf_dir)), sites).select("bucket", "cnt", "n", "present_frac")


@query
def histogram_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus whose gate was stricter once and which lacked a neighbourhood, brought up to date in two steps without reading it again."""
    rows, places = fx.listings(spark, sf_dir), enrich.gated(fx.places(spark, sf_dir), fx.taxonomy(spark))
    sites = enrich.sites(rows)
    new, old = once(enrich.density_around(sites, places)), once(enrich.density_around(sites, places.where("confidence >= 0.8")))
    # a position has as many rows as listings of the kind that a step is about; a listing is of one kind, however often it comes
    kinds = once(enrich.members(rows, sites, least=("neighbourhood",)).groupBy(F.col("_site").alias("id"), "neighbourhood").agg(F.count("*").alias("n")))
    part = lambda dense, kind: enrich.weighted(dense, kinds.where(kind).groupBy("id").agg(F.sum("n").alias("n_rows")))
    at = {"weight": "n_rows"}
    held = corpus.counts(part(old, "neighbourhood IS NULL OR neighbourhood <> 7"), **at)
    held = corpus.changed(held, part(old, "neighbourhood < 7"), part(new, "neighbourhood < 7"), **at)
    held = corpus.changed(held, part(old, "neighbourhood > 7"), part(new, "neighbourhood IS NULL OR neighbourhood >= 7"), **at)
    return corpus.from_counts(held).select("bucket", "cnt", "n", "present_frac")


@query
def strict_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return _spread(_scored(sites, spark, sf_dir).select("id", "bucket", "pct"), sites, spark, sf_dir)


@query
def deviations_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return _spread(render.deviations(_lists(sites, spark, sf_dir)), sites, spark, sf_dir)


@query
def deviations_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return _spread(render.deviations(_lists(sites, spark, sf_dir), exact=True), sites, spark, sf_dir)


def _view(view: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sites = _sites(spark, sf_dir)
        dense, hist = _corpus(sites, spark, sf_dir) if view in render.RELATIVE else (None, None)
        return _spread(render.prompts(_records(sites, spark, sf_dir, dense), view, hist), sites, spark, sf_dir)

    return run


QUERIES |= {f"view_{v}": _view(v) for v in P.VIEWS}


@query
def band_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return histograms.deviation_bands(enrich.weighted(_scored(sites, spark, sf_dir), sites), "n_rows")


@query
def proximity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return histograms.proximity_bands(enrich.weighted(_dense(sites, spark, sf_dir), sites), "n_rows")


def _facts(sites: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("poi_id", F.lit(4))
    kinds = {c: F.when(kind == i, F.col("category")).when(kind == (i + 1) % 4, F.lit("")) for i, c in enumerate(render.KINDS)}
    told = enrich.gated(fx.places(spark, sf_dir), fx.taxonomy(spark)).withColumns(kinds).select("poi_id", "name", *render.KINDS, "x_m", "y_m")
    return render.facts_around(sites, once(render.name_ids(told)), P.DEFAULT.radius)


@query
def place_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    rows = _facts(sites, spark, sf_dir).select("id", F.size("names").alias("n_names"), F.explode("kinds").alias("_k")).select("id", "n_names", "_k.*")
    return _spread(rows, sites, spark, sf_dir)


@query
def facts_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return _spread(render.facts_block(_facts(sites, spark, sf_dir)), sites, spark, sf_dir)


def _prompts(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return _spread(render.prompts(_records(sites, spark, sf_dir), view), sites, spark, sf_dir)


@query
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of a batch a listing gets follows a hash; the sizes and the request texts are fixed."""
    p = P.Params(batch_size=100)
    sent = exchange.requests(_prompts(spark, sf_dir, "proximity"), "Describe the block.", p)
    request = F.from_json("request", "custom_id STRING, body STRUCT<messages:ARRAY<STRUCT<role:STRING,content:STRING>>,temperature:DOUBLE,max_tokens:INT,usage:STRUCT<include:BOOLEAN>>")
    sizes = sent.groupBy("batch_no").agg(F.count("*").alias("batch_rows"))
    body = sent.select("batch_no", "custom_id", request.alias("r")).join(sizes, "batch_no")
    return body.select("custom_id", F.col("r.body.messages")[0]["role"].alias("first_role"), F.col("r.body.messages")[1]["content"].alias("prompt"), F.col("r.body.max_tokens").alias("max_tokens"), (F.col("batch_rows") <= 100).alias("within"))


@query
def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON lines in a folder a batch, and what a service reads there."""
    path = fresh(spark, "requests")
    sent = exchange.requests(_prompts(spark, sf_dir, "landmarks"), "Describe the block.", P.Params(batch_size=100))
    writers.request_lines(sent, path)
    line = F.from_json("value", "custom_id STRING, body STRUCT<messages:ARRAY<STRUCT<role:STRING,content:STRING>>>")
    rows = readers.request_lines(spark, path).select("batch_no", line.alias("r"))
    sizes = rows.groupBy("batch_no").agg(F.count("*").alias("_n"))
    return rows.join(sizes, "batch_no").select("r.custom_id", F.col("r.body.messages")[1]["content"].alias("prompt"), (F.col("_n") <= 100).alias("within"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.result_rows(fx.result_batches(spark, sf_dir))


@query
def batch_results_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.merge_results(fx.listings(spark, sf_dir), _results(spark, sf_dir))


@query
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = exchange.merge_results(fx.listings(spark, sf_dir), _results(spark, sf_dir))
    return exchange.upsert(fx.cache(spark, sf_dir), new)


@query
def summary_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of summaries that two batches of answers are added to, many answers to a listing; the first batch comes twice."""
    held = Summaries(spark, fresh(spark, "summaries"), buckets=16)
    held.upsert(fx.cache(spark, sf_dir), 0)
    answers = fx.answers(spark, sf_dir)
    for batch in (1, 1, 2):
        held.upsert(exchange.merge_results(fx.listings(spark, sf_dir), readers.result_rows(answers.where(F.col("batch") == batch))).withColumn("seq", F.lpad(F.col("seq.seq").cast("string"), 20, "0")), batch)
    return held.read()


@query
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.pending(fx.listings(spark, sf_dir), fx.cache(spark, sf_dir)).select("id")


@query
def cached_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.attach_cached(fx.listings(spark, sf_dir), fx.cache(spark, sf_dir)).select("id", "summary")


@query
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.lit("model-"), F.pmod(F.col("custom_id").cast("long"), F.lit(3)).cast("string"))
    rows = _results(spark, sf_dir).withColumn("model", model).withColumn("cost", F.when(F.col("model") == "model-1", 0.0).otherwise(F.col("cost")))
    out = exchange.usage(rows, ("model",))
    return out.select("model", "calls", "tokens_in", "tokens_out", F.round("cost", 6).alias("cost"), F.round("per_1k", 3).alias("per_1k"), F.round("full_cost", 2).alias("full_cost"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names in each document that are not on a short list of its own."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    allowed = F.array(F.lit("The"), F.lit("Place 1"), F.concat(F.lit("Thea"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", exchange.ungrounded(F.col("text"), allowed).alias("names"))


@query
def ungrounded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", F.explode("names").alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query
def retry_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).where(F.size("names") > 0).select("doc_id", exchange.retry_note(F.col("names")).alias("note"))


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.listings(spark, sf_dir)
    n = df.count()
    return sample.stratified(df, n // 10, 7, total=n).select("id", F.col("neighbourhood").alias("stratum"))


@query
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.seeded_sample(fx.listings(spark, sf_dir), 40, 7).select("id", F.col("room_type").alias("stratum"))


@query
def prompt_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = fx.table(spark, sf_dir, "region").select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("prompt_id"), F.col("r_name").alias("system"))
    rows = sample.prompt_variants(fx.listings(spark, sf_dir), prompts).withColumn("summary", F.concat_ws(": ", "system", "room_type"))
    return sample.variant_dataset(rows, ["id", "room_type"])


@query
def variant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets on disk, one a prompt, over one sample."""
    path, rows = fresh(spark, "variants"), fx.listings(spark, sf_dir)
    prompts = fx.table(spark, sf_dir, "region").select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("prompt_id"), F.col("r_name").alias("system"))
    jobs.variants_job(rows, prompts, rows.count() // 10, 7, path, ["id", "room_type"])
    return spark.read.parquet(path)


@query
def model_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.concat(F.element_at(F.array(F.lit("openai/gpt-5.6-luna"), F.lit("google/gemini-3.7-flash"), F.lit("google/gemini-3-flash-lite"), F.lit("google/gemini-2.5-flash-lite")), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int")), F.when(F.col("s_suppkey") % 2 == 0, ":batch").otherwise(""))
    models = fx.table(spark, sf_dir, "supplier").select(slug.alias("slug")).distinct()
    return sample.model_variants(fx.listings(spark, sf_dir).select("id"), models).select("id", "slug", "base", "kind")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.derive_rooms(clean.set_types(clean.select_aliases(fx.raw_listings(spark, sf_dir), ("id",))))


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.raw_listings(spark, sf_dir)
    return features.column_profile(df, [c for c in df.columns if c != "id"])


@query
def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.median_fill(_features(spark, sf_dir), ["price", "num_bedrooms", "num_baths"]).select("id", "price", "num_bedrooms", "num_baths")


@query
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.encode(_features(spark, sf_dir).select("id", F.when(F.col("id") % 9 != 0, F.col("room_type")).alias("room_type")), "room_type")


@query
def structured_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.structured(_features(spark, sf_dir), "id", ("price",))


@query
def condition_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _features(spark, sf_dir).withColumn("summary", F.concat(F.lit("Text "), F.col("room_type")))
    sets = [s.withColumn("condition", F.lit(name)) for name, s in features.condition_sets(df, "id", "price", "summary").items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)


@query
def condition_sets_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a picture's name as a modality."""
    df = _features(spark, sf_dir).withColumns({"summary": F.concat(F.lit("Text "), F.col("room_type")), "image": F.concat(F.col("id").cast("string"), F.lit(".jpg"))})
    sets = [s.withColumn("condition", F.lit(name)) for name, s in features.condition_sets(df, "id", "price", "summary", "image").items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)


@query
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.criteria(fx.eval_report(spark, sf_dir))


@query
def eligibility_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.verdict_of_both(fx.eval_report(spark, sf_dir))


@query
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates around New York, in centimetres."""
    lon, lat = -74.25 + (F.col("c_custkey") * 37 % 1000) / 1000.0 * 0.55, 40.5 + (F.col("c_custkey") * 61 % 1000) / 1000.0 * 0.4
    x, y = geo.utm(lon, lat, P.DEFAULT.utm_zone)
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.rint(x * 100).cast("long").alias("east_cm"), F.rint(y * 100).cast("long").alias("north_cm"))


@query
def bucket_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and proximity words of every listing's buckets."""
    sites = _sites(spark, sf_dir)
    told = _dense(sites, spark, sf_dir).select("id", phrases.label(F.col("bucket")).alias("label"), phrases.proximity(F.col("nearest_m")).alias("near"))
    return _spread(told, sites, spark, sf_dir)


@query
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are numbered without gaps and full, but for the last."""
    return exchange.batched(fx.listings(spark, sf_dir), 64, part_rows=500).groupBy("batch_no").agg(F.count("*").alias("n"))


@query
def scrape_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings written as CSV with line ends and quotes in a field, and read as a scrape."""
    path = fresh(spark, "scrape")
    text = F.concat("bathrooms_text", F.lit('\n"as told"'))
    writers.table(fx.raw_listings(spark, sf_dir).withColumn("bathrooms_text", text), path, "csv")
    return readers.scrape_csv(spark, path)


@query
def clean_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workload 1 from scrape files to the table."""
    path = fresh(spark, "clean")
    writers.table(fx.raw_listings(spark, sf_dir).drop("id"), f"{path}/scrape", "csv")
    jobs.clean_job(spark, f"{path}/scrape", f"{path}/table", p=P.Params(max_listings=None))
    return spark.read.parquet(f"{path}/table").drop("listing_key")


@query
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys stand for so many equal rows."""
    rows = clean.stable_key(clean.clean_listings(fx.raw_listings(spark, sf_dir)))
    return rows.groupBy("listing_key").agg(F.count("*").alias("n_rows")).groupBy("n_rows").agg(F.count("*").alias("n_keys"))


@query
def leaks_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = [F.concat(F.lit("x"), F.col("id").cast("string")).alias(c) for c in ("name", "host_id", "host_name", "license", "last_review")]
    rows = fx.listings(spark, sf_dir).select("id", *who, "room_type", F.col("y_m").alias("latitude"), F.col("x_m").alias("longitude"))
    return clean.drop_leaks(rows).withColumnsRenamed({"lat": "y", "long": "x"})


@query
def taxonomy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy of parts, written with a header, a byte order mark and a short line."""
    path = fresh(spark, "taxonomy")
    leaf = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))
    lines = fx.table(spark, sf_dir, "part").select(F.concat(leaf, F.lit(" ; ["), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit(", "), F.lower("p_brand"), F.lit(","), leaf, F.lit("]")).alias("value"))
    head = spark.range(1).select(F.explode(F.array(F.lit("\ufeffCategory code; Taxonomy"), F.lit("short"))).alias("value"))
    head.unionByName(lines).write.text(path)
    return readers.taxonomy_csv(spark, path).select("leaf", F.array_join("path", "/").alias("path"))


@query
def landmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks in one JSON object, read back and joined with all listings. Such a file is a curated list, so one task reads it."""
    path = fresh(spark, "landmarks")
    one = F.concat(F.regexp_replace(F.to_json(F.array("name")), r"^\[|\]$", ""), F.lit(': {"type": "Polygon", "wkt": "'), F.col("wkt"), F.lit('"}'))
    lines = fx.landmarks(spark, sf_dir).select("ord", one.alias("_e")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_e"))), lambda x: x["_e"]).alias("_l"))
    lines.select(F.concat(F.lit('{"landmarks": {'), F.array_join("_l", ", "), F.lit("}}")).alias("value")).write.text(path)
    found = enrich.landmarks_within(fx.listings(spark, sf_dir), readers.landmarks_json(spark, path, None))
    return found.select("id", "ord", "name", "dist_m")


def _places_files(spark: SparkSession, sf_dir: str) -> str:
    """Places around New York in a nested dataset, as points in degrees."""
    path = fresh(spark, "places")
    places = spark.sql(fx.PLACES_DEGREES_SQL, orders=fx.table(spark, sf_dir, "orders"), taxonomy=fx.taxonomy(spark))
    at = F.struct(F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax"))
    point = F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    nested = places.select(F.col("poi_id").alias("id"), F.struct(F.col("name").alias("primary")).alias("names"), F.struct(F.col("category").alias("primary")).alias("categories"), at.alias("bbox"), "confidence", point.alias("geometry"))
    writers.places(nested, path)
    return path


@query
def places_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a nested dataset in a box, with their place on the metric plane in decimetres."""
    rows = readers.places_parquet(spark, _places_files(spark, sf_dir), fx.taxonomy(spark), (-74.1, -73.9, 40.6, 40.8))
    return rows.select("poi_id", "name", "category", F.rint(F.col("x_m") * 10).cast("long").alias("east_dm"), F.rint(F.col("y_m") * 10).cast("long").alias("north_dm"))


@query
def enriched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workload 2 from listings in degrees and a places dataset: extent, pruned read, projection, distances, records."""
    listings = spark.sql(fx.LISTINGS_DEGREES_SQL, customer=fx.table(spark, sf_dir, "customer"))
    done = jobs.enrich_files_job(listings, _places_files(spark, sf_dir), fx.taxonomy(spark), fx.landmarks(spark, sf_dir))
    return done.select("id", "room_type", F.explode("cats").alias("_c")).select("id", "room_type", "_c.*")


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.enrich_job(fx.listings(spark, sf_dir), fx.places(spark, sf_dir), fx.taxonomy(spark), fx.landmarks(spark, sf_dir))


@query
def stored_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of records that were stored as JSON and read again; ties in distance keep the stored order."""
    path = fresh(spark, "variants")
    writers.write_variants(_enriched(spark, sf_dir), "id", f"{path}/vanilla", f"{path}/enriched")
    records = readers.stored_records(spark.read.parquet(f"{path}/enriched"))
    return render.prompts(records, "combined", once(corpus.histogram(jobs.flat_density(records))))


@query
def vanilla_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "variants")
    writers.write_variants(_enriched(spark, sf_dir), "id", f"{path}/vanilla", f"{path}/enriched")
    return spark.read.parquet(f"{path}/vanilla")


@query
def enriched_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "variants")
    writers.write_variants(_enriched(spark, sf_dir), "id", f"{path}/vanilla", f"{path}/enriched")
    return spark.read.parquet(f"{path}/enriched")


@query
def describe_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the listings that lack a summary: id and text."""
    sent, _ = jobs.describe_job(_enriched(spark, sf_dir), fx.cache(spark, sf_dir), "combined")
    told = F.from_json("request", "custom_id STRING, body STRUCT<messages:ARRAY<STRUCT<role:STRING,content:STRING>>>")["body"]["messages"]
    return sent.select("custom_id", F.get(told, F.lit(1))["content"].alias("prompt"), (F.get(told, F.lit(0))["content"] == jobs.system_text("combined")).alias("asked"))


@query
def collected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings have a summary once the answers are in, and how many still lack one."""
    return jobs.collect_job(_enriched(spark, sf_dir), fx.cache(spark, sf_dir), fx.result_batches(spark, sf_dir))[2]


@query
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.collect_job(_enriched(spark, sf_dir), fx.cache(spark, sf_dir), fx.result_batches(spark, sf_dir))[1]


@query
def retry_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that each name one landmark: those that name one out of reach are asked for again, with a note."""
    records = _enriched(spark, sf_dir)
    marks = fx.landmarks(spark, sf_dir).select("ord", F.col("name").alias("_name"))
    drafts = records.select("id").join(marks, F.pmod("id", F.lit(25)) == F.col("ord")).select("id", F.concat(F.lit("a block by "), "_name").alias("summary"))
    kept, sent = jobs.retry_job(records, drafts, "proximity")
    note = F.regexp_extract(F.from_json("request", "body STRUCT<messages:ARRAY<STRUCT<role:STRING,content:STRING>>>")["body"]["messages"][1]["content"], r"(?s)\n\n(Your previous draft.*)$", 1)
    return kept.select(F.col("id").cast("string").alias("id"), "summary").unionByName(sent.select(F.col("custom_id").alias("id"), note.alias("summary")))
