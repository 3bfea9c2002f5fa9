"""Listings, places, landmarks and the like, derived from the driver's tables by text that both engines run.

Formulas are whole-number arithmetic, so both engines agree to the last bit. {customer} and the
other names in braces stand for tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# An invented taxonomy that meets every routing rule.
TAXONOMY = (
    ("restaurant", "eat_and_drink,restaurant"),
    ("pizza_restaurant", "eat_and_drink,restaurant,pizza_restaurant"),
    ("bar", "eat_and_drink,bar"),
    ("cocktail_bar", "eat_and_drink,bar,cocktail_bar"),
    ("cafe", "eat_and_drink,cafe"),
    ("coffee_shop", "eat_and_drink,cafe,coffee_shop"),
    ("clothing_store", "retail,shopping,clothing_store"),
    ("pharmacy", "retail,drugstore,pharmacy"),
    ("grocery_store", "retail,shopping,grocery_store"),
    ("supermarket", "retail,shopping,supermarket"),
    ("butcher", "retail,food,butcher"),
    ("gym", "active_life,sports_and_recreation_venue,gym"),
    ("yoga_studio", "active_life,sports_and_recreation_venue,yoga_studio"),
    ("theatre", "arts_and_entertainment,theatre"),
    ("cinema", "arts_and_entertainment,cinema"),
    ("dog_park", "attractions_and_activities,park,dog_park"),
    ("beach", "attractions_and_activities,beach"),
    ("museum", "attractions_and_activities,museum"),
    ("art_museum", "attractions_and_activities,museum,art_museum"),
    ("monument", "attractions_and_activities,monument"),
    ("hotel", "accommodation,hotel"),
    ("hostel", "accommodation,hostel"),
    ("train_station", "travel,transportation,train_station"),
    ("bus_stop", "travel,transportation,bus_stop"),
    ("car_rental", "travel,car_rental"),
    ("dentist", "health_and_medical,dentist"),
    ("bank", "financial_service,bank"),
    ("active_life", "active_life"),
    ("ferry_terminal", "travel,transportation,ferry_terminal"),
)

TAXONOMY_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{leaf}', '{path}')" for i, (leaf, path) in enumerate(TAXONOMY)) + ") AS t(ord, leaf, path)"

RAW_SQL = """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 23 = 0 THEN 'n/a' WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN '-12.00'
       ELSE concat('$', CAST(c_custkey % 9 AS STRING), ',', lpad(CAST((c_custkey * 37) % 1000 AS STRING), 3, '0'), '.50') END AS price,
  CAST(CAST(c_custkey % 6 AS DOUBLE) / 2 + 2.5 AS STRING) AS review_scores_rating,
  CAST(1 + c_custkey % 8 AS STRING) AS accommodates,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 5 AS STRING) END AS bedrooms,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(1 + c_custkey % 3 AS STRING) END AS bathrooms,
  c_mktsegment AS room_type,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('Entire place, ', CAST(c_custkey % 5 AS STRING), ' Bedrooms, ', CAST(1 + c_custkey % 3 AS STRING), '.5 baths') END AS bathrooms_text,
  CASE WHEN c_custkey % 11 = 0 THEN 'maybe' WHEN c_custkey % 2 = 0 THEN 't' ELSE 'FALSE' END AS host_is_superhost
FROM {customer}
"""

LISTINGS_SQL = """
SELECT c_custkey AS id,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN 5500 + (c_custkey * 7919) % 1000 ELSE (c_custkey * 7919) % 12000 END AS DOUBLE) AS x_m,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN 5500 + (c_custkey * 104729) % 1000 ELSE (c_custkey * 104729) % 12000 END AS DOUBLE) AS y_m,
  c_mktsegment AS room_type, c_nationkey AS neighbourhood
FROM {customer}
"""

PLACES_SQL = """
SELECT o_orderkey AS poi_id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('Place ', CAST(o_orderkey % 977 AS STRING)) END AS name,
  leaf AS category,
  CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS confidence,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN 5500 + (o_orderkey * 6101) % 1000 ELSE (o_orderkey * 6101) % 12000 END AS DOUBLE) AS x_m,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN 5500 + (o_orderkey * 15485) % 1000 ELSE (o_orderkey * 15485 + o_custkey * 31) % 12000 END AS DOUBLE) AS y_m
FROM (SELECT o.o_orderkey, o.o_custkey, t.leaf AS leaf FROM {orders} o JOIN {taxonomy} t ON t.ord = (o.o_orderkey * 7 + o.o_custkey) % 29)
"""

LANDMARKS_SQL = """
SELECT n_name AS name, n_nationkey AS ord, concat('POLYGON((', a, ' ', b, ',', c, ' ', b, ',', c, ' ', d, ',', a, ' ', d, ',', a, ' ', b, '))') AS wkt FROM (
  SELECT n_name, n_nationkey, CAST(x - w AS STRING) a, CAST(y - w AS STRING) b, CAST(x + w AS STRING) c, CAST(y + w AS STRING) d FROM (
    SELECT n_name, n_nationkey, (n_nationkey * 2377) % 12000 x, (n_nationkey * 5179) % 12000 y, 50 + 10 * (n_nationkey % 7) w FROM {nation}))
"""

#: Listings and places around New York in degrees, a fifth and a quarter of them in a dense part.
LISTINGS_DEGREES_SQL = """
SELECT c_custkey AS id, c_mktsegment AS room_type,
  CAST(-74.05 AS DOUBLE) + CAST(CASE WHEN c_custkey % 5 = 0 THEN 4000 + (c_custkey * 7919) % 1000 ELSE (c_custkey * 7919) % 10000 END AS DOUBLE) / 80000 AS longitude,
  CAST(40.65 AS DOUBLE) + CAST(CASE WHEN c_custkey % 5 = 0 THEN 4000 + (c_custkey * 104729) % 1000 ELSE (c_custkey * 104729) % 10000 END AS DOUBLE) / 100000 AS latitude
FROM {customer}
"""

PLACES_DEGREES_SQL = """
SELECT o_orderkey AS poi_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('Place ', CAST(o_orderkey % 977 AS STRING)) END AS name, leaf AS category,
  CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS confidence,
  CAST(-74.08 AS DOUBLE) + CAST(CASE WHEN o_orderkey % 4 = 0 THEN 6000 + (o_orderkey * 6101) % 1000 ELSE (o_orderkey * 6101) % 15000 END AS DOUBLE) / 80000 AS lon,
  CAST(40.63 AS DOUBLE) + CAST(CASE WHEN o_orderkey % 4 = 0 THEN 6000 + (o_orderkey * 15485) % 1000 ELSE (o_orderkey * 15485 + o_custkey * 31) % 15000 END AS DOUBLE) / 100000 AS lat
FROM (SELECT o.o_orderkey, o.o_custkey, t.leaf AS leaf FROM {orders} o JOIN {taxonomy} t ON t.ord = (o.o_orderkey * 7 + o.o_custkey) % 29)
"""

#: A text service's answers: some without body, some without cost, one id twice.
RESULTS_SQL = """
SELECT CASE WHEN event_id % 13 = 0 THEN concat('{{"results": [], "output": [', item, ']}}') ELSE concat('{{"results": [', item, ']}}') END AS value FROM (
  SELECT event_id, CASE
    WHEN event_id % 17 = 0 THEN concat('{{"custom_id": "', CAST(event_id AS STRING), '", "response": {{}}}}')
    ELSE concat('{{"custom_id": "', CAST(event_id AS STRING), '", "response": {{"body": {{"choices": [{{"message": {{"content": "Block of ', event_type, ' ', CAST(event_id % 10 AS STRING), '"}}}}], "usage": {{"prompt_tokens": ', CAST(100 + event_id % 50 AS STRING), ', "completion_tokens": ', CAST(event_id % 40 AS STRING), ', "cost": ', CAST(event_id % 4 AS STRING), '}}}}}}}}')
    END AS item FROM {events})
"""

#: Answers by listing in two batches, many to a listing: the last of them counts.
ANSWERS_SQL = """
SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS batch,
  concat('{{"results": [{{"custom_id": "', CAST(user_id AS STRING), '", "response": {{"body": {{"choices": [{{"message": {{"content": "', event_type, ' ', CAST(event_id AS STRING), '"}}}}]}}}}}}]}}') AS value
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.sql(TAXONOMY_SQL).withColumn("path", F.split("path", ","))


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_SQL, customer=table(spark, sf_dir, "customer"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTINGS_SQL, customer=table(spark, sf_dir, "customer"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PLACES_SQL, orders=table(spark, sf_dir, "orders"), taxonomy=taxonomy(spark))


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LANDMARKS_SQL, nation=table(spark, sf_dir, "nation"))


def result_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESULTS_SQL, events=table(spark, sf_dir, "events"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ANSWERS_SQL, events=table(spark, sf_dir, "events"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of some listings; some are null, and some ids come twice."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.concat(F.lit("Cached "), F.col("doc_id").cast("string"))).alias("summary"))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by brand, as if each were a learner; every seventh brand has no tuned score (NaN)."""
    part = table(spark, sf_dir, "part")
    score = lambda m: (F.sum((F.col("p_partkey") * m + F.col("p_size")) % 101) % 100).cast("double") / 100
    out = part.groupBy(F.col("p_brand").alias("learner")).agg(*(score(m).alias(c) for c, m in REPORT_COLUMNS.items()))
    skipped = F.regexp_extract("learner", r"(\d+)", 1).cast("int") % 7 == 3
    return out.withColumn("joint_text_tar", F.when(skipped, float("nan")).otherwise(F.col("joint_text_tar")))


#: Score columns and the factors that make them differ.
REPORT_COLUMNS = {"structured": 3, "unstructured_text": 5, "joint_text_frozen": 7, "joint_text_tar": 11, "unstructured_image": 13, "joint_image_frozen": 17, "joint_image_tar": 19}
