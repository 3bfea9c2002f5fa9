"""Results that land file by file, merged into the stored table of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinage.operators import exchange
from vicinage.sources import readers
from vicinage.sources.summaries import Summaries


def follow_results(spark: SparkSession, landing: str, listings: DataFrame, cache_path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Each new result file of `landing` is parsed once and its summaries are added to the table at cache_path.

    A batch is an upsert under its own number, so an attempt that is done again changes nothing; later batches win, and inside a batch
    the later file by name.
    """
    held = Summaries(spark, cache_path, key)

    def merge(rows: DataFrame, batch_id: int) -> None:
        held.upsert(exchange.merge_results(listings, readers.result_rows(rows), key), batch_id)

    files = spark.readStream.format("text").option("wholetext", True).load(landing)
    placed = files.select("value", F.col("_metadata.file_name").alias("seq"))
    return placed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_cache(spark: SparkSession, cache_path: str, key: str = "id") -> DataFrame:
    """(key, summary): the latest batch's summary of each key."""
    return Summaries(spark, cache_path, key).read()
