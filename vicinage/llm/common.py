"""What several operators share: lineage cuts, scratch tables, running totals."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.store import once as cut
from vicinage.store import shared_dir

T = TypeVar("T")

#: A word is a run of characters that are neither a space nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


#: What a Python worker remembers for its operator; one entry at most, as workers go on to other operators' tasks.
_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], T]) -> T:
    """make()'s result, kept for the worker's next tasks until another operator asks for its own."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]  # type: ignore[return-value]


def make_room() -> None:
    """Forget what another operator has kept in this worker."""
    _kept.clear()


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


class Scratch:
    """Parquet tables in the shared folder that go when the block ends.

    What a block returns must not read them any more: cut() it inside the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def table(self, name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}") if not partition_by else self.spark.read.parquet(f"{self.path}/{name}")

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Inside the block Spark removes a query's shuffle files when it ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buckets_for(rows: int, per_bucket: int = 50_000, least: int = 64) -> int:
    """So many buckets that each holds about per_bucket rows, however large the table is."""
    return max(least, -(-rows // per_bucket))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add `out`: the total of `value` in each key up to and with the row, in the order (bucket, *order).

    No task gets a whole key: buckets are summed first (with map-side partial sums), their offsets
    come from a window over that short table, and rows are ordered only inside (key, bucket).
    Keys must not be null.
    """
    by = [*keys, bucket]
    sums = df.groupBy(*by).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, by).withColumn(out, F.col("_offset") + F.sum(value).over(inside)).drop("_offset")
