"""A stored table of summaries by key, in hash buckets of which an upsert rewrites only those it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.operators.exchange import last_of


@dataclass(frozen=True)
class Summaries:
    """SET2, JON6: (key, summary, batch, seq) as Parquet at path, one folder a bucket of the key's hash.

    Of a key's summaries the one of the greatest batch stays, and inside a batch that of the greatest seq (any type, the same in all
    batches; null without one), so doing a batch again changes nothing. A null summary counts as none. The number of buckets is fixed when the
    table is first written; give it so that a bucket is one task's work.
    """

    spark: SparkSession
    path: str
    key: str = "id"
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket=*")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where):
            return None
        return self.spark.read.parquet(self.path)

    def upsert(self, new: DataFrame, batch: int) -> None:
        """Add new(key, summary[, seq]) as a batch. The driver gets the numbers of touched buckets, no more than there are; the files of the others stay as they are."""
        order = F.struct(F.lit(batch).cast("long").alias("batch"), (F.col("seq") if "seq" in new.columns else F.lit("")).alias("seq"))
        rows = new.select(self.key, "summary", order.alias("seq")).withColumn("bucket", self._bucket()).where(F.col("summary").isNotNull())
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        held = self._stored()
        if held is not None:
            rows = rows.unionByName(held.where(F.col("bucket").isin(touched)).select(self.key, "summary", F.struct("batch", "seq").alias("seq"), "bucket"))
        merged = last_of(rows.drop("bucket"), self.key, "summary").withColumn("bucket", self._bucket()).select(self.key, "summary", "seq.batch", "seq.seq", "bucket")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def read(self, order: bool = False) -> DataFrame:
        """(key, summary[, batch, seq])."""
        held = self._stored()
        if held is None:
            raise ValueError(f"no summaries at {self.path}")
        return held.select(self.key, "summary", *(("batch", "seq") if order else ()))
