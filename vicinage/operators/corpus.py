"""How a listing's counts compare with those of the whole corpus.

The corpus is summed up as a histogram (bucket, count) with one row per distinct count, so no step
sorts or windows over the listings themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.store import once

#: Rows of a histogram that are sent to every task at most, some 20 bytes each; a longer one is joined.
REFERENCE = 200_000


def histogram(dense: DataFrame, n_listings: int | None = None, key: str = "id", weight: str | None = None) -> DataFrame:
    """AGG5, AGG6, WIN1: (bucket, cnt, n, n_lt, pct, present_frac).

    n listings have the count cnt, n_lt have fewer; a listing without the bucket has 0. pct is the
    share strictly below. A row for 0 is there for every bucket, as absence is scored too. Unless told, the
    corpus has as many listings as keys in dense; that one number joins the histogram inside the plan. With a weight, a column of whole
    numbers that is the same in all rows of a key, a key stands for so many listings.
    """
    seen = dense.groupBy("bucket", F.col("n_radius").alias("cnt")).agg(_rows(weight).alias("n"))
    seen = seen.where("cnt > 0")
    size = _size(dense, key, weight, "_all") if n_listings is None else dense.sparkSession.range(1).select(F.lit(n_listings).alias("_all"))
    return _placed(seen, size)


def _rows(weight: str | None) -> Column:
    return F.count("*") if weight is None else F.sum(weight)


def _size(dense: DataFrame, key: str, weight: str | None, name: str) -> DataFrame:
    """One row: how many listings dense has."""
    if weight is None:
        return dense.select(key).distinct().agg(F.count("*").alias(name))
    return dense.select(key, weight).distinct().agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias(name))


def size(dense: DataFrame, key: str = "id", weight: str | None = None) -> int:
    """How many listings dense has."""
    return _size(dense, key, weight, "n").first()["n"]


def _placed(seen: DataFrame, size: DataFrame) -> DataFrame:
    """histogram() from (bucket, cnt, n) of counts above 0 and the one number _all of listings."""
    zero = seen.groupBy("bucket").agg(F.lit(0).alias("cnt"), F.sum("n").alias("_n")).crossJoin(size).select("bucket", "cnt", (F.col("_all") - F.col("_n")).cast("long").alias("n"))
    below = Window.partitionBy("bucket").orderBy("cnt").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("bucket")
    out = seen.unionByName(zero).withColumn("n_lt", F.coalesce(F.sum("n").over(below), F.lit(0)).cast("long"))
    # with the row for 0 a bucket's counts sum up to the corpus
    present, everyone = F.sum(F.when(F.col("cnt") > 0, F.col("n")).otherwise(0)).over(whole), F.sum("n").over(whole)
    return out.select("bucket", "cnt", "n", "n_lt", (F.col("n_lt") / everyone).alias("pct"), (present / everyone).alias("present_frac"))


def reference(hist: DataFrame) -> DataFrame:
    """One row (ref): by bucket, its counts in order with their pct, and present_frac."""
    rows = hist.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("cnt", "pct"))).alias("_c"), F.first("present_frac").alias("present_frac"))
    each = F.struct("bucket", F.col("_c.cnt").alias("cnt"), F.col("_c.pct").alias("pct"), "present_frac")
    return rows.agg(F.sort_array(F.collect_list(each)).alias("ref"))


def _below(ref: Column, n: Column) -> Column:
    """The pct of count n: that of the least known count from n up, found by halving; 1 above all."""
    size = F.size(ref["cnt"])

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        less = F.get(ref["cnt"], mid) < n
        return F.struct(F.when((a["lo"] < a["hi"]) & less, mid + 1).otherwise(a["lo"]).alias("lo"), F.when((a["lo"] < a["hi"]) & ~less, mid).otherwise(a["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve)["lo"]
    return F.coalesce(F.get(ref["pct"], at), F.lit(1.0))


def scored_lists(records: DataFrame, hist: DataFrame, key: str = "id") -> DataFrame:
    """JON4, JON5: records(key, cats, ...) with scored: every bucket of the corpus as (bucket, n_doorstep, n_radius, nearest_m, pct, present_frac).

    Absent buckets have 0 places. The corpus' reference goes to every task and is searched inside the row, so nothing is shuffled; a histogram
    of more than REFERENCE rows is joined instead. hist should be cheap to read twice.
    """
    if hist.limit(REFERENCE + 1).count() > REFERENCE:
        return _scored_by_join(records, hist, key)
    own = F.map_from_entries(F.transform("cats", lambda c: F.struct(c["bucket"], c)))

    def one(r: Column) -> Column:
        c = F.try_element_at("_own", r["bucket"])
        n = F.coalesce(c["n_radius"], F.lit(0))
        return F.struct(r["bucket"].alias("bucket"), F.coalesce(c["n_doorstep"], F.lit(0)).alias("n_doorstep"), n.alias("n_radius"), c["nearest_m"].alias("nearest_m"), _below(r, n).alias("pct"), r["present_frac"].alias("present_frac"))

    return records.withColumn("_own", own).crossJoin(F.broadcast(reference(hist))).withColumn("scored", F.transform("ref", one)).drop("ref", "_own")


def _scored_by_join(records: DataFrame, hist: DataFrame, key: str) -> DataFrame:
    """The same by a join on bucket and count, for a corpus whose counts are too many to send around; they must all be in hist."""
    names = hist.agg(F.sort_array(F.collect_set("bucket")).alias("_names"))
    own = F.map_from_entries(F.transform("cats", lambda c: F.struct(c["bucket"], c)))
    full = records.select(key, own.alias("_own")).crossJoin(names).select(key, F.explode("_names").alias("bucket"), "_own")
    c = F.try_element_at("_own", F.col("bucket"))
    full = full.select(key, "bucket", F.coalesce(c["n_doorstep"], F.lit(0)).alias("n_doorstep"), F.coalesce(c["n_radius"], F.lit(0)).alias("n_radius"), c["nearest_m"].alias("nearest_m"))
    joined = full.join(hist.select("bucket", F.col("cnt").alias("n_radius"), "pct", "present_frac"), ["bucket", "n_radius"])
    lists = joined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("bucket", "n_doorstep", "n_radius", "nearest_m", "pct", "present_frac"))).alias("scored"))
    return records.join(lists, key)


def scored(records: DataFrame, hist: DataFrame, key: str = "id") -> DataFrame:
    """scored_lists() as rows (key, bucket, n_doorstep, n_radius, nearest_m, pct, present_frac)."""
    return scored_lists(records.select(key, "cats"), hist, key).select(key, F.explode("scored").alias("_s")).select(key, "_s.*")


def counts(dense: DataFrame, key: str = "id", weight: str | None = None) -> DataFrame:
    """AGG5 as a table that can be kept up to date: (bucket, cnt, n), and the number of listings as n where bucket is null. A weight as in histogram()."""
    seen = dense.where("n_radius > 0").groupBy("bucket", F.col("n_radius").alias("cnt")).agg(_rows(weight).alias("n"))
    size = _size(dense, key, weight, "n").select(F.lit(None).cast("string").alias("bucket"), F.lit(0).alias("cnt"), "n")
    return seen.unionByName(size)


def changed(held: DataFrame, gone: DataFrame, come: DataFrame, key: str = "id", weight: str | None = None) -> DataFrame:
    """AGG5, AGG6 after a change: counts() with the densities of gone records taken out and those of new ones put in; a changed record is in both.

    Signed counts are summed up, so changes can come in any order and only the changed records are read.
    """
    signed = [held, counts(gone, key, weight).withColumn("n", -F.col("n")), counts(come, key, weight)]
    rows = signed[0].unionByName(signed[1]).unionByName(signed[2])
    return once(rows.groupBy("bucket", "cnt").agg(F.sum("n").alias("n")).where("n <> 0 OR bucket IS NULL"))


def from_counts(held: DataFrame) -> DataFrame:
    """The histogram() of a corpus whose counts() are held."""
    return _placed(held.where("bucket IS NOT NULL"), held.where("bucket IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all")))


def totals(dense: DataFrame, key: str = "id") -> DataFrame:
    """AGG7: places in the radius over all buckets."""
    return dense.groupBy(key).agg(F.sum("n_radius").cast("long").alias("total"))


def densest(dense: DataFrame, k: int, key: str = "id") -> DataFrame:
    """TOP1: the k listings with most places; Spark keeps k rows a task, so k stays small."""
    return top(totals(dense, key), k, key)


def top(totals: DataFrame, k: int, key: str = "id") -> DataFrame:
    return totals.orderBy(F.desc("total"), key).limit(k)
