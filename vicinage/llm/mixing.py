"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every shuffled document gets a virtual finish time: its source's cumulative words divided by the
source's target. A source may be gone through twice, the second pass following the first. Copies
are taken in the global order of finish times until the next one would pass the total budget: whole slots of finish times
from the sums of each, and the copies of the slot at the edge in order. mixed_rows() then range-sorts what is taken.

Null or blank text has size 0 and is never taken. A null source is a source of its own, after all
others. Rows that repeat a doc_id are rows of their own. An empty table gives an empty result.
Very long texts are only counted. Columns of the input whose names clash with the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.llm.common import buckets_for, cut, n_words, running_total

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2


def fill_targets(sources: DataFrame, share: float = SHARE, most: int = MAX_PASSES) -> DataFrame:
    """Add `target` to sources(weight, source_size): share of all sizes dealt out by weight, none above most x its size.

    The level (words per unit of weight) rises while the excess of full sources is dealt out
    again; each round is one aggregate over sources, and only four numbers reach the driver.
    """
    full = F.lit(False)
    level = 0.0
    while True:
        was = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if not was["weight"]:
            break
        level = ((was["all"] or 0) * share - most * (was["full"] or 0)) / was["weight"]
        over = F.col("weight") * F.lit(level) > F.col("source_size") * most
        if sources.where(over | full).count() == was["n"]:
            break
        full = over | full
    return sources.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 17, extra: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, *extra, size, source_size, target, taken): taken counts the words of every copy that the mix takes."""
    rows, taken = _copies(docs, size, weights, share, seed, extra or [])
    words = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in taken), F.lit(0))
    return rows.select("doc_id", *(extra or []), "size", "source_size", "target", (F.col("size") * words).cast("long").alias("taken"))


def _copies(docs: DataFrame, size: Column | None, weights: tuple[int, ...], share: float, seed: int, extra: list[str]) -> tuple[DataFrame, list[Column]]:
    """Rows with what places them, and for each pass the copy's place (finish, rank, end), null if the mix does not take it."""
    slim = cut(docs.select("doc_id", "source", *extra, (n_words(F.col("text")) if size is None else size).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_h")).select("*", F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none")))
    n = slim.count()
    # one row a source; sources, not documents, are numbered in one window
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = slim.groupBy("source", "_name", "_none").agg(F.sum("size").alias("source_size")).withColumn("_rank", F.row_number().over(order) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")))
    sources = cut(fill_targets(cut(sources), share)).drop("source")
    nb = buckets_for(n)
    rows = slim.withColumn("_bucket", F.pmod("_h", F.lit(nb)))
    rows = running_total(rows, ["_name", "_none"], "_bucket", [F.col("_h"), F.col("doc_id"), F.col("size")], "size", "_end")
    rows = cut(rows.join(sources, ["_name", "_none"]).select("doc_id", *extra, "size", "source_size", "target", "_rank", "_end"))
    # copies as (finish, rank, end): a total order, as ends grow within a source
    scale = max(1024, n // 20_000)

    def place(k: int) -> Column:
        end = F.col("_end") + k * F.col("source_size")
        return F.struct((end / F.nullif("target", F.lit(0.0))).alias("finish"), F.col("_rank").alias("rank"), end.alias("end"))

    def slot(p: Column) -> Column:
        return F.least(F.floor(p["finish"] * scale), F.lit(4 * scale))

    copies = rows.where("size > 0 AND target > 0").select("size", F.explode(F.array(*(place(k) for k in range(MAX_PASSES)))).alias("at")).withColumn("slot", slot(F.col("at")))
    budget = (slim.agg(F.sum("size")).first()[0] or 0) * share
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    edge = copies.groupBy("slot").agg(F.sum("size").alias("s")).select("slot", "s", F.sum("s").over(upto).alias("total")).where(F.col("total") > budget).orderBy("slot").first()
    if edge is None:
        taken_at = lambda p: p["finish"].isNotNull()  # noqa: E731  the budget covers all copies
    else:
        left = budget - (edge["total"] - edge["s"])
        inside = Window.partitionBy("slot").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        last = copies.where(F.col("slot") == edge["slot"]).select("at", F.sum("size").over(inside).alias("total")).where(F.col("total") <= left).agg(F.max("at").alias("at")).first()["at"]
        within = (lambda p: F.lit(False)) if last is None else (lambda p: p <= F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).cast("int").alias("rank"), F.lit(last["end"]).cast("long").alias("end")))
        taken_at = lambda p: (slot(p) < edge["slot"]) | ((slot(p) == edge["slot"]) & within(p))
    # a copy of size 0 takes no words and is never taken
    return rows, [F.when((F.col("size") > 0) & F.coalesce(taken_at(place(k)), F.lit(False)), place(k)) for k in range(MAX_PASSES)]


def mixed_rows(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 17) -> DataFrame:
    """docs with each row as often as the mix takes it (not at all, once or twice), in the order of finish times, all columns kept.

    Partitions are ranges of finish times, each sorted. Rows are found again by doc_id and text; rows that repeat both
    share their group's copies.
    """
    # the input's columns travel as one, so that none of their names can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("key", F.xxhash64("row.text"))
    slim = docs.select("doc_id", "source", "text", (n_words(F.col("text")) if size is None else size).alias("own_size"), F.xxhash64("text").alias("key"))
    found, taken = _copies(slim, F.col("own_size"), weights, share, seed, ["key"])
    own = found.select("doc_id", "key", F.array_compact(F.array(*taken)).alias("p"))
    plan = own.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("text_key")).agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"), F.count("*").alias("m"))
    met = rows.join(plan.where(F.size("p") > 0), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")))
    # of rows that are alike, each takes every m-th copy
    alike = Window.partitionBy("id", "text_key").orderBy("m")
    numbered = met.where("m = 1").withColumn("n", F.lit(0)).unionByName(met.where("m > 1").withColumn("n", F.row_number().over(alike) - 1))
    each = numbered.select("*", F.posexplode("p").alias("i", "at")).where(F.col("i") % F.col("m") == F.col("n"))
    place = [F.col(f"at.{c}") for c in ("finish", "rank", "end")]
    return each.repartitionByRange(*place).sortWithinPartitions(*place).select("row.*")
