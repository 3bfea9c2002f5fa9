"""Sharding by balanced label propagation. DataFrame functions only.

Documents with equal text are linked. Every document starts in a shard that a hash picks. In each
round a group of linked documents wants to be in the shard where most of its bytes are; a join
moves its other members there as far as that shard's quota of linked bytes reaches. Unlinked
documents cost no cut edge wherever they are, so they then even out the sizes; members of groups
move for that only when no unlinked document is left.

A group that is larger than a shard fills one shard after another. Links are kept as group ids, so
that no pair of members is ever formed. Null text counts as empty text, of size 1. Rows that repeat
a doc_id are rows of their own. Very long texts are only measured and hashed; one that is larger than a shard's share makes
its shard larger by as much. Columns beside doc_id and text are not read. An empty table gives an empty result. Texts count as
equal if their 64-bit hashes are: among 10^10 different texts a few pairs may be linked so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import buckets_for, cut, running_total

#: Linked bytes a shard takes at most, as a share of the mean shard size.
FILL = 0.98
#: Fewer than so many groups are sent to every task, those of over a HEAVY-th of all rows.
HEAVY = 10_000


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _at(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), index + 1)


def _loads(df: DataFrame, n_shards: int) -> list[int]:
    found = {r["shard"]: r["b"] for r in df.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    return [found.get(s, 0) for s in range(n_shards)]


def _attach(rows: DataFrame, facts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows left-joined with facts, one row a key, whose column many (dropped) counts the key's rows among n.

    Keys of over n / HEAVY rows are fewer than HEAVY, so these are sent to every task; no other key is large enough to hold up its task.
    """
    heavy = F.col("many") * HEAVY > n
    sent = F.broadcast(facts.where(heavy))
    others = rows.join(sent.select(*keys), keys, "left_anti").join(facts.where(~heavy), keys, "left")
    return rows.join(sent, keys).unionByName(others).drop("many")


def propagate(linked: DataFrame, n_shards: int, mean: float, rounds: int, n: int) -> DataFrame:
    """Rounds of label propagation over rows (_g, _r, size, shard, ...), of n rows in all."""
    for k in range(rounds):
        tally = cut(linked.groupBy("_g", "shard").agg(F.sum("size").alias("here"), F.count("*").alias("many")))
        free = [max(0.0, FILL * mean - b) for b in _loads(tally.withColumnRenamed("here", "size"), n_shards)]
        # a full shard draws nobody; among the others the one with most bytes, then the lowest
        is_open = _at(free, F.col("shard")) > 0
        best = tally.where(is_open).groupBy("_g").agg(F.max(F.struct("here", (-F.col("shard")).alias("s"))).alias("best"))
        moves = tally.join(best, "_g").select("_g", "shard", "here", "many", (-F.col("best.s")).alias("to"), F.col("best.here").alias("there"))
        # out of a full shard nobody moves, as the group is at its best there
        moves = cut(moves.where((F.col("to") != F.col("shard")) & (_at(free, F.col("shard")) > 0)))
        demand = _loads(moves.select(F.col("to").alias("shard"), F.col("here").alias("size")), n_shards)
        if not any(demand):
            break
        share = [min(1.0, free[t] / demand[t]) if demand[t] else 0.0 for t in range(n_shards)]
        # small portions move whole, large ones in part
        whole = F.col("here") * 10 <= _at(free, F.col("to"))
        draw = F.when(whole, _unit(F.col("_g"), F.col("shard"), F.lit(k))).otherwise(_unit(F.col("_r"), F.lit(k)))
        linked = cut(
            _attach(linked, moves.drop("there"), ["_g", "shard"], n)
            .withColumn("shard", F.when(F.col("to").isNotNull() & (draw < _at(share, F.col("to"))), F.col("to")).otherwise(F.col("shard")))
            .drop("here", "to")
        )
    return linked


def even_out(rows: DataFrame, n_shards: int, n: int, passes: int) -> DataFrame:
    """Move documents from shards above the mean to those below, free ones first, until sizes are even."""
    nb = buckets_for(n)
    for _ in range(passes):
        loads = _loads(rows, n_shards)
        mean = sum(loads) / n_shards
        over, under = [max(0.0, b - mean) for b in loads], [max(0.0, mean - b) for b in loads]
        if max(over, default=0) <= 16:
            break
        giving = rows.where(F.col("size") <= _at(over, F.col("shard")))
        giving = running_total(giving.withColumn("_bucket", F.col("cost") * nb + F.pmod("_r", F.lit(nb))), ["shard"], "_bucket", [F.col("_r"), F.col("doc_id"), F.col("size"), F.col("_g")], "size", "_upto").drop("_bucket")
        # surpluses and deficits lie on one axis; a document goes where its middle falls
        base = [sum(over[:s]) for s in range(n_shards)]
        ends = [sum(under[: t + 1]) for t in range(n_shards)]
        middle = _at(base, F.col("shard")) + F.col("_upto") - F.col("size") / 2
        to = F.lit(n_shards - 1)
        for t in reversed(range(n_shards)):
            if under[t]:
                to = F.when(middle <= ends[t], F.lit(t)).otherwise(to)
        goes = F.col("_upto") <= _at(over, F.col("shard"))
        stays = rows.where(F.col("size") > _at(over, F.col("shard")))
        rows = cut(stays.unionByName(giving.withColumn("shard", F.when(goes, to).otherwise(F.col("shard"))).drop("_upto")))
    return rows


def shard_documents(docs: DataFrame, n_shards: int = 8, rounds: int = 4, passes: int = 4, seed: int = 29) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size, cut): one for each row of docs.

    size is the text's UTF-8 bytes plus 1; law is 'bytes' (shards are of near equal total size);
    slot counts from 0 in each shard; cut says that the row's group lies in more than one shard.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_g"), F.xxhash64("doc_id", F.lit(seed)).alias("_r"))
        .withColumn("shard", F.pmod(F.shiftright("_r", 20), F.lit(n_shards)).cast("int"))
    )
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    groups = cut(rows.groupBy("_g").agg(F.count("*").alias("group_size")).where("group_size > 1").withColumn("many", F.col("group_size")))
    rows = cut(_attach(rows, groups, ["_g"], total["n"]).fillna(1, ["group_size"]))
    single, linked = rows.where("group_size = 1"), rows.where("group_size > 1")
    linked = propagate(linked, n_shards, (total["b"] or 0) / n_shards, rounds, total["n"])
    spread = cut(linked.groupBy("_g").agg((F.min("shard") != F.max("shard")).alias("_split"), F.count("*").alias("many")))
    linked = _attach(linked, spread, ["_g"], total["n"])
    # moving an unlinked document costs nothing, one of a split group little, one of a whole group most
    rows = cut(single.withColumn("cost", F.lit(0)).unionByName(linked.withColumn("cost", F.when(F.col("_split"), 1).otherwise(2)).drop("_split")))
    rows = even_out(rows, n_shards, total["n"], passes)
    rows = running_total(rows.withColumn("_bucket", F.pmod("_r", F.lit(buckets_for(total["n"])))).withColumn("_one", F.lit(1)), ["shard"], "_bucket", [F.col("_r"), F.col("doc_id"), F.col("size"), F.col("_g")], "_one", "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_size", (F.col("cost") == 1).alias("cut"))
