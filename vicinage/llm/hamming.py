"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and the index has a row for each segment's bits of each code. If a code
differs from a query in at most m * (r + 1) - 1 bits, one of its m segments differs in at most r. So
queries probe the index by equi-joins with all values at segment radius 0, then 1, and so on; new
candidates are verified on whole codes inside the join, where they must be as near as the k-th neighbour so far.
A query leaves when its k-th verified neighbour lies within what the radius covers. No radius is
assumed and no candidate is dropped. Large radii grow by one segment at a time; where a segment has fewer different values in the index than the radius
has flips, the query's segment meets these values instead. The number of segments follows the number of codes.

Rows of equal code are one index entry with their k smallest ids, so that a hot code costs no more
than another; equal queries are searched once. Equal distances go by id. Null vectors have no code
and are left out; null components count as 0; vectors of more than BITS components raise an error. A query finds itself when
it is a row. With fewer than k rows, all are returned. Rows that repeat an id are rows of their own. Columns beside id and
code are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.llm.common import cut

BITS = 64
K = 10
#: Segments for up to so many codes: a segment's values are about as many as the codes.
SEGMENTS = ((1 << 12, 8), (1 << 26, 4), (None, 2))
#: Probes of a query that one step may take over all segments, and parts that a segment's different values are dealt to.
LOT, PARTS = 1024, 64


def sign_code(vector: Column) -> Column:
    """A 64-bit code: bit i is set where component i is above 0. Null for a null vector."""
    zero = F.lit(0).cast("long")
    code = F.aggregate(F.reverse(vector), zero, lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.coalesce((x > 0).cast("long"), zero)))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a vector of more than {BITS} components"))).otherwise(code)


def smallest_ids(rows: DataFrame, k: int, salts: int = 32) -> DataFrame:
    """(code, ids): the k smallest ids of each code in order; hot codes are cut down in salted parts first."""
    part = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    first = Window.partitionBy("code", "_salt").orderBy("id")
    part = part.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    then = Window.partitionBy("code").orderBy("id")
    part = part.withColumn("_n", F.row_number().over(then)).where(F.col("_n") <= k)
    return part.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def with_flips(rows: DataFrame, width: int, radius: int) -> DataFrame:
    """rows with flip: each value of `width` bits with exactly `radius` of them set."""
    rows = rows.select("*", F.lit(0).cast("long").alias("flip"), F.lit(-1).alias("last"))
    kept = [c for c in rows.columns if c not in ("flip", "last")]
    for left in range(radius, 0, -1):  # the next higher bit, with room for those that follow
        rows = rows.select(*kept, "flip", F.explode(F.sequence(F.col("last") + 1, F.lit(width - left))).alias("last"))
        rows = rows.select(*kept, F.col("flip").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("last"))).alias("flip"), "last")
    return rows.drop("last")


def segments(code: str, m: int) -> Column:
    """The bits of each of m segments, with the segment's number."""
    width = BITS // m
    return F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")) for s in range(m))))


def _probe(active: DataFrame, index: DataFrame, values: DataFrame, most: int, m: int, radius: int, segs: list[int]) -> DataFrame:
    """(q, code, first_id, n_ids, d) of codes with one of the segments at exactly this radius, no farther than the query's bound; some come twice.

    A query's segment becomes all values at the radius; where the index has fewer different values than these, it is compared with those instead.
    """
    width = BITS // m
    at = active.select("q", "bound", segments("q", m).alias("s")).select("q", "bound", "s.seg", F.col("s.bits").alias("at")).where(F.col("seg").isin(segs))
    if comb(width, radius) <= most:
        keys = with_flips(at, width, radius).select("q", "bound", "seg", F.col("at").bitwiseXOR(F.col("flip")).alias("bits"))
    else:
        parts = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        keys = parts.join(values, ["seg", "part"]).where(F.bit_count(F.col("at").bitwiseXOR(F.col("bits"))) == radius).select("q", "bound", "seg", "bits")
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
    return keys.join(index, ["seg", "bits"]).where(distance <= F.col("bound")).select("q", "code", "first_id", "n_ids", distance.alias("d"))


def steps(m: int) -> list[tuple[int, list[int], int]]:
    """(radius, segments, distance that is covered then): all segments at once while that is LOT probes a query at most, then one at a time.

    With radius r in the first a + 1 segments and r - 1 in the others, a code that differs in m * r + a bits is found: else it would differ in (a + 1) (r + 1) + (m - a - 1) r bits, one more.
    """
    width, out = BITS // m, []
    for r in range(width + 1):
        if m * comb(width, r) <= LOT:
            out.append((r, list(range(m)), m * r + m - 1))
        else:
            out += [(r, [a], m * r + a) for a in range(m)]
    return out


def nearest_codes(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    """(q, code, first_id, n_ids, d): the k nearest codes of each query by (distance, first id), which hold its k nearest ids. None without entries or queries."""
    size = entries.agg(F.count("*").alias("n"), F.sum("n_ids").alias("ids")).first()
    n, wanted = size["n"], min(k, size["ids"] or 0)
    active = cut(asked.select("q", F.lit(BITS).alias("bound")))
    if not n or active.isEmpty():
        return None
    m = next(m for most, m in SEGMENTS if most is None or n <= most)
    index = cut(entries.select("code", "first_id", "n_ids", segments("code", m).alias("s")).select("code", "first_id", "n_ids", "s.seg", "s.bits"))
    values, most = None, n
    order = Window.partitionBy("q").orderBy("d", "first_id")
    best = None
    for radius, segs, covered in steps(m):
        if values is None and radius > 2:  # by then it pays to know how many values there are
            values = cut(index.select("seg", "bits").distinct().withColumn("part", F.pmod(F.xxhash64("bits"), F.lit(PARTS)).cast("int")))
            most = values.groupBy("seg").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        new = _probe(active, index, values, most if values is not None else 1 << BITS, m, radius, segs)
        found = (new if best is None else best.unionByName(new)).dropDuplicates(["q", "code"])
        best = cut(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n"))
        # the bound is the distance within which the best so far hold enough ids
        upto = Window.partitionBy("q").orderBy("d", "first_id").rowsBetween(Window.unboundedPreceding, 0)
        reached = best.withColumn("_ids", F.sum("n_ids").over(upto)).where(F.col("_ids") >= wanted).groupBy("q").agg(F.min("d").alias("kth"))
        active = cut(active.join(reached, "q", "left").where(F.coalesce(F.col("kth") > covered, F.lit(True))).select("q", F.coalesce("kth", "bound").alias("bound")))
        if active.isEmpty():
            break
    return best


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """rows(id, code) and queries(id, code) -> (query_id, rank, id, distance), rank from 1."""
    found = cut(smallest_ids(rows.where("code IS NOT NULL"), k))
    entries = found.select("code", F.get("ids", F.lit(0)).alias("first_id"), F.size("ids").alias("n_ids"))
    asked = queries.where("code IS NOT NULL").select(F.col("code").alias("q")).distinct()
    best = nearest_codes(entries, asked, k)
    if best is None:
        best = entries.select(F.col("code").alias("q"), "code", F.lit(0).alias("d")).where("false")
    order = Window.partitionBy("q").orderBy("d", "id")
    near = best.join(found, "code").select("q", "d", F.explode("ids").alias("id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(near, "q").select("query_id", "rank", "id", F.col("d").alias("distance"))
