"""N-gram Jaccard join: exact links between shingle sets, and the components that they form.

Equal sets are one node, known by a 64-bit fingerprint. Linked sets have much in common, so every step
keeps only what can still link, and none forms the pairs of a group:

1. Screens. A node stays only if enough of its first tokens in hash order (l is a tenth of the set, see
   `prefix`) are in the same place of other nodes; then only if ceil(t n) tokens of its whole set are
   in other nodes that are left. What has a quarter of its tokens to itself links with nothing.
2. Leader rounds. Tokens are ordered by the groups that have them, fewest first; of two nodes that link in
   c tokens, both have one in the first s - c + 1 of their s shared ones. Every node is compared with two
   leaders for each of these tokens: the node most covered by others, which a family of copies has in common,
   and a drawn one. What links forms groups of similar documents (connected components).
3. Token-group matrix. For each of these tokens that lies in several groups, the matrix has a row for each group,
   with its sizes and the union of its members' tokens as a bit map. A node asks the groups that are larger than
   its own; those whose union can't cover enough of the node stay shut. Opened groups are compared
   member by member, by bit maps of token parity first, then on whole sets.

No link between different texts is lost: bit maps and bounds only rule out what can't link. A family of m texts that
are near each other but do not link takes up to m^2 comparisons of bit maps for each token they start with, inside
one join, which puts out only the pairs that pass; bit maps tell sets of some 700 tokens and less apart, and
pairs of longer ones go on to whole sets. Comparisons count common tokens of whole sets; 64-bit hashes stand for tokens,
for sets and for texts, so that among 10^10 different texts a few may be taken for equal.

A text with fewer words than a shingle has its whole sequence as its one token. Null texts and
texts without words have no tokens: n_shingles is 0 and they are linked with nothing. Very long texts are taken
whole: a task holds one of them with its hashes, some 60 bytes for each of the text's. Rows that
repeat a doc_id are joined as one document if their texts' sets link, else each for itself. Columns beside doc_id and
text are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.llm.common import WORD, Scratch, cut, in_slices, make_room, shuffles_end_with_their_query

WORDS = 5
#: Two sets link when 100 * common >= PERCENT * together.
PERCENT = 75
#: l of the first screen is a tenth (one by EXTRA) of a set, rounded up.
EXTRA = 10
#: 64-bit words of a set's bit maps.
MAP = 16
#: Rounds with leaders, before groups are bounded.
LEADER_ROUNDS = 2

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


#: Odd factors for a word's place in its shingle; mixed, as factors in an even row would let swapped words cancel out.
_PLACE = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _power_tables(n: int) -> list[np.ndarray]:
    """base^i and base^-i modulo 2^64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text its tokens, ascending and distinct, as signed 64-bit integers."""
    parts = [(t or "").encode() for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    text = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    blank = (text == 32) | ((text >= 9) & (text <= 13))
    lower = np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(text) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[: len(text)], dtype=np.uint64)])
    word = _mix((total[ends] - total[starts]) * inverse[starts])
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    n = max(0, len(word) - words + 1)
    run = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        run += word[k : k + n] * _PLACE[k]
    run = _mix(run).view(np.int64)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(run[lo : hi - words + 1]))
        elif hi > lo:
            short = _mix(np.array([(word[lo:hi] * _PLACE[8 : 8 + hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)], dtype=np.uint64))
            out.append(short.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of about `most` characters with their sets."""
    make_room()
    for whole in in_slices(batches, 1024):
        texts, first, size = whole.column("text").to_pylist(), 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= most or k + 1 == len(texts):
                yield whole.slice(first, k + 1 - first), shingle_sets(texts[first : k + 1])
                first, size = k + 1, 0


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, n_shingles, set_id) of every row: text_id is a hash of the text; set_id is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _batches(batches):
            ids = [_set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64())], names=["doc_id", "text_id", "n_shingles", "set_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text_id long, n_shingles long, set_id long")


def needed(n: int) -> int:
    """Least common tokens of a set of n tokens with any set that it links with."""
    return -(-PERCENT * n // 100)


def prefix(tokens: np.ndarray) -> np.ndarray:
    """The first tokens in hash order, of which any two linked sets share l or more, l being that of the smaller."""
    return tokens[: len(tokens) - needed(len(tokens)) - (-len(tokens) // EXTRA)]


def least_shared(n: Column) -> Column:
    """The least l of a set of n tokens and of any set that it links with, as that one may be smaller."""
    return F.ceil(F.ceil(PERCENT * n / 100) / EXTRA)


#: Rows that a task looks through for tokens of several nodes before it sends them on.
COMBINE = 1 << 20
#: Kinds of rows of the first screen: a node's token; a token that several nodes of one task have; how many such tokens a node has.
TOKEN, PROOF = 0, -1


def combined(h: np.ndarray, node: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """(h, node, n, k) rows of a task's prefix tokens, summed up before the shuffle.

    Of a token that several of the nodes have, one row goes on (k = PROOF), however many they are, and each node gets
    a row with the number of its such tokens (k > 0, under the node's own number). The other tokens go on as they are (k = TOKEN).
    """
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    shared = np.zeros(len(h), dtype=bool)
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    proofs = np.unique(h[shared])
    nodes, at, counts = np.unique(node[shared], return_index=True, return_counts=True)
    left = ~shared
    zeros = lambda x: np.zeros(len(x), dtype=np.int64)
    return [
        np.concatenate([h[left], proofs, nodes]),
        np.concatenate([node[left], zeros(proofs), nodes]),
        np.concatenate([n[left], zeros(proofs), n[shared][at]]),
        np.concatenate([np.full(left.sum(), TOKEN), zeros(proofs) + PROOF, counts]),
    ]


_ROW = ("h", "node", "n", "k")
_ROW_SCHEMA = "h long, node long, n int, k int"


def _row_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int32, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t, copy=False)) for c, t in zip(columns, kinds, strict=True)], names=list(_ROW))


def prefix_rows(docs: DataFrame) -> DataFrame:
    """Rows of combined() for the tokens of each node's prefix; a task gives each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(h) for h, _, _ in held]
            return _row_batch(combined(np.concatenate([h for h, _, _ in held]), *(np.repeat(np.array([x[k] for x in held], dtype=np.int64), lengths) for k in (1, 2))))

        for _, sets in _batches(batches):
            new = {i: s for s in sets if len(s) and (i := _set_id(s)) not in done}
            done.update(new)
            held += [(prefix(s), i, len(s)) for i, s in new.items()]
            size += sum(len(s) for s in new.values())
            if size >= 2 * COMBINE:  # prefixes are less than half of the tokens
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, _ROW_SCHEMA)


def credits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, node, n, k) with k > 0: how many tokens of a node others have too, from rows in the order of h. Several rows a node."""
    rest: list[np.ndarray] | None = None

    def told(columns: list[np.ndarray]) -> pa.RecordBatch:
        h, node, n, k = columns
        ready, token = k > 0, k <= 0
        gh, gn, gk = h[token], node[token], k[token]
        if not len(gh):
            return _row_batch([c[ready] for c in columns])
        start = np.flatnonzero(np.concatenate([[True], gh[1:] != gh[:-1]]))
        # tokens of several nodes, or of several in one task
        nodes = np.where(gk == TOKEN, gn, np.repeat(np.maximum.reduceat(np.where(gk == TOKEN, gn, np.iinfo(np.int64).min), start), np.diff(np.append(start, len(gh)))))
        many = (np.minimum.reduceat(nodes, start) != np.maximum.reduceat(nodes, start)) | (np.minimum.reduceat(gk, start) == PROOF)
        hit = np.repeat(many, np.diff(np.append(start, len(gh)))) & (gk == TOKEN)
        ids, at, counts = np.unique(gn[hit], return_index=True, return_counts=True)
        return _row_batch([np.concatenate([c[ready], x]) for c, x in zip(columns, (ids, ids, n[token][hit][at], counts), strict=True)])

    for b in batches:
        columns = [b.column(c).to_numpy() for c in _ROW]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        # the last token's rows may go on in the next batch
        cut_at = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        rest = [c[cut_at:] for c in columns]
        if cut_at:
            yield told([c[:cut_at] for c in columns])
    if rest is not None and len(rest[0]):
        yield told(rest)


def _several(rows: DataFrame, what: str = "node") -> DataFrame:
    """Tokens that several nodes (or groups) have."""
    return rows.groupBy("h").agg(F.min(what).alias("lo"), F.max(what).alias("hi")).where("lo <> hi").select("h")


def screened(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node) of nodes that share enough tokens of their prefixes with others. A token has some rows a task at most in the shuffle.

    Copies of a node in other tasks may let more through.
    """
    rows = prefix_rows(docs).repartition("h").sortWithinPartitions("h").mapInArrow(credits, _ROW_SCHEMA)
    counts = rows.groupBy("node").agg(F.sum("k").alias("k"), F.first("n").alias("n"))
    return scratch.table("screened", counts.where(F.col("k") >= least_shared(F.col("n"))).select("node"))


def bit_maps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set 2 * MAP words: the parity of its tokens on each bit, then the bits that any token has."""
    bits = 64 * MAP
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    counts = np.bincount(row * bits + (tokens & (bits - 1)), minlength=len(sets) * bits).reshape(len(sets), bits)
    return np.concatenate([np.packbits(x, axis=1, bitorder="little").view("<i8") for x in (counts & 1 == 1, counts > 0)], axis=1)


PARITY = [f"p{k}" for k in range(MAP)]
UNION = [f"u{k}" for k in range(MAP)]


def node_sets(docs: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, tokens, bit maps) of the given nodes, each once: of the rows that have a set, the first one's text is read."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_z")]
    wanted = own.join(nodes, own["set_id"] == nodes["node"]).groupBy("node").agg(F.min(F.struct(*key, "text_id")).alias("r")).select("node", "r.*")
    texts = docs.select(*key, F.xxhash64("text").alias("text_id"), "text").groupBy("_d", "_z", "text_id").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _batches(batches):
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            maps = bit_maps(sets)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.diff(offsets)), tokens, *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(2 * MAP))], names=["node", "n", "tokens", *PARITY, *UNION])

    found = texts.join(wanted, ["_d", "_z", "text_id"]).select("node", "text")
    return found.mapInArrow(run, "node long, n int, tokens array<long>, " + ", ".join(f"{c} long" for c in PARITY + UNION))


def _rows(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("tokens").alias("h"), "node", "n")


def coverable(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Those sets of which at least ceil(t n) of n tokens are in other ones too."""
    rows = _rows(sets)
    shared = scratch.table("shared_by_sets", _several(rows))
    counts = rows.join(shared, "h", "left_semi").groupBy("node").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    return scratch.table("sets", sets.join(counts.where(100 * F.col("k") >= PERCENT * F.col("n")).select("node"), "node", "left_semi"))


def together(c: Column, n: Column, m: Column) -> Column:
    """Whether c common tokens or more can link sets of n and m tokens."""
    return (100 + PERCENT) * c >= PERCENT * (n + m)


def fits(n: Column, m: Column) -> Column:
    return (PERCENT * n <= 100 * m) & (PERCENT * m <= 100 * n)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets link, by common tokens of the whole sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(together(F.size(F.array_intersect("ta", "tb")), F.col("na"), F.col("nb"))).select("a", "b")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node in links: comp is the least node that links reach. Labels spread to neighbours, then jump to their label's label."""
    edges = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = cut(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("comp")))
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("heard"))
        new = labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = cut(new.join(jump, "comp").select("node", "was", F.least("comp", "next").alias("comp")))
        if new.where(F.col("was") != F.col("comp")).isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _with_comp(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows(node, ...) with comp: the node's component, or the node itself."""
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def with_groups(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(h, node, n, comp, g): rows of tokens that lie in g groups, two or more."""
    here = _with_comp(rows.select("h", "node", "n"), labels)
    each = here if labels is None else here.select("h", "comp").distinct()
    # one row a token on the other side: a hot token's rows can be split over tasks
    return here.join(each.groupBy("h").agg(F.count("*").alias("g")).where("g > 1"), "h")


def active(rows: DataFrame) -> DataFrame:
    """rows(h, node, n, comp, g) of nodes of which ceil(t n) tokens are left, with s: how many are, and pos: the token's place among them, those in few groups first."""
    own = Window.partitionBy("node")
    rows = rows.withColumn("s", F.count("*").over(own)).where(100 * F.col("s") >= PERCENT * F.col("n"))
    return rows.withColumn("pos", F.row_number().over(own.orderBy("g", "h")))


def first_tokens(rows: DataFrame) -> DataFrame:
    """Rows whose token can be the first that the node has in common with a linked one."""
    return rows.where(100 * (F.col("s") - F.col("pos") + 1) >= PERCENT * F.col("n"))


def may_link(x: str, y: str) -> Column:
    """Whether two rows of one token can be the first common one of sets that link, by places and sizes."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = lambda r: F.col(f"{r}.s") - F.col(f"{r}.pos") + 1
    return fits(n, m) & together(F.least(left(x), left(y)), n, m) & (F.col(f"{x}.comp") != F.col(f"{y}.comp"))


def leader_pairs(firsts: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Pairs (a, b) of each node with the two leaders of its first tokens, if they are in different groups."""
    node, draw = F.struct("node", "n", "s", "pos", "comp"), F.xxhash64("node", F.lit(k))
    leaders = F.array(F.max_by(node, F.struct(F.col("s") / F.col("n"), draw)), F.min_by(node, draw))
    # written, as the join with them is then one that Spark splits when a token is hot
    leads = scratch.table(f"leaders{k}", firsts.groupBy("h").agg(leaders.alias("l")).select("h", F.explode("l").alias("l")).select("h", "l.*"))
    return firsts.alias("x").join(leads.alias("y"), F.col("x.h") == F.col("y.h")).where(may_link("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _ones(words: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(w) for w in words])


def differ(x: str, y: str) -> Column:
    """A lower bound of the tokens that only one of two sets has, by parity."""
    return _ones([F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in PARITY])


def apart(d: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m tokens that differ in d or more can't link."""
    return (100 + PERCENT) * d > (100 - PERCENT) * (n + m)


def group_pairs(firsts: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes with members of other groups that the bounds don't rule out."""
    maps = sets.select("node", *PARITY, *UNION)
    nodes = firsts.select("node", "n", "comp").distinct().join(maps, "node")
    union = [F.expr(f"bit_or({c})").alias(c) for c in UNION] + [F.max(c).alias(c) for c in PARITY]
    groups = scratch.table("groups", nodes.groupBy(F.col("comp").alias("grp")).agg(F.count("*").alias("members"), *union))
    matrix = firsts.groupBy("h", F.col("comp").alias("grp")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    matrix = scratch.table("matrix", matrix.join(groups, "grp"))
    # a node asks larger groups alone, so the members of a token's largest group need not ask for it
    largest = scratch.table("largest", matrix.groupBy("h").agg(F.max(F.struct("members", "grp")).alias("top")))
    size = groups.select(F.col("grp").alias("comp"), "members")
    asking = firsts.join(size, "comp").join(largest, "h").where(F.struct("members", F.col("comp").alias("grp")) < F.col("top")).drop("top")
    asking = scratch.table("asking", asking.join(maps, "node"))
    n, least = F.col("x.n"), F.greatest(F.col("y.least"), F.ceil(PERCENT * F.col("x.n") / 100))
    later = F.struct("x.members", F.col("x.comp").alias("grp")) < F.struct("y.members", "y.grp")
    in_size = (100 * F.col("y.most") >= PERCENT * n) & (PERCENT * F.col("y.least") <= 100 * n) & together(F.col("x.s") - F.col("x.pos") + 1, n, least)
    outside = _ones([F.col(f"x.{c}").bitwiseAND(F.bitwise_not(F.col(f"y.{c}"))) for c in UNION])
    covered = F.when(F.col("y.members") == 1, ~apart(differ("x", "y"), n, F.col("y.most"))).otherwise(together(n - outside, n, least))
    opened = asking.alias("x").join(matrix.alias("y"), F.col("x.h") == F.col("y.h")).where(later & in_size & covered)
    opened = scratch.table("opened", opened.select("x.node", "y.grp").distinct())
    side = scratch.table("members", firsts.join(maps.select("node", *PARITY), "node"))
    x = side.join(opened, "node").alias("x")
    same = (F.col("x.h") == F.col("y.h")) & (F.col("x.grp") == F.col("y.comp"))
    pairs = x.join(side.alias("y"), same).where(may_link("x", "y") & ~apart(differ("x", "y"), n, F.col("y.n")))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def set_links(docs: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, comp) of every node that links with another one; None if none does."""
    sets = coverable(scratch.table("screened_sets", node_sets(docs, own, screened(docs, scratch))), scratch)
    rows, links, labels = _rows(sets), None, None
    for k in range(LEADER_ROUNDS + 1):
        # groups only grow, so what is in one group alone, and nodes too little of which is left, need not come back
        rows = scratch.table(f"rows{k}", active(with_groups(rows, labels)))
        firsts = scratch.table(f"firsts{k}", first_tokens(rows))
        pairs = leader_pairs(firsts, scratch, k) if k < LEADER_ROUNDS else group_pairs(firsts, sets, scratch)
        new = scratch.table(f"links{k}", linked(pairs, sets))
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links)
    return labels


def _labelled(docs: DataFrame) -> DataFrame:
    """document_sets with comp, component_id and n_sets, which are null for an empty set."""
    spark: SparkSession = docs.sparkSession
    with shuffles_end_with_their_query(spark), Scratch(spark) as scratch:
        own = cut(document_sets(docs))
        labels = set_links(docs, own, scratch)
        by = own.where("set_id IS NOT NULL").groupBy(F.col("set_id").alias("node")).agg(F.min("doc_id").alias("first"))
        by = cut(_with_comp(by, labels))
    heads = by.groupBy("comp").agg(F.min("first").alias("component_id"), F.count("*").alias("n_sets"))
    of_set = by.join(heads, "comp").select(F.col("node").alias("set_id"), "comp", "component_id", "n_sets")
    return own.join(of_set, "set_id", "left")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_sets): for every row the least doc_id that links reach, and how many different sets its component has."""
    alone = F.col("component_id").isNull()
    return _labelled(docs).select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_sets", F.lit(1).cast("long")).alias("n_sets"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the least by doc_id (null last), set and text. Rows without tokens all stay, as do all columns."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id", "text_id")
    heads = _labelled(docs).where("set_id IS NOT NULL").groupBy("comp").agg(F.min(order).alias("head")).select(F.col("head.doc_id").alias("id"), F.col("head.text_id").alias("text_id"))
    # the input's columns travel as one, so that none of their names can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    has_words = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    full = rows.where(has_words)
    kept = full.join(heads, F.col("row.doc_id").cast("long").eqNullSafe(heads["id"]) & (F.xxhash64("row.text") == heads["text_id"]))
    # rows that repeat a doc_id and its text
    return kept.dropDuplicates(["id", "text_id"]).select("row").unionByName(rows.where(~has_words)).select("row.*")
