"""Runs: stretches of words that repeat with a period, found by longest common extensions.

In a stretch of words every run of exponent 2 or more has a Lyndon root that is the longest Lyndon word from its first
word, in the order of words or in the opposite one. That word ends before the next smaller (or greater) suffix. So two candidates
a word are enough: each is extended to the right by the longest common extension of its two first copies, and to the left by that
of the reversed stretch. Both come from suffix trees (Ukkonen's construction) in constant time: the extension of two
suffixes is the depth of their lowest common ancestor, a range minimum over the Euler tour, of which the lowest node
between each two neighbouring leaves is kept. A stretch of n words takes O(n log n) time and memory, some 600 bytes a word.

Before that, words that can be in no wanted run are cut out, which loses nothing: a run of length l >= 4 q holds each of its words again within
q words, so in a stretch of s words the next equal one is at most s / 4 away. What is left of ordinary prose is little.

Null and empty texts have no words and no runs; their rows stay. A row is worked off alone, so repeated rows, ties and null ids need no rule;
a null id gets no planted repeat. A very long text is held in one task. Of the columns only doc_id and text are read, so
names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vicinage.llm.common import WORD, in_slices

SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
LEAST, TIMES = 6, 4
_WORD = re.compile(WORD)
_FAR = 1 << 40


def suffix_tree(s: list[int], base: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's construction over s, whose last symbol occurs once; symbols are below base.

    (children, starts, stops): children[node * base + symbol] is the node behind the edge that starts with the symbol, whose
    label is s[starts[node]:stops[node]]. Node 0 is the root; a leaf stops at len(s), and leaves come into being in the order of their suffixes.
    """
    n = len(s)
    child: dict[int, int] = {}
    start, stop, link = [0], [0], [0]
    node, edge, along, waiting, new = 0, 0, 0, 0, 1
    for i, c in enumerate(s):
        waiting += 1
        last = 0
        while waiting:
            if not along:
                edge = i
            key = node * base + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = new
                start.append(i)
                stop.append(n)
                link.append(0)
                new += 1
                if last:
                    link[last] = node
                    last = 0
            else:
                first = start[below]
                length = stop[below] - first
                if along >= length:
                    node, along, edge = below, along - length, edge + length
                    continue
                if s[first + along] == c:
                    along += 1
                    if last:
                        link[last] = node
                    break
                middle = first + along
                start += (first, i)
                stop += (middle, n)
                link += (0, 0)
                child[key] = new
                child[new * base + c] = new + 1
                child[new * base + s[middle]] = below
                start[below] = middle
                if last:
                    link[last] = new
                last = new
                new += 2
            waiting -= 1
            if node:
                node = link[node]
            elif along:
                along -= 1
                edge = i - waiting + 1
    return child, start, stop


class Extensions:
    """Constant-time longest common extensions of a word sequence, whose symbols are 1 and up."""

    def __init__(self, s: list[int], base: int):
        n = len(s)
        child, start, stop = suffix_tree([*s, 0], base)
        keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        order = np.argsort(-keys)
        above = keys[order] // base
        behind = np.fromiter(child.values(), dtype=np.int64, count=len(child))[order]
        # the children of a node are a range, the last one first
        nodes = len(start)
        lo, hi = np.searchsorted(-above, -np.arange(nodes), side="left"), np.searchsorted(-above, -np.arange(nodes), side="right")
        parent, first = np.zeros(nodes, dtype=np.int64), np.ones(nodes, dtype=bool)
        parent[behind] = above
        first[behind[:-1][above[:-1] == above[1:]]] = False  # another child of the node comes before it
        tour, stack = [], [0]
        kids, lows, highs = behind.tolist(), lo.tolist(), hi.tolist()
        up, depth = parent.tolist(), [0] * nodes
        while stack:
            v = stack.pop()
            tour.append(v)
            a, b = lows[v], highs[v]
            if a < b:
                depth[v] = depth[up[v]] + stop[v] - start[v] if v else 0
                stack += kids[a:b]
        at = np.array(tour)
        leaf = hi[at] == lo[at]
        # the tour goes through a node's parent just before each of its children but the first
        turned = np.maximum.accumulate(np.where(first[at], 0, np.arange(len(at))))
        depths = np.array(depth)
        self.common = depths[parent[at[turned]]][leaf]
        # leaves are numbered as they came, which is the order of suffixes
        leaves = at[leaf]
        suffix = np.empty(n + 1, dtype=np.int64)
        suffix[np.argsort(leaves, kind="stable")] = np.arange(n + 1)
        self.rank = np.empty(n + 1, dtype=np.int64)
        self.rank[suffix] = np.arange(n + 1)
        self.table = [self.common.astype(np.int32)]
        width = 1
        while 2 * width <= n + 1:
            t = self.table[-1]
            self.table.append(np.minimum(t[:-width], t[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes from i and j (unlike each other, len(s) for the empty one) share at their start."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            t = self.table[k]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << k) + 1])
        return out


def next_beyond(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the next one of a smaller and of a greater rank; len(rank) if there is none."""
    n = len(rank)
    less, more = [n] * n, [n] * n
    falls: list[int] = []
    rises: list[int] = []
    for i, r in enumerate(rank):
        while falls and rank[falls[-1]] > r:
            less[falls.pop()] = i
        falls.append(i)
        while rises and rank[rises[-1]] < r:
            more[rises.pop()] = i
        rises.append(i)
    return less, more


def runs_in(s: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of a stretch with length >= max(LEAST, TIMES * period); s holds numbers of words."""
    n = len(s)
    _, s = np.unique(s, return_inverse=True)
    own = (s + 1).tolist()
    base = int(s.max()) + 2
    ahead = Extensions(own, base)
    less, more = next_beyond(ahead.rank[:n].tolist())
    at = np.arange(n)
    i, j = np.concatenate([at, at]), np.concatenate([less, more])
    wanted = (j < n) & (TIMES * (j - i) <= n)
    i, j = i[wanted], j[wanted]
    right = ahead(i, j)
    # a run holds its root twice, and grows to the left by less than a root
    back = Extensions(own[::-1], base)
    left = back(n - i, n - j)  # the reversed suffix from n - i is what stands before i, read backwards
    found = np.stack([i - left, j - i + left + right, j - i], axis=1)
    long = found[:, 1] >= np.maximum(LEAST, TIMES * found[:, 2])
    return np.unique(found[long], axis=0)


def stretches(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, words) of the parts of x that can hold wanted runs; every such run lies inside one."""
    at = np.arange(len(x))
    while len(at):
        part = np.cumsum(np.r_[0, np.diff(at) != 1])
        size = np.bincount(part)[part]
        key = part * (int(x.max()) + 1) + x[at]
        order = np.argsort(key, kind="stable")
        k, place = key[order], at[order]
        gap = np.where(k[1:] == k[:-1], np.diff(place), _FAR)
        near = np.empty(len(at), dtype=np.int64)
        near[order] = np.minimum(np.r_[_FAR, gap], np.r_[gap, _FAR])
        good = (TIMES * near <= size) & (size >= LEAST)
        if good.all():
            break
        at = at[good]
    if len(at):
        for p in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
            yield int(p[0]), x[p]


def find_runs(words: list[str]) -> np.ndarray:
    """(start, length, period) of every run of the words, by start and period."""
    number: dict[str, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    found = [runs_in(s) + np.array([at, 0, 0]) for at, s in stretches(x)]
    out = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    return out[np.lexsort((out[:, 1], out[:, 2], out[:, 0]))]


def plant(doc_id: int | None, words: list[str]) -> list[str]:
    """In one of ten documents, by its id, the words from some place on repeat with a period."""
    if doc_id is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def summary(words: list[str]) -> tuple:
    """n_runs, the greatest run, and digests of all runs and of the words that stay; a run's first period stays."""
    runs = find_runs(words)
    if not len(runs):
        return 0, None, None, None, None, sha256().hexdigest(), sha256(" ".join(words).encode()).hexdigest()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(edge)[:-1] == 0
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
    kept = " ".join(w for w, k in zip(words, stay.tolist(), strict=True) if k)
    return len(runs), start, length, period, 1000 * length // period, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest()


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per row (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256); planted: plant() comes first.

    start, length and period are those of the longest run, of the first such, with the smallest period; null without runs.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = _WORD.findall(t or "")
                out.append(summary(plant(i, words) if planted else words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
