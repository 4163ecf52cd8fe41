"""Exact set-similarity links inside candidate blocks.

Candidate edges make blocks (their connected components).  A block is cut, in
the order of set size, into chunks of ``CHUNK`` members; one group per pair of
chunks whose sizes allow a link is searched in one task, so a block of any
size is searched whole in bounded pieces.  A search is T-occurrence over the
chunk's inverted lists by DivideSkip: merge the short lists on a heap, probe
the long ones by binary search, keep members that reach the overlap.  Groups
return spanning links only, never all pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens.functions.ranking import ranked
from phonelens.llm.common import discard, stored
from phonelens.llm.components import components

CHUNK = 512
MU = 0.0085  # DivideSkip's price of a probe against a merge step
DENSE = 64   # members of a group that are compared in one table, unless the heap is asked for
HUBS = 4     # components whose hubs are tried before a search


class Links:
    """Union-find over a group's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def _heap_merge(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, lists that hold it) for members in at least ``least`` lists."""
    found: list[int] = []
    count: list[int] = []
    last, run = -1, 0
    for m in heapq.merge(*(x.tolist() for x in lists)):
        if m == last:
            run += 1
            continue
        if run >= least:
            found.append(last)
            count.append(run)
        last, run = m, 1
    if run >= least:
        found.append(last)
        count.append(run)
    return np.array(found, np.int64), np.array(count, np.int64)


def _sort_merge(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by one sort: cheaper in numpy for lists of some length."""
    m = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) if len(m) else m
    run = np.diff(np.r_[first, len(m)])
    keep = run >= least
    return m[first[keep]], run[keep]


class Lists:
    """Inverted lists token -> members, and which members hold a query's tokens often enough."""

    def __init__(self, sets: list[np.ndarray], heap: bool = True):
        self.heap = heap
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.member, tokens = owner[order], tokens[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        self.token, self.begin, self.stop = tokens[first], first, np.r_[first[1:], len(tokens)]
        self.key = np.repeat(np.arange(len(first)), self.stop - self.begin) * len(sets) + self.member
        self.n = len(sets)
        self.longest = int((self.stop - self.begin).max())

    def search(self, query: np.ndarray, need: int, wanted: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(member, overlap) for members of ``wanted`` with overlap >= need;
        lists are read up to member ``upto`` only."""
        at = np.searchsorted(self.token, query)
        ok = at < len(self.token)
        at = at[ok]
        at = at[self.token[at] == query[ok]]
        stop = np.searchsorted(self.key, at * self.n + upto)
        length = stop - self.begin[at]
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        if len(order) < need:
            return at[:0], at[:0]
        at, stop = at[order], stop[order]
        skip = max(0, min(need - 1, int(need / (MU * math.log2(self.longest + 1) + 1))))
        short, long = at[: len(at) - skip], at[len(at) - skip:]
        spans = [self.member[self.begin[i]: j] for i, j in zip(short, stop)]
        members, overlap = (_heap_merge if self.heap else _sort_merge)(spans, max(1, need - skip))
        keep = wanted[members]
        members, overlap = members[keep], overlap[keep]
        if len(members) and len(long):
            probe = (long[:, None] * self.n + members[None, :]).ravel()
            p = np.searchsorted(self.key, probe)
            hit = self.key[np.minimum(p, len(self.key) - 1)] == probe
            overlap = overlap + hit.reshape(len(long), -1).sum(axis=0)
        enough = overlap >= need
        return members[enough], overlap[enough]


def group_links(sets: list[np.ndarray], index_of: list[bool], percent: int, heap: bool = True) -> list[tuple[int, int]]:
    """Spanning links of one group.

    Members with ``index_of`` are indexed; when all are, each is searched
    against those before it, otherwise the others are searched against
    them.  A link: 100 * overlap >= percent * union.  Members already
    connected to the query need no probe: they change nothing."""
    indexed = [i for i, x in enumerate(index_of) if x]
    own = len(indexed) == len(sets)
    if not indexed or (own and len(sets) < 2):
        return []
    if len(sets) == 2:  # nothing to merge
        return [(0, 1)] if _linked(*sets, percent) else []
    if not heap and own and len(sets) <= DENSE:
        return _dense_links(sets, percent)
    lists = Lists([sets[i] for i in indexed], heap)
    names = np.array(indexed)
    root, hits = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    hub: dict[int, int] = {}  # of a component: the member that most queries linked to
    out: list[tuple[int, int]] = []

    def join(m: int, q: int) -> None:
        out.append((m, q))
        hits[m] += 1
        a, b = sorted((int(root[m]), int(root[q])))
        hub[a] = max(hub.pop(a, a), hub.pop(b, b), m, key=lambda i: hits[i])
        root[root == b] = a

    for q in indexed if own else [i for i, x in enumerate(index_of) if not x]:
        s = sets[q]
        before = names < q if own else np.ones(len(names), bool)
        wanted = before & (root[names] != root[q])
        others = np.unique(root[names[wanted]])
        if len(others) <= HUBS:  # a link to a component's hub spares its other members
            for r in others.tolist():
                h = hub.get(r, r)
                if (h < q if own else index_of[h]) and _linked(sets[h], s, percent):
                    join(h, q)
            wanted = before & (root[names] != root[q])
        if not wanted.any():
            continue
        need = -(-percent * len(s) // 100)  # an overlap of at least this share of either set
        members, overlap = lists.search(s, need, wanted, int(np.searchsorted(names, q)) if own else len(names))
        union = len(s) + lists.sizes[members] - overlap
        for m in names[members[100 * overlap >= percent * union]].tolist():
            if root[m] != root[q]:
                join(m, q)
    return out


def _dense_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The same for a small group whose members are all indexed: one table of
    members and tokens gives every overlap."""
    sizes = np.array([len(s) for s in sets])
    tokens, which = np.unique(np.concatenate(sets), return_inverse=True)
    table = np.zeros((len(sets), len(tokens)), np.float32)
    table[np.repeat(np.arange(len(sets)), sizes), which] = 1
    overlap = np.rint(table @ table.T).astype(np.int64)
    i, j = np.nonzero(np.triu(100 * overlap >= percent * (sizes[:, None] + sizes[None, :] - overlap), 1))
    links, out = Links(len(sets)), []
    for a, b in zip(i.tolist(), j.tolist()):
        if links.root(a) != links.root(b):
            links.join(a, b)
            out.append((a, b))
    return out


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    overlap = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * overlap >= percent * (len(a) + len(b) - overlap)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows with equal (block, a, b); rows arrive sorted by them."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["block"], row["a"], row["b"]) != (rows[0]["block"], rows[0]["a"], rows[0]["b"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def block_groups(edges: DataFrame, sizes: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """(key, block, a, b, index): the groups in which each member is searched.

    ``edges``: candidate pairs of keys; ``sizes``: (key, n), one row for each
    key that has an edge (others are passed over).  Chunks a <= b of a block meet when the smallest set of b is
    not too large for the largest of a."""
    blocks = components(edges)
    members = blocks.select(F.col("node").alias("key"), F.col("root").alias("block")).union(
        blocks.select(F.col("root").alias("key"), F.col("root").alias("block")).distinct())
    members = ranked(members.join(sizes, "key"), ["block"], [F.col("n"), F.col("key")], "at")
    members = stored(members.select("key", "n", "block", F.floor(F.col("at") / chunk).cast("int").alias("chunk")))
    discard(blocks)
    spans = members.groupBy("block", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a = spans.select("block", F.col("chunk").alias("a"), F.col("high").alias("a_high"))
    b = spans.select("block", F.col("chunk").alias("b"), F.col("low").alias("b_low"))
    meet = stored(a.join(b, "block").filter((F.col("a") <= F.col("b")) & (F.col("b_low") * percent <= F.col("a_high") * 100))
                  .select("block", "a", "b"))
    first = members.join(meet, (members.block == meet.block) & (members.chunk == meet.a)).select(
        "key", members.block, "a", "b", F.lit(True).alias("index"))
    second = members.join(meet.filter("a < b"), (members.block == meet.block) & (members.chunk == meet.b)).select(
        "key", members.block, "a", "b", F.lit(False).alias("index"))
    groups = stored(first.union(second))
    discard(members, meet)
    return groups


def search_groups(rows: DataFrame, to_set: Callable[[str], np.ndarray], name: Callable[[np.ndarray], int] | None,
                  percent: int, heap: bool = True) -> DataFrame:
    """Links (x, y) between keys; ``rows``: key, block, a, b, index, n, text.

    With ``name``, a row whose text does not give the set that its key names
    (rows that share a doc_id) is passed over."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            named = {r["key"]: (r, s) for r in group for s in [to_set(r["text"])] if name is None or name(s) == r["key"]}
            group, sets = [r for r, _ in named.values()], [s for _, s in named.values()]
            found = group_links(sets, [r["index"] for r in group], percent, heap)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[i]["key"] for i, _ in found], pa.int64()),
                     pa.array([group[j]["key"] for _, j in found], pa.int64())], names=["x", "y"])
    dealt = rows.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b", F.desc("index"), "n", "key")
    return dealt.select("key", "block", "a", "b", "index", "text").mapInArrow(run, "x long, y long")
