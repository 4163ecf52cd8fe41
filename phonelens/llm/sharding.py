"""Operator 3: sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards; a key descends level by level, and at
each node every child draws a weighted hash (an exponential arrival time with
the child's weight as rate); the earliest child wins.  Raising a child's
weight moves keys only into that child, and a new subtree takes keys only
into itself: all movement stays inside subtrees whose weights change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonelens.functions.ranking import ranked

HEX_DIGITS = 12
RESOLUTION = float(16 ** HEX_DIGITS)


@dataclass(frozen=True)
class Node:
    """``weight`` is the node's draw rate; a leaf has ``shard`` set."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def tree(n_shards: int, regions: int = 2, racks: int = 3) -> Node:
    """``n_shards`` equal shards: as many whole regions of equal racks as
    fit, and one region of its own for every shard that is left over.

    The base size is the largest multiple of regions x racks that is at most
    ``n_shards``; ``grown`` adds one more single-shard region."""
    per_rack = n_shards // (regions * racks)
    out, at = [], 0
    for r in range(regions if per_rack else 0):
        shelf = []
        for k in range(racks):
            name = f"r{r}.k{k}"
            leaves = tuple(Node(f"{name}.s{i}", 1.0, shard=i) for i in range(at, at + per_rack))
            at += per_rack
            shelf.append(Node(name, float(per_rack), leaves))
        out.append(Node(f"r{r}", float(per_rack * racks), tuple(shelf)))
    root = Node("root", float(at), tuple(out))
    while at < n_shards:
        root, at = grown(root, at), at + 1
    return root


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard in a region and rack of its own; no
    other node's weight changes, so only this shard receives keys."""
    name = f"r+{shard}"
    leaf = Node(f"{name}.k0.s{shard}", weight, shard=shard)
    region = Node(name, weight, (Node(f"{name}.k0", weight, (leaf,)),))
    return Node(root.name, root.weight + weight, (*root.children, region))


def _arrival(key: Column, node: Node) -> Column:
    """-ln(u) / weight with u in (0, 1] from an md5 of key and node name."""
    digits = F.substring(F.md5(F.concat(key, F.lit("/" + node.name))), 1, HEX_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(1.0)) / F.lit(RESOLUTION)
    return -F.log(u) / F.lit(node.weight)


def place(key: Column, root: Node) -> Column:
    """The shard of a key (a non-NULL string column) as one expression: only
    the nodes on the key's own path are drawn."""
    live = [c for c in root.children if c.weight > 0]
    if not live:
        return F.lit(root.shard).cast("int")
    if len(live) == 1:
        return place(key, live[0])
    draws = F.array(*[F.struct(_arrival(key, c).alias("a"), F.lit(i).alias("i")) for i, c in enumerate(live)])
    # the winner is bound to a lambda variable, so the draws are made once
    def descend(win: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, c in reversed(list(enumerate(live))):
            out = F.when(win["i"] == i, place(key, c)).otherwise(out)
        return out
    return F.element_at(F.transform(F.array(F.array_min(draws)), descend), 1)


def shard_table(docs: DataFrame, root: Node, bigger: Node | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard for every row.

    ``size`` is the text's UTF-8 bytes plus 8 (NULL: none); ``slot`` numbers a
    shard's rows from 0 without gaps in the order of doc_id (equal ids by
    size and CRC, then arbitrarily but once).  A NULL doc_id is a key like any
    other ("null").  Repeated rows each get a slot.  Texts never move; only
    the six numbers of a row are sorted, over as many tasks as there are
    partitions, however large a shard or a key is."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        place(key, root).alias("shard"),
        (place(key, bigger) if bigger else F.lit(None).cast("int")).alias("grown_shard"),
    ).withColumn("tie", F.monotonically_increasing_id())
    out = ranked(rows, ["shard"], [F.col(c) for c in ("doc_id", "size", "text_crc32", "tie")], "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
