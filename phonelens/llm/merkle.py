"""Operator 13: Merkle manifest of a data set in van Emde Boas layout.

Every row is a leaf.  The leaves of a language, in the order of their ids, are
cut into aligned blocks of ``2**BLOCK_HEIGHT``; a task builds a block's binary
tree and stores its digests in one array in van Emde Boas order: the levels
are split at half height, the upper subtree comes first, then every lower
subtree, each laid out alike.  ``address`` gives a node's place from its depth
and index alone, for construction and for reading siblings, so a path from
leaf to root stays in few neighbouring pieces whatever the size of a cache
line or page.  Block roots are the leaves of the next round of blocks, until a
language has one; the languages' roots make a last tree in the same way.
Proofs come back down: a block's path above it is read once and shared by its
leaves.

A node is the hash of the (one or two) nodes below it, so a run's last node
may have one child; a tree of one leaf has no inner node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonelens.functions.joins import join_bounded
from phonelens.functions.ranking import ranked
from phonelens.llm.common import stored

BLOCK_HEIGHT = 12
TASK_LEAVES = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALONE, RIGHT, LEFT = b"\0", b"\1", b"\2"  # where a step's sibling is
BLOCK = "tree string, block long, n int, height int, nodes binary, root binary"
PATHS = "tree string, at long, path binary"


# ---- layout
def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes in the van Emde Boas order of a complete tree of
    ``levels`` levels; ``index`` counts the nodes of ``depth`` from 0."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = depth - top
    bottom = levels - top
    inside = address(bottom, below, index & ((1 << below) - 1))
    return ((1 << top) - 1) + (index >> below) * ((1 << bottom) - 1) + inside


@lru_cache(maxsize=256)
def places(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(1 << depth, dtype=np.int64))


def widths(n: int, height: int) -> list[int]:
    """Nodes at each depth, the root's first, over ``n`` leaves."""
    out = [n]
    for _ in range(height):
        out.append(-(-out[-1] // 2))
    return out[::-1]


def node(*children: bytes) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def build(leaves: list[bytes], height: int) -> np.ndarray:
    """The block's digests [place, 32] in van Emde Boas order."""
    nodes = np.zeros((2 ** (height + 1) - 1, 32), np.uint8)
    row = leaves
    for depth in range(height, -1, -1):
        nodes[places(height + 1, depth)[: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        row = [node(*row[i: i + 2]) for i in range(0, len(row), 2)]
    return nodes


def sibling_path(nodes: np.ndarray, n: int, height: int, leaf: int) -> bytes:
    """The steps from a leaf to the block's root: where the sibling is, and
    its digest."""
    out, at = [], leaf
    for depth, width in zip(range(height, 0, -1), widths(n, height)[:0:-1]):
        other = at ^ 1
        if other < width:
            out.append((LEFT if at & 1 else RIGHT) + nodes[places(height + 1, depth)[other]].tobytes())
        else:
            out.append(ALONE)
        at >>= 1
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(path):
        side = path[at: at + 1]
        end = at + 1 if side == ALONE else at + 33
        yield side, path[at + 1: end]
        at = end


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, sibling in steps(path):
        leaf = node(leaf) if side == ALONE else node(leaf, sibling) if side == RIGHT else node(sibling, leaf)
    return leaf


def proof(path: bytes) -> str:
    return hashlib.sha256(b"".join(s.hex().encode() for _, s in steps(path))).hexdigest()


# ---- blocks
def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """Rows of one (tree, block) at a time; they arrive sorted."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        tree, block = batch.column("tree").to_pylist(), batch.column("block").to_numpy(zero_copy_only=False)
        cuts = [0, *(i for i in range(1, len(tree)) if block[i] != block[i - 1] or tree[i] != tree[i - 1]), len(tree)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            here = (tree[a], int(block[a]))
            if held and here != key:
                yield *key, pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield *key, pa.Table.from_batches(held)


def _build_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tree, block, rows in _runs(batches):
        n, height = len(rows), rows.column("height")[0].as_py()
        nodes = build(rows.column("digest").to_pylist(), height)
        yield pa.RecordBatch.from_pylist(
            [{"tree": tree, "block": block, "n": n, "height": height, "nodes": nodes.tobytes(), "root": nodes[0].tobytes()}],
            schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("height", pa.int32()),
                              ("nodes", pa.binary()), ("root", pa.binary())]))


def _dealt(rows: DataFrame, order: str, count: int) -> DataFrame:
    """Whole blocks to tasks; their number follows the rows."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // TASK_LEAVES + 1)
    return rows.repartition(tasks, "tree", "block").sortWithinPartitions("tree", "block", order)


def forest(leaves: DataFrame, block_height: int = BLOCK_HEIGHT) -> list[DataFrame]:
    """Block tables from the leaves up; ``leaves``: tree, at (gapless from 0
    in each tree), digest (binary).  The last table holds one block of each
    tree that is still open."""
    out = []
    while True:
        totals = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
        count, widest = totals.agg(F.sum("total"), F.max("total")).first()
        if not count:
            return out
        # of one block: as high as its leaves need; of several: all of the same height
        bits = F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0)
        height = F.least(bits, F.lit(block_height))
        rows = join_bounded(leaves, totals, ["tree"]).select(
            "tree", F.shiftright("at", block_height).alias("block"), "at", "digest", height.alias("height"))
        out.append(stored(_dealt(rows, "at", count).mapInArrow(_build_blocks, BLOCK)))
        if widest <= 1 << block_height:
            return out
        several = out[-1].filter("block > 0").select("tree").distinct()
        leaves = out[-1].join(several, "tree", "left_semi").select("tree", F.col("block").alias("at"), F.col("root").alias("digest"))


def tree_roots(blocks: list[DataFrame]) -> DataFrame:
    """(tree, root): of each tree its only block of the highest table it is in."""
    every = None
    for level, b in enumerate(blocks):
        own = b.select("tree", F.lit(level).alias("level"), "root")
        every = own if every is None else every.union(own)
    return every.groupBy("tree").agg(F.max_by("root", "level").alias("root"))


def _block_paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            nodes = np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32)
            first = r["first"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["tree"]] * r["n"], pa.string()), pa.array(range(first, first + r["n"]), pa.int64()),
                 pa.array([sibling_path(nodes, r["n"], r["height"], i) + r["above"] for i in range(r["n"])], pa.binary())],
                names=["tree", "at", "path"])


def _leaf_paths(blocks: DataFrame, block_height: int) -> DataFrame:
    """(tree, at, path) of every leaf of blocks with ``above``."""
    rows = blocks.select("tree", F.shiftleft("block", block_height).alias("first"), "n", "height", "nodes", "above")
    return stored(rows.mapInArrow(_block_paths, PATHS))


def block_tops(blocks: list[DataFrame], base: DataFrame, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """The lowest block table with ``above``: each block's path from its root
    to the whole's; ``base`` (tree, path) is what follows a tree's root."""
    above = None
    for level in range(len(blocks) - 1, -1, -1):
        b = join_bounded(blocks[level], base.select("tree", F.col("path").alias("base")), ["tree"])
        if above is None:
            b = b.withColumn("above", F.col("base"))
        else:
            b = b.join(above.select("tree", F.col("at").alias("block"), "path"), ["tree", "block"], "left")
            b = b.withColumn("above", F.coalesce("path", "base")).drop("path")
        if level == 0:
            return b
        above = _leaf_paths(b, block_height)


# ---- rows
def row_digest(fields: dict[str, Column]) -> Column:
    """Hex SHA-256 over the fields: "-" for NULL, else byte count, ":", value."""
    def part(x: Column) -> Column:
        s = x.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[part(fields[f]) for f in FIELDS]).cast("binary"), 256)


PROVED = "doc_id long, leaf string, subroot binary, proof_sha256 string, folded_root string"


def _prove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, rows in _runs(batches):
        top = rows.slice(0, 1).to_pylist()[0]  # the block itself sorts before its leaves
        nodes = np.frombuffer(top["nodes"], np.uint8).reshape(-1, 32)
        leaves = rows.slice(1)
        paths = [sibling_path(nodes, top["n"], top["height"], i) + top["above"] for i in range(top["n"])]
        leaf, tampered = leaves.column("leaf").to_pylist(), leaves.column("tampered").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [leaves.column("doc_id").combine_chunks(), pa.array([x.hex() for x in leaf], pa.string()),
             pa.array([top["subroot"]] * len(leaf), pa.binary()), pa.array([proof(p) for p in paths], pa.string()),
             pa.array([fold(t if t is not None else x, p).hex() for x, t, p in zip(leaf, tampered, paths)], pa.string())],
            names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, tampered: Column | None = None, change: dict[str, Column] | None = None,
             block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for
    every row.

    Rows for which ``tampered`` holds are checked as if ``change`` (field:
    column) had been done to them after the manifest was made; all else is of
    the untampered rows.  Any field may be NULL: it counts as "-", a NULL
    language is a language of its own (the first), a NULL doc_id sorts first.
    Rows that share a doc_id follow each other by their digest; repeated rows
    are a leaf each.  An empty table gives no row.  Other columns are not
    read."""
    types = {"doc_id": "long", "n_chars": "long"}
    fields = {f: F.col(f"`{f}`").cast(types.get(f, "string")) for f in FIELDS}
    altered = row_digest({**fields, **(change or {})})
    rows = docs.select(
        F.concat(F.when(fields["lang"].isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(fields["lang"], F.lit(""))).alias("tree"),
        fields["doc_id"].alias("doc_id"), F.unhex(row_digest(fields)).alias("leaf"),
        F.unhex(F.when(tampered, altered) if tampered is not None else F.lit(None).cast("string")).alias("tampered"))
    leaves = stored(ranked(stored(rows), ["tree"], [F.col("doc_id"), F.col("leaf")], "at").select(
        "tree", F.col("at").cast("long").alias("at"), "doc_id", "leaf", "tampered"))
    blocks = forest(leaves.select("tree", "at", F.col("leaf").alias("digest")), block_height)
    spark = docs.sparkSession
    if not blocks:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                         "folded_root string, verified boolean")
    subroots = stored(tree_roots(blocks).withColumnRenamed("root", "subroot"))
    order = stored(ranked(subroots.withColumn("all", F.lit("")), ["all"], [F.col("tree")], "at").select(
        F.lit("").alias("tree"), F.col("at").cast("long").alias("at"), F.col("subroot").alias("digest"), F.col("tree").alias("lang")))
    top = forest(order.select("tree", "at", "digest"), block_height)
    root = tree_roots(top).first()["root"].hex()  # one digest
    no_path = spark.createDataFrame([("", b"")], "tree string, path binary")
    of_top = _leaf_paths(block_tops(top, no_path, block_height), block_height)
    base = stored(order.join(of_top, ["tree", "at"]).select(F.col("lang").alias("tree"), "path"))
    lowest = join_bounded(block_tops(blocks, base, block_height), subroots, ["tree"])
    heads = lowest.select("tree", "block", F.lit(-1).cast("long").alias("at"), "n", "height", "nodes", "above", "subroot",
                          *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("leaf", "binary"), ("tampered", "binary"))])
    body = leaves.select("tree", F.shiftright("at", block_height).alias("block"), "at",
                         *[F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("height", "int"), ("nodes", "binary"),
                                                                      ("above", "binary"), ("subroot", "binary"))],
                         "doc_id", "leaf", "tampered")
    proved = _dealt(heads.union(body), "at", leaves.count()).mapInArrow(_prove, PROVED)
    return proved.select("doc_id", "leaf", F.lower(F.hex("subroot")).alias("subroot"), F.lit(root).alias("root"),
                         "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
