"""Operator 8: benchmark decontamination by MinHash containment search.

Finds benchmark items whose word shingles lie (to ``threshold``) inside a
document of any length.  Jaccard similarity of a short item and a long
document is near zero, so the MinHash is one-sided: an item is signed by the
``k`` smallest hashes of its shingle set, and a document holds the item's
j-th minimum with a probability of exactly the containment.  Items are
partitioned by size; a partition's ``k`` follows from its size so that an
item contained to the threshold is found for certain (k exceeds the shingles
that may be missing), or, in partitions of large items, is missed with a
probability under ``miss``.  Candidates are verified by exact containment of
the shingles' words.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens.llm.common import id_and_text, stored
from phonelens.llm.textblocks import Words, blocks, combine

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-12
INDEX_BYTES = 16 << 20  # item texts of one broadcast block; more items make more blocks
SCHEMA = "doc_id long, text_key long, item_id long, n_item_shingles long, n_shared long"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def size_class(n: int) -> int:
    """Items of 1-15, 16-31, 32-63, ... shingles share a partition."""
    return max(4, n.bit_length())


def minima(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """How many minima sign an item of n shingles."""
    upper = (1 << size_class(n)) - 1
    certain = upper - math.ceil(threshold * upper) + 1
    likely = math.ceil(math.log(miss) / math.log(1 - threshold)) if threshold < 1 else 1
    return min(n, certain, likely)


def shingle_set(text: bytes, n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """Distinct n-word shingles, ASCII lower case; a shorter text is one."""
    w = _WORD.findall(text.lower())
    if not w:
        return set()
    return {tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))}


@dataclass
class Index:
    """Signatures of a block of items: sorted hashes and the items they sign."""

    lengths: list[int]
    hashes: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]
    texts: list[tuple[int, bytes]]


def build_index(items: list[tuple[int, bytes]], threshold: float, n: int = SHINGLE) -> Index:
    by: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for i, (_, text) in enumerate(items):
        raw = np.frombuffer(text, np.uint8)
        words = Words(raw, np.array([0, len(raw)]))
        if not len(words.start):
            continue
        length = min(n, len(words.start))
        h = np.unique(combine(words.hashes(lower=True), length))
        for x in h[: minima(len(h), threshold)]:
            by[length][int(x)].append(i)
    hashes = {k: np.array(sorted(v), np.uint64) for k, v in by.items()}
    return Index(sorted(by), hashes, {k: [v[int(x)] for x in hashes[k]] for k, v in by.items()}, items)


def _hits(words: Words, index: Index) -> dict[int, set[int]]:
    """Texts of a block and the items of which they hold a minimum."""
    out: dict[int, set[int]] = defaultdict(set)
    h = words.hashes(lower=True)
    for length in index.lengths:
        grams, known = combine(h, length), index.hashes[length]
        if not len(grams):
            continue
        at = np.searchsorted(known, grams)
        found = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == grams)
        owner = np.searchsorted(words.first, found, "right") - 1
        inside = found + length <= words.first[owner + 1]  # not across two texts
        for d, g in zip(owner[inside].tolist(), at[found[inside]].tolist()):
            out[d].update(index.items[length][g])
    return out


def _search(docs: DataFrame, index, threshold: float, n: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        wanted: dict[int, set] = {}
        for batch in batches:
            ids, keys, rows = batch.column("doc_id"), batch.column("text_key"), []
            for span, raw, offsets in blocks(batch):
                for d, candidates in _hits(Words(raw, offsets), ix).items():
                    text = raw[offsets[d]: offsets[d + 1]].tobytes()
                    own: dict[int, set] = {}
                    for i in candidates:
                        if i not in wanted:
                            wanted[i] = shingle_set(ix.texts[i][1], n)
                        width = min(n, len(next(iter(wanted[i]))))
                        if width not in own:
                            own[width] = shingle_set(text, width)
                        shared = len(wanted[i] & own[width])
                        if shared >= threshold * len(wanted[i]):
                            rows.append((ids[span.start + d].as_py(), keys[span.start + d].as_py(), ix.texts[i][0], len(wanted[i]), shared))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=[c.split()[0] for c in SCHEMA.split(", ")])
    return docs.mapInArrow(run, SCHEMA)


def item_blocks(benchmark: DataFrame, id_col: str, limit: int = INDEX_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of at most ``limit`` bytes of text (one item
    at least), a partition of it at a time on the driver.  The query set is
    stated: a block is what one broadcast holds; a larger benchmark takes more
    passes over the documents, never a larger broadcast."""
    q = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    block: list[tuple[int, bytes]] = []
    size = 0
    for r in q.filter(F.col("text").isNotNull()).toLocalIterator():
        text = r.text.encode()
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((r.id, text))
        size += len(text)
    if block:
        yield block


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE,
                      item_id: str = "item_id", limit: int = INDEX_BYTES) -> DataFrame:
    """``contaminated`` with ``text_key``, a hash of the row's text that tells
    apart rows with shared or NULL ids.

    With several blocks of items, each block's matches are written and its
    broadcast released before the next is read."""
    d = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    spark = docs.sparkSession
    out, last = spark.createDataFrame([], SCHEMA), None
    for items in item_blocks(benchmark, item_id, limit):
        if last is not None:
            out = out.union(stored(_search(d, last, threshold, n)))
            last.destroy()
        last = spark.sparkContext.broadcast(build_index(items, threshold, n))
    return out if last is None else out.union(_search(d, last, threshold, n))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE,
                 item_id: str = "item_id", limit: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared) for every document row and
    item row with n_shared >= threshold * n_item_shingles.

    Shingles are ``n`` words, distinct, ASCII lower case; an item with fewer
    words is one shingle.  NULL, empty and blank texts hold and match
    nothing; repeated rows each report; an empty table on either side gives
    no rows.  Documents never move; a very common passage only makes more
    candidates within the tasks that read it."""
    return contaminated_rows(docs, benchmark, threshold, n, item_id, limit).drop("text_key")
