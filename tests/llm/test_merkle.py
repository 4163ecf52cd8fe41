"""Operator 13 against a tree built by hand, and the layout's arithmetic."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonelens.llm import merkle
from tests.llm.conftest import documents


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_over(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i: i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def hit(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def by_hand(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: digest(*map(part, (
        r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)))
    order = sorted(rows, key=lambda r: (r.lang is not None, (r.lang or "").encode(), r.doc_id is not None, r.doc_id or 0, leaf(r)))
    langs = list(dict.fromkeys(r.lang for r in order))
    runs = {lang: [r for r in order if r.lang == lang] for lang in langs}
    trees = {lang: levels_over([leaf(r) for r in run]) for lang, run in runs.items()}
    top = levels_over([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(runs[lang]):
            siblings, now = [], leaf(r, int(hit(r.doc_id)))
            for tree, at in ((trees[lang], i), (top, k)):
                for level in tree[:-1]:
                    if at ^ 1 < len(level):
                        siblings.append(level[at ^ 1])
                        now = digest(level[at ^ 1], now) if at & 1 else digest(now, level[at ^ 1])
                    else:
                        now = digest(now)
                    at >>= 1
            out.append((r.doc_id, leaf(r), trees[lang][-1][0], top[-1][0], digest(*siblings), now, now == top[-1][0]))
    return out


def run(docs, height=merkle.BLOCK_HEIGHT):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return [tuple(r) for r in merkle.manifest(docs, tampered, {"n_chars": F.col("n_chars") + 1}, height).collect()]


plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("height", [1, 3, 12])
def test_manifest_against_hand_built_trees(spark, height):
    """One language with most rows, one with one row, a NULL one, an empty one."""
    docs = documents(spark, [f"text {i} é" for i in range(75)] + [None, "", "same", "same"], extra=False)
    docs = docs.withColumn("lang", F.expr("case when doc_id < 60 then 'en' when doc_id < 61 then 'zh' when doc_id < 68 then null "
                                          "when doc_id < 70 then '' else 'de' end"))
    docs = docs.withColumn("n_chars", F.expr("case when doc_id % 9 = 0 then null else n_chars end"))
    docs = docs.union(docs.filter("doc_id % 20 = 3")).union(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    got = run(docs, height)
    assert plain(got) == plain(by_hand(docs.collect()))
    changed = [r for r in docs.collect() if hit(r.doc_id) and r.n_chars is not None]
    assert sum(not r[-1] for r in got) == len(changed) > 3


def test_one_row_and_shared_ids(spark):
    one = documents(spark, ["alone"], extra=False)
    assert plain(run(one)) == plain(by_hand(one.collect()))
    shared = documents(spark, ["a", "b", "c"], extra=False).withColumn("doc_id", F.lit(4).cast("long"))
    assert plain(run(shared)) == plain(by_hand(shared.collect()))


@pytest.mark.parametrize("levels", range(1, 11))
def test_layout_is_a_permutation_of_aligned_subtrees(levels):
    every = [merkle.places(levels, d) for d in range(levels)]
    assert sorted(np.concatenate(every).tolist()) == list(range(2 ** levels - 1))
    top = levels // 2
    if top:  # the upper half comes first, each lower subtree is one contiguous piece
        assert max(int(p.max()) for p in every[:top]) == 2 ** top - 2
        size = 2 ** (levels - top) - 1
        for s in range(1 << top):
            inside = np.concatenate([every[d][s << (d - top): (s + 1) << (d - top)] for d in range(top, levels)])
            assert inside.max() - inside.min() == size - 1


def test_paths_and_nodes_of_a_ragged_block():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    tree = levels_over([x.hex() for x in leaves])
    nodes = merkle.build(leaves, 4)
    assert nodes[0].tobytes().hex() == tree[-1][0]
    for i, x in enumerate(leaves):
        assert merkle.fold(x, merkle.sibling_path(nodes, 11, 4, i)).hex() == tree[-1][0]
