"""NULLs, empty and long texts, ties, repeated rows, empty tables and extra
columns: each operator has a defined result for each."""

import public_tokenizers as P
import pytest

from phonelens.llm import (
    decontaminate, lattice_lm, licenses, line_dedup, merkle, ngram_join, packing, quality, quality_qda,
    sharding, spelling, substring_dedup, token_counts)

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


def items(spark, texts=("the same five words here",)):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


OPERATORS = {
    "quality": lambda d: quality.quality(d),
    "sharding": lambda d: sharding.shard_table(d, sharding.tree(24), sharding.grown(sharding.tree(24), 24)),
    "tokens": lambda d: token_counts.token_counts(d, PIECES),
    "packing": lambda d: packing.pack_documents(d, WORDS),
    "decontaminate": lambda d: decontaminate.contaminated(d, items(d.sparkSession)),
    "licenses": lambda d: licenses.license_matches(d),
    "lines": lambda d: line_dedup.line_classes(d),
    "line_texts": lambda d: line_dedup.without_repeated_lines(d),
    "ngram": lambda d: ngram_join.jaccard_components(d),
    "substring": lambda d: substring_dedup.without_repeats(d),
    "lattice": lambda d: lattice_lm.lattice_scores(d, PIECES),
    "classifier": lambda d: quality_qda.quality_scores(d, d.selectExpr("doc_id", "doc_id % 2 as quality")),
    "spelling": lambda d: spelling.spelling_variants(d, noise=31),
    "merkle": lambda d: merkle.manifest(d),
}
PER_ROW = ("quality", "sharding", "tokens", "ngram", "substring", "lattice", "merkle", "classifier")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_rows(null_rows, name):
    rows = OPERATORS[name](null_rows).collect()
    if name in PER_ROW:
        assert len(rows) == 3 and sum(r.doc_id is None for r in rows) == 2


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows(edge, name):
    once, twice = OPERATORS[name](edge).collect(), OPERATORS[name](edge.union(edge)).collect()
    if name in PER_ROW:
        assert len(twice) == 2 * len(once) == 22


def test_edge_results(edge):
    by = lambda name: {r.doc_id: r for r in OPERATORS[name](edge).collect()}
    q = by("quality")
    assert [q[i].n_words for i in range(8)] == [0, 0, 0, 1, 4, 5, 5, 1] and not any(q[i].kept for i in range(8))
    n = by("ngram")
    assert [n[i].n_shingles for i in (0, 1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1, 2]
    assert n[6].component_id == 5 and n[2].component_id == 2 and n[0].component_id == 0
    t = by("tokens")
    assert t[0].n_tokens == t[1].n_tokens == 0 and t[0].n_bytes == 0 and t[7].n_bytes == 5000
    s = by("lattice")
    assert s[0].n_tokens == s[1].n_tokens == 1 and s[0].score == s[1].score < 0 and s[3].n_tokens == 2
    w = by("substring")
    assert w[0].n_words == 0 and w[0].kept_sha256 == w[1].kept_sha256 and w[8].n_removed == 0
    hits = {(r.doc_id, r.item_id) for r in OPERATORS["decontaminate"](edge).collect()}
    assert hits == {(5, 0), (6, 0)}


def test_line_texts_keep_columns_and_order(spark):
    from tests.llm.conftest import documents
    near = "a long line of ordinary prose that is repeated with one small change in it, number %d"
    docs = documents(spark, ["first line of its own\n" + near % 1 + "\n\nlast", near % 2 + "\nanother line, not like the others at all",
                             near % 1, None])
    out = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert out[0].text == "first line of its own\n" + near % 1 + "\n\nlast"
    assert out[1].text == "another line, not like the others at all" and out[1].n_chars == len(out[1].text)
    assert 2 not in out and out[3].text is None and out[1].key == "k" and out[1].n == 1
