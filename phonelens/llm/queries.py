"""Registered queries of the operators, with production parameters."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens.llm import (
    decontaminate, lattice_lm, licenses, line_dedup, merkle, ngram_join, packing, quality, quality_qda,
    sharding, spelling, substring_dedup, token_counts)
from phonelens.llm import oracle
from phonelens.llm.common import read_table

N_SHARDS = 24
TOKEN_LIMIT = 4096
QUALITY_CUT = 0.3
SPELLING_NOISE = 31
PIECE_MODEL = "piece_bpe_32k.model"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_line_dedup(spark, sf_dir) -> DataFrame:
    """Operator 1 over all documents: the class of every line."""
    return line_dedup.line_classes(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "line_no", "class_doc_id", "class_line_no", "kept")


def op2_substring_dedup(spark, sf_dir) -> DataFrame:
    """Operator 2 over all documents: windows of 50 words."""
    return substring_dedup.without_repeats(read_table(spark, sf_dir, "documents"), with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op3_hash_tree(spark, sf_dir) -> DataFrame:
    """Operator 3 over all documents: 24 shards, law ``key``."""
    root = sharding.tree(N_SHARDS)
    rows = sharding.shard_table(read_table(spark, sf_dir, "documents"), root, sharding.grown(root, N_SHARDS))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_quality_rules(spark, sf_dir) -> DataFrame:
    """Operator 4 over all documents."""
    return quality.quality(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_lattice_lm(spark, sf_dir) -> DataFrame:
    """Operator 5 over all documents."""
    return lattice_lm.lattice_scores(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op6_token_counts(spark, sf_dir) -> DataFrame:
    """Operator 6 over all documents."""
    t = token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return t.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_ngram_join(spark, sf_dir) -> DataFrame:
    """Operator 7 over all documents: four-word shingles, similarity 0.85."""
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_decontaminate(spark, sf_dir) -> DataFrame:
    """Operator 8: all benchmark items in all documents."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_packing(spark, sf_dir) -> DataFrame:
    """Operator 9 over all documents: sequences of 4096 tokens."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op10_licenses(spark, sf_dir) -> DataFrame:
    """Operator 10 over all documents."""
    return licenses.license_matches(read_table(spark, sf_dir, "documents"))


def op11_quality_qda(spark, sf_dir) -> DataFrame:
    """Operator 11 over all documents: labels of ``labels.quality``."""
    scores = quality_qda.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= QUALITY_CUT).cast("int"))


def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    """Operator 12 over all documents: every 31st run loses a code point."""
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"), noise=SPELLING_NOISE)


def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    """Operator 13 over all documents: every seventh id's n_chars tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(read_table(spark, sf_dir, "documents"), hit, {"n_chars": F.col("n_chars") + 1})


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_substring_dedup, op3_hash_tree, op4_quality_rules, op5_lattice_lm, op6_token_counts,
    op7_ngram_join, op8_decontaminate, op9_packing, op10_licenses,
    op11_quality_qda, op12_spelling_variants, op13_merkle_manifest)}

# op5 (sums over segmentations), op6 and op9 (a library's merges, a greedy
# packing) and op11 (a fitted model) have none: tests/llm holds them against
# brute-force versions and held-out labels
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": oracle.lines_sql(line_dedup.SHINGLE, line_dedup.PERCENT),
    "op2_substring_dedup": oracle.substring_sql(substring_dedup.N_WORDS),
    "op3_hash_tree": oracle.sharding_sql(N_SHARDS),
    "op4_quality_rules": oracle.quality_sql(),
    "op7_ngram_join": oracle.jaccard_sql(4, 85),
    "op8_decontaminate": oracle.decontaminate_sql(),
    "op10_licenses": oracle.licenses_sql(),
    "op12_spelling_variants": oracle.spelling_sql(SPELLING_NOISE),
    "op13_merkle_manifest": oracle.merkle_sql(),
}
