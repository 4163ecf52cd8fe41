"""Operator 5: subword lattice likelihood.

An existing vocabulary of pieces gets unigram weights from the training
documents; a word's probability is the sum over all its segmentations into
pieces, by a forward recursion in log space; a text's score is the log10
probability of its words and one end mark.  Segmentations do not cross words,
so every distinct word is summed once, over the corpus.

Counts are exact and corpus-wide.  Texts are dealt into chunks of a few
megabytes.  A first pass sums the words of all chunks, map-side first, and weighs each
distinct word once; a second names the words of each chunk, which meet their
sums in a join, so a very frequent word moves once per chunk, as a narrow
row, and no table of all words is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonelens.llm.common import conf_bytes, id_and_text, stored
from phonelens.llm.textblocks import SMALL_BLOCK, Words, blocks

SPACE_MARK = "▁"
HELD_OUT_OF, HELD_OUT = 7, 2
CHUNK_BYTES = 8 << 20       # of stored input per chunk
LOOSE_CHUNKS = 4096         # for rows that come from no file
# A worker's memory; all workers of an executor share its limit.  Results are unaffected.
MEMO_ENTRIES = 150_000      # segmented words; emptied when full
CHUNK_WORDS = 400_000       # words gathered of one chunk before they are sent
HELD_WORDS = 500_000        # of all chunks
END = -1                    # stands for the end mark among piece ids
LN10 = math.log(10.0)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2 (a NULL id is training)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


@lru_cache(maxsize=2)
def _library(model_path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def vocabulary(model_path: str) -> tuple[dict[str, int], dict[int, int]]:
    """(piece -> id, byte -> id) of the existing vocabulary."""
    sp = _library(model_path)
    pieces, of_bytes = {}, {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            of_bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[sp.id_to_piece(i)] = i
    return pieces, of_bytes


class Lattice:
    """Log probabilities of words under piece weights."""

    def __init__(self, model_path: str, log_weights: np.ndarray):
        pieces, of_bytes = vocabulary(model_path)
        self.weight = {p: float(log_weights[i]) for p, i in pieces.items()}
        # with the beginnings of pieces, so that a walk stops where no piece goes on; no weight is over 0
        self.walk: dict[str, float | None] = {p[:k]: None for p in pieces for k in range(1, len(p))}
        self.walk.update(self.weight)
        self.byte = {b: float(log_weights[i]) for b, i in of_bytes.items()}

    def spelled(self, char: str) -> float:
        """A character outside the vocabulary, byte by byte."""
        return sum(self.byte[b] for b in char.encode("utf-8", "surrogatepass"))

    def word(self, word: str) -> float:
        """log of the sum over all segmentations of the marked word."""
        s = SPACE_MARK + word
        n, weight, walk, exp = len(s), self.weight, self.walk, math.exp
        reach: list[list[float]] = [[] for _ in range(n + 1)]
        reach[0].append(0.0)
        for i in range(n):
            here = reach[i]
            if not here:
                continue
            if len(here) == 1:
                a = here[0]
            else:
                top = max(here)
                a = top + math.log(sum([exp(x - top) for x in here]))
            if s[i] not in weight:
                reach[i + 1].append(a + self.spelled(s[i]))
            for j in range(i + 1, n + 1):
                w = walk.get(s[i:j], 1.0)
                if w is None:
                    continue
                if w > 0.0:
                    break
                reach[j].append(a + w)
            reach[i] = []
        top = max(reach[n])
        return top + math.log(sum([exp(x - top) for x in reach[n]]))


def _piece_counts(model_path: str):
    """Per task: how often training words' segments and end marks occur."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, ends, memo = _library(model_path), 0, {}
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            batch = batch.filter(pa.array(~batch.column("held_out").to_numpy(zero_copy_only=False)))
            ends += batch.num_rows
            for _, raw, offsets in blocks(batch, size=SMALL_BLOCK):
                words = _distinct(Words(raw, offsets))[1:]
                if len(memo) > MEMO_ENTRIES:
                    memo = {}
                texts = words[0]
                fresh = [w for w in texts if w not in memo]
                if fresh:
                    memo.update(zip(fresh, sp.encode([w.decode() for w in fresh], num_threads=1)))
                ids = [memo[w] for w in texts]
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
                total += np.bincount(flat, weights=np.repeat(words[1], lengths), minlength=len(total)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[END, used]), pa.array(np.r_[ends, total[used]])], names=["piece", "n"])
    return run


def _distinct(words: Words, upto: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(hashes, lower-case words, counts) of the distinct words of a block;
    counts only words of texts with ``upto`` true."""
    h = words.hashes(lower=True)
    names, at, place = np.unique(h, return_index=True, return_inverse=True)
    if upto is None:
        n = np.bincount(place, minlength=len(names))
    else:
        counted = np.repeat(upto, np.diff(words.first))
        n = np.bincount(place[counted], minlength=len(names))
    raw = words.raw.tobytes().lower()
    texts = [raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
    return names, texts, n


def _dictionary(counted: bool):
    """A chunk's distinct words: with their texts and training counts
    (chunk, h, word, n) if ``counted``, else their names (chunk, h).

    Words are gathered over a few blocks of one chunk; a chunk may send a
    word more than once, which sums and looks up alike."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: Counter = Counter()

        def out(chunk: int) -> pa.RecordBatch:
            got = held.pop(chunk)
            size.pop(chunk)
            h = np.concatenate([x[0] for x in got])
            if not counted:
                names = np.unique(h)
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), chunk)), pa.array(names.view(np.int64))],
                                                  names=["chunk", "h"])
            texts = [t for x in got for t in x[1]]
            n = np.concatenate([x[2] for x in got])
            names, at, place = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(names), chunk)), pa.array(names.view(np.int64)),
                 pa.array([texts[i] for i in at.tolist()], pa.binary()).cast(pa.string()),
                 pa.array(np.bincount(place, weights=n).astype(np.int64))], names=["chunk", "h", "word", "n"])

        for batch in batches:
            chunks = batch.column("chunk").to_numpy(zero_copy_only=False)
            for chunk in np.unique(chunks).tolist():
                part = batch.filter(pa.array(chunks == chunk))
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                for span, raw, offsets in blocks(part, size=SMALL_BLOCK):
                    words = Words(raw, offsets)
                    got = _distinct(words, train[span]) if counted else (np.unique(words.hashes(lower=True)),)
                    if not len(got[0]):
                        continue
                    held.setdefault(chunk, []).append(got)
                    size[chunk] += len(got[0])
                    if size[chunk] > CHUNK_WORDS:
                        yield out(chunk)
            while sum(size.values()) > HELD_WORDS:
                yield out(size.most_common(1)[0][0])
        for chunk in list(held):
            yield out(chunk)
    return run


def _weigh(model_path: str, weights):
    """The lattice sum of each distinct word."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_path, weights.value)
        for batch in batches:
            sums = [lattice.word(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(sums, pa.float64())],
                                             names=["h", "c", "lp"])
    return run


def _score(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Sums over the words of each text of a chunk."""
    h = words.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h, kind="stable")
    h = h[order]
    c = words.column("c").to_numpy()[order]
    lp = words.column("lp").to_numpy()[order]
    log_c = np.log10(c + 1.0)
    n_words, known, base, score = [], [], [], []
    for batch in docs.select(["text"]).combine_chunks().to_batches():
        for _, raw, offsets in blocks(batch, size=SMALL_BLOCK):
            w = Words(raw, offsets)
            at = np.searchsorted(h, w.hashes(lower=True))
            run = [np.r_[0, np.cumsum(x[at])] for x in (c > 0, log_c, lp)] if len(at) else [np.zeros(1)] * 3
            for out, x in zip((known, base, score), run):
                out.append(x[w.first[1:]] - x[w.first[:-1]])
            n_words.append(np.diff(w.first))
    cat = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_words": cat(n_words, np.int64),
                     "known": cat(known, np.int64), "log_c": cat(base, float), "lp": cat(score, float)})


def lattice_scores(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    for every row.

    Tokens are the words, ASCII lower case, and one end per document.
    ``base_score`` is the add-one word unigram; ``score`` the lattice's log10
    probability.  A piece's weight is (n + 1) / (all + pieces), n its uses in
    the library's segmentation of the training words; the end mark is one of
    the pieces; characters outside the vocabulary are spelled in byte pieces.
    NULL and empty texts are the end mark alone; a NULL doc_id is training.
    Repeated rows count and are scored each.  Words are named by 64-bit
    hashes."""
    spark = docs.sparkSession
    parts = max(1, -(-conf_bytes(spark, "spark.sql.files.maxPartitionBytes") // CHUNK_BYTES))
    own = F.xxhash64("doc_id", "text")
    place = F.when(F.input_file_name() == "", F.pmod(own, F.lit(LOOSE_CHUNKS))).otherwise(
        F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(own, F.lit(parts))))
    d = id_and_text(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), place.alias("chunk"))

    # at most one row per piece comes back: the vocabulary bounds it
    counted = d.select("text", "held_out").mapInArrow(_piece_counts(model_path), "piece long, n long")
    counts = {r.piece: r.n for r in counted.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    n_pieces = _library(model_path).get_piece_size()
    weights = np.ones(n_pieces)
    for i, n in counts.items():
        if i != END:
            weights[i] += n
    end = counts.get(END, 0)
    pieces, of_bytes = vocabulary(model_path)
    usable = np.array(sorted([*pieces.values(), *of_bytes.values()]))
    total = weights[usable].sum() + end + 1
    log_weights, log_end = np.log(weights / total), math.log((end + 1) / total)

    # one row per distinct word: summed in each task first, so that a word of
    # all chunks is a row per task here, and in the join a narrow row per
    # chunk on the side that a skewed key splits
    words = d.mapInArrow(_dictionary(counted=True), "chunk long, h long, word string, n long")
    totals = words.groupBy("h").agg(F.max("word").alias("word"), F.sum("n").alias("c"))
    totals = stored(totals.mapInArrow(_weigh(model_path, spark.sparkContext.broadcast(log_weights)), "h long, c long, lp double"))
    names = d.select("chunk", "text", "held_out").mapInArrow(_dictionary(counted=False), "chunk long, h long")
    words = names.join(totals, "h").select("chunk", "h", "c", "lp")
    scored = d.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(
        _score, "doc_id long, held_out boolean, n_words long, known long, log_c double, lp double")
    scored = stored(scored)
    n_train = scored.agg(F.sum(F.when(~F.col("held_out"), F.col("n_words") + 1))).first()[0] or 0
    v = totals.filter(F.col("c") > 0).count() + (1 if end else 0)
    denominator = math.log10(n_train + v + 1)
    n_tokens = F.col("n_words") + 1
    return scored.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + (1 if end else 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_c") + math.log10(end + 1) - n_tokens * denominator).alias("base_score"),
        ((F.col("lp") + log_end) / LN10).alias("score"))
