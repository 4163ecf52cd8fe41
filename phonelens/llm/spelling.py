"""Operator 12: grouping of spelling variants by an index of variable-length grams.

Words are distinct strings with a count; two are near when one inserted,
deleted or replaced code point turns one into the other.

*Dictionary.*  Words get a begin and an end mark.  The gram that starts at a
position is the shortest piece of at least ``Q_MIN`` characters that is rare,
or ``Q_MAX`` long, or ends the word: a trie of grams, pruned to those whose
prefixes stand in more than ``limit`` words.  The frequent grams are all that is
stored.  They are counted over all words, a length at a time (a frequent gram
has a frequent prefix), and their number is bounded: each stands in more than
1 / ``MAX_GRAMS`` of all gram places.

*Bound.*  A gram depends on its own characters only, so an edit at a place
destroys the grams that cover the place and no others.  The most that cover
one place is the word's affected-gram bound; near words share all but so many
of either's grams.

*Merging.*  Hence near words share one of the first ``bound + 1`` grams of
each, in one order for all words, the least frequent first: a word stands in
these lists alone.  Inside a list, words that agree when one place of each is left out
meet in one sort, so a list costs its length, not its square; a frequent
gram's list is dealt out by what is left of the word, so that no task holds it
whole.  Pairs are verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens.llm.common import id_and_text, stored
from phonelens.llm.textblocks import _BASE, _INVERSE, _powers, longs, mix, span_hash

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Q_MIN, Q_MAX = 3, 6
MAX_GRAMS = 20_000     # frequent grams of one length, at most
LIST_WORDS = 4_096     # a list of so many words is never called frequent
PIECE_POINTS = 400_000 # code points that a task works on at a time
FORM_FACTOR = 10


# ---- words
def word_counts(docs: DataFrame, min_length: int, min_count: int, noise: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters of all texts, A-Z lowered.

    With ``noise``, a run whose CRC-32 with its document's id is divisible by
    it loses one code point.  A NULL text has no words; in a row without a
    doc_id no run loses one.  Repeated rows count each time."""
    d = id_and_text(docs)
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"{LETTERS}{{{min_length},}}"), 0)
    runs = d.select("doc_id", F.explode(runs).alias("run"))
    word = F.col("run")
    if noise:
        runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary")))
        at = F.col("h").cast("long") % F.length("run")
        less = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
        word = F.when(F.col("h") % noise == 0, less).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


class Points:
    """Code points of words in a row, ``points[start[i]:end[i]]``, with a mark
    before and after each word if ``marked``."""

    def __init__(self, words: list[str], marked: bool):
        text = "\x02" + "\x03\x02".join(words) + "\x03" if marked else "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.values = mix(points.astype(np.uint64) + np.uint64(0x51))
        size = np.array([len(w) for w in words], np.int64) + 2 * marked
        self.end = np.cumsum(size)
        self.start = self.end - size


class Dictionary:
    """Hashes of frequent grams and how many words hold each."""

    def __init__(self, grams: dict[int, int]):
        self.hash = np.array(sorted(grams), np.int64)
        self.words = np.array([grams[h] for h in self.hash.tolist()], np.int64)

    def frequency(self, h: np.ndarray) -> np.ndarray:
        """Words that hold the gram; 0 for a gram that is not frequent."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64)
        h = h.view(np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.words[at], 0)

    def grams(self, p: Points, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end) of the gram at every place, of at most ``upto``
        characters."""
        count = np.maximum(p.end - p.start - Q_MIN + 1, 0)
        word = np.repeat(np.arange(len(count)), count)
        start = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + p.start[word]
        end = start + Q_MIN
        live = np.arange(len(word))
        for _ in range(Q_MIN, upto):
            live = live[end[live] < p.end[word[live]]]
            live = live[self.frequency(span_hash(p.values, start[live], end[live])) > 0]
            end[live] += 1
        return word, start, end


def _pieces(batches: Iterable[pa.RecordBatch], whole: str | None = None) -> Iterator[pa.Table]:
    """Rows in pieces of about PIECE_POINTS code points, rows of equal
    ``whole`` (they arrive sorted) in one piece."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if whole and size >= PIECE_POINTS:
            keys = batch.column(whole).to_numpy(zero_copy_only=False)
            other = np.flatnonzero(keys != held[-1].column(whole)[-1].as_py())
            cut = int(other[0]) if len(other) else batch.num_rows
            if cut:
                held.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                batch = batch.slice(cut)
            else:
                continue
        held.append(batch)
        size += batch.column("word").nbytes
        if not whole and size >= PIECE_POINTS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _count_grams(known: Dictionary, length: int) -> Callable:
    """Per gram of ``length`` whose shorter prefixes are all frequent: words that hold it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            p = Points(piece.column("word").to_pylist(), marked=True)
            word, start, end = known.grams(p, length)
            full = end - start == length
            h = span_hash(p.values, start[full], end[full])
            order = np.lexsort((h, word[full]))
            h, w = h[order], word[full][order]
            new = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])][: len(h)]
            grams, count = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([longs(grams), pa.array(count)], names=["gram", "c"])
    return run


def gram_dictionary(words: DataFrame, limit: int) -> Dictionary:
    """All grams of Q_MIN to Q_MAX characters in more than ``limit`` words.

    A gram in more than ``limit`` words takes more than ``limit`` of the places
    in all words, so at most places / ``limit`` of each length come to the driver."""
    grams: dict[int, int] = {}
    for length in range(Q_MIN, Q_MAX + 1):
        counts = words.select("word").mapInArrow(_count_grams(Dictionary(grams), length), "gram long, c long")
        more = counts.groupBy("gram").agg(F.sum("c").alias("c")).filter(F.col("c") > limit).collect()
        if not more:
            break
        grams.update((r["gram"], r["c"]) for r in more)
    return Dictionary(grams)


# ---- lists
def _residues(p: Points, row: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Hash of word ``row`` without its code point ``cut`` (its length: whole)."""
    up, down = _powers(len(p.values) + 1)
    sums = np.zeros(len(p.values) + 1, np.uint64)
    np.cumsum(p.values * up[: len(p.values)], out=sums[1:])
    a, b = p.start[row], p.end[row]
    at = a + cut
    rest = (sums[at] - sums[a]) + (sums[b] - sums[np.minimum(at + 1, b)]) * _INVERSE
    return mix(rest * down[a] + (b - a - (at < b)).astype(np.uint64))


def _every_cut(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cut) for each place of each row, and for no place."""
    row = np.repeat(np.arange(len(length)), length + 1)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(length + 1) - length - 1, length + 1)


def list_entries(words: list[str], known: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, cut): the lists in which each word stands.  ``cut`` is -1,
    or in a frequent gram's list the place left out, which is part of the key."""
    p = Points(words, marked=True)
    word, start, end = known.grams(p, Q_MAX)
    cover = np.zeros(len(p.values) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.subtract.at(cover, end, 1)
    bound = np.maximum.reduceat(np.cumsum(cover), p.start)  # grams that one edit can touch
    gram = span_hash(p.values, start, end)
    frequency = known.frequency(gram)
    order = np.lexsort((start, gram, word))  # a gram's second place in a word is another token
    word, gram, frequency = word[order], gram[order], frequency[order]
    new = np.r_[True, (word[1:] != word[:-1]) | (gram[1:] != gram[:-1])]
    first = np.flatnonzero(new)
    nth = np.arange(len(gram)) - first[np.cumsum(new) - 1]
    token = mix(gram + nth.astype(np.uint64) * _BASE)
    order = np.lexsort((token, frequency, word))
    word, token, frequency = word[order], token[order], frequency[order]
    rank = np.arange(len(word)) - np.searchsorted(word, word)
    keep = rank <= bound[word]
    word, token, hot = word[keep], token[keep], frequency[keep] > 0
    plain = Points(words, marked=False)
    row, cut = _every_cut((plain.end - plain.start)[word[hot]])
    owner = word[hot][row]
    spread = mix(token[hot][row] * _BASE + _residues(plain, owner, cut))
    return (np.r_[token[~hot], spread], np.r_[word[~hot], owner], np.r_[np.full(int((~hot).sum()), -1), cut])


def _entries(known: Dictionary) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            piece = piece.combine_chunks()
            key, word, cut = list_entries(piece.column("word").to_pylist(), known)
            for at in range(0, len(key), 100_000):
                part = slice(at, at + 100_000)
                rows = pa.array(word[part])
                yield pa.RecordBatch.from_arrays(
                    [longs(key[part]), piece.column("word").take(rows).combine_chunks(),
                     piece.column("n").take(rows).combine_chunks(), pa.array(cut[part].astype(np.int32))],
                    names=["key", "word", "n", "cut"])
    return run


def near_in_lists(key: np.ndarray, words: list[str], cut: np.ndarray) -> tuple[list[int], list[int]]:
    """Rows (i, j) of near words in whole lists; a pair may come more than once."""
    p = Points(words, marked=False)
    length = p.end - p.start
    whole = np.flatnonzero(cut < 0)
    row, at = _every_cut(length[whole])
    row = np.r_[whole[row], np.flatnonzero(cut >= 0)]
    at = np.r_[at, cut[cut >= 0]]
    rest = _residues(p, row, at)
    same = np.where(cut[row] < 0, mix(key[row] * _BASE + rest), key[row])
    order = np.lexsort((at, same))
    same, row, at = same[order], row[order], at[order]
    full = at == length[row]
    left, right = [], []
    here, step = np.arange(len(same)), 1
    while True:
        here = here[here + step < len(same)]
        here = here[same[here] == same[here + step]]
        if not len(here):
            break
        there = here + step
        replaced = (at[here] == at[there]) & ~full[here] & ~full[there]
        pick = replaced | (full[here] != full[there])
        left.append(np.c_[row[here[pick]], at[here[pick]]])
        right.append(np.c_[row[there[pick]], at[there[pick]]])
        step += 1
    if not left:
        return [], []
    left, right = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.c_[left, right], axis=0).tolist()
    out = [(i, j) for i, a, j, b in pairs
           if words[i] != words[j] and words[i][:a] + words[i][a + 1:] == words[j][:b] + words[j][b + 1:]]
    return [i for i, _ in out], [j for _, j in out]


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches, whole="key"):
        key = piece.column("key").to_numpy().view(np.uint64)
        alone = np.ones(len(key), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        if alone.all():
            continue
        piece = piece.filter(pa.array(~alone))
        words, n = piece.column("word").to_pylist(), piece.column("n").to_pylist()
        i, j = near_in_lists(key[~alone], words, piece.column("cut").to_numpy())
        pairs = sorted({(words[a], words[b]) if words[a] < words[b] else (words[b], words[a]) for a, b in zip(i, j)})
        count = dict(zip(words, n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in pairs], pa.string()), pa.array([count[a] for a, _ in pairs], pa.int64()),
             pa.array([b for _, b in pairs], pa.string()), pa.array([count[b] for _, b in pairs], pa.int64())],
            names=["x", "x_n", "y", "y_n"])


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """(x, x_n, y, y_n), x < y: all pairs of near words of ``words`` (word
    distinct, n); the shortest needs Q_MIN + Q_MAX - 2 code points."""
    places, shortest = words.agg(F.sum(F.length("word") + 3 - Q_MIN), F.min(F.length("word"))).first()
    if shortest is not None and shortest < Q_MIN + Q_MAX - 2:
        raise ValueError(f"words need {Q_MIN + Q_MAX - 2} code points, so that an edit leaves a gram")
    known = gram_dictionary(words, max(list_words, (places or 0) // MAX_GRAMS))
    entries = words.select("word", "n").mapInArrow(_entries(known), "key long, word string, n long, cut int")
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), (places or 0) // 1_000_000 + 1)
    pairs = entries.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(
        _merge, "x string, x_n long, y string, y_n long")
    return pairs.distinct()


# ---- groups
def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms; ``forms`` is
    (word, form) of the words that have one.  Chains have no circle: counts
    rise on the way.  The known stretch doubles every round."""
    reach = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if reach.join(onward, "root", "left_semi").isEmpty():
            return reach
        reach = stored(reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, noise: int | None = None,
                      factor: int = FORM_FACTOR, list_words: int = LIST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least
    ``min_length`` code points and ``min_count`` occurrences.

    ``n_near`` counts near words (0: none).  ``form`` is the near word with
    the most occurrences (ties: the first in code-point order) if it has at
    least ``factor`` times the word's; else NULL, as is ``form_n``.  ``root``
    ends the chain of forms, the word itself if it has none.  NULL and empty
    texts have no words, an empty table gives no row; other columns than
    doc_id and text are not read."""
    words = stored(word_counts(docs, min_length, min_count, noise))
    pairs = stored(near_words(words, list_words))
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("y_n").alias("other_n")).union(
        pairs.select("y", "x", "x_n"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = words.join(near, "word", "left")
    most = -F.col("best.less")
    is_form = most >= F.col("n") * factor
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, most).alias("form_n")))
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
