"""Operator 11: quality classifier, a regularised quadratic discriminant.

Every text gives the statistics named in ``STATISTICS``, each transformed so
that its spread within a class is closer to normal: counts by their logarithm,
shares by the arcsine of their square root.  A class is a normal density over
them: its mean, and its covariance shrunk towards that of both classes
(``POOL``) and that towards a multiple of the identity (``RIDGE``), so that it
can be inverted however few rows or constant statistics a class has.  Moments are sums over
all labelled training rows, added up per task and then over tasks.  The
Cholesky factor of each covariance is inverted once and kept with the model;
a text's score compares the classes' log densities, whose Mahalanobis part is
the length of the factor's product with the centred statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens.llm.common import id_and_text, stored
from phonelens.llm.textblocks import Words, blocks, combine, mix, span_hash

STATISTICS = (
    "log_words", "log_word_length", "log_longest_word", "log_words_per_line",                    # counts
    "symbols", "capitals", "digits", "shouts", "stops", "other_marks", "beyond_ascii",           # shares of characters
    "short_words", "repeated_words", "repeated_windows", "repeated_lines", "capital_words")      # shares of words, windows, lines
POOL = 0.1
RIDGE = 0.02
WINDOW = 5


def _class_of_byte() -> np.ndarray:
    """symbols 1, capitals 2, digits 3, ! and ? 4, full stops 5, other ASCII
    marks 6, first byte of a character beyond ASCII 7, its other bytes 8."""
    out = np.zeros(256, np.uint8)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[marks] = 6
    for k, chars in ((1, b"#*$%&|<>"), (2, bytes(range(65, 91))), (3, b"0123456789"), (4, b"!?"), (5, b".")):
        out[list(chars)] = k
    out[192:], out[128:192] = 7, 8
    return out


_CLASS = _class_of_byte()


def _per_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values[cuts[i]:cuts[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def _count_repeats(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of h[first[i]:first[i + 1]] that equal an earlier one there."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][again], minlength=len(first) - 1)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics [text, statistic] of a block of texts.

    A text without words has zeros for whatever its words would tell."""
    w = Words(raw, offsets)
    kind = _CLASS[raw]
    chars = np.maximum(np.diff(offsets) - _per_text(kind == 8, offsets), 1)
    shares = [np.minimum(_per_text(kind == k, offsets) / chars, 1.0) for k in range(1, 8)]
    first, n = w.first, np.diff(w.first)
    some = np.maximum(n, 1)
    length = w.end - w.start
    longest = np.zeros(len(n), np.int64)
    has = n > 0
    if has.any():
        longest[has] = np.maximum.reduceat(length, first[:-1][has])
    hashes = w.hashes(lower=True)
    grams = combine(hashes, WINDOW)
    grams = np.r_[grams, np.zeros(len(hashes) - len(grams), np.uint64)]
    inside = np.ones(len(hashes), bool)  # windows that leave their text are none
    for k in range(1, WINDOW):
        late = first[1:] - k
        inside[late[late >= first[:-1]]] = False
    kept = np.r_[0, np.cumsum(inside)][first]
    windows = np.maximum(np.diff(kept), 1)
    feeds = np.flatnonzero(raw == 10)
    begin = np.sort(np.r_[offsets[:-1], feeds + 1])
    stop = np.r_[begin[1:], len(raw)]
    words_in = np.searchsorted(w.start, stop) - np.searchsorted(w.start, begin)
    begin, stop = begin[words_in > 0], stop[words_in > 0]
    line_first = np.searchsorted(begin, offsets)
    lines = np.maximum(np.diff(line_first), 1)
    line_hash = span_hash(mix(raw.astype(np.uint64) + np.uint64(77)), begin, np.maximum(stop - 1, begin))
    capital = kind[w.start] == 2 if len(w.start) else np.zeros(0, bool)
    shares += [_per_text(length <= 3, first) / some, _count_repeats(first, hashes) / some,
               _count_repeats(kept, grams[inside]) / windows, _count_repeats(line_first, line_hash) / lines,
               _per_text(capital, first) / some]
    counts = [n, _per_text(length, first) / some, longest, n / lines]
    return np.column_stack([*(np.log1p(c) for c in counts), *(np.arcsin(np.sqrt(s)) for s in shares)])


def _statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for span, raw, offsets in blocks(batch):
            x = statistics(raw, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            rows = batch.slice(span.start, span.stop - span.start)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), lists], names=["doc_id", "held_out", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): held_out rows are those whose labels are not learnt."""
    d = id_and_text(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return d.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        _statistics, "doc_id long, held_out boolean, x array<double>")


# ---- fit
@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse of the covariance's Cholesky factor, and the
    log of prior over density scale."""

    mean: np.ndarray
    factor: np.ndarray
    offset: np.ndarray
    constant: float | None = None  # the score of every text, where one class is all there is

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.mean, self.factor, self.offset)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(n: np.ndarray, total: np.ndarray, square: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """The model from each class's row count, sum [2, d] and sum of products [2, d, d]."""
    if not n.all():
        return Discriminant(*[np.zeros(0)] * 3, constant=float(n[1] / n.sum()) if n.any() else 0.5)
    mean = total / n[:, None]
    scatter = square - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    size = len(pooled)
    factor, offset = [], []
    for k in range(2):
        cov = (1 - pool) * scatter[k] / n[k] + pool * pooled
        cov = (1 - ridge) * cov + (ridge * np.trace(cov) / size + 1e-9) * np.eye(size)
        lower = np.linalg.cholesky(cov)
        factor.append(np.linalg.inv(lower))
        offset.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(mean, np.array(factor), np.array(offset))


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = len(STATISTICS)
    total = np.zeros((2, 1 + size, 1 + size))
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, size)
        x = np.column_stack([np.ones(len(x)), x])
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for k in range(2):
            total[k] += x[label == k].T @ x[label == k]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])


def fit(rows: DataFrame) -> Discriminant:
    """The model of labelled rows (x, label 0 or 1).  Rows and products of
    statistics are summed by the tasks; 2 * 17 * 17 sums come to the driver."""
    size = len(STATISTICS) + 1
    sums = rows.select("x", "label").mapInArrow(_moments, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(2 * size * size)
    for r in sums.collect():
        total[r["place"]] = r["value"]
    total = total.reshape(2, size, size)
    return discriminant(total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:])


def labelled(labels: DataFrame, column: str = "quality") -> DataFrame:
    """(label_id, label): one row per id; an id with both labels teaches nothing."""
    value = F.col(f"`{column}`").cast("int")
    one = labels.select(F.col("doc_id").cast("long").alias("label_id"), value.alias("label")).filter("label in (0, 1) and label_id is not null")
    return one.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")


def _score(model: Discriminant) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id, held_out, score for every row: the probability of label 1.

    Learns from the labels of ids whose CRC-32 is not divisible by 5; rows
    that share an id share its label, a row without an id has none.  NULL and
    empty texts are scored by their (zero) statistics.  Without labels every score
    is 0.5, with one class only that class's.  Nothing but the text enters a
    score; other columns are not read."""
    x = stored(document_statistics(docs))
    known = labelled(labels, column)
    train = x.filter("not held_out").join(known, F.col("doc_id") == F.col("label_id")).select("x", "label")
    return x.mapInArrow(_score(fit(train)), "doc_id long, held_out boolean, score double")
