"""Operator 2: substring de-duplication with an FM-index per shard.

A window is ``n`` consecutive words; a document loses every word covered by a
window that also starts in a document with a smaller doc_id.

Shards are cut by minimizers, so no document meets all others: a window's
minimizer is the least hash of its 8-word runs, equal windows have equal
minimizers, and consecutive windows mostly share one.  Minimizers of a single
document are set aside; each run of windows over a shared minimizer is a
segment, and a shard holds all segments of its minimizers.  There an FM-index
is built over the distinct segments, and the segments are streamed through
it by backward search, which reports matches of ``n`` words and more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens.llm.common import id_and_text, stored
from phonelens.llm.fm_index import FMIndex, earlier_spans
from phonelens.llm.textblocks import Words, blocks, combine, longs

N_WORDS = 50
GRAM = 8
INDEX_WORDS = 1_000_000  # words of one index; a shard with more builds several


def window_minima(hashes: np.ndarray, n: int, gram: int = GRAM) -> np.ndarray:
    """The minimizer of each n-word window (sliding minimum by doubling)."""
    g = combine(hashes, min(gram, n))
    width = n - min(gram, n) + 1
    if len(g) < width:
        return g[:0]
    m, have = g, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(g) - width + 1], m[width - have:]) if have < width else m


def runs(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, one past last) of each run of equal minimizers."""
    first = np.flatnonzero(np.r_[True, minima[1:] != minima[:-1]]) if len(minima) else np.zeros(0, np.int64)
    return first, np.r_[first[1:], len(minima)].astype(np.int64)


def _minimizers(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            for span, raw, offsets in blocks(batch):
                words = Words(raw, offsets)
                h = words.hashes(lower=False)
                minis, docs, rows = [], [], []
                for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    if b - a >= n:
                        m = np.unique(window_minima(h[a:b], n))
                        minis.append(m)
                        docs.append(np.full(len(m), ids[span.start + d], np.int64))
                        rows.append(np.full(len(m), keys[span.start + d], np.int64))
                if minis:
                    yield pa.RecordBatch.from_arrays(
                        [longs(np.concatenate(minis)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(rows))],
                        names=["mini", "doc_id", "text_key"])
    return run


def _segments(n: int):
    """Rows (doc_id, text_key, text, minis): the segments over those minimizers."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, marks = batch.column("doc_id"), batch.column("text_key"), batch.column("minis")
            for span, raw, offsets in blocks(batch):
                words = Words(raw, offsets)
                h = words.hashes(lower=False)
                flat = np.where(np.isin(raw, np.array([9, 10, 11, 12, 13], np.uint8)), np.uint8(32), raw).tobytes()
                out: list[tuple] = []
                for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    if b - a < n:
                        continue
                    m = window_minima(h[a:b], n)
                    known = marks[span.start + d].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    first, stop = runs(m)
                    shared = np.isin(m[first], known)
                    doc, key = ids[span.start + d].as_py(), keys[span.start + d].as_py()
                    for s, e, x in zip(first[shared].tolist(), stop[shared].tolist(), m[first[shared]].view(np.int64).tolist()):
                        out.append((x, doc, key, s, flat[words.start[a + s]: words.end[a + e + n - 2]]))
                if out:
                    c = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.binary())],
                        names=["mini", "doc_id", "text_key", "start", "words"])
    return run


class _Shard:
    """Segments of whole minimizers, or of a part of a very common one.

    Segments come in the order of (minimizer, doc_id).  A segment equal to an
    earlier one of another document is covered whole.  Distinct segments are
    gathered to one index; when a single minimizer outgrows it, the index
    stays for the rest of that minimizer's segments, which are held against
    every index so far."""

    def __init__(self, n: int):
        self.n = n
        self.seen: dict[tuple[int, bytes], int] = {}
        self.texts: list[bytes] = []
        self.rows: list[tuple[int, int, int, bool]] = []
        self.size = 0
        self.full: list[tuple[dict[bytes, int], FMIndex]] = []
        self.mini = None
        self.least = 0

    def add(self, mini: int, doc: int, key: int, start: int, text: bytes) -> Iterator[tuple]:
        if mini != self.mini:
            if self.full:
                yield from self.search()
                self.full, self.seen = [], {}
            elif self.size > INDEX_WORDS // 2:
                yield from self.search()
                self.seen = {}
            self.full, self.mini, self.least = [], mini, doc
        words = text.split()
        text = b" ".join(words)
        name = (mini, hashlib.blake2b(text, digest_size=16).digest())
        owner = self.seen.get(name)
        if owner is not None and owner < doc:
            yield (doc, key, start, start + len(words))
            return
        self.seen[name] = doc
        self.texts.append(text)
        self.rows.append((doc, key, start, doc > self.least))
        self.size += len(words) + 1
        if self.size > INDEX_WORDS:
            yield from self.search(keep=True)

    def search(self, keep: bool = False) -> Iterator[tuple]:
        if not self.texts:
            return
        number: dict[bytes, int] = {}
        texts = [np.array([number.setdefault(w, len(number) + 1) for w in t.split(b" ")], np.int64) for t in self.texts]
        owners = np.array([d for d, *_ in self.rows], np.int64)
        index = FMIndex(texts, owners, self.n)
        # a minimizer's least document loses nothing to it
        ask = [k for k, (*_, later) in enumerate(self.rows) if later]
        asked = [self.rows[k] for k in ask]
        for (doc, key, start, _), spans in zip(asked, earlier_spans(index, [texts[k] for k in ask], owners[ask], self.n)):
            for a, b in spans:
                yield (doc, key, start + a, start + b)
        for names, earlier in self.full:  # of the same, very common minimizer
            foreign = [np.array([names.get(w, 0) for w in self.texts[k].split(b" ")], np.int64) for k in ask]
            for (doc, key, start, _), spans in zip(asked, foreign_spans(earlier, foreign, owners[ask], self.n)):
                for a, b in spans:
                    yield (doc, key, start + a, start + b)
        if keep:
            self.full.append((number, index))
        self.texts, self.rows, self.size = [], [], 0


def foreign_spans(index: FMIndex, queries: list[np.ndarray], owners: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """``earlier_spans`` for queries outside the index: unknown words (0) end
    a stretch, and a window needs a single occurrence."""
    pieces, origin = [], []
    for k, q in enumerate(queries):
        cut = np.flatnonzero(q == 0)
        for a, b in zip(np.r_[0, cut + 1].tolist(), np.r_[cut, len(q)].tolist()):
            if b - a >= n:
                pieces.append(q[a:b])
                origin.append((k, a))
    out: list[list[tuple[int, int]]] = [[] for _ in queries]
    own = owners[[k for k, _ in origin]] if origin else owners[:0]
    for (k, a), spans in zip(origin, earlier_spans(index, pieces, own, n, own_inside=False)):
        out[k] += [(a + s, a + e) for s, e in spans]
    return out


def _search(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(n)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["doc_id", "text_key", "first", "stop"])

        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows += shard.add(*row)
            yield table(rows)
        yield table(list(shard.search()))
    return run


def covered_words(docs: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(doc_id, text_key, first, stop): word spans of each row to be removed;
    ``text_key`` is a hash of the row's text."""
    d = id_and_text(docs).filter("doc_id is not null and text is not null").withColumn("text_key", F.xxhash64("text"))
    minis = d.mapInArrow(_minimizers(n), "mini long, doc_id long, text_key long")
    shared = minis.groupBy("mini").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("mini")
    marks = minis.join(shared, "mini").groupBy("doc_id", "text_key").agg(F.collect_set("mini").alias("minis"))
    segments = d.join(marks.hint("shuffle_hash"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "minis").mapInArrow(
        _segments(n), "mini long, doc_id long, text_key long, start long, words binary")
    dealt = segments.repartition("mini").sortWithinPartitions("mini", "doc_id", "text_key", "start")
    return dealt.mapInArrow(_search(n), "doc_id long, text_key long, first long, stop long")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cut(with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, kept_texts = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                keep = np.ones(len(words), bool)
                for s in spans or ():
                    keep[s["first"]: s["stop"]] = False
                kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k] if spans else words)
                n_words.append(len(words))
                n_removed.append(len(words) - int(keep.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(sha), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def without_repeats(docs: DataFrame, n: int = N_WORDS, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, asked for, kept_text (the
    kept words joined by one space) for every row.

    Words are runs without ASCII white space, unchanged; windows are judged
    on the input.  NULL and empty texts have no words (the hash of nothing);
    a document under ``n`` words keeps all.  Rows with a NULL doc_id keep all
    words and remove none elsewhere.  Rows that share a doc_id are told apart
    by their texts and never remove each other's words; each loses what a
    smaller doc_id holds."""
    d = id_and_text(docs)
    spans = covered_words(docs, n).distinct().groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("first", "stop")).alias("spans"))
    keyed = d.filter("doc_id is not null").withColumn("text_key", F.xxhash64("text"))
    whole = keyed.join(stored(spans).hint("shuffle_hash"), ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    none = F.lit(None).cast("array<struct<first:bigint,stop:bigint>>")
    rest = d.filter("doc_id is null").select("doc_id", "text", none.alias("spans"))
    return whole.union(rest).mapInArrow(_cut(with_text), RESULT)
