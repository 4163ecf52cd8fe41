"""Operator 9: vector bin packing by the dot-product heuristic.

Examples (pieces of tokenised documents) go into sequences under limits on
tokens, segments and loss-bearing tokens at once.  An open sequence takes the
waiting piece whose demand vector has the largest dot product with its free
capacity, both as shares of the limits; when no whole piece fits any more and
cutting is allowed, one piece is cut to fill the rest.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from phonelens.llm.common import id_and_text
from phonelens.llm.textblocks import Words, blocks

MEMO_ENTRIES = 400_000  # of each generation of a worker's memory of encoded words
WAITING = 1024          # pieces that a task holds before it packs them
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, segment int, loss_tokens long")


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray      # uint32
    loss: np.ndarray     # bool: does the id bear loss
    doc_tokens: int

    def cut(self, at: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc_id, self.start, self.ids[:at], self.loss[:at], self.doc_tokens),
                Piece(self.doc_id, self.start + at, self.ids[at:], self.loss[at:], self.doc_tokens))


class Packer:
    """Packs a stream of pieces; holds at most about ``waiting`` pieces."""

    def __init__(self, limits: Limits, first_id: int, may_cut: bool = True, waiting: int = WAITING):
        self.limits, self.next_id, self.may_cut, self.waiting = limits, first_id, may_cut, waiting
        self.pieces: list[Piece] = []
        self.top = np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, piece: Piece) -> Iterator[tuple]:
        """Full-length heads of a long document are sequences by themselves."""
        while self.may_cut and len(piece.ids) >= self.limits.tokens:
            at = self._fit(piece, self.top)
            head, piece = piece.cut(at)
            yield from self._write([head])
        if len(piece.ids):
            if not self.may_cut and self._fit(piece, self.top) < len(piece.ids):
                raise ValueError(f"document {piece.doc_id} exceeds the limits and may not be cut")
            self.pieces.append(piece)
        if len(self.pieces) >= self.waiting:
            yield from self.pack(keep=self.waiting // 8)

    def _fit(self, piece: Piece, free: np.ndarray) -> int:
        """How many of a piece's first ids fit into the free capacity."""
        if free[1] < 1:
            return 0
        n = min(len(piece.ids), int(free[0]))
        return int(np.searchsorted(np.cumsum(piece.loss[:n]), free[2], "right"))

    def pack(self, keep: int = 0) -> Iterator[tuple]:
        """Pack until at most ``keep`` pieces wait."""
        need = np.array([[len(p.ids), 1, int(p.loss.sum())] for p in self.pieces], float).reshape(-1, 3)
        alive = np.ones(len(need), bool)
        left = len(need)
        while left > keep:
            free, chosen = self.top.copy(), []
            while True:
                fits = alive & (need <= free).all(axis=1)
                if not fits.any():
                    break
                score = np.where(fits, (need / self.top) @ (free / self.top), -1.0)
                i = int(score.argmax())
                chosen.append(self.pieces[i])
                free -= need[i]
                alive[i], left = False, left - 1
            if self.may_cut and free[0] > 0 and left:
                i = int(np.where(alive, need[:, 0], -1).argmax())
                at = self._fit(self.pieces[i], free)
                if at:
                    head, self.pieces[i] = self.pieces[i].cut(at)
                    need[i] = [len(self.pieces[i].ids), 1, int(self.pieces[i].loss.sum())]
                    chosen.append(head)
            yield from self._write(chosen)
        self.pieces = [p for p, a in zip(self.pieces, alive) if a]

    def _write(self, chosen: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for k, p in enumerate(chosen):
            yield (p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens,
                   self.next_id, offset, k, int(p.loss.sum()))
            offset += len(p.ids)
        self.next_id += 1


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself
    where printable and no blank, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts as the concatenated ids of their words.

    The tokenizer drops white space, folds case and never merges across white
    space, so a word's ids depend neither on its neighbours nor on ASCII
    case.  Words are split at ASCII white space only (other white space stays
    in a "word" and the library sees it).  Two more facts of its pattern save
    work: a run of letters is one pre-token, so words of lower-case letters
    that are in normal form go to the library's merges without its normaliser
    and pattern; and one sentence mark behind a letter or an ASCII digit is a
    pre-token of its own.  Texts that hold a special string go to the library
    whole.  Encoded words are remembered in two generations: when the younger
    is full it becomes the older, so frequent words stay."""

    MARKS = ".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters() | {32: " "}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for p, i in vocabulary.items() if p.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {m: self._whole(m) for m in self.MARKS}
        self.bar, = np.frombuffer(self._whole("|"), "<u4")  # between two words a piece of its own

    def _ids(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _whole(self, text: str) -> bytes:
        return self._ids(self.tokenizer, text).tobytes()

    def _merged(self, words: list[str]) -> list[bytes]:
        """Runs of letters: a piece with the end suffix ends each."""
        ids = self._ids(self.merges, " ".join(words).encode().decode("latin-1").translate(self.letters))
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *stops], stops)]

    def _barred(self, words: list[str]) -> list[bytes]:
        """Other words without a bar: told apart by bars."""
        ids = self._ids(self.tokenizer, " | ".join(words))
        ends = np.r_[np.flatnonzero(ids == self.bar), len(ids)].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *(e + 1 for e in ends)], ends)]

    def _learn(self, words: list[bytes]) -> None:
        memo, older, marks = self.memo, self.older, self.marks
        letters, other, marked = {}, {}, []
        for w in words:
            ids = older.get(w)
            if ids is not None:
                memo[w] = ids
                continue
            s = w.decode()
            if len(s) > 1 and s[-1] in marks and (s[-2].isalpha() or s[-2] in "0123456789"):
                marked.append((w, w[:-1], s[-1]))
                w, s = w[:-1], s[:-1]
                if w in memo:
                    continue
            if s.isalpha() and s == s.lower() and unicodedata.is_normalized("NFC", s):
                letters[w] = s
            elif "|" in s:
                memo[w] = self._whole(s)
            else:
                other[w] = s
        for some, encode in ((letters, self._merged), (other, self._barred)):
            keys, texts = list(some), list(some.values())
            for at in range(0, len(keys), 4096):
                memo.update(zip(keys[at: at + 4096], encode(texts[at: at + 4096]), strict=True))
        for w, stem, mark in marked:
            memo[w] = memo[stem] + marks[mark]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (NULL: empty)."""
        whole = np.zeros(len(column), bool)
        for s in self.special:
            whole |= pc.match_substring(column, s, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
        batch = pa.RecordBatch.from_arrays([pc.ascii_lower(column)], names=["text"])
        for span, raw, offsets in blocks(batch):
            if len(self.memo) > MEMO_ENTRIES:
                self.memo, self.older = {}, self.memo
            words = Words(raw, offsets)
            _, at, place = np.unique(words.hashes(lower=False), return_index=True, return_inverse=True)
            data = raw.tobytes()
            names = [data[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
            self._learn([w for w in names if w not in self.memo])
            known = [self.memo[w] for w in names]
            flat = np.frombuffer(b"".join(known), "<u4")
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            first = np.cumsum(size) - size
            count = size[place]
            end = np.cumsum(count)
            total = int(end[-1]) if len(end) else 0
            ids = flat[np.repeat(first[place] - (end - count), count) + np.arange(total)]
            cuts = np.r_[0, end][words.first]
            for d in range(len(offsets) - 1):
                if whole[span.start + d]:
                    text = column[span.start + d].as_py()
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
                else:
                    yield ids[cuts[d]: cuts[d + 1]]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def all_but_first(n: int) -> np.ndarray:
    """Loss mask of a plain document: each id but the first is predicted."""
    mask = np.ones(n, bool)
    mask[:1] = False
    return mask


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(),
                   may_cut: bool = True, loss_mask: Callable[[int], np.ndarray] = all_but_first,
                   keep_encoder: bool = True) -> DataFrame:
    """One row per piece: which ids of which document stand where.

    A document is the ids of its whole text (NULL: empty) and ``end_id``, so
    every row has at least one id.  Pieces are written as tasks read texts:
    no shuffle, and a task holds at most WAITING short pieces, whatever the
    table's size or skew; a task's last sequence alone may have room left.
    ``sequence_id`` is the task's partition in the high bits and a running
    number in the low ones, so a task that runs again writes the same rows.
    Repeated rows are packed one by one.  ``keep_encoder``: a Python worker
    keeps its encoder and encoded words for its next task; off, it frees them
    for other work of the same session."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        packer = Packer(limits, TaskContext.get().partitionId() << 36, may_cut)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in SCHEMA.split(", ")]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                x = np.append(x, np.uint32(end_id))
                rows += packer.add(Piece(doc_id, 0, x, loss_mask(len(x)), len(x)))
            yield table(rows)
        yield table(list(packer.pack()))
        if not keep_encoder:
            word_encoder.cache_clear()
    return id_and_text(docs).mapInArrow(run, SCHEMA)
