"""Operator 6: token counts with a whole-token shortcut.

The vocabulary is examined once, before any text: no piece holds a space mark
after another character and none holds a line feed, so merges never cross the
start of a word or a line feed, and a text's count is the sum over its
pre-tokens.  Vocabulary strings that the library encodes, alone, as one token
count one without merging; other pre-tokens go to the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from phonelens.llm.common import id_and_text

SPACE_MARK = "▁"
_PRE_TOKEN = re.compile(SPACE_MARK + "*[^" + SPACE_MARK + "]+|" + SPACE_MARK + "+")
MEMO_ENTRIES = 300_000  # a worker's memory of merged pre-tokens; emptied when full, results unaffected
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class Proof:
    """What the vocabulary allows, found by looking at every piece of it."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.sp.get_piece_size()
        ordinary = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
        pieces = [self.sp.id_to_piece(i) for i in ordinary]
        self.splits = not any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in pieces)
        # the library must leave texts as they are, but for spaces, and put one space first
        probe = "  Åﬁ Ａ\n\tx  "
        self.plain = self.sp.normalize(probe) == SPACE_MARK + probe.replace(" ", SPACE_MARK)
        self.single = frozenset(p for p in pieces if self.plain and self._alone(p) == 1)

    def _alone(self, pre_token: str) -> int:
        return self.merged([pre_token])[0]

    def merged(self, pre_tokens: list[str]) -> list[int]:
        """Counts from the library, for strings in which spaces are marks.

        The library always puts a space first, so a string is encoded behind
        a line feed, which no piece holds: the space and the line feed take
        a fixed number of tokens, which is taken off again."""
        head = len(self.sp.encode("\n"))
        return [len(x) - head for x in self.sp.encode(["\n" + p.replace(SPACE_MARK, " ") for p in pre_tokens], num_threads=1)]


@lru_cache(maxsize=2)
def proof(model_path: str) -> Proof:
    return Proof(model_path)


class Counter:
    def __init__(self, model_path: str):
        self.proof = proof(model_path)
        self.memo = dict.fromkeys(self.proof.single, 1)

    def counts(self, texts: list[str]) -> np.ndarray:
        if not (self.proof.splits and self.proof.plain):  # a vocabulary without the property: the library alone
            return np.array([len(x) for x in self.proof.sp.encode(texts, num_threads=1)], np.int64)
        if len(self.memo) > MEMO_ENTRIES + len(self.proof.single):
            self.memo = dict.fromkeys(self.proof.single, 1)
        memo, out, parts = self.memo, np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            if not t:
                parts.append([])
                continue
            lines = (SPACE_MARK + t.replace(" ", SPACE_MARK)).split("\n")
            out[i] = len(lines) - 1  # a line feed is one byte token
            parts.append(_PRE_TOKEN.findall("\n".join(lines)) if len(lines) == 1 else
                         [p for line in lines for p in _PRE_TOKEN.findall(line)])
        fresh = {p for ps in parts for p in ps if p not in memo}
        if fresh:
            fresh = list(fresh)
            memo.update(zip(fresh, self.proof.merged(fresh)))
        for i, ps in enumerate(parts):
            out[i] += sum(map(memo.__getitem__, ps))
        return out


@lru_cache(maxsize=2)
def _counter(model_path: str) -> Counter:
    return Counter(model_path)


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row's whole text, as the
    library's encode() gives them without begin or end tokens.

    NULL and empty texts have 0 bytes and 0 tokens; a row's result depends
    on its text alone, so repeated rows are counted alike.  Nothing is
    shuffled; a task holds a few hundred texts at a time."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = part.column("text").fill_null("")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()),
                     pa.array(counter.counts(text.to_pylist()))], names=["doc_id", "n_bytes", "n_tokens"])
    return id_and_text(docs).mapInArrow(count, SCHEMA)
