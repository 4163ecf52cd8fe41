"""op5's workers: small blocks and tables of words, results unaffected by
their limits."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from phonelens.llm import lattice_lm as L

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _batch(n: int, words: int) -> pa.RecordBatch:
    texts = [" ".join(f"W{(i * 31 + j * 7919) % 50_000:x}" for j in range(words)) for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n) % 3), pa.array(texts), pa.array(np.arange(n) % 7 == 2)],
                                      names=["chunk", "text", "held_out"])


def _sums(batches) -> dict:
    out: dict = {}
    for b in batches:
        for r in b.to_pylist():
            key = tuple(r[c] for c in r if c not in ("n",))
            out[key] = out.get(key, 0) + r.get("n", 0)
    return out


def test_limits_leave_counts_alone(monkeypatch):
    batch = _batch(200, 300)
    runs = [L._piece_counts(MODEL), L._dictionary(True), L._dictionary(False)]
    want = [_sums(run([batch])) for run in runs]
    monkeypatch.setattr(L, "MEMO_ENTRIES", 50)
    monkeypatch.setattr(L, "CHUNK_WORDS", 100)
    monkeypatch.setattr(L, "HELD_WORDS", 200)
    monkeypatch.setattr(L, "SMALL_BLOCK", 1000)
    assert [_sums(run([batch])) for run in runs] == want


def test_a_worker_holds_little_beside_its_batch():
    batch = _batch(4000, 400)                                   # some 9 MB of text
    list(L._dictionary(False)([batch.slice(0, 10)]))            # tables that stay
    tracemalloc.start()
    list(L._dictionary(False)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak
