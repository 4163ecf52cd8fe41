"""Operator 12 against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from phonelens.llm import spelling
from tests.llm.conftest import documents


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(rows, noise):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if noise and doc_id is not None and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    best = {}
    for w in counts:
        around = sorted((-counts[v], v) for v in counts if near(v, w))
        best[w] = (len(around), around[0][1] if around and -around[0][0] >= 10 * counts[w] else None)
    out = []
    for w, (k, form) in best.items():
        root = w
        while best[root][1]:
            root = best[root][1]
        out.append((w, form, root, counts[w], k, counts[form] if form else None))
    return sorted(out)


def run(docs, noise, list_words):
    rows = spelling.spelling_variants(docs, noise=noise, list_words=list_words)
    return sorted(tuple(r) for r in rows.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("list_words", [1, 5, 4096])
def test_variants_against_all_pairs(spark, list_words):
    """Common endings, one letter repeated, ties, chains of forms, letters
    beyond ASCII, with every gram frequent, some and none."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(2, 6))) for _ in range(40)]
    words = [s + e for s in stems for e in ("ation", "ations", "aaaaaaa")] + ["Aaaaaaaa", "aaaaaaaaaa" * 30, "×÷ßØþÿàa"]
    words += [w[:i] + rng.choice("abxé") + w[i + 1:] for w in words[:60] for i in (0, 3, len(w) - 1)]
    words += [w[:i] + w[i + 1:] for w in words[:60] for i in (1, len(w) // 2)]
    texts = [" ".join([w] * rng.choice([1, 2, 3, 20, 40, 500])) for w in words] + [None, "", " .,! ", "chainab " * 1000 + "chainac " * 90
                                                                                + "chaiiac " * 8]
    docs = documents(spark, texts)
    got = run(docs, 31, list_words)
    assert got == by_hand([(r.doc_id, r.text) for r in docs.collect()], 31)
    assert len({r[2] for r in got}) < len(got) and any(r[1] and r[1] != r[2] for r in got)


def test_every_near_pair_shares_a_list():
    """The affected-gram bound: entries of near words meet, whatever is frequent."""
    rng = random.Random(8)
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(7, 14)))
        at, kind = rng.randrange(len(a)), rng.randrange(3)
        b = a[:at] + ("" if kind == 0 else rng.choice("abc")) + a[at + (kind < 2):]
        if a == b or len(b) < 7:
            continue
        p = spelling.Points([a, b], marked=True)
        grams = {int(h): rng.randrange(2, 9) for q in range(3, 7) for i in range(len(p.values) - q + 1)
                 if rng.random() < 0.5
                 for h in spelling.span_hash(p.values, np.array([i]), np.array([i + q])).view(np.int64)}
        key, word, cut = spelling.list_entries([a, b], spelling.Dictionary(grams))
        i, _ = spelling.near_in_lists(*(lambda o: (key[o], [[a, b][w] for w in word[o]], cut[o]))(np.argsort(key, kind="stable")))
        assert i, (a, b)


def test_short_words_are_refused(spark):
    docs = documents(spark, ["abcdef abcdef"])
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, min_length=6).collect()


def test_null_ids_lose_no_letter(spark):
    texts = [" ".join("abcdefg" + c for c in "abcdefghijklmnopqrstuvwxyz")] * 2
    docs = documents(spark, texts).selectExpr("cast(null as bigint) as doc_id", "text", "doc_id as word", "n as key")
    assert run(docs, 1, 4096) == by_hand([(None, t) for t in texts], 1)
