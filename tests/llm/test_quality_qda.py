"""Operator 11: statistics against plain Python, densities against the formula, held-out labels."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonelens.llm import quality_qda as Q
from phonelens.llm import queries
from tests.llm.conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    size = [len(w.encode()) for w in words]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(lower[i: i + 5]) for i in range(len(lower) - 4)]
    again = lambda xs: sum(c - 1 for c in Counter(xs).values())
    share = lambda n, of: math.asin(math.sqrt(n / max(of, 1)))
    ascii_marks = [c for c in text if 32 < ord(c) < 127 and not c.isalnum()]
    chars = [sum(c in "#*$%&|<>" for c in text), sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text),
             sum(c in "!?" for c in text), text.count("."), sum(c not in "#*$%&|<>!?." for c in ascii_marks),
             sum(ord(c) > 127 for c in text)]
    return [math.log1p(len(words)), math.log1p(sum(size) / max(len(words), 1)), math.log1p(max(size, default=0)),
            math.log1p(len(words) / max(len(lines), 1)), *(share(c, len(text)) for c in chars),
            share(sum(s <= 3 for s in size), len(words)), share(again(lower), len(words)), share(again(windows), len(windows)),
            share(again(lines), len(lines)), share(sum("A" <= w[0] <= "Z" for w in words), len(words))]


@given(st.lists(st.text(alphabet="aB1 \t\n.!#é☃", max_size=60), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_statistics_of_a_block(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    assert np.allclose(Q.statistics(raw, offsets), [plain(t) for t in texts])


def test_scores_are_the_densities():
    rng = np.random.default_rng(4)
    x = [rng.normal(0, 1, (400, 3)) @ rng.normal(0, 1, (3, 3)) + k for k in range(2)]
    n = np.array([400.0, 400.0])
    model = Q.discriminant(n, np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x]))
    cov = [np.cov(a.T, bias=True) for a in x]
    pooled = (cov[0] + cov[1]) / 2
    logs = []
    for k in range(2):
        c = 0.9 * cov[k] + 0.1 * pooled
        c = (1 - Q.RIDGE) * c + (Q.RIDGE * np.trace(c) / 3 + 1e-9) * np.eye(3)
        d = x[0] - x[k].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    assert np.allclose(model.score(x[0]), 1 / (1 + np.exp(logs[0] - logs[1])))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_held_out_labels(spark, sf):
    base = f"/root/testdata/sf{sf}"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rows = queries.op11_quality_qda(spark, base).join(labels, "doc_id").filter("held_out").collect()
    right = {q: [r.predicted == r.quality for r in rows if r.quality == q] for q in (0, 1)}
    assert all(len(v) > 5 and sum(v) / len(v) >= 0.97 for v in right.values())


def test_labels_of_held_out_ids_teach_nothing(spark):
    docs = documents(spark, [f"{'word ' * (i % 30 + 5)}{'#' * (i % 3)}" for i in range(120)])
    label = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int")
    scores = {r.doc_id: r for r in Q.quality_scores(docs, label).collect()}
    held = [i for i, r in scores.items() if r.held_out]
    turned = label.selectExpr("doc_id", f"if(doc_id in ({','.join(map(str, held))}), 1 - quality, quality) as quality")
    again = {r.doc_id: r for r in Q.quality_scores(docs, turned.union(turned)).collect()}
    assert len(held) > 10 and all(abs(scores[i].score - again[i].score) < 1e-9 for i in scores)


def test_defined_without_two_classes(spark):
    docs = documents(spark, ["one text", None, "", "x" * 100_000 + " " + "long words " * 30_000])
    none = spark.createDataFrame([(None, 1), (0, None)], "doc_id long, quality int")
    assert {r.score for r in Q.quality_scores(docs, none).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in Q.quality_scores(docs, both).collect()} == {1.0}
    two = spark.createDataFrame([(0, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.quality_scores(docs, two).collect())
