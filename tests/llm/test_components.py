import numpy as np
import pytest

from phonelens.llm import components as C


@pytest.fixture(scope="module")
def edges(spark):
    """A long path, a hub, loops, repeated and NULL ends, dealt over tasks."""
    rng = np.random.default_rng(3)
    path = [(int(a), int(b)) for a, b in zip(*(lambda p: (p[:-1], p[1:]))(rng.permutation(300)))]
    hub = [(1000, 1000 + i) for i in range(1, 40)]
    pairs = [(2000 + int(a), 2000 + int(b)) for a, b in rng.integers(0, 200, (120, 2))]
    rows = [*path, *hub, *pairs, *hub, (5, 5), (None, 7), (7, None)]
    return spark.createDataFrame(rows, "a long, b long").repartition(7)


def _expected(rows):
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i
    for a, b in rows:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up if root(i) != i}


def test_few_edges_need_no_step_of_stars(edges, monkeypatch):
    monkeypatch.setattr(C, "_large_star", lambda e: pytest.fail("a step of stars"))
    got = C.components(edges).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == _expected(edges.collect())


def test_many_edges_take_steps_of_stars(edges, monkeypatch):
    """More edges than a task may hold are never brought together."""
    steps = []
    star = C._large_star
    monkeypatch.setattr(C, "_large_star", lambda e: steps.append(1) or star(e))
    got = {r.node: r.root for r in C.components(edges, piece=0).collect()}
    assert got == _expected(edges.collect()) and steps


def test_no_edge(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
