"""Contact graph and handset operators on hand-made tables."""

from phonelens.operators import device as D
from phonelens.operators import graph as G
from tests import fixtures as fx
from tests.conftest import by_key, rows


def test_callback_count_small_graph(spark):
    out = by_key(G.callback_count(fx.graph_small_voice(spark)))
    # a called b, c, a; was called by b (and logs its self-call as received)
    assert (out["a"]["recall"], out["a"]["call"]) == (2, 3)
    assert (out["b"]["recall"], out["b"]["call"]) == (1, 1)
    assert (out["c"]["recall"], out["c"]["call"]) == (0, 1)
    assert (out["d"]["recall"], out["d"]["call"]) == (0, 0)
    for r in out.values():
        assert r["recall"] <= r["call"]


def test_reciprocated_rows_brute_force(spark):
    log = fx.graph_small_voice(spark)
    got = by_key(G.reciprocated_rows(log))
    pairs = [(r["phone_no_m"], r["opposite_no_m"]) for r in log.collect()]
    expect = {}
    for p in {a for a, _ in pairs}:
        total = sum(sum(1 for x, y in pairs if x == c and y == p) for c in {b for a, b in pairs if a == p})
        if total:
            expect[p] = total
    assert {k: v["recall"] for k, v in got.items()} == expect


def test_no_outgoing_and_fallback(spark):
    log = fx.graph_small_voice(spark)
    assert rows(G.no_outgoing(log)) == [("d",)]
    fb = by_key(G.callback_with_fallback(log))
    assert fb["d"]["measure"] == "rows" and fb["d"]["call"] == 1 and fb["d"]["recall"] == 1
    assert fb["a"]["measure"] == "distinct_contacts"


def test_contact_edges_counts(spark):
    e = G.contact_edges(fx.graph_small_voice(spark))
    got = {(r["phone_no_m"], r["contact"], r["direction"]): r["n"] for r in e.collect()}
    assert got[("a", "b", "out")] == 2 and got[("b", "a", "in")] == 2 and got[("a", "a", "out")] == 1


def test_shared_handset_score(spark):
    out = by_key(D.shared_handset_score(fx.handset_small_voice(spark)))
    # a: rows h1 (alone: 0), h3 (3 phones), NULL (0) -> 3 / 3
    assert out["a"]["imei_phone"] == 1.0
    assert out["b"]["imei_phone"] == 3.0 and out["c"]["imei_phone"] == 3.0
    per = rows(D.phones_per_handset(fx.handset_small_voice(spark)))
    assert per == [("h3", 3)]


def test_contact_edges_reverse_adds_incoming(spark):
    log = fx.voice(spark, [("a", "b", 1, fx.ts(1), 1.0, "c", "k", "h1")])   # only a's side is logged
    plain = {(r["phone_no_m"], r["contact"], r["direction"]) for r in G.contact_edges(log).collect()}
    rev = {(r["phone_no_m"], r["contact"], r["direction"]) for r in G.contact_edges(log, reverse=True).collect()}
    assert plain == {("a", "b", "out")}
    assert rev == {("a", "b", "out"), ("b", "a", "in")}


def test_callback_share_counts_nonzero_per_class(spark):
    cb = spark.createDataFrame([("a", 2, 3), ("b", 0, 1), ("c", 0, 0), ("d", 1, 1)],
                               "phone_no_m string, recall long, call long")
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0), ("d", 0)], "phone_no_m string, label int")
    got = {r["label"]: (r["with_out"], r["nonzero"]) for r in G.callback_share(cb, labels).collect()}
    assert got == {1: (2, 1), 0: (1, 1)}
