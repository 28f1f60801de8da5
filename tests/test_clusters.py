"""Components and clusters that are too large for one task, in small."""

import random

import pytest
from pyspark.sql import functions as F

from test_operators import one_by_one

from tallyspark.operators import graph, identity

PAIR = "ws int, l long, r long, weight double, decision string, conflict boolean"


def test_components_without_a_last_task(spark, monkeypatch):
    """Chains, stars around a high node, rings and random graphs, by rounds alone."""
    monkeypatch.setattr(graph, "LAST", 0)
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 130)] + [(299, k) for k in range(200, 240)] + [(300 + k, 300 + (k + 7) % 30) for k in range(30)] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(90)] + [(600, 600)]
    label = {}
    for u, v in edges:
        a, b = label.setdefault(u, {u}), label.setdefault(v, {v})
        if a is not b:
            a |= b
            label.update(dict.fromkeys(b, a))
    frame = spark.createDataFrame(edges, "u long, v long")
    assert {r["node"]: r["label"] for r in graph.components(frame).collect()} == {n: min(g) for n, g in label.items()}


@pytest.mark.parametrize("together, ids", [(40, 0), (8, 2**50)])
def test_large_contested_components(spark, monkeypatch, together, ids):
    """Components that no task may walk through as a whole: by levels of weight, by walks over parts of them, and edge by edge where all weights are equal."""
    monkeypatch.setattr(identity, "TOGETHER", together)
    rng = random.Random(together)
    rows, want = [], {}
    for ws in (1, 3):
        n = 11
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
        edges = {p: 20.0 if ws == 3 else float(rng.choice([6, 7, 9.5, 20])) for p in rng.sample(pairs, 20)}
        barred = {p for p in pairs if p not in edges and rng.random() < 0.2}
        rows += [(ws, ids + a, ids + b, w, "ACCEPTED", False) for (a, b), w in edges.items()] + [(ws, ids + a, ids + b, -5.0, "REJECTED", True) for a, b in barred]
        want |= {(ws, ids + k): ids + c for k, c in one_by_one([(w, a, b) for (a, b), w in edges.items()], barred).items()}
    assert {(r["ws"], r["id"]): r["cluster"] for r in identity.clusters(spark.createDataFrame(rows, PAIR)).collect()} == want


def test_equal_weights_without_conflict_among_them_take_one_round(spark, monkeypatch):
    """Forty records that all accept each other, each barred from one of another forty, with a weaker link between the two groups; single edges took a round for each record."""
    monkeypatch.setattr(identity, "TOGETHER", 100)
    seen, staged = [], identity.staged
    monkeypatch.setattr(identity, "staged", lambda df, name: seen.append(name) or staged(df, name))
    n = 40
    rows = [(0, s + a, s + b, 20.0, "ACCEPTED", False) for s in (0, n) for a in range(n) for b in range(a + 1, n)] + [(0, 0, n + 1, 7.0, "ACCEPTED", False)] + [(0, k, n + k, -5.0, "REJECTED", True) for k in range(n)]
    got = {r["id"]: r["cluster"] for r in identity.clusters(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == {k: k // n * n for k in range(2 * n)} and len(seen) < 40


def test_vectors_are_asked_only_where_they_tell(spark, monkeypatch):
    """Decisions, conflicts and the weights of accepted pairs are those of all scores; pairs that no vector can lift aren't asked about."""
    names = ["zeta alpha", "zeta alpha two", "zeta beta", "omega beta", "zeta alpha", "zetta alfa", "omega betta", "quite other"]
    people = spark.createDataFrame([(0, k, n, None, "27ABCDE0001F1Z5" if k in (0, 3) else None) for k, n in enumerate(names)], "ws int, id long, name string, email string, tax_id string").withColumns({"phone": F.lit(None).cast("string"), "address": F.lit(None).cast("string")})
    recs = identity.records(people)
    pairs = spark.createDataFrame([(0, a, b, "x") for a in range(8) for b in range(a + 1, 8)], "ws int, l long, r long, rule string")
    semantic = pairs.select("ws", "l", "r", (F.lit(0.4) + F.pmod(F.xxhash64("l", "r"), F.lit(60)) / 100).alias("similarity"))
    asked = []

    def similar(some):
        asked.extend((r["l"], r["r"]) for r in some.collect())
        return semantic.join(some, ["ws", "l", "r"])

    told = lambda df: {(r["l"], r["r"]): (r["decision"], r["conflict"], r["weight"] if r["decision"] == "ACCEPTED" else None) for r in df.collect()}
    whole = identity.scored(pairs, recs, semantic)
    assert told(identity.settled(pairs, recs, similar)) == told(whole)
    assert 0 < len(asked) < 28 and set(asked) >= {(r["l"], r["r"]) for r in whole.where("exact IS NULL AND decision = 'ACCEPTED'").collect()}
