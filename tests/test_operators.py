import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import names, similarity, texts
from tallyspark.operators import allocation, anomaly, graph, identity, quality, revenue, review, semantic
from tallyspark.plans import pipeline


@pytest.mark.parametrize("raw, want", [("Acme Technologies Pvt. Ltd.", "acme technologies"), ("A & B Limited, Inc.", "a and b"), ("Foo Private  Limited LLP", "foo"), (None, ""), ("", "")])
def test_normalize_name(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(names.normalize_name(F.col("n"))).first()[0] == want


def test_name_tokens_keep_something(spark):
    got = spark.createDataFrame([("Global Technologies",), ("Acme Technologies",)], "n string").select(names.name_tokens(F.col("n"))).collect()
    assert [r[0] for r in got] == [["global", "technologies"], ["acme"]]


@pytest.mark.parametrize("raw, want", [
    ("NEFT CR-ACME INDUSTRIES INV-123 124", "ACME INDUSTRIES"), ("TRF FROM A/C 998877 JOHN DOE", "JOHN DOE"), ("UPI/razorpay settlement BLUE HARBOR REF: X12", "BLUE HARBOR"),
    ("APEX HOLDINGS ADVISORY FEE", "APEX HOLDINGS"), ("Advance Auto Parts", "Advance Auto Parts"), ("COBBLE INDUSTRIES INSTALMENT 3", "COBBLE INDUSTRIES"), (None, None), ("refund", "refund"),
])
def test_counterparty(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(texts.counterparty(F.col("n"))).first()[0] == want


def test_subsequence_against_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(9))) for _ in range(2))
        best = max(len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if (it := iter(b)) and all(x in it for x in c))
        assert similarity.common_subsequence(a, b) == best


def test_allocation_forced_cases():
    def solve(rows):
        df = pd.DataFrame([(1, *r) for r in rows], columns=["ws", "invoice_id", "payment_id", "total", "available", "score"])
        return allocation.solve(df)

    one_to_many = solve([(i, 9, t, 118_000_000, 0.9) for i, t in enumerate([47_200_000, 35_400_000, 23_600_000, 11_800_000])])
    assert len(one_to_many) == 4 and one_to_many.amount.sum() == 118_000_000
    many_to_one = solve([(1, p, 47_200_000, a, 0.9) for p, a in enumerate([20_000_000, 15_000_000, 12_200_000])])
    assert many_to_one.amount.sum() == 47_200_000 and len(many_to_one) == 3
    two_equal = solve([(i, 9, 50_000_000, 50_000_000, 0.9) for i in (1, 2)])
    assert two_equal.amount.sum() == 50_000_000 and len(two_equal) == 1
    whole = solve([(i, p, 7_500_000, 7_500_000, 0.9) for i in (1, 2, 3) for p in (7, 8, 9)])
    assert sorted(whole.amount) == [7_500_000] * 3


def test_allocation_conserves():
    rng = random.Random(3)
    for _ in range(20):
        inv, pay = {i: rng.randrange(1, 500) for i in range(3)}, {p: rng.randrange(1, 500) for p in range(3)}
        edges = [(i, p) for i in inv for p in pay if rng.random() < 0.7]
        if not edges:
            continue
        got = allocation.solve(pd.DataFrame([(1, i, p, inv[i], pay[p], 0.5) for i, p in edges], columns=["ws", "invoice_id", "payment_id", "total", "available", "score"]))
        assert all(n <= inv[i] for i, n in got.groupby("invoice_id").amount.sum().items())
        assert all(n <= pay[p] for p, n in got.groupby("payment_id").amount.sum().items())


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (8, 9)], "u long, v long")
    assert {r["node"]: r["label"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert {r["node"]: r["label"] for r in graph.strongly_connected(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 9}
    assert sorted(r["path"] for r in graph.cycles(e).collect()) == [[1, 2, 3], [4, 5]]


def test_constrained_clusters(spark):
    pairs = spark.createDataFrame([(0, 1, 2, 9.0, "ACCEPTED", False), (0, 2, 3, 8.0, "ACCEPTED", False), (0, 1, 3, -9.0, "REJECTED", True), (0, 5, 6, 7.0, "ACCEPTED", False)], "ws int, l long, r long, weight double, decision string, conflict boolean")
    assert {r["id"]: r["cluster"] for r in identity.clusters(pairs).collect()} == {1: 1, 2: 1, 3: 3, 5: 5, 6: 5}


def test_versions_of_returning_content(spark):
    rows = spark.createDataFrame([("k", 1, "A"), ("k", 2, "B"), ("k", 3, "A")], "k string, id int, h string")
    got = quality.versions(rows, ["k"], ["id"], "h", "id").orderBy("id").collect()
    assert [(r["id"], r["version"], r["superseded_by"]) for r in got] == [(1, 1, 2), (2, 2, None)]


def test_rescan_keeps_verdicts(spark):
    p = spark.createDataFrame([(0, "a", "OPEN"), (0, "b", "CONFIRMED"), (0, "c", "OPEN")], "ws int, fingerprint string, status string")
    n = spark.createDataFrame([(0, "c"), (0, "d")], "ws int, fingerprint string")
    assert {(r["fingerprint"], r["status"], r["fires"]) for r in anomaly.rescanned(p, n).collect()} == {("b", "CONFIRMED", False), ("c", "OPEN", True), ("d", "OPEN", True)}


def test_concentration_is_quiet_on_negatives(spark):
    df = spark.createDataFrame([(0, "a", 60), (0, "b", 40), (0, "c", -5)], "ws int, k string, x long")
    got = {r["k"]: (r["share"], r["hhi"]) for r in revenue.concentration(df, "k", "x").collect()}
    assert got == {"a": (60.0, 5200.0), "b": (40.0, 5200.0)}


def test_waterfall_reconciles(spark):
    totals = spark.createDataFrame([(0, "VERIFIED_RECURRING", 70), (0, "INVOICED_UNPAID", 50), (1, "VERIFIED_ONE_TIME", 500)], "ws int, state string, amount long")
    claims = spark.createDataFrame([(0, 100), (1, 100), (2, 5)], "ws int, claimed long")
    by = {}
    for r in revenue.waterfall(totals, claims).orderBy("ws", "step").collect():
        by.setdefault(r["ws"], []).append(r)
    for steps in by.values():
        assert steps[-1]["kind"] == "total" and sum(s["amount"] for s in steps[:-1]) == steps[-1]["amount"]
    assert by[1][1]["label"] == "Evidence beyond the claim" and by[2][1]["label"] == "Claimed but not evidenced"


def test_pipeline_order_and_stop(spark, tmp_path):
    t = {"raw": spark.range(3).toDF("x")}
    stages = {k: (lambda tables, k=k: {k: tables["raw"]}) for k in pipeline.NEEDS}
    stages["revenue"] = lambda tables: 1 / 0
    _, log = pipeline.run(t, stages, f"file://{tmp_path}")
    assert [k for k, _ in log] == ["identity", "contracts", "reconciliation", "revenue"] and log[-1][1].startswith("failed")
    with pytest.raises(pipeline.StageError):
        pipeline.run({"raw": spark.range(0).toDF("x")}, stages, str(tmp_path))
    assert pipeline.affected({"contracts"}) == ["contracts", "revenue", "anomaly", "review", "publish"]


def test_gate_publishes_unblocked(spark):
    row = dict(state="VERIFIED_ONE_TIME", has_invoice=True, is_live=True, recognised=10, retained=10, gross=10, refunded=0, confirmed=0, customer_resolved=True, contract_recurring=0, future_period=0, in_period=0, citations_verified=True, open_high_anomaly=False)
    df = spark.createDataFrame([row, row | {"retained": 5}])
    got = review.judged(df).collect()
    assert [r["verdict"] for r in got] == ["DISPUTED", "DISPUTED"] and [r["is_published"] for r in got] == [True, False]


def one_by_one(edges, barred):
    """Union by falling weight, refusing a union that would bring a barred pair together."""
    group = {}
    for weight, l, r in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        a, b = group.setdefault(l, {l}), group.setdefault(r, {r})
        if a is not b and not any((min(x, y), max(x, y)) in barred for x in a for y in b):
            a |= b
            for m in b:
                group[m] = a
    return {n: min(g) for n, g in group.items()}


def test_clusters_in_rounds_are_those_edge_by_edge(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for ws in range(60):  # dense and sparse graphs, chains of equal and of falling weights
        n = rng.randint(3, 14)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
        if ws % 3:
            edges = {p: float(rng.choice([6, 7, 8, 20])) for p in rng.sample(pairs, min(len(pairs), rng.randint(n, 2 * n)))}
        else:
            edges = {(a, a + 1): float(40 - a if ws % 2 else 20) for a in range(n - 1)}
        barred = {p for p in pairs if p not in edges and rng.random() < (0.15 if ws % 4 else 0.5)}
        rows += [(ws, a, b, w, "ACCEPTED", False) for (a, b), w in edges.items()] + [(ws, a, b, -5.0, "REJECTED", True) for a, b in barred]
        want |= {(ws, k): c for k, c in one_by_one([(w, a, b) for (a, b), w in edges.items()], barred).items()}
    frame = spark.createDataFrame(rows, "ws int, l long, r long, weight double, decision string, conflict boolean")
    assert {(r["ws"], r["id"]): r["cluster"] for r in identity.clusters(frame).collect()} == want


@pytest.mark.parametrize("together, rounds", [(50_000, 0), (30, 2)])
def test_small_components_need_no_rounds(spark, monkeypatch, together, rounds):
    """A chain that only falling weights decide, so that rounds take its edges one by one; ids that doubles don't tell apart."""
    monkeypatch.setattr(identity, "TOGETHER", together)
    seen, staged = [], identity.staged
    monkeypatch.setattr(identity, "staged", lambda df, name: seen.append(name) or staged(df, name))
    n, start = 18, 2**60
    edges = {(a, a + 1): float(40 - a) for a in range(n - 1)}
    barred = {(a, b) for a in range(n) for b in range(a + 2, n) if (a * b) % 5 == 1}
    rows = [(1, start + a, start + b, w, "ACCEPTED", False) for (a, b), w in edges.items()] + [(1, start + a, start + b, -5.0, "REJECTED", True) for a, b in barred]
    frame = spark.createDataFrame(rows, "ws int, l long, r long, weight double, decision string, conflict boolean")
    want = {start + k: start + c for k, c in one_by_one([(w, a, b) for (a, b), w in edges.items()], barred).items()}
    assert {r["id"]: r["cluster"] for r in identity.clusters(frame).collect()} == want
    assert seen.count("round") <= rounds


def test_similar_vectors_against_all_pairs(spark, monkeypatch):
    """Every pair above the threshold, among vectors of which many are equal and many lie in one bucket; also with blocks of a few vectors."""
    import numpy as np

    rng = np.random.default_rng(3)
    heads = rng.normal(size=(20, 12))
    rows = [(0, i, heads[i % 20] + rng.normal(size=12) * (0.2 if i % 2 else 0.6)) for i in range(120)] + [(0, 200 + i, heads[0]) for i in range(5)] + [(1, i, heads[i % 3]) for i in range(6)] + [(1, 99, np.zeros(12))]
    frame = spark.createDataFrame([(w, i, [float(c) for c in v]) for w, i, v in rows], "ws int, id long, vector array<double>")
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    same = lambda a, b: a.tobytes() == b.tobytes()
    first = {(w, v.tobytes()): min(i for x, i, u in rows if x == w and same(u, v)) for w, _, v in rows}
    want = {(w, i, j) for w, i, a in rows for x, j, b in rows if w == x and i < j and a.any() and b.any() and cos(a, b) >= 0.7 and (not same(a, b) or first[w, a.tobytes()] == i)}
    found = lambda: {(r["ws"], r["l"], r["r"]) for r in semantic.similar(frame, 0.7).collect()}
    assert found() == want
    monkeypatch.setattr(semantic, "BLOCK", 7)
    assert found() == want


def test_components_share_a_task_and_stay_apart():
    """Rows in the order of their labels, cut into batches anywhere, are solved as each component by itself; one too large is counted, not held."""
    import pyarrow as pa

    rows = [(f"c{k // 3}", 1 + k // 3 % 2, k // 3 * 10 + k % 3, k // 3 * 10, 100 + k, 150, 0.5) for k in range(30)]
    rows += [("d", 7, n, n, 5, 5, 0.5) for n in range(allocation.MAX_EDGES + 3)]
    names = ["label", "ws", *allocation.EDGE]
    batches = lambda size: (pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + size]]) for i in range(0, len(rows), size))
    whole = [(ws, allocation.settled(held, n), n, len(held)) for ws, held, n in allocation.components_in_order(batches(len(rows)))]
    for size in (1, 7, 1000):
        assert [(ws, allocation.settled(held, n), n, len(held)) for ws, held, n in allocation.components_in_order(batches(size))] == whole
    assert [w[2] for w in whole] == [3] * 10 + [allocation.MAX_EDGES + 3] and whole[-1][1][0][3] == "TOO_LARGE" and whole[-1][3] == allocation.MAX_EDGES
    assert all(sum(link[2] for link in w[1]) == 150 for w in whole[:-1])


def test_names_compared_together_are_those_one_by_one():
    rng = random.Random(5)
    texts = ["", None, "abc", "a b", "zeta firm", "zetafirm limited", "ä" * 9, "x" * 80, "x" * 70 + "y"] + ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 63))) for _ in range(60)]
    texts += [t[rng.randrange(3) : len(t) - rng.randrange(3)] for t in texts if t]
    a, b = zip(*[(x, y) for x in texts for y in texts], strict=True)
    assert similarity.best_ratios(list(a), list(b)).tolist() == [similarity.best_ratio(x, y) for x, y in zip(a, b)]
    for least in (0.0, 60.0, 88.0):
        assert similarity.are_contained(list(a), list(b), least).tolist() == [similarity.containment(x, y) >= least for x, y in zip(a, b)]


def test_few_pairs_need_windows(monkeypatch):
    """Names of one pattern: what of one stands in the other tells that no stretch of it can do."""
    seen = []
    monkeypatch.setattr(similarity, "containment", lambda x, y: seen.append(x) or 0.0)
    names = [f"zeta{n:05d} {word}" for n in range(20) for word in ("building", "machinery", "automobile")]
    similarity.are_contained(names * 20, sorted(names) * 20, 88.0)
    assert len(seen) < 200
