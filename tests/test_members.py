"""Pairs of members of linked groups."""

import random

import pytest

from tallyspark.operators import anomaly, members


@pytest.mark.parametrize("block", [2, 1000])
def test_member_pairs_against_all_pairs(spark, monkeypatch, block):
    """Groups of one, of a few and of many members, linked with one another and with themselves."""
    monkeypatch.setattr(members, "BLOCK", block)
    rng = random.Random(4)
    held = [(w, rng.choice("abcdeee"), 100 * w + k) for w in (1, 2) for k in range(40)] + [(1, "a", None)]
    links = [(1, "a", "b", 0.5), (1, "c", "e", 0.6), (1, "e", "e", 1.0), (2, "e", "e", 1.0), (2, "d", "a", 0.7)]
    want = sorted((w, min(x, y), max(x, y), s) for w, p, q, s in links for v, g, x in held for u, h, y in held if w == v == u and g == p and h == q and None not in (x, y) and (p != q or x < y))
    found = members.member_pairs(spark.createDataFrame(links, "ws int, inner string, outer string, s double"), spark.createDataFrame(held, "ws int, head string, id long"))
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 200


def test_contained_parties_shuffle_no_pairs(spark):
    """Ids by the square of their number come out of lists, with no exchange after that."""
    rows = spark.range(400).selectExpr("cast(id % 2 as int) AS ws", "id", "concat('firma ', substr('abcdef', 1, cast(id % 3 as int) + 1)) AS name")
    pairs = anomaly.contained_parties(rows, "id")
    want = {(w, a, b) for w in (0, 1) for a in range(w, 400, 2) for b in range(a + 2, 400, 2)}
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("Repartition") and "Aggregate" not in plan[: plan.index("Repartition")]
