"""Connectors, candidates and allocation against brute force and hand-sized cases."""

import json
import os
import random
import re
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import names
from tallyspark.operators import allocation, anomaly, contracts, reconcile
from tallyspark.plans.adapters import Tables
from tallyspark.sources import connectors, documents
from tallyspark.streaming import evidence

SF = "/root/testdata/sf0.001"


def test_connector_pages_and_refusals(spark, tmp_path):
    pages = {f"contacts-{k + 1}": {"contacts": [{"contact_id": str(10 * k + n)} for n in range(10)], "page_context": {"has_more_page": k < 2}} for k in range(4)}
    pages |= {f"invoices-{k + 1}": {"invoices": [{"invoice_id": str(n), "created_at": n} for n in range(4 * k, min(4 * k + 4, 6))]} for k in range(3)}
    pages["creditnotes-1"] = {"creditnotes": []}
    for name, body in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    rows = connectors.fetch(spark, "accounting", f"file://{tmp_path}/{{path}}-{{page}}.json", page_size=4)
    counts = {r["record_type"]: (r["n"], r["errors"]) for r in connectors.counts_by_type(rows).collect()}
    assert counts == {"customer": (30, 0), "invoice": (6, 0), "payment": (0, 1)}  # page 4 comes after the end, customerpayments doesn't exist
    assert connectors.next_cursor(rows).first()["since"] == 6 and not rows.where("is_synthetic").count()
    shown = connectors.fetch(spark, "crm", None, demonstration=rows.drop("is_synthetic").limit(1))
    assert shown.first()["is_synthetic"]
    with pytest.raises(ValueError):
        connectors.fetch(spark, "crm", None)


def test_connector_asks_again_and_follows_tokens(monkeypatch):
    """Answers of a server that is busy at times, pages with tokens in nested fields, and an offset in the middle of a page that has grown."""
    pages = {"": {"results": [{"id": k} for k in range(3)], "paging": {"next": {"after": "b"}}}, "b": {"results": [{"id": 3}]}}
    calls = []

    class Answer:
        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self):
            return json.dumps(self.body).encode()

    def urlopen(request, timeout):
        calls.append(request.full_url)
        if len(calls) % 3 == 1:
            raise connectors.urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)
        return Answer(pages[request.full_url.split("after=")[1]])

    monkeypatch.setattr(connectors.urllib.request, "urlopen", urlopen)
    monkeypatch.setattr(connectors, "PAUSE", 0)
    source = connectors.EvidenceStream({"connector": "crm", "base": "http://x/{path}?after={token}"})
    rows, at = source.read(source.initialOffset())
    assert [r[2] for r in rows] == ["0", "1", "2", "3"] and at["companies"] == {"n": 1, "skip": 3, "token": "b", "taken": 1, "refused": 0}
    again, same = source.read(at)
    assert not list(again) and same == at
    pages["b"] = {"results": [{"id": 3}, {"id": 4}], "paging": {"next": {"after": "c"}}}
    pages["c"] = {"results": [{"id": 5}]}
    rows, end = source.read(at)
    assert [r[2] for r in rows] == ["4", "5"]
    pages["c"]["results"].append({"id": 6})  # what came after a batch doesn't belong to it when it is read again
    assert [r[2] for r in source.readBetweenOffsets(at, end)] == ["4", "5"] and [r[2] for r in source.readBetweenOffsets(source.initialOffset(), at)] == ["0", "1", "2", "3"]
    assert [r[2] for r in source.read(end)[0]] == ["6"]
    monkeypatch.setattr(connectors, "RETRIES", 0)
    calls.clear()
    with pytest.raises(connectors.urllib.error.HTTPError):
        source.read(source.initialOffset())


def links(invoices, payments, edges, score=0.5):
    df = pd.DataFrame([(1, i, p, invoices[i], payments[p], score) for i, p in edges], columns=["ws", "invoice_id", "payment_id", "total", "available", "score"])
    return allocation.solve(df)


def test_hand_sized_allocations():
    four = {1: 47_200_000, 2: 35_400_000, 3: 23_600_000, 4: 11_800_000}
    got = links(four, {9: 118_000_000}, [(i, 9) for i in four])
    assert len(got) == 4 and got.amount.sum() == 118_000_000
    got = links({1: 47_200_000}, {1: 20_000_000, 2: 15_000_000, 3: 12_200_000}, [(1, p) for p in (1, 2, 3)])
    assert got.amount.sum() == 47_200_000
    got = links({1: 50_000_000, 2: 50_000_000}, {1: 50_000_000}, [(1, 1), (2, 1)])
    assert got.amount.tolist() == [50_000_000]
    got = links(dict.fromkeys((1, 2, 3), 7_500_000), dict.fromkeys((1, 2, 3), 7_500_000), [(i, p) for i in (1, 2, 3) for p in (1, 2, 3)])
    assert sorted(got.amount) == [7_500_000] * 3 and set(got.status) == {"OPTIMAL"}
    six = dict.fromkeys(range(6), 7_500_000)  # 36 edges: more than are searched to the end, and still whole links
    got = links(six, six, [(i, p) for i in six for p in six])
    assert sorted(got.amount) == [7_500_000] * 6
    assert links({i: 1 for i in range(70)}, {p: 1 for p in range(70)}, [(i, p) for i in range(70) for p in range(70)]).status.tolist() == ["TOO_LARGE"]


def every_flow(edges, invoices, payments, confidence):
    """The largest objective over all whole amounts."""
    best = 0

    def put(k, left, right, amount):
        nonlocal best
        if k == len(edges):
            best = max(best, allocation.objective(amount, invoices, confidence))
            return
        i, p = edges[k]
        for a in range(min(left[i], right[p]) + 1):
            put(k + 1, left | {i: left[i] - a}, right | {p: right[p] - a}, amount | {edges[k]: a})

    put(0, invoices, payments, {})
    return best


def test_search_finds_the_best_flow():
    rng = random.Random(5)
    for _ in range(150):
        invoices, payments = {i: rng.randint(1, 6) for i in range(rng.randint(1, 3))}, {p: rng.randint(1, 6) for p in range(rng.randint(1, 3))}
        pairs = [(i, p) for i in invoices for p in payments]
        edges = sorted(rng.sample(pairs, rng.randint(1, min(6, len(pairs)))))
        invoices, payments = {i: t for i, t in invoices.items() if any(e[0] == i for e in edges)}, {p: t for p, t in payments.items() if any(e[1] == p for e in edges)}
        confidence = {e: rng.choice([0.3, 0.6, 1.0]) for e in edges}
        best, bound = allocation.searched(edges, invoices, payments, confidence, allocation.greedy(edges, invoices, payments, confidence), 10**6)
        assert bound == allocation.objective(best, invoices, confidence) == every_flow(edges, invoices, payments, confidence)


def test_a_stopped_search_has_a_true_bound():
    rng = random.Random(6)
    stopped = 0
    for _ in range(40):
        invoices, payments = {i: rng.randint(1, 5000) for i in range(6)}, {p: rng.randint(1, 5000) for p in range(6)}
        edges = sorted(rng.sample([(i, p) for i in invoices for p in payments], 24))
        confidence = {e: rng.choice([0.3, 0.6, 1.0]) for e in edges}
        solve = lambda most: allocation.searched(edges, invoices, payments, confidence, allocation.greedy(edges, invoices, payments, confidence), most)
        (early, bound), (best, proven) = solve(2), solve(10**6)
        assert allocation.objective(best, invoices, confidence) == proven <= bound and allocation.objective(early, invoices, confidence) <= proven
        stopped += bound > allocation.objective(early, invoices, confidence)
    assert stopped


def test_amounts_of_nothing_have_no_links():
    got = links({1: 0, 2: 100}, {1: 100, 2: 0}, [(1, 1), (2, 1), (2, 2)])
    assert got[["invoice_id", "payment_id", "amount", "status"]].values.tolist() == [[2, 1, 100, "OPTIMAL"]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_best_allocations_reach_waterfall_and_gate(spark, tmp_path):
    """Everything that follows from the links is what the forced case's SQL says of the same links; nothing is allocated twice, and all components are solved to the end."""
    import duckdb

    from tallyspark.plans import queries_cash as cash

    t = cash.Settled(spark, SF)
    t.allocations().write.parquet(f"{tmp_path}/links")
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "part", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    con.execute(f"CREATE TABLE links AS SELECT * FROM read_parquet('{tmp_path}/links/*.parquet')")
    assert con.execute("SELECT count(*) FROM links").fetchone()[0] > con.execute("SELECT count(*) FROM links WHERE invoice_id = payment_id").fetchone()[0] > 0
    for f, name in ((cash.agg3, "agg3_invoice_outcomes"), (cash.agg2, "agg2_reconciliation_totals"), (cash.cls, "cls_revenue_states"), (cash.win8, "win8_waterfall"), (cash.crt, "crt_critic_gate"), (cash.mth3, "mth3_conservation")):
        sql, n = re.subn(r"allocations AS \(\n.*?\n.*?\),\nlines AS", "allocations AS (SELECT * FROM links),\nlines AS", cash.ORACLES[name], flags=re.S)
        assert n == 1
        got, want = f(t), con.execute(sql)
        columns = sorted(d[0] for d in want.description)
        assert sorted(got.columns) == columns
        order = [[d[0] for d in want.description].index(c) for c in columns]
        assert sorted(map(str, (tuple(r[k] for k in order) for r in want.fetchall()))) == sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))
        assert name != "mth3_conservation" or got.count() == 0
    assert {(r["status"], r["gap"]) for r in cash.alc_statuses(cash.Tables(spark, SF)).collect()} == {("OPTIMAL", 0)}


def walked(debits, refunds):
    """JN13 by a walk over the debits of one amount."""
    open_ = sorted(refunds, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    out = []
    for debit, on in sorted(debits, key=lambda d: (d[1] is None, d[1] or 0, d[0])):
        for k, (refund, back) in enumerate(open_):
            if back is None or on is not None and abs(on - back) <= 7:
                out.append((debit, refund))
                del open_[k]
                break
    return out


def test_debits_take_refunds_as_a_walk_does(spark):
    rng = random.Random(4)
    day = lambda: None if rng.random() < 0.15 else rng.randint(0, 60)
    debits, refunds, want = [], [], []
    for amount, n in ((1, 60), (2, 25), (3, 8), (4, 1), (5, 0)):
        d, r = [(amount * 100 + k, day()) for k in range(n)], [(amount * 1000 + k, day()) for k in range(rng.randint(n // 2, n + 3))]
        debits += [(1, amount, *x) for x in d]
        refunds += [(1, amount, *x) for x in r]
        want += [(1, amount, *x) for x in walked(d, r)]
    date = "CASE WHEN day IS NOT NULL THEN date_add(DATE'2024-01-01', day) END"
    d = spark.createDataFrame(debits, "ws int, amount long, debit_id long, day int").selectExpr("ws", "amount", "debit_id", f"{date} AS booked_on")
    r = spark.createDataFrame(refunds, "ws int, amount long, refund_id long, day int").selectExpr("ws", "amount", "refund_id", f"{date} AS refunded_on")
    assert sorted(tuple(x) for x in anomaly.matched_debits(d, r).collect()) == sorted(want)


def test_contained_names_against_all_pairs(spark, monkeypatch):
    """Names of 1 to 60 letters with a common first word, repeated ones, and names that stand in all others; also with buckets of a few names."""
    rng = random.Random(8)
    words = ["firma", "itc", "tata", "big", "a", "ab", "xyz", "hotels", "motors", "ltda"]
    names = [" ".join(["firma", *rng.choices(words, k=rng.randint(0, 9))])[: rng.randint(1, 60)].strip() for _ in range(150)] + ["itc", "itc hotels", "tata", "big tata motors", "f", "a", "é", "aé b", "firma"]
    rows = [(k % 2, n) for k, n in enumerate(names)]
    want = {(w, a, b) for w, a in rows for v, b in rows if w == v and a != b and a in b and a}
    frame = spark.createDataFrame(rows, "ws int, name string")
    assert {tuple(r) for r in anomaly.contained_names(frame).collect()} == want
    monkeypatch.setattr(anomaly, "BUCKET", 3)
    assert {tuple(r) for r in anomaly.contained_names(frame).collect()} == want


def test_candidates_against_all_pairs(spark):
    rng = random.Random(7)
    day = lambda: None if rng.random() < 0.1 else f"2024-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    name = lambda: rng.choice([None, "", "Firm Alpha Ltd", "Firm Beta", "Alpha"])
    who = lambda: rng.choice([None, 1, 2])
    invoices = [(1, k, "INR", who(), name(), day(), rng.randint(1, 5) * 1000, f"INV-{k:04}", "sent") for k in range(40)]
    payments = [(1, k, "INR", who(), name(), day(), rng.randint(1, 5) * 1000, f"pays INV-{rng.randint(0, 60):04}", None, "captured") for k in range(40)]
    i = spark.createDataFrame(invoices, "ws int, invoice_id int, currency string, customer_id int, customer_name string, issue_date string, total long, invoice_number string, status string").withColumn("issue_date", F.to_date("issue_date"))
    p = spark.createDataFrame(payments, "ws int, payment_id int, currency string, customer_id int, customer_name string, paid_on string, amount long, reference string, description string, status string").withColumn("paid_on", F.to_date("paid_on"))
    got = sorted((r["invoice_id"], r["payment_id"], r["score"]) for r in reconcile.invoice_payment_candidates(i, p).collect())
    si, sp = reconcile._sides(i, p)
    known = F.col("i_entity").isNotNull() & F.col("p_entity").isNotNull()
    named = (F.size("i_tokens") > 0) & (F.size("p_tokens") > 0)
    veto = (known & (F.col("i_entity") != F.col("p_entity"))) | (named & ~F.arrays_overlap("i_tokens", "p_tokens"))
    near = F.col("p_date").isNull() | F.col("i_date").isNull() | F.datediff("p_date", "i_date").between(reconcile.PAY_FROM, reconcile.PAY_TO)
    every = si.join(sp, ["ws", "currency"]).where(~veto & near).withColumns(reconcile.invoice_payment_score()).where(F.col("score") >= reconcile.LEAST_SCORE)
    assert got == sorted((r["i_id"], r["p_id"], r["score"]) for r in every.collect()) and len(got) > 50


def test_bank_candidates_against_all_pairs(spark):
    rng = random.Random(11)
    amounts = [0, 50, 99, 101, 150, 1600, 1700, 1990, 2000, 2010, 2100, 5000, 5300, 5301, 4699, 100_000, 106_000, 94_001]
    payments = [(1, "INR", k, f"2024-01-{rng.randint(1, 28):02}", rng.choice(amounts) + rng.randint(0, 3), rng.choice([0, 40, 200]), 0, f"s{k}", "captured") for k in range(60)]
    bank = [(1, "INR", k, f"2024-01-{rng.randint(1, 28):02}", max(0, rng.choice(amounts) + rng.randint(-3, 3)), rng.choice([None, f"ref S{k}"]), "credit") for k in range(60)]
    p = spark.createDataFrame(payments, "ws int, currency string, payment_id int, paid_on string, amount long, fee long, tax long, settlement_id string, status string").withColumn("paid_on", F.to_date("paid_on"))
    b = spark.createDataFrame(bank, "ws int, currency string, bank_id int, booked_on string, amount long, reference string, direction string").withColumn("booked_on", F.to_date("booked_on"))
    got = sorted((r["payment_id"], r["bank_id"]) for r in reconcile.payment_bank_candidates(p, b).collect())
    want = [
        (x[2], y[2]) for x in payments for y in bank
        if -1 <= (pd.Timestamp(y[3]) - pd.Timestamp(x[3])).days <= 10 and (abs(y[4] - (x[4] - x[5])) <= 100 or abs(y[4] - x[4]) <= max(100, x[4] * 6 // 100))
    ]
    assert got == sorted(want) and len(got) > 100


def test_forest_scores_and_drift(spark):
    rng = random.Random(3)
    rows = [(1, k, 1_700_000_000 + 3600 * k, float(10**9 if k == 77 else rng.randint(900, 1100)), 0.0, 3, 4, 1.0, 2.0) for k in range(120)] + [(2, 1000 + k, 1_700_000_000 + k, 1.0, 0.0, 3, 4, 1.0, 2.0) for k in range(10)]
    df = spark.createDataFrame(rows, "ws int, payment_id int, t long, amount double, refund_ratio double, hour int, day_of_month int, days_since double, nth double")
    df = df.withColumn("paid_at", F.timestamp_seconds("t")).drop("t")
    got = {r["payment_id"]: r for r in anomaly.outliers(df).collect()}
    assert len(got) == 120 and got[77]["outlier"] and got[77]["driver"] == "amount" and sum(r["outlier"] for r in got.values()) <= 6
    assert len({r["version"] for r in got.values()}) == 1 and max(got.values(), key=lambda r: r["score"])["payment_id"] == 77
    told = anomaly.drift(df).collect()
    assert {r["ws"] for r in told} == {1} and all(0 <= r["flagged_rate"] <= 1 for r in told)


def test_large_files_are_refused(spark, tmp_path):
    (tmp_path / "a b.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    (tmp_path / "c.pdf").write_bytes(b"%PDF-" + b"x" * 20)
    files = documents.found(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in documents.quarantined(files, most=50).collect()] == [("a b.pdf", 105, "the file is 0 MB; the limit is 0 MB")]
    assert documents.documents(files, most=50).first()["length"] == 25
    rows = spark.createDataFrame([("x/e.pdf", 0, b""), ("x/z.pdf", 4, b"PK\x03\x04")], "path string, length long, content binary")
    assert [r["reason"][:17] for r in documents.quarantined(rows).orderBy("name").collect()] == ["the file is empty", "the file is not a"]


def test_state_of_a_quiet_key_ends(spark, tmp_path):
    """A, B, A is two versions, but after a long pause a key begins anew; and so in every batching, rows being late, and over a restart. Nothing is kept of keys that are quiet."""
    day = lambda d: f"CAST(TIMESTAMP'2024-01-01' + make_dt_interval({d}) AS TIMESTAMP)"
    rng = random.Random(11)
    rows = sorted((k, d, k * 1000 + i, rng.choice("ABC")) for k in range(4) for i, d in enumerate(sorted(rng.sample(range(0, 400), 25))))
    want, known, last = [], {}, {}
    for k, d, i, c in sorted(rows):
        if k in last and d - last[k] > 20:
            known[k] = {}
        if c not in known.setdefault(k, {}):
            known[k][c] = len(known[k]) + 1
            want.append((k, c, known[k][c]))
        last[k] = d
    arrival = sorted(rows, key=lambda r: (r[1] + rng.randint(0, 4)))
    for part in range(5):  # four files, two runs, and a clock
        mine = arrival[part * 25 : part * 25 + 25] or [(99, 600, 0, "x")]
        frame = spark.createDataFrame(mine, "source_id long, d int, event_id long, content_hash string").select("source_id", F.expr(day("d")).alias("ts"), "event_id", "content_hash")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part in (1, 4):
            stream = evidence.record_stream(spark, f"{tmp_path}/in", "source_id long, ts timestamp, event_id long, content_hash string")
            got = evidence.collected(evidence.content_versions(stream, late="6 days", keep=timedelta(days=20)), f"file://{tmp_path}/versions")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    state = spark.read.format("statestore").option("stateVarName", "known").load(f"file://{tmp_path}/versions/state")
    assert state.count() == 0


def test_upserts_touch_their_own_parts_and_survive_replays(spark, tmp_path):
    from tallyspark.sources import sinks

    path = f"file://{tmp_path}/table"
    assert sinks.upserted(spark, path) is None
    schema, want, rng = "k long, v string, at int", {}, random.Random(2)
    batches = [[(rng.randint(0, 40), f"b{b}", b) for _ in range(25)] for b in range(1, 5)] + [[(7, "late", 5)]]
    for b, rows in enumerate(batches, 1):
        frame = spark.createDataFrame(rows, schema)
        before = {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
        assert sinks.upsert(frame, path, ["k"], ["at"], b, parts=8)
        assert all(f.stat().st_mtime_ns == before[str(f)] for f in tmp_path.rglob("*.parquet") if str(f) in before)
        want |= {k: v for k, v, _ in rows}
        assert not sinks.upsert(spark.createDataFrame(batches[0], schema), path, ["k"], ["at"], 1, parts=8)  # sent again
        assert {r["k"]: r["v"] for r in sinks.upserted(spark, path).collect()} == want and sinks.upserted(spark, path).count() == len(want)
    assert len(list((tmp_path / "table" / "data" / "held=5").glob("part=*"))) == 1
    (tmp_path / "table" / "data" / "held=6" / "part=0").mkdir(parents=True)  # a batch that never came to its commit
    assert {r["k"]: r["v"] for r in sinks.upserted(spark, path).collect()} == want


def test_outliers_need_no_window_over_a_workspace(spark):
    """The sample, by hash, and the folds, by rank in time, against windows over a whole workspace."""
    from pyspark.sql import Window

    rows = spark.range(900).selectExpr("CAST(id % 3 AS INT) AS ws", "id AS payment_id", "timestamp_seconds(id * 977 % 700) AS paid_at")
    got = anomaly.order.numbered(rows, [F.col("ws"), F.xxhash64("payment_id"), F.col("payment_id")], ["ws"], "n")
    place = F.row_number().over(Window.partitionBy("ws").orderBy(F.xxhash64("payment_id"), "payment_id"))
    assert sorted(map(tuple, got.select("payment_id", "n").collect())) == sorted(map(tuple, rows.select("payment_id", place).collect()))


def test_best_claims_are_those_of_all_pairs(spark):
    """With ties, settlements named in part, empty ones, and amounts near the limits."""
    rng = random.Random(5)
    amounts = [-500, 0, 50, 99, 1600, 1650, 1700, 1990, 2100, 5000, 5300, 5301, 4699, 100_000, 106_000, 94_001, 99_000, 103_000]
    for empty in (False, True):
        ids = ["s1", "set", "settlement-77", "Settlement-7", None, None, None] + [""] * empty
        payments = [(k % 2, "INR", rng.randint(1, 10**6), f"2024-01-{rng.randint(1, 28):02}" if k % 20 else None, rng.choice(amounts) + rng.randint(0, 3), rng.choice([0, 40, 4000]), 0, rng.choice(ids), "captured" if k % 9 else "failed") for k in range(150)]
        bank = [(k % 2, "INR", k, f"2024-01-{rng.randint(1, 28):02}", rng.choice(amounts) + rng.randint(-3, 3), rng.choice([None, "", "ref S1", "NEFT/SETTLEMENT-77/x"]), "credit" if k % 8 else "debit") for k in range(250)]
        p = spark.createDataFrame(payments, "ws int, currency string, payment_id int, paid_on string, amount long, fee long, tax long, settlement_id string, status string").withColumn("paid_on", F.to_date("paid_on"))
        b = spark.createDataFrame(bank, "ws int, currency string, bank_id int, booked_on string, amount long, reference string, direction string").withColumn("booked_on", F.to_date("booked_on"))
        rows = lambda df: sorted((r["ws"], r["bank_id"], r["payment_id"], r["score"]) for r in df.collect())
        want = rows(reconcile.claimed(reconcile.payment_bank_candidates(p, b)))
        assert rows(reconcile.best_claims(p, b)) == want and len(want) > 60 and len({w[3] for w in want}) > 4


def test_a_dense_cell_is_read_by_its_front(spark):
    """Ten thousand close payments: a credit meets dozens of them, not all."""
    rows = spark.range(10_000).select(F.lit(1).alias("cell"), F.col("id").alias("payment_id"), (100_000 + F.pmod(F.xxhash64("id"), F.lit(1000))).alias("amount"))
    rows = rows.withColumns({"low": F.col("amount") - 6000, "high": F.col("amount") + 6000})
    kept = reconcile.front(rows, ["cell"])
    assert kept.count() < 60
    limits = spark.range(93_900, 107_100, 50).select(F.col("id").alias("credit"))
    first = lambda df: sorted(tuple(r) for r in limits.crossJoin(df).where("credit >= low AND credit <= high AND (credit < 95000 OR credit > 106000 - 1000)").groupBy("credit").agg(F.min("payment_id")).collect())
    assert first(kept) == first(rows)


def test_statements_stay_small(spark):
    """Two workspaces of 30 000 lines are dealt over statements of some 1 000, however many lines there are."""
    from tallyspark.plans import queries_sources

    bank = spark.range(30_000).select((F.col("id") % 2).alias("ws"), F.col("id").alias("bank_id"))
    sizes = [r["count"] for r in bank.groupBy("ws", queries_sources._statement(bank, 1000)).count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) == 62 and max(sizes) < 1000


def test_an_intake_has_few_batches(spark, tmp_path):
    """Three hundred files are taken in by one batch."""
    from pyspark.sql import Row

    from tallyspark.sources import sinks

    sinks.files(spark.createDataFrame([Row(name=f"{k}.pdf", text=f"%PDF-{k % 200}") for k in range(300)]), f"file://{tmp_path}/in")
    running = evidence.started(documents.documents(documents.found(spark, f"file://{tmp_path}/in", stream=True)), f"file://{tmp_path}/out", f"file://{tmp_path}/state", availableNow=True)
    running.awaitTermination()
    assert [p["numInputRows"] for p in running.recentProgress if p["numInputRows"]] == [300]
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 200


def test_best_claims_read_each_side_once(spark):
    """Amounts of payments and credits follow from others, and are found once, not for every level of scores."""
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    t = Tables(spark, SF)
    p, b = t.payments(), t.bank()
    assert reconcile.best_claims(*(rows.mapInArrow(told, rows.schema) for rows in (p, b))).count() > 100
    assert seen.value == p.count() + b.count()


def test_contracts_of_parties_are_those_of_their_invoices(spark):
    """By customer, by name, by neither; customers, names and workspaces may be missing, and a contract's facts come along."""
    parties = [(1, 1, "Acme Ltd"), (1, None, "ACME Limited"), (1, 9, None), (1, None, None), (None, 1, "Acme"), (2, 1, "Acme Ltd"), (1, 7, "Other")]
    inv = spark.createDataFrame([(10 * i + k, *party) for i, party in enumerate(parties) for k in range(3)], "invoice_id long, ws int, customer_id long, customer_name string")
    con = spark.createDataFrame([(1, 5, 1, "Acme", "x"), (1, 3, 2, "Acme Pvt Ltd", "y"), (1, 8, 7, None, "z"), (1, 6, 7, "Third", "u")], "ws int, contract_id long, customer_id long, customer_name string, fact string")
    keyed = lambda rows: rows.withColumn("name_key", names.normalize_name(F.col("customer_name")))
    want = contracts.contract_of_invoice(keyed(inv), keyed(con)).join(con.select("ws", "contract_id", "fact"), ["ws", "contract_id"], "left")
    got = contracts.of_parties(inv, contracts.contract_of_party(inv, con))
    columns = ["invoice_id", "ws", "customer_id", "customer_name", "contract_id", "fact"]
    assert set(got.columns) == set(columns) and sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert {r["contract_id"] for r in got.collect()} == {5, 3, 6, 8, None}
