"""The reads of a workspace over hand-sized tables of two workspaces, with the expected rows as literals in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyspark.operators import quality
from tallyspark.operators.workspace import Workspace
from cases_golden import values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SCHEMAS = {
    "entities": "ws int, entity_id string, canonical_name string, confidence double",
    "matches": "ws int, match_id int, left_id int, right_id int, left_label string, right_label string, score double, decision string, decided_by string, critic_note string",
    "memory": "ws int, a int, b int, verdict string",
    "contracts": "ws int, contract_id int, document_name string, unknown_fields array<string>",
    "citations": "ws int, contract_id int, field_name string, page int, verified boolean",
    "invoices": "ws int, invoice_id int, total long",
    "payments": "ws int, payment_id int, amount long",
    "allocations": "ws int, invoice_id int, payment_id int, amount long, method string",
    "claims": "ws int, payment_id int, bank_id int",
    "refunds": "ws int, payment_id int, refund_id int",
    "items": "ws int, item_id int, customer_id int, contract_id int, invoice_id int, state string, gross long, recognised long, refunded long, retained long",
    "judgements": "ws int, item_id int, verdict string, is_published boolean",
    "anomalies": "ws int, anomaly_id int, rule string, severity string, status string",
    "review_items": "ws int, item_id int, category string, title string, question_key string, severity string, status string, created_on string, resolution string, reason string",
    "versions": "ws int, version int, published long",
    "raw_records": "ws int, record_id int, source_system string, record_type string, source_id string, version int, superseded_by int, created_at int",
    "quarantined": "ws int, record_id int, source_system string, reason string, created_at int, resolved_at int",
    "edges": "ws int, u string, v string",
}
ROWS = {
    "entities": [(1, "e2", "Beta", 0.9), (1, "e1", "Alpha", None), (1, "e3", "Beta", None), (2, "e9", "Aaa", None)],
    "matches": [
        (1, 1, 10, 11, "A", "B", 0.5, "REVIEW", "rules", None), (1, 2, 12, 13, "C", "D", 0.9, "ACCEPTED", "rules", None), (1, 3, 14, 15, "E", "F", 0.5, "REJECTED", "rules", None),
        (2, 1, 10, 11, "A", "B", 0.7, "REVIEW", "rules", None),
    ],
    "memory": [(1, 10, 11, "REJECTED"), (2, 10, 11, "REJECTED")],
    "contracts": [(1, 1, "b.pdf", ["terms_not_yet_extracted"]), (1, 2, "a.pdf", ["end_date"]), (2, 3, "c.pdf", ["terms_not_yet_extracted"])],
    "citations": [(1, 2, "term", 3, False), (1, 2, "amount", 1, True), (1, 1, "amount", 1, True), (2, 2, "amount", 9, True)],
    "invoices": [(1, 1, 1000), (1, 2, 500), (2, 3, 700)],
    "payments": [(1, 1, 600), (1, 2, 400), (2, 3, 1)],
    "allocations": [(1, 1, 1, 600, "exact_reference"), (1, 1, 2, 400, "exact_amount")],
    "claims": [(1, 2, 7)],
    "refunds": [(1, 1, 70)],
    "items": [
        (1, 1, 5, 1, 1, "VERIFIED_RECURRING", 1000, 900, 0, 1000), (1, 2, 5, 1, 2, "INVOICED_UNPAID", 500, 0, 0, 0), (1, 3, 6, 2, None, "VERIFIED_ONE_TIME", 300, 900, 0, 300),
        (1, 4, 6, None, None, "REFUNDED_OR_REVERSED", 200, 0, 150, 0), (2, 5, 7, None, 3, "INVOICED_UNPAID", 700, 0, 0, 0),
    ],
    "judgements": [(1, 1, "APPROVED", True), (1, 2, "APPROVED", False), (1, 3, "DISPUTED", False), (1, 4, "MORE_EVIDENCE_REQUIRED", False)],
    "anomalies": [(1, 1, "A09", "LOW", "OPEN"), (1, 2, "A02", "HIGH", "CONFIRMED"), (1, 3, "A01", "HIGH", "DISMISSED"), (1, 4, "A02", "HIGH", "CONFIRMED"), (2, 5, "A01", "HIGH", "OPEN")],
    "review_items": [
        (1, 1, "ambiguous_match", "A ↔ B", "q1", "MEDIUM", "OPEN", "2026-01-05", None, None), (1, 2, "ambiguous_match", "B ↔ A", "q1", "MEDIUM", "OPEN", "2026-01-02", None, None),
        (1, 3, "anomaly", "spike", "q2", "HIGH", "OPEN", "2026-01-09", None, None), (1, 4, "anomaly", "spike", "q3", "HIGH", "IN_PROGRESS", "2026-01-01", None, None),
        (1, 5, "contract", "term", "q4", "LOW", "RESOLVED", "2025-12-01", "accept", "read"), (2, 6, "ambiguous_match", "A ↔ B", "q1", "HIGH", "OPEN", "2025-01-01", None, None),
    ],
    "versions": [(1, 1, 500), (1, 2, 900)],
    "raw_records": [
        (1, 1, "bank", "payment", "p1", 1, 2, 10), (1, 2, "bank", "payment", "p1", 2, None, 20), (1, 3, "books", "invoice", "i1", 1, None, 30), (1, 4, "books", "invoice", "i2", 3, None, 30),
        (1, 5, "books", "invoice", "i2", 2, 4, 25), (2, 6, "bank", "payment", "p1", 2, None, 99),
    ],
    "quarantined": [(1, 1, "bank", "bad_date", 5, None), (1, 2, "bank", "schema", 6, None), (1, 3, "books", "schema", 7, 8), (1, 4, "books", "schema", 6, None), (2, 5, "bank", "schema", 9, None)],
    "edges": [(1, "customer:1", "domain:x"), (1, "customer:2", "domain:x"), (1, "customer:2", "account:9"), (1, "account:9", "customer:3"), (2, "customer:1", "customer:8")],
}


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    made = {name: spark.createDataFrame(ROWS[name], schema) for name, schema in SCHEMAS.items()}
    made["review_items"] = made["review_items"].withColumn("created_on", F.to_date("created_on"))
    return made


def read(name: str, columns: str, expected: list[tuple]):
    """Register a function of workspace 1."""

    def put(f):
        QUERIES[name] = lambda spark, folder: f(Workspace(1, tables(spark)))
        ORACLES[name] = values(columns, expected)
        return f

    return put


def placed(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns, and each row's place in the order that the read gives; for hand-sized results."""
    return rows.select(F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("place"), *columns)


@read("api_customers", "place, entity_id", [(1, "e1"), (2, "e2"), (3, "e3")])
def customers(w):
    return placed(w.customers(), "entity_id")


@read("api_matches", "place, match_id", [(1, 2), (2, 1)])
def matches(w):
    return placed(w.matches(limit=2), "match_id")


@read("api_match_counts", "decision, n", [("ACCEPTED", 1), ("REJECTED", 1), ("REVIEW", 1)])
def match_counts(w):
    return w.match_counts()


@read("api_decide_match", "ws, match_id, decision, decided_by", [(1, 1, "ACCEPTED", "human"), (1, 2, "ACCEPTED", "rules"), (1, 3, "REJECTED", "rules"), (2, 1, "REVIEW", "rules")])
def decide(w):
    return w.decide(1, "ACCEPTED", "same tax id")["matches"].select("ws", "match_id", "decision", "decided_by")


@read("api_decide_memory", "ws, a, b, verdict", [(1, 10, 11, "ACCEPTED"), (2, 10, 11, "REJECTED")])
def decide_memory(w):
    return w.decide(1, "ACCEPTED", "same tax id")["memory"].select("ws", "a", "b", "verdict")


@read("api_decide_review", "item_id, status, resolution", [(1, "RESOLVED", "ACCEPTED"), (2, "OPEN", None), (3, "OPEN", None), (4, "IN_PROGRESS", None), (5, "RESOLVED", "accept"), (6, "OPEN", None)])
def decide_review(w):
    return w.decide(1, "ACCEPTED", "same tax id")["review_items"].select("item_id", "status", "resolution")


@read("api_neighbourhood", "near, distance", [("domain:x", 1), ("customer:2", 2)])
def neighbourhood(w):
    return w.neighbourhood("customer:1", 2)


@read("api_relationships", "place, node, near, distance", [(1, "customer:1", "customer:2", 2), (2, "customer:2", "customer:3", 2), (3, "customer:1", "customer:3", 4)])
def relationships(w):
    return placed(w.relationships(4), "node", "near", "distance")


@read("api_contracts", "place, document_name", [(1, "a.pdf"), (2, "b.pdf")])
def contract_list(w):
    return placed(w.contracts(), "document_name")


@read("api_citations", "place, field_name, verified", [(1, "amount", True), (2, "term", False)])
def citation_list(w):
    return placed(w.citations(2), "field_name", "verified")


@read("api_allocations", "place, payment_id, amount", [(1, 1, 600), (2, 2, 400)])
def allocation_list(w):
    return placed(w.allocations(), "payment_id", "amount")


@read("api_reconciliation", "invoice_id, active, banked", [(1, 1000, 400), (2, 0, 0)])
def reconciliation(w):
    return w.reconciliation().select("invoice_id", "active", "banked")


@read("api_revenue_summary", "state, amount, n", [("VERIFIED_RECURRING", 900, 1), ("VERIFIED_ONE_TIME", 900, 1), ("INVOICED_UNPAID", 500, 1), ("REFUNDED_OR_REVERSED", 150, 1)])
def revenue_summary(w):
    return w.revenue_summary().select("state", "amount", "n")


@read("api_revenue_items", "place, item_id", [(1, 1), (2, 3), (3, 2), (4, 4)])
def revenue_items(w):
    return placed(w.revenue_items(), "item_id")


@read("api_anomalies", "place, anomaly_id", [(1, 3), (2, 2), (3, 4), (4, 1)])
def anomaly_list(w):
    return placed(w.anomalies(), "anomaly_id")


@read("api_precision", "rule, confirmed, labelled, precision", [("A01", 0, 1, 0.0), ("A02", 2, 2, 1.0), ("A09", 0, 0, None)])
def precision(w):
    return w.precision().select("rule", "confirmed", "labelled", "precision")


@read("api_feedback", "anomaly_id, status", [(1, "DISMISSED"), (2, "CONFIRMED"), (3, "DISMISSED"), (4, "CONFIRMED"), (5, "OPEN")])
def feedback(w):
    return w.feedback(1, is_false_positive=True).select("anomaly_id", "status")


@read("api_critic", "place, item_id, verdict", [(1, 3, "DISPUTED"), (2, 4, "MORE_EVIDENCE_REQUIRED"), (3, 1, "APPROVED"), (4, 2, "APPROVED")])
def critic(w):
    return placed(w.critic(), "item_id", "verdict")


@read("api_review", "place, item_id, members", [(1, 3, 1), (2, 2, 2)])
def review_list(w):
    return placed(w.review(), "item_id", "members")


@read("api_review_summary", "open, in_progress, resolved, dismissed, oldest_open_days, open_decisions", [(3, 1, 1, 0, 10, 3)])
def review_summary(w):
    return w.review_summary(F.lit("2026-01-12").cast("date"))


@read("api_review_waiting", "category, n", [("ambiguous_match", 2), ("anomaly", 2)])
def review_waiting(w):
    return w.waiting("category")


@read("api_position", "published, withheld, n_published, n_withheld", [(900, 900, 1, 1)])
def position(w):
    return w.position().select("published", "withheld", "n_published", "n_withheld")


@read("api_trace", "item_id, payments, banks, refunds, breaks", [(1, "1,2", "7", "70", "")])
def trace(w):
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return w.trace(1).select("item_id", *map(shown, ("payments", "banks", "refunds", "breaks")))


@read("api_versions", "place, version", [(1, 2), (2, 1)])
def version_list(w):
    return placed(w.versions(), "version")


@read("api_changes", "place, record_id", [(1, 4), (2, 2)])
def changes(w):
    return placed(w.changes(F.lit(15)), "record_id")


@read("api_evidence", "place, record_id", [(1, 3), (2, 4)])
def evidence(w):
    return placed(w.evidence("invoice", limit=2), "record_id")


@read("api_evidence_counts", "record_type, source_system, n", [("payment", "bank", 1), ("invoice", "books", 2)])
def evidence_counts(w):
    return w.evidence_counts()


@read("api_lineage", "place, record_id, version, superseded", [(1, 5, 2, True), (2, 4, 3, False)])
def lineage(w):
    return placed(w.lineage("i2"), "record_id", "version", "superseded")


@read("api_quarantine", "place, record_id", [(1, 2), (2, 4), (3, 1)])
def quarantine(w):
    return placed(w.quarantine(), "record_id")


@read("api_quarantine_counts", "source_system, n", [("bank", 2), ("books", 1)])
def quarantine_counts(w):
    return w.quarantine_counts("source_system")


def trail(w, forged: int | None = None) -> DataFrame:
    """Four audited actions, hashed one after the other; the hash of one may be forged."""
    spark, log, last = next(iter(w.tables.values())).sparkSession, [], None
    for k in range(1, 5):
        made = spark.range(1).select(quality.chained_hash(F.lit(last).cast("string"), F.lit(k), F.lit(f"act {k}"))).first()[0]
        last = made if k != forged else "0" * 64
        log.append((1, k, f"act {k}", last))
    return spark.createDataFrame(log, "ws int, sequence int, action string, event_hash string")


@read("api_audit", "place, sequence", [(1, 4), (2, 3)])
def audit(w):
    return placed(Workspace(1, w.tables | {"audit": trail(w)}).audit(limit=2), "sequence")


@read("api_audit_integrity", "broken_at, reason", [(3, "hash_mismatch")])
def audit_integrity(w):
    log = trail(w, forged=3).withColumn("number", F.col("sequence"))
    return Workspace(1, w.tables | {"audit": log}).audit_integrity(["number", "action"]).select("broken_at", "reason")


@read("api_summary", "name, n", [
    ("raw_records", 5), ("entities", 3), ("contracts", 2), ("invoices", 2), ("payments", 2), ("refunds", 1), ("allocations", 2), ("items", 4), ("anomalies", 4), ("judgements", 4), ("versions", 2),
    ("open_review_items", 4), ("quarantined_records", 3),
])
def summary(w):
    return w.summary()


@read("pip2_stages_done", "stage", [("identity",), ("contracts",), ("reconciliation",), ("revenue",), ("anomaly",), ("review",), ("publish",)])
def stages_done(w):
    return next(iter(w.tables.values())).sparkSession.createDataFrame([(s,) for s in sorted(w.done())], "stage string")
