"""The reads and decisions of a reviewer over one workspace of the adapters' tables, and the identity service's collection and application; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import texts
from ..operators import exports, identity, order, revenue, review
from ..operators.workspace import UNREAD, Workspace
from ..sources.shared import staged
from . import queries_cash as cash
from .adapters import Tables, oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WS = 1


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


SEVERITY, STATUS = ("HIGH", "MEDIUM", "LOW", "INFO"), ("OPEN", "CONFIRMED", "DISMISSED")
CATEGORY, PROGRESS = ("ambiguous_match", "anomaly", "contract"), ("OPEN", "IN_PROGRESS", "RESOLVED", "DISMISSED", "OPEN")
REASONS = ("bad_date", "schema", "missing_field")

TABLES = (
    "entities AS (SELECT ws, 'e' || customer_id AS entity_id, name AS canonical_name, CASE WHEN customer_id % 3 = 0 THEN 0.9 END AS confidence FROM customers)",
    """matches AS (SELECT *, CASE WHEN points >= 80 THEN 'ACCEPTED' WHEN points >= 40 THEN 'REVIEW' ELSE 'REJECTED' END AS decision FROM (
 SELECT a.ws, a.customer_id * 20 + b.customer_id - a.customer_id AS match_id, a.customer_id AS left_id, b.customer_id AS right_id, a.name AS left_label, b.name AS right_label, (a.customer_id * 7 + b.customer_id) % 100 AS points
 FROM customers a JOIN customers b ON a.ws = b.ws AND a.customer_id < b.customer_id AND a.customer_id // 12 = b.customer_id // 12))""",
    f"read_contracts AS (SELECT *, 'c' || contract_id || '.pdf' AS document_name, CASE WHEN contract_id % 6 = 0 THEN '{UNREAD}' ELSE 'end_date' END AS unknown FROM contracts)",
    "citations AS (SELECT ws, contract_id, f.name AS field_name, (contract_id + f.i) % 9 AS page, (contract_id + f.i) % 5 != 0 AS verified FROM contracts, (VALUES (0, 'amount'), (1, 'end_date'), (2, 'term')) f(i, name))",
    "anomalies AS (SELECT ws, refund_id AS anomaly_id, ['A01', 'A02', 'A09'][refund_id % 3 + 1] AS rule, ['HIGH', 'MEDIUM', 'LOW', 'INFO'][refund_id % 4 + 1] AS severity, ['OPEN', 'CONFIRMED', 'DISMISSED'][refund_id // 2 % 3 + 1] AS status FROM refunds)",
    """review_items AS (SELECT ws, item_id, ['ambiguous_match', 'anomaly', 'contract'][k % 3 + 1] AS category, 'q' || (k % 40) AS question_key, ['HIGH', 'MEDIUM', 'LOW', 'INFO'][k % 4 + 1] AS severity, ['OPEN', 'IN_PROGRESS', 'RESOLVED', 'DISMISSED', 'OPEN'][k % 5 + 1] AS status, created_on,
 CASE WHEN k % 3 = 0 THEN m.left_label || ' ↔ ' || m.right_label END AS title FROM (SELECT ws, payment_id AS item_id, payment_id // 3 AS k, paid_on AS created_on, payment_id // 3 % 300 AS n FROM payments WHERE payment_id % 3 = 0) p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY match_id) - 1 AS n FROM matches) m USING (ws, n))""",
    "versions AS (SELECT ws, CAST(year(issue_date) - 1991 AS INTEGER) AS version, CAST(sum(total) AS BIGINT) AS published FROM invoices GROUP BY ALL)",
    """raw_records AS (SELECT CAST(user_id % 4 AS INTEGER) AS ws, event_id AS record_id, 'sys' || (event_id % 3) AS source_system, event_type AS record_type, 's' || user_id AS source_id, row_number() OVER w AS version, lead(event_id) OVER w AS superseded_by, event_id AS created_at
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""",
    "quarantined AS (SELECT CAST(user_id % 4 AS INTEGER) AS ws, event_id AS record_id, 'sys' || (event_id % 3) AS source_system, ['bad_date', 'schema', 'missing_field'][event_id % 3 + 1] AS reason, event_id AS created_at, CASE WHEN event_id % 5 = 0 THEN event_id + 1 END AS resolved_at FROM events WHERE event_id % 7 = 0)",
    "edges AS (SELECT ws, 'customer:' || customer_id AS u, 'domain:' || (customer_id // 12) AS v FROM customers UNION ALL SELECT ws, 'customer:' || customer_id, 'account:' || ((customer_id + 4) // 12) FROM customers)",
)


class Canonical:
    """The tables by name, each built when it is asked for."""

    def __init__(self, t: Tables):
        self.t = t

    def __contains__(self, name: str) -> bool:
        return hasattr(self, name)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def entities(self) -> DataFrame:
        k = F.col("customer_id")
        return self.t.customers().select("ws", F.concat(F.lit("e"), k).alias("entity_id"), F.col("name").alias("canonical_name"), F.when(k % 3 == 0, 0.9).alias("confidence"))

    def matches(self) -> DataFrame:
        c = self.t.customers().select("ws", "customer_id", "name", F.floor(F.col("customer_id") / 12).alias("g"))
        a, b = (c.select("ws", "g", F.col("customer_id").alias(f"{s}_id"), F.col("name").alias(f"{s}_label")) for s in ("left", "right"))
        points = (F.col("left_id") * 7 + F.col("right_id")) % 100
        return a.join(b, ["ws", "g"]).where("left_id < right_id").select(
            "ws", (F.col("left_id") * 19 + F.col("right_id")).alias("match_id"), "left_id", "right_id", "left_label", "right_label", (points / 100).alias("score"),
            F.when(points >= 80, "ACCEPTED").when(points >= 40, "REVIEW").otherwise("REJECTED").alias("decision"), F.lit("rules").alias("decided_by"), F.lit(None).cast("string").alias("critic_note"),
        )

    def memory(self) -> DataFrame:
        return self.matches().where("match_id % 4 = 0").select("ws", F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.lit("REJECTED").alias("verdict"))

    def contracts(self) -> DataFrame:
        k = F.col("contract_id")
        return self.t.contracts().withColumns({"document_name": F.concat(F.lit("c"), k, F.lit(".pdf")), "unknown_fields": F.array(F.when(k % 6 == 0, UNREAD).otherwise("end_date"))})

    def citations(self) -> DataFrame:
        each = self.t.contracts().select("ws", "contract_id", F.posexplode(F.array(*map(F.lit, ("amount", "end_date", "term")))).alias("i", "field_name"))
        n = F.col("contract_id") + F.col("i")
        return each.select("ws", "contract_id", "field_name", (n % 9).alias("page"), (n % 5 != 0).alias("verified"))

    def invoices(self) -> DataFrame:
        return self.t.invoices()

    def payments(self) -> DataFrame:
        return self.t.payments()

    def refunds(self) -> DataFrame:
        return self.t.refunds()

    def bank(self) -> DataFrame:
        return self.t.bank()

    def allocations(self) -> DataFrame:
        return self.t.allocations()

    def claims(self) -> DataFrame:
        return cash._claims(self.t)

    def items(self) -> DataFrame:
        return cash._classified(self.t)

    def judgements(self) -> DataFrame:
        return cash._judged(self.t).select("ws", "item_id", "verdict", "is_published")

    def anomalies(self) -> DataFrame:
        k = F.col("refund_id")
        return self.t.refunds().select("ws", k.alias("anomaly_id"), pick(("A01", "A02", "A09"), k % 3).alias("rule"), pick(SEVERITY, k % 4).alias("severity"), pick(STATUS, F.floor(k / 2) % 3).alias("status"))

    def review_items(self) -> DataFrame:
        k = F.floor(F.col("item_id") / 3)
        titles = order.numbered(self.matches().select("ws", "match_id", F.concat("left_label", F.lit(" ↔ "), "right_label").alias("title")), [F.col("ws"), F.col("match_id")], ["ws"], "n").select("ws", (F.col("n") - 1).alias("n"), "title")
        rows = self.t.payments().where("payment_id % 3 = 0").select("ws", F.col("payment_id").alias("item_id"), F.col("paid_on").alias("created_on")).withColumn("n", k % 300).join(titles, ["ws", "n"], "left")
        return rows.select(
            "ws", "item_id", pick(CATEGORY, k % 3).alias("category"), F.when(k % 3 == 0, F.col("title")).alias("title"), F.concat(F.lit("q"), k % 40).alias("question_key"), pick(SEVERITY, k % 4).alias("severity"), pick(PROGRESS, k % 5).alias("status"), "created_on",
            F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("string").alias("reason"),
        )

    def versions(self) -> DataFrame:
        return self.t.invoices().groupBy("ws", (F.year("issue_date") - 1991).alias("version")).agg(F.sum("total").alias("published"))

    def _events(self) -> DataFrame:
        return self.t.raw("events").select((F.col("user_id") % 4).cast("int").alias("ws"), F.col("event_id").alias("record_id"), F.concat(F.lit("sys"), F.col("event_id") % 3).alias("source_system"), F.col("event_type").alias("record_type"), F.concat(F.lit("s"), F.col("user_id")).alias("source_id"), F.col("event_id").alias("created_at"))

    def raw_records(self) -> DataFrame:
        w = Window.partitionBy("source_id").orderBy("record_id")
        return self._events().withColumns({"version": F.row_number().over(w), "superseded_by": F.lead("record_id").over(w)})

    def quarantined(self) -> DataFrame:
        k = F.col("record_id")
        return self._events().where(k % 7 == 0).withColumns({"reason": pick(REASONS, k % 3), "resolved_at": F.when(k % 5 == 0, k + 1)})

    def edges(self) -> DataFrame:
        k = F.col("customer_id")
        one = lambda kind, shift: self.t.customers().select("ws", F.concat(F.lit("customer:"), k).alias("u"), F.concat(F.lit(f"{kind}:"), F.floor((k + shift) / 12)).alias("v"))
        return one("domain", 0).unionByName(one("account", 4))


def read(name: str, sql: str, *ctes: str):
    """Register a function of a reviewer's workspace under a name, with the SQL of its result."""

    def put(f):
        QUERIES[name] = lambda spark, folder: f(Workspace(WS, Canonical(Tables(spark, folder))))
        ORACLES[name] = oracle(sql, *ctes, *TABLES)
        return f

    return put


MINE = f"ws = {WS}"
RANK = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END"


@read("api_customers", f"SELECT entity_id, canonical_name FROM entities WHERE {MINE}")
def customers(w):
    return w.customers().select("entity_id", "canonical_name")


@read("api_matches", f"SELECT match_id, decision FROM matches WHERE {MINE} AND decision = 'REVIEW' ORDER BY points DESC, match_id LIMIT 100")
def matches(w):
    return w.matches("review").select("match_id", "decision")


@read("api_match_counts", f"SELECT decision, count(*) AS n FROM matches WHERE {MINE} GROUP BY ALL")
def match_counts(w):
    return w.match_counts()


def _decided(w) -> dict[str, DataFrame]:
    """The decision on the link with the lowest number."""
    first = w.of("matches").agg(F.min("match_id")).first()[0]
    return w.decide(first, "ACCEPTED", "same tax id")


@read("api_decide_match", f"SELECT ws, match_id, CASE WHEN {MINE} AND match_id = (SELECT min(match_id) FROM matches WHERE {MINE}) THEN 'ACCEPTED' ELSE decision END AS decision, CASE WHEN {MINE} AND match_id = (SELECT min(match_id) FROM matches WHERE {MINE}) THEN 'human' ELSE 'rules' END AS decided_by FROM matches")
def decide_match(w):
    return _decided(w)["matches"].select("ws", "match_id", "decision", "decided_by")


@read("api_decide_memory", f"SELECT ws, a, b, arg_max(verdict, new) AS verdict FROM (SELECT ws, left_id AS a, right_id AS b, 'REJECTED' AS verdict, 0 AS new FROM matches WHERE match_id % 4 = 0 UNION ALL SELECT ws, left_id, right_id, 'ACCEPTED', 1 FROM matches WHERE {MINE} AND match_id = (SELECT min(match_id) FROM matches WHERE {MINE})) GROUP BY ALL")
def decide_memory(w):
    return _decided(w)["memory"].select("ws", "a", "b", "verdict")


@read("api_decide_review", f"""SELECT ws, item_id, CASE WHEN hit THEN 'RESOLVED' ELSE status END AS status, CASE WHEN hit THEN 'ACCEPTED' END AS resolution FROM (
 SELECT *, coalesce({MINE} AND category = 'ambiguous_match' AND status = 'OPEN' AND title = (SELECT left_label || ' ↔ ' || right_label FROM matches WHERE {MINE} AND match_id = (SELECT min(match_id) FROM matches WHERE {MINE})), false) AS hit FROM review_items)""")
def decide_review(w):
    return _decided(w)["review_items"].select("ws", "item_id", "status", "resolution")


REACH = """both_e AS (SELECT u, v FROM edges WHERE {mine} UNION SELECT v, u FROM edges WHERE {mine}),
near AS (WITH RECURSIVE w(node, near, d) AS (SELECT u, v, 1 FROM both_e WHERE u LIKE 'customer:%' UNION SELECT w.node, b.v, d + 1 FROM w JOIN both_e b ON w.near = b.u WHERE d < 4) SELECT node, near, min(d) AS distance FROM w WHERE node != near GROUP BY ALL)""".format(mine=MINE)


def read_graph(name: str, sql: str):
    def put(f):
        QUERIES[name] = lambda spark, folder: f(Workspace(WS, Canonical(Tables(spark, folder))))
        ORACLES[name] = oracle(sql, *TABLES, REACH)
        return f

    return put


@read_graph("api_neighbourhood", "SELECT near, distance FROM near WHERE node = 'customer:1' AND distance <= 3")
def neighbourhood(w):
    return w.neighbourhood("customer:1", 3)


@read_graph("api_relationships", "SELECT node, near, distance FROM near WHERE node < near AND near LIKE 'customer:%'")
def relationships(w):
    return w.relationships(4)


@read("api_contracts", f"SELECT contract_id, document_name, unknown FROM read_contracts WHERE {MINE}")
def contract_list(w):
    return w.contracts().select("contract_id", "document_name", F.col("unknown_fields")[0].alias("unknown"))


@read("api_citations", f"SELECT field_name, page, verified FROM citations WHERE {MINE} AND contract_id = (SELECT min(contract_id) FROM contracts WHERE {MINE})")
def citation_list(w):
    return w.citations(w.of("contracts").agg(F.min("contract_id")).first()[0]).select("field_name", "page", "verified")


@read("api_allocations", f"SELECT invoice_id, payment_id, amount FROM allocations WHERE {MINE}")
def allocation_list(w):
    return w.allocations().select("invoice_id", "payment_id", "amount")


@read("api_reconciliation", f"SELECT i.invoice_id, coalesce(CAST(sum(a.amount) AS BIGINT), 0) AS active, coalesce(CAST(sum(CASE WHEN b.payment_id IS NOT NULL THEN a.amount ELSE 0 END) AS BIGINT), 0) AS banked FROM invoices i LEFT JOIN allocations a ON i.ws = a.ws AND i.invoice_id = a.invoice_id LEFT JOIN (SELECT DISTINCT ws, payment_id FROM claimed) b ON a.ws = b.ws AND a.payment_id = b.payment_id WHERE i.{MINE} GROUP BY ALL", cash.BANKED, cash.CLAIMED)
def reconciliation(w):
    return w.reconciliation().select("invoice_id", "active", "banked")


@read("api_revenue_summary", f"SELECT state, amount, n FROM state_totals WHERE {MINE}", *cash.FULL, cash.TOTALS)
def revenue_summary(w):
    return w.revenue_summary().select("state", "amount", "n")


@read("api_revenue_items", f"SELECT item_id, state, recognised FROM classified WHERE {MINE}", *cash.FULL)
def revenue_items(w):
    return w.revenue_items().select("item_id", "state", "recognised")


@read("api_anomalies", f"SELECT anomaly_id, rule, severity FROM anomalies WHERE {MINE}")
def anomaly_list(w):
    return w.anomalies().select("anomaly_id", "rule", "severity")


@read("api_precision", f"SELECT rule, count(*) FILTER (WHERE status = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE status != 'OPEN') AS labelled, round(count(*) FILTER (WHERE status = 'CONFIRMED') / nullif(count(*) FILTER (WHERE status != 'OPEN'), 0), 3) AS precision FROM anomalies WHERE {MINE} GROUP BY rule")
def precision(w):
    return w.precision().select("rule", "confirmed", "labelled", "precision")


@read("api_feedback", f"SELECT ws, anomaly_id, CASE WHEN {MINE} AND anomaly_id = (SELECT max(anomaly_id) FROM anomalies WHERE {MINE}) THEN 'DISMISSED' ELSE status END AS status FROM anomalies")
def feedback(w):
    return w.feedback(w.of("anomalies").agg(F.max("anomaly_id")).first()[0], is_false_positive=True).select("ws", "anomaly_id", "status")


@read("api_critic", f"SELECT item_id, verdict, recognised FROM judged WHERE {MINE}", *cash.JUDGE)
def critic(w):
    return w.critic().select("item_id", "verdict", "recognised")


@read("api_review", f"SELECT question_key, item_id, members, rank, since FROM (SELECT question_key, arg_min(item_id, ({RANK}, created_on, item_id)) AS item_id, count(*) AS members, min(({RANK}, created_on, item_id)) AS o, arg_min({RANK}, ({RANK}, created_on, item_id)) AS rank, arg_min(created_on, ({RANK}, created_on, item_id)) AS since FROM review_items WHERE {MINE} AND status = 'OPEN' GROUP BY question_key) ORDER BY o LIMIT 100")
def review_list(w):
    return w.review().select("question_key", "item_id", "members", "rank", "since")


@read("api_review_summary", f"SELECT count(*) FILTER (WHERE status = 'OPEN') AS open, count(*) FILTER (WHERE status = 'IN_PROGRESS') AS in_progress, count(*) FILTER (WHERE status = 'RESOLVED') AS resolved, count(*) FILTER (WHERE status = 'DISMISSED') AS dismissed, greatest(0, date_diff('day', min(created_on) FILTER (WHERE status = 'OPEN'), DATE '1999-01-01')) AS oldest_open_days, count(DISTINCT CASE WHEN status IN ('OPEN', 'IN_PROGRESS') THEN question_key END) AS open_decisions FROM review_items WHERE {MINE}")
def review_summary(w):
    return w.review_summary(F.lit("1999-01-01").cast("date"))


@read("api_review_waiting", f"SELECT category, count(*) AS n FROM review_items WHERE {MINE} AND status IN ('OPEN', 'IN_PROGRESS') GROUP BY ALL")
def review_waiting(w):
    return w.waiting("category")


@read("api_position", f"SELECT CAST(sum(CASE WHEN is_published THEN recognised ELSE 0 END) AS BIGINT) AS published, CAST(sum(CASE WHEN v AND NOT is_published THEN recognised ELSE 0 END) AS BIGINT) AS withheld, count(*) FILTER (WHERE is_published) AS n_published, count(*) FILTER (WHERE v AND NOT is_published) AS n_withheld FROM judged WHERE {MINE}", *cash.JUDGE)
def position(w):
    return w.position().select("published", "withheld", "n_published", "n_withheld")


@read("api_trace", f"SELECT i.item_id, (SELECT string_agg(payment_id, ',' ORDER BY payment_id) FROM allocations a WHERE a.ws = i.ws AND a.invoice_id = i.invoice_id) AS payments, i.contract_id FROM items i WHERE {MINE} AND item_id = (SELECT min(item_id) FROM items WHERE {MINE} AND allocated > 0)", *cash.FULL)
def trace(w):
    items = staged(w.of("items"), "items")
    first = items.where("allocated > 0").agg(F.min("item_id")).first()[0]
    tables = {"items": items} | {name: w.tables[name] for name in ("contracts", "invoices", "allocations", "claims", "refunds")}
    return Workspace(w.ws, tables).trace(first).select("item_id", F.array_join(F.array_sort("payments").cast("array<string>"), ",").alias("payments"), "contract_id")


@read("api_versions", f"SELECT version, published FROM versions WHERE {MINE}")
def version_list(w):
    return w.versions().select("version", "published")


@read("api_changes", f"SELECT record_id, version FROM raw_records WHERE {MINE} AND superseded_by IS NULL AND version > 1 AND created_at >= 50 ORDER BY created_at DESC, record_id LIMIT 200")
def changes(w):
    return w.changes(F.lit(50)).select("record_id", "version")


@read("api_evidence", f"SELECT record_id, source_id FROM raw_records WHERE {MINE} AND superseded_by IS NULL AND record_type = 'click' ORDER BY created_at DESC, record_id LIMIT 50")
def evidence(w):
    return w.evidence("click").select("record_id", "source_id")


@read("api_evidence_counts", f"SELECT record_type, source_system, count(*) AS n FROM raw_records WHERE {MINE} AND superseded_by IS NULL GROUP BY ALL")
def evidence_counts(w):
    return w.evidence_counts()


@read("api_lineage", f"SELECT record_id, version, superseded_by IS NOT NULL AS superseded FROM raw_records WHERE {MINE} AND source_id = (SELECT min(source_id) FROM raw_records WHERE {MINE})")
def lineage(w):
    return w.lineage(w.of("raw_records").agg(F.min("source_id")).first()[0]).select("record_id", "version", "superseded")


@read("api_quarantine", f"SELECT record_id, reason FROM quarantined WHERE {MINE} AND resolved_at IS NULL ORDER BY created_at DESC, record_id LIMIT 100")
def quarantine(w):
    return w.quarantine().select("record_id", "reason")


@read("api_quarantine_counts", f"SELECT reason, count(*) AS n FROM quarantined WHERE {MINE} AND resolved_at IS NULL GROUP BY ALL")
def quarantine_counts(w):
    return w.quarantine_counts()


COUNTS = ("raw_records", "entities", "contracts", "invoices", "payments", "refunds", "bank", "allocations", "items", "anomalies", "versions")


@read("api_summary", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n} WHERE {MINE}" for n in COUNTS) + f" UNION ALL SELECT 'judgements', count(*) FROM judged WHERE {MINE} UNION ALL SELECT 'open_review_items', count(*) FROM review_items WHERE {MINE} AND status IN ('OPEN', 'IN_PROGRESS') UNION ALL SELECT 'quarantined_records', count(*) FROM quarantined WHERE {MINE} AND resolved_at IS NULL", *cash.JUDGE)
def summary(w):
    return w.summary()


@read("pip2_stages_done", """SELECT CAST(ws AS INTEGER) AS ws, stage FROM (VALUES (0), (1), (2), (3)) x(ws), (VALUES ('identity'), ('contracts'), ('reconciliation'), ('revenue'), ('anomaly'), ('review'), ('publish')) s(stage) WHERE CASE stage
 WHEN 'identity' THEN EXISTS (SELECT 1 FROM entities e WHERE e.ws = x.ws AND confidence IS NOT NULL AND x.ws != 2) WHEN 'contracts' THEN EXISTS (SELECT 1 FROM read_contracts c WHERE c.ws = x.ws AND unknown = 'end_date' AND x.ws != 1)
 WHEN 'reconciliation' THEN EXISTS (SELECT 1 FROM allocations a WHERE a.ws = x.ws AND x.ws != 3) WHEN 'revenue' THEN EXISTS (SELECT 1 FROM items i WHERE i.ws = x.ws) WHEN 'anomaly' THEN EXISTS (SELECT 1 FROM anomalies a WHERE a.ws = x.ws AND severity = 'HIGH')
 WHEN 'review' THEN EXISTS (SELECT 1 FROM judged j WHERE j.ws = x.ws AND is_published) ELSE EXISTS (SELECT 1 FROM versions v WHERE v.ws = x.ws AND x.ws > 0) END""", *cash.JUDGE)
def stages_done(w):
    """Workspaces that stopped at different stages: their tables are cut down to what each stage left."""
    t = w.tables
    judged = staged(t["judgements"], "judgements")
    tables = {
        "entities": t["entities"].withColumn("confidence", F.when(F.col("ws") != 2, F.col("confidence"))), "contracts": t["contracts"].where(f"ws != 1 OR array_contains(unknown_fields, '{UNREAD}')"), "payments": t["payments"],
        "allocations": t["allocations"].where("ws != 3"), "items": judged, "anomalies": t["anomalies"].where("severity = 'HIGH'"), "judgements": judged.where("is_published"), "versions": t["versions"].where("ws > 0"),
    }
    return t.t.spark.createDataFrame([(ws, s) for ws in range(4) for s in sorted(Workspace(ws, tables).done())], "ws int, stage string")


# --- identity service, JSON, slugs -------------------------------------------------------------------------------------------------------------------------------


def query(name: str, sql: str, *ctes: str):
    def put(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        ORACLES[name] = oracle(sql, *ctes)
        return f

    return put


@query("idn6_collected_records", """
SELECT ws, 'contact:c' || customer_id AS id, CASE WHEN customer_id % 20 = 0 THEN 'c' || customer_id WHEN customer_id % 10 = 0 THEN 'Co ' || customer_id ELSE name END AS name FROM customers WHERE customer_id % 2 = 0
UNION ALL SELECT ws, 'crm:h' || customer_id, name FROM customers WHERE customer_id % 3 = 0 AND customer_id % 9 != 0
UNION ALL SELECT ws, 'contract:' || contract_id, CASE WHEN contract_id % 4 = 0 THEN 'Northstar' ELSE customer_name END FROM contracts WHERE contract_id % 4 != 0 OR contract_id % 8 = 0
UNION ALL SELECT ws, 'payment:' || payment_id, customer_name FROM (SELECT *, row_number() OVER (PARTITION BY ws, lower(customer_name) ORDER BY source_id, payment_id) AS n FROM payments) WHERE n = 1
UNION ALL SELECT ws, 'bank:' || bank_id, counterparty FROM (SELECT *, row_number() OVER (PARTITION BY ws, lower(counterparty) ORDER BY 'b' || bank_id, bank_id) AS n FROM bank WHERE counterparty IS NOT NULL AND direction = 'credit') WHERE n = 1""")
def idn6(t):
    """Money that goes out goes to payrolls, which nobody else names."""
    k, none = F.col("customer_id"), F.lit(None).cast("string")
    contacts = t.customers().where(k % 2 == 0).select("ws", F.concat(F.lit("c"), k).alias("source_id"), F.when(k % 10 == 0, " ").otherwise(F.col("name")).alias("contact_name"), F.when(k % 20 != 0, F.concat(F.lit("Co "), k)).alias("company_name"), *(none.alias(c) for c in ("email", "phone", "gst_no", "address", "website")))
    crm = t.customers().where(k % 3 == 0).select("ws", F.concat(F.lit("h"), k).alias("source_id"), F.when(k % 9 != 0, F.col("name")).alias("name"), none.alias("domain"), none.alias("city"))
    c = F.col("contract_id")
    contracts = t.contracts().select("ws", "contract_id", F.lit("Northstar_Subscription_FY2025.pdf").alias("document_name"), F.when(c % 4 != 0, F.col("customer_name")).alias("customer_name"), (c % 8 == 0).alias("terms_read"))
    payments = t.payments().select("ws", "payment_id", "source_id", "customer_name", none.alias("email"), none.alias("phone"))
    payroll = F.when(F.col("direction") == "debit", F.concat(F.lit("Payroll "), F.col("bank_id") % 7)).otherwise(F.col("counterparty"))
    bank = t.bank().select("ws", "bank_id", F.concat(F.lit("b"), F.col("bank_id")).alias("source_id"), payroll.alias("counterparty"), "direction")
    return identity.collected(contacts, crm, contracts, payments, bank).select("ws", "id", "name")


GROUPED = """grouped AS (SELECT CAST((customer_id // 2) % 4 AS INTEGER) AS ws, customer_id AS id, customer_id // 2 AS g, count(*) OVER (PARTITION BY customer_id // 2) AS members FROM customers WHERE customer_id >= 2)"""


@query("idn8_applied_clusters", """
SELECT ws, CASE WHEN g % 3 = 0 THEN 'a' || g ELSE 'new:' || id END AS entity_id, 'Omega' || g || ' Prime Ltd' AS name, CASE WHEN members = 2 AND g % 3 != 2 AND g % 10 != 0 THEN 'b' || g ELSE '' END AS moved_from FROM grouped WHERE id % 2 = 0
UNION ALL SELECT ws, 'b' || g, 'omega' || g, '' FROM grouped WHERE id % 2 = 1 AND g % 3 != 2 AND g % 10 = 0""", GROUPED)
def idn8(t):
    """Pairs of customers as clusters. Some have an entity already, most another one named like their second member, some of those confirmed by a human; a fifth have an orphan."""
    k, g = F.col("customer_id"), F.floor(F.col("customer_id") / 2)
    base = t.customers().where(k >= 2).select(k.alias("customer_id"), g.alias("g"), (g % 4).cast("int").alias("ws"))
    even, none = k % 2 == 0, F.lit(None).cast("string")
    name = F.concat(F.lit("Omega"), F.col("g"), F.when(even, " Prime Ltd").otherwise(""))
    recs = identity.records(base.select("ws", k.cast("string").alias("id"), name.alias("name"), *(none.alias(c) for c in ("email", "phone", "tax_id", "address"))))
    found = base.select("ws", k.cast("string").alias("id"), (F.col("g") * 2).cast("string").alias("cluster"))
    empty = F.array().cast("array<string>")

    def entity(rows: DataFrame, mark: str, called: Column, since: int, sure: Column) -> DataFrame:
        return rows.select("ws", F.concat(F.lit(mark), F.col("g")).alias("entity_id"), called.alias("name"), called.alias("normalized_name"), empty.alias("aliases"), empty.alias("domains"), empty.alias("tax_ids"), sure.alias("human_confirmed"), F.lit(since).alias("created_at"))

    low = F.concat(F.lit("omega"), F.col("g"))
    entities = entity(base.where(even & (F.col("g") % 3 == 0)), "a", F.concat(low, F.lit(" prime")), 2, F.lit(False))
    entities = entities.unionByName(entity(base.where(~even & (F.col("g") % 3 != 2)), "b", low, 1, F.col("g") % 10 == 0)).unionByName(entity(base.where(even & (F.col("g") % 5 == 0)), "z", F.concat(F.lit("nobody"), F.col("g")), 1, F.lit(False)))
    after, moves = identity.applied(recs, found, entities, entities.where("entity_id LIKE 'b%'").select("ws", "entity_id"))
    came = moves.groupBy("ws", F.col("to_id").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_list("from_id")), ",").alias("moved_from"))
    return after.join(came, ["ws", "entity_id"], "left").select("ws", "entity_id", "name", F.coalesce("moved_from", F.lit("")).alias("moved_from"))


@query("jsn1_canonical_json", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 != 0 THEN '{"a":{"c":[' || o_custkey || ',"' || o_orderstatus || '"],"d":null},"p":"' || o_orderpriority || '","z":' || o_orderkey || '}' END AS canonical FROM orders""")
def jsn1(t):
    """Orders as JSON with keys and spaces in another order; every ninth isn't JSON."""
    text = F.concat(F.lit('{ "z": '), F.col("o_orderkey"), F.lit(',\n "p" : "'), F.col("o_orderpriority"), F.lit('", "a": {"d": null, "c": [ '), F.col("o_custkey"), F.lit(', "'), F.col("o_orderstatus"), F.lit('" ]}'), F.when(F.col("o_orderkey") % 9 != 0, "}").otherwise(""))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), texts.canonical_json(text).alias("canonical"))


@query("prj18_redaction", """SELECT customer_id AS id, CASE WHEN customer_id % 11 != 0 THEN '{"a":[{"CVV":"<redacted>","x":' || customer_id || '}],' || CASE WHEN customer_id % 2 = 0 THEN '"card":"<redacted>",' ELSE '' END || '"name":"' || name || '","pan":"<redacted>"}' END AS shown FROM customers""")
def prj18(t):
    k = F.col("customer_id")
    card = F.when(k % 2 == 0, F.concat(F.lit(', "card": {"number": '), k, F.lit("}"))).otherwise("")
    text = F.concat(F.lit('{"pan": "ABCDE'), k, F.lit('", "name": "'), F.col("name"), F.lit('"'), card, F.lit(', "a": [{"x": '), k, F.lit(', "CVV": "1"}]'), F.when(k % 11 != 0, "}").otherwise(""))
    return t.customers().select(k.alias("id"), texts.redacted(text).alias("shown"))


@query("str19_slugs", "SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'workspace' ELSE replace(p_name, ' ', '-') || '-' || p_partkey END AS slug FROM part")
def str19(t):
    k = F.col("p_partkey")
    text = F.when(k % 26 == 0, F.lit(None)).when(k % 13 == 0, " -- !").otherwise(F.concat(F.lit(" /"), F.initcap("p_name"), F.lit(" & "), k, F.lit("!")))
    return t.raw("part").select(k.alias("id"), texts.slug(text).alias("slug"))


#: Pairs of customers of one dozen with weights and conflicts by fixed arithmetic: what follows from scores can be told in SQL, the scores can't.
PAIRS = """given AS (SELECT ws, l, r, weight, conflict, CASE WHEN weight >= 6 THEN 'ACCEPTED' WHEN weight >= 1.5 THEN 'REVIEW' ELSE 'REJECTED' END AS decision FROM (
 SELECT a.ws, a.customer_id AS l, b.customer_id AS r, ((a.customer_id * 7 + b.customer_id * 3) % 30 - 12) * 0.5 AS weight, (a.customer_id + b.customer_id) % 5 = 0 AS conflict FROM customers a JOIN customers b ON a.ws = b.ws AND a.customer_id < b.customer_id AND a.customer_id // 12 = b.customer_id // 12))"""


def _given(t: Tables) -> DataFrame:
    c = t.customers().select("ws", "customer_id", F.floor(F.col("customer_id") / 12).alias("g"))
    rows = c.withColumnRenamed("customer_id", "l").join(c.withColumnRenamed("customer_id", "r"), ["ws", "g"]).where("l < r")
    rows = rows.select("ws", "l", "r", (((F.col("l") * 7 + F.col("r") * 3) % 30 - 12) * 0.5).alias("weight"), ((F.col("l") + F.col("r")) % 5 == 0).alias("conflict"))
    return rows.withColumn("decision", identity.decision(F.col("weight")))


@query("idn3_given_pairs", "SELECT ws, l, r FROM given WHERE decision != 'ACCEPTED' AND conflict", PAIRS)
def idn3(t):
    return identity.cannot_link(_given(t))


@query("idn5_given_clusters", "SELECT ws, l, r, l // 24 * 24 AS cluster FROM given WHERE decision = 'REJECTED' AND conflict AND l // 24 = r // 24", PAIRS)
def idn5(t):
    """Clusters that nobody constrained: two dozens each."""
    found = t.customers().select("ws", F.col("customer_id").alias("id"), (F.floor(F.col("customer_id") / 24) * 24).alias("cluster"))
    return identity.transitivity_conflicts(_given(t), found)


@query("idn7_given_memory", "SELECT ws, l, r, CASE WHEN l % 3 = 0 THEN 'REJECTED' ELSE decision END AS decision FROM given", PAIRS)
def idn7(t):
    """A reviewer has refused every link of a third of the customers, told with the sides exchanged."""
    pairs = _given(t)
    memory = pairs.where("l % 3 = 0").select("ws", F.col("r").alias("a"), F.col("l").alias("b"), F.lit("REJECTED").alias("verdict"))
    return identity.overridden(pairs, memory).select("ws", "l", "r", "decision")


GIVEN_CLUSTERS = """linked AS (SELECT ws, l AS u, r AS v FROM given WHERE decision = 'ACCEPTED' UNION SELECT ws, r, l FROM given WHERE decision = 'ACCEPTED'),
reached AS (WITH RECURSIVE w(ws, u, v) AS (SELECT ws, u, u FROM linked UNION SELECT w.ws, w.u, k.v FROM w JOIN linked k ON w.ws = k.ws AND w.v = k.u) SELECT ws, u AS id, min(v) AS cluster FROM w GROUP BY ALL)"""


@query("idn4_uncontested_clusters", "SELECT * FROM reached", PAIRS, GIVEN_CLUSTERS)
def idn4(t):
    """Clusters of pairs none of which are in conflict: components of the accepted ones."""
    return identity.clusters(_given(t).withColumn("conflict", F.lit(False)))


# --- policies and artifacts --------------------------------------------------------------------------------------------------------------------------------------


@query("crt_bank_policy", "SELECT ws, item_id, verdict, v AND len(codes) = 0 AS is_published FROM judged", *cash.JUDGE)
def crt_bank(t):
    """The gate of a policy that wants a bank credit behind every published item."""
    return review.judged(cash._classified(t), require_bank=True).select("ws", "item_id", "verdict", "is_published")


RESOLVED = "CASE WHEN rule != 'R08' AND NOT customer_resolved THEN {0} ELSE {1} END"


@query("cls_resolved_policy", f"SELECT ws, item_id, {RESOLVED.format(chr(39) + 'HUMAN_REVIEW' + chr(39), 'state')} AS state, {RESOLVED.format(chr(39) + 'R09' + chr(39), 'rule')} AS rule, {RESOLVED.format('0', 'recognised')} AS recognised FROM classified", *cash.FULL)
def cls_resolved(t):
    """The states of a policy that wants every customer resolved."""
    return revenue.classified(cash._items(t), require_resolved=True).select("ws", "item_id", "state", "rule", "recognised")


def artifact(name: str, sql: str, *ctes: str):
    """Register a function of the canonical tables of all workspaces under a name, with its SQL."""

    def put(f):
        QUERIES[name] = lambda spark, folder: f(Canonical(Tables(spark, folder)))
        ORACLES[name] = oracle(sql, *ctes, *TABLES)
        return f

    return put


@artifact("snk3_anomalies_artifact", "SELECT ws, lower(severity) AS severity, CAST(CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS INTEGER) AS severity_rank, rule, 'finding ' || anomaly_id AS title, CASE WHEN anomaly_id % 2 = 0 THEN 'seen' ELSE '' END AS observed, status, CASE WHEN rule = 'A09' THEN format('{:.4f}', (anomaly_id % 100) / 100) ELSE '' END AS model_score FROM anomalies")
def anomalies_artifact(c):
    k, none = F.col("anomaly_id"), F.lit(None).cast("string")
    rows = c.anomalies().withColumns({"title": F.concat(F.lit("finding "), k), "observed": F.when(k % 2 == 0, "seen"), "baseline": none, "model_version": none, "model_score": F.when(F.col("rule") == "A09", (k % 100) / 100)})
    return exports.anomalies(rows).select("ws", "severity", "severity_rank", "rule", "title", "observed", "status", "model_score")


@artifact("snk3_review_queue_artifact", "SELECT ws, status, severity, category, question_key AS question, coalesce(title, '') AS detail, '' AS resolution, '' AS reason, CAST(created_on AS VARCHAR) AS raised_on, '' AS resolved_on FROM review_items")
def review_artifact(c):
    rows = c.review_items().withColumns({"question": F.col("question_key"), "detail": F.col("title"), "raised_on": F.col("created_on"), "resolved_on": F.lit(None).cast("date")})
    return exports.review_queue(rows)


@artifact("snk3_customers_artifact", "SELECT ws, canonical_name AS customer, canonical_name || '; ' || upper(canonical_name) AS also_known_as, CASE WHEN confidence IS NOT NULL THEN 'T' || entity_id ELSE '' END AS tax_identifiers, '' AS domains, CASE WHEN confidence IS NULL THEN '' ELSE '0.90' END AS match_confidence FROM entities")
def customers_artifact(c):
    none = F.lit(None).cast("array<string>")
    rows = c.entities().withColumns({"aliases": F.array("canonical_name", F.upper("canonical_name")), "tax_ids": F.array_compact(F.array(F.when(F.col("confidence").isNotNull(), F.concat(F.lit("T"), "entity_id")))), "domains": F.array().cast("array<string>"), "emails": none, "addresses": none})
    return exports.customers(rows).select("ws", "customer", "also_known_as", "tax_identifiers", "domains", "match_confidence")


AMOUNT = cash.EXACT


@query("snk3_summary_artifact", f"""
SELECT ws, m.measure, m.exact_value FROM (SELECT c.ws, unnest([
 {{'measure': 'Claimed revenue', 'exact_value': {AMOUNT.format('claimed')}}}, {{'measure': 'Proven by evidence', 'exact_value': {AMOUNT.format('published')}}}, {{'measure': 'Awaiting review', 'exact_value': {AMOUNT.format('withheld')}}},
 {{'measure': CASE WHEN claimed < published THEN 'Evidence beyond the claim' ELSE 'Claimed but not yet proven' END, 'exact_value': {AMOUNT.format('abs(claimed - published)')}}},
 {{'measure': 'Items published', 'exact_value': ''}}, {{'measure': 'Items withheld pending review', 'exact_value': ''}}]) AS m
 FROM (SELECT ws, CAST(sum(total) AS BIGINT) * ws // 2 AS claimed FROM invoices GROUP BY ws) c JOIN (
  SELECT ws, CAST(sum(CASE WHEN is_published THEN recognised ELSE 0 END) AS BIGINT) AS published, CAST(sum(CASE WHEN v AND NOT is_published THEN recognised ELSE 0 END) AS BIGINT) AS withheld FROM judged GROUP BY ws) p USING (ws))""", *cash.JUDGE)
def summary_artifact(t):
    claims = t.invoices().groupBy("ws").agg(F.sum("total").alias("s")).select("ws", F.expr("s * ws div 2").alias("claimed"))
    return exports.summary(review.position(cash._judged(t)), claims, F.lit("INR")).select("ws", "measure", "exact_value")


@artifact("rev1_claimed_items", "SELECT ws, item_id, CASE WHEN status = 'OPEN' AND item_id % 2 = 0 AND ws != 3 THEN 'IN_PROGRESS' ELSE status END AS status FROM review_items")
def claimed(c):
    """A reviewer takes up every second item, some of them twice; those of workspace 3 are asked for in another workspace."""
    items = staged(c.review_items(), "review-items")
    asked = items.where("item_id % 2 = 0").select(F.when(F.col("ws") == 3, 9).otherwise(F.col("ws")).cast("int").alias("ws"), "item_id")
    return review.claimed(items, asked.unionByName(asked)).select("ws", "item_id", "status")


@query("ver1_forced_versions", "SELECT ws, taken_at, row_number() OVER (PARTITION BY ws ORDER BY taken_at) AS version FROM (SELECT *, lag(x) OVER (PARTITION BY ws ORDER BY taken_at) AS p FROM (SELECT ws, CAST(strftime(issue_date, '%Y%m') AS INTEGER) AS taken_at, count(*) % 3 AS x FROM invoices GROUP BY ALL)) WHERE p IS NULL OR p != x OR taken_at % 100 = 12")
def forced(t):
    """December is published whether anything moved or not."""
    snaps = t.invoices().groupBy("ws", F.date_format("issue_date", "yyyyMM").cast("int").alias("taken_at")).agg((F.count("*") % 3).alias("x"))
    return review.published_versions(snaps, ["x"], F.col("taken_at") % 100 == 12).select("ws", "taken_at", "version")


@artifact("jn16_cited_chain", "SELECT i.ws, i.item_id, CASE WHEN i.contract_id IS NOT NULL THEN coalesce(n, 0) END AS citations_total, CASE WHEN i.contract_id IS NOT NULL THEN coalesce(v, 0) END AS citations_verified FROM items i LEFT JOIN (SELECT ws, contract_id, count(*) AS n, count(*) FILTER (WHERE verified) AS v FROM citations WHERE contract_id % 5 != 0 GROUP BY ALL) c ON i.ws = c.ws AND i.contract_id = c.contract_id", *cash.FULL)
def cited_chain(c):
    chain = review.trace(cash._items(c.t), c.contracts(), c.invoices(), c.allocations(), c.claims(), c.refunds())
    return review.cited(chain, c.citations().where("contract_id % 5 != 0")).select("ws", "item_id", "citations_total", "citations_verified")
