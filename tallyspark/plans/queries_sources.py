"""Queries over payload normalisers, sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import identity, order
from ..sources import bank_csv, connectors, documents, payloads, sinks
from ..sources.shared import shared_dir
from ..streaming import evidence
from . import queries_parties
from .adapters import Tables, oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a function of Tables under a name, with the SQL of its result."""

    def put(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return put


def _payload(rows: DataFrame, **fields) -> DataFrame:
    return rows.select(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("payload"))


@query("prj1_payment_payloads", "SELECT source_id, amount, CASE WHEN status = 'partially_refunded' THEN 'partially_refunded' ELSE status END AS status, amount_refunded, coalesce(reference, 'ord' || payment_id) AS reference, to_timestamp(payment_id * 1000) AS payment_time FROM payments")
def prj1(t):
    k = F.col("payment_id")
    rows = _payload(t.payments(), id=F.col("source_id"), amount=F.col("amount"), currency=F.lit("inr"), status=F.when(F.col("status") == "partially_refunded", "captured").otherwise(F.col("status")), order_id=F.concat(F.lit("ord"), k.cast("string")), amount_refunded=F.col("amount_refunded"), created_at=k * 1000, notes=F.struct(F.lit("x").alias("customer_name"), F.col("reference").alias("invoice_number")))
    return payloads.payments(rows).select("source_id", "amount", "status", "amount_refunded", "reference", "payment_time")


@query("prj2_refund_payloads", "SELECT 'r' || refund_id AS source_id, amount, false AS is_chargeback FROM refunds UNION ALL SELECT 'd' || refund_id, amount, true FROM refunds WHERE refund_id % 5 = 0")
def prj2(t):
    made = lambda p, df: _payload(df, id=F.concat(F.lit(p), F.col("refund_id").cast("string")), amount=F.col("amount"), created_at=F.lit(1).cast("bigint"))
    return payloads.refunds(made("r", t.refunds()), made("d", t.refunds().where("refund_id % 5 = 0"))).select("source_id", "amount", "is_chargeback")


@query("prj3_prj6_contact_payloads", "SELECT CAST(customer_id AS VARCHAR) AS source_id, CASE WHEN customer_id % 2 = 0 THEN name ELSE 'Contact' END AS name, CASE WHEN customer_id % 3 = 0 THEN 1 ELSE 0 END AS n_tax FROM customers")
def prj3(t):
    k = F.col("customer_id")
    rows = _payload(t.customers(), contact_id=k.cast("string"), contact_name=F.lit("Contact"), company_name=F.when(k % 2 == 0, F.col("name")).otherwise("  "), gst_no=F.when(k % 3 == 0, "27X"))
    return payloads.contacts(rows).select("source_id", "name", F.size("tax_ids").alias("n_tax"))


@query("prj4_invoice_payloads", "SELECT CAST(invoice_id AS VARCHAR) AS source_id, total, CASE WHEN status = 'paid' AND invoice_id % 3 = 0 THEN 'partially_paid' ELSE status END AS status, issue_date, invoice_id % 4 != 0 AS has_one_time_items FROM invoices")
def prj4(t):
    k = F.col("invoice_id")
    text = F.element_at(F.array(*map(F.lit, ("Annual licence", "Setup fee", "Annual setup", "Training"))), (k % 4 + 1).cast("int"))
    rows = _payload(t.invoices(), invoice_id=k.cast("string"), status=F.initcap("status"), date=F.col("issue_date").cast("string"), currency_code=F.lit("inr"), total=(F.col("total") / 100).cast("decimal(18,2)"), balance=F.when(k % 3 == 0, 10.5).otherwise(0.0), line_items=F.array(F.struct(text.alias("description"), F.lit(1).alias("quantity"), F.lit(2.5).alias("rate"), F.lit(2.5).alias("item_total"))))
    return payloads.invoices(rows).select("source_id", "total", "status", "issue_date", "has_one_time_items")


@query("prj5_ledger_payments", "SELECT source_id, amount, CASE WHEN payment_id % 3 = 1 THEN 'INV' ELSE 'ref' END AS reference FROM payments")
def prj5(t):
    k = F.col("payment_id")
    inv = F.struct(F.lit("INV").alias("invoice_number"))
    rows = _payload(t.payments(), payment_id=F.col("source_id"), amount=(F.col("amount") / 100).cast("decimal(18,2)"), date=F.col("paid_on").cast("string"), reference_number=F.lit("ref"), invoices=F.when(k % 3 == 0, F.array().cast("array<struct<invoice_number:string>>")).when(k % 3 == 1, F.array(inv)).otherwise(F.array(inv, inv)))
    return payloads.ledger_payments(rows).select("source_id", "amount", "reference")


#: Lines of a statement, about.
STATEMENT = 10_000


def _statement(bank: DataFrame, lines: int = STATEMENT) -> Column:
    """Which of its workspace's statements a line stands in; there are as many as all lines call for."""
    return F.pmod(F.xxhash64("bank_id"), F.lit(bank.count() // lines + 1)).alias("statement")


@query("src7_prj13_prj14_bank_csv", """SELECT 'f' || ws AS path, CASE WHEN bank_id % 10 = 0 THEN NULL ELSE amount END AS amount, CASE WHEN bank_id % 10 = 0 THEN 'bad date' END AS error, CASE WHEN bank_id % 10 = 0 THEN NULL ELSE booked_on END AS transaction_date FROM bank""")
def src7(t):
    """Statements of every workspace, with four lines in front of the header, written as text and read back. A workspace has as many statements as its lines call for, as one file holds 10 MB at most."""
    b = t.bank()
    line = F.concat_ws(";", F.when(F.col("bank_id") % 10 == 0, "someday").otherwise(F.date_format("booked_on", "dd/MM/yyyy")), F.concat(F.lit("NEFT CR-"), F.coalesce("counterparty", F.lit("X"))), F.lit(""), (F.col("amount") / 100).cast("decimal(18,2)").cast("string"), F.lit("ACC 1"))
    head = "Bank of Somewhere\nHolder;X\n\n;;\nTxn Date;Narration;Withdrawal;Deposit;A/C No\n"
    files = b.groupBy("ws", _statement(b)).agg(F.concat(F.lit(head), F.array_join(F.collect_list(line), "\n")).alias("text")).select(F.concat(F.lit("f"), F.col("ws").cast("string"), F.lit("/"), "statement").alias("path"), F.encode("text", "UTF-8").alias("content"))
    rows = bank_csv.transactions(bank_csv.raw_rows(files), F.lit(1))
    bad = F.col("error").isNotNull()
    return rows.select(F.substring_index("path", "/", 1).alias("path"), F.when(~bad, F.col("amount")).alias("amount"), "error", F.when(~bad, F.col("transaction_date")).alias("transaction_date"))


@query("snk2_snk3_export", "SELECT invoice_id, total AS total_exact, status FROM invoices")
def snk3(t):
    """Replace by workspace, twice, then export."""
    spark = t.spark
    path = f"{shared_dir(spark)}/tallyspark/snk2-{uuid.uuid4().hex}"
    rows = t.invoices().select("ws", "invoice_id", "total", "currency", "status")
    sinks.replace_workspaces(rows.where("ws < 2").withColumn("status", F.lit("old")), path)
    sinks.replace_workspaces(rows, path)
    return sinks.export(spark.read.parquet(path), ["total"]).select("invoice_id", "total_exact", "status")


@query("snk1_upsert_commits", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'first' WHEN o_orderkey % 6 = 0 THEN 'third' WHEN o_orderkey % 4 < 2 THEN 'second' ELSE 'first' END AS state FROM orders WHERE o_orderkey % 4 > 0 OR o_orderkey % 2 = 0""")
def snk1_commits(t):
    """Orders in three batches: most of them, half of them again, a sixth a third time; the second batch is sent twice more."""
    path = f"{shared_dir(t.spark)}/tallyspark/upserts-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    orders = t.raw("orders").select("o_orderkey")
    batches = [(1, orders.where(k % 4 >= 2), "first"), (2, orders.where(k % 4 < 2), "second"), (3, orders.where((k % 6 == 0) & (k % 4 < 3)), "third")]
    for batch, rows, state in (*batches[:2], batches[1], batches[2], batches[1]):
        sinks.upsert(rows.withColumns({"state": F.lit(state), "batch": F.lit(batch)}), path, ["o_orderkey"], ["batch"], batch)
    return sinks.upserted(t.spark, path).select("o_orderkey", "state")


@query("snk4_bundle_counts", "SELECT 'refunds' AS artifact, count(*) AS rows, true AS written FROM refunds UNION ALL SELECT 'invoices', count(*), true FROM invoices UNION ALL SELECT 'broken', NULL, false")
def snk4(t):
    """Counts as the exports are written; one can't be."""
    broken = t.invoices().select(F.raise_error(F.lit("no such column")).alias("x"))
    made = sinks.bundle({"refunds": t.refunds(), "invoices": t.invoices(), "broken": broken}, f"{shared_dir(t.spark)}/tallyspark/bundle-{uuid.uuid4().hex}")
    return made.select("artifact", "rows", F.col("error").isNull().alias("written"))


@query("snk7_graph_mirror")
def snk7(t):
    pairs, found = queries_parties._clusters(t)
    nodes, edges = sinks.graph_mirror(identity.records(queries_parties._people(t)), pairs, found)
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")))


def _served(t: Tables, base: str, share: int, size: int) -> None:
    """The first `share` tenths of customers, invoices and parts, as pages of a provider: numbered ones, and of parts some that each name the next one."""
    texts = {
        "contacts": t.customers().select(F.col("customer_id").alias("id"), F.to_json(F.struct(F.col("customer_id").cast("string").alias("contact_id"), F.col("name").alias("contact_name"))).alias("item")),
        "invoices": t.invoices().select(F.col("invoice_id").alias("id"), F.to_json(F.struct(F.col("invoice_id").cast("string").alias("invoice_id"), "total", "status")).alias("item")),
        "files": t.raw("part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))).alias("item")),
    }
    for path, rows in texts.items():
        n = rows.count() * share // 10
        placed = order.numbered(rows.withColumn("one", F.lit(1)), [F.col("one"), F.col("id")], ["one"]).where(F.col("number") <= n)
        pages = placed.groupBy(F.floor((F.col("number") - 1) / size).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "item"))), lambda x: x["item"]), ",").alias("items"))
        more = (F.col("page") + 1) * size < n
        name = F.when(F.col("page") == 0, "").otherwise(F.concat(F.lit("t"), F.col("page"))) if path == "files" else (F.col("page") + 1).cast("string")
        following = F.when(more, F.concat(F.lit(',"nextPageToken":"t'), F.col("page") + 1, F.lit('"'))).otherwise("") if path == "files" else F.concat(F.lit(',"page_context":{"has_more_page":'), more.cast("string"), F.lit("}"))
        sinks.files(pages.select(F.concat(F.lit(f"{path}-"), name, F.lit(".json")).alias("name"), F.concat(F.lit(f'{{"{path}":['), "items", F.lit("]"), following, F.lit("}")).alias("text")), base)


@query("src3_src6_incremental_pulls", """
SELECT record_type, source_id, CAST(1 AS BIGINT) AS n, source_id IS NULL AS is_error FROM (
 SELECT 'customer' AS record_type, CAST(customer_id AS VARCHAR) AS source_id FROM customers UNION ALL SELECT 'invoice', CAST(invoice_id AS VARCHAR) FROM invoices
 UNION ALL SELECT 'contract', CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT 'credit_note', NULL UNION ALL SELECT 'payment', NULL)""")
def src3(t):
    """Two providers pulled as streams, by page numbers and by page tokens, each stopped after what there is; then their last pages grow and new ones follow, and the queries are
    started again from their checkpoints. Two endpoints don't exist."""
    base = f"{shared_dir(t.spark)}/tallyspark/provider-{uuid.uuid4().hex}"
    kinds = (("accounting", "{path}-{page}.json"), ("documents", "{path}-{token}.json"))
    for share in (6, 10):
        _served(t, base, share, 190)
        for connector, name in kinds:
            rows = connectors.pulls(t.spark, connector, f"{base}/{name}", page_size=190, pages_per_batch=20)
            running = evidence.started(rows, f"{base}/{connector}/out", f"{base}/{connector}/state", processingTime="0 seconds")
            running.processAllAvailable()
            running.stop()
    found = [t.spark.read.schema(connectors.SCHEMA).parquet(f"{base}/{connector}/out") for connector, _ in kinds]
    return found[0].unionByName(found[1]).groupBy("record_type", "source_id").agg(F.count("*").alias("n"), F.max(F.col("error").isNotNull()).alias("is_error"))


UPLOADS = """files AS (SELECT 'd' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.bin' ELSE '.pdf' END AS name, doc_id, CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 5 = 0 THEN text ELSE '%PDF-1.7 ' || text END AS body FROM documents WHERE text IS NOT NULL)"""


#: Folders that uploads are dealt over, each of which is listed by one task.
FOLDERS = 256


def _uploads(t: Tables) -> tuple[DataFrame, str]:
    """Documents as files in two halves, of which the second one comes when the first has been taken in; some are empty, some no PDFs. Names say little about that."""
    k = F.col("doc_id")
    body = F.when(k % 17 == 0, "").when(k % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("%PDF-1.7 "), F.col("text")))
    name = F.concat(F.lit("f"), F.pmod(F.xxhash64(k), F.lit(FOLDERS)), F.lit("/d"), k.cast("string"), F.when(k % 3 == 0, ".bin").otherwise(".pdf"))
    return t.raw("documents").where("text IS NOT NULL").select(name.alias("name"), body.alias("text"), (k % 2).alias("half")), f"{shared_dir(t.spark)}/tallyspark/uploads-{uuid.uuid4().hex}"


def _taken_in(t: Tables, name: str) -> DataFrame:
    rows, path = _uploads(t)
    for half in (0, 1):
        sinks.files(rows.where(F.col("half") == half).select("name", "text"), f"{path}/in")
        out = evidence.collected(getattr(documents, name)(documents.found(t.spark, f"{path}/in", stream=True)), path)
    return out


@query("src9_document_intake", "SELECT 'upload_' || substr(sha256(body), 1, 24) AS document_id, any_value(strlen(body)) AS length, sha256(any_value(body)) AS digest FROM files WHERE starts_with(body, '%PDF-') GROUP BY ALL", UPLOADS)
def src9(t):
    """Each document once, though many have equal bytes, some in both halves."""
    return _taken_in(t, "documents").select("document_id", "length", F.sha2("content", 256).alias("digest"))


@query("src9_refused_files", "SELECT name, strlen(body) AS length, 'the file is not a PDF (its first bytes are not %PDF-)' AS reason FROM files WHERE NOT starts_with(body, '%PDF-') AND body != ''", UPLOADS)
def src9b(t):
    return _taken_in(t, "quarantined")


#: Days that events may come late in the streams here, and events of a file.
LATE, EVENTS = 3, 250_000


def _stream(t: Tables, shuffled: bool = False) -> tuple[DataFrame, str]:
    """The events as a stream of one file or, shuffled, of four batches, of a file for each `EVENTS` events. Events of the same time then come up to `LATE` days apart, in any order, and a last file without
    events moves the clock on."""
    path = f"{shared_dir(t.spark)}/tallyspark/stream-{uuid.uuid4().hex}"
    events = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    schema = events.schema.simpleString()[7:-1].replace(":", " ")
    if not shuffled:
        events.coalesce(1).write.parquet(f"{path}/in")
        return evidence.record_stream(t.spark, f"{path}/in", schema), path
    arrival = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(LATE * 86_400 * 9 // 10))
    first, last, count = events.agg(F.min(arrival), F.max(arrival), F.count(arrival)).first()
    step = (last - first) // 4 + 1 if first is not None else 1
    files = max(1, count // 4 // EVENTS)
    for k in range(4 if count else 0):
        part = events.where(arrival.between(first + k * step, first + (k + 1) * step - 1))
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(f"{path}/in")
        for _ in range((k + 1) * files - len(t.spark.read.schema(schema).parquet(f"{path}/in").inputFiles())):  # a batch has as many files as all others, so none has events of two
            events.limit(0).coalesce(1).write.mode("append").parquet(f"{path}/in")
    clock = events.limit(0).unionByName(t.spark.range(1).select(F.timestamp_seconds(F.lit((last or 0) + 100 * 86_400)).alias("ts")), allowMissingColumns=True)
    clock.write.mode("append").parquet(f"{path}/in")
    return evidence.record_stream(t.spark, f"{path}/in", schema, files), path


@query("str_b_once_each", "SELECT event_id FROM events")
def str_b(t):
    stream, path = _stream(t)
    twice = stream.unionByName(stream)
    return evidence.collected(evidence.once_each(twice, keep="60 days").select("event_id"), path)


@query("str_c_content_versions", "SELECT user_id, event_type AS content_hash, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) AS INTEGER) AS version FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL)")
def str_c(t):
    """Over events that come out of order."""
    stream, path = _stream(t, shuffled=True)
    rows = stream.select("user_id", F.col("event_type").alias("content_hash"), "ts", "event_id")
    return evidence.collected(evidence.content_versions(rows, "user_id", late=f"{LATE} days"), path)


@query("str_g_close_repeats", "SELECT event_id, previous_id FROM (SELECT event_id, ts, lag(event_id) OVER w AS previous_id, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE ts - before <= INTERVAL 1 DAY")
def str_g(t):
    """Over events that come out of order."""
    stream, path = _stream(t, shuffled=True)
    return evidence.collected(evidence.close_repeats(stream, ["user_id", "event_type"], late=f"{LATE} days"), path).select("event_id", "previous_id")


@query("str_d_changes_since", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 200")
def str_d(t):
    return evidence.changes_since(t.raw("events"), "2024-01-20").select("event_id")

