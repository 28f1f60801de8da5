"""Queries over money, periods, reconciliation and revenue, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import money, names, texts
from ..operators import allocation, anomaly, contracts, exports, quality, reconcile, revenue, review
from ..sources.shared import staged
from .adapters import PERIOD, Tables, oracle, p0, p1

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
P0, P1 = f"DATE '{PERIOD[0]}'", f"DATE '{PERIOD[1]}'"


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a function of Tables under a name, with the SQL of its result."""

    def put(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return put


# --- scans, filters, projections -------------------------------------------------------------------------------------------------------


@query("src11_tenant_scan", "SELECT ws, invoice_id, customer_id, issue_date, total, status FROM invoices WHERE ws = 2")
def src11(t):
    return t.invoices().where("ws = 2").select("ws", "invoice_id", "customer_id", "issue_date", "total", "status")


@query("flt1_live_invoices", "SELECT ws, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM invoices WHERE status NOT IN ('void', 'draft') GROUP BY ws")
def flt1(t):
    return t.invoices().where(reconcile.live(F.col("status"))).groupBy("ws").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query("flt2_successful_payments", "SELECT ws, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM payments WHERE status IN ('captured', 'refunded', 'partially_refunded') GROUP BY ws")
def flt2(t):
    return t.payments().where(reconcile.successful(F.col("status"))).groupBy("ws").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("flt5_unread_contracts", "SELECT ws, count(*) AS n FROM contracts WHERE recurring_amount = 0 AND one_time_amount = 0 GROUP BY ws")
def flt5(t):
    return t.contracts().where("recurring_amount = 0 AND one_time_amount = 0").groupBy("ws").agg(F.count("*").alias("n"))


@query("prj11_minor_units", """
SELECT o_orderkey AS id, CASE WHEN abs(x) <= 1000000000000000 THEN CAST(round_even(x * CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 100 ELSE 1000 END, 0) AS BIGINT) END AS minor
FROM (SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 10 = 9 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '5' END AS DECIMAL(30,4)) AS x FROM orders)""")
def prj11(t):
    o = t.raw("orders")
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 9, "n/a").otherwise(F.concat(F.lit(" "), F.regexp_replace(F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("5")), r"^(\d)(\d{3})", "$1,$2")))
    currency = F.when(k % 3 == 0, "jpy").when(k % 3 == 1, "INR").otherwise("KWD")
    return o.select(k.alias("id"), money.to_minor(text, currency).alias("minor"))


@query("prj12_money_format", r"""
SELECT invoice_id, currency || ' ' || CASE WHEN currency = 'INR' AND length(w) > 3 THEN reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\d{2})', '\1,', 'g')) ELSE '' END AS x,
 ltrim(CASE WHEN currency = 'INR' AND length(w) > 3 THEN reverse(rtrim(regexp_replace(reverse(left(w, length(w) - 3)), '(\d{2})', '\1,', 'g'), ',')) || ',' || right(w, 3) WHEN currency = 'INR' THEN w ELSE format('{:,}', total // 100) END, ',') || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') AS shown
FROM (SELECT *, CAST(total // 100 AS VARCHAR) AS w FROM invoices)""".replace("currency || ' ' || CASE WHEN currency = 'INR' AND length(w) > 3 THEN reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\\d{2})', '\\1,', 'g')) ELSE '' END AS x,\n ", ""))
def prj12(t):
    return t.invoices().select("invoice_id", F.substring_index(money.formatted(F.col("total"), F.col("currency")), " ", -1).alias("shown"))


@query("prj9_line_hints", r"""
SELECT item, CASE WHEN o AND r THEN 'ambiguous' WHEN o THEN 'one_time' WHEN r THEN 'recurring' ELSE 'unknown' END AS hint, count(*) AS n FROM (
 SELECT item, regexp_matches(text, '(?i)\b(set[\s-]?up|setup|onboard(?:ing)?|implementation|migration|installation|training)\b') AS o, regexp_matches(text, '(?i)\b(subscription|licen[sc]e|recurring|monthly|quarterly|annual(?:ly)?)\b') AS r
 FROM (SELECT p_size % 7 AS item, p_name || ['', ' setup', ' monthly', ' annual subscription', ' migration of licence', ' set-up', ' widget'][p_size % 7 + 1] AS text FROM part)) GROUP BY ALL""")
def prj9(t):
    p = t.raw("part")
    tail = F.element_at(F.array(*map(F.lit, ("", " setup", " monthly", " annual subscription", " migration of licence", " set-up", " widget"))), (F.col("p_size") % 7 + 1).cast("int"))
    return p.select((F.col("p_size") % 7).alias("item"), texts.line_hint(F.concat("p_name", tail)).alias("hint")).groupBy("item", "hint").agg(F.count("*").alias("n"))


@query("prj7_validation", """
SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN total < 20000 THEN 'total too small' END, CASE WHEN status = 'draft' THEN 'missing status' END, CASE WHEN customer_id % 7 = 0 THEN 'bad currency' END], lambda x: x IS NOT NULL)) AS error FROM invoices) GROUP BY error""")
def prj7(t):
    rules = {"total too small": F.col("total") < 20000, "missing status": F.col("status") == "draft", "bad currency": F.col("customer_id") % 7 == 0}
    _, bad = quality.split_valid(t.invoices(), rules)
    return bad.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("prj8_quarantine_reasons", """
SELECT ws, reason, count(*) AS n FROM (SELECT ws, CASE WHEN m LIKE '%missing%' OR m LIKE '%required%' THEN 'missing_field' WHEN m LIKE '%currency%' THEN 'bad_currency' WHEN m LIKE '%amount%' OR m LIKE '%total%' THEN 'bad_amount' WHEN m LIKE '%date%' OR m LIKE '%time%' THEN 'bad_date' ELSE 'schema' END AS reason
 FROM (SELECT ws, lower(['Missing currency', 'Unknown currency of amount', 'Negative total', 'Bad date', 'extra field'][invoice_id % 5 + 1]) AS m FROM invoices)) GROUP BY ALL""")
def prj8(t):
    message = F.element_at(F.array(*map(F.lit, ("Missing currency", "Unknown currency of amount", "Negative total", "Bad date", "extra field"))), (F.col("invoice_id") % 5 + 1).cast("int"))
    return t.invoices().groupBy("ws", quality.quarantine_reason(message).alias("reason")).agg(F.count("*").alias("n"))


AGG17_SQL = "SELECT ws, currency, status, count(*) AS n FROM invoices WHERE total < 5000000 GROUP BY ALL"


@query("agg17_quarantine_counts", AGG17_SQL)
def agg17(t):
    return t.invoices().where("total < 5000000").groupBy("ws", "currency", "status").agg(F.count("*").alias("n"))


@query("agg18_evidence_counts", """
SELECT 'invoice' AS kind, count(*) AS n, max(issue_date) AS latest FROM invoices UNION ALL SELECT 'payment', count(*), max(paid_on) FROM payments UNION ALL SELECT 'bank', count(*), max(booked_on) FROM bank
UNION ALL SELECT 'refund', count(*), max(refunded_on) FROM refunds UNION ALL SELECT 'contract', count(*), max(start_date) FROM contracts""")
def agg18(t):
    parts = [(t.invoices(), "invoice", "issue_date"), (t.payments(), "payment", "paid_on"), (t.bank(), "bank", "booked_on"), (t.refunds(), "refund", "refunded_on"), (t.contracts(), "contract", "start_date")]
    rows = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.max(on).alias("latest")) for df, kind, on in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("prj15_csv_guard", r"""
SELECT event_id, CASE WHEN regexp_matches(c, '^[=+@-]') AND NOT regexp_matches(c, '^[+-]?[0-9][0-9,]*(\.[0-9]+)?$') THEN '''' || c ELSE c END AS cell FROM (
 SELECT event_id, ['=1+2', '-12.50', '@cmd', '+x', 'plain', '-a'][event_id % 6 + 1] || CASE WHEN event_id % 6 = 1 THEN '' ELSE event_type END AS c FROM events)""")
def prj15(t):
    e = t.raw("events")
    cell = F.concat(F.element_at(F.array(*map(F.lit, ("=1+2", "-12.50", "@cmd", "+x", "plain", "-a"))), (F.col("event_id") % 6 + 1).cast("int")), F.when(F.col("event_id") % 6 == 1, "").otherwise(F.col("event_type")))
    return e.select("event_id", texts.csv_cell(cell).alias("cell"))


@query("prj16_account_fingerprint", "SELECT ws, bank_id, sha256(ws || ':' || regexp_replace(upper(account || '-' || ws), '[^A-Z0-9]', '', 'g')) AS fingerprint FROM bank")
def prj16(t):
    return t.bank().select("ws", "bank_id", names.account_fingerprint(F.col("ws"), F.concat("account", F.lit("-"), "ws")).alias("fingerprint"))


# --- windows over money -----------------------------------------------------------------------------------------------------------------


@query("win5_largest_remainder", """
SELECT invoice_id, line, CAST(CASE WHEN w > 0 THEN fl + CASE WHEN n <= total - sf THEN 1 ELSE 0 END WHEN f = 1 THEN total ELSE 0 END AS BIGINT) AS share FROM (
 SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY rem DESC, line) AS n, sum(fl) OVER (PARTITION BY invoice_id) AS sf, row_number() OVER (PARTITION BY invoice_id ORDER BY line) AS f FROM (
  SELECT *, CAST(total AS HUGEINT) * weight % w AS rem, CAST(total AS HUGEINT) * weight // w AS fl FROM (
   SELECT l.invoice_id, l.line, i.total, l.weight, CAST(sum(l.weight) OVER (PARTITION BY l.invoice_id) AS HUGEINT) AS w FROM lines l JOIN invoices i USING (invoice_id))))""")
def win5(t):
    rows = t.lines().join(t.invoices().select("invoice_id", "total"), "invoice_id")
    return money.largest_remainder(rows, ["invoice_id"], "total", "weight", ["line"]).select("invoice_id", "line", "share")


def _refunded(t) -> DataFrame:
    return reconcile.refunds_of_payments(t.payments(), t.refunds())


REFUNDED = """refunded AS (
 SELECT p.ws, p.payment_id, least(p.amount, greatest(p.amount_refunded, coalesce(l.linked, 0))) AS refunded FROM payments p LEFT JOIN (
  SELECT ws, payment_id, CAST(sum(amount) AS BIGINT) AS linked FROM (
   SELECT ws, payment_id, refund_id, amount FROM refunds WHERE payment_id IS NOT NULL
   UNION SELECT r.ws, p.payment_id, r.refund_id, r.amount FROM refunds r JOIN payments p ON r.ws = p.ws AND r.source_payment_id = p.source_id) GROUP BY ALL) l ON p.ws = l.ws AND p.payment_id = l.payment_id)"""


@query("jn6_agg4_refunds_of_payments", "SELECT * FROM refunded", REFUNDED)
def jn6(t):
    return _refunded(t)


SHARES = """shares AS (
 SELECT ws, payment_id, invoice_id, amount, CAST(down + CASE WHEN row_number() OVER (PARTITION BY ws, payment_id ORDER BY rest DESC, invoice_id) <= back - sum(down) OVER (PARTITION BY ws, payment_id) THEN 1 ELSE 0 END AS BIGINT) AS refund_share FROM (
  SELECT *, back * amount // whole AS down, back * amount % whole AS rest FROM (
   SELECT a.*, CAST(sum(a.amount) OVER w AS HUGEINT) AS whole, CAST(least(r.refunded, sum(a.amount) OVER w) AS HUGEINT) AS back FROM allocations a JOIN refunded r ON a.ws = r.ws AND a.payment_id = r.payment_id WINDOW w AS (PARTITION BY a.ws, a.payment_id))))"""


@query("win6_refund_distribution", "SELECT ws, payment_id, invoice_id, refund_share FROM shares", REFUNDED, SHARES)
def win6(t):
    return reconcile.distributed_refunds(t.allocations(), _refunded(t)).select("ws", "payment_id", "invoice_id", "refund_share")


@query("win7_even_split", "SELECT invoice_id, line, total // n + CASE WHEN i = 1 THEN total - (total // n) * n ELSE 0 END AS share FROM (SELECT l.invoice_id, l.line, i.total, count(*) OVER (PARTITION BY l.invoice_id) AS n, row_number() OVER (PARTITION BY l.invoice_id ORDER BY line) AS i FROM lines l JOIN invoices i USING (invoice_id))")
def win7(t):
    w = Window.partitionBy("invoice_id")
    rows = t.lines().join(t.invoices().select("invoice_id", "total"), "invoice_id").withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("line")) - 1})
    return rows.select("invoice_id", "line", money.even_split(F.col("total"), F.col("n"), F.col("i")).alias("share"))


# --- periods and contracts ---------------------------------------------------------------------------------------------------------------


@query("dt1_overlap_days", f"SELECT contract_id, date_diff('day', start_date, end_date) + 1 AS term, greatest(0, date_diff('day', greatest(start_date, {P0}), least(end_date, {P1})) + 1) AS covered FROM contracts")
def dt1(t):
    return t.contracts().select("contract_id", money.days_inclusive(F.col("start_date"), F.col("end_date")).alias("term"), money.overlap_days(F.col("start_date"), F.col("end_date"), p0(), p1()).alias("covered"))


TERMS = f"""terms AS (SELECT *, CAST(date_diff('day', start_date, end_date) + 1 AS BIGINT) AS term, CAST(greatest(0, date_diff('day', greatest(start_date, {P0}), least(end_date, {P1})) + 1) AS BIGINT) AS covered,
 CASE billing_frequency WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 WHEN 'half_yearly' THEN 2 WHEN 'annual' THEN 1 END AS per_year FROM contracts)"""
VALUED = "valued AS (SELECT *, CASE WHEN per_year IS NULL OR recurring_amount = 0 THEN recurring_amount ELSE recurring_amount * greatest(1, CAST(round_even(term / (365.0 / per_year), 0) AS BIGINT)) END AS value FROM terms)"
PRORATED = "prorated AS (SELECT *, CASE WHEN covered = 0 THEN 0 WHEN covered >= term THEN value ELSE CAST(CAST(value AS HUGEINT) * covered // term + CASE WHEN 2 * (CAST(value AS HUGEINT) * covered % term) > term OR (2 * (CAST(value AS HUGEINT) * covered % term) = term AND (CAST(value AS HUGEINT) * covered // term) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) END AS part FROM valued)"


@query("dt2_proration", "SELECT contract_id, part FROM prorated", TERMS, VALUED, PRORATED)
def dt2(t):
    c = t.contracts()
    value = money.contract_value(F.col("recurring_amount"), F.col("billing_frequency"), money.days_inclusive(F.col("start_date"), F.col("end_date")))
    return c.select("contract_id", money.prorated(value, F.col("start_date"), F.col("end_date"), p0(), p1()).cast("long").alias("part"))


ALLOCATED = f"""allocated AS (SELECT *, CASE WHEN covered = 0 AND start_date > {P1} THEN 'OUTSIDE_PERIOD_FUTURE' WHEN covered = 0 THEN 'OUTSIDE_PERIOD_PAST' WHEN covered < term THEN 'DAY_PRORATED' ELSE 'FULLY_IN_PERIOD' END AS rule,
 CASE WHEN covered = 0 THEN 0 ELSE part + CASE WHEN start_date BETWEEN {P0} AND {P1} THEN one_time_amount ELSE 0 END END AS in_period,
 CASE WHEN covered = 0 THEN CASE WHEN start_date > {P1} THEN value + one_time_amount ELSE 0 END WHEN end_date > {P1} THEN value - part ELSE 0 END AS future_period, coalesce(recurring_amount * per_year, 0) AS annualised FROM prorated)"""


@query("dt3_dt4_dt5_period_allocation", "SELECT contract_id, rule, in_period, future_period, annualised FROM allocated", TERMS, VALUED, PRORATED, ALLOCATED)
def dt3(t):
    return contracts.allocated_to_period(t.contracts(), p0(), p1()).select("contract_id", "rule", "in_period", "future_period", "annualised")


@query("jn18_amendments_as_of", "SELECT a.ws, a.contract_id, arg_max(o.contract_id, (o.start_date, o.contract_id)) AS original_id FROM (SELECT *, customer_id // 10 AS g FROM contracts WHERE is_amendment) a JOIN (SELECT *, customer_id // 10 AS g FROM contracts WHERE NOT is_amendment) o ON a.ws = o.ws AND a.g = o.g AND o.start_date <= coalesce(a.effective_from, a.start_date) GROUP BY ALL")
def jn18(t):
    return contracts.amended(t.contracts().withColumn("g", F.floor(F.col("customer_id") / 10)), ["ws", "g"]).select("ws", "contract_id", "original_id")


@query("mth2_fx", "SELECT invoice_id, CAST(round_even(CAST(total AS DECIMAL(20,0)) * 83.125000 * 10, 0) AS BIGINT) AS converted FROM invoices WHERE currency = 'USD'")
def mth2(t):
    return t.invoices().where("currency = 'USD'").select("invoice_id", money.converted(F.col("total"), F.lit("83.125"), F.lit(2), F.lit(3)).alias("converted"))


# --- candidates and outcomes -----------------------------------------------------------------------------------------------------------


@query("jn1_jn2_invoice_payment", """
SELECT ws, invoice_id, payment_id, least(100, points) / 100.0 AS score, CASE WHEN named THEN 'exact_reference' WHEN exact THEN 'exact_amount' ELSE 'amount_date' END AS method FROM (
 SELECT *, CASE WHEN gap BETWEEN 0 AND 45 THEN 25 ELSE 5 END + CASE WHEN named THEN 50 ELSE 0 END + 30 + CASE WHEN exact THEN 45 WHEN amount < total THEN 20 ELSE 15 END AS points FROM (
  SELECT i.ws, i.invoice_id, p.payment_id, date_diff('day', i.issue_date, p.paid_on) AS gap, abs(p.amount - i.total) <= 100 AS exact, p.amount, i.total,
         coalesce(contains(regexp_replace(lower(p.reference), '[^a-z0-9]', '', 'g'), regexp_replace(lower(i.invoice_number), '[^a-z0-9]', '', 'g')), false) AS named
  FROM invoices i JOIN payments p ON i.ws = p.ws AND i.currency = p.currency AND i.customer_id = p.customer_id WHERE i.status NOT IN ('void', 'draft') AND p.status != 'failed') WHERE gap BETWEEN -30 AND 120)""")
def jn1(t):
    return reconcile.invoice_payment_candidates(t.invoices(), t.payments())


@query("jn1_unresolved_parties")
def jn1_unresolved(t):
    """Payments without a customer id; half of them have no name either, so nothing vetoes a pair. All names share the word Firm. SQL would meet
    all pairs of a workspace; a test holds the operator against brute force."""
    p = t.payments().withColumns({"customer_id": F.lit(None).cast("bigint"), "customer_name": F.when(F.col("payment_id") % 2 == 0, F.col("customer_name"))})
    return reconcile.invoice_payment_candidates(t.invoices(), p).drop("method")


BANKED = """banked AS (
 SELECT ws, payment_id, bank_id, least(100, CASE WHEN net THEN 60 ELSE 35 END + CASE WHEN gap BETWEEN 0 AND 4 THEN 25 ELSE 10 END + CASE WHEN settled THEN 30 ELSE 0 END) / 100.0 AS score FROM (
  SELECT p.ws, p.payment_id, b.bank_id, date_diff('day', p.paid_on, b.booked_on) AS gap, abs(b.amount - (p.amount - p.fee - p.tax)) <= 100 AS net, abs(b.amount - p.amount) <= greatest(100, p.amount * 6 // 100) AS gross, coalesce(contains(lower(b.reference), lower(p.settlement_id)), false) AS settled
  FROM payments p JOIN bank b ON p.ws = b.ws AND p.currency = b.currency WHERE p.status != 'failed' AND b.direction = 'credit' AND b.booked_on BETWEEN p.paid_on - 1 AND p.paid_on + 10) WHERE net OR gross)"""
CLAIMED = "claimed AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY ws, bank_id ORDER BY score DESC, payment_id) AS n FROM banked) WHERE n = 1)"


def _claims(t) -> DataFrame:
    return reconcile.best_claims(t.payments(), t.bank())


@query("jn3_payment_bank", "SELECT * FROM banked", BANKED)
def jn3(t):
    return reconcile.payment_bank_candidates(t.payments(), t.bank())


@query("jn4_one_payment_per_credit", "SELECT * FROM claimed", BANKED, CLAIMED)
def jn4(t):
    return _claims(t)


UNMATCHED = "unmatched AS (SELECT * FROM bank b WHERE direction = 'credit' AND NOT EXISTS (SELECT 1 FROM claimed c WHERE c.ws = b.ws AND c.bank_id = b.bank_id))"


@query("jn5_unmatched_credits", "SELECT ws, bank_id, amount, booked_on FROM unmatched", BANKED, CLAIMED, UNMATCHED)
def jn5(t):
    return reconcile.unmatched_credits(t.bank(), _claims(t)).select("ws", "bank_id", "amount", "booked_on")


@query("flt4_unsupported_receipts", "SELECT ws, bank_id, amount FROM unmatched WHERE amount >= 1000000 AND counterparty IS NOT NULL", BANKED, CLAIMED, UNMATCHED)
def flt4(t):
    return reconcile.unsupported_receipts(t.bank(), _claims(t)).select("ws", "bank_id", "amount")


OUTCOMES = """owned AS (SELECT ws, payment_id, count(*) AS n FROM claimed GROUP BY ALL),
outcomes AS (
 SELECT ws, invoice_id, total, allocated, least(back, allocated) AS refunded, greatest(0, allocated - least(back, allocated)) AS retained, least(seen, allocated) AS confirmed, total - allocated AS outstanding FROM (
  SELECT i.ws, i.invoice_id, i.total, CAST(coalesce(sum(s.amount), 0) AS BIGINT) AS allocated, CAST(coalesce(sum(s.refund_share), 0) AS BIGINT) AS back, CAST(coalesce(sum(s.amount * coalesce(o.n, 0)), 0) AS BIGINT) AS seen
  FROM invoices i LEFT JOIN shares s ON i.ws = s.ws AND i.invoice_id = s.invoice_id LEFT JOIN owned o ON s.ws = o.ws AND s.payment_id = o.payment_id WHERE i.status != 'draft' GROUP BY ALL))"""
CHAIN = (REFUNDED, SHARES, BANKED, CLAIMED, OUTCOMES)


def _outcomes(t) -> DataFrame:
    shares = reconcile.distributed_refunds(t.allocations(), _refunded(t))
    return reconcile.invoice_outcomes(t.invoices(), t.allocations(), shares, _claims(t))


@query("agg3_invoice_outcomes", "SELECT * FROM outcomes", *CHAIN)
def agg3(t):
    return _outcomes(t)


@query("agg2_reconciliation_totals", """
SELECT o.*, p.failed_payments, p.received - coalesce(a.applied, 0) AS unapplied FROM (
 SELECT ws, CAST(sum(total) AS BIGINT) AS invoiced, CAST(sum(allocated) AS BIGINT) AS allocated, CAST(sum(outstanding) AS BIGINT) AS outstanding, CAST(sum(refunded) AS BIGINT) AS refunded, CAST(sum(retained) AS BIGINT) AS retained, CAST(sum(confirmed) AS BIGINT) AS confirmed, count(*) FILTER (WHERE allocated = 0) AS unpaid_invoices FROM outcomes GROUP BY ws) o
JOIN (SELECT ws, CAST(sum(CASE WHEN status != 'failed' THEN amount ELSE 0 END) AS BIGINT) AS received, count(*) FILTER (WHERE status = 'failed') AS failed_payments FROM payments GROUP BY ws) p USING (ws)
LEFT JOIN (SELECT ws, CAST(sum(amount) AS BIGINT) AS applied FROM allocations GROUP BY ws) a USING (ws)""", *CHAIN)
def agg2(t):
    return reconcile.totals(_outcomes(t), t.payments(), t.allocations())


@query("mth3_conservation", "SELECT a.ws, 'payment' AS kind, a.payment_id AS id, a.amount AS used, p.amount AS ceiling FROM allocations a JOIN payments p ON a.ws = p.ws AND a.payment_id = p.payment_id WHERE a.amount > p.amount")
def mth3(t):
    return reconcile.over_allocated(t.allocations(), t.payments(), t.invoices())


@query("alc_allocation", """
SELECT ws, count(*) AS links, CAST(sum(amount) AS BIGINT) AS amount FROM (
 SELECT i.ws, least(i.total, p.amount) AS amount FROM invoices i JOIN payments p ON i.ws = p.ws AND i.invoice_id = p.payment_id WHERE i.status != 'draft' AND p.status != 'failed' AND i.invoice_id % 3 = 0) GROUP BY ws""")
def alc(t):
    """Over candidates by reference, which force every link; tests solve the free cases."""
    found = reconcile.invoice_payment_candidates(t.invoices(), t.payments()).where("method = 'exact_reference'")
    return allocation.allocate(found, t.invoices(), t.payments()).groupBy("ws").agg(F.count("*").alias("links"), F.sum("amount").alias("amount"))


class Settled(Tables):
    """The tables of a folder whose allocations are the best ones over all candidates, instead of the forced ones; solved once."""

    def allocations(self) -> DataFrame:
        if not hasattr(self, "links"):
            i, p = self.invoices(), self.payments()
            found = staged(reconcile.invoice_payment_candidates(i, p), "candidates")
            links = allocation.allocate(found, i, p).select("ws", "invoice_id", "payment_id", "amount")
            self.links = staged(links.join(found.select("ws", "invoice_id", "payment_id", "method"), ["ws", "invoice_id", "payment_id"]), "links")
        return self.links


def settled(name: str):
    """Register a function of Tables over the best allocations. No SQL finds those; tests hold links against brute force and what follows from them against the forced case's SQL."""

    def put(f):
        QUERIES[name] = lambda spark, folder: f(Settled(spark, folder))
        return f

    return put


@query("alc_free_allocation")
def alc_free(t):
    """Over all candidates, where the best solution needn't be unique."""
    i, p = t.invoices(), t.payments()
    return allocation.allocate(reconcile.invoice_payment_candidates(i, p), i, p)


@query("alc_statuses")
def alc_statuses(t):
    i, p = t.invoices(), t.payments()
    return allocation.statuses(reconcile.invoice_payment_candidates(i, p), i, p)


settled("alc_agg3_outcomes")(agg3)
settled("alc_agg2_totals")(agg2)
settled("alc_mth3_conservation")(mth3)


@query("agg1_currency_sums", "SELECT ws, status, CASE WHEN count(*) FILTER (WHERE currency != 'INR') = 0 THEN CAST(sum(total) AS BIGINT) END AS total, CASE WHEN count(*) FILTER (WHERE currency != 'INR') > 0 THEN 'cannot sum ' || array_to_string(list_sort(list(DISTINCT currency) FILTER (WHERE currency != 'INR')), ', ') || ' into a INR total' END AS error FROM (SELECT * FROM invoices WHERE ws != 1 OR currency = 'INR') GROUP BY ALL")
def agg1(t):
    return money.currency_sums(t.invoices().where("ws != 1 OR currency = 'INR'"), ["ws", "status"], "total", "currency", F.lit("INR"))


@query("jn11_payer_accounts", "SELECT c.ws, c.payment_id, arg_min(b.account, b.bank_id) AS account FROM claimed c JOIN bank b ON b.ws = c.ws AND b.bank_id = c.bank_id WHERE EXISTS (SELECT 1 FROM allocations a WHERE a.ws = c.ws AND a.payment_id = c.payment_id) GROUP BY c.ws, c.payment_id", BANKED, CLAIMED)
def jn11(t):
    return reconcile.payer_accounts(t.allocations(), _claims(t), t.bank())


# --- revenue ------------------------------------------------------------------------------------------------------------------------------------


def _items(t) -> DataFrame:
    """SET1: items anchored in invoices, in contracts never invoiced (JN8) and in payments never allocated (JN9)."""
    terms = contracts.allocated_to_period(t.contracts().repartition("ws", "contract_id"), p0(), p1()).select(
        *contracts.PARTY, "contract_id", F.lit(True).alias("has_contract"), F.col("needs_human_review").alias("has_contradiction"), (money.overlap_days(F.col("start_date"), F.col("end_date"), p0(), p1()) > 0).alias("covers_period"), (F.col("billing_frequency") != "one_time").alias("states_recurring"),
        F.col("one_time_amount").alias("contract_one_time"), F.col("recurring_amount").alias("contract_recurring"), "in_period", "future_period", "annualised",
    )
    terms = staged(terms, "terms")
    parties = contracts.contract_of_party(t.invoices(), terms)
    inv, told = contracts.of_parties(t.invoices(), parties), [c for c in terms.columns if c not in contracts.PARTY]
    paid = t.allocations().groupBy("ws", "invoice_id").agg(F.array_sort(F.collect_set("payment_id")).alias("payment_ids"))
    rows = inv.join(_outcomes(t).drop("total", "outstanding"), ["ws", "invoice_id"], "left").join(paid, ["ws", "invoice_id"], "left")
    by_invoice = rows.select("ws", F.col("invoice_id").alias("item_id"), "invoice_id", "customer_id", F.col("total").alias("gross"), F.lit(True).alias("has_invoice"), reconcile.live(F.col("status")).alias("is_live"), "has_one_time_items", "allocated", "refunded", "retained", "confirmed", "payment_ids", *told)
    never = terms.where("contract_recurring > 0 OR contract_one_time > 0").join(parties.select("ws", "contract_id").where("contract_id IS NOT NULL").distinct(), ["ws", "contract_id"], "left_anti")
    by_contract = never.select("ws", (F.col("contract_id") + 2_000_000_000).alias("item_id"), "contract_id", "customer_id", (F.col("contract_recurring") + F.col("contract_one_time")).alias("gross"))
    by_contract = by_contract.join(terms.select("ws", *told), ["ws", "contract_id"], "left")
    refunded = _refunded(t)
    by_payment = t.payments().where(reconcile.successful(F.col("status"))).join(t.allocations().select("ws", "payment_id"), ["ws", "payment_id"], "left_anti").join(refunded, ["ws", "payment_id"]).select(
        "ws", (F.col("payment_id") + 3_000_000_000).alias("item_id"), "customer_id", F.col("amount").alias("gross"), F.col("amount").alias("allocated"), "refunded", (F.col("amount") - F.col("refunded")).alias("retained"), F.array("payment_id").alias("payment_ids"))
    items = by_invoice.unionByName(by_contract, allowMissingColumns=True).unionByName(by_payment, allowMissingColumns=True)
    items = items.fillna(False, ["has_invoice", "is_live", "has_one_time_items", "has_contract", "has_contradiction", "covers_period", "states_recurring"]).fillna(0, ["allocated", "refunded", "retained", "confirmed", "contract_one_time", "contract_recurring", "in_period", "future_period", "annualised"])
    return items.withColumns({
        "has_customer": F.lit(True), "customer_resolved": F.col("customer_id") % 19 != 0, "payment_succeeded": F.col("allocated") > 0, "bank_confirmed": F.col("confirmed") > 0, "fully_refunded": (F.col("refunded") >= F.col("gross")) & (F.col("gross") > 0) & (F.col("allocated") > 0),
        "citations_verified": F.col("customer_id") % 23 != 0, "open_high_anomaly": F.col("customer_id") % 29 == 0,
    })


def _classified(t) -> DataFrame:
    return revenue.classified(_items(t))


ITEMS = """cx AS (SELECT c.*, true AS has_contract, needs_human_review AS has_contradiction, covered > 0 AS covers_period, billing_frequency != 'one_time' AS states_recurring, one_time_amount AS contract_one_time, recurring_amount AS contract_recurring FROM allocated c),
byname AS (SELECT ws, customer_name, min(contract_id) AS contract_id FROM contracts GROUP BY ALL),
inv AS (SELECT i.*, coalesce(c.contract_id, b.contract_id) AS contract_id FROM invoices i LEFT JOIN contracts c ON i.ws = c.ws AND i.customer_id = c.customer_id LEFT JOIN byname b ON i.ws = b.ws AND i.customer_name = b.customer_name),
anchors AS (
 SELECT i.ws, i.invoice_id AS item_id, i.invoice_id, i.contract_id, i.customer_id, i.total AS gross, true AS has_invoice, i.status != 'draft' AS is_live, i.has_one_time_items, coalesce(o.allocated, 0) AS allocated, coalesce(o.refunded, 0) AS refunded, coalesce(o.retained, 0) AS retained, coalesce(o.confirmed, 0) AS confirmed,
        (SELECT list(a.payment_id ORDER BY a.payment_id) FROM allocations a WHERE a.ws = i.ws AND a.invoice_id = i.invoice_id) AS payment_ids
 FROM inv i LEFT JOIN outcomes o ON i.ws = o.ws AND i.invoice_id = o.invoice_id
 UNION ALL SELECT ws, contract_id + 2000000000, NULL, contract_id, customer_id, recurring_amount + one_time_amount, false, false, false, 0, 0, 0, 0, NULL FROM contracts c WHERE (recurring_amount > 0 OR one_time_amount > 0) AND NOT EXISTS (SELECT 1 FROM inv i WHERE i.ws = c.ws AND i.contract_id = c.contract_id)
 UNION ALL SELECT p.ws, p.payment_id + 3000000000, NULL, NULL, p.customer_id, p.amount, false, false, false, p.amount, r.refunded, p.amount - r.refunded, 0, [p.payment_id] FROM payments p JOIN refunded r ON p.ws = r.ws AND p.payment_id = r.payment_id WHERE p.status != 'failed' AND NOT EXISTS (SELECT 1 FROM allocations a WHERE a.ws = p.ws AND a.payment_id = p.payment_id)),
items AS (
 SELECT a.*, coalesce(c.has_contract, false) AS has_contract, coalesce(c.has_contradiction, false) AS has_contradiction, coalesce(c.covers_period, false) AS covers_period, coalesce(c.states_recurring, false) AS states_recurring, coalesce(c.contract_one_time, 0) AS contract_one_time, coalesce(c.contract_recurring, 0) AS contract_recurring,
        coalesce(c.in_period, 0) AS in_period, coalesce(c.future_period, 0) AS future_period, coalesce(c.annualised, 0) AS annualised, a.customer_id % 19 != 0 AS customer_resolved, a.allocated > 0 AS payment_succeeded, a.confirmed > 0 AS bank_confirmed, a.refunded >= a.gross AND a.gross > 0 AND a.allocated > 0 AS fully_refunded,
        a.customer_id % 23 != 0 AS citations_verified, a.customer_id % 29 = 0 AS open_high_anomaly
 FROM anchors a LEFT JOIN cx c ON a.ws = c.ws AND a.contract_id = c.contract_id),
classified0 AS (SELECT *, CASE WHEN has_contradiction THEN 'R08' WHEN has_invoice AND NOT is_live THEN 'R11' WHEN fully_refunded OR (allocated > 0 AND retained = 0) THEN 'R01' WHEN retained > 0 AND NOT has_invoice THEN CASE WHEN has_contract THEN 'R12' ELSE 'R06' END
  WHEN has_contract AND NOT covers_period AND NOT has_invoice THEN 'R10' WHEN retained > 0 AND payment_succeeded AND has_invoice THEN CASE WHEN has_contract AND states_recurring AND covers_period AND (NOT (has_one_time_items AND contract_one_time > 0) OR gross > contract_one_time) THEN 'R02' ELSE 'R03' END
  WHEN has_invoice AND retained = 0 THEN 'R04' WHEN has_contract AND NOT has_invoice THEN 'R05' ELSE 'R07' END AS rule FROM items),
classified1 AS (SELECT *, CASE rule WHEN 'R08' THEN 'HUMAN_REVIEW' WHEN 'R11' THEN 'UNSUPPORTED_CLAIM' WHEN 'R01' THEN 'REFUNDED_OR_REVERSED' WHEN 'R12' THEN 'PAYMENT_WITHOUT_SUPPORT' WHEN 'R06' THEN 'PAYMENT_WITHOUT_SUPPORT' WHEN 'R10' THEN 'CONTRACTED_UNPAID' WHEN 'R02' THEN 'VERIFIED_RECURRING' WHEN 'R03' THEN 'VERIFIED_ONE_TIME' WHEN 'R04' THEN 'INVOICED_UNPAID' WHEN 'R05' THEN 'CONTRACTED_UNPAID' ELSE 'UNSUPPORTED_CLAIM' END AS state FROM classified0),
classified AS (SELECT *, CASE WHEN state = 'VERIFIED_RECURRING' AND in_period > 0 AND in_period < retained THEN in_period WHEN state LIKE 'VERIFIED%' THEN retained ELSE 0 END AS recognised FROM classified1)"""
FULL = (*CHAIN, TERMS, VALUED, PRORATED, ALLOCATED, ITEMS)


@query("set1_item_anchors", "SELECT ws, item_id, invoice_id, contract_id, customer_id, gross, has_invoice, has_contract, allocated, refunded, retained FROM items", *FULL)
def set1(t):
    return _items(t).select("ws", "item_id", "invoice_id", "contract_id", "customer_id", "gross", "has_invoice", "has_contract", "allocated", "refunded", "retained")


@query("jn7_contract_of_invoice", "SELECT ws, invoice_id, contract_id FROM inv", *FULL)
def jn7(t):
    rows = contracts.of_parties(t.invoices(), contracts.contract_of_party(t.invoices(), t.contracts().select(*contracts.PARTY, "contract_id")))
    return rows.select("ws", "invoice_id", "contract_id")


@query("jn8_contracts_never_invoiced", "SELECT ws, contract_id, gross FROM items WHERE item_id BETWEEN 2000000000 AND 2999999999", *FULL)
def jn8(t):
    return _items(t).where("item_id BETWEEN 2000000000 AND 2999999999").select("ws", "contract_id", "gross")


@query("jn9_unallocated_payments", "SELECT p.ws, p.payment_id, p.amount FROM payments p WHERE p.status != 'failed' AND NOT EXISTS (SELECT 1 FROM allocations a WHERE a.ws = p.ws AND a.payment_id = p.payment_id)")
def jn9(t):
    return t.payments().where(reconcile.successful(F.col("status"))).join(t.allocations().select("ws", "payment_id"), ["ws", "payment_id"], "left_anti").select("ws", "payment_id", "amount")


@query("cls_revenue_states", "SELECT ws, item_id, state, rule, recognised FROM classified", *FULL)
def cls(t):
    return _classified(t).select("ws", "item_id", "state", "rule", "recognised")


COUNTED = "CASE WHEN state LIKE 'VERIFIED%' THEN recognised WHEN state = 'REFUNDED_OR_REVERSED' AND refunded > 0 THEN refunded WHEN state = 'PAYMENT_WITHOUT_SUPPORT' AND retained > 0 THEN retained ELSE gross END"
TOTALS = f"state_totals AS (SELECT ws, state, CAST(sum({COUNTED}) AS BIGINT) AS amount, count(*) AS n FROM classified GROUP BY ALL)"


@query("agg5_agg7_state_totals", "SELECT * FROM state_totals", *FULL, TOTALS)
def agg5(t):
    return revenue.state_totals(_classified(t))


@query("agg6_supported_arr", "SELECT ws, CAST(sum(arr) AS BIGINT) AS supported_arr, count(*) AS n_contracts FROM (SELECT ws, coalesce('c' || contract_id, 'i' || item_id) AS k, max(CASE WHEN annualised > 0 THEN annualised ELSE retained END) AS arr FROM classified WHERE state = 'VERIFIED_RECURRING' GROUP BY ALL) GROUP BY ws", *FULL)
def agg6(t):
    return revenue.supported_arr(_classified(t))


WATERFALL = """steps AS (
 SELECT c.ws, c.claimed, coalesce(sum(amount) FILTER (WHERE state = 'REFUNDED_OR_REVERSED'), 0) AS a1, coalesce(sum(amount) FILTER (WHERE state = 'INVOICED_UNPAID'), 0) AS a2, coalesce(sum(amount) FILTER (WHERE state = 'CONTRACTED_UNPAID'), 0) AS a3, coalesce(sum(amount) FILTER (WHERE state = 'PAYMENT_WITHOUT_SUPPORT'), 0) AS a4,
        coalesce(sum(amount) FILTER (WHERE state = 'HUMAN_REVIEW'), 0) AS a5, coalesce(sum(amount) FILTER (WHERE state = 'UNSUPPORTED_CLAIM'), 0) AS a6, coalesce(sum(amount) FILTER (WHERE state LIKE 'VERIFIED%'), 0) AS v
 FROM (SELECT ws, CAST(sum(total) AS BIGINT) * (ws + 1) AS claimed FROM invoices GROUP BY ws) c LEFT JOIN state_totals s USING (ws) GROUP BY ALL),
long AS (
 SELECT ws, 0 AS step, 'Claimed revenue' AS label, claimed AS amount, 'start' AS kind FROM steps UNION ALL SELECT ws, 1, 'Refunded or reversed', -a1, 'deduction' FROM steps UNION ALL SELECT ws, 2, 'Invoiced but unpaid', -a2, 'deduction' FROM steps UNION ALL SELECT ws, 3, 'Contracted but unbilled', -a3, 'deduction' FROM steps
 UNION ALL SELECT ws, 4, 'Cash without support', -a4, 'deduction' FROM steps UNION ALL SELECT ws, 5, 'Awaiting human review', -a5, 'deduction' FROM steps UNION ALL SELECT ws, 6, 'Unsupported', -a6, 'deduction' FROM steps
 UNION ALL SELECT ws, 8, CASE WHEN r < 0 THEN 'Claimed but not evidenced' WHEN v > claimed THEN 'Evidence beyond the claim' ELSE 'Categories larger than the claim' END, r, CASE WHEN r < 0 THEN 'deduction' ELSE 'addition' END FROM (SELECT *, v - claimed + a1 + a2 + a3 + a4 + a5 + a6 AS r FROM steps)
 UNION ALL SELECT ws, 9, 'Evidence-supported revenue (before critic review)', v, 'total' FROM steps)"""


@query("win8_waterfall", "SELECT ws, step, label, CAST(amount AS BIGINT) AS amount, kind, CAST(sum(CASE WHEN kind = 'total' THEN 0 ELSE amount END) OVER (PARTITION BY ws ORDER BY step) AS BIGINT) AS running FROM long WHERE kind IN ('start', 'total') OR amount != 0", *FULL, TOTALS, WATERFALL)
def win8(t):
    claims = t.invoices().groupBy("ws").agg(F.sum("total").alias("s")).select("ws", (F.col("s") * (F.col("ws") + 1)).alias("claimed"))
    return revenue.waterfall(revenue.state_totals(_classified(t)), claims)


settled("alc_cls_revenue_states")(cls)
settled("alc_win8_waterfall")(win8)


CONC = """conc AS (SELECT ws, segment, amount, amount * 100.0 / sum(amount) OVER (PARTITION BY ws) AS share, row_number() OVER (PARTITION BY ws ORDER BY amount DESC, segment) AS rank FROM (
 SELECT i.ws, c.segment, CAST(sum(i.total) AS BIGINT) AS amount FROM invoices i JOIN customers c USING (customer_id) GROUP BY ALL) WHERE amount > 0)"""


@query("agg8_srt6_concentration", "SELECT ws, segment, amount, round(share, 2) AS share, rank, round(max(share) OVER (PARTITION BY ws), 2) AS top1, round(sum(CASE WHEN rank <= 5 THEN share ELSE 0 END) OVER (PARTITION BY ws), 2) AS top5, round(sum(share * share) OVER (PARTITION BY ws), 1) AS hhi FROM conc", CONC)
def agg8(t):
    rows = t.invoices().join(t.customers().select("customer_id", "segment"), "customer_id")
    return revenue.concentration(rows, "segment", "total")


@query("a07_concentrated", "SELECT ws, who AS segment, round(share, 2) AS share, CASE WHEN round(share, 2) >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM (SELECT ws, who, amount * 100.0 / sum(amount) OVER (PARTITION BY ws) AS share, row_number() OVER (PARTITION BY ws ORDER BY amount DESC, who) AS rank FROM (SELECT i.ws, CASE WHEN c.segment IN ('BUILDING', 'MACHINERY') OR i.ws = 2 AND c.segment = 'FURNITURE' THEN 'ONE' ELSE c.segment END AS who, CAST(sum(i.total) AS BIGINT) AS amount FROM invoices i JOIN customers c USING (customer_id) GROUP BY ALL)) WHERE rank = 1 AND round(share, 2) >= 25")
def a07(t):
    """Segments stand in for customers; two or three of them are one, so that both severities occur."""
    one = F.col("segment").isin("BUILDING", "MACHINERY") | ((F.col("ws") == 2) & (F.col("segment") == "FURNITURE"))
    rows = t.invoices().join(t.customers().select("customer_id", "segment"), "customer_id").withColumn("segment", F.when(one, "ONE").otherwise(F.col("segment")))
    return anomaly.concentrated(revenue.concentration(rows, "segment", "total")).select("ws", "segment", "share", "severity")


@query("cls2_double_counts", """
SELECT ws, 'payment' AS kind, id, CAST(sum(r) AS BIGINT) AS amount FROM (SELECT ws, unnest(payment_ids) AS id, recognised * 2 AS r, retained FROM classified WHERE state LIKE 'VERIFIED%' AND len(payment_ids) > 0) GROUP BY ws, id HAVING sum(r) > sum(retained)""", *FULL)
def cls2(t):
    """With recognised amounts doubled, so that the ceilings are broken."""
    return revenue.double_counted(_classified(t).withColumn("recognised", F.col("recognised") * 2))


@query("mth4_mth5_evidence", """
SELECT ws, strength, lacks, count(*) AS n FROM (SELECT ws, CASE WHEN has_contradiction THEN 'DISPUTED' WHEN has_contract AND has_invoice AND payment_succeeded AND bank_confirmed THEN 'STRONG' WHEN has_contract AND has_invoice AND payment_succeeded THEN 'MODERATE' ELSE 'LIMITED' END AS strength,
 array_to_string(list_filter([CASE WHEN v AND NOT has_invoice THEN 'no invoice' END, CASE WHEN v AND NOT payment_succeeded THEN 'no successful payment' END, CASE WHEN v AND retained <= 0 THEN 'no cash retained after refunds' END, CASE WHEN v AND NOT bank_confirmed THEN 'no independent bank confirmation' END, CASE WHEN v AND NOT customer_resolved THEN 'customer identity not resolved' END], lambda x: x IS NOT NULL), ';') AS lacks
 FROM (SELECT *, state LIKE 'VERIFIED%' AS v FROM classified)) GROUP BY ALL""", *FULL)
def mth45(t):
    rows = _classified(t).select("ws", revenue.evidence_strength().alias("strength"), F.array_join(revenue.missing_evidence(True, True), ";").alias("lacks"))
    return rows.groupBy("ws", "strength", "lacks").agg(F.count("*").alias("n"))


@query("prj17_evidence_ids", "SELECT ws, item_id, array_to_string(list_concat(list_filter(['customer:' || customer_id, 'contract:' || contract_id, 'invoice:' || invoice_id], lambda x: x IS NOT NULL), list_transform(coalesce(payment_ids, []), lambda x: 'payment:' || x)), ',') AS ids FROM items", *FULL)
def prj17(t):
    return _items(t).withColumn("bank_ids", F.lit(None).cast("array<bigint>")).select("ws", "item_id", F.array_join(revenue.evidence_ids(), ",").alias("ids"))


# --- critic and room ----------------------------------------------------------------------------------------------------------------------------


def _judged(t) -> DataFrame:
    return review.judged(_classified(t))


JUDGED = """found AS (SELECT *, list_filter([CASE WHEN state = 'HUMAN_REVIEW' OR (v AND has_invoice AND NOT is_live) THEN 'CONTRADICTORY_CLAUSE' END, CASE WHEN v AND recognised > retained THEN 'DOUBLE_COUNTED' END, CASE WHEN v AND retained <= 0 THEN 'MISSING_PAYMENT_EVIDENCE' END, CASE WHEN v AND gross > 0 AND refunded >= gross THEN 'REFUND_NOT_APPLIED' END,
  CASE WHEN v AND confirmed <= 0 THEN 'MISSING_BANK_CONFIRMATION' END, CASE WHEN v AND NOT customer_resolved THEN 'WEAK_ENTITY_LINK' END, CASE WHEN state = 'VERIFIED_RECURRING' AND contract_recurring <= 0 THEN 'ONE_TIME_AS_RECURRING' END, CASE WHEN v AND future_period > 0 AND in_period <= 0 THEN 'WRONG_PERIOD' END,
  CASE WHEN NOT citations_verified AND recognised > 0 THEN 'UNVERIFIED_CITATION' END, CASE WHEN open_high_anomaly THEN 'ANOMALY_UNRESOLVED' END], lambda x: x IS NOT NULL) AS codes FROM (SELECT *, state LIKE 'VERIFIED%' AS v FROM classified)),
judged AS (SELECT *, CASE WHEN len(codes) = 0 THEN 'APPROVED' ELSE 'DISPUTED' END AS verdict, v AND len(list_filter(codes, lambda x: x != 'MISSING_BANK_CONFIRMATION')) = 0 AS is_published,
  list_min(list_transform(codes, lambda x: CASE x WHEN 'CONTRADICTORY_CLAUSE' THEN 3 WHEN 'UNVERIFIED_CITATION' THEN 3 WHEN 'WEAK_ENTITY_LINK' THEN 2 WHEN 'ANOMALY_UNRESOLVED' THEN 6 WHEN 'DOUBLE_COUNTED' THEN 5 WHEN 'ONE_TIME_AS_RECURRING' THEN 5 WHEN 'WRONG_PERIOD' THEN 5 ELSE 4 END)) AS route FROM found)"""
JUDGE = (*FULL, JUDGED)


@query("crt_critic_gate", "SELECT ws, item_id, verdict, route, is_published, array_to_string(codes, ',') AS codes FROM judged", *JUDGE)
def crt(t):
    return _judged(t).select("ws", "item_id", "verdict", "route", "is_published", F.array_join(F.transform("found", lambda f: f["code"]), ",").alias("codes"))


settled("alc_crt_critic_gate")(crt)


@query("flt6_position", "SELECT ws, CAST(sum(CASE WHEN is_published THEN recognised ELSE 0 END) AS BIGINT) AS published, CAST(sum(CASE WHEN v AND NOT is_published THEN recognised ELSE 0 END) AS BIGINT) AS withheld, count(*) FILTER (WHERE is_published) AS n_published, count(*) FILTER (WHERE v AND NOT is_published) AS n_withheld FROM judged GROUP BY ws", *JUDGE)
def flt6(t):
    return review.position(_judged(t))


@query("agg13_snapshot", """SELECT ws, CAST(sum(CASE WHEN state = 'VERIFIED_RECURRING' AND is_published THEN recognised ELSE 0 END) AS BIGINT) AS verified_recurring, CAST(sum(CASE WHEN state = 'VERIFIED_ONE_TIME' AND is_published THEN recognised ELSE 0 END) AS BIGINT) AS verified_one_time, CAST(sum(CASE WHEN state = 'INVOICED_UNPAID' THEN gross ELSE 0 END) AS BIGINT) AS invoiced_unpaid,
 CAST(sum(CASE WHEN state = 'CONTRACTED_UNPAID' THEN gross ELSE 0 END) AS BIGINT) AS contracted_unpaid, CAST(sum(CASE WHEN state = 'UNSUPPORTED_CLAIM' THEN gross ELSE 0 END) AS BIGINT) AS unsupported_claim, CAST(sum(CASE WHEN state = 'HUMAN_REVIEW' THEN gross ELSE 0 END) AS BIGINT) AS human_review, count(*) AS items FROM judged GROUP BY ws""", *JUDGE)
def agg13(t):
    return review.snapshot(_judged(t))


@query("agg21_critic_summary", "SELECT ws, verdict, code, route, count(*) AS n FROM (SELECT ws, verdict, route, unnest(CASE WHEN len(codes) = 0 THEN [NULL] ELSE codes END) AS code FROM judged) GROUP BY ALL", *JUDGE)
def agg21(t):
    return review.critic_summary(_judged(t))


@query("agg13_missing_histogram", "SELECT ws, 'no independent bank confirmation' AS lacks, count(*) AS n FROM classified WHERE state LIKE 'VERIFIED%' AND NOT bank_confirmed GROUP BY ws UNION ALL SELECT ws, 'customer identity not resolved', count(*) FROM classified WHERE state LIKE 'VERIFIED%' AND NOT customer_resolved GROUP BY ws", *FULL)
def agg13b(t):
    return review.missing_histogram(_classified(t).withColumn("missing", revenue.missing_evidence(True, True)))


@query("jn16_evidence_chain", """
SELECT ws, item_id, array_to_string(list_filter([CASE WHEN contract_id IS NULL THEN 'no contract' END, CASE WHEN invoice_id IS NULL THEN 'no invoice' END, CASE WHEN ps IS NULL THEN 'no payment' END, CASE WHEN bs IS NULL THEN 'no bank receipt' END], lambda x: x IS NOT NULL), ',') AS breaks, ps AS n_payments, bs AS n_banks, rs AS n_refunds FROM (
 SELECT i.*, (SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM allocations a WHERE a.ws = i.ws AND a.invoice_id = i.invoice_id) AS ps, (SELECT CASE WHEN count(*) > 0 THEN count(DISTINCT bank_id) END FROM allocations a JOIN claimed c ON a.ws = c.ws AND a.payment_id = c.payment_id WHERE a.ws = i.ws AND a.invoice_id = i.invoice_id) AS bs,
        (SELECT CASE WHEN count(*) > 0 THEN count(DISTINCT refund_id) END FROM allocations a JOIN refunds r ON a.ws = r.ws AND a.payment_id = r.payment_id WHERE a.ws = i.ws AND a.invoice_id = i.invoice_id) AS rs FROM items i)""", *FULL)
def jn16(t):
    rows = review.trace(_items(t), t.contracts(), t.invoices(), t.allocations(), _claims(t), t.refunds())
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    return rows.select("ws", "item_id", F.array_join("breaks", ",").alias("breaks"), n("payments").alias("n_payments"), n("banks").alias("n_banks"), n("refunds").alias("n_refunds"))


@query("agg12_settlement_export", """
SELECT i.ws, i.invoice_id, i.total, coalesce(CAST(sum(a.amount) AS BIGINT), 0) AS active, coalesce(CAST(sum(CASE WHEN b.payment_id IS NOT NULL THEN a.amount ELSE 0 END) AS BIGINT), 0) AS banked, count(a.payment_id) AS n, count(DISTINCT a.method) AS methods
FROM invoices i LEFT JOIN allocations a ON i.ws = a.ws AND i.invoice_id = a.invoice_id LEFT JOIN (SELECT DISTINCT ws, payment_id FROM claimed) b ON a.ws = b.ws AND a.payment_id = b.payment_id GROUP BY ALL""", BANKED, CLAIMED)
def agg12(t):
    return review.settlement_export(t.invoices(), t.allocations(), _claims(t))


# --- exports ----------------------------------------------------------------------------------------------------------------------------------------------

EXACT = "format('{{:.2f}}', CAST({0} AS DECIMAL(20, 2)) / 100)"


@query("snk3_reconciliation_artifact", f"""
SELECT i.ws, i.invoice_number AS invoice, {EXACT.format('i.total')} AS invoiced_exact, {EXACT.format('coalesce(a.amount, 0)')} AS allocated_exact, {EXACT.format('i.total - coalesce(a.amount, 0)')} AS outstanding_exact, CASE WHEN a.banked > 0 THEN 'yes' ELSE 'no' END AS independently_bank_confirmed, coalesce(a.n, 0) AS payment_links
FROM invoices i LEFT JOIN (SELECT a.ws, a.invoice_id, sum(a.amount) AS amount, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM claimed c WHERE c.ws = a.ws AND c.payment_id = a.payment_id) THEN a.amount ELSE 0 END) AS banked FROM allocations a GROUP BY ALL) a ON a.ws = i.ws AND a.invoice_id = i.invoice_id""", BANKED, CLAIMED)
def snk3_reconciliation(t):
    return exports.reconciliation(t.invoices(), t.allocations(), _claims(t)).select("ws", "invoice", "invoiced_exact", "allocated_exact", "outstanding_exact", "independently_bank_confirmed", "payment_links")


@query("snk3_evidence_artifact", f"SELECT ws, 'payment' AS kind, source_id, coalesce(customer_name, '') AS counterparty, CAST(paid_on AS VARCHAR) AS date, {EXACT.format('amount')} AS amount_exact, status AS status_or_direction FROM payments UNION ALL SELECT ws, 'bank_transaction', CAST(bank_id AS VARCHAR), coalesce(counterparty, ''), CAST(booked_on AS VARCHAR), {EXACT.format('amount')}, direction FROM bank")
def snk3_evidence(t):
    return exports.evidence(t.payments(), t.bank()).select("ws", "kind", "source_id", "counterparty", "date", "amount_exact", "status_or_direction")


@query("snk3_revenue_artifact", f"SELECT ws, CAST(item_id AS VARCHAR) AS item, CASE WHEN state LIKE 'VERIFIED%' THEN 'yes' ELSE 'no' END AS counts_as_verified, {EXACT.format('gross')} AS gross_exact, {EXACT.format('recognised')} AS recognised_exact, CASE WHEN is_published THEN 'published' ELSE 'withheld — ' || verdict END AS status_for_reviewer FROM judged", *JUDGE)
def snk3_revenue(t):
    rows = _judged(t).withColumns({"strength": revenue.evidence_strength(), "missing": revenue.missing_evidence(True, True)})
    return exports.revenue_items(rows, F.lit("INR")).select("ws", "item", "counts_as_verified", "gross_exact", "recognised_exact", "status_for_reviewer")


@query("snk3_contracts_artifact", f"SELECT ws, 'c' || contract_id AS document, CAST(start_date AS VARCHAR) AS term_start, {EXACT.format('recurring_amount')} AS recurring_exact, {EXACT.format('future_period')} AS future_period_exact, CASE WHEN contract_id % 6 = 0 THEN 'no — terms unknown' ELSE 'yes' END AS was_read FROM allocated", TERMS, VALUED, PRORATED, ALLOCATED)
def snk3_contracts(t):
    unread = F.when(F.col("contract_id") % 6 == 0, F.array(F.lit("terms_not_yet_extracted")))
    rows = contracts.allocated_to_period(t.contracts(), p0(), p1()).withColumns({"document_name": F.concat(F.lit("c"), F.col("contract_id").cast("string")), "unknown_fields": unread, "currency": F.lit("INR")})
    return exports.contracts(rows).select("ws", "document", "term_start", "recurring_exact", "future_period_exact", "was_read")
