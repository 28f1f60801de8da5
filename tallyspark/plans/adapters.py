"""Evidence tables over the driver's star schema, as projections; `SQL` says the same in SQL for the oracles.

An order is an invoice; its payment, bank credit, refund and contract follow from its keys by fixed arithmetic, so that every case of
the operators occurs: partial and over-payments, failed ones, refunds by either id, credits nobody claims, contracts of every frequency.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.money import minor_of

#: The reporting period.
PERIOD = ("1997-01-01", "1997-12-31")


def p0():
    return F.lit(PERIOD[0]).cast("date")


def p1():
    return F.lit(PERIOD[1]).cast("date")


class Tables:
    """Canonical tables of one data folder, each built when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def customers(self) -> DataFrame:
        c = self.raw("customer")
        suffix = F.element_at(F.array(*map(F.lit, (" Pvt Ltd", " Private Limited", ", Inc.", " LLP", ""))), (F.col("c_custkey") % 5 + 1).cast("int"))
        name = F.concat(F.lit("Firm "), F.floor(F.col("c_custkey") / 3).cast("string"), F.lit(" "), F.initcap("c_mktsegment"), suffix)
        return c.select((F.col("c_custkey") % 4).cast("int").alias("ws"), F.col("c_custkey").alias("customer_id"), name.alias("name"), F.col("c_nationkey").alias("nation"), minor_of(F.col("c_acctbal")).alias("balance"), F.col("c_mktsegment").alias("segment"))

    def invoices(self) -> DataFrame:
        o = self.raw("orders")
        status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "sent").otherwise("draft")
        return o.select(
            (F.col("o_custkey") % 4).cast("int").alias("ws"), F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("customer_id"), F.concat(F.lit("Firm "), F.floor(F.col("o_custkey") / 3).cast("string"), F.lit(" Ltd")).alias("customer_name"),
            F.concat(F.lit("INV-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("invoice_number"), F.to_date("o_orderdate").alias("issue_date"), minor_of(F.col("o_totalprice")).alias("total"), status.alias("status"),
            F.when(F.col("o_custkey") % 10 == 0, "USD").otherwise("INR").alias("currency"), (F.col("o_orderpriority") == "1-URGENT").alias("has_one_time_items"),
        )

    def payments(self) -> DataFrame:
        i, k = self.invoices().where("invoice_id % 7 != 0"), F.col("invoice_id")
        amount = F.when(k % 5 == 0, F.floor(F.col("total") / 2)).when(k % 5 == 1, F.col("total") + 5000).otherwise(F.col("total")).cast("long")
        status = F.when(k % 11 == 0, "failed").when(k % 11 == 1, "refunded").when(k % 11 == 2, "partially_refunded").otherwise("captured")
        rows = i.withColumns({"amount": amount, "pstatus": status})
        fee = F.floor(F.col("amount") / 50)
        return rows.select(
            "ws", k.alias("payment_id"), F.concat(F.lit("pay_"), k.cast("string")).alias("source_id"), "customer_id", "customer_name", "currency", "amount", fee.cast("long").alias("fee"), F.floor(fee * 18 / 100).cast("long").alias("tax"),
            F.when(F.col("pstatus") == "refunded", F.col("amount")).when(F.col("pstatus") == "partially_refunded", F.floor(F.col("amount") / 4)).otherwise(0).cast("long").alias("amount_refunded"), F.col("pstatus").alias("status"),
            F.date_add("issue_date", (k % 40).cast("int")).alias("paid_on"), F.when(k % 3 == 0, F.concat(F.lit("Pay "), F.col("invoice_number"))).alias("reference"), F.lit(None).cast("string").alias("description"), F.when(k % 4 == 0, F.concat(F.lit("setl"), k.cast("string"))).alias("settlement_id"),
        )

    def bank(self) -> DataFrame:
        k = F.col("payment_id")
        p = self.payments().where("status != 'failed'")
        account = F.concat(F.lit("AC"), (F.floor(F.col("customer_id") / 2) % 400).cast("string"))
        own = p.where(k % 6 != 0).select(
            "ws", k.alias("bank_id"), "currency", F.when(k % 9 == 0, F.col("amount")).otherwise(F.col("amount") - F.col("fee") - F.col("tax")).alias("amount"), F.date_add("paid_on", (k % 6).cast("int")).alias("booked_on"), F.lit("credit").alias("direction"),
            F.when(k % 4 == 0, F.concat(F.lit("NEFT/SETL"), k.cast("string"), F.lit("/X"))).otherwise("NEFT").alias("reference"), F.col("customer_name").alias("counterparty"), account.alias("account"), "customer_id",
        )
        other = p.where(k % 50 == 3).select("ws", (k + 1_000_000_000).alias("bank_id"), "currency", (F.col("amount") + 7_777_777).alias("amount"), F.date_add("paid_on", 1).alias("booked_on"), F.when(k % 100 == 3, "credit").otherwise("debit").alias("direction"), F.lit(None).cast("string").alias("reference"), F.when(k % 150 == 3, None).otherwise(F.col("customer_name")).alias("counterparty"), account.alias("account"), "customer_id")
        return own.unionByName(other)

    def refunds(self) -> DataFrame:
        k = F.col("payment_id")
        p = self.payments().where("amount_refunded > 0")
        return p.select("ws", (k + 500_000_000).alias("refund_id"), F.when(k % 2 == 0, k).alias("payment_id"), F.when(k % 3 != 0, F.col("source_id")).alias("source_payment_id"), F.when(k % 13 == 0, F.col("amount_refunded") * 2).otherwise(F.col("amount_refunded")).alias("amount"), F.date_add("paid_on", (k % 5).cast("int")).alias("refunded_on"))

    def contracts(self) -> DataFrame:
        k = F.col("customer_id")
        start = F.date_add(F.lit("1995-06-01").cast("date"), (k * 7 % 1100).cast("int"))
        frequency = F.element_at(F.array(*map(F.lit, ("monthly", "quarterly", "half_yearly", "annual", "one_time"))), (k % 5 + 1).cast("int"))
        c = self.customers().where("customer_id % 3 != 0")
        return c.select(
            "ws", k.alias("contract_id"), k.alias("customer_id"), F.concat(F.lit("Firm "), F.floor(k / 3).cast("string"), F.lit(" Ltd")).alias("customer_name"), start.alias("start_date"), F.date_add(start, (364 + k * 11 % 400).cast("int")).alias("end_date"), frequency.alias("billing_frequency"),
            F.abs("balance").alias("recurring_amount"), F.when(k % 4 == 1, F.lit(5_000_000)).otherwise(0).cast("long").alias("one_time_amount"), (k % 17 == 0).alias("needs_human_review"), (k % 6 == 1).alias("is_amendment"), F.when(k % 6 == 1, F.date_add(start, 100)).alias("effective_from"),
        )

    def allocations(self) -> DataFrame:
        """The forced links: a payment settles the invoice that it was made for, as far as both go."""
        p = self.payments().where("status != 'failed'").select("ws", "payment_id", "amount", "reference")
        i = self.invoices().where("status != 'draft'").select("ws", F.col("invoice_id").alias("i"), "total")
        j = p.join(i, (p.ws == i.ws) & (F.col("payment_id") == F.col("i"))).drop(i.ws)
        return j.select("ws", F.col("i").alias("invoice_id"), "payment_id", F.least("amount", "total").alias("amount"), F.when(F.col("reference").isNotNull(), "exact_reference").otherwise("exact_amount").alias("method"))

    def lines(self) -> DataFrame:
        """Invoice lines, one for each line number of an order."""
        l = self.raw("lineitem")
        net = F.bround(F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("long")
        return l.groupBy(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line")).agg(F.sum(net).alias("weight"), F.max("l_returnflag").alias("flag"))


#: The adapters for DuckDB.
SQL = """
customers AS (
  SELECT CAST(c_custkey % 4 AS INTEGER) AS ws, c_custkey AS customer_id,
         'Firm ' || (c_custkey // 3) || ' ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || [' Pvt Ltd', ' Private Limited', ', Inc.', ' LLP', ''][c_custkey % 5 + 1] AS name,
         c_nationkey AS nation, CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) AS balance, c_mktsegment AS segment FROM customer),
invoices AS (
  SELECT CAST(o_custkey % 4 AS INTEGER) AS ws, o_orderkey AS invoice_id, o_custkey AS customer_id, 'Firm ' || (o_custkey // 3) || ' Ltd' AS customer_name,
         'INV-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS invoice_number, CAST(o_orderdate AS DATE) AS issue_date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS total,
         CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'sent' ELSE 'draft' END AS status, CASE WHEN o_custkey % 10 = 0 THEN 'USD' ELSE 'INR' END AS currency,
         o_orderpriority = '1-URGENT' AS has_one_time_items FROM orders),
payments0 AS (
  SELECT *, CASE invoice_id % 5 WHEN 0 THEN total // 2 WHEN 1 THEN total + 5000 ELSE total END AS amount,
         CASE invoice_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'refunded' WHEN 2 THEN 'partially_refunded' ELSE 'captured' END AS pstatus
  FROM invoices WHERE invoice_id % 7 != 0),
payments AS (
  SELECT ws, invoice_id AS payment_id, 'pay_' || invoice_id AS source_id, customer_id, customer_name, currency, amount, amount // 50 AS fee, (amount // 50) * 18 // 100 AS tax,
         CASE pstatus WHEN 'refunded' THEN amount WHEN 'partially_refunded' THEN amount // 4 ELSE 0 END AS amount_refunded, pstatus AS status,
         issue_date + CAST(invoice_id % 40 AS INTEGER) AS paid_on, CASE WHEN invoice_id % 3 = 0 THEN 'Pay ' || invoice_number END AS reference, CAST(NULL AS VARCHAR) AS description,
         CASE WHEN invoice_id % 4 = 0 THEN 'setl' || invoice_id END AS settlement_id FROM payments0),
bank AS (
  SELECT ws, payment_id AS bank_id, currency, CASE WHEN payment_id % 9 = 0 THEN amount ELSE amount - fee - tax END AS amount, paid_on + CAST(payment_id % 6 AS INTEGER) AS booked_on, 'credit' AS direction,
         CASE WHEN payment_id % 4 = 0 THEN 'NEFT/SETL' || payment_id || '/X' ELSE 'NEFT' END AS reference, customer_name AS counterparty, 'AC' || (customer_id // 2) % 400 AS account, customer_id
  FROM payments WHERE status != 'failed' AND payment_id % 6 != 0
  UNION ALL
  SELECT ws, payment_id + 1000000000, currency, amount + 7777777, paid_on + 1, CASE WHEN payment_id % 100 = 3 THEN 'credit' ELSE 'debit' END, NULL,
         CASE WHEN payment_id % 150 = 3 THEN NULL ELSE customer_name END, 'AC' || (customer_id // 2) % 400, customer_id
  FROM payments WHERE status != 'failed' AND payment_id % 50 = 3),
refunds AS (
  SELECT ws, payment_id + 500000000 AS refund_id, CASE WHEN payment_id % 2 = 0 THEN payment_id END AS payment_id, CASE WHEN payment_id % 3 != 0 THEN source_id END AS source_payment_id,
         CASE WHEN payment_id % 13 = 0 THEN amount_refunded * 2 ELSE amount_refunded END AS amount, paid_on + CAST(payment_id % 5 AS INTEGER) AS refunded_on
  FROM payments WHERE amount_refunded > 0),
contracts0 AS (SELECT *, DATE '1995-06-01' + CAST(customer_id * 7 % 1100 AS INTEGER) AS start_date FROM customers WHERE customer_id % 3 != 0),
contracts AS (
  SELECT ws, customer_id AS contract_id, customer_id, 'Firm ' || (customer_id // 3) || ' Ltd' AS customer_name, start_date, start_date + CAST(364 + customer_id * 11 % 400 AS INTEGER) AS end_date,
         ['monthly', 'quarterly', 'half_yearly', 'annual', 'one_time'][customer_id % 5 + 1] AS billing_frequency, abs(balance) AS recurring_amount,
         CASE WHEN customer_id % 4 = 1 THEN 5000000 ELSE 0 END AS one_time_amount, customer_id % 17 = 0 AS needs_human_review, customer_id % 6 = 1 AS is_amendment,
         CASE WHEN customer_id % 6 = 1 THEN start_date + 100 END AS effective_from FROM contracts0),
allocations AS (
  SELECT p.ws, i.invoice_id, p.payment_id, least(p.amount, i.total) AS amount, CASE WHEN p.reference IS NOT NULL THEN 'exact_reference' ELSE 'exact_amount' END AS method
  FROM payments p JOIN invoices i ON p.ws = i.ws AND p.payment_id = i.invoice_id WHERE p.status != 'failed' AND i.status != 'draft'),
lines AS (
  SELECT l_orderkey AS invoice_id, l_linenumber AS line, CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS weight, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)
"""


def oracle(body: str, *ctes: str) -> str:
    """An oracle query over the adapters, with further common tables in between."""
    return "WITH " + ",\n".join([SQL.strip(), *ctes]) + "\n" + body
