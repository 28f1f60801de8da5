"""Canonical rows of providers' payloads (JSON text in `payload`). Absent fields stay null; amounts are minor units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import to_minor

# The providers' fields.
PAYMENT = "id string, amount bigint, currency string, status string, invoice_id string, order_id string, amount_refunded bigint, fee bigint, tax bigint, email string, created_at bigint, notes struct<customer_name:string,invoice_number:string,invoice:string>"
REFUND = "id string, payment_id string, amount bigint, created_at bigint, status string, notes struct<reason:string>, reason_code string"
CONTACT = "contact_id string, contact_name string, company_name string, email string, website string, gst_no string, billing_address struct<address:string,country:string>"
INVOICE = "invoice_id string, invoice_number string, customer_id string, customer_name string, status string, date string, due_date string, currency_code string, sub_total string, tax_total string, total string, balance string, line_items array<struct<description:string,name:string,quantity:string,rate:string,item_total:string>>"
LEDGER_PAYMENT = "payment_id string, customer_name string, amount string, currency_code string, date string, reference_number string, invoices array<struct<invoice_number:string,amount_applied:string>>"
CREDIT_NOTE = "creditnote_id string, invoice_id string, date string, currency_code string, total string, reason string"
COMPANY = "id string, properties struct<name:string,domain:string,city:string,country:string,lifecyclestage:string>"
INVOICE_STATUS = {"draft": "draft", "sent": "sent", "viewed": "sent", "paid": "paid", "partially_paid": "partially_paid", "overdue": "overdue", "void": "void", "unpaid": "sent"}


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("p", F.from_json("payload", schema))


def _text(column: Column, most: int = 300) -> Column:
    cut = F.substring(F.trim(column), 1, most)
    return F.when(cut != "", cut)


def payments(rows: DataFrame) -> DataFrame:
    """PRJ1: partly refunded if captured with a refund below the amount; the reference is the first of three fields."""
    p = lambda c: F.col(f"p.{c}")
    partly = (p("status") == "captured") & (p("amount_refunded") > 0) & (p("amount_refunded") < p("amount"))
    return _parsed(rows, PAYMENT).select(
        p("id").alias("source_id"), p("amount").alias("amount"), F.upper(p("currency")).alias("currency"), F.when(partly, "partially_refunded").otherwise(F.coalesce(p("status"), F.lit("unknown"))).alias("status"),
        F.coalesce("p.amount_refunded", F.lit(0)).alias("amount_refunded"), F.coalesce("p.fee", F.lit(0)).alias("fee"), F.coalesce("p.tax", F.lit(0)).alias("tax"), _text(F.lower(p("email"))).alias("email"), _text(p("notes.customer_name")).alias("customer_name"),
        F.coalesce(_text(p("notes.invoice_number")), _text(p("notes.invoice")), _text(p("order_id"))).alias("reference"), F.timestamp_seconds(p("created_at")).alias("payment_time"),
    )


def refunds(rows: DataFrame, disputes: DataFrame | None = None) -> DataFrame:
    """PRJ2: refunds, and disputes as refunds marked as chargebacks."""
    one = lambda df, dispute: _parsed(df, REFUND).select(F.col("p.id").alias("source_id"), F.col("p.payment_id").alias("source_payment_id"), F.col("p.amount").alias("amount"), F.col("p.status").alias("status"), F.timestamp_seconds("p.created_at").alias("refund_time"), _text(F.col("p.reason_code") if dispute else F.col("p.notes.reason"), 1000).alias("reason"), F.lit(dispute).alias("is_chargeback"))
    return one(rows, False).unionByName(one(disputes, True)) if disputes is not None else one(rows, False)


def contacts(rows: DataFrame) -> DataFrame:
    """PRJ3"""
    return _parsed(rows, CONTACT).select(
        F.col("p.contact_id").alias("source_id"), F.coalesce(_text(F.col("p.company_name")), _text(F.col("p.contact_name"))).alias("name"), _text(F.lower("p.email")).alias("email"), _text(F.col("p.website")).alias("website"),
        F.array_compact(F.array(_text(F.col("p.gst_no")))).alias("tax_ids"), _text(F.col("p.billing_address.address"), 1000).alias("address"), _text(F.col("p.billing_address.country")).alias("country"),
    )


def invoices(rows: DataFrame) -> DataFrame:
    """PRJ4: decimals to minor units, nested lines with their hints; paid with a balance is partly paid."""
    from ..functions.texts import line_hint

    c = F.upper(F.coalesce("p.currency_code", F.lit("INR")))
    total, due = to_minor(F.col("p.total"), c), to_minor(F.coalesce("p.balance", F.lit("0")), c)
    status = F
    for said, meant in INVOICE_STATUS.items():
        status = status.when(F.lower("p.status") == said, F.lit(meant))
    said = lambda l: F.coalesce(_text(l["description"], 1000), _text(l["name"], 1000), F.lit(""))
    many = lambda l: F.coalesce(F.nullif(l["quantity"].try_cast("decimal(18,6)"), F.lit(0)), F.lit(1)).cast("decimal(18,6)")
    lines = F.transform("p.line_items", lambda l: F.struct(said(l).alias("description"), many(l).alias("quantity"), to_minor(l["rate"], c).alias("unit_amount"), to_minor(l["item_total"], c).alias("total"), line_hint(said(l)).alias("hint")))
    rows = _parsed(rows, INVOICE).select(
        F.col("p.invoice_id").alias("source_id"), _text(F.col("p.invoice_number")).alias("invoice_number"), F.col("p.customer_id").alias("source_customer_id"), _text(F.col("p.customer_name")).alias("customer_name"), status.otherwise("unknown").alias("status"),
        F.to_date(F.try_to_timestamp("p.date", F.lit("yyyy-MM-dd"))).alias("issue_date"), F.to_date(F.try_to_timestamp("p.due_date", F.lit("yyyy-MM-dd"))).alias("due_date"), c.alias("currency"), to_minor(F.col("p.sub_total"), c).alias("subtotal"), to_minor(F.col("p.tax_total"), c).alias("tax"), total.alias("total"), due.alias("amount_due"), lines.alias("line_items"),
    )
    rows = rows.withColumn("status", F.when((F.col("status") == "paid") & (F.col("amount_due") > 0), "partially_paid").otherwise(F.col("status")))
    return rows.withColumn("has_one_time_items", F.coalesce(F.exists("line_items", lambda l: l["hint"].isin("one_time", "ambiguous")), F.lit(False)))


def ledger_payments(rows: DataFrame) -> DataFrame:
    """PRJ5: captured, without fee or tax; the reference is the invoice's only if exactly one was paid."""
    c = F.upper(F.coalesce("p.currency_code", F.lit("INR")))
    only = F.when(F.size("p.invoices") == 1, F.get(F.col("p.invoices.invoice_number"), F.lit(0)))
    return _parsed(rows, LEDGER_PAYMENT).select(
        F.col("p.payment_id").alias("source_id"), _text(F.col("p.customer_name")).alias("customer_name"), to_minor(F.col("p.amount"), c).alias("amount"), c.alias("currency"), F.lit("captured").alias("status"), F.lit(0).alias("fee"), F.lit(0).alias("tax"),
        F.to_timestamp(F.try_to_timestamp("p.date", F.lit("yyyy-MM-dd"))).alias("payment_time"), F.coalesce(only, _text(F.col("p.reference_number"))).alias("reference"),
    )


def credit_notes(rows: DataFrame) -> DataFrame:
    """PRJ6"""
    c = F.upper(F.coalesce("p.currency_code", F.lit("INR")))
    return _parsed(rows, CREDIT_NOTE).select(F.col("p.creditnote_id").alias("source_id"), F.col("p.invoice_id").alias("source_invoice_id"), F.to_date(F.try_to_timestamp("p.date", F.lit("yyyy-MM-dd"))).alias("issue_date"), c.alias("currency"), to_minor(F.col("p.total"), c).alias("total"), _text(F.col("p.reason"), 1000).alias("reason"))


def companies(rows: DataFrame) -> DataFrame:
    """PRJ6"""
    return _parsed(rows, COMPANY).select(F.col("p.id").alias("source_id"), _text(F.col("p.properties.name")).alias("name"), _text(F.lower("p.properties.domain")).alias("domain"), _text(F.col("p.properties.city")).alias("city"), _text(F.col("p.properties.country")).alias("country"), F.col("p.properties.lifecyclestage").alias("stage"))


def unknown_fields(columns: list[str]) -> Column:
    """JSN2: names of the fields that a row lacks."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))


#: What each record type's payloads become.
NORMALIZERS = {"payment": payments, "refund": refunds, "contact": contacts, "invoice": invoices, "ledger_payment": ledger_payments, "credit_note": credit_notes, "company": companies}
