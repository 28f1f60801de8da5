"""SNK3: the tables that a reviewer downloads, as DataFrames. Every amount stands twice: as shown, and exact, with two decimals and without separators, so that it can be read back.

`sinks.bundle` writes them with a manifest. Flags are "yes" or "no", lists are joined by semicolons, absent values are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import money

# What the revenue states are called.
STATE_LABELS = {
    "VERIFIED_RECURRING": "Verified recurring", "VERIFIED_ONE_TIME": "Verified one-time", "CONTRACTED_UNPAID": "Contracted, unbilled", "INVOICED_UNPAID": "Invoiced, unpaid",
    "REFUNDED_OR_REVERSED": "Refunded or reversed", "PAYMENT_WITHOUT_SUPPORT": "Cash without support", "UNSUPPORTED_CLAIM": "Unsupported claim", "HUMAN_REVIEW": "Awaiting human review",
}
SEVERITIES = ("HIGH", "MEDIUM", "LOW", "INFO")


def exact(minor: Column, currency: Column) -> Column:
    """Two decimals, no separators."""
    major = minor.cast("decimal(28,3)") / F.pow(F.lit(10), money.exponent(currency)).cast("decimal(5,0)")
    return F.coalesce(major.cast("decimal(28,2)").cast("string"), F.lit(""))


def both(minor: str, name: str, currency: Column) -> list[Column]:
    shown = F.coalesce(money.formatted(F.col(minor), currency), F.lit(""))
    return [shown.alias(f"{name}_display"), exact(F.col(minor), currency).alias(f"{name}_exact")]


def flag(condition: Column) -> Column:
    return F.when(condition, "yes").otherwise("no")


def listed(values: Column) -> Column:
    return F.coalesce(F.array_join(values.cast("array<string>"), "; "), F.lit(""))


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def revenue_items(items: DataFrame, currency: Column) -> DataFrame:
    """Classified items (ws, item_id, state, rule, gross, recognised, strength, missing, is_published, verdict)."""
    label = F
    for state, name in STATE_LABELS.items():
        label = label.when(F.col("state") == state, F.lit(name))
    withheld = F.concat(F.lit("withheld — "), F.coalesce("verdict", F.lit("not yet reviewed")))
    return items.select(
        "ws", text(F.col("item_id")).alias("item"), label.otherwise(F.col("state")).alias("classification"), flag(F.col("state").isin("VERIFIED_RECURRING", "VERIFIED_ONE_TIME")).alias("counts_as_verified"),
        flag(F.col("state") == "VERIFIED_RECURRING").alias("is_recurring"), *both("gross", "gross", currency), *both("recognised", "recognised", currency), currency.alias("currency"), text(F.col("strength")).alias("evidence_strength"),
        "rule", listed(F.col("missing")).alias("missing_evidence"), flag(F.col("is_published")).alias("published"), F.when(F.col("is_published"), "published").otherwise(withheld).alias("status_for_reviewer"), text(F.col("verdict")).alias("critic_verdict"),
    )


def anomalies(findings: DataFrame) -> DataFrame:
    """Findings (ws, severity, rule, title, observed, baseline, status, model_version, model_score), the gravest first by `severity_rank`."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.upper("severity")), F.lit(9))
    return findings.select("ws", F.lower("severity").alias("severity"), rank.cast("int").alias("severity_rank"), "rule", text(F.col("title")).alias("title"), text(F.col("observed")).alias("observed"), text(F.col("baseline")).alias("baseline"), text(F.col("status")).alias("status"), text(F.col("model_version")).alias("model_version"), F.when(F.col("model_score").isNotNull(), F.format_string("%.4f", "model_score")).otherwise("").alias("model_score"))


def review_queue(items: DataFrame) -> DataFrame:
    return items.select("ws", "status", *(text(F.col(c)).alias(c) for c in ("severity", "category", "question", "detail", "resolution", "reason", "raised_on", "resolved_on")))


def contracts(rows: DataFrame) -> DataFrame:
    """An unread contract isn't one worth zero, so it says so."""
    currency = F.coalesce("currency", F.lit("INR"))
    unread = F.coalesce(F.array_contains("unknown_fields", "terms_not_yet_extracted"), F.lit(False))
    return rows.select(
        "ws", F.col("document_name").alias("document"), text(F.col("customer_name")).alias("customer_named_in_document"), text(F.col("start_date")).alias("term_start"), text(F.col("end_date")).alias("term_end"), text(F.col("billing_frequency")).alias("billing_frequency"),
        currency.alias("currency"), *both("recurring_amount", "recurring", currency), *both("one_time_amount", "one_time", currency), *both("future_period", "future_period", currency), F.when(unread, "no — terms unknown").otherwise("yes").alias("was_read"),
        listed(F.col("unknown_fields")).alias("unknown_fields"), flag(F.col("needs_human_review")).alias("needs_human_review"),
    )


def customers(entities: DataFrame) -> DataFrame:
    return entities.select(
        "ws", F.col("canonical_name").alias("customer"), *(listed(F.col(c)).alias(n) for c, n in (("aliases", "also_known_as"), ("tax_ids", "tax_identifiers"), ("domains", "domains"), ("emails", "email_addresses"), ("addresses", "addresses"))),
        F.when(F.col("confidence").isNotNull(), F.format_string("%.2f", F.col("confidence").cast("double"))).otherwise("").alias("match_confidence"),
    )


def reconciliation(invoices: DataFrame, allocations: DataFrame, claims: DataFrame) -> DataFrame:
    """Settlement of each invoice, from its allocations; what a bank credit stands behind is told apart."""
    backed = claims.select("ws", "payment_id").distinct().withColumn("backed", F.lit(True))
    sums = allocations.join(backed, ["ws", "payment_id"], "left").groupBy("ws", "invoice_id").agg(
        F.sum("amount").alias("allocated"), F.sum(F.when(F.col("backed"), F.col("amount")).otherwise(0)).alias("bank"), F.count("*").alias("links"), F.array_sort(F.collect_set("method")).alias("methods")
    )
    rows = invoices.join(sums, ["ws", "invoice_id"], "left").fillna(0, ["allocated", "bank", "links"]).withColumn("outstanding", F.col("total") - F.col("allocated"))
    currency = F.coalesce("currency", F.lit("INR"))
    return rows.select(
        "ws", F.coalesce("invoice_number", F.col("invoice_id").cast("string")).alias("invoice"), text(F.col("customer_name")).alias("customer"), "status", text(F.col("issue_date")).alias("invoice_date"), *both("total", "invoiced", currency), *both("allocated", "allocated", currency),
        *both("outstanding", "outstanding", currency), both("bank", "bank_confirmed", currency)[0], flag(F.col("bank") > 0).alias("independently_bank_confirmed"), F.col("links").alias("payment_links"), listed(F.col("methods")).alias("match_rules"),
    )


def evidence(payments: DataFrame, bank: DataFrame) -> DataFrame:
    """One row for each payment and bank line."""
    currency = F.coalesce("currency", F.lit("INR"))
    paid = payments.select("ws", F.lit("payment").alias("kind"), text(F.col("source_id")).alias("source_id"), text(F.col("customer_name")).alias("counterparty"), text(F.col("paid_on")).alias("date"), *both("amount", "amount", currency), F.col("status").alias("status_or_direction"), text(F.coalesce("reference", "description")).alias("reference"))
    banked = bank.select("ws", F.lit("bank_transaction").alias("kind"), text(F.col("bank_id")).alias("source_id"), text(F.col("counterparty")).alias("counterparty"), text(F.col("booked_on")).alias("date"), *both("amount", "amount", currency), F.col("direction").alias("status_or_direction"), text(F.col("reference")).alias("reference"))
    return paid.unionByName(banked)


def summary(position: DataFrame, claims: DataFrame, currency: Column) -> DataFrame:
    """Measures of each workspace (ws, published, withheld, n_published, n_withheld; ws, claimed), as long rows."""
    rows = claims.join(position, "ws", "left").fillna(0)
    gap = F.col("claimed") - F.col("published")
    parts = [("Claimed revenue", F.col("claimed")), ("Proven by evidence", F.col("published")), ("Awaiting review", F.col("withheld"))]
    shown = lambda name, minor: F.struct(name.alias("measure"), money.formatted(minor, currency).alias("value"), exact(minor, currency).alias("exact_value"))
    counted = lambda name, n: F.struct(F.lit(name).alias("measure"), n.cast("string").alias("value"), F.lit("").alias("exact_value"))
    all_ = [shown(F.lit(n), c) for n, c in parts] + [shown(F.when(gap < 0, "Evidence beyond the claim").otherwise("Claimed but not yet proven"), F.abs(gap)), counted("Items published", F.col("n_published")), counted("Items withheld pending review", F.col("n_withheld"))]
    return rows.select("ws", F.explode(F.array(*all_)).alias("m")).select("ws", "m.*")
