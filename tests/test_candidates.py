"""Candidates where parties are unknown."""

from pyspark.sql import functions as F

from tallyspark.operators import reconcile


def test_sides_are_not_broadcast_and_pairs_not_grouped(spark):
    """Files are small for what they hold: a side of 8 MB is hundreds on the driver, once a join. Names that share several words, and days far apart, give each pair once."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 9).cast("int"))
    rows = spark.range(60).withColumns({"ws": F.lit(1), "currency": F.lit("INR"), "customer_id": F.lit(None).cast("long"), "customer_name": F.when(F.col("id") % 3 != 0, "Alpha Beta Firm Ltd"), "day": day, "amount": F.lit(1000).cast("long")})
    i = rows.withColumnsRenamed({"id": "invoice_id", "day": "issue_date", "amount": "total"}).withColumns({"invoice_number": F.concat(F.lit("INV-000"), "invoice_id"), "status": F.lit("sent")})
    p = rows.withColumnsRenamed({"id": "payment_id", "day": "paid_on"}).withColumns({"reference": F.lit(None).cast("string"), "description": F.lit(None).cast("string"), "status": F.lit("captured")})
    found = reconcile.invoice_payment_candidates(i, p)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Aggregate" not in plan
    got = sorted((r["invoice_id"], r["payment_id"]) for r in found.collect())
    assert got == [(a, b) for a in range(60) for b in range(60) if -30 <= 9 * (b - a) <= 120]
