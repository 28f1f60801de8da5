"""Revenue: the eight states, totals, waterfall, concentration and double counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

VERIFIED = ("VERIFIED_RECURRING", "VERIFIED_ONE_TIME")


def recurring() -> Column:
    """Whether retained cash recurs: a contract states so and covers the period, and what is invoiced isn't just its one-time fee."""
    own_fee = F.col("has_one_time_items") & (F.col("contract_one_time") > 0)
    return F.col("has_contract") & F.col("states_recurring") & F.col("covers_period") & (~own_fee | (F.col("gross") > F.col("contract_one_time")))


def classified(items: DataFrame, require_resolved: bool = False) -> DataFrame:
    """CLS: state, rule and recognised amount of each item; the first rule that holds."""
    c = F.col
    back = c("fully_refunded") | ((c("allocated") > 0) & (c("retained") == 0))
    cash = (c("retained") > 0) & c("payment_succeeded") & c("has_invoice")
    ladder = [
        (c("has_contradiction"), "HUMAN_REVIEW", "R08"),
        (F.lit(require_resolved) & c("has_customer") & ~c("customer_resolved"), "HUMAN_REVIEW", "R09"),
        (c("has_invoice") & ~c("is_live"), "UNSUPPORTED_CLAIM", "R11"),
        (back, "REFUNDED_OR_REVERSED", "R01"),
        ((c("retained") > 0) & ~c("has_invoice") & c("has_contract"), "PAYMENT_WITHOUT_SUPPORT", "R12"),
        ((c("retained") > 0) & ~c("has_invoice"), "PAYMENT_WITHOUT_SUPPORT", "R06"),
        (c("has_contract") & ~c("covers_period") & ~c("has_invoice"), "CONTRACTED_UNPAID", "R10"),
        (cash & recurring(), "VERIFIED_RECURRING", "R02"),
        (cash, "VERIFIED_ONE_TIME", "R03"),
        (c("has_invoice") & (c("retained") == 0), "INVOICED_UNPAID", "R04"),
        (c("has_contract") & ~c("has_invoice"), "CONTRACTED_UNPAID", "R05"),
    ]
    state, rule = F, F
    for condition, name, code in ladder:
        condition = F.coalesce(condition, F.lit(False))
        state, rule = state.when(condition, F.lit(name)), rule.when(condition, F.lit(code))
    rows = items.withColumns({"state": state.otherwise("UNSUPPORTED_CLAIM"), "rule": rule.otherwise("R07")})
    part = F.when((c("state") == VERIFIED[0]) & (c("in_period") > 0) & (c("in_period") < c("retained")), c("in_period")).otherwise(c("retained"))
    return rows.withColumn("recognised", F.when(c("state").isin(*VERIFIED), part).otherwise(0).cast("long"))


def counted() -> Column:
    """AGG5: the amount by which an item counts in its state."""
    return (
        F.when(F.col("state").isin(*VERIFIED), F.col("recognised")).when(F.col("state") == "REFUNDED_OR_REVERSED", F.coalesce(F.when(F.col("refunded") > 0, F.col("refunded")), F.col("gross")))
        .when(F.col("state") == "PAYMENT_WITHOUT_SUPPORT", F.coalesce(F.when(F.col("retained") > 0, F.col("retained")), F.col("gross"))).otherwise(F.col("gross"))
    )


def state_totals(items: DataFrame) -> DataFrame:
    """AGG5 and AGG7"""
    return items.groupBy("ws", "state").agg(F.sum(counted()).alias("amount"), F.count("*").alias("n"))


def supported_arr(items: DataFrame) -> DataFrame:
    """AGG6: the largest contribution of each contract (or of an item without one), then the sum."""
    key = F.coalesce(F.concat(F.lit("contract:"), F.col("contract_id").cast("string")), F.concat(F.lit("item:"), F.col("item_id").cast("string")))
    arr = F.coalesce(F.when(F.col("annualised") > 0, F.col("annualised")), F.col("retained"))
    one = items.where(F.col("state") == VERIFIED[0]).groupBy("ws", key.alias("k")).agg(F.max(arr).alias("arr"))
    return one.groupBy("ws").agg(F.sum("arr").alias("supported_arr"), F.count("*").alias("n_contracts"))


#: WIN8's steps in order.
DEDUCTIONS = (
    ("Refunded or reversed", "REFUNDED_OR_REVERSED"), ("Invoiced but unpaid", "INVOICED_UNPAID"), ("Contracted but unbilled", "CONTRACTED_UNPAID"),
    ("Cash without support", "PAYMENT_WITHOUT_SUPPORT"), ("Awaiting human review", "HUMAN_REVIEW"), ("Unsupported", "UNSUPPORTED_CLAIM"),
)


def waterfall(totals: DataFrame, claims: DataFrame) -> DataFrame:
    """WIN8: from the claim to what is verified: every deduction that isn't zero, then the difference as a named step, so that the steps add up."""
    wide = claims.join(totals, "ws", "left").groupBy("ws", "claimed").agg(
        *(F.coalesce(F.sum(F.when(F.col("state") == s, F.col("amount"))), F.lit(0)).alias(s) for _, s in DEDUCTIONS),
        F.coalesce(F.sum(F.when(F.col("state").isin(*VERIFIED), F.col("amount"))), F.lit(0)).alias("verified"),
    )
    residual = F.col("verified") - F.col("claimed") + sum((F.col(s) for _, s in DEDUCTIONS), F.lit(0))
    label = F.when(residual < 0, "Claimed but not evidenced").when(F.col("verified") > F.col("claimed"), "Evidence beyond the claim").otherwise("Categories larger than the claim")
    step = lambda n, name, amount, kind: F.struct(F.lit(n).alias("step"), (name if isinstance(name, Column) else F.lit(name)).alias("label"), amount.cast("long").alias("amount"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"))
    steps = [step(0, "Claimed revenue", F.col("claimed"), "start"), *(step(i, name, -F.col(s), "deduction") for i, (name, s) in enumerate(DEDUCTIONS, 1))]
    steps += [step(8, label, residual, F.when(residual < 0, "deduction").otherwise("addition")), step(9, "Evidence-supported revenue (before critic review)", F.col("verified"), "total")]
    rows = wide.select("ws", F.explode(F.array(*steps)).alias("s")).select("ws", "s.*").where("kind IN ('start', 'total') OR amount != 0")
    running = F.sum(F.when(F.col("kind") == "total", 0).otherwise(F.col("amount"))).over(Window.partitionBy("ws").orderBy("step"))
    return rows.withColumn("running", running)


def concentration(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """AGG8: share of each customer with a positive amount, its rank, and the workspace's top-1, top-5 and HHI."""
    sums = rows.groupBy("ws", key).agg(F.sum(amount).alias("amount")).where("amount > 0")
    ws = Window.partitionBy("ws")
    percent = F.col("amount") * 100.0 / F.sum("amount").over(ws)
    ranked = sums.withColumns({"share": percent, "rank": F.row_number().over(ws.orderBy(F.desc("amount"), key))})
    return ranked.select(
        "ws", key, "amount", F.round("share", 2).alias("share"), "rank", F.round(F.max("share").over(ws), 2).alias("top1"),
        F.round(F.sum(F.when(F.col("rank") <= 5, F.col("share")).otherwise(0.0)).over(ws), 2).alias("top5"), F.round(F.sum(F.col("share") * F.col("share")).over(ws), 1).alias("hhi"),
    )


def double_counted(items: DataFrame) -> DataFrame:
    """CLS2: an invoice behind two verified items, and payments whose items recognise more than was retained of them (`payments`: array of ids; `retained_of`: map id to retained)."""
    verified = items.where(F.col("state").isin(*VERIFIED))
    twice = verified.where("invoice_id IS NOT NULL").groupBy("ws", F.col("invoice_id").alias("id")).agg(F.count("*").alias("n"), F.sum("recognised").alias("amount")).where("n > 1").select("ws", F.lit("invoice").alias("kind"), "id", "amount")
    n = F.size("payment_ids")
    shares = verified.where(n > 0).select("ws", F.posexplode("payment_ids").alias("i", "id"), "recognised", n.alias("n"), "retained")
    from ..functions.money import even_split

    by = shares.groupBy("ws", "id").agg(F.sum(even_split(F.col("recognised"), F.col("n"), F.col("i"))).alias("amount"), F.sum(even_split(F.col("retained"), F.col("n"), F.col("i"))).alias("ceiling"))
    return twice.unionByName(by.where("amount > ceiling").select("ws", F.lit("payment").alias("kind"), "id", "amount"))


def evidence_strength() -> Column:
    """MTH4"""
    c = F.col
    paid = c("has_contract") & c("has_invoice") & c("payment_succeeded")
    return F.when(c("has_contradiction"), "DISPUTED").when(paid & c("bank_confirmed"), "STRONG").when(paid, "MODERATE").otherwise("LIMITED")


def missing_evidence(require_bank: bool = False, require_resolved: bool = False) -> Column:
    """MTH5: what an item lacks for its state."""
    c = F.col
    verified, again = c("state").isin(*VERIFIED), c("state") == VERIFIED[0]
    return F.array_compact(F.array(
        F.when(verified & ~c("has_invoice"), "no invoice"), F.when(verified & ~c("payment_succeeded"), "no successful payment"),
        F.when(verified & (c("retained") <= 0), "no cash retained after refunds"), F.when(verified & ~c("bank_confirmed") & F.lit(require_bank), "no independent bank confirmation"),
        F.when(verified & ~c("customer_resolved") & F.lit(require_resolved), "customer identity not resolved"), F.when(again & ~c("has_contract"), "no contract establishing recurring terms"),
        F.when(again & c("has_contract") & ~c("states_recurring"), "contract does not state a recurring charge"),
        F.when(again & c("has_contract") & ~c("covers_period"), "contract term does not cover the reporting period"),
        F.when((c("state") == "CONTRACTED_UNPAID") & ~c("has_contract"), "no contract"),
    ))


def evidence_ids() -> Column:
    """PRJ17: prefixed ids of all that an item rests on."""
    one = lambda prefix, name: F.when(F.col(name).isNotNull(), F.concat(F.lit(prefix), F.col(name).cast("string")))
    return F.concat(
        F.array_compact(F.array(one("customer:", "customer_id"), one("contract:", "contract_id"), one("invoice:", "invoice_id"))),
        F.transform(F.coalesce("payment_ids", F.array().cast("array<bigint>")), lambda p: F.concat(F.lit("payment:"), p.cast("string"))),
        F.transform(F.coalesce("bank_ids", F.array().cast("array<bigint>")), lambda p: F.concat(F.lit("bank:"), p.cast("string"))),
    )
