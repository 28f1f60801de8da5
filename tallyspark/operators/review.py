"""Critic, publication gate, review queue, exports, evidence chains and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .revenue import VERIFIED

#: CRT's codes, with the stage that owns each; MISSING_BANK_CONFIRMATION blocks only if a policy wants it.
OWNERS = {
    "CONTRADICTORY_CLAUSE": 3, "DOUBLE_COUNTED": 5, "MISSING_PAYMENT_EVIDENCE": 4, "REFUND_NOT_APPLIED": 4, "MISSING_BANK_CONFIRMATION": 4,
    "WEAK_ENTITY_LINK": 2, "ONE_TIME_AS_RECURRING": 5, "WRONG_PERIOD": 5, "UNVERIFIED_CITATION": 3, "ANOMALY_UNRESOLVED": 6,
}


def findings(require_bank: bool = False) -> Column:
    """CRT: array of struct<code, blocking>, in the order of the codes."""
    c = F.col
    verified = c("state").isin(*VERIFIED)
    tests = {
        "CONTRADICTORY_CLAUSE": (c("state") == "HUMAN_REVIEW") | (verified & c("has_invoice") & ~c("is_live")),
        "DOUBLE_COUNTED": verified & (c("recognised") > c("retained")),
        "MISSING_PAYMENT_EVIDENCE": verified & (c("retained") <= 0),
        "REFUND_NOT_APPLIED": verified & (c("gross") > 0) & (c("refunded") >= c("gross")),
        "MISSING_BANK_CONFIRMATION": verified & (c("confirmed") <= 0),
        "WEAK_ENTITY_LINK": verified & ~c("customer_resolved"),
        "ONE_TIME_AS_RECURRING": (c("state") == VERIFIED[0]) & (c("contract_recurring") <= 0),
        "WRONG_PERIOD": verified & (c("future_period") > 0) & (c("in_period") <= 0),
        "UNVERIFIED_CITATION": ~c("citations_verified") & (c("recognised") > 0),
        "ANOMALY_UNRESOLVED": c("open_high_anomaly"),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(code != "MISSING_BANK_CONFIRMATION" or require_bank).alias("blocking"))) for code, test in tests.items())))


def judged(items: DataFrame, require_bank: bool = False) -> DataFrame:
    """CRT and the gate: verdict, the stage that a disputed item goes back to, and whether it is published. Anything found disputes an item; only a blocking finding withholds it."""
    rows = items.withColumn("found", findings(require_bank))
    route = F.array_min(F.transform("found", lambda f: _owner(f["code"])))
    return rows.withColumns({
        "verdict": F.when(F.size("found") == 0, "APPROVED").otherwise("DISPUTED"), "route": route,
        "is_published": F.col("state").isin(*VERIFIED) & ~F.exists("found", lambda f: f["blocking"]),
    })


def _owner(code: Column) -> Column:
    out = F
    for name, stage in OWNERS.items():
        out = out.when(code == name, F.lit(stage))
    return out.otherwise(F.lit(None).cast("int"))


def position(items: DataFrame) -> DataFrame:
    """FLT6: the one definition of what is published, and of what is verified but withheld."""
    verified = F.col("state").isin(*VERIFIED)
    return items.groupBy("ws").agg(
        F.sum(F.when(verified & F.col("is_published"), F.col("recognised")).otherwise(0)).alias("published"), F.sum(F.when(verified & ~F.col("is_published"), F.col("recognised")).otherwise(0)).alias("withheld"),
        F.count_if(verified & F.col("is_published")).alias("n_published"), F.count_if(verified & ~F.col("is_published")).alias("n_withheld"),
    )


def snapshot(items: DataFrame) -> DataFrame:
    """AGG13: published recurring and one-time sums; unpaid and other states over all items."""
    pub = F.col("is_published")
    s = lambda state, extra=None: F.sum(F.when((F.col("state") == state) & (extra if extra is not None else F.lit(True)), F.col("recognised") if state in VERIFIED else F.col("gross")).otherwise(0)).alias(state.lower())
    return items.groupBy("ws").agg(s(VERIFIED[0], pub), s(VERIFIED[1], pub), s("INVOICED_UNPAID"), s("CONTRACTED_UNPAID"), s("UNSUPPORTED_CLAIM"), s("HUMAN_REVIEW"), F.count("*").alias("items"))


def missing_histogram(items: DataFrame) -> DataFrame:
    """AGG13: how many items lack what."""
    return items.select("ws", F.explode("missing").alias("lacks")).groupBy("ws", "lacks").agg(F.count("*").alias("n"))


def critic_summary(judgements: DataFrame) -> DataFrame:
    """AGG21: counts by verdict, code and route."""
    return judgements.select("ws", "verdict", "route", F.explode_outer(F.transform("found", lambda f: f["code"])).alias("code")).groupBy("ws", "verdict", "code", "route").agg(F.count("*").alias("n"))


def anomalies_of(items: DataFrame, anomalies: DataFrame) -> DataFrame:
    """JN17: open anomalies of an item by its records, else by its customer (anomalies: anomaly_id, ws, severity, records array<struct<kind, id>>, customer_id)."""
    by_record = anomalies.where("status = 'OPEN'").select("ws", "anomaly_id", "severity", F.explode("records").alias("r")).where("r.kind IN ('invoice', 'payment')")
    inv = by_record.where("r.kind = 'invoice'").join(items.select("ws", "item_id", "invoice_id"), (by_record.ws == items.ws) & (F.col("r.id") == F.col("invoice_id"))).select(items.ws, "item_id", "anomaly_id", "severity")
    pay = by_record.where("r.kind = 'payment'").join(items.select("ws", "item_id", F.explode("payment_ids").alias("pid")), (by_record.ws == items.ws) & (F.col("r.id") == F.col("pid"))).select(items.ws, "item_id", "anomaly_id", "severity")
    hit = inv.unionByName(pay).distinct()
    none = items.join(hit.select("ws", "item_id").distinct(), ["ws", "item_id"], "left_anti").select("ws", "item_id", "customer_id")
    by_customer = none.join(anomalies.where("status = 'OPEN' AND customer_id IS NOT NULL").select("ws", "customer_id", "anomaly_id", "severity"), ["ws", "customer_id"]).select("ws", "item_id", "anomaly_id", "severity")
    return hit.unionByName(by_customer).groupBy("ws", "item_id").agg(F.array_sort(F.collect_set("anomaly_id")).alias("anomalies"), F.max(F.col("severity") == "HIGH").alias("open_high_anomaly"))


def queue(items: DataFrame, now: Column) -> DataFrame:
    """AGG16: open review items by severity: counts, the oldest's days, distinct questions."""
    return items.where("status = 'OPEN'").groupBy("ws", "severity").agg(F.count("*").alias("n"), F.max(F.datediff(now, "created_on")).alias("oldest_days"), F.countDistinct("question_key").alias("questions"))


def ranked(items: DataFrame) -> DataFrame:
    """WIN10: by severity, then age, then id."""
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return items.withColumn("place", F.row_number().over(Window.partitionBy("ws").orderBy(rank, "created_on", "item_id")))


def budgeted(rows: DataFrame, budget: int = 15) -> DataFrame:
    """SRT7: the riskiest pairs of each workspace: conflicts first, then the least weight."""
    w = Window.partitionBy("ws").orderBy(F.desc("conflict"), "weight", "l", "r")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget)


def best(rows: DataFrame, keys: list[str], score: str, row_id: str, most: int) -> DataFrame:
    """SRT1, SRT3: the `most` highest scores of each key, ties by id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), row_id)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def newest(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """SRT5: the `most` latest rows of each key; the last column of `order` tells all rows apart."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def version_diff(snapshots: DataFrame, fields: list[str]) -> DataFrame:
    """WIN11: fields that changed from one version to the next (ws, version, fields)."""
    long = snapshots.select("ws", "version", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("value")) for f in fields))).alias("x")).select("ws", "version", "x.*")
    before = F.lag("value").over(Window.partitionBy("ws", "field").orderBy("version"))
    return long.withColumn("before", before).where("before IS NOT NULL AND value != before").withColumn("change", F.col("value") - F.col("before"))


def published_versions(snapshots: DataFrame, fields: list[str], force: Column | None = None) -> DataFrame:
    """VER1: a snapshot becomes a version only if a field moved since the last one, or where publishing is forced."""
    moved = snapshots.withColumn("_h", F.sha2(F.concat_ws("|", *(F.col(f).cast("string") for f in fields)), 256))
    w = Window.partitionBy("ws").orderBy("taken_at")
    forced = F.lit(False) if force is None else F.coalesce(force, F.lit(False))
    return moved.withColumn("_p", F.lag("_h").over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col("_h")) | forced).drop("_h", "_p").withColumn("version", F.row_number().over(w))


def trace(items: DataFrame, contracts: DataFrame, invoices: DataFrame, allocations: DataFrame, claims: DataFrame, refunds: DataFrame) -> DataFrame:
    """JN16: the evidence chain of each item, and where it breaks."""
    pays = allocations.groupBy("ws", "invoice_id").agg(F.array_sort(F.collect_set("payment_id")).alias("payments"))
    banks = allocations.join(claims, ["ws", "payment_id"]).groupBy("ws", "invoice_id").agg(F.array_sort(F.collect_set("bank_id")).alias("banks"))
    backs = allocations.join(refunds.select("ws", "payment_id", "refund_id"), ["ws", "payment_id"]).groupBy("ws", "invoice_id").agg(F.array_sort(F.collect_set("refund_id")).alias("refunds"))
    rows = items.select("ws", "item_id", "customer_id", "contract_id", "invoice_id").join(contracts.select("ws", "contract_id", F.lit(True).alias("c")), ["ws", "contract_id"], "left")
    rows = rows.join(invoices.select("ws", "invoice_id", F.lit(True).alias("i")), ["ws", "invoice_id"], "left")
    for part in (pays, banks, backs):
        rows = rows.join(part, ["ws", "invoice_id"], "left")
    breaks = F.array_compact(F.array(F.when(F.col("c").isNull(), "no contract"), F.when(F.col("i").isNull(), "no invoice"), F.when(F.col("payments").isNull(), "no payment"), F.when(F.col("banks").isNull(), "no bank receipt")))
    return rows.select("ws", "item_id", "customer_id", "contract_id", "invoice_id", "payments", "banks", "refunds", breaks.alias("breaks"))


#: AGG23: stages that a change of a record type invalidates.
STAGES_OF = {
    "contact": ("identity", "revenue"), "contract": ("contracts", "revenue", "review"), "invoice": ("reconciliation", "revenue", "anomaly", "review"),
    "payment": ("reconciliation", "revenue", "anomaly", "review"), "bank": ("reconciliation", "anomaly"), "refund": ("reconciliation", "revenue"),
}


def impact(changes: DataFrame) -> DataFrame:
    """AGG23: affected stages and customers of the changes in each workspace."""
    stages = F
    for kind, names in STAGES_OF.items():
        stages = stages.when(F.col("record_type") == kind, F.array(*map(F.lit, names)))
    rows = changes.select("ws", "customer_id", F.explode(stages.otherwise(F.array().cast("array<string>"))).alias("stage"))
    return rows.groupBy("ws").agg(F.array_sort(F.collect_set("stage")).alias("stages"), F.countDistinct("customer_id").alias("customers"))


def claimed(queue_items: DataFrame, claims: DataFrame) -> DataFrame:
    """REV1: open items (ws, item_id) that a reviewer takes up are in progress; items of any other status, and other workspaces' items, stay as they are."""
    taken = claims.select("ws", "item_id", F.lit(True).alias("_taken")).distinct()
    hit = F.col("_taken") & (F.col("status") == "OPEN")
    return queue_items.join(taken, ["ws", "item_id"], "left").withColumn("status", F.when(hit, "IN_PROGRESS").otherwise(F.col("status"))).drop("_taken")


def cited(traced: DataFrame, citations: DataFrame) -> DataFrame:
    """JN16: the chain's items with how many citations their contract has, and how many of them were verified; null without a contract."""
    by = citations.groupBy("ws", "contract_id").agg(F.count("*").alias("n"), F.count_if("verified").alias("v"))
    rows = traced.join(by, ["ws", "contract_id"], "left")
    held = F.col("contract_id").isNotNull()
    return rows.withColumns({"citations_total": F.when(held, F.coalesce("n", F.lit(0))), "citations_verified": F.when(held, F.coalesce("v", F.lit(0)))}).drop("n", "v")


def resolved(queue_items: DataFrame, decisions: DataFrame) -> DataFrame:
    """REV1: a decision closes every open item of its question; a decision without a reason does nothing."""
    d = decisions.where("reason IS NOT NULL AND trim(reason) != ''").select("ws", "question_key", "decision", "reason").dropDuplicates(["ws", "question_key"])
    rows = queue_items.join(d, ["ws", "question_key"], "left")
    hit = (F.col("status") == "OPEN") & F.col("decision").isNotNull()
    return rows.withColumns({"status": F.when(hit, "RESOLVED").otherwise(F.col("status")), "decision": F.when(hit, F.col("decision"))})


def settlement_export(invoices: DataFrame, allocations: DataFrame, claims: DataFrame) -> DataFrame:
    """AGG12: each invoice's settlement from its allocations: active sum, sum with a bank credit, counts."""
    banked = allocations.join(claims.select("ws", "payment_id").distinct().withColumn("b", F.lit(True)), ["ws", "payment_id"], "left")
    sums = banked.groupBy("ws", "invoice_id").agg(F.sum("amount").alias("active"), F.sum(F.when(F.col("b"), F.col("amount")).otherwise(0)).alias("banked"), F.count("*").alias("n"), F.countDistinct("method").alias("methods"))
    return invoices.select("ws", "invoice_id", "total").join(sums, ["ws", "invoice_id"], "left").fillna(0, ["active", "banked", "n", "methods"])
