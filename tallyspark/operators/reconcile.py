"""Invoices to payments to bank credits: candidates, outcomes and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import money, names, texts
from ..sources.shared import staged

SUCCESSFUL = ("captured", "refunded", "partially_refunded")
DEAD = ("void", "draft")
#: Days from invoice to payment, and from payment to bank credit.
PAY_FROM, PAY_TO = -30, 120
BANK_FROM, BANK_TO = -1, 10
CLOSE = 100
LEAST_SCORE = 0.25


def live(status: Column) -> Column:
    return ~status.isin(*DEAD)


def successful(status: Column) -> Column:
    return status.isin(*SUCCESSFUL)


def invoice_payment_score(i: str = "i", p: str = "p") -> dict[str, Column]:
    """JN1's score and method for a joined pair with columns i_* and p_*."""
    c = lambda side, name: F.col(f"{side}_{name}")
    gap = F.datediff(c(p, "date"), c(i, "date"))
    named = (F.length(c(i, "key")) >= 5) & (F.contains(c(p, "description_key"), c(i, "key")) | F.contains(c(p, "reference_key"), c(i, "key")))
    same_entity = F.coalesce(c(i, "entity") == c(p, "entity"), F.lit(False))
    same_name = F.coalesce((c(i, "name") == c(p, "name")) & (c(i, "name") != ""), F.lit(False))
    off = c(p, "amount") - c(i, "total")
    exact = F.abs(off) <= CLOSE
    hundredths = (  # whole hundredths, so that sums and comparisons are exact
        F.when(gap.between(0, 45), 25).otherwise(5) + F.when(named, 50).otherwise(0) + F.when(same_entity, 30).when(same_name, 20).otherwise(0)
        + F.when(exact, 45).when(off < 0, 20).otherwise(15)
    )
    method = F.when(named, "exact_reference").when(exact, "exact_amount").otherwise("amount_date")
    return {"score": F.least(F.lit(100), hundredths) / 100.0, "method": method}


def _sides(invoices: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    i = invoices.where(live(F.col("status"))).select(
        "ws", "currency", F.col("invoice_id").alias("i_id"), F.col("customer_id").alias("i_entity"), names.normalize_name(F.col("customer_name")).alias("i_name"),
        names.name_tokens(F.col("customer_name")).alias("i_tokens"), F.col("issue_date").alias("i_date"), F.col("total").alias("i_total"), F.col("invoice_number").alias("i_number"), texts.reference_key(F.col("invoice_number")).alias("i_key"),
    )
    p = payments.where(successful(F.col("status"))).select(
        "ws", "currency", F.col("payment_id").alias("p_id"), F.col("customer_id").alias("p_entity"), names.normalize_name(F.col("customer_name")).alias("p_name"),
        names.name_tokens(F.col("customer_name")).alias("p_tokens"), F.col("paid_on").alias("p_date"), F.col("amount").alias("p_amount"), *(texts.reference_key(F.coalesce(F.col(c), F.lit(""))).alias(f"p_{c}_key") for c in ("reference", "description")),
    )
    return i, p


def _either(a: DataFrame, b: DataFrame, in_a: Column, in_b: Column, keys: list[str]) -> DataFrame:
    """Rows that join where the one or the other side is marked; unmarked rows never meet each other, however common their key. A side's files are small for what they hold, so none is
    broadcast; where days are among the keys, these are dealt over as many tasks as pairs call for, not rows."""
    conf = a.sparkSession
    tasks = max(int(conf.conf.get("spark.sql.shuffle.partitions")), 4 * conf.sparkContext.defaultParallelism)
    dealt = lambda rows: rows.repartition(tasks, *keys) if "b" in keys else rows
    met = lambda x, y: dealt(x).join(dealt(y).hint("merge"), keys)
    return met(a.where(in_a), b).unionByName(met(a.where(~in_a), b.where(in_b)))


#: Days of a bucket that dated invoices and payments meet in.
DAYS = 30


def invoice_payment_candidates(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """JN1: scored pairs. Both entities known: they must be equal, which makes it an equi join. Otherwise both names known: they
    must share a distinctive token, joined on the token and a bucket of days. The rest, where nothing can veto a pair, is joined by buckets of days.
    Every branch reads both sides, so these, with their names' tokens, are staged."""
    i, p = (staged(rows, "sides") for rows in _sides(invoices, payments))
    known = lambda side: F.col(f"{side}_entity").isNotNull()
    has_name = lambda side: F.size(f"{side}_tokens") > 0
    near = F.col("p_date").isNull() | F.col("i_date").isNull() | F.datediff("p_date", "i_date").between(PAY_FROM, PAY_TO)
    both = i.where(known("i")).join(p.where(known("p")).hint("merge"), [i.ws == p.ws, i.currency == p.currency, F.col("i_entity") == F.col("p_entity")])
    both = both.where((F.size("i_tokens") == 0) | (F.size("p_tokens") == 0) | F.arrays_overlap("i_tokens", "p_tokens")).drop(p.ws).drop(p.currency)
    score = lambda pairs: pairs.withColumns(invoice_payment_score()).where(F.col("score") >= LEAST_SCORE).select("ws", F.col("i_id").alias("invoice_id"), F.col("p_id").alias("payment_id"), "score", "method")
    if i.where(~known("i")).isEmpty() and p.where(~known("p")).isEmpty():  # no other branch has rows
        return score(both.where(near))
    unknown = ~known("i") | ~known("p")
    bucket = lambda d: F.floor(F.unix_date(d) / DAYS)
    bi = i.withColumn("b", F.when(F.col("i_date").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(bucket(F.date_add("i_date", PAY_FROM)), bucket(F.date_add("i_date", PAY_TO))))).withColumn("b", F.explode("b"))
    bp = p.withColumn("b", bucket(F.col("p_date")))
    token = lambda rows, side: rows.where(has_name(side)).withColumn("token", F.explode(f"{side}_tokens"))
    by_day = _either(token(bi, "i"), token(bp, "p"), ~known("i"), ~known("p"), ["ws", "currency", "b", "token"]).drop("b")
    undated = _either(token(i.where("i_date IS NULL"), "i"), token(p, "p"), ~known("i"), ~known("p"), ["ws", "currency", "token"])
    undated = undated.unionByName(_either(token(i.where("i_date IS NOT NULL"), "i"), token(p.where("p_date IS NULL"), "p"), ~known("i"), ~known("p"), ["ws", "currency", "token"]))
    by_name = by_day.unionByName(undated).where(near & (F.col("token") == F.array_min(F.array_intersect("i_tokens", "p_tokens")))).drop("token")  # once, by the first token that both have
    dated = _either(bi.where("b IS NOT NULL"), bp.where("b IS NOT NULL"), ~has_name("i"), ~has_name("p"), ["ws", "currency", "b"])
    undated_i = _either(bi.where("b IS NULL").drop("b"), bp.drop("b"), ~has_name("i"), ~has_name("p"), ["ws", "currency"]).select(*dated.drop("b").columns)
    undated_p = _either(i.where("i_date IS NOT NULL"), bp.where("b IS NULL").drop("b"), ~has_name("i"), ~has_name("p"), ["ws", "currency"]).select(*dated.drop("b").columns)
    nameless = dated.drop("b").unionByName(undated_i).unionByName(undated_p).where(unknown & (~has_name("i") | ~has_name("p")))
    return score(both.unionByName(by_name).unionByName(nameless).where(near))


#: Amounts within 6 % of each other lie in the same or in neighbouring steps of this logarithm; below SMALL the hundred decides, which is a step of CLOSE.
STEP, SMALL = 1.07, 1650


def _bank_terms() -> tuple[Column, Column, Column, Column]:
    """Days between, whether the net or the gross amount is met, and JN3's points of a joined pair."""
    gap = F.datediff("booked_on", "paid_on")
    net = F.abs(F.col("credit") - F.col("net")) <= CLOSE
    gross = F.abs(F.col("credit") - F.col("amount")) <= _tolerance()
    settled = F.coalesce(F.contains(F.lower("bank_reference"), F.lower("settlement_id")), F.lit(False))
    points = F.when(net, 60).when(gross, 35) + F.when(gap.between(0, 4), 25).otherwise(10) + F.when(settled, 30).otherwise(0)
    return gap, net, gross, F.least(F.lit(100), points)


def _tolerance() -> Column:
    return F.greatest(F.lit(CLOSE), F.floor(F.col("amount") * 6 / 100))


def _hundred(amount: Column) -> Column:
    return F.floor(amount / CLOSE).cast("long")


def _step(amount: Column) -> Column:
    return F.floor(F.log(F.greatest(amount, F.lit(1)).cast("double")) / F.log(F.lit(STEP))).cast("long")


def _bank_sides(payments: DataFrame, bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = payments.where(successful(F.col("status"))).select("ws", "currency", "payment_id", "paid_on", "amount", (F.col("amount") - F.col("fee") - F.col("tax")).alias("net"), "settlement_id")
    return p, bank.where("direction = 'credit'").select("ws", "currency", "bank_id", "booked_on", F.col("amount").alias("credit"), F.col("reference").alias("bank_reference"))


def payment_bank_candidates(payments: DataFrame, bank: DataFrame) -> DataFrame:
    """JN3: scored pairs, joined on workspace, currency, a bucket of days and a bucket of amounts. A payment's window meets two buckets of days. Its net amount is sought
    among credits within a hundred, its gross amount, where the net one isn't met, among those within 6 % or a hundred. A credit has one bucket of each kind, so no pair
    is found twice. There are as many pairs as are that close; `best_claims` finds the best of each credit without them."""
    span = BANK_TO - BANK_FROM
    p, b = _bank_sides(payments, bank)
    p = p.withColumn("b", F.explode(F.array_distinct(F.array(F.floor(F.unix_date(F.date_add("paid_on", BANK_FROM)) / span), F.floor(F.unix_date(F.date_add("paid_on", BANK_TO)) / span)))))
    b = b.withColumn("b", F.floor(F.unix_date("booked_on") / span))
    near = lambda at: F.explode(F.array(at - 1, at, at + 1))
    gap, net, gross, points = _bank_terms()
    met = lambda pays, of_credit, wanted: pays.join(b.withColumn("k", of_credit), ["ws", "currency", "b", "k"]).where(wanted)
    pairs = (
        met(p.withColumn("k", near(_hundred(F.col("net")))), _hundred(F.col("credit")), net)
        .unionByName(met(p.where(F.col("amount") < SMALL).withColumn("k", near(_hundred(F.col("amount")))), _hundred(F.col("credit")), gross & ~net))
        .unionByName(met(p.where(F.col("amount") >= SMALL).withColumn("k", near(_step(F.col("amount")))), _step(F.col("credit")), gross & ~net))
    )
    return pairs.where(gap.between(BANK_FROM, BANK_TO)).select("ws", "payment_id", "bank_id", (points / 100.0).alias("score"))


#: Widths of the buckets of days and net amounts in which best claims are sought, and how much of a settlement's id is looked up.
DAYS, WIDTH, ANCHOR = 30, 1000, 8


def _days(on: str) -> Column:
    """The buckets of days in which a payment's credits can lie."""
    return F.explode(F.sequence(F.floor((F.unix_date(on) + BANK_FROM) / DAYS), F.floor((F.unix_date(on) + BANK_TO) / DAYS)))


def front(rows: DataFrame, cell: list[str]) -> DataFrame:
    """The rows of a cell that are the first by payment_id for some lower limit on `high`, or some upper limit on `low`. For rows in random order these are about twice the
    logarithm of the cell's rows."""
    before = Window.partitionBy(*cell).orderBy("payment_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumns({"_high": F.max("high").over(before), "_low": F.min("low").over(before)})
    return marked.where(F.col("_high").isNull() | (F.col("high") > F.col("_high")) | (F.col("low") < F.col("_low"))).drop("_high", "_low")


def _first_gross(p: DataFrame, credits: DataFrame, since: int, until: int, points: int) -> DataFrame:
    """For each credit, the first payment, by id, whose gross amount it meets `since` to `until` days on. A cell of amounts is narrower than what meets a credit, so
    a credit's limits cut it on one side at most, and its first payment is on the cell's front."""
    large = F.col("amount") >= SMALL
    lone = p.groupBy("ws", "currency", "paid_on", "amount").agg(F.min("payment_id").alias("payment_id"))
    lone = lone.select("ws", "currency", "paid_on", "payment_id", large.alias("large"), F.when(large, _step(F.col("amount"))).otherwise(_hundred(F.col("amount"))).alias("k"), (F.col("amount") - _tolerance()).alias("low"), (F.col("amount") + _tolerance()).alias("high"))
    cell = ["ws", "currency", "booked_on", "large", "k"]
    places = lambda kind, at: [F.struct(F.lit(kind).alias("large"), (at + d).alias("k")) for d in (-1, 0, 1)]
    small, big = F.array(*places(False, _hundred(F.col("credit")))), F.array(*places(True, _step(F.col("credit"))))
    wanted = F.when(F.col("credit") < SMALL - CLOSE, small).when(F.col("credit") > SMALL + CLOSE, big).otherwise(F.concat(small, big))
    asked = credits.select("ws", "currency", "bank_id", "booked_on", "credit", F.explode(wanted).alias("at")).select("*", "at.*").drop("at")
    firsts = front(lone, ["ws", "currency", "paid_on", "large", "k"])
    firsts = firsts.withColumn("booked_on", F.explode(F.sequence(F.date_add("paid_on", since), F.date_add("paid_on", until)))).join(asked.select(*cell).distinct(), cell, "left_semi")
    met = asked.join(front(firsts, cell), cell).where(F.col("credit").between(F.col("low"), F.col("high")))
    return met.groupBy("ws", "bank_id").agg(F.min(F.struct(F.lit(-points).alias("below"), "payment_id")).alias("best"))


def _levels(p: DataFrame, credits: DataFrame, known: DataFrame | None, bonus: int) -> DataFrame:
    """Each credit's best payment when all have the same `bonus`, from the highest score on: by net amounts, then by gross ones within four days, then by all others.
    Credits of `known` are met better than by gross amounts."""
    lone = p.groupBy("ws", "currency", "paid_on", "net").agg(F.min("payment_id").alias("payment_id")).withColumns({"amount": F.lit(None).cast("long"), "settlement_id": F.lit(None).cast("string")})
    pays = lone.withColumn("b", _days("paid_on")).withColumn("k", F.explode(F.sequence(F.floor((F.col("net") - CLOSE) / WIDTH), F.floor((F.col("net") + CLOSE) / WIDTH))))
    gap, net, _, points = _bank_terms()
    met = pays.join(credits.withColumns({"b": F.floor(F.unix_date("booked_on") / DAYS), "k": F.floor(F.col("credit") / WIDTH)}), ["ws", "currency", "b", "k"]).where(net & gap.between(BANK_FROM, BANK_TO))
    found = staged(met.groupBy("ws", "bank_id").agg(F.min(F.struct((-F.least(F.lit(100), points + bonus)).alias("below"), "payment_id")).alias("best")), "net")
    told = found if known is None else found.unionByName(known)
    left = credits
    for since, until, worth in ((0, 4, 60), (BANK_FROM, BANK_TO, 45)):
        left = left.join(told.select("ws", "bank_id"), ["ws", "bank_id"], "left_anti")
        told = staged(_first_gross(p, left, since, until, worth + bonus), "gross")
        found = found.unionByName(told)
    return found


def best_claims(payments: DataFrame, bank: DataFrame) -> DataFrame:
    """JN4 from the sides: the best payment of each credit that has one, the same as `claimed` over all pairs, without these. A score depends on a few facts, so each credit asks for the
    first payment by id from the highest score on: those whose settlement it names are looked up by the end of their ids; net amounts lie within a hundred; of gross amounts
    only the fronts of small cells are read. Work grows with the rows, and with the logarithm of how close they lie. Each level reads both sides, so these are staged:
    amounts that follow from others are found once."""
    p, b = (staged(rows, "claim-sides") for rows in _bank_sides(payments, bank))
    gap, net, gross, points = _bank_terms()
    ids = p.where("settlement_id != ''").withColumn("gram", F.right(F.lower("settlement_id"), F.lit(ANCHOR))).withColumn("b", _days("paid_on"))
    widths = ids.select("ws", "currency", "b", F.length("gram").alias("width")).distinct()
    texts_ = b.where("bank_reference IS NOT NULL").withColumns({"b": F.floor(F.unix_date("booked_on") / DAYS), "text": F.lower("bank_reference")}).join(widths, ["ws", "currency", "b"]).where(F.length("text") >= F.col("width"))
    grams = texts_.withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("width") + 1), lambda i: F.substr(F.col("text"), i, F.col("width"))))))
    named = grams.join(ids, ["ws", "currency", "b", "gram"]).where(gap.between(BANK_FROM, BANK_TO) & (net | gross) & F.contains("text", F.lower("settlement_id")))
    named = staged(named.groupBy("ws", "bank_id").agg(F.min(F.struct((-points).alias("below"), "payment_id")).alias("best")), "settled")
    found = named.unionByName(_levels(p, b, named, 0))
    always = p.where("settlement_id = ''")  # which every reference names
    if not always.isEmpty():
        found = found.unionByName(_levels(always, b.where("bank_reference IS NOT NULL"), None, 30))
    best = found.groupBy("ws", "bank_id").agg(F.min("best").alias("best"))
    return best.select("ws", "best.payment_id", "bank_id", (-F.col("best.below") / 100.0).alias("score"))


def payer_accounts(allocations: DataFrame, claims: DataFrame, bank: DataFrame) -> DataFrame:
    """JN11: the account that each allocated payment came from, by its bank credit with the lowest id."""
    paid = allocations.select("ws", "payment_id").distinct().join(claims.select("ws", "payment_id", "bank_id"), ["ws", "payment_id"])
    return paid.join(bank.select("ws", "bank_id", "account"), ["ws", "bank_id"]).groupBy("ws", "payment_id").agg(F.min_by("account", "bank_id").alias("account"))


def claimed(pairs: DataFrame) -> DataFrame:
    """JN4: each bank credit goes to its best payment; a payment may own several."""
    best = Window.partitionBy("ws", "bank_id").orderBy(F.desc("score"), "payment_id")
    return pairs.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def unmatched_credits(bank: DataFrame, claims: DataFrame) -> DataFrame:
    """JN5"""
    return bank.where("direction = 'credit'").join(claims.select("ws", "bank_id"), ["ws", "bank_id"], "left_anti")


def unsupported_receipts(bank: DataFrame, claims: DataFrame, material: int = 1_000_000) -> DataFrame:
    """FLT4"""
    return unmatched_credits(bank, claims).where((F.col("amount") >= material) & F.col("counterparty").isNotNull())


def refunds_of_payments(payments: DataFrame, refunds: DataFrame) -> DataFrame:
    """JN6 and AGG4: refunded sum of each payment, found by id or by the source's id (two equi joins instead of an OR), within the payment's amount."""
    by_id = refunds.where("payment_id IS NOT NULL").select("ws", "payment_id", "refund_id", "amount")
    sources = payments.select("ws", "payment_id", F.col("source_id").alias("source_payment_id"))
    by_source = refunds.select("ws", "source_payment_id", "refund_id", "amount").join(sources, ["ws", "source_payment_id"]).select("ws", "payment_id", "refund_id", "amount")
    linked = by_id.unionByName(by_source).distinct().groupBy("ws", "payment_id").agg(F.sum("amount").alias("linked"))
    joined = payments.join(linked, ["ws", "payment_id"], "left")
    return joined.select("ws", "payment_id", F.least("amount", F.greatest("amount_refunded", F.coalesce("linked", F.lit(0)))).alias("refunded"))


def distributed_refunds(allocations: DataFrame, refunded: DataFrame) -> DataFrame:
    """WIN6: a payment's refund over its invoices, in proportion to what it paid of each."""
    w = Window.partitionBy("ws", "payment_id")
    rows = allocations.join(refunded, ["ws", "payment_id"]).withColumn("back", F.least("refunded", F.sum("amount").over(w)))
    return money.largest_remainder(rows, ["ws", "payment_id"], "back", "amount", ["invoice_id"], "refund_share").drop("back", "refunded")


def invoice_outcomes(invoices: DataFrame, allocations: DataFrame, refund_shares: DataFrame, claims: DataFrame, credits: DataFrame | None = None) -> DataFrame:
    """AGG3: allocated, refunded, retained and bank-confirmed amounts of every live invoice. Each credit that a payment owns adds its allocation again, up to what is allocated."""
    owned = claims.groupBy("ws", "payment_id").agg(F.count("*").alias("n_credits"))
    lines = allocations.join(refund_shares.select("ws", "payment_id", "invoice_id", "refund_share"), ["ws", "payment_id", "invoice_id"], "left").join(owned, ["ws", "payment_id"], "left")
    sums = lines.groupBy("ws", "invoice_id").agg(F.sum("amount").alias("allocated"), F.sum("refund_share").alias("back"), F.sum(F.col("amount") * F.coalesce("n_credits", F.lit(0))).alias("seen"))
    rows = invoices.where(live(F.col("status"))).select("ws", "invoice_id", "total").join(sums, ["ws", "invoice_id"], "left").fillna(0, ["allocated", "back", "seen"])
    if credits is not None:
        rows = rows.join(credits.groupBy("ws", "invoice_id").agg(F.sum("total").alias("credit")), ["ws", "invoice_id"], "left")
    credit = F.coalesce("credit", F.lit(0)) if credits is not None else F.lit(0)
    refunded = F.least(F.col("back") + credit, F.col("allocated"))
    return rows.select(
        "ws", "invoice_id", "total", "allocated", refunded.cast("long").alias("refunded"), F.greatest(F.lit(0), F.col("allocated") - refunded).cast("long").alias("retained"),
        F.least("seen", "allocated").cast("long").alias("confirmed"), (F.col("total") - F.col("allocated")).alias("outstanding"),
    )


def totals(outcomes: DataFrame, payments: DataFrame, allocations: DataFrame) -> DataFrame:
    """AGG2: one row a workspace."""
    o = outcomes.groupBy("ws").agg(
        F.sum("total").alias("invoiced"), F.sum("allocated").alias("allocated"), F.sum("outstanding").alias("outstanding"), F.sum("refunded").alias("refunded"), F.sum("retained").alias("retained"),
        F.sum("confirmed").alias("confirmed"), F.count_if(F.col("allocated") == 0).alias("unpaid_invoices"),
    )
    ok = successful(F.col("status"))
    p = payments.groupBy("ws").agg(F.sum(F.when(ok, F.col("amount")).otherwise(0)).alias("received"), F.count_if(~ok).alias("failed_payments"))
    a = allocations.groupBy("ws").agg(F.sum("amount").alias("applied"))
    return o.join(p, "ws").join(a, "ws", "left").select(*o.columns, "failed_payments", (F.col("received") - F.coalesce("applied", F.lit(0))).alias("unapplied"))


def over_allocated(allocations: DataFrame, payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """MTH3: violations of conservation, which must be none: sums above a payment's amount or an invoice's total."""
    by = lambda key, side, limit, kind: allocations.groupBy("ws", key).agg(F.sum("amount").alias("used")).join(side.select("ws", key, F.col(limit).alias("ceiling")), ["ws", key]).where("used > ceiling").select("ws", F.lit(kind).alias("kind"), F.col(key).alias("id"), "used", "ceiling")
    return by("payment_id", payments, "amount", "payment").unionByName(by("invoice_id", invoices, "total", "invoice"))
