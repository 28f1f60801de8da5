"""Anomaly rules: each gives findings (ws, rule, severity, subject and figures); none of them accuses."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import staged
from . import members, order


def close_repeats(rows: DataFrame, keys: list[str], at: str, row_id: str, seconds: int = 86_400) -> DataFrame:
    """WIN1, A01: rows that follow one of the same key within a day."""
    w = Window.partitionBy(*keys).orderBy(at, row_id)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    seen = rows.withColumns({"previous_id": F.lag(row_id).over(w), "gap_us": gap})
    return seen.where(F.col("gap_us") <= seconds * 1_000_000).withColumn("gap_s", F.floor(F.col("gap_us") / 1_000_000)).drop("gap_us")


def running_counts(rows: DataFrame, keys: list[str], on: str, row_id: str) -> DataFrame:
    """WIN2: number of the row in its key, and days since the one before, -1 for the first."""
    w = Window.partitionBy(*keys).orderBy(on, row_id)
    return rows.withColumns({"nth": F.row_number().over(w), "days_since": F.coalesce(F.datediff(on, F.lag(on).over(w)), F.lit(-1))})


def rapid_refunds(payments: DataFrame, refunds: DataFrame, days: int = 3) -> DataFrame:
    """JN14, A02"""
    pairs = refunds.select("ws", "refund_id", "payment_id", "refunded_on", F.col("amount").alias("refund")).join(payments.select("ws", "payment_id", "paid_on"), ["ws", "payment_id"])
    return pairs.withColumn("days", F.datediff("refunded_on", "paid_on")).where(F.col("days").between(0, days)).withColumn("severity", F.lit("MEDIUM"))


def period_end_spikes(invoices: DataFrame, p1: Column, days: int = 14, least_months: int = 4, limit: float = 3.0) -> DataFrame:
    """AGG9, A03: the last days' invoices against the median month, in units of the months' median deviation (or of the median, if that is 0)."""
    late = F.col("issue_date") >= F.date_sub(p1, days)
    rows = invoices.where(F.col("issue_date") <= p1)
    months = rows.groupBy("ws", F.trunc("issue_date", "month").alias("month")).agg(F.sum("total").alias("amount"))
    middle = months.groupBy("ws").agg(F.median("amount").alias("median"), F.count("*").alias("months"))
    spread = months.join(middle, "ws").groupBy("ws", "median", "months").agg(F.median(F.abs(F.col("amount") - F.col("median"))).alias("mad"))
    window = rows.where(late).groupBy("ws").agg(F.sum("total").alias("window"))
    scored = window.join(spread, "ws").withColumn("scale", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("median")))
    scored = scored.withColumn("score", F.when(F.col("scale") > 0, (F.col("window") - F.col("median")) / F.col("scale")))
    return scored.where(F.col("months") >= least_months).withColumn("fires", F.coalesce(F.col("score") >= limit, F.lit(False)))


def one_time_as_recurring(invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """A04: one-time wording on invoices of customers whose largest one-time fee is positive."""
    fee = contracts.groupBy("ws", "customer_id").agg(F.max_by("contract_id", F.struct("one_time_amount", -F.col("contract_id"))).alias("contract_id"), F.max("one_time_amount").alias("fee")).where("fee > 0")
    return invoices.where("has_one_time_items").join(fee, ["ws", "customer_id"]).select("ws", "invoice_id", "customer_id", "contract_id", "fee", F.lit("HIGH").alias("severity"))


def future_value(contracts: DataFrame) -> DataFrame:
    """A05"""
    return contracts.where("future_period > 0").select("ws", "contract_id", "future_period", F.lit("MEDIUM").alias("severity"))


def shared_accounts(rows: DataFrame) -> DataFrame:
    """AGG11, A06: accounts that several customers pay from."""
    by = rows.groupBy("ws", "account").agg(F.countDistinct("customer_id").alias("customers"), F.slice(F.array_sort(F.collect_set("payment_id")), 1, 10).alias("examples"))
    return by.where("customers >= 2").withColumn("severity", F.when(F.col("customers") == 2, "MEDIUM").otherwise("HIGH"))


def concentrated(shares: DataFrame, limit: float = 25.0, high: float = 50.0) -> DataFrame:
    """A07, from AGG8."""
    return shares.where((F.col("rank") == 1) & (F.col("share") >= limit)).withColumn("severity", F.when(F.col("share") >= high, "HIGH").otherwise("MEDIUM"))


def churned(versioned: DataFrame, keys: list[str], limit: int = 2) -> DataFrame:
    """A08: rows of more than two versions."""
    return versioned.groupBy(*keys).agg(F.max("version").alias("versions")).where(F.col("versions") > limit).withColumn("severity", F.lit("MEDIUM"))


def refund_rates(rows: DataFrame) -> DataFrame:
    """AGG10, A09: customers whose refund rate is twice the workspace's and a quarter at least (ws, customer_id, amount, refunded). The workspace's rate joins back by its key."""
    by = rows.groupBy("ws", "customer_id").agg(F.sum("amount").alias("paid"), F.sum("refunded").alias("back")).where("paid > 0")
    rate = F.col("back") / F.col("paid")
    whole = by.groupBy("ws").agg((F.sum("back") / F.sum("paid")).alias("ws_rate"))
    return by.join(whole, "ws").withColumn("rate", rate).where(F.col("rate") >= F.greatest(2 * F.col("ws_rate"), F.lit(0.25))).withColumn("severity", F.lit("MEDIUM"))


def related_parties(labels: DataFrame, kinds: DataFrame) -> DataFrame:
    """A10: components of three nodes or more with two customers or more."""
    by = labels.join(kinds, "node").groupBy("label").agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "customer").alias("customers"))
    return by.where("nodes >= 3 AND customers >= 2").withColumn("severity", F.lit("MEDIUM"))


#: Letters of the grams that names are found by, and names of a gram that one task compares with.
GRAM, BUCKET = 4, 5000


def _grams(rows: DataFrame, size: int, keep: list[str]) -> DataFrame:
    starts = F.sequence(F.lit(1), F.length("name") - size + 1)
    return rows.where(F.length("name") >= size).select(*keep, F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("name", i, F.lit(size))))).alias("gram"))


def contained_names(rows: DataFrame) -> DataFrame:
    """Pairs (ws, inner, outer) of different names (ws, name) of which one stands in the other. A name that holds another holds all its grams, so each name
    is looked up by its rarest one alone; names below `GRAM` letters by themselves, among the grams of their length. A gram of many names is dealt into
    buckets, so no task meets all of them."""
    names = staged(rows.select("ws", "name").where("name != ''").distinct(), "names")
    found = None
    for size in range(1, GRAM + 1):  # the lengths below GRAM hold only as many different names as there are grams of that length
        inner = names.where(F.length("name") == size) if size < GRAM else names.where(F.length("name") >= size)
        outer = _grams(names, size, ["ws", "name"])
        if size < GRAM:
            outer = outer.join(inner.select("ws", F.col("name").alias("gram")), ["ws", "gram"], "left_semi")
        outer = staged(outer, "grams")
        counts = outer.groupBy("ws", "gram").agg(F.count("*").alias("n"))
        mine = _grams(inner, size, ["ws", "name"]).join(counts, ["ws", "gram"])
        rarest = mine.groupBy("ws", F.col("name").alias("inner")).agg(F.min(F.struct("n", "gram")).alias("r")).select("ws", "inner", "r.gram", "r.n")
        parts = F.ceil(F.col("n") / BUCKET).cast("int")
        asked = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = outer.join(counts, ["ws", "gram"]).select("ws", "gram", F.col("name").alias("outer"), F.pmod(F.xxhash64("name"), parts).cast("int").alias("part"))
        pairs = asked.join(dealt, ["ws", "gram", "part"]).where((F.col("inner") != F.col("outer")) & F.contains("outer", F.col("inner"))).select("ws", "inner", "outer")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _named(rows: DataFrame, key: str) -> DataFrame:
    from ..functions import names

    return rows.select("ws", F.col(key).alias("id"), names.normalize_name(F.col("name")).alias("name")).where("name != ''").dropDuplicates(["ws", "id"])


def contained_parties(rows: DataFrame, key: str) -> DataFrame:
    """JN15: pairs of ids where one normalised name stands in another, or is the same."""
    n = staged(_named(rows, key), "named")
    links = contained_names(n).unionByName(n.groupBy("ws", "name").count().where("count > 1").select("ws", F.col("name").alias("inner"), F.col("name").alias("outer")))
    return members.member_pairs(links, n.select("ws", F.col("name").alias("head"), "id")).withColumnsRenamed({"l": "a", "r": "b"})


def name_groups(rows: DataFrame, key: str) -> DataFrame:
    """A13: ids (ws, id, name) whose names are linked by containment, with their group's first name and how many names it has."""
    from . import graph

    n = staged(_named(rows, key), "named")
    node = lambda c: F.concat(F.col("ws").cast("string"), F.lit("|"), F.col(c))
    links = staged(contained_names(n).select(node("inner").alias("u"), node("outer").alias("v")), "name-links")
    labels = graph.components(links)
    sized = labels.groupBy("label").agg(F.count("*").alias("names"), F.min("node").alias("first"))
    told = labels.join(sized, "label").select(F.col("node"), "names", F.regexp_replace("first", r"^[^|]*\|", "").alias("group_name"))
    return n.withColumn("node", node("name")).join(told, "node").select("ws", "id", "name", "group_name", "names")


#: Days that a debit and its refund may lie apart.
REFUND_DAYS = 7


def matched_debits(debits: DataFrame, refunds: DataFrame) -> DataFrame:
    """JN13: each debit, by day and id, takes the first open refund of its amount within 7 days, else one without a date; a refund is taken once.

    Days come in order and all windows have the same length, so refunds are taken in order too: which debits of a day meet which refunds follows from how many there are on
    each day. So only counts by day, as many as the calendar has, are walked for a workspace and an amount; rows meet by their numbers, however many share an amount.
    What finds no refund with a date meets the ones without, again number by number."""
    key = ["ws", "amount"]
    d = debits.select(*key, "debit_id", "booked_on")
    r = refunds.select(*key, "refund_id", "refunded_on")
    dated = order.numbered(d.where("booked_on IS NOT NULL"), [*map(F.col, (*key, "booked_on", "debit_id"))], [*key, "booked_on"], "nth")
    open_ = order.numbered(r.where("refunded_on IS NOT NULL"), [*map(F.col, (*key, "refunded_on", "refund_id"))], key, "nth")
    by_day = dated.groupBy(*key, F.col("booked_on").alias("day")).agg(F.count("*").alias("debits")).withColumn("refunds", F.lit(0).cast("long"))
    by_day = by_day.unionByName(open_.groupBy(*key, F.col("refunded_on").alias("day")).agg(F.count("*").alias("refunds")).withColumn("debits", F.lit(0).cast("long")))
    by_day = by_day.groupBy(*key, "day").agg(F.sum("debits").alias("debits"), F.sum("refunds").alias("refunds"))
    kinds = dict(debits.dtypes)

    def walk(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("day")
        at = np.asarray(pd.to_datetime(days["day"]).values.astype("datetime64[D]").astype(np.int64))
        past = np.concatenate([[0], np.cumsum(days["refunds"].to_numpy(np.int64))])  # refunds before each day
        first = past[np.searchsorted(at, at - REFUND_DAYS, "left")]
        last = past[np.searchsorted(at, at + REFUND_DAYS, "right")]
        taken, out = 0, []
        for k, n in enumerate(days["debits"].to_numpy(np.int64)):
            start = max(taken, int(first[k]))
            met = min(int(n), max(0, int(last[k]) - start))
            if n:
                out.append((start, met))
            taken = max(taken, start + met) if met else taken
        some = days[days["debits"] > 0]
        return some[[*key, "day"]].assign(start=[o[0] for o in out], met=[o[1] for o in out])

    plan = by_day.groupBy(*key).applyInPandas(walk, f"ws {kinds['ws']}, amount {kinds['amount']}, day date, start long, met long").withColumnRenamed("day", "booked_on")
    placed = staged(dated.join(plan, [*key, "booked_on"]).withColumn("seat", F.when(F.col("nth") <= F.col("met"), F.col("start") + F.col("nth"))), "placed")
    with_date = placed.where("seat IS NOT NULL").join(open_.withColumnRenamed("nth", "seat"), [*key, "seat"]).select(*key, "debit_id", "refund_id")
    left = placed.where("seat IS NULL").select(*key, "debit_id", "booked_on").unionByName(d.where("booked_on IS NULL"))
    left = order.numbered(left, [*map(F.col, key), F.col("booked_on").asc_nulls_last(), F.col("debit_id")], key, "seat")
    free = order.numbered(r.where("refunded_on IS NULL"), [*map(F.col, (*key, "refund_id"))], key, "seat")
    return with_date.unionByName(left.join(free, [*key, "seat"]).select(*key, "debit_id", "refund_id"))


def fingerprints(findings: DataFrame) -> DataFrame:
    """SET2: findings once each, by rule and sorted record references."""
    key = F.sha2(F.concat_ws("|", "rule", F.array_join(F.array_sort("records"), ",")), 256)
    return findings.withColumn("fingerprint", key).dropDuplicates(["ws", "fingerprint"])


def rescanned(previous: DataFrame, now: DataFrame) -> DataFrame:
    """SET3 and SET4: verdicts outlive a scan; findings that no longer fire go, unless somebody has labelled them."""
    p = previous.select("ws", "fingerprint", F.col("status").alias("was"), F.lit(True).alias("before"))
    n = now.select("ws", "fingerprint", F.lit(True).alias("fires"))
    both = p.join(n, ["ws", "fingerprint"], "full")
    status = F.coalesce("was", F.lit("OPEN"))
    kept = both.where(F.coalesce("fires", F.lit(False)) | (status != "OPEN"))
    return kept.select("ws", "fingerprint", status.alias("status"), F.coalesce("fires", F.lit(False)).alias("fires"), F.coalesce("before", F.lit(False)).alias("known"))


def precision(labelled: DataFrame) -> DataFrame:
    """AGG14: confirmed share of each rule's labelled findings; the model's rule is switched off by ten labels and under a half right."""
    by = labelled.groupBy("rule").agg(F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("status").isin("CONFIRMED", "DISMISSED")).alias("labelled"))
    p = F.round(F.col("confirmed") / F.nullif(F.col("labelled"), F.lit(0)), 3)
    return by.withColumn("precision", p).withColumn("enabled", ~((F.col("rule") == "A12") & (F.col("labelled") >= 10) & (F.col("precision") < 0.5)))


#: What a payment is judged by.
FEATURES = ("amount", "refund_ratio", "hour", "day_of_month", "days_since", "nth")
# Share of outliers, trees, seed, and payments without which a workspace has no model.
OUTLIERS, TREES, SEED, LEAST_ROWS = 0.05, 200, 20260401, 50
#: Payments of a workspace that the forest is grown from: a bounded sample, taken by a hash.
GROWN_FROM = 20_000


def features(rows: DataFrame) -> DataFrame:
    """ws, payment_id, paid_at and the FEATURES of payments with an amount (amount, amount_refunded, paid_at, days_since, nth)."""
    return rows.where("amount > 0 AND paid_at IS NOT NULL").select(
        "ws", "payment_id", "paid_at", F.col("amount").cast("double").alias("amount"), (F.col("amount_refunded").cast("double") / F.col("amount")).alias("refund_ratio"), F.hour("paid_at").alias("hour"),
        F.dayofmonth("paid_at").alias("day_of_month"), F.col("days_since").cast("double").alias("days_since"), F.col("nth").cast("double").alias("nth"),
    )


def usual(m: int) -> float:
    """Mean path length of an unsuccessful search among m rows."""
    return 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else float(m == 2)


def grown(x: np.ndarray, trees: int = TREES, size: int = 256, seed: int = SEED) -> tuple[int, list[list[tuple]]]:
    """An isolation forest: for each tree its nodes as (feature, cut, left, right), or (-1, depth and usual path below it, 0, 0) for a leaf."""
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    deepest = math.ceil(math.log2(max(size, 2)))
    forest = []
    for _ in range(trees):
        nodes: list[tuple] = [()]
        work = [(0, rng.choice(len(x), size, replace=False), 0)]
        while work:
            at, sample, d = work.pop()
            low, high = (x[sample].min(axis=0), x[sample].max(axis=0)) if len(sample) else (0, 0)
            wide = np.flatnonzero(high > low) if len(sample) > 1 else []
            if d >= deepest or not len(wide):
                nodes[at] = (-1, d + usual(len(sample)), 0, 0)
                continue
            f = int(rng.choice(wide))
            cut = float(rng.uniform(low[f], high[f]))
            nodes[at] = (f, cut, len(nodes), len(nodes) + 1)
            nodes += [(), ()]
            work.append((nodes[at][2], sample[x[sample, f] < cut], d + 1))
            work.append((nodes[at][3], sample[x[sample, f] >= cut], d + 1))
        forest.append(nodes)
    return size, forest


def isolation_scores(x: np.ndarray, model: tuple[int, list[list[tuple]]]) -> np.ndarray:
    """2 to the minus of the mean path length over what it would be by chance."""
    size, forest = model
    depth = np.zeros(len(x))
    for nodes in forest:
        feature, value, left, right = (np.array(c) for c in zip(*nodes))
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            n = at[inner]
            at[inner] = np.where(x[inner, feature[n]] < value[n], left[n], right[n])
        depth += value[at]
    return 2.0 ** (-depth / len(forest) / max(usual(size), 1e-9))


def _forests(rows: DataFrame) -> dict:
    """A forest for each workspace with enough payments, with its version; they are grown in Spark, one task each, from bounded samples, and sent to the driver: as many as workspaces."""
    sample = order.numbered(rows, [F.col("ws"), F.xxhash64("payment_id"), F.col("payment_id")], ["ws"], "_n").where(F.col("_n") <= GROWN_FROM)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("payment_id")[list(FEATURES)].to_numpy(float)
        if len(x) < LEAST_ROWS:
            return pd.DataFrame([], columns=["ws", "version", "forest"], dtype=object)
        version = f"isolation-forest/c{OUTLIERS}/t{TREES}/{hashlib.sha256(np.round(x, 4).tobytes()).hexdigest()[:12]}"
        return pd.DataFrame({"ws": [group.ws.iloc[0]], "version": [version], "forest": [pickle.dumps(grown(x))]})

    made = sample.groupBy("ws").applyInPandas(grow, f"ws {dict(rows.dtypes)['ws']}, version string, forest binary").collect()
    return {r["ws"]: (r["version"], bytes(r["forest"])) for r in made}


def _scored(rows: DataFrame, forests: dict) -> DataFrame:
    """rows of workspaces that have a forest, with score and version: a map, whatever a workspace's size."""
    sent = rows.sparkSession.sparkContext.broadcast(forests)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {w: (v, pickle.loads(f)) for w, (v, f) in sent.value.items()}
        for batch in batches:
            for w, group in batch.groupby("ws", sort=False):
                if w in models:
                    yield group.assign(score=isolation_scores(group[list(FEATURES)].to_numpy(float), models[w][1]), version=models[w][0])

    return rows.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in rows.columns), "score double, version string"]))


def outliers(rows: DataFrame) -> DataFrame:
    """MLF, A12: every payment's isolation score, whether it is among the workspace's `OUTLIERS` most isolated, the model's version, and the feature
    that lies furthest from the workspace's median. Workspaces of under `LEAST_ROWS` payments have none."""
    scored = _scored(rows, _forests(rows))
    bound = scored.groupBy("ws").agg(F.percentile_approx("score", 1 - OUTLIERS, 10_000).alias("bound"), *(F.percentile_approx(c, 0.5, 10_000).alias(f"m_{c}") for c in FEATURES))
    off = F.array(*(F.struct(F.abs(F.col(c) - F.col(f"m_{c}")).alias("off"), F.lit(c).alias("feature")) for c in FEATURES))
    told = scored.join(F.broadcast(bound), "ws")  # a row a workspace
    return told.select("ws", "payment_id", "score", (F.col("score") > F.col("bound")).alias("outlier"), F.array_max(off)["feature"].alias("driver"), "version")


def drift(rows: DataFrame) -> DataFrame:
    """A12's check over time: forests of each fold's earlier payments judge its later ones; the share of outliers by workspace and fold, and whether shares differ
    by more than twice the expected one. Folds are equal steps of the payments' rank in time."""
    sizes = rows.groupBy("ws").agg(F.count("*").alias("_n"))
    ranked = order.numbered(rows, [F.col("ws"), F.col("paid_at"), F.col("payment_id")], ["ws"], "_k").join(F.broadcast(sizes), "ws")  # a row a workspace
    ranked = ranked.withColumn("_r", F.coalesce((F.col("_k") - 1) / F.nullif(F.col("_n") - 1, F.lit(0)), F.lit(0.0)))
    ranked = staged(ranked.withColumn("_f", folds(F.col("_n"))).withColumn("_slot", F.least(F.floor(F.col("_r") * (F.col("_f") + 1)), F.col("_f")).cast("int")), "ranked")
    parts = None
    for fold in range(5):
        past, now = ranked.where(F.col("_slot") <= fold).select(*rows.columns), ranked.where((F.col("_slot") == fold + 1) & (F.lit(fold) < F.col("_f"))).select(*rows.columns)
        forests = _forests(past)
        bound = _scored(past, forests).groupBy("ws").agg(F.percentile_approx("score", 1 - OUTLIERS, 10_000).alias("bound"))
        part = _scored(now, forests).join(F.broadcast(bound), "ws").groupBy("ws").agg(F.lit(fold).alias("fold"), F.count("*").alias("tested"), F.round(F.avg((F.col("score") > F.col("bound")).cast("int")), 4).alias("flagged_rate"))
        parts = part if parts is None else parts.unionByName(part)
    spread = F.max("flagged_rate").over(Window.partitionBy("ws")) - F.min("flagged_rate").over(Window.partitionBy("ws"))
    return parts.withColumn("drift_suspected", spread > 2 * OUTLIERS)


def folds(n: Column) -> Column:
    """WIN12: number of expanding-window folds for n rows."""
    return F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / 20))).cast("int")
