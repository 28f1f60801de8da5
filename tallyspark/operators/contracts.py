"""Contracts: allocation to a period, amendments, citations and clauses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import money, names, texts
from ..sources.shared import staged

LEAST_CLAUSE, CLAUSE_WINDOW = 20, 1800
PER_ASPECT, MAX_CLAUSES = 3, 14


def allocated_to_period(contracts: DataFrame, p0: Column, p1: Column) -> DataFrame:
    """DT3 over a contract table."""
    c = money.period_allocation(F.col("start_date"), F.col("end_date"), F.col("recurring_amount"), F.col("one_time_amount"), F.col("billing_frequency"), p0, p1)
    return contracts.withColumns({"rule": c["rule"], "in_period": c["in_period"], "future_period": c["future_period"], "annualised": c["annualised"]})


def amended(contracts: DataFrame, keys: list[str]) -> DataFrame:
    """JN18: each amendment with the latest original of its group that began by its effective date; a range join, then the latest."""
    originals = contracts.where("NOT is_amendment").select(*keys, F.col("contract_id").alias("original_id"), F.col("start_date").alias("original_start"))
    amendments = contracts.where("is_amendment").select(*keys, "contract_id", F.coalesce("effective_from", "start_date").alias("effective"))
    pairs = amendments.join(originals, keys).where("original_start <= effective")
    return pairs.groupBy(*keys, "contract_id", "effective").agg(F.max_by("original_id", F.struct("original_start", "original_id")).alias("original_id"))


def citations(cited: DataFrame, pages: DataFrame, shortest: int = 8) -> DataFrame:
    """STR11: whether each quote (contract_id, field, value, page, quote) stands in its contract, with the page and its place in the normalised page.

    A quote that stands on another page is genuine, so its page is put right: the lowest one is taken. A short quote counts only if it holds the value that it
    cites, and only on the page cited. Citations without page or quote are none.
    """
    key = lambda c: texts.normalize_quote(F.coalesce(c, F.lit("")))
    p = pages.where("text IS NOT NULL").select("contract_id", F.col("page").alias("found_page"), texts.normalize_quote(F.col("text")).alias("page_text"))
    q = cited.where("page IS NOT NULL AND quote != ''").withColumns({"quote_key": texts.normalize_quote(F.col("quote")), "value_key": key(F.col("value"))})
    short = F.length("quote_key") < shortest
    vague = (short & ((F.col("value_key") == "") | ~F.contains("quote_key", F.col("value_key")))) | (F.length("quote_key") < 2)
    q = q.withColumns({"short": short, "vague": vague})
    hits = q.where("NOT vague").join(p, "contract_id").where(F.contains("page_text", F.col("quote_key")) & (~F.col("short") | (F.col("found_page") == F.col("page"))))
    place = hits.withColumn("pos", F.instr("page_text", F.col("quote_key")) - 1)
    best = place.groupBy("contract_id", "field").agg(F.min_by(F.struct("found_page", "pos"), F.struct((F.col("found_page") != F.col("page")).alias("other"), "found_page")).alias("hit"))
    out = q.join(best, ["contract_id", "field"], "left")
    found = F.col("hit").isNotNull()
    note = F.when(F.col("vague"), "too_short").when(~found & F.col("short"), "short_not_on_page").when(~found, "not_found").when(F.col("hit.found_page") != F.col("page"), "other_page").otherwise("verified")
    return out.select(
        "contract_id", "field", F.coalesce("hit.found_page", "page").alias("page"), note.alias("note"), found.alias("verified"), F.col("hit.pos").alias("span_start"),
        (F.col("hit.pos") + F.length("quote_key")).alias("span_end"),
    )


def aligned_keys(contracts: DataFrame, invoices: DataFrame) -> DataFrame:
    """JN12: the invoices' key of each contract key (key, core): the same one, else the only invoice key with the contract's core."""
    own = contracts.select("key", "core").distinct()
    other = invoices.select("key", "core").distinct()
    alone = other.groupBy("core").agg(F.min("key").alias("other"), F.count("*").alias("n")).where("n = 1").drop("n")
    both = own.join(other.select("key", F.lit(True).alias("same")), "key", "left").join(alone, "core", "left")
    return both.select(F.col("key").alias("contract_key"), F.when(F.col("same"), F.col("key")).otherwise(F.col("other")).alias("aligned"))


def clauses(pages: DataFrame) -> DataFrame:
    """STR14: passages of pages (doc_id, page, text), cut at headings, then into windows; pieces of under 20 signs are no clauses."""
    import re

    heading = re.compile(texts.CLAUSE_HEADING.replace("(?im)", ""), re.I | re.M)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, page, text in zip(batch.doc_id, batch.page, batch.text):
                text = text or ""
                if not text.strip():
                    continue
                edges = sorted({0, len(text), *(m.start() for m in heading.finditer(text))})
                n = 0
                for a, b in zip(edges, edges[1:]):
                    part = text[a:b].strip()
                    for k in range(0, len(part), CLAUSE_WINDOW) if len(part) >= LEAST_CLAUSE else ():
                        piece = part[k : k + CLAUSE_WINDOW]
                        if len(piece) >= LEAST_CLAUSE:
                            rows.append((doc, page, n, piece.split("\n", 1)[0][:120].strip(), piece, a + k, a + k + len(piece)))
                            n += 1
            yield pd.DataFrame(rows, columns=["doc_id", "page", "n", "heading", "text", "start", "stop"])

    kind = dict(pages.dtypes)
    return pages.select("doc_id", "page", "text").mapInPandas(run, f"doc_id {kind['doc_id']}, page {kind['page']}, n int, heading string, text string, start int, stop int")


def retrieved(found: DataFrame) -> DataFrame:
    """SRT2: the best clauses of each aspect, their union cut to the best ones, in the document's order."""
    scored = found.select("doc_id", "page", "n", F.explode(F.array(*(F.struct(F.lit(a).alias("aspect"), texts.clause_score(F.col("text"), F.col("heading"), a).alias("score")) for a in texts.CLAUSE_TERMS))).alias("s")).select("doc_id", "page", "n", "s.*").where("score > 0")
    by_aspect = Window.partitionBy("doc_id", "aspect").orderBy(F.desc("score"), "page", "n")
    top = scored.withColumn("r", F.row_number().over(by_aspect)).where(F.col("r") <= PER_ASPECT).groupBy("doc_id", "page", "n").agg(F.max("score").alias("score"))
    all_ = Window.partitionBy("doc_id").orderBy(F.desc("score"), "page", "n")
    return top.withColumn("r", F.row_number().over(all_)).where(F.col("r") <= MAX_CLAUSES).drop("r")


def first_contracts(contracts: DataFrame, key: str) -> DataFrame:
    """The first contract by id of each key."""
    w = Window.partitionBy("ws", key).orderBy("contract_id")
    return contracts.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def contract_of_invoice(invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """JN7: by resolved customer, else by normalised name."""
    by_id = first_contracts(contracts, "customer_id").select("ws", "customer_id", F.col("contract_id").alias("c1"))
    by_name = first_contracts(contracts, "name_key").select("ws", "name_key", F.col("contract_id").alias("c2"))
    return invoices.join(by_id, ["ws", "customer_id"], "left").join(by_name, ["ws", "name_key"], "left").withColumn("contract_id", F.coalesce("c1", "c2")).drop("c1", "c2")


#: What tells an invoice's customer.
PARTY = ["ws", "customer_id", "customer_name"]


def contract_of_party(invoices: DataFrame, contracts: DataFrame) -> DataFrame:
    """JN7 for each customer and name that invoices have, with the contract's other columns, staged. A name is normalised once, not for every invoice; contracts are dealt over
    the tasks before that, as their files are small for what they hold, and aren't broadcast."""
    key = names.normalize_name(F.col("customer_name"))
    held = contracts.repartition("ws", "contract_id")
    parties = contract_of_invoice(invoices.select(*PARTY).distinct().withColumn("name_key", key), held.select(*PARTY, "contract_id").withColumn("name_key", key)).drop("name_key")
    facts = held.drop("customer_id", "customer_name")
    return staged(parties.join(facts.hint("merge"), ["ws", "contract_id"], "left") if len(facts.columns) > 2 else parties, "parties")


def of_parties(invoices: DataFrame, parties: DataFrame) -> DataFrame:
    """Invoices with what `contract_of_party` found for their customers and names, which may be null."""
    p = parties.withColumnsRenamed({c: f"_{c}" for c in PARTY})
    return invoices.join(p.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PARTY], "left").drop(*(f"_{c}" for c in PARTY))
