"""Validation, quarantine, versions and upserts of evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def checks(rules: dict[str, Column]) -> Column:
    """PRJ7: the messages of the rules that fail; a rule holds while its condition isn't true."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(message)) for message, condition in rules.items())))


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows with the errors that they have."""
    checked = rows.withColumn("errors", checks(rules))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def quarantine_reason(error: Column) -> Column:
    """PRJ8: the first kind that the message speaks of."""
    text = F.lower(error)
    has = lambda *words: text.rlike("|".join(words))
    return (
        F.when(has("missing", "required"), "missing_field").when(has("currency"), "bad_currency").when(has("amount", "total", "decimal", "minor"), "bad_amount")
        .when(has("date", "time"), "bad_date").otherwise("schema")
    )


def versions(rows: DataFrame, keys: list[str], order: list[str], content: str, row_id: str) -> DataFrame:
    """WIN4: a row is a new version only if its content differs from every earlier one of its key (A, B, A makes two).
    Adds version and superseded_by; rows with content seen before are dropped."""
    seen = Window.partitionBy(*keys, content).orderBy(*order)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("_seen", F.row_number().over(seen)).where("_seen = 1").drop("_seen")
    return first.withColumn("version", F.row_number().over(by_key)).withColumn("superseded_by", F.lead(row_id).over(by_key))


def current(rows: DataFrame) -> DataFrame:
    """FLT3"""
    return rows.where(F.col("superseded_by").isNull())


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SNK1: the newest row of each natural key; incoming rows win over existing ones."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(F.desc(c) for c in order))
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new")


def near_duplicates(rows: DataFrame, keys: list[str], order: list[str], row_id: str) -> DataFrame:
    """WIN3: the first row of a bucket with each later one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumns({"first_id": F.first(row_id).over(w), "_n": F.row_number().over(w)})
    return marked.where("_n > 1").select(*keys, "first_id", F.col(row_id).alias("later_id"))


def chained_hash(previous: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("genesis")), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def broken_links(log: DataFrame, keys: list[str], sequence: str, stored_hash: str, parts: list[str]) -> DataFrame:
    """WIN9: the first broken row of each chain: a gap in the sequence, or a hash that the stored one before doesn't give."""
    w = Window.partitionBy(*keys).orderBy(sequence)
    previous, before = F.lag(stored_hash).over(w), F.lag(sequence).over(w)
    seen = log.withColumns({"_gap": F.col(sequence) != F.coalesce(before + 1, F.lit(0)), "_bad": F.col(stored_hash) != chained_hash(previous, *(F.col(p) for p in parts))})
    reason = F.when(F.col("_gap"), "sequence_gap").otherwise("hash_mismatch")
    return seen.where("_gap OR _bad").groupBy(*keys).agg(F.min(sequence).alias("broken_at"), F.min_by(reason, sequence).alias("reason"))
