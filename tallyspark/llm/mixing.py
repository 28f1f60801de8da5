"""Mixing of sources to target weights by systematic sampling.

Every document has an expected number of copies. Within a source these are summed up in an order by falling size; a random offset is added to the sums; and a
document is emitted once for each integer that its stretch of the sums crosses. So a document is taken floor or ceil of its expectation times, and what one document
takes too much, its neighbours of nearly the same size take less.

Sizes differ widely, so a source is sampled by octaves of size, each with an offset of its own, from documents of over half the source's size down to those
of at most 1 / 2 ** `OCTAVES` of it. The expectation in an octave is what the target still lacks over what is left, so whatever the long documents of an octave took too much
or too little is made up for by shorter ones; at most 2. A source's taken words miss its target by about its smallest documents' size, unless nothing short is left. Octaves before the last
hold less than 2 ** `OCTAVES` documents of a source together, so they are handled in one task a source; the last one, however large, is numbered over a range-partitioned
table. Positions are fixed-point integers, so nothing depends on how numbers are rounded.

Nulls: a null text has size 0; null sources are one source, the last; a null id is passed on. Empty and blank texts have size 0 too. A very long text counts whole, as one document.
Ties: equal sizes are ordered by id, then by the text's hash; equal rows are interchangeable. Repeated rows are documents each. A source without words has target 0 and takes nothing.
An empty table gives an empty result. Extra columns are ignored by `planned`, kept by `emitted`.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common as C, vectors as V

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), Fraction(3, 2), 2, 20
OCTAVES = 10
#: Bits behind the point of positions.
POINT = 24


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target of each source of `sizes` (source, size). All sources share `share` of all sizes by weight; a target above `most` times its
    source's size stops there, and what is over is shared anew among the others, until none is above."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*map(F.lit, weights))
    order = [F.col("source").isNull(), F.col("source")]
    sums = C.staged(C.numbered(sums.withColumn("one", F.lit(1)), [F.col("one"), *order], ["one"]).select("source", "source_size", cycle[((F.col("number") - 1) % len(weights)).cast("int")].cast("long").alias("weight")), "source-sizes")
    total = (sums.agg(F.sum("source_size")).first()[0] or 0) * share
    level, cap = None, F.col("source_size") * most
    while True:  # the level only rises, and each round stops one source more at least
        over = F.lit(False) if level is None else cap.cast("decimal(38,0)") * level.denominator < F.col("weight") * F.lit(level.numerator).cast("decimal(38,0)")
        taken, left = sums.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        now = (total - (taken or 0)) / left if left else level
        if now == level or now is None:
            break
        level = now
    if level is None:
        return sums.select("source", "source_size", F.lit(0.0).alias("target"))
    target = F.when(over, cap.cast("double")).otherwise((F.col("weight") * level.numerator).cast("double") / F.lit(float(level.denominator)))
    return sums.select("source", "source_size", target.alias("target"))


def offset(seed: int, source: Column, octave: Column) -> Column:
    """The random offset of an octave, in units of 2 ** -POINT."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(source, F.lit("")), source.isNull(), octave), F.lit(1 << POINT))


def crossed(number: Column, rate: Column, start: Column) -> Column:
    """Integers crossed by the stretch of the document with this number."""
    return F.shiftright(start + number * rate, POINT) - F.shiftright(start + (number - 1) * rate, POINT)


def rate_of(lacking: float, left: int, most: int) -> int:
    return round(min(max(lacking / left, 0.0), float(most)) * (1 << POINT)) if left else 0


def long_copies(most: int):
    """Copies of a source's long documents, octave by octave; with the words they have and take."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["octave", "size", "doc_id", "text_hash"], ascending=[True, False, True, True], na_position="last", kind="stable")
        target, left = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
        copies, taken = [], 0
        for _, group in rows.groupby("octave", sort=True):
            rate, start = rate_of(target - taken, left, most), int(group["start"].iloc[0])
            sizes = group["size"].tolist()
            found = [((start + k * rate) >> POINT) - ((start + (k - 1) * rate) >> POINT) for k in range(1, len(sizes) + 1)]
            copies += found
            taken += sum(c * s for c, s in zip(found, sizes))
            left -= sum(sizes)
        return rows.assign(copies=copies)[["doc_id", "source", "size", "source_size", "target", "text_hash", "copies"]]

    return run


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, text_hash and copies of every document."""
    columns = "doc_id long, source string, size long, source_size long, target double, text_hash long, copies long"
    rows = C.staged(docs.select(F.col("doc_id").cast("long"), "source", words().alias("size"), F.xxhash64("text").alias("text_hash")), "sized")
    aims = C.staged(targets(rows, weights, share, most), "targets")
    rows = V.with_side(rows, aims, "source")
    # octave k holds sizes above source_size / 2 ** (k + 1), the last one all that is left
    octave = F.expr(f"aggregate(sequence(0, {OCTAVES - 1}), {OCTAVES}, (found, k) -> CASE WHEN size > 0 AND size * shiftleft(2L, k) > source_size THEN least(found, k) ELSE found END)")
    rows = rows.withColumn("octave", octave).withColumn("start", offset(seed, F.col("source"), F.col("octave")))
    long = C.staged(rows.where(F.col("octave") < OCTAVES).groupBy("source").applyInPandas(long_copies(most), columns), "long-documents")
    done = long.groupBy("source").agg(F.sum("size").alias("done"), F.sum(F.col("copies") * F.col("size")).alias("taken"))
    lacking, left = F.col("target") - F.coalesce(F.col("taken"), F.lit(0)), F.col("source_size") - F.coalesce(F.col("done"), F.lit(0))
    rate = F.when(left > 0, F.round(F.least(F.greatest(lacking / left, F.lit(0.0)), F.lit(float(most))) * (1 << POINT))).otherwise(0).cast("long")
    rates = aims.alias("a").join(done.alias("d"), F.col("a.source").eqNullSafe(F.col("d.source")), "left").select(F.col("a.source").alias("source"), rate.alias("rate"))
    order = [F.col("source"), F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash")]
    short = C.numbered(rows.where(F.col("octave") == OCTAVES).drop("octave"), order, ["source"])
    short = V.with_side(short, C.staged(rates, "rates"), "source").withColumn("copies", crossed(F.col("number"), F.col("rate"), F.col("start")))
    return long.unionByName(short.select(*long.columns))


def emitted(plan: DataFrame, docs: DataFrame) -> DataFrame:
    """The mix: each row of `docs` as often as the plan says. Equal ids are told apart by their texts; of equal rows each is emitted its share of their copies."""
    sums = plan.groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    keys = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source"), "text_hash": F.xxhash64("text")}
    same = [keys[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    side = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), "__copies", "__rows")
    first = F.row_number().over(Window.partitionBy("__doc_id", "__source", "__text_hash").orderBy(F.monotonically_increasing_id()))
    found = docs.join(side, same).withColumn("__place", first)
    share = F.expr("__copies * __place div __rows - __copies * (__place - 1) div __rows").cast("int")
    return found.withColumn("__copy", F.explode(F.when(share > 0, F.sequence(F.lit(1), share)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planned(C.table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
