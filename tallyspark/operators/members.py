"""Pairs of rows that follow from pairs of the groups they are in."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import staged

#: Members of a group that are held in one row; two such rows give at most the square of it.
BLOCK = 1000


def member_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links (ws, inner, outer and more) of groups as pairs (ws, l, r and more) of their members (ws, head, id), l below r, each once if each link is there once and each id is in one group; a group linked
    with itself gives the pairs among its members. Members travel as lists of a bounded length, so links and lists are all that is shuffled, and the pairs are made where they are
    used. Lists are dealt evenly, however few links there are and however large a group is."""
    spark = members.sparkSession
    more = [c for c in links.columns if c not in ("ws", "inner", "outer")]
    members = members.where("id IS NOT NULL")
    sized = members.groupBy("ws", "head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sized, ["ws", "head"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    lists = staged(dealt.groupBy("ws", "head", "block").agg(F.collect_list("id").alias("ids")), "member-lists")
    side = lambda head, s: lists.select("ws", F.col("head").alias(head), F.col("block").alias(f"block_{s}"), F.col("ids").alias(f"ids_{s}"))
    met = links.join(side("inner", "a"), ["ws", "inner"]).join(side("outer", "b"), ["ws", "outer"])
    met = met.where((F.col("inner") != F.col("outer")) | (F.col("block_a") <= F.col("block_b"))).withColumn("itself", (F.col("inner") == F.col("outer")) & (F.col("block_a") == F.col("block_b")))
    even = met.drop("inner", "outer", "block_a", "block_b").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    pairs = even.select("ws", "itself", "ids_b", *more, F.explode("ids_a").alias("x")).select("ws", "itself", "x", *more, F.explode("ids_b").alias("y")).where(~F.col("itself") | (F.col("x") < F.col("y")))
    return pairs.select("ws", F.least("x", "y").alias("l"), F.greatest("x", "y").alias("r"), *more)
