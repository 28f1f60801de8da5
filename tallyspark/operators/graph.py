"""Components, cycles and neighbourhoods of edge tables (u, v)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import shared_dir, staged


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Edges between merged nodes that one task follows to the end.
LAST = 200_000


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and to, the lowest node that it is connected with, of nodes that aren't the lowest themselves."""
    parent: dict = {}
    kind = None

    def top(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(u), top(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array([*parent], kind), pa.array([top(x) for x in [*parent]], kind)], ["node", "to"])


def components(edges: DataFrame) -> DataFrame:
    """GRA1: node and label, the lowest node of its weakly connected component.

    Each node joins its lowest neighbour, if that is lower, and what hangs together so becomes one node, the lowest. A node that nothing joins and that joins nothing has a lower neighbour in the next round, so
    nodes halve in two rounds, and chains end in as many steps as their length has digits. The last `LAST` edges are followed in one task."""
    kind = dict(edges.dtypes)["u"]
    pair = lambda rows: rows.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    labels = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
    left = staged(pair(edges), "edges")
    while count := left.count():
        if count <= LAST:
            up = staged(left.select("u", "v").repartition(1).mapInArrow(_rooted, f"node {kind}, to {kind}"), "joined")
        else:
            up = staged(left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("to")), "joined")
            while True:
                up = staged(up.join(up.select(F.col("node").alias("to"), F.col("to").alias("on")), "to", "left").select("node", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")), "joined")
                if up.where("moved").isEmpty():
                    break
        labels = staged(labels.join(up.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        if count <= LAST:
            break
        to = lambda rows, c: rows.join(up.select(F.col("node").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        left = staged(pair(to(to(left, "u"), "v")).distinct(), "edges")
    return labels


def cycles(edges: DataFrame, longest: int = 6) -> DataFrame:
    """GRA3: simple directed cycles of 2 to `longest` nodes, as `path` from their lowest node. Nodes that no edge enters or leaves
    are pruned first, by semi joins, until all that is left is entered and left."""
    e = _cut(edges.select("u", "v").where("u != v").distinct())
    left = e.count()
    while True:
        e = _cut(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
        if left == (left := e.count()):
            break
    step = e.select(F.col("u").alias("at"), F.col("v").alias("next"))
    walks = e.where("u < v").select(F.array("u", "v").alias("path"), F.col("u").alias("start"), F.col("v").alias("at"))
    found = None
    for size in range(2, longest + 1):
        onward = walks.join(step, "at")
        closed = onward.where("next = start").select("path")
        found = closed if found is None else found.unionByName(closed)
        if size < longest:
            walks = onward.where((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path"), "start", F.col("next").alias("at"))
    return found.withColumn("n", F.size("path"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """GRA2: node and label, the lowest node of its strongly connected component, by colouring: the least node that reaches a node
    along remaining edges is its colour; within a colour, what reaches back to the colour's own node is a component."""
    left = _cut(edges.select("u", "v").where("u != v").distinct())
    nodes = _cut(edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct())
    done = None
    while True:
        colour = _reach(nodes.select("node", F.col("node").alias("mark")), left, forward=True)
        inside = _cut(left.join(colour.select(F.col("node").alias("u"), F.col("mark").alias("cu")), "u").join(colour.select(F.col("node").alias("v"), F.col("mark").alias("cv")), "v").where("cu = cv").select("u", "v"))
        back = _reach(colour.where("node = mark"), inside, forward=False, seeds_only=True)
        ours = _cut(back.select("node", F.col("mark").alias("label")).dropDuplicates(["node"]))
        done = ours if done is None else done.unionByName(ours)
        nodes = _cut(nodes.join(ours, "node", "left_anti"))
        if nodes.isEmpty():
            return done
        left = _cut(left.join(nodes.withColumnRenamed("node", "u"), "u", "left_semi").join(nodes.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v"))


def _reach(marks: DataFrame, edges: DataFrame, forward: bool, seeds_only: bool = False) -> DataFrame:
    """Least mark that reaches each node; with `seeds_only`, nodes without a mark stay out."""
    a, b = ("u", "v") if forward else ("v", "u")
    marks = _cut(marks)
    while True:
        sent = edges.join(marks.withColumnRenamed("node", a), a).groupBy(F.col(b).alias("node")).agg(F.min("mark").alias("sent"))
        merged = marks.join(sent, "node", "full" if seeds_only else "left")
        merged = _cut(merged.select("node", F.least("mark", "sent").alias("mark"), (F.col("mark").isNull() | (F.col("sent") < F.col("mark"))).alias("moved")))
        if merged.where("moved").isEmpty():
            return marks
        marks = merged.select("node", "mark")


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """JN20: nodes within `depth` undirected steps of each start, with the distance."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    seen = start.select("node", F.col("node").alias("near"), F.lit(0).alias("distance"))
    front = seen
    for d in range(1, depth + 1):
        front = front.join(both, front.near == both.u).select("node", F.col("v").alias("near"), F.lit(d).alias("distance")).distinct().join(seen, ["node", "near"], "left_anti")
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


#: Edges of a node from which on its walks meet in several tasks.
HUB = 200


def connecting_paths(edges: DataFrame, depth: int = 4, limit: int | None = None) -> DataFrame:
    """JN20: paths of at most `depth` edges (ws, a, b, kind, attribute), undirected and none twice in a path, between nodes source < target, with nodes, kinds and attributes on the way; the first `limit` of a
    workspace, shortest first, if told.

    Walks go out from both ends, two edges at most each, and meet in the middle. The walks that meet in a node of many edges are dealt over as many tasks as it has `HUB` edges."""
    if not 1 <= depth <= 4:
        raise ValueError("paths have a depth of 1 to 4")
    name = F.concat_ws("\x01", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"), "kind", "attribute")
    ahead = edges.where("a != b").withColumn("e", name).dropDuplicates(["ws", "e"])
    both = staged(ahead.select("ws", F.col("a").alias("u"), F.col("b").alias("v"), "kind", "attribute", "e").unionByName(ahead.select("ws", F.col("b").alias("u"), F.col("a").alias("v"), "kind", "attribute", "e")), "edges")
    one = both.select("ws", F.col("u").alias("end"), F.col("v").alias("at"), F.array("u").alias("nodes"), F.array("kind").alias("kinds"), F.array("attribute").alias("attributes"), F.array("e").alias("used"))
    walks = {1: one}
    if depth > 2:
        more = one.join(both.withColumnRenamed("u", "at"), ["ws", "at"]).where(~F.array_contains("used", F.col("e")))
        walks[2] = staged(more.select("ws", "end", F.col("v").alias("at"), F.concat("nodes", F.array("at")).alias("nodes"), F.concat("kinds", F.array("kind")).alias("kinds"), F.concat("attributes", F.array("attribute")).alias("attributes"), F.concat("used", F.array("e")).alias("used")), "walks")
    parts = both.groupBy("ws", F.col("u").alias("at")).agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts"))

    def met(i: int, j: int) -> DataFrame:
        a = walks[i].join(parts, ["ws", "at"]).withColumn("part", F.pmod(F.xxhash64("used"), F.col("parts")).cast("int")).drop("parts")
        b = walks[j].join(parts, ["ws", "at"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        b = b.select("ws", "at", "part", *(F.col(c).alias(f"{c}_b") for c in ("end", "nodes", "kinds", "attributes", "used")))
        rows = a.join(b, ["ws", "at", "part"]).where((F.col("end") < F.col("end_b")) & ~F.arrays_overlap("used", "used_b"))
        joined = lambda c: F.concat(c, F.reverse(f"{c}_b")).alias(c)
        return rows.select("ws", F.col("end").alias("source"), F.col("end_b").alias("target"), F.lit(i + j).alias("hops"), F.concat("nodes", F.array("at"), F.reverse("nodes_b")).alias("nodes"), joined("kinds"), joined("attributes"))

    found = one.where(F.col("end") < F.col("at")).select("ws", F.col("end").alias("source"), F.col("at").alias("target"), F.lit(1).alias("hops"), F.array("end", "at").alias("nodes"), "kinds", "attributes")
    for i, j in ((1, 1), (2, 1), (2, 2))[: depth - 1]:
        found = found.unionByName(met(i, j))
    if limit is None:
        return found
    rank = F.struct("hops", "source", "target", "nodes", "kinds", "attributes")
    return shortest(found.select("ws", rank.alias("r")), limit)


def shortest(ranked: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of each workspace's ranked structs `r`, taken within parts first, so that no task sees all of a workspace."""
    part = F.pmod(F.xxhash64("r"), F.lit(64))
    inner = ranked.withColumn("n", F.row_number().over(Window.partitionBy("ws", part).orderBy("r"))).where(F.col("n") <= limit).drop("n")
    return inner.withColumn("n", F.row_number().over(Window.partitionBy("ws").orderBy("r"))).where(F.col("n") <= limit).select("ws", "r.*")
