"""Constrained allocation of payments to invoices.

Candidate edges fall into connected components, which are independent. A component of one edge has one best solution, a column expression. The others are
fixed-charge transportation problems: money flows along edges, each used edge has a charge, each invoice that is paid in full a reward. They go to a best-first branch and
bound: a node's linear relaxation is a flow of largest gain, its dual a proven bound, and the dual's reduced costs decide edges that no better solution can
use, or do without. A search that ends (status OPTIMAL) has the best solution; one stopped after `NODES` nodes (FEASIBLE) says by how much it may fall short.
Components of more than `MAX_EDGES` edges are refused, as the rule has it: they have status TOO_LARGE and no link.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import staged
from . import graph

NODES = 5000
MAX_EDGES = 4000


class Relaxed(NamedTuple):
    """A node's linear relaxation: its flow, a proven bound, and what the bound loses if an edge is taken out, or gains at most if it is used in full."""

    amount: dict
    bound: float
    without: dict
    used: dict


def costs(edges: list[tuple], invoices: dict, confidence: dict) -> tuple[int, dict]:
    """The unit of costs, and what using each edge costs."""
    unit = max(1, max(invoices.values(), default=0) // 1000)
    return unit, {e: unit + max(1, unit // 4) - int(confidence[e] * unit) for e in edges}


def relaxed(edges: list[tuple], invoices: dict, payments: dict, cost: dict, unit: int, used: frozenset, full: frozenset, short: frozenset) -> Relaxed | None:
    """The best flow if an undecided edge is charged, and an undecided invoice rewarded, in proportion to what flows; edges of `used` are charged whole, invoices of
    `full` must be paid in full and those of `short` earn nothing for it. None if they can't. Paths of the largest gain are filled until none gains; the bound is the
    dual's value at their potentials, so it holds whatever is rounded."""
    ends = [n for e in edges for n in (("i", e[0]), ("p", e[1]))]
    nodes = list(dict.fromkeys(ends))
    number = {n: k + 1 for k, n in enumerate(nodes)}  # 0 is source and sink in one
    must = 4.0 * len(nodes) + 16
    room = [0] + [invoices[n[1]] if n[0] == "i" else payments[n[1]] for n in nodes]
    limit = {e: min(invoices[e[0]], payments[e[1]]) for e in edges}
    gain = {}
    for e in edges:
        i = e[0]
        gain[e] = 1.0 + (0 if e in used else -cost[e] / limit[e]) + (must if i in full else 0 if i in short else 2.0 * unit / invoices[i])
    amount = dict.fromkeys(edges, 0)
    left = list(room)
    arcs = [(e, number["i", e[0]], number["p", e[1]], gain[e]) for e in edges]
    while True:
        # longest paths: from invoices with room, along edges that aren't full, back along edges in use, to payments with room
        far = [0.0 if k and nodes[k - 1][0] == "i" and left[k] > 0 else -math.inf for k in range(len(room))]
        by: list = [None] * len(room)
        for _ in range(len(room)):
            changed = False
            for e, i, p, g in arcs:
                if amount[e] < limit[e] and far[i] + g > far[p] + 1e-9:
                    far[p], by[p], changed = far[i] + g, (e, i), True
                if amount[e] > 0 and far[p] - g > far[i] + 1e-9:
                    far[i], by[i], changed = far[p] - g, (e, p), True
            if not changed:
                break
        goal = max((k for k in range(1, len(room)) if nodes[k - 1][0] == "p" and left[k] > 0), key=lambda k: (far[k], -k), default=0)
        if not goal or far[goal] <= 1e-9:
            break
        path, at = [], goal
        while by[at] is not None:
            path.append((by[at][0], nodes[at - 1][0] == "p"))
            at = by[at][1]
        push = min(left[at], left[goal], *(limit[e] - amount[e] if ahead else amount[e] for e, ahead in path))
        for e, ahead in path:
            amount[e] += push if ahead else -push
        left[at] -= push
        left[goal] -= push
    if any(left[number["i", i]] > 0 for i in full if ("i", i) in number) or any(("i", i) not in number for i in full):
        return None
    rise = [0.0] * len(room)  # potentials over what could still be changed, the common source and sink being node 0
    for _ in range(len(room) + 1):
        changed = False
        for k in range(1, len(room)):
            ahead, back = (0, k) if nodes[k - 1][0] == "i" else (k, 0)
            if left[k] > 0 and rise[ahead] > rise[back] + 1e-9:
                rise[back], changed = rise[ahead], True
            if left[k] < room[k] and rise[back] > rise[ahead] + 1e-9:
                rise[ahead], changed = rise[back], True
        for e, i, p, g in arcs:
            if amount[e] < limit[e] and rise[i] + g > rise[p] + 1e-9:
                rise[p], changed = rise[i] + g, True
            if amount[e] > 0 and rise[p] - g > rise[i] + 1e-9:
                rise[i], changed = rise[p] - g, True
        if not changed:
            break
    price = [0.0] + [max(0.0, rise[0] - rise[k] if nodes[k - 1][0] == "i" else rise[k] - rise[0]) for k in range(1, len(room))]
    over = {e: max(0.0, g - price[i] - price[p]) * limit[e] for e, i, p, g in arcs}
    fixed = 2.0 * unit * len(full) - sum(cost[e] for e in used) - must * sum(invoices[i] for i in full)
    bound = sum(x * r for x, r in zip(price, room)) + sum(over.values()) + fixed
    whole = {e: max(0.0, g - price[i] - price[p] + (0 if e in used else cost[e] / limit[e])) * limit[e] - over[e] - (0 if e in used else cost[e]) for e, i, p, g in arcs}
    return Relaxed(amount, bound, {e: bound - x for e, x in over.items()}, {e: bound + x for e, x in whole.items()})


def objective(amount: dict, invoices: dict, confidence: dict) -> int:
    """Allocated sum, less a cost and plus the confidence of each used edge, plus a bonus for each invoice paid in full."""
    used = {e: a for e, a in amount.items() if a > 0}
    unit, cost = costs([*used], invoices, confidence)
    paid = defaultdict(int)
    for (i, _), a in used.items():
        paid[i] += a
    return sum(used.values()) - sum(cost.values()) + 2 * unit * sum(paid[i] == t for i, t in invoices.items())


def greedy(edges: list[tuple], invoices: dict, payments: dict, confidence: dict) -> dict:
    """Whole settlements first, then by confidence."""
    left, right, out = dict(invoices), dict(payments), {}
    for e in sorted(edges, key=lambda e: (invoices[e[0]] != payments[e[1]], -confidence[e], e)):
        if a := min(left[e[0]], right[e[1]]):
            out[e] = a
            left[e[0]] -= a
            right[e[1]] -= a
    return out


def searched(edges: list[tuple], invoices: dict, payments: dict, confidence: dict, best: dict, most: int) -> tuple[dict, int]:
    """The best solution, from `best` on, and the bound that is proven: its own worth if the search ended within `most` nodes. Nodes with the largest bound come first.
    A node's bounds on using an edge, and on doing without it, decide edges that can't be otherwise in any better solution; of what is left, the edge or invoice
    whose proportional charge or reward is furthest from the true one is decided both ways."""
    unit, cost = costs(edges, invoices, confidence)
    worth = objective(best, invoices, confidence)
    slack = 1e-7 * (1 + sum(invoices.values()))  # rounding of floats against whole amounts
    whole = lambda bound: math.floor(bound + min(slack, 0.5))
    heap, serial, seen = [(-math.inf, 0, tuple(edges), frozenset(), frozenset(), frozenset())], 0, 0
    while heap:
        bound, _, held, used, full, short = heapq.heappop(heap)
        if bound > -math.inf and whole(-bound) <= worth:
            return best, worth
        if seen >= most:
            return best, max(worth, whole(-bound)) if bound > -math.inf else sum(invoices.values()) + 2 * unit * len(invoices)
        seen += 1
        node = relaxed(list(held), invoices, payments, cost, unit, used, full, short)
        if node is None or whole(node.bound) <= worth:
            continue
        got = {e: a for e, a in node.amount.items() if a > 0}
        value = objective(got, invoices, confidence)
        if value > worth:
            best, worth = got, value
            if whole(node.bound) <= worth:
                continue
        kept = tuple(e for e in held if e in used or whole(node.used[e]) > worth)
        forced = used | {e for e in kept if whole(node.without[e]) <= worth}
        paid: dict = defaultdict(int)
        for (i, _), a in node.amount.items():
            paid[i] += a
        limit = {e: min(invoices[e[0]], payments[e[1]]) for e in held}
        doubts = [(cost[e] * (1 - node.amount[e] / limit[e]), 0, e) for e in kept if e not in forced and 0 < node.amount[e] < limit[e]]
        doubts += [(2 * unit * paid[i] / invoices[i], 1, i) for i in invoices if i not in full and i not in short and 0 < paid[i] < invoices[i]]
        if doubts:
            _, kind, item = max(doubts)
        elif len(kept) < len(held) or forced != used:
            kind, item = 2, None
        else:
            continue  # nothing is charged in proportion any more: the bound is this solution's worth
        children = (
            [(kept, forced, full | {item}, short), (kept, forced, full, short | {item})] if kind == 1
            else [(kept, forced | {item}, full, short), (tuple(e for e in kept if e != item), forced, full, short)] if kind == 0
            else [(kept, forced, full, short)]
        )
        for child in children:
            serial += 1
            heapq.heappush(heap, (-node.bound, serial, *child))
    return best, worth


LINK = "amount long, status string, gap long"


def settled(rows: list[tuple], n: int) -> list[tuple]:
    """Links (invoice_id, payment_id, amount, status, gap) of one component of `n` edges (invoice_id, payment_id, total, available, score): amounts, its status, and by how much its objective
    may fall short of the best one; a row without ids if there is no link."""
    if n > MAX_EDGES:
        return [(None, None, 0, "TOO_LARGE", None)]
    rows = [r for r in rows if r[2] > 0 and r[3] > 0]
    edges = sorted((i, p) for i, p, *_ in rows)
    invoices, payments, confidence = {r[0]: r[2] for r in rows}, {r[1]: r[3] for r in rows}, {(r[0], r[1]): r[4] for r in rows}
    best, bound = searched(edges, invoices, payments, confidence, greedy(edges, invoices, payments, confidence), NODES)
    gap = bound - objective(best, invoices, confidence)
    status = "FEASIBLE" if gap else "OPTIMAL"
    return [(i, p, int(a), status, gap) for (i, p), a in best.items() if a > 0] or [(None, None, 0, status, gap)]


EDGE = ("invoice_id", "payment_id", "total", "available", "score")


def solve(component: pd.DataFrame) -> pd.DataFrame:
    """`settled` of one component, with its workspace."""
    out = pd.DataFrame(settled(list(zip(*(component[c].tolist() for c in EDGE))), len(component)), columns=["invoice_id", "payment_id", "amount", "status", "gap"])
    out.insert(0, "ws", component.ws.iloc[0])
    return out


def components_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple], int]]:
    """Workspace, edges and number of edges of each component, from rows in the order of their label. Edges beyond `MAX_EDGES` are counted only."""
    label, ws, held, n = None, None, [], 0
    for batch in batches:
        for at, w, *edge in zip(*(batch.column(c).to_pylist() for c in ("label", "ws", *EDGE))):
            if n and at != label:
                yield ws, held, n
                held, n = [], 0
            label, ws, n = at, w, n + 1
            if n <= MAX_EDGES:
                held.append(tuple(edge))
    if n:
        yield ws, held, n


def solved(candidates: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Links (ws, invoice_id, payment_id, amount) with their component's status; a component without links has one row without ids. Most components have a few edges, so a task
    reads many of them, one after the other."""
    edges = candidates.join(invoices.select("ws", "invoice_id", "total"), ["ws", "invoice_id"]).join(payments.select("ws", "payment_id", F.col("amount").alias("available")), ["ws", "payment_id"])
    keyed = staged(edges.select("ws", *EDGE), "edges")
    degree = keyed.join(keyed.groupBy("ws", "invoice_id").agg(F.count("*").alias("n_i")), ["ws", "invoice_id"]).join(keyed.groupBy("ws", "payment_id").agg(F.count("*").alias("n_p")), ["ws", "payment_id"])
    degree = staged(degree.select("ws", *EDGE, ((F.col("n_i") == 1) & (F.col("n_p") == 1)).alias("alone")), "degrees")
    alone = degree.where("alone").select("ws", "invoice_id", "payment_id", F.least("total", "available").alias("amount"), F.lit("OPTIMAL").alias("status"), F.lit(0).cast("long").alias("gap"))
    node = lambda tag, c: F.concat_ws(":", "ws", F.concat(F.lit(tag), F.col(c).cast("string")))
    rest = degree.where("NOT alone").withColumn("k", node("i", "invoice_id"))
    label = graph.components(rest.select(F.col("k").alias("u"), node("p", "payment_id").alias("v")))
    rest = rest.join(label.withColumnRenamed("node", "k"), "k").select("label", "ws", *EDGE)
    kind = dict(candidates.dtypes)
    names = ["ws", "invoice_id", "payment_id", "amount", "status", "gap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [*(first.schema.field(c).type for c in names[:3]), pa.int64(), pa.string(), pa.int64()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)
        out: list[tuple] = []
        for ws, rows, n in components_in_order(chain([first], batches)):
            out += [(ws, *link) for link in settled(rows, n)]
            if len(out) >= 5000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    schema = f"ws {kind['ws']}, invoice_id {kind['invoice_id']}, payment_id {kind['payment_id']}, {LINK}"
    return alone.unionByName(rest.repartition("label").sortWithinPartitions("label").mapInArrow(run, schema))


def allocate(candidates: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """ALC: ws, invoice_id, payment_id, amount and status of the links."""
    return solved(candidates, invoices, payments).where("invoice_id IS NOT NULL")


def statuses(candidates: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """ALC: the worst status of each workspace, with links, their sum, and by how much the workspace's objective may fall short of the best one; TOO_LARGE and FEASIBLE
    components show."""
    rank = F.when(F.col("status") == "TOO_LARGE", 2).when(F.col("status") == "FEASIBLE", 1).otherwise(0)
    by = solved(candidates, invoices, payments).groupBy("ws").agg(F.max(rank).alias("rank"), F.count("invoice_id").alias("links"), F.sum("amount").alias("amount"), F.sum("gap").alias("gap"))
    return by.select("ws", F.element_at(F.array(*map(F.lit, ("OPTIMAL", "FEASIBLE", "TOO_LARGE"))), (F.col("rank") + 1).cast("int")).alias("status"), "links", "amount", "gap")
