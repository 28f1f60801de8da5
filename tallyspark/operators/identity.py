"""Identity: blocking, exact rules, Fellegi-Sunter scores, constrained clusters and canonical records."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import names, similarity
from ..sources.shared import staged
from . import graph

MAX_BLOCK = 60
ACCEPT, REVIEW, EXACT = 6.0, 1.5, 20.0
#: An accepted pair of this weight without conflict isn't contested.
SETTLED = 10.0
#: Columns of arrays that an identity record has besides ws, id and name.
KEY_SETS = ("domains", "emails", "phones", "tax_ids", "pans", "addresses", "postal_codes", "platform_ids")


def records(rows: DataFrame) -> DataFrame:
    """Identity records of raw rows: comparable forms of name, email, phone, tax id and address. A table of customers is a file or two, but forms take long, so rows are dealt over all cores."""
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    one = lambda c: F.array_compact(F.array(c))
    given = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    email, address = F.col("email"), F.col("address")
    site = names.normalize_domain(given("website"))
    return rows.select(
        "ws", "id", "name", names.normalize_name(F.col("name")).alias("normalized_name"), names.name_tokens(F.col("name")).alias("tokens"), F.array_distinct(F.array_compact(F.array(names.normalize_domain(email), site))).alias("domains"), given("source").alias("source"), one(given("platform_id")).alias("platform_ids"),
        one(names.normalize_email(email)).alias("emails"), one(names.normalize_phone(F.col("phone"))).alias("phones"), one(names.normalize_tax_id(F.col("tax_id"))).alias("tax_ids"),
        one(names.pan_of(F.col("tax_id"))).alias("pans"), one(F.nullif(names.normalize_address(address), F.lit(""))).alias("addresses"), one(names.postal_code(address)).alias("postal_codes"),
    )


def block_keys() -> Column:
    """JN10's keys: identifiers, words of four letters, the name's start and its 4-grams."""
    tag = lambda prefix, column: F.transform(column, lambda x: F.concat(F.lit(prefix), x))
    named = F.col("normalized_name") != ""
    return F.array_distinct(F.concat(
        tag("1pan:", F.col("pans")), tag("2tax:", F.col("tax_ids")), tag("3domain:", F.col("domains")), tag("4email:", F.col("emails")), tag("5phone:", F.col("phones")), tag("6pin:", F.col("postal_codes")),
        tag("7token:", F.filter("tokens", lambda t: F.length(t) >= 4)), F.when(named, F.array(F.concat(F.lit("8prefix:"), F.substring("normalized_name", 1, 5)))).otherwise(F.array().cast("array<string>")),
        F.when(named, tag("9ngram:", names.ngrams(F.col("normalized_name")))).otherwise(F.array().cast("array<string>")),
    ))


def candidate_pairs(recs: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """JN10: pairs that share a block of 2 to 60 records, once, with the strongest shared key. Larger blocks tell too little; they are
    skipped by the operator's own rule, and listed by `oversized_blocks`."""
    keyed = staged(recs.select("ws", "id", F.explode(block_keys()).alias("key")).distinct(), "keyed")
    fit = keyed.groupBy("ws", "key").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= max_block)).select("ws", "key")
    blocks = keyed.join(fit, ["ws", "key"]).groupBy("ws", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # of max_block ids at most
    firsts = blocks.select("ws", "key", "ids", F.posexplode("ids").alias("n", "l"))
    pairs = firsts.select("ws", "key", "l", F.explode(F.expr("slice(ids, n + 2, size(ids))")).alias("r"))
    return pairs.groupBy("ws", "l", "r").agg(F.min("key").alias("rule"))


def oversized_blocks(recs: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    keyed = recs.select("ws", "id", F.explode(block_keys()).alias("key")).distinct()
    return keyed.groupBy("ws", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_block)


def _sides(pairs: DataFrame, recs: DataFrame) -> DataFrame:
    side = lambda s: recs.select("ws", F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("normalized_name", "tokens", "source", *KEY_SETS)))
    return pairs.join(side("l"), ["ws", "l"]).join(side("r"), ["ws", "r"])


def _shared(name: str) -> Column:
    return F.arrays_overlap(f"l_{name}", f"r_{name}")


def _both(name: str) -> Column:
    return (F.size(f"l_{name}") > 0) & (F.size(f"r_{name}") > 0)


def _tax_conflict() -> Column:
    """Both sides carry tax ids that differ, and no PAN in common."""
    return _both("tax_ids") & ~_shared("tax_ids") & ~_shared("pans")


def exact_match() -> Column:
    """IDN1: confidence of the first exact rule that holds: PAN, tax id, platform's customer id, corporate e-mail, domain with a shared word. A shared domain
    doesn't count against differing tax ids."""
    corporate = F.exists(F.array_intersect("l_emails", "r_emails"), lambda e: names.normalize_domain(e).isNotNull())
    return (
        F.when(_shared("pans"), 0.99).when(_shared("tax_ids"), 0.98).when(_shared("platform_ids") & (F.col("l_source") == F.col("r_source")), 0.97)
        .when(corporate, 0.94).when(_shared("domains") & _shared("tokens") & ~_tax_conflict(), 0.92)
    )


def name_points(score: Column) -> Column:
    return F.when(score >= 99.5, 8.0).when(score >= 95, 5.5).when(score >= 88, 3.5).when(score >= 80, 1.5).when(score >= 65, -1.0).otherwise(-6.0)


#: What similar vectors add at most, and from which similarity on: support, never a decision.
SEMANTIC_MOST, SEMANTIC_FROM = 1.0, 0.5


def semantic_points(similarity_: Column) -> Column:
    return F.coalesce(F.when(similarity_ > SEMANTIC_FROM, F.least(F.lit(SEMANTIC_MOST), (similarity_ - SEMANTIC_FROM) * 2 * SEMANTIC_MOST)), F.lit(0.0))


def scored(pairs: DataFrame, recs: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """IDN2: weight and decision of each pair. Exact matches stop at 20; only the others reach the similarity functions. `semantic` has the similarity of pairs (ws, l, r) whose
    vectors are close; others have none."""
    rows = _sides(pairs, recs).withColumn("exact", exact_match())
    if semantic is not None:
        rows = rows.join(semantic.select("ws", "l", "r", "similarity"), ["ws", "l", "r"], "left")
    sure = rows.where("exact IS NOT NULL").select("ws", "l", "r", "rule", F.lit(EXACT).alias("weight"), "exact", (_both("tax_ids") & ~_shared("tax_ids")).alias("conflict"))
    rest = rows.where("exact IS NULL")
    common = F.size(F.array_intersect("l_tokens", "r_tokens"))
    smaller = F.least(F.size("l_tokens"), F.size("r_tokens"))
    tokens = F.when(_both("tokens"), F.when(common == smaller, 3.0).when(common > 0, 1.2).otherwise(-3.5)).otherwise(0.0)
    domain = F.when(_both("domains"), F.when(_shared("domains"), 4.5).otherwise(-4.0)).otherwise(0.0)
    tax = _both("tax_ids") & ~_shared("tax_ids")
    weight = (
        name_points(similarity.name_similarity("l_normalized_name", "r_normalized_name")) + tokens + domain + F.when(tax, -9.0).otherwise(0.0)
        + F.when(similarity.name_contained("l_normalized_name", "r_normalized_name", F.lit(88.0)), 4.0).otherwise(0.0) + F.when(_shared("phones"), 3.0).otherwise(0.0)
        + F.when(_shared("addresses"), 2.0).when(_shared("postal_codes"), 0.5).otherwise(0.0) + (semantic_points(F.col("similarity")) if semantic is not None else F.lit(0.0))
    )
    conflict = tax | (_both("domains") & ~_shared("domains"))
    other = rest.select("ws", "l", "r", "rule", weight.alias("weight"), F.lit(None).cast("double").alias("exact"), conflict.alias("conflict"))
    return sure.unionByName(other).withColumn("decision", decision(F.col("weight")))


def settled(pairs: DataFrame, recs: DataFrame, similar: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`scored` as far as clusters need it: every pair's decision and conflict, and the weight of accepted pairs. `similar` gives the similarity of vectors of pairs (ws, l, r), and is asked only for
    those that it may lift over a threshold or that are accepted, whose weight says when they merge; the weight of others is told without it."""
    plain = staged(scored(pairs, recs).select("ws", "l", "r", "weight", "exact", "conflict", "decision"), "scored")
    reach = SEMANTIC_MOST + 1e-6  # sums are rounded
    weight = F.col("weight")
    asked = F.coalesce(F.col("exact").isNull() & (weight.between(REVIEW - reach, REVIEW) | (weight >= ACCEPT - reach)), F.lit(False))
    near = plain.where(asked)
    lifted = near.join(similar(near.select("ws", "l", "r")), ["ws", "l", "r"], "left").withColumn("weight", weight + semantic_points(F.col("similarity"))).withColumn("decision", decision(weight))
    return plain.where(~asked).unionByName(lifted.select(plain.columns))


def decision(weight: Column) -> Column:
    return F.when(weight >= ACCEPT, "ACCEPTED").when(weight >= REVIEW, "REVIEW").otherwise("REJECTED")


def posterior(weight: Column) -> Column:
    """MTH1"""
    w = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), weight))
    return F.pow(F.lit(2.0), w) / (1 + F.pow(F.lit(2.0), w))


def overridden(pairs: DataFrame, memory: DataFrame) -> DataFrame:
    """IDN7: a reviewer's earlier verdict on the same two records wins."""
    told = memory.select("ws", F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"), F.col("verdict").alias("told"))
    return pairs.join(told, ["ws", "l", "r"], "left").withColumn("decision", F.coalesce("told", "decision")).drop("told")


def cannot_link(pairs: DataFrame) -> DataFrame:
    """IDN3"""
    return pairs.where((F.col("decision") != "ACCEPTED") & F.col("conflict")).select("ws", "l", "r")


#: Edges and barred pairs that one task walks through.
TOGETHER = 1_000_000
#: The share of a component's edges that are looked at together at first.
SHARE = 0.5


def _walked(rows: pa.Table) -> pa.Table:
    """node and to, of nodes that end in another one's cluster, after a walk over whole components' edges, strongest first. Rows: u, v and key (w, l, r), whose w barred pairs have none of."""
    kind = rows.schema.field("u").type
    ends = pa.chunked_array([*rows["u"].chunks, *rows["v"].chunks], kind).combine_chunks().dictionary_encode()
    if isinstance(ends, pa.ChunkedArray):
        ends = ends.combine_chunks()
    us, vs = ends.indices.to_numpy().reshape(2, -1)
    parent: dict[int, int] = {}
    foes: dict[int, set[int]] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    barred = rows["w"].is_null().to_numpy()
    for u, v in zip(us[barred].tolist(), vs[barred].tolist()):
        foes.setdefault(u, set()).add(v)
        foes.setdefault(v, set()).add(u)
    order = pc.sort_indices(rows.select(["w", "l", "r"]), [(c, "ascending") for c in ("w", "l", "r")]).to_numpy()[: int((~barred).sum())]  # nulls are last
    for u, v in zip(us[order].tolist(), vs[order].tolist()):
        a, b = top(u), top(v)
        if a == b or b in foes.get(a, ()):
            continue
        if len(foes.get(a, ())) < len(foes.get(b, ())):
            a, b = b, a
        parent[b] = a
        for x in foes.pop(b, ()):
            foes[x].discard(b)
            foes[x].add(a)
            foes.setdefault(a, set()).add(x)
    moved = [(x, t) for x in list(parent) if (t := top(x)) != x]
    names = lambda k: ends.dictionary.take(pa.array([m[k] for m in moved], pa.int64()))
    return pa.table({"node": names(0), "to": names(1)})


def _merged(edges: DataFrame, barred: DataFrame) -> DataFrame:
    """node and root after merging along edges (u, v, weight, l, r, label), strongest first, without ever bringing a barred pair (u, v, label) together. Components, by their label, of up to
    `TOGETHER` rows are walked through, many in a task; larger ones become smaller, a round after the other, until they are as small.

    What hangs together by the strongest edges of a component, down to some weight, is decided before anything that leads out of it. Without a barred pair in it, it is one cluster; with some, and small enough, it is
    walked through. The weight is the middle one of a component's edges; where that settles nothing, that of an eighth of these, and so on, at last the strongest alone. If all of these are one weight's and too many, edges
    are decided one by one (`_firsts`). Clusters barred from each other lose their edges, and components without edges bar nothing."""
    key = F.struct((-F.col("weight")).alias("w"), "l", "r")
    edges = staged(_once(edges.select("u", "v", "label", key.alias("key"))), "edges")
    roots = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    barred = staged(_pair(barred.select("u", "v", "label")).distinct(), "barred")
    share = SHARE
    while True:
        sizes = staged(edges.select("label").unionByName(barred.join(edges.select("label").distinct(), "label", "left_semi").select("label")).groupBy("label").agg(F.count("*").alias("n")), "sizes")
        ready = sizes.where(F.col("n") <= TOGETHER)
        if few := ready.agg(F.sum("n")).first()[0]:
            roots = _moved(roots, _walks(edges, barred, ready, few), "root")
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= TOGETHER:
            return staged(roots, "roots")
        alone = share * most < 1  # only the strongest edges, and those of their weight
        large = sizes.where(F.col("n") > TOGETHER).select("label")
        edges, barred = (staged(rows.join(large, "label", "left_semi"), name) for rows, name in ((edges, "edges"), (barred, "barred")))
        until = edges.groupBy("label").agg((F.min("key.w") if alone else F.percentile_approx("key.w", share)).alias("until"))
        strong = staged(edges.join(until, "label").where("key.w <= until").select("u", "v", "key"), "strong")
        part = graph.components(strong)
        at = lambda c, name: part.select(F.col("node").alias(c), F.col("label").alias(name))  # noqa: E731  noqa: B023
        strong = strong.join(at("u", "label"), "u")
        within = staged(barred.select("u", "v").join(at("u", "a"), "u").join(at("v", "b"), "v").where("a = b").select("u", "v", F.col("a").alias("label")), "within")
        split = within.select("label").distinct()
        whole = part.where("node != label").join(split, "label", "left_anti").select("node", F.col("label").alias("to"))
        strong = staged(strong.join(split, "label", "left_semi"), "split")
        sizes = staged(strong.select("label").unionByName(within.select("label")).groupBy("label").agg(F.count("*").alias("n")), "sizes")
        ready = sizes.where(F.col("n") <= TOGETHER)
        if few := ready.agg(F.sum("n")).first()[0]:
            whole = whole.unionByName(_walks(strong, within, ready, few))
        up = staged(whole, "joined")
        if up.isEmpty() and few is None:  # all that hangs together is contested and large
            if not alone:
                share /= 8
                continue
            up = _firsts(edges, barred)
        else:
            share = min(8 * share, SHARE)
        roots = staged(_moved(roots, up, "root"), "roots")
        barred = staged(_pair(_moved(_moved(barred, up, "u"), up, "v")).distinct(), "barred")
        edges = _once(_moved(_moved(edges, up, "u"), up, "v")).join(barred.select("u", "v"), ["u", "v"], "left_anti")
        edges = staged(edges.drop("label"), "edges")
        part = graph.components(edges)
        edges = staged(edges.join(part.withColumnRenamed("node", "u"), "u").select("u", "v", "label", "key"), "edges")
        within = barred.drop("label").join(at("u", "a"), "u").join(at("v", "b"), "v").where("a = b")
        barred = staged(within.select("u", "v", F.col("a").alias("label")), "barred")


def _pair(rows: DataFrame) -> DataFrame:
    return rows.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *(c for c in rows.columns if c not in ("u", "v")))


def _once(rows: DataFrame) -> DataFrame:
    """Edges between clusters, the strongest of each two."""
    return _pair(rows).groupBy("u", "v", "label").agg(F.min("key").alias("key"))


def _moved(rows: DataFrame, up: DataFrame, c: str) -> DataFrame:
    return rows.join(up.select(F.col("node").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")


def _walks(edges: DataFrame, barred: DataFrame, ready: DataFrame, few: int) -> DataFrame:
    """node and to after walks over the components `ready`, of `few` rows together, many in a task."""
    kinds = edges.schema["key"].dataType
    part = F.pmod(F.xxhash64("label"), F.lit(2 * few // TOGETHER + 1))
    rows = edges.select("u", "v", "label", "key").unionByName(barred.select("u", "v", "label", F.lit(None).cast(kinds).alias("key"))).join(ready, "label", "left_semi")
    kind = dict(edges.dtypes)["u"]
    return staged(rows.select("u", "v", "key.w", "key.l", "key.r", part.alias("part")).groupBy("part").applyInArrow(_walked, f"node {kind}, to {kind}"), "walked")


def _firsts(edges: DataFrame, barred: DataFrame) -> DataFrame:
    """node and to of clusters that merge by single edges, which are decided whatever comes later.

    The strongest edge of both its clusters is decided at once: everything that could change either of them comes later. So is the strongest edge of a cluster without barred pairs: it can't be
    refused, whatever the other side has become by then, and what the cluster brings along comes later. The strongest edge of all is always one of these, so every round gets on."""
    best = edges.select(F.explode(F.array("u", "v")).alias("x"), "key").groupBy("x").agg(F.min("key").alias("best"))
    hot = barred.select(F.explode(F.array("u", "v")).alias("x")).distinct().withColumn("hot", F.lit(True))
    told = best.join(hot, "x", "left").select("x", "best", F.coalesce("hot", F.lit(False)).alias("hot"))
    side = lambda s: told.select(F.col("x").alias(s), F.col("best").alias(f"best_{s}"), F.col("hot").alias(f"hot_{s}"))
    rows = edges.join(side("u"), "u").join(side("v"), "v").join(barred.select("u", "v"), ["u", "v"], "left_anti")
    top_u, top_v = F.col("best_u") == F.col("key"), F.col("best_v") == F.col("key")
    # each cluster joins at most one other: the greater of two that are each other's first, else the one that can't be refused
    joins = F.when(top_u & top_v | top_v & ~F.col("hot_v"), "v").when(top_u & ~F.col("hot_u"), "u")
    go = rows.withColumn("joins", joins).where("joins IS NOT NULL")
    up = staged(go.select(F.when(F.col("joins") == "v", F.col("v")).otherwise(F.col("u")).alias("node"), F.when(F.col("joins") == "v", F.col("u")).otherwise(F.col("v")).alias("to")), "joined")
    while True:  # to the cluster that joins no other
        up = staged(up.join(up.select(F.col("node").alias("to"), F.col("to").alias("on")), "to", "left").select("node", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")), "joined")
        if up.where("moved").isEmpty():
            return up.select("node", "to")


#: Bits of a node's number that are the id's.
BITS = 42


def _tags(pairs: DataFrame) -> Callable[[str], Column]:
    """What tells a record from all others, of its workspace and id: a number if both are numbers that go into one, which joins and sorts much faster than text."""
    kinds = dict(pairs.dtypes)
    if all(kinds[c] in ("int", "bigint") for c in ("ws", "l", "r")):
        low, high, least, most = pairs.agg(F.min("ws"), F.max("ws"), F.min(F.least("l", "r")), F.max(F.greatest("l", "r"))).first()
        if low is not None and least is not None and 0 <= low and high < 1 << 62 - BITS and 0 <= least and most < 1 << BITS:
            return lambda c: F.col("ws").cast("long") * (1 << BITS) + F.col(c)
    return lambda c: F.concat_ws(":", F.col("ws"), F.lpad(F.col(c).cast("string"), 20, "0"))


def clusters(pairs: DataFrame) -> DataFrame:
    """IDN4: ws, id and cluster. Components of accepted links are clusters, except where a cannot-link pair lies within one: those are
    merged link by link, strongest first. Such a pair matters only inside a component, so the others need no rounds."""
    accepted = pairs.where("decision = 'ACCEPTED'").select("ws", "l", "r", "weight")
    tag = _tags(pairs)
    label = graph.components(accepted.select(tag("l").alias("u"), tag("r").alias("v")))
    barred = cannot_link(pairs).select(tag("l").alias("u"), tag("r").alias("v"))
    within = barred.join(label.withColumnsRenamed({"node": "u", "label": "a"}), "u").join(label.withColumnsRenamed({"node": "v", "label": "b"}), "v").where("a = b").select("u", "v", F.col("a").alias("label"))
    split = within.select("label").distinct()
    ids = accepted.select("ws", F.explode(F.array("l", "r")).alias("id")).distinct().withColumn("node", tag("id")).join(label, "node")
    contested = accepted.select(tag("l").alias("u"), tag("r").alias("v"), "weight", "l", "r").join(label.select(F.col("node").alias("u"), "label"), "u").join(split, "label", "left_semi")
    roots = _merged(contested, within)
    found = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "label"))
    lowest = found.groupBy("root").agg(F.min("id").alias("cluster"))
    return found.join(lowest, "root").select("ws", "id", "cluster")


def transitivity_conflicts(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """IDN5: rejected pairs with a conflict that ended up in one cluster all the same."""
    l, r = (found.select("ws", F.col("id").alias(s), F.col("cluster").alias(f"c{s}")) for s in ("l", "r"))
    return pairs.where("decision = 'REJECTED' AND conflict").join(l, ["ws", "l"]).join(r, ["ws", "r"]).where("cl = cr").select("ws", "l", "r", F.col("cl").alias("cluster"))


def canonical(recs: DataFrame, found: DataFrame) -> DataFrame:
    """AGG20: longest name (the first by id of equal ones), sorted unions of all keys; confidence 1.0 for one record, else 0.9."""
    rows = recs.join(found, ["ws", "id"], "left").withColumn("cluster", F.coalesce("cluster", "id"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return rows.groupBy("ws", "cluster").agg(
        F.max_by("name", F.struct(F.length("name"), -F.col("id"))).alias("canonical_name"), F.array_sort(F.collect_set("name")).alias("aliases"),
        *(union(c) for c in ("domains", "emails", "tax_ids", "addresses")), F.when(F.count("*") == 1, 1.0).otherwise(0.9).alias("confidence"), F.count("*").alias("records"),
    )


def cluster_entropy(found: DataFrame) -> DataFrame:
    """AGG19: entropy of cluster sizes in bits."""
    sizes = found.groupBy("ws", "cluster").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("ws"))
    return sizes.withColumn("p", p).groupBy("ws").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"), F.count("*").alias("clusters"))


def criticised(pairs: DataFrame, recs: DataFrame) -> DataFrame:
    """IDN9: what speaks against each proposed link, the critic's verdict and the decision that is left. A verdict can only weaken a decision.

    Objections send an accepted link without exact match to review. Exact matches and rejected pairs stand. What is accepted on contested evidence (a conflict, or a
    weight of under 10) was challenged by nobody, as there is no model here, so it goes to review, too.
    """
    rows = _sides(pairs.select("ws", "l", "r", "weight", "exact", "conflict", "decision"), recs)
    shared_address = _shared("addresses") & ~_shared("tax_ids") & ~_shared("domains") & ~_shared("tokens")
    said = F.array_compact(F.array(
        F.when(_tax_conflict(), "CONTRADICTORY_IDENTIFIER: tax"), F.when(_both("domains") & ~_shared("domains"), "CONTRADICTORY_IDENTIFIER: domain"),
        F.when(shared_address, "SHARED_ADDRESS_NOT_SAME"),
    ))
    contested = F.col("conflict") | (F.col("weight") < SETTLED)
    disputed = (F.size("objections") > 0) & (F.col("decision") == "ACCEPTED") & F.col("exact").isNull()
    verdict = F.when(disputed, "DISPUTE").when(F.col("exact").isNotNull() | (F.col("decision") != "ACCEPTED") | ~contested, "AGREE").otherwise("NEEDS_REVIEW")
    out = rows.withColumn("objections", said).withColumn("verdict", verdict)
    return out.select("ws", "l", "r", "objections", "verdict", F.when(F.col("verdict") == "AGREE", F.col("decision")).otherwise("REVIEW").alias("decision"))


def collected(contacts: DataFrame, crm: DataFrame, contracts: DataFrame, payments: DataFrame, bank: DataFrame) -> DataFrame:
    """IDN6: raw identity rows (ws, id, source, name, email, phone, tax_id, address, website, platform_id) of everything that names a customer.

    contacts: ws, source_id, contact_name, company_name, email, phone, gst_no, address, website. crm: ws, source_id, name, domain, city. contracts: ws, contract_id,
    document_name, customer_name, terms_read. payments: ws, payment_id, source_id, customer_name, email, phone. bank: ws, bank_id, source_id, counterparty, direction.
    A file's name speaks for a contract only once the contract was read and named nobody. Payments and bank lines speak once for each name. A
    counterparty that money only went out to counts if another source names it.
    """
    def put(rows: DataFrame, kind: str, key: str, source: str, **given) -> DataFrame:
        filled = {c: given.get(c, F.lit(None).cast("string")) for c in ("name", "email", "phone", "tax_id", "address", "website", "platform_id")}
        return rows.select("ws", F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(source).alias("source"), *(v.alias(c) for c, v in filled.items()))

    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = put(
        contacts, "contact", "source_id", "accounting", name=F.coalesce(text("contact_name"), text("company_name"), F.col("source_id").cast("string")), email=F.col("email"), phone=F.col("phone"),
        tax_id=F.col("gst_no"), address=F.col("address"), website=F.col("website"), platform_id=F.col("source_id").cast("string"),
    ).unionByName(put(crm.where("name != ''"), "crm", "source_id", "crm", name=F.col("name"), website=F.col("domain"), address=F.col("city")))
    of_file = F.when(F.col("terms_read"), names.name_from_filename(F.col("document_name")))
    named = named.unionByName(put(contracts.withColumn("_name", F.coalesce(text("customer_name"), text(of_file))).where("_name IS NOT NULL"), "contract", "contract_id", "documents", name=F.col("_name")))
    once = lambda rows, name, key: rows.where(F.length(name) > 0).withColumn("_n", F.row_number().over(Window.partitionBy("ws", F.lower(name)).orderBy("source_id", key))).where("_n = 1")
    paid = once(payments, "customer_name", "payment_id")
    named = named.unionByName(put(paid, "payment", "payment_id", "payments", name=F.col("customer_name"), email=F.col("email"), phone=F.col("phone")))
    known = named.select("ws", names.normalize_name(F.col("name")).alias("_key"), F.lit(True).alias("_known")).distinct()
    pays_in = bank.where("direction = 'credit'").select("ws", F.lower("counterparty").alias("_low"), F.lit(True).alias("_pays")).distinct()
    seen = once(bank, "counterparty", "bank_id").withColumns({"_low": F.lower("counterparty"), "_key": names.normalize_name(F.col("counterparty"))})
    seen = seen.join(pays_in, ["ws", "_low"], "left").join(known, ["ws", "_key"], "left").where("_pays OR _known")
    return named.unionByName(put(seen, "bank", "bank_id", "bank", name=F.col("counterparty")))


def applied(recs: DataFrame, found: DataFrame, entities: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IDN8: customers after clustering, and which ids they took over (ws, from_id, to_id).

    entities: ws, entity_id, name, normalized_name, aliases, domains, tax_ids, human_confirmed, created_at. found: ws, id, cluster. owned: ws, entity_id of what owns evidence.
    A cluster's customer is the oldest entity of its canonical name, or a new one; one that a human confirmed keeps its fields. Other entities named like a member are absorbed, unless
    a human confirmed them or their tax ids contradict the customer's. What owns no evidence then and wasn't confirmed is retired.
    """
    rows = recs.join(found, ["ws", "id"], "left").withColumn("cluster", F.coalesce("cluster", "id"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    made = rows.groupBy("ws", "cluster").agg(
        F.min_by(F.struct("name", "normalized_name"), F.struct((-F.length("name")).alias("n"), "id")).alias("canonical"), F.array_sort(F.collect_set("name")).alias("aliases"), union("domains"), union("tax_ids"),
        union("pans"), F.array_distinct(F.collect_list(F.nullif("normalized_name", F.lit("")))).alias("member_names"),
    ).select("ws", "cluster", F.col("canonical.name").alias("name"), F.col("canonical.normalized_name").alias("normalized_name"), "aliases", "domains", "tax_ids", "pans", "member_names")
    oldest = entities.groupBy("ws", "normalized_name").agg(F.min_by("entity_id", F.struct("created_at", "entity_id")).alias("entity_id"))
    target = made.join(oldest, ["ws", "normalized_name"], "left").withColumn("_n", F.row_number().over(Window.partitionBy("ws", F.coalesce("entity_id", "cluster")).orderBy("cluster")))
    target = target.withColumn("entity_id", F.coalesce(F.when(F.col("_n") == 1, F.col("entity_id")), F.concat(F.lit("new:"), F.col("cluster").cast("string")))).drop("_n")
    pans = F.array_compact(F.transform("e_tax_ids", lambda x: names.pan_of(x)))
    other = entities.where("NOT human_confirmed").select("ws", F.col("entity_id").alias("from_id"), F.col("normalized_name").alias("_m"), F.col("name").alias("e_name"), F.col("aliases").alias("e_aliases"), F.col("domains").alias("e_domains"), F.col("tax_ids").alias("e_tax_ids")).withColumn("e_pans", pans)
    near = target.select("ws", F.col("entity_id").alias("to_id"), "tax_ids", "pans", F.explode("member_names").alias("_m")).join(other, ["ws", "_m"]).where("from_id != to_id")
    clash = (F.size("tax_ids") > 0) & (F.size("e_tax_ids") > 0) & ~F.arrays_overlap("tax_ids", "e_tax_ids") & ~F.arrays_overlap("pans", "e_pans")
    taken = near.where(~clash).join(target.select("ws", F.col("entity_id").alias("from_id")), ["ws", "from_id"], "left_anti")
    taken = taken.groupBy("ws", "from_id").agg(F.min_by(F.struct("to_id", "e_name", "e_aliases", "e_domains", "e_tax_ids"), "to_id").alias("t")).select("ws", "from_id", "t.*")
    moves = taken.select("ws", "from_id", "to_id")
    extra = taken.groupBy("ws", F.col("to_id").alias("entity_id")).agg(
        F.flatten(F.collect_list(F.array_union(F.coalesce("e_aliases", F.array().cast("array<string>")), F.array("e_name")))).alias("x_aliases"), F.flatten(F.collect_list("e_domains")).alias("x_domains"), F.flatten(F.collect_list("e_tax_ids")).alias("x_tax_ids"),
    )
    none = F.array().cast("array<string>")
    kept = entities.select("ws", "entity_id", *(F.col(c).alias(f"k_{c}") for c in ("name", "normalized_name", "aliases", "domains", "tax_ids", "human_confirmed")))
    both = target.drop("pans", "member_names", "cluster").join(extra, ["ws", "entity_id"], "left").join(kept, ["ws", "entity_id"], "full")
    sure = F.coalesce("k_human_confirmed", F.lit(False))
    own = lambda c: F.when(sure | F.col("name").isNull(), F.col(f"k_{c}")).otherwise(F.col(c))
    wide = lambda c: F.array_sort(F.array_union(F.coalesce(own(c), none), F.coalesce(f"x_{c}", none))).alias(c)
    after = both.select("ws", "entity_id", own("name").alias("name"), own("normalized_name").alias("normalized_name"), wide("aliases"), wide("domains"), wide("tax_ids"), sure.alias("human_confirmed"))
    after = after.join(moves.select("ws", F.col("from_id").alias("entity_id")), ["ws", "entity_id"], "left_anti")
    holds = owned.join(moves.withColumnRenamed("from_id", "entity_id"), ["ws", "entity_id"], "left").select("ws", F.coalesce("to_id", "entity_id").alias("entity_id"), F.lit(True).alias("owns")).distinct()
    linked = target.select("ws", "entity_id", F.lit(True).alias("owns"))  # a cluster's records are its evidence
    return after.join(holds.unionByName(linked).distinct(), ["ws", "entity_id"], "left").where("owns OR human_confirmed").drop("owns"), moves


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG15: precision and recall of predictions (said, true) by key; 1 where there is nothing to be right about."""
    by = rows.groupBy(*keys).agg(F.count_if(F.col("said") & F.col("true")).alias("tp"), F.count_if(F.col("said") & ~F.col("true")).alias("fp"), F.count_if(~F.col("said") & F.col("true")).alias("fn"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)))
    return by.select(*keys, rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"))


def blocking_recall(recs: DataFrame, true_pairs: DataFrame) -> DataFrame:
    """AGG15: the share of true pairs (ws, l, r) that blocking proposes."""
    met = true_pairs.join(candidate_pairs(recs).select("ws", "l", "r", F.lit(True).alias("met")), ["ws", "l", "r"], "left")
    return met.groupBy("ws").agg((F.count_if("met") / F.count("*")).alias("recall"))


def without_evidence(entities: DataFrame, *owners: DataFrame) -> DataFrame:
    """SET5: entities (ws, customer_id) that no evidence table names."""
    owned = owners[0].select("ws", "customer_id")
    for o in owners[1:]:
        owned = owned.unionByName(o.select("ws", "customer_id"))
    return entities.join(owned.where("customer_id IS NOT NULL").distinct(), ["ws", "customer_id"], "left_anti")


def shared_attribute_pairs(rows: DataFrame, max_group: int = MAX_BLOCK) -> DataFrame:
    """JN19: clusters that share a domain or address (ws, cluster, attribute)."""
    distinct = rows.select("ws", "cluster", "attribute").distinct()
    fit = distinct.groupBy("ws", "attribute").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= max_group)).select("ws", "attribute")
    m = distinct.join(fit, ["ws", "attribute"])
    return m.withColumnRenamed("cluster", "a").join(m.withColumnRenamed("cluster", "b"), ["ws", "attribute"]).where("a < b")
