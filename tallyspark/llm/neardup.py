"""Near-duplicate classes by DartMinHash.

A text is the weighted set of its word 5-grams, a gram's weight being how often it occurs (a text of fewer words, but not
none, is one gram). Each unit of an element's weight is a region at which hashed darts are thrown: a Poisson process
whose arrival times and coordinates depend only on the element, the unit and the dart's number. A text of n units looks at the
darts that arrive before `DARTS` / n, about `DARTS` of them whatever its length, and keeps the earliest of each of `K`
coordinates; if a coordinate has none, the text looks twice as long. Two signatures agree in a coordinate with the
probability of their weighted Jaccard similarity.

`BANDS` bands of `ROWS` coordinates make the candidates. Texts with equal weighted sets are folded into one node first. In a band's bucket
not everybody is paired with everybody: leaders are compared with the members, and their links are closed to classes. A bucket whose members are
of one class by then is done; in any other, whoever isn't of its largest class meets every member of another class (see `links`). So each two
nodes that share a bucket are in one class or were compared. A link counts only if the texts' exact similarity reaches the threshold.

Nulls: a null text is a class of its own. Texts without words are classes of equal texts. Equal rows are copies of each other. The row
kept of a class has the lowest doc_id (nulls first). A very long text is hashed whole; its darts are as many as any other's. An empty table gives an empty result. `deduplicated` passes all
columns on.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

GRAM = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
K = BANDS * ROWS
DARTS = int(K * (log(K) + 3))
#: Signatures that agree in this share of coordinates are checked exactly; at 0.8, one true link in 10^5 agrees in less.
MAYBE = 0.62
#: In buckets up to this size one leader is tried.
SMALL_BUCKET = 24
#: Nodes, and bytes of their grams, on either side of a group of comparisons in larger buckets.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Bytes of text worked on at once in a task; a longer text is still worked on whole.
PIECE = 1 << 20
#: Rows of two longs that may be broadcast.
SMALL = 400_000
SKETCH_SCHEMA = "doc_id long, th long, a long, b long, n long, sig binary, bands array<long>"

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x5851F42D4C957F2D, i + 1, 1 << 64) for i in range(GRAM)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each unit of weight of each text's grams, and offsets by text."""
    data, offsets = C.utf8(texts)
    data = C.LOWER[data]
    found = C.words(data, offsets, C.ALNUM_LOWER)
    codes, distinct = C.coded(C.word_array(data, found))
    hashes = pd.util.hash_array(np.array(distinct.to_pylist(), object)) if len(distinct) else np.zeros(0, np.uint64)
    word = hashes[codes]
    of_doc = found[2]
    n_words = np.diff(of_doc)
    n = np.where(n_words >= GRAM, n_words - GRAM + 1, np.minimum(n_words, 1))
    ends = np.concatenate([[0], np.cumsum(n)])
    first = C.ragged(of_doc[:-1], n)
    padded = np.concatenate([word, np.zeros(GRAM, np.uint64)])
    gram = np.zeros(len(first), np.uint64)
    size = np.minimum(n_words, GRAM).repeat(n)
    for k in range(GRAM):
        gram += np.where(k < size, padded[first + k], np.uint64(0)) * _POWERS[k]
    gram = mix(gram + size.astype(np.uint64))
    order, same = C.repeated(gram, np.repeat(np.arange(len(n)), n))
    if same.any():
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        nth = np.zeros(len(order), np.uint64)
        nth[order] = run
        gram = np.where(nth > 0, mix(gram + nth * GOLDEN), gram)
    return gram, ends


def throw(unit: np.ndarray, ends: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Earliest darts of each text and coordinate that arrive before the text's reach: time in the upper 32 bits, dart in the lower; all ones for none."""
    n_docs = len(ends) - 1
    out = np.full(n_docs * K, np.uint64(0xFFFFFFFFFFFFFFFF))
    doc = np.repeat(np.arange(n_docs), np.diff(ends))
    limit, time, seed = reach[doc], np.zeros(len(unit)), unit
    number = 0
    while len(seed):
        number = (number + int(GOLDEN)) % 2**64
        dart = mix(seed + np.uint64(number))
        time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        near = time < limit
        doc, limit, time, seed, dart = doc[near], limit[near], time[near], seed[near], dart[near]
        label = mix(dart ^ GOLDEN)
        at = doc * K + (label >> np.uint64(32)).astype(np.int64) % K
        np.minimum.at(out, at, (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (label & np.uint64(0xFFFFFFFF)))
    return out.reshape(n_docs, K)


def signatures(unit: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """K labels of 32 bits for each text; zeros for a text without units."""
    n = np.diff(ends)
    reach = np.where(n > 0, DARTS / np.maximum(n, 1), 0.0)
    best = throw(unit, ends, reach)
    while len(short := np.flatnonzero((n > 0) & (best == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1))):
        reach[short] *= 2
        best[short] = throw(unit[C.ragged(ends[short], n[short])], np.concatenate([[0], np.cumsum(n[short])]), reach[short])
    return np.where(n[:, None] > 0, best & np.uint64(0xFFFFFFFF), 0).astype(np.uint32)


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def sketches(docs: DataFrame) -> DataFrame:
    """One row a document: its text's hash, the key (a, b) and size n of its weighted set, its signature and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in C.pieces(batch, "text", PIECE):
                unit, ends = units(piece.column("text"))
                n = np.diff(ends)
                sig = signatures(unit, ends)
                totals = [np.concatenate([[0], np.cumsum(mix(unit + np.uint64(s)))]).astype(np.uint64) for s in (1, 2)]
                a, b = ((t[ends[1:]] - t[ends[:-1]]).view(np.int64) for t in totals)
                a = np.where(n > 0, a, piece.column("th").to_numpy(zero_copy_only=False))  # without words: by the whole text
                bands = np.zeros((len(n), BANDS), np.uint64)
                for i in range(BANDS):
                    h = np.full(len(n), np.uint64(i + 1)) * GOLDEN
                    for j in range(ROWS):
                        h = mix(h + sig[:, i * ROWS + j].astype(np.uint64))
                    bands[:, i] = h
                n = np.where(np.asarray(piece.column("missing")), -1, n)
                kept = np.where(n > 0, BANDS, 0)
                flat = bands[n > 0].reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("th"), pa.array(a), pa.array(b), pa.array(n), pa.array([s.tobytes() for s in sig.astype("<u4")], pa.binary()), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32), pa.array(flat))],
                    ["doc_id", "th", "a", "b", "n", "sig", "bands"],
                )
            C.trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key(F.col("text")).alias("th"), F.col("text").isNull().alias("missing")).mapInArrow(run, SKETCH_SCHEMA)
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    alone = F.col("n") < 0
    return C.staged(rows.withColumns({"a": F.when(alone, F.col("uid")).otherwise(F.col("a")), "b": F.when(alone, -1).otherwise(F.col("b"))}), "sketches")


def agreement(pairs: DataFrame) -> DataFrame:
    """`pairs` with `share`, the share of coordinates in which sig_u and sig_v agree."""
    names = [c for c in pairs.columns if c not in ("sig_u", "sig_v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.frombuffer(C.utf8(batch.column(c))[0].tobytes(), "<u4").reshape(-1, K) for c in ("sig_u", "sig_v"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array((u == v).mean(axis=1))], [*names, "share"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "share double"]))


def _shares(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """The (u, v) among `pairs` that agree in `MAYBE` of their coordinates or more."""
    both = pairs.join(sig.select(F.col("node").alias("u"), F.col("sig").alias("sig_u")), "u").join(sig.select(F.col("node").alias("v"), F.col("sig").alias("sig_v")), "v")
    return C.staged(agreement(both).where(F.col("share") >= MAYBE).select("u", "v"), "close")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _linked(lead: int, others: np.ndarray, best_first: np.ndarray, groups: np.ndarray, grams: list[np.ndarray]) -> list[int]:
    """Of the `others`, taken in the order `best_first`, one for each group that holds a text similar to `lead`'s."""
    found, own = [], grams[lead]
    step = 1
    while len(best_first):
        now, best_first = best_first[:step], best_first[step:]
        step = min(4 * step, 512)
        sizes = np.array([len(grams[others[k]]) for k in now])
        place = np.searchsorted(own, flat := np.concatenate([grams[others[k]] for k in now]))
        hit = own[np.minimum(place, len(own) - 1)] == flat
        shared = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        for k in now[shared >= THRESHOLD * (len(own) + sizes - shared)]:
            if groups[k] not in {groups[f] for f in found}:
                found.append(k)
        best_first = best_first[~np.isin(groups[best_first], groups[found])] if found else best_first
    return found


def _compare(block: pa.Table) -> pa.Table:
    """Links between the block's open nodes and its members, as many as bring its classes together. Classes that the nodes have already, and
    those that the block's own links make of them, need no second link. What two nodes share an earlier band of is left to that band's bucket."""
    node, opens, band = block.column("node").to_numpy(), block.column("opens").to_numpy(zero_copy_only=False), block.column("band")[0].as_py()
    group = np.unique(block.column("label").to_numpy(), return_inverse=True)[1]
    sigs = np.frombuffer(C.utf8(block.column("sig"))[0].tobytes(), "<u4").reshape(-1, K)
    data, ends = C.utf8(block.column("grams"))
    flat, ends = np.frombuffer(data.tobytes(), np.uint64), ends // 8
    grams = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    size = np.diff(ends)
    others = np.flatnonzero(~opens)
    to = np.ascontiguousarray(sigs[others].T)
    out = []
    for lead in np.flatnonzero(opens)[np.argsort(node[opens], kind="stable")]:
        same = np.zeros(len(others), np.uint8)
        earlier = np.zeros(len(others), bool)
        for i in range(BANDS):
            in_band = np.zeros(len(others), np.uint8)
            for k in range(i * ROWS, (i + 1) * ROWS):
                in_band += to[k] == sigs[lead, k]
            if i < band:
                earlier |= in_band == ROWS
            same += in_band
        alike = np.minimum(size[others], size[lead]) >= THRESHOLD * np.maximum(size[others], size[lead])
        maybe = np.flatnonzero((same >= MAYBE * K) & alike & ~earlier & (group[others] != group[lead]))
        if len(maybe):
            best_first = maybe[np.lexsort((node[others[maybe]], -same[maybe].astype(np.int64)))]
            for k in _linked(lead, others, best_first, group[others], grams):
                out.append((min(node[lead], node[others[k]]), max(node[lead], node[others[k]])))
                group[group == group[others[k]]] = group[lead]
    return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})


def _crossed(mixed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between the open nodes of large buckets and those buckets' members of other classes. Both sides are dealt by hash into blocks of about `BLOCK`
    nodes or `BLOCK_BYTES` bytes, and each two blocks are a group of their own, so a bucket of any size is spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in C.pieces(batch, "text", PIECE):
                unit, ends = units(piece.column("text"))
                sets = [np.sort(unit[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(sets, pa.binary())], ["node", "grams"])

    texts = texts_of(mixed.select("node").distinct(), nodes, docs)
    grams = C.staged(texts.mapInArrow(run, "node long, grams binary").join(nodes.select("node", "n", "sig"), "node"), "grams")
    mixed = mixed.withColumn("opens", F.col("label") != F.col("top"))
    blocks = lambda count, bytes_: F.greatest(F.ceil(count / BLOCK), F.ceil(bytes_ * 8 / BLOCK_BYTES)).cast("int")
    size = mixed.join(nodes.select("node", "n"), "node").groupBy("bucket").agg(
        blocks(F.count("*"), F.sum("n")).alias("nm"), blocks(F.count_if("opens"), F.sum(F.when(F.col("opens"), F.col("n")).otherwise(0))).alias("no")
    )
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = mixed.join(size, "bucket").join(grams, "node")
    columns = ["bucket", "band", "node", "label", "sig", "grams"]
    leads = rows.where("opens").select(*columns, F.lit(True).alias("opens"), dealt("no").alias("i"), every("nm").alias("j"))
    meets = rows.select(*columns, F.lit(False).alias("opens"), every("no").alias("i"), dealt("nm").alias("j"))
    return C.staged(leads.unionByName(meets).groupBy("bucket", "i", "j").applyInArrow(_compare, "u long, v long").distinct(), "crossed")


def labelled(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and label, the lowest node of its class, of all nodes that are linked: that is, whose texts reach the threshold. There are enough links that classes are whole.

    A node's crowd is the sum of its buckets' sizes: among copies of one text, those nearest to all others have the largest, so they lead.
    In each round a bucket's leader meets all who wait, and those that it is linked to wait no longer. While a bucket has more than `SMALL_BUCKET`
    members and its leader is linked to a quarter of those who waited, the others wait for the next leader, so that the rounds
    are bounded by the logarithm of its size. The links so far make classes. Where a bucket holds several, its nodes outside the largest one are open and meet all
    its members of other classes.
    """
    member = nodes.select(F.posexplode("bands").alias("band", "bucket"), "node")
    shared = member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    member = member.join(shared, "bucket")
    crowd = C.staged(member.groupBy("node").agg(F.sum("m").alias("crowd")), "crowd")
    member = C.staged(member.join(crowd, "node"), "buckets")
    sig = nodes.select("node", "sig")
    first = F.max_by("node", F.struct("crowd", -F.col("node")))
    waiting, found, seen = member, None, None

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among pairs that no round has had yet. Close pairs are staged, so that a round's plan doesn't hold those of all before."""
        nonlocal found, seen
        new = C.staged(_shares(pairs if seen is None else pairs.join(seen, ["u", "v"], "left_anti"), sig), "pairs")
        good = verified(new, nodes, docs)
        found = good if found is None else found.unionByName(good)
        seen = new if seen is None else seen.unionByName(new)
        return good

    while True:
        leaders = waiting.groupBy("bucket").agg(first.alias("leader"), F.count("*").alias("w"))
        tried = waiting.join(leaders, "bucket").where("node != leader")
        checked(tried.select(*_ordered("node", "leader")).distinct())
        told = found.select(F.col("u").alias("node"), F.col("v").alias("leader")).unionByName(found.select(F.col("v").alias("node"), F.col("u").alias("leader")))
        left = C.staged(tried.join(told, ["node", "leader"], "left_anti").select("bucket", "node", "m", "crowd", "w"), "left")
        again = left.where(F.col("m") > SMALL_BUCKET).groupBy("bucket").agg(F.count("*").alias("now"), F.first("w").alias("w")).where("4 * (w - 1 - now) >= w").select("bucket")
        waiting = C.staged(left.join(again, "bucket", "left_semi").select("bucket", "node", "m", "crowd"), "waiting")
        if waiting.isEmpty():
            break
    labels = components(found)
    told = member.join(labels, "node", "left").select("bucket", "band", "node", "m", F.coalesce("label", "node").alias("label"))
    by_label = told.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    several = by_label.groupBy("bucket").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("bucket", "top")
    mixed = C.staged(told.join(several, "bucket"), "mixed")
    few, many = mixed.where(F.col("m") <= SMALL_BUCKET), mixed.where(F.col("m") > SMALL_BUCKET)
    opened = few.where("label != top").select("bucket", F.col("node").alias("leader"), F.col("label").alias("own"))
    pairs = few.join(opened, "bucket").where("label != own").select(*_ordered("node", "leader")).distinct()
    late = checked(pairs)
    return merged(labels, late if many.isEmpty() else late.unionByName(_crossed(many, nodes, docs)))


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts, pair by pair."""
    unit, ends = units(pa.concat_arrays([left, right]))
    n, size = len(left), np.diff(ends)
    pair = np.repeat(np.arange(2 * n) % n, size)
    order = np.lexsort((unit, pair))
    u, p = unit[order], pair[order]
    common = np.bincount(p[1:][(u[1:] == u[:-1]) & (p[1:] == p[:-1])], minlength=n)
    total = size[:n] + size[n:] - common
    return np.where(total > 0, common / np.maximum(total, 1), 0.0)


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the wanted nodes. Their keys are sent to the texts while they are few, else both are shuffled."""
    wanted = C.staged(wanted.join(nodes.select("node", "doc_id", "th"), "node"), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), "text", _key(F.col("text")).alias("h"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))
    return C.staged(keyed.join(side, same).groupBy("node").agg(F.first("text").alias("text")), "texts")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs, which are staged, whose texts reach the threshold, by exact similarity of whole texts."""
    texts = texts_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in C.pieces(batch, "tu", PIECE):
                good = pa.array(similarity(piece.column("tu"), piece.column("tv")) >= THRESHOLD)
                yield pa.RecordBatch.from_arrays([piece.column("u").filter(good), piece.column("v").filter(good)], ["u", "v"])
            C.trim()

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    return C.staged(both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node and label, the lowest node of its component, for all nodes with links. Labels spread over links and then jump to their own label's label."""
    edges = C.staged(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = C.staged(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        spread = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").select(F.col("u").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        nearer = spread.unionByName(labels.withColumn("own", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("own").alias("own"))
        nearer = C.staged(nearer.select("node", "label", (F.col("label") < F.col("own")).alias("moved")), "labels")
        moved = not nearer.where("moved").isEmpty()
        if not moved:
            return labels
        up = nearer.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = C.staged(nearer.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels as `components` gives them, after more links: only the labels that these join are gone through again, not all links."""
    label = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    between = more.join(label("u"), "u", "left").join(label("v"), "v", "left").select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v")).where("u != v")
    between = C.staged(between, "between")
    if between.isEmpty():
        return labels
    up = components(between)
    moved = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return C.staged(moved.unionByName(up.join(labels, "node", "left_anti")), "labels")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, th, class_id (the class's lowest doc_id), class_size and kept for every row."""
    rows = sketches(docs)
    folded = rows.groupBy("a", "b", "n").agg(
        F.min("uid").alias("node"), F.min_by("doc_id", "uid").alias("doc_id"), F.min_by("th", "uid").alias("th"), F.min_by("sig", "uid").alias("sig"), F.min_by("bands", "uid").alias("bands"),
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "uid")).alias("first"),
    )
    nodes = C.staged(folded, "nodes")
    told = nodes.join(labelled(nodes, docs), "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_class = told.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    told = told.select("a", "b", "n", "label").join(of_class, "label").drop("label")
    told = told.select(*(F.col(c).alias(f"k_{c}") for c in ("a", "b", "n")), "first", "class_size")
    same = (F.col("a") == F.col("k_a")) & (F.col("b") == F.col("k_b")) & (F.col("n") == F.col("k_n"))
    return rows.join(told, same).select("doc_id", "th", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("first.uid") == F.col("uid")).alias("kept"), "uid")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns. A null text is a class of its own, so those rows stay without a look; of rows with the kept one's
    id and text, any is taken, and they are folded before they are shuffled."""
    d, h = "__neardup_d", "__neardup_h"  # beside whatever columns there are
    keep = classes(docs.where(F.col("text").isNotNull())).where("kept").select(F.col("doc_id").alias(d), F.col("th").alias(h)).distinct()
    keyed = docs.where(F.col("text").isNotNull()).withColumns({d: F.col("doc_id").cast("long"), h: _key(F.col("text"))})
    keep = keep.select(F.col(d).alias("__neardup_kd"), F.col(h).alias("__neardup_kh"))
    found = keyed.join(keep, F.col(d).eqNullSafe(F.col("__neardup_kd")) & (F.col(h) == F.col("__neardup_kh")), "left_semi").dropDuplicates([d, h])
    return found.select(*docs.columns).unionByName(docs.where(F.col("text").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
