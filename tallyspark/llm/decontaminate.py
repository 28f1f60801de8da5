"""Benchmark decontamination through a positional inverted index of the training texts.

The index is partitioned by document: each row holds the postings of some whole documents, that is, the distinct
terms in order and for each term the ascending positions at which it stands. It is written to the shared folder once
and then searched with any number of test items. A search takes a window's rarest term in the segment, moves that
term's postings back by its offset and keeps the candidates whose other terms, rarest first, stand at their offsets,
which is an intersection of offset-adjusted lists; all windows of all items go through it together.

Proximity matches are found by the same index: of an item's distinct terms, the `NEAR_TERMS` rarest of the whole corpus (ties: the first in the item)
are taken; each one's list is moved back by the term's first place in the item, and a match is a place of the rarest
term for which every other list holds one of the same document within `SLOP` words.

Test items are searched in blocks of `BLOCK_WORDS` words at most, one after the other: the driver and a task hold one block at a time.

Nulls and texts without words have no positions and are never hit. An item without words has no window. Repeated items
and ids count once in `items`; a null item id is written "null". Repeated document ids are separate rows. An empty
index or an empty item table gives rows without hits. Very long documents are indexed whole, as rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

WINDOW = 13
BLOCK_WORDS = 2_000_000
#: Rows of the index in a file: a task that writes or reads them holds a file's.
SEGMENTS_PER_FILE = 4
INDEX_SCHEMA = "docs array<long>, ends array<int>, terms array<binary>, counts array<int>, steps binary"
NEAR_TERMS, SLOP = 4, 3
HIT_SCHEMA = "segment long, place int, doc_id long, n_words long, spans array<struct<first:int,last:int>>, items array<string>, near array<string>"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents, staged: one row for each stretch of about 4 MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in C.pieces(batch, text):
                data, offsets = C.utf8(piece.column(text))
                data = C.LOWER[data]
                found = C.words(data, offsets, C.ALNUM_LOWER)
                codes, terms = C.coded(C.word_array(data, found))
                order = np.argsort(codes, kind="stable").astype(np.int64)
                counts = np.bincount(codes, minlength=len(terms))
                steps = np.diff(order, prepend=0)
                first = np.cumsum(counts) - counts
                steps[first] = order[first]  # each list starts afresh
                row = {"docs": pa.array([piece.column(key).to_pylist()], pa.list_(pa.int64())), "ends": _lists(found[2][1:], pa.int32()), "terms": pa.ListArray.from_arrays([0, len(terms)], terms.cast(pa.binary())), "counts": _lists(counts, pa.int32()), "steps": pa.array([steps.astype("<i4").tobytes()], pa.binary())}
                yield pa.RecordBatch.from_pydict(row)

    rows = docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, INDEX_SCHEMA)
    return C.staged(rows.withColumn("segment", F.monotonically_increasing_id()), "postings", SEGMENTS_PER_FILE)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays([0, len(values)], pa.array(values).cast(kind))


class Windows:
    """The windows of some items over a table of their distinct terms."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        at: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        by_width: dict[int, tuple[list[int], list[list[int]]]] = {}
        for i, (_, terms) in enumerate(items):
            ids = [at.setdefault(t, len(at)) for t in terms]
            w = min(width, len(ids))
            owners, rows = by_width.setdefault(w, ([], []))
            for k in range(len(ids) - w + 1 if w else 0):
                owners.append(i)
                rows.append(ids[k : k + w])
        self.terms = list(at)
        self.groups = [(np.array(o, np.int64), np.array(r, np.int64)) for w, (o, r) in sorted(by_width.items()) if w and o]
        self.owner = np.repeat(np.arange(len(items)), [len(t) for _, t in items])
        self.word = np.array([at[t] for _, terms in items for t in terms], np.int64)
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(t)) for _, t in items)])
        self.near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def choose(self, counts: np.ndarray, terms: int = NEAR_TERMS) -> None:
        """Each item's rarest terms by their counts in the corpus: owners, terms and places, by number of terms."""
        order = np.lexsort((self.place, self.word, self.owner))
        o, w, p = self.owner[order], self.word[order], self.place[order]
        first = np.ones(len(o), bool)
        first[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1])
        o, w, p = o[first], w[first], p[first]
        order = np.lexsort((p, counts[w], o))
        o, w, p = o[order], w[order], p[order]
        begins = np.searchsorted(o, np.arange(len(self.names)))
        sizes = np.minimum(np.diff(np.append(begins, len(o))), terms)
        self.near = []
        for k in np.unique(sizes[sizes > 0]):
            items = np.flatnonzero(sizes == k)
            at = begins[items][:, None] + np.arange(k)
            self.near.append((items, w[at], p[at]))


def item_blocks(bench: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with their words, in blocks; the driver holds one block at a time."""
    block, held = [], 0
    for row in bench.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).toLocalIterator():
        data, offsets = C.utf8(pa.array([row["t"]], pa.string()))
        data = C.LOWER[data]
        terms = C.word_array(data, C.words(data, offsets, C.ALNUM_LOWER)).to_pylist()
        block.append(("null" if row["k"] is None else row["k"], terms))
        held += len(terms)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


class Segment:
    """One row of the index, opened for search."""

    def __init__(self, row: dict):
        self.ends = np.asarray(row["ends"], np.int64)
        self.counts = np.asarray(row["counts"], np.int64)
        steps = np.frombuffer(row["steps"], "<i4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        run = np.cumsum(steps)
        self.positions = run - np.repeat((run - steps)[self.first] if len(steps) else run, self.counts)
        self.size = max(1, len(steps))
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.size + self.positions
        self.terms = row["terms"]

    def codes(self, terms: pa.Array) -> np.ndarray:
        """This segment's code of each term, -1 for those it lacks."""
        got = pc.index_in(terms, value_set=self.terms.cast(terms.type))
        return np.nan_to_num(got.to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(np.int64)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right")

    def occurrences(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, first position) of every occurrence of each row of term codes, within one document."""
        width = rows.shape[1]
        alive = np.flatnonzero((rows >= 0).all(axis=1))
        if not len(alive):
            return alive, alive
        rows = rows[alive]
        by_count = np.argsort(self.counts[rows], axis=1, kind="stable")
        rarest = by_count[:, 0]
        term = rows[np.arange(len(rows)), rarest]
        n = self.counts[term]
        row = np.repeat(np.arange(len(rows)), n)
        start = self.positions[C.ragged(self.first[term], n)] - np.repeat(rarest, n)
        keep = (start >= 0) & (start + width <= self.size)
        row, start = row[keep], start[keep]
        for k in range(1, width):
            offset = by_count[row, k]
            want = rows[row, offset] * self.size + start + offset
            keep = self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want
            row, start = row[keep], start[keep]
        keep = self.doc_of(start) == self.doc_of(start + width - 1)
        return alive[row[keep]], start[keep]


    def within(self, rows: np.ndarray, places: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of every place of a row's first term that has the others near where they stand in the item."""
        alive = np.flatnonzero((rows >= 0).all(axis=1))
        if not len(alive):
            return alive, alive
        rows, places = rows[alive], places[alive]
        n = self.counts[rows[:, 0]]
        row = np.repeat(np.arange(len(rows)), n)
        at = self.positions[C.ragged(self.first[rows[:, 0]], n)]
        ends = np.append(self.ends, self.size)
        doc = self.doc_of(at)
        low, high = np.where(doc > 0, ends[doc - 1], 0), ends[doc] - 1
        for k in range(1, rows.shape[1]):
            want = at + places[row, k] - places[row, 0]
            least, most = np.maximum(want - slop, low), np.minimum(want + slop, high)
            key = rows[row, k] * self.size
            got = self.keys[np.minimum(np.searchsorted(self.keys, key + least), len(self.keys) - 1)]
            keep = (got >= key + least) & (got <= key + most)
            row, at, low, high = row[keep], at[keep], low[keep], high[keep]
        return alive[row], at


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, list, Segment]]:
    for i in range(len(batch)):
        at = {c: batch.column(c)[i] for c in ("ends", "counts", "steps", "terms")}
        row = {"ends": at["ends"].values.to_numpy(), "counts": at["counts"].values.to_numpy(), "steps": at["steps"].as_py(), "terms": at["terms"].values}
        yield batch.column("segment")[i].as_py(), batch.column("docs")[i].as_py(), Segment(row)


def corpus_counts(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    """How often each term stands in the corpus. A row for each term that occurs comes back, so a block bounds them."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.binary())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                own, counts = batch.column("terms")[i].values, batch.column("counts")[i].values.to_numpy()
                place = pc.index_in(wanted, value_set=own.cast(wanted.type))
                have = np.asarray(place.is_valid())
                total[have] += counts[place.drop_null().to_numpy()]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def search(index: DataFrame, items: list[tuple[str, list[bytes]]], width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """A row for every document: its hit word positions as disjoint spans, the ids of the items with occurring windows, and of those near."""
    windows = Windows(items, width)
    if windows.terms:
        windows.choose(corpus_counts(index, windows.terms))
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(windows)  # of a block, so of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        terms = pa.array(windows.terms, pa.binary())
        for batch in batches:
            for segment, docs, s in _segments(batch):
                code = s.codes(terms)
                edge = np.zeros(s.size + 1, np.int64)
                pairs = [np.zeros((0, 2), np.int64)]
                for owners, rows in windows.groups:
                    row, start = s.occurrences(code[rows])
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + rows.shape[1], -1)
                    if len(row):
                        pairs.append(np.unique(np.stack([s.doc_of(start), owners[row]], axis=1), axis=0))
                begins = np.concatenate([[0], s.ends[:-1]])
                hit = np.cumsum(edge[:-1]) > 0
                spans: list[list] = [[] for _ in docs]
                cut = np.zeros(s.size + 1, bool)
                cut[s.ends] = True
                before = np.concatenate([[False], hit[:-1]]) & ~cut[: s.size]
                after = np.concatenate([hit[1:], [False]]) & ~cut[1:]
                for a, b in zip(np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after), strict=True):
                    d = int(s.doc_of(a))
                    spans[d].append({"first": int(a - begins[d]), "last": int(b - begins[d])})
                names: list[list] = [[] for _ in docs]
                for d, i in np.concatenate(pairs).tolist():
                    names[d].append(windows.names[i])
                near: list[list] = [[] for _ in docs]
                for owners, rows, places in windows.near:
                    row, at = s.within(code[rows], places, slop)
                    if len(row):
                        for d, i in np.unique(np.stack([s.doc_of(at), owners[row]], axis=1), axis=0).tolist():
                            near[d].append(windows.names[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment] * len(docs), pa.int64()), pa.array(range(len(docs)), pa.int32()), pa.array(docs, pa.int64()), pa.array(s.ends - begins), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(names, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))],
                    ["segment", "place", "doc_id", "n_words", "spans", "items", "near"],
                )

    return index.mapInArrow(run, HIT_SCHEMA)


def find(index: DataFrame, bench: DataFrame, width: int = WINDOW, key: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Matches of all items: doc_id, n_words, n_hit (words inside any occurrence of a window), items, and near (items with a proximity match)."""
    blocks = item_blocks(bench, key, text, block_words)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        rows = search(index, block, width)
    else:  # each block's documents with hits are written before the next block is read
        hits = None
        while block is not None:
            found = C.staged(search(index, block, width).where("size(items) > 0 OR size(near) > 0").select("segment", "place", "spans", "items", "near"), "hits")
            hits = found if hits is None else hits.unionByName(found)
            block, following = following, next(blocks, None) if following is not None else None
        together = hits.groupBy("segment", "place").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "near")))
        rows = search(index, [], width).drop("spans", "items", "near").join(together, ["segment", "place"], "left")
        rows = rows.withColumns({c: F.coalesce(c, F.array().cast(dict(together.dtypes)[c])) for c in ("spans", "items", "near")})
    covered = F.aggregate(  # spans in order; those of several blocks can overlap
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], a["to"] + 1) + 1)).alias("n"), F.greatest(a["to"], s["last"]).alias("to")),
    )["n"]
    named = lambda c: F.array_sort(F.array_distinct(c)).alias(c)
    return rows.select("doc_id", "n_words", covered.alias("n_hit"), named("items"), named("near"), "segment", "place")


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    found = find(build_index(docs), bench)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


#: The same rows in DuckDB's SQL; a word and those after it.
RUN = ", ".join(f"lead(w, {i}) OVER o" for i in range(WINDOW))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS id, coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
widths AS (SELECT DISTINCT least(len(w), {WINDOW}) AS k FROM b WHERE len(w) > 0),
words AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM d),
asked AS (SELECT id, item, len, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT *, len(w) AS len FROM b)),
phrases AS (SELECT DISTINCT item, k, array_to_string(r[1:k], ' ') AS phrase FROM (SELECT item, least(len, {WINDOW}) AS k, len, pos, [{RUN}] AS r FROM asked WINDOW o AS (PARTITION BY id ORDER BY pos)) WHERE pos + k - 1 <= len),
places AS (SELECT id, k, i, array_to_string(r[1:k], ' ') AS phrase FROM (SELECT id, pos AS i, [{RUN}] AS r FROM words WINDOW o AS (PARTITION BY id ORDER BY pos)), widths WHERE r[k] IS NOT NULL),
hits AS (SELECT p.id, p.k, p.i, q.item FROM places p JOIN phrases q USING (k, phrase)),
covered AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(generate_series(i, i + k - 1)) AS pos FROM hits) GROUP BY id),
named AS (SELECT id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY id),
terms AS (SELECT id, item, w, min(pos) AS pos FROM asked GROUP BY ALL),
counted AS (SELECT t.*, row_number() OVER (PARTITION BY t.id ORDER BY coalesce(c.n, 0), t.pos) AS r FROM terms t LEFT JOIN (SELECT w, count(*) AS n FROM words GROUP BY w) c USING (w)),
chosen AS (SELECT * FROM counted WHERE r <= {NEAR_TERMS}),
sizes AS (SELECT id, count(*) AS n FROM chosen GROUP BY id),
starts AS (SELECT c.id AS b, c.item, w.id, w.pos, c.pos AS offset_ FROM chosen c JOIN words w USING (w) WHERE c.r = 1),
met AS (
  SELECT s.b, s.item, s.id, s.pos, count(DISTINCT c.r) AS n FROM starts s JOIN chosen c ON c.id = s.b JOIN words w ON w.id = s.id AND w.w = c.w
  WHERE CASE WHEN c.r = 1 THEN w.pos = s.pos ELSE abs(w.pos - s.pos - c.pos + s.offset_) <= {SLOP} END GROUP BY ALL),
near AS (SELECT m.id, count(DISTINCT m.item) AS n_near FROM met m JOIN sizes z ON m.b = z.id AND m.n = z.n GROUP BY m.id)
SELECT doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered USING (id) LEFT JOIN named USING (id) LEFT JOIN near USING (id)
"""
