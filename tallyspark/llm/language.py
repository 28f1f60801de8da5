"""Language identification by prediction by partial matching (PPM).

For each language, a context tree of up to `ORDER` bytes counts which byte follows which context. A byte's code length
is that of its frequency in the longest known context; where the context never saw the byte, an escape (method C: as
many escape counts as distinct followers) is paid and the next shorter context is asked, down to the uniform one of 256
bytes. The trees are learned once and then frozen; a text gets the language whose tree codes it in the
fewest bits. Lower-cased UTF-8 bytes are coded, after `ORDER` newlines as the first context.

A language's tree is learned from `LEARN_ROWS` labelled texts in expectation, taken whole by a hash of id and text, or from all if there are fewer. Of
these texts, every path is kept, so the code lengths are exact. The model that the driver builds and sends out grows
with the number of languages, not with the corpus.

Nulls: a text that is null or has no letter is `und` with score 0; a null label or text isn't learned from. Repeated rows are
scored each; among those to learn from, equal rows are taken or left together. Very long texts are learned from and scored whole. Of equal code lengths, the first
language by name wins. Without any labelled text, every text is `und`. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

ORDER = 4
LEARN_ROWS = 20_000
START = "\n" * ORDER
#: A score is the posterior after as much evidence as this many bytes give on average.
SCORE_BYTES = 50
UNKNOWN = "und"
#: Bytes scored at once in a worker.
PIECE = 1 << 19
#: Distinct paths that a worker holds while it counts.
HELD = 500_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 4 == 2


def _prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return C.utf8(pc.binary_join_element_wise(pa.scalar(START, pa.large_string()), lowered, pa.scalar("", pa.large_string())))


def _paths(data: np.ndarray) -> np.ndarray:
    """Context and follower at each place, ORDER + 1 bytes as a big-endian number."""
    d = data.astype(np.int64)
    out = d[: len(d) - ORDER].copy()
    for k in range(1, ORDER + 1):
        out = (out << 8) | d[k : len(d) - ORDER + k]
    return out


def sampled(docs: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """lang and text of about `rows` labelled documents a language, by a hash that doesn't depend on how the table is partitioned."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rate = labelled.groupBy("lang").agg((F.lit(float(rows)) / F.count("*")).alias("rate"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return labelled.join(F.broadcast(rate), "lang").where(place < F.col("rate")).select("lang", "text")  # a row a language


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram (a path of the tree as a number) and its count n over all given texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(which, np.concatenate([k for _, k in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for piece in C.pieces(batch, "text", PIECE):
                langs = piece.column("lang")
                for lang in langs.unique().to_pylist():
                    data, offsets = _prepared(piece.column("text").filter(pc.equal(langs, lang)))
                    inside = np.ones(len(data), bool)  # a path must not cross into the next text
                    for k in range(ORDER):
                        inside[offsets[1:] - 1 - k] = False
                    held.setdefault(lang, []).append(np.unique(_paths(data)[inside[: len(data) - ORDER]], return_counts=True))
                if sum(len(g) for parts in held.values() for g, _ in parts) > HELD:
                    yield from rows()
        yield from rows()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """One language's counts by order: sorted paths with their counts, and sorted contexts with their totals and distinct followers."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.orders = []
        for order in range(ORDER + 1):
            paths, which = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.bincount(which, n, len(paths)).astype(np.int64)
            contexts, at = np.unique(paths >> 8, return_inverse=True)
            self.orders.append((paths, counts, contexts, np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts))))

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return place, keys[place] == wanted

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of each path's last byte after its others."""
        bits = np.full(len(grams), 0.0)
        left = np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            paths, counts, contexts, totals, distinct = self.orders[order]
            wanted = grams[left] & ((1 << 8 * (order + 1)) - 1)
            context, known = self._at(contexts, wanted >> 8)
            path, seen = self._at(paths, wanted)
            if len(contexts):
                whole = totals[context] + distinct[context]
                bits[left[seen]] -= np.log2(counts[path[seen]] / whole[seen])
                escaped = known & ~seen
                bits[left[escaped]] -= np.log2(distinct[context[escaped]] / whole[escaped])
            left = left[~seen]
        bits[left] += 8
        return bits


class Model:
    """Frozen trees of all languages, and a hash table of every language's code length for each path that any of them knows."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.trees = [Tree(*counts[lang]) for lang in self.langs]
        grams = np.unique(np.concatenate([counts[lang][0] for lang in self.langs])) if counts else np.zeros(0, np.int64)
        self.shift = np.uint64(64 - max(10, int(2 * len(grams)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.rows = np.zeros(len(self.keys), np.int32)
        left, step = np.arange(len(grams)), 0
        while len(left):  # each path takes the first free place from its own on
            place = (self._home(grams[left]) + step) % len(self.keys)
            free = self.keys[place] == -1
            taken, first = np.unique(place[free], return_index=True)
            winners = left[free][first]
            self.keys[taken], self.rows[taken] = grams[winners], winners + 1
            left, step = np.setdiff1d(left, winners, assume_unique=True), step + 1
        self.bits = np.zeros((len(self.langs), len(grams) + 1), np.float32)
        for i, tree in enumerate(self.trees):
            self.bits[i, 1:] = tree.cost(grams)

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def row_of(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the table, 0 for paths that no language knows."""
        out = np.zeros(len(grams), np.int32)
        home, left, step = self._home(grams), np.arange(len(grams)), 0
        while len(left):
            place = (home[left] + step) % len(self.keys)
            key = self.keys[place]
            here = key == grams[left]
            out[left[here]] = self.rows[place[here]]
            left, step = left[~here & (key != -1)], step + 1
        return out

    def code_lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits by language and text, and coded bytes by text."""
        data, offsets = _prepared(texts)
        paths = _paths(data)
        row = self.row_of(paths)
        begins, stops = offsets[:-1], offsets[1:] - ORDER
        bounds = np.stack([begins, stops], axis=1).reshape(-1)
        bits = np.zeros((len(self.langs), len(begins)))
        some = stops > begins
        owner = np.repeat(np.arange(len(begins)), stops - begins)
        new = C.ragged(begins, stops - begins)
        unknown = row[new] == 0
        new, owner = new[unknown], owner[unknown]
        grams, which = np.unique(paths[new], return_inverse=True)
        for i, tree in enumerate(self.trees):
            cost = np.append(self.bits[i][row], np.float32(0))
            bits[i] = np.where(some, np.add.reduceat(cost, np.minimum(bounds, len(cost) - 1), dtype=np.float64)[::2], 0)
            if len(new):
                bits[i] += np.bincount(owner, tree.cost(grams)[which], minlength=len(begins))
        return bits, stops - begins


def learn(docs: DataFrame, rows: int = LEARN_ROWS) -> Model:
    """A model of the sampled texts."""
    table = C.staged(gram_counts(sampled(docs, rows)), "paths").toArrow()
    counts = {}
    lang = table.column("lang").combine_chunks().dictionary_encode()
    of, grams, n = lang.indices.to_numpy(zero_copy_only=False), table.column("gram").to_numpy(), table.column("n").to_numpy()
    for i, name in enumerate(lang.dictionary.to_pylist()):
        counts[name] = (grams[of == i], n[of == i])
    return Model(counts)


def predict(docs: DataFrame, model: Model, passed: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """The columns `passed` of each row (doc_id unless told) with the language, the score (0 to 1) and the bits a byte, under `names`.
    Callers that pass unknown columns on choose names that can't clash with them."""
    passed = passed if passed is not None else ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LEARN_ROWS bounds it for each language
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in passed), *(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "double"), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in C.pieces(batch, "text", PIECE):
                texts = piece.column("text")
                n = len(piece)
                lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
                if model.langs:
                    bits, size = model.code_lengths(texts)
                    size = np.maximum(size, 1)
                    best = bits.argmin(axis=0)
                    evidence = (bits - bits.min(axis=0)) * np.minimum(1, SCORE_BYTES / size)
                    score = 1 / np.exp2(-evidence).sum(axis=0)
                    lang = np.array(model.langs, object)[best]
                    per_byte = bits.min(axis=0) / size
                else:
                    lettered, lang, score, per_byte = np.zeros(n, bool), np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in passed), pa.array(np.where(lettered, lang, UNKNOWN), pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(np.where(lettered, per_byte, 0.0))],
                    [*passed, *names],
                )
            C.trim()

    return docs.select(*dict.fromkeys([*passed, "text"])).mapInArrow(run, schema)


def identify(docs: DataFrame, passed: list[str] | None = None, **names) -> DataFrame:
    """Learn from the documents that aren't held out, predict all."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model, passed, **names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.table(spark, sf_dir, "documents")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
