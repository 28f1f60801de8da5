"""Token ids in a binary file format, under canonical length-limited Huffman codes.

Ids are counted over the whole corpus, code lengths of at most `limit` bits are found by package-merge,
and canonical codes follow from the lengths alone, so that the codebook is one byte a symbol. A file is
a Parquet container (any store that Spark writes to, committed atomically by Spark's writer) of segments
in ascending order of the key. A segment's bytes are

    magic "TLH1", u32 documents, u64 tokens, u32 block length, u32 blocks, u32 32-bit words, u32 crc32 of what follows
    i64 key of each document, u8 whether the key is null, u32 tokens of each document
    u64 bit offset of each block's first code (the checkpoints)
    big-endian 32-bit words of the code stream, with two spare words at the end

Every block can be decoded on its own from its checkpoint; the decoder steps through all blocks of a
segment together, one table lookup a step.

Nulls: a null text is empty (it has the end id only); a null key sorts first and is kept. Repeated keys
and rows are kept, tied keys are ordered by a hash of their ids. Very long texts are encoded whole. An empty table writes no segment. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common as C

HEAD = struct.Struct("<4sIQIIII")
MAGIC = b"TLH1"
SEGMENT_TOKENS = 1 << 20
BLOCK = 256
#: Tokens of a file; a corpus of fewer is still dealt over the session's cores, with no less than the second number each.
FILE_TOKENS, LEAST_TOKENS = 32 << 20, 1 << 20
#: Bytes of text encoded at once in a worker; a longer text is still encoded whole.
PIECE = 8 << 20
IDS_SCHEMA = "doc_id long, n_tokens long, ids binary"
FILE_SCHEMA = "file int, segment int, first long, n_docs long, n_tokens long, payload binary"
#: Distinct words whose ids a worker keeps.
CACHED_WORDS = 800_000

_tokenizers: dict[str, object] = {}
_known: dict[str, "Known"] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: ASCII signs that may close a word: a word of letters before them is a token of the pre-tokenizer by itself.
CLOSING = ",.;:!?)"
IS_CLOSING = C.byte_table(CLOSING.encode())
IS_LETTER = C.byte_table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
#: The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)}


def _letters(word: str) -> bool:
    """Whether the normalizer only lower-cases this word and the pre-tokenizer keeps it whole."""
    return word.isalpha() and (word.isascii() or (unicodedata.is_normalized("NFC", low := word.lower()) and "\u03a3" not in word and len(low) == len(word)))


class Known:
    """The ids of the words met so far, found again by Arrow's hashing; only new words are touched one by one."""

    def __init__(self, path: str):
        self.path = path
        self.tok = _tokenizer(path)
        self.words = pa.array([], pa.large_binary())
        self.pool, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def places(self, distinct: pa.Array) -> np.ndarray:
        """The number of each of some distinct words, after learning the new ones."""
        if len(self.words) > CACHED_WORDS:
            self.__init__(self.path)
        found = pc.index_in(distinct, value_set=self.words)
        missing = found.is_null()
        if found.null_count:
            new = distinct.filter(missing)
            ids = self._encode([w.decode() for w in new.to_pylist()])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            n = len(self.words)
            self.words = pa.concat_arrays([self.words, new])
            out = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            out[np.asarray(missing)] = n + np.arange(len(new))
            return out
        return found.to_numpy(zero_copy_only=False).astype(np.int64)

    def _encode(self, words: list[str]) -> list[bytes]:
        """A word of letters, less its closing signs, goes to the tokenizer's model as such; other words as texts."""
        model, out, rest, tails = self.tok.model, [b""] * len(words), [], {"": b""}
        for i, word in enumerate(words):
            head = word.rstrip(CLOSING)
            if not _letters(head):
                rest.append(i)
                continue
            tail = word[len(head) :]
            if tail not in tails:
                tails[tail] = np.array(self.tok.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
            low = head.lower()
            if not low.isascii():
                low = "".join(map(BYTE_CHARS.__getitem__, low.encode()))
            out[i] = np.array([x.id for x in model.tokenize(low)], "<u4").tobytes() + tails[tail]
        for i, e in zip(rest, self.tok.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by the end id, and offsets.

    Right for tokenizers that lower-case and that split at ASCII white space and drop it, as `splits_at_space` checks.
    The texts are cut at white space and between an ASCII letter and a closing sign, where this pre-tokenizer always
    cuts; each distinct stretch is then encoded once by the tokenizers library.
    """
    data, offsets = C.utf8(texts)
    if b"<|" not in data.tobytes():  # the special tokens' strings are told apart by case
        data = C.LOWER[data]
    starts, ends, of_doc, mask = C.words(data, offsets, C.NOT_SPACE)
    cuts = np.flatnonzero(IS_CLOSING[data[1:]] & IS_LETTER[data[:-1]]) + 1
    cuts = cuts[~np.isin(cuts, offsets)]
    before = np.searchsorted(starts, cuts)
    starts, ends, of_doc = np.insert(starts, before, cuts), np.insert(ends, before - 1, cuts), of_doc + np.searchsorted(cuts, offsets)
    codes, distinct = C.coded(C.word_array(data, (starts, ends, of_doc, mask)))
    if path not in _known:
        _known[path] = Known(path)
    known = _known[path]
    at = known.places(distinct)[codes]
    per_word = known.starts[at + 1] - known.starts[at]
    ids = known.pool[C.ragged(known.starts[at], per_word)]
    ends = np.concatenate([[0], np.cumsum(per_word)])[of_doc]  # token offsets of the documents
    return np.insert(ids, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))


def splits_at_space(path: str) -> bool:
    """Whether encoding the stretches between white space gives what encoding the text gives."""
    tok = _tokenizer(path)
    if any(n not in str(tok.pre_tokenizer) + str(tok.normalizer) for n in ("ByteLevel", "NFC", "Lowercase", "\\p{L}")):
        return False
    probe = "It's a Test, don't\n\n split12 \t éàü <|endoftext|> 中文 x"
    whole = tok.encode(probe, add_special_tokens=False).ids
    return whole == [i for w in probe.split() for i in tok.encode(w, add_special_tokens=False).ids]


def id_kind(tokenizer: str, end_id: int) -> str:
    """The narrowest unsigned type for this vocabulary's ids."""
    return "<u2" if max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id, n_tokens and ids (of `id_kind`) of every whole text."""
    kind = id_kind(tokenizer, end_id)
    if not splits_at_space(tokenizer):
        raise ValueError("this tokenizer joins text over white space")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in C.pieces(batch, "text", PIECE):
                ids, offsets = encode_texts(piece.column("text"), tokenizer, end_id)
                raw = pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer((offsets * int(kind[-1])).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(offsets)), raw], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, IDS_SCHEMA)


def id_counts(tokens: DataFrame, kind: str) -> dict[int, int]:
    """Count of each id; as many rows as the vocabulary has reach the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = C.utf8(batch.column("ids"))
            n = np.bincount(np.frombuffer(data.tobytes(), kind))
            if len(n) > len(total):
                total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
            total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def code_lengths(counts: dict[int, int], limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (more only if the symbols need more), 0 for ids never seen."""
    if not counts:
        return np.zeros(1, np.uint8)
    ids = np.array(sorted(counts), np.int64)
    weights = np.array([counts[i] for i in ids.tolist()], np.int64)
    out = np.zeros(int(ids[-1]) + 1, np.uint8)
    if len(ids) == 1:
        out[ids[0]] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(ids)))))
    order = np.argsort(weights, kind="stable")
    leaves = weights[order]
    # Package-merge: at each level, pairs of the level below are packed and merged with the leaves. Only which entries
    # are leaves is kept; going back down, the 2n - 2 lightest entries of the top level choose how many of each level count.
    levels, below = [], leaves
    for _ in range(limit - 1):
        levels.append(below)
        packs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packs])
        kind = np.concatenate([np.ones(len(leaves), bool), np.zeros(len(packs), bool)])
        by = np.argsort(merged, kind="stable")
        levels[-1] = kind[by]
        below = merged[by]
    depth = np.zeros(len(leaves), np.int64)
    take = 2 * len(leaves) - 2
    for kind in reversed(levels):
        n_leaves = int(kind[:take].sum())
        depth[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    depth[:take] += 1
    out[ids[order]] = depth
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by id, and the decoder's tables: symbol and length for each value of the longest code's bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = int(lengths.max(initial=1))
    spans = (1 << (size - lengths[order].astype(np.int64))).astype(np.int64)
    first = np.cumsum(spans) - spans
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (first >> (size - lengths[order].astype(np.int64))).astype(np.uint64)
    symbol, width = np.zeros(1 << size, np.uint32), np.ones(1 << size, np.uint8)
    symbol[: spans.sum()], width[: spans.sum()] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return codes, symbol, width


def pack(keys: list, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment's bytes."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    at = ends - width
    n_words = int((ends[-1] if len(ends) else 0) // 32 + 3)
    out = np.zeros(n_words, np.uint64)
    if len(ids):
        word = at >> 5
        shifted = codes[ids] << (64 - width - (at & 31)).astype(np.uint64)
        groups = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[groups]] |= np.bitwise_or.reduceat(shifted >> np.uint64(32), groups)
        out[word[groups] + 1] |= np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), groups)
    checkpoints = at[::block].astype("<u8")
    null = np.array([k is None for k in keys], np.uint8)
    body = np.array([k or 0 for k in keys], "<i8").tobytes() + null.tobytes() + counts.astype("<u4").tobytes() + checkpoints.tobytes() + out.astype(">u4").tobytes()
    return HEAD.pack(MAGIC, len(keys), len(ids), block, len(checkpoints), n_words, zlib.crc32(body)) + body


def unpack(payload: bytes, symbol: np.ndarray, width: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Keys, token counts and ids of a segment."""
    magic, n_docs, n_tokens, block, n_blocks, n_words, crc = HEAD.unpack_from(payload)
    if magic != MAGIC or zlib.crc32(memoryview(payload)[HEAD.size :]) != crc:
        raise ValueError("not a whole TLH1 segment")
    at = HEAD.size

    def part(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, kind, n, at)
        at += got.nbytes
        return got

    keys, null, counts = part("<i8", n_docs), part("u1", n_docs), part("<u4", n_docs).astype(np.int64)
    pos, stream = part("<u8", n_blocks).astype(np.int64), part(">u4", n_words).astype(np.uint64)
    pairs = (stream[:-1] << np.uint64(32)) | stream[1:]
    size = int(len(symbol)).bit_length() - 1
    mask, last = np.uint64((1 << size) - 1), len(pairs) - 1
    out = np.empty((block, n_blocks), np.uint32)
    for i in range(min(block, n_tokens)):
        peek = (pairs[np.minimum(pos >> 5, last)] >> (64 - size - (pos & 31)).astype(np.uint64)) & mask  # beyond a short last block: unused
        out[i] = symbol[peek]
        pos += width[peek]
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], counts, out.T.reshape(-1)[:n_tokens]


def write_files(tokens: DataFrame, kind: str, lengths: np.ndarray, path: str, files: int) -> None:
    """Write the ids in ascending order of doc_id as `files` files of segments under `path`/data, the codebook under `path`/codebook."""
    codes, _, _ = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, segment, first = TaskContext.get().partitionId(), 0, 0
        keys, counts, ids, held = [], [], [], 0

        def close():
            nonlocal segment, first, keys, counts, ids, held
            payload = pack(keys, np.array(counts, np.int64), np.concatenate(ids), lengths, codes)
            row = pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "segment": pa.array([segment], pa.int32()), "first": [first], "n_docs": [len(keys)], "n_tokens": [held], "payload": pa.array([payload], pa.binary())})
            segment, first = segment + 1, first + held
            keys, counts, ids, held = [], [], [], 0
            return row

        for batch in batches:
            data, offsets = C.utf8(batch.column("ids"))
            flat, ends = np.frombuffer(data.tobytes(), kind), offsets // int(kind[-1])
            names = batch.column("doc_id").to_pylist()
            at = 0
            while at < len(names):
                room = np.searchsorted(ends, ends[at] + max(1, SEGMENT_TOKENS - held))
                to = min(max(int(room), at + 1), len(names))
                keys += names[at:to]
                counts += np.diff(ends[at : to + 1]).tolist()
                ids.append(flat[ends[at] : ends[to]])
                held += int(ends[to] - ends[at])
                at = to
                if held >= SEGMENT_TOKENS:
                    yield close()
        if keys:
            yield close()

    # equal rows are interchangeable; their number in the table deals those of a key that is too hot for one file over several
    tokens = tokens.withColumn("uid", F.monotonically_increasing_id())
    ordered = tokens.repartitionByRange(files, "doc_id", F.xxhash64("ids"), "uid").sortWithinPartitions("doc_id", F.xxhash64("ids"), "ids")
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(f"{path}/data")
    book = [(bytearray(zlib.compress(lengths.tobytes())),)]
    tokens.sparkSession.createDataFrame(book, "lengths binary").write.parquet(f"{path}/codebook")


def read_files(spark, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    book = spark.read.schema("lengths binary").parquet(f"{path}/codebook").first()
    lengths = np.frombuffer(zlib.decompress(bytes(book["lengths"])), np.uint8)
    files = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/data")
    base, total = {}, 0  # a row for each file, as many as write_files was told to make
    for r in sorted(files.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["file"]):
        base[r["file"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, symbol, width = canonical(lengths)
        for batch in batches:
            for file, first, payload in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), batch.column("payload"), strict=True):
                keys, counts, ids = unpack(payload.as_py(), symbol, width)
                ends = np.concatenate([[0], np.cumsum(counts)])
                raw = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ends[:-1] + base[file] + first), pa.array(counts), raw], ["doc_id", "start", "n_tokens", "ids"])

    return files.select("file", "first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, limit: int = 16, files: int | None = None) -> None:
    """Tokenise the whole corpus once, fit the codebook to its counts and write the files."""
    spark = docs.sparkSession
    tokens = C.staged(tokenize(docs, tokenizer, end_id), "ids")
    kind = id_kind(tokenizer, end_id)
    counts = id_counts(tokens, kind)
    total = sum(counts.values())
    files = files or max(1, -(-total // FILE_TOKENS), min(spark.sparkContext.defaultParallelism, total // LEAST_TOKENS))
    write_files(tokens, kind, code_lengths(counts, limit), path, files)


def query(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{C.work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_corpus(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
