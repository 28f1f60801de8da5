"""What the operators of this subpackage share: table reading, staging and byte-level word splitting."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.order import numbered  # noqa: F401  used by the operators here

#: Used only in local sessions, as in tests, that name no shared folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir. Only a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/tallyspark/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write `df` as Parquet in the shared folder and return it read back, so that nothing upstream is computed again when an
    executor is lost. `release` deletes what an application has staged. Parquet holds a hundred rows before it looks at their size, and reads
    thousands at once, so large rows need `rows_per_file`."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables, maps and files that this application put into the shared folder. Results that still read them must have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def byte_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, dtype=np.uint8)] = True
    return out


#: Separators [\x20\x09-\x0D]: everything else is part of a word.
NOT_SPACE = ~byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and every byte of a non-ASCII character.
ALNUM_LOWER = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and len + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null's bytes are undefined by the format, so they are cut out
        valid = np.asarray(column.is_valid())
        lengths = np.diff(offsets)
        if (lengths[~valid] > 0).any():
            whole = whole[np.repeat(valid, lengths)]
        lengths = np.where(valid, lengths, 0)
        return whole, np.concatenate([[0], np.cumsum(lengths)])
    return whole, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes within a document, word counts' offsets by document,
    and the mask of word bytes.

    Works on bytes: both word classes end at ASCII characters only, so no UTF-8 sequence is cut.
    """
    n = len(data)
    mask = is_word[data] if n else np.zeros(0, bool)
    first = np.zeros(n + 1, bool)  # a document's first byte starts a word even if the last one's ended with one
    first[offsets] = True
    begins, stops = mask.copy(), mask.copy()
    if n:
        begins[1:] &= ~mask[:-1] | first[1:n]
        stops[:-1] &= ~mask[1:] | first[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets), mask


def word_array(data: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The words that `words` found, as one Arrow array of bytes."""
    starts, ends, _, mask = found
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[mask]))])


def coded(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes by first appearance, and the distinct values."""
    d = array.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i, also of empty stretches."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position, in sorted order by (key, position): same key and owner as the one before. Returns order, flags.

    `owner` must not decrease, so that a stable sort by key keeps an owner's rows together.
    """
    order = np.argsort(key, kind="stable")
    k, o = key[order], owner[order]
    same = np.zeros(len(key), bool)
    same[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return order, same


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


#: Bytes of text that a Python worker handles at once; a longer text is still handled whole.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES):
    """Slices of a batch with about `limit` bytes of `column` each, so that memory doesn't grow with the batch."""
    array = batch.column(column)
    if len(array) == 0:
        return
    ends = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(array.cast(pa.large_binary())).to_numpy(zero_copy_only=False), dtype=np.float64)))
    at = 0
    while at < len(array):
        base = ends[at - 1] if at else 0.0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def count_true(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True values in each stretch of a mask."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        out[some] = np.add.reduceat(mask, offsets[:-1][some], dtype=np.int64)
    return out


def trim() -> None:
    """Give freed memory back to the system, where the C library can; workers are reused, so they would keep their largest piece's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)
