"""Structured Streaming counterparts of the evidence operators."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def record_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """STR-A: new Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once_each(events: DataFrame, key: str = "event_id", at: str = "ts", keep: str = "7 days") -> DataFrame:
    """STR-B: each event once within the time that replays are remembered."""
    return events.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


class InOrder(StatefulProcessor):
    """Rows of a key are kept until the watermark has passed them, so that all that may still come before them has come, and are then judged by event time and id,
    however they arrived. Once the watermark lies `keep` behind a key's last row, nothing of the key is kept any more.

    `judge` gets a key's rows, in order, and gives what they say; `forget` drops what it remembers."""

    def __init__(self, keys: list[str], fields: list[str], kinds: dict[str, str], out: list[str], keep: timedelta):
        self.keys, self.fields, self.kinds, self.out, self.keep_ms = keys, fields, kinds, out, int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["at long", *(f"{f} {self.kinds[f]}" for f in self.fields[1:])]))
        self.last = handle.getValueState("last", "at long")

    def judge(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            micros = frame[self.fields[0]].astype("datetime64[us]").astype("int64").tolist()
            rest = [frame[f].astype(object).where(frame[f].notna(), None).tolist() for f in self.fields[1:]]
            self.waiting.appendList(list(zip(micros, *rest)))
            latest = max(micros) if latest is None else max(latest, *micros)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, keep = timerValues.getCurrentWatermarkInMs() * 1000, self.keep_ms * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in held if r[0] <= passed), key=lambda r: r[:2])
        last = self.last.get()[0] if self.last.exists() else None
        if ready:
            later = [r for r in held if r[0] > passed]
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            found, run = [], []
            for row in ready:  # a pause of more than `keep` ends what is remembered, whenever the timers fire
                if last is not None and row[0] - last > keep:
                    found += self.judge(key, run) if run else []
                    self.forget()
                    run = []
                run.append(row)
                last = row[0]
            found += self.judge(key, run)
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + self.keep_ms + 2)
            if found:
                yield pd.DataFrame(found, columns=self.out)
        if last is not None and last + keep < passed:
            self.last.clear()
            self.forget()

    def close(self) -> None:
        pass


class Versions(InOrder):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getMapState("known", "content string", "version int")

    def judge(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        count, out = sum(1 for _ in self.known.keys()), []
        for _, _, content in rows:
            if not self.known.containsKey((content,)):
                count += 1
                self.known.updateValue((content,), (count,))
                out.append((*key, content, count))
        return out

    def forget(self) -> None:
        self.known.clear()


def _in_order(rows: DataFrame, processor: InOrder, keys: list[str], schema: str, at: str, late: str) -> DataFrame:
    return rows.withWatermark(at, late).groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")


def content_versions(records: DataFrame, key: str = "source_id", content: str = "content_hash", at: str = "ts", row_id: str = "event_id", late: str = "1 day", keep: timedelta = timedelta(days=90)) -> DataFrame:
    """STR-C: a version number for content that a key hasn't had before; rows may come `late`, and are numbered by time and id. The state of a key is a map of the hashes it
    has had, which is as much as A, B, A needs to be told from A, B, C; a key that was quiet for `keep` is forgotten and begins anew."""
    kinds = dict(records.dtypes)
    processor = Versions([key], [at, row_id, content], kinds, [key, content, "version"], keep)
    return _in_order(records.select(key, at, row_id, content), processor, [key], f"{key} {kinds[key]}, {content} {kinds[content]}, version int", at, late)


def close_repeats(events: DataFrame, keys: list[str], at: str = "ts", row_id: str = "event_id", seconds: int = 86_400, late: str = "1 day") -> DataFrame:
    """STR-G: A01 on a stream: an event that follows one of its key within a day, by time and id, though it may come `late`. Each event counts in two windows of two days: in the later one as what may come
    before others, of which the last one is kept, in the earlier one as what may follow. A window is judged once nothing can come into it any more, and is forgotten then."""
    rows = events.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.col(row_id).alias("_id")).withWatermark("_at", late)
    rows = rows.withColumn("_window", F.window("_at", f"{2 * seconds} seconds", f"{seconds} seconds"))
    follows = F.unix_micros("_at") >= F.unix_micros("_window.start") + seconds * 1_000_000
    each = F.struct(F.unix_micros("_at").alias("at"), F.col("_id").alias("id"))
    by = rows.groupBy(*keys, "_window").agg(F.max(F.when(~follows, each)).alias("_before"), F.collect_list(F.when(follows, each)).alias("_rows"))
    ordered = by.withColumn("_rows", F.array_sort("_rows"))
    pairs = ordered.select(*keys, F.explode(F.arrays_zip(F.col("_rows").alias("row"), F.concat(F.array("_before"), "_rows").alias("before"))).alias("_pair"))
    return pairs.where(F.col("_pair.row.at") - F.col("_pair.before.at") <= seconds * 1_000_000).select(*keys, F.col("_pair.row.id").alias(row_id), F.col("_pair.before.id").alias("previous_id"))


def changes_since(records: DataFrame, since: str, at: str = "ts", most: int = 200, row_id: str = "event_id") -> DataFrame:
    """STR-D: the newest changes after a time, ties by id; in a stream, call it from foreachBatch."""
    return records.where(F.col(at) > F.lit(since).cast("timestamp")).orderBy(F.desc(at), F.desc(row_id)).limit(most)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Counts by type and tumbling window, with late events accepted for `late`."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


#: Keyed state with timers needs a store of this kind.
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(stream: DataFrame, path: str, state: str, **trigger) -> StreamingQuery:
    """A running query that appends to Parquet files at `path`, with its state and progress under `state`: started again with the same two, it goes on where it stopped, and
    no row is written twice."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKSDB)
    try:
        return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", state).trigger(**trigger).start()
    finally:
        conf.set(STORE, before)


def collected(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what there is, state and output being kept under `folder`, and return all it has written so far."""
    started(stream, f"{folder}/out", f"{folder}/state", availableNow=True).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
