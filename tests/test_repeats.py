"""Close repeats on a stream, by windows without Python."""

import random
from datetime import datetime, timedelta

from tallyspark.plans import queries_sources
from tallyspark.plans.adapters import Tables
from tallyspark.streaming import evidence

SCHEMA = "event_id long, ts timestamp, user_id long"


def test_close_repeats_against_brute_force(spark, tmp_path):
    """Events of the same time, of exactly a day and of a microsecond more between them, over the ends of windows, late, without a time or a key, in two batches with a restart."""
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=6 * rng.randint(0, 80), microseconds=rng.choice([0, 0, 1])), rng.choice([1, 2, 3, None])) for k in range(150)] + [(900, None, 1)]
    want = {}
    for key in (1, 2, 3, None):
        mine = sorted((ts, k) for k, ts, u in rows if u == key and ts is not None)
        want |= {b[1]: a[1] for a, b in zip(mine, mine[1:]) if b[0] - a[0] <= timedelta(days=1)}
    middle = start + timedelta(days=10)
    early = lambda r: r[1] is None or r[1] + timedelta(days=r[0] % 3) < middle
    clock = [(-1, start + timedelta(days=100), 9)]
    for part in ([r for r in rows if early(r)], [r for r in rows if not early(r)], clock):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        repeats = evidence.close_repeats(evidence.record_stream(spark, f"{tmp_path}/in", SCHEMA), ["user_id"], late="4 days")
        found = evidence.collected(repeats, f"file://{tmp_path}/out")
    assert {r["event_id"]: r["previous_id"] for r in found.collect()} == want and found.count() == len(want) > 50
    assert "Python" not in repeats._jdf.queryExecution().analyzed().toString() and "InPandas" not in repeats._jdf.queryExecution().analyzed().toString()


def test_a_batch_has_as_many_files_as_its_events_call_for(spark, monkeypatch):
    """Each of four batches of a stream is written by several tasks, and none has files of two."""
    monkeypatch.setattr(queries_sources, "EVENTS", 60)
    stream, path = queries_sources._stream(Tables(spark, "/root/testdata/sf0.001"), shuffled=True)
    count = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    files = count // 4 // 60
    assert files > 1
    stream.writeStream.format("noop").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    sizes = [len(f) for f in _batches(f"{path}/state/sources/0")]
    assert sizes[:4] == [files] * 4


def _batches(folder):
    import json
    import pathlib

    folder = pathlib.Path(folder.removeprefix("file://"))
    lines = [json.loads(x) for f in sorted(folder.iterdir(), key=lambda f: f.name) if not f.name.startswith(".") for x in f.read_text().splitlines()[1:]]
    by = {}
    for entry in {e["path"]: e for e in lines}.values():
        by.setdefault(entry["batchId"], []).append(entry["path"])
    return [by[k] for k in sorted(by)]
