"""A provider's pages as a stream whose tasks read them."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import connectors
from tallyspark.streaming import evidence


def _served(folder, n, size):
    """n invoices by page numbers, n files by tokens; the other endpoints don't exist."""
    for k in range(0, max(n, 1), size):
        items = [{"invoice_id": str(j)} for j in range(k, min(k + size, n))]
        (folder / f"invoices-{k // size + 1}.json").write_text(json.dumps({"invoices": items, "page_context": {"has_more_page": k + size < n}}))
        files = {"files": [{"id": str(j)} for j in range(k, min(k + size, n))]} | ({"nextPageToken": f"t{k // size + 1}"} if k + size < n else {})
        (folder / f"files-{f't{k // size}' if k else ''}.json").write_text(json.dumps(files))


def _taken(reader, start):
    """Rows of a batch, where it ends and how many tasks it has."""
    end = reader.latestOffset()
    tasks = reader.partitions(start, end)
    return [r for t in tasks for r in reader.read(t)], end, len(tasks)


@pytest.mark.parametrize(("connector", "name", "path"), [("accounting", "{path}-{page}.json", "invoices"), ("documents", "{path}-{token}.json", "files")])
def test_batches_follow_the_tasks_not_the_pages(tmp_path, monkeypatch, connector, name, path):
    """However many pages there are, the driver keeps places alone, finds numbered ones by a search, and one batch takes them all, up to its tasks; what grows is taken once."""
    options = {"connector": connector, "base": f"{tmp_path}/{name}", "page_size": "3", "pages_per_batch": "4"}
    _served(tmp_path, 1000, 3)
    reader = connectors.EvidencePulls(options)
    asked, page = [], connectors.Provider.page
    monkeypatch.setattr(connectors.Provider, "page", lambda self, end, place: asked.append(place["n"]) or page(self, end, place))
    at = reader.initialOffset()
    reader.latestOffset()
    assert connector != "accounting" or len(asked) < 30
    rows, end, tasks = _taken(reader, at)
    ids = [int(r[2]) for r in rows if r[5] is None]
    assert ids == list(range(1000)) and 84 <= tasks <= 88 and end[path]["n"] == 333 and end[path]["taken"] == 1
    assert [r[5] for r in rows if r[5]] == ([f"{p}: FileNotFoundError" for p in ("contacts", "creditnotes", "customerpayments")] if connector == "accounting" else [])
    assert reader.latestOffset() == end and not reader.partitions(end, end)
    _served(tmp_path, 1007, 3)
    again = connectors.EvidencePulls(options)  # started again: Spark tells where it stopped
    assert not again.partitions(end, end)
    rows, last, _ = _taken(again, end)
    assert [int(r[2]) for r in rows] == list(range(1000, 1007))
    replay = connectors.EvidencePulls(options)  # a batch is done again without what was found on the way to its end
    assert [int(r[2]) for t in replay.partitions(at, end) for r in replay.read(t) if r[5] is None] == list(range(1000)) and [int(r[2]) for t in replay.partitions(end, last) for r in replay.read(t)] == list(range(1000, 1007))
    for tasks in (1, 2, 3, 7):  # a batch has its bound, and the next one goes on
        monkeypatch.setattr(connectors, "BATCH_TASKS", tasks)
        small, start, ids, sizes = connectors.EvidencePulls(options), at, [], []
        while True:
            rows, stop, n = _taken(small, start)
            if stop == start:
                break
            ids += [int(r[2]) for r in rows if r[5] is None]
            sizes.append(len([r for r in rows if r[5] is None]))
            start = stop
        assert ids == list(range(1007)) and max(sizes) == 12 * tasks
    gone = tmp_path / f"{path}-{'t' if connector == 'documents' else ''}5.json"
    gone.unlink()
    with pytest.raises(OSError):  # a planned page that is gone isn't passed over
        [list(replay.read(t)) for t in replay.partitions(at, end)]


def test_a_stream_started_again_takes_each_item_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in (0, 200, 200, 263):
        _served(tmp_path / "in", n, 3)
        running = evidence.started(connectors.pulls(spark, "accounting", f"{tmp_path}/in/{{path}}-{{page}}.json", page_size=3, pages_per_batch=4), f"{tmp_path}/out", f"{tmp_path}/state", processingTime="0 seconds")
        running.processAllAvailable()
        running.stop()
    found = spark.read.schema(connectors.SCHEMA).parquet(f"{tmp_path}/out")
    assert sorted(int(r["source_id"]) for r in found.where("error IS NULL").collect()) == list(range(263)) and found.where(F.col("error").isNotNull()).count() == 3
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) <= 6
