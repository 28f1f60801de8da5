"""Documents that come in many folders, a stream of which is stopped and started again."""

from pyspark.sql import functions as F

from tallyspark.sources import documents, sinks
from tallyspark.streaming import evidence


def test_tasks_list_and_remember(spark, tmp_path):
    """The driver keeps a number and a mark, whatever the number of files; each file is given once, over restarts, and older files that come later are given, too."""
    reader = documents.UploadListing({"folder": f"file://{tmp_path}/in", "pattern": "*.pdf"})
    assert reader.latestOffset() == reader.initialOffset() and not reader.partitions(reader.initialOffset(), reader.initialOffset())

    def put(ids):
        sinks.files(spark.createDataFrame([(f"f{k % 5}/d {k}%.pdf" if k % 7 else f"d{k}.pdf", f"%PDF-{k % 40}" if k % 4 else f"{k}") for k in ids], "name string, text string"), f"file://{tmp_path}/in")

    def run(kind):
        rows = getattr(documents, kind)(documents.found(spark, f"file://{tmp_path}/in", stream=True, pattern="*.pdf"))
        return evidence.collected(rows.drop("content"), f"file://{tmp_path}/{kind}")

    put(range(0, 100, 2))
    (tmp_path / "in" / "f1" / "empty.pdf").touch()
    (tmp_path / "in" / "f1" / "other.txt").write_text("x")
    (tmp_path / "in" / "f1" / "_hidden.pdf").write_text("x")
    offset = reader.latestOffset()
    assert offset["files"] == 50 and len(str(offset)) < 80 and len(reader.partitions(reader.initialOffset(), offset)) == 6
    batches = [b for p in reader.partitions(reader.initialOffset(), offset) for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 50 and min(c for b in batches for c in b.column("length").to_pylist()) > 0
    assert run("quarantined").count() == 25 and run("documents").count() == len({k % 40 for k in range(0, 100, 2) if k % 4})
    put(range(1, 100, 2))
    import os

    for place in (tmp_path / "in").rglob("*.pdf"):
        os.utime(place, (1, 1))  # nothing goes by the time
    assert reader.latestOffset() != offset
    names = [r["name"] for r in run("quarantined").collect()]
    assert sorted(names) == sorted(f"d {k}%.pdf" if k % 7 else f"d{k}.pdf" for k in range(100) if k % 4 == 0)
    found = run("documents")
    assert found.count() == found.select("document_id").distinct().count() == len({k % 40 for k in range(100) if k % 4})
    assert run("documents").count() == found.count()


def test_files_are_held_a_few_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "HELD", 100)
    sinks.files(spark.range(40).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("name"), F.repeat(F.lit("x"), 30).alias("text")), f"file://{tmp_path}")
    reader = documents.UploadListing({"folder": f"{tmp_path}"})
    listed = [b for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(p)]
    given = list(documents._contents(f"{tmp_path}")(iter(listed)))
    assert [b.num_rows for b in given] == [4] * 10 and sum(len(c) for b in given for c in b.column("content").to_pylist()) == 1200
