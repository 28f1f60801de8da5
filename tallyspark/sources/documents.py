"""SRC9: intake of documents from a folder, as a batch or as a stream.

A document is known by its bytes: its id is made from their digest, so equal bytes are one document under whatever names and whenever they come. What can't be taken is told with
the reason: empty uploads, files above `MOST_BYTES`, whose bytes aren't looked at, and files that don't begin as a PDF does, whatever their name says. Spark's file sources pass over
empty files, and so does the stream here, so these are told only if uploads come as rows.

Spark's own stream over files keeps every file that it has seen, and those of a listing, on the driver. Here tasks list the folders, the files seen before are state of the tasks, and tasks read the new ones. The driver goes
through the listing, a folder at a time, for a mark that tells whether it has changed; it keeps nothing else.
"""

from __future__ import annotations

import hashlib
import urllib.parse
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: The largest file that is taken, how a PDF begins, and the length of a digest in an id.
MOST_BYTES, MAGIC, DIGEST = 25 * 1024 * 1024, "%PDF-", 24
LISTED = "path string, modificationTime timestamp, length long"
SCHEMA = f"{LISTED}, content binary"
#: Tasks that list a folder's folders, and bytes of files that a task holds at a time, of one file at least.
LISTERS, HELD = 64, 8 * 1024 * 1024


def _opened(folder: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


class UploadSource(DataSource):
    """Options: folder, pattern."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema) -> "UploadListing":
        return UploadListing(dict(self.options))


class UploadListing(DataSourceStreamReader):
    """Each batch lists what there is, if that has changed: the files of the folder itself, and of the folders in it with all that is in these. An offset is the number of files and a mark of
    their names."""

    def __init__(self, options: dict):
        self.folder, self.pattern = options["folder"].rstrip("/"), options.get("pattern", "*")

    def initialOffset(self) -> dict:
        return {"files": 0, "mark": ""}

    def places(self) -> list[str]:
        from pyarrow import fs

        where, path = _opened(self.folder)
        found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return ["", *sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))]

    def listed(self, place: str) -> Iterator[tuple[str, datetime, int]]:
        """Path, time and length of the files of a place, but for hidden and empty ones; paths are written as Spark writes them."""
        from pyarrow import fs

        where, path = _opened(self.folder)
        for f in where.get_file_info(fs.FileSelector(f"{path}/{place}" if place else path, recursive=bool(place), allow_not_found=True)):
            inside = f.path[len(path) :].lstrip("/")
            if f.type == fs.FileType.File and f.size and fnmatch(f.base_name, self.pattern) and not any(part.startswith(("_", ".")) for part in inside.split("/")):
                yield f"{self.folder}/{urllib.parse.quote(inside)}", f.mtime or datetime.fromtimestamp(0, timezone.utc), f.size

    def latestOffset(self) -> dict:
        files, mark = 0, 0
        for place in self.places():
            for path, _, _ in self.listed(place):
                files += 1
                mark ^= int.from_bytes(hashlib.blake2b(path.encode(), digest_size=16).digest(), "big")
        return {"files": files, "mark": f"{mark:x}" if files else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        places = self.places() if start != end else []
        return [InputPartition(places[k::LISTERS]) for k in range(min(LISTERS, len(places)))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "modificationTime", "length"], [pa.string(), pa.timestamp("us", "UTC"), pa.int64()]
        for place in partition.value:
            rows = list(self.listed(place))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _contents(folder: str):
    """Listed files with their bytes. A file that is gone fails the task, so that nothing is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _opened(folder)
        base = folder.rstrip("/")
        for batch in batches:
            start, held, size = 0, [], 0
            for k, path in enumerate(batch.column(0).to_pylist()):
                with where.open_input_file(f"{top}/{urllib.parse.unquote(path[len(base) + 1 :])}") as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= HELD or k == batch.num_rows - 1:
                    part = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(len, held), pa.int64()), pa.array(held, pa.binary())], ["path", "modificationTime", "length", "content"])
                    start, held, size = k + 1, [], 0

    return run


def found(spark: SparkSession, folder: str, stream: bool = False, pattern: str = "*") -> DataFrame:
    """Files (path, modificationTime, length, content) of a folder, with their names. A batch of a stream is all that has come; a file is given once, by its path, however often it is listed."""
    if not stream:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    spark.dataSource.register(UploadSource)
    listed = spark.readStream.format("uploads").option("folder", folder).option("pattern", pattern).load()
    return listed.dropDuplicates(["path"]).mapInArrow(_contents(folder), SCHEMA)


def reason(most: int = MOST_BYTES) -> Column:
    """Why a file isn't taken; null if it is. The size is told by the listing, so contents of large files aren't looked at."""
    limit, mb = most // 1024 // 1024, F.floor(F.col("length") / (1024 * 1024)).cast("string")
    return (
        F.when(F.col("length") == 0, "the file is empty")
        .when(F.col("length") > most, F.concat(F.lit("the file is "), mb, F.lit(f" MB; the limit is {limit} MB")))
        .when(~F.startswith(F.col("content"), F.encode(F.lit(MAGIC), "UTF-8")), f"the file is not a PDF (its first bytes are not {MAGIC})")
    )


def taken(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Files with document_id, name and reason; the id is null for what isn't taken."""
    why = reason(most)
    name = F.substring_index(F.url_decode(F.substring_index("path", "/", -1)), "/", -1)
    digest = F.concat(F.lit("upload_"), F.substring(F.sha2("content", 256), 1, DIGEST))
    return files.select(name.alias("name"), "length", why.alias("reason"), F.when(why.isNull(), digest).alias("document_id"), "content")


def documents(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Each document once, across batches: a stream remembers the ids, which are as many as different documents."""
    return taken(files, most).where("document_id IS NOT NULL").dropDuplicates(["document_id"]).select("document_id", "length", "content")


def quarantined(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Files that aren't taken, by name, with the reason."""
    return taken(files, most).where("document_id IS NULL").select("name", "length", "reason")
