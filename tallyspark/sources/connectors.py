"""SRC1 to SRC6: connectors of evidence providers as one Spark data source, for batches, a partition for each endpoint, and for streams.

A connector says which endpoints it has, under which key a page holds its items, which field identifies an item, what type of record it becomes, and how it is paged: by
numbers, by the number of items to skip, or by a token that each page gives for the next one. A page is a JSON document at `base` with the endpoint's path and the page's place put in, read
over http and https, or from any file system that PyArrow opens. Pages are read until one says that there are no more, or, where it doesn't say, until a short one. Answers that
may be different next time (429 and 500 to 599, broken connections) are asked for again, `RETRIES` times. An endpoint that access is refused to (403), or that doesn't exist
(404), gives one row with the error instead of failing the others. `since` goes into the request, so that only what is new is fetched; `next_cursor` gives the next one.

As a stream, the source goes on where it stopped: an offset is, for each endpoint, the place of the page that was read last and how many of its items are taken, so a page that has
grown gives its new items alone. The driver only finds where a batch ends: among numbered pages by a search, whatever their number; where only a page tells the next one's place, by following
them, and nothing of them is kept but places. Tasks read the pages, each `pages_per_batch` of an endpoint at most, and a batch has up to `BATCH_TASKS` such tasks of an endpoint; the next batch
takes the next ones.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "source string, record_type string, source_id string, payload string, page int, error string"
#: A loop that never ends must not hammer a provider; reaching the limit is an error row, not a silent cut.
MAX_PAGES = 50
RETRIES, PAUSE = 3, 0.2
PAGES_PER_BATCH = 5
#: Tasks of a batch for an endpoint.
BATCH_TASKS = 500


@dataclass(frozen=True)
class Endpoint:
    path: str
    items: str
    identifier: str
    record_type: str
    paging: str = "page"
    token_at: str = ""


# The providers' endpoints.
CONNECTORS: dict[str, tuple[Endpoint, ...]] = {
    "payments": (*(Endpoint(path, "items", "id", kind, "skip") for path, kind in (("payments", "payment"), ("refunds", "refund"), ("disputes", "dispute"), ("settlements", "settlement"))),),
    "accounting": (
        Endpoint("contacts", "contacts", "contact_id", "customer"), Endpoint("invoices", "invoices", "invoice_id", "invoice"), Endpoint("creditnotes", "creditnotes", "creditnote_id", "credit_note"),
        Endpoint("customerpayments", "customerpayments", "payment_id", "payment"),
    ),
    "documents": (Endpoint("files", "files", "id", "contract", "token", "nextPageToken"),),
    "crm": (Endpoint("companies", "results", "id", "crm_account", "token", "paging.next.after"),),
}
PAGE_SIZE = {"payments": 100, "accounting": 200, "documents": 100, "crm": 100}


class EvidenceSource(DataSource):
    """Options: connector; base, with {path}, {page}, {skip}, {token} and {since} in it; since; page_size; token, which is sent as the Authorization header; for streams
    pages_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "EvidenceReader":
        return EvidenceReader(dict(self.options))

    def streamReader(self, schema) -> "EvidencePulls":
        return EvidencePulls(dict(self.options))


def _dug(body: dict, path: str) -> str | None:
    for step in path.split("."):
        body = (body or {}).get(step)
    return body


class Provider:
    """Pages of a connector's endpoints. A place is {"n": pages before it, "skip": items before it, "token": the page's own}."""

    START = {"n": 0, "skip": 0, "token": ""}

    def __init__(self, options: dict):
        if options.get("connector") not in CONNECTORS:
            raise ValueError(f"connector is one of {sorted(CONNECTORS)}")
        self.connector, self.base = options["connector"], options["base"]
        self.since, self.token = options.get("since", ""), options.get("token")
        self.size = int(options.get("page_size", PAGE_SIZE[self.connector]))
        self.endpoints = CONNECTORS[self.connector]

    def opened(self, url: str) -> bytes:
        if not url.startswith(("http:", "https:")):
            from pyarrow import fs

            where, path = fs.FileSystem.from_uri(url if "://" in url else f"file://{url}")
            with where.open_input_stream(path) as stream:
                return stream.read()
        request = urllib.request.Request(url)
        if self.token:
            request.add_header("Authorization", self.token)
        for attempt in range(RETRIES + 1):
            try:
                with urllib.request.urlopen(request, timeout=30) as answer:
                    return answer.read()
            except urllib.error.HTTPError as refused:
                if attempt == RETRIES or refused.code != 429 and refused.code < 500:
                    raise
            except (urllib.error.URLError, ConnectionError, TimeoutError):
                if attempt == RETRIES:
                    raise
            time.sleep(PAUSE * 2**attempt)
        raise AssertionError

    def page(self, end: Endpoint, place: dict) -> tuple[list[dict], dict | None, str | None]:
        """A page's items, the place of the next page if there is one, and an error."""
        try:
            body = json.loads(self.opened(self.base.format(path=end.path, page=place["n"] + 1, skip=place["skip"], token=place["token"], since=self.since)))
        except urllib.error.HTTPError as refused:
            if refused.code not in (403, 404):
                raise
            return [], None, f"{end.path}: HTTP {refused.code}"
        except FileNotFoundError:
            return [], None, f"{end.path}: FileNotFoundError"
        items = body.get(end.items) or []
        token = _dug(body, end.token_at) if end.paging == "token" else None
        told = (body.get("page_context") or {}).get("has_more_page")
        more = bool(token) if end.paging == "token" else len(items) >= self.size if told is None else told
        return items, {"n": place["n"] + 1, "skip": place["skip"] + len(items), "token": str(token or "")} if more else None, None

    def rows(self, end: Endpoint, items: list[dict], number: int) -> Iterator[tuple]:
        for item in items:
            if item.get(end.identifier) not in (None, ""):
                yield self.connector, end.record_type, str(item[end.identifier]), json.dumps(item, separators=(",", ":"), sort_keys=True), number, None


class EvidenceReader(Provider, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.endpoints))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        end, place = self.endpoints[partition.value], dict(self.START)
        while place is not None:
            if place["n"] >= MAX_PAGES:
                yield self.connector, end.record_type, None, None, MAX_PAGES + 1, f"{end.path}: stopped at {MAX_PAGES} pages"
                return
            items, following, error = self.page(end, place)
            if error:
                yield self.connector, end.record_type, None, None, place["n"] + 1, error
            yield from self.rows(end, items, place["n"] + 1)
            place = following


class EvidenceStream(Provider, SimpleDataSourceStreamReader):
    """An offset: by endpoint the place of the page read last, with "taken", its items that have been given, and "refused", whether its error has been told."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("pages_per_batch", PAGES_PER_BATCH))

    def initialOffset(self) -> dict:
        return {end.path: self.START | {"taken": 0, "refused": 0} for end in self.endpoints}

    def pulled(self, end: Endpoint, at: dict, until: dict | None) -> tuple[list[tuple], dict]:
        """Rows from `at` on, up to `until` if a batch is read again, and where they end."""
        rows: list[tuple] = []
        for _ in range(self.most if until is None else until["n"] - at["n"] + 1):
            place = {k: at[k] for k in self.START}
            items, following, error = self.page(end, place)
            if error:
                if place["n"] == 0 and not at["refused"]:  # a page that should follow and isn't there yet is no error
                    rows.append((self.connector, end.record_type, None, None, 1, error))
                    at = at | {"refused": 1}
                return rows, at
            last = len(items) if until is None or place["n"] < until["n"] else until["taken"]
            rows += self.rows(end, items[at["taken"] : last], place["n"] + 1)
            at = at | {"taken": max(at["taken"], last), "refused": 0}
            if following is None or until is not None and place["n"] >= until["n"]:
                return rows, at
            at = following | {"taken": 0, "refused": 0}
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = {end.path: self.pulled(end, start[end.path], None) for end in self.endpoints}
        return iter([row for rows, _ in found.values() for row in rows]), {path: at for path, (_, at) in found.items()}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for one in self.endpoints:
            if start[one.path] != end[one.path]:
                yield from self.pulled(one, start[one.path], end[one.path])[0]


class EvidencePulls(Provider, DataSourceStreamReader):
    """The same offsets, but pages are read by tasks. `at` is where the batch planned last ends; Spark tells it when a query is started again, by asking for the tasks of an empty range."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.each = int(options.get("pages_per_batch", PAGES_PER_BATCH))
        self.at: dict | None = None
        #: By endpoint, places that a batch's tasks may begin at, as found on the way to its end.
        self.marks: dict[str, list[dict]] = {}

    def initialOffset(self) -> dict:
        return {end.path: self.START | {"taken": 0, "refused": 0} for end in self.endpoints}

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        self.at = {end.path: (self.searched if end.paging == "page" else self.followed)(end, at[end.path]) for end in self.endpoints}
        return self.at

    def ended(self, at: dict, place: dict, found: tuple) -> dict:
        """The offset at a page that no other one follows, or that isn't there yet, which is an error only of a first page."""
        items, _, error = found
        if error:
            return at | {"refused": 1} if place["n"] == 0 else place | {"taken": at["taken"] if at["n"] == place["n"] else 0, "refused": 0}
        return place | {"taken": max(len(items), at["taken"] if at["n"] == place["n"] else 0), "refused": 0}

    def searched(self, end: Endpoint, at: dict) -> dict:
        """Where numbered pages end: the first page that says that there are no more, by steps that double and then halve."""
        most = at["n"] + self.each * BATCH_TASKS - 1
        asked = lambda n: self.page(end, self.START | {"n": n})
        low, found = at["n"], asked(at["n"])
        if found[1] is None:
            return self.ended(at, self.START | {"n": low}, found)
        step, high = 1, None
        while high is None or high - low > 1:
            n = min(low + step, most) if high is None else (low + high) // 2
            if n == low:  # as many pages as a batch takes
                return self.START | {"n": low + 1, "taken": 0, "refused": 0}
            answer = asked(n)
            if answer[1] is None:
                high, found = n, answer
            else:
                low, step = n, 2 * step
        return self.ended(at, self.START | {"n": high}, found)

    def followed(self, end: Endpoint, at: dict) -> dict:
        """Where pages end that each tell the next one's place."""
        first, marks = at, self.marks.setdefault(end.path, [])
        for k in range(self.each * BATCH_TASKS):
            place = {k: at[k] for k in self.START}
            if k % self.each == 0 and (not marks or place["n"] > marks[-1]["n"]):
                marks.append(place)
            found = self.page(end, place)
            if found[1] is None:
                at = self.ended(first, place, found)
                break
            at = found[1] | {"taken": 0, "refused": 0}
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end
        tasks = []
        for number, one in enumerate(self.endpoints):
            at, until = start[one.path], end[one.path]
            if at == until:
                continue
            if one.paging == "page":
                places = [self.START | {"n": n} for n in range(at["n"], until["n"] + 1, self.each)]
            else:  # without marks, as when a batch is done again by another session, one task follows the pages
                self.marks[one.path] = [p for p in self.marks.get(one.path, []) if p["n"] > at["n"]]
                places = [{k: at[k] for k in self.START}, *(p for p in self.marks[one.path] if p["n"] <= until["n"])]
            for k, place in enumerate(places):
                begin = place | {"taken": at["taken"] if k == 0 else 0, "refused": at["refused"]}
                tasks.append(InputPartition((number, begin, {"n": places[k + 1]["n"], "taken": 0, "refused": 0} if k + 1 < len(places) else until)))
        return tasks

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Rows from one offset up to another. A page of a planned range that isn't there any more fails the task, so that nothing is passed over."""
        number, at, until = partition.value
        end = self.endpoints[number]
        if until["refused"]:
            yield self.connector, end.record_type, None, None, 1, self.page(end, self.START)[2] or f"{end.path}: refused before"
            return
        while (at["n"], at["taken"]) < (until["n"], until["taken"]):
            items, following, error = self.page(end, {k: at[k] for k in self.START})
            last = len(items) if at["n"] < until["n"] else until["taken"]
            if error or len(items) < last or at["n"] < until["n"] and following is None:
                raise OSError(error or f"{end.path}: page {at['n'] + 1} has become shorter")
            yield from self.rows(end, items[at["taken"] : last], at["n"] + 1)
            if at["n"] == until["n"]:
                return
            at = following | {"taken": 0}


def fetch(spark: SparkSession, connector: str, base: str | None, since: str = "", page_size: int | None = None, token: str | None = None, demonstration: DataFrame | None = None) -> DataFrame:
    """SRC1: the provider's records, or, where no provider is configured, the demonstration rows, marked as such."""
    if not base:
        if demonstration is None:
            raise ValueError(f"{connector}: neither a provider nor demonstration rows")
        return demonstration.withColumn("is_synthetic", F.lit(True))
    spark.dataSource.register(EvidenceSource)
    read = spark.read.format("evidence").option("connector", connector).option("base", base).option("since", since)
    for name, value in (("page_size", page_size), ("token", token)):
        read = read.option(name, value) if value is not None else read
    return read.load().withColumn("is_synthetic", F.lit(False))


def pulls(spark: SparkSession, connector: str, base: str, since: str = "", page_size: int | None = None, token: str | None = None, pages_per_batch: int = PAGES_PER_BATCH) -> DataFrame:
    """SRC3 to SRC6 as a stream: each of the provider's records once, whatever it adds between batches and however often the query is started again from its checkpoint."""
    spark.dataSource.register(EvidenceSource)
    read = spark.readStream.format("evidence").option("connector", connector).option("base", base).option("since", since).option("pages_per_batch", pages_per_batch)
    for name, value in (("page_size", page_size), ("token", token)):
        read = read.option(name, value) if value is not None else read
    return read.load()


def counts_by_type(records: DataFrame) -> DataFrame:
    return records.groupBy("source", "record_type").agg(F.count("source_id").alias("n"), F.count("error").alias("errors"))


def next_cursor(records: DataFrame, field: str = "created_at") -> DataFrame:
    """A row for each source: where the next run begins, one more than the largest value seen."""
    return records.where("source_id IS NOT NULL").groupBy("source").agg((F.max(F.get_json_object("payload", f"$.{field}").cast("bigint")) + 1).alias("since"))
