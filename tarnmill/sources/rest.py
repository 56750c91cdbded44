"""Paged REST endpoints as Spark tables: a Python data source whose partitions are pages.

A fetcher is a callable (endpoint, params) -> reply, a dictionary as the endpoint's JSON; the caller brings it, with its
own sign-in, retries and waiting. It is pickled into the tasks that call it.

Two ways of paging are known. By *offset* a page's place is known beforehand, so pages are read in parallel, some a task.
By *cursor* a page tells where the next one begins, so one task follows them, but several scans (a date range each, say)
run side by side. Records keep their page and place, so a cap on how many are wanted counts records in the endpoint's
order, after any filter.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnmill.operators import staging
from tarnmill.sources import readers

Fetch = Callable[[str, Mapping], Mapping]

#: Records a page may have where an endpoint has no cap of its own in readers.PAGE_CAPS (fixed value).
OTHER_CAP = 10


def page_size(endpoint_kind: str, asked: object) -> int:
    """How many records of a page to ask for: what is asked, from 1 to the kind's cap; 10 where it is no number."""
    try:
        n = int(asked)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        n = OTHER_CAP
    return max(1, min(readers.PAGE_CAPS.get(endpoint_kind, OTHER_CAP), n))


@dataclass(frozen=True)
class Scan:
    """One listing to read: `records` is the path of keys to a reply's records, `start` and `rows` the names of its paging parameters.

    With `next`, the key of a cursor, cursors are followed from `first`, `most` records at most. Without it, pages are read
    by offset from `first` to `end`; without an end, until one is empty. `ok` is the key by which a reply reports success.
    """

    endpoint: str
    params: Mapping
    records: tuple[str, ...]
    size: int
    start: str
    rows: str
    first: int = 0
    end: int | None = None
    next: str | None = None
    most: int | None = None
    ok: str | None = None


def inner(reply: Mapping, path: Sequence[str]) -> object:
    found: object = reply
    for key in path:
        found = found.get(key) if isinstance(found, Mapping) else None
    return found


def page_of(fetch: Fetch, scan: Scan, at: int) -> tuple[Mapping, list]:
    """The reply at a place, and its records; no list of records counts as none. A reply that reports no success fails."""
    reply = fetch(scan.endpoint, {**scan.params, scan.rows: scan.size, scan.start: at})
    if scan.ok is not None and not (isinstance(reply, Mapping) and reply.get(scan.ok)):
        raise ValueError(f"{scan.endpoint} reported no success at {at}")
    records = inner(reply, scan.records)
    return reply, records if isinstance(records, list) else []


def whole(value: object) -> int | None:
    try:
        return int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return None


@dataclass
class Pages(InputPartition):
    """Pages of a scan that one task reads: from place `at`, by cursor or up to `end`."""

    scan: int
    at: int
    end: int | None


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, scans: Sequence[Scan], pages_a_task: int):
        self.fetch, self.scans, self.pages_a_task = fetch, scans, pages_a_task

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for n, scan in enumerate(self.scans):
            if scan.next or scan.end is None:
                found.append(Pages(n, scan.first, None))
                continue
            step = scan.size * self.pages_a_task
            found += [Pages(n, at, min(at + step, scan.end)) for at in range(scan.first, scan.end, step)]
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Pages)
        scan, at, given = self.scans[partition.scan], partition.at, 0
        while partition.end is None or at < partition.end:
            reply, records = page_of(self.fetch, scan, at)
            if not records:
                return
            for place, record in enumerate(records):
                if scan.most is not None and given >= scan.most:
                    return
                given += 1
                yield partition.scan, at, place, json.dumps(record, ensure_ascii=False)
            if scan.next:
                following = whole(reply.get(scan.next))
                # A cursor that does not move on would be read for ever.
                if not following or following <= at:
                    return
                at = following
            else:
                at += scan.size


def source(fetch: Fetch, scans: Sequence[Scan], pages_a_task: int) -> type[DataSource]:
    """A data source class of the given scans; the class travels by pickle with all that it refers to."""

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tarnmill_pages"

        def schema(self) -> str:
            return "scan int, at long, place int, record string"

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(fetch, scans, pages_a_task)

    return PagedSource


def read(spark: SparkSession, fetch: Fetch, scans: Sequence[Scan], schema: str, pages_a_task: int = 10) -> DataFrame:
    """(scan, at, place, record) of every record of the scans, record parsed by `schema` (null where it is no object).

    A reply is fetched again when a task is run again, and whenever the frame is read again: stage it where it is read twice.
    """
    spark.dataSource.register(source(fetch, list(scans), pages_a_task))
    rows = spark.read.format("tarnmill_pages").load()
    return rows.withColumn("record", F.from_json("record", schema))


def first_records(found: DataFrame, most: int) -> DataFrame:
    """(scan, number, record): of each scan the first `most` records of found(scan, at, place, record), in the endpoint's order.

    Pages are counted and their counts added up; records are ranked within their page, so no scan's records meet in one task.
    """
    window = Window.partitionBy("scan").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pages = found.groupBy("scan", "at").agg(F.count("*").alias("n"))
    before = pages.select("scan", "at", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("before")).filter(F.col("before") < most)
    inside = F.row_number().over(Window.partitionBy("scan", "at").orderBy("place"))
    return found.join(before, ["scan", "at"]).select("scan", (F.col("before") + inside).alias("number"), "record").filter(F.col("number") <= most)


def read_speeches(spark: SparkSession, fetch: Fetch, endpoint: str, kind: str, queries: Sequence[Mapping], schema: str, most: int | None = None, size: object = OTHER_CAP) -> DataFrame:
    """The parliament's records of several queries side by side: cursors are followed, `most` records a query; one page without `most`.

    `kind` names the endpoint: speech or list, others have smaller pages. Records count from 1.
    """
    n, key = page_size(kind, size), "speechRecord" if kind == "speech" else "meetingRecord"
    scans = []
    for q in queries:
        first = whole(q.get("startRecord")) or 1
        paging = {"end": first + 1} if most is None else {"next": "nextRecordPosition", "most": max(1, most)}
        scans.append(Scan(endpoint, {"recordPacking": "json", **q}, (key,), n, "startRecord", "maximumRecords", first, **paging))
    return read(spark, fetch, scans, schema)


def read_catalog(spark: SparkSession, fetch: Fetch, endpoint: str, params: Mapping, schema: str, allowed: Sequence[str], most: int, pages_a_task: int = 10) -> DataFrame:
    """(number, record): the first `most` datasets of a catalog search that have a resource of an allowed format.

    The cap counts after the filter, so how many pages it takes is not known: rounds read as many pages as the cap would
    fill, then twice as many each, until there are enough datasets or none are left. `params` gives rows (1 or more) and
    start (0 or more); schema has `resources array<struct<format, url, ...>>`. Records that are no objects do not count.
    """
    size, start = whole(params.get("rows")), whole(params.get("start"))
    if not size or size < 1 or start is None or start < 0 or most < 1:
        raise ValueError("rows and most are 1 or more, start 0 or more")
    scan = Scan(endpoint, params, ("result", "results"), size, "start", "rows", ok="success")
    total = whole(inner(page_of(fetch, scan, start)[0], ("result", "count"))) or None
    pages, kept, n = -(-most // size), None, 0
    while True:
        # Without a total, rounds go on until one brings nothing.
        end = start + pages * size if total is None else min(start + pages * size, max(total, start + 1))
        rows = staging.stage(read(spark, fetch, [replace(scan, first=start, end=end)], schema, pages_a_task), "pages")
        wanted = rows.filter(F.exists("record.resources", lambda r: readers.resource_allowed(r["format"], r["url"], allowed)))
        kept = wanted if kept is None else kept.unionByName(wanted)
        n += wanted.count()
        start += pages * size
        if n >= most or (rows.isEmpty() if total is None else start >= total):
            return first_records(kept, most).drop("scan")
        pages *= 2
