"""Cursor-paged listings as a data source: planned page ranges in batches, the cursor as offset in streams, and the walk that ends at an empty page."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.session import written

SCHEMA = "page bigint, ok boolean, items array<string>"
MOST_TASKS = 1000  # a long listing has larger ranges, not more tasks
_NUMBER = re.compile(r"page[=-](\d+)")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class PageRange(InputPartition):
    """Pages of one task, with their files."""

    pages: list[tuple[int, str]]


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.path, self.start, self.each = options["path"], int(options.get("start", 0)), int(options.get("pagespertask", 8))
        self.items_at = [k for k in options.get("itemsat", "").split(".") if k]

    def landed(self) -> dict[int, str]:
        """Files by page number: page-12.json, or the one data file of a folder page=12."""
        files, folder = _opened(self.path)
        found = {}
        for info in files.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)):
            name = info.path[len(folder.rstrip("/")) :]
            if info.type == pafs.FileType.File and (m := _NUMBER.search(name)) and not any(p.startswith(("_", ".")) for p in name.split("/")):
                found[int(m[1])] = info.path
        return found

    def ranges(self, low: int, high: int | None = None) -> list[PageRange]:
        held = sorted((n, f) for n, f in self.landed().items() if n >= low and (high is None or n < high))
        each = max(self.each, -(-len(held) // MOST_TASKS))
        return [PageRange(held[i : i + each]) for i in range(0, len(held), each)]

    def rows(self, part: PageRange) -> Iterator[tuple]:
        files, _ = _opened(self.path)
        for number, file in part.pages if part is not None else []:  # without pages Spark reads one partition of none
            try:
                with files.open_input_stream(file) as f:
                    body = json.loads(f.read())
                for key in self.items_at:
                    body = body.get(key)
                items = list(body.values()) if isinstance(body, dict) else list(body or [])
                yield number, True, [json.dumps(x) for x in items]
            except (ValueError, AttributeError, TypeError):
                yield number, False, []


class _Batch(_Pages, DataSourceReader):
    def partitions(self):
        return self.ranges(self.start)

    def read(self, partition):
        return self.rows(partition)


class _Stream(_Pages, DataSourceStreamReader):
    """The offset is the cursor: the first page that is not read yet.  Pages follow each other without a gap, so what lands ahead of its turn waits."""

    def initialOffset(self):
        return {"cursor": self.start}

    def latestOffset(self):
        held, cursor = self.landed(), self.start
        while cursor in held:
            cursor += 1
        return {"cursor": cursor}

    def partitions(self, start, end):
        return self.ranges(start["cursor"], end["cursor"])

    def read(self, partition):
        return self.rows(partition)

    def commit(self, end):
        pass


class LandedPages(DataSource):
    """Format landed_pages: rows (page, ok, items as JSON texts) of a listing's pages landed as JSON files.

    Options: path; start (first page, 0); itemsAt (keys to the items, as response.apps; they may be a list or an object, whose values count);
    pagesPerTask (8; more where that would give over MOST_TASKS tasks).  A page that is no such JSON has ok = false.  As a stream its checkpoint holds the cursor, so a later run reads only new pages."""

    @classmethod
    def name(cls):
        return "landed_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def _options(path: str, start: int, items_at: str, pages_per_task: int) -> dict[str, str]:
    return {"path": path, "start": str(start), "itemsAt": items_at, "pagesPerTask": str(pages_per_task)}


def pages(spark: SparkSession, path: str, *, start: int = 0, items_at: str = "", pages_per_task: int = 8) -> DataFrame:
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").options(**_options(path, start, items_at, pages_per_task)).load()


def page_stream(spark: SparkSession, path: str, *, start: int = 0, items_at: str = "", pages_per_task: int = 8) -> DataFrame:
    spark.dataSource.register(LandedPages)
    return spark.readStream.format("landed_pages").options(**_options(path, start, items_at, pages_per_task)).load()


def walked(found: DataFrame, start: int = 0, max_bad: int = 2) -> tuple[DataFrame, int]:
    """(rows (page, item), cursor): the items of a walk over pages (page, ok, items), and the page that the next walk begins with.

    The walk ends before the first empty page, before the first gap (pages begin with `start`), and before the bad page after `max_bad` bad ones, which
    it steps over.  Only ends of the walk reach the driver.  Pages are read from their source once."""
    held = written(found.where(F.col("page") >= start), "walked")
    empty = held.where("ok AND size(items) = 0").agg(F.min("page")).first()[0]
    bad = [r["page"] for r in held.where("NOT ok").select("page").distinct().orderBy("page").limit(max_bad + 1).collect()]
    after = held.select((F.col("page") + 1).alias("page")).distinct()
    gap = after.join(held.select("page"), "page", "left_anti").agg(F.min("page")).first()[0]
    if held.where(F.col("page") == start).isEmpty():
        gap = start
    ends = [x for x in (empty, bad[max_bad] if len(bad) > max_bad else None, gap) if x is not None]
    end = min(ends)
    return held.where(F.col("page") < end).where("ok").select("page", F.explode("items").alias("item")), end


def land(rows: DataFrame, path: str, page: str, body: str, first: int | None = None, last: int | None = None) -> None:
    """Writes bodies (one a page) as a listing's pages, one file a page."""
    held = rows if first is None else rows.where(F.col(page).between(first, last))
    held.select(F.col(page).alias("page"), F.col(body).alias("value")).repartition("page").write.partitionBy("page").mode("append").text(path)
