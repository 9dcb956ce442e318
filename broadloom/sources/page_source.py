"""Pages as a table of programme rows: ``spark.read.format("broadloom_pages")``.

A folder of Parquet files with (url, html) becomes one partition for each row group; a task
reads those two columns of its own group and hands every page to the reader of its domain. The
schema that the caller asks for is what is built (``.schema("site string, title string")``
gives two columns), and with the option ``pushdown``, where the session pushes filters to
Python sources (spark.sql.python.filterPushdown.enabled), a filter on the site keeps other
pages from being parsed at all.

Readers are found by domain: the domain's own, else that of the longest suffix registered with
a dot before it (".example.com": a family of sites on one engine), else the one that the domain
borrows, else the fallback, which takes every visible line 'HH:MM title'. For pages that are
already a DataFrame, or in a store that only Spark opens, ``page_rows`` does the same as a
table function in a lateral join.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from broadloom.sources.pages import PROGRAM, READERS, TIMED

Reader = Callable[[str, str], Iterator[tuple]]

GONE = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
BREAK = re.compile(r"(?i)<(?:br|/?(?:p|div|li|ul|tr|td|th|h[1-6]|table|article|nav|section|title|body))\b[^>]*>")
TAG = re.compile(r"<[^>]*>")
CLOCK = re.compile(TIMED)


def site_of(url: str | None) -> str:
    """Host without www. and port, lower-cased; '' if there is none."""
    try:
        parts = urlsplit((url or "").strip().lower())
        return (parts.hostname or "").removeprefix("www.") if parts.scheme else ""
    except ValueError:
        return ""


def fallback(url: str, page: str) -> Iterator[tuple]:
    """(channel, title, minute, raw_time) of the visible lines that begin with a time."""
    text = TAG.sub("", BREAK.sub("\n", GONE.sub(" ", page)))
    for line in entities.unescape(text).split("\n"):
        if found := CLOCK.match(" ".join(line.split())):
            hour, minute, title = found.groups()
            yield None, title, int(hour) * 60 + int(minute), f"{hour}:{minute}"


def reader_of(site: str, readers: dict[str, Reader], borrowed: dict[str, str]) -> Reader:
    """Own reader, own family's, borrowed (of the site or its family), fallback."""
    parts = site.split(".")
    keys = [site, *("." + ".".join(parts[i:]) for i in range(1, len(parts)))]
    for key in keys:
        if key in readers:
            return readers[key]
    for key in keys:
        if borrowed.get(key) in readers:
            return readers[borrowed[key]]
    return fallback


class Rows:
    """Programme rows of pages, with the columns asked for."""

    def __init__(self, columns: list[str], readers: dict[str, Reader], borrowed: dict[str, str]) -> None:
        self.columns, self.readers, self.borrowed = columns, readers, borrowed

    def of(self, url: str | None, page: str | None) -> Iterator[tuple]:
        site = site_of(url)
        for channel, title, minute, raw in reader_of(site, self.readers, self.borrowed)(url, page or ""):
            row = {"site": site, "channel": channel, "title": title, "minute": minute, "raw_time": raw, "url": url}
            yield tuple(row[c] for c in self.columns)


class RowGroup(InputPartition):
    def __init__(self, path: str, group: int) -> None:
        self.path, self.group = path, group


class PageReader(DataSourceReader):
    def __init__(self, rows: Rows, path: str) -> None:
        self.rows, self.path = rows, path
        self.sites: set[str] | None = None

    def _files(self):
        from pyarrow import fs

        path = self.path
        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        return system, root

    def partitions(self) -> list[RowGroup]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        system, root = self._files()
        if system.get_file_info(root).type == fs.FileType.File:
            files = [root]
        else:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
            files = sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
        groups = []
        for path in files:
            with system.open_input_file(path) as f:
                groups += [RowGroup(path, g) for g in range(pq.ParquetFile(f).num_row_groups)]
        return groups or [RowGroup("", -1)]

    def read(self, partition: RowGroup) -> Iterator[tuple]:
        from pyarrow import parquet as pq

        if partition.group < 0:
            return
        system, _ = self._files()
        with system.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=64, row_groups=[partition.group], columns=["url", "html"]):
                for url, page in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url", "html")), strict=True):
                    if self.sites is None or site_of(url) in self.sites:
                        yield from self.rows.of(url, page)


class FilteringReader(PageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the site are done here; Spark does the others."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("site",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sites = values if self.sites is None else self.sites & values
            else:
                yield f


def register(spark: SparkSession, readers: dict[str, Reader] | None = None, borrowed: dict[str, str] | None = None, name: str = "broadloom_pages") -> None:
    """Make the format known to a session, with its readers (default: the registered ones).

    Options: path (a file or folder of Parquet with url and html), pushdown ('true' where the
    session lets filters be pushed to Python sources)."""
    known = dict(READERS if readers is None else readers), dict(borrowed or {})

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PROGRAM

        def reader(self, schema: StructType) -> PageReader:
            if unknown := set(schema.names) - {c.split()[0] for c in PROGRAM.split(", ")}:
                raise ValueError(f"pages have no columns {sorted(unknown)}")
            kind = FilteringReader if self.options.get("pushdown") == "true" else PageReader
            return kind(Rows(schema.names, *known), self.options["path"])

    spark.dataSource.register(PageSource)


def page_rows(pages: DataFrame, readers: dict[str, Reader] | None = None, borrowed: dict[str, str] | None = None) -> DataFrame:
    """Programme rows of a table with url and html, by a table function in a lateral join."""
    columns = [c.split()[0] for c in PROGRAM.split(", ")]
    found = Rows(columns, dict(READERS if readers is None else readers), dict(borrowed or {}))

    class PageRows:
        def eval(self, url: str, page: str):
            yield from found.of(url, page)

    rows = F.udtf(PageRows, returnType=PROGRAM)
    p = pages.select(pages["url"].alias("_url"), pages["html"].alias("_html"))
    return p.lateralJoin(rows(F.col("_url").outer(), F.col("_html").outer())).select(*columns)
