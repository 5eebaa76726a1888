"""Listings as a Spark data source: page after page, by the cursor each page names.

``spark.read.format("listing")`` reads a whole listing, ``spark.readStream`` goes on
where the last run stopped: the offset log is the ledger of pages that were listed.
Rows are responses (page, cursor, body); the functions of ``links`` turn them into files.

A lister tells the cursor after a response; ``LISTERS`` holds the known ones and takes
more.  Responses come from a folder, one file per cursor, as a fetcher stored them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

SCHEMA = "page int, cursor string, body string"


@dataclass(frozen=True)
class Lister:
    """first: the cursor of the first page.  following: the cursor after a response, or
    None at the end."""

    first: str
    following: Callable[[str, str], str | None]


def _named(cursor: str, body: str) -> str | None:
    """A cursor that the response states."""
    return json.loads(body).get("cursor") or None


def _counted(cursor: str, body: str) -> str | None:
    """Pages by number, until one is empty."""
    return str(int(cursor) + 1) if json.loads(body) else None


def _resumed(cursor: str, body: str) -> str | None:
    """Lines; a resume key stands behind an empty line."""
    lines, _, key = body.rstrip("\n").rpartition("\n\n")
    return key.strip() or None if lines else None


LISTERS: dict[str, Lister] = {"search": Lister("*", _named), "posts": Lister("1", _counted), "captures": Lister("start", _resumed)}


def response_name(cursor: str) -> str:
    return quote(cursor, safe="") + ".txt"


class _Pages:
    def __init__(self, options: dict[str, str], lister: Lister):
        self.path, self.lister = options["path"], lister

    def body(self, cursor: str) -> str | None:
        """The stored response, None while there is none."""
        system, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        name = f"{folder.rstrip('/')}/{response_name(cursor)}"
        if system.get_file_info(name).type != pyarrow.fs.FileType.File:
            return None
        with system.open_input_stream(name) as f:
            return f.read().decode()

    def walk(self, page: int, cursor: str | None, until: str | None = None) -> Iterator[tuple[int, str, str]]:
        while cursor is not None and cursor != until and (body := self.body(cursor)) is not None:
            yield page, cursor, body
            page, cursor = page + 1, self.lister.following(cursor, body)


class _Batch(DataSourceReader):
    def __init__(self, pages: _Pages):
        self.pages = pages

    def read(self, partition) -> Iterator[tuple]:
        """One task: each page names the next."""
        yield from self.pages.walk(0, self.pages.lister.first)


class _Stream(SimpleDataSourceStreamReader):
    """An offset is the page to be read next: its number and cursor, null at the end."""

    def __init__(self, pages: _Pages, per_batch: int):
        self.pages, self.per_batch = pages, per_batch

    def initialOffset(self) -> dict:
        return {"page": 0, "cursor": self.pages.lister.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows: list[tuple] = []
        page, cursor = start["page"], start["cursor"]
        for row in self.pages.walk(page, cursor):
            rows.append(row)
            page, cursor = page + 1, self.pages.lister.following(row[1], row[2])
            if len(rows) == self.per_batch:
                break
        return iter(rows), {"page": page, "cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = self.pages.walk(start["page"], start["cursor"], end["cursor"])
        return iter([r for r in rows if r[0] < end["page"]])


class Listing(DataSource):
    """Options: path (of the responses), lister (a name of LISTERS), pages_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def _pages(self) -> _Pages:
        return _Pages(self.options, LISTERS[self.options.get("lister", "search")])

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._pages())

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self._pages(), int(self.options.get("pages_per_batch", "100")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listing)
