"""Sources that are pulled page by page, as a Spark data source: a plug-in lists pages and reads one.

Each page is a partition, so a page whose task is lost is read again alone. The columns that are asked for (the schema
given to `load`) and equality filters reach the plug-in's pages: rows and fields that nobody wants are not made. As a
stream, the offset is the number of pages seen in their order, so a pull that is resumed from its checkpoint reads new
pages only. Pages must not change, and new ones must sort behind those that are there.

    spark.read.format("pages").option("adapter", "lotlens.sources.paged:JsonFolder").option("path", p).schema(s).load()

Filters are pushed if `spark.sql.python.filterPushdown.enabled` is set; Spark applies those that are not taken.
"""

from __future__ import annotations

import importlib
import json
import os
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType


class PageAdapter(ABC):
    """A plug-in: made from the reader's options on the driver and again in each task."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    @abstractmethod
    def pages(self) -> list[str]:
        """Names of all pages, in an order in which new ones come last."""

    @abstractmethod
    def fetch(self, page: str) -> Iterator[dict]:
        """The records of one page."""


class JsonFolder(PageAdapter):
    """Files with one JSON record a line, in a folder that the driver and the executors share."""

    def pages(self) -> list[str]:
        root = self.options["path"]
        return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith((".json", ".txt")) and not f.startswith((".", "_")))

    def fetch(self, page: str) -> Iterator[dict]:
        with open(page, encoding="utf-8") as lines:
            yield from (json.loads(x) for x in lines if x.strip())


def _adapter(options: dict[str, str]) -> PageAdapter:
    module, _, name = options["adapter"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


@dataclass
class Page(InputPartition):
    name: str


def rows_of(options: dict[str, str], columns: list[str], equal: dict[str, object], page: str) -> Iterator[tuple]:
    """Tuples of the asked columns of the records that meet the filters."""
    for record in _adapter(options).fetch(page):
        if all(record.get(c) == v for c, v in equal.items()):
            yield tuple(record.get(c) for c in columns)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.columns, self.equal = options, schema.names, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality on top-level columns; all others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (str, int, bool)) and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(p) for p in _adapter(self.options).pages()]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        return iter(()) if partition is None else rows_of(self.options, self.columns, self.equal, partition.name)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.columns = options, schema.names

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(_adapter(self.options).pages())}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(p) for p in _adapter(self.options).pages()[start["pages"] : end["pages"]]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return rows_of(self.options, self.columns, {}, partition.name)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
