"""A paged collection as a Python data source: one partition for each planned page, read until a page comes back short.

``format("paged").option("fetch", "module:function")`` names a function ``(resource, page, size) -> list of rows``;
``pages`` is the number of pages to plan for: a reader stops at its own page, so an empty page costs one call, and the
last one goes on to the end of the collection, so none is lost where there are more.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """``resource, page, item`` with each item as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "resource string, page int, item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(1, self.pages() + 1)]

    def pages(self) -> int:
        return max(1, int(self.options.get("pages", "1")))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        resource, size, page = self.options.get("resource", "items"), int(self.options.get("size", "100")), partition.value
        while True:
            items = fetch(resource, page, size)
            for item in items:
                yield resource, page, json.dumps(item)
            if page < self.pages() or len(items) < size:
                return
            page += 1


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def sample_fetch(resource: str, page: int, size: int) -> list[dict]:
    """A fixture collection of 230 items."""
    first = (page - 1) * size
    return [{"number": i, "title": f"{resource} {i}", "state": "open" if i % 3 else "closed"} for i in range(first, min(230, first + size))]
