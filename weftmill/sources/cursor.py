"""A cursor-paged collection as a stream: the offset is the cursor, so a restart goes on where the last batch was committed.

``register(spark, fetch, name)`` makes ``format(name)`` read by a function ``(resource, cursor, size) -> (items, end_cursor,
has_next)``; the first cursor is None. A batch is up to ``pages`` pages of ``size`` items, read one after another, as each
page names the next one: that is the collection's own limit, and all that the driver holds is one batch. Spark writes the
batch's offsets down before it runs and commits them after, so a batch that is run again fetches the same cursors again. An
empty page or an end without a cursor leaves the offset where it is; what is added behind the last cursor comes with a later batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from weftmill.session import ship_package


class CursorReader(SimpleDataSourceStreamReader):
    def __init__(self, fetch: Callable, options: dict):
        self.fetch, self.resource = fetch, options.get("resource", "items")
        self.size, self.pages = int(options.get("size", "100")), int(options.get("pages", "10"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": None}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, cursor = [], start["cursor"]
        for _ in range(self.pages):
            items, end, more = self.fetch(self.resource, cursor, self.size)
            if not items or end is None:
                break
            rows += [(self.resource, json.dumps(i)) for i in items]
            cursor = end
            if not more:
                break
        return iter(rows), {"cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The batch again, page by page up to the cursor that was written down."""
        cursor = start["cursor"]
        while cursor != end["cursor"]:
            items, cursor, _ = self.fetch(self.resource, cursor, self.size)
            if not items:
                raise ValueError(f"{self.resource}: the collection no longer reaches cursor {end['cursor']}")
            yield from ((self.resource, json.dumps(i)) for i in items)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, fetch: Callable, name: str = "cursor") -> None:
    """Make ``readStream.format(name)`` give ``resource, item``, each item as JSON text."""
    own = name

    class Bound(DataSource):
        @classmethod
        def name(cls) -> str:
            return own

        def schema(self) -> str:
            return "resource string, item string"

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
            return CursorReader(fetch, dict(self.options))

    ship_package(spark)
    spark.dataSource.register(Bound)
