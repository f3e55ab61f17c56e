"""A Python data source for paged services: each page is a partition, fetched by a task with retries.

The transport is a function from page number to rows, given by its import path (`module:function`), so that offline use
and tests read fixtures through the same source.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def with_retries(call: Callable, tries: int = 4, wait_s: float = 0.5):
    """Calls again after 1, 2, 4 ... times the wait; an error with `retry_after` names its own wait."""
    for k in range(tries):
        try:
            return call()
        except Exception as e:
            if k == tries - 1:
                raise
            time.sleep(getattr(e, "retry_after", wait_s * 2**k))


class Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.transport = options["transport"]
        self.pages = int(options.get("pages", 1))

    def partitions(self):
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition) -> Iterator[tuple]:
        module, _, name = self.transport.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for row in with_retries(lambda: list(fetch(partition.value))):
            yield tuple(row)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self):
        return "title string, views bigint"

    def reader(self, schema):
        return Pages(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
