"""A Python data source over meeting directories, read on demand.

``spark.dataSource.register(DirectorySource)`` and
``spark.read.format("meeting_directory").option("url", ...).option("fetch", "module:function")``;
the function takes a URL and returns a page's HTML. Acquisition never runs inside
an analytical plan: land the pages first, then read them with ``listings``.
"""

from __future__ import annotations

import importlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Tries and waits of a request.
TRIES, BACKOFF = 3, 0.5
T = TypeVar("T")


def http_bytes(url: str, timeout: float = 60.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read()


def http_get(url: str, timeout: float = 30.0) -> str:
    return http_bytes(url, timeout).decode("utf-8", errors="replace")


def get_with_retry(url: str, fetch: Callable[[str], T], tries: int = TRIES, backoff: float = BACKOFF, sleep=time.sleep) -> T:
    """``fetch(url)``; retried unless the server says that the request is wrong."""
    for n in range(tries):
        try:
            return fetch(url)
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 and e.code != 429 or n == tries - 1:
                raise
        except OSError:
            if n == tries - 1:
                raise
        sleep(backoff * 2**n)
    raise ValueError("no tries")


class Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        # Each page is asked for once in a scan, however often it is named.
        self.urls = list(dict.fromkeys(options.get("url", "").split()))
        self.fetch = options.get("fetch", f"{__name__}:http_get")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, name = self.fetch.split(":")
        yield partition.value, get_with_retry(partition.value, getattr(importlib.import_module(module), name))


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meeting_directory"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> Pages:
        return Pages(self.options)
