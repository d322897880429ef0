"""Python data source for paged HTTP row services: one partition per page, bounded retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE, ATTEMPTS = 100, 4


def fetch(url: str, opener: Callable | None = None, sleep: Callable = time.sleep) -> dict:
    """JSON of url; 429 and 5xx are tried again with growing pauses, other errors raise at once."""
    opener = opener or (lambda u: urllib.request.urlopen(u, timeout=60).read())
    for attempt in range(ATTEMPTS):
        try:
            return json.loads(opener(url))
        except urllib.error.HTTPError as e:
            if attempt == ATTEMPTS - 1 or not (e.code == 429 or e.code >= 500):
                raise
            sleep(2**attempt + (15 * (attempt + 1) if e.code == 429 else 0))
    raise AssertionError


class Page(InputPartition):
    """One page, or with length None all pages from offset on, up to the first empty one."""

    def __init__(self, offset: int, length: int | None):
        self.offset, self.length = offset, length


class PageReader(DataSourceReader):
    def __init__(self, url: str, total: int | None):
        self.url, self.total = url, total

    def partitions(self) -> list[Page]:
        total = self.total
        if total is None:
            stated = fetch(f"{self.url}&offset=0&length=1").get("num_rows_total")
            if stated is None:  # a service that names no total is paged through by one task
                return [Page(0, None)]
            total = int(stated)
        return [Page(o, min(PAGE, total - o)) for o in range(0, total, PAGE)]

    def read(self, partition: Page) -> Iterator[tuple]:
        offset = partition.offset
        while True:
            rows = fetch(f"{self.url}&offset={offset}&length={partition.length or PAGE}").get("rows") or []
            for item in rows:
                yield item.get("row_idx"), json.dumps(item.get("row"), sort_keys=True)
            offset += len(rows)
            if partition.length is not None or not rows:
                return


class PagedRows(DataSource):
    """spark.read.format("paged_rows").option("url", …).load(): row_idx and the row as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "row_idx bigint, row string"

    def reader(self, schema) -> PageReader:
        total = self.options.get("total")
        return PageReader(self.options["url"], int(total) if total else None)
