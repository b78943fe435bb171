"""A paged HTTP source with an injected transport, as a Python data source."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, MutableMapping

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str], tuple[int, str]]


def cache_key(url: str) -> str:
    """A readable, unique file name for a URL."""
    safe = re.sub(r"[^A-Za-z0-9]+", "_", url.split("?")[0].rsplit("/", 1)[-1])[:40]
    return f"{safe}_{hashlib.md5(url.encode()).hexdigest()[:12]}"


def fetch(url: str, transport: Transport, spacing: float = 2.0, tries: int = 6, sleep: Callable[[float], None] = time.sleep, cache: MutableMapping[str, str] | None = None) -> dict:
    """JSON of a URL: 429 waits 30 s more each time (120 at most), 504 waits 10 s, other codes give {}.

    What was served is kept in `cache` by cache_key and asked for there first, without waiting. Tasks
    that run at once share a limit when `spacing` is the limit times their number."""
    key = cache_key(url)
    if cache is not None and key in cache:
        return json.loads(cache[key])
    for attempt in range(1, tries + 1):
        sleep(spacing)
        code, body = transport(url)
        if code == 200:
            if cache is not None:
                cache[key] = body
            return json.loads(body)
        if code not in (429, 504):
            return {}
        sleep(min(30.0 * attempt, 120.0) if code == 429 else 10.0)
    return {}


def pages(url: str, transport: Transport, most: int = 10, **options) -> Iterator[dict]:
    """Records of up to so many pages, following the token of each."""
    token = ""
    for _ in range(most):
        page = fetch(url + (f"&token={token}" if token else ""), transport, **options)
        yield from page.get("data") or []
        token = page.get("token") or ""
        if not token:
            return


def register(spark: SparkSession, name: str, schema_: str, transport: Transport, **options) -> None:
    """Makes spark.read.format(name).option("urls", "[...]") read records. Each URL is a partition; as
    many may run at once as there are cores, so the spacing of one is the limit times these."""
    options = {**options, "spacing": options.get("spacing", 2.0) * max(1, spark.sparkContext.defaultParallelism)}

    class Reader(DataSourceReader):
        def __init__(self, urls: list[str]) -> None:
            self.urls = urls

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(u) for u in self.urls]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            names = [c.strip().split()[0] for c in schema_.split(",")]
            for r in pages(partition.value, transport, **options):
                yield tuple(r.get(n) for n in names)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema_

        def reader(self, schema) -> DataSourceReader:
            return Reader(json.loads(self.options["urls"]))

    spark.dataSource.register(Source)
