"""A paper index behind a paged search, as a data source that takes filters.

Conditions on venue, year and citationCount become parameters of the search and never reach Spark; each
venue of a list is a partition with pages of its own. What was served is kept in a folder that all executors share,
page by page, so a repeated task, or one after a lost executor, asks only for pages that are missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, MutableMapping
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quillgraph.session import shared_folder
from quillgraph.sources.http import Transport, pages

PAGES = 10
SCHEMA = "paperId string, title string, venue string, year int, citationCount int"


class SharedCache(MutableMapping):
    """Served bodies as files under an address that every executor can open."""

    def __init__(self, folder: str) -> None:
        from pyarrow.fs import FileSystem

        scheme, _, rest = folder.partition(":")
        self.fs, self.path = FileSystem.from_uri(f"file://{rest}" if scheme == "file" and not rest.startswith("//") else folder)
        self.fs.create_dir(self.path, recursive=True)

    def __getitem__(self, key: str) -> str:
        try:
            with self.fs.open_input_stream(f"{self.path}/{key}") as f:
                return f.read().decode()
        except FileNotFoundError:
            raise KeyError(key) from None

    def __setitem__(self, key: str, body: str) -> None:
        import uuid

        part = f"{self.path}/.{key}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(body.encode())
        self.fs.move(part, f"{self.path}/{key}")  # whole or not there

    def __delitem__(self, key: str) -> None:
        try:
            self.fs.delete_file(f"{self.path}/{key}")
        except FileNotFoundError:
            raise KeyError(key) from None

    def __iter__(self) -> Iterator[str]:
        from pyarrow.fs import FileSelector

        return (f.base_name for f in self.fs.get_file_info(FileSelector(self.path)) if not f.base_name.startswith("."))

    def __len__(self) -> int:
        return sum(1 for _ in self)


class SearchReader(DataSourceReader):
    def __init__(self, url: str, names: list[str], transport: Transport, cache: str, spacing: float) -> None:
        self.url, self.names, self.transport, self.cache, self.spacing = url, names, transport, cache, spacing
        self.venues: list[str | None] = [None]
        self.low, self.high, self.citations = None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what the search can express; what is left is Spark's."""
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        name = getattr(f, "attribute", ())
        if name == ("venue",) and isinstance(f, (EqualTo, In)):
            new = [f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None]
            self.venues = new if self.venues == [None] else [v for v in self.venues if v in new]
            return True
        least = {GreaterThanOrEqual: 0, GreaterThan: 1, EqualTo: 0}.get(type(f))
        most = {LessThanOrEqual: 0, LessThan: -1, EqualTo: 0}.get(type(f))
        if name == ("year",) and (least is not None or most is not None):
            if least is not None:
                self.low = max(f.value + least, self.low if self.low is not None else f.value + least)
            if most is not None:
                self.high = min(f.value + most, self.high if self.high is not None else f.value + most)
            return True
        if name == ("citationCount",) and type(f) in (GreaterThanOrEqual, GreaterThan):
            self.citations = max(f.value + least, self.citations or 0)
            return True
        return False

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(v) for v in dict.fromkeys(self.venues)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        asked = {"venue": partition.value, "year": None if self.low is None and self.high is None else f"{'' if self.low is None else self.low}-{'' if self.high is None else self.high}", "minCitationCount": self.citations}
        url = f"{self.url}?{urlencode({k: v for k, v in asked.items() if v is not None})}"
        for r in pages(url, self.transport, most=PAGES, cache=SharedCache(self.cache), spacing=self.spacing):
            yield tuple(r.get(n) for n in self.names)


def search(spark: SparkSession, url: str, transport: Transport, fields: str = SCHEMA, spacing: float = 2.0, folder: str | None = None) -> DataFrame:
    """Papers of the index as a DataFrame; `where` on venue, year and citationCount goes to the search.
    Pages are kept in `folder` (that of spark.checkpoint.dir unless given); the spacing between requests is
    that of the limit times the tasks that may run at once."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    names = [c.strip().split()[0] for c in fields.split(",")]
    cache, wait = folder or f"{shared_folder(spark)}/search", spacing * max(1, spark.sparkContext.defaultParallelism)

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paper_search"

        def schema(self) -> str:
            return fields

        def reader(self, schema) -> DataSourceReader:
            return SearchReader(url, names, transport, cache, wait)

    spark.dataSource.register(Search)
    return spark.read.format("paper_search").load()
