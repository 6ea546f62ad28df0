"""A Spark data source over the answers of a search service: pages of hits, read in ranges, with filters on the year pushed down.

    spark.dataSource.register(HitsSource)
    spark.read.format("folio_hits").option("path", folder).option("range", 4).load().where("year >= 2001")

A page is a JSON object with `total` (hits of the whole answer), `next` (the page
that follows, null after the last) and `data` (a list of hits with id, title and
year).  Pages lie in a folder as page=0/part-*, page=1/part-*, as Spark's writer
leaves them; it may be any store that Arrow knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "id long, title string, year int"
_ARROW = pa.schema([("id", pa.int64()), ("title", pa.string()), ("year", pa.int32())])
#: Tries of a page that cannot be read.
TRIES = 3


class PageRange(InputPartition):
    """Pages first to last - 1; last is null where the number of pages is not known."""

    def __init__(self, first: int, last: int | None) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class HitsReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]
        self.each = int(options.get("range", 10))
        self.low: int | None = None
        self.high: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds on the year are kept to while pages are read; all other filters stay with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("year",) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                bound = f.value + isinstance(f, GreaterThan)
                self.low = bound if self.low is None else max(self.low, bound)
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                bound = f.value - isinstance(f, LessThan)
                self.high = bound if self.high is None else min(self.high, bound)

    def _page(self, number: int) -> dict | None:
        store, root = fs.FileSystem.from_uri(self.folder if "://" in self.folder or ":/" in self.folder else f"file://{self.folder}")
        folder = fs.FileSelector(f"{root}/page={number}", allow_not_found=True)
        for f in store.get_file_info(folder):
            if f.base_name.startswith("part-") and f.size:
                for tries in range(1, TRIES + 1):
                    try:
                        with store.open_input_stream(f.path) as stream:
                            return json.loads(stream.read())
                    except OSError:
                        if tries == TRIES:
                            raise
        return None

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of pages, as many as the first page's total needs; without a total one range follows the pages' `next`."""
        first = self._page(0)
        if first is None or not first["data"]:
            return [PageRange(0, 0)]
        if first.get("total") is None:
            return [PageRange(0, None)]
        pages = -(-first["total"] // len(first["data"]))
        return [PageRange(lo, min(lo + self.each, pages)) for lo in range(0, pages, self.each)]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        number: int | None = partition.first
        while number is not None and (partition.last is None or number < partition.last):
            page = self._page(number)
            if page is None or not page["data"]:  # behind the end
                return
            hits = [h for h in page["data"] if self._wanted(h.get("year"))]
            if hits:
                yield pa.RecordBatch.from_pylist([{k: h.get(k) for k in _ARROW.names} for h in hits], _ARROW)
            number = page.get("next")

    def _wanted(self, year: int | None) -> bool:
        if self.low is None and self.high is None:
            return True
        return year is not None and (self.low is None or year >= self.low) and (self.high is None or year <= self.high)


class HitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_hits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HitsReader:
        return HitsReader(self.options)


def write_pages(hits: DataFrame, folder: str, size: int = 100, with_total: bool = True) -> None:
    """Answers of a service, as pages of `size` hits (id, title, year) in the order of place, a whole number from 0."""
    paged = hits.withColumn("page", F.floor(F.col("place") / size).cast("int"))
    pages = paged.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "id", "title", "year"))).alias("x"))
    total = hits.count()
    last = -(-total // size) - 1
    data = F.transform("x", lambda h: F.struct(h["id"].alias("id"), h["title"].alias("title"), h["year"].alias("year")))
    following = F.when(F.col("page") < last, F.col("page") + 1)
    body = F.to_json(F.struct(F.lit(total if with_total else None).cast("long").alias("total"), following.alias("next"), data.alias("data")))
    pages.select("page", body.alias("value")).write.partitionBy("page").text(folder)


def read_hits(spark: SparkSession, folder: str, pages_each: int = 10) -> DataFrame:
    """The hits of a folder of pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HitsSource)
    return spark.read.format("folio_hits").option("path", folder).option("range", pages_each).load()
