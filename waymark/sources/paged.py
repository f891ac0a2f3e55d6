"""Feature pages as a data source: one page is one input partition.

A server hands out features in order of OBJECTID, a fixed number to a page, and the list ends with
the first short or missing page. Its pages lie as files page-<offset>.json (GeoJSON) in a folder that
all machines share. Pages are read side by side: a first pass counts features by page, the first
short one among them ends the list, and the second pass reads up to it. Comparisons of object_id
with constants are applied while a page is read, before rows are made of it (with
spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import json
import operator
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

PAGE_ROWS = 1000
_LINES = "offset long, place int, object_id long, length_mi double, coords array<array<double>>"
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class Page(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)
        self.offset = offset


def page_file(folder: str, offset: int) -> str:
    return os.path.join(folder.removeprefix("file://"), f"page-{offset}.json")


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.rows = options["path"], int(options.get("rows", PAGE_ROWS))
        self.until = int(options["until"]) if "until" in options else None
        self.tests: list[tuple] = []

    def partitions(self) -> list[Page]:
        """Pages from offset 0 on up to the first that is missing, or up to the last wanted one."""
        out, offset = [], 0
        while (self.until is None or offset <= self.until) and os.path.exists(page_file(self.folder, offset)):
            out.append(Page(offset))
            offset += self.rows
        return out or [Page(0)]  # without any Spark would read the whole source at once

    def read(self, partition: Page) -> Iterator[tuple]:
        if not os.path.exists(page_file(self.folder, partition.offset)):
            return
        with open(page_file(self.folder, partition.offset), encoding="utf-8") as f:
            features = json.load(f).get("features") or []
        for place, x in enumerate(features):
            props, shape = x.get("properties") or {}, x.get("geometry") or {}
            number = props.get("OBJECTID")
            if all(number is not None and test(number, value) for test, value in self.tests):
                yield (partition.offset, place, number, props.get("LENGTH_MI"), self._line(shape))

    @staticmethod
    def _line(shape: dict) -> list[list[float]] | None:
        lines = shape.get("coordinates") if shape.get("type") == "LineString" else None
        return [[float(v) for v in c] for c in lines] if lines else None


class ComparingReader(PageReader):
    """Applies comparisons of the object's number itself; Spark wants such a reader only where the
    session allows it."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if type(f) in _COMPARE and f.attribute == ("object_id",):
                self.tests.append((_COMPARE[type(f)], f.value))
            else:
                yield f


class PageSource(DataSource):
    """spark.read.format("waymark_pages"): options path (folder), rows (a page's size), until (offset),
    compare (true where the session lets sources apply filters)."""

    @classmethod
    def name(cls) -> str:
        return "waymark_pages"

    def schema(self) -> str:
        return _LINES

    def reader(self, schema) -> PageReader:
        return (ComparingReader if self.options.get("compare") == "true" else PageReader)(self.options)


def read_pages(spark: SparkSession, folder: str, rows: int = PAGE_ROWS) -> DataFrame:
    """(offset, place, object_id, length_mi, coords) of all features up to the end of the first short
    page; what lies behind it is not part of the list. No page, no rows."""
    spark.dataSource.register(PageSource)
    pages = spark.read.format(PageSource.name()).option("path", folder).option("rows", rows)
    pages = pages.option("compare", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    # a page without features leaves no row here, as one that is not there
    counts = pages.load().groupBy("offset").agg(F.count(F.lit(1)).alias("n"))
    places = spark.range(1).select("id").unionByName(counts.select((F.col("offset") + rows).alias("id")))
    until = places.join(counts, F.col("id") == F.col("offset"), "left").where(F.coalesce("n", F.lit(0)) < rows).agg(F.min("id")).first()[0]
    return pages.option("until", until).load()
