"""A table kept as numbered pages of JSON, as a REST service gives them, as a source of Spark: ``spark.read.format("json_pages")``.

Options: ``path`` (a folder of files, each a JSON array of objects or an object with the array under ``items``),
``schema`` of the read. A page is a partition. Tests of equality with texts and whole numbers, and of null, are
pushed to where the page is read, before rows are made. Pages that are no JSON of that form are an error; fields that
the schema lacks are left out, missing ones are null. The folder is one that every executor sees (a mounted path)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, InputPartition, IsNotNull, IsNull
from pyspark.sql.types import DoubleType, LongType, StructType


class Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class PageReader(DataSourceReader):
    def __init__(self, options, schema: StructType) -> None:
        self.path, self.schema, self.tests = options["path"], schema, []

    def pushFilters(self, filters: list[Filter]):
        """Takes tests of top fields that come out here as they would in Spark; gives the others back."""
        for f in filters:
            top = len(getattr(f, "attribute", ())) == 1
            if top and isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, (str, int)):
                self.tests.append((f.attribute[0], "=", f.value))
            elif top and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((f.attribute[0], "null" if isinstance(f, IsNull) else "some", None))
            else:
                yield f

    def partitions(self):
        found = [os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if not n.startswith((".", "_"))]
        return [Page(p) for p in sorted(found)]

    def _passes(self, row: dict) -> bool:
        for name, test, value in self.tests:
            v = row.get(name)
            if (test == "=" and v != value) or (test == "null" and v is not None) or (test == "some" and v is None):
                return False
        return True

    def read(self, partition: Page):
        with open(partition.path, encoding="utf-8") as f:
            body = json.load(f)
        rows = body["items"] if isinstance(body, dict) else body
        casts = [(f.name, float if isinstance(f.dataType, DoubleType) else int if isinstance(f.dataType, LongType) else None) for f in self.schema.fields]
        for row in rows:
            if self._passes(row):
                yield tuple(c(row[n]) if c and row.get(n) is not None else row.get(n) for n, c in casts)


class JsonPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self):
        raise ValueError("json_pages needs a schema: spark.read.format('json_pages').schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonPages)


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The pages under a folder as a table."""
    register(spark)
    return spark.read.format("json_pages").schema(schema).option("path", path.removeprefix("file://")).load()
