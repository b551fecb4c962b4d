"""A catalogue served in pages, as a Spark data source over stored answers.

spark.dataSource.register(CatalogueSource); spark.read.format("catalogue").option("path", folder).option("kind", "series").load()
reads folder/series-1.json, series-2.json, ... each {"Total": n, "List": [{"ID": 1, "Name": ...}]}, up to Total. The folder is one that driver and executors share.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 100
ALLOWED = ("series", "episode", "file")


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class CatalogueReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.kind = options["path"], options.get("kind", "series")
        if self.kind not in ALLOWED:
            raise ValueError(f"the catalogue serves {', '.join(ALLOWED)}, not {self.kind!r}")

    def answer(self, number: int) -> dict:
        with open(f"{self.folder}/{self.kind}-{number}.json", encoding="utf-8") as f:
            return json.load(f)

    def partitions(self):
        return [Page(k + 1) for k in range(max(1, -(-int(self.answer(1)["Total"]) // PAGE)))]

    def read(self, partition):
        for row in self.answer(partition.number)["List"]:
            if isinstance(row.get("ID"), int):
                yield row["ID"], row.get("Name")


class CatalogueSource(DataSource):
    @classmethod
    def name(cls):
        return "catalogue"

    def schema(self):
        return "id long, name string"

    def reader(self, schema):
        return CatalogueReader(self.options)
