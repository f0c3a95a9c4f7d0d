"""Listing servers as a Spark data source: one partition a server, so discovery runs on the executors."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import SourceError
from ..session import ship

SCHEMA = "name string, namespace string, description string, input_schema string, tags array<string>, risk string, source_id string"


class Server(InputPartition):
    def __init__(self, name: str, spec: Mapping) -> None:
        super().__init__(name)
        self.name, self.spec = name, dict(spec)


class ListingReader(DataSourceReader):
    """``lister`` (module:function) maps a server's settings to its items; hints on them override the guessed risk."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.servers = json.loads(options.get("servers", "{}"))
        self.lister = options.get("lister", "")
        self.tolerant = options.get("toleratefailures", "true").lower() == "true"
        if ":" not in self.lister:
            raise SourceError("the option lister must name a function as module:function")

    def partitions(self) -> list[Server]:
        return [Server(n, s) for n, s in sorted(self.servers.items())]

    def read(self, partition: Server) -> Iterator[tuple]:
        module, function = self.lister.split(":", 1)
        list_items: Callable = getattr(importlib.import_module(module), function)
        try:
            found = list(list_items(partition.spec))
        except Exception as error:
            if self.tolerant:
                return
            raise SourceError(f"{partition.name}: {error}") from error
        for x in found:
            hints = x.get("annotations") or {}
            risk = "low" if hints.get("readOnlyHint") else "high" if hints.get("destructiveHint") else x.get("risk") or "medium"
            schema = x.get("inputSchema") or {}
            yield x["name"], partition.spec.get("namespace", partition.name), x.get("description") or "", json.dumps(schema), sorted(x.get("tags") or []), risk, partition.name


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options)


def register(spark: SparkSession) -> None:
    """Afterwards ``spark.read.format("orrery_listing").option("servers", json).option("lister", "module:function").load()``."""
    ship(spark)
    spark.dataSource.register(ListingSource)


def example_lister(spec: Mapping) -> list[dict]:
    """Items from the settings themselves; a failing server for tests."""
    if spec.get("down"):
        raise ConnectionError("no answer")
    return spec.get("items", [])
