"""What plugs into an engine, as protocols over DataFrames and Columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class Source(Protocol):
    """Gives catalogue rows (``schema.ITEM``)."""

    def rows(self, spark: Any) -> DataFrame: ...


@runtime_checkable
class Embedder(Protocol):
    """Texts of a batch to vectors of one width, in their order; runs in the workers."""

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


@runtime_checkable
class Store(Protocol):
    """Holds an index: rows by id, replaced and deleted."""

    def current(self) -> DataFrame | None: ...

    def upsert(self, records: DataFrame) -> None: ...

    def delete(self, ids: DataFrame) -> int: ...

    def clear(self) -> None: ...


@runtime_checkable
class Retriever(Protocol):
    """Index and requests to query_id, tool_id, score, rank."""

    def __call__(self, index: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


@runtime_checkable
class Reranker(Protocol):
    """Hits to the same hits in another order."""

    def __call__(self, hits: DataFrame) -> DataFrame: ...


@runtime_checkable
class PolicyRule(Protocol):
    """A verdict Column over a candidate's row: struct of decision and reason, or null."""

    def check(self) -> Column: ...


@runtime_checkable
class Renderer(Protocol):
    """Items to tool_id, rendered."""

    def __call__(self, items: DataFrame) -> DataFrame: ...


@runtime_checkable
class Tracer(Protocol):
    """Takes a span's name, attributes and seconds."""

    def __call__(self, name: str, attributes: dict[str, Any], seconds: float) -> None: ...
