"""What any store, renderer, embedder, retriever, reranker or tracer must hold, as checks to run against one's own.

Each function raises AssertionError with what was found. They need a session and nothing else.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import observe
from .operators.filters import Filters

ROWS = "tool_id string, namespace string, name string, description string, input_schema string, tags array<string>, risk_level int, vector array<double>"


def sample(spark: SparkSession, n: int = 12) -> DataFrame:
    """Items with vectors that are all different, over three namespaces and four tiers."""
    rows = [(f"ns{k % 3}/item_{k}", f"ns{k % 3}", f"item_{k}", f"does the work number {k}", "{}", [f"t{k % 2}"], k % 4, [math.cos(k), math.sin(k)]) for k in range(n)]
    return spark.createDataFrame(rows, ROWS)


def _ids(df: DataFrame) -> list[str]:
    return sorted(r.tool_id for r in df.select("tool_id").collect())


def check_store(spark: SparkSession, store: Any) -> None:
    """An empty store with upsert, delete, get, current, clear and len."""
    assert len(store) == 0 and store.get("ns0/item_0") == [], "a new store is empty"
    items = sample(spark)
    store.upsert(items)
    assert _ids(store.current()) == _ids(items) and len(store) == 12, "all rows are there"
    store.upsert(items.limit(3).replace({"ns0": "ns0"}, subset=["namespace"]))
    assert len(store) == 12, "an upsert of known ids adds none"
    changed = items.filter("tool_id = 'ns1/item_1'").selectExpr("*").withColumnRenamed("description", "old").selectExpr("tool_id", "namespace", "name", "'changed' as description", "input_schema", "tags", "risk_level", "vector")
    store.upsert(changed.unionByName(changed))
    assert [r.description for r in store.get("ns1/item_1")] == ["changed"] and len(store) == 12, "an upsert replaces the row, once"
    moved = changed.selectExpr("tool_id", "'ns2' as namespace", "name", "description", "input_schema", "tags", "risk_level", "vector")
    store.upsert(moved)
    assert [r.namespace for r in store.get("ns1/item_1")] == ["ns2"] and len(store) == 12, "a row may change its namespace"
    gone = items.filter("risk_level = 3").select("tool_id")
    assert store.delete(gone) == 3 and store.delete(gone) == 0 and len(store) == 9, "deleting counts what was there"
    for filters in (Filters(namespaces=frozenset({"ns0"})), Filters(max_risk="low"), Filters(tags_any=frozenset())):
        assert set(_ids(filters.apply(store.current()))) <= set(_ids(items)), "filters apply to what is stored"
    store.clear()
    assert len(store) == 0 and store.current().columns == items.columns, "a cleared store keeps its columns"


def check_renderer(spark: SparkSession, renderer: Callable[[DataFrame], DataFrame]) -> None:
    """One row an item: (tool_id, rendered), JSON with a name that model APIs accept."""
    items = sample(spark)
    rows = renderer(items).collect()
    assert sorted(r.tool_id for r in rows) == _ids(items), "every item is rendered once"
    for r in rows:
        made = json.loads(r.rendered)
        inner = made.get("function", made)
        assert inner["name"].replace("_", "").replace("-", "").isalnum() and len(inner["name"]) <= 64, inner["name"]
        assert "work number" in inner["description"], "the description is there"


def check_embedder(function: Callable[[Sequence[str]], Sequence[Sequence[float]]]) -> None:
    """One vector a text in their order, all of one width, finite, and the same ones again."""
    texts = ["first text", "", "another text", "first text", "\u00e9\u4e2d\U0001f600", "x" * 10_000]
    vectors = [list(map(float, v)) for v in function(texts)]
    assert len(vectors) == len(texts) and len({len(v) for v in vectors}) == 1 and vectors[0], "a vector a text, of one width"
    assert all(math.isfinite(x) for v in vectors for x in v), "finite numbers"
    close = lambda a, b: all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b))
    assert close(vectors[0], vectors[3]) and close(vectors[2], list(function(texts[2:3]))[0]), "equal texts have equal vectors, in any batch"
    assert not close(vectors[0], vectors[2]) and list(function([])) == [], "other texts have others, no texts none"


def check_retriever(spark: SparkSession, search: Callable[[DataFrame, DataFrame, int], DataFrame]) -> None:
    """(index, queries, k) to query_id, tool_id, score, rank."""
    items = sample(spark)
    asked = items.selectExpr("tool_id as query_id", "vector")
    rows = search(items, asked, 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r["rank"], -r.score, r.tool_id))
    assert set(by) == set(_ids(items)) and all([x[0] for x in sorted(v)] == [1, 2, 3] for v in by.values()), "k hits with ranks from 1"
    assert all(sorted(v) == sorted(v, key=lambda x: (x[1], x[2])) for v in by.values()), "best first, ties by id"
    assert sum(sorted(v)[0][2] == q for q, v in by.items()) == len(by), "an item finds itself"
    again = {(r.query_id, r.tool_id, r["rank"]) for r in search(items.repartition(3), asked, 3).collect()}
    assert again == {(r.query_id, r.tool_id, r["rank"]) for r in rows}, "however the index is partitioned"
    assert search(items.limit(0), asked, 3).count() == 0 and search(items, asked.limit(0), 3).count() == 0, "nothing in, nothing out"
    assert search(items, asked.limit(1), 50).count() == 12, "no more than there is"


def check_reranker(spark: SparkSession, rerank: Callable[[DataFrame], DataFrame]) -> None:
    """hits (query_id, tool_id, score, rank) to the same hits in another order."""
    hits = spark.createDataFrame([(q, f"ns{k % 3}/item_{k}", 1.0 - k / 10, k + 1) for q in (1, 2) for k in range(5)], "query_id int, tool_id string, score double, rank int")
    rows = rerank(hits).collect()
    key = lambda df: sorted((r.query_id, r.tool_id) for r in df)
    assert key(rows) == key(hits.collect()), "no hit is lost or made"
    assert all(sorted(r["rank"] for r in rows if r.query_id == q) == [1, 2, 3, 4, 5] for q in (1, 2)), "ranks from 1 without gaps"
    assert rerank(hits.limit(0)).count() == 0, "nothing in, nothing out"


def check_tracer(tracer: observe.Tracer) -> None:
    """Takes spans, failed ones too; a failing tracer doesn't stop a job."""
    before = observe.get_tracer()
    try:
        observe.set_tracer(tracer)
        with observe.span("step", size=3) as more:
            more["found"] = 1
        try:
            with observe.span("broken"):
                raise KeyError("x")
        except KeyError:
            pass
    finally:
        observe.set_tracer(before)
