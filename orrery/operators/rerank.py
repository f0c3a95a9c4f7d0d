"""Rerankers: bounded usage boost, model scores, lexical choice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..functions.vectors import ranked
from ..session import ship


def usage_boost(hits: DataFrame, counts: DataFrame, weight: float = 0.1, k: int | None = None, id_col: str = "tool_id") -> DataFrame:
    """Scores plus weight * ln(1 + count) / ln(1 + largest count) * |score|; order and ranks anew.

    ``counts`` has (id, count); ids without one count 0. Without counts, or with weight 0, hits stay as they are.
    """
    if not weight:
        return hits
    top = counts.agg(F.coalesce(F.max("count"), F.lit(0.0)).alias("__top"))
    joined = hits.drop("rank").join(counts.select(id_col, "count"), id_col, "left").join(F.broadcast(top), how="cross")
    share = F.when(F.col("__top") > 0, F.log1p(F.coalesce("count", F.lit(0.0))) / F.log1p("__top")).otherwise(0.0)
    boosted = joined.withColumn("boost", F.round(float(weight) * share * F.abs("score"), 9)).withColumn("score", F.round(F.col("score") + F.col("boost"), 9))
    return ranked(boosted.drop("count", "__top"), k or 1 << 30, id_col)


def model_rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable[[str, Sequence[str]], Sequence[float]], candidates: int = 20, blend: float = 1.0, strict: bool = False, id_col: str = "tool_id") -> DataFrame:
    """Rerank each query's first ``candidates`` by ``scorer(query, texts)``; the tail keeps its order behind them.

    blend mixes model and retrieval scores. A failing scorer leaves the query's order, unless ``strict``. A group
    is one query's hits, which the retrieval width bounds.
    """
    ship(hits.sparkSession)
    rows = hits.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(texts.select(id_col, F.col("text").alias("item")), id_col)
    fields = dict(hits.dtypes)

    def run(group: pa.Table) -> pa.Table:
        t = group.sort_by([("rank", "ascending")])
        ids, scores = t[id_col].to_pylist(), t["score"].to_pylist()
        head, order = min(candidates, len(ids)), list(range(len(ids)))
        try:
            model = [float(x) for x in scorer(t["query"][0].as_py(), t["item"].to_pylist()[:head])]
            mixed = [blend * m + (1 - blend) * s for m, s in zip(model, scores[:head], strict=True)]
            scores[:head] = [round(x, 9) for x in mixed]
            order = sorted(range(head), key=lambda k: (-scores[k], ids[k])) + order[head:]
        except Exception:
            if strict:
                raise
        return pa.table({"query_id": t["query_id"], id_col: pa.array([ids[k] for k in order], t[id_col].type), "score": [scores[k] for k in order], "rank": pa.array(range(1, len(ids) + 1), pa.int32())})

    return rows.select("query_id", id_col, "score", "rank", "query", "item").groupBy("query_id").applyInArrow(run, f"query_id {fields['query_id']}, {id_col} {fields[id_col]}, score double, rank int")


def lexical_choice(offered: DataFrame) -> DataFrame:
    """query_id, chosen: of the items offered (query_id, position, tool_id, text, query) the best by word overlap.

    Overlap of distinct words over the root of the item's distinct words; it must be above 0 and the first best wins.
    """
    words = lambda c: F.array_distinct(tokenize(F.col(c)))
    both = F.size(F.array_intersect(words("query"), words("text")))
    scored = offered.withColumn("score", F.when(F.size(words("text")) > 0, F.round(both / F.sqrt(F.size(words("text")).cast("double")), 9)).otherwise(0.0)).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    return scored.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select("query_id", F.col("tool_id").alias("chosen"), "score")
