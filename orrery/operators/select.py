"""Selection end to end: search, boost, policy, truncation, for a batch of requests in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import search
from ..schema import NotIndexedError
from .filters import Filters
from .policy import AgentPolicies
from .rerank import usage_boost
from .retrieve import fetch_size, pipeline_size


@dataclass
class Engine:
    """An indexed catalogue with what selections need; immutable parts, all DataFrames lazy.

    ``index``: catalogue columns with ``vector``. Requests: query_id, vector, agent, scopes, tenant.
    """

    index: DataFrame
    policies: AgentPolicies = field(default_factory=AgentPolicies)
    usage: DataFrame | None = None
    usage_weight: float = 0.1
    metric: str = "cosine"

    def size(self) -> int:
        n = self.index.count()
        if not n:
            raise NotIndexedError("nothing is indexed")
        return n

    def candidates(self, requests: DataFrame, k: int, filters: Filters = Filters(), size: int | None = None) -> DataFrame:
        """query_id, tool_id, score, rank: what retrieval and boosting hand to the policy, at the pipeline's width."""
        width = fetch_size(k, size or self.size())
        hits = search(filters.apply(self.index), requests, pipeline_size(width), self.metric)
        if self.usage is not None:
            hits = usage_boost(hits, self.usage, self.usage_weight).drop("boost")
        return hits.filter(F.col("rank") <= width)

    def evaluated(self, requests: DataFrame, k: int = 5, filters: Filters = Filters(), size: int | None = None) -> DataFrame:
        """Every candidate with its decision, ``final_rank`` among the permitted ones, and stage and reason of an exclusion."""
        hits = self.candidates(requests, k, filters, size)
        asked = requests.drop("vector")
        known = hits.join(self.index.drop("vector"), "tool_id").join(asked, "query_id")
        judged = self.policies.judged(known)
        ok = F.col("decision") == "allow"
        place = F.row_number().over(Window.partitionBy("query_id", "decision").orderBy("rank"))
        out = judged.withColumn("final_rank", F.when(ok, place))
        stage = F.when(~ok, "policy").when(F.col("final_rank") > k, "truncation")
        reason = F.when(~ok, F.col("reason")).when(F.col("final_rank") > k, F.lit(f"ranked below the top {k}"))
        return out.withColumn("reason", reason).withColumn("stage", stage)

    def select(self, requests: DataFrame, k: int = 5, filters: Filters = Filters(), size: int | None = None) -> DataFrame:
        """query_id, tool_id, rank, score of the k permitted hits of each request."""
        out = self.evaluated(requests, k, filters, size).filter("stage is null")
        return out.select("query_id", "tool_id", F.col("final_rank").alias("rank"), "score")


def nested(evaluated: DataFrame) -> DataFrame:
    """A row a request: hits, exclusions and firings as arrays in rank order; a request's candidates are bounded."""
    hit = F.struct("rank", "tool_id", "score")
    gone = F.struct("rank", "tool_id", "stage", "reason")
    return evaluated.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("stage").isNull(), hit))).alias("hits"),
        F.array_sort(F.collect_list(F.when(F.col("stage").isNotNull(), gone))).alias("exclusions"),
        F.flatten(F.collect_list("firings")).alias("firings"),
    )


def explain(row) -> str:
    """A trace of one request's nested row as text."""
    lines = [f"query {row.query_id}: {len(row.hits)} selected, {len(row.exclusions)} excluded"]
    lines += [f"  {k + 1}. {h.tool_id}  {h.score:.4f}" for k, h in enumerate(row.hits)]
    lines += [f"  - {x.tool_id} [{x.stage}] {x.reason}" for x in row.exclusions]
    return "\n".join(lines)


def payload(row) -> dict:
    """One request's nested row as plain values, scores rounded to four digits."""
    return {
        "query": row.query_id, "selected": [{"id": h.tool_id, "rank": k + 1, "score": round(h.score, 4)} for k, h in enumerate(row.hits)],
        "excluded": [{"id": x.tool_id, "stage": x.stage, "reason": x.reason} for x in row.exclusions], "firings": [f.asDict() for f in row.firings or []],
    }
