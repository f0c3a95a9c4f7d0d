"""Filter bundles compiled to one Column, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RISK_TIERS

#: Id lists longer than this become semi and anti joins instead of IN lists.
MAX_IN = 1000


@dataclass(frozen=True)
class Filters:
    """Conjunction of optional predicates; None asks nothing, an empty allow-set matches nothing.

    Only an empty ``tags_all`` matches everything.
    """

    namespaces: frozenset[str] | None = None
    tags_any: frozenset[str] | None = None
    tags_all: frozenset[str] | None = None
    exclude_tags: frozenset[str] | None = None
    max_risk: str | None = None
    tool_ids: frozenset[str] | None = None
    exclude_tool_ids: frozenset[str] | None = None

    def is_empty(self) -> bool:
        return self == Filters()

    def merged(self, namespaces: Iterable[str] | None = None, tags: Iterable[str] | None = None) -> Filters:
        """With shorthand arguments, which replace the field."""
        out = self
        if namespaces is not None:
            out = replace(out, namespaces=frozenset(namespaces))
        if tags is not None:
            out = replace(out, tags_any=frozenset(tags))
        return out

    def columns(self) -> list[Column]:
        out: list[Column] = []
        tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
        words = lambda xs: F.array(*(F.lit(x) for x in sorted(xs))).cast("array<string>")
        if self.namespaces is not None:
            out.append(F.col("namespace").isin(sorted(self.namespaces)) if self.namespaces else F.lit(False))
        if self.tool_ids is not None and len(self.tool_ids) <= MAX_IN:
            out.append(F.col("tool_id").isin(sorted(self.tool_ids)) if self.tool_ids else F.lit(False))
        if self.exclude_tool_ids and len(self.exclude_tool_ids) <= MAX_IN:
            out.append(~F.col("tool_id").isin(sorted(self.exclude_tool_ids)))
        if self.tags_any is not None:
            out.append(F.arrays_overlap(tags, words(self.tags_any)) if self.tags_any else F.lit(False))
        if self.tags_all:
            out.append(F.size(F.array_except(words(self.tags_all), tags)) == 0)
        if self.exclude_tags:
            out.append(~F.arrays_overlap(tags, words(self.exclude_tags)))
        if self.max_risk is not None:
            out.append(F.col("risk_level") <= RISK_TIERS.index(self.max_risk))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        for c in self.columns():
            df = df.filter(c)
        ids = lambda xs: df.sparkSession.createDataFrame([(x,) for x in sorted(xs)], "tool_id string")
        if self.tool_ids is not None and len(self.tool_ids) > MAX_IN:
            df = df.join(ids(self.tool_ids), "tool_id", "left_semi")
        if self.exclude_tool_ids and len(self.exclude_tool_ids) > MAX_IN:
            df = df.join(ids(self.exclude_tool_ids), "tool_id", "left_anti")
        return df
