"""Connected components of a link table by minimum labels with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, staged


def components(links: DataFrame) -> DataFrame:
    """v, component (smallest vertex reachable) for every vertex of ``links`` (a, b: long).

    Each round takes the smallest label among the neighbours and then that label's own label, so long chains
    halve; the rounds end when no label changes. Vertices without a link do not occur; no links give no rows.
    A vertex with very many neighbours and a component with very many vertices are no hot keys: their labels are sent
    to the edges and vertices instead.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = staged(both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "cc-edges")
    near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    labels = staged(near.select("u", F.least("u", "m").alias("c"), "degree"), "cc-labels")
    edges, vertices = max(both.count(), 1), max(labels.count(), 1)
    while True:
        met = join_groups(both, labels.select(F.col("u").alias("v"), "c", "degree"), ["v"], "degree", edges)
        near = met.groupBy("u").agg(F.min("c").alias("m"))
        seen = staged(labels.join(near, "u").select("u", F.col("c").alias("old"), F.least("c", "m").alias("c"), "degree"), "cc-seen")
        sizes = seen.groupBy("c").agg(F.count("*").alias("size"))
        jump = sizes.join(labels.select(F.col("u").alias("c"), F.col("c").alias("p")), "c")
        step = staged(join_groups(seen, jump, ["c"], "size", vertices).select("u", "old", F.least("c", "p").alias("c"), "degree"), "cc-labels")
        labels = step.select("u", "c", "degree")
        if step.filter("c <> old").isEmpty():
            return labels.select(F.col("u").alias("v"), F.col("c").alias("component"))
