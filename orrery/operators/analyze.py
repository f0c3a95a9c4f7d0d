"""Analysis: statistics, reachability and policy diffs, catalogue diagnosis, savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .policy import AgentPolicies

UNDESCRIBED, SHADOWED, THIN, TWINNED = "undescribed", "shadowed", "thin", "twinned"
MIN_DESCRIPTION = 16
#: Agents that are broadcast to the catalogue's rows; the result has a row a pair in any case.
MAX_AGENTS = 10_000


def reach(policies: AgentPolicies, catalogue: DataFrame, agents: DataFrame) -> DataFrame:
    """agent, tool_id, risk_level, reachable for every agent (agent, scopes, tenant) by the static per-item rules."""
    few = agents.limit(MAX_AGENTS + 1).count() <= MAX_AGENTS
    every = catalogue.join(F.broadcast(agents) if few else agents, how="cross").withColumn("score", F.lit(1.0)).withColumn("query_id", F.col("agent"))
    return policies.judged(every).select("agent", "tool_id", "risk_level", (F.col("decision") == "allow").alias("reachable"))


def policy_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """agent, tool_id, change: gained or lost."""
    a = before.filter("reachable").select("agent", "tool_id", F.lit(True).alias("was"))
    b = after.filter("reachable").select("agent", "tool_id", F.lit(True).alias("now"))
    both = a.join(b, ["agent", "tool_id"], "full_outer").filter("was is null or now is null")
    return both.select("agent", "tool_id", F.when(F.col("was").isNull(), "gained").otherwise("lost").alias("change"))


def grants(diff: DataFrame, catalogue: DataFrame) -> DataFrame:
    """agent, gained, lost, grants_high_risk (exactly high) and grants_at_least_high, for gates on policy changes."""
    rows = diff.join(catalogue.select("tool_id", "risk_level"), "tool_id", "left")
    gain = F.col("change") == "gained"
    return rows.groupBy("agent").agg(
        F.count_if(gain).alias("gained"), F.count_if(~gain).alias("lost"), F.bool_or(gain & (F.col("risk_level") == 2)).alias("grants_high_risk"), F.bool_or(gain & (F.col("risk_level") >= 2)).alias("grants_at_least_high")
    )


def neighbour_gaps(near: DataFrame) -> DataFrame:
    """id, nearest, gap from top-2 self-searches (id, other, score, rank).

    The gap is the distance of the nearest other row's score from the row's own, relative to it. A row that more than
    one equal row pushes out of its own top two has no gap.
    """
    own = near.filter("id = other").select("id", F.col("score").alias("own"))
    others = near.filter("id <> other").groupBy("id").agg(F.min_by(F.struct("other", "score"), "rank").alias("n"))
    out = others.join(own, "id", "left").select("id", F.col("n.other").alias("nearest"), F.col("n.score").alias("score"), F.coalesce("own", F.lit(0.0)).alias("own"))
    gap = F.when(F.col("own") != 0, F.greatest(F.lit(0.0), (F.col("own") - F.col("score")) / F.abs("own")))
    return out.select("id", "nearest", gap.alias("gap"))


def closest_pairs(gaps: DataFrame) -> DataFrame:
    """left_id, right_id, gap: pairs keyed by smaller and larger id with their smallest gap."""
    low, high = F.least("id", "nearest"), F.greatest("id", "nearest")
    return gaps.filter("gap is not null").groupBy(low.alias("left_id"), high.alias("right_id")).agg(F.min("gap").alias("gap"))


def findings(catalogue: DataFrame, found: DataFrame, gaps: DataFrame, k: int = 5, min_description: int = MIN_DESCRIPTION, margin: float | None = None) -> DataFrame:
    """tool_id, self_rank, nearest_gap, issues.

    ``found``: description, tool_id, rank of one retrieval a distinct description; an item not among the first k
    for its own description is shadowed.
    """
    about = F.trim(F.col("description"))
    rows = catalogue.select("tool_id", about.alias("description"))
    rows = rows.join(found.filter(F.col("rank") <= k).select("description", "tool_id", F.col("rank").alias("self_rank")), ["description", "tool_id"], "left")
    rows = rows.join(gaps.select(F.col("id").alias("tool_id"), F.col("gap").alias("nearest_gap")), "tool_id", "left")
    none = F.col("description") == ""
    issues = [
        F.when(none, UNDESCRIBED),
        F.when(~none & F.col("self_rank").isNull(), SHADOWED),
        F.when(~none & (F.length("description") < min_description), THIN),
    ]
    if margin is not None:
        issues.append(F.when(F.col("nearest_gap") <= margin, TWINNED))
    return rows.select("tool_id", "self_rank", "nearest_gap", F.array_compact(F.array(*issues)).alias("issues"))


def savings(selections: DataFrame) -> DataFrame:
    """One row from selections (tools_sent, catalogue, est_sent, est_full, actual): sums and shares.

    With a measured token count the full catalogue's estimate is scaled by measured over estimated and truncated.
    """
    actual = F.col("actual")
    sent = F.coalesce(actual, F.col("est_sent"))
    full = F.when(actual.isNotNull() & (F.col("est_sent") > 0), F.floor(F.col("est_full") * (actual / F.when(F.col("est_sent") > 0, F.col("est_sent"))))).otherwise(F.col("est_full"))
    sums = selections.agg(
        F.count("*").alias("selections"), F.sum("tools_sent").alias("tools_sent"), F.sum("catalogue").alias("tools_in_catalogue"),
        F.sum(sent).cast("long").alias("tokens_sent"), F.sum(full).cast("long").alias("tokens_if_full"), F.coalesce(F.bool_and(actual.isNotNull()), F.lit(False)).alias("measured"),
    )
    saved = 1 - F.col("tokens_sent") / F.when(F.col("tokens_if_full") > 0, F.col("tokens_if_full"))
    return sums.withColumn("saved_share", F.coalesce(saved, F.lit(0.0)))


#: Characters of the pieces by which ids are looked up.
GRAM = 4


def hints(visible: DataFrame, asked: DataFrame, most: int = 5) -> DataFrame:
    """ask_id, hint: the first ``most`` ids that contain what was asked for (ask_id, wanted) or whose name it is.

    An id contains a string only if it has all the string's pieces of GRAM characters, so each question is joined with
    the ids that have its rarest piece. Questions shorter than a piece are compared with every id.
    """
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda k: F.substring(c, k, F.lit(GRAM))))
    long = asked.filter(F.length("wanted") >= GRAM).select("ask_id", "wanted", F.explode(pieces(F.col("wanted"))).alias("piece"))
    wanted = long.select("piece").distinct()
    held = visible.filter(F.length("tool_id") >= GRAM).select("tool_id", F.explode(pieces(F.col("tool_id"))).alias("piece")).join(wanted, "piece", "left_semi")
    sizes = held.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = long.join(sizes, "piece", "left").groupBy("ask_id", "wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("piece"))).alias("r"))
    near = rarest.filter("r.n > 0").select("ask_id", "wanted", F.col("r.piece").alias("piece")).join(held, "piece").filter(F.col("tool_id").contains(F.col("wanted")))
    short = asked.filter(F.length("wanted") < GRAM).select("ask_id", "wanted")
    every = visible.select("tool_id").join(short, F.col("tool_id").contains(F.col("wanted")))
    by_name = visible.select("tool_id", F.col("name").alias("wanted")).join(asked.select("ask_id", "wanted"), "wanted")
    found = near.select("ask_id", "tool_id").unionByName(every.select("ask_id", "tool_id")).unionByName(by_name.select("ask_id", "tool_id")).distinct()
    place = F.row_number().over(Window.partitionBy("ask_id").orderBy("tool_id"))
    first = found.withColumn("k", place).filter(F.col("k") <= most)
    return first.groupBy("ask_id").agg(F.array_join(F.array_sort(F.collect_list("tool_id")), ", ").alias("hint"))


def routed(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``calls`` (tool_id, ...) with ``source_id``, the source that carries the call out; null for an unknown item."""
    return calls.join(catalogue.select("tool_id", "source_id"), "tool_id", "left")


def unhealthy(found: DataFrame) -> DataFrame:
    """Findings with an issue, those with most issues first."""
    return found.filter(F.size("issues") > 0).orderBy(F.desc(F.size("issues")), "tool_id")
