"""Feedback: decayed usage counts, learnt aliases, conversation folding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_phrase

USAGE_HALF_LIFE = 30 * 86400.0
ALIAS_HALF_LIFE = 90 * 86400.0
USAGE_FLOOR = 1e-6
MIN_ALIAS_WEIGHT, MAX_ALIASES, MAX_PHRASE = 3.0, 5, 120
MAX_TURNS, TURN_WEIGHT, MAX_TURN_CHARS = 2, 2, 400


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def decay(elapsed: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(elapsed, F.lit(0.0)) / F.lit(float(half_life)))


def usage_counts(events: DataFrame, as_of: Column, half_life: float = USAGE_HALF_LIFE, key: str = "tool_id") -> DataFrame:
    """key, count: counts of events (key, ts, count) decayed to ``as_of`` (epoch seconds).

    Decay is a closed form over the events, so order and lateness don't matter. Counts of 0 or less are ignored and
    totals below USAGE_FLOOR dropped.
    """
    part = F.col("count") * decay(as_of - seconds(F.col("ts")), half_life)
    return events.filter("count > 0").groupBy(key).agg(F.sum(part).alias("count")).filter(F.col("count") >= USAGE_FLOOR)


def learnt_aliases(events: DataFrame, as_of: Column, half_life: float = ALIAS_HALF_LIFE, min_weight: float = MIN_ALIAS_WEIGHT, most: int = MAX_ALIASES) -> DataFrame:
    """tool_id, phrase, weight, rank: the heaviest phrases of each item from events (tool_id, phrase, ts, weight)."""
    rows = events.select("tool_id", normalise_phrase(F.col("phrase")).alias("phrase"), (F.col("weight") * decay(as_of - seconds(F.col("ts")), half_life)).alias("w"))
    rows = rows.filter((F.col("phrase") != "") & (F.length("phrase") <= MAX_PHRASE))
    sums = rows.groupBy("tool_id", "phrase").agg(F.round(F.sum("w"), 9).alias("weight")).filter(F.col("weight") >= min_weight - 1e-6)
    order = Window.partitionBy("tool_id").orderBy(F.desc("weight"), "phrase")
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def contextual_queries(turns: DataFrame, max_turns: int = MAX_TURNS, weight: int = TURN_WEIGHT, include_assistant: bool = False, max_chars: int = MAX_TURN_CHARS) -> DataFrame:
    """conv_id, query: the last ``max_turns`` earlier turns and the current one ``weight`` times, a line each.

    The current turn is the last non-blank one of any role. Earlier turns count if they are the user's (or
    anybody's, where ``include_assistant``), not blank and at most ``max_chars`` long. Conversations without a non-blank turn
    give no row.
    """
    said = turns.withColumn("said", F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).filter("said <> ''")
    each = Window.partitionBy("conv_id")
    said = said.withColumn("last", F.max("turn").over(each))
    speaker = F.lit(True) if include_assistant else F.col("role") == "user"
    counts = (F.col("turn") < F.col("last")) & speaker & (F.length("text") <= max_chars)
    said = said.withColumn("old", counts)
    place = F.row_number().over(Window.partitionBy("conv_id", "old").orderBy(F.desc("turn")))
    kept = said.withColumn("place", place).filter((F.col("turn") == F.col("last")) | (F.col("old") & (F.col("place") <= max_turns)))
    lines = F.when(F.col("turn") == F.col("last"), F.array_repeat("said", max(1, weight))).otherwise(F.array("said"))
    folded = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", lines.alias("lines")))).alias("parts"))
    return folded.select("conv_id", F.array_join(F.flatten(F.transform("parts", lambda p: p["lines"])), "\n").alias("query"))


def latest_user_turn(turns: DataFrame) -> DataFrame:
    return turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def alias_weights(events: DataFrame, as_of: Column, half_life: float = ALIAS_HALF_LIFE) -> DataFrame:
    """tool_id, phrase, weight: every phrase's decayed weight, the light ones too."""
    return learnt_aliases(events, as_of, half_life, min_weight=0.0, most=1 << 30).drop("rank")


def forget(events: DataFrame, ids: DataFrame, key: str = "tool_id") -> DataFrame:
    """Events (usage or aliases) without those of ``ids``; an item that comes back starts from nothing."""
    return events.join(ids.select(key).distinct(), key, "left_anti")


@dataclass
class Conversation:
    """Turns as they are said, on the driver; ``rows`` are what ``contextual_queries`` folds."""

    spark: SparkSession
    conv_id: int = 0
    turns: list[tuple[str, str]] = field(default_factory=list)

    def add(self, role: str, text: str) -> Conversation:
        self.turns.append((role, text))
        return self

    def add_user(self, text: str) -> Conversation:
        return self.add("user", text)

    def add_assistant(self, text: str) -> Conversation:
        return self.add("assistant", text)

    def rows(self) -> DataFrame:
        said = [(self.conv_id, k, role, text) for k, (role, text) in enumerate(self.turns)]
        return self.spark.createDataFrame(said, "conv_id long, turn long, role string, text string")

    def query(self, **how) -> str:
        found = contextual_queries(self.rows(), **how).first()
        return found["query"] if found else ""
