"""``python -m orrery index|query|bench|calibrate|doctor|diff``: batch commands over catalogue files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, observe
from .functions import embed, vectors
from .operators import analyze, evaluate, maintain, report
from .operators.filters import Filters
from .operators.select import Engine, explain, nested
from .schema import ConfigError
from .session import session
from .sources.catalogue import read_items

VERBS = {"index": ["items", "store"], "query": ["items", "text"], "bench": ["items", "cases"], "calibrate": ["items"], "doctor": ["items"], "diff": ["items", "before", "after"]}
#: What has nothing to do with any catalogue, for calibration without a file of noise.
NOISE = (
    "how long do swans live", "the recipe calls for two lemons", "my neighbour plays the cello at night", "what rhymes with orange", "the mountain was covered in fog",
    "who painted the ceiling", "she lost her umbrella on the tram", "is it going to snow on friday", "the kitten sleeps in the sun", "translate good morning into welsh",
)
CASES = "query string, expected array<string>, agent string, scopes array<string>, note string, category string"


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="orrery")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, words in VERBS.items():
        one = sub.add_parser(verb)
        for w in words:
            one.add_argument(w)
        one.add_argument("--config")
        one.add_argument("--agent")
        one.add_argument("--scopes", default="", help="scopes that the agent holds, by commas")
        one.add_argument("--tenant")
        one.add_argument("-k", type=int, default=5)
        one.add_argument("--json", action="store_true")
        one.add_argument("--log-json", action="store_true")
        one.add_argument("--noise", help="questions without an answer, a line each")
        one.add_argument("--samples", help="questions with an answer, a line each")
        one.add_argument("--percentile", type=int, default=90)
        one.add_argument("--min-hit-rate", type=float)
        one.add_argument("--fail-on-grant", action="store_true")
        one.add_argument("--fail-on-high-risk", action="store_true")
    return p.parse_args(argv)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text: the lines of a file without blank ones and those that start with ``#``."""
    said = spark.read.text(path).select(F.trim("value").alias("text")).filter("text <> '' and not startswith(text, '#')")
    return said.select(F.monotonically_increasing_id().alias("query_id"), "text")


def requests(asked: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Questions (query_id, text, and perhaps agent and scopes) as requests with vectors."""
    held = F.array(*(F.lit(s.strip()) for s in a.scopes.split(",") if s.strip())).cast("array<string>")
    agent = F.coalesce(F.col("agent"), F.lit(a.agent)) if "agent" in asked.columns else F.lit(a.agent).cast("string")
    scopes = F.coalesce(F.col("scopes"), held) if "scopes" in asked.columns else held
    full = asked.select("query_id", "text", agent.cast("string").alias("agent"), scopes.alias("scopes"), F.lit(a.tenant).cast("string").alias("tenant"))
    return embed.default_embedder()(full).drop("text")


def diff(spark: SparkSession, a: argparse.Namespace, items: DataFrame) -> int:
    files = [config.load(f) for f in (a.before, a.after)]
    agents = sorted({n for f in files for n in (f.get("policies", {}).get("agents") or {})}) or ["default"]
    who = spark.createDataFrame([(n, [s.strip() for s in a.scopes.split(",") if s.strip()], a.tenant) for n in agents], "agent string, scopes array<string>, tenant string")
    change = analyze.policy_diff(*(analyze.reach(config.agent_policies(f), items, who) for f in files))
    rows = analyze.grants(change, items).orderBy("agent").collect()
    for r in rows:
        print(json.dumps(r.asDict()))
    return int((a.fail_on_grant and any(r.gained for r in rows)) or (a.fail_on_high_risk and any(r.grants_at_least_high for r in rows)))


def bench(spark: SparkSession, a: argparse.Namespace, engine: Engine) -> int:
    """Cases in JSON lines (query, expected, agent, scopes, note, category) against the catalogue."""
    cases = spark.read.schema(CASES).option("mode", "FAILFAST").json(a.cases).withColumn("query_id", F.monotonically_increasing_id()).persist()
    if cases.filter("query is null").count():
        raise ConfigError(f"{a.cases}: a case without a query")
    hits = engine.select(requests(cases.withColumnRenamed("query", "text"), a), a.k)
    expected = cases.select("query_id", F.explode(F.coalesce("expected", F.array().cast("array<string>"))).alias("tool_id"))
    about = cases.select("query_id", "query", F.coalesce("category", F.lit("none")).alias("category"))
    results = evaluate.case_results(hits, expected, about).persist()
    size = engine.size()
    made = report.benchmark(evaluate.summary(results, size), evaluate.summary(results, size, ["category"]), results)
    print(json.dumps(made) if a.json else report.benchmark_text(made))
    return int(a.min_hit_rate is not None and made["total"]["hit_rate"] < a.min_hit_rate)


def calibrate(spark: SparkSession, a: argparse.Namespace, index: DataFrame) -> int:
    """Score floors from what unanswerable questions score, and what they would cost the answerable ones."""
    noise = lines(spark, a.noise) if a.noise else spark.createDataFrame(list(enumerate(NOISE)), "query_id long, text string")
    samples = lines(spark, a.samples) if a.samples else index.filter("description <> ''").select(F.xxhash64("tool_id").alias("query_id"), F.col("description").alias("text"))
    made = []
    for asked in (noise, samples):
        asked = asked.persist()
        made.append(evaluate.extremes(vectors.search(index, requests(asked, a), a.k), asked))
    out = evaluate.calibrate(*made).persist()
    best = evaluate.recommended(out, a.percentile)
    print(json.dumps({"floors": report.plain(out.orderBy("percentile")), "recommended": best}) if a.json else f"{report.calibration_text(out)}\nrecommended (p{a.percentile}): {best}")
    return 0


def doctor(a: argparse.Namespace, index: DataFrame) -> int:
    asked = index.select(F.trim("description").alias("query_id")).filter("query_id <> ''").distinct().withColumn("text", F.col("query_id"))
    found = vectors.search(index, embed.default_embedder()(asked), a.k).withColumnRenamed("query_id", "description")
    out = analyze.findings(index, found, analyze.neighbour_gaps(vectors.nearest(index)), a.k)
    if not a.json:
        print(report.diagnosis_text(out))
        return 0
    for r in analyze.unhealthy(out).collect():
        print(json.dumps(r.asDict()))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    if a.log_json:
        observe.log_json()
    spark = session()
    items = maintain.with_text(read_items(spark, a.items)).withColumn("owner", F.element_at("metadata", "tenant"))
    settings = config.load(a.config) if a.config else {}
    with observe.span(a.verb, spark):
        if a.verb == "index":
            counts = maintain.VersionedStore(spark, a.store).sync(items, embed.default_embedder())
            print(report.sync_text(counts) if counts else "a first index was written")
            return 0
        if a.verb == "diff":
            return diff(spark, a, items)
        index = embed.default_embedder()(items).persist()
        engine = Engine(index, config.agent_policies(settings), **config.engine_options(settings))
        if a.verb == "bench":
            return bench(spark, a, engine)
        if a.verb == "calibrate":
            return calibrate(spark, a, index)
        if a.verb == "doctor":
            return doctor(a, index)
        asked = spark.createDataFrame([(0, a.text)], "query_id int, text string")
        for r in nested(engine.evaluated(requests(asked, a), a.k, Filters())).collect():
            print(json.dumps(r.asDict(True)) if a.json else explain(r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
