"""Behaviours that the queries' data don't reach: ties, empty sets, decay, bypasses, sources, streams."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from orrery import config, schema
from orrery.functions import embed, text, vectors
from orrery.operators import analyze, evaluate, feedback, hooks, maintain, render, rerank, retrieve
from orrery.operators import policy as P
from orrery.operators.filters import Filters
from orrery.plans import queries as Q
from orrery.sources import catalogue as C
from orrery.sources.functions import FunctionSource, split_docstring, type_schema
from orrery.sources.openapi import operation_name, operations, read_openapi
from orrery.streaming import feedback as stream


def items(spark, rows):
    return spark.createDataFrame(rows, "tool_id string, namespace string, tags array<string>, risk_level int")


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a/x", "a", ["read"], 0), ("a/y", "a", ["write", "read"], 2), ("b/z", "b", [], 3), ("b/w", "b", None, 1)]
    return items(spark, rows).persist()


@pytest.mark.parametrize(
    "filters, want",
    [
        (Filters(), {"a/x", "a/y", "b/z", "b/w"}),
        (Filters(namespaces=frozenset()), set()),
        (Filters(tags_any=frozenset()), set()),
        (Filters(tool_ids=frozenset()), set()),
        (Filters(tags_all=frozenset()), {"a/x", "a/y", "b/z", "b/w"}),
        (Filters(tags_all=frozenset({"read", "write"})), {"a/y"}),
        (Filters(exclude_tags=frozenset({"read"})), {"b/z", "b/w"}),
        (Filters(max_risk="medium"), {"a/x", "b/w"}),
        (Filters(exclude_tool_ids=frozenset({"a/x"})).merged(namespaces=["a"]), {"a/y"}),
    ],
)
def test_filters(small, filters, want):
    assert {r.tool_id for r in filters.apply(small).collect()} == want


def test_long_id_lists_become_joins(small):
    ids = frozenset({"a/x", *(f"n/{k}" for k in range(2000))})
    assert [r.tool_id for r in Filters(tool_ids=ids).apply(small).collect()] == ["a/x"]
    assert Filters(exclude_tool_ids=ids).apply(small).count() == 3


@pytest.mark.parametrize(
    "name, want", [("countRainyDays", "count rainy days"), ("UVIndex3Now", "uvindex3 now"), ("a-b.c/d_e", "a b c d e"), ("café", "café"), ("", ""), ("__x__", "x")]
)
def test_humanize(spark, name, want):
    assert spark.range(1).select(text.humanize(F.lit(name))).first()[0] == want


def test_tokenize_is_ascii_only(spark):
    said = "café windSpeed_max 12 \u0130x \u212a"
    got = spark.range(1).select(text.tokenize(F.lit(said))).first()[0]
    assert got == embed.words_of(said) == ["caf", "wind", "speed", "max", "12", "x"]


def test_describe_schema(spark):
    s = json.dumps({"properties": {"mastHeight": {"type": "string", "description": "in feet"}, "n": {"type": "integer"}, "z": {}}, "required": ["n"]})
    got = spark.range(1).select(text.describe_schema(F.lit(s)), text.describe_schema(F.lit("{}"))).first()
    assert got[0] == "parameters: mast height: in feet; n (integer) [required]; z" and got[1] is None


def test_flatten_name_keeps_the_tail_within_64(spark):
    got = spark.range(1).select(text.flatten_name(F.lit("n" * 60), F.lit("a/long name")), text.flatten_name(F.lit("default"), F.lit("ok"))).first()
    assert len(got[0]) <= 64 and got[0].endswith("_a_long_name") and got[1] == "ok"


def test_identifiers_are_checked(spark):
    good = schema.normalised_items(spark.createDataFrame([(" a ",)], "name string")).first()
    assert good.tool_id == "default/a" and good.risk_level == 0 and good.cost_level == 0
    for bad in ("", "a/b", "a\u0000b"):
        with pytest.raises(Exception, match="invalid name"):
            schema.normalised_items(spark.createDataFrame([(bad,)], "name string")).collect()


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_search_against_brute_force_with_ties(spark, metric):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[10], v[20], v[30] = v[0], v[0], 0
    index = spark.createDataFrame([(f"t{k:02d}", x.tolist()) for k, x in enumerate(v)], "tool_id string, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(k, v[k].tolist()) for k in (0, 5, 30)], "query_id int, vector array<double>")
    got = {(r.query_id, r.rank): r.tool_id for r in vectors.search(index, asked, 4, metric).collect()}
    for q in (0, 5, 30):
        s = vectors.scores(v, v[q : q + 1], metric)[:, 0]
        order = sorted(range(60), key=lambda k: (-s[k], k))[:4]
        assert [got[q, r + 1] for r in range(4)] == [f"t{k:02d}" for k in order]


def test_search_in_blocks_and_batches_gives_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(size=(300, 3)), 1)  # many ties
    index = spark.createDataFrame([(f"t{k:03d}", x.tolist()) for k, x in enumerate(v)], "tool_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(k, v[k].tolist()) for k in range(0, 300, 4)], "query_id int, vector array<double>")
    s = vectors.scores(v, v, "l2")
    want = [(q, r + 1, f"t{o:03d}") for q in range(0, 300, 4) for r, o in enumerate(sorted(range(300), key=lambda j: (-s[j, q], j))[:6])]
    got = lambda: sorted((r.query_id, r["rank"], r.tool_id) for r in vectors.search(index, asked, 6, "l2").collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert got() == want
        monkeypatch.setattr(vectors, "MAX_QUERIES", 20)
        monkeypatch.setattr(vectors, "INDEX_BLOCK", 70)
        assert got() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert vectors.search(index, asked.limit(0), 3).count() == 0 and vectors.search(index.limit(0), asked, 3).count() == 0


def test_search_refuses_other_widths(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0])], "tool_id string, vector array<double>")
    with pytest.raises(Exception, match="dimensions"):
        vectors.search(index, spark.createDataFrame([(0, [1.0])], "query_id int, vector array<double>"), 1).collect()


def test_nearest_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    v = np.random.default_rng(2).normal(size=(40, 5))
    v[3] = v[4] = v[5]
    index = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "tool_id int, vector array<double>")
    near = vectors.nearest(index)
    s = vectors.scores(v, v, "cosine")
    want = {(k, r + 1): o for k in range(40) for r, o in enumerate(sorted(range(40), key=lambda j: (-s[j, k], j))[:2])}
    assert {(r.id, r["rank"]): r.other for r in near.collect()} == want
    gaps = {r.id: r.gap for r in analyze.neighbour_gaps(near).collect()}
    assert gaps[5] is None and gaps[3] == 0.0  # of three equal rows the last doesn't find itself


def test_hashing_embedder_is_stable(spark):
    df = spark.createDataFrame([("Wind from west",), ("",)], "text string")
    a, b = [r.vector for r in embed.hashing_blake2b(df, "text", dim=64).collect()]
    assert a == embed.hashed_vector("Wind from west", 64) and math.isclose(sum(x * x for x in a), 1) and set(b) == {0.0}


def test_native_hashing_has_unit_length(spark):
    df = spark.createDataFrame([(1, "Wind from the west"), (2, "x")], "id int, text string")
    got = embed.hashing_native(df, "id", "text", 64).groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("l")).collect()
    assert all(math.isclose(r.l, 1) for r in got) and len(got) == 2


def test_cached_embedding_only_embeds_what_is_missing(spark):
    cache = spark.createDataFrame([], "key string, vector array<double>")
    calls = lambda texts: [[float(len(t))] for t in texts]
    df = spark.createDataFrame([("aa",), ("aa",), ("b",)], "text string")
    out, cache = embed.embed_cached(df, cache, "m", calls)
    assert sorted(r.vector[0] for r in out.collect()) == [1.0, 2.0, 2.0] and cache.count() == 2
    assert embed.cache_misses(df, cache, "m").count() == 0 and embed.cache_misses(df, cache, "other").count() == 2


def test_bm25_repeated_terms_and_empty_documents(spark):
    docs = spark.createDataFrame([("a", "red red blue"), ("b", "blue"), ("c", ""), ("d", None)], "id string, text string")
    index = retrieve.KeywordIndex.build(docs, "id")
    asked = spark.createDataFrame([(0, "red"), (1, "red red"), (2, "nothing")], "query_id int, text string")
    got = {(r.query_id, r.tool_id): r.score for r in index.search(asked, 5).collect()}
    n, avg = 4, 1.0
    idf = math.log(1 + (n - 1 + 0.5) / 1.5)
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert got.keys() == {(0, "a"), (1, "a")}
    assert math.isclose(got[0, "a"], want, rel_tol=1e-6) and math.isclose(got[1, "a"], 2 * want, rel_tol=1e-6)


def test_weighted_fusion_without_spread_counts_one(spark):
    run = lambda rows: spark.createDataFrame(rows, "query_id int, tool_id string, score double, rank int")
    got = {r.tool_id: r.score for r in retrieve.fuse_weighted([run([(0, "a", 5.0, 1), (0, "b", 5.0, 2)]), run([])], 5, [3.0, 1.0]).collect()}
    assert got == {"a": 0.75, "b": 0.75}


def test_widths():
    assert retrieve.fetch_size(5, 1000) == 20 and retrieve.pipeline_size(20) == 80 and retrieve.hybrid_size(80) == 240
    assert retrieve.fetch_size(5, 3) == 5 and retrieve.pipeline_size(4000) == 100


def test_resilient(spark):
    ok = lambda: spark.range(3)

    def fails():
        return spark.range(1).select(F.raise_error(F.lit("boom")).alias("id"))

    assert retrieve.resilient(ok)[1] is False
    assert retrieve.resilient(fails, ok)[0].count() == 3
    hits, degraded = retrieve.resilient(fails, on_error="empty")
    assert degraded and hits.count() == 0
    with pytest.raises(Exception, match="boom"):
        retrieve.resilient(fails, on_error="fail")


def candidates(spark, ids, **more):
    rows = [(1, t, t.split("/")[0], 1.0 - k / 10, k + 1) for k, t in enumerate(ids)]
    df = spark.createDataFrame(rows, "query_id int, tool_id string, namespace string, score double, rank int")
    for c, v in more.items():
        df = df.withColumn(c, v)
    return df


@pytest.mark.parametrize(
    "pattern, tool, match",
    [("delete_*", "delete_x", True), ("delete_*", "deletex", False), ("*", "a/b", True), ("a?c", "a/c", True), ("[!a]*", "b1", True), ("[a-c]1", "B1", True), ("a[", "a[", True), ("a", "a\n", False), ("a.c", "abc", False)],
)
def test_globs(spark, pattern, tool, match):
    got = spark.createDataFrame([(tool,)], "tool_id string").select(P.first_match([pattern])).first()[0]
    assert (got == pattern) is match


def test_mandatory_denial_ends_the_evaluation(spark):
    rules = (P.AllowTools("allow", patterns=("*",)), P.TenantIsolation("tenant_isolation"))
    df = candidates(spark, ["a/x"], owner=F.lit("t2"), tenant=F.lit("t1"))
    row = P.Policy(rules, mode="first_match").judged(df).first()
    assert row.decision == "deny" and [f.rule for f in row.firings] == ["tenant_isolation"]
    assert row.reason == "tenant_isolation: belongs to another tenant"


def test_mandatory_allow_overrides_the_default_under_first_match(spark):
    df = candidates(spark, ["a/x"], owner=F.lit(None).cast("string"), tenant=F.lit("t1"))
    assert P.Policy((P.TenantIsolation("t"),), mode="first_match", default=P.DENY).judged(df).first().decision == "allow"


def test_deny_overrides_and_default(spark):
    df = candidates(spark, ["a/x", "b/y"])
    rules = (P.AllowTools("allow", patterns=("a/*",)), P.DenyTools("deny", patterns=("*/X",)))
    got = {r.tool_id: (r.decision, r.reason) for r in P.Policy(rules).judged(df).collect()}
    assert got["a/x"] == ("deny", "deny: denied by pattern: '*/X'") and got["b/y"] == ("deny", "allow: not in the allowlist")
    assert P.Policy(default=P.DENY).judged(df).first().reason == "denied by default policy"


@pytest.mark.parametrize("limit, pinned, want", [(2, (), ["a/1", "a/2"]), (2, ("a/4",), ["a/1", "a/4"]), (1, ("a/3", "a/4"), ["a/3", "a/4"]), (-1, (), ["a/1", "a/2", "a/3", "a/4"]), (0, (), []), (2, ("no/where",), ["a/1", "a/2"])])
def test_max_tools_and_pins(spark, limit, pinned, want):
    df = candidates(spark, ["a/1", "a/2", "a/3", "a/4"])
    out = P.Policy(selection=(P.MaxTools(limit, pinned),)).evaluate(df).filter("kept").orderBy("rank").collect()
    assert [r.tool_id for r in out] == want


def test_strict_agents(spark):
    df = candidates(spark, ["a/x"])
    routed = lambda agent, strict: P.AgentPolicies({"known": P.Policy()}, P.Policy(default=P.ALLOW), strict).judged(df.withColumn("agent", F.lit(agent).cast("string"))).first().decision
    assert routed(None, True) == "allow" and routed("known", True) == "allow" and routed("other", True) == "deny" and routed("other", False) == "allow"


def test_policy_from_settings():
    p = P.build_policy({"deny": ["x"], "allow": ["*"], "max_risk": "low", "max_tools": 3, "min_score": 0.2})
    assert [r.name for r in p.rules] == ["allow", "deny", "max_risk"] and [r.name for r in p.selection] == ["min_score", "max_tools"]
    with pytest.raises(schema.PolicyError):
        P.Policy(mode="other")


def test_usage_boost_without_counts_changes_nothing(spark):
    hits = candidates(spark, ["a/1", "a/2"]).select("query_id", "tool_id", "score", "rank")
    none = spark.createDataFrame([], "tool_id string, count double")
    assert [(r.tool_id, r.score) for r in rerank.usage_boost(hits, none).orderBy("rank").collect()] == [("a/1", 1.0), ("a/2", 0.9)]


def test_model_rerank_survives_a_failing_scorer(spark):
    hits = candidates(spark, ["a/1", "a/2", "a/3"]).select("query_id", "tool_id", "score", "rank")
    asked = spark.createDataFrame([(1, "q")], "query_id int, text string")
    texts = spark.createDataFrame([(f"a/{k}", "x" * k) for k in (1, 2, 3)], "tool_id string, text string")
    order = lambda scorer, **kw: [r.tool_id for r in rerank.model_rerank(hits, asked, texts, scorer, **kw).orderBy("rank").collect()]
    assert order(lambda q, ts: [len(t) for t in ts]) == ["a/3", "a/2", "a/1"]
    assert order(lambda q, ts: [len(t) for t in ts], candidates=2) == ["a/2", "a/1", "a/3"]
    assert order(lambda q, ts: 1 / 0) == ["a/1", "a/2", "a/3"]


def test_half_lives_and_late_events(spark):
    rows = [("a", 0, 4.0), ("a", 100, 2.0), ("a", 500, 1.0), ("b", 0, -1.0), ("c", 0, 0.0)]
    df = spark.createDataFrame(rows, "tool_id string, s int, count double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.tool_id: r["count"] for r in feedback.usage_counts(df, F.lit(200.0), 100.0).collect()}
    assert got == {"a": 1.0 + 1.0 + 1.0}  # two half-lives, one, and an event of the future undecayed


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", 10, 3.0), ("a", 110, 1.0), ("b", 60, 2.0)], "tool_id string, s int, count double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    source = stream.events_stream(spark, str(tmp_path / "in"), df.schema)
    q = stream.forward_weights(source, 0.0, 100.0).writeStream.outputMode("complete").format("memory").queryName("weights").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.tool_id: round(r["count"], 9) for r in stream.decayed(spark.table("weights"), F.lit(200.0), 0.0, 100.0).collect()}
    want = {r.tool_id: round(r["count"], 9) for r in feedback.usage_counts(df, F.lit(200.0), 100.0).collect()}
    assert got == want


def test_sync_stream_and_versions(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    snapshot = C.catalogue_view(part)
    snapshot.write.parquet(str(tmp_path / "in"))
    store, seen = maintain.VersionedStore(spark, str(tmp_path / "store")), []
    for _ in range(2):
        items_ = spark.readStream.schema(snapshot.schema).parquet(str(tmp_path / "in"))
        stream.sync_stream(items_, store, str(tmp_path / "c"), lambda n, r: seen.append(r)).awaitTermination()
        C.changed_view(part).write.mode("append").parquet(str(tmp_path / "in"))
    assert store.current().count() == maintain.upsert(snapshot, C.changed_view(part)).count() and seen[0]["added"] > 0
    gone = store.current().limit(3).select("tool_id").persist()
    assert store.delete(gone) == 3 and store.delete(gone) == 0


def test_windows_accept_streams(spark, tmp_path):
    df = spark.createDataFrame([("v", 1, 5), ("v", 1, 7), ("w", 2, 4000)], "event_type string, user_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert stream.windowed_usage(df, "1 hour").count() == 2 and stream.session_usage(df, "10 minutes").count() == 2
    df.write.parquet(str(tmp_path / "in"))
    source = stream.events_stream(spark, str(tmp_path / "in"), df.schema)
    q = stream.windowed_usage(source, "1 hour").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").count() == 2


def test_contextual_queries(spark):
    rows = [(1, 0, "user", "one"), (1, 1, "assistant", "two"), (1, 2, "user", " three "), (1, 3, "user", "x" * 401), (1, 4, "user", "four"), (1, 5, "assistant", "end"), (1, 6, "user", "  "), (2, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    get = lambda *a, **k: {r.conv_id: r["query"] for r in feedback.contextual_queries(df, *a, **k).collect()}
    assert get() == {1: "three\nfour\nend\nend"} and get(0) == {1: "end\nend"} and get(9, 1) == {1: "one\nthree\nfour\nend"}
    assert get(2, 1, True) == {1: "three\nfour\nend"} and get(4, 0, True) == {1: "one\ntwo\nthree\nfour\nend"}


def test_aliases_need_weight_and_keep_five(spark):
    rows = [("t", f" Phrase  {k} ", 0, 3.0 + k) for k in range(7)] + [("t", "light", 0, 2.9), ("t", "x" * 121, 0, 9.0), ("t", "edge", 0, 3.0 - 1e-7)]
    df = spark.createDataFrame(rows, "tool_id string, phrase string, s int, weight double").withColumn("ts", F.timestamp_seconds("s"))
    got = [r.phrase for r in feedback.learnt_aliases(df, F.lit(0.0)).orderBy("rank").collect()]
    assert got == [f"phrase {k}" for k in (6, 5, 4, 3, 2)]


def test_metrics_of_negative_and_empty_cases(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "query_id int, tool_id string, rank int")
    expected = spark.createDataFrame([(1, "b"), (1, "b"), (3, "a")], "query_id int, tool_id string")
    cases = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "query_id int")
    got = {r.query_id: (r.recall, r.precision, r.hit, r.reciprocal_rank) for r in evaluate.case_results(hits, expected, cases).collect()}
    assert got == {1: (1.0, 0.5, True, 0.5), 2: (0.0, 0.0, False, 0.0), 3: (0.0, 0.0, False, 0.0), 4: (1.0, 1.0, True, 1.0)}


def test_wilson_and_percentiles(spark):
    low, high = evaluate.wilson(F.col("s"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "s int, n int").select(low, high).collect()
    assert got[0][0] == got[0][1] == 0.0 and math.isclose(got[1][0], 0.2366, abs_tol=1e-4) and got[2][1] == 1.0
    rng = random.Random(3)
    values = [rng.randrange(20) / 4 for _ in range(46)]
    want = {p: sorted(values)[round(p / 100 * 45)] for p in (0, 10, 50, 90, 100)}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {r.percentile: r.value for r in evaluate.nearest_rank(df, "v", (0, 10, 50, 90, 100)).collect()} == want


def test_dedup_keeps_first_place_and_last_value(spark):
    df = spark.createDataFrame([("a", "old", 1), ("b", "x", 2), ("a", "new", 3)], "tool_id string, d string, seq int")
    assert {(r.tool_id, r.d, r.first_seq) for r in maintain.dedup_last_wins(df, "seq").collect()} == {("a", "new", 1), ("b", "x", 2)}
    assert [tuple(r) for r in maintain.duplicate_ids(df).collect()] == [("a", 1)]


def test_graph_and_render(spark):
    df = spark.createDataFrame([("a/x", "a", "x", 'say "hi"\n', "{}")], "tool_id string, namespace string, name string, description string, input_schema string")
    for f in render.RENDERERS.values():
        made = json.loads(f(df).first().rendered)
        inner = made.get("function", made)
        assert inner["name"] == "a__x" and inner["description"] == 'say "hi"\n'
    assert json.loads(render.openai(df, strict=True).first().rendered)["function"]["strict"] is True
    assert render.resolve_name(df, "a__x").first().tool_id == "a/x"


def test_hooks(spark):
    h = hooks.Hooks()
    h.on("transform_hits", lambda df: df.filter("id > 1"))
    h.on("transform_hits", lambda df: None)
    assert h.transform("transform_hits", spark.range(4)).count() == 2
    with pytest.raises(schema.RegistryError):
        h.on("no_event", print)
    with pytest.raises(schema.RegistryError):
        hooks.create("store", "missing")
    assert hooks.create("x", "orrery.operators.retrieve:fetch_size", k=5, catalogue=9) == 9


_POINT = "#/components/schemas/Station"
WEATHER = {
    "info": {"title": "Weather Desk"},
    "servers": ["odd", {"url": "https://desk.example/v2"}],
    "components": {
        "schemas": {"Station": {"type": "object", "properties": {"upwind": {"$ref": _POINT}, "code": {"type": "string"}, "far": {"$ref": "https://else.example/x.json"}}, "required": ["code"]}},
        "parameters": {"Unit": {"name": "unit", "in": "query", "schema": {"type": "string"}, "description": "Kelvin or not."}},
    },
    "security": [{"key": ["look"]}, "odd"],
    "paths": {
        "/stations/{code}/gusts": {"parameters": [{"name": "code", "in": "path", "required": True, "schema": {"type": "string"}}, {"$ref": "#/components/parameters/Unit"}], "get": {"summary": "Gusts."}, "delete": {"deprecated": True}},
        "/stations": {"post": {"operationId": "plant station!", "security": [{"key": ["w", "a"]}], "tags": ["Steel Masts"], "parameters": [{"name": "code", "in": "query"}, {"name": "crumb", "in": "cookie"}, {"$ref": "#/nowhere"}], "requestBody": {"content": {"application/json": {"schema": {"$ref": _POINT, "title": "beside"}}}}}},
        "/masts": {"put": {"operationId": "plant station!", "security": [], "requestBody": {"content": {"application/merge-patch+json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/0"}}}}}}, "x-note": 1},
        "/odd": None,
    },
}


def test_openapi(spark):
    rows = {r["name"]: r for r in operations(WEATHER)}
    assert set(rows) == {"get_stations_by_code_gusts", "plant_station", "plant_station_put"}
    node, shape = rows["plant_station"], json.loads(rows["plant_station"]["input_schema"])
    assert shape["properties"] == {"code": {}, "upwind": {}, "body_code": {"type": "string"}, "far": {}} and shape["required"] == ["body_code"]
    assert node["required_scopes"] == ["a", "w"] and node["risk"] == "medium" and node["cost"] == "low" and node["tags"] == ["steel_masts"] and node["source_id"] == "openapi:weather_desk"
    assert json.loads(node["metadata"]["body_fields"]) == ["upwind", "body_code", "far"] and node["metadata"]["server"] == "https://desk.example/v2"
    gusts = json.loads(rows["get_stations_by_code_gusts"]["input_schema"])
    assert gusts["properties"]["unit"] == {"type": "string", "description": "Kelvin or not."} and gusts["required"] == ["code"]
    mast = rows["plant_station_put"]
    assert json.loads(mast["input_schema"]) == {"type": "object", "properties": {"body": {"type": "array", "items": {}}}, "required": ["body"]} and mast["required_scopes"] == []
    assert operation_name("get", "/", None) == "get"
    specs = spark.createDataFrame([("s", "desk", json.dumps(WEATHER)), ("e", "none", "{}"), ("b", "none", "{broken"), ("l", "none", "[1]"), (None, None, None)], "source_id string, namespace string, spec string")
    got = {r.tool_id: (r.risk_level, r.required_scopes) for r in read_openapi(specs, deprecated=True).collect()}
    assert got["desk/delete_stations_by_code_gusts"] == (2, ["look"]) and len(got) == 4
    with pytest.raises(Exception, match="without paths"):
        read_openapi(specs.filter("source_id = 'e'"), strict=True).collect()


def test_openapi_references_end(spark, tmp_path):
    chain = {f"S{k}": {"properties": {"l": {"$ref": f"#/components/schemas/S{k + 1}"}, "r": {"$ref": f"#/components/schemas/S{k + 1}"}}} for k in range(40)}
    spec = {"info": {"title": "Deep"}, "components": {"schemas": chain}, "paths": {"/d": {"post": {"requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/S0"}}}}}}}}
    (row,) = operations(spec)
    assert len(row["input_schema"]) < 2_000_000
    (tmp_path / "deep.json").write_text(json.dumps(spec))
    from orrery.sources.openapi import read_openapi_files

    assert [r.tool_id for r in read_openapi_files(spark, str(tmp_path / "deep.json"), tags=("outside",), cost="high").collect()] == ["deep/post_d"]


def find_gusts(term: str, limit: int = 10, tags: list[str] | None = None) -> str:
    """Find gusts.

    Args:
        term: What to look
            for.
        limit (int): How many.
    """


def test_function_source(spark):
    assert split_docstring(find_gusts.__doc__) == ("Find gusts.", {"term": "What to look for.", "limit": "How many."})
    assert type_schema(list[int]) == {"type": "array", "items": {"type": "integer"}}
    row = FunctionSource([find_gusts], namespace="desk").rows(spark).first()
    made = json.loads(row.input_schema)
    assert row.tool_id == "desk/find_gusts" and made["required"] == ["term"] and made["properties"]["limit"]["default"] == 10 and row.risk == "low"


def test_files_and_failures(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tools": [{"name": "x", "risk": "HIGH", "tags": ["b", "a", "b"]}]}))
    (tmp_path / "b.jsonl").write_text('{"name": "y", "namespace": "n"}\n{"name": "z"}\n')
    readers = {"a": lambda: C.read_items(spark, str(tmp_path / "a.json"), "a"), "b": lambda: C.read_items(spark, str(tmp_path / "b.jsonl"), "b"), "c": lambda: spark.read.parquet(str(tmp_path / "none"))}
    rows, failures = C.discover(spark, readers)
    assert {(r.tool_id, r.source_id) for r in rows.collect()} == {("default/x", "a"), ("n/y", "b"), ("default/z", "b")}
    assert [r.source_id for r in failures.collect()] == ["c"]
    with pytest.raises(schema.SourceError):
        C.discover(spark, readers, tolerate_failures=False)


def test_interpolation(tmp_path):
    env = {"A": "1"}
    assert config.interpolate({"x": ["${A}", "${B:-two}", "$${A}"]}, env) == {"x": ["1", "two", "${A}"]}
    with pytest.raises(schema.ConfigError, match="x"):
        config.interpolate({"x": "${B}"}, env)
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"policies": {"strict": True, "agents": {"a": {"max_risk": "low"}}}}))
    policies = config.agent_policies(config.load(str(path)))
    assert policies.strict and policies.by_agent["a"].rules[0].ceiling == "low"
    path.write_text("{\"nope\": 1}")
    with pytest.raises(schema.ConfigError):
        config.load(str(path))


def test_policy_grants(spark):
    diff = spark.createDataFrame([("a", "x", "gained"), ("a", "y", "lost"), ("b", "z", "gained")], "agent string, tool_id string, change string")
    cat = items(spark, [("x", "n", [], 3), ("y", "n", [], 0), ("z", "n", [], 2)])
    got = {r.agent: (r.gained, r.lost, r.grants_high_risk, r.grants_at_least_high) for r in analyze.grants(diff, cat).collect()}
    assert got == {"a": (1, 1, False, True), "b": (1, 0, True, True)}


def test_listing_source(spark):
    from orrery.sources import datasource

    datasource.register(spark)
    servers = {"a": {"items": [{"name": "x", "annotations": {"destructiveHint": True}, "inputSchema": {"type": "object"}}]}, "b": {"down": True}, "c": {"namespace": "n", "items": [{"name": "y", "annotations": {"readOnlyHint": True}}]}}
    read = spark.read.format("orrery_listing").option("servers", json.dumps(servers)).option("lister", "orrery.sources.datasource:example_lister")
    got = {(r.tool_id, r.source_id, r.risk) for r in schema.normalised_items(read.load()).collect()}
    assert got == {("a/x", "a", "high"), ("n/y", "c", "low")}
    with pytest.raises(Exception, match="no answer"):
        read.option("tolerateFailures", "false").load().collect()


def test_nearest_rank_of_nothing_and_of_many(spark):
    assert evaluate.nearest_rank(spark.createDataFrame([], "v double"), "v").count() == 0
    values = [(k * k % 10007) / 3 for k in range(5000)]
    got = {r.percentile: r.value for r in evaluate.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v", (1, 37, 99)).collect()}
    assert got == {p: sorted(values)[round(p / 100 * 4999)] for p in (1, 37, 99)}


def test_sparse_searches_equal_their_sql_in_blocks_and_give_texts_without_features_a_row(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"red bolt {k}" if k else "..") for k in range(40)], "id long, text string")
    index = embed.hashed_rows(texts, "id", "text", 64).withColumnRenamed("id", "tool_id")
    asked = embed.hashed_rows(texts.filter("id < 9"), "id", "text", 64).withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, vectors.search(index, asked, 5, dim=64).collect()))
    assert [r[1:] for r in whole[:5]] == [(k, 0.0, k + 1) for k in range(5)]
    wide = vectors.search(index.withColumn("vector", F.expr("transform(sequence(0, 63), b -> aggregate(filter(vector, x -> x.bucket = b), 0D, (s, x) -> s + x.weight))")), asked.withColumn("vector", F.expr("transform(sequence(0, 63), b -> aggregate(filter(vector, x -> x.bucket = b), 0D, (s, x) -> s + x.weight))")), 5)
    assert sorted(map(tuple, wide.collect())) == whole
    for name, value in (("MAX_QUERIES", 4), ("INDEX_BLOCK", 16), ("MAX_SCORES", 8)):
        monkeypatch.setattr(vectors, name, value)
    assert sorted(map(tuple, vectors.search(index, asked, 5, dim=64).collect())) == whole


def test_token_lines_equal_the_tokens_of_the_engine(spark):
    texts = [None, "", " ", "..", "a", "A", "aB", "ABc", "getHTTPUrl2Go", "x9Y", "Ünïcode größeÄB 漢字a", "a\u0000b\nC", "ſKı", "𝐀b𝐁C", "_snake__case_", "Z z", "", "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = [r.line or "" for r in df.orderBy("id").select(F.array_join(text.tokenize(F.col("text")), " ").alias("line")).collect()]
    whole = pa.array(["aB c", *texts, "Z"])
    assert embed.token_lines(pa.array(texts)).to_pylist() == want == embed.token_lines(whole.slice(1, len(texts))).to_pylist()
    assert embed.token_lines(pa.array([], pa.string())).to_pylist() == [] and embed.token_lines(pa.array([None, ""], pa.string())).to_pylist() == ["", ""]


def test_many_like_sparse_queries_score_few_rows_and_lose_none(monkeypatch):
    rng = np.random.default_rng(3)
    kinds = [f"{a} {b} of type {c}" for a in ("red", "hot", "blue", "large") for b in ("bolt", "ring", "gizmo") for c in ("economy", "small")]
    texts = [f"{kinds[k % len(kinds)]} {rng.integers(10**5)}" for k in range(3000)]
    texts += ["red bolt of type economy 77"] * 40 + ["", "zebra"]
    asked = [f"red bolt of type economy {k}" for k in range(70, 370)] + ["", "blue ring", "quite another question"]
    names, hasher = pa.array([f"t{k:05}" for k in rng.permutation(len(texts))]), embed.Hasher()
    rows, queries = hasher(pa.array(texts)), hasher(pa.array(asked))
    query, bucket = np.nonzero(queries)
    offsets = np.searchsorted(query, np.arange(len(asked) + 1))
    by_name = np.asarray(pc.sort_indices(names))
    exact = np.round(queries @ rows[by_name].T, 9) + 0.0
    best = np.argsort(-exact, axis=1, kind="stable")[:, :5]
    want = [(q, names[int(by_name[r])].as_py(), exact[q, r]) for q in range(len(asked)) for r in best[q]]
    scored, score = [], vectors.Alike._score
    monkeypatch.setattr(vectors.Alike, "_score", lambda self, who, q, r, at: (scored.append((q.shape[0] * r.shape[0], (who < 300).sum() * r.shape[0])), score(self, who, q, r, at))[1])
    for settings in ({}, {"ALIKE": 50, "TILE": 7, "WAITING": 200, "THIN": 1}):
        for name, value in settings.items():
            monkeypatch.setattr(vectors, name, value)
        scored.clear()
        found = vectors.Alike(offsets, bucket, queries[query, bucket], embed.DIM, 5)
        for at in range(0, len(texts), 500):
            found.see(names[at : at + 500], rows[at : at + 500])
        got = found.table(pa.array(range(len(asked))), "tool_id").to_pydict()
        got = sorted(zip(got["query_id"], got["tool_id"], got["score"]), key=lambda x: (x[0], -x[2], x[1]))
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1.1e-9)
        assert sum(x[1] for x in scored) < 0.35 * 300 * len(texts), "like queries are compared with few rows"


def test_many_sparse_queries_do_not_multiply_the_index(spark, monkeypatch):
    index = spark.range(3000).selectExpr("concat('t', id) as tool_id", "concat('red bolt ', id % 1700) as line")
    texts = spark.range(4200).selectExpr("id", "concat('red bolt of type economy ', id) as text")
    asked = embed.hashed_rows(texts, "id", "text").withColumnRenamed("id", "query_id")
    found = vectors.search(index, asked, 3, vector_col="line", dim=embed.DIM, read=embed.Hasher)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1, "rows stay where they are; only hits are shuffled"
    got = {(r.query_id, r["rank"]): (r.tool_id, r.score) for r in found.collect()}
    monkeypatch.setattr(vectors, "MAX_ENTRIES", 60_000)
    monkeypatch.setattr(vectors, "INDEX_BLOCK", 100)
    blocks = vectors.search(index, asked, 3, vector_col="line", dim=embed.DIM, read=embed.Hasher)
    assert "Generate" in blocks._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r["rank"]): (r.tool_id, r.score) for r in blocks.collect()} == {k: (v[0], pytest.approx(v[1], abs=1.1e-9)) for k, v in got.items()}
    few = vectors.search(embed.hashed_rows(index, "tool_id", "line").withColumnRenamed("id", "tool_id"), asked.filter("query_id % 300 = 17"), 3, "ip", dim=embed.DIM)
    want = {(r.query_id, r["rank"]): (r.tool_id, r.score) for r in few.collect()}
    assert len(got) == 3 * 4200 and len(want) == 42 and all(got[k] == (v[0], pytest.approx(v[1], abs=1.1e-9)) for k, v in want.items())


def test_native_hashing_shuffles_nothing(spark):
    df = spark.createDataFrame([(1, "a b a b a"), (2, ""), (3, None)], "id long, text string")
    out = embed.hashing_native(df, "id", "text", 64)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in out.collect()} == {1}


def test_keyword_search_scores_like_documents_and_queries_once(spark):
    words = ["red bolt", "red ring", "blue bolt bolt", "red bolt", "ring of blue", "..."]
    texts = [(k, words[k % 6] if k % 5 else words[k % 6] + " steel") for k in range(60)]
    corpus = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame([(k, ("red bolt", "bolt red", "steel steel ring", "none")[k % 4]) for k in range(12)], "query_id long, text string")
    allowed = corpus.filter("doc_id <> 3").select("doc_id")
    found = retrieve.KeywordIndex.build(corpus, only=retrieve.KeywordIndex.terms_of(asked)).search(asked, 7, "doc_id", allowed)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()  # no row for each pair of a query and a document
    docs = {k: [w for w in t.replace(".", " ").split() if w] for k, t in texts}
    mean = sum(map(len, docs.values())) / len(docs)
    want = []
    for q in asked.collect():
        scored = []
        for k, d in docs.items():
            part = 0.0
            for w in q.text.split():
                df, tf = sum(w in x for x in docs.values()), d.count(w)
                part += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(len(d), 1) / mean))
            if part > 0 and k != 3:
                scored.append((-round(part, 9), k))
        want += [(q.query_id, k, -s, place) for place, (s, k) in enumerate(sorted(scored)[:7], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_best_columns_keep_ties_in_order():
    rng = np.random.default_rng(1)
    s = np.round(rng.random((20, 700)) * 12) * (rng.random((20, 700)) < 0.7)
    s[3], s[4, 5:] = 0, 0
    row, column, score = retrieve._best_columns(s, 6)
    want = [(r, c) for r in range(20) for c in sorted(range(700), key=lambda c: (-s[r, c], c))[:6] if s[r, c] > 0]
    assert list(zip(row.tolist(), column.tolist())) == want and (s[row, column] == score).all()


def test_search_rounds_and_sorts_few_of_the_scores(monkeypatch):
    rng = np.random.default_rng(4)
    rows, asked = rng.normal(size=(4000, 8)), rng.normal(size=(50, 8))
    want = vectors.scores(rows, asked, "cosine")
    rounded, plain = [], np.round
    monkeypatch.setattr(np, "round", lambda a, *x, **y: (rounded.append(np.size(a)), plain(a, *x, **y))[1])
    best = vectors.Best(asked, 5, "cosine")
    best.see(pa.array([f"t{k:04d}" for k in range(4000)]), rows)
    out = best.table(pa.array(range(50)), "tool_id")
    assert sum(rounded) < want.size / 10
    assert [x.as_py() for x in out["tool_id"]] == [f"t{r:04d}" for q in range(50) for r in np.argsort(-want[:, q], kind="stable")[:5]]


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_search_among_equal_and_odd_rows_in_batches(monkeypatch, metric):
    monkeypatch.setattr(vectors, "MAX_SCORES", 5000)
    rng = np.random.default_rng(5)
    rows = np.round(rng.normal(size=(900, 3)), 1)
    rows[100:700], rows[5], rows[7, 0], rows[9] = rows[0], 0, np.nan, np.inf
    names = np.array([f"t{k:03d}" for k in rng.permutation(900)])
    with np.errstate(all="ignore"):
        s = vectors.scores(rows, rows[:20], metric)
        for k in (1, 6, 1000):
            best = vectors.Best(rows[:20], k, metric)
            for at in range(0, 900, 130):
                best.see(pa.array(names[at : at + 130]), rows[at : at + 130])
            out = best.table(pa.array(range(20)), "tool_id")
            order = [sorted(range(900), key=lambda j: (-np.nan_to_num(s[j, q], nan=-np.inf, posinf=np.inf, neginf=-np.inf), names[j]))[:k] for q in range(20)]
            assert out["tool_id"].to_pylist() == [names[j] for js in order for j in js]
            assert np.array_equal(np.asarray(out["score"]), np.concatenate([s[js, q] for q, js in enumerate(order)]), equal_nan=True)


def test_both_runs_of_a_fusion_read_one_joined_catalogue(spark):
    for run in Q.catalogue_runs(spark, "/root/testdata/sf0.001", 60):
        plan = run._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan and "Join Inner, (p_partkey" not in plan.split("InMemoryRelation")[0]


def test_members_are_joined_only_to_classes_that_can_be_hits(spark):
    corpus = spark.createDataFrame([(k, "red bolt" if k % 2 else "red ring steel") for k in range(60)] + [(60, "red bolt bolt"), (61, "red")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "bolt red"), (2, "red"), (3, "ring")], "query_id long, text string")
    index = retrieve.KeywordIndex.build(corpus, only=retrieve.KeywordIndex.terms_of(asked))
    found = index.search(asked, 4, "doc_id")
    assert {(r.query_id, r["rank"]): r.doc_id for r in found.collect()} == {(1, 1): 60, (1, 2): 1, (1, 3): 3, (1, 4): 5, (2, 1): 61, (2, 2): 1, (2, 3): 3, (2, 4): 5, (3, 1): 0, (3, 2): 2, (3, 3): 4, (3, 4): 6}
    assert "Filter (above" in found._jdf.queryExecution().analyzed().toString()
