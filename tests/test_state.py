"""Stores, state tables, embedders, reports, settings and commands."""

import http.server
import json
import logging
import threading

import pytest
from pyspark.sql import functions as F

from orrery import __main__ as cli
from orrery import config, conformance, observe, schema
from orrery.functions import embed, vectors
from orrery.operators import analyze, evaluate, feedback, maintain, render, report, rerank, retrieve, state
from orrery.operators import policy as P
from orrery.sources import catalogue as C

ITEMS = "tool_id string, namespace string, text string, source_id string, risk_level int, cost_level int, tags array<string>, required_scopes array<string>, owner string"


def items(spark, rows):
    return spark.createDataFrame([(f"{ns}/{n}", ns, text, src, risk, 0, [], [], None) for ns, n, text, src, risk in rows], ITEMS)


def test_conformance(spark, tmp_path):
    conformance.check_store(spark, maintain.VersionedStore(spark, str(tmp_path / "by namespace")))
    conformance.check_store(spark, maintain.VersionedStore(spark, str(tmp_path / "whole"), ()))
    for renderer in render.RENDERERS.values():
        conformance.check_renderer(spark, renderer)
    conformance.check_embedder(lambda texts: [embed.hashed_vector(t) for t in texts])
    conformance.check_retriever(spark, lambda index, asked, k: vectors.search(index, asked, k))
    none = spark.createDataFrame([("ns1/item_4", 3.0)], "tool_id string, count double")
    conformance.check_reranker(spark, lambda hits: rerank.usage_boost(hits, none, 0.5))
    seen = []
    conformance.check_tracer(lambda name, attributes, seconds: seen.append((name, attributes)))
    assert seen == [("step", {"size": 3, "found": 1}), ("broken", {"error": "KeyError"})]
    conformance.check_tracer(lambda *_: 1 / 0)
    with pytest.raises(AssertionError):
        conformance.check_embedder(lambda texts: [[1.0] for _ in texts])


def test_sync_embeds_new_texts_and_writes_touched_partitions_only(spark, tmp_path):
    store, calls = maintain.VersionedStore(spark, str(tmp_path / "s")), []

    def embedder(df):
        calls.append(sorted(r.tool_id for r in df.select("tool_id").collect()))
        return df.withColumn("vector", F.array(F.length("text").cast("double")))

    first = [("a", "x", "one", "s1", 0), ("a", "y", "two", "s1", 1), ("b", "z", "three", "s2", 2), ("c", "w", "four", "s3", 0)]
    assert store.sync(items(spark, first), embedder) is None
    before = store.manifest()["folders"]
    second = [("a", "x", "one", "s1", 3), ("b", "z", "three!", "s2", 2), ("b", "v", "five", "s2", 1)]
    got = store.sync(items(spark, second), embedder, spark.createDataFrame([("s1",), ("s2",)], "source_id string"))
    assert got == {"added": 1, "reembedded": 1, "rewritten": 1, "unchanged": 0, "removed": 1, "total": 3}
    assert calls[0] == ["a/x", "a/y", "b/z", "c/w"] and all(c == ["b/v", "b/z"] for c in calls[1:])
    rows = {r.tool_id: (r.text, r.risk_level, r.vector) for r in store.current().collect()}
    assert rows == {"a/x": ("one", 3, [3.0]), "b/z": ("three!", 2, [6.0]), "b/v": ("five", 1, [4.0]), "c/w": ("four", 0, [4.0])}
    after = store.manifest()["folders"]
    assert after["namespace=c"] == before["namespace=c"] and after["namespace=a"] != before["namespace=a"]
    assert store.vacuum() == 2 and store.vacuum() == 0 and store.current().count() == 4
    assert report.sync_text(got) == "4 changed of 3: 1 added, 1 reembedded, 1 rewritten, 0 unchanged, 1 removed"


def test_two_writers_of_one_version_collide(spark, tmp_path):
    store = maintain.VersionedStore(spark, str(tmp_path / "s"))
    store.write(items(spark, [("a/b %", "x", "one", "s", 0)]))
    assert store.get("a/b %/x")[0].namespace == "a/b %"
    store.upsert(items(spark, [("a/b %", "y", "two", "s", 0)]))
    assert len(store) == 2
    other = maintain.VersionedStore(spark, store.path)
    other.versions = lambda: store.versions()[:-1]
    with pytest.raises(Exception, match="exist"):
        other._commit(store.current().schema, {})


def test_tables_are_tolerant(spark, tmp_path):
    usage = state.Usage(spark, str(tmp_path / "usage"))
    assert usage.read().count() == 0
    with pytest.raises(schema.StoreError):
        state.Usage(spark, str(tmp_path / "usage"), missing_ok=False).read()
    usage.record("a", "a", "b")
    usage.record("b", count=2.5)
    got = {r.tool_id: round(r["count"], 3) for r in usage.counts().collect()}
    assert got == {"a": 2.0, "b": 3.5}
    usage.forget(spark.createDataFrame([("a",)], "tool_id string"))
    assert [r.tool_id for r in usage.counts().collect()] == ["b"]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    assert state.Aliases(spark, str(tmp_path / "broken")).read().count() == 0
    usage.clear()
    assert usage.read().count() == 0


def test_aliases_and_approvals(spark, tmp_path):
    aliases = state.Aliases(spark, str(tmp_path / "aliases"))
    aliases.record(" Where is  it ", "a/x", 2.0)
    aliases.record("where is it", "a/x")
    now = spark.range(1).select(F.unix_timestamp()).first()[0] + 5
    assert round(aliases.weight_of("a/x", "WHERE is it", now), 3) == 3.0 and aliases.weight_of("a/x", "other", now) == 0.0
    assert [(r.tool_id, r.phrase) for r in aliases.snapshot(now).collect()] == [("a/x", "where is it")] and aliases.known_items().count() == 1
    full = "tool_id string, description string, input_schema string, risk_level int, required_scopes array<string>, tags array<string>"
    make = lambda *rows: spark.createDataFrame([(i, d, "{}", 0, [], []) for i, d in rows], full)
    old, new = make(("a", "one"), ("b", "two")), make(("a", "one"), ("b", "TWO"), ("c", "three"))
    approvals, guard = state.Approvals(spark, str(tmp_path / "ok")), maintain.DriftGuard(trust_on_first_use=False)
    served = {r.tool_id: r.description for r in approvals.accept(guard, old, new).collect()}
    assert served == {"a": "one", "b": "two"} and [r.tool_id for r in approvals.read().collect()] == ["a"]
    approvals.approve(new)
    assert {r.tool_id: r.description for r in approvals.accept(guard, old, new).collect()} == {"a": "one", "b": "TWO", "c": "three"}
    approvals.forget(new.filter("tool_id = 'c'"))
    assert sorted(r.tool_id for r in approvals.read().collect()) == ["a", "b"]
    text = [r.text for r in report.drift_text(guard.changes(old, new, approvals.read().limit(0))).collect()]
    assert text == ["b: description changed from 'two' to 'TWO' (held)"]


class Model(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        made = [[float(len(t)), 1.0] for t in asked["input"]]
        answer = {"embeddings": made} if self.path == "/api/embed" else {"data": [{"index": k, "embedding": v} for k, v in reversed(list(enumerate(made)))]}
        body = json.dumps(answer if asked["model"] != "short" else {"embeddings": []}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_embedders_behind_http(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}"
    try:
        df = spark.createDataFrame([("ab",), ("",), ("abcd",)], "text string").coalesce(1)
        for style in ("ollama", "openai", "azure"):
            model = embed.HttpModel("m", host, style, dim=2, key="k")
            assert [r.vector for r in embed.embed_with(df, "text", model, batch=2).collect()] == [[2.0, 1.0], [1.0, 1.0], [4.0, 1.0]]
        assert embed.HttpModel("m", host, prefix="q: ")()(["x"]) == [[4.0, 1.0]]
        with pytest.raises(schema.DimensionMismatchError):
            embed.HttpModel("m", host, dim=3)()(["x"])
        with pytest.raises(schema.EmbeddingError):
            embed.HttpModel("short", host)()(["x"])
    finally:
        server.shutdown()
    with pytest.raises(schema.EmbeddingError):
        embed.HttpModel("m", "http://127.0.0.1:9")()(["x"])
    assert embed.default_embedder()(df).columns == ["text", "vector"]


def test_a_bounded_cache_loses_its_oldest_half(spark):
    cache = spark.createDataFrame([], "key string, vector array<double>")
    calls = lambda texts: [[float(len(t))] for t in texts]
    for batch in ("abc", "de", "fgh"):
        df = spark.createDataFrame([(c,) for c in batch], "text string")
        _, cache = embed.embed_cached(df, cache, "m", calls, max_entries=6)
        cache = spark.createDataFrame(cache.collect(), cache.schema)
    ages = sorted(r.age for r in cache.collect())
    assert ages == [0, 0, 0]  # eight entries are too many; three of six stay


def test_stored_keyword_index(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "red bolt"), (2, "blue bolt"), (3, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "red bolt bolt")], "query_id int, text string")
    hits = lambda index: [(r.doc_id, r.score) for r in index.search(asked, 5, "doc_id").orderBy("rank").collect()]
    want = hits(retrieve.KeywordIndex.build(corpus))
    for _ in range(2):
        index = retrieve.KeywordIndex.stored(corpus.repartition(3), str(tmp_path))
        assert hits(index) == want and index.stats.first().n == 3
    assert len(list(tmp_path.iterdir())) == 1
    more = corpus.unionByName(spark.createDataFrame([(4, "red red")], corpus.schema))
    assert hits(retrieve.KeywordIndex.stored(more, str(tmp_path)))[0][0] == 1 and len(list(tmp_path.iterdir())) == 2
    only = retrieve.KeywordIndex.build(corpus, only=retrieve.KeywordIndex.terms_of(asked.withColumn("text", F.lit("red"))))
    assert only.stats.first().n == 3 and [r.term for r in only.terms.collect()] == ["red"]
    only.release()


def test_bindings(spark):
    df = spark.createDataFrame([("a/x", "a", "x", "does", "{}"), ("a/y", "a", "y", "does", "{}")], "tool_id string, namespace string, name string, description string, input_schema string")
    bound = render.bind(df, {"a/x": lambda n: n + 1}, lambda tool_id, arguments: (tool_id, arguments))
    assert bound["a__x"](n=1) == 2 and bound["a__y"](n=1) == ("a/y", {"n": 1})
    with pytest.raises(schema.InvocationError):
        render.bind(df, {})
    assert list(render.bind(df, {"a/x": print}, skip=True)) == ["a__x"]
    clash = df.unionByName(spark.createDataFrame([("a/x 2", "a", "x", "other", "{}")], df.schema))
    with pytest.raises(schema.RenderError):
        render.bind(clash, {}, lambda *_: None)
    with pytest.raises(schema.RegistryError):
        render.rendered(df, "nothing")
    with pytest.raises(schema.RegistryError):
        render.register_renderer("openai", render.openai)


def test_rules_conversations_and_hints(spark):
    rules = P.describe_rules(P.build_policy({"deny": ["x*"], "max_risk": "low", "max_tools": 3}))
    assert [(r["kind"], r["name"]) for r in rules] == [("DenyTools", "deny"), ("MaxLevel", "max_risk"), ("MaxTools", "max_tools")] and rules[0]["settings"]["patterns"] == ["x*"]
    talk = feedback.Conversation(spark).add_user("one").add_assistant("two").add_user("three")
    assert talk.query() == "one\nthree\nthree" and feedback.Conversation(spark).query() == ""
    visible = spark.createDataFrame([("ab/cdef", "cdef"), ("xx/abcd", "abcd"), ("q", "zz")], "tool_id string, name string")
    asked = spark.createDataFrame([(1, "abcd"), (2, "cde"), (3, "zz"), (4, "none at all"), (5, "x/ab")], "ask_id int, wanted string")
    assert {r.ask_id: r.hint for r in analyze.hints(visible, asked).collect()} == {1: "xx/abcd", 2: "ab/cdef", 3: "q", 5: "xx/abcd"}


def test_catalogues_of_any_size(spark):
    assert C.core_catalogue(spark).count() == 40
    a, b = C.sized_catalogue(spark, 100, 1), C.sized_catalogue(spark, 100, 2)
    order = lambda df: [r.tool_id for r in df.orderBy("position").collect()]
    assert len(set(order(a))) == 100 and set(order(a)) == set(order(b)) and order(a) != order(b)


def test_an_invalid_item_is_named_by_its_index(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "x"}, {"name": "y/z"}]))
    with pytest.raises(Exception, match="item 1: invalid name: y/z"):
        C.read_items(spark, str(tmp_path / "a.json")).collect()


def test_json_log():
    record = logging.makeLogRecord({"name": "orrery", "msg": "read %s", "args": ("x",), "levelname": "INFO", "rows": 3})
    made = json.loads(observe.JsonFormatter().format(record))
    assert made["message"] == "read x" and made["rows"] == 3 and made["level"] == "INFO"


def test_settings_build_what_they_name(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "x"}]))
    made = {
        "sources": [{"id": "good", "path": str(tmp_path / "a.json")}, {"id": "bad", "path": str(tmp_path / "none.json")}, {"kind": "functions", "id": "py", "functions": ["json:dumps"], "namespace": "py"}],
        "drift": {"trust_on_first_use": False, "path": str(tmp_path / "ok")}, "usage": {"weight": 0.2, "path": str(tmp_path / "use")}, "savings": {"path": str(tmp_path / "audit")},
        "hooks": {"strict": True, "transform_hits": ["json:dumps"]}, "fallback": {"on_error": "empty"}, "retrieval": {"metric": "ip"}, "tracer": "builtins:print",
    }
    rows, failures = config.sources(spark, made)
    assert sorted(r.tool_id for r in rows.collect()) == ["default/x", "py/dumps"] and [r.source_id for r in failures.collect()] == ["bad"]
    assert config.drift_guard(made) == maintain.DriftGuard(trust_on_first_use=False) and config.drift_guard({}) is None
    assert set(config.tables(spark, made)) == {"usage", "drift", "savings"} and config.on_error(made) == "empty"
    assert config.engine_options(made) == {"metric": "ip", "usage_weight": 0.2} and config.hooks(made).strict
    config.tracer(made)
    assert observe.tracing_enabled()
    observe.set_tracer(None)
    for broken in ({"drift": {"x": 1}}, {"fallback": {"on_error": "x"}}, {"hooks": {"transform_hits": ["no path"]}}):
        with pytest.raises(schema.ConfigError):
            config.drift_guard(broken), config.on_error(broken), config.hooks(broken)


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    rows = C.core_catalogue(spark).select("name", "namespace", "description", "tags", "risk").collect()
    path = tmp_path / "items.json"
    path.write_text(json.dumps([r.asDict() for r in rows]))
    cases = tmp_path / "cases.jsonl"
    cases.write_text('{"query": "cancel cargo and release what they hold", "expected": ["cargo/cancel_cargo"], "category": "plain"}\n{"query": "check the present state of fuel", "expected": ["fuel/find_fuel"], "category": "hard"}\n')
    assert cli.main(["bench", str(path), str(cases), "-k", "1", "--json"]) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["total"]["cases"] == 2 and made["total"]["hits"] == 1 and made["failed"] == 1 and made["categories"][0]["category"] == "hard"
    assert cli.main(["bench", str(path), str(cases), "-k", "1", "--min-hit-rate", "0.9"]) == 1 and "1 hits" in capsys.readouterr().out
    (tmp_path / "noise.txt").write_text("# nothing\nswans on the lake\n\nlemons\n")
    assert cli.main(["calibrate", str(path), "--noise", str(tmp_path / "noise.txt"), "--json"]) == 0
    floors = json.loads(capsys.readouterr().out)
    assert len(floors["floors"]) == 5 and floors["recommended"] is not None
    (tmp_path / "c.json").write_text(json.dumps({"policies": {"default": {"require_scopes": True, "max_risk": "low"}}}))
    assert cli.main(["query", str(path), "book berths", "--config", str(tmp_path / "c.json"), "--scopes", "a,b", "--tenant", "t", "--json"]) == 0
    assert all("book" not in h["tool_id"] for h in json.loads(capsys.readouterr().out)["hits"])
    assert cli.main(["doctor", str(path)]) == 0 and "of 40 items" in capsys.readouterr().out
    assert cli.main(["index", str(path), str(tmp_path / "store")]) == 0 and cli.main(["index", str(path), str(tmp_path / "store")]) == 0
    assert "0 changed of 40" in capsys.readouterr().out


def test_texts_of_reports(spark):
    found = spark.createDataFrame([("a", ["thin"]), ("b", []), ("c", ["thin", "shadowed"])], "tool_id string, issues array<string>")
    assert report.diagnosis_text(found) == "2 of 3 items with an issue\n  c: thin, shadowed\n  a: thin"
    diff = spark.createDataFrame([("a", "x", "gained"), ("a", "y", "lost")], "agent string, tool_id string, change string")
    assert report.diff_text(diff) == "a gained 1: x\na lost 1: y" and report.diff_text(diff.limit(0)) == "no change"
    rows = spark.createDataFrame([(3, 200, 120, 8000, 60)], "tools_sent int, catalogue int, est_sent int, est_full int, actual int")
    assert report.savings_text(analyze.savings(rows)) == "1 selections: 60 of 4000 tokens sent (measured), 98.5% saved"
    floors = spark.createDataFrame([(90, 0.5, 0.9, 0.1, 0.2)], "percentile int, floor double, noise_rejected double, samples_emptied double, samples_thinned double")
    assert "p90: floor 0.5000" in report.calibration_text(floors) and evaluate.recommended(floors) == 0.5 and evaluate.recommended(floors, 50) is None


def test_approximate_index_reaches_its_recall(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("tool_id"), F.col("embedding").alias("vector"))
    asked = e.filter("tool_id % 20 = 0").select(F.col("tool_id").alias("query_id"), "vector")
    exact = vectors.search(e, asked, 10).persist()
    cells = vectors.Cells.fit(e, 16)
    placed = cells.place(e).persist()
    assert placed.count() == e.count() and placed.select("cell").distinct().count() > 8
    found = cells.search(placed, asked, 10, 11).persist()
    assert vectors.recall(found, exact) >= 0.9 and vectors.recall(cells.search(placed, asked, 10, 16), exact) == 1.0
    monkeypatch.setattr(vectors, "INDEX_BLOCK", 5)
    monkeypatch.setattr(vectors, "MAX_QUERIES", 2)
    again = cells.search(placed, asked, 10, 11)
    key = lambda df: sorted((r.query_id, r["rank"], r.tool_id) for r in df.collect())
    assert key(again) == key(found)
    assert cells.search(placed, asked.limit(0), 10).count() == 0


def test_schemas_become_structs():
    from orrery.sources import functions as f

    made = f.struct_type({"properties": {"a b": {"type": "integer"}, "a_b": {"type": ["string", "null"]}, "class": {"type": "array", "items": {"type": "number"}}, "1x": {"type": "object", "properties": {"y": {}}}, "m": {"type": "object"}, "o": True}, "required": ["a b"]})
    assert made.simpleString() == "struct<a_b:bigint,a_b_:string,_class:array<double>,_1x:struct<y:string>,m:map<string,string>,o:string>"
    assert [x.nullable for x in made.fields] == [False, True, True, True, True, True]


def test_protocols_and_async(spark, tmp_path):
    import asyncio

    from orrery import aio, protocols
    from orrery.operators.select import Engine, nested, payload

    assert isinstance(maintain.VersionedStore(spark, str(tmp_path)), protocols.Store) and isinstance(P.AllowTools("x"), protocols.PolicyRule)
    index = conformance.sample(spark).withColumn("cost_level", F.lit(0)).withColumn("required_scopes", F.array().cast("array<string>")).withColumn("owner", F.lit(None).cast("string"))
    asked = spark.createDataFrame([(1, [1.0, 0.0], None, [], None)], "query_id int, vector array<double>, agent string, scopes array<string>, tenant string")
    engine = Engine(index)
    rows = asyncio.run(aio.select(engine, asked, 2))
    assert [r.tool_id for r in sorted(rows, key=lambda r: r["rank"])][0] == "ns0/item_0" and len(rows) == 2
    made = payload(nested(engine.evaluated(asked, 2)).first())
    assert made["selected"][0] == {"id": "ns0/item_0", "rank": 1, "score": 1.0} and len(made["selected"]) == 2 and made["excluded"][0]["stage"] == "truncation"


def test_streams_of_aliases_savings_and_audits(spark, tmp_path):
    from orrery.streaming import feedback as stream

    events = spark.createDataFrame([("a", " Red  Bolt", 10, 3.0), ("a", "red bolt", 110, 1.0), ("b", "", 60, 2.0), ("b", "x" * 121, 60, 2.0)], "tool_id string, phrase string, s int, weight double")
    events = events.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream.alias_weights(source, 0.0, 100.0).writeStream.outputMode("complete").format("memory").queryName("aliases").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = stream.decayed(spark.table("aliases"), F.lit(210.0), 0.0, 100.0).collect()
    want = feedback.alias_weights(events, F.lit(210.0), 100.0).collect()
    assert [(r.tool_id, r.phrase, round(r["count"], 9)) for r in got] == [(r.tool_id, r.phrase, r.weight) for r in want] == [("a", "red bolt", 0.75 + 0.5)]
    sent = spark.createDataFrame([(3, 200, 120, 8000, 60), (2, 200, 80, 8000, None)], "tools_sent int, catalogue int, est_sent int, est_full int, actual int")
    sent.write.parquet(str(tmp_path / "sent"))
    totals = stream.savings_totals(spark.readStream.schema(sent.schema).parquet(str(tmp_path / "sent")))
    totals.writeStream.outputMode("complete").format("memory").queryName("saved").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("saved").first() == analyze.savings(sent).first()
    for _ in range(2):
        stream.append_sink(spark.readStream.schema(sent.schema).parquet(str(tmp_path / "sent")), str(tmp_path / "audit"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2  # each row once, however often the stream is started


def test_batches_to_python_are_bounded(spark):
    import pyarrow as pa

    from orrery import session

    session.ship(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{session.BATCH_BYTES}b"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    rows = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("t"))
    found = [r.n for r in session.map_arrow(rows, sizes, "n long").collect()]
    assert len(found) > 3 and max(found) < 1.1 * session.BATCH_BYTES
