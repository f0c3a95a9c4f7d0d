"""Every query of the library by name, with the SQL it should equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed, text, vectors
from ..operators import analyze, evaluate, feedback, maintain, render, rerank, retrieve
from ..operators import policy as P
from ..operators.filters import Filters
from ..operators.hooks import Hooks
from ..operators.select import Engine
from ..schema import RISK_TIERS, tier
from ..session import spread
from ..sources import catalogue as C
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return C.from_parts(spark, sf)


def listed(c: str) -> F.Column:
    return F.array_join(F.array_sort(c), ",")


def r6(c: str | F.Column, name: str | None = None) -> F.Column:
    return F.round(c, 6).alias(name or c)


# sources ----------------------------------------------------------------------------------------------------------

_ROW = ("tool_id", "name", "namespace", "description", "risk_level", "cost_level", "owner", "source_id")


@query("scan_catalogue", S.q(S.CAT, f"select {', '.join(_ROW)}, {S.TAGS} as tags, array_to_string(required_scopes, ',') as required_scopes from cat"))
def scan_catalogue(spark, sf):
    return parts(spark, sf).select(*_ROW, listed("tags").alias("tags"), listed("required_scopes").alias("required_scopes"))


@query("source_stamp_union", "select 'supplier/' || s_name as tool_id, 'suppliers' as source_id from supplier union all select 'part/' || p_partkey, 'parts' from part")
def source_stamp_union(spark, sf):
    a = C.stamped(table(spark, sf, "supplier").select(F.concat(F.lit("supplier/"), "s_name").alias("tool_id")), "suppliers")
    b = C.stamped(table(spark, sf, "part").select(F.concat(F.lit("part/"), F.col("p_partkey")).alias("tool_id")), "parts")
    return C.union_sources([a, b])


@query("filler_catalogue", f"""with k as (select range as id, {list(C.FILLER_VERBS)}[range % 8 + 1] as verb, {list(C.FILLER_NOUNS)}[(range // 8) % 20 + 1] as noun from range(1000))
select verb || '_' || noun || '_' || id as name, noun || 's' as namespace, noun || 's/' || verb || '_' || noun || '_' || id as tool_id,
       upper(verb[1]) || verb[2:] || ' one or more ' || noun || ' records.' as description from k""")
def filler_catalogue(spark, sf):
    return C.filler_catalogue(spark, 1000)


@query("core_catalogue", f"select verb || '_' || area as name, area as namespace, area || '/' || verb || '_' || area as tool_id, replace(about, '{{0}}', area) as description, risk from (select unnest({list(C.CORE_AREAS)}) as area), (select unnest({[w[0] for w in C.CORE_WORK]}) as verb, unnest({[w[1] for w in C.CORE_WORK]}) as about, unnest({[w[2] for w in C.CORE_WORK]}) as risk)")
def core_catalogue(spark, sf):
    return C.core_catalogue(spark).select("name", "namespace", "tool_id", "description", "risk")


@query("store_upsert", S.q(S.CAT, S.NEW, "select tool_id, description, risk_level from new union all select tool_id, description, risk_level from cat where tool_id not in (select tool_id from new)"))
def store_upsert(spark, sf):
    part = table(spark, sf, "part")
    return maintain.upsert(C.catalogue_view(part), C.changed_view(part)).select("tool_id", "description", "risk_level")


@query("store_delete", S.q(S.CAT, "select tool_id from cat where key % 10 <> 0"))
def store_delete(spark, sf):
    cat = parts(spark, sf)
    return maintain.delete(cat, cat.filter("key % 10 = 0")).select("tool_id")


# filters ----------------------------------------------------------------------------------------------------------


def _filtered(name: str, filters: Filters, where: str) -> None:
    @query(name, S.q(S.CAT, f"select tool_id, namespace, risk_level, {S.TAGS} as tags from cat where {where}"))
    def run(spark, sf):
        return filters.apply(parts(spark, sf)).select("tool_id", "namespace", "risk_level", listed("tags").alias("tags"))


_filtered("filter_namespace", Filters(namespaces=frozenset({"economy", "promo"})), "namespace in ('economy', 'promo')")
_filtered("filter_tool_ids", Filters(tool_ids=frozenset({"economy/small_ring_0", "small/blue_bolt_2"}), exclude_tool_ids=frozenset({"small/blue_bolt_2"})), "tool_id = 'economy/small_ring_0'")
_filtered("filter_tags_any", Filters(tags_any=frozenset({"brand#2", "red"})), "list_has_any(tags, ['brand#2', 'red'])")
_filtered("filter_tags_all", Filters(tags_all=frozenset({"brand#2", "small"})), "list_has_all(tags, ['brand#2', 'small'])")
_filtered("filter_exclude_tags", Filters(exclude_tags=frozenset({"red", "blue"})), "not list_has_any(tags, ['red', 'blue'])")
_filtered("filter_max_risk", Filters(max_risk="medium"), "risk_level <= 1")
_filtered(
    "filter_bundle",
    Filters(namespaces=frozenset({"economy", "large", "small"}), tags_any=frozenset({"red", "small", "blue"}), exclude_tags=frozenset({"brand#7"}), max_risk="high"),
    "namespace in ('economy', 'large', 'small') and list_has_any(tags, ['red', 'small', 'blue']) and not list_has_any(tags, ['brand#7']) and risk_level <= 2",
)

# text -------------------------------------------------------------------------------------------------------------


@query("text_humanize", f"select p_partkey, {S.HUMAN.format('p_name || $$.Http$$ || p_type')} as readable from part".replace("$$", "'"))
def text_humanize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.humanize(F.concat("p_name", F.lit(".Http"), "p_type")).alias("readable"))


@query("text_tokenize", f"select doc_id, len({S.TOKENS.format('text')})::int as n, md5(array_to_string({S.TOKENS.format('text')}, ' ')) as digest from documents")
def text_tokenize(spark, sf):
    t = text.tokenize(F.col("text"))
    return spread(table(spark, sf, "documents")).select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("index_text", S.q(S.CAT, f"select tool_id, {S.index_text()} as text from cat"))
def index_text(spark, sf):
    return maintain.with_text(parts(spark, sf)).select("tool_id", "text")


@query("embed_cache_misses", """with t as (select distinct text from documents), k as (select sha256('hashing' || chr(0) || text) as key, text from t),
c as (select distinct sha256('hashing' || chr(0) || text) as key from documents where lang = 'en') select key, length(text)::int as n from k where key not in (select key from c)""")
def embed_cache_misses(spark, sf):
    docs = table(spark, sf, "documents")
    cache = docs.filter("lang = 'en'").select(F.sha2(F.concat_ws("\u0000", F.lit("hashing"), "text"), 256).alias("key")).distinct()
    return embed.cache_misses(docs, cache, "hashing").select("key", F.length("text").alias("n"))


@query("vector_normalize", S.q(S.EMB, "select vec_id, round(sqrt(list_dot_product(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))))), 6) as length, round(v[1] / sqrt(list_dot_product(v, v)), 6) as first from emb"))
def vector_normalize(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", vectors.normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", r6(vectors.norm(F.col("u")), "length"), r6(F.element_at("u", 1), "first"))


@query("cosine_pairs", S.q(S.EMB, "select a.vec_id as left_id, b.vec_id as right_id, round(list_cosine_similarity(a.v, b.v), 6) as cosine from emb a join emb b on a.label = b.label where a.vec_id % 20 = 0"))
def cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("left_id"), "label", F.col("embedding").alias("q"))
    return asked.join(e, "label").select("left_id", F.col("vec_id").alias("right_id"), r6(vectors.cosine(F.col("q"), F.col("embedding")), "cosine"))


@query("content_hash", S.q(S.CAT, "select tool_id, substr(sha256(length(description) || ':' || description || length(namespace) || ':' || namespace), 1, 16) as digest from cat"))
def content_hash(spark, sf):
    return parts(spark, sf).select("tool_id", text.content_hash(F.col("description"), F.col("namespace")).alias("digest"))


@query("alias_normalise", r"select conv_id, turn, lower(trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g'))) as phrase from conversations")
def alias_normalise(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.normalise_phrase(F.col("text")).alias("phrase"))


@query("flatten_name", S.q(S.CAT, "select tool_id, regexp_replace(namespace || '__' || name, '[^a-zA-Z0-9_-]', '_', 'g') as flat from cat"))
def flatten_name(spark, sf):
    return parts(spark, sf).select("tool_id", text.flatten_name(F.col("namespace"), F.col("name")).alias("flat"))


@query("risk_classify", "with k as (select range as id, " + f"{list(C.FILLER_VERBS)}[range % 8 + 1]" + " as verb from range(1000)) select id, verb, case when verb = 'delete' then 'high' when verb in ('create', 'update') then 'medium' else 'low' end as risk from k")
def risk_classify(spark, sf):
    verbs = F.element_at(F.array(*map(F.lit, C.FILLER_VERBS)), (F.col("id") % 8 + 1).cast("int"))
    return spark.range(1000).select("id", verbs.alias("verb"), text.risk_by_name(F.concat(verbs, F.lit("_thing"))).alias("risk"))


@query("token_estimate", S.q(S.CAT, """select tool_id, length('{"name":"' || name || '","description":"' || description || '"}') // 4 as tokens from cat"""))
def token_estimate(spark, sf):
    rendered = F.to_json(F.struct("name", "description"))
    return parts(spark, sf).select("tool_id", text.token_estimate(rendered).alias("tokens"))


@query("contextual_query", r"""with t as (select *, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) as said from conversations), n as (select * from t where said <> ''),
l as (select conv_id, max(turn) as last from n group by 1),
h as (select n.*, row_number() over (partition by conv_id order by turn desc) as place from n join l using (conv_id) where turn < last and role = 'user' and length(text) <= 400),
x as (select conv_id, turn, said from h where place <= 2 union all select n.conv_id, turn, said || chr(10) || said from n join l on n.conv_id = l.conv_id and turn = last)
select conv_id, string_agg(said, chr(10) order by turn) as query from x group by 1""")
def contextual_query(spark, sf):
    return feedback.contextual_queries(table(spark, sf, "conversations"))


@query("latest_user_turn", "select conv_id, arg_max(text, turn) as text from conversations where role = 'user' group by 1")
def latest_user_turn(spark, sf):
    return feedback.latest_user_turn(table(spark, sf, "conversations"))


# retrieval --------------------------------------------------------------------------------------------------------


def indexed(spark: SparkSession, sf: str, vector: Callable[[F.Column], F.Column] = vectors.doubles) -> DataFrame:
    """The items that have a vector; only these are made into items."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("p_partkey"), vector(F.col("embedding")).alias("vector"), "label")
    return C.catalogue_view(table(spark, sf, "part").join(e, "p_partkey"), "vector", "label")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("key")
    agent = F.element_at(F.array(F.lit("analyst"), F.lit("operator"), F.lit(None), F.lit("guest")), (F.floor(key / 20) % 4 + 1).cast("int"))
    scopes = F.when(key % 40 == 0, F.array(F.lit("write"))).otherwise(F.array().cast("array<string>"))
    return indexed(spark, sf).filter("key % 20 = 0").select(key.alias("query_id"), "vector", agent.alias("agent"), scopes.alias("scopes"), F.concat(F.lit("t"), key % 3).alias("tenant"))


def hits(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    return vectors.search(indexed(spark, sf), requests(spark, sf), k)


def candidates(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """Hits with their catalogue rows and their requests' agent, scopes and tenant."""
    return hits(spark, sf, k).join(indexed(spark, sf).drop("vector"), "tool_id").join(requests(spark, sf).drop("vector"), "query_id")


_TOP = "select query_id, tool_id, rank, round(score, 6) as score from hits"


def _metric(name: str, metric: str, expression: str) -> None:
    sql = S.q(S.EMB, f"s as (select q.vec_id as query_id, e.vec_id as tool_id, round({expression}, 9) as score from emb q, emb e where q.vec_id % 20 = 0)",
              "hits as (select *, row_number() over (partition by query_id order by score desc, tool_id)::int as rank from s qualify rank <= 10)", _TOP)

    @query(name, sql)
    def run(spark, sf):
        e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("tool_id"), F.col("embedding").alias("vector"))
        asked = e.filter("tool_id % 20 = 0").select(F.col("tool_id").alias("query_id"), "vector")
        return vectors.search(e, asked, 10, metric).select("query_id", "tool_id", "rank", r6("score"))


_metric("vector_topk", "cosine", "list_cosine_similarity(q.v, e.v)")
_metric("vector_topk_ip", "ip", "list_dot_product(q.v, e.v)")
_metric("vector_topk_l2", "l2", "-sqrt(greatest(list_dot_product(q.v, q.v) + list_dot_product(e.v, e.v) - 2 * list_dot_product(q.v, e.v), 0))")
_metric("vector_topk_manhattan", "manhattan", "-list_sum(list_transform(list_zip(q.v, e.v), lambda p: abs(p[1] - p[2])))")


@query("vector_topk_cells")
def vector_topk_cells(spark, sf):
    """The approximate index: every row is in a cell, a request looks into eleven of sixteen, as these vectors hardly cluster."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("tool_id"), F.col("embedding").alias("vector"))
    asked = e.filter("tool_id % 20 = 0").select(F.col("tool_id").alias("query_id"), "vector")
    cells = vectors.Cells.fit(e, 16)
    return cells.search(cells.place(e), asked, 10, 11).select("query_id", "tool_id", "rank", r6("score"))


@query("semantic_min_score", S.q(S.SCORED, S.hits(20), _TOP + " where score >= 0.3"))
def semantic_min_score(spark, sf):
    return hits(spark, sf).filter("score >= 0.3D").select("query_id", "tool_id", "rank", r6("score"))


def documents_index(spark: SparkSession, sf: str) -> retrieve.KeywordIndex:
    return retrieve.KeywordIndex.build(spread(table(spark, sf, "documents")))


_DOCS = "corpus as (select doc_id as id, text from documents), question as (select item_id as query_id, text from benchmark)"


@query("bm25_postings", S.q(_DOCS, S.BM25, "select term, id, length, tf from post"))
def bm25_postings(spark, sf):
    return documents_index(spark, sf).postings.select("term", "id", F.col("length").cast("long").alias("length"), "tf")


@query("bm25_idf", S.q(_DOCS, S.BM25, "select term, df, round(idf, 6) as idf from term"))
def bm25_idf(spark, sf):
    return documents_index(spark, sf).terms.select("term", "df", r6("idf"))


@query("bm25_topk", S.q(_DOCS, S.BM25, "hits as (select query_id, id as doc_id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from bm where score > 0 qualify rank <= 10)", "select query_id, doc_id, rank, round(score, 6) as score from hits"))
def bm25_topk(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = retrieve.KeywordIndex.build(spread(table(spark, sf, "documents")), only=retrieve.KeywordIndex.terms_of(asked))
    return index.search(asked, 10, "doc_id").select("query_id", "doc_id", "rank", r6("score"))


def catalogue_runs(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The semantic and the keyword run of the requests over the catalogue."""
    idx = maintain.with_text(indexed(spark, sf, lambda v: v)).select("key", "tool_id", "description", "text", "vector").persist()  # joined once, read several times
    asked = idx.filter("key % 20 = 0").select(F.col("key").alias("query_id"), F.col("description").alias("text"), "vector")
    keyword = retrieve.KeywordIndex.build(idx, "tool_id", only=retrieve.KeywordIndex.terms_of(asked)).search(asked, k)
    return vectors.search(idx, asked, k), keyword


_RUNS = (
    S.SCORED, S.hits(60, name="sem"), f"corpus as (select tool_id as id, {S.index_text()} as text from idx), question as (select key as query_id, description as text from idx where key % 20 = 0)", S.BM25,
    "kw as (select query_id, id as tool_id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from bm where score > 0 qualify rank <= 60)",
)


@query("hybrid_rrf", S.q(*_RUNS, "f as (select query_id, tool_id, round(sum(part), 9) as score from (select query_id, tool_id, 1.0::double / (60 + rank) as part from sem union all select query_id, tool_id, 1.0::double / (60 + rank) from kw) group by all)",
                         "hits as (select *, row_number() over (partition by query_id order by score desc, tool_id)::int as rank from f qualify rank <= 20)", _TOP))
def hybrid_rrf(spark, sf):
    return retrieve.fuse_rrf(catalogue_runs(spark, sf, retrieve.hybrid_size(20)), 20).select("query_id", "tool_id", "rank", r6("score"))


_NORM = "case when max(score) over w = min(score) over w then 1.0::double else (score - min(score) over w) / (max(score) over w - min(score) over w) end"


@query("hybrid_weighted", S.q(*_RUNS, f"f as (select query_id, tool_id, round(sum(part) / 1.0::double, 9) as score from (select query_id, tool_id, 0.75::double * {_NORM} as part from sem window w as (partition by query_id) union all select query_id, tool_id, 0.25::double * {_NORM} from kw window w as (partition by query_id)) group by all)",
                              "hits as (select *, row_number() over (partition by query_id order by score desc, tool_id)::int as rank from f qualify rank <= 20)", _TOP))
def hybrid_weighted(spark, sf):
    return retrieve.fuse_weighted(catalogue_runs(spark, sf, retrieve.hybrid_size(20)), 20, [0.75, 0.25]).select("query_id", "tool_id", "rank", r6("score"))


_USED = "used as (select 'x' as x), cnt as (select tool_id, c::double as count from (select l_partkey as k, count(*) as c from lineitem group by 1) join idx on k = key)"
_BOOST = "boosted as (select query_id, tool_id, round(score + round({w}::double * coalesce(ln(1 + coalesce(count, 0)) / ln(1 + (select max(count) from cnt)), 0) * abs(score), 9), 9) as score from hits left join cnt using (tool_id))"


def usage_of(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").cast("double").alias("count"))
    return indexed(spark, sf).select("key", "tool_id").join(calls, "key").select("tool_id", "count")


@query("usage_boost", S.q(S.SCORED, S.hits(20), _USED, _BOOST.format(w=0.1), "select query_id, tool_id, row_number() over (partition by query_id order by score desc, tool_id)::int as rank, round(score, 6) as score from boosted"))
def usage_boost(spark, sf):
    return rerank.usage_boost(hits(spark, sf), usage_of(spark, sf), 0.1).select("query_id", "tool_id", "rank", r6("score"))


@query("pipeline_topk", S.q(S.SCORED, S.hits(80), _USED, _BOOST.format(w=0.1), "select query_id, tool_id, row_number() over (partition by query_id order by score desc, tool_id)::int as rank, round(score, 6) as score from boosted qualify rank <= 5"))
def pipeline_topk(spark, sf):
    width = retrieve.pipeline_size(retrieve.fetch_size(5, 1000))
    return rerank.usage_boost(hits(spark, sf, width), usage_of(spark, sf), 0.1, 5).select("query_id", "tool_id", "rank", r6("score"))


@query("usage_weight_sweep", S.q(S.SCORED, S.hits(20), _USED, ", ".join(_BOOST.format(w=w).replace("boosted as", f"b{k} as") for k, w in enumerate((0.05, 0.1, 0.2, 0.4))),
                                 "a as (" + " union all ".join(f"select {w}::double as weight, * from (select *, row_number() over (partition by query_id order by score desc, tool_id) as rank from b{k} qualify rank <= 5)" for k, w in enumerate((0.05, 0.1, 0.2, 0.4))) + ")",
                                 "select weight, round(avg((i.label = r.label)::int), 6) as precision from a join idx i using (tool_id) join req r using (query_id) group by 1"))
def usage_weight_sweep(spark, sf):
    base, counts = hits(spark, sf), usage_of(spark, sf)
    labels = indexed(spark, sf).select("key", "tool_id", "label")
    out = None
    for w in (0.05, 0.1, 0.2, 0.4):
        one = rerank.usage_boost(base, counts, w, 5).select(F.lit(w).alias("weight"), "query_id", "tool_id")
        out = one if out is None else out.unionByName(one)
    known = out.join(labels.select("tool_id", "label"), "tool_id").join(labels.select(F.col("key").alias("query_id"), F.col("label").alias("want")), "query_id")
    return known.groupBy("weight").agg(r6(F.avg((F.col("label") == F.col("want")).cast("int")), "precision"))


def random_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Counts that have nothing to do with use."""
    return indexed(spark, sf).select("tool_id", (F.col("key") * 7919 % 13).cast("double").alias("count"))


_ARMS = [(arm, w) for arm in ("informed", "random") for w in (0.05, 0.2)]


@query("usage_arms", S.q(S.SCORED, S.hits(20), _USED, "rnd as (select tool_id, (key * 7919 % 13)::double as count from idx)",
                         ", ".join(_BOOST.format(w=w).replace("boosted as", f"b{k} as").replace("cnt", "rnd" if arm == "random" else "cnt") for k, (arm, w) in enumerate(_ARMS)),
                         "a as (" + " union all ".join(f"select '{arm}' as arm, {w}::double as weight, * from (select *, row_number() over (partition by query_id order by score desc, tool_id) as rank from b{k} qualify rank <= 5)" for k, (arm, w) in enumerate(_ARMS)) + ")",
                         "select arm, weight, round(avg((i.label = r.label)::int), 6) as precision from a join idx i using (tool_id) join req r using (query_id) group by 1, 2"))
def usage_arms(spark, sf):
    base = hits(spark, sf)
    counts = {"informed": usage_of(spark, sf), "random": random_usage(spark, sf)}
    labels = indexed(spark, sf).select("key", "tool_id", "label")
    out = None
    for arm, w in _ARMS:
        one = rerank.usage_boost(base, counts[arm], w, 5).select(F.lit(arm).alias("arm"), F.lit(w).alias("weight"), "query_id", "tool_id")
        out = one if out is None else out.unionByName(one)
    known = out.join(labels.select("tool_id", "label"), "tool_id").join(labels.select(F.col("key").alias("query_id"), F.col("label").alias("want")), "query_id")
    return known.groupBy("arm", "weight").agg(r6(F.avg((F.col("label") == F.col("want")).cast("int")), "precision"))


@query("graph_expand", S.q(S.SCORED, S.hits(5), "edge as (select a.tool_id as src, b.tool_id as dst from idx a join idx b on b.key = a.key + 1)",
                           "x as (select query_id, tool_id, score from hits union all select query_id, dst, round(score * 0.99::double, 9) from hits join edge on tool_id = src)",
                           "m as (select query_id, tool_id, max(score) as score from x group by 1, 2)", "select query_id, tool_id, row_number() over (partition by query_id order by score desc, tool_id)::int as rank, round(score, 6) as score from m"))
def graph_expand(spark, sf):
    idx = indexed(spark, sf).select("key", "tool_id")
    edges = idx.select(F.col("tool_id").alias("src"), (F.col("key") + 1).alias("to")).join(idx.select(F.col("key").alias("to"), F.col("tool_id").alias("dst")), "to").select("src", "dst")
    base = hits(spark, sf, 5)
    near = base.join(edges, base["tool_id"] == edges["src"]).select("query_id", F.col("dst").alias("tool_id"), F.round(F.col("score") * 0.99, 9).alias("score"))
    best = base.select("query_id", "tool_id", "score").unionByName(near).groupBy("query_id", "tool_id").agg(F.max("score").alias("score"))
    return vectors.ranked(best, 1 << 30).select("query_id", "tool_id", "rank", r6("score"))


@query("lexical_caller", S.q(S.SCORED, S.hits(20), f"w as (select query_id, h.tool_id as tool_id, rank, list_distinct({S.TOKENS.format('h.description')}) as t, list_distinct({S.TOKENS.format('r.description')}) as s from hits h join idx r on r.key = query_id)".replace("r.description", "(r.tags[2] || ' ' || r.namespace)"),
                             "c as (select *, round(len(list_intersect(t, s)) / sqrt(len(t)::double), 9) as score from w)", "select query_id, tool_id as chosen, round(score, 6) as score from c where score > 0 qualify row_number() over (partition by query_id order by score desc, rank) = 1"))
def lexical_caller(spark, sf):
    idx = indexed(spark, sf)
    asked = idx.select(F.col("key").alias("query_id"), F.concat(F.element_at("tags", 2), F.lit(" "), "namespace").alias("query"))
    offered = hits(spark, sf).join(idx.select("tool_id", F.col("description").alias("text")), "tool_id").join(asked, "query_id").withColumnRenamed("rank", "position")
    return rerank.lexical_choice(offered).select("query_id", "chosen", r6("score"))


# policy -----------------------------------------------------------------------------------------------------------

_DENY_GLOBS, _ALLOW_GLOBS = ("economy/*", "*bolt_1?", "Promo/red_*"), ("small/*", "*ring*", "medium/blue_[wb]*")


def _rule(name: str, rule: P.Rule, sql: str) -> None:
    """One rule over the whole catalogue for a caller without scopes, of tenant t1."""

    @query(name, S.q(S.CAT, f"v as (select tool_id, {sql} as v from cat)", "select tool_id, v.decision as decision, v.reason as reason from v where v is not null"))
    def run(spark, sf):
        rows = parts(spark, sf).withColumn("scopes", F.array(F.lit("read"))).withColumn("tenant", F.lit("t1"))
        return rows.withColumn("v", rule.check()).filter("v is not null").select("tool_id", "v.decision", "v.reason")


def _globs(patterns: tuple[str, ...]) -> str:
    return "case " + " ".join(f"when tool_id glob '{p.lower()}' then '{p}'" for p in patterns) + " end"


def _said(decision: str, reason: str) -> str:
    return f"{{'decision': '{decision}', 'reason': {reason}}}"


_rule("policy_deny_globs", P.DenyTools("deny", patterns=_DENY_GLOBS), f"case when {_globs(_DENY_GLOBS)} is not null then {_said('deny', 'concat($denied by pattern: $, chr(39), ' + _globs(_DENY_GLOBS) + ', chr(39))')} end".replace("$", "'"))
_rule("policy_allow_globs", P.AllowTools("allow", patterns=_ALLOW_GLOBS), f"case when {_globs(_ALLOW_GLOBS)} is not null then {_said('allow', 'concat($matched allow pattern $, chr(39), ' + _globs(_ALLOW_GLOBS) + ', chr(39))')} else {_said('deny', '$not in the allowlist$')} end".replace("$", "'"))
_rule("policy_require_scopes", P.RequireScopes("require_scopes"), f"case when len(required_scopes) > 0 then {_said('deny', '$missing scopes: write$')} end".replace("$", "'"))
_rule("policy_tenant", P.TenantIsolation("tenant_isolation"), f"case when owner is null then {_said('allow', '$shared tool, no tenant$')} when owner <> 't1' then {_said('deny', '$belongs to another tenant$')} else {_said('allow', '$tenant $ || owner')} end".replace("$", "'"))
_rule("policy_max_risk", P.MaxRisk("medium"), f"case when risk_level > 1 then {_said('deny', '$risk $ || [$low$, $medium$, $high$, $critical$][risk_level + 1] || $ exceeds ceiling medium$')} end".replace("$", "'"))
_rule("policy_max_cost", P.MaxCost("low"), f"case when cost_level > 1 then {_said('deny', '$cost $ || [$free$, $low$, $medium$, $high$][cost_level + 1] || $ exceeds ceiling low$')} end".replace("$", "'"))
_rule("policy_deny_tags", P.DenyTags("deny_tags", tags=("red", "brand#3")), f"case when list_has_any(tags, ['red', 'brand#3']) then {_said('deny', '$carries denied tag(s): $ || array_to_string(list_sort(list_intersect(tags, [$red$, $brand#3$])), $, $)')} end".replace("$", "'"))
_rule("policy_require_tags", P.RequireTags("require_tags", tags=("red", "brand#3")), f"case when not list_has_all(tags, ['red', 'brand#3']) then {_said('deny', '$missing required tag(s): $ || array_to_string(list_sort(list_filter([$red$, $brand#3$], lambda x: not list_contains(tags, x))), $, $)')} end".replace("$", "'"))


class _Odd(P.PredicateRule):
    """Built when it is used: a Column needs a session."""

    def check(self):
        return P.PredicateRule(self.name, predicate=F.expr("key % 2 = 1"), reason=self.reason).check()


_rule("policy_predicate", _Odd("odd", reason="even key"), f"case when key % 2 = 0 then {_said('deny', '$even key$')} end".replace("$", "'"))

_RULES = (P.MaxRisk("high"), P.DenyTools("deny", patterns=("promo/*",)), P.RequireScopes("require_scopes"), P.TenantIsolation("tenant_isolation"))
#: The same rules in SQL, in evaluation order: the mandatory one first.
_F_TENANT = "case when owner is null then {'rule': 'tenant_isolation', 'decision': 'allow', 'reason': 'shared tool, no tenant'} when owner <> tenant then {'rule': 'tenant_isolation', 'decision': 'deny', 'reason': 'belongs to another tenant'} else {'rule': 'tenant_isolation', 'decision': 'allow', 'reason': 'tenant ' || owner} end"
_F_RISK = "case when risk_level > 2 then {'rule': 'max_risk', 'decision': 'deny', 'reason': 'risk critical exceeds ceiling high'} end"
_F_DENY = "case when tool_id glob 'promo/*' then {'rule': 'deny', 'decision': 'deny', 'reason': 'denied by pattern: ' || chr(39) || 'promo/*' || chr(39)} end"
_F_SCOPE = "case when len(required_scopes) > 0 then case when len(scopes) = 0 then {'rule': 'require_scopes', 'decision': 'deny', 'reason': 'missing scopes: write'} else {'rule': 'require_scopes', 'decision': 'allow', 'reason': 'all required scopes held'} end end"
_JUDGE = (
    S.SCORED, S.hits(20), "cand as (select h.*, r.agent, r.scopes, r.tenant from hits h join req r using (query_id))",
    f"fired as (select *, list_filter(case when ({_F_TENANT}).decision = 'deny' then [{_F_TENANT}] else [{_F_TENANT}, {_F_RISK}, {_F_DENY}, {_F_SCOPE}] end, lambda x: x is not null) as f from cand)",
    "judged as (select *, case when len(list_filter(f, lambda x: x.decision = 'deny')) > 0 then 'deny' else 'allow' end as decision, array_to_string(list_transform(list_filter(f, lambda x: x.decision = 'deny'), lambda x: x.rule || ': ' || x.reason), '; ') as why from fired)",
)


@query("policy_deny_overrides", S.q(*_JUDGE, "select query_id, tool_id, decision, case when decision = 'deny' then why end as reason from judged"))
def policy_deny_overrides(spark, sf):
    return P.Policy(_RULES).judged(candidates(spark, sf)).select("query_id", "tool_id", "decision", "reason")


@query("policy_first_match", S.q(*_JUDGE, "select query_id, tool_id, case when f[1].decision = 'deny' then 'deny' when len(f) > 1 then f[2].decision else 'allow' end as decision, case when f[1].decision = 'deny' then f[1].reason when len(f) > 1 then f[2].reason else f[1].reason end as last_reason from judged"))
def policy_first_match(spark, sf):
    out = P.Policy(_RULES, mode="first_match").judged(candidates(spark, sf))
    return out.select("query_id", "tool_id", "decision", F.element_at("firings", -1)["reason"].alias("last_reason"))


@query("policy_firings", S.q(*_JUDGE, "u as (select query_id, tool_id, unnest(f) as x from fired)", "select query_id, tool_id, x.rule as rule, x.decision as decision, x.reason as reason from u"))
def policy_firings(spark, sf):
    return P.firing_rows(P.Policy(_RULES).judged(candidates(spark, sf)))


_FLOOR = "floored as (select * from judged where decision = 'allow')"


@query("policy_exclusions", S.q(*_JUDGE, _FLOOR, "capped as (select *, row_number() over (partition by query_id order by rank) as place from floored where score >= 0.1::double)",
                                "select query_id, tool_id, 'policy' as stage, why as reason from judged where decision = 'deny' union all select query_id, tool_id, 'min_score', printf('score %.4f below threshold 0.1000', score) from floored where score < 0.1::double union all select query_id, tool_id, 'max_tools', 'beyond max_tools limit of 5' from capped where place > 5"))
def policy_exclusions(spark, sf):
    return P.exclusions(P.Policy(_RULES, (P.MinScore(0.1), P.MaxTools(5))).evaluate(candidates(spark, sf)))


@query("policy_dry_run", S.q(*_JUDGE, "c as (select *, row_number() over (partition by query_id order by rank) as place from judged)", "select query_id, tool_id, rank, case when decision = 'deny' then 'policy' when place > 5 then 'max_tools' end as stage, true as kept from c"))
def policy_dry_run(spark, sf):
    return P.Policy(_RULES, (P.MaxTools(5),), dry_run=True).evaluate(candidates(spark, sf)).select("query_id", "tool_id", "rank", "stage", "kept")


@query("policy_min_score", S.q(S.SCORED, S.hits(20), "select query_id, tool_id, score >= 0.3::double as kept, case when score < 0.3::double then printf('score %.4f below threshold 0.3000', score) end as reason from hits"))
def policy_min_score(spark, sf):
    return P.Policy(selection=(P.MinScore(0.3),)).evaluate(candidates(spark, sf)).select("query_id", "tool_id", "kept", "reason")


@query("policy_max_tools", S.q(S.SCORED, S.hits(20), "p as (select *, tool_id in (select tool_id from idx where key in (3, 40)) as pin from hits)", "c as (select *, row_number() over (partition by query_id, pin order by rank) as place, sum(pin::int) over (partition by query_id) as pins from p)", "select query_id, tool_id, rank, pin or place <= greatest(5 - pins, 0) as kept from c"))
def policy_max_tools(spark, sf):
    pinned = tuple(r.tool_id for r in indexed(spark, sf).filter("key in (3, 40)").select("tool_id").collect())
    return P.Policy(selection=(P.MaxTools(5, pinned),)).evaluate(candidates(spark, sf)).select("query_id", "tool_id", "rank", "kept")


def agent_policies(strict: bool = True) -> P.AgentPolicies:
    return P.AgentPolicies({"analyst": P.Policy((P.MaxRisk("low"),)), "operator": P.Policy((P.DenyTags("deny_tags", tags=("red",)),))}, P.Policy((P.MaxRisk("high"),)), strict)


_ROUTE = "case when agent is null then risk_level <= 2 when agent = 'analyst' then risk_level <= 0 when agent = 'operator' then not list_contains(tags, 'red') else false end"


@query("policy_agent_routing", S.q(S.SCORED, S.hits(20), "cand as (select h.*, r.agent from hits h join req r using (query_id))", f"select query_id, tool_id, agent, case when {_ROUTE} then 'allow' else 'deny' end as decision from cand"))
def policy_agent_routing(spark, sf):
    return agent_policies().judged(candidates(spark, sf)).select("query_id", "tool_id", "agent", "decision")


# selection --------------------------------------------------------------------------------------------------------

_SELECT = (
    S.SCORED, S.hits(80, "risk_level <= 2"), _USED, _BOOST.format(w=0.1),
    "wide as (select *, row_number() over (partition by query_id order by score desc, tool_id) as rank from boosted qualify rank <= 20)",
    f"judged as (select w.query_id, w.tool_id, w.score, w.rank, {_ROUTE} as ok, agent, risk_level, tags from wide w join idx using (tool_id) join req using (query_id))",
    "placed as (select *, case when ok then row_number() over (partition by query_id, ok order by rank) end as final_rank from judged)",
)


def engine(spark: SparkSession, sf: str) -> Engine:
    return Engine(indexed(spark, sf), agent_policies(), usage_of(spark, sf))


@query("select_end_to_end", S.q(*_SELECT, "select query_id, tool_id, final_rank::int as rank, round(score, 6) as score from placed where final_rank <= 5"))
def select_end_to_end(spark, sf):
    return engine(spark, sf).select(requests(spark, sf), 5, Filters(max_risk="high")).withColumn("score", F.round("score", 6))


_WHY = "case when ok then 'ranked below the top 5' when agent = 'guest' then 'denied by default policy' when agent = 'operator' then 'deny_tags: carries denied tag(s): red' when agent = 'analyst' then 'max_risk: risk ' || ['low', 'medium', 'high', 'critical'][risk_level + 1] || ' exceeds ceiling low' end"


@query("select_exclusions", S.q(*_SELECT, f"select query_id, tool_id, case when ok then 'truncation' else 'policy' end as stage, {_WHY} as reason from placed where not ok or final_rank > 5"))
def select_exclusions(spark, sf):
    return P.exclusions(engine(spark, sf).evaluated(requests(spark, sf), 5, Filters(max_risk="high")))


@query("proxy_search", S.q(*_SELECT, "select query_id, tool_id, description, round(score, 4) as score, ['low', 'medium', 'high', 'critical'][placed.risk_level + 1] as risk from placed join idx using (tool_id) where final_rank <= 5"))
def proxy_search(spark, sf):
    idx = indexed(spark, sf).select("tool_id", "description", tier(F.col("risk_level"), RISK_TIERS).alias("risk"))
    found = engine(spark, sf).select(requests(spark, sf), 5, Filters(max_risk="high"))
    return found.join(idx, "tool_id").select("query_id", "tool_id", "description", F.round("score", 4).alias("score"), "risk")


@query("proxy_describe", S.q(S.CAT, "ask as (select s_suppkey as ask_id, case when s_suppkey % 2 = 0 then 'small/blue_bolt_' || s_suppkey else 'bolt_1' || s_suppkey end as wanted from supplier)", "ok as (select * from cat where risk_level <= 1)",
                             "hint as (select ask_id, array_to_string(list_slice(list_sort(list(tool_id)), 1, 5), ', ') as hint from ask join ok on contains(tool_id, wanted) or name = wanted group by 1)",
                             "select ask_id, wanted, ok.description as description, case when ok.tool_id is null then coalesce(hint, '') end as hint from ask left join ok on ok.tool_id = wanted left join hint using (ask_id)"))
def proxy_describe(spark, sf):
    k = F.col("s_suppkey")
    wanted = F.when(k % 2 == 0, F.concat(F.lit("small/blue_bolt_"), k)).otherwise(F.concat(F.lit("bolt_1"), k))
    asked = table(spark, sf, "supplier").select(k.alias("ask_id"), wanted.alias("wanted"))
    visible = P.Policy((P.MaxRisk("medium"),)).judged(parts(spark, sf)).filter("decision = 'allow'").select("tool_id", "name", "description")
    found = visible.select(F.col("tool_id").alias("wanted"), "description")
    hint = analyze.hints(visible, asked.join(found, "wanted", "left_anti"))
    out = asked.join(found, "wanted", "left").join(hint, "ask_id", "left")
    return out.select("ask_id", "wanted", "description", F.when(F.col("description").isNull(), F.coalesce("hint", F.lit(""))).alias("hint"))


# maintenance ------------------------------------------------------------------------------------------------------


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    return maintain.with_text(C.catalogue_view(part)), maintain.with_text(C.changed_view(part))


_ACTION = (
    S.CAT, S.NEW, f"o as (select *, {S.index_text()} as text from cat), n as (select *, {S.index_text()} as text from new)",
    "act as (select coalesce(o.tool_id, n.tool_id) as tool_id, o.source_id as source_id, case when o.tool_id is null then 'added' when n.tool_id is null then case when o.source_id in ('src0', 'src1', 'src2') then 'removed' else 'kept' end when o.text <> n.text then 'reembed' when o.risk_level <> n.risk_level then 'rewrite' else 'unchanged' end as action from o full join n on o.tool_id = n.tool_id)",
)


def answered(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("src0",), ("src1",), ("src2",)], "source_id string")


@query("sync_classify", S.q(*_ACTION, "select tool_id, action from act"))
def sync_classify(spark, sf):
    old, new = versions(spark, sf)
    return maintain.classify(old, new, answered(spark))


@query("sync_report", S.q(*_ACTION, "select count(*) filter (action = 'added') as added, count(*) filter (action = 'reembed') as reembedded, count(*) filter (action = 'rewrite') as rewritten, count(*) filter (action = 'unchanged') as unchanged, count(*) filter (action = 'removed') as removed, count(*) filter (action in ('added', 'reembed', 'rewrite', 'unchanged')) as total from act"))
def sync_report(spark, sf):
    return maintain.report(sync_classify(spark, sf))


@query("sync_prune", S.q(*_ACTION, "select tool_id from act where action = 'removed'"))
def sync_prune(spark, sf):
    old, new = versions(spark, sf)
    return maintain.prunable(old, new, answered(spark)).select("tool_id")


def marked(df: DataFrame, mark: str) -> DataFrame:
    """A stand-in for an embedder that shows when a vector was made."""
    return df.withColumn("vector", F.concat(F.lit(mark), F.md5("text")))


_MADE = "case when action in ('added', 'reembed') then 'new:' || md5(n.text) else 'old:' || md5(o.text) end as vector, case when action in ('kept', 'unchanged') then o.risk_level else n.risk_level end as risk_level"


@query("sync_apply", S.q(*_ACTION, f"select act.tool_id as tool_id, {_MADE} from act left join o on o.tool_id = act.tool_id left join n on n.tool_id = act.tool_id where action <> 'removed'"))
def sync_apply(spark, sf):
    old, new = versions(spark, sf)
    return maintain.apply_sync(marked(old, "old:"), new, lambda df: marked(df, "new:"), answered(spark)).select("tool_id", "vector", "risk_level")


_REFRESHED = (*_ACTION[:2], _ACTION[2].replace("from new)", "from new where source_id <> 'src3')"), _ACTION[3])


@query("refresh", S.q(*_REFRESHED, f"select act.tool_id as tool_id, {_MADE} from act left join o on o.tool_id = act.tool_id left join n on n.tool_id = act.tool_id where action <> 'removed'"))
def refresh(spark, sf):
    old, new = versions(spark, sf)

    def down() -> DataFrame:
        raise OSError("no answer")

    readers = {f"src{k}": (lambda k=k: new.filter(F.col("source_id") == f"src{k}")) for k in range(3)} | {"src3": down}
    rows, failures = C.discover(spark, readers)
    heard = spark.createDataFrame([(n,) for n in readers], "source_id string").join(failures, "source_id", "left_anti")
    return maintain.apply_sync(marked(old, "old:"), rows, lambda df: marked(df, "new:"), heard).select("tool_id", "vector", "risk_level")


@query("route_calls", S.q(S.CAT, "ask as (select 'small/blue_bolt_' || s_suppkey as tool_id, s_suppkey as call_id from supplier union all select tool_id, key from cat where key % 3 = 0)", "select call_id, ask.tool_id as tool_id, source_id from ask left join cat using (tool_id)"))
def route_calls(spark, sf):
    cat = parts(spark, sf)
    calls = table(spark, sf, "supplier").select(F.concat(F.lit("small/blue_bolt_"), "s_suppkey").alias("tool_id"), F.col("s_suppkey").alias("call_id"))
    calls = calls.unionByName(cat.filter("key % 3 = 0").select("tool_id", F.col("key").alias("call_id")))
    return analyze.routed(calls, cat).select("call_id", "tool_id", "source_id")


_SCHEMA_OF = "'{\"k\":' || (key % 3) || '}'"
_WITH_SCHEMA = (S.CAT, S.NEW, f"o as (select *, {_SCHEMA_OF} as input_schema from cat), n as (select *, case when key % 13 = 0 then '{{\"k\":9}}' else {_SCHEMA_OF} end as input_schema from new)")


def schema_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old, new = versions(spark, sf)
    plain = F.concat(F.lit('{"k":'), F.col("key") % 3, F.lit("}"))
    return old.withColumn("input_schema", plain), new.withColumn("input_schema", F.when(F.col("key") % 13 == 0, '{"k":9}').otherwise(plain))


_DIGEST = "substr(sha256(length(description) || ':' || description || length(input_schema) || ':' || input_schema), 1, 16)"


def approvals(new: DataFrame) -> DataFrame:
    return new.filter("key % 3 = 0").select("tool_id", maintain.sensitive_digest(F.col("description"), F.col("input_schema")).alias("digest"))


_PRIV = "'risk=' || ['low', 'medium', 'high', 'critical'][{0}.risk_level + 1] || ' scopes=' || case when len({0}.required_scopes) > 0 then array_to_string({0}.required_scopes, ',') else 'none' end || ' tags=' || array_to_string(list_sort({0}.tags), ',')"
_APPROVED = f"ok as (select tool_id, {_DIGEST} as digest from n where key % 3 = 0)"


@query("drift_digest", S.q(*_WITH_SCHEMA, f"select tool_id, {_DIGEST} as digest from n"))
def drift_digest(spark, sf):
    return schema_versions(spark, sf)[1].select("tool_id", maintain.sensitive_digest(F.col("description"), F.col("input_schema")).alias("digest"))


@query("drift_changes", S.q(*_WITH_SCHEMA, _APPROVED, f"j as (select o.tool_id as tool_id, o.description as d0, n.description as d1, o.input_schema as s0, n.input_schema as s1, {_PRIV.format('o')} as p0, {_PRIV.format('n')} as p1, ok.tool_id is null as held from o join n on o.tool_id = n.tool_id left join ok on ok.tool_id = o.tool_id)",
                            "select tool_id, 'description' as kind, d0 as before, d1 as after, held as quarantined from j where d0 <> d1 union all select tool_id, 'schema', s0, s1, held from j where s0 <> s1 union all select tool_id, 'privilege', p0, p1, false from j where p0 <> p1"))
def drift_changes(spark, sf):
    old, new = schema_versions(spark, sf)
    return maintain.DriftGuard().changes(old, new, approvals(new))


@query("drift_hold", S.q(*_WITH_SCHEMA, _APPROVED, f"j as (select n.tool_id as tool_id, o.tool_id is null as fresh, o.description <> n.description or o.input_schema <> n.input_schema or {_PRIV.format('o')} <> {_PRIV.format('n')} as differs, ok.tool_id is not null as approved from n left join o on o.tool_id = n.tool_id left join ok on ok.tool_id = n.tool_id)",
                         "select tool_id, case when fresh then case when approved then 'new' else 'held_new' end when differs then case when approved then 'changed' else 'held' end else 'same' end as state from j"))
def drift_hold(spark, sf):
    old, new = schema_versions(spark, sf)
    return maintain.DriftGuard(trust_on_first_use=False).decide(old, new, approvals(new))


@query("drift_accept", S.q(*_WITH_SCHEMA, _APPROVED, f"j as (select n.tool_id as tool_id, n.description as d1, o.description as d0, o.tool_id is null as fresh, o.description <> n.description or o.input_schema <> n.input_schema or {_PRIV.format('o')} <> {_PRIV.format('n')} as differs, ok.tool_id is not null as approved from n left join o on o.tool_id = n.tool_id left join ok on ok.tool_id = n.tool_id)",
                           "select tool_id, case when differs and not approved then d0 else d1 end as description from j where not fresh or approved"))
def drift_accept(spark, sf):
    old, new = schema_versions(spark, sf)
    served, _ = maintain.DriftGuard(trust_on_first_use=False).accepted(old, new, approvals(new))
    return served.select("tool_id", "description")


_TWICE = "w as (select namespace || '/' || tags[2] as tool_id, description, key from cat)"


@query("index_duplicates", S.q(S.CAT, _TWICE, "select tool_id, count(*) - 1 as skipped from w group by 1 having count(*) > 1"))
def index_duplicates(spark, sf):
    return maintain.duplicate_ids(parts(spark, sf).select(F.concat("namespace", F.lit("/"), F.element_at("tags", 2)).alias("tool_id")))


@query("dedup_last_wins", S.q(S.CAT, _TWICE, "select tool_id, arg_max(description, key) as description, min(key) as first_seq from w group by 1"))
def dedup_last_wins(spark, sf):
    rows = parts(spark, sf).select(F.concat("namespace", F.lit("/"), F.element_at("tags", 2)).alias("tool_id"), "description", "key")
    return maintain.dedup_last_wins(rows, "key")


@query("index_build", S.q(S.CAT, f"t as (select tool_id, {S.index_text()} as text from cat where risk_level < 3)", "select tool_id, length(text)::int as n_chars, md5(text) as digest from t"))
def index_build(spark, sf):
    hooks = Hooks()
    hooks.on("transform_tool", lambda df: df.filter("risk_level < 3"))
    built = maintain.with_text(hooks.transform("transform_tool", parts(spark, sf)))
    return built.select("tool_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("hook_transform", S.q(S.CAT, "select tool_id, upper(description) as description from cat where risk_level < 3"))
def hook_transform(spark, sf):
    hooks = Hooks()
    hooks.on("transform_tool", lambda df: df.filter("risk_level < 3"))
    hooks.on("transform_tool", lambda df: df.no_such_method())
    hooks.on("transform_tool", lambda df: df.withColumn("description", F.upper("description")))
    return hooks.transform("transform_tool", parts(spark, sf).select("tool_id", "description", "risk_level")).select("tool_id", "description")


@query("render_collisions", S.q(S.CAT, "f as (select regexp_replace(namespace || '__' || tags[1], '[^a-zA-Z0-9_-]', '_', 'g') as flat from cat)", "select flat, count(*) as n from f group by 1 having count(*) > 1"))
def render_collisions(spark, sf):
    return render.collisions(parts(spark, sf).withColumn("name", F.element_at("tags", 1)))


_FLAT = "regexp_replace(namespace || '__' || name, '[^a-zA-Z0-9_-]', '_', 'g')"
_SHAPE = """case when key % 3 = 0 then '{"type":"object","properties":{}}' else '{"type":"object","properties":{"size":{"type":"integer","description":"of part ' || key || '"}},"required":["size"]}' end"""


def shaped(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue with a schema for two items of three."""
    full = F.concat(F.lit('{"type":"object","properties":{"size":{"type":"integer","description":"of part '), F.col("key"), F.lit('"}},"required":["size"]}'))
    return parts(spark, sf).withColumn("description", F.concat(F.col("description"), F.lit(' "so-called"'))).withColumn("input_schema", F.when(F.col("key") % 3 == 0, "{}").otherwise(full))


_SAID = """to_json(description || ' "so-called"')::varchar"""


@query("render_openai", S.q(S.CAT, f"""select tool_id, '{{"type":"function","function":{{"name":' || to_json({_FLAT})::varchar || ',"description":' || {_SAID} || ',"parameters":' || {_SHAPE} || '}}}}' as rendered from cat"""))
def render_openai(spark, sf):
    return render.openai(shaped(spark, sf))


@query("render_anthropic", S.q(S.CAT, f"""select tool_id, '{{"name":' || to_json({_FLAT})::varchar || ',"description":' || {_SAID} || ',"input_schema":' || {_SHAPE} || '}}' as rendered from cat"""))
def render_anthropic(spark, sf):
    return render.anthropic(shaped(spark, sf))


@query("describe_schema", S.q(S.CAT, "select tool_id, case when key % 3 <> 0 then 'parameters: size: of part ' || key || ' [required]' end as parameters from cat"))
def describe_schema(spark, sf):
    return shaped(spark, sf).select("tool_id", text.describe_schema(F.col("input_schema")).alias("parameters"))


# statistics and evaluation ----------------------------------------------------------------------------------------


@query("catalogue_stats", S.q(S.CAT, "select 'namespace' as kind, namespace as value, count(*) as n from cat group by 2 union all select 'risk', ['low', 'medium', 'high', 'critical'][risk_level + 1], count(*) from cat group by 2"))
def catalogue_stats(spark, sf):
    each = F.array(F.struct(F.lit("namespace").alias("kind"), F.col("namespace").alias("value")), F.struct(F.lit("risk").alias("kind"), tier(F.col("risk_level"), RISK_TIERS).alias("value")))
    return parts(spark, sf).select(F.explode(each).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def judged_cases(spark: SparkSession, sf: str, k: int = 10, floor: float = 0.25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits above a floor, expected, cases): an item is relevant to a request if both have one label; label 9 expects nothing."""
    labels = indexed(spark, sf).select("key", "tool_id", "label")
    cases = labels.filter("key % 20 = 0").select(F.col("key").alias("query_id"), F.concat(F.lit("c"), F.col("label")).alias("category"), F.col("label"))
    expected = cases.filter("label <> 9").join(labels.select("tool_id", "label"), "label").select("query_id", "tool_id")
    return hits(spark, sf, k).filter(F.col("score") >= floor), expected, cases.drop("label")


_CASES = (
    S.SCORED, S.hits(10), "h as (select * from hits where score >= 0.25::double)", "cases as (select query_id, 'c' || label as category, label from req)",
    "good as (select query_id, tool_id from req join idx on req.label = idx.label where req.label <> 9)",
    "per as (select query_id, count(*) as selected, count(good.tool_id) as good, min(case when good.tool_id is not null then rank end) as first from h left join good using (query_id, tool_id) group by 1)",
    "want as (select query_id, count(*) as expected from good group by 1)",
    "base as (select c.query_id, category, coalesce(selected, 0) as selected, coalesce(good, 0) as good, coalesce(expected, 0) as expected, first from cases c left join per using (query_id) left join want using (query_id))",
    "res as (select query_id, category, selected, expected, case when expected = 0 then (selected = 0)::int::double else good / expected::double end as recall, case when selected = 0 then (expected = 0)::int::double else good / selected::double end as precision, case when expected = 0 then selected = 0 else good > 0 end as hit, case when expected = 0 then (selected = 0)::int::double else coalesce(1.0::double / first, 0) end as reciprocal_rank from base)",
)


def results(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.case_results(*judged_cases(spark, sf))


@query("eval_recall_at_k", S.q(*_CASES, "select query_id, round(recall, 6) as recall from res"))
def eval_recall_at_k(spark, sf):
    return results(spark, sf).select("query_id", r6("recall"))


@query("eval_precision_at_k", S.q(*_CASES, "select query_id, round(precision, 6) as precision from res"))
def eval_precision_at_k(spark, sf):
    return results(spark, sf).select("query_id", r6("precision"))


@query("eval_mrr", S.q(*_CASES, "select query_id, hit, round(reciprocal_rank, 6) as reciprocal_rank from res"))
def eval_mrr(spark, sf):
    return results(spark, sf).select("query_id", "hit", r6("reciprocal_rank"))


@query("eval_failures", S.q(*_CASES, "select query_id, category, selected from res where not hit"))
def eval_failures(spark, sf):
    return results(spark, sf).filter("not hit").select("query_id", "category", "selected")


_MEANS = "count(*) as cases, count(*) filter (hit) as hits, round(avg(recall), 6) as mean_recall, round(avg(precision), 6) as mean_precision, round(avg(reciprocal_rank), 6) as mean_reciprocal_rank, round(avg(hit::int), 6) as hit_rate, round(1 - avg(selected) / (select count(*) from idx), 6) as context_reduction"
_MEAN_COLUMNS = ("mean_recall", "mean_precision", "mean_reciprocal_rank", "hit_rate", "context_reduction")


@query("eval_summary", S.q(*_CASES, f"select {_MEANS} from res"))
def eval_summary(spark, sf):
    return evaluate.summary(results(spark, sf), indexed(spark, sf).count()).select("cases", "hits", *map(r6, _MEAN_COLUMNS))


@query("eval_by_category", S.q(*_CASES, f"select category, {_MEANS} from res group by 1"))
def eval_by_category(spark, sf):
    return evaluate.summary(results(spark, sf), indexed(spark, sf).count(), ["category"]).select("category", "cases", "hits", *map(r6, _MEAN_COLUMNS))


_W = "(3.8416::double)"


@query("eval_wilson", S.q(*_CASES, "c as (select category, count(*)::double as n, count(*) filter (hit)::double as s from res group by 1)", "p as (select *, s / n as p from c)",
                          f"select category, round(greatest(0, ((p + {_W} / (2 * n)) - 1.96::double * sqrt((p * (1 - p) + {_W} / (4 * n)) / n)) / (1 + {_W} / n)), 6) as low, round(least(1, ((p + {_W} / (2 * n)) + 1.96::double * sqrt((p * (1 - p) + {_W} / (4 * n)) / n)) / (1 + {_W} / n)), 6) as high from p"))
def eval_wilson(spark, sf):
    counts = results(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.count_if("hit").alias("s"))
    low, high = evaluate.wilson(F.col("s"), F.col("n"))
    return counts.select("category", r6(low, "low"), r6(high, "high"))


def _nearest_sql(source: str, value: str) -> str:
    return f"ord as (select {value} as v, row_number() over (order by {value}) - 1 as pos from {source} where {value} is not null), pct as (select p, (select list(v order by pos) from ord)[round_even(p / 100.0::double * ((select count(*) from ord) - 1), 0)::bigint + 1] as value from (select unnest([50, 75, 90, 95, 100]) as p))"


@query("nearest_rank_percentile", S.q(_nearest_sql("events", "value"), "select p::int as percentile, value from pct"))
def nearest_rank_percentile(spark, sf):
    return evaluate.nearest_rank(table(spark, sf, "events"), "value")


@query("calibrate_floor", S.q(S.SCORED, S.hits(5), "ex as (select query_id, max(score) filter (rank > 1) as top, min(score) as tail from hits group by 1)", "noise as (select top from ex where query_id % 40 = 0)", _nearest_sql("noise", "top"), "smp as (select * from ex where query_id % 40 <> 0)",
                              "select p::int as percentile, round(value, 6) as floor, round((select avg((top < value)::int) from noise), 6) as noise_rejected, round((select avg((top < value)::int) from smp), 6) as samples_emptied, round((select avg((tail < value)::int) from smp), 6) as samples_thinned from pct"))
def calibrate_floor(spark, sf):
    h = hits(spark, sf, 5)
    ex = h.groupBy("query_id").agg(F.max(F.when(F.col("rank") > 1, F.col("score"))).alias("top"), F.min("score").alias("tail"))
    out = evaluate.calibrate(ex.filter("query_id % 40 = 0"), ex.filter("query_id % 40 <> 0"))
    return out.select("percentile", *map(r6, ("floor", "noise_rejected", "samples_emptied", "samples_thinned")))


@query("recall_ceiling", S.q(S.SCORED, S.hits(200), "good as (select query_id, tool_id from req join idx on req.label = idx.label where tool_id not in (select tool_id from idx where key % 20 = 0))", "f as (select query_id, min(rank) as first from hits join good using (query_id, tool_id) group by 1)",
                             "d as (select unnest([5, 10, 20, 50, 100, 200])::int as depth)", "select depth, count(*) filter (coalesce(first <= depth, false)) as reached, round(avg(coalesce(first <= depth, false)::int), 6) as share from req left join f using (query_id), d group by 1"))
def recall_ceiling(spark, sf):
    labels = indexed(spark, sf).select("key", "tool_id", "label")
    cases = labels.filter("key % 20 = 0").select(F.col("key").alias("query_id"), "label")
    expected = cases.join(labels.filter("key % 20 <> 0").select("tool_id", "label"), "label").select("query_id", "tool_id")
    return evaluate.recall_ceiling(hits(spark, sf, 200), expected, cases).select("depth", "reached", r6("share"))


@query("recall_unreachable", S.q(S.SCORED, S.hits(40), "good as (select query_id, tool_id, 'c' || req.label as category from req join idx on req.label = idx.label where tool_id not in (select tool_id from idx where key % 20 = 0))", "f as (select query_id, min(rank) as first from hits join good using (query_id, tool_id) group by 1)",
                                 "select category, count(*) as cases, count(*) filter (first is null) as unreachable from (select distinct query_id, category from good) left join f using (query_id) group by 1"))
def recall_unreachable(spark, sf):
    labels = indexed(spark, sf).select("key", "tool_id", "label")
    cases = labels.filter("key % 20 = 0").select(F.col("key").alias("query_id"), "label", F.concat(F.lit("c"), F.col("label")).alias("category"))
    expected = cases.join(labels.filter("key % 20 <> 0").select("tool_id", "label"), "label").select("query_id", "tool_id")
    return evaluate.unreachable(hits(spark, sf, 40), expected, cases, 40)


_FLOORS = (0.0, 0.2, 0.3, 0.4)


@query("threshold_sweep", S.q(S.SCORED, S.hits(10), "good as (select query_id, tool_id, 1 as g from req join idx on req.label = idx.label where req.label <> 9)", f"fl as (select unnest({list(_FLOORS)}::double[]) as floor)",
                              "per as (select query_id, floor, count(*) as n, count(g) as good from hits left join good using (query_id, tool_id) join fl on score >= floor group by all)",
                              "e as (select query_id, label <> 9 as wants, floor, coalesce(n, 0) as n, coalesce(good, 0) as good from (select query_id, label, floor from req, fl) left join per using (query_id, floor))",
                              "select floor, round(avg((case when wants then good > 0 else n = 0 end)::int), 6) as hit_rate, round(avg(case when n = 0 then (not wants)::int::double else good / n::double end), 6) as mean_precision from e group by 1"))
def threshold_sweep(spark, sf):
    _, expected, cases = judged_cases(spark, sf)
    return evaluate.threshold_sweep(hits(spark, sf, 10), expected, cases, _FLOORS).select("floor", r6("hit_rate"), r6("mean_precision"))


@query("threshold_sweep_split", SQL["threshold_sweep"].split("select floor, round(avg(")[0] + "select floor, round(avg(case when wants then (good > 0)::int end), 6) as positive_hit_rate, round(avg(case when not wants then (n = 0)::int end), 6) as negative_hit_rate from e group by 1")
def threshold_sweep_split(spark, sf):
    _, expected, cases = judged_cases(spark, sf)
    return evaluate.threshold_sweep(hits(spark, sf, 10), expected, cases, _FLOORS).select("floor", r6("positive_hit_rate"), r6("negative_hit_rate"))


@query("e2e_outcomes", S.q(S.SCORED, S.hits(5), "good as (select query_id, tool_id from req join idx on req.label = idx.label where req.label <> 9)",
                           f"w as (select query_id, h.tool_id as tool_id, rank, list_distinct({S.TOKENS.format('h.description')}) as t, list_distinct({S.TOKENS.format('(r.tags[2] || $ $ || r.namespace)')}) as s from hits h join idx r on r.key = query_id)".replace("$", "'"),
                           "c as (select query_id, tool_id as chosen from (select *, round(len(list_intersect(t, s)) / sqrt(len(t)::double), 9) as score from w) where score > 0 qualify row_number() over (partition by query_id order by score desc, rank) = 1)",
                           "off as (select distinct query_id from hits join good using (query_id, tool_id))",
                           "o as (select r.query_id, case when label = 9 then case when chosen is null then 'correct' else 'wrong' end when (r.query_id, chosen) in (select (query_id, tool_id) from good) then 'correct' when r.query_id not in (select query_id from off) then 'retrieval_miss' when chosen is null then 'abstained' else 'wrong' end as outcome from req r left join c using (query_id))",
                           "select outcome, count(*) as n from o group by 1"))
def e2e_outcomes(spark, sf):
    _, expected, cases = judged_cases(spark, sf)
    h, idx = hits(spark, sf, 5), indexed(spark, sf)
    asked = idx.select(F.col("key").alias("query_id"), F.concat(F.element_at("tags", 2), F.lit(" "), "namespace").alias("query"))
    offered = h.join(idx.select("tool_id", F.col("description").alias("text")), "tool_id").join(asked, "query_id").withColumnRenamed("rank", "position")
    return evaluate.outcomes(cases, rerank.lexical_choice(offered), h, expected).groupBy("outcome").agg(F.count("*").alias("n"))


# feedback ---------------------------------------------------------------------------------------------------------

_AS_OF = 1706745600.0  # 2024-02-01


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(k.alias("tool_id"), "ts", F.col("value").alias("count"))


@query("usage_decay", f"select (props->>'$.k')::bigint as tool_id, round(sum(value * pow(0.5::double, ({_AS_OF}::double - epoch_us(ts) / 1e6::double) / 2592000)), 6) as count from events where value > 0 group by 1 having sum(value * pow(0.5::double, ({_AS_OF}::double - epoch_us(ts) / 1e6::double) / 2592000)) >= 1e-6::double")
def usage_decay(spark, sf):
    return feedback.usage_counts(usage_events(spark, sf), F.lit(_AS_OF)).select("tool_id", r6("count"))


@query("alias_topk", f"with s as (select (props->>'$.k')::bigint as tool_id, lower(event_type) as phrase, round(sum(pow(0.5::double, ({_AS_OF}::double - epoch_us(ts) / 1e6::double) / 7776000)), 9) as weight from events group by 1, 2) select tool_id, phrase, round(weight, 6) as weight, row_number() over (partition by tool_id order by weight desc, phrase)::int as rank from s where weight >= 3 - 1e-6::double qualify rank <= 5")
def alias_topk(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, sf, "events").select(k.alias("tool_id"), F.col("event_type").alias("phrase"), "ts", F.lit(1.0).alias("weight"))
    return feedback.learnt_aliases(events, F.lit(_AS_OF)).select("tool_id", "phrase", r6("weight"), "rank")


@query("alias_snapshot", f"select (props->>'$.k')::bigint as tool_id, lower(event_type) as phrase, round(sum(pow(0.5::double, ({_AS_OF}::double - epoch_us(ts) / 1e6::double) / 7776000)), 6) as weight from events where (props->>'$.k')::bigint % 5 <> 0 group by 1, 2")
def alias_snapshot(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, sf, "events").select(k.alias("tool_id"), F.col("event_type").alias("phrase"), "ts", F.lit(1.0).alias("weight"))
    events = feedback.forget(events, events.filter("tool_id % 5 = 0"))
    return feedback.alias_weights(events, F.lit(_AS_OF)).select("tool_id", "phrase", r6("weight"))


@query("savings_report", "with s as (select o_orderkey % 7 as tools_sent, 200 as catalogue, 40 * (o_orderkey % 7) as est_sent, 8000 as est_full, case when o_orderkey % 3 = 0 then 50 * (o_orderkey % 7) + 1 end as actual from orders) select count(*) as selections, sum(tools_sent)::bigint as tools_sent, sum(catalogue)::bigint as tools_in_catalogue, sum(coalesce(actual, est_sent))::bigint as tokens_sent, sum(case when actual is not null and est_sent > 0 then floor(est_full * (actual / est_sent::double)) else est_full end)::bigint as tokens_if_full, bool_and(actual is not null) as measured, round(1 - sum(coalesce(actual, est_sent))::double / sum(case when actual is not null and est_sent > 0 then floor(est_full * (actual / est_sent::double)) else est_full end)::double, 6) as saved_share from s")
def savings_report(spark, sf):
    k = F.col("o_orderkey") % 7
    rows = table(spark, sf, "orders").select(k.alias("tools_sent"), F.lit(200).alias("catalogue"), (k * 40).alias("est_sent"), F.lit(8000).alias("est_full"), F.when(F.col("o_orderkey") % 3 == 0, k * 50 + 1).alias("actual"))
    return analyze.savings(rows).withColumn("saved_share", F.round("saved_share", 6))


# reachability and diagnosis ---------------------------------------------------------------------------------------


def agents(spark: SparkSession) -> DataFrame:
    rows = [("analyst", ["write"], "t1"), ("operator", [], "t1"), ("guest", [], "t2")]
    return spark.createDataFrame(rows, "agent string, scopes array<string>, tenant string")


_AGENTS = "ag as (select * from (values ('analyst'), ('operator'), ('guest')) t(agent))"
_REACH = f"reach as (select agent, tool_id, risk_level, {_ROUTE} as reachable from cat, ag)"


@query("policy_reach", S.q(S.CAT, _AGENTS, _REACH, "select agent, tool_id, reachable from reach"))
def policy_reach(spark, sf):
    return analyze.reach(agent_policies(), parts(spark, sf), agents(spark)).select("agent", "tool_id", "reachable")


@query("policy_reach_by_risk", S.q(S.CAT, _AGENTS, _REACH, "select agent, risk_level, count(*) as n from reach where reachable group by 1, 2"))
def policy_reach_by_risk(spark, sf):
    return analyze.reach(agent_policies(), parts(spark, sf), agents(spark)).filter("reachable").groupBy("agent", "risk_level").agg(F.count("*").alias("n"))


@query("policy_diff", S.q(S.CAT, _AGENTS, _REACH, "later as (select agent, tool_id, case when agent = 'analyst' then risk_level <= 1 and namespace <> 'promo' else risk_level <= 2 end as reachable from cat, ag)", "select agent, tool_id, case when later.reachable then 'gained' else 'lost' end as change from reach join later using (agent, tool_id) where reach.reachable <> later.reachable"))
def policy_diff(spark, sf):
    after = P.AgentPolicies({"analyst": P.Policy((P.MaxRisk("medium"), P.DenyTools("deny", patterns=("promo/*",))))}, P.Policy((P.MaxRisk("high"),)))
    cat, who = parts(spark, sf), agents(spark)
    return analyze.policy_diff(analyze.reach(agent_policies(), cat, who), analyze.reach(after, cat, who))


_NEAR = (
    S.CAT, S.EMB, "idx as (select tool_id, description, v from cat join emb on key = vec_id)",
    "near as (select a.tool_id as id, b.tool_id as other, round(list_cosine_similarity(a.v, b.v), 9) as score from idx a, idx b qualify row_number() over (partition by a.tool_id order by round(list_cosine_similarity(a.v, b.v), 9) desc, b.tool_id) <= 2)",
    "own as (select id, score as own from near where id = other)", "oth as (select id, arg_max(other, score) as nearest, max(score) as score from near where id <> other group by 1)",
    "gaps as (select id, nearest, case when coalesce(own, 0) <> 0 then greatest(0, (own - score) / abs(own)) end as gap from oth left join own using (id))",
)


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.neighbour_gaps(vectors.nearest(indexed(spark, sf)))


@query("diagnose_nearest", S.q(*_NEAR, "select id, nearest, round(gap, 6) as gap from gaps"))
def diagnose_nearest(spark, sf):
    return gaps(spark, sf).select("id", "nearest", r6("gap"))


@query("diagnose_pairs", S.q(*_NEAR, "select least(id, nearest) as left_id, greatest(id, nearest) as right_id, round(min(gap), 6) as gap from gaps where gap is not null group by 1, 2"))
def diagnose_pairs(spark, sf):
    return analyze.closest_pairs(gaps(spark, sf)).select("left_id", "right_id", r6("gap"))


def self_probe(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Keyword retrieval once a distinct description: description, tool_id, rank."""
    idx = maintain.with_text(indexed(spark, sf))
    asked = idx.select(F.trim("description").alias("query_id")).filter("query_id <> ''").distinct().withColumn("text", F.col("query_id"))
    return retrieve.KeywordIndex.build(idx, "tool_id").search(asked, k).withColumnRenamed("query_id", "description")


_PROBE = (
    S.SCORED, f"corpus as (select tool_id as id, {S.index_text()} as text from idx), question as (select distinct trim(description) as query_id, trim(description) as text from idx)", S.BM25,
    "found as (select query_id as description, id as tool_id, row_number() over (partition by query_id order by score desc, id)::int as rank from bm where score > 0 qualify rank <= 5)",
)


@query("diagnose_findings", S.q(*_PROBE, "select idx.tool_id as tool_id, rank as self_rank, array_to_string(list_filter([case when rank is null then 'shadowed' end, case when length(trim(idx.description)) < 16 then 'thin' end], lambda x: x is not null), ',') as issues from idx left join found on found.description = trim(idx.description) and found.tool_id = idx.tool_id"))
def diagnose_findings(spark, sf):
    empty = spark.createDataFrame([], "id string, gap double")
    return analyze.findings(indexed(spark, sf), self_probe(spark, sf), empty).select("tool_id", "self_rank", F.array_join("issues", ",").alias("issues"))


@query("diagnose_twinned", S.q(*_NEAR, "select id as tool_id, round(gap, 6) as nearest_gap from gaps where gap <= 0.5::double"))
def diagnose_twinned(spark, sf):
    none = spark.createDataFrame([], "description string, tool_id string, rank int")
    found = analyze.findings(indexed(spark, sf), none, gaps(spark, sf), margin=0.5)
    return found.filter(F.array_contains("issues", analyze.TWINNED)).select("tool_id", r6("nearest_gap"))


@query("diagnose_unreached", S.q(*_PROBE, "select tool_id from idx where tool_id not in (select tool_id from found)"))
def diagnose_unreached(spark, sf):
    return indexed(spark, sf).select("tool_id").join(self_probe(spark, sf).select("tool_id").distinct(), "tool_id", "left_anti")


# embedding and model surfaces --------------------------------------------------------------------------------------


@query("hash_embed", S.q(S.CAT, "select tool_id, 512::int as dim, 1.0::double as length from cat"))
def hash_embed(spark, sf):
    out = embed.hashing_blake2b(maintain.with_text(parts(spark, sf)).select("tool_id", "text"), "text")
    return out.select("tool_id", F.size("vector").alias("dim"), r6(vectors.norm(F.col("vector")), "length"))


def _hashed_sql(source: str, id_: str, text_: str, p: str = "") -> tuple[str, ...]:
    """CTEs that end in {p}u (id, bucket, weight): the native hashed vectors of a source's texts."""
    return (
        f"{p}t as (select {id_} as id, {S.TOKENS.format('(' + text_ + ')')} as t from {source})", f"{p}l as (select *, array_to_string(t, ' ') as line from {p}t)",
        f"{p}f as (select id, unnest(list_concat(list_concat(t, list_transform(range(1, len(t)), lambda k: t[k] || '_' || t[k + 1])), list_transform(range(1, length(line) - 2), lambda k: '#' || substr(line, k, 4)))) as f from {p}l)",
        f"{p}c as (select id, ('0x' || substr(md5(f), 1, 15))::bigint as code, count(*) as n from {p}f group by id, f)",
        f"{p}w as (select id, (code % 512)::int as bucket, sum(case when (code >> 59) % 2 = 1 then 1 else -1 end * (1 + ln(n))) as w from {p}c group by 1, 2)",
        f"{p}u as (select id, bucket, w / sqrt(sum(w * w) over (partition by id)) as weight from {p}w)",
    )


@query("hash_embed_native", S.q(S.CAT, *_hashed_sql("cat", "tool_id", S.index_text()), "select id, bucket, round(weight, 6) as weight from u where abs(weight) > 1e-12::double"))
def hash_embed_native(spark, sf):
    out = embed.hashing_native(maintain.with_text(spread(parts(spark, sf))).select("tool_id", "text"), "tool_id", "text")
    return out.select("id", "bucket", r6("weight"))


@query("semantic_retrieve", S.q(S.CAT, *_hashed_sql("cat", "tool_id", S.index_text()), *_hashed_sql("supplier", "s_suppkey", "'red bolt of type economy ' || s_suppkey", "q"),
                               "pair as (select qu.id as query_id, u.id as tool_id, sum(qu.weight * u.weight) as score from qu join u using (bucket) group by 1, 2)",
                               "every as (select s_suppkey as query_id, tool_id, round(coalesce(score, 0), 9) + 0.0::double as score from supplier cross join cat left join pair on pair.query_id = s_suppkey and pair.tool_id = cat.tool_id)".replace("select s_suppkey as query_id, tool_id,", "select s_suppkey as query_id, cat.tool_id as tool_id,"),
                               "hits as (select *, row_number() over (partition by query_id order by score desc, tool_id)::int as rank from every qualify rank <= 5)", _TOP))
def semantic_retrieve(spark, sf):
    part = table(spark, sf, "part")
    cores = spark.sparkContext.defaultParallelism
    dealt = part.repartition(max(cores, part._jdf.rdd().getNumPartitions()), "p_partkey")  # a file's splits may all lie in one row group
    index = maintain.with_text(C.catalogue_view(dealt)).select("tool_id", "text")
    asked = spread(table(spark, sf, "supplier")).select("s_suppkey", F.concat(F.lit("red bolt of type economy "), F.col("s_suppkey")).alias("text"))
    vectors_ = embed.hashed_rows(asked, "s_suppkey", "text").withColumnRenamed("id", "query_id")
    return vectors.search(index, vectors_, 5, vector_col="text", dim=embed.DIM, read=embed.Hasher).select("query_id", "tool_id", "rank", r6("score"))


def overlap(query: str, texts: list[str]) -> list[float]:
    """A deterministic stand-in for a model: shared words over all words."""
    want = set(embed.words_of(query))
    return [len(want & set(embed.words_of(t))) / max(len(want), 1) for t in texts]


@query("model_rerank", S.q(S.SCORED, S.hits(20), f"w as (select h.query_id as query_id, h.tool_id as tool_id, h.score as score, list_distinct({S.TOKENS.format('r.description')}) as want, list_distinct({S.TOKENS.format('(' + S.index_text('h.') + ')')}) as have from hits h join idx r on r.key = h.query_id)",
                           "m as (select query_id, tool_id, round(0.7::double * (len(list_intersect(want, have)) / greatest(len(want), 1)::double) + (1 - 0.7::double) * score, 9) as score from w)",
                           "select query_id, tool_id, row_number() over (partition by query_id order by score desc, tool_id)::int as rank, round(score, 6) as score from m"))
def model_rerank(spark, sf):
    idx = maintain.with_text(indexed(spark, sf))
    asked = idx.select(F.col("key").alias("query_id"), F.col("description").alias("text"))
    return rerank.model_rerank(hits(spark, sf), asked, idx.select("tool_id", "text"), overlap, 20, 0.7).select("query_id", "tool_id", "rank", r6("score"))


_NAME = S.index_text().split("concat_ws(chr(10), ")[1].split(" end,")[0] + " end"
_VARIANTS = {
    "default": (text.TextConfig(), S.index_text()),
    "no_name": (text.TextConfig(include_name=False), S.index_text().replace(_NAME + ",", "")),
    "name_x3": (text.TextConfig(name_weight=3), S.index_text().replace(_NAME + ",", f"{_NAME}, {_NAME}, {_NAME},")),
    "no_tags": (text.TextConfig(include_tags=False), S.index_text().replace(", 'tags: ' || array_to_string(list_sort(tags), ', ')", "")),
}


def _ablated(name: str, text_sql: str) -> str:
    corpus = f"corpus as (select tool_id as id, {text_sql} as text from cat), question as (select key as query_id, split_part(name, '_', 2) || ' ' || namespace || ' ' || tags[1] as text from cat where key % 20 = 0)"
    found = "hit as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from bm where score > 0 qualify rank <= 5)"
    last = f"select '{name}' as variant, round(avg((i.namespace = q.namespace)::int), 6) as precision from hit join cat i on i.tool_id = hit.id join cat q on q.key = hit.query_id"
    return "select * from (" + S.q(S.CAT, corpus, S.BM25, found, last) + ")"


@query("enrichment_ablation", " union all ".join(_ablated(n, t) for n, (_, t) in _VARIANTS.items()))
def enrichment_ablation(spark, sf):
    """Precision of keyword retrieval, by what goes into the index text, for a question about every twentieth item."""
    cat = spread(parts(spark, sf))
    asked = cat.filter("key % 20 = 0").select(F.col("key").alias("query_id"), F.col("namespace").alias("want"), F.concat_ws(" ", F.split_part("name", F.lit("_"), F.lit(2)), "namespace", F.element_at("tags", 1)).alias("text"))
    out = None
    for name, (config, _) in _VARIANTS.items():
        index = retrieve.KeywordIndex.build(maintain.with_text(cat, config), "tool_id", only=retrieve.KeywordIndex.terms_of(asked))
        found = index.search(asked, 5).join(cat.select("tool_id", "namespace"), "tool_id").join(asked.select("query_id", "want"), "query_id")
        one = found.agg(r6(F.avg((F.col("namespace") == F.col("want")).cast("int")), "precision")).select(F.lit(name).alias("variant"), "precision")
        out = one if out is None else out.unionByName(one)
    return out


_TURNS = [(turns, weight) for turns in (0, 1, 2) for weight in (1, 2)]


@query("multiturn_sweep", S.q(r"t as (select *, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) as said from conversations), n as (select * from t where said <> '')",
                             "l as (select conv_id, max(turn) as last from n group by 1)",
                             "h as (select n.*, row_number() over (partition by conv_id order by turn desc) as place from n join l using (conv_id) where turn < last and role = 'user' and length(text) <= 400)",
                             "v as (select * from (values " + ", ".join(f"({t}, {w})" for t, w in _TURNS) + ") x(turns, weight))",
                             "x as (select turns, weight, conv_id, turn, said from h, v where place <= turns union all select turns, weight, n.conv_id, turn, case weight when 2 then said || chr(10) || said else said end from v, n join l on n.conv_id = l.conv_id and turn = last)",
                             "question as (select conv_id * 100 + turns * 10 + weight as query_id, string_agg(said, chr(10) order by turn) as text from x group by turns, weight, conv_id)",
                             "corpus as (select conv_id as id, arg_min(text, turn) as text from conversations group by 1)", S.BM25,
                             "hit as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from bm where score > 0 qualify rank <= 5)",
                             "good as (select query_id from hit where id = query_id // 100)",
                             "select (q.query_id // 10 % 10)::int as turns, (q.query_id % 10)::int as weight, count(*) as queries, round(avg((g.query_id is not null)::int), 6) as recall from question q left join good g using (query_id) group by 1, 2"))
def multiturn_sweep(spark, sf):
    """Whether a folded conversation finds its own opening among those of all conversations, by turns and weight."""
    turns = table(spark, sf, "conversations")
    corpus = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    asked = None
    for n, weight in _TURNS:
        one = feedback.contextual_queries(turns, n, weight).select((F.col("conv_id") * 100 + n * 10 + weight).alias("query_id"), F.col("query").alias("text"))
        asked = one if asked is None else asked.unionByName(one)
    asked = asked.persist()  # folded once, read several times
    found = retrieve.KeywordIndex.build(corpus, "conv_id", only=retrieve.KeywordIndex.terms_of(asked)).search(asked, 5, "conv_id")
    good = found.filter(F.col("conv_id") == F.floor(F.col("query_id") / 100)).select("query_id", F.lit(1).alias("good"))
    per = asked.select("query_id").join(good, "query_id", "left")
    turn = (F.floor(F.col("query_id") / 10) % 10).cast("int")
    return per.groupBy(turn.alias("turns"), (F.col("query_id") % 10).cast("int").alias("weight")).agg(F.count("*").alias("queries"), r6(F.avg(F.coalesce("good", F.lit(0))), "recall"))


# extensions: event time -------------------------------------------------------------------------------------------


@query("usage_tumbling", "select time_bucket(interval '1 day', ts)::timestamp as start, event_type, count(*) as n from events group by 1, 2")
def usage_tumbling(spark, sf):
    return table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("usage_sliding", "with s as (select date_trunc('day', ts) - k * interval '1 day' as start, ts from events, (select unnest([0, 1]) as k)) select start::timestamp as start, count(*) as n from s group by 1")
def usage_sliding(spark, sf):
    return table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "2 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("usage_session", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '1 hour' then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def usage_session(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
