"""Shared DuckDB fragments of the queries' SQL."""

from __future__ import annotations


def cat(table: str = "part") -> str:
    """The catalogue that a parts table stands for."""
    return f"""
select p_partkey as key, replace(p_name, ' ', '_') || '_' || p_partkey as name, lower(p_type) as namespace,
       lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey as tool_id,
       p_name || ' of type ' || p_type as description, [lower(p_brand), split_part(p_name, ' ', 1)] as tags,
       (p_size % 4)::int as risk_level, (p_partkey % 4)::int as cost_level,
       case when p_size > 40 then ['write'] else []::varchar[] end as required_scopes,
       case when p_partkey % 5 = 0 then null else 't' || (p_partkey % 3) end as owner, 'src' || (p_partkey % 4) as source_id
from {table}"""


CAT = f"cat as ({cat()})"

NEW = f"""new as (
  select * replace (case when key % 7 = 0 then description || ' (revised)' else description end as description,
                    case when key % 11 = 0 then 3 else risk_level end::int as risk_level)
  from cat where key % 10 <> 0
  union all ({cat("(select * replace (p_partkey + 10000000 as p_partkey) from part where p_partkey % 10 = 0)")})
)"""

TAGS = "array_to_string(list_sort(tags), ',')"

EMB = "emb as (select vec_id, embedding::double[] as v, label from embeddings)"

#: Items with vectors, requests (every twentieth) and all their scores.
SCORED = f"""{CAT}, {EMB},
idx as (select cat.*, v, label from cat join emb on key = vec_id),
req as (
  select key as query_id, v, label, case (key // 20) % 4 when 0 then 'analyst' when 1 then 'operator' when 2 then null else 'guest' end as agent,
         case when key % 40 = 0 then ['write'] else []::varchar[] end as scopes, 't' || (key % 3) as tenant
  from idx where key % 20 = 0
),
scored as (select query_id, i.*, round(list_cosine_similarity(r.v, i.v), 9) as score from req r, idx i)"""


def hits(k: int, where: str = "true", name: str = "hits") -> str:
    return f"""{name} as (
  select *, row_number() over (partition by query_id order by score desc, tool_id)::int as rank from scored where {where}
  qualify rank <= {k}
)"""


HUMAN = r"lower(trim(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-./]+', ' ', 'g')))"
TOKENS = r"list_filter(string_split(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"


def index_text(prefix: str = "") -> str:
    p = prefix
    return f"""concat_ws(chr(10), case when {HUMAN.format(p + "name")} = {p}name then {p}name else {p}name || ' (' || {HUMAN.format(p + "name")} || ')' end,
  'namespace: ' || {HUMAN.format(p + "namespace")}, trim({p}description), 'tags: ' || array_to_string(list_sort({p}tags), ', '))"""


#: BM25 over a corpus (id, text) for questions (query_id, text).
BM25 = f"""tok as (select id, unnest({TOKENS.format("coalesce(text, '')")}) as term from corpus),
len as (select id, len({TOKENS.format("coalesce(text, '')")})::bigint as length from corpus),
post as (select term, id, any_value(length) as length, count(*) as tf from tok join len using (id) group by term, id),
stat as (select count(*) as n, avg(length) as avg_length from len),
term as (select term, count(*) as df, ln(1 + (any_value(n) - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf from post, stat group by term),
ask as (select query_id, unnest({TOKENS.format("text")}) as term from question),
bm as (
  select query_id, id, round(sum(idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * greatest(length, 1) / avg_length))), 9) as score
  from ask join term using (term) join post using (term), stat group by query_id, id
)"""


def q(*parts: str) -> str:
    """with a, b, c select ... from its parts, the last being the select."""
    return "with " + ",\n".join(parts[:-1]) + "\n" + parts[-1] if len(parts) > 1 else parts[0]
