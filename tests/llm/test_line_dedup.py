from collections import Counter

from orrery.llm import line_dedup as L
from orrery.llm.registry import QUERIES, SQL

from ..oracle import same


def brute(rows, ratio=L.RATIO, least=L.MIN_PAGES):
    pages = {}
    for _, t, s in rows:
        pages.setdefault(s, set()).add(t)
    drop = {}
    for s, texts in pages.items():
        n = Counter(x for t in texts if t is not None for x in {y.strip(" ") for y in t.split("\n")} if x)
        drop[s] = {x for x, c in n.items() if c >= least and c > ratio * len(texts)}
    out = []
    for i, t, s in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if x.strip(" ") not in drop[s]]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_odd_texts(make, odd_texts):
    rows = [(k, t, None if k % 2 else "s") for k, t in enumerate(odd_texts)]
    out = L.dedup_lines(make(rows))
    assert got(out) == brute(rows) and set(make(rows).columns) < set(out.columns)


def test_boilerplate_is_dropped_by_host_only(make):
    rows = [(k, f"menu \nbody {k}\n\n menu\nfoot", "hot") for k in range(60)] + [(100 + k, f"menu\nown {k}", "other" if k == 0 else f"h{k}") for k in range(20)]
    found = L.dedup_lines(make(rows))
    assert got(found) == brute(rows)
    assert found.filter("source = 'hot'").first().text.startswith("body") and found.filter("source = 'h3'").first().n_dropped == 0


def test_copies_of_one_page_are_not_boilerplate(make):
    rows = [(k, "copied line\nand another", "s") for k in range(50)] + [(50 + k, f"own {k}", "s") for k in range(30)]
    assert L.dedup_lines(make(rows)).agg({"n_dropped": "sum"}).first()[0] == 0


def test_large_tables_are_joined_without_broadcast(make, monkeypatch):
    rows = [(k, f"menu\nbody {k}", "hot") for k in range(60)]
    monkeypatch.setattr(L, "MAX_BROADCAST_LINES", 0)
    assert got(L.dedup_lines(make(rows))) == brute(rows)


def test_columns_of_any_name(spark):
    ddl = "doc_id long, text string, source string, n_lines string, n_dropped int, __lines int, __host string, __drop int, host int"
    rows = [(k, f"menu\nbody {k}", "hot") for k in range(60)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "h", 3, 4) for r in rows], ddl)
    with_counts, plain = L.dedup_lines(docs), L.dedup_lines(docs, counts=False)
    assert got(with_counts) == brute(rows) and sorted(with_counts.columns) == sorted(docs.columns)
    assert plain.columns == docs.columns and {(r.n_lines, r.n_dropped, r.host) for r in plain.collect()} == {("x", 1, 4)}


def test_empty_table(make):
    assert L.dedup_lines(make([])).count() == 0


def test_query_equals_its_sql(spark):
    same(spark, "/root/testdata/sf0.001", QUERIES["op6_line_dedup"], SQL["op6_line_dedup"])
