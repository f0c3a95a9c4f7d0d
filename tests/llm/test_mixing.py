import hashlib
import re

import pytest

from orrery.llm import mixing as M
from orrery.llm.registry import QUERIES, SQL

from ..oracle import same


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute(rows):
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r[1]) for r in rows if r[2] == s) for s in sources]
    weights = [(5, 2, 1)[k % 3] for k in range(len(sources))]
    aims, left, open_ = [0.0] * len(sources), float(sum(sizes)), set(range(len(sources)))
    while open_:
        rate = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if weights[k] * rate > 3 * sizes[k]}
        for k in over or open_:
            aims[k] = 3.0 * sizes[k] if over else weights[k] * rate
        if not over:
            break
        left -= sum(3 * sizes[k] for k in over)
        open_ -= over
    out = []
    h = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    for s, total, aim in zip(sources, sizes, aims):
        n = int(aim // total) if total else 0
        rest, upto = aim - n * total, 0
        cells = {}
        for i, t, src, *_ in rows:
            if src == s:
                cells[h(i)] = cells.get(h(i), 0) + size(t)
        more = set()
        for c in sorted(cells):
            if 2 * upto + cells[c] <= 2 * rest:
                more.add(c)
            upto += cells[c]
        out += [(i, size(t), total, aim, size(t) * (n + (h(i) in more))) for i, t, src, *_ in rows if src == s]
    return sorted(out, key=str)


def got(docs):
    out = M.with_copies(docs, M.mixture(docs)).collect()
    return sorted(((r.doc_id, size(r.text), r.source_size, r.target, size(r.text) * r.copies) for r in out), key=str)


def test_odd_texts_and_null_source(make, odd_texts):
    rows = [(k, t, ["a", "b", None][k % 3]) for k, t in enumerate(odd_texts)]
    assert got(make(rows)) == brute(rows)


def test_hot_source_is_near_its_target(make):
    rows = [(k, "w " * (k % 37 + 1), "hot") for k in range(600)] + [(k, "w " * (k % 11 + 1), f"s{k % 5}") for k in range(600, 900)]
    found = got(make(rows))
    assert found == brute(rows)
    for s in {r[2] for r in found}:
        taken, target = sum(r[4] for r in found if r[2] == s), next(r[3] for r in found if r[2] == s)
        assert abs(taken - target) <= 37
    assert all(r[4] <= 3 * r[1] for r in found)


def test_repeated_rows_are_drawn_together(make):
    rows = [(1, "a b c", "x")] * 7 + [(2, "d", "y"), (3, "", "z")]
    assert got(make(rows)) == brute(rows)


def test_empty_table_and_no_words(make):
    assert M.mix(make([])).count() == 0
    assert got(make([(1, None, "a"), (2, " ", "b")])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mix_repeats_rows_with_their_columns(make):
    docs = make([(k, "w " * 10, "big" if k < 90 else "rare") for k in range(100)])
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    copies = {(r.doc_id): r.copies for r in M.with_copies(docs, M.mixture(docs)).collect()}
    assert mixed.count() == sum(copies.values())


def test_targets_stop_at_the_cap():
    assert M.targets([100, 10, 10], [1, 1, 1]) == [60.0, 30.0, 30.0]
    assert M.targets([0, 10], [5, 2]) == [0.0, 10.0]


def test_source_limit(make):
    with pytest.raises(ValueError, match="sources"):
        M.mixture(make([(1, "a", "x"), (2, "b", "y")]), max_sources=1)


def test_many_sources_over_several_ranges(make, monkeypatch):
    monkeypatch.setattr(M, "RANKED", 7)
    rows = [(k, "w " * (k % 13 + (900 if k % 60 == 7 else 0)), None if k % 60 == 59 else f"s{k % 60}é" if k % 2 else f"S{k % 60}") for k in range(400)]
    assert got(make(rows)) == brute(rows)


def test_columns_of_any_name(spark):
    ddl = "doc_id long, text string, source string, target string, full int, threshold int, source_size string, copies string, key string, row int, n int, h int"
    docs = spark.createDataFrame([(k, "w " * (k % 5 + 1), f"s{k % 4}", "t", 1, 2, "z", "c", "k", 3, 4, 5) for k in range(80)], ddl)
    mixed = M.mix(docs)
    plain = docs.select("doc_id", "text", "source")
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in M.mix(plain).collect())
    assert {tuple(r)[3:] for r in mixed.collect()} == {("t", 1, 2, "z", "c", "k", 3, 4, 5)}


def test_query_equals_its_sql(spark):
    same(spark, "/root/testdata/sf0.001", QUERIES["op5_source_mix"], SQL["op5_source_mix"])
