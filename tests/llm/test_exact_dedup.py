import hashlib
import random
import re

from orrery.llm import exact_dedup as X
from orrery.llm.registry import QUERIES, SQL

from ..oracle import same


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[key])[1]
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_odd_texts(make, odd_texts):
    rows = list(enumerate(odd_texts))
    assert got(X.exact_dedup(make(rows))) == brute(rows)


def test_hot_group_ties_and_repeated_rows(make):
    rng = random.Random(1)
    rows = [(k, "hot " + " " * rng.randrange(3)) for k in range(900)] + [(k, f"t{k // 2}") for k in range(900, 2700)] + [(5000, "dup"), (5000, "dup")]
    assert got(X.exact_dedup(make(rows))) == brute(rows)


def test_empty_table(make):
    assert X.exact_dedup(make([])).count() == 0


def test_bloom_never_loses_a_repeat(spark, make):
    rows = [(k, f"text {k % 700}") for k in range(1000)]
    digest = X.digests(make(rows))
    flagged = X.flag_possible(digest, X.repeated_cells(digest, 10), 10).collect()  # an overfull table
    assert {r.doc_id for r in flagged if r.maybe} >= {k for k in range(1000) if k % 700 < 300}
    wide = X.flag_possible(digest, X.repeated_cells(digest, 20), 20)
    assert wide.filter("maybe").count() < 650  # 600 are repeated


def test_shuffled_cells_give_the_same(make, monkeypatch):
    rows = [(k, f"text {k % 70}") for k in range(100)]
    monkeypatch.setattr(X, "MAX_BROADCAST_BITS", 1)
    assert got(X.exact_dedup(make(rows))) == brute(rows)


def test_a_hot_text_beyond_the_broadcast_bound(make, monkeypatch):
    rows = [(k, "hot") for k in range(500)] + [(k, f"text {k // 2}") for k in range(500, 1500)]
    monkeypatch.setattr(X, "MAX_BROADCAST_BITS", 1)
    assert got(X.exact_dedup(make(rows))) == brute(rows)


def test_a_null_id_comes_last(make):
    found = {r.doc_id: (r.keep_id, r.kept) for r in X.exact_dedup(make([(None, "a b"), (5, "a b"), (7, "a b"), (None, "alone")])).collect() if r.group_size > 1}
    assert found == {None: (5, False), 5: (5, True), 7: (5, False)}


def test_query_equals_its_sql(spark):
    same(spark, "/root/testdata/sf0.001", QUERIES["op9_exact_dedup"], SQL["op9_exact_dedup"])
