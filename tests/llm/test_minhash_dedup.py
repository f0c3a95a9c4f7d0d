import itertools
import random

import numpy as np
import pytest

from orrery.llm import components as C
from orrery.llm import minhash_dedup as M


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent=80):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(i, low.get(find(k), i))
    return sorted((i, len(sets[k]), low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{k}" for k in range(3000)]


def family(seed, n, share, length=120):
    rng = random.Random(seed)
    base = [rng.choice(VOCABULARY) for _ in range(length)]
    return [" ".join(edited(rng, base, share)) for _ in range(n)]


@pytest.mark.parametrize("words", [2, 5])
def test_odd_texts(make, odd_texts, words):
    rows = list(enumerate(odd_texts))
    assert got(M.near_duplicates(make(rows), words)) == brute(rows, words)


@pytest.mark.parametrize("blocks", [(512, 1024), (5, 11)])
def test_families_around_the_threshold(make, monkeypatch, blocks):
    for name, value in zip(("MINOR", "MAJOR"), blocks):
        monkeypatch.setattr(M, name, value)
    texts = family(1, 120, 0.05) + family(2, 60, 0.03) + family(3, 40, 0.08) + family(4, 30, 0.0) + [f"lone {k} " + " ".join(random.Random(k).choices(VOCABULARY, k=40)) for k in range(50)]
    rng = random.Random(5)
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    assert got(M.near_duplicates(make(rows), 2)) == brute(rows, 2)


def test_exactly_at_the_threshold(make):
    a = " ".join(f"x{k}" for k in range(10))  # 9 shingles
    b = a + " y"  # 10 shingles, 9 shared
    far = " ".join(f"x{k}" for k in range(8)) + " y z"  # 7 shared of 11
    rows = [(1, a), (2, b), (3, far), (4, "A" + a[1:]), (5, a.replace("x", "X"))]
    assert got(M.near_duplicates(make(rows), 2)) == brute(rows, 2)


def test_empty_table_and_repeated_rows(make):
    assert M.near_duplicates(make([])).count() == 0
    assert got(M.near_duplicates(make([(1, "a b c")] * 3 + [(2, None)]), 2)) == [(1, 2, 1, True)] * 3 + [(2, 0, 2, True)]


def test_drop_keeps_one_of_each(make):
    docs = make([(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words are here now ok"), (4, None)])
    out = M.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 4]


def test_posterior_bounds_keep_similar_pairs():
    least = M.least_matches(0.8)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (4000, M.HASHES)).astype(np.uint16)
    for similarity, low, high in ((0.8, 1.0, 1.0), (0.3, 0.0, 0.001)):
        b = np.where(rng.random(a.shape) < similarity, a, a + 1)
        kept = len(M.plausible(a, b, least)) / len(a)
        assert low <= kept <= high


def test_components_of_a_chain_and_a_star(spark):
    rng = random.Random(2)
    names = rng.sample(range(1000), 60)
    chain = list(zip(names[:40], names[1:41]))
    star = [(names[45], n) for n in names[46:]]
    found = {r.v: r.component for r in C.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert set(found) == {*names[:41], *names[45:]}
    assert {found[n] for n in names[:41]} == {min(names[:41])} and {found[n] for n in names[45:]} == {min(names[45:])}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(M.op2_minhash_dedup(spark, sf)) == brute(rows, 2)


def test_drop_keeps_one_row_of_repeated_ids(make):
    a, b = "a b c d e f", "other words are here now ok"
    docs = make([(1, a), (1, a), (1, a), (2, a), (5, b), (5, "third text of some new words"), (6, b), (7, None), (7, None), (8, "alone in its component for good")])
    out = M.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(t or "" for _, t in got) == sorted([a, b, "third text of some new words", "", "alone in its component for good"])
    assert (1, a) in got and (5, "third text of some new words") in got


def test_rows_without_an_id_are_told_apart_by_text(make):
    a, b = "a b c d e f g", "other words are here now ok"
    docs = make([(None, a), (None, a), (None, b), (None, None), (3, a), (9, "quite another text that has no copy")])
    texts = [r.text for r in M.drop_near_duplicates(docs).collect()]
    assert sorted(t or "" for t in texts) == sorted([a, b, "", "quite another text that has no copy"])


def test_columns_of_any_name(spark):
    ddl = "doc_id long, text string, id long, row string, n long, __gone int, d string, size long, component_id long"
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "r", 1, 2, "d", 3, 4), (2, "a b c d e f", 5, "r", 1, 2, "d", 3, 4), (2, "zz yy xx ww vv uu", 6, "r", 1, 2, "d", 3, 4)], ddl)
    out = M.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == ["a b c d e f", "zz yy xx ww vv uu"]


@pytest.mark.parametrize("bits", [27, 10])
def test_sets_of_wanted_documents(make, monkeypatch, bits):
    monkeypatch.setattr(M, "MAX_TABLE_BITS", bits)
    rows = [(k, f"w{k} w{k + 1} w{k + 2}") for k in range(300)]
    docs = make(rows).select("doc_id", "text")
    wanted = docs.filter("doc_id % 3 = 0").select("doc_id")
    found = {r.doc_id: np.frombuffer(r.set, "<u8").tolist() for r in M.Verifier(docs, docs, 2, 80, M.MISS).sets(wanted).collect()}
    assert {k for k in range(0, 300, 3)} <= set(found) and len(found) < 130
    assert all(found[k] == M.shingles(rows[k][1].encode(), 2).tolist() for k in found)
