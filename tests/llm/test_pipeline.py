import pytest

import corpus_pipeline as P
from orrery.llm import packing
from orrery.llm.common import documents, staged

from .test_line_dedup import brute as lines_by_hand
from .test_minhash_dedup import brute as groups_by_hand
from .test_mixing import brute as mix_by_hand


@pytest.fixture(scope="module")
def steps(spark):
    sf, out = "/root/testdata/sf0.001", []
    docs = documents(spark, sf)
    for _, stage in P.STAGES:
        after = staged(stage(spark, docs, sf), "test-stage")
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_keep_the_columns(spark, steps):
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "source_mix", "packing"]
    for before, after in steps[:-1]:
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_quality_stage(spark, steps):
    before, after = steps[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.93 and after.exceptAll(before).count() == 0


def test_line_stage(steps):
    before, after = steps[1]
    want = {i: t for i, t, *_ in lines_by_hand(rows(before))}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, None if t is None else len(t)) for i, t in want.items()}


def test_near_stage(steps):
    before, after = steps[2]
    want = {i for i, _, _, kept in groups_by_hand([r[:2] for r in rows(before)], 5) if kept}
    assert {r.doc_id for r in after.collect()} == want


def test_mix_stage(steps):
    before, after = steps[3]
    copies = {}
    for i, size, _, _, taken in mix_by_hand(rows(before)):
        copies[i] = taken // size if size else None
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert all(got.get(i, 0) == n for i, n in copies.items() if n is not None)


def test_packing_stage(steps):
    before, after = steps[4]
    words = packing.word_ids(None)
    assert sum(r.length for r in after.collect()) == sum(len(words.ids((r.text or "").encode())) + 1 for r in before.collect())


def test_run(spark, steps):
    assert P.ORACLE_SQL is None
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.agg({"length": "sum"}).first() == steps[4][1].agg({"length": "sum"}).first()
