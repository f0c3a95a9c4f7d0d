import random

import numpy as np

from orrery.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        good = rng.random() < 0.7
        said = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        text = " ".join(said).capitalize() + "." if good else " ".join(rng.choice([w.upper() + "!!", w + "###"]) for w in said)
        rows.append((k, text, f"s{k % 3}", int(good)))
    return rows


def test_held_out_accuracy_and_unlabelled_documents(spark, make):
    rows = corpus()
    labels = spark.createDataFrame([(k, y, 0) for k, _, _, y in rows if k % 4 == 0], LABELS)
    docs = make([r[:3] for r in rows])
    got = {r.doc_id: r for r in Q.score(docs, Q.fit(docs, labels)).collect()}
    right = [got[k].kept == bool(y) for k, _, _, y in rows if k % 4]
    assert len(got) == len(rows) and np.mean(right) > 0.97
    kept = Q.keep_good(docs, Q.fit(docs, labels))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}


def test_reruns_agree(spark, make):
    rows = corpus(2, 200)
    labels = spark.createDataFrame([(k, y, 0) for k, _, _, y in rows if k % 3 == 0], LABELS)
    once = sorted(map(tuple, Q.score(make([r[:3] for r in rows]), Q.fit(make([r[:3] for r in rows]), labels)).collect()))
    docs = make([r[:3] for r in reversed(rows)]).repartition(7)
    assert once == sorted(map(tuple, Q.score(docs, Q.fit(docs, labels)).collect()))


def test_odd_texts_and_no_labels(spark, make, odd_texts):
    docs = make([(k, t, None) for k, t in enumerate(odd_texts)] + [(0, None)])
    none = spark.createDataFrame([], LABELS)
    assert Q.fit(docs, none) is None and Q.fit(docs, spark.createDataFrame([(1, 1, 0), (2, None, 0)], LABELS)) is None
    assert all(r.kept for r in Q.score(docs, None).collect())
    model = Q.fit(docs, spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(3, 1, 1)], LABELS))
    out = Q.score(docs, model).collect()
    assert len(out) == len(odd_texts) + 1 and all(0 <= r.score <= 1 for r in out)


def test_empty_table(spark, make):
    assert Q.score(make([]), Q.fit(make([]), spark.createDataFrame([(1, 1, 0)], LABELS))).count() == 0


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    n, width, each = 1500, 200, 8
    y = (rng.random(n) < 0.5).astype(int)
    # in either view a document shows eight features, four in five of its own class's hundred
    own = lambda: (100 * np.where(rng.random((n, each)) < 0.8, y[:, None], 1 - y[:, None]) + rng.integers(0, 100, (n, each))).ravel()
    view = lambda: Q.Rows(np.repeat(np.arange(n), each), own(), np.full(n * each, each**-0.5), n, width)
    a, b = view(), view()
    known = np.where(np.arange(n) < 60, y, -1)
    held = np.arange(n) < 20
    wrong = {}
    for rounds in (0, 4):
        m = Q.co_train(a, b, known, held, rounds)
        wrong[rounds] = np.mean((a.dot(m.text) > 0) != y) + np.mean((b.dot(m.page) > 0) != y)
    assert wrong[4] < 0.9 * wrong[0]


def test_platt_scaling_is_calibrated():
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < Q.sigmoid(3 * z - 1)).astype(float)
    a, b = Q.platt(z, y)
    assert abs(a - 3) < 0.4 and abs(b + 1) < 0.3


def test_query_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op1_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (got.kept == (got.quality == 1)).mean() > 0.97


def test_the_page_view_sees_metadata_alone(spark, make):
    rows = corpus(3, 200)
    labels = spark.createDataFrame([(k, y, 0) for k, _, _, y in rows if k % 3 == 0], LABELS)
    docs = make([r[:3] for r in rows])
    model = Q.fit(docs, labels)
    at = Q.page_features("s", "en", 100)
    assert len(set(at.tolist())) == len(at) and at.max() < Q.PAGE_SIZE
    assert {tuple(Q.page_features(*x)) for x in ((None, None, None), ("", None, None), ("s", "en", 0), ("s", "en", -5), ("s", "en", 10**15))}
    for text in (b"", b"one text", b"ANOTHER!! ###"):
        assert model.score(text, "s", "en", 100)[1] == model.score(b"x", "s", "en", 100)[1]


def test_combined_scores_are_calibrated_where_views_depend_on_each_other():
    rng = np.random.default_rng(4)
    y = (rng.random(6000) < 0.6).astype(float)
    z = 2 * y - 1 + rng.normal(size=6000) * 1.2
    a, b = Q.platt(z, y)
    same = a * z + b  # both views say the same, so their sum would count it twice
    w = Q.combination(same, same, y, float(np.log(0.6 / 0.4)))
    p = Q.sigmoid(w[0] * same + w[1] * same + w[2])
    for low in (0.1, 0.3, 0.5, 0.7):
        there = (p >= low) & (p < low + 0.2)
        assert abs(p[there].mean() - y[there].mean()) < 0.05


def test_each_round_sees_its_own_draw():
    rng = np.random.default_rng(5)
    n = 600
    y = (rng.random(n) < 0.5).astype(int)
    view = Q.Rows(np.arange(n), y + 2 * rng.integers(0, 10, n), np.ones(n), n, 20)
    known = np.where(np.arange(n) < 100, y, -1)
    held = np.arange(n) < 30
    models = [Q.co_train(view, view, known, held, 2, draw) for draw in (None, np.arange(n) % 2, np.full(n, 9))]
    assert np.abs(models[1].text - models[2].text).max() > 0  # nothing is drawn in round 9
    assert np.mean((view.dot(models[1].text) > 0) == y) > 0.95
