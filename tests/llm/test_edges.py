"""Every operator over nulls in any column, repeated rows, empty tables and columns named like the operators' own."""

import pytest

from orrery.llm import exact_dedup, line_dedup, minhash_dedup, mixing, packing, pii, quality, secrets, sharding, spotsigs

CLASH = "row id key n h t e at size target full threshold copies source_size shard slot cell slice curve level rank base sigs s u x p own block doc word bits maybe first d y draw page value spans host line lines pages kept group_size edited position v w a b i j q"
NAMES = [f"`{c}` string" for c in CLASH.split()] + ["`__row` int", "`__key` int", "`__host` int", "`__id` int", "`__lines` int", "`__order` int", "`__next` int", "`__hot` int"]
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(NAMES)
CORE = [
    (1, "One line here, password: hunter2hunter2\nmail jo@site.org now", "en", "a", 55), (1, "One line here, password: hunter2hunter2\nmail jo@site.org now", "en", "a", 55),
    (2, None, None, None, None), (None, "text without an id, eve@else.org 10.0.0.1", None, "b", None), (None, None, None, None, None), (3, "", "en", None, 0), (4, " \n\t ", None, "a", 3),
    (1, "another text of a known id", "de", "b", 26), (-(1 << 62), "far below", "en", "a", 9), ((1 << 62), "far above", "en", "a", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["c"] * (len(NAMES) - 8), *[7] * 8) for r in CORE], DDL)


@pytest.fixture(scope="module")
def model(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None), (4, 0, 0), (4, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    return quality.fit(docs, labels)


#: Operators by name: what each gives a row of.
ROWS = {
    "score": lambda d, m: quality.score(d, m), "near_duplicates": lambda d, m: minhash_dedup.near_duplicates(d, 2), "hilbert_shards": lambda d, m: sharding.hilbert_shards(d), "with_copies": lambda d, m: mixing.with_copies(d, mixing.mixture(d)),
    "dedup_lines": lambda d, m: line_dedup.dedup_lines(d), "edit_report": lambda d, m: spotsigs.edit_report(d), "scan_secrets": lambda d, m: secrets.scan_secrets(d), "exact_dedup": lambda d, m: exact_dedup.exact_dedup(d),
    "find_pii": lambda d, m: pii.find_pii(d), "sanitise": lambda d, m: pii.sanitise(d),
}
#: Operators that give rows of the table itself, and those with rows of their own.
SOME = {
    "keep_good": lambda d, m: quality.keep_good(d, m), "drop_near_duplicates": lambda d, m: minhash_dedup.drop_near_duplicates(d), "mix": lambda d, m: mixing.mix(d), "lines_only": lambda d, m: line_dedup.dedup_lines(d, counts=False),
}


@pytest.mark.parametrize("name", ROWS)
def test_a_row_for_each_row(docs, model, name):
    out = ROWS[name](docs, model).collect()
    assert len(out) == len(CORE)
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in CORE)
    assert ROWS[name](docs.limit(0), model).count() == 0


@pytest.mark.parametrize("name", SOME)
def test_the_columns_of_the_table(docs, model, name):
    out = SOME[name](docs, model)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r["w"] for r in rows} <= {"c"} and {r["__row"] for r in rows} <= {7} and {str(r.doc_id) for r in rows} <= {str(r[0]) for r in CORE}
    assert SOME[name](docs.limit(0), model).count() == 0


def test_rows_of_their_own(docs, model):
    pieces = packing.pack(docs).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == sorted(str(r[0]) for r in CORE)
    assert packing.pack(docs.limit(0)).count() == 0
    links = spotsigs.spot_links(docs).collect()
    assert all(r.a < r.b for r in links) and spotsigs.spot_links(docs.limit(0)).count() == 0
    kept = minhash_dedup.drop_near_duplicates(docs).collect()
    assert len(kept) == len(CORE) - 1 and sum(r.doc_id == 1 for r in kept) == 2  # only the repeated row is alike to another
