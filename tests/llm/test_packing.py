import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orrery.llm import packing as K


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER))


def check(tokenizer, rows, pieces, size=K.SEQUENCE):
    """Every id of every document in exactly one piece, gapless sequences within the size, order kept."""
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [K.END_ID])
    got = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        got[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, copies in want.items():
        for c in {tuple(c) for c in copies}:
            mine = [p for p in got[i] if p["doc_tokens"] == len(c)]
            assert sum(p["length"] for p in mine) == len(c) * len([x for x in copies if len(x) == len(c)])
        if len(copies) == 1:
            ids, at = np.array(copies[0], "<u4"), 0
            for p in sorted(got[i], key=lambda p: p["start"]):
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
    assert set(got) == set(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return sequences


def test_ids_equal_the_tokenizers(tokenizer, odd_texts):
    odd = ["Don't STOP!! it's 'quoted' <|endoftext|> x<|startoftext|>y", "é É ß İstanbul ǅ ﬁ", "a b c\x1cd\x85e", "é ̈x", "x|y<z>'t", "1,234.5 No... \"end.\" (ok!)", "日本語 テキスト", "### &&& word### WORD!!", "ſharp KelvinK", "퟿ \U0010ffff"]
    words = K.word_ids(None)
    for t in [*odd, *(x for x in odd_texts if x), *odd]:
        assert words.ids(t.encode()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_random_texts_round_trip(tokenizer):
    rng = random.Random(4)
    letters = "abcXYZéÜñ.,!?'-|<>#&*0 \n\t ́ſΣς"
    words = K.word_ids(None)
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert words.ids(t.encode()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_marks_letters_and_long_words_part_as_the_tokenizer_does(tokenizer):
    rng = random.Random(11)
    pieces = ["word", "É", "ß", "Ü", "÷", "×", ".", ",", "-", "'s", "'", "(", ")", "##", "9", "é", "x\x00y", "\x00", "日", "a" * 23, "b" * 24, "c" * 90, "\u0301", "<|", "|>", "@", "\u00a0", "\u2028", " ", "\n", "\x1c"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    words = K.word_ids(None)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for t, ids in zip(some, words.all_ids(pa.array([t.encode() for t in some], pa.binary()))):
            assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_small_table_is_emptied_and_stays_exact(tokenizer, monkeypatch):
    monkeypatch.setattr(K, "MEMO", 50)
    monkeypatch.setattr(K, "_AT_ONCE", 20)
    monkeypatch.setattr(K, "_BYTES", 300)
    words = K.WordIds(public_tokenizers.path(K.TOKENIZER))
    rng = random.Random(12)
    for _ in range(200):
        t = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(30))
        assert words.ids(t.encode()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_cuts_fall_on_ends_but_in_long_sentences():
    stop = np.zeros(1 << 16, bool)
    stop[7] = True
    stream = np.full(3000, 5, "<u2")
    stream[[99, 499]] = 7  # sentences of 100, 400 and 2,500 tokens
    points, penalties = K.cut_points(stream, np.array([3000]), stop, 2048)
    assert points[:3].tolist() == [0, 100, 500] and penalties[:3].tolist() == [0, K.SENTENCE_PENALTY, K.SENTENCE_PENALTY]
    assert set(penalties[3:-1].tolist()) == {K.HARD_PENALTY} and np.diff(points[2:]).max() <= K.GRID and penalties[-1] == 0
    points, _ = K.cut_points(stream[:900], np.array([900]), stop, 2048)
    assert points.tolist() == [0, 100, 500, 900]


def brute_cost(points, penalties, size):
    best = {0: 0}
    for j in range(1, len(points)):
        best[j] = penalties[j] + min(best[i] + size - (points[j] - points[i]) for i in range(j) if points[j] - points[i] <= size)
    return best[len(points) - 1]


def test_dynamic_program_is_optimal():
    rng = random.Random(5)
    for _ in range(300):
        size = rng.choice([8, 20])
        points = [0, *itertools.accumulate(rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 30)))]
        penalties = [rng.choice([0, 2, 5]) for _ in points]
        cuts = K.best_cuts(points, penalties, size)
        cost, at = 0, 0
        for j in cuts:
            assert points[j] - points[at] <= size
            cost += size - (points[j] - points[at]) + penalties[j]
            at = j
        assert at == len(points) - 1 and cost == brute_cost(points, penalties, size)


def test_odd_texts(make, tokenizer, odd_texts):
    rows = list(enumerate(odd_texts))
    check(tokenizer, rows, [r.asDict() for r in K.pack(make(rows).coalesce(1)).collect()])


def test_repeated_rows_and_null_ids(make, tokenizer):
    rows = [(1, "one two")] * 3 + [(None, "x"), (2, None)]
    check(tokenizer, rows, [r.asDict() for r in K.pack(make(rows)).collect()])


def test_empty_table(make):
    assert K.pack(make([])).count() == 0


def test_blocks_carry_over(tokenizer):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["the", "cat", "sat.", "on", "mats"]) for _ in range(rng.randrange(900)))) for k in range(60)]
    words = K.word_ids(None)
    whole = []
    for block in (12_000, 20_000, 1 << 19):
        packer, pieces = K.Packer(0, words.ends_sentence, block=block), []
        for i, t in rows:
            pieces += packer.add(i, np.concatenate([words.ids(t.encode()), np.array([1], "<u2")]))
        pieces += packer.finish()
        named = [dict(zip(K.PIECE.names, p)) for p in pieces]
        sequences = check(tokenizer, rows, named)
        whole.append(len(sequences))
        assert [p["doc_id"] for p in named] == sorted(p["doc_id"] for p in named)
    assert whole[2] <= whole[0] <= whole[2] + 2


def test_query_packs_tightly(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sequences = check(tokenizer, rows, [r.asDict() for r in K.op3_dp_packing(spark, sf).collect()])
    padding = [K.SEQUENCE - sum(n for _, n in parts) for parts in sequences.values()]
    assert sum(padding) - max(padding) < 0.02 * K.SEQUENCE * len(padding)
