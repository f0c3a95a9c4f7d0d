import random

import numpy as np
import pyarrow as pa

from orrery.llm import words as W


def texts():
    rng = random.Random(1)
    pieces = ["word", "Word.", "ABC", "é", "日本", "a" * 16, "b" * 17, "c" * 300, "x\x00", "x", "\x00", "1,2", "!!", " ", "\n", "\t ", "\x1c", " "]
    return [None, "", " ", "\n\t"] + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(400)]


def test_words_are_told_apart_as_bytes_do(monkeypatch):
    said = texts()
    want = [(t or "").encode().lower().split() for t in said]
    names = {}
    for size in (1 << 20, 100):
        monkeypatch.setattr(W, "_BYTES", size)
        got = list(W.lowered_hashes(pa.array([None if t is None else t.encode() for t in said], pa.binary())))
        assert [len(g) for g in got] == [len(w) for w in want]
        for w, g in zip(want, got):
            for word, h in zip(w, g.tolist()):
                assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def shape(word):
    out = bytearray()
    for c in word:
        kind = 0x58 if 65 <= c <= 90 else 0x78 if 97 <= c <= 122 or c >= 128 else 0x39 if 48 <= c <= 57 else c
        if not out or out[-1] != kind:
            out.append(kind)
    return bytes(out[: W.SHAPE_RUNS])


def test_shapes_against_plain_loops():
    said = texts() + ["Ab1" * 30, "A-b-C 12ab Ab1Ab1"]
    names, back = {}, {}
    for t, (_, forms) in zip(said, W.hashes_and_shapes(pa.array([None if t is None else t.encode() for t in said], pa.binary()))):
        for word, h in zip((t or "").encode().split(), forms.tolist(), strict=True):
            assert names.setdefault(shape(word), h) == h and back.setdefault(h, shape(word)) == shape(word)
    assert len(names) > 10


def test_slices_of_arrays():
    whole = pa.array([b"zz yy", b"a b", None, b"c"], pa.binary())
    assert [len(x) for x in W.lowered_hashes(whole.slice(1, 3))] == [2, 0, 1]
    one = next(W.lowered_hashes(pa.array([b"a b"], pa.binary())))
    assert np.array_equal(next(W.lowered_hashes(whole.slice(1, 1))), one)
