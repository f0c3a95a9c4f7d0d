"""Words of many texts at once: hashes of words and of their shapes, in arrays, without an object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text in work at a time.
_BYTES = 1 << 20
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Masks that keep so many first bytes of eight.
KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(33)
#: Words of up to so many bytes are hashed in arrays, longer ones by themselves.
SHORT = 16
#: Classes of bytes for shapes: capitals, other letters (with all beyond ASCII), digits; marks stand for themselves.
_SHAPE = np.array([0x58 if 65 <= c <= 90 else 0x78 if 97 <= c <= 122 or c >= 128 else 0x39 if 48 <= c <= 57 else c for c in range(256)], np.uint8)
#: Runs of one class that count in a shape.
SHAPE_RUNS = 16


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def groups(texts: pa.BinaryArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts in groups of about _BYTES: the bytes, each text closed by a space, and where texts begin (and the end)."""
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + _BYTES, "right")) - 1)
        own = ends[begin : end + 1] - ends[begin]
        yield np.insert(raw[ends[begin] : ends[end]], own[1:], 32), own + np.arange(len(own))
        begin = end


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs without ASCII white space."""
    white = np.concatenate([[True], _WHITE[raw], [True]])
    return np.flatnonzero(white[:-2] & ~white[1:-1]), np.flatnonzero(~white[1:-1] & white[2:]) + 1


def hashes(raw: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of words by their bytes."""
    padded = np.append(raw, np.zeros(SHORT, np.uint8))
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("S8"), (len(padded) - 7,), (1,))
    n = stops - begins
    low = eights[begins].view("<u8") & KEPT[np.minimum(n, 8)]
    high = eights[begins + 8].view("<u8") & KEPT[np.clip(n - 8, 0, 8)]
    out = mix(mix(low * _M3 + n.astype(np.uint64)) + high * _M2)
    for k in np.flatnonzero(n > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[begins[k] : stops[k]].tobytes())
    return out


def shapes(raw: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shapes of words: Xx. for Word. and x9 for ab12."""
    kind = _SHAPE[raw]
    new = np.append(True, kind[1:] != kind[:-1])
    new[begins] = True
    count = np.cumsum(new)
    first = np.zeros(len(raw), np.int64)
    first[begins] = count[begins] - np.append(0, count[begins[:-1]]) if len(begins) else 0
    place = count - np.cumsum(first)  # of the run within its word, from 0
    part = mix(kind.astype(np.uint64) * _M3 + place.astype(np.uint64))
    part[~new | (place >= SHAPE_RUNS)] = 0
    upto = np.append(np.uint64(0), np.cumsum(part, dtype=np.uint64))
    return upto[stops] - upto[begins]


def lowered_hashes(texts: pa.BinaryArray) -> Iterator[np.ndarray]:
    """The words' hashes of each text in order, A-Z lower-cased; a null text has none."""
    for raw, ends in groups(texts):
        raw = _LOWER[raw]
        begins, stops = spans(raw)
        found = hashes(raw, begins, stops)
        at = np.searchsorted(begins, ends).tolist()
        for a, b in zip(at, at[1:]):
            yield found[a:b]


def hashes_and_shapes(texts: pa.BinaryArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words' hashes and their shapes' of each text in order, as written; a null text has none."""
    for raw, ends in groups(texts):
        begins, stops = spans(raw)
        found, forms = hashes(raw, begins, stops), shapes(raw, begins, stops)
        at = np.searchsorted(begins, ends).tolist()
        for a, b in zip(at, at[1:]):
            yield found[a:b], forms[a:b]
