"""Order-preserving packing by dynamic programming over document and sentence boundaries.

Documents form one token stream in their input order. Windows of at most 2,048 tokens cut it at document ends
(free) or sentence ends (a small truncation penalty); only a sentence longer than a quarter of a window may be cut
inside, on a coarse grid and at a larger penalty. Cuts minimise padding plus penalties; since a window's padding is a difference
of positions, the best predecessor is a sliding-window minimum and a monotone queue finds it in amortised constant
time.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow
from .words import KEPT
from .words import spans as word_spans

SEQUENCE = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Truncation penalties in tokens of padding: a cut at a sentence end, a cut inside a sentence.
SENTENCE_PENALTY, HARD_PENALTY = 2, 16
#: A sentence longer than a LONG-th of a window (junk without full stops) may be cut inside, every GRID tokens.
LONG = 4
GRID = 32
#: Tokens that one dynamic program covers; the rest of its last windows goes on into the next one.
BLOCK = 1 << 19
#: Words a worker remembers before it starts afresh; its table of 2**20 slots has 32 MB.
MEMO = 400_000

#: Lower-case words of ASCII and Latin-1 letters.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: ASCII marks of which the tokenizer makes one run (not ' < > |, which it treats apart).
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<>|")
#: Classes of bytes: a mark, a letter a-z, the first and the second byte of a lower-case letter of Latin-1.
_MARK, _LETTER, _FIRST, _SECOND = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_MARKS)] = _MARK
_CLASS[97:123] = _LETTER
_CLASS[0xC3] = _FIRST
_CLASS[0x9F:0xC0] = _SECOND
_CLASS[0xB7] = 0
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Bytes of text in work at a time, and chunks that are looked up at a time.
_BYTES, _AT_ONCE = 1 << 20, 1 << 14


def spaced(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array of UTF-8 bytes with the letters of ASCII and Latin-1 in lower case and a space wherever a mark
    meets one of them (the tokenizer parts its words there anyhow) and between texts; and where their ``ends`` are then."""
    raw = _LOWER[raw]
    at = np.flatnonzero(raw[:-1] == 0xC3) + 1  # UTF-8 has this byte in front of these letters only
    second = raw[at]
    raw[at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 0x20
    kind = np.concatenate([np.zeros(2, np.uint8), _CLASS[raw], np.zeros(2, np.uint8)])
    marks = np.flatnonzero(kind == _MARK)
    before, behind = kind[marks - 1], kind[marks + 1]
    before = (before == _LETTER) | ((before == _SECOND) & (kind[marks - 2] == _FIRST))
    behind = (behind == _LETTER) | ((behind == _FIRST) & (kind[marks + 2] == _SECOND))
    at = np.sort(np.concatenate([marks[before] - 2, marks[behind] - 1, ends]))
    return np.insert(raw, at, 32), ends + np.searchsorted(at, ends, "right")


class WordTable:
    """Token ids by word, for words of up to LONGEST bytes: an open hash table in arrays, looked up by many words at once.

    A word's key is its bytes and its length, so a hit is exact. ``value`` is the place of its ids in ``pool`` times 256
    plus their number, 0 in a free slot. ``use`` empties a table with ``most`` words or more.
    """

    LONGEST = 23
    _tables: list[WordTable] = []

    def __init__(self, most: int) -> None:
        self.most, self.bits = most, (2 * most).bit_length()
        self.keys = np.zeros((3, 1 << self.bits), np.uint64)
        self.value = np.zeros(1 << self.bits, np.int64)
        self.clear()

    def clear(self) -> None:
        self.n, self.filled = 0, 0
        self.pool = np.empty(1 << 16, np.uint16)
        self.value[:] = 0

    def use(self) -> None:
        if self.n >= self.most:
            self.clear()

    def _slots(self, keys: list[np.ndarray]) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[2] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The values of words; 0 for unknown ones."""
        slot = self._slots(keys)
        found = self.value[slot]
        other = np.zeros(len(slot), bool)
        for mine, theirs in zip(self.keys, keys):
            other |= mine[slot] != theirs
        todo = np.flatnonzero(other & (found != 0))
        found[other] = 0
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            value = self.value[slot]
            same = value != 0
            for mine, theirs in zip(self.keys, keys):
                same &= mine[slot] == theirs[todo]
            found[todo[same]] = value[same]
            more = ~same & (value != 0)
            todo, slot = todo[more], slot[more]
        return found

    def put(self, ids: np.ndarray) -> int:
        """Adds ids to the pool, gives their place."""
        at, end = self.filled, self.filled + len(ids)
        if end > len(self.pool):
            self.pool = np.append(self.pool[:at], np.empty(max(end, 2 * len(self.pool)) - at, np.uint16))
        self.pool[at:end] = ids
        self.filled = end
        return at

    def add(self, keys: list[np.ndarray], value: np.ndarray) -> None:
        """New words, each once."""
        slot, todo = self._slots(keys), np.arange(len(value))
        while len(todo):
            free = np.flatnonzero(self.value[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            free = free[first]
            self.value[slot[free]] = value[todo[free]]
            for mine, theirs in zip(self.keys, keys):
                mine[slot[free]] = theirs[todo[free]]
            rest = np.ones(len(todo), bool)
            rest[free] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.n += len(value)


class WordIds:
    """Token ids of texts, as little-endian unsigned 16-bit numbers.

    The tokenizer drops white space and never joins across it, nor across the meeting of a letter and a mark, so a text's
    ids are those of its chunks in a row. Chunks are looked up by the thousand; the plain words that come anew are already
    normalised and are encoded in one call, by the model and its byte level alone, and told apart by their word-end tokens.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.table = WordTable(MEMO)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        self.ends_sentence, self.ends_word = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self.ends_sentence[[i for s, i in vocabulary.items() if re.fullmatch(r"[.!?…]+[\"')\]»”]*(</w>)?", s)]] = True
        self.ends_word[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.normalizer = normalizers.Sequence([])
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")

    def ids(self, text: bytes) -> np.ndarray:
        return next(self.all_ids(pa.array([text], pa.binary())))

    def all_ids(self, texts: pa.BinaryArray) -> Iterator[np.ndarray]:
        """The ids of each text; a null one has none. About _BYTES of text are in work at a time."""
        if not len(texts):
            return
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        raw = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + _BYTES, "right")) - 1)
            yield from self._some_ids(raw[ends[begin] : ends[end]], ends[begin : end + 1] - ends[begin])
            begin = end

    def _some_ids(self, raw: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        whole = raw.tobytes()
        # special tokens are matched before the tokenizer lower-cases, combining marks are joined before
        odd = [x for x in (b"<|", b"\xcc", b"\xcd") if x in whole]
        own = [bool(odd) and any(whole.find(x, a, b) >= 0 for x in odd) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        apart = {k: self.encode(whole[ends[k] : ends[k + 1]].decode()) for k, is_own in enumerate(own) if is_own}
        easy, ends = spaced(raw, ends)
        begins, stops = word_spans(easy)
        easy = np.append(easy, np.zeros(self.table.LONGEST + 1, np.uint8))
        parts, sizes = [np.empty(0, np.uint16)], [np.zeros(1, np.int64)]
        for at in range(0, len(begins), _AT_ONCE):
            ids, size = self._of(easy, begins[at : at + _AT_ONCE], stops[at : at + _AT_ONCE])
            parts.append(ids)
            sizes.append(size)
        ids, upto = np.concatenate(parts), np.cumsum(np.concatenate(sizes))
        places = upto[np.searchsorted(begins, ends)].tolist()
        for k, is_own in enumerate(own):
            yield apart[k] if is_own else ids[places[k] : places[k + 1]]

    def _of(self, raw: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        table, lengths = self.table, stops - begins
        table.use()
        eights = np.lib.stride_tricks.as_strided(raw[:8].view("S8"), (len(raw) - 7,), (1,))
        keys = []
        for at in (0, 8, 16):
            held = np.clip(lengths - at, 0, 8)
            keys.append(eights[np.minimum(begins + at, len(raw) - 8)].view("<u8") & KEPT[held])
        keys[2] |= lengths.astype(np.uint64) << np.uint64(56)
        long = lengths > table.LONGEST
        value = table.find(keys)
        value[long] = 0
        missing = np.flatnonzero(value == 0)
        where, number = value >> 8, value & 255
        if len(missing):
            chunks = [raw[a:b].tobytes() for a, b in zip(begins[missing].tolist(), stops[missing].tolist())]
            first: dict[bytes, int] = {}
            which = np.array([first.setdefault(c, len(first)) for c in chunks])
            learnt = self._learn(list(first))
            flat, count = np.concatenate(learnt), np.array([len(x) for x in learnt])
            place = table.put(flat) + np.cumsum(count) - count
            where[missing], number[missing] = place[which], count[which]
            _, one = np.unique(which, return_index=True)
            keep = ~long[missing[one]] & (count > 0)
            one = missing[one[keep]]
            table.add([k[one] for k in keys], where[one] << 8 | number[one])
        total = np.cumsum(number)
        at = np.arange(total[-1]) + np.repeat(where - (total - number), number)
        return table.pool[at], number

    def _learn(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of chunks; plain words in one call."""
        plain = [c for c in chunks if (c.islower() and c.isalpha()) or _PLAIN.fullmatch(c)]
        known: dict[bytes, np.ndarray] = {}
        if plain:
            ids = np.array(self.bare.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u2")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) == len(plain):  # or else a vocabulary in which some word has no single end
                known = {c: ids[a:b] for c, a, b in zip(plain, [0, *ends], ends)}
        return [known[c] if c in known else self.encode(c.decode()) for c in chunks]

_word_ids: dict[str, WordIds] = {}


def word_ids(path: str | None) -> WordIds:
    """The worker's tokenizer; a bare or missing path means the installed vocabulary files."""
    if path not in _word_ids:
        import public_tokenizers

        _word_ids[path] = WordIds(path or public_tokenizers.path(TOKENIZER))
    return _word_ids[path]


def cut_points(stream: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a token stream where a window may end, from 0 on, and their penalties.

    These are the ends of documents and sentences; only where the next one is more than a LONG-th of ``size`` away there
    are others between.
    """
    kind = np.zeros(len(stream) + 1, np.uint8)
    kind[1:] = ends_sentence[stream]
    kind[doc_ends - 1] = 0  # not between a document and its end id
    kind[doc_ends] = 2
    points = np.flatnonzero(kind)
    penalty = np.where(kind[points] == 2, 0, SENTENCE_PENALTY)
    long = np.flatnonzero(np.diff(points, prepend=0) > max(size // LONG, 1))
    if len(long):
        step = max(1, min(GRID, size // LONG))
        hard = np.concatenate([np.arange((points[k - 1] if k else 0) + step, points[k], step) for k in long])
        points, penalty = np.append(points, hard), np.append(penalty, np.full(len(hard), HARD_PENALTY))
        order = np.argsort(points, kind="stable")
        points, penalty = points[order], penalty[order]
    return np.append(0, points), np.append(0, penalty)


def best_cuts(points: list[int], penalties: list[int], size: int = SEQUENCE) -> list[int]:
    """Indices into ``points`` (ascending; point 0 is the start, the last one the end) that end the windows.

    f(j) = penalty(j) + min over i with points[j] - points[i] <= size of f(i) + size - (points[j] - points[i]).
    Equal costs keep the earliest predecessor, so the result is one fixed choice.
    """
    cost = [0] * len(points)
    back = [0] * len(points)
    queue: deque[tuple[int, int]] = deque([(points[0], 0)])  # (f(i) + points[i], i), values ascending
    for j in range(1, len(points)):
        at = points[j]
        while points[queue[0][1]] < at - size:
            queue.popleft()
        low, back[j] = queue[0]
        here = low + size - at + penalties[j]
        cost[j] = here
        here += at
        while queue and queue[-1][0] > here:
            queue.pop()
        queue.append((here, j))
    cuts, j = [], len(points) - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


PIECE = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs the documents of one task; each ``add`` may give finished pieces, ``finish`` gives the rest."""

    def __init__(self, first_sequence: int, ends_sentence: np.ndarray, size: int = SEQUENCE, block: int = BLOCK) -> None:
        self.sequence, self.ends_sentence, self.size, self.block = first_sequence, ends_sentence, size, block
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, ids, tokens already packed
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.waiting += len(ids)
        return self._pack(False) if self.waiting >= self.block else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.docs else []

    def _pack(self, last: bool) -> list[tuple]:
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        doc_ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        points, penalties = cut_points(stream, doc_ends, self.ends_sentence, self.size)
        flat, at, starts = points.tolist(), len(stream), [0, *doc_ends.tolist()]
        cuts = [flat[j] for j in best_cuts(flat, penalties.tolist(), self.size)]
        if not last:
            cuts = cuts[:-4]  # the last windows may change with what comes next
        out, k, begin = [], 0, 0
        for end in cuts:
            offset = 0
            while k < len(self.docs) and begin < end:
                doc_id, ids, done = self.docs[k]
                stop = min(end, starts[k] + len(ids) - done)
                start = begin - starts[k] + done
                piece = ids[start : start + stop - begin].astype("<u4")
                out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), self.sequence, offset))
                offset += stop - begin
                begin = stop
                if stop == starts[k] + len(ids) - done:
                    k += 1
            self.sequence += 1
        rest = self.docs[k:]
        if rest and begin > starts[k]:
            doc_id, ids, done = rest[0]
            rest[0] = (doc_id, ids, done + begin - starts[k])
        self.docs = rest
        self.waiting = at - begin
        return out


def pack_batches(batches: Iterable[pa.RecordBatch], path: str | None, first_sequence: int, size: int = SEQUENCE) -> Iterator[pa.RecordBatch]:
    words = word_ids(path)
    end = np.array([END_ID], "<u2")
    packer = Packer(first_sequence, words.ends_sentence, size)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECE.types)], schema=PIECE)

    for b in batches:
        for doc_id, ids in zip(b.column(0).to_pylist(), words.all_ids(b.column(1).cast(pa.binary()))):
            rows = packer.add(doc_id, np.concatenate([ids, end]))
            if rows:
                yield batch(rows)
    rows = packer.finish()
    if rows:
        yield batch(rows)


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pieces of the documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs its own rows in their order and pads only its last sequence beyond what the cuts leave, so no
    text is shuffled. ``sequence_id`` is the task's partition times 2**32 plus a running number: unique, ordered
    and the same when a lost task is run again. A null or empty text is the end id alone. Repeated rows are
    packed each. A task holds about BLOCK tokens besides its current document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack_batches(batches, tokenizer_path, TaskContext.get().partitionId() << 32, size)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECE_DDL)


def op3_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` of all documents in their stored order."""
    return pack(documents(spark, sf_dir, in_order=True))
