"""Secret scan: fixed patterns plus dictionary-primed zstandard novelty.

A candidate string in a sensitive context is compressed with a dictionary made of the corpus's identifiers and
the text around it. A name, a path or repeated code costs far less than a random string of its alphabet and length;
what still costs nearly as much is new information, as keys and passwords are, and is reported. zstandard stores a
short string's letters as they are, so an unseen word costs as much as a password there; strings must also be
surprising letter by letter, given the letter pairs of the identifiers. Numbers, dates and UUIDs are not reported.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow

Span = tuple[int, int, str]

KINDS = ("assign", "access", "hex")
#: Spans that only the novelty measure finds.
NOVEL = "novel"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# runs of a class are maximal, so the look-behind only saves trying a run again from its middle
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

SENSITIVE = re.compile(r"(?:passw|passphrase|secret|token|api_?key|auth|credential|private|bearer|access_?key|client_id)", re.I | re.A)
_SENSITIVE_PARTS = ("passw", "passphrase", "secret", "token", "key", "auth", "credential", "private", "bearer", "client_id")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A name that stands alone: no piece of a longer string, so the letter runs of a key are none.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z_-]{3,31}(?![A-Za-z0-9+/_=-])")

#: What stands between spaces and quotes, without punctuation at its ends.
TOKEN = re.compile(r"""[^\s"'`]+""")
_TOKEN_START = re.compile(r"""[^\s"'`]""")
_EDGE = ".,;:()[]{}<>"
LEAST = 8
#: The rest of a name with a sensitive word, up to its value in the same token.
_ASSIGNED = re.compile(r"[A-Za-z0-9_-]*[:=]+")
KEY_LINE = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_=-]+)[\x20\t]*(?=\r?\n|\Z)")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")

#: A candidate starts at most REACH characters behind a sensitive word, or ends so far before one.
REACH = 48
#: Bits a character, given the one before, from which a candidate is surprising: of any shape, and a run of 16 or more
#: letters and digits, whose mean scatters less; at most log2(95) count.
SURPRISE, SURPRISE_RUN = 5.5, 5.0
#: Letters without which a token is a number, a date or the like.
LETTERS = 3
#: Identifiers by design: not secret, though random.
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Common words that the letter pairs start from, so that a small corpus has some too.
PRIMER = (
    "the and that with this from have which their would there about could other after first should because between through "
    "password secret token authorization credentials private bearer client user account name value string return request "
    "response header session service config default function message number system public version license information "
    "author written document example settings access control manager handler create update delete application database "
    "nicht werden einen durch gegen zwischen schreiben dans pour avec cette comme entre porque como para sobre desde entre"
)
#: Text on both sides that primes the dictionary, and that identifiers are gathered from.
AROUND = 256
#: Share of what a random string of the same alphabet and length costs from which a candidate is new information.
NOVELTY = 0.8
#: The identifier dictionary is the TOP most widespread identifiers (a top-k list of about 32 KB at most).
TOP = 2000


def base_spans(text: str) -> list[Span]:
    """The fixed patterns: (start, end, kind), by start and then kind."""
    found: list[Span] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def contexts(text: str) -> list[tuple[int, int]]:
    """The sensitive words of a text."""
    low = text.lower()
    return [m.span() for m in SENSITIVE.finditer(text)] if any(p in low for p in _SENSITIVE_PARTS) else []


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Strings of letters and digits closely behind a sensitive word that overlap no span in ``taken``.

    A string that is out of reach is kept for the next words, so a text is read once.
    """
    out, at = [], 0
    covered, k = merged(taken), 0
    m = None
    for _, end in contexts(text):
        while True:
            if m is None or m.start() < max(end, at):
                m = CANDIDATE.search(text, max(end, at))
                if m is None:
                    return out
            if m.start() > end + REACH:
                break
            at = m.end()
            while k < len(covered) and covered[k][1] <= m.start():
                k += 1
            free = k == len(covered) or covered[k][0] >= at
            if free and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
                out.append(m.span())
    return out


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """What the spans cover, in order and without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def tokens(text: str, taken: list[Span]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Tokens of LEAST characters or more of any shape on both sides of the sensitive words, and the lines of keys.

    What ``taken`` covers is left out, and so are the names that hold a sensitive word; their values are not.
    """
    words, found, lines, seen = contexts(text), [], [], 0
    for a, e in words:
        low = max(0, a - REACH)
        while low > seen and TOKEN.match(text, low - 1, low):
            low -= 1  # the start of a token that ends in reach
        while (start := _TOKEN_START.search(text, max(low, seen), e + REACH + 1)) is not None:
            m = TOKEN.match(text, start.start())
            seen = m.end()
            found.append(m.span())
    spans, k, j = [], 0, 0
    covered = merged(taken)
    for s, e in found:
        while k < len(words) and words[k][1] <= s:
            k += 1
        if "-----" in text[s:e]:
            continue
        if k < len(words) and words[k][0] < e:
            value = _ASSIGNED.match(text, words[k][1], e)
            if value is None:
                continue
            s = value.end()
        while j < len(covered) and covered[j][0] < e:
            s = max(s, min(covered[j][1], e))
            if covered[j][1] > e:
                break
            j += 1
        while s < e and text[s] in _EDGE:
            s += 1
        while s < e and text[e - 1] in _EDGE:
            e -= 1
        if e - s >= LEAST:
            spans.append((s, e))
    at, end = 0, 0
    for m in PEM.finditer(text):
        if 0 <= end < m.end():
            end = text.find("-----END", m.end())
        at = max(at, m.end())
        while (line := KEY_LINE.search(text, at, end if end >= 0 else min(len(text), at + AROUND))) is not None:
            lines.append(line.span(1))
            at = line.end()
    for s, e in spans:
        at = max(at, e) if e - s >= 2 * LEAST else at
        while at == e and (line := KEY_LINE.match(text, at)) is not None:
            if line.start(1) < e or not any(c.isdigit() for c in line[1]) and len(line[1]) < 2 * LEAST:
                break
            lines.append(line.span(1))
            at = e = line.end()
    return spans, sorted(set(lines))


def letter_pairs(identifiers: bytes) -> list[list[float]]:
    """Bits of each ASCII character after each other one, from PRIMER and the identifiers; lower-case for both cases."""
    counts = [[0.0] * 128 for _ in range(128)]
    single = [0.5] * 128
    text = f" {PRIMER} {identifiers.decode(errors='ignore')} ".lower()
    for x, y in zip(text, text[1:]):
        if x < "\x80" and y < "\x80":
            counts[ord(x)][ord(y)] += 1
            single[ord(y)] += 1
    total, most = sum(single), math.log2(95)
    return [[min(most, -math.log2((c + 4 * single[y] / total) / (sum(row) + 4))) for y, c in enumerate(row)] for row in counts]


def surprise(token: str, pairs: list[list[float]]) -> float:
    """Bits a character; a change to upper case inside a word counts as unknown, other letters as ordinary ones."""
    bits, before = 0.0, " "
    for c in token:
        low = c.lower()[:1]
        if c >= "\x80" or before >= "\x80":
            bits += 4
        elif c.isupper() and before.islower():
            bits += math.log2(95)
        else:
            bits += pairs[ord(before.lower())][ord(low)]
        before = c
    return bits / len(token)


_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/=", string.ascii_letters + string.digits + "-_=")


def _cost(secret: bytes, dictionary: bytes) -> int:
    """Compressed bytes that the secret adds, given the dictionary."""
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=12, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(squeeze.compress(secret)) - len(squeeze.compress(b""))


@lru_cache(maxsize=4096)
def _random_cost(alphabet: int, length: int) -> float:
    """Mean cost a byte of random strings: zstandard codes long ones down to their alphabet's entropy."""
    letters = _ALPHABETS[alphabet] if alphabet < len(_ALPHABETS) else string.printable[:94]
    rng = random.Random(length * 16 + alphabet)
    drawn = ["".join(rng.choices(letters, k=length)).encode() for _ in range(3)]
    return sum(_cost(x, b" ") for x in drawn) / (3 * length)


def novelty(text: str, start: int, end: int, identifiers: bytes) -> float:
    """Compressed bytes that the candidate adds, given the identifiers and the text around it, as a share of what a random
    string of the same alphabet and length adds. Further copies of the candidate nearby don't count as known."""
    found = text[start:end]
    around = (text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]).replace(found, " ")
    used = set(found)
    alphabet = next((k for k, letters in enumerate(_ALPHABETS) if used <= set(letters)), len(_ALPHABETS))
    secret = found.encode()
    length = len(secret) if len(secret) < 128 else len(secret) // 64 * 64
    return _cost(secret, identifiers + b"\n" + around.encode() + b"\n") / len(secret) / _random_cost(alphabet, min(length, 1 << 14))


def all_spans(text: str, identifiers: bytes, threshold: float = NOVELTY, pairs: list[list[float]] | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the novel ones, each in report order; ``pairs`` are those of ``identifiers``."""
    base = base_spans(text)
    if not contexts(text):
        return base, base
    pairs = pairs or letter_pairs(identifiers)
    shaped, lines = tokens(text, base)
    novel: list[Span] = []
    held = merged(base)
    found = [(0.0, x) for x in lines] + [(SURPRISE, x) for x in shaped] + [(SURPRISE_RUN, x) for x in candidates(text, base)]
    for least, (a, b) in found:
        k = bisect_left(held, (b,))
        if k and held[k - 1][1] > a:
            continue
        if least and (sum(c.isalpha() for c in text[a : min(b, a + 64)]) < LETTERS or _UUID.fullmatch(text, a, b)):
            continue
        if surprise(text[a:b], pairs) >= least and novelty(text, a, b, identifiers) >= threshold:
            novel.append((a, b, NOVEL))
            insort(held, (a, b))
    order = {k: i for i, k in enumerate((*KINDS, NOVEL))}
    return base, sorted(base + novel, key=lambda s: (s[0], order[s[2]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _identifiers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: Counter[str] = Counter()
        for text in b.column(0):
            t = text.as_py()
            if t:
                words: set[str] = set()
                for a, e in merged([(max(0, a - AROUND), e + AROUND, "") for a, e in contexts(t)]):
                    words.update(IDENTIFIER.findall(t, a, e))
                seen.update(words)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def identifier_dictionary(docs: DataFrame, top: int = TOP) -> bytes:
    """The most widespread identifiers near sensitive words, over all documents; ties by the word itself.

    Only names without digits in at least two documents count, so no single secret primes its own dictionary.
    """
    counts = map_arrow(docs.select("text"), _identifiers_of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    best = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(top).collect()]
    return " ".join(reversed(best)).encode()  # zstandard reaches the end of a dictionary most cheaply


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def scan_secrets(docs: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    """A row a document: doc_id, counts by kind, base_sha256, spans, n_novel; whole texts, null as empty.

    Spans are code points ``kind:start:end``, end exclusive. Documents without any span have empty ``spans``.
    Time is linear in a text's length. Repeated rows are scanned each and alike; an empty table gives no rows. Extra
    columns are ignored, whatever their names.
    """
    identifiers = identifier_dictionary(docs)
    pairs = letter_pairs(identifiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                base, spans = all_spans(text.as_py() or "", identifiers, threshold, pairs)
                n = Counter(kind for _, _, kind in spans)
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[NOVEL]))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array([r[k] for r in rows], kinds[k]) for k in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan_secrets`` of all documents."""
    return scan_secrets(documents(spark, sf_dir))
