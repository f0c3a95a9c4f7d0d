"""Personal data: fixed patterns plus information-theoretic sanitisation.

Mail addresses, IP addresses, card and phone numbers are protected entities. A term in a document with an entity
reveals it as far as their co-occurrence in the corpus says: disclosure = PMI(entity, term) / IC(entity), which is
1 for a term that occurs with the entity only and near 0 for an ordinary word. Meetings and frequencies count whole
documents. Terms above one threshold are generalised, those above a second one removed, wherever they stand in a
document with the entity.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_PARTS, Memo, documents, join_groups, map_arrow, ship, staged

Span = tuple[int, int, str]

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# digit runs are taken whole by a match, so the look-behind only saves trying a run again from its middle
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A term: a maximal run of three letters or more.
TERM = re.compile(r"[^\W\d_]{3,}")

#: Added to both frequencies of a pair that meets in one document only: one meeting tells the less, the smaller the corpus.
#: No pair is left out for it; with the usual thresholds a word of one document is generalised from 243 documents on.
SINGLE = 2
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.6, 0.9
#: Words a worker remembers.
TERM_MEMO = 400_000


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ backwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255; leading zeros, however many, don't count."""
    value = digits.lstrip("0")
    return len(value) < 3 or len(value) == 3 and value <= "255"


def base_spans(text: str) -> list[Span]:
    """The fixed patterns: (start, end, kind), by kind and then start."""
    found: list[Span] = [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text) is None:
        return found
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode()) - (1 << 63)


def placed_terms(text: str, spans: list[Span]) -> dict[int, list[int]]:
    """By term hash, start and end of every place of the term in the whole text that overlaps no entity, one after the other."""
    out: dict[int, list[int]] = {}
    held, k = sorted((a, b) for a, b, _ in spans), 0
    known: dict[str, int] = {}
    busy = 0
    for m in TERM.finditer(text):
        s, e = m.span()
        while k < len(held) and held[k][0] < e:
            busy = max(busy, held[k][1])
            k += 1
        if s < busy:
            continue
        word = m[0]
        t = known.get(word)
        if t is None:
            t = known[word] = _hash(word.lower())
        out.setdefault(t, []).extend((s, e))
    return out


def entities_of(text: str, spans: list[Span]) -> list[int]:
    return sorted({_hash(kind + ":" + text[a:b].lower()) for a, b, kind in spans})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


#: ``row`` is a hash of the text: rows that share a doc_id but not the text are different documents.
SCAN = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base string, e array<long>"
#: A row a document and term: the entities it may disclose there, and its places.
NEAR = "doc_id long, row long, t long, e array<long>, at array<int>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, held = [], []
        for value in b.column(1):
            text = value.as_py() or ""
            spans = base_spans(text)
            rows.append((_hash(text), *(sum(s[2] == k for s in spans) for k in KINDS), joined(spans)))
            held.append(entities_of(text, spans))
        arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)] + [pa.array([r[5] for r in rows], pa.string()), pa.array(held, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base", "e"])


_known = Memo(TERM_MEMO)


def _known_terms() -> Memo:
    """A function of the module, so that workers reach their own memo and not a pickled copy."""
    return _known


def _document_frequency(docs: DataFrame) -> DataFrame:
    """t, df over all whole texts for every term; counted a batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known_terms()
        for b in batches:
            known.use()
            seen: dict[int, int] = {}
            for value in b.column(0):
                text = value.as_py()
                if not text:
                    continue
                found = set()
                for word in set(TERM.findall(text)):
                    t = known.get(word)
                    if t is None:
                        t = _hash(word.lower())
                        if len(known) < known.most:
                            known[word] = t
                    found.add(t)
                for t in found:
                    seen[t] = seen.get(t, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["t", "n"])

    return map_arrow(docs.select("text"), count, "t long, n long").groupBy("t").agg(F.sum("n").alias("df"))


def _meetings(docs: DataFrame, entities: DataFrame, terms: DataFrame, total: int, least: float) -> DataFrame:
    """NEAR rows of all entities and terms in one document, but for pairs whose frequencies keep them below ``least``.

    A pair can't meet more often than its entity, so it reaches ``least`` only with df <= df_e**least * total**(1 - least).
    For an entity that isn't hot this leaves out common terms; those and the hot entities are a number of mean
    document lengths, whatever the corpus, and are sent to the workers.
    """
    limit = max(total // HOT_PARTS, 1)

    def bound(df_e: int) -> float:
        return df_e**least * total ** (1 - least) * (1 + 1e-9)

    usual = bound(limit)
    hot = {r.e: bound(r.df_e) for r in entities.filter(F.col("df_e") > limit).collect()}
    common = {r.t: r.df for r in terms.filter(F.col("df") > usual).collect()}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, ts, es, ats = [], [], [], [], []
            for i, value in zip(b.column(0), b.column(1)):
                text = value.as_py() or ""
                spans = base_spans(text)
                if not spans:
                    continue
                doc, row, held = i.as_py(), _hash(text), entities_of(text, spans)
                for t, at in placed_terms(text, spans).items():
                    df = common.get(t)
                    told = held if df is None else [e for e in held if df <= hot.get(e, usual)]
                    if told:
                        ids.append(doc)
                        rows.append(row)
                        ts.append(t)
                        es.append(told)
                        ats.append(at)
            arrays = [*(pa.array(x, pa.int64()) for x in (ids, rows, ts)), pa.array(es, pa.list_(pa.int64())), pa.array(ats, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "t", "e", "at"])

    return staged(map_arrow(docs.select("doc_id", "text"), meet, NEAR), "pii-near")


def _attached(rows: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``stats`` of their key, also where many rows share one."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("__size"))
    return join_groups(rows, stats.join(sizes, key), [key], "__size", max(rows.count(), 1)).drop("__size")


def _disclosing(docs: DataFrame, scan: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The pairs e, t, joint, disclosure from ``least`` on, and the NEAR rows they come from."""
    total = max(scan.count(), 1)
    entities = staged(scan.select(F.explode("e").alias("e")).groupBy("e").agg(F.count("*").alias("df_e")), "pii-entities")
    terms = staged(_document_frequency(docs), "pii-terms")
    near = _meetings(docs, entities, terms, total, least)
    joint = staged(near.select("t", F.explode("e").alias("e")).groupBy("e", "t").agg(F.count("*").alias("joint")), "pii-joint")
    more = F.when(F.col("joint") == 1, SINGLE).otherwise(0)
    pmi = F.log2(F.col("joint") * total / ((F.col("df_e") + more) * (F.col("df") + more)))
    ic = F.log2(total / F.col("df_e"))
    pairs = _attached(_attached(joint, entities, "e"), terms, "t")
    pairs = pairs.select("e", "t", "joint", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("disclosure"))
    return pairs.filter(F.col("disclosure") >= least), near


def disclosures(docs: DataFrame, scan: DataFrame) -> DataFrame:
    """e, t, joint, disclosure for every entity and term that meet not less than by chance, the best founded last."""
    return _disclosing(docs, scan, 0.0)[0].orderBy("joint", "e", "t")


def _found(docs: DataFrame, generalise: float, remove: float) -> DataFrame:
    """What ``find_pii`` returns, and ``row``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = staged(map_arrow(docs, _scan, SCAN), "pii-scan")
    risky, near = _disclosing(docs, scan, generalise)
    risky = staged(risky, "pii-risky")
    key = [F.coalesce("doc_id", F.lit(0)).alias("__id"), "row"]
    near = near.select(*key, "t", F.explode("e").alias("e"), "at")
    hits = join_groups(near, risky, ["e", "t"], "joint", max(near.count(), 1))
    worst = hits.groupBy("__id", "row", "t", "at").agg(F.max("disclosure").alias("d"))
    places = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("at"), 1) - 1), lambda k: F.struct(F.get("at", 2 * k).alias("a"), F.get("at", 2 * k + 1).alias("b")))
    worst = worst.select("__id", "row", "d", F.explode(places).alias("x")).select("__id", "row", "d", "x.*")
    kind = F.when(F.col("d") >= remove, F.lit(1)).otherwise(F.lit(0))
    terms = worst.groupBy("__id", "row").agg(F.array_sort(F.collect_set(F.struct(kind.alias("k"), "a", "b"))).alias("terms"))
    text = F.transform("terms", lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, TERM_KINDS)), x["k"] + 1), x["a"], x["b"]))
    return (
        scan.drop("e").withColumn("__id", key[0])
        .join(terms, ["__id", "row"], "left")
        .select(
            "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"),
            F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(text, ",")).alias("spans"),
            F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"), "row",
        )
    )


def find_pii(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """A row a document: doc_id, counts by kind, base_sha256, spans, n_terms; whole texts, null as empty.

    ``spans`` holds the base spans by kind and start, then terms to generalise, then terms to remove, as
    ``kind:start:end`` in code points. Statistics cover all documents, repeated rows each. Documents without an entity
    have no spans. Rows with one doc_id and different texts, or without an id, have their own spans. An empty table
    gives no rows; extra columns are ignored.
    """
    return _found(docs, generalise, remove).drop("row")


#: What a generalised term becomes: the class of strings that it belongs to.
CLASSES = (("[ACRONYM]", str.isupper), ("[NAME]", str.istitle), ("[WORD]", str.islower))


def general(term: str) -> str:
    return next((name for name, fits in CLASSES if fits(term)), "[TERM]")


def redact(text: str, spans: str) -> str:
    """The text without its personal data: entities become their kind, generalised terms their class, other terms go."""
    marks = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in marks:
        if a < at:
            continue
        out += [text[at:a], "" if kind == "remove" else general(text[a:-b]) if kind == "generalise" else f"[{kind.upper()}]"]
        at = -b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with sanitised text, row by row and with all columns. Null texts stay null."""
    ship(docs.sparkSession)

    @F.udf("string", useArrow=True)
    def clean(text: str | None, marks: str | None) -> str | None:
        return redact(text, marks) if text and marks else text

    @F.udf("long", useArrow=True)
    def row_of(text: str | None) -> int:
        return _hash(text or "")

    found = _found(docs, generalise, remove).filter("spans != ''").select("doc_id", "row", "spans").distinct()
    marks = found.select(F.struct(F.col("doc_id").alias("i"), F.col("row").alias("r")).alias("__key"), F.col("spans").alias("__marks"))
    whole = docs.select(F.struct(*docs.columns).alias("__row")).withColumn("__key", F.struct(F.col("__row.doc_id").cast("long").alias("i"), row_of("__row.text").alias("r")))
    cleaned = whole.join(marks, whole["__key"].eqNullSafe(marks["__key"]), "left").withColumn("__clean", clean("__row.text", "__marks"))
    return cleaned.select(*(F.col("__clean").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find_pii`` of all documents."""
    return find_pii(documents(spark, sf_dir))
