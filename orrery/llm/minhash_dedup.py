"""Near-duplicate detection: banded MinHash, sequential Bayesian verification, exact confirmation.

Documents with the same shingle set form one class. Classes that share a band of their signatures are
candidates. A candidate pair's signatures are compared batch by batch and the pair is dropped as soon as the
posterior probability that its similarity reaches the threshold is below the chosen miss probability. Survivors
are confirmed on their full shingle sets; confirmed links are closed into components.

Within a band's bucket pairs are not enumerated. Two rounds compare members with the bucket's smallest member
only. Pairs that the posterior bounds keep join documents to families; what a family's components don't cover yet
is compared inside tasks, block against block, and only new links leave a task. Last, members of one bucket that
belong to different families are compared, once for the first band that they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_groups, map_arrow, ship, staged
from .components import components
from .words import lowered_hashes, mix

#: 32 bands of 4 rows: a pair at similarity 0.8 misses every band with probability 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the probability of dropping a pair that reaches the threshold.
BATCH, MISS = 32, 1e-6
#: Members of a group outside and inside its largest part that one task compares.
MINOR, MAJOR = 512, 1024
#: Slots of a bit table a wanted document, and the table's size up to which it is sent to every worker (16 MB).
SPARE, MAX_TABLE_BITS = 8, 27

_random = np.random.default_rng(20240229)
_A = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_M3 = np.uint64(0x9E3779B97F4A7C15)


def shingled(h: np.ndarray, words: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of the ``words``-word shingles of a text, given its words' hashes.

    With fewer words than that the whole sequence is the one shingle; without words the set is empty.
    """
    if not len(h):
        return np.empty(0, np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * _M3 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """``shingled`` of one text; A-Z are lower-cased, ASCII white space separates."""
    return shingled(next(lowered_hashes(pa.array([text], pa.binary()))), words)


def signature(values: np.ndarray) -> np.ndarray:
    """HASHES minima, 32 bits each, of a non-empty set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        np.minimum(low, (values[at : at + 1024, None] * _A + _B).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for part in sig.reshape(BANDS, ROWS).T:
        key = mix(key * _M3 + part)
    return key.view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sig binary"


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, sets, bands, sigs = [], [], [], []
            for h in lowered_hashes(b.column(1).cast(pa.binary())):
                s = shingled(h, words)
                size.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s) if len(s) else None
                bands.append(None if sig is None else band_keys(sig))
                sigs.append(None if sig is None else sig.astype("<u2").tobytes())  # 16 bits tell a match from chance
            arrays = [pa.array(size, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "n_shingles", "set_hash", "bands", "sig"])

    return run


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For BATCH, 2 BATCH, ... compared hashes the fewest matches that keep a pair.

    With a uniform prior, m matches of n leave the similarity Beta(m + 1, n - m + 1), which reaches the threshold
    t with probability P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m, below = 0, (1 - threshold) ** (n + 1)
        while below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def plausible(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of two signature tables that no posterior bound excludes; later batches only look at what is left."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for k, need in enumerate(least):
        at = slice(k * BATCH, (k + 1) * BATCH)
        matches += (left[alive, at] == right[alive, at]).sum(axis=1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _posterior(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = pa.array(plausible(_table(b.column(2)), _table(b.column(3)), least))
                yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    return run


def _slot(bits: int) -> Column:
    return F.expr(f"shiftrightunsigned(xxhash64(doc_id), {64 - bits})").alias("slot")


class Verifier:
    """Turns candidate pairs (a, b) into confirmed links."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, percent: int, miss: float) -> None:
        self.docs, self.reps, self.words, self.percent = docs, reps, words, percent
        self.least = least_matches(percent / 100, miss)

    def bayes(self, pairs: DataFrame) -> DataFrame:
        sig = self.reps.select("doc_id", "sig")
        joined = pairs.join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b")
        joined = joined.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a")
        return map_arrow(joined.select("a", "b", "x", "y"), _posterior(self.least), "a long, b long")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """doc_id, set of the documents in ``wanted`` (distinct doc_id) and, by chance, of a few others.

        A bit table with SPARE slots a wanted document spares the other texts the work; a wish for more documents than
        fit a table that may be sent to every worker is a join by id.
        """
        count, bits = self.words, max(16, (SPARE * wanted.count() - 1).bit_length())
        table = self._bits(wanted, bits) if bits <= MAX_TABLE_BITS else None
        docs = self.docs if table is not None else self.docs.join(wanted, "doc_id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slot = b.column(2).to_numpy()
                at = np.arange(len(slot)) if table is None else np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                at = pa.array(at)
                texts = b.column(1).take(at).cast(pa.binary())
                sets = pa.array([shingled(h, count).tobytes() for h in lowered_hashes(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), sets], ["doc_id", "set"])

        return map_arrow(docs.select("doc_id", "text", _slot(bits)), run, "doc_id long, set binary")

    @staticmethod
    def _bits(wanted: DataFrame, bits: int) -> np.ndarray:
        """The slots of the wanted documents as bits of bytes; made by words of 64 slots, 2**(MAX_TABLE_BITS - 6) at most."""
        slots = wanted.select(_slot(bits)).distinct()
        word = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        held = word.toArrow()
        table = np.zeros(1 << (bits - 6), "<i8")
        table[np.asarray(held["word"])] = np.asarray(held["bits"])
        return table.view(np.uint8)

    def links(self, left: DataFrame) -> DataFrame:
        """The pairs whose full sets reach the threshold."""
        sets = self.sets(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        joined = left.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
        joined = joined.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
        return staged(map_arrow(joined.select("a", "b", "x", "y"), _confirm(self.percent), "a long, b long").distinct(), "mh-links")


def _blocks(least: list[int]):
    """Pairs across families in two blocks of one bucket that survive the posterior bounds."""

    def run(group: pa.Table) -> pa.Table:
        side = np.asarray(group["side"])
        ids, family, sig = np.asarray(group["doc_id"]), np.asarray(group["family"]), _table(group["sig"].combine_chunks())
        bands = np.asarray(group["bands"].combine_chunks().flatten()).reshape(-1, BANDS)
        here = int(np.flatnonzero(bands[0] == group["key"][0].as_py())[0])
        first, second = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)  # side 1: a block with itself
        left, right = [], []
        for k in first:
            other = second[(family[second] != family[k]) & ((ids[second] > ids[k]) | (side[k] == 0))]
            # a pair meets once, in the first band that it shares
            other = other[np.argmax(bands[other] == bands[k], axis=1) == here]
            if len(other):
                hit = other[plausible(np.broadcast_to(sig[k], (len(other), HASHES)), sig[other], least)]
                left += [ids[k]] * len(hit)
                right += ids[hit].tolist()
        a, b = np.minimum(left, right), np.maximum(left, right)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _family_links(least: list[int], percent: int):
    """Links between components in two blocks of one family: bounds first, then exact; one link joins two components."""

    def run(group: pa.Table) -> pa.Table:
        side = np.asarray(group["side"])
        ids, root, sig = np.asarray(group["doc_id"]), np.asarray(group["component"]).copy(), _table(group["sig"].combine_chunks())
        sets = [np.frombuffer(x, "<u8") for x in group["set"].to_pylist()]
        rows, cols = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
        sizes = np.array([len(x) for x in sets])
        values = np.concatenate([sets[c] for c in cols]) if len(cols) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(cols)), sizes[cols])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        left, right = [], []
        for r in rows:
            other = np.flatnonzero(root[cols] != root[r])
            if len(other):
                other = other[plausible(np.broadcast_to(sig[r], (len(other), HASHES)), sig[cols[other]], least)]
            if not len(other):
                continue
            begin, end = np.searchsorted(values, sets[r], "left"), np.searchsorted(values, sets[r], "right")
            count = end - begin
            at = np.repeat(begin - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(cols))[other]
            for c in cols[other[100 * both >= percent * (sizes[r] + sizes[cols[other]] - both)]]:
                if root[c] != root[r]:
                    left.append(min(ids[r], ids[c]))
                    right.append(max(ids[r], ids[c]))
                    root[root == root[c]] = root[r]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _dealt(rows: DataFrame, group: str, part: str) -> DataFrame:
    """group, i, j, side, doc_id, part of groups with several parts, for every pair of blocks to compare across parts.

    A group's largest part is cut into MAJOR blocks, all else into MINOR blocks. Minor blocks meet each other,
    themselves and the major blocks; major blocks need not meet.
    """
    rows = staged(rows.select(group, part, "doc_id"), "mh-parts")
    sizes = rows.groupBy(group, part).agg(F.count("*").alias("m"))
    plan = sizes.groupBy(group).agg(
        F.count("*").alias("parts"), F.sum("m").alias("all"), F.max("m").alias("top"), F.max(F.struct("m", F.col(part).alias("p"))).getField("p").alias("major")
    ).filter("parts > 1")
    plan = plan.select(group, "all", "major", F.ceil((F.col("all") - F.col("top")) / MINOR).cast("int").alias("minors"), F.ceil(F.col("top") / MAJOR).cast("int").alias("majors"))
    rows = join_groups(rows, plan, [group], "all", max(rows.count(), 1))
    inside = F.col(part) == F.col("major")
    rows = rows.withColumn("block", F.when(inside, F.col("minors") + F.pmod(F.xxhash64("doc_id"), "majors")).otherwise(F.pmod(F.xxhash64("doc_id"), "minors")).cast("int"))
    last = F.when(inside, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1
    meets = F.transform(
        F.sequence(F.lit(0), last),
        lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j"), F.when(o == F.col("block"), 1).when(F.col("block") < o, 0).otherwise(2).alias("side")),
    )
    return rows.withColumn("to", F.explode(meets)).select(group, "to.i", "to.j", "to.side", "doc_id", part)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable and ``kept`` marks the document that has it. Null, empty and blank texts have
    empty sets, are linked with nothing and kept. Equal sets are linked, so exact copies and repeated rows fall
    together. Two rows with one doc_id must have equal texts to be told apart from a changed copy, and rows without an
    id are linked with nothing and have no component; ``drop_near_duplicates`` has no such bounds. An empty table
    gives no rows; extra columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(map_arrow(docs, _sign(words), SIGNED), "mh-signed")
    rows = signed.select("doc_id", "n_shingles", "set_hash").filter("n_shingles > 0")
    classes = staged(rows.groupBy("set_hash").agg(F.count("*").alias("size"), F.min("doc_id").alias("rep")), "mh-classes")
    own = classes.select("set_hash", F.col("rep").alias("doc_id"))
    reps = staged(signed.join(own, ["set_hash", "doc_id"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "bands", "sig"), "mh-reps")
    bands = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = staged(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub")).filter("n > 1"), "mh-buckets")
    total = max(reps.count(), 1)
    members = staged(join_groups(bands, buckets, ["key"], "n", BANDS * total).select("key", "n", "hub", "doc_id"), "mh-members")
    ship(docs.sparkSession)
    check = Verifier(docs, reps, words, percent, miss)

    def labelled(rows: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
        side = found.select(F.col("v").alias(column), F.col("component").alias(name))
        return rows.join(side, column, "left").withColumn(name, F.coalesce(name, column))

    # round 1: each document with the hub it shares most bands with
    shared = members.filter("doc_id <> hub").groupBy("hub", "doc_id").agg(F.count("*").alias("bands"))
    best = shared.groupBy("doc_id").agg(F.min(F.struct(-F.col("bands"), F.col("hub"))).getField("hub").alias("hub"))
    tried = staged(best.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")), "mh-pairs")
    survivors = staged(check.bayes(tried), "mh-survivors")
    links = check.links(survivors)

    # round 2: the other hubs, where components do not cover the pair yet
    found = components(links)
    others = shared.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).join(tried, ["a", "b"], "left_anti")
    others = labelled(labelled(others, found, "a", "ca"), found, "b", "cb").filter("ca <> cb").select("a", "b")
    more = staged(check.bayes(others), "mh-survivors")
    links = links.unionByName(check.links(more))

    # round 3: inside families of plausible pairs, across components
    families = components(survivors.unionByName(more))
    parts = families.select(F.col("v").alias("doc_id"), F.col("component").alias("family"))
    dealt = staged(_dealt(labelled(parts, components(links), "doc_id", "component"), "family", "component"), "mh-dealt")
    sets = check.sets(dealt.select("doc_id").distinct())
    full = dealt.join(reps.select("doc_id", "sig"), "doc_id").join(sets, "doc_id")
    inner = full.groupBy("family", "i", "j").applyInArrow(_family_links(check.least, percent), "a long, b long")
    links = links.unionByName(staged(inner, "mh-links"))

    # round 4: across families, in buckets with more than a hub and one member
    parts = labelled(members.filter("n > 2 and doc_id <> hub"), families, "doc_id", "family")
    spread = _dealt(parts, "key", "family").join(reps, "doc_id")
    rest = spread.groupBy("key", "i", "j").applyInArrow(_blocks(check.least), "a long, b long").distinct()
    links = links.unionByName(check.links(staged(rest, "mh-survivors")))

    found = components(links)
    named = labelled(classes, found, "rep", "component_id")
    out = join_groups(rows, named.select("set_hash", "size", "component_id"), ["set_hash"], "size", max(rows.count(), 1))
    empty = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(empty)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _told_apart(docs: DataFrame) -> DataFrame:
    """``row`` (all columns) and ``id`` of every different pair of doc_id and text, once; ``id`` is unique.

    It is the doc_id, but for the second and further texts of one doc_id and all texts without one, which take unused
    numbers. Without repeated and null ids no text moves.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*docs.columns).alias("row"))
    ids = rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    repeated = staged(ids.filter("n > 1"), "mh-repeated")
    if repeated.isEmpty() and rows.filter("id is null").isEmpty():
        return rows
    marked = join_groups(rows.filter("id is not null"), repeated, ["id"], "n", max(rows.count(), 1), "left")
    several = marked.filter("n is not null").select("id", "row").unionByName(rows.filter("id is null"))
    digest = F.sha2(F.coalesce(F.concat(F.lit("t"), F.col("row.text")), F.lit("")), 256)
    several = staged(several.withColumn("d", digest).groupBy("id", "d").agg(F.first("row").alias("row")), "mh-several")
    least = several.filter("id is not null").groupBy("id").agg(F.min("d").alias("least"))
    sorted_out = several.join(least, "id", "left").withColumn("own", F.coalesce(F.col("d") == F.col("least"), F.lit(False)))
    further = sorted_out.filter("not own").select("id", "d")
    for salt in range(100):
        named = staged(further.select("id", "d", F.xxhash64("id", "d", F.lit(salt)).alias("other")), "mh-named")
        if named.select("other").distinct().count() == named.count() and named.join(rows.select(F.col("id").alias("other")), "other", "left_semi").isEmpty():
            break
    other = named.select(F.col("id").alias("__i"), F.col("d").alias("__d"), "other")
    sorted_out = sorted_out.join(other, (F.col("d") == F.col("__d")) & F.col("id").eqNullSafe(F.col("__i")), "left")
    several = sorted_out.select(F.coalesce("other", "id").alias("id"), "row")
    return staged(marked.filter("n is null").select("id", "row").unionByName(several), "mh-apart")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component. Of rows equal in doc_id and text one stays; different texts of one doc_id
    are different documents, and so are different texts without an id. Null and empty texts are alike to nothing."""
    rows = _told_apart(docs)
    gone = near_duplicates(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")), words, percent)
    gone = gone.filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return rows.join(gone, F.col("id") == F.col("__gone"), "left_anti").select("row.*")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents by two-word shingles."""
    return near_duplicates(documents(spark, sf_dir), words=2, percent=80)
