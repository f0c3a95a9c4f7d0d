"""Retrieval: BM25, fusion of rankings, pipeline widths, resilient retrieval."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..functions.vectors import MAX_SCORES, bound, ranked
from ..session import ship

K1, B = 1.5, 0.75
RRF_K = 60
#: Query terms that are broadcast to the tokens of a corpus.
MAX_TERMS = 100_000
#: Documents and queries of a block in a search; a word is multiplied as a matrix if this share of their
#: pairs have it.
DEAL, DENSE = 16_384, 1 / 512
HYBRID_OVERFETCH, PIPELINE_OVERFETCH, MAX_CANDIDATES = 3.0, 4.0, 100


def fetch_size(k: int, catalogue: int) -> int:
    """Candidates that a selection of k asks for."""
    return min(max(4 * k, k + 10), max(catalogue, k))


def pipeline_size(width: int, overfetch: float = PIPELINE_OVERFETCH, most: int = MAX_CANDIDATES) -> int:
    return min(most, max(width, int(width * overfetch)))


def hybrid_size(width: int, overfetch: float = HYBRID_OVERFETCH) -> int:
    return max(width, int(width * overfetch))


@dataclass
class KeywordIndex:
    """BM25 over a corpus: postings (term, id, tf, length), terms (term, df, idf), stats (n, avg_length).

    Statistics cover the whole corpus whatever a query filters. A corpus is tokenised once: ``counts`` has, besides the
    postings, a row without a term for each document, from which the statistics come. It is cached until ``release``.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    counts: DataFrame | None = None
    few: bool = False
    kept: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def build(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None) -> KeywordIndex:
        """``only`` (term) keeps the postings of these terms alone, so that a search without a stored index shuffles
        no other token; it is broadcast up to MAX_TERMS terms. Statistics are the whole corpus's all the same."""
        tokens = corpus.select(F.col(id_col).alias("id"), tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
        each = F.explode(F.concat("tokens", F.array(F.lit(None).cast("string"))))  # the null is the document's own row
        words = tokens.select("id", F.size("tokens").alias("length"), each.alias("term"))
        few = False
        if only is not None:
            few = only.limit(MAX_TERMS + 1).count() <= MAX_TERMS
            wanted = only.select(F.col("term").alias("__t"))
            words = words.join(F.broadcast(wanted) if few else wanted, F.col("term") == F.col("__t"), "left").filter("__t is not null or term is null").select("id", "length", F.col("__t").alias("term"))
        counts = words.groupBy("term", "id", "length").agg(F.count("*").alias("tf")).persist()
        return KeywordIndex._of(counts, few)

    @staticmethod
    def _of(counts: DataFrame, few: bool = False) -> KeywordIndex:
        postings = counts.filter("term is not null").select("term", "id", "length", "tf")
        stats = counts.filter("term is null").agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = df.join(F.broadcast(stats), how="cross").select("term", "df", idf.alias("idf"))
        return KeywordIndex(postings, terms, stats, counts, few)

    @staticmethod
    def stored(corpus: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> KeywordIndex:
        """The index of a corpus as kept below ``path``; built and written when the corpus is another than last time.

        The corpus's signature (rows and a hash over ids and texts, whatever their order) names the folder.
        """
        spark = corpus.sparkSession
        row = F.xxhash64(F.col(id_col), F.col(text_col))
        n, one, two = corpus.agg(F.count("*"), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 40)))).first()
        at = f"{path.rstrip('/')}/{n}-{(one or 0) & (1 << 64) - 1:016x}-{two or 0:x}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        done = hadoop(f"{at}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            built = KeywordIndex.build(corpus, id_col, text_col)
            built.counts.sortWithinPartitions("term").write.mode("overwrite").parquet(at)
            built.release()
        return KeywordIndex._of(spark.read.parquet(at))

    def release(self) -> None:
        """Gives back what the index keeps in the executors; its tables are computed anew when they are used again."""
        if self.counts is not None:
            self.counts.unpersist()
        while self.kept:
            self.kept.pop().unpersist()

    @staticmethod
    def terms_of(queries: DataFrame) -> DataFrame:
        return queries.select(F.explode(tokenize(F.col("text"))).alias("term")).distinct()

    def search(self, queries: DataFrame, k: int, id_col: str = "tool_id", allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """query_id, id, score, rank for ``queries`` (query_id, text); scores above 0 only.

        A term repeated in a query counts each time. ``allowed`` (id) drops candidates only. Queries of the same words
        are searched once, and documents of the same words and length are scored as one, of which the k lowest ids can
        be hits; no pair of a query and a document is a row unless it is among the k best of its block.
        """
        bag = F.array_join(F.sort_array(tokenize(F.col("text"))), " ")
        asked = queries.select("query_id", bag.alias("bag")).filter("bag <> ''")
        length = F.greatest(F.col("length"), F.lit(1))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / F.col("avg_length")))
        idf = self.terms.select("term", "idf")
        held = self.postings.join(F.broadcast(idf) if self.few else idf, "term").join(F.broadcast(self.stats), how="cross").select("id", F.struct("term", part.alias("weight")).alias("entry"))
        if allowed is not None:
            held = held.join(allowed.select(F.col(id_col).alias("id")), "id", "left_semi")
        docs = held.groupBy("id").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
        alike = Window.partitionBy(F.sha2(F.to_json("entries"), 256)).orderBy("id")
        first = docs.select("id", "entries", F.row_number().over(alike).alias("place"), F.min("id").over(alike).alias("class"))
        first = first.filter(F.col("place") <= k).persist()
        self.kept.append(first)
        best = _best_classes(first.filter("place = 1").select("id", "entries"), asked.select("bag").distinct(), k)
        higher, same = Window.partitionBy("bag").orderBy(F.desc("score")), Window.partitionBy("bag", "score")
        sized = best.join(first.groupBy("class").agg(F.count("*").alias("size")), "class").withColumn("above", F.sum("size").over(higher) - F.sum("size").over(same))
        best = sized.filter(F.col("above") < k)  # else k members of classes with a higher score come before all of its own
        members = first.select("class", F.col("id").alias(id_col))
        hits = best.join(members, "class").select("bag", id_col, "score")
        order = Window.partitionBy("bag").orderBy(F.desc("score"), F.asc(id_col))
        top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        named = asked.select("query_id", F.sha2("bag", 256).alias("bag"))
        return named.join(top, "bag").select("query_id", id_col, "score", "rank")


def _best_classes(classes: DataFrame, bags: DataFrame, k: int) -> DataFrame:
    """bag (its SHA-256), class, score: for every bag of words the k best documents (id, entries) by score, then id.

    Bags and documents are dealt into blocks by hash; every pair of blocks is one task, which multiplies the words that
    many have as matrices and adds up the rest word by word, and passes on k documents a bag.
    """
    spark = classes.sparkSession
    parts, sets = (max(1, -(-df.count() // DEAL)) for df in (classes, bags))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    mine = classes.select(deal("id", parts).alias("i"), every(sets).alias("j"), "id", F.col("entries.term").alias("terms"), F.col("entries.weight").alias("weights"))
    theirs = bags.select(every(parts).alias("i"), deal("bag", sets).alias("j"), "bag")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        wants, held = group.filter(pc.is_valid(group["bag"]))["bag"].combine_chunks(), group.filter(pc.is_valid(group["id"]))
        held = held.take(pc.sort_indices(held["id"])).combine_chunks()
        ids = held["id"].combine_chunks()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(wants) and len(ids):
            scorer = _Block(held["terms"].combine_chunks(), held["weights"].combine_chunks())
            step = max(1, MAX_SCORES // len(ids))
            for at in range(0, len(wants), step):
                q, doc, score = _best_columns(scorer.scores(wants[at : at + step]), k)
                found.append((q + at, doc, score))
        q, doc, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"bag": wants.take(pa.array(q)), "class": ids.take(pa.array(doc)), "score": score})

    ship(spark)
    both = mine.unionByName(theirs, allowMissingColumns=True).select("i", "j", "id", "terms", "weights", "bag")
    hits = both.groupBy("i", "j").applyInArrow(run, f"bag string, class {dict(classes.dtypes)['id']}, score double")
    order = Window.partitionBy("bag").orderBy(F.desc("score"), F.asc("class"))
    hits = hits.select(F.sha2("bag", 256).alias("bag"), "class", "score")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def _best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k highest scores above 0 of each row; among equal ones the lower column."""
    least = np.maximum(bound(s, k), 0.0)
    row, column = np.nonzero((s >= least[:, None]) & (s > 0))
    score = s[row, column]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    sizes = np.bincount(row, minlength=len(s))
    keep = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k
    return row[keep], column[keep], score[keep]


class _Block:
    """The words of a block of documents and their weights, to score bags of words against."""

    def __init__(self, terms: pa.ListArray, weights: pa.ListArray) -> None:
        self.docs = len(terms)
        coded = pc.dictionary_encode(terms.flatten())
        self.terms, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        doc = np.repeat(np.arange(self.docs), np.asarray(pc.list_value_length(terms)))
        order = np.argsort(code, kind="stable")
        self.doc, self.weight = doc[order], np.asarray(weights.flatten())[order]
        self.times = np.bincount(code, minlength=len(self.terms))
        self.start = np.cumsum(self.times) - self.times

    def scores(self, bags: pa.Array) -> np.ndarray:
        """bags x documents, rounded."""
        words = pc.split_pattern(bags, " ")
        code = np.asarray(pc.fill_null(pc.index_in(words.flatten(), self.terms), -1)).astype(np.int64)
        bag = np.repeat(np.arange(len(bags)), np.asarray(pc.list_value_length(words)))
        bag, code = bag[code >= 0], code[code >= 0]
        asked = np.bincount(code, minlength=len(self.terms))
        common = np.flatnonzero(asked * self.times > DENSE * len(bags) * self.docs)
        column = np.full(len(self.terms), -1)
        column[common] = np.arange(len(common))
        rare = column[code] < 0
        size, start = self.times[code[rare]], self.start[code[rare]]
        entry = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        flat = np.repeat(bag[rare] * self.docs, size) + self.doc[entry]
        out = np.bincount(flat, self.weight[entry], len(bags) * self.docs).astype(np.float64).reshape(len(bags), self.docs)
        if len(common):
            left = np.bincount(bag[~rare] * len(common) + column[code[~rare]], minlength=len(bags) * len(common)).astype(np.float64).reshape(len(bags), -1)
            right = np.zeros((len(common), self.docs))
            for k, c in enumerate(common):
                at = slice(self.start[c], self.start[c] + self.times[c])
                np.add.at(right[k], self.doc[at], self.weight[at])
            out += left @ right
        return np.round(out, 9, out=out)


def fuse_rrf(runs: Sequence[DataFrame], k: int, weights: Sequence[float] | None = None, rrf_k: int = RRF_K, id_col: str = "tool_id") -> DataFrame:
    """Reciprocal rank fusion of runs (query_id, id, score, rank): the sum of weight / (rrf_k + rank)."""
    weights = weights or [1.0] * len(runs)
    parts = [r.select("query_id", id_col, (F.lit(float(w)) / (F.lit(rrf_k) + F.col("rank"))).alias("part")) for r, w in zip(runs, weights)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return ranked(both.groupBy("query_id", id_col).agg(F.round(F.sum("part"), 9).alias("score")), k, id_col)


def fuse_weighted(runs: Sequence[DataFrame], k: int, weights: Sequence[float] | None = None, id_col: str = "tool_id") -> DataFrame:
    """Fusion of min-max normalised scores; a run whose scores are all equal counts as 1.

    The sum is divided by all weights, also those of runs without a hit.
    """
    weights = weights or [1.0] * len(runs)
    total = float(sum(weights))
    each = Window.partitionBy("query_id")
    parts = []
    for r, w in zip(runs, weights):
        low, high = F.min("score").over(each), F.max("score").over(each)
        norm = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
        parts.append(r.select("query_id", id_col, (norm * float(w)).alias("part")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return ranked(both.groupBy("query_id", id_col).agg(F.round(F.sum("part") / total, 9).alias("score")), k, id_col)


def resilient(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame] | None = None, on_error: str = "fallback") -> tuple[DataFrame, bool]:
    """(hits, degraded). Spark is lazy, so the primary's plan is run here, guarded, and kept.

    ``on_error``: fail, empty or fallback. If both fail, the primary's error is raised.
    """
    if on_error not in ("fail", "empty", "fallback"):
        raise ValueError(f"unknown on_error {on_error!r}")
    try:
        hits = primary().persist()
        hits.count()
        return hits, False
    except Exception as error:
        if on_error == "fail":
            raise
        if on_error == "empty" or fallback is None:
            try:
                empty = primary()
                return empty.sparkSession.createDataFrame([], empty.schema), True  # the plan that failed isn't run again
            except Exception:
                raise error from None
        try:
            hits = fallback().persist()
            hits.count()
            return hits, True
        except Exception:
            raise error from None
