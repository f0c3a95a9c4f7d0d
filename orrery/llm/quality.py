"""Quality classifier by co-training.

Two logistic models see a document from two sides: its text (words, word shapes and repetition) and the page's metadata
(host, language, recorded size and their pairs), of which neither sees the other's. They learn from a bounded sample of
labelled documents; in each round both label the documents they are sure about for each other, out of a fresh draw from
all documents. Both are calibrated on labelled documents kept out of training, so is their weighted sum, and every
document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, map_arrow
from .words import hashes_and_shapes

#: Documented bounds of what the fit sees: labelled documents, and the documents drawn in a round for the views to label
#: for each other. Each round draws others from all documents.
MAX_LABELLED, MAX_POOL = 5000, 5000
ROUNDS, SURE = 3, 0.95
#: Share of pool documents that one view may label for the other in a round.
EXCHANGE = 0.25
#: Pseudo-labels count less than labels.
PSEUDO_WEIGHT = 0.5
TEXT_BITS = 14
TEXT_SIZE = 1 << TEXT_BITS
STEPS, MORE_STEPS, RATE, RIDGE = 80, 25, 0.2, 1e-5
HOSTS, LANGS, SIZES, PAIRS = 1024, 64, 40, 2048
PAGE_SIZE = HOSTS + LANGS + SIZES + 2 * PAIRS


def _bucket(value: bytes, size: int) -> int:
    return xxhash.xxh3_64_intdigest(value) % size


def text_features(hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values (log counts, unit length) of the text view, from the hashes of words and of their shapes.

    Words have the lower half of the numbers and shapes the upper one, but for the last: words that follow themselves.
    """
    half = np.uint64(TEXT_SIZE // 2)
    own = (hashes % half).astype(np.int64)
    forms = (shapes % (half - np.uint64(1))).astype(np.int64) + TEXT_SIZE // 2
    counts = np.bincount(np.concatenate([own, forms]), minlength=TEXT_SIZE).astype(np.float64)
    counts[TEXT_SIZE - 1] = np.count_nonzero(own[1:] == own[:-1])
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at])
    return at, values / (np.sqrt((values * values).sum()) or 1.0)


def page_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Numbers of the page view's features, each of value one: host, language, recorded size in steps of half a power of two,
    host with language and language with size. Nulls are values of their own."""
    host, tongue = b"-" if source is None else b"=" + source.encode(), b"-" if lang is None else b"=" + lang.encode()
    size = 0 if n_chars is None else min(SIZES - 1, 1 + int(2 * np.log2(max(n_chars, 0) + 1)))
    at, out = 0, []
    for value, width in ((host, HOSTS), (tongue, LANGS), (None, SIZES), (host + b" " + tongue, PAIRS), (tongue + b" %d" % size, PAIRS)):
        out.append(at + (size if value is None else _bucket(value, width)))
        at += width
    return np.array(out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: Values of sparse rows that are multiplied at a time, so that a fit holds little besides the rows.
AT_ONCE = 1 << 18


@dataclass
class Rows:
    """Sparse rows: row numbers, feature numbers and values."""

    row: np.ndarray
    at: np.ndarray
    value: np.ndarray
    n: int
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._by(self.row, self.at, w, self.n) + w[-1]

    def _by(self, into: np.ndarray, of: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
        """Sums of value * w[of] by ``into``."""
        out = np.zeros(size)
        for k in range(0, len(self.value), AT_ONCE):
            part = slice(k, k + AT_ONCE)
            out += np.bincount(into[part], self.value[part] * w[of[part]], size)
        return out

    def weighted(self, weight: np.ndarray) -> Rows:
        """The rows with a weight, under their own numbers."""
        used = weight[self.row] > 0
        return Rows(self.row[used], self.at[used], self.value[used], self.n, self.width)

    def fit(self, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Weighted logistic regression (the last number is the intercept) by Adam over all rows, from earlier weights on."""
        rows = self.weighted(weight)
        w = np.zeros(self.width + 1) if start is None else start
        m, v, total = np.zeros_like(w), np.zeros_like(w), max(weight.sum(), 1e-9)
        for step in range(1, (STEPS if start is None else MORE_STEPS) + 1):
            g = weight * (sigmoid(rows.dot(w)) - y) / total
            grad = np.append(rows._by(rows.at, rows.row, g, self.width), g.sum()) + RIDGE * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a view's score into a calibrated log odds (Platt's smoothed targets; Newton steps, halved
    until the loss falls, so that separable scores don't diverge)."""
    pos, neg = y.sum(), len(y) - y.sum()
    aim = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(z)), 1e-6)
    x = np.stack([z / scale, np.ones_like(z)])

    def loss(w: np.ndarray) -> float:
        t = w @ x
        return float((np.logaddexp(0, t) - aim * t).sum() + 0.005 * ((w - [1, 0]) ** 2).sum())

    w = np.array([1.0, 0.0])
    now = loss(w)
    for _ in range(100):
        p = sigmoid(w @ x)
        g = x @ (p - aim) + 0.01 * (w - [1, 0])
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 0.01 * np.eye(2), g)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-8:
            size /= 2
        w, before, now = w - size * step, now, then
        if before - now < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def combination(zt: np.ndarray, zp: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Weights of both calibrated log odds and an offset that give a calibrated sum (Newton steps). They are drawn towards
    (1, 1, -prior), which is right where the views are independent given the class."""
    x, start = np.stack([zt, zp, np.ones_like(zt)]), np.array([1.0, 1.0, -prior])
    pos, neg = y.sum(), len(y) - y.sum()
    aim = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(w: np.ndarray) -> float:
        t = w @ x
        return float((np.logaddexp(0, t) - aim * t).sum() + 0.5 * ((w - start) ** 2).sum())

    w, now = start, loss(start)
    for _ in range(100):
        p = sigmoid(w @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + np.eye(3), x @ (p - aim) + (w - start))
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-8:
            size /= 2
        w, before, now = w - size * step, now, then
        if before - now < 1e-9:
            break
    return w


@dataclass
class Model:
    """Weights and calibrations of both views, and the weights of their log odds in the sum."""

    text: np.ndarray
    page: np.ndarray
    text_scale: tuple[float, float]
    page_scale: tuple[float, float]
    both: np.ndarray

    def score(self, text: bytes, source: str | None, lang: str | None, n_chars: int | None) -> tuple[float, float, float]:
        """Calibrated probabilities of good quality: by the text, by the page, combined."""
        return self.scored(*next(hashes_and_shapes(pa.array([text], pa.binary()))), source, lang, n_chars)

    def scored(self, hashes: np.ndarray, shapes: np.ndarray, source: str | None, lang: str | None, n_chars: int | None) -> tuple[float, float, float]:
        at, value = text_features(hashes, shapes)
        zt = self.text_scale[0] * ((value * self.text[at]).sum() + self.text[-1]) + self.text_scale[1]
        zp = self.page_scale[0] * (self.page[page_features(source, lang, n_chars)].sum() + self.page[-1]) + self.page_scale[1]
        p = sigmoid(np.array([zt, zp, self.both @ np.array([zt, zp, 1.0])]))
        return float(p[0]), float(p[1]), float(p[2])


def co_train(text: Rows, page: Rows, y: np.ndarray, held: np.ndarray, rounds: int = ROUNDS, draw: np.ndarray | None = None) -> Model:
    """``y``: 1, 0, or -1 without a label. ``held``: labelled rows that only calibrate. ``draw``: the round for which a row
    without a label is drawn; without it all of them are in every round."""
    known = (y >= 0) & ~held
    prior = float(np.clip(y[y >= 0].mean(), 1e-3, 1 - 1e-3))
    labels = {v: (np.where(known, y, 0).astype(float), known.astype(float)) for v in ("text", "page")}
    views = {"text": text, "page": page}
    weights = {v: views[v].fit(*labels[v]) for v in views}
    for k in range(rounds):
        pool = np.flatnonzero((y < 0) & (draw == k if draw is not None else True))
        if not len(pool):
            continue
        sure = {}
        for v in views:
            a, b = platt(views[v].dot(weights[v])[held], y[held]) if held.any() else (1.0, 0.0)
            p = sigmoid(a * views[v].dot(weights[v])[pool] + b)
            room = int(EXCHANGE * len(pool)) + 1
            good, bad = np.argsort(-p, kind="stable"), np.argsort(p, kind="stable")
            good = good[: max(1, int(room * prior))]
            bad = bad[: max(1, int(room * (1 - prior)))]
            sure[v] = (pool[good[p[good] >= SURE]], pool[bad[p[bad] <= 1 - SURE]])
        for teacher, pupil in (("text", "page"), ("page", "text")):
            target, weight = labels[pupil]
            for rows, value in zip(sure[teacher], (1.0, 0.0)):
                target[rows], weight[rows] = value, PSEUDO_WEIGHT
        weights = {v: views[v].fit(*labels[v], weights[v]) for v in views}
    fold = held if held.any() else known
    z, scales = {}, {}
    for v in views:
        scales[v] = platt(views[v].dot(weights[v])[fold], y[fold])
        z[v] = scales[v][0] * views[v].dot(weights[v])[fold] + scales[v][1]
    both = combination(z["text"], z["page"], y[fold], float(np.log(prior / (1 - prior))))
    return Model(weights["text"], weights["page"], scales["text"], scales["page"], both)


SAMPLE = "doc_id long, y int, draw int, at array<short>, value array<float>, page array<short>"
#: The columns that both views see.
SEEN = ("text", "lang", "source", "n_chars")


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        texts, rest = hashes_and_shapes(b.column(1).cast(pa.binary())), (c.to_pylist() for k, c in enumerate(b.columns) if k != 1)
        for seen, doc_id, lang, source, n_chars, y, draw in zip(texts, *rest):
            at, value = text_features(*seen)
            rows.append((doc_id, y, draw, at.astype(np.int16), value.astype(np.float32), page_features(source, lang, n_chars).astype(np.int16)))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int16()), pa.list_(pa.float32()), pa.list_(pa.int16())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], ["doc_id", "y", "draw", "at", "value", "page"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> Model | None:
    """Train on samples drawn by a hash of the id: about ``max_labelled`` documents, and ``max_pool`` more in each round.

    Null labels are ignored; a document labelled more than once takes the rounded mean. Without labels of both
    classes there is no model (None).
    """
    known = labels.filter(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label_col)).cast("int").alias("__y"))
    try:
        return _fitted(docs, known, max_labelled, max_pool)
    finally:
        give_back()


def _fitted(docs: DataFrame, known: DataFrame, max_labelled: int, max_pool: int) -> Model | None:
    n_labels, n_docs = known.count(), docs.count()
    spread = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_003))
    cut = lambda most, n: int(1_000_003 * min(1.0, most / max(n, 1)))
    drawn = F.broadcast(known.filter(spread < cut(max_labelled, n_labels)).withColumnRenamed("doc_id", "__id"))
    joined = docs.select("doc_id", *SEEN).join(drawn, F.col("doc_id") == F.col("__id"), "left")
    y = F.coalesce(F.col("__y"), F.lit(-1))
    pool = spread >= 1_000_003 - cut(max_pool * ROUNDS, n_docs)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(ROUNDS)).cast("int")
    rows = joined.filter(F.col("__y").isNotNull() | pool).select("doc_id", *SEEN, y.alias("y"), draw.alias("draw"))
    table = map_arrow(rows, _sampled, SAMPLE).toArrow()
    order = np.lexsort((np.asarray(table["y"]), np.asarray(table["doc_id"].fill_null(-1))))
    table = table.take(pa.array(order)).combine_chunks()
    y = np.asarray(table["y"]).astype(np.int64)
    if not {0, 1} <= set(y.tolist()):
        return None

    def sparse(at: str, value: str | None, width: int) -> Rows:
        lists = table[at].combine_chunks()
        lengths = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten())
        values = np.asarray(table[value].combine_chunks().flatten()) if value else np.ones(len(flat), np.float32)
        return Rows(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), flat, values, len(lengths), width)

    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::5]] = (y == label).sum() >= 10
    draws = np.asarray(table["draw"]) if n_docs > max_pool * ROUNDS else None  # a small corpus is in every round
    return co_train(sparse("at", "value", TEXT_SIZE), sparse("page", None, PAGE_SIZE), y, held, draw=draws)


def _scores(model: Model | None, b: pa.RecordBatch) -> list[tuple[float, float, float]]:
    if model is None:
        return [(1.0, 1.0, 1.0)] * b.num_rows
    rest = (b.column(c).to_pylist() for c in ("source", "lang", "n_chars"))
    return [model.scored(*seen, *r) for seen, *r in zip(hashes_and_shapes(b.column("text").cast(pa.binary())), *rest)]


def score(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """A row a document: doc_id, p_text, p_page, score, kept. Null texts are scored as empty ones, whole texts however long.

    Without a model (no labels of both classes) every document scores 1 and is kept. Repeated rows are scored each and
    alike, a score of exactly ``least`` is kept; an empty table gives no rows and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.round(np.array(_scores(model, b), np.float64).reshape(-1, 3), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= least)], ["doc_id", "p_text", "p_page", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *SEEN)
    return map_arrow(rows, run, "doc_id long, p_text double, p_page double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns, whatever their names; repeated rows are
    all kept or all dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([round(p, 6) >= least for _, _, p in _scores(model, b)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` of all documents by a model fit on the table of labels."""
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
