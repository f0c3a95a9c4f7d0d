"""Vector functions: Column builders for single pairs, blocks of matrices for searches.

Scores are computed in double precision and rounded to SCORE_DIGITS before they are compared, so that equal
vectors tie whatever the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..schema import DimensionMismatchError
from ..session import map_arrow, ship

SCORE_DIGITS = 9
METRICS = ("cosine", "ip", "l2", "manhattan")
#: Queries that are sent to every worker as one matrix; more are dealt into blocks of as many, against blocks of the index.
MAX_QUERIES = 4096
#: Rows of a block in a self-search, and of the index in a search with many queries.
BLOCK, INDEX_BLOCK = 2048, 16_384
#: Scores that a search computes at a time; scores of a group whose best alone is looked at first.
MAX_SCORES, GROUP = 1 << 22, 64
#: Entries of sparse queries that are sent to every worker; more are dealt into blocks of about as many.
MAX_ENTRIES = 1 << 22
#: Sparse queries that are dense at a time; rows that have a common bound; rows that wait until they are compared; hits
#: beyond which the worse ones are dropped before the rows that wait are through.
ALIKE, TILE, WAITING, THIN = 4096, 64, 8192, 1 << 20


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def checked(v: Column, width: int) -> Column:
    """The vector, or a failed job if its width is another."""
    return F.when(F.size(v) == width, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} dimensions, got "), F.size(v).cast("string"))))


def scores(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """rows x queries similarities, rounded; higher is closer for every metric."""
    return _rounded(_unrounded(rows, queries, metric))


def _rounded(s: np.ndarray) -> np.ndarray:
    np.round(s, SCORE_DIGITS, out=s)
    s += 0.0
    return s


def _unrounded(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        lengths = np.sqrt((rows * rows).sum(1))[:, None] * np.sqrt((queries * queries).sum(1))[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            out = rows @ queries.T
            out /= lengths
            out[lengths == 0] = 0.0
    elif metric == "ip":
        out = rows @ queries.T
    elif metric == "l2":
        square = (rows * rows).sum(1)[:, None] + (queries * queries).sum(1)[None, :] - 2 * rows @ queries.T
        out = -np.sqrt(np.maximum(square, 0.0))
    elif metric == "manhattan":
        out = np.stack([-np.abs(rows - q).sum(1) for q in queries], axis=1)
    else:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return out


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A row a vector; with ``dim`` the vectors are sparse, lists of (bucket, weight)."""
    if dim is not None:
        out, entries = np.zeros((len(column), dim)), column.flatten()
        out[np.repeat(np.arange(len(column)), np.asarray(pc.list_value_length(column))), np.asarray(entries.field("bucket"))] = np.asarray(entries.field("weight"))
        return out
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1)


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, buckets and weights of sparse vectors."""
    sizes, entries = np.asarray(pc.fill_null(pc.list_value_length(column), 0)), column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), np.asarray(entries.field("bucket")), np.asarray(entries.field("weight"))


def best_rows(s: np.ndarray, k: int) -> np.ndarray:
    """For each column the rows of its k highest scores, best first; among equal ones the lower row."""
    if len(s) > 4 * k:
        part = np.argpartition(-s, k - 1, axis=0)[:k]
        least = np.take_along_axis(s, part, 0).min(axis=0)
        sure = (s >= least).sum(axis=0) == k  # no tie at the edge
        part.sort(axis=0)
        order = np.argsort(-np.take_along_axis(s, part, 0), axis=0, kind="stable")
        best = np.take_along_axis(part, order, 0)
        if not sure.all():
            best[:, ~sure] = np.argsort(-s[:, ~sure], axis=0, kind="stable")[:k]
        return best
    return np.argsort(-s, axis=0, kind="stable")[:k]


def bound(s: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least k of its scores reach, close to the k-th highest; minus infinity if it has fewer.

    k groups have a score as high as the k-th highest of the groups' maxima, so at least k scores are.
    """
    groups = s.shape[1] // GROUP
    if groups > k:
        s = s[:, : groups * GROUP].reshape(len(s), groups, GROUP).max(2)
    n = s.shape[1]
    return np.partition(s, n - k, axis=1)[:, n - k] if n >= k else np.full(len(s), -np.inf)


class Best:
    """The k best rows so far of every query; holds k rows a query and a few more, however many it sees.

    Scores are compared with what k of a query's rows reach before any is rounded or sorted; only those that may be
    among the k best are.
    """

    def __init__(self, matrix: np.ndarray, k: int, metric: str) -> None:
        self.matrix, self.k, self.metric = matrix, k, metric
        if metric == "cosine":  # of unit vectors it is the inner product
            self.matrix, self.metric = _units(matrix), "ip"
        self.unit = metric == "cosine"
        self.names: pa.Array | None = None
        self.query, self.at, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # at: places in names
        self.least = np.full(len(matrix), -np.inf)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def see(self, names: pa.Array, rows: np.ndarray) -> None:
        if rows.shape[1] != self.matrix.shape[1]:
            raise DimensionMismatchError(f"index has {rows.shape[1]} dimensions, queries {self.matrix.shape[1]}")
        order = pc.sort_indices(names)
        names, rows = names.take(order), rows[np.asarray(order)]
        rows = _units(rows) if self.unit else rows
        first = 0 if self.names is None else len(self.names)
        self.names = names if self.names is None else pa.concat_arrays([self.names, names])
        step = max(1, MAX_SCORES // max(len(rows), 1))
        for at in range(0, len(self.matrix), step):
            s = _unrounded(self.matrix[at : at + step], rows, self.metric)
            key = _last(s)
            least = np.maximum(bound(key, self.k), self.least[at : at + step])
            finite = np.isfinite(least)
            least[finite] -= 2 * 10.0**-SCORE_DIGITS + 1e-14 * np.abs(least[finite])  # what rounding may move
            good = key >= least[:, None]
            tied = np.flatnonzero(np.count_nonzero(good, axis=1) > 4 * self.k)
            if len(tied):  # of many equal rows the lowest names
                best = np.argsort(-_rounded(key[tied]), axis=1, kind="stable")[:, : self.k]
                few = np.zeros((len(tied), len(rows)), bool)
                np.put_along_axis(few, best, True, axis=1)
                good[tied] = few
            query, row = np.nonzero(good)
            self.new.append((query + at, row + first, _rounded(s[query, row])))
        if len(self.names) > 1 << 16 or sum(len(x[0]) for x in self.new) > max(1 << 20, 2 * self.k * len(self.matrix)):
            self._settle()

    def _settle(self) -> None:
        """Drops all but the k best of each query; among equal ones the lower names stay."""
        if not self.new:
            return
        query, at, score = (np.concatenate(x) for x in zip((self.query, self.at, self.score), *self.new))
        self.new = []
        used, at = np.unique(at, return_inverse=True)
        names = self.names.take(pa.array(used))
        order = pc.sort_indices(names)
        rank = np.empty(len(names), np.int64)
        rank[np.asarray(order)] = np.arange(len(names))
        names, at = names.take(order), rank[at]
        best = np.lexsort((at, -_last(score), query))
        counts = np.bincount(query, minlength=len(self.matrix))
        best = best[np.arange(len(best)) - np.repeat(np.cumsum(counts) - counts, counts) < self.k]
        self.names, self.query, self.at, self.score = names, query[best], at[best], score[best]
        ends = np.cumsum(np.minimum(counts, self.k)) - 1
        full = counts >= self.k
        self.least[full] = _last(self.score[ends[full]])

    def table(self, ids: pa.Array, id_col: str) -> pa.RecordBatch:
        self._settle()
        if self.names is None:
            return pa.RecordBatch.from_arrays([ids[:0], pa.nulls(0), pa.array([], pa.float64())], ["query_id", id_col, "score"])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(self.query)), self.names.take(pa.array(self.at)), pa.array(self.score)], ["query_id", id_col, "score"])


class Alike(Best):
    """As ``Best`` for the cosine of many sparse queries, which may have most entries in common.

    A query is ``share`` times one common vector plus a rest of few entries. A row's product with the common vector and
    the extremes of each bucket over some rows bound the rows' scores for a query from above; what can't reach the k best
    is not scored. No row is lost by that. Unlike queries have long rests, and all rows are scored then.
    """

    def __init__(self, offsets: np.ndarray, bucket: np.ndarray, weight: np.ndarray, dim: int, k: int) -> None:
        n = len(offsets) - 1
        super().__init__(np.zeros((n, 0)), k, "cosine")
        self.dim, self.offsets, self.bucket = dim, offsets, bucket
        length = np.sqrt(np.bincount(self._owner(), weight * weight, n))
        self.weight = weight / np.where(length == 0, 1, length)[self._owner()]
        self._split()
        self.held = 0
        self.waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def _owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def _dense(self, first: int, last: int) -> np.ndarray:
        out, at = np.zeros((last - first, self.dim)), slice(self.offsets[first], self.offsets[last])
        out[np.repeat(np.arange(last - first), np.diff(self.offsets[first : last + 1])), self.bucket[at]] = self.weight[at]
        return out

    def _chunks(self) -> Iterator[tuple[int, int]]:
        n = len(self.offsets) - 1
        return ((at, min(at + ALIKE, n)) for at in range(0, n, ALIKE))

    def _typical(self, weight: np.ndarray) -> np.ndarray:
        """The median weight of each bucket that most queries have; 0 for the others."""
        order = np.argsort(self.bucket, kind="stable")
        ends = np.cumsum(np.bincount(self.bucket, minlength=self.dim))
        out = np.zeros(self.dim)
        for b, (start, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
            if 2 * (end - start) > len(self.offsets) - 1:
                out[b] = np.median(weight[order[start:end]])
        return out

    def _split(self) -> None:
        """The common vector, each query's share of it, and the rests: offsets, owners, weights and the extremes they meet."""
        rough = self._typical(self.weight)
        held = np.flatnonzero(rough)
        share = np.zeros(len(self.offsets) - 1)
        if len(held):
            for first, last in self._chunks():
                share[first:last] = np.maximum(np.median(self._dense(first, last)[:, held] / rough[held], axis=1), 0.0)
        of = share[self._owner()]
        self.share, self.common = share, self._typical(np.divide(self.weight, of, out=np.zeros(len(of)), where=of > 0))
        sizes, bucket, weight = [], [], []
        for first, last in self._chunks():
            rest = self._dense(first, last) - share[first:last, None] * self.common
            row, at = np.nonzero(~(np.abs(rest) <= 1e-12))
            sizes.append(np.bincount(row, minlength=last - first))
            bucket.append(at)
            weight.append(rest[row, at])
        empty = [np.zeros(0, np.int64)]
        self.rest_ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes or empty))])
        self.rest, self.rest_owner = np.concatenate(weight or [np.zeros(0)]), np.repeat(np.arange(len(share)), np.diff(self.rest_ends))
        self.rest_meets = np.concatenate(bucket or empty) + np.where(self.rest < 0, self.dim, 0)  # places in _extremes

    @staticmethod
    def _extremes(rows: np.ndarray) -> np.ndarray:
        """The most of each bucket, then the least."""
        return np.concatenate([rows.max(0), rows.min(0)])

    def _most(self, extremes: np.ndarray, first: int, last: int) -> np.ndarray:
        """For each query what its rest's product with any of the rows is at most."""
        at = slice(self.rest_ends[first], self.rest_ends[last])
        return np.bincount(self.rest_owner[at] - first, self.rest[at] * extremes[self.rest_meets[at]], last - first)

    def _needed(self, first: int, last: int) -> np.ndarray:
        """What a bound must reach: the least of the k best so far, but for rounding and the entries left out of the rests."""
        least = self.least[first:last]
        return least - np.where(np.isfinite(least), 4 * 10.0**-SCORE_DIGITS + 1e-12 * np.abs(least), 0.0)

    def see(self, names: pa.Array, rows: np.ndarray) -> None:
        if rows.shape[1] != self.dim:
            raise DimensionMismatchError(f"index has {rows.shape[1]} dimensions, queries {self.dim}")
        if not len(rows) or len(self.offsets) == 1:
            return
        rows = _units(rows)
        near = rows @ self.common
        known = self.names is not None
        if known:  # rows that no query can want go at once
            room = self._needed(0, len(self.share)) - self._most(self._extremes(rows), 0, len(self.share))
            with np.errstate(divide="ignore", invalid="ignore"):
                from_ = np.where(self.share > 0, room / self.share, np.where(room > 0, np.inf, -np.inf))
            kept = np.flatnonzero(~(near < from_.min() - 1e-12))
            names, rows, near = names.take(pa.array(kept)), rows[kept], near[kept]
        if len(rows):
            self.waiting.append((names, rows, near))
        if not known or sum(len(x[1]) for x in self.waiting) >= WAITING:
            self._compare()

    def _compare(self) -> None:
        """Scores the rows that wait, those nearest to the common vector first, in tiles with a bound of their own."""
        if not self.waiting:
            return
        names = pa.concat_arrays([x[0] for x in self.waiting])
        rows, near = (np.concatenate([x[at] for x in self.waiting]) for at in (1, 2))
        self.waiting = []
        order = np.asarray(pc.sort_indices(names))
        names, rows, near = names.take(pa.array(order)), rows[order], near[order]
        offset = 0 if self.names is None else len(self.names)
        self.names = names if self.names is None else pa.concat_arrays([self.names, names])
        by, ends = np.argsort(-near, kind="stable"), range(0, len(near), TILE)
        highest = near[by[::TILE]]
        by = np.concatenate([np.sort(by[at : at + TILE]) for at in ends])  # by name within a tile, as ties want it
        rows = rows[by]
        tiles = [(by[at : at + TILE] + offset, rows[at : at + TILE], high, self._extremes(rows[at : at + TILE])) for at, high in zip(ends, highest)]
        extremes = self._extremes(rows)
        for first, last in self._chunks():
            queries, share = self._dense(first, last), self.share[first:last]
            overall, needed = self._most(extremes, first, last), self._needed(first, last)
            for places, some, near_most, extremes_of in tiles:
                high = share * near_most
                if (high + overall < needed).all():
                    break  # later tiles are further away
                wants = np.flatnonzero(~(high + self._most(extremes_of, first, last) < needed))
                if len(wants):
                    self._score(first + wants, queries if len(wants) == len(queries) else queries[wants], some, places)
                    needed = self._needed(first, last)
        self._settle()
        self.held = 0

    def _score(self, who: np.ndarray, queries: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        key = _last(queries @ rows.T)
        self.least[who] = np.maximum(self.least[who], bound(key, self.k) - 2 * 10.0**-SCORE_DIGITS)
        least = self.least[who]
        good = key >= np.where(np.isfinite(least), least - (2 * 10.0**-SCORE_DIGITS + 1e-14 * np.abs(least)), least)[:, None]
        tied = np.flatnonzero(np.count_nonzero(good, axis=1) > 4 * self.k)
        if len(tied):  # of many equal rows the lowest names
            best = np.argsort(-_rounded(key[tied]), axis=1, kind="stable")[:, : self.k]
            few = np.zeros((len(tied), len(rows)), bool)
            np.put_along_axis(few, best, True, axis=1)
            good[tied] = few
        query, row = np.nonzero(good)
        self.new.append((who[query], at[row], _rounded(key[query, row])))
        self.held += len(query)
        if self.held > max(THIN, 2 * self.k * len(self.share)):
            self._thin()

    def _thin(self) -> None:
        """Drops all but the k best new rows of each query; their places are in the order of their names."""
        query, at, score = (np.concatenate(x) for x in zip(*self.new))
        best = np.lexsort((at, -_last(score), query))
        counts = np.bincount(query, minlength=len(self.share))
        best = best[np.arange(len(best)) - np.repeat(np.cumsum(counts) - counts, counts) < self.k]
        self.new, self.held = [(query[best], at[best], score[best])], len(best)

    def table(self, ids: pa.Array, id_col: str) -> pa.RecordBatch:
        self._compare()
        return super().table(ids, id_col)


def _last(s: np.ndarray) -> np.ndarray:
    """Scores to order by: what isn't a number comes last."""
    odd = np.isnan(s)
    return np.where(odd, -np.inf, s) if odd.any() else s


def search(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "tool_id", vector_col: str = "vector", dim: int | None = None, read: Callable[[], Callable[[pa.Array], np.ndarray]] | None = None) -> DataFrame:
    """query_id, tool_id, score, rank: the k best rows of ``index`` for each row (query_id, vector) of ``queries``.

    With ``dim`` all vectors are sparse, arrays of (bucket, weight), and become that wide in the workers only. With
    ``read`` besides, the index has what vectors are made of instead: ``read()``, called once a task, gives a function
    from such a column to its matrix, so that no vector passes through Spark.

    Order is score descending, id ascending. Filters belong on ``index``, where they reach the scan. Up to MAX_QUERIES
    queries (sparse ones: MAX_ENTRIES entries) are sent to the workers as one matrix, and the index is streamed past it
    without a shuffle; a task keeps k rows a query. More queries are dealt into blocks, as is the index, and every pair of
    blocks is compared in a task; no query comes to the driver then.
    """
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {id_col} {dict(index.dtypes)[id_col]}, score double"
    single = dict(queries.dtypes)["vector"] == dict(index.dtypes)[vector_col] == "array<float>"  # widened in the workers
    plain = doubles if dim is None and not single else lambda v: v
    asked = queries.select("query_id", plain(F.col("vector")).alias("v"))
    rows = index.select(id_col, plain(F.col(vector_col)).alias("v"))
    reader = read or (lambda: lambda column: _matrix(column, dim))
    alike = dim is not None and metric == "cosine"
    if alike:
        entries, n = asked.agg(F.sum(F.size("v")), F.count("*")).first()
        sets = max(1, -(-max(entries or 0, 4 * k * n) // MAX_ENTRIES))
        few = asked.toArrow() if sets == 1 else None
    else:
        few = asked.limit(MAX_QUERIES + 1).toArrow()
        sets = 1 if few.num_rows <= MAX_QUERIES else max(1, -(-asked.count() // MAX_QUERIES))

    def held(vectors: pa.Array) -> Best:
        return Alike(*_entries(vectors), dim, k) if alike else Best(_matrix(vectors, dim), k, metric)

    if sets > 1:
        return ranked(_by_blocks(rows, asked, sets, held, reader, id_col, schema, 8 * INDEX_BLOCK if alike else INDEX_BLOCK), k, id_col)
    few = few.combine_chunks()
    ids = few["query_id"].combine_chunks() if few.num_rows else pa.array([], few.schema.field("query_id").type)
    asked_for = few["v"].combine_chunks() if few.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if asked_for is None:
            return
        best, matrix = None, reader()
        for b in batches:
            if b.num_rows:
                best = best or held(asked_for)
                best.see(b.column(0), matrix(b.column(1)))
        if best is not None:
            yield best.table(ids, id_col)

    return ranked(map_arrow(rows, run, schema), k, id_col)


def _by_blocks(rows: DataFrame, asked: DataFrame, sets: int, held: Callable, reader: Callable, id_col: str, schema: str, block: int) -> DataFrame:
    """The k best of every pair of a block of queries and a block of the index."""
    parts = max(1, -(-rows.count() // block))
    mine = rows.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("i"), F.explode(F.expr(f"sequence(0L, {sets - 1}L)")).alias("j"), F.col(id_col).alias("id"), "v")
    theirs = asked.select(F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("i"), F.pmod(F.xxhash64("query_id"), F.lit(sets)).alias("j"), F.col("query_id").alias("q"), F.col("v").alias("w"))
    return _met(mine, theirs, held, reader, id_col, schema)


def _met(mine: DataFrame, theirs: DataFrame, held: Callable, reader: Callable, id_col: str, schema: str) -> DataFrame:
    """The k best rows (i, j, id, v) of each block (i, j) for its queries (i, j, q, w)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        wants = group.filter(pc.is_valid(group["q"]))
        rows = group.filter(pc.is_valid(group["id"]))
        ids = wants["q"].combine_chunks()
        if len(ids) and rows.num_rows:
            best, matrix = held(wants["w"].combine_chunks()), reader()
            for at in range(0, rows.num_rows, INDEX_BLOCK):
                part = rows.slice(at, INDEX_BLOCK).combine_chunks()
                best.see(part["id"].combine_chunks(), matrix(part["v"].combine_chunks()))
            return pa.Table.from_batches([best.table(ids, id_col)])
        return pa.table({"query_id": ids[:0], id_col: rows["id"].combine_chunks()[:0], "score": pa.array([], pa.float64())})

    ship(mine.sparkSession)
    both = mine.unionByName(theirs, allowMissingColumns=True).select("i", "j", "id", "q", "v", "w")
    return both.groupBy("i", "j").applyInArrow(run, schema)


@dataclass(frozen=True)
class Cells:
    """An approximate index: rows lie in the cell of the centroid that is nearest by angle; a search looks into some cells.

    ``fit`` sees a bounded sample, ``place`` puts every row into a cell, whatever cells they are when stored; recall is
    measured by ``recall`` against the exact search.
    """

    centroids: np.ndarray

    @staticmethod
    def fit(index: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 12, id_col: str = "tool_id", vector_col: str = "vector") -> Cells:
        """Centroids from about ``sample`` rows drawn by a hash of their id (spherical k-means)."""
        share = min(1.0, sample / max(index.count(), 1))
        drawn = index.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < int(1_000_003 * share)).orderBy(id_col)
        rows = _units(_matrix(drawn.select(doubles(F.col(vector_col)).alias("v")).toArrow().combine_chunks()["v"].combine_chunks()))
        rng = np.random.default_rng(0)
        at = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
        for _ in range(rounds):
            own = np.argmax(rows @ at.T, axis=1)
            sums = np.zeros_like(at)
            np.add.at(sums, own, rows)
            at = np.where((np.bincount(own, minlength=len(at)) > 0)[:, None], _units(sums), at)
        return Cells(at)

    def _nearest(self, df: DataFrame, vector_col: str, n: int, out: str) -> DataFrame:
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = np.argsort(-(_matrix(b.column(b.num_columns - 1)) @ centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                flat = pa.array(near.ravel())
                cells = flat if n == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], cells], [*b.schema.names[:-1], out])

        kind = IntegerType() if n == 1 else ArrayType(IntegerType())
        fields = StructType([*df.schema.fields]).add(out, kind)
        return map_arrow(df.withColumn("__v", doubles(F.col(vector_col))), run, fields)

    def place(self, index: DataFrame, vector_col: str = "vector") -> DataFrame:
        """``index`` with its rows' ``cell``; write it partitioned or sorted by cell, so that a search reads those it needs."""
        return self._nearest(index, vector_col, 1, "cell")

    def search(self, placed: DataFrame, queries: DataFrame, k: int, probes: int = 8, metric: str = "cosine", id_col: str = "tool_id", vector_col: str = "vector") -> DataFrame:
        """As ``search``, in the ``probes`` nearest cells of each query. Cells are cut into blocks, so a large one is many tasks."""
        schema = f"query_id {dict(queries.dtypes)['query_id']}, {id_col} {dict(placed.dtypes)[id_col]}, score double"
        probed = self._nearest(queries.select("query_id", "vector"), "vector", max(probes, 2), "cells").select("query_id", doubles(F.col("vector")).alias("v"), F.explode(F.slice("cells", 1, probes)).alias("cell"))
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / INDEX_BLOCK).cast("int").alias("parts"))  # a row a cell
        asked = probed.groupBy("cell").agg(F.ceil(F.count("*") / MAX_QUERIES).cast("int").alias("sets"))
        cells = F.broadcast(sizes.join(asked, "cell"))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        block = lambda part, set_: [F.struct("cell", part.alias("part")).alias("i"), set_.alias("j")]
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        mine = placed.join(cells, "cell").withColumn("set", F.explode(every("sets"))).select(*block(deal(id_col, "parts"), F.col("set")), F.col(id_col).alias("id"), doubles(F.col(vector_col)).alias("v"))
        theirs = probed.join(cells, "cell").withColumn("part", F.explode(every("parts"))).select(*block(F.col("part"), deal("query_id", "sets")), F.col("query_id").alias("q"), F.col("v").alias("w"))
        return ranked(_met(mine, theirs, lambda v: Best(_matrix(v), k, metric), lambda: _matrix, id_col, schema), k, id_col)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "tool_id") -> float:
    """Share of the exact hits (query_id, id) that an approximate search found."""
    total = exact.count()
    return 1.0 if not total else exact.join(found.select("query_id", id_col), ["query_id", id_col], "left_semi").count() / total


def _units(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length == 0, 1, length)


def ranked(hits: DataFrame, k: int, id_col: str = "tool_id") -> DataFrame:
    """The k best hits of each query with their rank from 1: score descending, id ascending."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(index: DataFrame, id_col: str = "tool_id", vector_col: str = "vector", k: int = 2) -> DataFrame:
    """id, other, score, rank: each row's k best rows by cosine, itself included as any other.

    Rows are dealt to blocks by a hash of the id; every unordered pair of blocks is one task's matrix product and passes
    on k rows for each row. No pair of rows is ever a row of a DataFrame, but the work is that of all pairs.
    """
    total = index.count()
    n = max(1, -(-total // BLOCK))
    id_type = dict(index.dtypes)[id_col]
    block = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    rows = index.select(F.col(id_col).alias("id"), doubles(F.col(vector_col)).alias("v"), block.alias("block"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    blocks = spread.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "v")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block, ids, vectors = np.asarray(group["block"]), group["id"].combine_chunks(), _matrix(group["v"].combine_chunks())
        order = np.asarray(pc.sort_indices(ids))
        left, right = order[block[order] == group["i"][0].as_py()], order[block[order] == group["j"][0].as_py()]
        s = scores(vectors[right], vectors[left], "cosine")
        sides = [(left, right, s)] if group["i"][0].as_py() == group["j"][0].as_py() else [(left, right, s), (right, left, s.T)]
        who, other, score = [], [], []
        for mine, theirs, at in sides:
            best = best_rows(at, k) if len(mine) and len(theirs) else np.zeros((0, len(mine)), np.int64)
            who.append(np.repeat(mine, best.shape[0]))
            other.append(theirs[best].T.ravel())
            score.append(np.take_along_axis(at, best, 0).T.ravel())
        take = lambda x: ids.take(pa.array(np.concatenate(x).astype(np.int64)))
        return pa.table({"query_id": take(who), "other": take(other), "score": np.concatenate(score)})

    ship(index.sparkSession)
    hits = blocks.groupBy("i", "j").applyInArrow(run, f"query_id {id_type}, other {id_type}, score double")
    return ranked(hits, k, "other").withColumnRenamed("query_id", "id")
