"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket. A source's budget falls into one bucket; everything before it is
taken and only that bucket is refined by the next bits of the hash, until the boundary is a single hash value.
What remains is one threshold a source, so the documents are filtered without sorting or shuffling any text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, join_groups, staged, word_count

WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its words.
MAX_REPEAT = 3
#: Hashes have LEVELS * LEVEL_BITS bits; each level refines one bucket into 2**LEVEL_BITS.
LEVELS, LEVEL_BITS = 4, 15
HASH_BITS = LEVELS * LEVEL_BITS


def mix_hash(doc_id: Column) -> Column:
    """60 hash bits of the id: a rerun draws the same documents."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeat: int = MAX_REPEAT) -> list[float]:
    """Shares of the total by weight; none above ``max_repeat`` times its size, the excess reshared by weight."""
    left, out = sum(sizes), [0.0] * len(sizes)
    active = [k for k in range(len(sizes)) if weights[k] > 0]
    while active:
        rate = left / sum(weights[k] for k in active)
        over = [k for k in active if weights[k] * rate > max_repeat * sizes[k]]
        if not over:
            for k in active:
                out[k] = weights[k] * rate
            break
        for k in over:
            out[k] = float(max_repeat * sizes[k])
            left -= max_repeat * sizes[k]
        active = [k for k in active if k not in set(over)]
    return out


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


#: Sources that one task puts in order.
RANKED = 100_000


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0: code-point order, a null source last; numbered by ranges, whatever their number."""
    spread = sources.repartitionByRange(max(1, -(-sources.count() // RANKED)), F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id())
    spread = staged(spread, "mix-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("range").agg(F.count("*").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)))  # a row a range
    inside = Window.partitionBy("range").orderBy(F.col("source").isNull(), "source")
    placed = spread.join(F.broadcast(starts.select("range", "base")), "range")
    return placed.withColumn("place", F.col("base") + F.row_number().over(inside) - 1).drop("range", "base")


def _rate(sources: DataFrame, max_repeat: int) -> float:
    """Words a unit of weight, with sources capped at ``max_repeat`` times their size and the excess reshared.

    A round caps what the rate of the last one exceeds; the capped sources only grow, and a handful of rounds do.
    """
    open_sources = sources.filter("weight > 0")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    while True:
        over = F.col("weight") * F.lit(rate) > max_repeat * F.col("source_size")
        capped, weight = open_sources.agg(F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if not weight:
            return rate
        then = (total - max_repeat * capped) / weight
        if then <= rate:
            return rate
        rate = then


def _boundary(rows: DataFrame, budgets: DataFrame, level: int, total: int) -> DataFrame:
    """One level: of key, n (rows of the source), prefix, budget the bucket in which the budget runs out, with the budget left."""
    shift = HASH_BITS - LEVEL_BITS * (level + 1)
    met = join_groups(rows, budgets, ["key"], "n", total).filter(F.shiftright(F.col("h"), shift + LEVEL_BITS) == F.col("prefix"))
    cells = met.groupBy("key", "n", "budget", F.shiftright(F.col("h"), shift).alias("cell")).agg(F.sum("size").alias("size"))
    run = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # 2**LEVEL_BITS rows at most
    summed = cells.withColumn("upto", F.sum("size").over(run))
    if level + 1 == LEVELS:
        beyond = summed.filter(F.col("upto") - F.col("size") + F.col("upto") > 2 * F.col("budget"))
    else:
        beyond = summed.filter(F.col("upto") > F.col("budget"))
    left = F.min_by(F.col("budget") - (F.col("upto") - F.col("size")), "cell")
    return beyond.groupBy("key", "n").agg(F.min("cell").alias("prefix"), left.alias("budget"))


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, max_sources: int | None = None) -> DataFrame:
    """The plan of a mix, a row a source: source, source_size, target, full, threshold and ``n``, its rows.

    A document is taken ``full`` times and once more if its hash lies below ``threshold``. Weights go to the
    sources in code-point order, a null source last, repeating. Rows with one doc_id share a hash and are
    drawn together; a source without words has target 0 and an empty table gives no rows. Any number of sources is
    planned in tables, neither documents nor sources come to the driver; ``max_sources`` refuses more than a caller wants.
    """
    rows = staged(docs.select("source", _key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), mix_hash(F.col("doc_id")).alias("h")), "mix-sizes")
    total = max(rows.count(), 1)
    sources = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    if max_sources is not None and sources.limit(max_sources + 1).count() > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = staged(_ranked(staged(sources, "mix-sources")).withColumn("weight", pick), "mix-ranked")
    share = F.col("weight") * F.lit(_rate(sources, max_repeat))
    most = max_repeat * F.col("source_size")
    aims = sources.withColumn("target", F.when(F.col("weight") <= 0, 0.0).when(share > most, most.cast("double")).otherwise(share.cast("double")))
    aims = aims.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = staged(aims, "mix-aims")
    rows = rows.select("key", "size", "h")
    edge = plan.select("key", "n", F.lit(0).cast("long").alias("prefix"), (F.col("target") - F.col("full") * F.col("source_size")).alias("budget"))
    ends = []
    for level in range(LEVELS):
        met = staged(_boundary(rows, edge, level, total), "mix-boundary")
        # a budget that no bucket exceeds takes all of what is refined
        whole = edge.join(met.select("key"), "key", "left_anti")
        ends.append(whole.select("key", F.shiftleft(F.col("prefix") + 1, HASH_BITS - LEVEL_BITS * level).alias("threshold")))
        edge = met
    ends.append(edge.select("key", F.col("prefix").alias("threshold")))
    threshold = ends[0]
    for e in ends[1:]:
        threshold = threshold.unionByName(e)
    return staged(plan.join(threshold, "key").select("source", "source_size", "target", "full", "threshold", "n"), "mix-plan")


def _taken(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``row`` (all columns) of every document with source_size, target and ``copies``. Only rows of sources that are
    neither hot nor in a small plan are shuffled."""
    side = plan.select(_key(F.col("source")).alias("key"), "source_size", "target", "full", "threshold", "n")
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("key", _key(F.col("row.source")))
    joined = join_groups(rows, side, ["key"], "n", max(plan.agg(F.sum("n")).first()[0] or 0, 1))
    more = F.when(mix_hash(F.col("row.doc_id")) < F.col("threshold"), 1).otherwise(0)
    return joined.select("row", "source_size", "target", (F.col("full") + more).alias("copies"))


def with_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with source_size, target and ``copies``, the times the mix takes the document; columns of these names give way."""
    added = ("source_size", "target", "copies")
    return _taken(docs, plan).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in added), *added)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``, whatever their names."""
    taken = _taken(docs, mixture(docs, weights, max_repeat)).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken (size times copies), source, copies."""
    docs = documents(spark, sf_dir)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = with_copies(sized, mixture(docs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


OP5_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source is null, source)) - 1) % 3 + 1] as w
  from d group by source
), o as (
  select *, sum(source_size) over () as total, sum(w) over () as all_w,
         row_number() over (order by source_size::double / w, source is null, source) as k
  from s
), p as (
  select *, coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as cap_before,
         coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0) as w_before
  from o
), r as (
  select min_by((total - cap_before)::double / (all_w - w_before)::double, k) as rate, min(k) as first_open
  from p where w * ((total - cap_before)::double / (all_w - w_before)::double) <= 3 * source_size
), t as (
  select source, source_size, case when k < first_open then (3 * source_size)::double else w * rate end as target
  from p, r
), u as (
  select source, source_size, target, case when source_size = 0 then 0 else floor(target / source_size)::bigint end as n,
         target - (case when source_size = 0 then 0 else floor(target / source_size)::bigint end) * source_size as budget
  from t
), c as (
  select d.*, u.source_size, u.target, u.n, u.budget,
         sum(size) over (partition by d.source order by h range between unbounded preceding and current row) as upto,
         sum(size) over (partition by d.source, h) as same
  from d join u on d.source is not distinct from u.source
), x as (
  select *, n + case when upto - same + upto <= 2 * budget then 1 else 0 end as copies from c
)
select doc_id, size, source_size, target, (size * copies)::bigint as taken, source, copies::bigint as copies from x
"""
