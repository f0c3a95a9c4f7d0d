"""Sharding along a Hilbert curve over quantised metadata.

Source, language and length are quantised to 16 levels each. The 4,096 cells are visited in Hilbert order, so
neighbours on the curve are neighbours in every dimension, and the run of all documents is cut into shards of
equal row counts. A reader with predicates on any of the dimensions prunes shards by their level ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, staged

BITS = 4
LEVELS = 1 << BITS
SHARDS = 16
#: A cell is numbered in slices of hashed ids, so a cell that holds a third of all rows is never one task.
SLICES = 1024


def hilbert_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """Index of a grid point on the Hilbert curve through a cube with 2**bits levels a side.

    The axes are turned into the transposed index by undoing the excess rotations from the highest bit down
    and then Gray-coding the result (J. Skilling, 2004).
    """
    axes, n = list(point), len(point)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for k in range(n):
            if axes[k] & level:
                axes[0] ^= below
            else:
                swap = (axes[0] ^ axes[k]) & below
                axes[0] ^= swap
                axes[k] ^= swap
        level >>= 1
    for k in range(1, n):
        axes[k] ^= axes[k - 1]
    flip, level = 0, 1 << (bits - 1)
    while level > 1:
        if axes[-1] & level:
            flip ^= level - 1
        level >>= 1
    index = 0
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            index = index << 1 | ((axes[k] ^ flip) >> bit & 1)
    return index


def category_level(value: Column) -> Column:
    """Level of a categorical dimension: a hash, so that a predicate on the value gives one level; null is 0."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit(LEVELS))).cast("int")


def magnitude_level(value: Column) -> Column:
    """Level of a size: its power of two, at most 15; null is 0."""
    return F.least(F.lit(LEVELS - 1), F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)) + 1))).cast("int")


def placed(docs: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, size, text_crc32, the three levels, the cell and its slice."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        category_level(F.col("source")).alias("source_level"),
        category_level(F.col("lang")).alias("lang_level"),
        magnitude_level(F.char_length(text)).alias("length_level"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("slice"),
    ).withColumn("cell", (F.col("source_level") * LEVELS + F.col("lang_level")) * LEVELS + F.col("length_level"))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve and the three levels.

    Law ``rows``: shards are consecutive runs of the curve whose row counts differ by one at most. Within a cell
    the order is by hash slice, then doc_id, checksum and size; rows equal in all of these are interchangeable.
    Null texts count as empty; repeated rows are placed each. An empty table gives no rows, extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = staged(placed(docs), "hilbert-rows")
    total = rows.count()
    curve = spark.createDataFrame(
        [((x * LEVELS + y) * LEVELS + z, hilbert_index((x, y, z))) for x in range(LEVELS) for y in range(LEVELS) for z in range(LEVELS)],
        "cell int, curve int",
    )
    counts = rows.groupBy("cell", "slice").agg(F.count("*").alias("n")).join(F.broadcast(curve), "cell")
    cells = counts.groupBy("curve").agg(F.sum("n").alias("in_cell"))  # 4,096 rows at most
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve", F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("cell_base"))
    inside = Window.partitionBy("curve").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(
        counts.withColumn("slice_base", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(cells), "curve")
        .select("cell", "slice", "curve", (F.col("cell_base") + F.col("slice_base")).alias("base")),
        "hilbert-bases",
    )
    order = Window.partitionBy("cell", "slice").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.join(bases, ["cell", "slice"]).withColumn("rank", F.col("base") + F.row_number().over(order) - 1)
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", shard)
        .withColumn("slot", F.col("rank") - start)
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "curve", "source_level", "lang_level", "length_level",
        )
    )


def manifest(sharded: DataFrame) -> DataFrame:
    """What a reader prunes by: row counts, bytes and the range of every level, a row a shard."""
    ranges = [f(c).alias(f"{f.__name__}_{c}") for c in ("source_level", "lang_level", "length_level") for f in (F.min, F.max)]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = 100_000) -> None:
    """Write ``docs`` into ``path/shard=N`` in slot order; doc_id must be unique, and a column ``shard`` gives way. Each text
    is shuffled once."""
    where = hilbert_shards(docs, shards).select(F.col("doc_id").alias("__id"), "shard", "slot")
    rows = docs.select(F.struct(*docs.columns).alias("__row"))
    out = rows.join(where, rows["__row.doc_id"].eqNullSafe(where["__id"]))
    out = out.repartition("shard", F.expr(f"slot div {rows_per_file}")).sortWithinPartitions("shard", "slot")
    out.select(*(F.col("__row")[c].alias(c) for c in docs.columns if c != "shard"), "shard").write.partitionBy("shard").parquet(path)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hilbert_shards`` of all documents, in sixteen shards."""
    return hilbert_shards(documents(spark, sf_dir))
