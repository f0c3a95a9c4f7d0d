"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one counts hashed texts into the cells of a Bloom table and keeps the cells that were hit twice. Pass
two looks every row up in that table: rows whose cells were all hit twice are possibly repeated and only
those are shuffled and grouped by SHA-256; every other row is proven unique and passes straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_groups, staged

#: Cells per row; two probes a row then let about 1.4 % of the unique rows through to the shuffle.
CELLS_PER_ROW = 16
#: Largest table that is broadcast: 2**27 cells are at most 2**21 words of 64 cells (32 MB). Beyond 8 million rows each row
#: has one probe, about 6 % of the unique rows come through, and narrow rows are shuffled once to meet the table.
MAX_BROADCAST_BITS = 27


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, code points, SHA-256 of the normalised text. Reads each text once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text).cast("long").alias("__chars"),
        F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"),
    )


def table_bits(rows: int) -> int:
    return max(10, (max(rows, 1) * CELLS_PER_ROW - 1).bit_length())


def _probes(sha: Column, bits: int) -> list[Column]:
    """Two cells of a row; one only in a table too large to broadcast, so that rows are joined with it once."""
    mask = (1 << bits) - 1
    part = lambda at: F.conv(F.substring(sha, at, 15), 16, 10).cast("long").bitwiseAND(F.lit(mask))
    return [part(1), part(17)][: 2 if bits <= MAX_BROADCAST_BITS else 1]


def repeated_cells(digest: DataFrame, bits: int) -> DataFrame:
    """Pass one: words of 64 cells with a set bit for every cell that at least two probes hit, and the probes of these."""
    cells = digest.select(F.explode(F.array(*_probes(F.col("text_sha256"), bits))).alias("cell"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("n"))
    bit = F.when(F.col("n") > 1, F.expr("shiftleft(1L, cast(cell & 63 as int))")).otherwise(F.lit(0).cast("long"))
    words = counts.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.sum("n").alias("n"))
    return words.filter("bits <> 0")


def flag_possible(digest: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Pass two: ``maybe`` is false for rows proven unique. The table is broadcast while its size is bounded; beyond that
    the narrow rows are joined with it by word, and the words of frequent texts are broadcast."""
    out = digest
    for k, cell in enumerate(_probes(F.col("text_sha256"), bits)):
        side = words.select(F.col("word").alias(f"__w{k}"), F.col("bits").alias(f"__b{k}"), "n")
        out = out.withColumn(f"__c{k}", cell).withColumn(f"__w{k}", F.shiftright(f"__c{k}", 6))
        if bits <= MAX_BROADCAST_BITS:
            out = out.join(F.broadcast(side.drop("n")), f"__w{k}", "left")
        else:
            out = join_groups(out, side, [f"__w{k}"], "n", max(digest.count(), 1), "left").drop("n")
        hit = F.expr(f"coalesce((shiftright(__b{k}, cast(__c{k} & 63 as int)) & 1) = 1, false)")
        out = out.withColumn("maybe", hit if k == 0 else F.col("maybe") & hit)
    return out.select(*digest.columns, "maybe")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; a null text is an empty one, so null, empty
    and blank texts form one group. The row with most code points stays, then the smallest id, a null one last.
    Repeated rows (same id and text) count each and share ``kept``. Extra columns of ``docs`` are ignored; an empty table
    gives an empty result.
    """
    digest = staged(digests(docs, id_col, text_col), "exact-digest")
    total = digest.count()
    bits = table_bits(total)
    words = staged(repeated_cells(digest, bits), "exact-cells")
    flagged = flag_possible(digest, words, bits)
    possible = flagged.filter("maybe").drop("maybe")
    groups = staged(
        possible.groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), F.min(F.struct(-F.col("__chars"), F.col("doc_id").isNull(), F.col("doc_id"))).alias("first"))
        .filter("group_size > 1")
        .select("text_sha256", "group_size", F.col("first.doc_id").alias("keep_id")),
        "exact-groups",
    )
    unique = flagged.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    joined = join_groups(possible, groups, ["text_sha256"], "group_size", total, "left")
    grouped = joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return unique.unionByName(grouped)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_dedup`` of all documents."""
    return exact_dedup(documents(spark, sf_dir))


OP9_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), g as (
  select *, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""
