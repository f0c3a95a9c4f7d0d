"""Line dedup by site-relative frequency, in DataFrame functions only.

A line that more than a given share of a host's pages carry is that site's boilerplate and is dropped there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_groups, staged

#: Share of a host's pages above which a line is boilerplate, and the pages that must carry it at least.
RATIO, MIN_PAGES = 0.05, 3
#: Boilerplate tables up to so many lines (8 bytes each) are broadcast; beyond that hosts are joined by a shuffle, but for
#: the hot ones, whose lines are broadcast.
MAX_BROADCAST_LINES = 1_000_000


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source") -> DataFrame:
    """host, line (64-bit hash of the line without outer spaces) of all boilerplate lines.

    Pages are a host's distinct texts, so copies of one page don't make its lines boilerplate. Blank lines never
    are. A host has at most (lines a page / ratio) such lines. Counting combines map-side.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    pages = docs.select(F.col(host_col).alias("host"), F.xxhash64("text").alias("page"), F.array_distinct(F.transform(lines, _line_hash)).alias("lines"))
    pages = staged(pages.groupBy("host", "page").agg(F.any_value("lines").alias("lines")), "lines-pages")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    sized = counts.join(totals.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host")))
    return sized.filter(F.col("n") > F.lit(float(ratio)) * F.col("pages")).select("host", "line")


def _host(host: Column) -> Column:
    """A host as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def dedup_lines(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", counts: bool = True) -> DataFrame:
    """``docs`` without boilerplate lines, plus ``n_lines`` (before) and ``n_dropped`` unless ``counts`` is false.

    Texts without such a line come back unchanged, null texts stay null with 0 lines, and a null host is a host of
    its own. Rows, repeated ones too, are neither added nor lost; an empty table gives none. Extra columns are kept,
    whatever their names, but for those called as the two counts. No text is shuffled while the boilerplate table is
    small enough to broadcast; beyond that only texts of hosts that aren't hot are, by host.
    """
    found = staged(boilerplate(docs, ratio, min_pages, host_col), "lines-boilerplate")
    by_host = found.groupBy(_host(F.col("host")).alias("__host")).agg(F.collect_set("line").alias("__drop"))
    rows = docs.select(F.struct(*docs.columns).alias("__row")).withColumn("__host", _host(F.col("__row")[host_col]))
    if found.count() <= MAX_BROADCAST_LINES:
        joined = rows.join(F.broadcast(by_host), "__host", "left")
    else:
        sizes = rows.groupBy("__host").agg(F.count("*").alias("__n"))
        joined = join_groups(rows, staged(by_host.join(sizes, "__host"), "lines-hosts"), ["__host"], "__n", max(rows.count(), 1), "left")
    joined = joined.withColumn("__lines", F.split("__row.text", "\n"))
    kept = F.filter("__lines", lambda x: ~F.array_contains("__drop", _line_hash(x)) | (F.trim(x) == ""))
    joined = joined.withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(kept))
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    numbers = {"n_lines": count("__lines"), "n_dropped": count("__lines") - count("__kept")} if counts else {}
    columns = [F.array_join("__kept", "\n").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns if c not in numbers]
    return joined.select(*columns, *(v.alias(k) for k, v in numbers.items()))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dedup_lines`` of all documents."""
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "source", "text", "n_lines", "n_dropped")


OP6_SQL = r"""
with p as (select distinct source, text from documents),
l as (
  select source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) as line from p
),
n as (select source, line, count(*) as n from l group by all),
h as (select source, count(*) as pages from p group by source),
b as (
  select n.source, list(line) as drop from n join h on n.source is not distinct from h.source
  where n >= 3 and n > 0.05::double * pages group by n.source
),
d as (select doc_id, documents.source, string_split(text, chr(10)) as lines, coalesce(drop, []) as drop from documents left join b on documents.source is not distinct from b.source),
k as (select *, list_filter(lines, lambda x: trim(x) = '' or not list_contains(drop, trim(x))) as kept from d)
select doc_id, source, array_to_string(kept, chr(10)) as text, coalesce(len(lines), 0)::bigint as n_lines,
       (coalesce(len(lines), 0) - coalesce(len(kept), 0))::bigint as n_dropped
from k
"""
