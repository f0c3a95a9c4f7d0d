"""Catalogue sources: files, unions of sources, synthetic catalogues, the catalogue view of a parts table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..schema import ITEM, SourceError, item_id, normalised_items

#: Sources read at a time.
CONCURRENCY = 8


def read_items(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    """Items of a ``.jsonl`` file (one object a line) or a ``.json`` one (a list, or an object with ``tools``).

    An invalid item of a list fails the job with its index from 0 in the message.
    """
    if path.endswith(".jsonl"):
        df = spark.read.schema(ITEM).option("mode", "FAILFAST").json(path)
    else:
        whole = spark.read.text(path, wholetext=True)
        listed = F.from_json("value", ArrayType(ITEM), {"mode": "FAILFAST"})
        nested = F.from_json("value", StructType([StructField("tools", ArrayType(ITEM))]), {"mode": "FAILFAST"})["tools"]
        df = whole.select(F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(nested)).alias("position", "item")).select("position", "item.*")
    out = normalised_items(df)
    return stamped(out, source_id) if source_id else out


def stamped(df: DataFrame, source_id: str) -> DataFrame:
    return df.withColumn("source_id", F.lit(source_id))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All rows of all sources (a bag), each with its own source_id."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def discover(spark: SparkSession, readers: Mapping[str, Callable[[], DataFrame]], tolerate_failures: bool = True, concurrency: int = CONCURRENCY) -> tuple[DataFrame | None, DataFrame]:
    """(rows of the sources that answer, failures as source_id and error). Readers run concurrently."""

    def read(item: tuple[str, Callable[[], DataFrame]]) -> tuple[str, DataFrame | None, str | None]:
        try:
            df = item[1]()
            df.schema  # analysis happens here, so a missing file fails now
            return item[0], stamped(df, item[0]) if "source_id" not in df.columns else df, None
        except Exception as error:
            if not tolerate_failures:
                raise SourceError(f"{item[0]}: {error}") from error
            return item[0], None, str(error).splitlines()[0][:500]

    with ThreadPoolExecutor(concurrency) as pool:
        found = list(pool.map(read, readers.items()))
    good = [df for _, df, _ in found if df is not None]
    failures = spark.createDataFrame([(n, e) for n, _, e in found if e is not None], "source_id string, error string")
    return (union_sources(good) if good else None), failures


#: Words of the synthetic catalogue.
FILLER_VERBS = ("get", "list", "create", "update", "delete", "search", "export", "sync")
FILLER_NOUNS = ("barge", "beacon", "buoy", "cable", "chart", "crane", "depot", "dock", "ferry", "gauge", "harbour", "jetty", "keel", "lantern", "mast", "pilot", "quay", "sluice", "tide", "wharf")
#: Areas and what is done in each of the core items.
CORE_AREAS = ("berths", "cargo", "crews", "customs", "fuel", "moorings", "tariffs", "weather")
CORE_WORK = (("find", "Find {0} by name, place or date.", "low"), ("check", "Check the present state of {0}.", "low"), ("book", "Book or reserve {0} for a ship.", "medium"), ("change", "Change what is recorded about {0}.", "medium"), ("cancel", "Cancel {0} and release what they hold.", "high"))


def filler_catalogue(spark: SparkSession, n: int) -> DataFrame:
    """n synthetic items, verbs times nouns in turn, numbered; any size without driver memory."""
    verbs, nouns = F.array(*map(F.lit, FILLER_VERBS)), F.array(*map(F.lit, FILLER_NOUNS))
    k = F.col("id")
    verb = F.element_at(verbs, (k % len(FILLER_VERBS) + 1).cast("int"))
    noun = F.element_at(nouns, (F.floor(k / len(FILLER_VERBS)) % len(FILLER_NOUNS) + 1).cast("int"))
    base = spark.range(n).select(k.alias("id"), verb.alias("verb"), noun.alias("noun"))
    name = F.concat_ws("_", "verb", "noun", "id")
    return base.select(
        name.alias("name"), F.concat(F.col("noun"), F.lit("s")).alias("namespace"), item_id(F.concat(F.col("noun"), F.lit("s")), name).alias("tool_id"),
        F.concat(F.initcap("verb"), F.lit(" one or more "), F.col("noun"), F.lit(" records.")).alias("description"),
    )


def core_catalogue(spark: SparkSession) -> DataFrame:
    """Forty described items: five kinds of work in eight areas."""
    rows = [(f"{verb}_{area}", area, about.format(area), [area, "write" if risk != "low" else "read"], risk) for area in CORE_AREAS for verb, about, risk in CORE_WORK]
    return normalised_items(spark.createDataFrame(rows, "name string, namespace string, description string, tags array<string>, risk string"))


def sized_catalogue(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """The core items and as many synthetic ones as make ``n``, with ``position``: an order drawn by ``seed``."""
    core = core_catalogue(spark).select("name", "namespace", "tool_id", "description")
    both = core.unionByName(filler_catalogue(spark, max(0, n - len(CORE_AREAS) * len(CORE_WORK))))
    return both.withColumn("position", F.xxhash64("tool_id", F.lit(seed)))


def from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue that a parts table stands for."""
    return catalogue_view(spark.read.parquet(f"{sf_dir}/part.parquet"))


def catalogue_view(part: DataFrame, *more: str) -> DataFrame:
    """Parts as items; ``more`` columns are passed on."""
    key = F.col("p_partkey")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), key)
    none = F.array().cast("array<string>")
    return part.select(
        key.alias("key"),
        name.alias("name"),
        F.lower("p_type").alias("namespace"),
        item_id(F.lower("p_type"), name).alias("tool_id"),
        F.concat(F.col("p_name"), F.lit(" of type "), F.col("p_type")).alias("description"),
        F.array(F.lower("p_brand"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("tags"),
        (F.col("p_size") % 4).cast("int").alias("risk_level"),
        (key % 4).cast("int").alias("cost_level"),
        F.when(F.col("p_size") > 40, F.array(F.lit("write"))).otherwise(none).alias("required_scopes"),
        F.when(key % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), key % 3)).alias("owner"),
        F.concat(F.lit("src"), key % 4).alias("source_id"),
        *more,
    )


def changed_view(part: DataFrame) -> DataFrame:
    """A later version of the same catalogue: a tenth of the rows gone, a tenth new, descriptions and tiers changed."""
    key = F.col("key")
    kept = catalogue_view(part).filter(key % 10 != 0)
    edited = kept.withColumn("description", F.when(key % 7 == 0, F.concat(F.col("description"), F.lit(" (revised)"))).otherwise(F.col("description")))
    edited = edited.withColumn("risk_level", F.when(key % 11 == 0, 3).otherwise(F.col("risk_level")).cast("int"))
    added = catalogue_view(part.filter(F.col("p_partkey") % 10 == 0).withColumn("p_partkey", F.col("p_partkey") + 10_000_000))
    return edited.unionByName(added)
