"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot signature is a common word and the chain of content words that follow it. Function words hold together
what an author wrote, so navigation and boilerplate give few of them. A fingerprint is the sorted set of a text's
signatures; sets are partitioned by length, since sets whose sizes differ too much can't be alike, and compared
by Jaccard similarity.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, join_groups, staged

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were with "
    "au aux avec ce dans de des du elle en est et il la le les ou par pour qui que sur un une "
    "als am auf aus das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "al con del el las lo los más no para por se su una y"
)
#: Content words in a chain, and how many anchors a chain may pass over.
CHAIN, PASSED = 2, 3
#: One word in so many, chosen by its hash, is an anchor too; that covers texts without function words.
HASHED = 16

_UNSPACED = "[\\u0E00-\\u0EFF\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF]"

_SEEN = sorted(set(ANCHORS.split()))
_ALTERNATIVES = "|".join(c + "(?:" + "|".join(sorted((w[1:] for w in words), key=len, reverse=True)) + ")" for c, words in ((c, list(g)) for c, g in groupby(_SEEN, key=lambda w: w[0])))


def signatures(text: Column) -> Column:
    """The sorted set of 32-bit spot signatures of a text; empty for a null or empty one.

    A text with words has at least the signature of its start; one of marks only has its whole as signature. Scripts
    that are written without spaces (Han, kana, Thai, Lao, Khmer) have a word a letter.
    """
    parted = F.when(text.rlike(_UNSPACED), F.regexp_replace(text, _UNSPACED, " $0 ")).otherwise(text)
    words = F.trim(F.regexp_replace(F.lower(parted), r"[^\p{L}\p{N}]+", " "))
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    anchors = F.regexp_extract_all(padded, F.lit(f" ({_ALTERNATIVES})(?= )"), F.lit(1))
    pieces = F.split(padded, f" (?:{_ALTERNATIVES})(?= )")
    plain = F.split(words, " ")

    def spot(of: Column) -> Column:
        def one(anchor: Column, k: Column) -> Column:
            behind = F.ltrim(F.concat_ws("", F.slice(of["p"], k + 2, F.lit(PASSED + 1))))
            return F.hash(anchor, F.rtrim(F.substring_index(behind, " ", CHAIN)))

        return F.transform(of["a"], one)

    def hashed(of: Column) -> Column:
        last = F.size(of["w"]) - CHAIN
        at = F.filter(F.sequence(F.lit(1), last), lambda k: (k == 1) | (F.pmod(F.hash(F.element_at(of["w"], k)), F.lit(HASHED)) == 0))
        chain = lambda k: F.hash(*(F.element_at(of["w"], k + j) for j in range(CHAIN + 1)))
        return F.when(last >= 1, F.transform(at, chain)).otherwise(F.array(F.hash(F.array_join(of["w"], " "))))

    parts = F.struct(anchors.alias("a"), pieces.alias("p"), plain.alias("w"))
    both = F.transform(F.array(parts), lambda x: F.concat(spot(x), hashed(x)))
    found = F.array_sort(F.array_distinct(F.element_at(both, 1)))
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<int>"))
        .when(words == "", F.array(F.hash(text)))
        .otherwise(found)
    )


def fingerprint(sigs: Column) -> Column:
    """The set as text: its length, then eight hexadecimal digits a signature."""
    digits = F.transform(sigs, lambda x: F.lpad(F.hex(F.when(x < 0, x.cast("long") + (1 << 32)).otherwise(x.cast("long"))), 8, "0"))
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.lower(F.array_join(digits, "")))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing where their lengths alone keep it below ``least``.

    Two empty sets are alike (1), an empty and a non-empty one are not (0).
    """
    few, many = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    return F.when(many == 0, 1.0).when((few == 0) | (few / many < least), 0.0).otherwise(exact).cast("double")


#: Sets in a block; two blocks of one bucket are compared in one row.
BLOCK = 128


def spot_links(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b, likeness: all pairs of texts whose fingerprints are alike to ``least`` or more, a below b.

    Equal sets form one class under its smallest id; null and empty texts have no pairs, an empty table gives no rows and
    extra columns are ignored. A set of n signatures looks only at its n - ceil(least * n)
    + 1 rarest: alike sets share one of those. Postings are split by length partition, sets meet only in their own
    and the next one. All sets there are compared, two blocks at a time inside a task, each pair only at the first
    signature it shares; just the alike ones become rows.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    sigs = docs.select("doc_id", signatures(F.col("text")).alias("s")).filter("size(s) > 0")
    sets = sigs.groupBy("s").agg(F.min("doc_id").alias("id"))
    sets = staged(sets.withColumn("u", F.monotonically_increasing_id()).withColumn("n", F.size("s")), "spots-sets")
    spread_ = sets.select("u", "n", F.explode("s").alias("x"))
    common = staged(spread_.groupBy("x").agg(F.count("*").alias("df")), "spots-common")
    total = common.agg(F.coalesce(F.sum("df"), F.lit(1))).first()[0]
    rare = join_groups(spread_, common, ["x"], "df", total)
    order = Window.partitionBy("u").orderBy("df", "x")
    shown = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1  # products like 0.7 * 10 come out a little too large
    prefix = rare.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= shown).filter("df > 1")
    heads = prefix.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "x"))), lambda y: y["x"]).alias("p"))
    width = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least)) + 1e-9) if least < 1 else F.lit(0)
    headed = staged(sets.join(heads, "u").withColumn("own", width.cast("long")), "spots-heads")
    dealt = headed.select("u", F.explode("p").alias("x"), "own").withColumn("l", F.explode(F.array(F.col("own"), F.col("own") + 1))).drop("own")
    dealt = staged(dealt, "spots-dealt")
    buckets = dealt.groupBy("x", "l").agg(F.count("*").alias("m")).filter("m > 1")
    met = join_groups(dealt, buckets, ["x", "l"], "m", max(dealt.count(), 1))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = met.withColumn("block", F.pmod(F.xxhash64("u", "x"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    member = F.struct("u", "id", "own", "block", "s", "p")
    groups = met.join(headed, "u").groupBy("x", "l", "i", "j").agg(F.collect_list(member).alias("g")).filter("size(g) > 1")

    def against(a: Column) -> Column:
        def meets(b: Column) -> Column:
            apart = (F.col("i") == F.col("j")) | (a["block"] != b["block"])
            here = (a["u"] < b["u"]) & apart & (F.greatest(a["own"], b["own"]) == F.col("l"))
            near = F.least(F.size(a["s"]), F.size(b["s"])) / F.greatest(F.size(a["s"]), F.size(b["s"])) >= least
            return here & near & (F.get(F.array_intersect(a["p"], b["p"]), F.lit(0)) == F.col("x"))

        def link(b: Column) -> Column:
            return F.struct(F.least(a["id"], b["id"]).alias("a"), F.greatest(a["id"], b["id"]).alias("b"), likeness(a["s"], b["s"], least).alias("likeness"))

        return F.filter(F.transform(F.filter(F.col("g"), meets), link), lambda y: y["likeness"] >= least)

    return groups.select(F.explode(F.flatten(F.transform("g", against))).alias("y")).select("y.*").filter("a < b")


#: Documents are put in order by slices of the id range: at most MAX_SLICES quantiles of about SLICE_ROWS rows,
#: each in equal parts beyond that; at most MAX_BUCKETS in all, whose first ids are broadcast (16 MB).
SLICE_ROWS, MAX_SLICES, MAX_BUCKETS = 64, 2048, 1 << 20


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (with doc_id and __order) with ``next_<column>``: the row of the next doc_id, after the last the first.

    One shuffle and no global sort: a bucket is a range of ids, and its first row is also dealt to the bucket
    before it, to follow that one's last row. Equal ids follow each other by __order.
    """
    ids = staged(rows.select("doc_id"), "spots-ids")
    total = max(ids.count(), 1)
    slices = max(1, min(MAX_SLICES, total // SLICE_ROWS))
    parts = max(1, min(MAX_BUCKETS // slices, total // slices // 1024))
    at = [k / slices for k in range(slices)]
    bounds = ids.agg(F.percentile_approx("doc_id", at, slices * 16).alias("q"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    edges = sorted({bounds.lo, *(bounds.q or [])}) if bounds.lo is not None else [0]
    tops = [*edges[1:], max(edges[-1], bounds.hi or 0)]
    steps = F.array(*(F.lit(1 << k) for k in range(len(edges).bit_length() - 1, -1, -1)))
    array, upper = F.array(*map(F.lit, edges)).cast("array<bigint>"), F.array(*map(F.lit, tops)).cast("array<double>")

    def climb(low: Column, power: Column) -> Column:
        up = low + power
        return F.when(F.coalesce(F.try_element_at(array, up) <= F.col("doc_id"), F.lit(False)), up).otherwise(low)

    rank = F.greatest(F.aggregate(steps, F.lit(0), climb), F.lit(1))
    low = F.element_at(array, F.col("__slice")).cast("double")  # ids may be further apart than a long holds
    width = F.greatest(F.element_at(upper, F.col("__slice")) - low, F.lit(1.0))
    part = F.coalesce(F.least(F.lit(parts - 1), F.floor((F.col("doc_id").cast("double") - low) / width * parts)), F.lit(0))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("__slice", rank).withColumn("__bucket", (F.col("__slice") * parts + part).cast("long"))

    firsts = dealt(ids).groupBy("__bucket").agg(F.min("doc_id").alias("__first"))
    ring = Window.orderBy("__bucket")  # MAX_BUCKETS narrow rows at most
    firsts = staged(firsts.withColumn("__before", F.lag("__bucket").over(ring)), "spots-firsts")
    last = firsts.agg(F.max("__bucket")).first()[0]
    side = F.broadcast(firsts.select(F.col("__bucket").alias("__b"), "__first", F.coalesce("__before", F.lit(last)).alias("__before")))
    marked = dealt(rows).join(side, (F.col("__bucket") == F.col("__b")) & F.col("doc_id").eqNullSafe(F.col("__first")), "left")
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("__before").alias("bucket"), F.lit(1).alias("guest"))
    spread = marked.withColumn("__to", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    order = Window.partitionBy("__to.bucket").orderBy("__to.guest", "doc_id", "__order")
    led = spread.withColumn("__next", F.lead(F.struct(*columns)).over(order)).filter("__to.guest = 0")
    return led.select(*rows.columns, *(F.col("__next")[c].alias(f"next_{c}") for c in columns)).drop("__order")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text; null counts as empty. No shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), fingerprint(signatures(text)).alias("fingerprint"))


def edit_report(docs: DataFrame) -> DataFrame:
    """How far fingerprints bear edits: a row a document with the likeness to its edited text and to the next document.

    The edited text is the text with its last floor(n / 2) code points replaced by as many of the next document's
    first ones (or all). Null texts count as empty; repeated rows and rows without an id follow each other, in the order
    of their texts' hashes. Whole texts count however long; an empty table gives no rows, extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), signatures(text).alias("sigs"), F.xxhash64(text).alias("__order"))
    led = with_next(rows, ["text", "sigs"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    led = led.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return led.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edit_report`` of all documents."""
    return edit_report(documents(spark, sf_dir))
