"""Mixing sources to target weights by hash-threshold histograms; built-in functions only.

Every document has a fixed hash of LEVELS * BITS bits. Words are summed by source and the first BITS bits of the
hash (a histogram of at most 2**BITS rows a source, summed map-side); the running sum of a source tells the bucket
in which its budget ends, and only that bucket is summed again by the next bits. After the last level the budget is
one threshold per source, and the mix is a filter: hash < threshold. Nothing is sorted. A larger budget has a larger
threshold, so smaller mixes are nested in larger ones, but for one document a source: of those beyond the threshold,
the one whose size comes closest to the words still wanted is taken too. A budget above the source takes every document once or twice
whole and thresholds the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalvault.session import cut_lineage

BITS = 12
LEVELS = 5
WEIGHTS = (5, 2, 1)
MOST = 3
"""No source, and no document, is taken more often."""
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """LEVELS * BITS bits of md5; null is a value of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``target`` for each row of (source, source_size). Sources by code point, null last, weigh ``weights``, repeating,
    and share all sizes; none gets more than ``most`` times its size, what is over goes to the others by weight.

    That is min(most * size, level * weight) with one level for all: the sources that reach their limit are those of
    the least limit per weight, so running sums over the sources in that order give the level. One row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    found = weighed.withColumn("level", level).withColumn("place", F.row_number().over(order))
    # the first source whose limit is not reached at its level sets the level
    first = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)
    free = first["level"]
    return found.select("source", "source_size", F.coalesce(F.least("limit", free * F.col("weight")), F.col("limit")).alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of ``documents``: doc_id, source, size, source_size, target, copies, taken (size * copies).

    Sizes are words of the text (null: 0). Rows of one doc_id, and rows whose doc_id is null, share a hash and are
    taken together. A source without words has target 0 and gives nothing.
    """
    given = cut_lineage(_sized(documents))
    return _copied(given, thresholds(given, weights, most), most) \
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of the mix: all columns of ``documents``, each row as often as the mix takes it (see ``mix``)."""
    limits = thresholds(cut_lineage(_sized(documents)), weights, most)
    key = documents.select(F.struct("*").alias("document"), F.col("source").cast("string").alias("source"), document_hash(F.col("doc_id").cast("long")).alias("hash"))
    return _copied(key, limits, most).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")


def _sized(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size")) \
        .withColumn("hash", document_hash(F.col("doc_id")))


def _copied(rows: DataFrame, limits: DataFrame, most: int) -> DataFrame:
    """``rows`` (source, hash, ...) with ``copies``; one row of ``limits`` a source, which Spark broadcasts while small."""
    more = (F.col("hash") < F.col("threshold")) | F.coalesce(F.col("hash") == F.col("extra"), F.lit(False))
    copies = F.col("whole") + F.when(F.col("whole") >= most, 0).when(more, 1).otherwise(0)
    return rows.join(limits, _same("source", "s")).withColumn("copies", copies.cast("int"))


def thresholds(given: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: how often all of ``given`` (source, size, hash) is taken, the threshold below which once more, and
    the hash of the one document that fills the rest."""
    sources = cut_lineage(targets(given.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0))
    open_ = sources.withColumn("whole", whole.cast("int")) \
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")) \
        .select(F.col("source").alias("s"), "source_size", "target", "whole", "budget", F.lit(0).cast("long").alias("prefix"))
    space = LEVELS * BITS
    for level in range(LEVELS):
        # words of the bucket in which the budget of the source ends, by its next bits
        width = space - (level + 1) * BITS
        part = given if level == 0 else given.join(open_.select("s", "prefix"), _same("source", "s")) \
            .where(F.shiftright("hash", width + BITS) == F.col("prefix"))
        histogram = part.groupBy("source", F.shiftright("hash", width).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        steps = histogram.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)).cast("double"))
        # the last bucket that begins within the budget
        edge = steps.join(open_.select("s", "budget"), _same("source", "s")).where(F.col("before") <= F.col("budget")) \
            .groupBy("source").agg(F.max(F.struct("bucket", "before", "words")).alias("edge"))
        open_ = cut_lineage(open_.join(edge, _same("s", "source"), "left").select(
            "s", "source_size", "target", "whole", (F.col("budget") - F.coalesce("edge.before", F.lit(0.0))).alias("budget"),
            F.coalesce("edge.bucket", F.lit(0).cast("long")).alias("prefix"), F.coalesce("edge.words", F.lit(0).cast("long")).alias("last")))
    fits = F.col("last") <= F.col("budget")
    limits = cut_lineage(open_.select("s", "source_size", "target", "whole", (F.col("prefix") + fits.cast("long")).alias("threshold"),
                                      (F.col("budget") - F.when(fits, F.col("last")).otherwise(0)).alias("rest")))
    # one document beyond the threshold fills the rest best
    gap = F.abs(F.col("rest") - F.col("size"))
    fill = given.join(limits.where(F.col("whole") < most).select("s", "threshold", "rest"), _same("source", "s")) \
        .where((F.col("hash") >= F.col("threshold")) & (gap < F.col("rest"))) \
        .groupBy("s").agg(F.min(F.struct(gap.alias("gap"), "hash"))["hash"].alias("extra"))
    return cut_lineage(limits.join(fill.withColumnRenamed("s", "f"), _same("s", "f"), "left").drop("f", "rest"))
