"""Line-oriented text inputs: shot lists and rename mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalvault.fixed_values import COMMENT_MARK, MAPPING_TOKENS
from signalvault.session import cut_lineage

# White space around the entries of lists and catalogs.
BLANKS = " \t\n\x0b\f\r"

# White space between and around the names of a mapping, Unicode's included.
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def tokens(text: Column) -> Column:
    return F.split(strip(text), rf"{_SPACE}+")


def read_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per small file: source, text."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def without_end(text: Column, end: str) -> Column:
    return F.when(text.endswith(end), F.left(text, F.length(text) - len(end))).otherwise(text)


def lines_of(text: Column, any_end: bool = False) -> Column:
    """Array of lines; a final line break ends the last line and starts none. A carriage
    return before a line break belongs to it; with ``any_end`` a lone one ends a line too."""
    if any_end:
        text = F.regexp_replace(text, "\r\n?", "\n")
    return F.transform(F.split(without_end(text, "\n"), "\n"), lambda x: without_end(x, "\r"))


def numbered_lines(texts: DataFrame, *by: str, any_end: bool = False) -> DataFrame:
    """(by..., text) -> (by..., n, line), n from 1. Narrow: no shuffle."""
    return (
        texts.select(*by, F.posexplode(lines_of(F.col("text"), any_end)).alias("pos", "line"))
        .select(*by, (F.col("pos").cast("bigint") + 1).alias("n"), "line")
    )


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """A text file of any size as (source, block, id, line): ``block`` is the first byte of
    the split that a line was read with, ``id`` rises with the lines of a split. A carriage
    return before a line feed belongs to it, a byte order mark is dropped. The splits are
    written down, because they may be cut differently when planned again.
    """
    return cut_lineage(spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        without_end(F.col("value"), "\r").alias("line")))


def read_lines(spark: SparkSession, path: str, any_end: bool = False) -> DataFrame:
    """A text file of any size as (source, n, line), the same way for every size.

    Lines end at a line feed, and a carriage return before it belongs to it. A lone one
    is text, as in shot lists, or ends a line too (``any_end``), as in mappings. Each
    split of a file numbers its own lines, and the line counts of the earlier splits
    (one small row per split) shift them.
    """
    raw = read_splits(spark, path).select(
        "source", "block", "id", (F.split("line", "\r") if any_end else F.array("line")).alias("lines"))
    count = F.size("lines").cast("bigint")
    below = Window.partitionBy("source").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (
        raw.groupBy("source", "block")
        .agg(F.min("id").alias("first_id"), F.sum(count).alias("in_split"))
        .select("source", "block", "first_id",
                F.coalesce(F.sum("in_split").over(below), F.lit(0)).alias("before"))
    )
    inside = F.col("id") - F.col("first_id")
    if any_end:  # a window holds one split at most
        above = Window.partitionBy("source", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        raw = raw.withColumn("above", F.coalesce(F.sum(count).over(above), F.lit(0)))
        inside = F.col("above")
    return (
        raw.join(starts, ["source", "block"])
        .select("source", (F.col("before") + inside + 1).alias("start"), F.posexplode("lines").alias("pos", "line"))
        .select("source", (F.col("start") + F.col("pos")).alias("n"), "line")
    )


def shot_list(lines: DataFrame) -> DataFrame:
    """Requested shots of a list: no blanks, no comments; order and repeats stay."""
    shot = F.col("shot")
    return (
        lines.withColumn("shot", strip_blanks(F.col("line"))).drop("line")
        .where((shot != "") & ~shot.startswith(COMMENT_MARK))
    )


def mapping_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rename mapping -> (line_no, old_name, new_name) and the rejected lines."""
    kept = (
        lines.withColumn("line", strip(F.col("line")))
        .where((F.col("line") != "") & ~F.col("line").startswith(COMMENT_MARK))
        .withColumn("parts", tokens(F.col("line")))
    )
    extra = [c for c in lines.columns if c not in ("n", "line")]
    good = kept.where(F.size("parts") == MAPPING_TOKENS).select(
        *extra, F.col("n").alias("line_no"), F.get("parts", F.lit(0)).alias("old_name"),
        F.get("parts", F.lit(1)).alias("new_name"))
    bad = kept.where(F.size("parts") != MAPPING_TOKENS).select(
        *extra, F.col("n").alias("line_no"), "line", F.size("parts").alias("n_tokens"))
    return good, bad
