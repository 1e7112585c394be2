"""Signal catalogs: tree headers, signal items, one server line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalvault.fixed_values import SERVER_LINE, SIGNAL_ITEM, TREE_HEADER
from signalvault.sources import files
from signalvault.sources.text import lines_of, read_splits, strip_blanks


def header_blocks(lines: DataFrame, is_header: Callable[[Column], Column], *by: str) -> DataFrame:
    """Array column ``lines`` -> one row per header with the lines that follow it.

    Carries the last header forward inside each text without a window: the header
    places are found first and every block is a slice, so a text stays in its row
    and nothing is shuffled. Gives by..., block (from 0), first_head and head
    (places from 0), header, items. Lines above the first header belong to no block.
    """
    heads = F.filter(F.transform("lines", lambda x, i: F.when(is_header(x), i)), lambda i: i.isNotNull())
    blocks = F.transform(
        F.col("heads"),
        lambda head, k: F.struct(
            head.alias("head"), F.get("lines", head).alias("header"),
            F.slice("lines", head + 2,
                    F.coalesce(F.get("heads", k + 1), F.size("lines")) - head - 1).alias("items")),
    )
    return (
        lines.select(*by, "lines", heads.alias("heads"))
        .select(*by, F.get("heads", F.lit(0)).alias("first_head"),
                F.posexplode(blocks).alias("block", "b"))
        .select(*by, "block", "first_head", "b.head", "b.header", "b.items")
    )


def _is_header(line: Column) -> Column:
    return ~line.startswith(SIGNAL_ITEM) & line.rlike(TREE_HEADER)


def _tree(header: Column) -> Column:
    return F.btrim(header, F.lit(" :"))


def _signal(item: Column) -> Column:
    return strip_blanks(F.substring(item, F.lit(len(SIGNAL_ITEM) + 1), F.length(item)))


def parse_catalog(texts: DataFrame, *by: str) -> DataFrame:
    """(by..., text) -> (by..., ordinal, tree, signal), ordinals from 1 per text.

    With only headers and items left, an item's ordinal is its place less the
    headers and stray items before it: arithmetic, no ranking. For texts that fit
    a row; ``parse_catalog_lines`` has no such bound.
    """
    relevant = texts.select(*by, F.filter(
        lines_of(F.col("text")), lambda x: x.startswith(SIGNAL_ITEM) | x.rlike(TREE_HEADER)).alias("lines"))
    return (
        header_blocks(relevant, _is_header, *by)
        .select(*by, "header", (F.col("head") - F.col("block") - F.col("first_head")).alias("before"),
                F.posexplode("items").alias("pos", "item"))
        .select(*by, (F.col("before") + F.col("pos") + 1).cast("bigint").alias("ordinal"),
                _tree(F.col("header")).alias("tree"), _signal(F.col("item")).alias("signal"))
    )


def parse_catalog_lines(lines: DataFrame, *by: str, block: str = "block", place: str = "id") -> DataFrame:
    """(by..., block, place, line) -> (by..., block, place, ordinal, tree, signal): a catalog of any length, read in blocks.

    A catalog is what shares the columns ``by``; its blocks follow each other by ``block``, the lines of a block by
    ``place``, and neither is null. Ordinals run from 1 through all blocks. It is a scan in three steps: inside each
    block the last header so far and the items so far; over the blocks, one small row each, the header that reaches a
    block from above and the number of items before it; then items above the first header of their block take the
    one from above, or are dropped where there is none. A block is sorted in one task, so it should be no more than a
    split of a file; a catalog may have any number of them.
    """
    keys = [*by, block]
    line = F.col("line")
    so_far = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        lines.select(*keys, place, F.when(_is_header(line), _tree(line)).alias("header"),
                     F.when(line.startswith(SIGNAL_ITEM), _signal(line)).alias("signal"))
        .where(F.col("header").isNotNull() | F.col("signal").isNotNull())
        .select(*keys, place, "signal", F.last("header", ignorenulls=True).over(so_far).alias("tree"),
                F.count("signal").over(so_far).alias("rank"))
    )
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        inside.groupBy(*keys).agg(F.max_by("tree", place).alias("last_tree"), F.max("rank").alias("items"),
                                  F.count(F.when(F.col("tree").isNull(), F.col("signal"))).alias("stray"))
        .select(*keys, "items", "stray", F.last("last_tree", ignorenulls=True).over(above).alias("from_above"))
        .withColumn("dropped", F.when(F.col("from_above").isNull(), F.col("stray")).otherwise(F.lit(0)))
        .select(*keys, "from_above", (F.coalesce(F.sum(F.col("items") - F.col("dropped")).over(above), F.lit(0))
                                      - F.col("dropped")).alias("before"))
    )
    return (
        inside.where(F.col("signal").isNotNull()).join(blocks, keys)
        .select(*keys, place, (F.col("before") + F.col("rank")).alias("ordinal"),
                F.coalesce("tree", "from_above").alias("tree"), "signal")
        .where(F.col("tree").isNotNull())
    )


def server_of(text: Column) -> Column:
    """What follows the first colon of the server line(s), white space normalised."""
    return _server(F.filter(lines_of(text), lambda x: x.startswith(SERVER_LINE)))


def _server(found: Column) -> Column:
    rest = F.transform(found, lambda x: F.substring(x, F.lit(len(SERVER_LINE) + 1), F.length(x)))
    return strip_blanks(F.regexp_replace(F.array_join(rest, " "), r"\s+", " "))


def union_catalogs(catalogs: dict[str, DataFrame | None]) -> tuple[DataFrame, list[str]]:
    """Several catalogs in order, with their config names; absent ones are listed apart."""
    parts = [
        cat.withColumn("config", F.lit(name)).withColumn("config_no", F.lit(i))
        for i, (name, cat) in enumerate(catalogs.items(), start=1) if cat is not None
    ]
    if not parts:
        raise ValueError("no catalog present")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out, [name for name, cat in catalogs.items() if cat is None]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file of any size, or a folder of them, by splits -> (server, ordinal, tree, signal), ordinals per file."""
    lines = read_splits(spark, path)
    found = F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "line"))), lambda x: x["line"])
    servers = lines.where(F.col("line").startswith(SERVER_LINE)).groupBy("source").agg(_server(found).alias("server"))
    return (parse_catalog_lines(lines, "source").join(servers, "source", "left")
            .select(F.coalesce("server", F.lit("")).alias("server"), "ordinal", "tree", "signal"))


def read_catalogs(spark: SparkSession, paths: list[str], require_all: bool = False
                  ) -> tuple[DataFrame, list[str]]:
    """Read catalogs in order -> (config_no, config, server, ordinal, tree, signal), missing paths."""
    present = {p: files.exists(spark, p) for p in paths}
    absent = [p for p, there in present.items() if not there]
    if require_all and absent:
        raise FileNotFoundError(", ".join(absent))

    return union_catalogs({p: read_catalog(spark, p) if there else None for p, there in present.items()})


def missing_config_outcomes(shots: DataFrame, missing: list[str]) -> DataFrame:
    """A missing config counts as one failed chunk for every shot."""
    names = F.array(*[F.lit(m) for m in missing]) if missing else F.array().cast("array<string>")
    return shots.select(
        "shot", F.explode(names).alias("config"), F.lit(None).cast("bigint").alias("chunk"),
        F.lit(1).alias("exit_code"))
