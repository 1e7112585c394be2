"""What is left to fetch, in which batches and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalvault.fixed_values import BATCH_SIZE, CHUNK_SIZE
from signalvault.functions.ordinals import dense_ordinal


def shots_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Inclusive range as (shot_no, shot)."""
    return spark.range(first, last + 1).select(
        F.col("id").alias("shot_no"), F.col("id").cast("string").alias("shot"))


def pending(requested: DataFrame, completed: DataFrame) -> DataFrame:
    """Requested shots less completed ones; repeats in the request stay.

    The completed side is made distinct first: that is where one shot could be hot
    and where an anti join cannot be split.
    """
    return requested.join(completed.select("shot").distinct(), "shot", "left_anti")


def batched(shots: DataFrame, position: str, size: int = BATCH_SIZE, name: str = "ordinal") -> DataFrame:
    """Add the global ordinal, the batch and the task inside the batch, all from 1."""
    numbered = dense_ordinal(shots, position, name)
    return (
        numbered.withColumn("batch", F.floor((F.col(name) - 1) / size) + 1)
        .withColumn("task", (F.col(name) - 1) % size + 1)
    )


def nth_shot(batches: DataFrame, batch: int, task: int) -> DataFrame:
    """The shot of one task; no row when the batch is shorter."""
    return batches.where((F.col("batch") == batch) & (F.col("task") == task))


def line_slice(lines: DataFrame, first: int, last: int, position: str = "n") -> DataFrame:
    return lines.where(F.col(position).between(first, last))


def chunked(catalog: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Add the chunk of each catalog entry; trees do not end a chunk."""
    return catalog.withColumn("chunk", F.floor((F.col("ordinal") - 1) / size) + 1)


def catalog_counts(catalog: DataFrame, size: int = CHUNK_SIZE, *by: str) -> DataFrame:
    by = by or ("config",)
    return catalog.groupBy(*by).agg(F.count(F.lit(1)).alias("n_signals")).withColumn(
        "n_chunks", F.ceil(F.col("n_signals") / size))


def chunk_counts(chunks: DataFrame, *by: str) -> DataFrame:
    by = by or ("config",)
    return chunks.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("n_signals"))


def tree_runs(chunks: DataFrame, *by: str) -> DataFrame:
    """Number the contiguous stretches of one tree inside a chunk, from 1.

    The windows are per chunk, and a chunk has at most the chunk size of rows.
    """
    by = by or ("config",)
    order = Window.partitionBy(*by, "chunk").orderBy("ordinal")
    starts = F.coalesce((F.lag("tree").over(order) != F.col("tree")).cast("int"), F.lit(1))
    return chunks.withColumn("_starts", starts).withColumn(
        "run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_starts")


def signals_by_run(runs: DataFrame, *by: str) -> DataFrame:
    """Ordered signals of every tree run of a chunk (bounded by the chunk size)."""
    by = by or ("config",)
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "signal")))
    return runs.groupBy(*by, "chunk", "run", "tree").agg(
        F.transform(listed, lambda e: e["signal"]).alias("signals"))


def chunk_plan(shots: DataFrame, catalog: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Every pending shot with every chunk of every config: the fetch units.

    Chunk bounds are arithmetic on the number of signals of a config, so a shot
    unfolds into its units in place: the one small row of counts (an entry per
    config file) comes in as a scalar subquery, and neither the shots nor the
    catalog are joined or shuffled.
    """
    counts = catalog.groupBy("config_no", "config").agg(F.count(F.lit(1)).alias("n"))
    per_config = counts.agg(F.array_sort(F.collect_list(
        F.struct("config_no", "config", "n"))).alias("configs"))
    columns = shots.columns
    return (
        shots.select(*columns, F.explode(per_config.scalar()).alias("c"))
        .select(*columns, "c.config_no", "c.config", "c.n", F.explode(
            F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("c.n") / size))).alias("chunk"))
        .withColumn("first_ordinal", (F.col("chunk") - 1) * size + 1)
        .withColumn("last_ordinal", F.least(F.col("chunk") * size, F.col("n")))
        .withColumn("n_signals", F.col("last_ordinal") - F.col("first_ordinal") + 1)
        .drop("n")
    )


def signal_plan(shots: DataFrame, catalog: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Every pending shot with every catalog signal and its chunk.

    An equi-join of the fetch units with the chunked catalog. No hint: Spark
    broadcasts the catalog while it is under the session's threshold.
    """
    units = chunk_plan(shots, catalog, size).drop("first_ordinal", "last_ordinal", "n_signals")
    entries = chunked(catalog, size).select("config_no", "config", "chunk", "ordinal", "tree", "signal")
    return units.join(entries, ["config_no", "config", "chunk"])


def signal_totals(shots: DataFrame, catalog: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Per catalog signal the shots that fetch it: number, first and last.

    Fetch units are counted per chunk first, so only as many rows meet the catalog as it has chunks.
    """
    units = chunk_plan(shots, catalog, size).groupBy("config_no", "config", "chunk").agg(
        F.count(F.lit(1)).alias("n_shots"), F.min("shot_no").alias("first_shot"), F.max("shot_no").alias("last_shot"))
    entries = chunked(catalog, size).select("config_no", "config", "chunk", "tree", "signal")
    return entries.join(units, ["config_no", "config", "chunk"]).drop("config_no")
