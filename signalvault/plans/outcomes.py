"""Roll-ups of chunk outcomes into shot outcomes and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalvault.fixed_values import COMPLETED, FAILED


def chunk_outcomes(outcomes: DataFrame) -> DataFrame:
    """(shot, config, chunk, exit_code) -> total and failed chunks per (shot, config)."""
    return outcomes.groupBy("shot", "config").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(F.col("exit_code") != 0).alias("failed_chunks"))


def nonempty_shots(shots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shots whose output exists and holds something."""
    return shots.join(nodes.select("shot").distinct(), "shot", "left_semi")


def shot_outcomes(outcomes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per shot: failed chunks and status. Without failures an empty output counts as one.

    One aggregation per side on ``shot`` (with map-side combining); the join reuses
    that partitioning.
    """
    failed = outcomes.groupBy("shot").agg(F.count_if(F.col("exit_code") != 0).alias("failed"))
    written = nodes.select("shot").distinct().withColumn("written", F.lit(True))
    lacking = (F.col("failed") == 0) & F.col("written").isNull()
    return (
        failed.join(written, "shot", "left")
        .select("shot", F.when(lacking, F.lit(1)).otherwise(F.col("failed")).cast("bigint")
                .alias("failed_chunks"))
        .withColumn("status", F.when(F.col("failed_chunks") == 0, COMPLETED).otherwise(FAILED))
    )


def progress(ledger: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: completed and failed over the whole ledger, and the number requested."""
    counts = ledger.select("shot", "status").distinct().agg(
        F.count_if(F.col("status") == COMPLETED).alias("completed"),
        F.count_if(F.col("status") == FAILED).alias("failed"))
    total = requested.agg(F.count(F.lit(1)).alias("requested"))
    return counts.withColumn("requested", total.scalar())
