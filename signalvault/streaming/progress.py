"""Progress over arriving outcomes, and the ledger as a streaming sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalvault.sources.ledger import append_ledger


def progress_stream(outcomes: DataFrame) -> DataFrame:
    """Distinct shots per status over a stream of (shot, status, ...), in parts: (status, part, odd_shot, n_shots).

    A shot may finish at any time, so there is no watermark; the state knows the pairs seen. Shot numbers are bits of
    a bitmap for each status and ``part``, 32,768 numbers wide, so that dense numbers need a bit each and one row for
    many. A shot that is no number is a part of its own. A repeated pair is the same bit again and is merged before
    the shuffle, however often it comes. ``progress_counts`` adds the parts up.
    """
    number = F.expr("try_cast(shot AS bigint)")
    plain = number.isNotNull() & (number >= 0) & (number.cast("string") == F.col("shot"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.when(F.col("number").isNotNull(), F.col("number") + 1).otherwise(F.lit(1))))
    return (
        outcomes.select("shot", "status", F.when(plain, number).alias("number"))
        .groupBy("status", F.bitmap_bucket_number(F.col("number") + 1).alias("part"),
                 F.when(F.col("number").isNull(), F.col("shot")).alias("odd_shot"))
        .agg(F.bitmap_count(bits).alias("n_shots"))
    )


def progress_counts(parts: DataFrame) -> DataFrame:
    """Shots per status from the parts that ``progress_stream`` keeps."""
    return parts.groupBy("status").agg(F.sum("n_shots").alias("n_shots"))


def start_ledger_sink(outcomes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append-if-absent per micro-batch. A batch's number is part of its commit, so a replayed one does nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_ledger(batch, path, (checkpoint, batch_id))

    return (
        outcomes.select("shot", "status").writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
