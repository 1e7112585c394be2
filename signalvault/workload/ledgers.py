"""Outcomes, ledgers, logs and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalvault.functions.naming import transfer_label
from signalvault.plans import outcomes as roll
from signalvault.session import scratch_path
from signalvault.sources import ledger as led
from signalvault.streaming.progress import progress_counts, progress_stream, start_ledger_sink
from signalvault.workload import tables as t
from signalvault.workload.registry import query


@query("chunk_outcomes", f"""WITH {t.OUTCOMES} SELECT shot, config, count(*) AS total_chunks,
 count(*) FILTER (exit_code <> 0) AS failed_chunks FROM outc GROUP BY ALL""")
def chunk_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return roll.chunk_outcomes(t.outcomes(spark, sf))


_SHOTS = """so AS (SELECT shot, CASE WHEN f = 0 AND shot NOT IN (SELECT shot FROM outp) THEN 1 ELSE f END AS failed_chunks
   FROM (SELECT shot, count(*) FILTER (exit_code <> 0) AS f FROM outc GROUP BY shot)),
 sst AS (SELECT shot, failed_chunks, CASE WHEN failed_chunks = 0 THEN 'completed' ELSE 'failed' END AS status FROM so)"""


@query("shot_outcomes", f"WITH {t.OUTCOMES}, {_SHOTS} SELECT * FROM sst")
def shot_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return roll.shot_outcomes(t.outcomes(spark, sf), t.outputs(spark, sf))


@query("nonempty_output", f"""WITH {t.OUTCOMES} SELECT DISTINCT shot FROM outc WHERE shot IN (SELECT shot FROM outp)""")
def nonempty_output(spark: SparkSession, sf: str) -> DataFrame:
    shots = t.outcomes(spark, sf).select("shot").distinct()
    return roll.nonempty_shots(shots, t.outputs(spark, sf))


@query("progress", f"""WITH {t.ORDER_LEDGER} SELECT count(DISTINCT CASE WHEN status = 'completed' THEN shot END) AS completed,
 count(DISTINCT CASE WHEN status = 'failed' THEN shot END) AS failed,
 (SELECT max(o_orderkey) + 1 FROM orders) AS requested FROM led""")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    return roll.progress(t.order_ledger(spark, sf), t.requested(spark, sf))


@query("ledger_union", f"""WITH {t.OUTCOMES}, {_SHOTS}, {t.ORDER_LEDGER}
 SELECT shot, status FROM sst UNION SELECT shot, status FROM led""")
def ledger_union(spark: SparkSession, sf: str) -> DataFrame:
    return led.ledger_union(t.order_ledger(spark, sf), shot_outcomes(spark, sf))


@query("retry_list", f"""WITH {t.OUTCOMES}, {_SHOTS}, {t.ORDER_LEDGER} SELECT DISTINCT shot FROM led
 WHERE status = 'failed' AND shot NOT IN (SELECT shot FROM sst WHERE status = 'completed')""")
def retry_list(spark: SparkSession, sf: str) -> DataFrame:
    """Failed before, and not completed by the later run."""
    later = shot_outcomes(spark, sf).where(F.col("status") == "completed")
    return led.retry_list(t.order_ledger(spark, sf), later)


@query("retry_cleared", f"""WITH {t.ORDER_LEDGER} SELECT status, count(DISTINCT shot) AS n_shots FROM led
 WHERE status = 'completed' OR (CAST(shot AS BIGINT) % 3 = 0) OR (CAST(shot AS BIGINT) % 2 = 0 AND status = 'failed') GROUP BY status""")
def retry_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of odd shots are cleared for a retry, in which every third shot fails again."""
    path = scratch_path(spark, "ledger")
    entries, number = t.order_ledger(spark, sf), F.col("shot").cast("bigint")
    led.append_ledger(entries, path)
    led.clear_failed(spark, path, entries.where(number % 2 == 1))
    led.append_ledger(entries.where((number % 3 == 0) & (F.col("status") == "failed")), path)
    return led.read_ledger(spark, path).groupBy("status").agg(F.count_distinct("shot").alias("n_shots"))


@query("ledger_append", f"""WITH {t.OUTCOMES}, {_SHOTS}, {t.ORDER_LEDGER}, u AS (
  SELECT shot, status FROM sst UNION SELECT shot, status FROM led)
 SELECT status, count(*) AS n_rows, count(DISTINCT shot) AS n_shots, min(shot) AS first_shot, max(shot) AS last_shot
 FROM u GROUP BY status""")
def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs are appended, the second twice: a written ledger keeps each pair once."""
    path = scratch_path(spark, "ledger")
    later = shot_outcomes(spark, sf)
    for run in (t.order_ledger(spark, sf), later, later):
        led.append_ledger(run, path)
    return led.read_ledger(spark, path).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("shot").alias("n_shots"),
        F.min("shot").alias("first_shot"), F.max("shot").alias("last_shot"))


@query("ledger_batches", f"""WITH {t.ORDER_LEDGER} SELECT status, count(*) AS n_rows, max(CAST(shot AS BIGINT)) AS last_shot FROM led
 WHERE CAST(shot AS BIGINT) % 3 < 2 GROUP BY status""")
def ledger_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of a stream count once: the second one comes again, with other rows, and is skipped; then all is compacted."""
    path = scratch_path(spark, "ledger")
    entries, part = t.order_ledger(spark, sf), F.col("shot").cast("bigint") % 3
    for number, rest in ((0, 0), (1, 1), (1, 2)):
        led.append_ledger(entries.where(part == rest), path, ("orders", number))
    led.compact_ledger(spark, path)
    return led.read_ledger(spark, path).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.col("shot").cast("bigint")).alias("last_shot"))


@query("transfer_log_append", """SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts,
 CAST(event_id AS VARCHAR) AS shot, event_id || '.h5' AS filename, 'TRANSFERRED_AND_DELETED' AS status,
 'Auto-transfer ' || event_id || '.h5 ' || strftime(ts, '%Y%m%d-%H%M%S') AS label FROM events""")
def transfer_log_append(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines are written as text, read back and parsed; labels repeat their time."""
    path = scratch_path(spark, "transfers")
    shot = F.col("event_id").cast("string")
    led.append_transfer_log(t.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), shot.alias("shot"), F.concat(shot, F.lit(".h5")).alias("filename")),
        path)
    back = led.parse_transfer_lines(spark.read.text(path))
    return back.withColumn("label", transfer_label("filename", "ts")).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _status_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = t.table(spark, sf, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .select(F.col("user_id").cast("string").alias("shot"), F.col("event_type").alias("status"), "event_id")
    )


@query("progress_stream", """SELECT event_type AS status, count(DISTINCT user_id) AS n_shots FROM events
 GROUP BY event_type""")
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per status kept by a stream, as bits of shot numbers."""
    path = scratch_path(spark, "progress")
    name = "progress_" + path.rsplit("-", 1)[1]
    run = (
        progress_stream(_status_stream(spark, sf)).writeStream.outputMode("complete").format("memory")
        .queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return progress_counts(spark.table(name))


@query("ledger_stream_append", """SELECT status, count(*) AS n_rows FROM
 (SELECT DISTINCT user_id, event_type AS status FROM events) GROUP BY status""")
def ledger_stream_append(spark: SparkSession, sf: str) -> DataFrame:
    """A stream fills a ledger; a second stream over the same rows adds nothing."""
    path = scratch_path(spark, "stream-ledger")
    for _ in range(2):
        start_ledger_sink(_status_stream(spark, sf), path, scratch_path(spark, "stream")).awaitTermination()
    return led.read_ledger(spark, path).groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))
