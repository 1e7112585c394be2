"""Completed / failed ledger and the transfer log: append-only, set semantics.

A ledger is a log of versions: small files that list data folders, one for each bucket of shots that a write had rows
for. A version is claimed by a rename that never overwrites, so jobs that append at the same time follow one another and
none is lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalvault.fixed_values import CLEARED, FAILED
from signalvault.functions.naming import transfer_line
from signalvault.model import LEDGER, empty
from signalvault.plans.outcomes import shot_outcomes
from signalvault.session import cut_lineage
from signalvault.sources import files


BUCKETS = 16
MOST_FOLDERS = 16
"""Folders of a bucket above which an append joins them."""
_ROWS = f"{LEDGER}, bucket int"


def bucket_column(buckets: int = BUCKETS) -> Column:
    return (F.crc32(F.coalesce("shot", F.lit("")).cast("binary")) % buckets).cast("int")


def _log(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The newest version and what it lists: data folders, and the last batch of each stream."""
    known = files.matching(spark, f"{path}/version-*.json")
    if not known:
        return 0, {"buckets": BUCKETS, "folders": [], "batches": {}}
    return int(known[-1].rsplit("-", 1)[1].removesuffix(".json")), json.loads(files.read_small(spark, known[-1]))


def _commit(spark: SparkSession, path: str, change: Callable[[dict], dict | None]) -> bool:
    """Claim the next version with what ``change`` makes of the newest one; None leaves it at that.

    Of several writers one claims a version, the others find it taken and apply their change to it in turn.
    """
    while True:
        version, listed = _log(spark, path)
        after = change(listed)
        if after is None:
            return False
        try:
            files.write_new(spark, f"{path}/version-{version + 1:09d}.json", json.dumps(after))
            return True
        except FileExistsError:
            continue


def _rows(spark: SparkSession, path: str, listed: dict, buckets: set[int] | None = None) -> DataFrame:
    """Stored rows; of some buckets only, where these are named."""
    folders = [f for f in listed["folders"] if buckets is None or int(f.rsplit("=", 1)[1]) in buckets]
    if not folders:
        return empty(spark, _ROWS)
    return spark.read.schema(_ROWS).option("basePath", f"{path}/data").parquet(*[f"{path}/{f}" for f in folders]).select("shot", "status", "ts", "bucket")


def _store(spark: SparkSession, path: str, rows: DataFrame) -> list[str]:
    """New folders with ``rows``, one for each bucket that has any."""
    folder = f"data/w={uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    return [f"{folder}/{p.rsplit('/', 1)[1]}" for p in files.matching(spark, f"{path}/{folder}/bucket=*")]


def _standing(raw: DataFrame) -> DataFrame:
    cleared = F.max(F.when(F.col("status") == CLEARED, F.col("ts")))
    pair = raw.where(F.col("status") != CLEARED)
    marks = raw.where(F.col("status") == CLEARED).groupBy("shot").agg(cleared.alias("cleared"))
    return (
        pair.join(marks, "shot", "left")
        .where((F.col("status") != FAILED) | F.col("cleared").isNull() | (F.col("ts") > F.col("cleared")))
        .groupBy("shot", "status").agg(F.min("ts").alias("ts"))
    )


def read_ledger(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """Ledger rows that stand, each (shot, status) once with its first time, even if two
    jobs entered it; a ledger that does not exist yet is empty. A failure stands until
    it is cleared (``clear_failed``); one entered after that stands again."""
    _, listed = _log(spark, path)
    if not listed["folders"]:
        return empty(spark, LEDGER)
    standing = _standing(_rows(spark, path, listed))
    return standing if status is None else standing.where(F.col("status") == status)


def clear_failed(spark: SparkSession, path: str, shots: DataFrame | None = None) -> None:
    """Take failed shots (all, or those in ``shots``) off the ledger for a retry. Appends
    markers; nothing is rewritten."""
    failed = read_ledger(spark, path, FAILED).select("shot")
    if shots is not None:
        failed = failed.join(shots.select("shot").distinct(), "shot", "left_semi")
    _enter(spark, path, failed.withColumns({"status": F.lit(CLEARED), "ts": F.current_timestamp()}))


def _enter(spark: SparkSession, path: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
    """Store rows and list them, with the batch they are; no rows, no version."""
    buckets = _log(spark, path)[1]["buckets"]
    new = _store(spark, path, rows.withColumn("bucket", bucket_column(buckets)))
    if not new:
        return

    def listed_too(listed: dict) -> dict | None:
        if batch and listed["batches"].get(batch[0], -1) >= batch[1]:
            return None
        return listed | {"folders": listed["folders"] + new, "batches": listed["batches"] | (dict([batch]) if batch else {})}

    if _commit(spark, path, listed_too):
        compact_ledger(spark, path, MOST_FOLDERS, {int(f.rsplit("=", 1)[1]) for f in new})


def compact_ledger(spark: SparkSession, path: str, most: int = 1, buckets: set[int] | None = None) -> None:
    """Join the folders of buckets that have more than ``most``: the rows that stand are written once again, together.

    Appends may go on meanwhile; where another compaction was faster, this one is dropped.
    """
    _, listed = _log(spark, path)
    held: dict[int, list[str]] = {}
    for f in listed["folders"]:
        held.setdefault(int(f.rsplit("=", 1)[1]), []).append(f)
    many = {b for b, folders in held.items() if len(folders) > most and (buckets is None or b in buckets)}
    if not many:
        return
    old = {f for b in many for f in held[b]}
    rows = _standing(_rows(spark, path, listed, many))
    new = _store(spark, path, rows.withColumn("bucket", bucket_column(listed["buckets"])))

    def replaced(now: dict) -> dict | None:
        there = set(now["folders"])
        return now | {"folders": [f for f in now["folders"] if f not in old] + new} if old <= there else None

    _commit(spark, path, replaced)


def new_entries(outcomes: DataFrame, ledger: DataFrame) -> DataFrame:
    """(shot, status) pairs not in the ledger yet, each once.

    The ledger is first reduced to the pairs in question. A small batch is then
    broadcast into its scan, and a long ledger is not shuffled for it. Pairs are
    distinct before they meet, so one repeated very often is no hot join key.
    """
    pair = ["shot", "status"]
    fresh = outcomes.select(*pair).distinct()

    def same(a: DataFrame, b: DataFrame) -> list[Column]:
        return [a[c].eqNullSafe(b[c]) for c in pair]

    known = ledger.select(*pair)
    known = known.join(fresh, same(known, fresh), "left_semi").distinct()
    fresh = outcomes.select(*pair).distinct()
    return fresh.join(known, same(fresh, known), "left_anti")


def append_ledger(outcomes: DataFrame, path: str, batch: tuple[str, int] | None = None) -> None:
    """Append the absent pairs. Safe to repeat: a second run finds nothing absent.

    Only buckets that the outcomes fall into are read. Jobs may append at the same time. ``batch``, a stream's name and
    the number of its batch, makes a batch count once: a replay ends before anything is read.
    """
    spark = outcomes.sparkSession
    _, listed = _log(spark, path)
    if batch and listed["batches"].get(batch[0], -1) >= batch[1]:
        return
    pairs = cut_lineage(outcomes.select("shot", "status").distinct().withColumn("bucket", bucket_column(listed["buckets"])))
    touched = {r.bucket for r in pairs.select("bucket").distinct().collect()}
    if touched:
        fresh = new_entries(pairs, _standing(_rows(spark, path, listed, touched)))
        _enter(spark, path, fresh.withColumn("ts", F.current_timestamp()), batch)


def record_outcomes(outcomes: DataFrame, nodes: DataFrame, path: str) -> None:
    """Roll chunk outcomes up per shot and enter the shots into the ledger."""
    append_ledger(shot_outcomes(outcomes, nodes), path)


def ledger_union(left: DataFrame, right: DataFrame) -> DataFrame:
    pair = ["shot", "status"]
    return left.select(*pair).unionByName(right.select(*pair)).distinct()


def retry_list(ledger: DataFrame, completed: DataFrame | None = None) -> DataFrame:
    """The failed set as the next request; without shots that succeeded since, if given."""
    failed = ledger.where(F.col("status") == FAILED).select("shot").distinct()
    if completed is None:
        return failed
    return failed.join(completed.select("shot").distinct(), "shot", "left_anti")


def transfer_lines(transfers: DataFrame) -> DataFrame:
    """(ts, shot, filename) -> the log's text lines."""
    return transfers.select(transfer_line("ts", "shot", "filename").alias("value"))


def append_transfer_log(transfers: DataFrame, path: str) -> None:
    transfer_lines(transfers).write.mode("append").text(path)


def parse_transfer_lines(lines: DataFrame) -> DataFrame:
    parts = F.split("value", r" \| ", 4)
    return lines.select(
        F.to_timestamp(F.get(parts, F.lit(0))).alias("ts"), F.get(parts, F.lit(1)).alias("shot"),
        F.get(parts, F.lit(2)).alias("filename"), F.get(parts, F.lit(3)).alias("status"))
