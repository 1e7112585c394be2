"""Ledgers as a log of versions, and the state of the progress stream."""

from signalvault.sources import files
from signalvault.sources import ledger as led
from signalvault.streaming.progress import progress_counts, progress_stream, start_ledger_sink


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "shot string, status string")


def entries(spark, path):
    return sorted((r.shot, r.status) for r in led.read_ledger(spark, path).collect())


def test_of_two_writers_both_are_listed(spark, folder, monkeypatch):
    inner, done = files.write_new, []

    def overtaken(spark_, path, text):
        if not done:
            done.append(1)
            led.append_ledger(pairs(spark, ("2", "completed"), ("1", "completed")), folder)
        inner(spark_, path, text)

    monkeypatch.setattr(files, "write_new", overtaken)
    led.append_ledger(pairs(spark, ("1", "completed"), ("3", "failed")), folder)
    assert entries(spark, folder) == [("1", "completed"), ("2", "completed"), ("3", "failed")]
    assert led._log(spark, folder)[0] == 2


def test_an_append_reads_its_own_buckets(spark, folder, monkeypatch):
    led.append_ledger(pairs(spark, *[(str(i), "completed") for i in range(100)]), folder)
    _, listed = led._log(spark, folder)
    assert len(listed["folders"]) == led.BUCKETS
    some = led._rows(spark, folder, listed, {5})
    assert all("bucket=5" in f for f in some.inputFiles()) and {r.bucket for r in some.collect()} == {5}
    asked, rows = [], led._rows
    monkeypatch.setattr(led, "_rows", lambda s, p, l, buckets=None: asked.append(buckets) or rows(s, p, l, buckets))
    led.append_ledger(pairs(spark, ("7", "completed"), ("7", "failed")), folder)
    assert len(asked) == 1 and len(asked[0]) == 1
    led.append_ledger(pairs(spark, ("7", "completed")), folder)
    assert led._log(spark, folder)[0] == 2      # nothing absent, no version


def test_batches_count_once_and_compaction_keeps_what_stands(spark, folder, monkeypatch):
    monkeypatch.setattr(led, "MOST_FOLDERS", 2)
    for number in range(4):
        led.append_ledger(pairs(spark, ("1", f"s{number}"), (str(number), "failed")), folder, ("stream", number))
    listed = led._log(spark, folder)[1]
    mine = [f for f in listed["folders"] if f.endswith(f"={__import__('zlib').crc32(b'1') % led.BUCKETS}")]
    assert len(mine) <= 3 and listed["batches"] == {"stream": 3}
    monkeypatch.setattr(led, "_rows", None)     # a replay reads nothing
    led.append_ledger(pairs(spark, ("9", "completed")), folder, ("stream", 3))
    monkeypatch.undo()
    led.clear_failed(spark, folder, pairs(spark, ("2", "failed")))
    led.compact_ledger(spark, folder)
    want = [("0", "failed"), ("1", "failed"), ("3", "failed")] + [("1", f"s{n}") for n in range(4)]
    assert entries(spark, folder) == sorted(want)
    assert len(led._log(spark, folder)[1]["folders"]) == len({f.rsplit("=")[-1] for f in led._log(spark, folder)[1]["folders"]})


def test_state_of_the_progress_stream(spark, folder):
    rows = [(str(i), "completed") for i in range(500)] * 3 + [("x7", "failed"), ("x7", "failed"), ("007", "failed"), ("7", "failed"), (None, "failed")]
    pairs(spark, *rows).coalesce(1).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema("shot string, status string").parquet(f"{folder}/in")
    run = progress_stream(arriving).writeStream.outputMode("complete").format("memory").queryName("bits") \
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.status: r.n_shots for r in progress_counts(spark.table("bits")).collect()} == {"completed": 500, "failed": 4}
    assert sum(op["numRowsTotal"] for op in run.recentProgress[0]["stateOperators"]) == 5
    for number in range(2):
        start_ledger_sink(arriving, f"{folder}/out", f"{folder}/sink-{number}").awaitTermination()
    listed = led._log(spark, f"{folder}/out")
    assert listed[0] == 1 and list(listed[1]["batches"].values()) == [0]
