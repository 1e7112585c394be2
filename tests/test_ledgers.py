import math

import pytest

from helpers import node, store
from signalvault.model import NODES, bounded, conform, samples, split_segments
from signalvault.operators.convert import to_float32
from signalvault.plans import outcomes as roll
from signalvault.sources import catalog as cat
from signalvault.sources import ledger as led
from signalvault.streaming.progress import progress_stream, start_ledger_sink


def ledger(spark, *pairs):
    return spark.createDataFrame(list(pairs), "shot string, status string")


def test_shot_outcomes(spark):
    rows = [("1", "a", 1, 0), ("1", "b", 1, 0), ("2", "a", 1, 0), ("2", "a", 2, 1), ("2", "b", 1, 9), ("3", "a", 1, 0)]
    chunks = spark.createDataFrame(rows, "shot string, config string, chunk bigint, exit_code int")
    absent = cat.missing_config_outcomes(spark.createDataFrame([("4",)], "shot string"), ["gone.yaml"])
    written = spark.createDataFrame([("1",), ("1",), ("2",)], "shot string")
    got = {r.shot: (r.failed_chunks, r.status)
           for r in roll.shot_outcomes(chunks.unionByName(absent), written).collect()}
    assert got == {"1": (0, "completed"), "2": (2, "failed"), "3": (1, "failed"), "4": (1, "failed")}
    per_config = {(r.shot, r.config): (r.total_chunks, r.failed_chunks) for r in roll.chunk_outcomes(chunks).collect()}
    assert per_config[("2", "a")] == (2, 1) and per_config[("2", "b")] == (1, 1)


def test_append_is_idempotent(spark, folder):
    path = f"{folder}/ledger"
    assert led.read_ledger(spark, path).count() == 0
    first = ledger(spark, ("1", "completed"), ("1", "completed"), ("2", "failed"))
    led.append_ledger(first, path)
    led.append_ledger(first, path)
    led.append_ledger(ledger(spark, ("2", "completed")), path)
    rows = sorted((r.shot, r.status) for r in led.read_ledger(spark, path).collect())
    assert rows == [("1", "completed"), ("2", "completed"), ("2", "failed")]
    all_rows = led.read_ledger(spark, path)
    assert [r.shot for r in led.retry_list(all_rows).collect()] == ["2"]
    assert led.retry_list(all_rows, led.read_ledger(spark, path, "completed")).count() == 0
    counts = roll.progress(all_rows, spark.range(5)).first()
    assert tuple(counts) == (2, 1, 5)


def test_transfer_log(spark, folder):
    import datetime as dt

    path = f"{folder}/log"
    rows = spark.createDataFrame([(dt.datetime(2025, 3, 4, 5, 6, 7), "200000", "200000.h5")],
                                 "ts timestamp, shot string, filename string")
    led.append_transfer_log(rows, path)
    led.append_transfer_log(rows, path)
    lines = spark.read.text(path)
    assert {r.value for r in lines.collect()} == {"2025-03-04 05:06:07 | 200000 | 200000.h5 | TRANSFERRED_AND_DELETED"}
    back = led.parse_transfer_lines(lines).collect()
    assert len(back) == 2 and back[0].ts == dt.datetime(2025, 3, 4, 5, 6, 7)


def test_stream_equals_batch(spark, folder):
    ledger(spark, ("1", "completed"), ("2", "failed"), ("1", "completed")).coalesce(1).write.parquet(f"{folder}/in")
    ledger(spark, ("1", "failed"), ("3", "completed"), ("2", "failed")).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def arriving():
        return (spark.readStream.schema("shot string, status string").option("maxFilesPerTrigger", 1)
                .parquet(f"{folder}/in"))

    run = (progress_stream(arriving()).writeStream.outputMode("complete").format("memory").queryName("seen")
           .option("checkpointLocation", f"{folder}/cp1").trigger(availableNow=True).start())
    run.awaitTermination()
    got = {r.status: r.n_shots for r in spark.table("seen").collect()}
    whole = roll.progress(spark.read.parquet(f"{folder}/in"), spark.range(3)).first()
    assert got == {"completed": whole.completed, "failed": whole.failed} == {"completed": 2, "failed": 2}
    for i in range(2):
        start_ledger_sink(arriving(), f"{folder}/out", f"{folder}/cp2-{i}").awaitTermination()
    assert led.read_ledger(spark, f"{folder}/out").count() == 4


def test_to_float32(spark):
    s = store(spark, [node("1", "t", "a", "data", [1e300, 0.1, math.nan]), node("1", "t", "b", "data", [1, 2]),
                      node("1", "t", "c", "data", "text"), node("1", "t", "d", "data", 0.5)])
    got = {r.signal: r for r in to_float32(s.nodes).collect()}
    a = got["a"]
    assert a.kind == "f32" and a.f64 is None and math.isinf(a.f32[0]) and math.isnan(a.f32[2]) and a.f32[1] != 0.1
    assert got["b"].i64 == [1, 2] and got["c"].str == ["text"] and list(got["d"].f32) == [0.5] and got["d"].shape == []


def test_segments_and_samples(spark):
    values, times = [float(i) for i in range(10)], [i / 2 for i in range(10)]
    wide = store(spark, [node("1", "t", "a", "data", values), node("1", "t", "a", "dim0", times),
                         node("1", "t", "b", "data", values)]).nodes
    cut = conform(split_segments(wide, "f64", 4), NODES)
    sizes = sorted((r.signal, r.node, r.seg, len(r.f64)) for r in cut.collect())
    assert sizes[:3] == [("a", "data", 0, 4), ("a", "data", 1, 4), ("a", "data", 2, 2)]
    s = store(spark, [node("1", "t", "a", "x", 1)])
    long = samples(type(s)(cut, s.groups, s.attrs), 4).orderBy("idx").collect()
    assert [(r.idx, r.t, r.v) for r in long] == list(zip(range(10), times, values))


@pytest.mark.parametrize("elements", [2, 1 << 20])
def test_samples_do_not_depend_on_the_segment_size(spark, elements):
    """``dim0`` ends early, in the last but one segment; a signal without it gives none."""
    values, times = [float(i) for i in range(6)], [0.5, 1.0, 1.5]
    wide = store(spark, [node("1", "t", "a", "data", values), node("1", "t", "a", "dim0", times),
                         node("1", "t", "b", "data", values)])
    s = type(wide)(bounded(wide.nodes, elements), wide.groups, wide.attrs)
    assert s.nodes.where(f"size(f64) > {elements}").isEmpty()
    got = [(r.signal, r.idx, r.t, r.v) for r in samples(s, elements).orderBy("idx").collect()]
    assert got == [("a", i, times[i] if i < 3 else None, v) for i, v in enumerate(values)]
