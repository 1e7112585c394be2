"""Steps that many queries share: each reads, compares or sends its rows once."""

import pytest
from pyspark.sql import functions as F

from signalvault.fixed_values import DATA_VALUES, NAN_POSITIONS
from signalvault.model import NODES, conform, empty, store_from_nodes, with_ancestors
from signalvault.operators import chains, compare
from signalvault.operators.rename import mapping_of, rename, rename_batch
from signalvault.sources.store import read_store, write_store

NAN = float("nan")


def _nodes(spark, rows):
    """(shot, tree, signal, node, values) as f64 leaves."""
    return conform(spark.createDataFrame(rows, "shot string, tree string, signal string, node string, f64 array<double>").withColumns(
        {"seg": F.lit(0), "kind": F.lit("f64"), "shape": F.array(F.size("f64"))}), NODES)


def test_empty_tables_fall_away_while_planning(spark):
    none = empty(spark, NODES)
    assert none.schema == spark.createDataFrame([], NODES).schema and none.count() == 0
    plan = spark.range(3).selectExpr("cast(id AS string) AS shot").join(none, "shot")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_groups_of_signals_once_each(spark):
    keys = spark.createDataFrame([(1, "a", "t", "x"), (1, "a", "t", "x"), (1, "a", "u", "x"), (2, "a", "t", None)],
                                 "src int, shot string, tree string, signal string")
    assert sorted(map(str, with_ancestors(keys, "src").collect())) == sorted(map(str, [
        *keys.distinct().withColumn("level", F.lit("signal")).collect(),
        *spark.createDataFrame([(1, "a", "t", None, "tree"), (1, "a", "u", None, "tree"), (2, "a", "t", None, "tree"), (1, "a", None, None, "shot"),
                                (2, "a", None, None, "shot")], "src int, shot string, tree string, signal string, level string").collect()]))


def test_a_store_write_computes_its_rows_once(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(200).select("id").mapInPandas(counted, "id long")
    nodes = conform(rows.select(
        (F.col("id") % 7).cast("string").alias("shot"), F.lit("t").alias("tree"), F.col("id").cast("string").alias("signal"),
        F.lit("data").alias("node"), F.lit(0).alias("seg"), F.lit("f64").alias("kind"), F.array(F.lit(1)).alias("shape"),
        F.array(F.col("id").cast("double")).alias("f64")), NODES)
    groups = empty(spark, "shot string, tree string, signal string, level string")
    store = store_from_nodes(nodes)
    write_store(type(store)(nodes, groups, store.attrs), folder + "/s")
    assert seen.value == 200
    assert read_store(spark, folder + "/s").nodes.count() == 200


def test_short_rows_are_settled_in_one_alignment(spark, monkeypatch):
    calls, align = [], compare.align
    monkeypatch.setattr(compare, "align", lambda *a: calls.append(1) or align(*a))

    def side(*values):
        rows = _nodes(spark, [("s", "t", f"k{i}", "data", v) for i, v in enumerate(values)])
        return rows.withColumn("path", F.concat_ws("/", "signal", "node"))

    first = side([1.0], [1.0], [NAN], [NAN], [None], [0.0])
    second = side([1.0 + 1e-12], [2.0], [NAN], [1.0], [None], [-0.0])
    found = compare.leaf_differences(first, second, ["shot"]).collect()
    assert sorted((r.path, r.difference) for r in found) == [("k1/data", DATA_VALUES), ("k3/data", NAN_POSITIONS)]
    assert len(calls) == 1
    mixed = compare.leaf_differences(side([1.0], [1.0] * 9), side([1.0] * 9, [1.0] * 9), ["shot"]).collect()
    assert [(r.path, r.difference) for r in mixed] == [("k0/data", "Shape mismatch")]


@pytest.mark.parametrize("few", [1, 32])
def test_small_scopes_are_chains_without_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(chains, "FEW_LINES", few)
    rounds, plain = [], chains.chains
    monkeypatch.setattr(chains, "chains", lambda *a: rounds.append(1) or plain(*a))
    nodes = _nodes(spark, [("s", "t", k, "data", [float(i)]) for i, k in enumerate("abd")] + [("s", "u", "a", "data", [5.0])])
    lines = spark.createDataFrame([(1, "b", "c", "s", "t"), (2, "a", "b", "s", "t"), (3, "d", "e", "s", "t"), (4, "a", "z", "s", "u")],
                                  "line_no long, old_name string, new_name string, shot string, tree string")
    after = rename_batch(store_from_nodes(nodes), mapping_of(lines), "signal").store.nodes
    assert sorted((r.tree, r.signal, r.f64[0]) for r in after.collect()) == [
        ("t", "b", 0.0), ("t", "c", 1.0), ("t", "e", 2.0), ("u", "z", 5.0)]
    assert len(rounds) == (1 if few == 1 else 0)


def test_signals_are_added_up_once_for_a_comparison(spark, folder, monkeypatch):
    sums, merkle = [], compare.merkle

    def counted(store, level, side="", signals=None):
        sums.append(level) if signals is None else None
        return merkle(store, level, side, signals)

    monkeypatch.setattr(compare, "merkle", counted)
    for name, x in (("a", 1.0), ("b", 2.0)):
        write_store(store_from_nodes(_nodes(spark, [("s", "t", "k", "data", [x]), ("s", "u", "k", "data", [0.0])])), f"{folder}/{name}")
    verdicts, _ = compare.compare_stores(*[read_store(spark, f"{folder}/{n}") for n in "ab"], "tree")
    assert sorted((r.tree, r.n_differences) for r in verdicts.collect()) == [("t", 1), ("u", 0)]
    assert sums == ["signal", "signal"]


def test_two_sides_of_one_store_share_their_digests(spark, folder, monkeypatch):
    sums, merkle = [], compare.merkle

    def counted(store, level, side="", signals=None):
        sums.append(level) if signals is None else None
        return merkle(store, level, side, signals)

    monkeypatch.setattr(compare, "merkle", counted)
    write_store(store_from_nodes(_nodes(spark, [("s", t, "k", "data", [x]) for t, x in (("a", 1.0), ("b", 1.0))])), folder + "/s")
    assert [r.verdict for r in rename(read_store(spark, folder + "/s"), "a", "b").verdicts.collect()] == ["deduplicated"]
    assert sums == ["signal"]
