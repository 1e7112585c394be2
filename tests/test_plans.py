"""The physical plans are the ones meant."""

import os
import re

import pytest

import __spark_entry__ as entry_points
from helpers import node, store
from signalvault.model import KEY
from signalvault.operators.compare import leaf_differences, leaf_digest
from signalvault.operators.merge import merge
from signalvault.operators.rename import candidates, labels_of, mapping_of
from signalvault.plans import acquisition as plan
from signalvault.workload import QUERIES

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_pending_is_an_anti_join(spark):
    done = spark.createDataFrame([("3",)], "shot string")
    assert "LeftAnti" in physical(plan.pending(plan.shots_range(spark, 1, 8), done))


def test_plan_has_no_product_join(spark, no_broadcast):
    """Even when nothing may be broadcast, shots meet the catalog without a product."""
    rows = [(1, "c", i, "t", f"s{i}") for i in range(1, 251)]
    catalog = spark.createDataFrame(rows, "config_no int, config string, ordinal bigint, tree string, signal string")
    shots = plan.shots_range(spark, 1, 3)
    text = physical(plan.chunk_plan(shots, catalog))
    assert "Join" not in text.split("Subquery")[0] and "CartesianProduct" not in text
    both = physical(plan.signal_plan(shots, catalog))
    assert "CartesianProduct" not in both and "NestedLoop" not in both
    assert plan.signal_plan(shots, catalog).count() == 750


def test_skip_merge_does_not_shuffle_target_content(spark, no_broadcast):
    s = store(spark, [node("1", "a", "x", "data", [1.0])])
    text = physical(merge(s, [s]).store.nodes)
    under_union = text[text.index("Union"):]
    target = under_union[:under_union.index("Join")]
    assert "f64" in target and "Exchange" not in target


def test_key_ranking_reads_keys_only(spark, folder):
    store(spark, [node("1", "a", "x", "data", [1.0])]).nodes.write.parquet(f"{folder}/n")
    text = physical(spark.read.parquet(f"{folder}/n").select(*KEY).distinct())
    assert "f64" not in text


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_no_python_in_any_query(spark):
    for name in QUERIES:
        text = physical(entry_points.queries()[name](spark, SF))
        assert "Python" not in text and "Pandas" not in text, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_first_differences_limits_on_the_map_side(spark):
    text = physical(entry_points.queries()["first_differences"](spark, SF))
    assert "row_number(), 5, Partial" in text


def test_arrays_stay_out_of_the_first_alignment(spark, no_broadcast, folder):
    s = store(spark, [node(str(i), "t", "a", "data", [1.0, float(i)]) for i in range(4)])
    s.nodes.withColumn("path", s.nodes.node).write.parquet(f"{folder}/n")
    leaves = spark.read.parquet(f"{folder}/n")
    keys = leaves.select("shot", "path", "seg", leaf_digest().alias("digest"))
    text = physical(keys.join(keys.withColumnRenamed("digest", "other"), ["shot", "path", "seg"], "full_outer"))
    assert "f64" not in text[:text.index("Exchange")] and leaf_differences(leaves, leaves, ["shot"]).count() == 0


def test_lines_with_a_shot_join_on_it(spark, no_broadcast):
    s = store(spark, [node(str(i), "d3d", "a", "x", 1.0) for i in range(3)])
    lines = mapping_of(spark.createDataFrame([(1, "d3d", "D3D", "1")], "line_no long, old_name string, new_name string, shot string"))
    text = physical(candidates(labels_of(s, "tree"), lines, "tree"))
    assert "OR" not in text and re.search(r"Join \[old_name#\d+, shot#\d+\]", text)
