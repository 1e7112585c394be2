"""One shot may hold most rows: its work is still spread, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from signalvault.functions.ordinals import dense_ordinal
from signalvault.model import NODES, Store, conform, empty, ATTRS, with_ancestors
from signalvault.operators.compare import LEAF, align
from signalvault.operators.merge import merge
from signalvault.operators.rename import rename, rename_stats
from signalvault.sources.ledger import new_entries


@pytest.fixture
def plain_shuffles(spark):
    """Eight partitions, none merged or split at run time: what the keys alone give."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8",
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    keep = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def hot_store(spark, tree, n=6000, shift=0.0):
    """Two thirds of all leaves belong to one shot, in one signal."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("shot"),
        F.lit(tree).alias("tree"), F.lit("x").alias("signal"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("node"),
        F.lit(0).alias("seg"), F.lit("f64").alias("kind"), F.array((F.col("id") + shift).cast("double")).alias("f64"),
    ).withColumn("shape", F.array(F.lit(1).cast("bigint")))
    nodes = conform(rows, NODES)
    return Store(nodes, with_ancestors(nodes), empty(spark, ATTRS))


def largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


def test_leaves_of_a_hot_unit_are_spread(spark, plain_shuffles):
    rows = hot_store(spark, "a").nodes.withColumn("path", F.concat_ws("/", "signal", "node"))
    aligned = align(rows, rows, ["shot", "path", "seg"], LEAF).persist()
    assert aligned.count() == 6000
    assert largest_share(aligned) < 0.2
    aligned.unpersist()


def test_ordinals_are_ranked_in_many_tasks(spark, plain_shuffles):
    numbered = dense_ordinal(spark.range(100_000).withColumnRenamed("id", "p"), "p", "o").persist()
    assert numbered.agg(F.min("o"), F.max("o"), F.count_distinct("o")).first()[:] == (1, 100_000, 100_000)
    assert numbered.where("o != p + 1").isEmpty() and largest_share(numbered) < 0.5  # two of eight ranges may meet in a task
    numbered.unpersist()


def test_hot_shot_keeps_all_rows(spark, plain_shuffles):
    a, b = hot_store(spark, "a"), hot_store(spark, "b", shift=1e-12)
    both = Store(a.nodes.unionByName(b.nodes), a.groups.unionByName(b.groups).distinct(), a.attrs)
    result = rename(both, "a", "b")
    assert tuple(rename_stats(result).first()) == (51, 0)
    assert result.store.nodes.count() == 6000
    merged = merge(a, [hot_store(spark, "a", 9000), hot_store(spark, "c")], "overwrite")
    assert merged.store.nodes.count() == 15000
    assert tuple(merged.stats.first()) == (2, 51, 102, 0, 51)


def test_repeated_pair_is_one_ledger_entry(spark, plain_shuffles):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("shot"),
                                    F.lit("completed").alias("status"))
    fresh = new_entries(rows, spark.createDataFrame([("2", "completed")], "shot string, status string"))
    assert fresh.count() == rows.distinct().count() - 1
