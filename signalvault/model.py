"""Tables of the store. The key space is dynamic, the columns are fixed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["shot", "tree", "signal"]

# One row per leaf segment. ``seg`` numbers the pieces of a long array, each
# SEGMENT_ELEMENTS long (the last one shorter), so no row grows without bound.
# ``shape`` is that of the whole leaf and empty for a scalar. ``kind`` is one of
# f64, f32, i64, bool, str, bin and names the filled column (bool uses i64).
NODES = ("shot string, tree string, signal string, node string, seg int, kind string, "
         "shape array<bigint>, f64 array<double>, f32 array<float>, i64 array<bigint>, "
         "str array<string>, bin binary")

# Existence of shots, trees and signals, empty ones included.
GROUPS = "shot string, tree string, signal string, level string"

# One row per attribute; owner columns below the owner's level are NULL.
ATTRS = ("shot string, tree string, signal string, node string, name string, kind string, "
         "is_array boolean, f64 array<double>, i64 array<bigint>, str array<string>, bin binary")

# Groups below a signal, at any depth: ``path`` and ``parent`` are relative to the signal, the parent of a
# path of depth 1 is the empty path. Leaves name the group they lie in by their ``node``.
PATHS = "shot string, tree string, signal string, path string, parent string, depth int"

LEDGER = "shot string, status string, ts timestamp"

SEGMENT_ELEMENTS = 1 << 20


@dataclass(frozen=True)
class Store:
    nodes: DataFrame
    groups: DataFrame
    attrs: DataFrame
    paths: DataFrame | None = None      # groups below signals, where there are any

    @property
    def nested(self) -> DataFrame:
        return empty(self.nodes.sparkSession, PATHS) if self.paths is None else self.paths

    def at_level(self, level: str) -> DataFrame:
        return self.groups.where(F.col("level") == level)

    def signal_keys(self) -> DataFrame:
        return self.at_level("signal").select(*KEY)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows. The filter on a literal lets Spark see that while it plans, so that joins and unions with it fall away."""
    return conform(spark.range(1).where(F.lit(False)), schema)


def each_table(store: Store, change: Callable[[DataFrame], DataFrame]) -> Store:
    """``store`` with every table changed the same way."""
    return Store(change(store.nodes), change(store.groups), change(store.attrs), None if store.paths is None else change(store.paths))


def with_ancestors(keys: DataFrame, *by: str) -> DataFrame:
    """Signal keys -> group rows of the signals, their trees and their shots, each once (per ``by``).

    Signals are made distinct once; trees come from them and shots from the trees, so no step sends more rows than its level has.
    """
    none = F.lit(None).cast("string")
    signals = keys.select(*by, *KEY).distinct()
    trees = signals.select(*by, "shot", "tree").distinct()
    shots = trees.select(*by, "shot").distinct()
    return reduce(DataFrame.unionByName, [
        signals.withColumn("level", F.lit("signal")),
        trees.select(*by, "shot", "tree", none.alias("signal"), F.lit("tree").alias("level")),
        shots.select(*by, "shot", none.alias("tree"), none.alias("signal"), F.lit("shot").alias("level"))])


def nested_paths(rows: DataFrame, path: str, *by: str) -> DataFrame:
    """PATHS rows (per ``by``) of the group ``path`` of each row and of all groups above it, below the signal, each once."""
    steps = F.split(F.col(path), "/")
    each = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(
        F.array_join(F.slice(steps, F.lit(1), n), "/").alias("path"),
        F.array_join(F.slice(steps, F.lit(1), n - 1), "/").alias("parent"), n.alias("depth"))))
    return rows.where(F.col(path) != "").select(*by, *KEY, each.alias("g")).select(*by, *KEY, "g.*").distinct()


def paths_of_leaves(nodes: DataFrame) -> DataFrame:
    """Groups below signals that leaves lie in, as their ``node`` tells."""
    inner = nodes.where(F.col("node").contains("/")).select(*KEY, F.regexp_replace("node", "/[^/]*$", "").alias("of"))
    return nested_paths(inner.distinct(), "of")


def store_from_nodes(nodes: DataFrame, attrs: DataFrame | None = None) -> Store:
    nodes = conform(nodes, NODES)
    return Store(nodes, with_ancestors(nodes),
                 empty(nodes.sparkSession, ATTRS) if attrs is None else conform(attrs, ATTRS))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Select the schema's columns, filling the absent ones with typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
        for name, kind in _fields(schema)
    ])


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in schema.split(",")]


def split_segments(df: DataFrame, value: str, elements: int = SEGMENT_ELEMENTS) -> DataFrame:
    """Cut the array column ``value`` into rows of at most ``elements`` values with ``seg``."""
    pieces: Column = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(value) / elements) - 1, F.lit(0)).cast("int")),
        lambda i: F.struct(i.alias("seg"), F.slice(value, i * elements + 1, elements).alias(value)),
    )
    rest = [c for c in df.columns if c not in (value, "seg")]
    return df.select(*rest, F.explode(pieces).alias("p")).select(*rest, "p.seg", f"p.{value}")


def bounded(nodes: DataFrame, elements: int = SEGMENT_ELEMENTS) -> DataFrame:
    """Nodes whose rows hold at most ``elements`` values each; what writers write.

    A whole leaf (segment 0) that is longer is cut into segments; a longer row that is a
    segment already is an error, because its place in the leaf is not known.
    """
    arrays = ["f64", "f32", "i64", "str"]
    length = F.greatest(F.lit(0), *[F.coalesce(F.size(c), F.lit(0)) for c in arrays])
    over = length > elements
    cut = F.when(over & (F.col("seg") != 0), F.raise_error(F.lit("a segment is longer than segments may be"))).otherwise(
        F.sequence(F.lit(0), F.greatest(F.ceil(length / elements) - 1, F.lit(0)).cast("int")))
    columns = nodes.columns
    pieces = nodes.withColumn("_over", over).withColumn("_i", F.explode(cut))
    part = {c: F.when(F.col("_over"), F.slice(c, F.col("_i") * elements + 1, elements)).otherwise(F.col(c)) for c in arrays}
    part["seg"] = F.when(F.col("_over"), F.col("_i")).otherwise(F.col("seg"))
    return pieces.select(*[part.get(c, F.col(c)).alias(c) for c in columns])


def samples(store: Store, elements: int = SEGMENT_ELEMENTS) -> DataFrame:
    """Long view: one row per sample of every signal that has ``data`` and ``dim0``.

    ``data`` meets ``dim0`` on (signal, segment), one bounded row each, and the samples
    are unfolded after the shuffle. Where one is longer the other is NULL, in whole
    segments too, so the rows do not depend on the segment size.
    """
    values = F.coalesce("f64", F.transform("f32", lambda x: x.cast("double")),
                        F.transform("i64", lambda x: x.cast("double")))
    nodes = store.nodes.where(F.col("node").isin("data", "dim0"))

    def column(node: str, name: str) -> DataFrame:
        return nodes.where(F.col("node") == node).select(*KEY, "seg", values.alias(name))

    complete = nodes.groupBy(*KEY).agg(F.count_distinct("node").alias("n")).where(F.col("n") == 2).select(*KEY)
    none = F.array().cast("array<double>")
    paired = column("dim0", "t").join(column("data", "v"), [*KEY, "seg"], "full_outer").join(complete, KEY, "left_semi")
    return (
        paired
        .select(*KEY, "seg", F.posexplode(F.arrays_zip(F.coalesce("t", none).alias("t"), F.coalesce("v", none).alias("v"))).alias("pos", "p"))
        .select(*KEY, (F.col("seg").cast("bigint") * elements + F.col("pos")).alias("idx"),
                F.col("p.t").alias("t"), F.col("p.v").alias("v"))
    )
