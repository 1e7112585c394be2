"""Keyed merge of sources into a target store."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalvault.model import GROUPS, KEY, NODES, Store, conform
from signalvault.session import cut_lineage

@dataclass(frozen=True)
class Merge:
    store: Store          # the merged store
    added: Store          # what the target lacked: rows taken from sources, new groups
    stats: DataFrame      # one row of counters
    replaced: DataFrame | None = None   # signal keys of the target that a source's rows replace


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """All sources in order, with the place of the source as ``src`` (from 1)."""
    return reduce(DataFrame.unionByName,
                  [f.withColumn("src", F.lit(i)) for i, f in enumerate(frames, start=1)])


def occurrences(keys: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """(src, key) rows, src 0 being the target -> one row per key with its holders.

    Only key columns are read. Partial aggregation reduces repeats before the shuffle.
    """
    source = F.when(F.col("src") > 0, F.col("src"))
    return keys.groupBy(*by).agg(
        (F.min("src") == 0).alias("in_target"), F.min(source).alias("first_src"),
        F.max(source).alias("last_src"), F.count(source).alias("n_src"))


def held_in(keys: DataFrame, target: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """``keys`` with ``in_target``: does the target hold the key?"""
    have = target.select(*by).distinct().withColumn("held", F.lit(True))
    return keys.join(have, list(by), "left").withColumn("in_target", F.coalesce("held", F.lit(False))).drop("held")


def name_bounds(keys: DataFrame, within: Sequence[str], names: Sequence[str]) -> DataFrame:
    """First and last of ``names`` in name order per ``within``, by column and not by joined path."""
    place = F.struct(*names)
    found = keys.groupBy(*within).agg(F.min(place).alias("a"), F.max(place).alias("z"))
    return found.select(*within, *[F.col(f"{side}.{n}").alias(f"{word}_{n}") for side, word in (("a", "first"), ("z", "last")) for n in names])


def winners(holders: DataFrame, strategy: str) -> DataFrame:
    """Which source a key is taken from: (key, src); keys kept from the target are absent."""
    if strategy == "skip":
        return holders.where(~F.col("in_target")).select(*KEY, F.col("first_src").alias("src"))
    return holders.where(F.col("n_src") > 0).select(*KEY, F.col("last_src").alias("src"))


def merge_counts(held: DataFrame, files: int, strategy: str) -> DataFrame:
    """The five counters as one row, from the held groups of all levels in one pass."""
    signal, lacking = F.col("level") == "signal", ~F.col("in_target")
    total = F.coalesce(F.sum(F.when(signal, F.col("n_src"))), F.lit(0))
    new, zero = F.count_if(signal & lacking), F.lit(0)
    added, skipped, over = {
        "skip": (new, total - new, zero),
        "overwrite": (total, zero, total - new),
        "upsert": (new, zero, total - new),
        "error": (total, zero, zero),
    }[strategy]
    return held.agg(
        F.lit(files).cast("bigint").alias("files_processed"),
        F.count_if((F.col("level") == "tree") & lacking).alias("trees_added"),
        *[c.cast("bigint").alias(f"signals_{name}")
          for c, name in ((added, "added"), (skipped, "skipped"), (over, "overwritten"))])


def stack(sources: Sequence[Store]) -> Store:
    """Sources in order as one store whose tables have a ``src`` column, from 1."""
    names = ["nodes", "groups", "attrs"] + (["paths"] if any(s.paths is not None for s in sources) else [])
    tables = [[getattr(s, "nested" if name == "paths" else name) for s in sources] for name in names]
    return Store(*[stacked([conform(t, NODES) for t in ts] if name == "nodes" else ts) for name, ts in zip(names, tables)])


def merge(target: Store, sources: Sequence[Store], strategy: str = "skip") -> Merge:
    """Merge ``sources`` in order into ``target``.

    ``skip`` keeps what is there, ``overwrite`` and ``upsert`` take the last source
    (they differ in how overwritten signals are counted), ``error`` stops a source at
    its first duplicate. Shot- and tree-level attributes of sources are not taken over.
    """
    return merge_stacked(target, stack(sources), len(sources), strategy)


def merge_stacked(target: Store, sources: Store, n_sources: int, strategy: str = "skip") -> Merge:
    """``merge`` for sources that are one table already, told apart by ``src`` (from 1).

    The plan does not grow with the number of sources. Only key columns are ranked;
    target content is never shuffled under ``skip``.
    """
    if strategy == "error":
        return _merge_error(target, sources, n_sources)
    if strategy not in ("skip", "overwrite", "upsert"):
        raise ValueError(f"unknown strategy {strategy!r}")
    target = Store(conform(target.nodes, NODES), target.groups, target.attrs, target.paths)
    held = hold(target.groups, sources.groups)
    chosen = winners(held.where(F.col("level") == "signal"), strategy)

    def taken(rows: DataFrame) -> DataFrame:
        return rows.join(chosen, [*KEY, "src"], "left_semi").drop("src")

    def kept(rows: DataFrame) -> DataFrame:
        if strategy == "skip":
            return rows
        return rows.join(chosen.select(*KEY), KEY, "left_anti").select(*rows.columns)

    # A NULL signal joins nothing: an anti join keeps the target's shot and tree
    # attributes, a semi join drops the sources' ones.
    nodes, attrs = taken(sources.nodes), taken(sources.attrs)
    paths = None if sources.paths is None else taken(sources.paths)
    replaced = None
    if strategy != "skip":
        replaced = held.where((F.col("level") == "signal") & F.col("in_target") & (F.col("n_src") > 0)).select(*KEY)
    return Merge(
        Store(kept(target.nodes).unionByName(nodes), conform(held, GROUPS),
              kept(target.attrs).unionByName(attrs), _with_paths(target, kept, paths)),
        Store(nodes, new_groups(held), attrs, paths), merge_counts(held, n_sources, strategy), replaced)


def _with_paths(target: Store, kept: Callable[[DataFrame], DataFrame], paths: DataFrame | None) -> DataFrame | None:
    """Groups below signals: those of the target that stay, and those that come."""
    if target.paths is None and paths is None:
        return None
    left = kept(target.nested)
    return left if paths is None else left.unionByName(paths)


def hold(target_groups: DataFrame, source_groups: DataFrame) -> DataFrame:
    """Every group once, with its holders. Key columns only, written down once: content,
    groups, attributes and counters of a merge all come from it."""
    groups = target_groups.withColumn("src", F.lit(0)).unionByName(source_groups)
    return cut_lineage(occurrences(groups, [*KEY, "level"]))


def new_groups(held: DataFrame) -> DataFrame:
    return conform(held.where(~F.col("in_target")), GROUPS)


def before(bound: Sequence[str], columns: Sequence[str] = KEY, inclusive: bool = False) -> Column:
    """Tuple comparison ``columns < bound`` (by column, never by the joined path)."""
    out = F.lit(inclusive)
    for name, value in zip(reversed(columns), reversed(bound)):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def contested(keys: DataFrame) -> DataFrame:
    """Keys that could be a duplicate: a source holds them, and the target or another
    source too. ``srcs`` has at most one entry per source, in order."""
    source = F.when(F.col("src") > 0, F.col("src"))
    return keys.groupBy(*KEY).agg(
        (F.min("src") == 0).alias("in_target"), F.sort_array(F.collect_set(source)).alias("srcs"),
    ).where((F.size("srcs") > 1) | (F.col("in_target") & (F.size("srcs") > 0)))


def first_meetings(holders: DataFrame) -> DataFrame:
    """(later, earlier, key): the first key, in name order, that two holders share; holder 0 is the target.

    Keys with the same holders become one row before pairs are formed, so the pairs do
    not grow with the keys; minima combine on the map side.
    """
    place = F.struct(*KEY)
    patterns = holders.groupBy("in_target", "srcs").agg(F.min(place).alias("key"))
    pairs = patterns.withColumn("later", F.explode("srcs")).withColumn("earlier", F.explode(F.concat(
        F.when(F.col("in_target"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
        F.filter("srcs", lambda i: i < F.col("later")))))
    return pairs.groupBy("later", "earlier").agg(F.min("key").alias("key"))


def find_bounds(keys: DataFrame, n_sources: int) -> list[tuple[str, str, str] | None]:
    """Per source the first key, in name order, that its target already holds; one job for all sources.

    An earlier source has inserted what lies below its own bound. So the bound of a
    source is the least first meeting with an earlier holder that lies below that
    holder's bound; later meetings with the same holder cannot be smaller. The bounds
    are one fold over the rows of first meetings, in the order of sources.
    """
    spark = keys.sparkSession
    met = first_meetings(contested(keys)).groupBy("later").agg(
        F.collect_list(F.struct("earlier", "key")).alias("firsts"))
    each = spark.range(1, n_sources + 1).select(F.col("id").cast("int").alias("later")).join(met, "later", "left")
    key_type = "struct<shot:string,tree:string,signal:string>"

    def step(bounds: Column, source: Column) -> Column:
        def counts(meeting: Column) -> Column:
            bound = F.get(bounds, meeting["earlier"] - 1)["key"]      # the target, as a source that runs through, has none
            return bound.isNull() | (meeting["key"] < bound)

        real = F.transform(F.filter(source["firsts"], counts), lambda m: m["key"])
        return F.concat(bounds, F.array(F.struct(F.array_min(real).alias("key"))))

    start = F.array().cast(f"array<struct<key:{key_type}>>")
    row = each.agg(F.array_sort(F.collect_list(F.struct("later", "firsts"))).alias("rows")).select(
        F.aggregate("rows", start, step).alias("bounds")).first()
    return [None if b.key is None else tuple(b.key) for b in row.bounds]


def cut_at(rows: DataFrame, bounds: Sequence[tuple[str, str, str] | None]) -> DataFrame:
    """Source rows that come before their source's first duplicate: a filter on literals."""
    keep = F.lit(True)
    for i, bound in enumerate(bounds, start=1):
        if bound is not None:
            keep = keep & ((F.col("src") != i) | before(bound))
    return rows.where(keep)


def cut_groups(groups: DataFrame, bounds: Sequence[tuple[str, str, str] | None]) -> DataFrame:
    """Group rows a source creates before it stops: the failing shot and tree included."""
    keep, level = F.lit(True), F.col("level")
    for i, bound in enumerate(bounds, start=1):
        if bound is not None:
            keep = keep & (
                (F.col("src") != i)
                | ((level == "shot") & before(bound[:1], KEY[:1], inclusive=True))
                | ((level == "tree") & before(bound[:2], KEY[:2], inclusive=True))
                | ((level == "signal") & before(bound)))
    return groups.where(keep)


def _merge_error(target: Store, sources: Store, n_sources: int) -> Merge:
    """Each source is inserted up to its first duplicate; the next source goes on."""
    keys = target.signal_keys().withColumn("src", F.lit(0)).unionByName(
        sources.at_level("signal").select("src", *KEY))
    bounds = find_bounds(keys, n_sources)
    held = hold(target.groups, cut_groups(sources.groups, bounds))
    target = Store(conform(target.nodes, NODES), target.groups, target.attrs, target.paths)
    nodes = cut_at(sources.nodes, bounds).drop("src")
    paths = None if sources.paths is None else cut_at(sources.paths, bounds).drop("src")
    attrs = cut_at(sources.attrs.where(F.col("signal").isNotNull()), bounds).drop("src")
    complete = sum(bound is None for bound in bounds)
    return Merge(
        Store(target.nodes.unionByName(nodes), conform(held, GROUPS), target.attrs.unionByName(attrs),
              _with_paths(target, lambda rows: rows, paths)),
        Store(nodes, new_groups(held), attrs, paths), merge_counts(held, complete, "error"))
