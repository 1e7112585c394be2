"""Tolerant comparison of subtrees, many pairs at once.

A *unit* is one pair of subtrees to compare; ``unit`` columns identify it on both
sides. Rows carry ``path``, the place below the unit. All leaves of all units are
aligned in one full outer join on (unit, path, segment), so one very large unit is
spread over the tasks like many small ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalvault.fixed_values import (
    ATTRIBUTE_KEYS, DATA_VALUES, NAN_POSITIONS, ONLY_IN_FIRST, ONLY_IN_SECOND, SHAPE_MISMATCH,
    SHOWN_DIFFERENCES,
)
from signalvault.functions.digests import ATTR, DIGEST, LANES, LEAF, has_digests, has_nan_attributes, merkle
from signalvault.model import KEY, SEGMENT_ELEMENTS, Store
from signalvault.session import cut_lineage
from signalvault.functions.values import (
    as_doubles, attr_values_equal, nan_positions_equal, node_values_equal,
)


@dataclass(frozen=True)
class Side:
    """One side of the units: leaves, existing groups and attributes with unit columns and path."""

    leaves: DataFrame
    groups: DataFrame
    attrs: DataFrame


def align(left: DataFrame, right: DataFrame, on: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Full outer join keeping both sides' payload as the structs ``a`` and ``b``."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*on, F.struct(*payload, F.lit(True).alias("there")).alias(name))

    return packed(left, "a").join(packed(right, "b"), list(on), "full_outer")


def _one_sided() -> Column:
    return (F.when(F.col("b").isNull(), F.lit(ONLY_IN_FIRST))
            .when(F.col("a").isNull(), F.lit(ONLY_IN_SECOND)))


def keys_only_in(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that one side lacks, with the side that has them; no row if the key sets are
    equal. Each side lists a key once, as the groups of a store do."""
    aligned = align(first, second, on, [])
    return aligned.select(*on, _one_sided().alias("side")).where(F.col("side").isNotNull())


def keys_equal(first: DataFrame, second: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group ``by`` of the keys ``on``, over groups of either side: do both sides list the same keys?"""
    odd = keys_only_in(first, second, on).select(*by).distinct().withColumn("odd", F.lit(True))
    groups = first.select(*by).unionByName(second.select(*by)).distinct()
    return groups.join(odd, list(by), "left").select(*by, F.col("odd").isNull().alias("same_keys"))


def leaf_difference(first: str = "a", second: str = "b") -> Column:
    """What differs in an aligned leaf row, cheapest test first; NULL if nothing."""
    a, b = F.col(first), F.col(second)
    both_float = a["kind"].isin("f64", "f32")
    return (
        F.when(b.isNull(), F.lit(ONLY_IN_FIRST)).when(a.isNull(), F.lit(ONLY_IN_SECOND))
        .when(~a["shape"].eqNullSafe(b["shape"]), F.lit(SHAPE_MISMATCH))
        .when(~node_values_equal(first, second), F.when(
            both_float & ~F.coalesce(nan_positions_equal(as_doubles(first), as_doubles(second)),
                                     F.lit(True)), F.lit(NAN_POSITIONS)).otherwise(F.lit(DATA_VALUES)))
    )


def leaf_digest() -> Column:
    """128 hash bits of what a leaf row holds; rows of equal content have equal digests."""
    content = [F.col(c) for c in LEAF]
    return F.struct(F.xxhash64(*content).alias("x"), F.xxhash64(F.lit(1), *content).alias("y"))


def _digest(rows: DataFrame) -> Column:
    """The digest a stored row carries, or that of its content."""
    return F.struct(*DIGEST) if has_digests(rows) else leaf_digest()


ARRAYS = ["f64", "f32", "i64", "str"]


def _length(row: str = "") -> Column:
    return F.greatest(F.lit(0), *[F.coalesce(F.size(f"{row}{c}"), F.lit(0)) for c in ARRAYS]).cast("bigint")


SHORT = 4
"""Numbers up to which a row's content is no longer than its digest."""


def _is_short() -> Column:
    numbers = F.col("kind").isin("f64", "f32", "i64", "bool") & F.col("str").isNull() & F.col("bin").isNull()
    return F.coalesce(numbers & (_length() <= SHORT) & (F.size("shape") <= SHORT), F.lit(False))


def recut(rows: DataFrame, leaf: Sequence[str], elements: int = SEGMENT_ELEMENTS) -> DataFrame:
    """Segments of any lengths -> (leaf columns, cell, LEAF): the same leaves in cells of ``elements`` values.

    Where a segment begins follows from the lengths of those before it, which are summed without their arrays. Each
    segment is cut at the borders of the cells it reaches into, and a cell puts its pieces together, so no task holds
    more than a cell of a leaf. An empty leaf is one empty cell.
    """
    sized = rows.select(*leaf, "seg", *LEAF, _length().alias("n"))
    before = Window.partitionBy(*leaf).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    begins = sized.select(*leaf, "seg", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    begin, n, cell = F.col("begin"), F.col("n"), F.col("cell")
    reached = F.sequence(F.floor(begin / elements), F.floor(F.greatest(begin + n - 1, begin) / elements))
    low = F.greatest(cell * elements - begin, F.lit(0))
    high = F.least((cell + 1) * elements - begin, n)
    pieces = (
        sized.join(begins, [*leaf, "seg"]).where((n > 0) | (begin == 0))
        .withColumn("cell", F.explode(reached))
        .withColumns({c: F.slice(c, (low + 1).cast("int"), (high - low).cast("int")) for c in ARRAYS})
    )

    def joined(column: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("begin", "seg", column)))
        return F.flatten(F.transform(ordered, lambda x: x[column])).alias(column)

    return pieces.groupBy(*leaf, "cell").agg(
        *[joined(c) if c in ARRAYS else F.first(c, ignorenulls=True).alias(c) for c in LEAF])


# What is said of a leaf that differs in several ways: the first of these.
_ORDER = [ONLY_IN_FIRST, ONLY_IN_SECOND, SHAPE_MISMATCH, NAN_POSITIONS, DATA_VALUES]


def _one_per_leaf(found: DataFrame, leaf: Sequence[str]) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(x) for x in _ORDER]), F.col("difference"))
    return (found.groupBy(*leaf).agg(F.min(F.struct(rank.alias("rank"), "difference")).alias("d"))
            .select(*leaf, F.col("d.difference").alias("difference")))


def leaf_differences(left: DataFrame, right: DataFrame, unit: Sequence[str], elements: int = SEGMENT_ELEMENTS) -> DataFrame:
    """Leaves that differ, as (unit..., path, difference), each once, however they are cut into segments.

    Keys and digests are aligned first; arrays are read again, and joined, only for segments that both sides have with
    different digests. A row of few numbers that carries no digest brings its content along in place of one, and is settled
    at once. Where it shows that the two sides are cut differently (lengths differ under one shape, or one side has segments
    that the other has not), those leaves are brought to cells of ``elements`` values and compared anew.
    """
    leaf = [*unit, "path"]
    on = [*leaf, "seg"]

    def told(side: DataFrame) -> DataFrame:
        short = F.lit(False) if has_digests(side) else _is_short()
        return side.select(*on, F.when(~short, _digest(side)).alias("digest"), F.when(short, F.struct(*LEAF)).alias("short"))

    def resized(a: str, b: str) -> Column:
        return (_length(f"{a}.") != _length(f"{b}.")).alias("resized")

    settled = F.col("a.short").isNotNull() & F.col("b.short").isNotNull()
    same = _one_sided().isNull() & F.when(settled, F.col("a.short").eqNullSafe(F.col("b.short"))).otherwise(
        F.col("a.digest").eqNullSafe(F.col("b.digest")))
    aligned = cut_lineage(
        align(told(left), told(right), on, ["digest", "short"]).where(~same)
        .select(*on, _one_sided().alias("lone"), settled.alias("settled"),
                F.when(settled, leaf_difference("a.short", "b.short")).alias("difference"),
                F.when(settled, resized("a.short", "b.short")).alias("resized"))
        .where(~F.col("settled") | F.col("difference").isNotNull()))
    compared = aligned.where("settled").select(*leaf, "difference", "resized")
    odd = aligned.where(F.col("lone").isNull() & ~F.col("settled")).select(*on)
    if not odd.isEmpty():
        first, second = (side.join(odd, on, "left_semi") for side in (left, right))
        compared = compared.unionByName(cut_lineage(
            align(first, second, on, LEAF)
            .select(*leaf, leaf_difference().alias("difference"), resized("a", "b"))
            .where(F.col("difference").isNotNull())))
    lone = aligned.where(F.col("lone").isNotNull()).select(*leaf, F.col("lone").alias("difference"))
    changed = compared.where("resized").select(*leaf)
    compared = compared.select(*leaf, "difference")
    if lone.select(*leaf).unionByName(changed).isEmpty():
        return _one_per_leaf(compared, leaf)

    def known(side: str, other: DataFrame) -> DataFrame:
        """Leaves of which one side has segments of its own while the other has the leaf as well."""
        return lone.where(F.col("difference") == side).select(*leaf).distinct().join(other.select(*leaf).distinct(), leaf, "left_semi")

    shared = cut_lineage(known(ONLY_IN_FIRST, right).unionByName(known(ONLY_IN_SECOND, left)).distinct())
    settled = compared.where(F.col("difference") == SHAPE_MISMATCH).select(*leaf).distinct()
    anew = cut_lineage(shared.unionByName(changed).distinct().join(settled, leaf, "left_anti"))
    found = lone.join(shared, leaf, "left_anti").unionByName(compared.join(anew, leaf, "left_anti"))
    if not anew.isEmpty():
        cells = align(*[recut(side.join(anew, leaf, "left_semi"), leaf, elements) for side in (left, right)], [*leaf, "cell"], LEAF)
        found = found.unionByName(cells.select(
            *leaf, F.when(_one_sided().isNotNull(), F.lit(SHAPE_MISMATCH)).otherwise(leaf_difference()).alias("difference"))
            .where(F.col("difference").isNotNull()))
    return _one_per_leaf(found, leaf)


def group_differences(left: DataFrame, right: DataFrame, unit: Sequence[str]) -> DataFrame:
    return keys_only_in(left, right, [*unit, "path"]).withColumnRenamed("side", "difference")


def attr_differences(left: DataFrame, right: DataFrame, unit: Sequence[str]) -> DataFrame:
    aligned = align(left, right, [*unit, "path", "name"], ATTR)
    found = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(ATTRIBUTE_KEYS))
        .when(~attr_values_equal("a", "b"), F.concat(F.lit("Attribute differs: "), F.col("name")))
    )
    return (aligned.select(*unit, "path", found.alias("difference"))
            .where(F.col("difference").isNotNull()))


def differences(left: Side, right: Side, unit: Sequence[str]) -> DataFrame:
    """All differences as (unit..., path, difference), each once."""
    return (
        group_differences(left.groups, right.groups, unit)
        .unionByName(leaf_differences(left.leaves, right.leaves, unit))
        .unionByName(attr_differences(left.attrs, right.attrs, unit))
        .distinct()
    )


def difference_counts(diffs: DataFrame, unit: Sequence[str]) -> DataFrame:
    return diffs.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_differences"))


def verdicts(units: DataFrame, diffs: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Units with ``n_differences`` and ``is_equal``."""
    return (
        units.join(difference_counts(diffs, unit), list(unit), "left")
        .withColumn("n_differences", F.coalesce("n_differences", F.lit(0)))
        .withColumn("is_equal", F.col("n_differences") == 0)
    )


def first_differences(diffs: DataFrame, unit: Sequence[str], k: int = SHOWN_DIFFERENCES) -> DataFrame:
    """Per unit the first ``k`` differences in path order and the number left out.

    Ranking is limited on the map side as well, so a unit with very many differences
    sends at most ``k`` of them per task to the final ranking. The differences are
    written down, so ranking and counting do not compare twice.
    """
    by = list(unit)
    diffs = cut_lineage(diffs)
    text = F.concat_ws(": ", "path", "difference")
    first = (
        diffs.select(*by, text.alias("text"))
        .withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("text")))
        .where(F.col("place") <= k)
        .groupBy(*by).agg(F.array_sort(F.collect_list("text")).alias("shown"))
    )
    return first.join(difference_counts(diffs, unit), by).select(
        *by, "shown", F.greatest(F.col("n_differences") - k, F.lit(0)).alias("n_more"))


SCOPES = {"shot": [], "tree": ["shot"], "signal": ["shot", "tree"]}


def side_of(store: Store, names: DataFrame, unit: Sequence[str], level: str, open_signals: DataFrame | None = None) -> Side:
    """Content below the groups ``names`` (unit columns, scope and ``level``), as one side of a comparison.

    ``open_signals`` (unit columns and the key below the unit) lists the signals worth a look: leaves, groups and
    attributes of others are left out. What belongs to no signal stays.
    """
    below = KEY[KEY.index(level) + 1:]
    digests = DIGEST if has_digests(store.nodes) else []

    def pick(rows: DataFrame, path: Sequence[str], payload: Sequence[str]) -> DataFrame:
        joined = rows.join(names, [*SCOPES[level], level])
        if open_signals is not None:
            inner = joined.where(F.col("signal").isNotNull()).join(open_signals, [*unit, *below], "left_semi")
            joined = inner.select(*joined.columns).unionByName(joined.where(F.col("signal").isNull()))
        return joined.select(*unit, F.concat_ws("/", *path).alias("path"), *payload)

    groups = store.groups.select(*KEY, F.lit(None).cast("string").alias("inner"))
    if store.paths is not None:
        groups = groups.unionByName(store.paths.select(*KEY, F.col("path").alias("inner")))
    return Side(pick(store.nodes, [*below, "node"], ["seg", *LEAF, *digests]), pick(groups, [*below, "inner"], []),
                pick(store.attrs, [*below, "node"], ["name", *ATTR]))


def _alike(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``on`` with ``same``: do both sides have the digest LANES there, and the same one?"""
    aligned = align(first.select(*on, F.struct(*LANES).alias("sums")), second.select(*on, F.struct(*LANES).alias("sums")), on, ["sums"])
    return aligned.select(*on, F.coalesce(F.col("a.sums") == F.col("b.sums"), F.lit(False)).alias("same"))


def signal_digests(first: Store, second: Store) -> tuple[DataFrame, DataFrame]:
    """Digests of all signals of both sides, written down: the units' digests and the search for unequal signals come from
    them, so the leaves are added up once. Two sides of one store share theirs."""
    sums = cut_lineage(merkle(first, "signal", "first"))
    if second is first and not has_nan_attributes(first):
        return sums, sums
    return sums, cut_lineage(merkle(second, "signal", "second"))


def unequal_units(first: Store, second: Store, left: DataFrame, right: DataFrame, unit: Sequence[str], level: str,
                  signals: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Units whose subtrees have different digests. Only keys and digests are read."""
    on = [*SCOPES[level], level]
    sides = [merkle(s, level, name, known).join(names, on)
             for s, names, name, known in ((first, left, "first", signals[0]), (second, right, "second", signals[1]))]
    return _alike(*sides, unit).where(~F.col("same")).select(*unit)


def unequal_signals(left: DataFrame, right: DataFrame, unit: Sequence[str], level: str, signals: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(unit columns, key below the unit) of the signals whose digests differ or that one side lacks."""
    below = KEY[KEY.index(level) + 1:]
    on = [*SCOPES[level], level]
    sides = [known.join(names, on) for known, names in zip(signals, (left, right))]
    return _alike(*sides, [*unit, *below]).where(~F.col("same")).select(*unit, *below)


def subtree_differences(first: Store, second: Store, left: DataFrame, right: DataFrame, unit: Sequence[str], level: str) -> DataFrame:
    """All differences between the groups ``left`` of ``first`` and ``right`` of ``second``, which ``unit`` pairs.

    Where both stores carry digests, the search goes down from the unit: units of equal digests are settled, then
    signals, then segments, and arrays are read for the segments that are left. Otherwise content is hashed first.
    """
    only = None
    if has_digests(first.nodes) and has_digests(second.nodes):
        signals = signal_digests(first, second)
        unequal = cut_lineage(unequal_units(first, second, left, right, unit, level, signals))
        if unequal.isEmpty():   # nothing but keys and digests is read
            return unequal.select(*unit, F.lit("").alias("path"), F.lit("").alias("difference"))
        left, right = (names.join(unequal, list(unit), "left_semi").select(*names.columns) for names in (left, right))
        only = cut_lineage(unequal_signals(left, right, unit, level, signals))
    return differences(side_of(first, left, unit, level, only), side_of(second, right, unit, level, only), unit)


def compare_stores(first: Store, second: Store, level: str = "tree") -> tuple[DataFrame, DataFrame]:
    """Verdicts (key of the level, n_differences, is_equal) and differences of all groups of ``level`` that both stores
    have under the same name."""
    on = [*SCOPES[level], level]
    both = cut_lineage(first.at_level(level).select(*on).join(second.at_level(level).select(*on), on, "left_semi"))
    diffs = cut_lineage(subtree_differences(first, second, both, both, on, level))
    return verdicts(both, diffs, on), diffs
