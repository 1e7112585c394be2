"""Digests of content: 128 bits a segment, added up per signal, tree and shot.

A segment's digest does not know the names it is stored under, so a rename keeps it. A parent's digest is a sum over
its children of a hash of the child's own name and digest: the order of the children does not matter, partial sums can
be combined, and two subtrees under different names have equal digests just if they hold the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalvault.model import KEY, Store

LEAF = ["kind", "shape", "f64", "f32", "i64", "str", "bin"]
ATTR = ["kind", "is_array", "f64", "i64", "str", "bin"]
DIGEST = ["h1", "h2"]
LANES = ["s1", "s2", "s3", "s4"]


def with_digests(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the digest of each row; what writers write."""
    content = [F.col(c) for c in LEAF]
    return nodes.withColumns({"h1": F.xxhash64(*content), "h2": F.xxhash64(F.lit(1), *content)})


def has_digests(nodes: DataFrame) -> bool:
    return set(DIGEST) <= set(nodes.columns)


def _part(kind: str, *columns: str | Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), F.lit(kind), *columns).alias(name) for salt, name in ((1, "p1"), (2, "p2"))]


def _added(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the parts in four lanes of 32 bits, which do not overflow below 2**31 children."""
    lanes = [F.sum(half(p)) for p in ("p1", "p2") for half in (
        lambda c: F.col(c).bitwiseAND(0xFFFFFFFF), lambda c: F.shiftrightunsigned(c, 32))]
    return parts.groupBy(*by).agg(*[lane.alias(name) for lane, name in zip(lanes, LANES)])


def _attributes(store: Store, side: str) -> DataFrame:
    """An attribute that holds NaN equals nothing, not even itself: ``side`` makes its digest differ between two sides."""
    return store.attrs.withColumn("side", F.when(_has_nan(), side))


def _has_nan() -> Column:
    return F.coalesce(F.exists("f64", F.isnan), F.lit(False))


def has_nan_attributes(store: Store) -> bool:
    return not store.attrs.where(_has_nan()).isEmpty()


def merkle(store: Store, level: str, side: str = "", signals: DataFrame | None = None) -> DataFrame:
    """Digest (four sums) of every group of ``level``: its columns of the key, and LANES.

    Only keys and segment digests of the leaves are read; with ``signals``, the digests of the signals (``side`` of the
    comparison included), no leaf at all.
    """
    attrs = _attributes(store, side)
    content = ["node", "name", "side", *ATTR]

    def groups(depth: int) -> DataFrame:
        return store.at_level(KEY[depth - 1]).select(*KEY[:depth], *_part("there"))

    def owned(depth: int) -> DataFrame:
        here = F.col(KEY[depth - 1]).isNotNull()
        for below in KEY[depth:]:
            here = here & F.col(below).isNull()
        return attrs.where(here).select(*KEY[:depth], *_part("attribute", *content))

    found = signals if signals is not None else _added(reduce(DataFrame.unionByName, [
        groups(3), owned(3), store.nodes.select(*KEY, *_part("leaf", "node", "seg", *DIGEST)),
        store.nested.select(*KEY, *_part("group", "path"))]), KEY)
    for depth in range(2, KEY.index(level), -1):
        children = found.select(*KEY[:depth], *_part("child", KEY[depth], *LANES))
        found = _added(reduce(DataFrame.unionByName, [groups(depth), owned(depth), children]), KEY[:depth])
    return found
