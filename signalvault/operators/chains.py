"""Mapping lines that depend on each other, judged without a round per line.

Lines that share a name form a chain. Per scope and chain, the lines are folded twice inside one row: first over sets
of groups that *may* bear each name, which gives every pair that can ever meet; those are compared once, all together.
Then over the groups that *do* bear it, with the verdicts at hand. Groups are numbered by their place among the chain's
names, 1 first; 0 is nobody.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalvault.session import cut_lineage


def names_of_lines(lines: DataFrame, scope: Sequence[str]) -> DataFrame:
    return lines.select("line_no", *scope, F.explode(F.array("old_name", "new_name")).alias("name"))


def ties(lines: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(a, b): each line and the first line that has a name in common with it, if that is another."""
    names = names_of_lines(lines, scope)
    earliest = names.groupBy(*scope, "name").agg(F.min("line_no").alias("b"))
    return names.join(earliest, [*scope, "name"]).where(F.col("line_no") > F.col("b")).select(
        F.col("line_no").alias("a"), "b").distinct()


def chains(lines: DataFrame, links: DataFrame) -> DataFrame:
    """(line_no, chain): the smallest line that each line is tied to, directly or over others.

    A line points to the smallest target among its neighbours, hands that to its own target, then skips to the target
    of its target: a chain of n lines takes about log n rounds, each written down.
    """
    both = cut_lineage(links.union(links.select("b", "a")))
    near = both.groupBy(F.col("a").alias("line_no")).agg(F.least("line_no", F.min("b")).alias("chain"))
    points = cut_lineage(lines.select("line_no").join(near, "line_no", "left").select(
        "line_no", F.coalesce("chain", "line_no").alias("chain")))
    while True:
        seen = both.join(points.select(F.col("line_no").alias("b"), F.col("chain").alias("low")), "b").groupBy(
            F.col("a").alias("line_no")).agg(F.min("low").alias("low")).join(points, "line_no")
        told = seen.select("line_no", "low").union(seen.select("chain", "low")).groupBy("line_no").agg(F.min("low").alias("low"))
        hooked = cut_lineage(points.join(told, "line_no", "left").select(
            "line_no", "chain", F.least("chain", "low").alias("low")))
        skipped = hooked.join(hooked.select(F.col("line_no").alias("low"), F.col("low").alias("far")), "low")
        after = cut_lineage(skipped.select("line_no", F.least("low", "far").alias("chain"),
                                           (F.least("low", "far") < F.col("chain")).alias("moved")))
        points = after.select("line_no", "chain")
        if after.where("moved").isEmpty():
            return points


FEW_LINES = 32
"""Lines of one scope up to which they are folded as one chain, tied or not."""


def chains_within(lines: DataFrame, links: DataFrame, tied: Sequence[str]) -> DataFrame:
    """(line_no, chain), where lines of scopes with few lines need not be tied to share a chain.

    Lines without a common name do not meet in the folds, so a small scope is a chain as it is, found by one aggregate.
    Only the lines of larger scopes go through the rounds of ``chains``.
    """
    if not tied:
        return chains(lines, links)
    sizes = lines.groupBy(*tied).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("chain"))
    placed = cut_lineage(lines.join(sizes, list(tied)).select(
        "line_no", F.when(F.col("n") <= FEW_LINES, F.col("chain")).alias("chain")))
    few, many = placed.where(F.col("chain").isNotNull()), placed.where(F.col("chain").isNull()).select("line_no")
    if many.isEmpty():
        return few
    inside = links.join(many, F.col("a") == F.col("line_no"), "left_semi")
    return few.unionByName(chains(many, inside))


def chain_groups(labels: DataFrame, lines: DataFrame, links: DataFrame, scope: Sequence[str], tied: Sequence[str]) -> DataFrame:
    """One row per (scope, chain) that bears one of its names: ``names`` and ``lines`` of the chain, the numbers ``held``.

    ``tied`` are the scope columns inside which names tie; a line that names a shot acts in that shot only.
    """
    marked = cut_lineage(lines.join(chains_within(lines, links, tied), "line_no"))
    per_chain = names_of_lines(marked.withColumn("line_no", F.col("chain")), tied).groupBy(
        F.col("line_no").alias("chain"), *tied).agg(F.array_sort(F.collect_set("name")).alias("names"))
    wanted = F.col("shot") if "shot" in scope else F.lit(None).cast("string")
    listed = marked.withColumn("only", wanted).join(per_chain.select("chain", "names"), "chain").groupBy("chain").agg(
        F.array_sort(F.collect_list(F.struct(
            "line_no", F.expr("cast(array_position(names, old_name) as int)").alias("o"),
            F.expr("cast(array_position(names, new_name) as int)").alias("n"), "only"))).alias("lines"),
        F.first("names").alias("names"))
    numbered = per_chain.select("chain", *tied, F.posexplode("names").alias("at", "current"))
    held = labels.join(numbered, [*tied, "current"]).groupBy(*scope, "chain").agg(
        F.collect_set((F.col("at") + 1).cast("int")).alias("held"))
    here = F.col("shot") if "shot" in scope else F.lit(None).cast("string")
    # a chain's lines meet every scope that bears its names: lines without effect there go before the folds
    return held.join(listed, "chain").withColumn("here", here).withColumn(
        "lines", F.expr("filter(lines, l -> l.only IS NULL OR l.only = here)")).drop("here")


_MAY_START = """named_struct('s', transform(names, (x, i) -> IF(array_contains(held, i + 1),
  named_struct('o', array(i + 1), 'v', false), named_struct('o', cast(array() as array<int>), 'v', true))),
  'p', cast(array() as array<struct<a: int, b: int>>))"""

# new: its own bearers, and those of old where it may be free. old: free if nobody bears new; else perhaps as before.
_MAY_STEP = """IF(size(acc.s[l.o - 1].o) = 0, acc, named_struct(
  's', transform(acc.s, (x, i) -> CASE
    WHEN i = l.n - 1 THEN named_struct('o', IF(x.v, array_union(x.o, acc.s[l.o - 1].o), x.o), 'v', x.v AND acc.s[l.o - 1].v)
    WHEN i = l.o - 1 THEN IF(size(acc.s[l.n - 1].o) = 0, named_struct('o', cast(array() as array<int>), 'v', true),
                             named_struct('o', x.o, 'v', true))
    ELSE x END),
  'p', concat(acc.p, flatten(transform(acc.s[l.o - 1].o, a -> transform(acc.s[l.n - 1].o, b -> named_struct('a', a, 'b', b)))))))"""

_DOES_START = """named_struct('s', transform(names, (x, i) -> IF(array_contains(held, i + 1), i + 1, 0)),
  'p', cast(array() as array<struct<line_no: bigint, o: int, n: int, a: int, b: int, moved: boolean>>))"""

_FREES = "(acc.s[l.n - 1] = 0 OR array_contains(same, named_struct('a', acc.s[l.o - 1], 'b', acc.s[l.n - 1])))"
_DOES_STEP = f"""IF(acc.s[l.o - 1] = 0, acc, named_struct(
  's', transform(acc.s, (x, i) -> CASE
    WHEN i = l.n - 1 THEN IF(x = 0, acc.s[l.o - 1], x)
    WHEN i = l.o - 1 THEN IF({_FREES}, 0, x) ELSE x END),
  'p', concat(acc.p, array(named_struct('line_no', l.line_no, 'o', l.o, 'n', l.n, 'a', acc.s[l.o - 1], 'b', acc.s[l.n - 1],
                                        'moved', {_FREES})))))"""


def possible_meetings(groups: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, chain, from_no, to_no): pairs of numbers that some course of the verdicts brings together, once each."""
    return groups.select(*scope, "chain", F.explode(F.array_distinct(F.expr(
        f"aggregate(lines, {_MAY_START}, (acc, l) -> {_MAY_STEP}).p"))).alias("pair")).select(
        *scope, "chain", F.col("pair.a").alias("from_no"), F.col("pair.b").alias("to_no"))


def names_of_pairs(groups: DataFrame, pairs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Pairs with the groups' names in the stored data."""
    return pairs.join(groups.select(*scope, "chain", "names"), [*scope, "chain"]).select(
        *scope, "chain", "from_no", "to_no", F.expr("names[from_no - 1]").alias("origin"), F.expr("names[to_no - 1]").alias("new_origin"))


def actual_meetings(groups: DataFrame, same: DataFrame, scope: Sequence[str]) -> DataFrame:
    """What each line does in sequence: (line_no, scope, old_name, new_name, origin, new_origin, moved), given the
    pairs ``same`` (scope, chain, from_no, to_no) whose content is equal. ``moved``: the name became free or was given up."""
    known = same.groupBy(*scope, "chain").agg(F.collect_set(F.struct(F.col("from_no").alias("a"), F.col("to_no").alias("b"))).alias("same"))
    ready = groups.join(known, [*scope, "chain"], "left").withColumn(
        "same", F.coalesce("same", F.expr("cast(array() as array<struct<a: int, b: int>>)")))
    acts = ready.select(*scope, "names", F.explode(F.expr(
        f"aggregate(lines, {_DOES_START}, (acc, l) -> {_DOES_STEP}).p")).alias("act"))
    return acts.select(F.col("act.line_no").alias("line_no"), *scope, *[
        F.expr(f"IF(act.{at} = 0, NULL, names[act.{at} - 1])").alias(c)
        for at, c in (("o", "old_name"), ("n", "new_name"), ("a", "origin"), ("b", "new_origin"))], "act.moved")
