"""Renaming of shots, trees or signals that never loses differing data.

Content is not moved while names are being resolved. ``labels`` holds one small row
per existing group of the level: its scope, its name in the stored data (``origin``)
and its name now (``current``). Every rename only edits labels; comparisons read the
stored data by origin, and the payload is relabelled once at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalvault.model import GROUPS, Store, conform, each_table, empty
from signalvault.operators.chains import actual_meetings, chain_groups, names_of_pairs, possible_meetings, ties
from signalvault.operators.compare import SCOPES, subtree_differences, verdicts
from signalvault.session import cut_lineage

RENAMED = "renamed"
DEDUPLICATED = "deduplicated"
CONFLICT = "conflict"
NOT_FOUND = "not_found"
UNCHANGED = "same_name"
NO_SCOPE = "scope_required"

MAPPING = "line_no bigint, old_name string, new_name string, shot string, tree string"
VERDICTS = ("line_no bigint, shot string, tree string, old_name string, new_name string, "
            "verdict string, n_differences bigint")


@dataclass(frozen=True)
class Rename:
    verdicts: DataFrame
    differences: DataFrame
    store: Store
    labels: DataFrame | None = None     # (scope, origin, current) of the groups in question, after the renames


def labels_of(store: Store, level: str) -> DataFrame:
    return store.at_level(level).select(
        *SCOPES[level], F.col(level).alias("origin"), F.col(level).alias("current"))


def runnable(lines: DataFrame, level: str) -> DataFrame:
    """Lines that can act: real renames, and for signals only with shot and tree named."""
    acting = lines.where(F.col("old_name") != F.col("new_name"))
    if level == "signal":
        acting = acting.where(F.col("shot").isNotNull() & F.col("tree").isNotNull())
    return acting


def candidates(labels: DataFrame, lines: DataFrame, level: str) -> DataFrame:
    """Mapping lines met with the groups that bear the old name, and the bearer of the new one.

    Equi-joins only: lines that name a shot meet its groups by (shot, name), the others
    by name. A mapping is small, and Spark broadcasts it when it is.
    """
    scope = SCOPES[level]
    have = labels.withColumnRenamed("current", "old_name")
    plain = ["line_no", "old_name", "new_name"]
    if level == "signal":                      # both scope columns are required there
        found = have.join(lines.select(*plain, *scope), ["old_name", *scope])
    elif level == "tree":
        named = have.join(lines.where(F.col("shot").isNotNull()).select(*plain, "shot"), ["old_name", "shot"])
        found = named.unionByName(have.join(lines.where(F.col("shot").isNull()).select(*plain), "old_name"))
    else:
        found = have.join(lines.select(*plain), "old_name")
    bearers = labels.select(*scope, F.col("current").alias("new_name"), F.col("origin").alias("new_origin"))
    return (
        found.select("line_no", *scope, "old_name", "new_name", "origin")
        .join(bearers, [*scope, "new_name"], "left")
    )


def judge(store: Store, found: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """Verdict per (line, group), and the differences behind the conflicts.

    Candidates, verdicts and differences are written down: the arrays are read and
    compared once, however often these are used. Without a
    collision no content is read at all.
    """
    unit = ["line_no", *SCOPES[level]]
    found = cut_lineage(found)
    pairs = found.where(F.col("new_origin").isNotNull())
    if pairs.isEmpty():
        diffs = empty(found.sparkSession, ", ".join(
            ["line_no bigint", *[f"{c} string" for c in SCOPES[level]], "path string", "difference string"]))
        judged = found.withColumns({"n_differences": F.lit(0).cast("bigint"), "verdict": F.lit(RENAMED)})
    else:
        old, new = (pairs.select(*unit, F.col(c).alias(level)) for c in ("origin", "new_origin"))
        diffs = cut_lineage(subtree_differences(store, store, old, new, unit, level))
        judged = cut_lineage(verdicts(found, diffs, unit).withColumn(
            "verdict",
            F.when(F.col("new_origin").isNull(), RENAMED).when(F.col("is_equal"), DEDUPLICATED)
            .otherwise(CONFLICT)))
    return judged.select(*unit, "old_name", "new_name", "origin", "verdict", "n_differences"), diffs


def relabel(labels: DataFrame, judged: DataFrame, level: str) -> DataFrame:
    """Labels after the last verdict on each group; a dropped group keeps its row with a NULL name."""
    on = [*SCOPES[level], "origin"]
    acted = judged.where(F.col("verdict").isin(RENAMED, DEDUPLICATED)).groupBy(*on).agg(
        F.max_by(F.struct("verdict", "new_name"), "line_no").alias("last")).select(
        *on, F.col("last.verdict").alias("done"), F.col("last.new_name").alias("to"))
    return labels.join(acted, on, "left").select(
        *on, F.when(F.col("done").isNull(), F.col("current"))
        .when(F.col("done") == RENAMED, F.col("to")).alias("current"))


def apply_labels(store: Store, labels: DataFrame, level: str, names: Sequence[str] | None = None) -> Store:
    """The store under its new names. Only changed groups take part in the join.

    ``names``, if known, are the old names: rows of other names skip the join, and at
    tree level their folders are not even matched.
    """
    scope = SCOPES[level]
    on = [*scope, level]
    changed = labels.where(~F.col("current").eqNullSafe(F.col("origin"))).select(
        *scope, F.col("origin").alias(level), F.col("current").alias("to"), F.lit(True).alias("hit"))

    def renamed(rows: DataFrame) -> DataFrame:
        columns = rows.columns
        subject, rest = rows, None
        if names is not None:
            named = F.coalesce(F.col(level).isin(*names), F.lit(False))
            subject, rest = rows.where(named), rows.where(~named)
        moved = subject.join(changed, on, "left").where(
            F.col("hit").isNull() | F.col("to").isNotNull()
        ).select(*[F.coalesce("to", level).alias(c) if c == level else F.col(c) for c in columns])
        return moved if rest is None else rest.unionByName(moved)

    return Store(renamed(store.nodes), conform(renamed(store.groups), GROUPS), renamed(store.attrs),
                 None if store.paths is None else renamed(store.paths))


def report(lines: DataFrame, judged: DataFrame, level: str) -> DataFrame:
    """Verdict table: one row per judged group, one per line that reached no group."""
    reached = judged.select("line_no").distinct().withColumn("reached", F.lit(True))
    unreached = lines.join(reached, "line_no", "left").where(F.col("reached").isNull())
    reason = F.when(F.col("old_name") == F.col("new_name"), UNCHANGED)
    if level == "signal":
        reason = reason.when(F.col("shot").isNull() | F.col("tree").isNull(), NO_SCOPE)
    return conform(judged, VERDICTS).unionByName(conform(
        unreached.withColumns({"verdict": reason.otherwise(NOT_FOUND),
                               "n_differences": F.lit(0)}), VERDICTS))


def rename(store: Store, old: str, new: str, level: str = "tree", shot: str | None = None,
           tree: str | None = None, dry_run: bool = False) -> Rename:
    """Rename ``old`` to ``new``. Where ``new`` exists: equal data drops ``old``,
    differing data leaves both and is reported. Verdicts are computed here; the
    renamed store is lazy."""
    shot, tree = shot or None, tree or None
    spark = store.nodes.sparkSession
    lines = spark.range(1, 2).select(
        F.col("id").alias("line_no"), F.lit(old).alias("old_name"), F.lit(new).alias("new_name"),
        F.lit(shot).cast("string").alias("shot"), F.lit(tree).cast("string").alias("tree"))
    subject = _scoped(store, level, old, new, shot, tree)
    labels = labels_of(subject, level)
    judged, diffs = judge(subject, candidates(labels, runnable(lines, level), level), level)
    if dry_run:
        return Rename(report(lines, judged, level), diffs, store)
    labels = relabel(labels, judged, level)
    return Rename(report(lines, judged, level), diffs, apply_labels(store, labels, level, [old]), labels)


def _scoped(store: Store, level: str, old: str, new: str, shot: str | None, tree: str | None) -> Store:
    """Only the content a rename can touch: literal filters that reach the scan."""
    condition = F.col(level).isin(old, new)
    if level != "shot" and shot is not None:
        condition = condition & (F.col("shot") == shot)
    if level == "signal" and tree is not None:
        condition = condition & (F.col("tree") == tree)
    return each_table(store, lambda rows: rows.where(condition))


def _named(store: Store, level: str, names: DataFrame) -> Store:
    """Content under the names of a mapping; other rows are left out before anything is shuffled for them."""
    touched = names.select(F.col("current").alias(level))
    return each_table(store, lambda rows: rows.join(touched, level, "left_semi").select(*rows.columns))


def mapping_of(lines: DataFrame) -> DataFrame:
    """Complete a mapping's columns; without shot / tree a line is not restricted."""
    return conform(lines, MAPPING)


def judge_chained(store: Store, labels: DataFrame, lines: DataFrame, links: DataFrame, level: str,
                  tied: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``judge`` for lines that depend on each other (``links``), as if one ran after the other.

    All pairs that can ever meet are compared in one go, then the verdicts follow. The
    number of jobs grows with the logarithm of the longest chain.
    """
    scope = SCOPES[level]
    unit = ["chain", "from_no", "to_no", *scope]
    groups = cut_lineage(chain_groups(labels, lines, links, scope, tied))
    pairs = cut_lineage(names_of_pairs(groups, possible_meetings(groups, scope), scope))
    if pairs.isEmpty():
        diffs = empty(store.nodes.sparkSession, ", ".join(
            ["chain bigint", "from_no int", "to_no int", *[f"{c} string" for c in scope], "path string", "difference string"]))
    else:
        old, new = (pairs.select(*unit, F.col(c).alias(level)) for c in ("origin", "new_origin"))
        diffs = cut_lineage(subtree_differences(store, store, old, new, unit, level))
    known = verdicts(pairs, diffs, unit)
    counts = known.select(*scope, "origin", "new_origin", "n_differences")
    acts = actual_meetings(groups, known.where("is_equal").select(*scope, "chain", "from_no", "to_no"), scope)
    met = [*scope, "origin", "new_origin"]
    judged = cut_lineage(acts.join(counts, met, "left").withColumns({
        "n_differences": F.coalesce("n_differences", F.lit(0).cast("bigint")),
        "verdict": F.when(F.col("new_origin").isNull(), RENAMED).when(F.col("moved"), DEDUPLICATED).otherwise(CONFLICT)}))
    between = diffs.join(pairs, unit).select(*met, "path", "difference")
    shown = judged.where(F.col("verdict") == CONFLICT).select("line_no", *met).join(between, met)
    return (judged.select("line_no", *scope, "old_name", "new_name", "origin", "verdict", "n_differences"),
            shown.select("line_no", *scope, "path", "difference"))


def rename_batch(store: Store, mapping: DataFrame, level: str = "tree", dry_run: bool = False) -> Rename:
    """Apply mapping lines as if in sequence.

    Lines that share no name cannot influence each other: a mapping without chains is a
    single pass. Chains are judged by ``judge_chained``. A dry run judges every line
    against the unchanged store.
    """
    lines = mapping_of(mapping)
    acting = runnable(lines, level)
    names = acting.select(F.explode(F.array("old_name", "new_name")).alias("current")).distinct()
    labels = labels_of(store, level).join(names, "current", "left_semi")
    content = _named(store, level, names)
    if dry_run:
        judged, diffs = judge(content, candidates(labels, acting, level), level)
        return Rename(report(lines, judged, level), diffs, store)
    labels, acting = cut_lineage(labels), cut_lineage(acting)
    # A tree line without a shot acts on all shots; then names tie across shots.
    tied = SCOPES[level]
    if level == "tree" and not acting.where(F.col("shot").isNull()).isEmpty():
        tied = []
    links = cut_lineage(ties(acting, tied))
    if links.isEmpty():
        judged, diffs = judge(content, candidates(labels, acting, level), level)
    else:
        judged, diffs = judge_chained(content, labels, acting, links, level, tied)
    labels = relabel(labels, judged, level)
    return Rename(report(lines, judged, level), diffs, apply_labels(store, labels, level), labels)


def touched_trees(store: Store, result: Rename, level: str) -> DataFrame:
    """Trees whose content a rename changed; ``store`` is the one it started from."""
    acted = result.verdicts.where(F.col("verdict").isin(RENAMED, DEDUPLICATED))
    if level == "tree":
        trees = acted.select(F.explode(F.array("old_name", "new_name")).alias("tree"))
    elif level == "signal":
        trees = acted.select("tree")
    else:
        moved = acted.select(F.col("old_name").alias("shot"))
        trees = store.at_level("tree").join(moved, "shot", "left_semi").select("tree")
    return trees.distinct()


def rename_stats(result: Rename) -> DataFrame:
    """One row: groups renamed or removed, and conflicts."""
    verdict = F.col("verdict")
    return result.verdicts.agg(
        F.count_if(verdict.isin(RENAMED, DEDUPLICATED)).alias("renamed"),
        F.count_if(verdict == CONFLICT).alias("conflicts"))
