"""Versioned Parquet folders of a store.

Every commit writes new folders and then one small manifest that lists the folders
of the version; a reader takes the newest manifest. Folders are never changed and every
attempt writes to folders of its own, so a job may read the version it replaces, a lost
job leaves only unlisted folders, and of two writers one commits and the other fails.

Rows lie in a bucket by their shot, leaves below it in one folder per tree. A change of
a few groups does not rewrite the folders they lie in: it adds rows under the new names and
a table of deleted keys. A deleted key hides its rows in all older commits; only folders of
buckets that have younger deleted keys are joined with them on reading. ``fold_deletes``
rewrites those buckets, ``compact_store`` the whole store. Leaves are stored with the digest
of their content (``functions.digests``).
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalvault.functions.digests import DIGEST, with_digests
from signalvault.model import ATTRS, GROUPS, KEY, NODES, PATHS, Store, bounded, conform, each_table, empty
from signalvault.operators.compare import SCOPES
from signalvault.operators.convert import to_float32
from signalvault.operators.merge import Merge, merge_stacked, stack
from signalvault.operators.rename import (
    DEDUPLICATED, RENAMED, Rename, mapping_of, rename, rename_batch, rename_stats,
)
from signalvault.session import cut_lineage
from signalvault.sources import files
from signalvault.sources.text import mapping_lines, read_lines

_SCHEMAS = {"nodes": NODES, "groups": GROUPS, "attrs": ATTRS, "paths": PATHS}
_DIGESTS = ", ".join(f"{c} bigint" for c in DIGEST)
_DELETES = "shot string, tree string, signal string, until int"
# The order inside a file. Folders that come out large are split among tasks, so even a shot holding a third of the rows is.
_CLUSTER = ["bucket", "tree", "shot", "signal", "node", "seg"]
BUCKETS = 8
"""Buckets of a new store. A folder of one tree and bucket should hold some gigabytes."""
FEW = 32
"""Names up to which a change is looked for by literals, which reach the scan."""


def bucket_column(buckets: int) -> Column:
    return (F.crc32(F.coalesce("shot", F.lit("")).cast("binary")) % buckets).cast("int")


def bucket_of(shot: str, buckets: int) -> int:
    return zlib.crc32(shot.encode()) % buckets


def versions(spark: SparkSession, root: str) -> list[int]:
    found = files.matching(spark, f"{root}/manifest-*.json")
    return [int(p.rsplit("-", 1)[1].removesuffix(".json")) for p in found]


def open_store(spark: SparkSession, root: str, shots: Iterable[str] | None = None) -> Store:
    """The newest version of a store that has to exist; with ``shots`` only the buckets these can lie in."""
    if not versions(spark, root):
        raise FileNotFoundError(f"no store at {root}")
    return read_store(spark, root, shots=shots)


def compact_store(spark: SparkSession, root: str) -> int:
    """Commit the content in few large files again, after many small appends."""
    return write_store(read_store(spark, root), root)


def _empty_manifest() -> dict:
    return {"buckets": BUCKETS, **{name: [] for name in _SCHEMAS}, "deletes": [], "made": {}}


def _manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    known = versions(spark, root)
    if not known:
        return 0, _empty_manifest()
    version = max(known) if version is None else version
    return version, _empty_manifest() | json.loads(files.read_small(spark, f"{root}/manifest-{version:06d}.json"))


def _commit_of(path: str) -> int:
    return int(re.search(r"/v=(\d+)-", path)[1])


def _bucket_of_path(path: str) -> int:
    return int(re.search(r"/bucket=(\d+)", path)[1])


def _hidden_below(path: str, deletes: list[dict]) -> bool:
    """Do some deleted keys concern the folder: its bucket, and a later commit?"""
    return any(d["version"] > _commit_of(path) and _bucket_of_path(path) in d["buckets"] for d in deletes)


def read_store(spark: SparkSession, root: str, version: int | None = None, shots: Iterable[str] | None = None) -> Store:
    """A version of the store, the newest unless told. Folders of other buckets than those of ``shots`` are not listed."""
    _, manifest = _manifest(spark, root, version)
    buckets = None if shots is None else {bucket_of(s, manifest["buckets"]) for s in shots}
    return Store(*[_table(spark, root, name, manifest, buckets) for name in _SCHEMAS])


def _table(spark: SparkSession, root: str, name: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
    schema = f"{NODES}, {_DIGESTS}" if name == "nodes" else _SCHEMAS[name]
    deletes = manifest["deletes"]
    paths = [p for p in manifest[name] if buckets is None or _bucket_of_path(p) in buckets]
    hidden = [p for p in paths if _hidden_below(p, deletes)]
    clean = [p for p in paths if p not in set(hidden)]
    found = []
    for some in (clean, hidden):
        if some:
            reader = spark.read.schema(f"{schema}, bucket int, v string").option("basePath", f"{root}/{name}")
            rows = reader.parquet(*[f"{root}/{p}" for p in _joined(some, manifest["made"])])
            if some is hidden:
                gone = spark.read.schema(_DELETES).parquet(*[f"{root}/{d['path']}" for d in deletes])
                gone = gone.groupBy(*KEY).agg(F.max("until").alias("until")).select(*[F.col(c).alias(f"gone_{c}") for c in KEY], "until")
                same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in KEY])
                since = F.split("v", "-")[0].cast("int")
                rows = rows.join(gone, same & (since < F.col("until")), "left_anti")
            found.append(conform(rows, schema))
    return reduce(DataFrame.unionByName, found) if found else empty(spark, schema)


def _joined(paths: list[str], made: dict[str, int]) -> list[str]:
    """Whole commit folders in place of their parts, where all parts that were ``made`` are wanted: less to list."""
    def by_commit(some: list[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for p in some:
            out.setdefault(p.split("/bucket=")[0], []).append(p)
        return out

    return [q for folder, parts in by_commit(paths).items() for q in ([folder] if len(parts) == made.get(folder) else parts)]


def _write(root: str, name: str, version: int, df: DataFrame, buckets: int = BUCKETS) -> list[str]:
    """Rows in folders of their own; returns these, one for each bucket (and tree, for leaves)."""
    spark = df.sparkSession
    folder = f"{name}/v={version}-{uuid.uuid4().hex}"
    rows = df.withColumn("bucket", bucket_column(buckets))
    if name == "nodes":
        rows = with_digests(bounded(conform(df, NODES))).withColumn("bucket", bucket_column(buckets))
        # rebalanced, not dealt by range: that would compute the rows twice, once for a sample
        (rows.hint("rebalance", F.col("bucket"), F.col("tree")).sortWithinPartitions(*_CLUSTER)
         .write.mode("errorifexists").partitionBy("bucket", "tree").parquet(f"{root}/{folder}"))
        found = files.matching(spark, f"{root}/{folder}/bucket=*/tree=*")
    else:
        rows.write.mode("errorifexists").partitionBy("bucket").parquet(f"{root}/{folder}")
        found = files.matching(spark, f"{root}/{folder}/bucket=*")
    return [f"{folder}/{p.split(f'{folder}/', 1)[1]}" for p in found]


def _commit(spark: SparkSession, root: str, version: int, manifest: dict) -> int:
    """Claim ``version``. ``made`` tells in how many parts each listed commit folder was written."""
    made = dict(manifest.get("made", {}))
    fresh = [p.split("/bucket=")[0] for name in _SCHEMAS for p in manifest.get(name, []) if _commit_of(p) == version]
    made.update({folder: fresh.count(folder) for folder in set(fresh)})
    files.write_new(spark, f"{root}/manifest-{version:06d}.json", json.dumps({**manifest, "made": made}, indent=1))
    return version


def _written(store: Store, root: str, version: int, buckets: int) -> dict[str, list[str]]:
    tables = {"nodes": store.nodes, "groups": store.groups, "attrs": store.attrs, "paths": store.paths}
    return {name: [] if rows is None else _write(root, name, version, rows, buckets) for name, rows in tables.items()}


def write_store(store: Store, root: str, buckets: int | None = None) -> int:
    """Commit the whole content as a new version, in ``buckets`` (as the store has them, or BUCKETS)."""
    spark = store.nodes.sparkSession
    version, manifest = _manifest(spark, root)
    buckets = manifest["buckets"] if buckets is None else buckets
    return _commit(spark, root, version + 1, {"buckets": buckets, "deletes": [], **_written(store, root, version + 1, buckets)})


def append_store(store: Store, root: str) -> int:
    """Commit the current version plus the rows it lacks; existing folders are not rewritten.

    A leaf segment, attribute or group that is there already stays as it is, so an
    append may be repeated, and one that adds nothing makes no version. Only keys of the
    shots in question are compared.
    """
    spark = store.nodes.sparkSession
    version, _ = _manifest(spark, root)
    known = read_store(spark, root)
    shots = cut_lineage(store.groups.select("shot").unionByName(store.nodes.select("shot")).distinct())

    def lacking(rows: DataFrame, there: DataFrame, columns: list[str]) -> DataFrame:
        old = there.join(shots, "shot", "left_semi").select(*columns).alias("k")
        new = rows.alias("n")
        return new.join(old, [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in columns], "left_anti")

    nodes = cut_lineage(lacking(bounded(conform(store.nodes, NODES)), known.nodes, ["shot", "tree", "signal", "node", "seg"]))
    attrs = cut_lineage(lacking(conform(store.attrs, ATTRS), known.attrs, ["shot", "tree", "signal", "node", "name"]))
    group = ["shot", "tree", "signal", "level"]
    groups = cut_lineage(lacking(store.groups.select(*group).distinct(), known.groups, group))
    paths = None if store.paths is None else cut_lineage(lacking(conform(store.paths, PATHS), known.paths, [*KEY, "path"]))
    if version and all(rows is None or rows.isEmpty() for rows in (nodes, attrs, groups, paths)):
        return version
    return _append(Store(nodes, groups, attrs, paths), root)


def _append(added: Store, root: str) -> int:
    spark = added.nodes.sparkSession
    version, manifest = _manifest(spark, root)
    new = _written(added, root, version + 1, manifest["buckets"])
    return _commit(spark, root, version + 1, manifest | {name: manifest[name] + new[name] for name in _SCHEMAS})


def replace_trees(store: Store, root: str, trees: list[str], new_groups: DataFrame | None = None) -> int:
    """Commit ``store`` as a new version, rewriting nodes of the named trees only.

    ``trees`` names every tree whose nodes changed, emptied ones included. Groups are
    rewritten too, unless ``new_groups`` says that only these came in addition. For
    changes of few groups ``commit_changes`` writes less.
    """
    spark = store.nodes.sparkSession
    version, manifest = _manifest(spark, root)
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    changed = {f"tree={escape(t)}" for t in trees}
    kept = [p for p in manifest["nodes"] if p.rsplit("/", 1)[1] not in changed]
    groups = store.groups if new_groups is None else new_groups
    new = _written(Store(store.nodes.where(F.col("tree").isin(*trees)), groups, store.attrs, store.paths), root, version + 1, manifest["buckets"])
    return _commit(spark, root, version + 1, manifest | {
        "nodes": kept + new["nodes"], "groups": new["groups"] if new_groups is None else manifest["groups"] + new["groups"],
        "attrs": new["attrs"], "paths": new["paths"]})


def commit_changes(root: str, deleted: DataFrame, added: Store) -> int:
    """Commit the current version without the groups ``deleted`` (the key; NULLs below the group's level) and with the
    rows ``added``, which may bear deleted keys anew.

    Each key stands for its own rows: with a tree, its signals are deleted by their keys. Nothing is rewritten. Folders
    whose signals are all gone leave the list; the others get the deleted keys beside them.
    """
    spark = added.nodes.sparkSession
    version, manifest = _manifest(spark, root)
    new, buckets = version + 1, manifest["buckets"]
    deleted = cut_lineage(deleted.select(*KEY).distinct())
    touched = sorted(r.bucket for r in deleted.select(bucket_column(buckets).alias("bucket")).distinct().collect())
    written = _written(added, root, new, buckets)
    listed = {name: manifest[name] for name in _SCHEMAS}
    deletes = manifest["deletes"]
    if touched:
        path = f"deletes/v={new}-{uuid.uuid4().hex}"
        deleted.withColumn("until", F.lit(new)).coalesce(1 + len(touched) // 8).write.mode("errorifexists").parquet(f"{root}/{path}")
        deletes = [*deletes, {"path": path, "version": new, "buckets": touched}]
        gone = _emptied(spark, root, manifest, deleted, set(touched))
        listed["nodes"] = [p for p in listed["nodes"] if tuple(p.rsplit("/", 2)[1:]) not in gone]
    return _commit(spark, root, new, manifest | {name: listed[name] + written[name] for name in _SCHEMAS} | {"deletes": deletes})


def _emptied(spark: SparkSession, root: str, manifest: dict, deleted: DataFrame, touched: set[int]) -> set[tuple[str, str]]:
    """Folders (bucket, tree) of which no signal is left, from the groups of the touched buckets."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    signals = _table(spark, root, "groups", manifest, touched).where(F.col("level") == "signal").select(*KEY)
    left = signals.join(deleted.where(F.col("signal").isNotNull()).withColumn("gone", F.lit(1)), KEY, "left") \
        .groupBy(bucket_column(manifest["buckets"]).alias("bucket"), "tree").agg(F.count_if(F.col("gone").isNull()).alias("n")).where("n = 0")
    return {(f"bucket={r.bucket}", f"tree={escape(r.tree)}") for r in left.collect()}


def fold_deletes(spark: SparkSession, root: str) -> int:
    """Rewrite the folders that have deleted keys, and only those; the new version has none."""
    version, manifest = _manifest(spark, root)
    if not manifest["deletes"]:
        return version
    listed = {}
    for name in _SCHEMAS:
        hidden = [p for p in manifest[name] if _hidden_below(p, manifest["deletes"])]
        rows = _table(spark, root, name, manifest | {name: hidden})
        listed[name] = [p for p in manifest[name] if p not in set(hidden)] + (_write(root, name, version + 1, rows, manifest["buckets"]) if hidden else [])
    return _commit(spark, root, version + 1, manifest | listed | {"deletes": []})


def merge_into(root: str, sources: Store, n_sources: int, strategy: str = "skip") -> Merge:
    """Merge stacked sources into the store at ``root`` and commit the result.

    Existing folders stay as they are: ``skip`` and ``error`` only add, the other strategies
    add as well and delete the keys of the signals that they replace.
    """
    spark = sources.nodes.sparkSession
    merged = merge_stacked(read_store(spark, root), sources, n_sources, strategy)
    if merged.replaced is None:
        _append(merged.added, root)
    else:
        again = merged.replaced.select(*KEY, F.lit("signal").alias("level"))
        added = merged.added
        commit_changes(root, merged.replaced, Store(added.nodes, added.groups.unionByName(conform(again, GROUPS)), added.attrs, added.paths))
    return merged


def merge_paths(spark: SparkSession, root: str, paths: list[str], strategy: str = "skip"
                ) -> tuple[Merge | None, list[tuple[int, str, str]]]:
    """Merge the stores at ``paths``, in order, into the one at ``root``.

    Missing sources, the target itself and sources that cannot be opened, or turn out
    to be damaged while they are merged, are left out and returned with the reason; the
    others are merged. A merge that fails commits nothing.
    """
    good, skipped = files.usable_sources(spark, root, paths)
    opened = []
    for ordinal, path in good:
        try:
            opened.append((ordinal, path, open_store(spark, path)))
        except Exception as problem:  # noqa: BLE001 - whatever makes a source unreadable
            skipped.append((ordinal, path, str(problem).splitlines()[0]))
    while opened:
        try:
            merged = merge_into(root, stack([source for _, _, source in opened]), len(opened), strategy)
            return merged, sorted(skipped)
        except Exception:  # noqa: BLE001 - sources that cannot be read through are looked for
            damaged = [(ordinal, path, problem) for ordinal, path, source in opened if (problem := _damage(source))]
            if not damaged:
                raise
            skipped += damaged
            opened = [x for x in opened if x[0] not in {ordinal for ordinal, _, _ in damaged}]
    return None, sorted(skipped)


def _damage(store: Store) -> str | None:
    """Why a store cannot be read through, if it cannot."""
    try:
        for rows in (store.nodes, store.groups, store.attrs):
            rows.write.format("noop").mode("overwrite").save()
    except Exception as problem:  # noqa: BLE001 - whatever makes a source unreadable
        return str(problem).splitlines()[0]
    return None


def rename_in(spark: SparkSession, root: str, old: str, new: str, level: str = "tree",
              shot: str | None = None, tree: str | None = None, dry_run: bool = False) -> Rename:
    """Rename in the store at ``root`` and commit. With a shot named, only its bucket is read."""
    shots = [old, new] if level == "shot" else [shot] if shot else None
    before = open_store(spark, root, shots)
    result = rename(before, old, new, level, shot, tree, dry_run)
    if not dry_run:
        commit_rename(before, result, root, level)
    return result


def rename_file_in(spark: SparkSession, root: str, mapping: str, level: str = "tree", dry_run: bool = False
                   ) -> tuple[Rename, DataFrame, DataFrame]:
    """Apply a mapping file to the store at ``root`` and commit.

    Returns the renames, the lines of the file that are no mapping (line_no, line,
    n_tokens) and the totals (``rename_stats``).
    """
    good, bad = mapping_lines(read_lines(spark, mapping, any_end=True))
    before = open_store(spark, root)
    result = rename_batch(before, mapping_of(good.drop("source")), level, dry_run)
    if not dry_run:
        commit_rename(before, result, root, level)
    return result, bad.drop("source"), rename_stats(result)


def convert_in(spark: SparkSession, root: str) -> int:
    """Commit the store at ``root`` with its float64 leaves as float32."""
    store = open_store(spark, root)
    return write_store(Store(conform(to_float32(store.nodes), NODES), store.groups, store.attrs, store.paths), root)


def scan_store(store: Store) -> DataFrame:
    """Signals in name order with the number of their leaves and of the values in them."""
    return store.nodes.where(F.col("signal").isNotNull()).groupBy(*KEY).agg(
        F.count_distinct("node").alias("n_nodes"),
        F.sum(F.when(F.col("seg") == 0, F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, n: a * n))).alias("n_values")
    ).orderBy(*KEY)


def moves(before: Store, labels: DataFrame, level: str) -> tuple[DataFrame, Store]:
    """What a rename changes: the keys that go, and the rows that come under their new names."""
    on = [*SCOPES[level], level]
    changed = cut_lineage(labels.where(~F.col("current").eqNullSafe(F.col("origin"))).select(
        *SCOPES[level], F.col("origin").alias(level), F.col("current").alias("to")))
    few = changed.select(level).distinct().limit(FEW + 1).collect()
    if len(few) <= FEW:
        names = [r[0] for r in few]
        before = each_table(before, lambda rows: rows.where(F.col(level).isin(*names)))
    moved = changed.where(F.col("to").isNotNull())

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.join(moved, on).select(*[F.col("to").alias(c) if c == level else F.col(c) for c in rows.columns])

    return before.groups.join(changed, on, "left_semi").select(*KEY), each_table(before, renamed)


def commit_rename(before: Store, result: Rename, root: str, level: str) -> None:
    """Commit what a rename changed; a conflict or an unknown name makes no version."""
    if result.verdicts.where(F.col("verdict").isin(RENAMED, DEDUPLICATED)).isEmpty():
        return
    commit_changes(root, *moves(before, result.labels, level))
