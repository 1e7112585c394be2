import random

import pytest
from pyspark.sql import functions as F

from helpers import attr, keys_of, node, store
from signalvault.operators.merge import before, find_bounds, merge
from signalvault.sources import store as st


def model(target, sources, strategy):
    """Nested loops over shots, trees and signals in name order, on plain dictionaries.

    A store is {shot: {tree: {signal: value}}}.
    """
    out = {s: {t: dict(sig) for t, sig in trees.items()} for s, trees in target.items()}
    count = dict(files=0, trees=0, added=0, skipped=0, over=0)
    for source in sources:
        failed = False
        for shot in sorted(source):
            out.setdefault(shot, {})
            for tree in sorted(source[shot]):
                if tree not in out[shot]:
                    out[shot][tree] = {}
                    count["trees"] += 1
                for signal in sorted(source[shot][tree]):
                    there = signal in out[shot][tree]
                    if there and strategy == "error":
                        failed = True
                        break
                    if there and strategy == "skip":
                        count["skipped"] += 1
                        continue
                    out[shot][tree][signal] = source[shot][tree][signal]
                    count["over"] += there
                    count["added"] += not there or strategy == "overwrite"
                if failed:
                    break
            if failed:
                break
        count["files"] += not failed
    return out, tuple(count.values())


def random_store(rng, tag):
    out = {}
    for shot in rng.sample(["1", "10", "2"], rng.randint(1, 3)):
        out[shot] = {}
        for tree in rng.sample(["a", "a!", "b"], rng.randint(0, 3)):
            out[shot][tree] = {sig: tag for sig in rng.sample(["x", "y", "z"], rng.randint(0, 3))}
    return out


def to_store(spark, tree, many):
    """All stores of one test side by side: ``case`` prefixes the shot, order is kept."""
    nodes, groups = [], []
    for case, content in tree.items():
        for shot, trees in content.items():
            groups.append(f"{case}|{shot}")
            for t, signals in trees.items():
                groups.append(f"{case}|{shot}/{t}")
                nodes += [node(f"{case}|{shot}", t, s, "data", v) for s, v in signals.items()]
    return store(spark, nodes, extra_groups=groups)


def content_of(s):
    out = {}
    for r in s.groups.collect():
        shot = out.setdefault(r.shot, {})
        if r.tree is not None:
            tree = shot.setdefault(r.tree, {})
            if r.signal is not None:
                tree[r.signal] = None
    for r in s.nodes.collect():
        out[r.shot][r.tree][r.signal] = r.i64[0]
    return out


@pytest.mark.parametrize("strategy", ["skip", "overwrite", "upsert"])
def test_merge_equals_nested_loops(spark, strategy):
    """Many random cases in one merge; the counters are sums over the cases."""
    rng = random.Random(strategy)
    cases = range(60)
    stores = [{c: random_store(rng, tag) for c in cases} for tag in range(4)]
    target, *sources = [to_store(spark, s, True) for s in stores]
    result = merge(target, sources, strategy)
    expected, counts = {}, [0] * 5
    for c in cases:
        out, n = model(stores[0][c], [s[c] for s in stores[1:]], strategy)
        expected.update({f"{c}|{shot}": trees for shot, trees in out.items()})
        counts = [a + b for a, b in zip(counts, n)]
    counts[0] = 3
    assert content_of(result.store) == expected
    assert list(result.stats.first()) == counts


@pytest.mark.parametrize("seed", range(4))
def test_merge_error_equals_nested_loops(spark, seed):
    """A failing source stops as a whole, so each case is a merge of its own."""
    rng = random.Random(seed)
    stores = [{0: random_store(rng, tag)} for tag in range(3)]
    if seed == 3:
        stores.append({0: {"only": {"here": {"s": 3}}}})
    target, *sources = [to_store(spark, s, False) for s in stores]
    result = merge(target, sources, "error")
    out, counts = model(stores[0][0], [s[0] for s in stores[1:]], "error")
    assert content_of(result.store) == {f"0|{shot}": trees for shot, trees in out.items()}
    assert tuple(result.stats.first()) == counts


def step_by_step(held, n_sources):
    """Bounds by inserting one source after the other; ``held`` is {holder: set of keys}."""
    target, bounds = set(held.get(0, ())), []
    for i in range(1, n_sources + 1):
        own = sorted(held.get(i, ()))
        bound = next((k for k in own if k in target), None)
        target |= {k for k in own if bound is None or k < bound}
        bounds.append(bound)
    return bounds


@pytest.mark.parametrize("seed", range(6))
def test_error_bounds_of_many_sources(spark, seed):
    rng = random.Random(seed)
    names = [("1", "a", "x"), ("1", "a", "y"), ("1", "a!", "a"), ("1", "b", "x"), ("10", "a", "x"), ("2", "a", "x"), ("2", "c", "z")]
    pool = [(s, t, f"{g}{i}") for s, t, g in names for i in range(4)]
    n = rng.choice([1, 3, 12])
    held = {i: set(rng.sample(pool, rng.randint(0, 5 if i else 2))) for i in range(n + 1)}
    rows = [(i, *k) for i, ks in held.items() for k in ks] * 2
    keys = spark.createDataFrame(rows, "src int, shot string, tree string, signal string")
    assert find_bounds(keys, n) == step_by_step(held, n)


def test_error_bounds_take_one_query(spark, folder):
    """The number of jobs does not grow with the sources."""
    def jobs(n):
        keys = spark.range(40 * n).select((F.col("id") % (n + 1)).cast("int").alias("src"), F.lit("1").alias("shot"),
                                          F.lit("a").alias("tree"), (F.col("id") % 37).cast("string").alias("signal"))
        spark.sparkContext.setJobGroup(f"bounds{n}", "")
        assert len(find_bounds(keys, n)) == n
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bounds{n}"))

    assert jobs(40) <= jobs(2)


def test_attributes_follow_their_signal(spark):
    target = store(spark, [node("1", "a", "x", "data", 1)],
                   [attr("1", "a", None, "t", "target"), attr("1", "a", "x", "u", "old")])
    source = store(spark, [node("1", "a", "x", "data", 2), node("1", "b", "y", "data", 3)],
                   [attr("1", "a", None, "t", "source"), attr("1", "b", None, "t", "source"),
                    attr("1", "a", "x", "u", "new"), attr("1", "b", "y", "u", "new")])
    get = lambda s: {(r.tree, r.signal, r.str[0]) for r in s.attrs.collect()}
    assert get(merge(target, [source]).store) == {("a", None, "target"), ("a", "x", "old"), ("b", "y", "new")}
    assert get(merge(target, [source], "overwrite").store) == {
        ("a", None, "target"), ("a", "x", "new"), ("b", "y", "new")}


def test_before_compares_by_column(spark):
    rows = spark.createDataFrame([("a", "b", "c"), ("a!", "a", "a"), ("a", "b", "d"), ("a", "a", "z")],
                                 "shot string, tree string, signal string")
    got = {tuple(r) for r in rows.where(before(("a", "b", "d"))).collect()}
    assert got == {("a", "b", "c"), ("a", "a", "z")}


def test_unknown_strategy(spark):
    s = store(spark, [node("1", "a", "x", "data", 1)])
    with pytest.raises(ValueError):
        merge(s, [s], "newest")


def test_versions_on_disk(spark, folder):
    root = f"{folder}/s"
    first = store(spark, [node("007", "t1", "x", "data", 1), node("007", "a:b", "x", "data", 1)],
                  extra_groups=["8", "9/empty"])
    assert st.write_store(first, root) == 1
    more = store(spark, [node("10", "t1", "y", "data", 2)])
    assert st.append_store(more, root) == 2
    now = st.read_store(spark, root)
    assert keys_of(now) == {("007", "t1", "x"), ("007", "a:b", "x"), ("10", "t1", "y")}
    assert {r.shot for r in now.at_level("shot").collect()} == {"007", "8", "9", "10"}
    assert {(r.shot, r.tree) for r in now.nodes.collect()} == {("007", "t1"), ("007", "a:b"), ("10", "t1")}
    assert now.groups.count() == now.groups.distinct().count()
    changed = st.read_store(spark, root)
    moved = changed.nodes.withColumn("tree", F.when(F.col("tree") == "a:b", "c").otherwise(F.col("tree")))
    assert st.replace_trees(type(now)(moved, changed.groups, changed.attrs), root, ["a:b", "c"]) == 3
    assert {(r.shot, r.tree) for r in st.read_store(spark, root).nodes.collect()} == {
        ("007", "t1"), ("007", "c"), ("10", "t1")}
    assert {r.tree for r in st.read_store(spark, root, 1).nodes.collect()} == {"t1", "a:b"}
    with pytest.raises(FileExistsError):
        st._commit(spark, root, 3, {})


def test_missing_store_is_empty(spark, folder):
    assert st.read_store(spark, f"{folder}/none").nodes.count() == 0
