"""Deleted keys, buckets, digests and groups below signals."""

import random

import pytest

from helpers import attr, keys_of, node, store
from signalvault.functions.digests import has_digests, merkle
from signalvault.model import KEY, PATHS, Store, nested_paths, paths_of_leaves
from signalvault.operators import compare as cmp
from signalvault.operators.merge import merge, stack
from signalvault.operators.rename import rename
from signalvault.sources import store as st


def content(s):
    return sorted((r.shot, r.tree, r.signal, r.node, str(r.f64)) for r in s.nodes.collect()), sorted(map(str, s.groups.collect())), \
        sorted((str(r.shot), str(r.tree), str(r.signal), r.name) for r in s.attrs.collect()), sorted(map(str, s.nested.collect()))


def some_store(spark, seed, shots="123456"):
    r = random.Random(seed)
    nodes = [node(s, t, x, f"in/{n}", [float(r.randrange(3))]) for s in shots for t in "ab" for x in "pq" for n in "uv" if r.random() < .8]
    attrs = [attr(s, "a", None, "unit", "V") for s in shots] + [attr(s, None, None, "run", 1) for s in shots] + [attr("1", "a", "p", "gain", 2.0)]
    plain = store(spark, nodes, attrs, [f"{s}/a" for s in shots])
    return Store(plain.nodes, plain.groups, plain.attrs, paths_of_leaves(plain.nodes))


def test_paths_of_any_depth(spark):
    rows = spark.createDataFrame([("1", "t", "x", "a/b/c"), ("1", "t", "x", "a/d"), ("1", "t", "y", "")], "shot string, tree string, signal string, of string")
    found = nested_paths(rows, "of")
    assert found.columns == [f.split()[0] for f in PATHS.split(", ")]
    assert sorted((r.path, r.parent, r.depth) for r in found.collect()) == [("a", "", 1), ("a/b", "a", 2), ("a/b/c", "a/b", 3), ("a/d", "a", 2)]
    leaves = store(spark, [node("1", "t", "x", "data", 1), node("1", "t", "x", "a/b/z", 1)]).nodes
    assert {r.path for r in paths_of_leaves(leaves).collect()} == {"a", "a/b"}


@pytest.mark.parametrize("level, old, new", [("shot", "1", "9"), ("tree", "a", "b")])
def test_a_committed_rename_equals_one_in_memory(spark, folder, level, old, new):
    first = some_store(spark, 1)
    st.write_store(first, folder, buckets=3)
    scope = {"shot": "2", "tree": "a"} if level == "signal" else {}
    want = rename(st.read_store(spark, folder), old, new, level, **scope).store
    want = content(want)
    st.rename_in(spark, folder, old, new, level, **scope)
    assert content(st.read_store(spark, folder)) == want
    version = st.fold_deletes(spark, folder)
    assert content(st.read_store(spark, folder)) == want and not st._manifest(spark, folder, version)[1]["deletes"]


def test_a_change_writes_only_the_buckets_it_touches(spark, folder):
    first = some_store(spark, 2, [str(i) for i in range(40)])
    st.write_store(first, folder, buckets=16)
    before = st._manifest(spark, folder)[1]
    st.rename_in(spark, folder, "p", "P", "signal", shot="7", tree="a")
    after = st._manifest(spark, folder)[1]
    mine = st.bucket_of("7", 16)
    for name in ("nodes", "groups", "attrs", "paths"):
        assert set(before[name]) <= set(after[name])
        assert {st._bucket_of_path(p) for p in set(after[name]) - set(before[name])} <= {mine}
    assert [d["buckets"] for d in after["deletes"]] == [[mine]]
    clean = [p for p in after["nodes"] if not st._hidden_below(p, after["deletes"])]
    assert {st._bucket_of_path(p) for p in clean} == set(range(16)) & {st._bucket_of_path(p) for p in after["nodes"]}
    assert all(st._bucket_of_path(p) != mine or st._commit_of(p) == 2 for p in clean)
    st.fold_deletes(spark, folder)
    folded = st._manifest(spark, folder)[1]
    assert {st._bucket_of_path(p) for p in set(folded["nodes"]) - set(before["nodes"])} == {mine}
    assert ("7", "a", "P") in keys_of(st.read_store(spark, folder)) and ("7", "a", "p") not in keys_of(st.read_store(spark, folder))


def test_names_that_return_and_emptied_folders(spark, folder):
    st.write_store(store(spark, [node("1", "a", "x", "data", [1.0]), node("1", "b", "y", "data", [2.0])]), folder)
    for old, new in (("a", "c"), ("c", "a")):
        st.rename_in(spark, folder, old, new)
        now = st.read_store(spark, folder)
        assert {(r.tree, r.signal) for r in now.nodes.collect()} == {(new, "x"), ("b", "y")}
    assert len(st._manifest(spark, folder)[1]["nodes"]) == 2    # emptied folders are not listed any more


def test_overwrite_on_disk_equals_memory(spark, folder):
    target, sources = some_store(spark, 3), [some_store(spark, 4, "1278"), some_store(spark, 5, "29")]
    st.write_store(target, folder)
    want = content(merge(target, sources, "overwrite").store)
    st.merge_into(folder, stack(sources), 2, "overwrite")
    got = content(st.read_store(spark, folder))
    assert got == want
    st.fold_deletes(spark, folder)
    assert content(st.read_store(spark, folder)) == want


def test_digests_find_what_differs_and_read_no_arrays(spark, folder, monkeypatch):
    same = some_store(spark, 6)
    other = Store(*[t for t in (same.nodes, same.groups, same.attrs)], same.paths)
    st.write_store(same, f"{folder}/a", buckets=2)
    st.write_store(other, f"{folder}/b", buckets=5)
    first, second = st.read_store(spark, f"{folder}/a"), st.read_store(spark, f"{folder}/b")
    assert has_digests(first.nodes)
    plan = merkle(first, "shot")._jdf.queryExecution().executedPlan().toString()
    assert "array<double>" not in plan.split("attrs")[0].split("Location")[0] and "i64:array" not in plan.split("Scan parquet")[1]

    def unread(*_):
        raise AssertionError("content was compared")

    with monkeypatch.context() as m:
        m.setattr(cmp, "differences", unread)
        for level in ("shot", "tree", "signal"):
            verdicts, _ = cmp.compare_stores(first, second, level)
            assert {r.is_equal for r in verdicts.collect()} == {True}
    st.rename_in(spark, f"{folder}/b", "p", "Q", "signal", shot="3", tree="a")
    second = st.read_store(spark, f"{folder}/b")
    verdicts, diffs = cmp.compare_stores(first, second, "tree")
    assert {(r.shot, r.tree) for r in verdicts.where("not is_equal").collect()} == {("3", "a")}
    plain = cmp.compare_stores(Store(first.nodes.drop("h1", "h2"), first.groups, first.attrs, first.paths), second, "tree")[1]
    assert sorted(map(str, diffs.collect())) == sorted(map(str, plain.select(*diffs.columns).collect()))


def test_an_attribute_of_nan_differs_from_itself(spark, folder):
    st.write_store(store(spark, [node("1", "t", "a", "x", [float("nan")]), node("1", "t", "b", "x", [float("nan")])],
                         [attr("1", "t", "b", "gain", float("nan"))]), folder)
    s = st.read_store(spark, folder)
    assert {r.signal: r.is_equal for r in cmp.compare_stores(s, s, "signal")[0].collect()} == {"a": True, "b": False}


def test_a_differing_empty_group_far_below_is_seen(spark):
    s = store(spark, [node("1", t, "x", "g/h/data", [1.0]) for t in ("old", "new", "twin")])
    more = spark.createDataFrame([("1", "old", "x", "g/h/none"), ("1", "new", "x", "g/h")], "shot string, tree string, signal string, of string")
    s = Store(s.nodes, s.groups, s.attrs, nested_paths(more, "of").unionByName(nested_paths(s.nodes.where("tree = 'twin'").selectExpr(*KEY, "'g/h' of"), "of")))
    found = rename(s, "old", "new")
    assert [r.verdict for r in found.verdicts.collect()] == ["conflict"]
    assert [(r.path, r.difference) for r in found.differences.collect()] == [("x/g/h/none", "Only in first")]
    assert [r.verdict for r in rename(s, "new", "twin").verdicts.collect()] == ["deduplicated"]
