import pytest

from helpers import attr, keys_of, node, store
from signalvault.operators.rename import candidates, labels_of, mapping_of, rename_batch
from signalvault.sources import files
from signalvault.sources import store as st
from signalvault.sources.store import append_store, read_store, rename_in, versions, write_store


def test_merge_paths(spark, folder):
    put = lambda name, *nodes: st.write_store(store(spark, nodes), f"{folder}/{name}")
    put("t", node("1", "a", "x", "data", 1), node("1", "keep", "x", "data", 1))
    put("s1", node("1", "a", "x", "data", 2), node("1", "b", "y", "data", 2))
    put("s2", node("1", "a", "x", "data", 3))
    with open(f"{folder}/junk", "w") as f:
        f.write("not a store")
    paths = [f"{folder}/{n}" for n in ("s1", "gone", "t", "junk", "s2")]
    merged, skipped = st.merge_paths(spark, f"{folder}/t", paths, "overwrite")
    assert tuple(merged.stats.first()) == (2, 1, 3, 0, 2)
    assert [(i, why.split(":")[0]) for i, _, why in skipped] == [
        (2, "missing"), (3, "same as target"), (4, "no store at " + f"{folder}/junk")]
    now = {(r.tree, r.signal): r.i64[0] for r in st.read_store(spark, f"{folder}/t").nodes.collect()}
    assert now == {("a", "x"): 3, ("b", "y"): 2, ("keep", "x"): 1}
    _, manifest = st._manifest(spark, f"{folder}/t")
    first = {p.rsplit("=", 1)[1] for p in manifest["nodes"] if p.startswith("nodes/v=1-")}
    assert first == {"keep"}
    with pytest.raises(FileNotFoundError):
        st.merge_paths(spark, f"{folder}/gone", paths)


def test_rename_in_place(spark, folder):
    root = f"{folder}/t"
    st.write_store(store(spark, [node("1", "a", "x", "data", 1), node("2", "c", "x", "data", 1)],
                         extra_groups=["3"]), root)
    st.rename_in(spark, root, "a", "b", dry_run=True)
    assert st.versions(spark, root) == [1]
    st.rename_in(spark, root, "a", "b")
    assert keys_of(st.read_store(spark, root)) == {("1", "b", "x"), ("2", "c", "x")}
    assert {(r.shot, r.tree) for r in st.read_store(spark, root).nodes.collect()} == {("1", "b"), ("2", "c")}
    st.rename_in(spark, root, "1", "9", level="shot")
    st.rename_in(spark, root, "3", "4", level="shot")           # a shot without trees
    st.rename_in(spark, root, "x", "z", level="signal", shot="2", tree="c")
    before = st.read_store(spark, root)
    assert {(r.shot, r.tree, r.signal) for r in before.nodes.collect()} == {("9", "b", "x"), ("2", "c", "z")}
    assert {r.shot for r in before.at_level("shot").collect()} == {"9", "2", "4"}
    mapping = mapping_of(spark.createDataFrame([(1, "b", "m"), (2, "m", "n")], "line_no bigint, old_name string, new_name string"))
    st.commit_rename(before, rename_batch(before, mapping), root, "tree")
    st.compact_store(spark, root)
    assert {(r.shot, r.tree) for r in st.read_store(spark, root).nodes.collect()} == {("9", "n"), ("2", "c")}


def test_of_two_writers_one_commits_and_its_rows_stay(spark, folder, monkeypatch):
    write_store(store(spark, [node("1", "t", "a", "x", 1.0)]), folder)
    inner, done = files.write_new, []

    def overtaken(spark_, path, text):
        if not done:
            done.append(1)
            append_store(store(spark, [node("2", "t", "a", "x", 2.0)]), folder)
        inner(spark_, path, text)

    monkeypatch.setattr(files, "write_new", overtaken)
    with pytest.raises(FileExistsError):
        append_store(store(spark, [node("3", "t", "a", "x", 3.0)]), folder)
    assert sorted(r.shot for r in read_store(spark, folder).nodes.collect()) == ["1", "2"]
    assert versions(spark, folder) == [1, 2] and not files.matching(spark, f"{folder}/*.draft")


def test_a_repeated_append_adds_nothing(spark, folder):
    more = store(spark, [node("1", "t", "a", "x", 1.0), node("1", "t", "a", "y", [1.0, 2.0])], [attr("1", "t", "a", "unit", "V")])
    write_store(store(spark, [node("0", "t", "a", "x", 1.0)]), folder)
    assert append_store(more, folder) == 2 and append_store(more, folder) == 2
    got = read_store(spark, folder)
    assert got.nodes.count() == 3 and got.attrs.count() == 1 and versions(spark, folder) == [1, 2]


def test_a_rename_that_changes_nothing_makes_no_version(spark, folder):
    write_store(store(spark, [node("1", "t", "a", "x", 1.0), node("2", "t", "a", "x", 2.0)]), folder)
    rename_in(spark, folder, "1", "2", level="shot")
    rename_in(spark, folder, "9", "8", level="shot")
    assert versions(spark, folder) == [1]
    rename_in(spark, folder, "1", "3", level="shot")
    assert versions(spark, folder) == [1, 2]


def test_lines_with_a_shot_meet_its_groups_by_shot_and_name(spark):
    s = store(spark, [node(str(i), "d3d", "a", "x", 1.0) for i in range(50)])
    lines = mapping_of(spark.createDataFrame([(i, "d3d", "D3D", str(i)) for i in range(50)], "line_no long, old_name string, new_name string, shot string"))
    found = candidates(labels_of(s, "tree"), lines, "tree")
    assert found.count() == 50
    assert sorted({r.verdict for r in rename_batch(s, lines).verdicts.collect()}) == ["renamed"]
