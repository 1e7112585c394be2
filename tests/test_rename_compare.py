import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import NODE_COLUMNS, attr, keys_of, node, store
from signalvault.functions.values import is_close
from signalvault.operators.compare import first_differences, leaf_differences, recut
from signalvault.model import Store, split_segments
from signalvault.operators.rename import mapping_of, rename, rename_batch, rename_stats
from signalvault.session import cut_lineage

NAN, INF = math.nan, math.inf


def verdicts_of(result):
    return {(r.shot, r.old_name, r.new_name): r.verdict for r in result.verdicts.collect()}


def test_is_close_agrees_with_numpy(spark):
    values = [0.0, -0.0, 1.0, 1.0 + 5e-10, 1.0 + 3e-9, 1e-10, 2e-9, -1.0, 1e300, 1.0000000005e300,
              INF, -INF, NAN]
    pairs = [(a, b) for a in values for b in values]
    rows = spark.createDataFrame(pairs, "a double, b double").select(
        "a", "b", is_close(F.col("a"), F.col("b")).alias("ok")).collect()
    for r in rows:
        assert r.ok == bool(np.isclose(r.a, r.b, rtol=1e-9, atol=1e-9, equal_nan=True)), (r.a, r.b)


# old value, new value, equal?
PAIRS = [
    ([1.0, NAN], [1.0, NAN], True),
    ([1.0, NAN], [NAN, 1.0], False),
    ([1.0, 2.0], [1.0, NAN], False),
    ([INF, -INF], [INF, -INF], True),
    ([INF], [-INF], False),
    ([1.0], [INF], False),
    ([1.0], [1.0 + 5e-10], True),
    ([1.0], [1.0 + 5e-9], False),
    ([1e12], [1e12 + 500.0], True),
    ([1e12], [1e12 + 5000.0], False),
    (1.0, [1.0], False),
    ([1.0, 2.0], [1.0], False),
    ([], [], True),
    (NAN, NAN, True),
    (NAN, 1.0, False),
    (2.5, 2.5 + 1e-12, True),
    ([1, 2], [1, 2], True),
    ([1, 2], [1, 3], False),
    ([1, 2], [1.0, 2.0], True),
    ([1, 2], [1.0, 2.0 + 1e-12], False),
    ([1.0, 2.0], [1, 2], True),
    (3, 3, True),
    (b"abc", b"abc", True),
    (b"abc", b"abd", False),
    (["x", "y"], ["x", "y"], True),
    (["x"], ["y"], False),
    (["1"], [1], False),
    ([True, False], [True, False], True),
]


def test_value_matrix(spark):
    nodes = []
    for i, (a, b, _) in enumerate(PAIRS):
        nodes += [node(f"s{i}", "old", "sig", "data", a), node(f"s{i}", "new", "sig", "data", b)]
    got = verdicts_of(rename(store(spark, nodes), "old", "new"))
    for i, (a, b, equal) in enumerate(PAIRS):
        assert got[(f"s{i}", "old", "new")] == ("deduplicated" if equal else "conflict"), (a, b)


def test_matrix_shape_and_float32(spark):
    nodes = [node("1", "old", "s", "data", [1.0, 2.0, 3.0, 4.0], shape=[2, 2]),
             node("1", "new", "s", "data", [1.0, 2.0, 3.0, 4.0], shape=[4]),
             node("2", "old", "s", "data", [1.5, 2.0], kind="f32"),
             node("2", "new", "s", "data", [1.5, 2.0])]
    got = verdicts_of(rename(store(spark, nodes), "old", "new"))
    assert got[("1", "old", "new")] == "conflict"
    assert got[("2", "old", "new")] == "deduplicated"


ATTR_PAIRS = [
    ("m", "m", True), ("m", "s", False), (1.0, 1.0, True), (1.0, 1.0 + 1e-12, False), (NAN, NAN, False),
    (1, 1.0, True), (b"m", "m", True), (b"\xff", "m", False), ([1, 2], [1, 2], True),
    ([1, 2], [1, 3], False), ([1.0, NAN], [1.0, NAN], False), ([1], 1, False), ("1", 1, False),
    (None, "m", False), ("m", None, False),
]


@pytest.mark.parametrize("place", ["tree", "signal", "node"])
def test_attributes(spark, place):
    nodes, attrs = [], []
    for i, (a, b, _) in enumerate(ATTR_PAIRS):
        for tree, value in (("old", a), ("new", b)):
            nodes.append(node(str(i), tree, "sig", "data", [1.0]))
            if value is not None:
                signal = None if place == "tree" else "sig"
                attrs.append(attr(str(i), tree, signal, "u", value, on="data" if place == "node" else None))
    got = verdicts_of(rename(store(spark, nodes, attrs), "old", "new"))
    for i, (a, b, equal) in enumerate(ATTR_PAIRS):
        assert got[(str(i), "old", "new")] == ("deduplicated" if equal else "conflict"), (a, b)


def test_structure_differences(spark):
    nodes = [node("1", "old", "a", "data", [1.0]), node("1", "old", "a", "dim0", [1.0]),
             node("1", "new", "a", "data", [1.0]),
             node("2", "old", "a", "data", [1.0]), node("2", "new", "a", "data/deep", [1.0]),
             node("3", "old", "a", "data", [1.0]), node("3", "new", "a", "data", [1.0])]
    result = rename(store(spark, nodes, extra_groups=["3/new/b", "4/old", "4/new"]), "old", "new")
    got = verdicts_of(result)
    assert [got[(s, "old", "new")] for s in "1234"] == ["conflict"] * 3 + ["deduplicated"]
    texts = {(r.shot, r.path, r.difference) for r in result.differences.collect()}
    assert ("1", "a/dim0", "Only in first") in texts
    assert ("3", "b", "Only in second") in texts


def cut_leaves(spark, leaves, size):
    """(name, values) as leaves of one unit in segments of ``size`` values."""
    rows = spark.createDataFrame([node("1", "t", k, "data", v) for k, v in leaves.items()], NODE_COLUMNS)
    out = rows.where("kind <> 'str'")
    out = split_segments(out, "f64", size).unionByName(split_segments(rows.where("kind = 'str'"), "str", size))
    return out.withColumn("path", F.concat_ws("/", "signal", "node"))


def test_differently_cut_leaves(spark):
    nan = math.nan
    long = [float(i) for i in range(23)]
    first = {"same": long, "near": long, "off": long, "nan": [*long[:20], nan, *long[21:]], "short": long, "empty": [], "gone": long,
             "text": list("abcdefghijk"), "words": list("abcdefghijk"), "tail": [*long[:22], nan]}
    second = {"same": long, "near": [x * (1 + 1e-12) for x in long], "off": [*long[:22], 7.0], "nan": long, "short": long[:17], "empty": [],
              "come": [1.0], "text": list("abcdefghijk"), "words": list("abcdefghijX"), "tail": [5.0, *long[1:]]}
    want = {("off", "Data values differ"), ("nan", "NaN positions differ"), ("short", "Shape mismatch"), ("gone", "Only in first"),
            ("come", "Only in second"), ("words", "Data values differ"), ("tail", "NaN positions differ")}
    for a, b in ((3, 5), (4, 1 << 20), (3, 3), (6, 8)):
        got = leaf_differences(cut_leaves(spark, first, a), cut_leaves(spark, second, b), ["shot"], elements=4).collect()
        assert sorted((x.path.split("/")[0], x.difference) for x in got) == sorted(want), (a, b)


def test_recut_keeps_every_value(spark):
    leaves = {f"s{n}": [float(i) for i in range(n)] for n in (0, 1, 4, 5, 8, 13)}
    for size in (1, 3, 7, 50):
        got = {}
        for x in recut(cut_leaves(spark, leaves, size), ["path"], 4).collect():
            got.setdefault(x.path.split("/")[0], {})[x.cell] = x.f64
        assert all(sorted(cells) == list(range(max(1, -(-len(leaves[k]) // 4)))) for k, cells in got.items())
        assert {k: sum((cells[i] for i in sorted(cells)), []) for k, cells in got.items()} == leaves


def test_rename_of_a_differently_cut_copy(spark):
    values = [float(i) for i in range(11)]
    rows = spark.createDataFrame([node("1", "raw", "a", "data", values), node("1", "RAW", "a", "data", values)], NODE_COLUMNS)
    nodes = split_segments(rows.where("tree = 'raw'"), "f64", 3).unionByName(split_segments(rows.where("tree = 'RAW'"), "f64", 5))
    whole = store(spark, [node("1", "raw", "a", "data", values), node("1", "RAW", "a", "data", values)])
    result = rename(Store(nodes, whole.groups, whole.attrs), "raw", "RAW", level="tree")
    assert [x.verdict for x in result.verdicts.collect()] == ["deduplicated"]
    assert {(x.tree, x.seg, len(x.f64)) for x in result.store.nodes.collect()} == {("RAW", 0, 5), ("RAW", 1, 5), ("RAW", 2, 1)}


def test_first_differences_shows_five_and_counts_the_rest(spark):
    nodes = [node("1", t, f"s{i}", "data", [v]) for i in range(8) for t, v in (("old", 1.0), ("new", 2.0))]
    result = rename(store(spark, nodes), "old", "new")
    row = first_differences(result.differences, ["line_no", "shot"]).first()
    assert row.shown == [f"s{i}/data: Data values differ" for i in range(5)] and row.n_more == 3


def sample(spark):
    return store(spark, [
        node("1", "a", "x", "data", [1.0]), node("1", "a", "y", "data", [2.0]),
        node("2", "a", "x", "data", [1.0]), node("2", "b", "x", "data", [1.0]),
        node("3", "a", "x", "data", [1.0]), node("3", "b", "x", "data", [9.0]),
        node("4", "c", "x", "data", [1.0])], attrs=[
        attr("1", "a", None, "t", "tree attr"), attr("1", "a", "x", "u", "V")])


def test_tree_level(spark):
    s = sample(spark)
    result = rename(s, "a", "b")
    assert verdicts_of(result) == {("1", "a", "b"): "renamed", ("2", "a", "b"): "deduplicated",
                                   ("3", "a", "b"): "conflict"}
    assert keys_of(result.store) == {("1", "b", "x"), ("1", "b", "y"), ("2", "b", "x"), ("3", "a", "x"),
                                     ("3", "b", "x"), ("4", "c", "x")}
    assert {(r.shot, r.tree, r.signal, r.name) for r in result.store.attrs.collect()} == {
        ("1", "b", None, "t"), ("1", "b", "x", "u")}
    assert tuple(rename_stats(result).first()) == (2, 1)
    groups = {(r.shot, r.tree) for r in result.store.at_level("tree").collect()}
    assert groups == {("1", "b"), ("2", "b"), ("3", "a"), ("3", "b"), ("4", "c")}
    again = rename(result.store, "a", "b")
    assert verdicts_of(again) == {("3", "a", "b"): "conflict"}


def test_tree_level_in_one_shot_and_dry_run(spark):
    s = sample(spark)
    assert verdicts_of(rename(s, "a", "b", shot="1")) == {("1", "a", "b"): "renamed"}
    assert verdicts_of(rename(s, "a", "b", shot="9")) == {("9", "a", "b"): "not_found"}
    dry = rename(s, "a", "b", dry_run=True)
    assert dry.store is s and tuple(rename_stats(dry).first()) == (2, 1)


def test_shot_level(spark):
    s = store(spark, [node("1", "a", "x", "data", [1.0]), node("2", "a", "x", "data", [1.0]),
                      node("3", "a", "x", "data", [2.0])])
    moved = rename(s, "1", "9", level="shot")
    assert keys_of(moved.store) == {("9", "a", "x"), ("2", "a", "x"), ("3", "a", "x")}
    assert keys_of(rename(s, "1", "2", level="shot").store) == {("2", "a", "x"), ("3", "a", "x")}
    bad = rename(s, "1", "3", level="shot")
    assert rename_stats(bad).first().conflicts == 1 and keys_of(bad.store) == keys_of(s)
    assert rename(s, "7", "8", level="shot").verdicts.first().verdict == "not_found"
    assert rename(s, "1", "1", level="shot").verdicts.first().verdict == "same_name"


def test_signal_level(spark):
    s = sample(spark)
    done = rename(s, "x", "z", level="signal", shot="1", tree="a")
    assert keys_of(done.store) - keys_of(s) == {("1", "a", "z")}
    assert [r.signal for r in done.store.attrs.where("name = 'u'").collect()] == ["z"]
    assert rename(s, "x", "y", level="signal", shot="1", tree="a").verdicts.first().verdict == "conflict"
    assert rename(s, "x", "z", level="signal").verdicts.first().verdict == "scope_required"
    assert rename(s, "q", "z", level="signal", shot="1", tree="a").verdicts.first().verdict == "not_found"


def lines(spark, *pairs):
    rows = [(i, *p, *([None] * (4 - len(p)))) for i, p in enumerate(pairs, start=1)]
    return mapping_of(spark.createDataFrame(rows, "line_no bigint, old_name string, new_name string, "
                                                  "shot string, tree string"))


def sequential(s, pairs, level="tree"):
    """The same mapping, one rename after the other."""
    total = 0
    for old, new in pairs:
        step = rename(s, old, new, level=level)
        total += rename_stats(step).first().renamed
        s = Store(*[cut_lineage(df) for df in (step.store.nodes, step.store.groups, step.store.attrs)])
    return s, total


@pytest.mark.parametrize("pairs", [
    [("a", "m"), ("b", "n")],                       # independent
    [("a", "b"), ("b", "q")],                       # chain through a collision
    [("a", "m"), ("m", "n"), ("n", "b")],           # chain into an existing name
    [("b", "k"), ("a", "b"), ("k", "a")],           # swap
    [("a", "a"), ("zz", "y"), ("a", "b"), ("c", "b"), ("b", "c")],
])
def test_batch_equals_sequence(spark, pairs):
    s = sample(spark)
    batch = rename_batch(s, lines(spark, *pairs))
    expected, total = sequential(s, pairs)
    assert keys_of(batch.store) == keys_of(expected)
    assert rename_stats(batch).first().renamed == total
    values = lambda st: {(r.shot, r.tree, r.signal, tuple(r.f64)) for r in st.nodes.collect()}
    assert values(batch.store) == values(expected)


def plain_batch(held, pairs):
    """(verdicts, bearers) of one shot, line by line; ``held`` is {name: value}."""
    at, out = {k: k for k in held}, []
    for i, (old, new) in enumerate(pairs, start=1):
        if old == new or old not in at:
            continue
        if new not in at:
            at[new] = at.pop(old)
            out.append((i, "renamed"))
        elif held[at[old]] == held[at[new]]:
            del at[old]
            out.append((i, "deduplicated"))
        else:
            out.append((i, "conflict"))
    return out, {k: held[v] for k, v in at.items()}


@pytest.mark.parametrize("level", ["tree", "signal", "shot"])
def test_random_chains_equal_line_by_line(spark, level):
    """Many shots of few values over few names: dependent lines, conflicts and swaps in mid-chain. At signal level each
    place has lines of its own, at shot level the names of a place are made its own."""
    rng = random.Random(level)
    names, places = [f"n{i}" for i in range(7)], range(12)
    stores = {p: {k: float(rng.randint(1, 2)) for k in rng.sample(names, rng.randint(0, 7))} for p in places}
    common = [tuple(rng.choices(names, k=2)) for _ in range(14)]
    pairs = {p: common if level == "tree" else [tuple(rng.choices(names, k=2)) for _ in range(10)] for p in places}
    own = lambda p, k: f"{p}_{k}" if level == "shot" else k
    at = {"tree": lambda p, k: (str(p), k, "s"), "signal": lambda p, k: (str(p), "t", k), "shot": lambda p, k: (own(p, k), "t", "s")}[level]
    nodes = [node(*at(p, k), "data", [v]) for p, held in stores.items() for k, v in held.items()]
    numbers = {}
    rows = []
    for p in places if level != "tree" else [0]:
        for i, (old, new) in enumerate(pairs[p], start=1):
            rows.append((len(rows) + 1, own(p, old), own(p, new), *((str(p), "t") if level == "signal" else (None, None))))
            numbers[p, i] = len(rows)
    mapping = spark.createDataFrame(rows, "line_no bigint, old_name string, new_name string, shot string, tree string")
    batch = rename_batch(store(spark, nodes), mapping, level)
    want, left = [], set()
    for p, held in stores.items():
        done, bearers = plain_batch(held, pairs[p])
        want += [(numbers[0 if level == "tree" else p, i], None if level == "shot" else str(p), v) for i, v in done]
        left |= {(*at(p, k), v) for k, v in bearers.items()}
    got = [(r.line_no, r.shot, r.verdict) for r in batch.verdicts.collect() if r.verdict not in ("not_found", "same_name")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(r.shot, r.tree, r.signal, r.f64[0]) for r in batch.store.nodes.collect()} == left
    conflicts = {(n, s) for n, s, v in want if v == "conflict"}
    assert conflicts and {(r.line_no, r["shot"] if level != "shot" else None) for r in batch.differences.collect()} == conflicts


def test_lines_of_one_shot_tie_with_lines_of_all(spark):
    s = store(spark, [node(p, t, "s", "data", [v]) for p in "12" for t, v in (("a", 1.0), ("b", 2.0))])
    batch = rename_batch(s, lines(spark, ("b", "c", "1"), ("a", "b"), ("b", "d", "2")))
    assert keys_of(batch.store) == {("1", "c", "s"), ("1", "b", "s"), ("2", "a", "s"), ("2", "d", "s")}
    got = {(r.line_no, r.shot): (r.verdict, r.n_differences) for r in batch.verdicts.collect()}
    assert got == {(1, "1"): ("renamed", 0), (2, "1"): ("renamed", 0), (2, "2"): ("conflict", 1), (3, "2"): ("renamed", 0)}


def test_jobs_of_a_chain_grow_with_its_logarithm(spark):
    def jobs(n):
        s = store(spark, [node("1", f"t{i}", "s", "data", [float(i % 5)]) for i in range(0, n + 1, 3)])
        spark.sparkContext.setJobGroup(f"chain{n}", "")
        done = rename_batch(s, lines(spark, *[(f"t{i}", f"t{i + 1}") for i in range(n)]))
        count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{n}"))
        held = {f"t{i}": float(i % 5) for i in range(0, n + 1, 3)}
        out, left = plain_batch(held, [(f"t{i}", f"t{i + 1}") for i in range(n)])
        spark.sparkContext.setJobGroup("", "")
        assert sorted((r.line_no, r.verdict) for r in done.verdicts.collect() if r.verdict != "not_found") == out
        assert {(r.tree, r.f64[0]) for r in done.store.nodes.collect()} == set(left.items())
        return count

    few, many = jobs(8), jobs(128)
    assert many <= few + 12 * math.log2(128 / 8), (few, many)


def test_batch_dry_run_does_not_chain(spark):
    s = sample(spark)
    dry = rename_batch(s, lines(spark, ("c", "d"), ("d", "e")), dry_run=True)
    assert {r.line_no: r.verdict for r in dry.verdicts.collect()} == {1: "renamed", 2: "not_found"}
    assert dry.store is s


def test_batch_signal_level_needs_scope(spark):
    s = sample(spark)
    none = rename_batch(s, lines(spark, ("x", "z")), level="signal")
    assert rename_stats(none).first().renamed == 0 and keys_of(none.store) == keys_of(s)
    some = rename_batch(s, lines(spark, ("x", "z", "1", "a"), ("z", "w", "1", "a")), level="signal")
    assert keys_of(some.store) - keys_of(s) == {("1", "a", "w")}
