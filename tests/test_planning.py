import random

import pytest
from pyspark.sql import functions as F

from signalvault.functions import naming
from signalvault.functions.ordinals import dense_ordinal
from signalvault.plans import acquisition as plan
from signalvault.sources import catalog as cat
from signalvault.sources import files, text

LIST = "# campaign\n200000\n200015\n\n200015\n  # indented\n 200032 \n200100"

CATALOG = """trees:
    - stray above any header
  main:
    - \\MAIN::TOP.A:ONE
    - \\MAIN::TOP.A:TWO
  - wrong indent
  points:
    - bare
    - bare
  main:
    - \\MAIN::TOP.A:ONE
  bad-header:
   main2:
    - last

server:   host.example:8000
"""


def put(folder, name, content):
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(content)
    return path


def test_shot_list(spark, folder):
    lines = text.read_lines(spark, put(folder, "l.txt", LIST))
    rows = sorted((r.n, r.shot) for r in text.shot_list(lines).collect())
    assert [s for _, s in rows] == ["200000", "200015", "200015", "200032", "200100"]


@pytest.mark.parametrize("end", ["", "\n"])
def test_lines_read_in_splits_equal_lines_read_whole(spark, folder, end):
    path = put(folder, "long.txt", "\n".join(f"line {i} " + "x" * (i % 50) for i in range(1, 3001)) + end)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        split = {r.n: r.line for r in text.read_lines(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    whole = {r.n: r.line for r in text.read_lines(spark, path).collect()}
    assert split == whole and sorted(split) == list(range(1, 3001))


def test_catalog(spark, folder):
    path = put(folder, "c.yaml", CATALOG)
    catalog, missing = cat.read_catalogs(spark, [path, f"{folder}/none.yaml"])
    rows = sorted(catalog.collect(), key=lambda r: r.ordinal)
    assert [(r.ordinal, r.tree, r.signal) for r in rows] == [
        (1, "main", "\\MAIN::TOP.A:ONE"), (2, "main", "\\MAIN::TOP.A:TWO"), (3, "points", "bare"),
        (4, "points", "bare"), (5, "main", "\\MAIN::TOP.A:ONE"), (6, "main", "last")]
    assert {r.server for r in rows} == {"host.example:8000"}
    assert missing == [f"{folder}/none.yaml"]
    with pytest.raises(FileNotFoundError):
        cat.read_catalogs(spark, [path, f"{folder}/none.yaml"], require_all=True)
    runs = plan.signals_by_run(plan.tree_runs(plan.chunked(catalog, 4)))
    got = {(r.chunk, r.run, r.tree): r.signals for r in runs.collect()}
    assert got == {(1, 1, "main"): ["\\MAIN::TOP.A:ONE", "\\MAIN::TOP.A:TWO"], (1, 2, "points"): ["bare", "bare"],
                   (2, 1, "main"): ["\\MAIN::TOP.A:ONE", "last"]}


def test_catalog_across_splits(spark, folder):
    """Trees that begin splits before their items, splits without a header, stray items, several server lines."""
    r = random.Random(5)
    lines = ["    - stray"] * 40 + ["server: one"]
    for i in range(4000):
        lines.append(r.choice(["    - s%d", "    - s%d", "    - s%d", " odd %d", "    -"]).replace("%d", str(i)) if r.random() < 0.99 else f"  t{i}:")
    lines += ["  last:", "server:  two "] + ["    - x"] * 3000
    content = "\r\n".join(lines) + "\n"
    path = put(folder, "long.yaml", content)
    want = cat.parse_catalog(spark.createDataFrame([("a", content)], "id string, text string"), "id")
    want = {(x.ordinal, x.tree, x.signal) for x in want.collect()}
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("500", "4000", keep):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            catalog, _ = cat.read_catalogs(spark, [path])
            rows = catalog.collect()
            assert {(x.ordinal, x.tree, x.signal) for x in rows} == want and len(rows) == len(want)
            assert {x.server for x in rows} == {"one two"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert max(want)[0] == len(want) and not any(x[2] == "stray" for x in want)


def test_catalog_lines_without_header_or_item(spark):
    lines = spark.createDataFrame([("a", 0, 0, "    - x"), ("b", 0, 0, "  t:"), ("c", 0, 0, "  t:"), ("c", 2, 0, "    - y"), ("c", 2, 1, None)],
                                  "k string, block long, id long, line string")
    assert [tuple(x) for x in cat.parse_catalog_lines(lines, "k").collect()] == [("c", 2, 0, 1, "t", "y")]
    assert cat.parse_catalog_lines(lines.limit(0), "k").count() == 0


def test_catalog_without_header_or_text(spark):
    texts = spark.createDataFrame([("a", ""), ("b", "    - x\n"), ("c", "  t:\n")], "id string, text string")
    assert cat.parse_catalog(texts, "id").count() == 0


def test_mapping_lines(spark):
    content = "# c\n\n a b \nonly\nx y z\n\tc\td\n#e f\na a"
    lines = text.numbered_lines(spark.createDataFrame([(content,)], "text string"))
    good, bad = text.mapping_lines(lines)
    assert sorted(tuple(r) for r in good.collect()) == [(3, "a", "b"), (6, "c", "d"), (8, "a", "a")]
    assert sorted((r.line_no, r.n_tokens) for r in bad.collect()) == [(4, 1), (5, 3)]


def test_pending_and_batches(spark):
    done = spark.createDataFrame([("3",), ("3",), ("5",), ("007",)], "shot string")
    left = plan.pending(plan.shots_range(spark, 1, 8), done)
    rows = {r.shot: (r.ordinal, r.batch, r.task) for r in plan.batched(left, "shot_no", 4).collect()}
    assert rows == {"1": (1, 1, 1), "2": (2, 1, 2), "4": (3, 1, 3), "6": (4, 1, 4), "7": (5, 2, 1), "8": (6, 2, 2)}
    assert plan.nth_shot(plan.batched(left, "shot_no", 4), 2, 2).first().shot == "8"
    assert plan.nth_shot(plan.batched(left, "shot_no", 4), 2, 3).count() == 0
    listed = spark.createDataFrame([("4",), ("3",), ("4",)], "shot string")
    assert sorted(r.shot for r in plan.pending(listed, done).collect()) == ["4", "4"]


def test_dense_ordinal_for_any_positions(spark):
    rows = spark.range(1000).where("id % 3 != 0").select((F.col("id") * 1_000_003 - 500).alias("p"), (F.col("id") % 2).alias("g"))
    got = dense_ordinal(rows, "p", "o").orderBy("p").collect()
    assert [r.o for r in got] == list(range(1, len(got) + 1))
    for g in (0, 1):
        part = [r.o for r in dense_ordinal(rows, "p", "o", ["g"]).where(f"g = {g}").orderBy("p").collect()]
        assert part == list(range(1, len(part) + 1))
    assert dense_ordinal(rows.limit(0), "p").count() == 0


@pytest.mark.parametrize("split", ["7", "128m"])
def test_line_ends(spark, folder, split):
    """The same lines however the file is split: a lone carriage return is text in lists and an end in mappings."""
    path = f"{folder}/ends.txt"
    with open(path, "wb") as f:
        f.write(b"\xef\xbb\xbf1\r2\n3\r\n\n4\r\r5\n6\r")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lists = [r.line for r in text.read_lines(spark, path).orderBy("n").collect()]
        mappings = [(r.n, r.line) for r in text.read_lines(spark, path, any_end=True).orderBy("n").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert lists == ["1\r2", "3", "", "4\r\r5", "6"]
    assert mappings == list(enumerate(["1", "2", "3", "", "4", "", "5", "6"], start=1))



def catalog_of(spark, sizes):
    rows = [(c, f"c{c}", i, "t", f"s{i}") for c, n in enumerate(sizes, start=1) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "config_no int, config string, ordinal bigint, tree string, signal string")


def test_plan(spark):
    catalog = catalog_of(spark, [250, 14])
    shots = plan.shots_range(spark, 1, 3)
    units = plan.chunk_plan(shots, catalog).where("shot = '2'").orderBy("config_no", "chunk").collect()
    assert [(r.config, r.chunk, r.first_ordinal, r.last_ordinal, r.n_signals) for r in units] == [
        ("c1", 1, 1, 100, 100), ("c1", 2, 101, 200, 100), ("c1", 3, 201, 250, 50), ("c2", 1, 1, 14, 14)]
    signals = plan.signal_plan(shots, catalog)
    assert signals.count() == 3 * 264
    assert signals.where("chunk != floor((ordinal - 1) / 100) + 1").count() == 0
    counts = {r.config: (r.n_signals, r.n_chunks) for r in plan.catalog_counts(catalog).collect()}
    assert counts == {"c1": (250, 3), "c2": (14, 1)}


def test_names(spark):
    row = spark.createDataFrame([("200000", "conf/config_a.yaml", 3)], "shot string, config string, chunk bigint")
    got = row.select(
        naming.output_file("/cscratch/x", "shot").alias("o"), naming.base_name("config", ".yaml").alias("b"),
        naming.without_prefix(naming.output_file("/cscratch/x", "shot")).alias("w"),
        naming.without_prefix(F.lit("/else/x")).alias("e"),
        naming.chunk_label("config", "shot", "chunk", F.lit("11"), F.lit("2")).alias("c"),
        naming.path_of("shot", F.lit(None).cast("string")).alias("p")).first()
    assert tuple(got) == ("/cscratch/x/200000.h5", "config_a", "x/200000.h5", "/else/x",
                          "config_config_a_200000_chunk3_11_2.yml", "200000")


def test_usable_sources(spark, folder):
    a, b = put(folder, "a", "1"), put(folder, "b", "2")
    good, bad = files.usable_sources(spark, a, [b, f"{folder}/./a", f"{folder}/c", b])
    assert [(i, p) for i, p in good] == [(1, b), (4, b)]
    assert [(i, why) for i, _, why in bad] == [(2, "same as target"), (3, "missing")]
    with pytest.raises(FileNotFoundError):
        files.usable_sources(spark, f"{folder}/c", [a])
