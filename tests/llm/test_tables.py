"""Mixing, neighbours, quotations, the pipeline and the queries' SQL."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline
from check_queries import compare, connect
from signalvault.llm import nearest as nearest_module
from signalvault.llm import queries
from signalvault.llm.mixing import mix, mixed, targets
from signalvault.llm.nearest import nearest
from signalvault.llm.quotation_links import conversations, quotation_levels

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert compare(got, connect(SF).sql(queries.ORACLES[name]).df()) is None


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, left, free, out = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_targets(spark):
    r = random.Random(1)
    for _ in range(6):
        sizes = {(f"s{i}" if i else None): r.choice([0, 1, 5, 100, 1000, 20_000]) for i in range(r.randrange(1, 14))}
        got = {x.source: x.target for x in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(water(sizes))


def test_mix_comes_near_its_targets(spark, documents, awkward):
    r = random.Random(2)
    rows = [*awkward[:5], *[(100 + i, "w " * r.randrange(1, 60), r.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(600)], (900, "w " * 7, "tiny")]
    docs = documents(rows)
    got = mix(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for _, part in got.groupby(got.source.fillna("null")):
        assert part.source_size.iloc[0] == part["size"].sum() and abs(part.taken.sum() - part.target.iloc[0]) <= 30
    again = mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixed(docs).count() == got.copies.sum() and mixed(docs).columns == docs.columns
    assert mix(documents([])).count() == 0 and mix(documents([(1, None, "a"), (2, "", "b")])).where("taken = 0 and target = 0").count() == 2


def brute(rows, queries_, k):
    out = []
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    for q in queries_:
        d = np.sqrt(((x - x[ids == q][0])**2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out += [(q, n + 1, int(ids[i]), d[i]) for n, i in enumerate(order)]
    return out


@pytest.mark.parametrize("block, cell, probes", [(8192, 4096, None), (50, 100, None), (50, 100, 3)])
def test_nearest(spark, monkeypatch, block, cell, probes):
    monkeypatch.setattr(nearest_module, "BLOCK", block)
    monkeypatch.setattr(nearest_module, "CELL_ROWS", cell)
    monkeypatch.setattr(nearest_module, "QUERY_BLOCK", 7)
    r = np.random.default_rng(0)
    centers = r.normal(size=(8, 24)) * 3
    vectors = np.round(centers[r.integers(0, 8, 900)] + r.normal(size=(900, 24)), 3)
    vectors[300:600] = vectors[300]  # a vector that a third of the rows have
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = [tuple(x) for x in nearest(table, lambda v: v % 50 == 0, 10, probes).orderBy("query_id", "rank").collect()]
    want = brute(rows, range(0, 900, 50), 10)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert len({x[0:3:2] for x in got} & {x[0:3:2] for x in want}) >= (0.98 if probes is None else 0.9) * len(want)
    exact = {(q, v): s for q, _, v, s in brute(rows, range(0, 900, 50), 899)}
    assert all(abs(exact[q, v] - s) < 1e-9 for q, _, v, s in got)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]),
            (7, [1.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(x) for x in nearest(table, lambda v: v % 3 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (6, 1, 7, 0.0), (6, 2, 0, 1.0)]
    assert nearest(table.limit(0), lambda v: v % 3 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {(r.query_id, r.vec_id) for r in queries.op10_nearest(spark, "/root/testdata/sf0.1").collect()}
    want = {(q, v) for q, _, v, _ in brute(rows, [i for i, _ in rows if i % 100 == 0], 10)}
    assert len(got & want) >= 0.95 * len(want)


def test_conversations(spark):
    rows = [(1, "u", "Hello there"), (2, "u", "Hello there"), (3, "a", "> Hello there\nHi, second"), (4, "u", ">> hello  THERE\n> Hi, second\nThanks"),
            (5, "a", "On Monday a wrote:\n> Thanks\n\nBye"), (6, "a", "> Hello there\nanother answer"), (7, "u", "> nobody said this\nalone"), (8, "u", None),
            (9, "u", ""), (10, "a", ">"), (11, "a", "> Hello there\n> Thanks\n> Bye\nmost lines win"), (None, "u", "x"), (9, "u", "")]
    table = spark.createDataFrame(rows, "message_id long, role string, text string")
    got = {r.message_id: (r.conversation_id, r.position, r.depth, r.reply_to, r.text) for r in conversations(table).collect()}
    assert got == {1: (1, 1, 0, None, "Hello there"), 2: (2, 1, 0, None, "Hello there"), 3: (2, 2, 1, 2, "Hi, second"), 4: (2, 4, 2, 3, "Thanks"),
                   5: (2, 5, 3, 4, "Bye"), 6: (2, 3, 1, 2, "another answer"), 7: (7, 1, 0, None, "alone"), 8: (8, 1, 0, None, ""), 9: (9, 1, 0, None, ""),
                   10: (10, 1, 0, None, ""), 11: (2, 6, 4, 5, "most lines win")}
    assert conversations(table.limit(0)).count() == 0
    assert [r.level for r in quotation_levels(table.where("message_id = 4")).orderBy("place").collect()] == [2, 1, 0]


def test_threads_that_share_lines(spark):
    rows = [(1, "u", "Hi all\nShip it Friday"), (2, "u", "Hi all\nLunch?"), (3, "a", "> Hi all\n> Ship it Friday\nyes"),
            (10, "u", "Dear list\nthe build is red\n\nKind regards\nKim"), (11, "u", "Dear list\nnothing new\n\nKind regards\nKim"),
            (12, "a", "> Dear list\n> the build is red\n> Kind regards\nfixed"),  # partial: one line tells
            (20, "u", "one long line that a mail program\nwraps anew"), (21, "a", "> one long line that\n> a mail program wraps anew\nseen"),
            (30, "a", ">> Hi all\n>> Lunch?\n> not in the table\ndeeper"),
            (40, "u", "p\nq\nr"), (41, "u", "p\nx"), (42, "u", "q\ny"), (43, "u", "r\nz"), (44, "a", "> p\n> q\ntwo in a row"),
            (50, "u", "start here"), (51, "a", "> start here\nok"), (52, "u", "begin"), (53, "a", "> begin\nok"), (54, "u", ">> start here\n> ok\nthanks"),
            (60, "a", ">> Ship it Friday\n>> Hi all\n> Hi all\n> gone\nonly a greeting is shared")]
    table = spark.createDataFrame(rows, "message_id long, role string, text string")
    got = {r.message_id: r.reply_to for r in conversations(table).collect() if r.reply_to is not None}
    assert got == {3: 1, 12: 10, 21: 20, 30: 2, 44: 40, 51: 50, 53: 52, 54: 51, 60: 1}


def test_only_lines_before_quotations_announce_them(spark):
    rows = [(1, "u", "On page 3 Smith wrote:\nunquoted words"), (2, "a", "On Monday u wrote:\n \n> On page 3 Smith wrote:\n> unquoted words\n\nSo\nOn page 4 too they wrote:"),
            (3, "u", "On Tuesday a wrote:\n> On Monday u wrote:\n> > On page 3 Smith wrote:\n> > unquoted words\n> So\n> On page 4 too they wrote:\nyes")]
    table = spark.createDataFrame(rows, "message_id long, role string, text string")
    got = {r.message_id: (r.reply_to, r.text) for r in conversations(table).collect()}
    assert got == {1: (None, rows[0][2]), 2: (1, "So\nOn page 4 too they wrote:"), 3: (2, "yes")}


def test_a_long_thread_and_a_common_line(spark):
    rows = [(0, "u", "start")]
    for i in range(1, 200):
        rows.append((i, "u", f"> {rows[-1][2].splitlines()[-1]}\nmessage {i}"))
    rows += [(1000 + i, "a", "> start\nok") for i in range(300)]
    got = {r.message_id: r for r in conversations(spark.createDataFrame(rows, "message_id long, role string, text string")).collect()}
    assert got[199].depth == 199 and got[1299].reply_to == 0 and all(r.conversation_id == 0 for r in got.values())
    assert sorted(r.position for r in got.values()) == list(range(1, 501))


@tables
def test_pipeline(spark):
    """Every stage against a plain version of what it decides."""
    from fractions import Fraction

    from test_scans import plain_spans
    from test_text_sets import classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, SF)
        rows = [r.asDict() for r in docs.collect()]
        kept[name] = len(rows)
        if name == "toxicity":
            assert rows and all(r in before for r in rows)
        if name == "ngram_join":
            first = {d for d, _, c in classes([(r["doc_id"], r["text"]) for r in before], 5, 80, 100) if d == c}
            assert {r["doc_id"] for r in rows} == first and len(rows) == len(first) and Fraction(80, 100) == Fraction(4, 5)
        if name == "secret_scan":
            texts = {r["doc_id"]: r["text"] for r in before}
            assert len(rows) == len(before) and all((r["text"] == texts[r["doc_id"]]) == (not plain_spans(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"]) for r in rows)
        if name == "mixing":
            taken = mix(spark.createDataFrame(before, docs.schema)).agg({"copies": "sum"}).first()[0]
            assert len(rows) == taken
    assert docs.columns == ["doc_id", "n_tokens", "ids"] and corpus_pipeline.run(spark, SF).count() == kept["sentencepiece"]


def test_pipeline_on_awkward_rows(spark, documents, awkward, folder):
    spark.createDataFrame([(0, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int").write.parquet(folder + "/labels.parquet")
    for rows in (awkward, []):
        docs = documents(rows).drop("n")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = stage(spark, docs, folder)
            assert i == 4 or docs.columns == columns
            docs.write.parquet(f"{folder}/{len(rows)}-{i}")
            docs = spark.read.parquet(f"{folder}/{len(rows)}-{i}")
        assert (docs.count() > 0) == bool(rows)
