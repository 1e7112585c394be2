"""N-gram join and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from signalvault.llm import ngram_join, substring_dedup
from signalvault.llm.ngram_join import ngram_classes, t_occurrence
from signalvault.llm.substring_dedup import remove_repeats

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, width):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def classes(rows, width, top, bottom):
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        same = len(x & y)
        if a != b and same and same * bottom >= top * (len(x) + len(y) - same):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return sorted((d, len(s), root(d)) for d, s in sets)


def edited(random_, words, n):
    words = list(words)
    for _ in range(n):
        words[random_.randrange(len(words))] = f"new{random_.randrange(40)}"
    return " ".join(words)


def corpus(seed):
    r = random.Random(seed)
    line = "a common line that very many of these texts hold in the middle"
    texts = []
    for family in range(6):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice([6, 12, 40, 90]))]
        texts += [edited(r, base, r.randrange(4)) for _ in range(r.choice([1, 2, 30]))] + [" ".join(base)] * r.randrange(3)
    texts += [f"{edited(r, ['u'] * 3, 3)} {line} t{i}" for i in range(40)] + [line, line.upper(), "", None, "x y", "x  y", "x y z"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("width, bound, family", [(4, (85, 100), 1024), (5, (80, 100), 8), (3, (50, 100), 16), (2, (1, 1), 8)])
def test_classes(spark, documents, monkeypatch, width, bound, family):
    monkeypatch.setattr(ngram_join, "FAMILY", family)
    texts = corpus(width)
    got = sorted(map(tuple, ngram_classes(documents(texts).repartition(3, "doc_id"), width, bound).collect()))
    assert got == classes(list(enumerate(texts)), width, *bound)


def test_hot_shingles_change_nothing(spark, documents, monkeypatch):
    texts = corpus(9)
    monkeypatch.setattr(ngram_join, "hot_shingles", lambda *a: np.zeros(0, np.uint64))
    plain = sorted(map(tuple, ngram_classes(documents(texts)).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 1e-9)  # every shingle of 32 texts
    assert sorted(map(tuple, ngram_classes(documents(texts)).collect())) == plain == classes(list(enumerate(texts)), 4, 85, 100)


def test_awkward_rows(spark, documents, awkward):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_classes(documents(awkward)).collect()}
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (6, len(shingles(awkward[6][1], 4)), 5), (9, 2, 9), (None, 2, None)} <= got
    assert ngram_classes(documents(awkward)).count() == len(awkward)
    assert ngram_classes(documents([])).count() == 0


def test_rows_of_far_partitions_stay_apart(spark, monkeypatch):
    def far(count):
        from pyspark import TaskContext

        return (TaskContext.get().partitionId() * 256 << 32) | count

    monkeypatch.setattr(ngram_join, "block_number", far)
    base = [" ".join(f"{name}{i}" for i in range(60)) for name in "ab"]
    rows = [(2 * i + j, text + end) for i, text in enumerate(base) for j, end in enumerate(("", " more"))]  # two of each partition
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert sorted(map(tuple, ngram_classes(docs).collect())) == classes(rows, 4, 85, 100) == [(0, 57, 0), (1, 58, 0), (2, 57, 2), (3, 58, 2)]


@pytest.mark.parametrize("send, kind", [(ngram_join._send(4, 8, np.zeros(0, np.uint64)), ngram_join._SENT),
                                        (substring_dedup._send(35, 8, np.zeros(0, np.uint64)), substring_dedup._SENT)])
def test_first_blocks_of_tasks_spread_over_groups(spark, send, kind):
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(i, f"text {i}") for i in range(64)], 64), "doc_id long, text string")
    found = docs.mapInArrow(send, kind).where("meta").groupBy("pid").count().collect()
    assert sum(r["count"] for r in found) == 64 and len(found) == 8 and max(r["count"] for r in found) <= 20


def test_search_finds_all_links():
    r = random.Random(3)
    for _ in range(30):
        base = [r.randrange(2**60) for _ in range(40)]
        sets = [sorted(r.sample(base, r.randrange(20, 40))) for _ in range(25)]
        n, bound = np.array([len(s) for s in sets]), Fraction(8, 10)
        keys = [np.array(s, np.uint64) for s in sets]
        frequency = Counter(k for s in sets for k in s)
        keys = [k[np.lexsort((k, [frequency[int(x)] for x in k]))] for k in keys]
        order = np.argsort(n, kind="stable")
        links = t_occurrence(order, n[order], order, np.full(25, 2), [keys[i] for i in order], bound)
        rows = [(i, " ".join(map(str, s))) for i, s in enumerate(sets)]
        want = classes(rows, 1, 8, 10)
        parent = list(range(25))
        for a, b in links:
            x, y = parent[a], parent[b]
            parent = [min(x, y) if p in (x, y) else p for p in parent]
        assert [p for p in parent] == [c for _, _, c in want]


def removed(rows, length):
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    count = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, block", [(1, 1 << 20), (3, 50), (6, 200), (35, 300)])
def test_repeats(spark, documents, monkeypatch, length, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    r = random.Random(length)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [" ".join(r.choice("abcde") for _ in range(r.randrange(60))) + (f"  {passage}\n" if r.random() < 0.4 else " ") + f"end{i}" for i in range(60)]
    texts += [passage + " " + passage, "z " * 100, None, ""]
    rows = list(enumerate(texts))
    got = sorted((tuple(x) for x in remove_repeats(documents(texts), length).collect()), key=str)
    assert got == removed(rows, length)


def test_frequent_prefixes_change_nothing(spark, documents, monkeypatch):
    texts = ["a b c d e f g h i j k l " * 3 + str(i) for i in range(80)]
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1e-9)
    got = sorted((tuple(x) for x in remove_repeats(documents(texts), 12).collect()), key=str)
    assert got == removed(list(enumerate(texts)), 12)


def test_awkward_repeats(spark, documents, awkward):
    got = sorted((tuple(x) for x in remove_repeats(documents(awkward), 35).collect()), key=str)
    assert got == removed([(d, t) for d, t, _ in awkward], 35)
    assert remove_repeats(documents([])).count() == 0


def test_digest_is_of_kept_words(spark, documents):
    row = remove_repeats(documents(["a  b\tc"])).first()
    assert hashlib.sha256(row.kept.encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()
