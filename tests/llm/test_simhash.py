"""SimHash near-duplicates against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signalvault.llm import queries
from signalvault.llm.components import components
from signalvault.llm.simhash import fingerprint_links, position_pairs, position_sets, simhash_classes

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance):
    values = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= distance).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {int(v): int(values[find(i)]) for i, v in enumerate(values)}


def plain_classes(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    root, least = plain_components(prints, 4), {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            least[root[p]] = min(doc_id, least.get(root[p], doc_id))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)), key=str)


def test_pairs_and_sets_cover_all_matches():
    from itertools import combinations

    for distance in (2, 4):
        pairs, sets = position_pairs(distance), position_sets(distance)
        for held in combinations(range(8), 8 - distance):
            assert any(set(p) <= set(held) for p in pairs)
            assert sum(held in mine for _, mine in sets) == 1
    assert len(position_pairs(4)) == 7


@pytest.mark.parametrize("cell", [1, 40, 2048])
@pytest.mark.parametrize("distance", [2, 4])
def test_links_at_every_size_of_cell(spark, cell, distance):
    r = random.Random(cell + distance)
    prints = [r.getrandbits(64) for _ in range(60)]
    for base in prints[:12]:  # chains of copies some bits apart
        for _ in range(12):
            for b in r.sample(range(64), r.randrange(1, 6)):
                base ^= 1 << b
            prints.append(base)
    prints += [r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64) for _ in range(60)] + [0]
    signed = sorted({p - 2**64 if p >> 63 else p for p in prints})
    links = fingerprint_links(spark.createDataFrame([(p,) for p in signed], "bits long"), distance, cell)
    got = {x.node % 2**64: x.component % 2**64 for x in components(links).collect()}
    want = plain_components(prints, distance)
    same = {}
    for p in want:
        assert same.setdefault(want[p], got.get(p, p)) == got.get(p, p)
    assert len(set(same.values())) == len(same)


def test_classes(spark, documents, awkward):
    r = random.Random(4)
    rows = [*awkward, (20, "", "a"), (None, None, "b")]
    for i in range(60):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([1, 2, 4, 5, 6, 60, 200]))]
        for j in range(r.randrange(1, 4)):
            rows.append((100 + 10 * i + j, " ".join(words), "a"))
            words[r.randrange(len(words))] = f"V{r.randrange(9)}"
    got = simhash_classes(documents(rows)).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_classes([(i, t) for i, t, _ in rows])
    assert simhash_classes(documents([])).count() == 0


def test_query(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_simhash"](spark, SF)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(x) for x in got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == plain_classes(rows)


def test_fingerprint_is_the_built_in_hash_of_a_single_shingle(spark, documents):
    docs = documents(["Alpha beta", "x", "one two three four"])
    want = docs.select(F.lpad(F.lower(F.hex(F.xxhash64(F.lower("text")))), 16, "0").alias("h")).collect()
    assert [x.h for x in want] == [x.fingerprint for x in simhash_classes(docs).orderBy("doc_id").collect()]
