"""Vector codes against a plain version in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from signalvault.llm import vector_codes
from signalvault.llm.vector_codes import assign, compress, exact

SCHEMA = "vec_id long, embedding array<double>, label int, code string, n int"


def plain(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * v) for v in x], label) for i, x, label in rows
            if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    cut = vector_codes.cuts(size, parts)
    books = [[r[1][cut[p]:cut[p + 1]] for r in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, x, _ in kept:
                held.setdefault(nearest(p, x[cut[p]:cut[p + 1]])[1], []).append(x[cut[p]:cut[p + 1]])
            for e, mine in held.items():
                books[p][e] = [sum(v) // len(mine) for v in zip(*mine)]
    out = []
    for i, x, label in kept:
        found = [nearest(p, x[cut[p]:cut[p + 1]]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()


def rows_of(r, n, size, scale):
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    return [(r.randrange(10 * n), [scale * (c + r.gauss(0, .3)) for c in r.choice(centres)], r.choice([None, 1, 2])) for _ in range(n)]


@pytest.mark.parametrize("n, size, entries, group, scale", [(300, 8, 40, 4, .1), (150, 10, 9, 32, 3.), (60, 8, 256, 32, 100_000.), (3, 4, 256, 32, 1.)])
def test_codes(spark, n, size, entries, group, scale):
    r = random.Random(n)
    rows = rows_of(r, n, size, scale)
    rows += rows[:2] + [(None, rows[0][1], 1), (-1, None, 1), (-2, [None] * size, 1), (-3, [math.nan] * size, 2), (-4, [math.inf] * size, None), (-5, [], 1)][:-1]
    rows += [(10**6, [1.0], 1)]
    found = compress(spark.createDataFrame([(*x, "x", 7) for x in rows], SCHEMA).repartition(3), 4, entries, 4, group)
    want, digest = plain(rows, 4, entries, 4)
    assert sorted((tuple(x) for x in found.rows.collect()), key=str) == sorted(want, key=str)
    assert found.digest() == digest


def test_nothing(spark):
    found = compress(spark.createDataFrame([], SCHEMA))
    assert found.rows.count() == 0 and found.digest() == hashlib.sha256(b"").hexdigest()
    only = compress(spark.createDataFrame([(1, None, 1, "", 0)], SCHEMA))
    assert only.rows.count() == 0
    with pytest.raises(Exception, match="scale"):
        compress(spark.createDataFrame([(1, [1e30] * 4, 1, "", 0)], SCHEMA))


def test_bounds_keep_their_stamps_and_save_distances():
    r = np.random.default_rng(2)
    x = np.floor(1024 * (r.normal(size=(20, 4))[r.integers(0, 20, 2000)] + r.normal(size=(2000, 4)) / 20)).astype(np.int64)
    history, code, upper, lower, stamp = [x[:64]], None, np.zeros(0), np.zeros((0, 1)), np.zeros((0, 1), np.uint8)
    share = []
    for _ in range(6):
        code, upper, lower, stamp, measured = assign(x, history, code, upper, lower, stamp)
        d = exact(x, history[-1])
        assert (code == d.argmin(1)).all()
        share.append(measured / d.size)
        history.append(np.stack([x[code == e].sum(0) // (code == e).sum() if (code == e).any() else history[-1][e] for e in range(64)]))
    assert share[-1] < .7 < share[0] and len(np.unique(stamp)) > 1


def test_drift_that_returns_costs_nothing():
    """Entries that move away and back are ruled out by where they are, not by how far they went."""
    x = np.array([[0, 0], [1000, 0]] * 20)
    near, far = np.array([[0, 0]] * 32 + [[1000, 0]] * 32), np.array([[0, 400]] * 32 + [[1000, 400]] * 32)
    state = assign(x, [near], None, np.zeros(0), np.zeros((0, 1)), np.zeros((0, 1), np.uint8))[:4]
    history = [near, far, far, near]
    assert assign(x, history, *state)[4] == 40 + 40 * 32  # the group of ties alone is met
