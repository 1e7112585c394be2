"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from signalvault.llm.turn_repair import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, n int"
KEEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        held += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in held:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        n = len(held)

        @lru_cache(None)
        def best(i, state, inserts=0):
            ways = [(0, "", ())] if i == n and state in ("", "a") else []
            if inserts < 3:
                to = NEXT[state]
                c, a, t = best(i, to, inserts + 1)
                ways.append((c + 2, "I" + a, (f"{NAME[to]}:", *t)))
            if i < n:
                _, role, text = held[i]
                c, a, t = best(i + 1, state)
                ways.append((c + 3, "D" + a, t))
                if faults[i] not in ("blank", "duplicate"):
                    late = faults[i] == "truncated"
                    to = KEEP.get((state, role[:1]))
                    if to:
                        c, a, t = best(i + 1, to)
                        ways.append((c + late, "K" + a, (f"{role}:{text}", *t)))
                    to = NEXT[state]
                    c, a, t = best(i + 1, to)
                    ways.append((c + 2 + late, "R" + a, (f"{NAME[to]}:{text}", *t)))
            return min(ways) if ways else (10**9, "", ())

        cost, audit, lines = best(0, "") if n else (0, "", ())
        turns = {t for t, _, _ in held} - {None}
        initials = [role[:1] for _, role, _ in held]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(r, convs, most):
    rows = []
    for conv in convs:
        turns = random.Random(r.random()).sample(range(-3, 4 * most), r.randrange(1, most))
        for t in turns:
            role = r.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "ux"])
            rows.append((conv, t, role, r.choice(["Yes.", "No!", "so it is", " \t\n", "", None, "Was it?  \n", f"word {r.randrange(99)}.", "ends. not"])))
    return rows


@pytest.mark.parametrize("segment", [16384, 2, 6])
def test_repair(spark, segment):
    r = random.Random(segment)
    rows = some_rows(r, range(40 if segment > 100 else 14), 12) + some_rows(r, [None, -7], 20)
    rows += [(500 + i, t, "user", "x.") for i in range(12) for t in (1,)]  # some of them lose all turns
    rows += [(600, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(60)] + [(601, None, "user", "once.")]
    frame = spark.createDataFrame([(*x, "x", 1) for x in r.sample(rows, len(rows))], SCHEMA).repartition(3)
    got = sorted((tuple(x) for x in repair(frame, segment).collect()), key=str)
    assert got == plain(rows)
    assert any(not x[7] for x in got)


def test_repeated_rows_and_nothing(spark):
    rows = [(1, 2, "user", "a."), (1, 2, "user", "a."), (1, 3, "assistant", "b." * 200_000)]
    for segment in (16384, 1):
        got = repair(spark.createDataFrame([(*x, "", 0) for x in rows], SCHEMA), segment)
        assert [tuple(x) for x in got.collect()] == plain(rows)
        assert repair(spark.createDataFrame([], SCHEMA), segment).count() == 0
