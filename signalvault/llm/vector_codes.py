"""Vector code compression: product codebooks by exact rounds of k-means under norm-of-sum bounds.

Components become integers, vectors are cut into PARTS equal parts, and each part has a codebook of up to 256 entries.
For every part of every vector an upper bound on the distance to its entry and, per group of GROUP entries, a lower
bound on the distance to the others is kept, each with the round it was measured in (its stamp). All codebooks are
kept. What an entry moved since a stamp is the norm of the sum of its steps, that is the true distance between its place
then and now, which is at most the sum of the step lengths that drifting bounds add up. A lower bound less the largest
such displacement of its group, still above the upper bound, rules the whole group out; only the other groups are
measured again, exactly, in integers.

Vectors travel in blocks, with their codes and bounds beside them: a round is one narrow pass that writes the next
state and, per task, the sums of each entry. The driver sees sums of at most PARTS * 256 entries. The state of the round
before is removed when the next one stands, so two lie on disk at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalvault.session import scratch_path

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
GROUP = 32
"""Entries that share a lower bound."""
BLOCK = 4096
"""Vectors of a block: about 1.5 MB with codes and bounds at 64 components."""
LARGEST = 1 << 28
"""Integer components below this keep all distances and a block's sums exact."""

_STATE = "n int, vec_ids binary, labels binary, vectors binary, codes binary, stamps binary, bounds binary"
_STEP = f"kind string, {_STATE}, part int, entry int, members long, totals array<long>, measured long"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, x): vectors that are there and hold finite components only, as doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("x")).where(F.col("x").isNotNull() & fine)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), refused beyond LARGEST."""
    scaled = np.floor(SCALE * x)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST // SCALE} or more; scale the vectors first")
    return scaled.astype(np.int64)


def first_entries(rows: DataFrame, entries: int) -> np.ndarray:
    """Integer vectors of the ``entries`` smallest vec_ids, ascending, nulls last, ties by components."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    return whole(np.array([r.x for r in first], float)) if first else np.zeros((0, 0), np.int64)


def cuts(size: int, parts: int) -> list[int]:
    """Where parts of equal size begin; the first ones are longer by one where ``size`` is no multiple of ``parts``."""
    return [0, *np.cumsum([size // parts + (p < size % parts) for p in range(parts)]).tolist()]


def exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each of ``x`` to each of ``entries``, as exact integers."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * most * most * max(1, x.shape[1]) < 2**53:  # every product and sum is a whole double
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for e, entry in enumerate(entries):
        out[:, e] = ((x - entry) ** 2).sum(1)
    return out


UP, DOWN = 1 + 1e-6, 1 - 1e-6
"""Bounds are kept as 32-bit floats; these factors keep them on the safe side of rounding."""


def assign(x: np.ndarray, history: list[np.ndarray], code: np.ndarray | None, upper: np.ndarray, lower: np.ndarray,
           stamp: np.ndarray, group: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of the last codebook in ``history`` (ties to the lower index), with the bounds to keep.

    ``code`` is the assignment before, None at first. ``stamp`` holds, per vector, the round of its upper bound and of
    each group's lower bound. A bound that still decides is left as it is with its stamp, so the next round again
    subtracts one true displacement and not a sum. Also returned: how many distances were measured.
    """
    now, book = len(history) - 1, history[-1]
    n, groups = len(x), -(-len(book) // group)
    if code is None:
        code, d = np.zeros(n, np.int64), exact(x, book[:1])[:, 0]
        lower, stamp = np.zeros((n, groups)), np.full((n, groups + 1), now, np.uint8)
        upper, reach, open_ = np.sqrt(d.astype(float)) * UP, lower, np.ones((n, groups), bool)
        seen = np.arange(n)
    else:
        moved = np.stack([np.sqrt(((book - old) ** 2).sum(1).astype(float)) for old in history]) * UP
        most = np.stack([np.maximum.reduceat(m, np.arange(0, len(book), group)) for m in moved])
        lower, upper, stamp = lower.astype(float), upper.copy(), stamp.copy()
        reach = lower - most[stamp[:, 1:], np.arange(groups)[None, :]]
        seen = np.flatnonzero((reach <= (upper + moved[stamp[:, 0], code])[:, None]).any(1))
        d = np.zeros(n, np.int64)
        d[seen] = ((x[seen] - book[code[seen]]) ** 2).sum(1)
        upper[seen], stamp[seen, 0] = np.sqrt(d[seen].astype(float)) * UP, now
        open_ = np.zeros((n, groups), bool)
        open_[seen] = reach[seen] <= upper[seen, None]
    measured = len(seen)
    best, at, met = d.copy(), code.copy(), []
    for g in range(groups):
        mine = np.flatnonzero(open_[:, g])
        if len(mine):
            part = exact(x[mine], book[g * group:(g + 1) * group])
            measured += part.size
            inner = part.argmin(1)
            least, first = part[np.arange(len(mine)), inner], inner + g * group
            part[np.arange(len(mine)), inner] = np.iinfo(np.int64).max
            met.append((g, mine, least, first, part.min(1)))
            better = (least < best[mine]) | ((least == best[mine]) & (first < at[mine]))
            best[mine[better]], at[mine[better]] = least[better], first[better]
    changed = np.flatnonzero(at != code)
    left = code[changed] // group  # the entry that a vector leaves is one of the others of its group from now on
    lower[changed, left] = np.minimum(reach[changed, left], np.sqrt(d[changed].astype(float)) * DOWN)
    stamp[changed, 1 + left] = now
    for g, mine, least, first, second in met:
        others = np.where(first == at[mine], second, least)
        lower[mine, g], stamp[mine, 1 + g] = np.sqrt(others.astype(float)) * DOWN, now
    upper[seen] = np.sqrt(best[seen].astype(float)) * UP
    return at, upper, lower, stamp, measured


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of integer vectors; vectors of another length than ``size`` take no part."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = whole(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size))
                named = [np.stack([part.column(c).fill_null(0).to_numpy(), part.column(c).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)])
                         for c in ("vec_id", "label")]
                yield _batch(_STATE, [{"n": part.num_rows, "vec_ids": named[0].tobytes(), "labels": named[1].tobytes(),
                                       "vectors": x.astype(np.int32).tobytes(), "codes": None, "stamps": None, "bounds": None}])

    return rows.where(F.size("x") == size).mapInArrow(block, _STATE)


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def step(state: DataFrame, history: list[list[np.ndarray]], cut: list[int], group: int = GROUP) -> DataFrame:
    """State rows after the round, and rows of the sums of each entry, told apart by ``kind``."""
    parts, size = len(cut) - 1, cut[-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, measured = [np.zeros(len(h[0]), np.int64) for h in history], 0
        totals = [np.zeros(h[0].shape, np.int64) for h in history]
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                x = np.frombuffer(row["vectors"], np.int32).reshape(n, size).astype(np.int64)
                groups = [-(-len(h[0]) // group) for h in history]
                code = np.frombuffer(row["codes"], np.uint8).reshape(parts, n) if row["codes"] is not None else None
                stamps = np.frombuffer(row["stamps"] or b"", np.uint8)
                bounds = np.frombuffer(row["bounds"] or b"", np.float32)
                out, at = ([], [], []), 0
                for p in range(parts):
                    wide = n * (groups[p] + 1)
                    stamp, bound = (v[at:at + wide].reshape(n, -1) if len(v) else np.zeros((0, 1), v.dtype) for v in (stamps, bounds))
                    at += wide
                    new, upper, lower, stamp, seen = assign(x[:, cut[p]:cut[p + 1]], history[p], None if code is None else code[p].astype(np.int64),
                                                            bound[:, 0].astype(float), bound[:, 1:], stamp, group)
                    measured += seen
                    members[p] += np.bincount(new, minlength=len(members[p]))
                    order = np.argsort(new, kind="stable")
                    there = np.flatnonzero(np.concatenate([[True], new[order][1:] != new[order][:-1]]))
                    totals[p][new[order][there]] += np.add.reduceat(x[order, cut[p]:cut[p + 1]], there, axis=0)
                    out[0].append(new.astype(np.uint8).tobytes())
                    out[1].append(stamp.tobytes())
                    # to 32 bits, upper bounds up and lower bounds down
                    out[2].append(np.concatenate([(upper * UP)[:, None], np.where(lower > 0, lower * DOWN, lower * UP)], axis=1).astype(np.float32).tobytes())
                codes, stamps, bounds = (b"".join(v) for v in out)
                yield _batch(_STEP, [row | {"kind": "state", "codes": codes, "stamps": stamps, "bounds": bounds}])
        sums = [{"kind": "sums", "part": p, "entry": e, "members": int(members[p][e]), "totals": totals[p][e].tolist(), "measured": 0}
                for p in range(parts) for e in np.flatnonzero(members[p]).tolist()]
        if sums:
            sums[0]["measured"] = int(measured)
            yield _batch(_STEP, sums)

    return state.mapInArrow(work, _STEP)


def moved_entries(sums: DataFrame, book: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The next codebook, and the distances measured; one row of sums for each used entry reaches the driver."""
    width = max(b.shape[1] for b in book)
    found = sums.groupBy("part", "entry").agg(F.sum("members").alias("members"), F.sum("measured").alias("measured"),
                                              *[F.sum(F.get("totals", F.lit(i))).alias(f"t{i}") for i in range(width)]).collect()
    after = [b.copy() for b in book]
    for r in found:
        after[r.part][r.entry] = [r[f"t{i}"] // r.members for i in range(book[r.part].shape[1])]
    return after, sum(r.measured for r in found)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Codes:
    """``rows`` (vec_id, label, code, error), ``codebooks`` per part, ``measured`` distances per round."""

    def __init__(self, rows: DataFrame, codebooks: list[np.ndarray], measured: list[int]) -> None:
        self.rows, self.codebooks, self.measured = rows, codebooks, measured

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(v) for b in self.codebooks for v in b.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             group: int = GROUP) -> Codes:
    """Codes of ``rows`` (vec_id, embedding, label) after ``rounds`` rounds and a last assignment.

    Vectors that are null or hold null or non-finite components take no part, nor do vectors of another length than
    that of the smallest vec_id (null ids last; ties by components). With fewer vectors than ``entries`` the codebooks
    have as many entries as there are vectors. Repeated rows and equal ids stay as rows. Parts are of equal size, the
    first ones longer by one where the length is no multiple of ``parts``; a tie goes to the lower entry, unused
    entries stay. A component of 2**18 or more raises an error. An empty table gives no rows and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is one byte")
    spark = rows.sparkSession
    good = usable(rows)
    first = first_entries(good, 1)
    size = first.shape[1] if len(first) else 0
    start = first_entries(good.where(F.size("x") == size), entries)
    cut = cuts(size, parts)
    history = [[start[:, cut[p]:cut[p + 1]]] for p in range(parts)]
    path, measured = scratch_path(spark, "codes"), []
    pack(good, size).write.parquet(path)
    state = spark.read.schema(_STATE).parquet(path)
    if not len(start):
        return Codes(_read_codes(state, history, cut), [h[0] for h in history], measured)
    for round_ in range(rounds + 1):
        after = scratch_path(spark, "codes")
        step(state, history, cut, group).write.partitionBy("kind").parquet(after)
        _remove(spark, path)
        path = after
        state = spark.read.schema(_STATE).parquet(f"{path}/kind=state")
        book, seen = moved_entries(spark.read.schema(_STEP).parquet(f"{path}/kind=sums"), [h[-1] for h in history])
        measured.append(seen)
        if round_ < rounds:
            for h, b in zip(history, book):
                h.append(b)
    return Codes(_read_codes(state, history, cut), [h[-1] for h in history], measured)


def _read_codes(state: DataFrame, history: list[list[np.ndarray]], cut: list[int]) -> DataFrame:
    parts, size = len(cut) - 1, cut[-1]
    books = [h[-1] for h in history]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                x = np.frombuffer(row["vectors"], np.int32).reshape(n, size).astype(np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(parts, n)
                error = sum(((x[:, cut[p]:cut[p + 1]] - books[p][codes[p]]) ** 2).sum(1) for p in range(parts))
                text = np.ascontiguousarray(codes.T).tobytes().hex()
                named = [np.frombuffer(row[c], np.int64).reshape(2, n) for c in ("vec_ids", "labels")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[0], mask=v[1] == 0) for v in named] + [pa.array([text[i:i + 2 * parts] for i in range(0, 2 * parts * n, 2 * parts)], pa.string()),
                                                                        pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(read, "vec_id long, label long, code string, error long")
