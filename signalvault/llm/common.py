"""Helpers of the text operators: Arrow slices of bounded size, words, hashes, numbered blocks."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, for clusters where it is not installed."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        top = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(str(archive))


SLICE_BYTES = 1 << 20
"""Text bytes that are worked on at once; a longer text is a slice of its own."""

WORD = r"[^\x20\x09-\x0D]+"
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_random = np.random.default_rng(20240229)
_CODE = _random.integers(0, 2**64, 256, dtype=np.uint64)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[ord("A"):ord("Z") + 1] = _CODE[ord("a"):ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_ODD = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64; kept while a worker lives."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= SLICE_BYTES + 1:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray, key: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (key + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair, from one running sum."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(_INVERSE, n), out=total[1:])
    raw = (total[ends] - total[starts]) * _power(_BASE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def text_column(column: pa.Array) -> pa.Array:
    """Strings with null as the empty text."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows."""
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` text bytes, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = flat(text_column(batch.column(text)))[1]
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Returns what a task no longer needs to the system: Python workers live on for later tasks, and what they
    hold is missing to the others of their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Words:
    """Where the words of a slice lie: byte ``starts`` and ``ends``, ``row`` of each, ``counts`` of each row.

    With ``letters`` a word is a run of letters (all that is not ASCII counts as one), else what white space parts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: bool = False) -> None:
        self.data, self.offsets = data, offsets
        letter = np.ones(len(data) + 1, bool)
        np.logical_not((_NO_LETTER if letters else _BREAK)[data], out=letter[:-1])
        letter[-1] = False
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = letter[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        start = letter & ~before
        start[cuts] |= letter[cuts]
        end = before & ~letter
        end[cuts] |= before[cuts]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end)
        bounds = np.searchsorted(self.starts, offsets)
        self.first = bounds
        self.counts = np.diff(bounds)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        code = _CODE_LOWER if lower else _CODE
        return range_hash(code[self.data], self.starts, self.ends)

    def prefix_hashes(self, widths: tuple[int, ...]) -> list[np.ndarray]:
        """Of the lowered words and, before that, of their first bytes; one array for each width."""
        code = _CODE_LOWER[self.data]
        return [range_hash(code, self.starts, np.minimum(self.starts + w, self.ends)) for w in widths]


def shingles(words: Words, width: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``width`` consecutive words, sorted in each row, and the row bounds.

    A row with fewer words has one hash of all its words, a row without words none.
    """
    h, row = words.hashes(lower), words.row
    n = len(h)
    rows = len(words.counts)
    whole = max(0, n - width + 1)
    value = np.zeros(whole, np.uint64)
    for j in range(width):
        value += h[j:j + whole] * _ODD[j]
    kept = row[:whole] == row[width - 1:] if whole else np.zeros(0, bool)
    value, at = mix(value[kept]), row[:whole][kept]
    few = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(few):
        first, count = words.first[few], words.counts[few]
        short = count.astype(np.uint64) * np.uint64(_BASE)
        for j in range(width - 1):
            there = count > j
            short[there] += h[first[there] + j] * _ODD[j]
        value, at = np.concatenate([value, mix(short, 1)]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
    bounds = np.searchsorted(at, np.arange(rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1])
    return value[new], np.searchsorted(at[new], np.arange(rows + 1))


def block_number(count: int) -> int:
    """A number for the ``count``-th block of this task, the same whenever the task runs again."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 32) | count


def block_group(number: int, parts: int) -> int:
    """One of ``parts`` groups for a block; the same blocks of all tasks spread over all groups."""
    return int(mix(np.array([number], np.uint64))[0] % np.uint64(parts))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of many ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def text_bytes(documents: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of all texts; one pass over the text column."""
    row = documents.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def with_column(documents: DataFrame, name: str, kind: str) -> tuple[DataFrame, StructType]:
    """``documents`` without a column ``name``, and the schema with a new one behind the others."""
    rest = documents.drop(*[c for c in documents.columns if c.lower() == name.lower()])
    return rest, StructType([*rest.schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])


def free_name(documents: DataFrame, name: str) -> str:
    """``name``, with underscores in front where a column has it already."""
    while name.lower() in [c.lower() for c in documents.columns]:
        name = f"_{name}"
    return name


def power_of_two(x: float) -> int:
    """The smallest power of two that is not below ``x``."""
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def hex_sha256(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
