"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most d bits differ in at most d of their 8 bytes, so they share at least
8 - d bytes at the same positions. The index lists fingerprints by (position, byte); the pairs of its lists are tallied,
those with 8 - d shared bytes or more are kept, and their bits are compared.

A list of one byte holds a 256th of everything, so the index is dealt into cells first. The 8 positions are parted
into 7 - d groups: of 8 - d shared bytes, two lie in one group. Each pair of positions inside a group makes a cell of
each pair of byte values (7 cells a fingerprint for d = 4), and a pair that can link meets in at least one of them.

1. ``fingerprints``: one narrow pass over the texts.
2. Equal fingerprints are one node; only distinct ones go on.
3. Cells of up to CELL fingerprints are packed into tasks, where the lists of the other positions are tallied.
4. The few larger cells are cut by all 8 - d shared bytes (70 ways at most), so the tally is met by construction.
5. A cell still larger than CELL shares 8 - d bytes among very many fingerprints. Two of them are d bits apart or less
   just if a value lies d / 2 bits from both: each lists the values around it, and equal values link. No list of values
   is longer than the values around one, so nothing there grows with the cell.

No step makes a row for a pair that fails, and a task returns a spanning forest of its links, not all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalvault.llm.common import Words, flat, ragged, slices, text_column
from signalvault.llm.components import components
from signalvault.session import cut_lineage

SEED = 42
CELL = 2048
"""Fingerprints of a cell that are tallied together; larger cells are cut further."""
TASK_ROWS = 1 << 18
CHUNK = 1 << 16
PAIRS = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the texts in ``data``: bit b is 1 where more than half of the shingles' hashes have it."""
    words = Words(data, offsets)
    lengths = words.ends - words.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    joined[ragged(starts, lengths)] = _LOWER[data[ragged(words.starts, lengths)]]
    buffer = joined.tobytes()
    has = np.flatnonzero(words.counts > 0)
    n = np.maximum(words.counts[has] - width + 1, 1)
    first = ragged(words.first[has], n)
    last = first + np.repeat(np.minimum(words.counts[has], width) - 1, n)
    row, start, end = np.repeat(np.arange(len(has)), n), starts[first], ends[last]
    ones = np.zeros((len(has), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(row), CHUNK):
        part = row[at:at + CHUNK]
        spans = zip(start[at:at + CHUNK].tolist(), end[at:at + CHUNK].tolist())
        h = np.array([digest(buffer[a:b], SEED) for a, b in spans], np.uint64)
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[part[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    out = np.zeros(len(words.counts), np.uint64)
    out[has] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, bits) of each row of ``documents``."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = text_fingerprints(*flat(text_column(part.column("text"))), width)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "bits"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, bits long")


def position_pairs(distance: int) -> list[tuple[int, int]]:
    """Pairs of byte positions of which any ``8 - distance`` positions hold at least one."""
    groups = 7 - distance
    return [pair for g in range(groups) for pair in combinations(range(g, 8, groups), 2)]


def position_sets(distance: int) -> list[tuple[int, list[tuple[int, ...]]]]:
    """For each pair, the sets of ``8 - distance`` positions that no earlier pair is in."""
    pairs, given, out = position_pairs(distance), set(), []
    for i, pair in enumerate(pairs):
        mine = [s for s in combinations(range(8), 8 - distance) if set(pair) <= set(s) and s not in given]
        given.update(mine)
        out.append((i, mine))
    return out


def _key(number: int, positions: tuple[int, ...]) -> list[Column]:
    """The number of a kind of cell, and the bytes at its positions side by side."""
    value = F.lit(0).cast("long")
    for p in positions:
        value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned("bits", 8 * p).bitwiseAND(0xFF))
    return [F.lit(number).alias("kind"), value.alias("value")]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect, each node with the least of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def tally(kind: np.ndarray, value: np.ndarray, bits: np.ndarray, known: list[tuple[int, ...]], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of the same cell (kind, value), whose bytes at ``known[kind]`` are equal."""
    order = np.lexsort((bits, value, kind))
    kind, value, bits = kind[order], value[order], bits[order]
    first = np.concatenate([[True], (kind[1:] != kind[:-1]) | (value[1:] != value[:-1])])
    size = np.diff(np.append(np.flatnonzero(first), len(kind)))
    many = np.repeat(size > 1, size)
    kind, bits, cell = kind[many], bits[many], np.repeat(np.arange(len(size)), size)[many]
    need = 8 - distance - len(known[0])
    held = bits.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
    lists = []  # the inverted index: members of each list, one list after another
    for p in range(8) if need else []:
        rows = np.flatnonzero(np.array([p not in k for k in known])[kind])
        lists.append((rows, (cell[rows] * 8 + p) * 256 + held[rows, p]))
    if not need:
        lists.append((np.arange(len(cell)), cell))
    member, number = (np.concatenate(x) for x in zip(*lists))
    order = np.lexsort((member, number))
    member, number = member[order], number[order]
    if not len(member):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    last = np.concatenate([np.flatnonzero(number[1:] != number[:-1]), [len(number) - 1]])
    later = np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(len(number))
    # a pair comes from up to 8 lists and must be tallied at once: chunks take all lists of a range of first members
    by_low = np.argsort(member, kind="stable")
    lows, cost = member[by_low], np.cumsum(later[by_low])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(by_low):
        end = int(np.searchsorted(cost, (cost[start - 1] if start else 0) + PAIRS, "right"))
        end = int(np.searchsorted(lows, lows[max(end, start + 1) - 1], "right"))
        take = by_low[start:end]
        start = end
        left = np.repeat(member[take], later[take])
        right = member[ragged(take + 1, later[take])]
        pair, count = np.unique(left * np.int64(len(bits)) + right, return_counts=True)
        pair = pair[count >= max(1, need)]
        x, y = bits[pair // len(bits)], bits[pair % len(bits)]
        near = np.bitwise_count(x ^ y) <= distance
        found.append(forest(x[near], y[near]))
    return forest(*(np.concatenate(x) for x in zip(*found)))


def _arrow_links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    held = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(n).to_numpy() for b in held]) if held else np.zeros(0, np.int64) for n in names]


def _tallied(cells: DataFrame, rows: int, known: list[tuple[int, ...]], distance: int) -> DataFrame:
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, value, bits = _columns(batches, "kind", "value", "bits")
        if len(kind):
            yield _arrow_links(*tally(kind, value, bits.view(np.uint64), known, distance))

    return cells.repartition(1 + rows // TASK_ROWS, "kind", "value").mapInArrow(link, "a long, b long")


def _midpoints(hot: DataFrame, rows: int, sets: list[tuple[int, ...]], distance: int) -> DataFrame:
    """Links of the fingerprints of hot cells: over values half the distance from both, outside the bytes they share."""
    near = []
    for s in sets:
        free = [8 * p + b for p in range(8) if p not in s for b in range(8)]
        flips = [sum(1 << b for b in c) for r in range(distance // 2 + 1) for c in combinations(free, r)]
        near.append(np.array(flips, np.uint64))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, bits = batch.column("kind").to_numpy(), batch.column("bits").to_numpy().view(np.uint64)
            for kind in np.unique(kinds):
                mine = bits[kinds == kind]
                for at in range(0, len(mine), 1024):
                    part = mine[at:at + 1024]
                    points = (part[:, None] ^ near[kind][None, :]).ravel()
                    yield _arrow_links(points, np.repeat(part, len(near[kind])))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, bits = (x.view(np.uint64) for x in _columns(batches, "a", "b"))
        if len(point):
            order = np.lexsort((bits, point))
            point, bits = point[order], bits[order]
            same = np.flatnonzero(point[1:] == point[:-1])
            yield _arrow_links(*forest(bits[same], bits[same + 1]))

    points = hot.mapInArrow(around, "a long, b long").distinct()
    return points.repartition(1 + rows * max(map(len, near)) // TASK_ROWS, "a").mapInArrow(link, "a long, b long")


def fingerprint_links(distinct: DataFrame, distance: int = 4, cell: int = CELL) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``bits`` that connect all those at ``distance`` bits or fewer.

    ``distance`` is 2 or 4: half of it reaches the values between two fingerprints of a hot cell.
    """
    if distance not in (2, 4):
        raise ValueError("distance is 2 or 4")
    pairs, sets = position_pairs(distance), position_sets(distance)
    count = distinct.count()

    def cells(rows: DataFrame, keys: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(*_key(n, p)) for n, p in keys]))
        return rows.select("bits", each.alias("cell")).select("cell.kind", "cell.value", "bits")

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of cells to tally and of cells that are too large."""
        large = cut_lineage(rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select("kind", "value"))
        return rows.join(large, ["kind", "value"], "left_anti"), rows.join(large, ["kind", "value"], "left_semi")

    small, large = parted(cells(distinct, list(enumerate(pairs))))
    links = cut_lineage(_tallied(small, count * len(pairs), pairs, distance))
    large = cut_lineage(large)
    left = large.count()
    if not left:
        return links
    whole = [s for _, mine in sets for s in mine]
    cut = []
    for kind, mine in sets:
        if mine:
            cut.append(cells(large.where(F.col("kind") == kind), [(whole.index(s), s) for s in mine]))
    cut_cells = cut[0]
    for more in cut[1:]:
        cut_cells = cut_cells.union(more)
    cut_cells = cut_lineage(cut_cells)
    small, hot = parted(cut_cells)
    links = links.union(cut_lineage(_tallied(small, cut_cells.count(), whole, distance)))
    hot = cut_lineage(hot)
    held = hot.count()
    return links.union(cut_lineage(_midpoints(hot, held, whole, distance))) if held else links


def simhash_classes(documents: DataFrame, width: int = 4, distance: int = 4, cell: int = CELL) -> DataFrame:
    """One row per row of ``documents``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over fingerprints at ``distance`` bits or fewer, the row's own
    included. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; shingles of ``width`` words, repeats included, joined
    by one space, are hashed by XXH64 with seed 42. A text with fewer words is one shingle; a null, empty or wordless
    text has the fingerprint zero and links like any other. Repeated rows stay and share a component; a row without
    doc_id links too, its component is null where no row of it has one. Texts are hashed in chunks, so a very long one
    needs memory for its bytes only. An empty table gives no rows; further columns are not read.
    """
    found = cut_lineage(fingerprints(documents, width))
    distinct = cut_lineage(found.groupBy("bits").agg(F.min("doc_id").alias("least")))
    linked = cut_lineage(components(fingerprint_links(distinct.select("bits"), distance, cell)))
    grouped = distinct.join(linked, distinct.bits == linked.node, "left").select("bits", "least", F.coalesce("component", "bits").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut_lineage(grouped.join(least, "root").select("bits", "component_id"))
    return found.join(classes, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
