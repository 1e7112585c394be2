"""Substring dedup by prefix-partitioned suffix trees over words.

The suffixes of all texts, cut at the window of ``length`` words, form a tree whose inner nodes at that depth are the
windows that start in more than one place. No task could hold the tree, so suffixes are split by their prefix into
subtrees of bounded size: the prefix is PREFIX words long, and the whole window for prefixes so frequent that their
subtree would outgrow a task (found in a bounded sample; any choice of them gives the same result). A suffix is
sent as its path in the subtree, a hash of 64 bits of all words of the window, and its place; sorting the paths lays
out the subtree, and paths that two suffixes share are its deep inner nodes. Windows that begin alike are told apart
by all 64 bits, others by log2(subtrees) more, which grow with the data.

Texts are worked on in blocks of about BLOCK_WORDS words. A window that a block has several times is sent once, so
a passage in a third of all documents makes one path a block, and the block itself marks all its places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalvault.llm.common import (Words, block_group, block_number, flat, power_of_two, ragged, range_hash, slices,
                                    text_bytes, text_column)

PREFIX = 8
BLOCK_WORDS = 1 << 19
GROUP_BYTES = 8 << 20
"""Text bytes whose suffixes make one subtree."""
SAMPLE_ROWS = 4096
HOT_SHARE = 1 / 128
_INSIDE = 0
"""Place of a path that its block has several times; other places count from 1."""

_SENT = "pid long, block long, meta boolean, n_words long, paths binary, places binary"
_REPLY = "block long, n_words long, places binary"
_BLOCK = "block long, doc_ids array<long>, sizes binary, texts binary"
_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[pa.RecordBatch, Words]]]]:
    """The same blocks of slices whenever the same rows come in the same order."""
    count, held, total = 0, [], 0
    for part in slices(batches):
        words = Words(*flat(text_column(part.column("text"))))
        held.append((part, words))
        total += len(words.row)
        if total >= BLOCK_WORDS:
            yield block_number(count), held
            count, held, total = count + 1, [], 0
    if held:
        yield block_number(count), held


def _spread(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of sorted or small integers, high bytes first and together, so that they compress."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:].T).tobytes()


def _gathered(data: bytes, count: int) -> np.ndarray:
    """The integers that ``_spread`` wrote."""
    width = len(data) // count if count else 8
    out = np.zeros((count, 8), np.uint8)
    out[:, 8 - width:] = np.frombuffer(data, np.uint8).reshape(width, count).T
    return out.view(">u8").ravel().astype(np.uint64)


def _windows(words: Words, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, prefix hash and path of every window."""
    h, row = words.hashes(), words.row
    count = max(0, len(h) - length + 1)
    start = np.flatnonzero(row[:count] == row[length - 1:]) if count else np.zeros(0, np.int64)
    return start, range_hash(h, start, start + min(prefix, length)), range_hash(h, start, start + length)


def frequent_prefixes(documents: DataFrame, length: int, rows: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Sorted hashes of prefixes that make more than HOT_SHARE as many suffixes as a sample has texts. At most
    1 / HOT_SHARE times the mean number of words: the bound of what the tasks are given."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = _windows(Words(*flat(text_column(part.column("text")))), length, PREFIX)[1]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    part = documents.sample(min(1.0, sample_rows / max(1, rows)), seed=11)
    least = max(32, int(min(rows, sample_rows) * HOT_SHARE))
    found = part.mapInArrow(count, "h long").groupBy("h").count().where(F.col("count") >= least).select("h").collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


def _send(length: int, parts: int, frequent: np.ndarray) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _blocks(batches):
            starts, pids, paths, base = [], [], [], 0
            for _, words in held:
                start, prefix, path = _windows(words, length, PREFIX)
                if len(frequent) and len(prefix):
                    often = frequent[np.minimum(np.searchsorted(frequent, prefix), len(frequent) - 1)] == prefix
                    prefix = np.where(often, path * np.uint64(0x9E3779B97F4A7C15), prefix)
                starts.append((start + base).astype(np.uint32)), paths.append(path)
                pids.append((prefix >> np.uint64(32)) % np.uint64(parts))
                base += len(words.row)
            start, path, pid = np.concatenate(starts), np.concatenate(paths), np.concatenate(pids).astype(np.uint32)
            order = np.argsort(path)
            order = order[np.argsort(pid[order], kind="stable")]
            start, path, pid = start[order], path[order], pid[order]
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (pid[1:] != pid[:-1])
            first = np.flatnonzero(new)
            several = np.diff(np.append(first, len(path))) > 1
            inside = np.repeat(several, np.diff(np.append(first, len(path))))
            place = np.where(several, _INSIDE, start[first].astype(np.int64) + 1)
            width = (base.bit_length() + 7) // 8
            path, pid = path[first], pid[first]
            out = [(block_group(number, parts), number, True, base, None, start[inside].tobytes())]
            cut = np.searchsorted(pid, np.arange(parts + 1)).tolist()
            out += [(p, number, False, base, _spread(path[a:b], 8), _spread(place[a:b], width)) for p, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["pid", "block", "meta", "n_words", "paths", "places"])

    return send


def _subtree(group: pa.Table) -> pa.Table:
    """Places of one subtree whose suffixes end in an inner node, for the blocks that sent them."""
    rows = group.to_pylist()
    sent = [r for r in rows if not r["meta"]]
    out = [(r["block"], r["n_words"], r["places"]) for r in rows if r["meta"]]
    if sent:
        path = np.concatenate([_gathered(r["paths"], len(r["paths"]) // 8) for r in sent])
        order = np.argsort(path)
        path = path[order]
        same = path[1:] == path[:-1]
        shared = np.zeros(len(path), bool)
        shared[1:] |= same
        shared[:-1] |= same
        leaf = np.zeros(len(path), bool)
        leaf[order[shared]] = True
        start = 0
        for r in sent:
            place = _gathered(r["places"], len(r["paths"]) // 8)
            mine = place[leaf[start:start + len(place)] & (place != _INSIDE)]
            start += len(place)
            if len(mine):
                out.append((r["block"], r["n_words"], (mine - np.uint64(1)).astype(np.uint32).tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), kinds)], ["block", "n_words", "places"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for number, held in _blocks(batches):
        ids = [i for part, _ in held for i in part.column("doc_id").to_pylist()]
        sizes = np.concatenate([np.diff(w.offsets) for _, w in held]).astype(np.uint32)
        texts = packer.compress(b"".join(w.data.tobytes() for _, w in held))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, ids, sizes.tobytes(), texts), kinds)], ["block", "doc_ids", "sizes", "texts"])


def _remove(length: int) -> Callable:
    def remove(texts: pa.Table, replies: pa.Table) -> pa.Table:
        import zstandard

        names = ["doc_id", "n_words", "n_removed", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        out = []
        for row in texts.to_pylist():
            size = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(size)])
            data = np.frombuffer(zstandard.decompress(row["texts"]), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
            words = Words(data, offsets)
            n = len(words.row)
            if any(x != n for x in replies.column("n_words").to_pylist()):
                raise RuntimeError("the documents came in another order when they were read again")
            cover = np.zeros(n + length + 1, np.int32)
            place = np.concatenate([np.frombuffer(x, np.uint32) for x in replies.column("places").to_pylist()]).astype(np.int64)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length, -1)
            gone = np.cumsum(cover)[:n] > 0
            removed = np.bincount(words.row[gone], minlength=len(size))
            kept = np.flatnonzero(~gone)
            width = words.ends[kept] - words.starts[kept] + 1
            joined = np.append(data, np.uint8(0x20))[ragged(words.starts[kept], width)]
            ends = np.cumsum(width)
            joined[ends - 1] = 0x20
            cut = np.concatenate([[0], ends])[np.searchsorted(words.row[kept], np.arange(len(size) + 1))].tolist()
            joined = joined.tobytes()
            texts_kept = [joined[a:max(a, b - 1)] for a, b in zip(cut, cut[1:])]
            out.append(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(
                (row["doc_ids"], words.counts, removed, pa.array(texts_kept, pa.binary()).cast(pa.string())), kinds)], names))
        return pa.concat_tables(out) if out else pa.schema(list(zip(names, kinds))).empty_table()

    return remove


def remove_repeats(documents: DataFrame, length: int = 35) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_removed and ``kept``, the remaining words joined by spaces.

    Removed is each word ``[^\\x20\\x09-\\x0D]+`` that a window of ``length`` words covers whose words also start anywhere
    else, in the same text too; windows are judged on the input. Repeated rows are two places of their words. A null
    or empty text has no words; a text of fewer than ``length`` words keeps all. ``documents`` is read more than once
    and must give the same rows in the same order, as files do; otherwise the job fails.
    """
    rows, size = text_bytes(documents)
    parts = max(8, power_of_two(size / GROUP_BYTES))
    given = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    frequent = frequent_prefixes(given, length, rows)
    replies = given.mapInArrow(_send(length, parts, frequent), _SENT).groupBy("pid").applyInArrow(_subtree, _REPLY)
    texts = given.mapInArrow(_pack, _BLOCK)
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_remove(length), _KEPT)
