"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A model file gives the pieces and their scores. Text units that no piece crosses (spaces, then other
characters) are independent, so every distinct unit of a slice is encoded once: all symbols lie in one flat array;
each round finds the best-ranked pair of every unit (segmented minimum), merges its leftmost place in all units at
once, compacts the array and drops the units without a pair. One merge a unit and round keeps the library's order
exactly, also where a merge creates a better pair. Units of more than LONG characters take the same ranks through a
priority queue, since rounds over them would be quadratic.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalvault.llm.common import ragged, slices, text_column, with_column
from signalvault.llm.units import UnitCache

LONG = 200
SPACE = "▁"
_NONE = np.int64(1) << 40


class PieceModel:
    """Tables of one model file. Needs identity normalisation with a dummy prefix and byte fallback; checks it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(size)]
        self.bos, self.eos, self.unk = library.bos_id(), library.eos_id(), library.unk_id()
        plain = [not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)) for i in range(size)]
        known = {p: i for i, p in enumerate(pieces) if plain[i]}
        if any(SPACE in p.lstrip(SPACE) for p in known) or any(library.is_unused(i) for i in range(size)):
            raise ValueError("a piece crosses a space or is unused: the units would not be independent")
        probe = "AÄ ﬁ①Ａ"
        if library.decode(library.encode(probe)) != probe or library.encode("a b") != library.encode("a b ")[:-1]:
            raise ValueError("the model normalises its text")
        byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if library.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.byte_id = np.array([byte[b] for b in range(256)], np.uint32)
        self.size = size
        self.symbol = np.arange(size, size + 0x110000, dtype=np.int64)  # a character without a piece: size + code point
        for p, i in known.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        rank = {s: r for r, s in enumerate(sorted({library.get_score(i) for i in known.values()}, reverse=True))}
        pairs = []
        for p, i in known.items():
            for cut in range(1, len(p)):
                left, right = self._side(p[:cut], known), self._side(p[cut:], known)
                if left is not None and right is not None:
                    pairs.append(((left << 32) | right, rank[library.get_score(i)], i))
        pairs.sort()
        self.pair, self.rank, self.merged = (np.array([x[k] for x in pairs], np.int64) for k in range(3))
        surface = [p.replace(SPACE, " ").encode() if plain[i] else bytes([int(p[3:5], 16)]) if library.is_byte(i)
                   else " ⁇ ".encode() if i == self.unk else b"" for i, p in enumerate(pieces)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_end = np.cumsum([len(x) for x in surface])
        self.surface_start = self.surface_end - [len(x) for x in surface]
        self.leads_space = np.array([plain[i] and p.startswith(SPACE) for i, p in enumerate(pieces)])
        self.is_control = np.array([library.is_control(i) for i in range(size)])

        self.cache = UnitCache(self.encode_units, limit=150_000)

    @classmethod
    @functools.cache
    def of(cls, path: str) -> PieceModel:
        """One a worker process, so that later tasks find its cache filled."""
        return cls(path)

    def _side(self, text: str, known: dict[str, int]) -> int | None:
        return known.get(text, self.size + ord(text) if len(text) == 1 else None)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; rank _NONE where the pair is no piece."""
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        there = self.pair[at] == key
        return np.where(there, self.rank[at], _NONE), self.merged[at]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, each without its first space sign (``SPACE`` goes before every unit)."""
        points = np.frombuffer((SPACE + SPACE.join(u.replace(" ", SPACE) for u in units)).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, units), np.int64, len(units)) + 1
        symbol = self.symbol[points]
        starts = np.cumsum(lengths) - lengths
        out: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        long = np.flatnonzero(lengths > LONG)
        for u in long.tolist():
            done = self._queue(symbol[starts[u]:starts[u] + lengths[u]].tolist())
            out.append(np.array(done, np.int64)), owner.append(np.full(len(done), u))
        if len(long):
            short = np.flatnonzero(lengths <= LONG)
            symbol, unit = symbol[ragged(starts[short], lengths[short])], np.repeat(short, lengths[short])
        else:
            unit = np.repeat(np.arange(len(units)), lengths)
        rank, merged = self._pairs(symbol, unit, None)
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(unit)))
            ended = best >= _NONE
            if ended.any():
                gone = np.repeat(ended, size)
                out.append(symbol[gone]), owner.append(unit[gone])
                stay = ~gone
                symbol, unit, rank, merged, best, size = symbol[stay], unit[stay], rank[stay], merged[stay], best[~ended], size[~ended]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.concatenate([[True], unit[at[1:]] != unit[at[:-1]]])]
            symbol[at] = merged[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # places after compaction
            symbol, unit, rank, merged = symbol[stay], unit[stay], rank[stay], merged[stay]
            near = np.concatenate([at, at[at > 0] - 1])
            self._pairs(symbol, unit, (near, rank, merged))
        flat, at = np.concatenate(out), np.concatenate(owner)
        order = np.argsort(at, kind="stable")
        return self._fall_back(flat[order], at[order], len(units))

    def _pairs(self, symbol: np.ndarray, unit: np.ndarray, part: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        if part is None:
            rank, merged = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)
            near = np.arange(len(symbol) - 1)
        else:
            near, rank, merged = part
            rank[near] = _NONE
            near = near[near < len(symbol) - 1]
        near = near[unit[near] == unit[near + 1]]
        rank[near], merged[near] = self.look_up(symbol[near], symbol[near + 1])
        return rank, merged

    def _queue(self, symbol: list[int]) -> list[int]:
        n = len(symbol)
        after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        rank, merged = self.look_up(np.array(symbol[:-1], np.int64), np.array(symbol[1:], np.int64))
        heap = [(r, i, 0, 0, m) for i, (r, m) in enumerate(zip(rank.tolist(), merged.tolist())) if r < _NONE]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, vi, vj, piece = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or version[i] != vi or j >= n or version[j] != vj:
                continue
            symbol[i], alive[j], after[i] = piece, False, after[j]
            version[i] += 1
            version[j] += 1
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n:
                    r, m = self.look_up(np.array([symbol[a]]), np.array([symbol[b]]))
                    if r[0] < _NONE:
                        heapq.heappush(heap, (int(r[0]), a, version[a], version[b], int(m[0])))
        return [s for s, a in zip(symbol, alive) if a]

    def _fall_back(self, flat: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the ids of their bytes."""
        odd = np.flatnonzero(flat >= self.size)
        if not len(odd):
            return flat.astype(np.uint32), np.bincount(unit, minlength=units)
        spelled = {p: self.byte_id[np.frombuffer(chr(p).encode("utf-8", "surrogatepass"), np.uint8)] for p in np.unique(flat[odd] - self.size).tolist()}
        width = np.ones(len(flat), np.int64)
        width[odd] = [len(spelled[p]) for p in (flat[odd] - self.size).tolist()]
        out = np.repeat(flat, width).astype(np.uint32)
        end = np.cumsum(width)
        for i, p in zip(odd.tolist(), (flat[odd] - self.size).tolist()):
            out[end[i] - width[i]:end[i]] = spelled[p]
        return out, np.bincount(np.repeat(unit, width), minlength=units)

    def decode(self, flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of the ids flat[bounds[i]:bounds[i + 1]]; control ids are silent, the first space of a text goes."""
        width = (self.surface_end - self.surface_start)[flat]
        data = self.surface[ragged(self.surface_start[flat], width)].tobytes()
        end = np.concatenate([[0], np.cumsum(width)])[bounds].tolist()
        heard = np.flatnonzero(~self.is_control[flat])
        first = np.searchsorted(heard, bounds[:-1])
        out = []
        for a, b, i, stop in zip(end, end[1:], first.tolist(), bounds[1:].tolist()):
            skip = i < len(heard) and heard[i] < stop and self.leads_space[flat[heard[i]]]
            out.append(data[a + bool(skip):b])
        return out


def text_units(text: str) -> list[str]:
    """Units of a text: each stands for one space sign and its own characters, leading spaces included."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, held = [], ""
    for part in parts[:-1]:
        if part:
            out.append(held + part)
            held = ""
        else:
            held += " "
    out.append(held + parts[-1])
    return out


def encode_texts(cache: UnitCache, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another (no begin or end id), and the bounds of each."""
    units: list[str] = []
    counts = []
    for text in texts:
        own = text_units(text)
        counts.append(len(own))
        units += own
    flat, lengths = cache.ids(units)
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    return flat, ends


def encode_documents(documents: DataFrame, model: str, ends: bool = True, text: str = "text", name: str = "ids") -> DataFrame:
    """All columns of ``documents`` and ``name`` (array<int>, in place of one of that name); ``model`` is a path that
    every executor has. Null and empty texts have the begin and end ids alone."""
    documents, schema = with_column(documents, name, "array<int>")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model)
        for part in slices(batches, text):
            flat, bounds = encode_texts(pieces.cache, text_column(part.column(text)).to_pylist())
            if ends:
                flat = np.insert(flat, np.stack([bounds[:-1], bounds[1:]], 1).ravel(), np.tile([pieces.bos, pieces.eos], len(bounds) - 1))
                bounds = bounds + 2 * np.arange(len(bounds))
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, name])

    return documents.mapInArrow(encode, schema)


def round_trip(documents: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, with begin and end ids. A null text is the empty one,
    whose ids are the begin and end alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model)
        begin, end = (np.uint32(x).tobytes() for x in (pieces.bos, pieces.eos))
        for part in slices(batches):
            flat, bounds = encode_texts(pieces.cache, text_column(part.column("text")).to_pylist())
            cut = bounds.tolist()
            hashed = [hashlib.sha256(begin + flat[a:b].tobytes() + end).hexdigest() for a, b in zip(cut, cut[1:])]
            decoded = [hashlib.sha256(x).hexdigest() for x in pieces.decode(flat, bounds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds) + 2), pa.array(hashed), pa.array(decoded)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
