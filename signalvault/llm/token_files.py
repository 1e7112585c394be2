"""Token-id files: documents encoded, ordered by doc_id and stored in Simple-8b segments.

A file is a Parquet table (so that Spark's committer, and not this module, makes a lost task harmless) whose rows
are segments of about SEGMENT ids: ``part`` and ``seq`` order them, ``doc_ids`` and ``doc_tokens`` tell whose ids
they hold, ``words`` the packed ids of all these documents and ``block_starts`` the first word of each block. A
document lies in one segment.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalvault.llm import simple8b
from signalvault.llm.common import flat, slices, text_column
from signalvault.llm.units import UnitCache

SEGMENT = 1 << 18
_SEGMENTS = "part int, seq int, n_ids long, doc_ids array<long>, doc_tokens array<int>, block_starts array<int>, words binary"
_INNER = re.compile(r"(?<=\s) | (?=\s)")
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
_ALONE = "\0 "
"""Before units that are encoded as they stand; the others begin with a line feed or stand for a space and their
characters, and have no other white space."""
_ODD = np.zeros(256, bool)
_ODD[[0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
"""Bytes without which a text has no white space but spaces and line feeds."""


def byte_units(text: str, odd: bool = True) -> list[str]:
    """Parts of a text that byte-level BPE encodes independently: no token of its pattern crosses from a character
    that is no space to a single space, or a single line feed, with such a character behind it."""
    if odd or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        if odd and not _INNER.search(text):
            parts = text.split(" ")
            return [_ALONE + parts[0], *[_ALONE + " " + p for p in parts[1:]]]
        return [_ALONE + u for u in _BOUNDARY.split(text)]
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = _ALONE + parts[0]
    if not parts[-1]:
        parts[-1] = _ALONE + " "
    return parts


class ByteEncoder:
    """The tokenizers library behind a cache of units. A text that holds an added token's string is one unit, so that
    the library finds the token as in any text; all others are split, and no token is looked for."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        size = self.library.get_vocab_size()
        # a byte is one character of a byte-level piece
        self.width = np.array([len(self.library.id_to_token(i) or "") for i in range(size)])
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache = UnitCache(self._encode)

    @classmethod
    @functools.cache
    def of(cls, path: str) -> ByteEncoder:
        """One a worker process, so that later tasks find its cache filled."""
        return cls(path)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units that begin with a space or line feed follow each other in one text, as they do in a document; the
        bytes of the ids tell where each unit ends. The others are encoded one by one."""
        led = np.array([not u.startswith(_ALONE) for u in units])
        text = (" " + " ".join([u for u in units if not u.startswith(_ALONE)])).replace(" \n", "\n")
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.append(np.flatnonzero((data == 0x20) | (data == 0x0A))[1:], len(data))
        joined = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids if led.any() else [], np.uint32)
        counts = np.zeros(len(units), np.int64)
        if led.any():
            counts[led] = np.diff(np.concatenate([[0], np.searchsorted(np.cumsum(self.width[joined]), ends) + 1]))
        if led.all():
            return joined, counts
        ids = [x.ids for x in self.library.encode_batch_fast([u[len(_ALONE):] for u in units if u.startswith(_ALONE)], add_special_tokens=False)]
        counts[~led] = [len(x) for x in ids]
        flat = np.zeros(int(counts.sum()), np.uint32)
        mine = np.repeat(led, counts)
        flat[mine] = joined
        flat[~mine] = [i for x in ids for i in x]
        return flat, counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        data, offsets = flat(column)
        odd = np.diff(np.concatenate([[0], np.cumsum(_ODD[data])])[offsets]) > 0
        marked = np.zeros(len(column), bool)
        for content in self.added:
            marked |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
        units: list[str] = []
        ends = [0]
        for text, strange, whole in zip(column.to_pylist(), odd.tolist(), marked.tolist()):
            if not whole:
                units += byte_units(text, strange)
            ends.append(len(units))
        ids, lengths = self.cache.ids(units)
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[ends])
        return self._with_added(column, marked, ids, counts) if marked.any() else (ids, counts)

    def _with_added(self, column: pa.Array, marked: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of the ``marked`` texts, encoded whole, between those of the others."""
        rows = np.flatnonzero(marked)
        self.library.encode_special_tokens = False
        try:
            own = [np.array(self.library.encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in rows]
        finally:
            self.library.encode_special_tokens = True
        before = np.concatenate([[0], np.cumsum(counts)])[rows]
        pieces, at = [], 0
        for i, mine in zip(before.tolist(), own):
            pieces += [ids[at:i], mine]
            at = i
        counts = counts.copy()
        counts[rows] = [len(x) for x in own]
        return np.concatenate([*pieces, ids[at:]]).astype(np.uint32), counts


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes all texts (null: empty), appends ``end_id`` to each and writes them in ascending doc_id order (null
    first; rows of one doc_id in any order). The text is dealt by range once, before it is encoded, into as many
    parts as the session shuffles into; ids never are."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = ByteEncoder.of(tokenizer), TaskContext.get().partitionId()
        seq, docs, counts, held, total = 0, [], [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held)
            words, starts = simple8b.pack(ids)
            row = (part, seq, len(ids), docs, np.concatenate(counts).tolist(), starts.tolist(), words.tobytes())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)],
                                              ["part", "seq", "n_ids", "doc_ids", "doc_tokens", "block_starts", "words"])

        for batch in slices(batches):
            coded, lengths = encoder.encode(text_column(batch.column("text")))
            coded = np.insert(coded, np.cumsum(lengths), np.uint32(end_id))
            lengths = lengths + 1
            ends = np.cumsum(lengths)
            ids, start = batch.column("doc_id").to_pylist(), 0
            while start < len(ids):
                begin = ends[start] - lengths[start]
                stop = max(start + 1, int(np.searchsorted(ends, begin + max(1, SEGMENT - total), "right")))
                docs += ids[start:stop]
                counts.append(lengths[start:stop]), held.append(coded[begin:ends[stop - 1]])
                total += int(ends[stop - 1] - begin)
                start = stop
                if total >= SEGMENT or start < len(ids):
                    yield segment()
                    seq, docs, counts, held, total = seq + 1, [], [], [], 0
        if docs:
            yield segment()

    documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id") \
        .mapInArrow(encode, _SEGMENTS).write.option("compression", "zstd").parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """``segments`` with ``start``: how many ids the segments before hold. Parts are summed first; only one row a
    part meets in the task that adds the parts up."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    keys = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inner"))
    return keys.join(offset, "part").select("part", "seq", (F.col("part_start") + F.col("inner")).alias("start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a written path: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.unpack(np.frombuffer(row["words"], np.uint64), np.array(row["block_starts"], np.int64), row["n_ids"]).astype("<u4")
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                cut = [0, *ends.tolist()]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(counts), pa.int32()), pa.array([row["seq"]] * len(counts), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    documents = segments.mapInArrow(read, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    starts = segment_starts(segments.select("part", "seq", "n_ids"))
    return documents.join(starts, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
