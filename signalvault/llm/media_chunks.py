"""Media columns by content-defined chunking.

A payload is stored as an 8-bit mono WAV file. Its samples are cut where a rolling gear hash of the last 32 bytes has
a run of zero bits, so equal stretches of different media make equal chunks wherever they lie. Spark joins on chunk
digests find the chunks that several media have; each is stored once, with the first medium that has it, and every
medium keeps an ordered list of its chunks. Reading joins the chunks a medium does not hold itself, puts the list
together and verifies every digest.

A medium is known by 128 bits of the sha256 of its payload, so equal payloads are one medium however many rows hold them.
Bytes move only once before they are stored, compressed; on reading only chunks that others hold move.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalvault.llm.common import flat, slices, text_column
from signalvault.session import cut_lineage

UNIT = 192
LEAST, MEAN_BITS, MOST = 1024, 12, 16384
DIGEST = 16
"""Bytes of sha256 that name a chunk or a medium."""
RATE = 8000
SLICE = 1 << 20
ROWS = 100
"""Media that a task has unpacked at once."""
ROW_GROUP = 8 << 20
"""Bytes of the store that a writer holds before it compresses them."""

_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
_CHUNK = "struct<digest:binary,size:int>"
_STORE = "media_id binary, header binary, recipe array<struct<digest:binary,size:int,own:boolean,shared:boolean>>, held binary"
_FEATURES = "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _name(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:DIGEST]


def payload_of(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def wav_header(size: int) -> bytes:
    """RIFF header of ``size`` unsigned 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)


def gear(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes up to each place: sum of gear[byte] << age."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
    return h


def cuts(marks: list[int], size: int) -> list[int]:
    """Ends of the chunks of a payload: at a mark at least LEAST behind the last end, after MOST at the latest."""
    out, last = [], 0
    for mark in [*marks, size]:
        while mark - last > MOST:
            last += MOST
            out.append(last)
        if mark - last >= LEAST or mark == size and mark > last:
            out.append(mark)
            last = mark
    return out


def _payloads(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    texts = part.column("text")
    data, offsets = flat(text_column(texts))
    whole, cut = data.tobytes(), offsets.tolist()
    return [payload_of(whole[a:b]) for a, b in zip(cut, cut[1:])], np.diff(offsets)


def _chunked(payloads: list[bytes]) -> list[list[int]]:
    data = np.frombuffer(b"".join(payloads), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    places = np.flatnonzero((gear(data) >> np.uint32(32 - MEAN_BITS)) == 0) + 1
    first = np.searchsorted(places, bounds, "right")
    return [cuts([m - base for m in places[a:b].tolist() if m - base < len(p)], len(p))
            for p, base, a, b in zip(payloads, bounds.tolist(), first[:-1].tolist(), first[1:].tolist())]


def _catalog(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32())]))]
    for part in slices(batches, limit=SLICE):
        payloads, sizes = _payloads(part)
        ids, lists = [], []
        for payload, ends in zip(payloads, _chunked(payloads)):
            ids.append(_name(payload))
            lists.append([{"digest": _name(payload[a:b]), "size": b - a} for a, b in zip([0, *ends], ends)])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), *[pa.array(x, t) for x, t in zip((ids, lists), kinds)]],
                                         ["doc_id", "n_bytes", "media_id", "chunks"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=6)
    for part in slices(batches, limit=SLICE):
        media = {_name(p): p for p in _payloads(part)[0]}
        yield pa.RecordBatch.from_arrays([pa.array(list(media), pa.binary()), pa.array([packer.compress(p) for p in media.values()], pa.binary())], ["media_id", "packed"])


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the store: the chunks a medium holds itself, one after another."""
    import zstandard

    kinds = [pa.binary(), pa.binary(), pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("own", pa.bool_()), ("shared", pa.bool_())])), pa.binary()]
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            out = []
            for row in batch.slice(start, ROWS).to_pylist():
                payload, at, held = zstandard.decompress(row["packed"]), 0, []
                for chunk in row["recipe"]:
                    if chunk["own"]:
                        held.append(payload[at:at + chunk["size"]])
                    at += chunk["size"]
                out.append((row["media_id"], wav_header(len(payload)), row["recipe"], b"".join(held)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], [], []), kinds)], ["media_id", "header", "recipe", "held"])


def catalog(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes of its text, media_id, chunks (digest, size) in order."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")) \
        .mapInArrow(_catalog, f"doc_id long, n_bytes long, media_id binary, chunks array<{_CHUNK}>")


def write_store(documents: DataFrame, known: DataFrame, path: str) -> None:
    """Stores all media of ``documents``, every chunk once; ``known`` is their catalog."""
    media = known.select("media_id", "chunks").dropDuplicates(["media_id"])
    recipes = cut_lineage(media.select("media_id", F.posexplode("chunks").alias("seq", "chunk")).select("media_id", "seq", "chunk.digest", "chunk.size"))
    holders = recipes.groupBy("digest").agg(F.min(F.struct("media_id", "seq")).alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "holder")
    own = F.col("holder").isNull() | ((F.col("holder.media_id") == F.col("media_id")) & (F.col("holder.seq") == F.col("seq")))
    plans = recipes.join(holders, "digest", "left") \
        .select("media_id", F.struct("seq", "digest", "size", own.alias("own"), F.col("holder").isNotNull().alias("shared")).alias("chunk")) \
        .groupBy("media_id").agg(F.array_sort(F.collect_list("chunk")).alias("chunks")) \
        .select("media_id", F.transform("chunks", lambda c: F.struct(c.digest.alias("digest"), c.size.alias("size"), c.own.alias("own"), c.shared.alias("shared"))).alias("recipe"))
    packed = documents.select(F.col("text").cast("string")).mapInArrow(_pack, "media_id binary, packed binary").dropDuplicates(["media_id"])
    packed.join(plans, "media_id").select("media_id", "packed", "recipe").mapInArrow(_hold, _STORE) \
        .write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).option("parquet.compression.codec.zstd.level", "6").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per medium: its verified payload and stored form, described. A chunk that is missing or differs fails the job."""
    store = spark.read.schema(_STORE).parquet(path)
    lends, borrows = F.exists("recipe", lambda c: c.own & c.shared), F.exists("recipe", lambda c: ~c.own)

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out = []
            for row in part.to_pylist():
                at = 0
                for chunk in row["recipe"]:
                    if chunk["own"]:
                        if chunk["shared"]:
                            out.append((chunk["digest"], row["held"][at:at + chunk["size"]]))
                        at += chunk["size"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (zip(*out) if out else ([], []))], ["digest", "data"])

    lent = store.where(lends).select("recipe", "held").mapInArrow(lend, "digest binary, data binary")
    wanted = store.where(borrows).select("media_id", F.explode(F.array_distinct(F.transform(F.filter("recipe", lambda c: ~c.own), lambda c: c.digest))).alias("digest"))
    found = wanted.join(lent, "digest").groupBy("media_id").agg(F.collect_list(F.struct("digest", "data")).alias("borrowed"))
    full = store.where(~borrows).withColumn("borrowed", F.array().cast("array<struct<digest:binary,data:binary>>"))
    rest = store.where(borrows).join(found, "media_id", "left")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                out = [_described(row) for row in batch.slice(start, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, kinds)], names)

    return full.unionByName(rest.select(*full.columns)).mapInArrow(describe, _FEATURES)


def restore(row: dict) -> bytes:
    """The stored form of a medium from its list of chunks."""
    borrowed = {x["digest"]: x["data"] for x in row["borrowed"] or ()}
    parts, at = [], 0
    for chunk in row["recipe"]:
        if chunk["own"]:
            data = row["held"][at:at + chunk["size"]]
            at += chunk["size"]
        else:
            data = borrowed.get(chunk["digest"], b"")
        if len(data) != chunk["size"] or _name(data) != chunk["digest"]:
            raise ValueError(f"chunk {chunk['digest'].hex()} of medium {row['media_id'].hex()} is missing or damaged")
        parts.append(data)
    return row["header"] + b"".join(parts)


def _described(row: dict) -> tuple:
    media = restore(row)
    payload = media[44:]
    if _name(payload) != row["media_id"] or struct.unpack_from("<I", media, 40)[0] != len(payload):
        raise ValueError(f"medium {row['media_id'].hex()} is not what was stored")
    return (row["media_id"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media),
            hashlib.sha256(media).hexdigest(), feature(payload))


def feature(payload: bytes) -> str:
    """Of the samples: mean level and power (in 1/1000), crossings of the middle, least and most level."""
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    levels = np.arange(256)
    there = np.flatnonzero(count)
    mean, power = int(count @ levels) * 1000 // len(x), int(count @ ((levels - 128)**2)) * 1000 // len(x)
    high = x >= 128
    return f"mean={mean},power={power},crossings={int(np.count_nonzero(high[1:] != high[:-1]))},min={there[0]},max={there[-1]}"


def media_columns(documents: DataFrame, path: str) -> DataFrame:
    """Stores the texts of ``documents`` (null: empty) at ``path`` as media and reads them back: one row per row with
    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Equal texts are
    one medium; rows that share a doc_id, or have none, keep their own row."""
    known = cut_lineage(catalog(documents))
    write_store(documents, known, path)
    described = read_store(documents.sparkSession, path)
    return known.select("doc_id", "n_bytes", "media_id").join(described, "media_id").drop("media_id")
