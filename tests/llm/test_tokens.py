"""Token files, SentencePiece and Simple-8b against the libraries and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalvault.llm import token_files
from signalvault.llm.sentencepiece_bpe import PieceModel, encode_documents, encode_texts, round_trip
from signalvault.llm.simple8b import pack, unpack
from signalvault.llm.token_files import ByteEncoder, read_tokens, write_tokens
from signalvault.llm.units import UnitCache

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(st.sampled_from(list("ab theing  éä▁\n\t<s>0x41/😀中\x00\xa0 '12,.")), max_size=80)


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60_000) | st.integers(0, 1), max_size=1500), st.sampled_from([3, 64, 512]))
@settings(max_examples=60, deadline=None)
def test_simple8b(values, block):
    values = np.array(values, np.uint64)
    words, starts = pack(values, block)
    assert (unpack(words, starts, len(values), block) == values).all() and len(starts) == -(-len(values) // block)


def test_simple8b_is_dense():
    words, _ = pack(np.arange(32_768, dtype=np.uint64) % 1000)
    assert len(words) * 8 < 32_768 * 1.5


@given(st.lists(TEXT, max_size=20))
@settings(max_examples=60, deadline=None)
def test_byte_units(texts):
    encoder = ByteEncoder.of(BYTES)
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts).tolist()
    want = [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[b - n:b].tolist() for b, n in zip(ends, counts.tolist())] == want


@given(st.lists(TEXT, max_size=20))
@settings(max_examples=60, deadline=None)
def test_pieces(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = PieceModel.of(PIECES)
    ids, bounds = encode_texts(model.cache, texts)
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [library.encode(t) for t in texts]
    assert [x.decode() for x in model.decode(ids, bounds)] == [library.decode(x) for x in got]


@pytest.mark.parametrize("text", ["a" * 5000, "theing" * 900, "ab" * 700 + "é" * 300, "中文" * 400, " " * 700])
def test_long_units(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids, _ = encode_texts(PieceModel.of(PIECES).cache, [text])
    assert ids.tolist() == library.encode(text)


def test_full_cache_changes_nothing():
    model = PieceModel.of(PIECES)
    small, r = UnitCache(model.encode_units, limit=8), random.Random(1)
    for _ in range(20):
        texts = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(10)) for _ in range(3)]
        assert (encode_texts(small, texts)[0] == encode_texts(model.cache, texts)[0]).all()


def test_round_trip(spark, documents, awkward):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(map(tuple, round_trip(documents(awkward), PIECES).collect()), key=str)
    want = []
    for doc_id, text, _ in awkward:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert round_trip(documents([]), PIECES).count() == 0
    encoded = encode_documents(documents(awkward), PIECES)
    assert encoded.columns[-1] == "ids" and encoded.columns.count("ids") == 1
    assert encoded.where("doc_id = 3").first().ids == library.encode("one", add_bos=True, add_eos=True)


@pytest.mark.parametrize("segment", [5, 1 << 18])
def test_token_files(spark, documents, awkward, folder, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    rows = [r for r in awkward if r[0] is not None]
    write_tokens(documents(rows[::-1]), folder + "/t", BYTES, 2)
    got = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, folder + "/t").collect()}
    library, want, start = ByteEncoder.of(BYTES).library, set(), 0
    for doc_id, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.add((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    write_tokens(documents([]), folder + "/e", BYTES, 2)
    assert read_tokens(spark, folder + "/e").count() == 0


def test_documents_without_an_id_come_first(spark, documents, folder):
    write_tokens(documents([(5, "b", "a"), (None, "a a", "a")]), folder + "/t", BYTES, 2)
    assert [r.doc_id for r in read_tokens(spark, folder + "/t").orderBy("start").collect()] == [None, 5]
