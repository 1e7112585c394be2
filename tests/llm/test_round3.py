"""Contracts that queries keep: added tokens, windows that begin alike, rows that share a doc_id."""

import os
import sys

import numpy as np
import pyarrow as pa
import public_tokenizers

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from signalvault.llm.common import Words, flat
from signalvault.llm.ngram_join import first_of_classes
from signalvault.llm.substring_dedup import _windows
from signalvault.llm.token_files import ByteEncoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_are_found_as_the_library_finds_them():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    texts = ["hello <|endoftext|> world", "plain text here", "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b\n", "<|endoftext", "more words"]
    for some in (texts, texts[::-1], ["x <|endoftext|>"], ["no mark"]):
        ids, counts = ByteEncoder.of(BYTES).encode(pa.array(some, pa.string()))
        ends = np.cumsum(counts)
        assert [ids[b - n:b].tolist() for b, n in zip(ends, counts)] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert 50256 in library.encode(texts[0], add_special_tokens=False).ids


def test_windows_behind_a_common_head_stay_apart():
    head = " ".join(f"h{i}" for i in range(20))
    texts = [f"{head} " + " ".join(f"t{i}x{j}" for j in range(15)) for i in range(300_000)]
    found = []
    for at in range(0, len(texts), 20_000):
        data, offsets = flat(pa.array(texts[at:at + 20_000], pa.string()))
        start, prefix, path = _windows(Words(data, offsets), 35, 8)
        assert len(start) == 20_000 and len(np.unique(prefix)) == 1
        found.append(path)
    assert len(np.unique(np.concatenate(found))) == len(texts)


def test_rows_that_share_a_doc_id_are_judged_one_by_one(spark, documents):
    copy = " ".join(f"c{i}" for i in range(30))
    clean = [" ".join(f"{x}{i}" for i in range(30)) for x in "pqr"]
    rows = [(1, copy, "a"), (7, copy, "a"), (7, clean[0], "a"), (7, clean[1], "b"), (None, copy, "a"), (None, clean[2], "a"), (None, clean[2], "b"), (None, None, "a"), (8, "", "a")]
    for parts in (1, 3):
        got = first_of_classes(documents(rows).repartition(parts))
        kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
        assert kept == sorted([(1, copy), (7, clean[0]), (7, clean[1]), (0, clean[2]), (0, ""), (8, "")])
        assert got.columns == documents(rows).columns
    many = [(i, f"{copy} x{i // 2}" if i % 2 else f"d{i} e{i} f{i} g{i} h{i}", "a") for i in range(3000)]
    assert first_of_classes(documents(many)).count() == 1501
