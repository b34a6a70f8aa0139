"""Counts, ids and keyed files against the public library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, keyed_ids, token_counts
from tests.llm.helpers import frame, odd_rows

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
BITS = ["a", "b", "é", "ñ", " ", "  ", "\n", "\t", "\r\n", "1", "23", "'s", "'ll", "'", "...", "<|endoftext|>", "<|startoftext|>", "<|endof", "\x1c", "\xa0", "中文", "😀", "é", "Σ", "İ", "ß",
        "\x85", "\x00", "-", "_", "The", " the", "straße"]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "   ", "a" * 3000, " \n " * 50, "ab " * 500]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_counts_equal_the_library(path):
    texts = odd_texts(800)
    assert token_counts.counter(path).count(texts) == [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library_and_come_back():
    texts = odd_texts(800)
    codec, tool = bpe.BacktrackingCodec(BYTE), Tokenizer.from_file(BYTE)
    for text, want in zip(texts, tool.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = codec.encode(text)
        assert ids == np.array(want.ids, "<u4").tobytes()
        assert codec.decode(ids) == tool.decode(want.ids, skip_special_tokens=False) == text


def test_word_encoder_equals_the_library():
    texts = odd_texts(800)
    tool = Tokenizer.from_file(WORD)
    got = keyed_ids.WordEncoder(WORD).encode(texts)
    assert got == [np.array(x.ids, "<u2").tobytes() for x in tool.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, PIECE])
def test_counts_of_odd_rows(spark, path):
    rows = odd_rows()
    got = token_counts.token_counts(frame(spark, rows), path).collect()
    count = token_counts.counter(path).count
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (str(i), len((t or "").encode()), n := count([t or ""])[0], n > 512) for i, t in rows)
    assert token_counts.token_counts(frame(spark, []), path).count() == 0


def test_round_trip_of_odd_rows(spark):
    rows, tool = odd_rows(), Tokenizer.from_file(BYTE)
    got = bpe.round_trip(frame(spark, rows), BYTE).collect()
    want = []
    for i, t in rows:
        ids = tool.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    encoded = bpe.encode(frame(spark, rows), BYTE)
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(encoded, BYTE).collect()) == sorted((str(i), t or "") for i, t in rows)


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys, prints = keyed_ids._key_bits([f"k{n}" for n in range(5000)], 0)
    phf = keyed_ids.PerfectHash.of(keys)
    assert sorted(phf.slots(keys)) == list(range(5000))
    back, _ = keyed_ids.PerfectHash.loads(phf.dumps())
    assert (back.slots(keys) == phf.slots(keys)).all()
    assert len(keyed_ids.PerfectHash.of(keys[:0]).slots(keys)) == 5000
    assert keyed_ids.PerfectHash.of(np.array([5, 7, 5], np.uint64)) is None  # other bits are taken then


def test_keyed_ids_of_odd_rows(spark, monkeypatch):
    rows, tool = odd_rows(), Tokenizer.from_file(WORD)
    monkeypatch.setattr(keyed_ids, "KEYS_PER_BUCKET", 3)
    docs = frame(spark, rows)
    store = keyed_ids.write_ids(docs, WORD)
    got = store.read(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (str(i), len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, t in rows for x in [tool.encode(t or "", add_special_tokens=False).ids])
    # Starts follow each other in the order of keys, null keys first.
    line = sorted(got, key=lambda r: r.start)
    assert [r.start for r in line] == list(np.cumsum([0, *(r.n_tokens for r in line)])[:-1])
    assert [r.doc_id is not None and r.doc_id for r in line] == sorted((r.doc_id is not None and r.doc_id) for r in line)
    assert all(r.ids[-1] == 1 for r in got)
    assert store.read(frame(spark, [(99, "not in it"), (5, "")])).select("doc_id").collect()[0].doc_id == 5
    assert keyed_ids.write_ids(frame(spark, []), WORD).read(docs).count() == 0
