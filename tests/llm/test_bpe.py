"""BPE by chunks against the library on whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetspan.llm import bpe

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def made(spark, rows):
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("ids", "place", "chunk", "n", "copies", "text_key")})
    return bpe.encoded(docs)


def same(spark, library, rows):
    got = sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in made(spark, rows).collect())
    assert got == sorted((i is not None, i or 0, whole(library, t)) for i, t in rows)


def test_words_part_at_white_space(library):
    r = np.random.default_rng(3)
    odd = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", " ", "́", "é", "Σ", "ς", "İ", "ß", "'s", "'", "'LL", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "12", "٣", "中文", "한국", "한", "🙂", "‍", "a", "B", ".", "!!", "\x00", "�"]
    c = bpe.codec(bpe.VOCABULARY)
    odd += [chr(i) for i in range(256)] + ["é", "ÉT", "ß", "Ñ", "ÿ", "Ÿ"] * 3
    for _ in range(4000):
        text = "".join(odd[i] for i in r.integers(0, len(odd), r.integers(1, 40)))
        assert np.frombuffer(c.encode(text.encode()), "<u4").tolist() == whole(library, text), repr(text)


def test_chunks_hang_on_content_alone():
    r = np.random.default_rng(4)
    text = "".join(chr(int(x)) for x in r.choice([97, 98, 32, 233, 0x4E2D, 0x1F642], 60_000)).encode()
    cut = bpe.chunks(text)
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
    assert all(bpe.LEAST <= e - b <= bpe.MOST for b, e in cut[:-1])
    for b, e in cut:
        text[b:e].decode()
    moved = {(b + 7, e + 7) for b, e in cut}
    assert len(moved & set(bpe.chunks(b"shifted" + text))) > 0.9 * len(cut)
    assert bpe.chunks(b"") == [] and bpe.chunks(b"a" * 20_000) == [(0, 8192), (8192, 16384), (16384, 20_000)]
    brute = [i + 1 for i in range(len(text) - 1) if rolling(text[max(0, i - bpe.WINDOW + 1) : i + 1]) < (1 << 32) // bpe.MEAN and text[i + 1] & 0xC0 != 0x80]
    assert bpe.marks(text).tolist() == brute


def rolling(window):
    h = 0
    for b in window:
        h = (h * bpe.BASE + (b + 1) * 0x85EBCA6B) & 0xFFFFFFFF
    return h * 0xC2B2AE35 & 0xFFFFFFFF


@pytest.mark.parametrize("block", [64, 1000])
def test_marks_of_blocks(monkeypatch, block):
    r = np.random.default_rng(5)
    text = bytes(r.integers(97, 123, 20_000).astype(np.uint8))
    want = bpe.marks(text).tolist()
    monkeypatch.setattr(bpe, "BLOCK", block)
    assert bpe.marks(text).tolist() == want


def test_shared_passages_and_joins(spark, library):
    r = np.random.default_rng(6)
    word = lambda: "".join(chr(int(x)) for x in r.choice([97, 101, 116, 233, 0x4E2D, 39, 115, 49], r.integers(1, 9)))
    passages = [" ".join(word() for _ in range(900)), "".join(word() for _ in range(4000)), ("no spaces,just commas;" * 600).replace(" ", "")]
    rows = []
    for i in range(40):
        own = [" ".join(word() for _ in range(int(r.integers(0, 400)))) for _ in range(3)]
        rows.append((i, own[0] + passages[i % 3][int(r.integers(0, 50)) :] + own[1] + passages[(i + 1) % 3] + own[2]))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (0, rows[1][1]), (None, rows[1][1]), (None, rows[1][1])]
    same(spark, library, rows)


def test_odd_rows(spark, library):
    same(spark, library, [(1, None), (2, ""), (3, " \n\t"), (None, "a row without an id"), (4, "word " * 30_000), (4, "word " * 30_000), (5, "x" * 50_000), (6, "naïve Ünïcode ß\x0b\x0c\r\nend"), (6, "naïve Ünïcode ß\x0b\x0c\r\nend"), (7, "é" * 9_001)])
    assert made(spark, []).count() == 0


def test_bytes_that_are_not_text(spark, library):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF6220C3') AS string) AS text")
    assert [list(r.ids) for r in bpe.encoded(docs).collect()] == [whole(library, "a�b �")]


def test_decoding(spark, library):
    rows = [(1, "Hello <|endoftext|> world's 中文"), (2, None)]
    got = {r.doc_id: r.text for r in bpe.decoded(made(spark, rows)).collect()}
    assert got == {i: library.decode(whole(library, t), skip_special_tokens=False) for i, t in rows}


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op12_bpe(spark, SF).collect()}
    want = {}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = whole(library, text)
        want[doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want
