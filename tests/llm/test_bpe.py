"""Ids against the library, exact round trips, and the UTF-8 machine."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillforge.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


CODEC = bpe.codec(PATH, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    ids = np.frombuffer(CODEC.encode(text), "<u4")
    assert ids.tolist() == library.encode_ordinary(text)
    assert CODEC.decode(ids, 1) == text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "th", "the", "tion", "er", "é", "ß", "😀", " ", "ción", "qu"]), max_size=25))
def test_repeats(library, parts):
    text = "".join(parts)
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == library.encode_ordinary(text)


@given(st.binary(max_size=12))
def test_machine(data):
    machine = bpe.Utf8Machine()
    assert "".join([machine.feed(data[i : i + 1]) for i in range(len(data))]) + machine.close() == data.decode("utf-8", "replace")


def test_states_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    monkeypatch.setattr(bpe, "PIECES", 50)
    own = bpe.Codec(PATH, P.PATTERN)
    for n in range(300):
        text = f"w{n}ord{n * n} ütterance{n % 7}tion "
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert len(own.pieces) <= 51


def test_one_long_piece_keeps_the_bound(library, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 60)
    own = bpe.Codec(PATH, P.PATTERN)
    piece = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000))
    assert np.frombuffer(own.encode(piece), "<u4").tolist() == library.encode_ordinary(piece)
    assert len(own.transducer.states) <= 61


def test_query(spark, tiny, library):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ab" * 30_000)], "doc_id long, text string"))
    got = {tuple(r) for r in bpe.digest(bpe.round_trip(docs, PATH, P.PATTERN)).collect()}
    want = set()
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want
