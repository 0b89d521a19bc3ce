"""Counts against the library, and what the cache does."""

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from quillforge.llm import tokencount as T

PATH = P.path("byte_bpe_50k.json")
FAST, SLOW = T._by_ranks(PATH, P.PATTERN), T.library_counter(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "  ", "\r\n", "'ll", " don't", "\x1c", "\x85", "　", "123 45"])), max_size=8))
def test_any_text(parts):
    assert FAST("".join(parts)) == SLOW("".join(parts))


def test_cache(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a<|endoftext|>b"), (-4, "a<|endoftext|>b")], "doc_id long, text string"))
    want = {(r.doc_id, len((r.text or "").encode()), SLOW(r.text or "")) for r in docs.collect()}
    cache = f"file://{tmp_path}/cache"
    assert {tuple(r) for r in T.token_counts(docs.where("doc_id % 2 = 0"), PATH, P.PATTERN, cache).collect()} == {w for w in want if w[0] % 2 == 0}
    before = spark.read.parquet(cache).count()
    assert {tuple(r) for r in T.token_counts(docs, PATH, P.PATTERN, cache).collect()} == want
    stored = spark.read.parquet(cache)
    assert before < stored.count() == stored.select("digest").distinct().count()
    assert T.token_counts(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_hits_encode_nothing(spark, tiny, tmp_path, monkeypatch):
    """A full cache answers without the tokenizer, by the query's own way; another version's counts are no hits."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    cache = f"file://{tmp_path}/cache"
    first = sorted(map(tuple, T.token_counts(docs, PATH, P.PATTERN, cache).collect()))
    stored = spark.read.parquet(cache).count()
    monkeypatch.setattr(T, "_encode", lambda path, pattern: (lambda batches: (1 / 0 for b in batches if b.num_rows)))
    assert sorted(map(tuple, T.token_counts(docs, PATH, P.PATTERN, cache).collect())) == first
    assert spark.read.parquet(cache).count() == stored
    monkeypatch.undo()
    monkeypatch.setattr(T, "tokenizer_version", lambda path: "other")
    assert sorted(map(tuple, T.token_counts(docs, PATH, P.PATTERN, cache).collect())) == first
    assert spark.read.parquet(cache).count() == 2 * stored


def test_many_misses_and_frequent_texts(spark, tiny, tmp_path, monkeypatch):
    """Beyond MANY missing keys, and with a text that most rows repeat."""
    monkeypatch.setattr(T, "MANY", 3)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").union(spark.range(1000, 1400).selectExpr("id", "'the same text'")).union(spark.createDataFrame([(None, "x " * 90_000), (5000, "x " * 90_000)], "doc_id long, text string"))
    want = sorted(((r.doc_id, len((r.text or "").encode()), SLOW(r.text or "")) for r in docs.collect()), key=str)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert sorted(map(tuple, T.token_counts(docs, PATH, P.PATTERN, cache).collect()), key=str) == want


def test_other_kinds_use_the_library(spark):
    docs = spark.createDataFrame([(1, "Hello wörld"), (2, None)], "doc_id long, text string")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        assert T._by_ranks(P.path(name), P.PATTERN) is None
        count = T.library_counter(P.path(name))
        assert {(r.doc_id, r.n_tokens) for r in T.token_counts(docs, P.path(name), P.PATTERN).collect()} == {(1, count("Hello wörld")), (2, count(""))}
