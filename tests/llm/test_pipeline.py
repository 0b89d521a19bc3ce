"""The pipeline's stages one by one on one table with planted cases, and its whole run."""

import re

import numpy as np

import corpus_pipeline
from quillforge.llm import bpe

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = [WORD.findall(r.text.encode().lower()) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    wins = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    planted = docs.where("doc_id = 2").first()
    base = planted.asDict()
    item = spark.read.parquet(f"{tiny}/benchmark.parquet").first().text
    clean = docs.where("lang = 'en' and n_chars > 1500").first()
    rows = [base | {"doc_id": 90_001}, base | {"doc_id": 90_002, "text": clean.text + " " + item}, base | {"doc_id": 90_003, "text": clean.text.replace(" ", " q ", 3) + " write a.b@c.de"}]
    state = docs.union(spark.createDataFrame(rows, docs.schema))
    counts = []
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in state.collect()}
        state = step(spark, state, tiny)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert state.columns == docs.columns
        state = spark.createDataFrame(state.collect(), state.schema)
        ids = [r.doc_id for r in state.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        counts.append(len(ids))
        if "near" in name:
            assert 90_001 not in ids
        if "benchmark" in name:
            kept = {d for d, t in before.items() if not any(tuple(w[i : i + 10]) in wins for w in [WORD.findall(t.encode().lower())] for i in range(max(1, len(w) - 9)))}
            assert set(ids) == kept
        if name == "PII":
            assert all("@" not in r.text or "[EMAIL]" in r.text or not re.search(r"\w@\w+\.\w", r.text) for r in state.collect())
    codec = bpe.codec(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    for r in state.collect():
        assert r.decoded == before[r.doc_id] and codec.encode(r.decoded) == bytes(r.ids) and r.n_tokens * 4 == len(np.frombuffer(r.ids, np.uint8))
    assert counts[0] > counts[1] >= counts[2] == counts[3] == counts[4]


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and 50 < out.count() < 200
