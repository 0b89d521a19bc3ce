"""Stored media: exact round trips, byte ranges, damaged and failing members."""

import hashlib
import zlib

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from quillforge.llm import media as M


@given(st.binary(max_size=300))
def test_images(raw):
    payload, n = M.from_png(M.to_png(raw))
    assert payload[:n] == raw and len(payload) == max(64, -(-len(raw) // 64) * 64) and not payload[n:].strip(b"\0")


def test_query(spark, tiny, tmp_path):
    odd = [(-1, None), (-2, ""), (None, "x"), (-4, "é" * 64), (-4, "é" * 64), (-5, "long " * 40_000)]
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).repartition(3)
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = M.to_png(raw)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    got = [tuple(r)[:-1] for r in M.stored_features(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ranges_give_each_member_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(400)], "doc_id long, text string").repartition(2)
    place = f"file://{tmp_path}/media"
    assert M.store(docs, place) == 400
    for size in (1000, 7777, 1 << 22):
        found = M.members(spark, place, size)
        assert found.rdd.getNumPartitions() == sum(-(-p.stat().st_size // size) for p in (tmp_path / "media").glob("*.zip"))
        assert sorted(r.doc_id for r in M.features(found).select("doc_id").collect()) == list(range(400))
    assert M.store(docs.limit(0), f"file://{tmp_path}/none") == 0
    assert M.members(spark, f"file://{tmp_path}/none").count() == 0


def test_members_fail_alone(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1)
    place = f"file://{tmp_path}/media"
    M.store(docs, place)
    (archive,) = (tmp_path / "media").glob("*.zip")
    rows = {r.name.split("/")[1]: r for r in M.members(spark, place).collect()}
    data = bytearray(archive.read_bytes())
    data[rows["2.png"].offset + 60] ^= 255
    archive.write_bytes(data)
    reader = M.ArchiveReader({"path": place, "pause": "0"})
    out = pa.Table.from_batches([b for p in reader.partitions() for b in reader.read(p)]).to_pylist()
    assert {r["name"].split("/")[1]: r["error"] is None for r in out} == {f"{i}.png": i != 2 for i in range(5)}
    with pytest.raises(PySparkException, match="damaged"):
        M.features(M.members(spark, place)).collect()
    # A read that fails once is tried again from the member's offset.
    data[rows["2.png"].offset + 60] ^= 255
    archive.write_bytes(data)
    real, calls = M.zlib.crc32, []

    def once(x):
        calls.append(1)
        return 0 if len(calls) == 2 else real(x)

    monkeypatch.setattr(M, "zlib", type("Z", (), {"crc32": staticmethod(once)}))
    out = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["error"] for r in out] == [None] * 5 and len(calls) == 6
