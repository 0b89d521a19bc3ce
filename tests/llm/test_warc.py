"""Revisits against a plain loop, over one and over many time slices."""

import random

import pytest
from pyspark.sql import functions as F

from quillforge.llm import warc as W

SCHEMA = "id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def plain(rows, key):
    out = {}
    for i, url, ts, kind, etag, modified, digest, headers in rows:
        if kind != "revisit":
            continue
        seen = [r for r in rows if r[3] == "response" and key[r[1]] is not None and key[r[1]] == key[url] and r[2] is not None and ts is not None and r[2] < ts]
        if not seen:
            out[i] = (None, "unresolved", None)
            continue
        hit = max(seen, key=lambda r: (r[2], r[0]))
        bare = lambda t: t and t.removeprefix("W/")
        # The first validator that both have decides.
        told = next((a == b for a, b in ((bare(etag), bare(hit[4])), (modified, hit[5]), (digest, hit[6])) if a is not None and b is not None), None)
        status = "unchecked" if told is None else "resolved" if told else "mismatch"
        merged = {k.lower(): v for k, v in (hit[7] or {}).items()} | {k.lower(): v for k, v in (headers or {}).items() if k.lower() in W.PERMITTED}
        out[i] = (hit[0], status, merged if status != "mismatch" else None)
    return out


@pytest.mark.parametrize("size", [100_000, 20])
def test_against_a_loop(spark, size):
    rng = random.Random(size)
    urls = ["http://www.A.org/x", "https://a.org:443/x/", "https://a.org/x#f", "http://a.org/x?utm_source=q", "http://a.org/x?b=1&a=2", "http://a.org/x?a=2&ref=z&b=1", None, "no url"]
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        pick = lambda *v: rng.choice([None, *v])
        rows.append((i, rng.choice(urls[:3] + urls), pick(*range(0, 300, 3)), kind, pick('"a"', 'W/"a"', '"b"'), pick("m1", "m2"), pick("d1", "d2"), pick({"ETag": '"z"', "Content-Type": "t"}, {"etag": '"y"', "Date": "now", "Content-Length": "3"}, {})))
    captures = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "id as key", "id as slice", "kind as near", "id as hit", "id as status", "id as canonical_url")
    key = {r.url: r.k for r in captures.select("url", W.canonical_url(F.col("url")).alias("k")).distinct().collect()}
    assert key["http://www.A.org/x"] == key["https://a.org:443/x/"] == key["https://a.org/x#f"] == key["http://a.org/x?utm_source=q"] == "a.org/x"
    assert key["http://a.org/x?b=1&a=2"] == key["http://a.org/x?a=2&ref=z&b=1"] == "a.org/x?a=2&b=1" and key["no url"] is None
    got = {r.id: (r.target_id, r.status, r.headers) for r in W.resolve(captures, slice_rows=size).collect()}
    assert got == plain(rows, key)
    assert {s for _, s, _ in got.values()} == {"resolved", "unchecked", "mismatch", "unresolved"}


def test_pages(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    extra = spark.createDataFrame([(1_000_001, "http://q.org/1", None), (1_000_002, None, "<p>"), (1_000_003, "http://q.org/1", "<p>")], pages.schema)
    got = {r.page_id: r.status for r in W.digest(W.resolve(W.page_captures(pages.union(extra)))).collect()}
    assert len(got) == pages.count() + 3
    assert [got[i] for i in (1_000_001, 1_000_002, 1_000_003)] == ["unchecked", "unresolved", "resolved"]
    assert W.resolve(W.page_captures(pages.limit(0))).count() == 0
