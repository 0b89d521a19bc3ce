"""Near-duplicate components against all pairs, and the edge cases of the docstring."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillforge.llm import decontaminate, kernels, lm, neardup
from quillforge.llm.neardup import near_duplicates


def brute(rows, percent=85):
    sets = []
    for doc, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets.append((doc, {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())))
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            n = len(x & y)
            if n and 100 * n >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                top[hi] = lo
    return {(d, len(s), find(d) if s else d, (find(d) if s else d) == d) for d, s in sets}


def test_all_pairs(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    # A chain whose ends are less alike than the threshold, and many copies with one word changed.
    long = [f"w{i}" for i in range(300)]
    for k in range(12):
        rows.append((10_000 + k, " ".join([*long[k * 6 :], *(f"z{i}" for i in range(k * 6))])))
    for k in range(40):
        rows.append((20_000 + k, " ".join([*long[: 5 * k], f"changed{k}", *long[5 * k + 1 :]])))
    rows += [(30_000, " ".join(base)), (30_001, " ".join(base).upper()), (30_002, "a b"), (30_003, "A\tb"), (30_004, ""), (30_005, None), (30_006, " \n")]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "x y z", "q"), (1, "x y z", "q"), (None, "x y z", "q"), (2, None, "q"), (3, "x y z" * 50_000, "q")]
    got = sorted(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (None, None, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def texts_of(rng, words, share, n):
    """A text of so many words and copies with a share of its words replaced."""
    base = [f"b{i}" for i in range(words)]
    for _ in range(n):
        own = list(base)
        for i in rng.choice(words, max(1, int(words * share)), replace=False):
            own[i] = f"x{rng.integers(1 << 40)}"
        yield " ".join(own)


def test_large_sets_and_many_unlinked_ones(spark, monkeypatch):
    """Sets beyond WHOLE, and a bucket of near texts of which only some are linked, in blocks of a few nodes."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = list(enumerate([*texts_of(rng, 1800, 0.008, 25), *texts_of(rng, 2500, 0.017, 25), *texts_of(rng, 200, 0.025, 60), *texts_of(rng, 300, 0.04, 40)]))
    want = brute(rows)
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()} == want
    assert len({c for _, n, c, _ in want if n > 1024}) > 2 and any(n > 1024 and not kept for _, n, _, kept in want)


def test_estimate(spark):
    """Odd sketches of MinHash samples tell similarities of 0.8 to 1.0 within four standard deviations."""
    rng = np.random.default_rng(6)
    rows, truth = [], []
    for size in (60, 400, 5000):
        for share in (0.0, 0.02, 0.05, 0.08, 0.11):
            for _ in range(20):
                both = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
                own = [np.unique(np.concatenate([both[int(size * share) :], rng.integers(0, 1 << 63, int(size * share), dtype=np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2)]
                x, y = neardup.odd_sketches(neardup.minhashes(own))
                rows.append((int(sum(bin(int(v)).count("1") for v in x ^ y)),))
                truth.append(len(np.intersect1d(*own)) / len(np.union1d(*own)))
    got = [r.e for r in spark.createDataFrame(rows, "bits int").select(neardup.estimate(F.col("bits")).alias("e")).collect()]
    errors = np.array(got) - truth
    assert abs(errors).max() < 4 * 0.045 and abs(errors.mean()) < 0.01
    assert min(truth) < 0.82 and all(e == 1 for e, t in zip(got, truth, strict=True) if t == 1)
    assert max(b for (b,), t in zip(rows, truth, strict=True) if t >= 0.85) <= neardup.most_bits(85)


def test_words_that_a_polynomial_hash_confuses(spark):
    """The Thue-Morse word and its complement are different words in every operator that hashes words."""
    for n in (10, 12):
        bits = [bin(i).count("1") & 1 for i in range(1 << n)]
        x, y = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
        rows = [(1, f"{x} one two three"), (2, f"{y} one two three")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.component_id for r in near_duplicates(docs).collect()} == {1, 2}
        items = spark.createDataFrame([(1, x)], "item_id long, text string")
        assert {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()} == {1: 1, 2: 0}
        data, offsets = kernels.buffers(pa.array([x, y]))
        assert len(set(lm.tokens(data, offsets)[0].tolist())) == 3
        assert len(set(kernels.word_hashes(data, offsets[:-1], offsets[1:], None).tolist())) == 2
