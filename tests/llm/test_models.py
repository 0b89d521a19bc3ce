"""Language, quality and language-model operators: held-out accuracy, plain recounts and odd rows."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillforge.llm import kernels, langid, lm, quality, registry

ODD = [(-1, None, "en", "x"), (-2, "", "de", "x"), (-3, "123 !!! ---", None, "x"), (None, "the end of the", "en", "x"), (-5, "Ω", "en", "x"), (-6, "zu " * 20_000, "de", "x"), (-6, "zu " * 20_000, "de", "x")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang", "source").union(spark.createDataFrame(ODD, SCHEMA))


def test_language(spark, docs, tiny):
    rows = registry.op3_bitmask_filters(spark, tiny).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if d is not None and d >= 0 and zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [got[d].lang_pred for d in (-1, -2, -3)] == ["und"] * 3
    assert got[-6].lang_pred == "de" and got[-5].lang_pred in truth.values()
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.fit(docs, sample_rows=50).languages
    assert {r.held_out for r in registry.op3_bitmask_filters(spark, tiny).collect()} == {True, False}


def test_rare_languages_are_learned(spark):
    """The bound draws all rows of rare languages, and of the others as many as it leaves."""
    assert langid._draws({"a": 5, "b": 1000, "c": 300}, 205) == {"a": 5, "b": 100, "c": 100}
    rows = [(i, f"the end of the day and the night of word{i}", "en") for i in range(600)] + [(1000 + i, f"zu dem ende der nacht und dem tag wort{i}", "de") for i in range(6)]
    fitted = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=100)
    probe = spark.createDataFrame([(1, "das ende der nacht und dem tag"), (2, "of the night and the day")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(probe, fitted).collect()} == {1: "de", 2: "en"}


def test_filters_report_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    members = [rng.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(70)]
    members[69] = np.concatenate([members[69], members[3]])
    filters = langid.Filters.build([f"l{i}" for i in range(70)], members)
    hits, total = filters.counts(members[3], np.zeros(400, np.int64), 1)
    assert hits[0, 3] == hits[0, 69] == total[0] == 400
    assert (np.delete(hits[0], [3, 69]) / 400 < 4 * filters.false_rates().max() + 0.05).all()


def test_quality(spark, docs, tiny):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    rows = {r.doc_id: r for r in quality.select(docs, labels).collect()}
    known = {r.doc_id: r for r in labels.collect() if r.doc_id in rows}
    good = [rows[d].kept for d, r in known.items() if r.quality and not r.toxic]
    bad = [rows[d].kept for d, r in known.items() if not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert not rows[-1].kept and rows[-1].log_weight is None and not rows[-2].kept
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in quality.select(docs, labels).where("kept").collect())
    assert quality.select(docs.limit(0), labels).count() == 0
    assert quality.keep(docs, labels.limit(0)).count() == docs.where("length(trim(text)) > 0").count()


def test_quality_leaves_out_toxic_documents(spark):
    """Labels that only part of the toxic documents have, and texts in which one word of thousands is toxic."""
    d, own = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    bad = set("trash pathetic idiot disgusting worthless stupid clown loser scum moron".split())
    plain = d.where("lang = 'en' and n_chars > 1000").orderBy("doc_id").select("doc_id", "text").collect()
    clean = [r for r in plain if not bad & set(r.text.lower().split())][:20]
    rows = [(10_000_000 + i, " ".join([*[r.text] * 5, "Idiot!", *[r.text] * 5])) for i, r in enumerate(clean)]
    docs = d.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    # Every other toxic label is held out.
    toxic = sorted(r.doc_id for r in own.where("toxic = 1 and quality = 1").collect())
    held = set(toxic[::2])
    kept = {r.doc_id: r.kept for r in quality.select(docs, own.where(~own.doc_id.isin(held))).collect()}
    texts = {r.doc_id: set(re.findall("[a-z]+", r.text.lower())) for r in docs.collect()}
    found = [not kept[i] for i in held if texts[i] & bad]
    assert len(found) >= 10 and sum(found) >= 0.9 * len(found)
    assert sum(not kept[i] for i in held) >= 0.5 * len(held)
    assert not any(kept[i] for i, _ in rows)
    # Labels that cannot be told apart by toxicity leave all in.
    assert len(quality.fit(docs, own.withColumn("toxic", F.lit(0))).toxic) == 0


def plain_features(text):
    """Buckets of a text's words, pairs and runs of shapes, one by one."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    one = lambda w: int(kernels.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), None)[0])
    kind = lambda b: 1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else 4 if b >= 128 else 8 + b
    hashes = [one(w) for w in words]
    shapes = [kind(w[0]) * 4096 + kind(w[-1]) * 8 + 2 * (i > 0 and words[i - 1] == w) + (len(w) > 20) for i, w in enumerate(words)]
    shapes = [int(kernels.mix(np.array([x], np.uint64))[0]) for x in shapes]

    def runs(values, n):
        if not values:
            return []
        n = min(n, len(values))
        out = [sum(v * int(f) for v, f in zip(values[i : i + n], kernels.SHINGLE_FACTORS, strict=False)) + n * 0xD6E8FEB86659FD93 for i in range(len(values) - n + 1)]
        return [int(x) for x in kernels.mix(np.array([x % 2**64 for x in out], np.uint64))]

    return [h % quality.BUCKETS for h in [*hashes, *runs(hashes, 2), *runs(shapes, 3)]]


def test_resampling_against_plain_code(spark, docs, tiny):
    """log_ratio, log_weight, key and kept recomputed one document at a time, for a k and a temperature of our own."""
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    docs = docs.where("doc_id <> -6 or doc_id is null").withColumn("key", F.lit(1)).withColumn("toxic", F.lit("x"))
    rows = docs.select("doc_id", "text").collect()
    known = {r.doc_id: r.quality and not r.toxic for r in labels.collect()}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    own = {r.doc_id: plain_features(r.text) for r in rows}
    for d, f in own.items():
        for b in f:
            raw[b] += 1
            target[b] += bool(known.get(d))
    base = [(x + 1e-3) / (raw.sum() + 1e-3 * len(raw)) for x in raw]
    smooth = quality.SMOOTH * len(raw)
    ratio = [math.log((t + smooth * b) / (target.sum() + smooth) / b) for t, b in zip(target, base, strict=True)]
    got = {r.doc_id: r for r in quality.select(docs, labels, k=60, temperature=7.0, seed=3).collect()}
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(F.col("doc_id"), 3).alias("g")).collect()}
    keys = {}
    for d, f in own.items():
        if not f:
            assert got[d].log_ratio is None and got[d].log_weight is None and not got[d].kept
            continue
        total = sum(ratio[b] for b in f)
        assert got[d].log_ratio == pytest.approx(total, rel=1e-9, abs=1e-9) and got[d].log_weight == pytest.approx(100 * total / len(f), rel=1e-9, abs=1e-9)
        if not got[d].toxic:
            keys[d] = got[d].log_weight / 7.0 + noise[d]
            assert got[d].key == pytest.approx(keys[d], rel=1e-12)
    assert {d for d, r in got.items() if r.kept} == set(sorted(keys, key=keys.get, reverse=True)[:60])
    kept = quality.keep(docs, labels, k=60, temperature=7.0, seed=3)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_samples_follow_the_weights(spark):
    """Over many seeds, first places come in proportion to exp(weight / temperature); the default temperature changes samples."""
    weights = [0.0, 1.0, 2.0, 3.0, 3.5]
    rows = spark.createDataFrame(list(enumerate(weights)), "doc_id long, w double").crossJoin(spark.range(4000).toDF("seed"))
    keyed = rows.select("seed", "doc_id", (F.col("w") / 2 + quality.gumbel(F.col("doc_id"), F.col("seed"))).alias("key"))
    firsts = collections.Counter(r.d for r in keyed.groupBy("seed").agg(F.max_by("doc_id", "key").alias("d")).collect())
    share = np.exp(np.array(weights) / 2) / np.exp(np.array(weights) / 2).sum()
    assert all(abs(firsts[i] / 4000 - p) < 4 * math.sqrt(p * (1 - p) / 4000) for i, p in enumerate(share))


def test_the_noise_matters(spark):
    """By the default temperature, other seeds choose other documents at the margin, and cost hardly a good one."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = quality.fit(docs, labels)
    weighed = quality.stage(quality.weigh(docs.select("doc_id", "text"), fitted).drop("text"), "weighed")
    samples = []
    for seed in range(4):
        keys, least = quality.resample(weighed, fitted, None, None, seed)
        samples.append({r.doc_id for r in keys.where(F.col("key") >= least).collect()})
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert len(set(map(len, samples))) == 1 and len(set.union(*samples) - set.intersection(*samples)) > 0
    assert all(len(s & good) >= 0.98 * len(good) for s in samples)


def test_kth_largest(spark):
    keys = spark.createDataFrame([(float(v % 97) / 7,) for v in range(1000)], "key double")
    want = sorted((float(v % 97) / 7 for v in range(1000)), reverse=True)
    for k in (1, 10, 500, 1000):
        assert quality.kth_largest(keys, k, small=20, bins=4) == want[k - 1]


def plain_score(model, vocabulary, numbers, shares):
    """A text's log10 probability, token by token, every softmax over all words of the model."""
    t, n, total = model.tables, len(model.unigram), 0.0
    for i, (w, share) in enumerate(zip(numbers, shares, strict=True)):
        q = sum(t["position"][p].astype(float) * t["context"][numbers[i - p - 1] if i > p else vocabulary.end] for p in range(lm.POSITIONS))
        groups = [math.exp(q @ g[:-1] + g[-1]) for g in t["group"].astype(float)]
        low = w // model.size * model.size
        words = {v: math.exp(q @ t["word"][v, :-1].astype(float) + t["word"][v, -1]) for v in range(low, min(low + model.size, n))}
        total += math.log10(groups[w // model.size] / sum(groups) * words[w] / sum(words.values())) + share
    return total


def test_scores(spark, docs):
    """Counts, base and score against a plain recount, with all counts sent around and with 300 of them."""
    docs = docs.withColumn("n_tokens", F.lit("x")).withColumn("held_out", F.lit(1))
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    held = {d: d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts}
    counts = collections.Counter(w for d, t in texts if not held[d] for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    for counted in (lm.COUNTED, 300):
        made = {}

        def fitted(own, counted=counted, made=made):
            made["fit"] = lm.fit(own, counted=counted)
            return made["fit"]

        found = lm.score(docs, fitted).collect()
        rows = {r.doc_id: r for r in found}
        assert len(found) == len(texts) and len({tuple(r) for r in found if r.doc_id == -6}) == 1
        _, vocabulary, model = made["fit"]
        hash_of = lambda w: lm.END if w is None else lm.tokens(*lm.K.buffers(pa.array([w])))[0][0]  # noqa: B023, E731
        numbers = {w: int(vocabulary.look_up(np.array([hash_of(w)], np.uint64))[1][0]) for w in {w for _, t in texts for w in t} | {None}}
        rest = [w for w in counts if not numbers[w]]
        assert vocabulary.rest == sum(counts[w] for w in rest) and len(vocabulary.hashes) <= counted
        for i, (d, t) in enumerate(texts):
            r, own = rows[d], [*t, None]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(own), sum(counts[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
            if len(own) < 200 and i % 5 == 0 or d in (-1, -5, None):
                shares = [0.0 if numbers[w] else math.log10((counts[w] + 1) / (vocabulary.rest + len(rest) + 1)) for w in own]
                assert r.score == pytest.approx(plain_score(model, vocabulary, [numbers[w] for w in own], shares), rel=1e-4, abs=1e-3)
        out = [r for r in rows.values() if r.held_out and r.doc_id is not None and r.doc_id >= 0]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score(docs.limit(0)).count() == 0
    assert {r.score for r in lm.score(docs.where("doc_id is null")).collect()} == {0.0}


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    for words in (1, 2, 90, 500):
        model = lm.Model.start(np.sort(rng.poisson(20, words))[::-1])
        trainer = lm.Trainer(model, 1)
        for _ in range(5):
            trainer.read(rng.integers(0, words, (3000, lm.POSITIONS)), rng.integers(0, words, 3000))
        before = np.repeat(rng.integers(0, words, (1, lm.POSITIONS)), words, axis=0)
        assert (10 ** trainer.model.log10(before, np.arange(words))).sum() == pytest.approx(1, abs=1e-4)


def test_training_learns_what_follows():
    """A language in which each word tells the next: far better than the unigram after some passes."""
    rng = np.random.default_rng(4)
    model = lm.Model.start(np.full(40, 1000))
    trainer = lm.Trainer(model, 2)
    for _ in range(30):
        before = rng.integers(0, 40, (8000, lm.POSITIONS))
        trainer.read(before, (before[:, 0] * 7 + 3) % 40)
    before = rng.integers(0, 40, (500, lm.POSITIONS))
    assert trainer.model.log10(before, (before[:, 0] * 7 + 3) % 40).mean() > math.log10(0.25) > model.log10(before, before[:, 0]).mean()
