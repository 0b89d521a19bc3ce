"""Quality selection by importance resampling over hashed n-gram models, with Gumbel top-k.

Method: words, pairs of neighbouring words, and runs of three word shapes (first and last character
class, repetition of the word before) are hashed into BUCKETS features. One generative model counts the
features of all documents (raw), one those of good labelled documents (target), smoothed towards the
raw one. A document's log ratio is the log of target / raw over its features; its log weight is that of a
text of LENGTH like features, so that length does not decide. Keys are log weights over the temperature plus
standard Gumbel noise, fixed by doc_id and seed, and the k documents of the largest keys are the sample: k
draws without replacement, the chance of a document in proportion to exp(log weight / temperature).

k and the temperature are the caller's, or follow from the labels, each scored by models that have not
seen it: k is how many documents reach the log weight that best parts good from bad labels, and the
temperature the greatest at which the noise is expected to cost LOSS of the good labels at most.

Toxic documents are no candidates. A second model, from toxic labels, has for each word (lower-cased,
TOXIC_BUCKETS buckets) the log of its share of toxic documents over that of other ones, smoothed by
TOXIC_SMOOTH. A document is as toxic as its strongest word, so neither length nor clean words dilute
it; from which weight on it is toxic is found like the log weight's level, by models of the other fold.

Scale: raw counts cover all documents, in one pass, and each document is scored once and staged; labels
are a sample of LABELS rows at most (drawn by hash of doc_id), which bounds what is broadcast. Models are
BUCKETS numbers, and the buckets of words that toxic labels have, TOXIC_BUCKETS at most. The k-th
largest key is found by repeated histograms, never by sorting or collecting keys.

Cases: documents without words (null, empty, blank) have a null log weight and are not kept; very long
texts are taken whole; without both good and bad labels all others are kept; without both toxic and
other labels nothing is toxic; ties at the k-th key are all kept; labels without a document and null labels
count for nothing; repeated rows share their fate; a null doc_id has noise like any other; empty tables give
no rows; other columns, whatever their names, pass through ``keep`` and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.llm import kernels as K
from quillforge.llm.shared import bound_arrow, let_go, stage

BUCKETS = 1 << 16
LABELS = 20_000
#: Weight of the raw model in the target model, in features for each bucket.
SMOOTH = 1.0
#: Share of good labels that the threshold must keep.
KEEP = 0.99
#: Log weights are those of a text of so many features.
LENGTH = 100
#: Share of good labels that the noise may cost by the default temperature.
LOSS = 0.002
SEED = 11
#: Buckets of the toxicity model's words.
TOXIC_BUCKETS = 1 << 20
#: Share of documents added to a word's share of toxic and of other documents.
TOXIC_SMOOTH = 0.01

_KIND = np.zeros(256, np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_OTHER = np.flatnonzero(_KIND == 0)
_KIND[_OTHER] = 8 + _OTHER.astype(np.uint64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row of each) of all rows' features: words, pairs of words, runs of three shapes."""
    starts, ends, pointers = K.word_spans(data, offsets, K.SPACE)
    words = K.word_hashes(data, starts, ends, None)
    again = np.zeros(len(words), np.uint64)
    again[1:] = words[1:] == words[:-1]
    shapes = K.mix(_KIND[data[starts]] * np.uint64(4096) + _KIND[data[ends - 1]] * np.uint64(8) + again * np.uint64(2) + (ends - starts > 20).astype(np.uint64))
    found = [(words, pointers), K.windows(words, pointers, 2), K.windows(shapes, pointers, 3)]
    rows = [np.repeat(np.arange(len(offsets) - 1), np.diff(at)) for _, at in found]
    return (np.concatenate([h for h, _ in found]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(rows)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of a partition: raw, and of good labels by fold."""
    let_go()
    sums = np.zeros((3, BUCKETS), np.int64)
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        good = batch.column("fold").to_numpy(zero_copy_only=False)
        for first, last, part, at in K.chunks(data, offsets):
            buckets, rows = features(part, at)
            fold = good[first:last][rows]
            sums[0] += np.bincount(buckets, minlength=BUCKETS)
            for f in (0, 1):
                sums[1 + f] += np.bincount(buckets[fold == f], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), *(pa.array(s) for s in sums)], names=["bucket", "raw", "good0", "good1"])


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / raw) of each feature; the target is smoothed by the raw model."""
    base = (raw + 1e-3) / (raw.sum() + 1e-3 * len(raw))
    weight = SMOOTH * len(raw)
    return np.log((target + weight * base) / (target.sum() + weight)) - np.log(base)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row pointers) of all rows' lower-cased words."""
    starts, ends, pointers = K.word_spans(data, offsets, K.NOT_ALNUM)
    return (K.word_hashes(data, starts, ends) % np.uint64(TOXIC_BUCKETS)).astype(np.int64), pointers


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each fold and label (2 * fold + toxic) have a word."""
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        kind = batch.column("fold").to_numpy().astype(np.int64) * 2 + batch.column("toxic").to_numpy()
        for first, last, part, at in K.chunks(data, offsets):
            buckets, pointers = _words(part, at)
            own = np.unique(np.repeat(np.arange(last - first), np.diff(pointers)) * TOXIC_BUCKETS + buckets)
            found, n = np.unique(kind[first:last][own // TOXIC_BUCKETS] * TOXIC_BUCKETS + own % TOXIC_BUCKETS, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found // TOXIC_BUCKETS), pa.array(found % TOXIC_BUCKETS), pa.array(n.astype(np.int64))], names=["kind", "bucket", "n"])


def _strongest(buckets: np.ndarray, weights: np.ndarray):  # noqa: ANN202
    """Each row's largest weight, by the model of the other fold; 0 for words that toxic labels don't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, TOXIC_BUCKETS))
        table[:, buckets] = weights
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            fold = batch.column("fold").to_numpy()
            found = []
            for first, _, part, at in K.chunks(data, offsets):
                own, pointers = _words(part, at)
                found += [float(table[1 - fold[first + r]][own[pointers[r] : pointers[r + 1]]].max(initial=0)) for r in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.float64())], names=["toxic", "w"])

    return run


def fit_toxic(labelled: DataFrame) -> np.ndarray:
    """Buckets of the words that make a document toxic, from ``labelled`` (text, toxic, fold)."""
    sizes = np.zeros((2, 2))
    for row in labelled.groupBy("fold", "toxic").count().collect():
        sizes[row.fold, row.toxic] = row["count"]
    if not sizes.sum(axis=0).all():
        return np.zeros(0, np.int64)
    each = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)]
    seen = labelled.mapInArrow(_presence, "kind long, bucket long, n long").groupBy("bucket").agg(*each).where("n1 + n3 > 0").toArrow()
    counts = np.array([seen.column(f"n{k}").to_numpy() for k in range(4)], float).reshape(2, 2, -1)

    def ratio(n: np.ndarray, of: np.ndarray) -> np.ndarray:
        clean, toxic = (n[k] / max(of[k], 1) + TOXIC_SMOOTH for k in (0, 1))
        return np.log(toxic / clean)

    buckets = seen.column("bucket").to_numpy()
    weights = np.array([ratio(counts[f], sizes[f]) for f in (0, 1)])
    rows = labelled.select("text", "toxic", "fold").mapInArrow(_strongest(buckets, weights), "toxic int, w double").toArrow()
    level = -_threshold(-rows.column("w").to_numpy(), 1 - rows.column("toxic").to_numpy())
    return buckets[ratio(counts.sum(axis=0), sizes.sum(axis=0)) > level]


def _score(ratios: np.ndarray, toxic: np.ndarray, names: list[str]):  # noqa: ANN202
    """Behind a batch's columns: log ratio and log weight (null without words), and whether a word is toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(TOXIC_BUCKETS, bool)
        table[toxic] = True
        for batch in batches:
            data, offsets = K.buffers(batch.column("text").cast(pa.string()))
            sums, sizes, bad = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for _, _, part, at in K.chunks(data, offsets):
                n = len(at) - 1
                buckets, rows = features(part, at)
                sums.append(np.bincount(rows, ratios[buckets], minlength=n))
                sizes.append(np.bincount(rows, minlength=n))
                words, pointers = _words(part, at)
                found = np.concatenate([[0], np.cumsum(table[words])])[pointers]
                bad.append(found[1:] > found[:-1])
            total, n = np.concatenate(sums), np.concatenate(sizes)
            none = n == 0
            columns = [pa.array(total, mask=none), pa.array(total / np.maximum(n, 1) * LENGTH, mask=none), pa.array(np.concatenate(bad))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return run


def _sampled(labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, good, toxic and fold (1 or 0 each) of ``bound`` labels at most, as far as hashing tells."""
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    total = own.count()
    if total > bound:
        own = own.where(F.expr(f"pmod(xxhash64(doc_id, 'label'), 4294967296) < {int(2**32 * bound / total)}"))
    good = F.when((F.col("quality") > 0) & (F.col("toxic") == 0), 1).otherwise(0)
    return own.select("doc_id", good.alias("good"), (F.col("toxic") > 0).cast("int").alias("toxic"), F.expr("cast(pmod(xxhash64(doc_id, 'fold'), 2) as int)").alias("fold"))


def _threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The score that best parts good (1) from bad (0), keeping KEEP of the good."""
    order = np.argsort(-scores)
    s, g = scores[order], good[order]
    last = np.concatenate([s[1:] != s[:-1], [True]])
    kept_good, kept_bad = np.cumsum(g) / g.sum(), np.cumsum(1 - g) / (1 - g).sum()
    value = np.where(last & (kept_good >= KEEP), kept_good - kept_bad, -2)
    at = int(np.argmax(value))
    # Half way to the next lower score, so that like documents are kept.
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def kept_share(weights: np.ndarray, level: float, temperature: float) -> np.ndarray:
    """The chance of each weight to be in a sample of as many as reach ``level``, of a large table like these."""
    x = np.clip((weights - level) / temperature, -700, 700)
    wanted, low, high = (weights >= level).mean(), -700.0, 700.0
    chance = lambda c: -np.expm1(-np.exp(np.clip(x - c, -700, 30)))
    for _ in range(60):
        cut = (low + high) / 2
        low, high = (cut, high) if chance(cut).mean() > wanted else (low, cut)
    return chance(high)


def warmest(weights: np.ndarray, good: np.ndarray, level: float) -> float:
    """The greatest temperature, of steps of a tenth, at which LOSS of the good at most are lost to the noise."""
    best, alone = 1e-3, (weights[good == 1] >= level).mean()
    for temperature in 0.05 * 1.1 ** np.arange(120):
        if alone - kept_share(weights, level, temperature)[good == 1].mean() > LOSS:
            break
        best = float(temperature)
    return best


@dataclass
class Fitted:
    """log(target / raw) of each bucket, buckets of toxic words, the level that parts good from bad, and the temperature."""

    ratios: np.ndarray
    toxic: np.ndarray
    level: float
    temperature: float


def fit(docs: DataFrame, labels: DataFrame, sample: int = LABELS) -> Fitted:
    """Models of ``docs`` (doc_id, text) and of ``sample`` labels (doc_id, quality, toxic) at most."""
    spark = docs.sparkSession
    bound_arrow(spark)
    known = F.broadcast(stage(_sampled(labels, sample), "labels"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = plain.join(known, "doc_id", "left").select("text", F.when(F.col("good") == 1, F.col("fold")).otherwise(-1).alias("fold"))
    sums = np.zeros((3, BUCKETS))
    tally = marked.mapInArrow(_tally, "bucket long, raw long, good0 long, good1 long").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "good0", "good1"))).toArrow()
    sums[:, tally.column("bucket").to_numpy()] = [tally.column(c).to_numpy() for c in ("raw", "good0", "good1")]
    raw, folds = sums[0], sums[1:]
    labelled = stage(plain.join(known, "doc_id").select("text", "good", "toxic", "fold"), "labelled")
    weights, good = [], []
    for f in (0, 1):
        seen = labelled.where(F.col("fold") == f).select("text", "good").mapInArrow(_score(log_ratios(raw, folds[1 - f]), np.zeros(0, np.int64), ["ratio", "w", "bad"]), "text string, good int, ratio double, w double, bad boolean")
        rows = seen.where("w is not null").select("good", "w").toArrow()
        weights.append(rows.column("w").to_numpy())
        good.append(rows.column("good").to_numpy())
    weights, good = np.concatenate(weights), np.concatenate(good)
    parted = 0 < good.sum() < len(good)
    level = _threshold(weights, good) if parted else -np.inf
    return Fitted(log_ratios(raw, folds.sum(axis=0)), fit_toxic(labelled), level, warmest(weights, good, level) if parted else 1.0)


def weigh(docs: DataFrame, fitted: Fitted, prefix: str = "") -> DataFrame:
    """``docs`` with each document's log_ratio, log_weight and whether it is toxic, names behind ``prefix``."""
    bound_arrow(docs.sparkSession)
    names = [f"{prefix}{n}" for n in ("log_ratio", "log_weight", "toxic")]
    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(_score(fitted.ratios, fitted.toxic, names), T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)]))


def gumbel(doc_id: Column, seed: Column | int = SEED) -> Column:
    """Standard Gumbel noise, fixed by doc_id and seed."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    unit = (F.expr("0.5D") + F.pmod(F.xxhash64(doc_id.cast("string"), seed), F.lit(1 << 52))) / float(1 << 52)
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, k: int, small: int = 5000, bins: int = 1024) -> float:
    """The k-th largest of column ``key``, by histograms of ever smaller ranges."""
    low, high, above = *keys.agg(F.min("key"), F.max("key")).first(), 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        if high <= low:
            return low
        n = inside.count()
        if n <= small:
            return sorted((r.key for r in inside.collect()), reverse=True)[k - above - 1]
        width = (high - low) / bins
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).alias("b")
        tally = {r.b: r for r in inside.groupBy(at).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(tally, reverse=True):
            if above + tally[b].n >= k:
                low, high = tally[b].lo, tally[b].hi
                break
            above += tally[b].n


def resample(weighed: DataFrame, fitted: Fitted, k: int | None, temperature: float | None, seed: int, prefix: str = "") -> tuple[DataFrame, float]:
    """(``weighed``, staged, with its key, null for toxic documents and those without a weight; the k-th largest key)."""
    weight = F.col(f"{prefix}log_weight")
    noisy = weight / float(temperature or fitted.temperature) + gumbel(F.col("doc_id").cast("long"), seed)
    keys = stage(weighed.withColumn(f"{prefix}key", F.when(~F.col(f"{prefix}toxic"), noisy)), "keys")
    own = keys.where(F.col(f"{prefix}key").isNotNull()).select(weight.alias("weight"), F.col(f"{prefix}key").alias("key"))
    n = own.where(F.col("weight") >= fitted.level).count() if k is None else min(k, own.count())
    return keys, kth_largest(own, n) if n else float("inf")


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_ratio, log_weight, toxic, key and kept of each row of ``docs``; k and temperature by the labels if not given."""
    fitted = fit(docs, labels)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys, least = resample(weigh(plain, fitted).drop("text"), fitted, k, temperature, seed)
    return keys.select("doc_id", "log_ratio", "log_weight", "toxic", "key", F.coalesce(F.col("key") >= least, F.lit(False)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that ``select`` keeps, with their columns."""
    fitted = fit(docs, labels)
    own = [f"`{c}`" for c in docs.columns]
    prefix = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    keys, least = resample(weigh(docs.withColumn("text", F.col("text").cast("string")), fitted, prefix), fitted, k, temperature, seed, prefix)
    return keys.where(F.col(f"{prefix}key") >= least).select(*own)
