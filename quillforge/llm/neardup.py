"""MinHash near-duplicate linking with odd sketches.

Method: bands of MinHash samples of every document's distinct word shingles bring candidate pairs
together. The samples are also folded into an odd sketch, a parity bitmap in which each (position,
sample) flips one bit. The population count of two sketches' XOR estimates the similarity
(``estimate``), and candidates whose estimate is too low for the threshold are no links. Of sets up to
WHOLE shingles a second odd sketch holds the whole set, whose count never exceeds the number of
shingles that only one of both has. What passes is confirmed on full sets of words, read from the texts.

Scale: documents with equal sets are one node. In each band bucket every node is paired with one
pivot, chosen anew in each bucket, so a bucket of n nodes gives n - 1 pairs; confirmed links form
components. In a bucket that still has several, nodes outside its largest component are compared
with the nodes of other components, in blocks of BLOCK by BLOCK nodes dealt over all tasks, sketches
inside the join, so that hardly more than the links between components leave it. No pair of
different sets goes untried unless links already connect it. Rows of frequent buckets, pivots and
sets meet broadcast rows (at most 1,000, see ``shared.frequent``) or are dealt over several tasks.

Cases: null, empty or blank texts have no shingles, are linked with nothing and are kept; a text
of fewer words than a shingle is one shingle; very long texts are taken whole; equal rows share one
result; a doc_id with several texts is judged by text, those for which it is the smallest doc_id being
one component; a null doc_id is linked with nothing, has a null component and is kept; empty tables
give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.llm import kernels as K
from quillforge.llm.shared import bound_arrow, frequent, let_go, salted_join, stage
from quillforge.operators.graph import components

WIDTH = 5
ROWS = 5
BANDS = 30
MINHASHES = ROWS * BANDS
#: Bits of the odd sketch of the MinHash samples.
SKETCH = 512
#: Shingles of a set that has a sketch of its own, and that sketch's bits.
WHOLE = 1024
#: Nodes of one side of a block of comparisons.
BLOCK = 256
#: Shingles of the word sets that a worker holds at once while it confirms pairs.
HELD = 100_000
#: The chance that a link's sketches differ too much for it.
LOST = 1e-9
SAMPLED = [f"m{i}" for i in range(SKETCH // 64)]
WORDS = [f"s{i}" for i in range(WHOLE // 64)]

_rng = np.random.default_rng(7)
_FACTORS = (_rng.integers(1, 1 << 31, MINHASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, MINHASHES, dtype=np.uint32)

SIGNED = f"doc_id long, n_shingles long, d0 long, d1 long, {', '.join(f'{w} long' for w in SAMPLED + WORDS)}, bands array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    starts, ends, pointers = K.word_spans(data, offsets, K.SPACE)
    hashes, at = K.windows(K.word_hashes(data, starts, ends), pointers, width)
    out = []
    for r in range(len(offsets) - 1):
        own = np.sort(hashes[at[r] : at[r + 1]])
        if len(own) > 1:
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        out.append(own)
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """MINHASHES samples of each of the sets, none of them empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, y = np.empty((len(sets), MINHASHES), np.uint32), np.empty_like(x)
    for k in range(MINHASHES):
        np.multiply(x, _FACTORS[k], out=y)
        y += _SHIFTS[k]
        out[:, k] = np.minimum.reduceat(y, at)
    return out


def _parities(bits: np.ndarray, rows: np.ndarray, n: int, size: int) -> np.ndarray:
    """``n`` bitmaps of ``size`` bits, as 64-bit words; each (row, bit) flips one."""
    flips = np.bincount(rows * size + bits, minlength=n * size) & 1
    return np.packbits(flips.reshape(n, size).astype(np.uint8), axis=1).view(np.uint64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """The odd sketch of each row of MinHash samples."""
    n, k = samples.shape
    marks = K.mix(samples.astype(np.uint64) + (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32)))
    return _parities((marks % np.uint64(SKETCH)).astype(np.int64).ravel(), np.repeat(np.arange(n), k), n, SKETCH)


def whole_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The odd sketch of each set of WHOLE elements at most; nothing for larger ones."""
    held = [own if len(own) <= WHOLE else own[:0] for own in sets]
    bits = (np.concatenate(held) % np.uint64(WHOLE)).astype(np.int64)
    return _parities(bits, np.repeat(np.arange(len(sets)), [len(x) for x in held]), len(sets), WHOLE)


def estimate(bits: Column) -> Column:
    """The similarity of two sets whose odd sketches differ in so many bits.

    A sample that differs puts two elements into the symmetric difference, and d elements leave
    SKETCH / 2 * (1 - exp(-2 d / SKETCH)) bits set on average.
    """
    return F.greatest(F.lit(0.0), 1 + SKETCH / (4 * MINHASHES) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * bits / SKETCH)))


def differing_bits(left: str, right: str, words: list[str] = SAMPLED) -> str:
    return " + ".join(f"bit_count({left}.{w} ^ {right}.{w})" for w in words)


def most_bits(percent: int) -> int:
    """How many bits the sketches of a link differ in at most, but for a chance of LOST: twice the number
    of samples that differ, which is binomial."""
    p, chance, m = 1 - percent / 100, 0.0, -1
    while chance < 1 - LOST and m < MINHASHES:
        m += 1
        chance += math.comb(MINHASHES, m) * p**m * (1 - p) ** (MINHASHES - m)
    return 2 * m


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.empty((len(samples), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(samples), b + 1, np.uint64)
        for j in range(ROWS):
            h = K.mix(h * K.SHINGLE_FACTORS[j] + samples[:, b * ROWS + j])
        keys[:, b] = h
    return keys


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        for first, last, part, at in K.chunks(data, offsets):
            sets = shingle_sets(part, at)
            n = last - first
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            digests = np.zeros((n, 2), np.int64)
            sketch = np.zeros((n, len(SAMPLED) + len(WORDS)), np.int64)
            values = pa.array([], pa.int64())
            if len(full):
                own = [sets[r] for r in full]
                digests[full] = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in own]
                samples = minhashes(own)
                sketch[full] = np.hstack([odd_sketches(samples), whole_sketches(own)]).view(np.int64)
                values = pa.array(band_keys(samples).view(np.int64).ravel())
            lengths = np.where(sizes > 0, BANDS, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)
            columns = [*(np.ascontiguousarray(digests[:, i]) for i in range(2)), *(np.ascontiguousarray(c) for c in sketch.T)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n).cast(pa.int64()), pa.array(sizes), *map(pa.array, columns), bands], names=["doc_id", "n_shingles", "d0", "d1", *SAMPLED, *WORDS, "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set size, set digest, odd sketches and band keys of each row."""
    bound_arrow(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sign, SIGNED)


def word_set(text: str) -> set[tuple[bytes, ...]]:
    """A text's distinct shingles, as words."""
    words = text.encode("utf-8", "replace").lower().split()
    return set(zip(*(words[i:] for i in range(WIDTH)), strict=False)) if len(words) >= WIDTH else {tuple(words)} if words else set()


class _Sets(dict):
    """Word sets of a batch's texts by number, about HELD shingles of them at a time."""

    def __init__(self, texts: pa.StringArray) -> None:
        super().__init__()
        self.texts, self.size = texts, 0

    def __missing__(self, at: int) -> set[tuple[bytes, ...]]:
        own = word_set(self.texts[at].as_py())
        if self.size + len(own) > HELD:
            self.clear()
            self.size = 0
        self[at] = own
        self.size += len(own)
        return own


def _verify(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ia, sa), (ib, sb) = ((texts.indices.to_pylist(), _Sets(texts.dictionary)) for texts in (batch.column(c).dictionary_encode() for c in ("ta", "tb")))
            keep = []
            for i, j in zip(ia, ib, strict=True):
                x, y = sa[i], sb[j]
                both = len(x & y)
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def may_link(percent: int) -> str:
    """SQL condition on nodes x and y: sizes and sketches allow a link.

    Linked sets of n and m differ in c * (n + m) elements at most, c = (1 - p) / (1 + p).
    """
    p = percent / 100
    sizes = f"100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles)"
    whole = f"greatest(x.n_shingles, y.n_shingles) > {WHOLE} or {differing_bits('x', 'y', WORDS)} <= 1e-6 + {(1 - p) / (1 + p)!r} * (x.n_shingles + y.n_shingles)"
    return f"{sizes} and {differing_bits('x', 'y')} <= {most_bits(percent)} and ({whole})"


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The staged pairs (a, b) whose full sets are similar enough; texts: node, text."""
    total = pairs.count()
    x, y = (texts.select(F.col("node").alias(n), F.col("text").alias(f"t{n}")) for n in "ab")
    near = stage(salted_join(pairs, "a", total, x), "near") if total else pairs.withColumn("ta", F.lit(""))
    return salted_join(near, "b", total, y).select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a long, b long")


def _by_bucket(rows: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
    """``rows`` (key, ...) joined to their buckets (key, n, ...), the frequent ones of which are broadcast."""
    hot = F.broadcast(frequent(buckets, total))
    few = rows.join(hot, "key", "left_anti").join(buckets.join(frequent(buckets, total).select("key"), "key", "left_anti"), "key")
    return rows.join(hot, "key").unionByName(few)


def _apart(placed: DataFrame, sizes: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs (a, b) of a bucket's nodes in different components that may be links.

    placed: key, n, node, label; the pivot, which all others have met, is not among them.
    """
    parts = placed.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("parts"))
    mixed = stage(parts.where("parts > 1").select("key", "n", F.col("top.label").alias("main"), (F.col("n") - F.col("top.c")).alias("others")), "mixed")
    left = _by_bucket(placed.drop("n"), mixed, total)
    spread = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), spread(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), spread(n) - 1))
    left = stage(left.withColumn("i", own("others", 1)).withColumn("j", own("n", 2)).join(sizes, "node"), "apart")
    x = left.where("label <> main").withColumn("j", every("n")).alias("x")
    y = left.withColumn("i", every("others")).alias("y")
    # Two nodes outside the largest component meet once, by label.
    met = x.join(y, F.expr(f"x.key = y.key and x.i = y.i and x.j = y.j and (x.label < y.label or (y.label = y.main and x.label <> y.label)) and {may_link(percent)}"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable. percent: 80 at least, for which BANDS suffice.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent: 80 to 100")
    signed = stage(signatures(docs), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    groups = stage(full.groupBy("d0", "d1").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "groups")
    named = groups.select(F.col("node").alias("doc_id"), F.col("d0").alias("g0"), F.col("d1").alias("g1"))
    nodes = full.join(named, "doc_id").where("d0 = g0 and d1 = g1").select(F.col("doc_id").alias("node"), "n_shingles", *SAMPLED, *WORDS, "bands").dropDuplicates(["node", "n_shingles", *SAMPLED, *WORDS])
    nodes = stage(nodes, "nodes")
    sizes = nodes.drop("bands")
    total = nodes.count() * BANDS
    entries = nodes.select("node", F.explode("bands").alias("key"))
    pivots = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("m")).where("n > 1").select("key", "n", F.col("m").bitwiseXOR(F.col("key")).alias("pivot"))
    entries = stage(_by_bucket(entries, stage(pivots, "pivots"), total).where("node <> pivot"), "buckets")

    pairs = stage(entries.select("node", "pivot").distinct(), "pairs")
    met = pairs.count()
    ends = salted_join(pairs, "pivot", met, sizes.select(F.col("node").alias("pivot"), F.struct(*(c for c in sizes.columns if c != "node")).alias("x")))
    ends = ends.join(sizes.select("node", F.struct(*(c for c in sizes.columns if c != "node")).alias("y")), "node")
    tried = stage(ends.where(may_link(percent)).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "tried")
    held = entries.select("node").union(entries.select(F.col("pivot").alias("node"))).distinct()
    plain = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    texts = stage(plain.join(held, "node"), "texts")
    links = stage(_confirmed(tried, texts, percent).distinct(), "links")
    labels = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    # What the pivots left apart: nodes of a bucket of three or more whose components differ.
    placed = stage(entries.where("n > 2").select("key", "n", "node").join(labels, "node", "left").select("key", "n", "node", F.coalesce("label", "node").alias("label")), "placed")
    rest = stage(_apart(placed, sizes, percent, total).join(tried, ["a", "b"], "left_anti"), "rest")
    more = stage(_confirmed(rest, texts, percent).distinct(), "more")
    if more.limit(1).count():
        # Components are joined by the links found between them.
        ends = more.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
        over = components(ends.select(F.coalesce("la", "a").alias("src"), F.coalesce("lb", "b").alias("dst")))
        labels = labels.join(over.toDF("label", "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label")).unionByName(over.join(labels.select("node"), "node", "left_anti"))
    found = stage(groups.join(labels, "node", "left").select("d0", "d1", "n", F.coalesce("label", "node").alias("label")), "found")
    hot = F.broadcast(frequent(found, total // BANDS))
    result = signed.select("doc_id", "n_shingles", "d0", "d1")
    few = result.join(hot, ["d0", "d1"], "left_anti").join(found, ["d0", "d1"], "left")
    result = few.unionByName(result.join(hot, ["d0", "d1"]))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


#: The contract in SQL, over all pairs of whole texts.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
ways as (select a, b from links union select b, a from links),
reach as (select a as node, b as other from ways union select r.node, v.b from reach r join ways v on v.a = r.other),
low as (select node, min(other) as o from reach group by 1)
select w.doc_id, coalesce(n.n, 0)::BIGINT as n_shingles, least(w.doc_id, coalesce(o, w.doc_id))::BIGINT as component_id, least(w.doc_id, coalesce(o, w.doc_id)) = w.doc_id as kept
from w left join n using (doc_id) left join low on low.node = w.doc_id
"""
