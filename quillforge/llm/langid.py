"""Language identification by language-bitmask n-gram filters.

Method: byte n-grams (sizes GRAMS) that are typical of a language are put into that language's Bloom
filter. The filters are bit-sliced: slot s of the table holds one bit a language, so ANDing a gram's
HASHES slots gives the mask of all languages that contain it. A text's grams give a count of hits
per language; each is corrected for that filter's false-positive rate (its share of set slots to the
power HASHES), and the largest decides. The score is its share of the corrected counts.

Fitting uses labelled rows, SAMPLE_ROWS at most (drawn by hash of doc_id, whole texts): all rows of rare
languages, and as many of each other as leaves the total within the bound. A gram counts for a language
if it comes LEAST_COUNT times or more, from a share of LEAST_SHARE of the language's grams, and of at least
TYPICAL of the share in the language that has it most; so at most 1 / LEAST_SHARE grams a language reach the
driver, for which a filter of 2**22 slots is enough.

Cases: ``und`` with score 0 where the text is null or has no letter, or where nothing was learned;
a text whose grams no filter has gets the most frequent language with score 0; the largest share wins,
ties go to the more frequent language, then by name; rows without lang aren't learned from; a null
doc_id counts as held out in the query; very long texts are read whole; repeated rows have equal results;
empty tables give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import kernels as K
from quillforge.llm.shared import bound_arrow, stage

GRAMS = (3, 5)
HASHES = 3
SAMPLE_ROWS = 20_000
LEAST_SHARE, LEAST_COUNT = 4e-6, 2
TYPICAL = 0.25
#: Slots for each gram put in.
SLOTS_PER_GRAM = 16

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters, all other ASCII as spaces, with a space around each text; row pointers."""
    lengths = np.diff(offsets)
    rows = len(lengths)
    out = np.full(len(data) + 2 * rows, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, lengths)] = _FOLD[data]
    # Capitals of the Latin-1 letters, two bytes each in UTF-8.
    big = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
    out[big] += 32
    return out, offsets + 2 * np.arange(rows + 1)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each) of all n-grams with no two spaces in a row."""
    text, at = _folded(data, offsets)
    space = text == 32
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    hashes, rows = [], []
    for n in GRAMS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint64)
        gap = np.zeros(m, bool)
        for j in range(n):
            code = (code << np.uint64(8)) | text[j : j + m]
            if j:
                gap |= space[j - 1 : j - 1 + m] & space[j : j + m]
        keep = ~gap & (row_of[:m] == row_of[n - 1 :])
        hashes.append(K.mix(code[keep] + np.uint64(n << 56)))
        rows.append(row_of[:m][keep])
    return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = np.zeros(256, np.int64)
    letter[65:91] = letter[97:123] = 1
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    plain = np.concatenate([[0], np.cumsum(letter[data])])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for r in np.flatnonzero(~out & (high[offsets[1:]] > high[offsets[:-1]])):
        out[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``planes`` has 64 languages a row; ``languages`` by frequency."""

    languages: list[str]
    planes: np.ndarray

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray]) -> Filters:
        most = max((len(m) for m in members), default=1)
        slots = 1 << int(np.ceil(np.log2(max(most, 1) * SLOTS_PER_GRAM)))
        planes = np.zeros((max(1, -(-len(languages) // 64)), slots), np.uint64)
        for i, own in enumerate(members):
            for at in cls._slots(own, slots):
                planes[i // 64][at] |= np.uint64(1 << (i % 64))
        return cls(languages, planes)

    @staticmethod
    def _slots(hashes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
        for k in range(HASHES):
            yield ((hashes >> np.uint64(20 * k)) & np.uint64(slots - 1)).astype(np.int64) if 20 * k + 24 <= 64 else (K.mix(hashes + np.uint64(k)) & np.uint64(slots - 1)).astype(np.int64)

    def false_rates(self) -> np.ndarray:
        fills = [np.count_nonzero(self.planes[i // 64] & np.uint64(1 << (i % 64))) / self.planes.shape[1] for i in range(len(self.languages))]
        return np.array(fills) ** HASHES

    def counts(self, hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(hits of each row in each language, grams of each row)."""
        at = list(self._slots(hashes, self.planes.shape[1]))
        out = np.zeros((n_rows, len(self.languages)))
        for p, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for more in at[1:]:
                mask &= plane[more]
            for i in range(p * 64, min(len(self.languages), p * 64 + 64)):
                hit = (mask & np.uint64(1 << (i % 64))) != 0
                out[:, i] = np.bincount(rows[hit], minlength=n_rows)
        return out, np.bincount(rows, minlength=n_rows)

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        score, names = np.zeros(n), ["und"] * n
        if not self.languages:
            return names, score
        hits, total = self.counts(*grams(data, offsets), n)
        rates = self.false_rates()
        true = np.clip((hits - total[:, None] * rates) / np.maximum(1 - rates, 1e-9), 0, None)
        best = np.argmax(true, axis=1)
        whole = true.sum(axis=1)
        score = np.where(whole > 0, true[np.arange(n), best] / np.maximum(whole, 1e-12), 0.0)
        letters = _has_letter(data, offsets)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, last, part, at in K.chunks(data, offsets, 1 << 22):
            hashes, rows = grams(part, at)
            own = langs[first:last]
            for lang in sorted(set(own)):
                found, n = np.unique(hashes[(own == lang)[rows]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _draws(sizes: dict[str, int], most: int) -> dict[str, int]:
    """How many rows of each language to learn from: the smallest whole, the others alike, ``most`` in all."""
    out, left = {}, most
    for i, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[lang] = min(sizes[lang], left // (len(sizes) - i))
        left -= out[lang]
    return out


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters from ``labelled`` (doc_id, text, lang); sample_rows: bound on the rows learned from."""
    bound_arrow(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    drawn = F.create_map(*(F.lit(x) for lang, n in _draws(sizes, sample_rows).items() for x in (lang, int(2**32 * n / sizes[lang])))) if sizes else F.lit(None).cast("map<string,bigint>")
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(2**32)) < F.try_element_at(drawn, F.col("lang")))
    counted = stage(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sums = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    # One row a language, as many as in the labels' own count above.
    shares = counted.where(F.col("n") >= LEAST_COUNT).join(F.broadcast(sums), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= LEAST_SHARE)
    top = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("own"))
    typical = top.select("gram", F.explode("own").alias("o"), "most").where(F.col("o.share") >= TYPICAL * F.col("most")).select("o.lang", "gram")
    frequent = [r.lang for r in sorted(sums.collect(), key=lambda r: (-r.total, r.lang))]
    found: dict[str, list[int]] = {name: [] for name in frequent}
    table = typical.toArrow()
    names, codes = np.array(table.column("lang").to_pylist(), object), np.array(table.column("gram").to_pylist(), np.int64).view(np.uint64)
    return Filters.build(frequent, [codes[names == name] if len(codes) else np.zeros(0, np.uint64) for name in found])


def _predict(filters: Filters):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            for first, last, part, at in K.chunks(data, offsets):
                names, score = filters.decide(part, at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first).cast(pa.int64()), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of each row, from its text alone."""
    bound_arrow(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_predict(filters), "doc_id long, lang_pred string, score double")
