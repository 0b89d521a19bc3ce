"""Token counts through a digest cache.

Method: a text's key is the digest of its normalised content with the digest of the tokenizer's
file. Keys are joined to a cache table of stored counts; only distinct misses are encoded, and their
counts are appended to the cache as one new folder of Parquet files.

Scale: keys alone are counted, map-side combined, and joined to the cache; texts move only where their
key is missing. MANY missing keys or fewer are broadcast, so that a nearly full cache moves hardly a
text; more are met by an aggregation on the key, map-side combined, so that a text that a third of all rows
repeat reaches the encoder once. Counts of frequent keys (at most 1,000) return by broadcast, others by
a join. Appending is one committed write; two writers at worst store a key twice, which readers combine.

Encoding: byte-level BPE files without normaliser or template, whose vocabulary is also at hand as a
rank file, are encoded from ranks, special strings split off as the library does; any other file
by the library on whole texts. Tests hold both against the library.

Cases: null counts as the empty text (0 tokens); very long texts are encoded whole; equal texts, and
repeated rows, share one cache row; special strings inside texts are single tokens; a null doc_id stays
null; empty tables give no rows and leave the cache as it is; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm.shared import bound_arrow, frequent, fresh_path, kept, stage

#: Missing keys that are broadcast: 32 bytes each.
MANY = 100_000
CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, read where the driver runs."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_letters() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_ranks(path: str, pattern: str) -> Callable[[str], int] | None:
    """A counter from the rank file beside a byte-level JSON file; None where they aren't the same."""
    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(ranks_path):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = spec.get("added_tokens") or []
    if spec.get("normalizer") or (spec.get("post_processor") or {}).get("type", "ByteLevel") != "ByteLevel" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    import tiktoken

    from quillforge.llm.bpe import load_ranks

    ranks, letters = load_ranks(ranks_path), _byte_letters()
    names = {t["content"] for t in added}
    if {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in names} != ranks:
        return None
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not names:
        return lambda text: len(encode(text))
    special = re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True))))
    # Parts between special strings are texts of their own; each special string is one token.
    return lambda text: (sum(len(encode(part)) for part in parts) + len(parts) - 1) if len(parts := special.split(text)) > 1 else len(encode(text))


def library_counter(path: str) -> Callable[[str], int]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


def counter(path: str, pattern: str) -> Callable[[str], int]:
    """One a worker process and tokenizer file."""
    return kept(("counter", path, pattern), lambda: _by_ranks(path, pattern) or library_counter(path))


def _encode(path: str, pattern: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            counts = [count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, pattern: str, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of ``docs``.

    path: the tokenizer's file, on every node. cache: folder of the cache table, in a file system that
    driver and executors share; by default a new one. Counts of the misses are in it afterwards.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    cache = cache or fresh_path(spark, "token-cache")
    version = tokenizer_version(path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest), "digests")
    copies = stage(sized.groupBy("digest").agg(F.count("*").alias("n")), "copies")
    known = _stored(spark, cache, version)
    missing = stage(copies.select("digest").join(known, "digest", "left_anti"), "missing")
    keyed = docs.select(text.alias("text"), digest)
    few = missing.limit(MANY + 1).count() <= MANY
    keyed = keyed.join(F.broadcast(missing), "digest", "left_semi") if few else keyed
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = misses if few else misses.join(known, "digest", "left_anti")
    encoded = misses.select("digest", "text").mapInArrow(_encode(path, pattern), "digest binary, n_tokens long")
    encoded.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = _stored(spark, cache, version)
    hot = F.broadcast(frequent(copies, sized.count()).select("digest").join(counts, "digest"))
    rest = sized.join(hot, "digest", "left_anti").join(counts, "digest")
    return sized.join(hot, "digest").unionByName(rest).select("doc_id", "n_bytes", "n_tokens")


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of the cache; nothing where there is no such folder yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
