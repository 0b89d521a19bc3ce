"""Structured extraction behind an interface, and what it would cost.

Hosted models are not reproduced: ``rule_based`` is a deterministic stand-in that keeps the pipeline
runnable offline, and its verdicts say nothing about the quality of a real extractor.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions.text import cost_usd
from quillforge.operators.grounding import holds

#: Dollars per million tokens in and out, by size of model, and the size that prices unknown models.
#: Hosted models' own names are no part of this engine: give them as rows of a table like this one.
PRICES = (("large", 5.0, 25.0), ("medium", 3.0, 15.0), ("small", 1.0, 5.0))
DEFAULT_MODEL = "medium"

EXTRACTED = "doc_id long, defines_concept boolean, definition string, verbatim_quote string, section string, novelty_claims array<string>"
Extractor = Callable[[pd.DataFrame, str], pd.DataFrame]


def rule_based(pdf: pd.DataFrame, concept: str) -> pd.DataFrame:
    """Takes the first sentence that names the concept as its definition and quote."""
    sentence = re.compile(rf"[^.\n]*{re.escape(concept)}[^.\n]*\.?", re.IGNORECASE)
    found = [sentence.search(text or "") for text in pdf.text]
    quotes = [m[0].strip() if m else "" for m in found]
    yes = [bool(q) for q in quotes]
    return pd.DataFrame({"doc_id": pdf.doc_id, "defines_concept": yes, "definition": quotes, "verbatim_quote": quotes, "section": "", "novelty_claims": [[] for _ in yes]})


def priced(uses: DataFrame, prices: tuple[tuple[str, float, float], ...] = PRICES, default: str = DEFAULT_MODEL) -> DataFrame:
    """``uses`` (model, tokens_in, tokens_out, ...) with their ``usd``; a model without a price has the default's."""
    known = {model: (a, b) for model, a, b in prices}
    rate = lambda i: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for m, p in known.items() for x in (m, p[i]))), F.col("model")), F.lit(known[default][i]))
    return uses.withColumn("usd", cost_usd(F.col("tokens_in"), F.col("tokens_out"), rate(0), rate(1)))


def in_order(answer: Column, width: int | None = None) -> Column:
    """Vectors of an embedder's answer (array of index, embedding) in the order they were asked for; another
    width than expected ends the job."""
    vectors = F.transform(F.array_sort(F.transform(answer, lambda x: F.struct(x["index"].alias("index"), x["embedding"].alias("embedding")))), lambda x: x["embedding"])
    if width is None:
        return vectors
    wrong = F.exists(vectors, lambda v: F.size(v) != width)
    return F.when(wrong, F.raise_error(F.lit(f"an embedding has another width than {width}")).cast("array<array<double>>")).otherwise(vectors)


def extract(docs: DataFrame, concept: str, extractor: Extractor = rule_based) -> DataFrame:
    """One row a document (doc_id, text), its quote checked against the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield extractor(pdf, concept)

    made = docs.select("doc_id", "text").mapInPandas(run, EXTRACTED)
    checked = made.join(docs.select("doc_id", "text"), "doc_id")
    return checked.withColumn("quote_verified", F.col("defines_concept") & holds(F.col("text"), F.col("verbatim_quote"))).drop("text")


def hashing_embedder(texts: list[str], width: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: the offline stand-in for a hosted embedder."""
    out = np.zeros((len(texts), width))
    for row, text in enumerate(texts):
        for word in (text or "").lower().split():
            code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[row, code % width] += 1 if code >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(docs: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashing_embedder, batch: int = 128) -> DataFrame:
    """(doc_id, embedding) of each document, in calls of at most ``batch`` texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"doc_id": part.doc_id, "embedding": list(embedder(part.text.fillna("").tolist()).astype("float32"))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, embedding array<float>")


def embed_missing(docs: DataFrame, cache: DataFrame, **options: object) -> DataFrame:
    """Stored vectors (doc_id, embedding) where there are some, new ones for the rest."""
    kept = docs.select("doc_id").join(cache.where("embedding is not null"), "doc_id").select("doc_id", "embedding")
    return kept.unionByName(embed(docs.join(kept, "doc_id", "left_anti"), **options))
