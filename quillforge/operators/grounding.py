"""Exact quotation checks: keyed, and the containment join with a lossless anchor filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions.text import verified_by


def holds(text: Column, quote: Column) -> Column:
    """Whether the text has the quote, case and all; an empty or missing quote or text does not count."""
    return F.coalesce(F.contains(text, quote) & (quote != ""), F.lit(False))


def ground(edges: DataFrame) -> DataFrame:
    """Edges with (source_text, source_quote, target_text, target_quote) get ``verified`` and ``reason``."""
    source, target = holds(F.col("source_text"), F.col("source_quote")), holds(F.col("target_text"), F.col("target_quote"))
    return edges.withColumn("verified", source & target).withColumn("reason", verified_by(source, target))


#: Characters of the anchor of a quote without an inner word.
GRAM = 3


def _grams(text: Column) -> Column:
    """All distinct runs of 1 to GRAM characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    run = lambda own, n: F.transform(F.slice(own, F.lit(1), F.greatest(F.size(own) - (n - 1), F.lit(0))), lambda c, i: F.concat(c, *(F.get(own, i + k) for k in range(1, n))))
    return F.array_distinct(F.flatten(F.transform(F.array(chars), lambda own: F.flatten(F.array(*(run(own, n) for n in range(1, GRAM + 1)))))))


def containment(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every quote that is a substring of a document.

    A quote's anchor is its longest inner word: white space on both sides within the quote, so that any text
    with the quote has the anchor as a whole word too. Quotes without an inner word have their last GRAM
    characters as anchor, which any text with the quote has among its runs of characters. Anchors meet
    those of texts in equi-joins, and only those pairs are compared; texts are only taken apart into
    words (runs of characters) where a quote needs it, which a scalar subquery says.
    """
    words = F.split(F.col("quote"), r"[ \t\n\r]+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    told = quotes.select("item_id", F.col("text").alias("quote")).where("quote <> ''").withColumn("anchor", F.try_element_at(longest, F.lit(1))["w"])
    kinds = ((told.where("anchor is not null"), F.array_distinct(F.split("text", r"[ \t\n\r]+"))), (told.where("anchor is null").withColumn("anchor", F.right("quote", F.lit(GRAM))), _grams(F.col("text"))))
    met = []
    for own, parts in kinds:
        wanted = own.select("anchor").distinct()
        some = own.agg(F.count("*")).scalar() > 0
        found = docs.where(some).select("doc_id", F.explode(parts).alias("anchor")).join(wanted, "anchor")
        met.append(found.join(own, "anchor").select("doc_id", "item_id", "quote"))
    pairs = met[0].union(met[1])
    return docs.select("doc_id", "text").join(pairs, "doc_id").where(F.contains("text", F.col("quote"))).select("doc_id", "item_id").distinct()
