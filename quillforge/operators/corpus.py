"""Corpus selection: reference frequency, one-hop expansion, best-record dedup, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions.text import citation_score


def reference_frequency(citing: DataFrame, references: DataFrame) -> DataFrame:
    """A1: (dst, refs): how often documents of ``citing`` (id) refer to dst; repeats in one list count."""
    return references.join(citing.select(F.col("id").alias("src")), "src", "left_semi").groupBy("dst").agg(F.count("*").alias("refs"))


def one_hop(frequency: DataFrame, seeds: DataFrame, least: int = 2, most: int = 300) -> DataFrame:
    """What is referred to ``least`` times and is no seed; filtered first, then the top ``most``."""
    known = seeds.select(F.col("id").alias("dst"))
    return frequency.where(F.col("refs") >= least).join(known, "dst", "left_anti").orderBy(F.desc("refs"), "dst").limit(most)


def keep_best(pool: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Each key's first row by ``order``, which must end in a real key for stable ties."""
    return pool.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def rank(pool: DataFrame, limit: int = 150) -> DataFrame:
    """The top ``limit`` of (id, seed, refs, cites) by score, numbered from 1.

    The window runs over the ``limit`` rows that TakeOrderedAndProject leaves.
    """
    scored = pool.select("id", "seed", "refs", "cites", F.round(citation_score(F.col("refs"), F.col("cites")), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), "id").limit(limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("rnk"), "id", "seed", "refs", "cites", "score")


def cited_references(papers: DataFrame) -> DataFrame:
    """(citing, cited, contexts, intents, influential) of papers (citing, refs).

    References without an id go; contexts are the first four that aren't blank. Repeats stay.
    """
    own = papers.select("citing", F.explode("refs").alias("r"))
    contexts = F.slice(F.filter(F.coalesce("r.contexts", F.expr("cast(array() as array<string>)")), lambda c: F.trim(c) != ""), 1, 4)
    cited = F.col("r.citedPaper.externalIds.ArXiv")
    return own.where(cited.isNotNull()).select("citing", cited.alias("cited"), contexts.alias("contexts"), F.col("r.intents").alias("intents"), F.col("r.isInfluential").alias("influential"))


def or_default(rows: DataFrame, default: DataFrame) -> DataFrame:
    """``rows``, or ``default`` where there are none."""
    some = rows.limit(1).select(F.lit(1).alias("_one"))
    return rows.unionByName(default.withColumn("_one", F.lit(1)).join(some, "_one", "left_anti").drop("_one"))


def resolve_concept(matches: DataFrame, most: int = 5) -> DataFrame:
    """(query, concept_id): the first of a search's ``most`` matches (query, pos, id), by its last path segment;
    a query without a match (id null) ends the job."""
    best = matches.groupBy("query").agg(F.min(F.when(F.col("id").isNotNull() & (F.col("pos") < most), F.struct("pos", "id"))).alias("m"))
    none = F.raise_error(F.concat(F.lit("no concept matches "), F.col("query")))
    return best.select("query", F.when(F.col("m").isNull(), none).otherwise(F.element_at(F.split("m.id", "/"), -1)).alias("concept_id"))


def to_extract(papers: DataFrame, done: DataFrame, least: float = 0.5) -> DataFrame:
    """Papers (id, concept, prompt_version, match, cited_by_count) that are not ``done`` under all three keys and
    whose title match, unknown counting as none, is good enough; numbered, the most cited first, unknown counts last."""
    left = papers.where(F.coalesce("match", F.lit(0.0)) >= least).join(done.select("id", "concept", "prompt_version").distinct(), ["id", "concept", "prompt_version"], "left_anti")
    return left.withColumn("pos", F.row_number().over(Window.partitionBy("concept", "prompt_version").orderBy(F.desc_nulls_last("cited_by_count"), "id")))
