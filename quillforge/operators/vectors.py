"""Vector operators: cosine top-k, centroids, representatives, average-linkage clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision, in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_top_k(vectors: DataFrame, query: Column, k: int, least: float) -> DataFrame:
    """The ``k`` vectors (vec_id, embedding) nearest to ``query``, of these those of ``least`` or more."""
    near = vectors.select("vec_id", "embedding", query.alias("_query")).select("vec_id", F.round(cosine(F.col("embedding"), F.col("_query")), 6).alias("cos"))
    return near.orderBy(F.desc("cos"), "vec_id").limit(k).where(F.col("cos") >= least)


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, dim, mean) of vectors (label, embedding); map-side combined per dimension."""
    return vectors.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def representatives(vectors: DataFrame) -> DataFrame:
    """Each label's vec_id of the greatest product with the raw centroid, the lowest id on ties."""
    center = centroids(vectors).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("c"))
    center = center.select("label", F.transform("c", lambda x: x["mean"]).alias("center"))
    near = vectors.join(center, "label").select("label", "vec_id", F.round(dot(F.col("embedding"), F.col("center")), 6).alias("near"))
    best = Window.partitionBy("label").orderBy(F.desc("near"), "vec_id")
    return near.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def average_linkage(points: np.ndarray, cutoff: float) -> np.ndarray:
    """Cluster numbers (by first member) of rows under cosine distance.

    The two nearest clusters merge while they are nearer than ``cutoff``; the distance of two clusters
    is the mean over their pairs of rows, which is 1 less the product of their mean unit vectors. So means and sizes
    of clusters are all that is kept, and memory is linear in the rows. Merges are found along chains of nearest
    neighbours, in time quadratic in the distinct rows: two clusters that are each other's nearest merge
    whatever happens elsewhere, and distances never fall from a merge to a later one above it. So a cluster
    whose nearest isn't nearer than ``cutoff`` is settled.
    """
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300) + 0.0
    owner, known = np.arange(len(unit)), {}
    if cutoff > 0:  # copies are at distance 0, but for zero vectors, which are at 1 from all
        owner = np.array([known.setdefault(u.tobytes(), i) if u.any() else i for i, u in enumerate(unit)], int)
    own, size = np.unique(owner, return_counts=True)  # slots, in the order of clusters' first rows
    mean, size = unit[own], size.astype(float)
    bar = np.zeros(len(own))  # -inf for what is merged into others or settled
    live = len(own)
    chain: list[int] = []
    steps: list[float] = []  # from each of the chain to the next
    while live > 1 or chain:
        if 4 * live < 3 * len(own) and len(own) > 64:
            keep = bar == 0
            place = np.cumsum(keep) - 1
            chain = place[chain].tolist()
            own, size, mean, bar = own[keep], size[keep], mean[keep], bar[keep]
        if not chain:
            chain.append(int(np.argmax(bar)))
        last = chain[-1]
        alike = mean @ mean[last]
        alike += bar
        alike[last] = -np.inf
        near = int(np.argmax(alike))
        gap = 1 - alike[near]
        if steps and (steps[-1] <= gap or near in chain):  # in the chain already: a tie but for rounding
            i, j = sorted((chain.pop(), chain.pop()))
            del steps[-2:]
            mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
            size[i] += size[j]
            owner[own[j]] = own[i]
            bar[j] = -np.inf
            live -= 1
        elif gap < cutoff:
            chain.append(near)
            steps.append(gap)
        else:
            bar[chain.pop()] = -np.inf
            live -= 1
    for i, o in enumerate(owner.tolist()):  # owners come before what they own
        owner[i] = owner[o]
    return np.unique(owner, return_inverse=True)[1]


def clusters(vectors: DataFrame, cutoff: float = 0.28, group: str = "concept") -> DataFrame:
    """(group, vec_id, cluster) of vectors (group, vec_id, embedding), each group, of any size, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        made = average_linkage(np.array(pdf.embedding.tolist(), float), cutoff)
        return pd.DataFrame({group: pdf[group], "vec_id": pdf.vec_id, "cluster": made})

    kind = vectors.schema[group].dataType.simpleString()
    return vectors.select(group, "vec_id", "embedding").groupBy(group).applyInPandas(run, f"{group} {kind}, vec_id long, cluster long")
