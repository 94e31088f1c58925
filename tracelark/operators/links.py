"""Operators on link tables (source_id, target_id, score). A missing link has score 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

KEYS = ["source_id", "target_id"]


def among(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links that are in pairs; where pairs are few and marked for broadcast, the others are not shuffled."""
    return links.join(pairs.select(*KEYS).distinct(), KEYS, "left_semi")


def lookup(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """The score of each pair, 0 where there is no link."""
    return pairs.join(links, KEYS, "left").select(*KEYS, F.coalesce("score", F.lit(0.0)).alias("score"))


def upsert(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.withColumnRenamed("score", "old").join(new.withColumnRenamed("score", "new"), KEYS, "full_outer").select(*KEYS, F.coalesce("new", "old").alias("score"))


def add(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new)


def above(links: DataFrame, threshold: float) -> DataFrame:
    return links.where(F.col("score") > threshold)


def below(links: DataFrame, threshold: float) -> DataFrame:
    return links.where(F.col("score") < threshold)


def top_k(links: DataFrame, k: int) -> DataFrame:
    """The k best links of each source, ties by target."""
    return links.withColumn("_r", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("score"), F.asc("target_id")))).where(F.col("_r") <= k).drop("_r")


def relative_top_k(links: DataFrame, k: int = 3, share: float = 0.5) -> DataFrame:
    """Of each source the k best links with at least `share` of its best score; none where that is 0."""
    best = F.max("score").over(W.partitionBy("source_id"))
    kept = links.withColumn("_m", best).where((F.col("_m") > 0) & (F.col("score") >= share * F.col("_m"))).drop("_m")
    return top_k(kept, k)


def sources(links: DataFrame) -> DataFrame:
    return links.select("source_id").distinct()


def targets(links: DataFrame) -> DataFrame:
    return links.select("target_id").distinct()


def row(links: DataFrame, source: str) -> DataFrame:
    return links.where(F.col("source_id") == source)


def _two(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.select(*KEYS, F.col("score").alias("a")).join(b.select(*KEYS, F.col("score").alias("b")), KEYS, how)


def _scored(two: DataFrame, score) -> DataFrame:
    """two with one score made of both (a, b); a missing one is 0."""
    return two.select(*KEYS, score(*(F.coalesce(c, F.lit(0.0)) for c in ("a", "b"))).alias("score"))


def average(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean over the links of either; zeros are left out."""
    return average_of(_two(a, b, "full_outer"))


def average_of(two: DataFrame) -> DataFrame:
    """average of links that are side by side: source_id, target_id, a, b, null where there is no link."""
    return _scored(two, lambda a, b: (a + b) / 2.0).where("score > 0")


def maximum(a: DataFrame, b: DataFrame) -> DataFrame:
    """The greater score, over the links of a; zeros are left out."""
    return maximum_of(_two(a, b, "left"))


def maximum_of(two: DataFrame) -> DataFrame:
    return _scored(two.where("a is not null"), F.greatest).where("score > 0")


def upsert_of(two: DataFrame, threshold: float) -> DataFrame:
    """Links a, with links b above a threshold put in."""
    new = F.when(F.col("b") > threshold, F.col("b"))
    return two.select(*KEYS, F.coalesce(new, "a").alias("score")).where("score is not null")


def fuse(base: DataFrame, enriched: DataFrame, strategy: str = "avg", guard: bool = False) -> DataFrame:
    """Base and enriched scores over the links of base; zeros stay. strategy: max, guarded_avg, else the mean (guarded_avg if guard)."""
    return fuse_of(_two(base, enriched, "left"), strategy, guard)


def fuse_of(two: DataFrame, strategy: str = "avg", guard: bool = False) -> DataFrame:
    """fuse of links that are side by side, base as a and enriched as b."""
    if strategy == "max":
        score = F.greatest
    elif strategy == "guarded_avg" or guard:
        score = lambda a, b: F.greatest(a, 0.5 * (a + b))
    else:
        score = lambda a, b: 0.5 * (a + b)
    return _scored(two.where("a is not null"), score)
