"""Links against a gold standard (distinct source_id, target_id)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .links import KEYS, above, among, below
from .settle import settled

#: 0.1, 0.2, ... by repeated addition in doubles, while below 1.
THRESHOLDS = []
_t = 0.1
while _t < 1.0:
    THRESHOLDS.append(_t)
    _t += 0.1


def f_measure(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def labelled(links: DataFrame, gold: DataFrame) -> DataFrame:
    """links with hit (1 or 0)."""
    g = gold.select(*KEYS).distinct().withColumn("_g", F.lit(1))
    return links.join(g, KEYS, "left").withColumn("hit", F.coalesce("_g", F.lit(0))).drop("_g")


def gold_size(gold: DataFrame) -> DataFrame:
    return gold.select(*KEYS).distinct().agg(F.count("*").alias("relevant"))


def is_link(gold: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.join(gold, KEYS, "left_semi")


def relevant_targets(gold: DataFrame) -> DataFrame:
    return gold.groupBy("source_id").agg(F.array_sort(F.collect_set("target_id")).alias("targets"))


def _rates(counts: DataFrame, gold: DataFrame, empty: float = 1.0) -> DataFrame:
    """precision, recall, f1 from tp and amount; precision of nothing retrieved is `empty`."""
    c = counts.crossJoin(F.broadcast(gold_size(gold)))
    p = F.when(F.col("amount") > 0, F.col("tp") / F.col("amount")).otherwise(F.lit(empty))
    r = F.when(F.col("relevant") > 0, F.col("tp") / F.col("relevant")).otherwise(F.lit(0.0))
    return c.withColumns({"precision": p, "recall": r}).withColumn("f1", f_measure(F.col("precision"), F.col("recall"))).drop("relevant")


def prf(links: DataFrame, gold: DataFrame, empty: float = 1.0) -> DataFrame:
    """One row: amount, tp, precision, recall, f1."""
    n = labelled(links, gold).agg(F.count("*").alias("amount"), F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"))
    return _rates(n, gold, empty)


def precision(links: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision by itself: 0 where nothing is retrieved."""
    return prf(links, gold, 0.0).select("precision")


def recall(links: DataFrame, gold: DataFrame) -> DataFrame:
    return prf(links, gold).select("recall")


def threshold_sweep(links: DataFrame, gold: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """prf of the links above each threshold (strictly): one pass, one row of sums."""
    ts = [float(t) for t in (THRESHOLDS if thresholds is None else thresholds)]
    over = lambda t, x: F.coalesce(F.sum(F.when(F.col("score") > t, x)), F.lit(0)).cast("long")
    sums = labelled(links, gold).agg(F.array(*[F.struct(F.lit(t).alias("threshold"), over(t, F.lit(1)).alias("amount"), over(t, F.col("hit")).alias("tp")) for t in ts]).alias("x"))
    return _rates(sums.select(F.explode("x").alias("y")).select("y.*"), gold)


def below_evaluation(links: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    return prf(below(links, threshold), gold)


def above_evaluation(links: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    return prf(above(links, threshold), gold)


def top_k_sweep(links: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """prf of the k best links of each source for each k."""
    w = W.partitionBy("source_id").orderBy(F.desc("score"), F.asc("target_id"))
    ranked = labelled(links, gold).withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(ks)).groupBy("r").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    kt = links.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    n = kt.join(F.broadcast(ranked), F.col("r") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("amount"), F.coalesce(F.sum("h"), F.lit(0)).alias("tp"))
    return _rates(n, gold)


def last_hits(lab: DataFrame) -> DataFrame:
    """source_id, low: the least score of a hit of each source, null without a hit."""
    return lab.groupBy("source_id").agg(F.min(F.when(F.col("hit") == 1, F.col("score"))).alias("low"))


def up_to_last_hit(lab: DataFrame, last: DataFrame) -> DataFrame:
    """The links that a hit's rank can count: those behind the last hit of their source are not shuffled or sorted. last has one row for each source and goes to every task."""
    return lab.join(F.broadcast(last.where("low is not null")), "source_id").where("score >= low").drop("low")


def average_precision(links: DataFrame, gold: DataFrame) -> DataFrame:
    """source_id, ap for every source of the links; 0 without gold."""
    w = W.partitionBy("source_id").orderBy(F.desc("score"), F.asc("target_id"))
    lab = labelled(links, gold)
    last = last_hits(lab)
    r = up_to_last_hit(lab, last).withColumn("rank", F.row_number().over(w)).withColumn("cum", F.sum("hit").over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = r.groupBy("source_id").agg(F.sum(F.col("hit") * F.col("cum") / F.col("rank")).alias("s"))
    n = gold.select(*KEYS).distinct().groupBy("source_id").agg(F.count("*").alias("n"))
    return last.select("source_id").join(s, "source_id", "left").join(n, "source_id", "left").select("source_id", F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("ap"))


def mean_average_precision(links: DataFrame, gold: DataFrame) -> DataFrame:
    return average_precision(links, gold).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))


#: Slices of the scores for running sums; each slice is a window of its own, and only the slices' totals meet in one task.
SLICES = 4096


def _before(by: DataFrame, key: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """by (one row for each value of key) with running sums over the rows before each: {column: name of its sum}."""
    slice_ = F.floor(F.least(F.greatest(F.col(key), F.lit(0.0)), F.lit(1.0)) * SLICES).cast("int")
    by = by.withColumn("_s", -slice_ if descending else slice_)
    every = W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)  # SLICES + 1 rows at most
    totals = by.groupBy("_s").agg(*[F.sum(c).alias(c) for c in sums]).select(F.col("_s").alias("_t"), *[F.coalesce(F.sum(c).over(every), F.lit(0)).alias(f"_{n}") for c, n in sums.items()])
    own = W.partitionBy("_s").orderBy(F.desc(key) if descending else F.asc(key)).rowsBetween(W.unboundedPreceding, -1)
    out = by.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for c, n in sums.items()}).join(F.broadcast(totals), F.col("_s") == F.col("_t"))
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums.values()}).drop("_s", "_t", *[f"_{n}" for n in sums.values()])


#: Hits up to which their scores go to every task.
HITS = 500_000


def _hits(links: DataFrame, gold: DataFrame) -> DataFrame:
    """The gold links that were retrieved, with their rank over all links and number so far.

    A rank is one more than the links before it. The scores of the hits go to every task, which counts its links between them,
    so that no other link is shuffled; links of equal score are told apart by their pair.
    """
    g = gold.select(*KEYS).distinct()
    hits = settled(among(links, F.broadcast(g) if g.count() <= HITS else g).select(*KEYS, "score"))
    if hits.count() > HITS:
        return _hits_by_shuffle(links, gold)
    cuts = hits.select("score").distinct().toArrow()["score"].to_numpy()
    shared = links.sparkSession.sparkContext.broadcast(np.sort(cuts))

    def count(batches):
        """For each hit's score (by place) the links above it and below the next; and the links of just this score."""
        cuts, total = shared.value, np.zeros(len(shared.value) + 1, np.int64)
        for b in batches:
            score = b.column(2).to_numpy(zero_copy_only=False)
            place = np.searchsorted(cuts, score, "right")
            same = (place > 0) & (cuts[place - 1] == score) if len(cuts) else np.zeros(len(score), bool)
            total += np.bincount(place[~same], minlength=len(total))
            kept = b.filter(pa.array(same))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.ones(kept.num_rows, np.int64))], ["source_id", "target_id", "score", "n"])
        some = np.flatnonzero(total[1:])  # links below all hits count for no rank
        none = pa.nulls(len(some), pa.string())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(cuts[some]), pa.array(total[1:][some])], ["source_id", "target_id", "score", "n"])

    got = links.select(*KEYS, F.col("score").cast("double").alias("score")).mapInArrow(count, "source_id string, target_id string, score double, n long")
    got = settled(got.groupBy(*KEYS, "score").agg(F.sum("n").alias("n")))
    got = labelled(got, g)
    # rows without a pair are links above a hit's score: they come before all links of this score
    by = got.groupBy("score").agg(F.sum("n").alias("n"), F.sum("hit").alias("h"), F.coalesce(F.sum(F.when(F.col("source_id").isNull(), F.col("n"))), F.lit(0)).alias("over"))
    before = _before(by, "score", {"n": "n0", "h": "h0"}, True)
    tied = W.partitionBy("score").orderBy("source_id", "target_id")
    pairs = got.where("source_id is not null").join(before.select("score", (F.col("n0") + F.col("over")).alias("n0"), "h0"), "score")
    pairs = pairs.withColumns({"rank": F.col("n0") + F.row_number().over(tied), "cum": F.col("h0") + F.sum("hit").over(tied.rowsBetween(W.unboundedPreceding, 0))})
    return pairs.where("hit = 1").select("rank", "cum")


def _hits_by_shuffle(links: DataFrame, gold: DataFrame) -> DataFrame:
    """_hits of many hits: counts by score come first, so the running sum goes over distinct scores."""
    lab = labelled(links, gold)
    before = _before(lab.groupBy("score").agg(F.count("*").alias("n"), F.sum("hit").alias("h")), "score", {"n": "n0", "h": "h0"}, True)
    tied = W.partitionBy("score").orderBy("source_id", "target_id")
    hits = lab.join(before.where("h > 0").select("score", "n0", "h0"), "score")
    hits = hits.withColumns({"rank": F.col("n0") + F.row_number().over(tied), "cum": F.col("h0") + F.sum("hit").over(tied.rowsBetween(W.unboundedPreceding, 0))})
    return hits.where("hit = 1").select("rank", "cum")


def pr_curve(links: DataFrame, gold: DataFrame, levels: int = 20) -> DataFrame:
    """recall_level, precision: the best precision at that recall or more. 20 levels are (i + 1) / 20, 11 levels i / 10."""
    at = [i / 10 for i in range(11)] if levels == 11 else [(i + 1) / levels for i in range(levels)]
    lv = links.sparkSession.createDataFrame([(float(x),) for x in at], "recall_level double")
    curve = _hits(links, gold).crossJoin(F.broadcast(gold_size(gold))).select((F.col("cum") / F.col("relevant")).alias("r"), (F.col("cum") / F.col("rank")).alias("p"))
    got = curve.join(F.broadcast(lv), F.col("r") >= F.col("recall_level")).groupBy("recall_level").agg(F.max("p").alias("p"))
    return lv.join(got, "recall_level", "left").select("recall_level", F.coalesce("p", F.lit(0.0)).alias("precision"))


def f_at_11(links: DataFrame, gold: DataFrame) -> DataFrame:
    return pr_curve(links, gold, 11).select("recall_level", "precision", f_measure(F.col("precision"), F.col("recall_level")).alias("f1"))


def wilcoxon(a: list[float], b: list[float]) -> float:
    """Exact two-sided p of the signed rank test: zero differences stay, ties take mean ranks."""
    if not a or len(a) != len(b):
        raise ValueError("the samples must be of one size and not empty")
    d = [y - x for x, y in zip(a, b)]
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    ranks = [0.0] * len(d)
    i = 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and abs(d[order[j + 1]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2 + 1
        i = j + 1
    plus = sum(r for r, x in zip(ranks, d) if x > 0)
    n = len(d)
    most = max(plus, n * (n + 1) / 2 - plus)
    # sums of subsets of 1 .. n
    ways = [1]
    for r in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if s >= r and s - r < len(ways) else 0) for s in range(len(ways) + r)]
    upper = sum(ways[math.ceil(most):])
    return min(1.0, 2 * upper / 2 ** n)


def cliffs_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """delta of two samples (column x): (pairs with a > b less those with a < b) / all pairs; 0 if one is empty.

    Ranks by value replace the pairs: with the counts of each distinct value, a running sum tells how many of b lie below and above.
    """
    by = a.select("x", F.lit(1).alias("na"), F.lit(0).alias("nb")).unionByName(b.select("x", F.lit(0).alias("na"), F.lit(1).alias("nb"))).groupBy("x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    r = _before(by, "x", {"nb": "low"})
    t = r.agg(F.sum("na").alias("n"), F.sum("nb").alias("m"), F.sum(F.col("na") * F.col("low")).alias("lt"), F.sum(F.col("na") * F.col("nb")).alias("eq"))
    n, m, lt, eq = (F.col(c) for c in ("n", "m", "lt", "eq"))
    return t.select(F.when((n > 0) & (m > 0), (lt - (n * m - lt - eq)) / (n * m)).otherwise(F.lit(0.0)).alias("delta"))


def compare(base: DataFrame, improved: DataFrame, gold: DataFrame) -> dict | None:
    """p and delta of the F measures at 11 recall levels; None if both are all zero."""
    xs, ys = ([r["f1"] for r in f_at_11(x, gold).orderBy("recall_level").collect()] for x in (base, improved))  # 11 rows each
    if not any(xs) and not any(ys):
        return None
    more = sum((y > x) - (y < x) for x in xs for y in ys)
    return {"p": wilcoxon(xs, ys), "delta": more / (len(xs) * len(ys))}


def evaluate(links: DataFrame, gold: DataFrame) -> dict[str, DataFrame]:
    """All the tables of an evaluation."""
    return {"prf": prf(links, gold), "map": mean_average_precision(links, gold), "pr_curve": pr_curve(links, gold), "thresholds": threshold_sweep(links, gold), "top_k": top_k_sweep(links, gold)}


