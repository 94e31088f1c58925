"""Similarity models: vector space, rank-k latent semantic, Jensen-Shannon, and their union.

A model takes two corpora (artifact_id, ir_text) and returns links (source_id, target_id, score). `dense` adds the pairs
without a common term, which is what an evaluation of all links needs; leave it off where only positive scores are used.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import ir_tokens
from . import latent
from .blocks import SCHEMA, scored
from .postings import postings, union_weights
from .settle import settled
from .shares import Terms

#: Documents and postings up to which the decomposition runs on the driver.
LOCAL_DOCS, LOCAL_POSTINGS = 3_000, 3_000_000


class Model(Protocol):
    def __call__(self, src: DataFrame, tgt: DataFrame, dense: bool = True) -> DataFrame: ...


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("artifact_id").alias("doc_id"))


def _grid(src: DataFrame, tgt: DataFrame) -> DataFrame:
    return src.select(F.col("artifact_id").alias("source_id")).crossJoin(tgt.select(F.col("artifact_id").alias("target_id")))


def filled(links: DataFrame, src: DataFrame, tgt: DataFrame, empty: float = 0.0) -> DataFrame:
    """links on the whole grid of sources and targets."""
    return _grid(src, tgt).join(links, ["source_id", "target_id"], "left").select("source_id", "target_id", F.coalesce("score", F.lit(empty)).alias("score"))


def vsm(src: DataFrame, tgt: DataFrame, dense: bool = True, best: int | None = None, digits: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """best: only so many links of each source, after rounding to digits. only: sources (artifact_id) that are scored; weights come from all."""
    n_s, n_t = src.count(), tgt.count()
    terms = Terms(src, tgt, n_s + n_t)
    if only is not None:
        src = src.join(only.select("artifact_id"), "artifact_id", "left_semi")
        n_s = src.count()
    return scored(terms.postings(src, True, dense), terms.postings(tgt, True, dense), n_s, n_t, "cosine", dense, best, digits)


def jsd(src: DataFrame, tgt: DataFrame, dense: bool = True, digits: int | None = None) -> DataFrame:
    """1 - Jensen-Shannon divergence (base 2). Only common terms need the sums: with h(x) = -x log2 x, the others add their mass."""
    n_s, n_t = src.count(), tgt.count()
    terms = Terms(src, tgt, n_s + n_t)
    return scored(terms.postings(src, False, dense), terms.postings(tgt, False, dense), n_s, n_t, "jsd", dense, digits=digits)


def vsm_and_jsd(src: DataFrame, tgt: DataFrame, dense: bool = True, digits: int | None = None) -> DataFrame:
    """source_id, target_id, a, b: the scores of vsm and jsd of each pair that either links, null where one has no link. Both come out of one block, so nothing joins pair by pair."""
    n_s, n_t = src.count(), tgt.count()
    terms = Terms(src, tgt, n_s + n_t)
    return scored(terms.postings(src, True, dense, True), terms.postings(tgt, True, dense, True), n_s, n_t, "both", dense, digits=digits)


def _few(docs: DataFrame, n_docs: int, local_docs: int) -> bool:
    """Whether the decomposition fits the driver."""
    words = F.size(F.array_distinct(ir_tokens(F.col("ir_text"))))
    return n_docs <= local_docs and (docs.agg(F.sum(words)).first()[0] or 0) <= LOCAL_POSTINGS


def _rank(n_s: int, n_t: int, k: int | None = None) -> int:
    return min(x for x in (n_s, n_t, 100, k) if x is not None)


def lsi(src: DataFrame, tgt: DataFrame, dense: bool = True, k: int | None = None, local_docs: int = LOCAL_DOCS) -> DataFrame:
    """Cosines of TF-IDF whose cells are replaced by their rank-k reconstruction where that is positive; k = min(|S|, |T|, 100) at most."""
    n_s, n_t = src.count(), tgt.count()
    k = _rank(n_s, n_t, k)
    docs = latent.corpora(src, tgt) if k else None
    if docs is not None and not _few(docs, n_s + n_t, local_docs):
        return latent.latent_links(docs, n_s, n_t, k, False, dense)
    spark = src.sparkSession
    w = settled(weights(src, tgt).select("role", "doc_id", "term", "weight")).toPandas() if k else []
    links = _lsi_local(spark, w, k) if len(w) else spark.createDataFrame([], SCHEMA)
    return filled(links, src, tgt) if dense else links.where("score > 0")


def _lsi_local(spark, p: pd.DataFrame, k: int, width: int = 4096) -> DataFrame:
    """A_k = U_k U_k' A, with U_k from the documents' Gram matrix; the terms are taken `width` at a time, so nothing dense is wider."""
    docs = p[["role", "doc_id"]].drop_duplicates().sort_values(["role", "doc_id"]).reset_index(drop=True)
    row = p.merge(docs.reset_index(), on=["role", "doc_id"], how="left")["index"].to_numpy()
    terms, col = np.unique(p["term"].to_numpy().astype(str), return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col, weight = row[order], col[order], p["weight"].to_numpy()[order]

    def parts():
        for c in range(0, len(terms), width):
            i, j = np.searchsorted(col, (c, c + width))
            a = np.zeros((len(docs), min(width, len(terms) - c)))
            a[row[i:j], col[i:j] - c] = weight[i:j]
            yield a

    value, u = np.linalg.eigh(sum((a @ a.T for a in parts()), np.zeros((len(docs), len(docs)))))
    u = u[:, np.argsort(-value)[:min(k, len(docs))]]
    s = (docs["role"] == "s").to_numpy()
    dot, norm = np.zeros((s.sum(), (~s).sum())), np.zeros(len(docs))
    for a in parts():
        a_k = u @ (u.T @ a)
        a = np.where(a_k > 1e-12, a_k, a)  # what rounding leaves of a zero is none
        dot += a[s] @ a[~s].T
        norm += (a * a).sum(1)
    norm = np.sqrt(norm)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((norm[s][:, None] > 0) & (norm[~s][None] > 0), dot / (norm[s][:, None] * norm[~s][None]), 0.0)
    sid, tid = docs["doc_id"][s].to_numpy(), docs["doc_id"][~s].to_numpy()
    if not score.size:
        return spark.createDataFrame([], "source_id string, target_id string, score double")
    return spark.createDataFrame(pd.DataFrame({"source_id": np.repeat(sid, len(tid)), "target_id": np.tile(tid, len(sid)), "score": score.ravel()}))


def _empties(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """The pairs with an empty document that jsd scores: 1 if both are empty, else a half. Only rows with an empty side meet."""
    empty = ~F.coalesce(F.col("ir_text"), F.lit("")).rlike(r"\S")
    s, t = (d.select(F.col("artifact_id").alias(n), empty.alias(e)) for d, n, e in ((src, "source_id", "es"), (tgt, "target_id", "et")))
    one = s.where("es").join(t, F.lit(True))
    two = s.where("not es").join(t.where("et"), F.lit(True))
    return one.unionByName(two).select("source_id", "target_id", F.when(F.col("es") & F.col("et"), 1.0).otherwise(0.5).alias("score"))


def union(src: DataFrame, tgt: DataFrame, dense: bool = True, local_docs: int = LOCAL_DOCS) -> DataFrame:
    """Mean of the three models; scores of zero are left out, with dense or without: it only says whether the grid of few documents is made on the way.
    Of many documents all three scores of a pair come out of one block."""
    n_s, n_t = src.count(), tgt.count()
    if n_s and n_t:
        docs = latent.corpora(src, tgt)
        if not _few(docs, n_s + n_t, local_docs):
            return latent.latent_links(docs, n_s, n_t, _rank(n_s, n_t), True, dense)
    parts = [m(src, tgt, dense) for m in (vsm, lsi, jsd)] + ([] if dense else [_empties(src, tgt)])
    parts = [p.withColumn("score", F.col("score") / 3.0) for p in parts]
    links = reduce(lambda x, y: x.unionByName(y), parts)
    return links.groupBy("source_id", "target_id").agg(F.sum("score").alias("score")).where("score > 0")


def weights(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """The weighted postings that vsm and lsi work on: role, doc_id, term, n, total, weight."""
    return union_weights(postings(src, total=True), postings(tgt, total=True), _ids(src), _ids(tgt))


MODELS: dict[str, Model] = {"VSM": vsm, "LSI": lsi, "JSD": jsd, "UNION": union}


def model(name: str) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(MODELS)}")
    return MODELS[name]
