"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector over hashed text, and ordered thresholds. It gives the
expected grade and the tail probabilities P(grade >= k) for selection. x holds the text's tokens (words in
lower case, and runs of other signs) and binned shape marks (share of distinct words, signs, digits, capitals, line and
word lengths, share of words after which nothing ends a sentence), hashed into DIM cells, log counts, scaled to length one.

Training takes a bounded sample: the rated rows with the least hash of their id, SAMPLE_ROWS of them at most; of each only
its hashed cells (DIM at most) come to the driver. Of an id that several rows have, the greatest text is taken.

Defined results: a null or blank text has the mark `empty` alone. With fewer than two grades among the ratings every text gets
the grade that there is (0 with none) and is kept. Ratings of an id that differ are left out. Repeated rows are rated alike; all of a text
counts, however long. An empty table gives an empty one. rate() replaces columns of the input that are named as those it adds; good() returns the
input's columns, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._rows import col, packed, unpacked

DIM = 1 << 13
SAMPLE_ROWS = 4_000
#: A document is kept if P(grade >= 1) is at least this.
KEEP = 0.4
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class Hasher:
    """Text to cells and values; keeps the cells of tokens that it has met (a bounded memo)."""

    def __init__(self, dim: int = DIM):
        self.dim, self.memo = dim, {}

    def cell(self, token: str) -> int:
        c = self.memo.get(token)
        if c is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            c = self.memo[token] = zlib.crc32(token.encode("utf-8", "replace")) % self.dim
        return c

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        count = Counter(_TOKEN.findall(text.lower()))
        marks = shape(text, count)
        at = np.fromiter(map(self.cell, count), np.int64, len(count))
        value = np.log1p(np.fromiter(count.values(), np.float64, len(count)))
        cells, inv = np.unique(at, return_inverse=True)
        x = np.bincount(inv, value, len(cells)) if len(cells) else np.zeros(0)
        x = x / max(1e-9, math.sqrt(float(x @ x)))
        more = np.array([self.cell(m) for m in marks], np.int64)
        return np.concatenate([cells, more]), np.concatenate([0.7 * x, np.full(len(more), 0.7 / math.sqrt(len(more)))])


def shape(text: str, count: Counter) -> list[str]:
    n = sum(count.values())
    if not n:
        return ["\0empty"]
    size = len(text)
    words = [(w, c) for w, c in count.items() if w[0].isalnum()]
    n_words = sum(c for _, c in words) or 1
    top = max(count.values())
    marks = {
        "distinct": 10 * len(words) / n_words, "top": 10 * top / n, "signs": 20 * (1 - n_words / n), "sign_kinds": min(9, sum(1 for w in count if not w[0].isalnum())),
        "word_length": sum(len(w) * c for w, c in words) / n_words, "stops": 30 * sum(text.count(x) for x in ".!?") / n_words, "pipes": 20 * text.count("|") / n_words,
        "lines": 20 * text.count("\n") / n_words, "upper": 30 * sum(map(str.isupper, text)) / size, "size": math.log2(n_words + 1),
    }
    return [f"\0{k}={int(v)}" for k, v in marks.items()]


class CumulativeLink:
    """Weights and ordered thresholds by Adam on the negative log likelihood."""

    def __init__(self, grades: int, dim: int = DIM):
        self.grades, self.dim, self.w, self.cuts = grades, dim, np.zeros(dim), np.linspace(-1, 1, grades - 1) if grades > 1 else np.zeros(0)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 250, rate: float = 0.1, l2: float = 1e-4) -> CumulativeLink:
        at = np.concatenate([r[0] for r in rows])
        value = np.concatenate([r[1] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        share = np.clip([(y <= k).mean() for k in range(self.grades - 1)], 1e-3, 1 - 1e-3)
        cuts = np.log(share / (1 - share))
        # ordered by construction: first cut, then logs of the gaps
        raw = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
        theta = np.concatenate([self.w, raw])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        n = len(y)
        for t in range(1, steps + 1):
            w, raw = theta[:self.dim], theta[self.dim:]
            cuts = self._cuts(raw)
            z = np.bincount(row, value * w[at], n)
            high = _sigmoid(np.append(cuts, np.inf)[y] - z)
            low = _sigmoid(np.concatenate([[-np.inf], cuts])[y] - z)
            p = np.maximum(high - low, 1e-9)
            dh, dl = high * (1 - high) / p, low * (1 - low) / p
            dz = (dh - dl) / n  # of the loss
            g = np.zeros_like(theta)
            g[:self.dim] = np.bincount(at, value * dz[row], self.dim) + l2 * w
            dc = np.array([-(dh[y == k].sum() - dl[y == k + 1].sum()) / n for k in range(self.grades - 1)])
            tail = dc[::-1].cumsum()[::-1]
            g[self.dim:] = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        self.w, self.cuts = theta[:self.dim], self._cuts(theta[self.dim:])
        return self

    @staticmethod
    def _cuts(raw: np.ndarray) -> np.ndarray:
        return raw[0] + np.concatenate([[0.0], np.exp(raw[1:]).cumsum()])

    def tails(self, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """P(grade >= k), k = 1 .. grades - 1."""
        return 1 - _sigmoid(self.cuts - float(self.w[x[0]] @ x[1]))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class QualityModel:
    def __init__(self, link: CumulativeLink | None, only: int = 0, grades: int = 3):
        self.link, self.only, self.grades = link, only, grades

    def tails(self, hasher: Hasher, text: str | None) -> np.ndarray:
        if self.link is None:
            return np.array([float(self.only >= k) for k in range(1, self.grades)])
        return self.link.tails(hasher(text))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade from the two marks of a label: 0 low quality, 1 good but toxic, 2 good and not toxic."""
    q, t = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    return labels.where(q.isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.when(q <= 0, 0).when(t > 0, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id") -> QualityModel:
    """ratings: doc_id and grade (0 .. grades - 1)."""
    ids = ratings.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.max("grade").alias("z")).where("grade = z").select(F.col("doc_id").alias("_id"), "grade").orderBy(F.xxhash64("_id"), "_id").limit(rows)
    src = docs.select(col(key).alias("_k"), col(text).alias("_t")).join(F.broadcast(ids), F.col("_k") == F.col("_id"))
    src = src.groupBy("_id").agg(F.max("grade").alias("grade"), F.max("_t").alias("_t"))  # one text for each id, however often it occurs

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                got = [h(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.int32()), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))], ["id", "grade", "at", "value"])

    found = src.mapInArrow(cells, "id long, grade int, at array<int>, value array<float>").toArrow()
    order = np.argsort(found.column("id").to_numpy(), kind="stable")
    y = found.column("grade").to_numpy()[order] if len(order) else np.zeros(0, np.int64)
    if len(set(y.tolist())) < 2:
        return QualityModel(None, int(y[0]) if len(y) else grades - 1, grades)
    at, value = found.column("at").combine_chunks(), found.column("value").combine_chunks()
    x = [(at[int(i)].values.to_numpy().astype(np.int64), value[int(i)].values.to_numpy().astype(np.float64)) for i in order]
    return QualityModel(CumulativeLink(grades).fit(x, y), grades=grades)


def _rated(docs: DataFrame, columns: list[str], model: QualityModel, text: str, threshold: float) -> DataFrame:
    """row (the columns but the text), text, and the columns that rate() adds."""
    src = packed(docs, [c for c in columns if c != text], text=col(text))
    added = ["expected_grade", *(f"p_{k}" for k in range(1, model.grades))]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in src.schema] + [T.StructField(c, T.DoubleType()) for c in added])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, h = shared.value, Hasher()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                tails = np.array([m.tails(h, t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(1)), *(pa.array(tails[:, j]) for j in range(tails.shape[1]))], ["row", "text", *added])

    return src.mapInArrow(scores, schema).withColumn("kept", F.col("p_1") >= threshold)


def rate(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, threshold: float = KEEP) -> DataFrame:
    """docs (or its columns `keep`) with expected_grade, p_1 .. p_k (tail probabilities) and kept; clashing columns are replaced."""
    names = docs.columns if keep is None else keep
    return unpacked(_rated(docs, names, model, text, threshold), names, "expected_grade", *(f"p_{k}" for k in range(1, model.grades)), "kept", text=text)


def good(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = KEEP) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return unpacked(_rated(docs, docs.columns, model, text, threshold).where("kept"), docs.columns, text=text)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rate(docs, model, keep=["doc_id"])
