"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon holds a few seed words, and words and word stems (first letters) that are far likelier in toxic
training texts. Features: densities of lexicon words, stems and disguised lexicon words, distance to the nearest
second person, capitals, punctuation, digits within words, repetition and length. Labels, language, source and ids are no input.

Training takes a bounded sample: the labelled rows with the least hash of their id, SAMPLE_ROWS at most, up to the first that would pass SAMPLE_BYTES
of text (a text that is longer than that by itself is left out).
Features of a training text use the lexicon of the other folds, so that the trees see lexicons that have not seen
the text. Scores of all texts are computed where the texts lie.

Defined results: a null or empty text has zero for each feature and is scored like any other; all of a text counts, however long. Without labels of both kinds the
score is the share of toxic labels (0 with none). Repeated rows score alike. An empty table gives an empty one.
A column score of the input is replaced, all others but the text are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 24_000_000
FOLDS = 4
#: Seed words, and words of the second person in four languages.
SEEDS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic scum trash worthless disgusting clown clowns bastard bitch retard imbecile filth vermin jerk freak creep pig dummkopf trottel arschloch connard salope idiota imbécil estúpido".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos usted ustedes tú ti tus vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
_TRIM = ".,;:!?\"'()[]{}…“”«»¿¡"
_UPPER = bytes(range(65, 91))
_MARKS = b".,;:!?\"'()[]{}"
_ODD = b"#*$%&|<>@_~^="
_DIGITS = b"0123456789"


class Lexicon:
    STEMS = (4, 5, 6)

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems

    @staticmethod
    def tokens(text: str) -> set[str]:
        """The words of a text, and its stems marked by their length."""
        words = {w.strip(_TRIM) for w in (text or "").lower().split()}
        words.discard("")
        return words | {f"{k}{w[:k]}" for w in words if w.isalpha() for k in Lexicon.STEMS if len(w) >= k + 1}

    @staticmethod
    def learn(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> Lexicon:
        """Tokens at least e**2.5 times as likely in toxic texts, seen in three of them or more (two per mille of many)."""
        words, stems = {w: 3.0 for w in SEEDS}, {}
        least = max(3, math.ceil(0.002 * n_toxic))
        for t, a in toxic.items():
            if a >= least:
                odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))
                # its own chance: how often so many toxic texts would hold it if it told nothing
                mean = (a + clean.get(t, 0)) * n_toxic / max(1, n_toxic + n_clean)
                if odds >= 2.5 and a - mean >= 3 * math.sqrt(mean):
                    (stems if t[0].isdigit() and t[1:].isalpha() else words)[t] = min(odds, 8.0)
        return Lexicon(words, stems)


NAMES = ("lex_density", "lex_count", "lex_weight", "stem_density", "stem_count", "stem_weight", "disguised", "second_density", "near_second", "upper_rate", "caps_words", "exclaim_rate", "punct_rate", "odd_rate", "digit_rate", "inner_digits", "repeat_rate", "mean_length", "log_words")


def features(text: str | None, lex: Lexicon) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    words = [w.strip(_TRIM) for w in text.lower().split()]
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    count = Counter(words)
    hits, stems, hidden = {}, {}, 0
    for w, c in count.items():
        if w in lex.words:
            hits[w] = c
            continue
        if len(w) > 4:
            best = max((lex.stems.get(f"{k}{w[:k]}", 0.0) for k in Lexicon.STEMS if len(w) >= k + 1), default=0.0)
            if best:
                stems[w] = (c, best)
        if len(w) > 3 and not w.isalpha():
            plain = re.sub(r"[^\w]|_", "", w.translate(LEET))
            if plain != w and (plain in lex.words or re.sub(r"(.)\1+", r"\1", plain) in lex.words):
                hidden += c
    k, s = sum(hits.values()), sum(c for c, _ in stems.values())
    second = sum(count[w] for w in SECOND if w in count)
    near = 0.0
    if second and (hits or stems):
        toxic = [i for i, w in enumerate(words) if w in hits or w in stems]
        you = np.array([i for i, w in enumerate(words) if w in SECOND])
        at = np.searchsorted(you, toxic)
        gap = min(min(abs(int(you[min(p, len(you) - 1)]) - t), abs(int(you[max(p - 1, 0)]) - t)) for p, t in zip(at, toxic))
        near = 1 / (1 + gap)
    without = lambda b: size - len(raw.translate(None, b)) - (0 if raw else 1)
    caps = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if without(_UPPER) > 2 else 0
    return [
        k / n, math.log1p(k), max((lex.words[w] for w in hits), default=0.0), s / n, math.log1p(s), max((b for _, b in stems.values()), default=0.0), math.log1p(hidden), second / n, near,
        without(_UPPER) / size, caps / n, without(b"!") / size, without(_MARKS) / size, without(_ODD) / size, without(_DIGITS) / size,
        sum(c for w, c in count.items() if not w.isalpha() and any(x.isdigit() for x in w) and any(x.isalpha() for x in w)) / n, 1 - len(count) / n, len(text) / n, math.log1p(n),
    ]


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, split on quantile histograms."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 3.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(code, cuts, y - p, p * (1 - p), np.arange(len(y)), 0)
            self.nodes.append(tree)
            f += self.rate * self._value(tree, x)
        return self

    def _grow(self, code, cuts, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = ("leaf", float(gs / (hs + 1.0)))
        if depth == self.depth or len(rows) < 4:
            return leaf
        best = (1e-6, None, None)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            a = np.bincount(code[rows, j], g[rows], len(c) + 1).cumsum()[:-1]
            b = np.bincount(code[rows, j], h[rows], len(c) + 1).cumsum()[:-1]
            gain = np.where((b > self.least / 10) & (hs - b > self.least / 10), a * a / (b + 1) + (gs - a) ** 2 / (hs - b + 1) - gs * gs / (hs + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] is None:
            return leaf
        _, j, k = best
        left = code[rows, j] <= k
        return ("split", j, float(cuts[j][k]), self._grow(code, cuts, g, h, rows[left], depth + 1), self._grow(code, cuts, g, h, rows[~left], depth + 1))

    def _value(self, node, x):
        if node[0] == "leaf":
            return np.full(len(x), node[1])
        out = np.empty(len(x))
        left = x[:, node[1]] <= node[2]
        out[left], out[~left] = self._value(node[3], x[left]), self._value(node[4], x[~left])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._value(t, x) for t in self.nodes), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising map from score to the share of ones."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        if pools and pools[-1][3] == s:
            pools[-1][0] += v
            pools[-1][1] += 1
        else:
            pools.append([float(v), 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v2, n2, _, hi = pools.pop()
            pools[-1][0] += v2
            pools[-1][1] += n2
            pools[-1][3] = hi
    xs, ys = [], []
    for v, n, lo, hi in pools:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [(v + 0.05) / (n + 0.1)] * (2 if hi > lo else 1)
    return np.array(xs), np.maximum.accumulate(np.array(ys))


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: Boosted | None, knots, share: float):
        self.lexicon, self.trees, self.knots, self.share = lexicon, trees, knots, share

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not len(texts):
            return np.full(len(texts), self.share)
        m = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]))
        calibrated = np.interp(m, *self.knots)
        # a little of the margin keeps the order within a pool
        return np.clip(0.98 * calibrated + 0.02 / (1 + np.exp(-m)), 0, 1)


def train(texts: list[str], toxic: np.ndarray) -> ToxicityModel:
    n = len(texts)
    share = float(toxic.mean()) if n else 0.0
    if not 0 < share < 1:
        return ToxicityModel(Lexicon({w: 3.0 for w in SEEDS}, {}), None, None, share)
    fold = np.zeros(n, np.int64)  # both labels spread evenly over the folds
    for label in (0, 1):
        at = np.flatnonzero(toxic == label)
        fold[at] = np.arange(len(at)) % FOLDS
    counts = {(k, y): Counter() for k in range(FOLDS) for y in (0, 1)}
    for t, k, y in zip(texts, fold, toxic):
        counts[k, int(y)].update(Lexicon.tokens(t))
    sizes = {(k, y): int(((fold == k) & (toxic == y)).sum()) for k in range(FOLDS) for y in (0, 1)}

    def lexicon(without: int | None) -> Lexicon:
        ks = [k for k in range(FOLDS) if k != without]
        bad = sum((counts[k, 1] for k in ks), Counter())
        strong = {t for t, a in bad.items() if a >= 3}
        clean = Counter({t: sum(counts[k, 0][t] for k in ks) for t in strong})
        return Lexicon.learn({t: bad[t] for t in strong}, clean, sum(sizes[k, 1] for k in ks), sum(sizes[k, 0] for k in ks))

    x = np.zeros((n, len(NAMES)))
    for k in range(FOLDS):
        lex = lexicon(k)
        for i in np.flatnonzero(fold == k):
            x[i] = features(texts[i], lex)
    out = np.zeros(n)  # margins from trees that have not seen the row, for the calibration
    for k in range(FOLDS):
        mine = fold == k
        out[mine] = Boosted().fit(x[~mine], toxic[~mine].astype(float)).margin(x[mine])
    return ToxicityModel(lexicon(None), Boosted().fit(x, toxic.astype(float)), isotonic(out, toxic.astype(float)), share)


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """The labelled texts with the least hash of their id (a number or a string), `rows` and `most` bytes of them at most. Labels of ids that repeat or are null are left out."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    ids = ids.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # `rows` rows at most
    sizes = got.groupBy("doc_id", "h").agg(F.max(F.octet_length("text")).alias("b")).where(F.coalesce("b", F.lit(0)) <= most).collect()
    total, last = 0, None
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        total += r["b"] or 0
        if total > most:
            break
        last = r["h"]
    if last is None:
        return [], np.zeros(0, np.int64)
    found = got.where((F.col("h") <= last) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= most)).groupBy("doc_id").agg(F.first("y").alias("y"), F.max("text").alias("text")).collect()
    found.sort(key=lambda r: r["doc_id"])
    return [r["text"] or "" for r in found], np.array([int(r["y"]) for r in found], np.int64)


def _map(batches: Iterator[pa.RecordBatch], model, at: int) -> Iterator[pa.RecordBatch]:
    m: ToxicityModel = model.value
    for b in batches:
        for k in range(0, b.num_rows, 512):
            part = b.slice(k, 512)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != at), pa.array(m.score(part.column(at).to_pylist()), pa.float64())], [*(c for i, c in enumerate(part.schema.names) if i != at), "score"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs without the text, with score (0 to 1); a column score is replaced."""
    src = docs.drop("score") if text != "score" else docs
    at = src.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in src.schema if f.name != text] + [T.StructField("score", T.DoubleType())])
    return src.mapInArrow(lambda it: _map(it, shared, at), schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(third != 1)
    out = score_toxicity(docs, train(*sample(docs, labels)))
    return out.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
