"""Masked pseudo-likelihood of documents under a bidirectional window network, trained in numpy.

Every word is predicted from the WINDOW words on either side of it, and the logs of these conditional probabilities are
summed over the document. P(word | both sides) = P(class | both sides) P(word | class). The first factor is the network's
(embeddings of the neighbours, one tanh layer, softmax over CLASSES classes: the OWN most frequent words have one each, the other known words share
classes by their mass, and the unknown ones have one). The second comes from exact counts of all words over all documents, without the document's own:
a document does not vouch for itself, so that one that occurs twice scores apart from one that occurs once.

What is gathered grows with the corpus. Each distinct word is counted (by a 64-bit value) in a table in the shared folder. The most frequent ones, KNOWN at most
(12 MB), go to every task; the counts of all others are joined to the documents that hold them by shuffle. Embedding rows: the ROWS most frequent words
have one each, the others share SHARED rows for each class.

Training does not depend on how rows lie: texts are cut into segments, which a hash deals to shards of about SHARD words (their number
follows the number of words). In each of ROUNDS rounds every shard trains from the same start, STEPS steps long, on every ROUNDS-th word as target, each round on
others, and the weights (and Adagrad's sums) are averaged by targets. So every word is a target once, and with its whole window: a segment brings the WINDOW words
before and after it along, as neighbours only.

Defined results: a null or wordless text has no tokens, a sum of 0 and a null mean. Rows that are equal score alike; ties have no effect. A text of any length is
scored whole (in training it is cut into segments of SEGMENT words). An empty table gives an empty one. Only the key and the text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _store
from ._rows import col
from ._words import SPACED, give_back, mix, slices

KNOWN = 1 << 20
CLASSES, OWN, ROWS, SHARED = 64, 48, 4096, 64
WINDOW, WIDTH, HIDDEN = 2, 16, 32
#: Rows of the embedding: own ones, shared ones for each class without own words, the edge of a text.
CELLS = ROWS + (CLASSES - OWN) * SHARED
SHARD, SEGMENT = 1_000_000, 4096
ROUNDS, STEPS, RATE, CHUNKS = 4, 64, 0.1, 64
BATCH = 4096
#: Added to each count.
ALPHA = 0.1
_SHIFTS = [k for k in range(-WINDOW, WINDOW + 1) if k]


class Network:
    """Weights in one flat vector: embeddings (a row more for the edge of a text), two layers; then Adagrad's sums of squares."""

    SHAPES = ((CELLS + 1, WIDTH), (2 * WINDOW * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray | None = None, seen: np.ndarray | None = None, bias: np.ndarray | None = None):
        if flat is None:
            r = np.random.default_rng(7)
            flat = np.concatenate([(r.standard_normal(int(np.prod(s))) * (0.3 if k == 0 else 1 / np.sqrt(s[0])) * (len(s) == 2) * (0.1 if k == 3 else 1)).astype(np.float32) for k, s in enumerate(self.SHAPES)])
        self.flat = np.array(flat, np.float32)
        self.parts, at = [], 0
        for s in self.SHAPES:
            n = int(np.prod(s))
            self.parts.append(self.flat[at:at + n].reshape(s))
            at += n
        if bias is not None:
            self.parts[4][:] = bias
        self.seen = np.full(self.SIZE, 1e-3, np.float32) if seen is None else np.array(seen, np.float32)
        self.layer: list[np.ndarray] | None = None

    def forward(self, context: np.ndarray):
        e, w1, b1, w2, b2 = self.parts
        x = e[context].reshape(len(context), -1)
        h = np.tanh(x @ w1 + b1)
        z = h @ w2 + b2
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        total = p.sum(1, keepdims=True)
        return x, h, z, p, total

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """In doubles, so that how rows are batched shows only beyond the digits that are kept; the first layer by a table for each neighbour."""
        w1, b1, w2, b2 = (x.astype(np.float64) for x in self.parts[1:])
        if self.layer is None:
            e = self.parts[0].astype(np.float64)
            self.layer = [e @ w for w in np.split(w1, 2 * WINDOW)]
        h = np.tile(b1, (len(context), 1))
        for k, table in enumerate(self.layer):
            h += table[context[:, k]]
        z = np.tanh(h, out=h) @ w2 + b2
        z -= z.max(1, keepdims=True)
        got = z[np.arange(len(target)), target]
        return got - np.log(np.exp(z, out=z).sum(1))

    def step(self, context: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
        e, w1, _, w2, _ = self.parts
        x, h, _, p, total = self.forward(context)
        p /= total
        p[np.arange(len(target)), target] -= 1
        p /= len(target)
        dh = (p @ w2.T) * (1 - h * h)
        dx = (dh @ w1.T).reshape(-1, WIDTH)
        at = context.ravel()
        de = np.stack([np.bincount(at, dx[:, k], CELLS + 1) for k in range(WIDTH)], 1)
        g = np.concatenate([de.ravel(), (x.T @ dh).ravel(), dh.sum(0), (h.T @ p).ravel(), p.sum(0)]).astype(np.float32)
        self.seen += g * g
        self.flat -= rate * g / np.sqrt(self.seen)
        self.layer = None


class LanguageModel:
    """The known words (sorted values, counts, embedding rows), the class of each row, each class's mass, and the weights."""

    def __init__(self, words: np.ndarray, n: np.ndarray, rare_mass: int = 0, rare_words: int = 0, flat: np.ndarray | None = None, seen: np.ndarray | None = None):
        order = np.lexsort((words, -n))  # the most frequent first
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        mass = n[order].astype(np.float64)
        mid = max(1, CLASSES - OWN - 1)
        cls = np.minimum(np.arange(len(words)), OWN)
        if len(words) > OWN:
            rest = mass[OWN:].cumsum()
            cls[OWN:] = OWN + np.minimum((rest / rest[-1] * mid).astype(np.int64), mid - 1)
        total = np.bincount(cls, mass, CLASSES)
        distinct = np.bincount(cls, minlength=CLASSES).astype(np.float64)
        total[-1], distinct[-1] = rare_mass, rare_words
        self.log_mass = np.log(total + ALPHA * np.maximum(distinct, 1))
        self.bias = np.log((total + ALPHA * distinct + ALPHA) / (total + ALPHA * distinct + ALPHA).sum()).astype(np.float32)
        value = np.argsort(words)
        self.words, self.n = words[value], n[value]
        rank = rank[value]
        self.row = np.where(rank < ROWS, rank, _shared(cls[rank], self.words)).astype(np.uint16)
        # a word's class follows from its row; own rows of words by rank
        self.row_class = np.concatenate([np.pad(cls[:ROWS], (0, max(0, ROWS - len(cls)))), np.repeat(np.arange(OWN, CLASSES), SHARED), [CLASSES - 1]]).astype(np.int64)
        self.flat, self.seen = flat, seen

    def network(self) -> Network:
        return Network(self.flat, self.seen, self.bias if self.flat is None else None)

    def rows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word value its place among the known words, or -1, and its embedding row."""
        if not len(self.words):
            return np.full(len(h), -1), _shared(np.full(len(h), CLASSES - 1), h).astype(np.uint16)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        return np.where(known, at, -1), np.where(known, self.row[at], _shared(CLASSES - 1, h)).astype(np.uint16)


def _shared(cls, words: np.ndarray) -> np.ndarray:
    """The shared embedding row of words of these classes."""
    return ROWS + (np.maximum(cls, OWN) - OWN) * SHARED + (words >> np.uint64(40)).astype(np.int64) % SHARED


def contexts(row: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The neighbours' rows of each word; CELLS beyond the edges of its text."""
    out = np.full((len(row), len(_SHIFTS)), CELLS, np.int32)
    for k, s in enumerate(_SHIFTS):
        a, b = (slice(-s, None), slice(None, s)) if s < 0 else (slice(None, -s or None), slice(s, None))
        if len(row) > abs(s):
            out[a, k] = np.where(text[a] == text[b], row[b], CELLS)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        word, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return word, np.bincount(at, np.concatenate([n for _, n in held]), len(word)).astype(np.int64)

    out = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in (held[0][0].view(np.int64), held[0][1])], ["word", "n"])
    for b in batches:
        for w in slices(b.column(0), SPACED):
            held.append(np.unique(w.hash, return_counts=True))
            size += len(held[-1][0])
            if size > 1_500_000:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield out()
                    held.clear()
                    size = 0
    if held:
        held[:] = [merged()]
        yield out()


def _segments(batches: Iterator[pa.RecordBatch], shared, shards: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> shard, order, rows (embedding rows of a segment's words and of the neighbours beyond its cuts, two bytes each), and how many are before it, its own, after it."""
    m: LanguageModel = shared.value
    for b in batches:
        key = mix(b.column(0).fill_null(0).to_numpy().view(np.uint64))
        to, order, rows, parts = [], [], [], []
        for w in slices(b.column(1), SPACED):
            if not len(w.hash):
                continue
            _, row = m.rows(w.hash)
            starts = [x for i in range(w.n) for x in range(int(w.at[i]), int(w.at[i + 1]), SEGMENT)]
            of = np.searchsorted(w.at, starts, "right") - 1
            sums = np.add.reduceat(mix(w.hash ^ (np.arange(len(w.hash), dtype=np.uint64) - w.at[np.repeat(np.arange(w.n), np.diff(w.at))].astype(np.uint64))), starts)
            h = mix(sums ^ key[w.first + of])
            to += (h % np.uint64(shards)).astype(np.int64).tolist()
            order.append(h.view(np.int64))
            for x, y, i in zip(starts, [*starts[1:], len(row)], of):
                a, z = max(x - WINDOW, int(w.at[i])), min(y + WINDOW, int(w.at[i + 1]))
                rows.append(row[a:z].tobytes())
                parts.append(np.array([x - a, y - x, z - y], np.int32).tobytes())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.concatenate(order)), pa.array(rows, pa.binary()), pa.array(parts, pa.binary())], ["shard", "ord", "rows", "parts"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments -> one row for each shard (more, if it came out twice as large as meant): rows, and the segments' parts."""
    held: list[bytes] = []
    parts: list[bytes] = []
    size, shard = 0, None

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([b"".join(held)], pa.binary()), pa.array([b"".join(parts)], pa.binary())], ["shard", "rows", "parts"])
        held.clear()
        parts.clear()
        return got

    for b in batches:
        for s, x, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if held and (s != shard or size > 4 * SHARD):
                yield out()
                size = 0
            shard = s
            held.append(x)
            parts.append(p)
            size += len(x)
    if held:
        yield out()


def _train(batches: Iterator[pa.RecordBatch], shared, turn: int, rounds: int = ROUNDS) -> Iterator[pa.RecordBatch]:
    """Each shard's weights and sums times its targets, added up, in chunks. The turns 0 to rounds - 1 together take every word as target once."""
    m: LanguageModel = shared.value
    total, targets = np.zeros(2 * Network.SIZE), 0
    for b in batches:
        for raw, parts in zip(b.column(1), b.column(2)):
            row, parts = np.frombuffer(raw.as_buffer(), np.uint16), np.frombuffer(parts.as_buffer(), np.int32).reshape(-1, 3)
            net = m.network()
            context = contexts(row, np.repeat(np.arange(len(parts), dtype=np.int32), parts.sum(1)))
            pick = np.flatnonzero(np.repeat(np.tile([False, True, False], len(parts)), parts.ravel()))[turn::rounds]
            np.random.default_rng(turn).shuffle(pick)
            target = m.row_class[row]
            for at in np.array_split(pick, min(STEPS, len(pick))) if len(pick) else ():
                net.step(context[at], target[at])
            total += len(pick) * np.concatenate([net.flat, net.seen]).astype(np.float64)
            targets += len(pick)
            del row, context, pick, target
            give_back()
    if targets:
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([targets] * CHUNKS, pa.int64()), pa.array([x.tobytes() for x in np.array_split(total, CHUNKS)], pa.binary())], ["chunk", "targets", "weights"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for b in batches:
        for c, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            v = np.frombuffer(x, np.float64)
            if c in sums:
                sums[c][0] += n
                sums[c][1] += v
            else:
                sums[c] = [n, v.copy()]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], ["chunk", "targets", "weights"])


class Fitted:
    """A trained model and the table of the words that it does not know, with their counts."""

    def __init__(self, model: LanguageModel, rare: DataFrame):
        self.model, self.rare = model, rare


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (its 64-bit value) and n over all documents."""
    return docs.select(col(text).alias("text")).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", known: int = KNOWN, rounds: int = ROUNDS) -> Fitted:
    spark = docs.sparkSession
    words = _store.durable(count_words(docs, text), "words")
    # the least count that at most `known` words reach: counts by their log, some hundred rows
    steps = sorted(words.groupBy(F.floor(F.log2("n") * 16).alias("k")).agg(F.count("*").alias("w"), F.sum("n").alias("m"), F.min("n").alias("least")).collect(), key=lambda r: -r["k"])
    have = total = 0
    least = None
    for r in steps:
        total += r["m"]
        have += r["w"]
        if have <= known:
            least = r["least"]
    is_known = F.col("n") >= least if least is not None else F.lit(False)
    top = words.where(is_known).toArrow()  # `known` rows at most
    rare = words.where(~is_known)
    value, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    model = LanguageModel(value, n, total - int(n.sum()), have - len(n))
    shared = spark.sparkContext.broadcast(model)
    shards = max(1, round(total / SHARD))
    src = docs.select(F.xxhash64(col(key)).alias("doc_id"), col(text).alias("text"))
    cut = src.mapInArrow(lambda it: _segments(it, shared, shards), "shard long, ord long, rows binary, parts binary").repartition("shard").sortWithinPartitions("shard", "ord", "rows")
    path = _store.store(cut.mapInArrow(_gather, "shard long, rows binary, parts binary"), "shards")
    kind = "chunk int, targets long, weights binary"
    for turn in range(rounds):
        got = _store.reread(spark, path).mapInArrow(lambda it, s=shared, t=turn: _train(it, s, t, rounds), kind).repartition(CHUNKS, "chunk").mapInArrow(_sum, kind).collect()  # CHUNKS rows, 2 SIZE numbers
        if got:
            flat, seen = np.split(np.concatenate([np.frombuffer(r["weights"], np.float64) / r["targets"] for r in sorted(got, key=lambda r: r["chunk"])]), 2)
            model.flat, model.seen = flat.astype(np.float32), seen.astype(np.float32)
            shared = spark.sparkContext.broadcast(model)
    _store.drop(spark, path)
    return Fitted(model, rare)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """doc_id, text, rid -> rid, doc_id, n_tokens, the sum but for what counts of rare words add, words that no other text has, rare words and how often."""
    m: LanguageModel = shared.value
    net = m.network()
    for b in batches:
        sums, ns, unseen = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        rare: list = [None] * b.num_rows
        times: list = [None] * b.num_rows
        for w in slices(b.column(1), SPACED):
            n = np.diff(w.at)
            text = np.repeat(np.arange(w.n), n)
            ns[w.first:w.first + w.n] = n
            if not len(text):
                continue
            at, row = m.rows(w.hash)
            target, context = m.row_class[row], contexts(row, text)
            logp = np.empty(len(row))
            for k in range(0, len(row), BATCH):
                logp[k:k + BATCH] = net.log_probability(context[k:k + BATCH], target[k:k + BATCH])
            logp -= m.log_mass[target]
            # how often each word stands in its own text
            pair = mix(w.hash ^ mix(text.astype(np.uint64)))
            order = np.argsort(pair)
            first = np.concatenate([[True], np.diff(pair[order]) != 0])
            run = np.diff(np.append(np.flatnonzero(first), len(pair)))
            own = np.empty(len(pair), np.int64)
            own[order] = np.repeat(run, run)
            known = at >= 0
            others = m.n[at[known]] - own[known]
            logp[known] += np.log(others + ALPHA)
            sums[w.first:w.first + w.n] = np.bincount(text, logp, w.n)
            unseen[w.first:w.first + w.n] = np.bincount(text[known][others == 0], minlength=w.n)
            left = order[first]
            left = left[~known[left]]
            left = left[np.argsort(text[left], kind="stable")]
            cut = np.searchsorted(text[left], np.arange(w.n + 1))
            for i in np.flatnonzero(np.diff(cut)):
                j = left[cut[i]:cut[i + 1]]
                rare[w.first + i], times[w.first + i] = w.hash[j].view(np.int64), own[j]
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(ns), pa.array(sums), pa.array(unseen), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], ["rid", "doc_id", "n_tokens", "s", "u", "rare", "times"])


def score(docs: DataFrame, fitted: Fitted, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood and mean_log_probability of each row, and n_unseen: its tokens that no other document has.

    The documents must be those of the fit, as each leaves its own words out of the counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted.model)
    src = docs.select(col(key).cast("long").alias("doc_id"), col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    part = _store.durable(src.mapInArrow(lambda it: _score(it, shared), "rid long, doc_id long, n_tokens long, s double, u long, rare array<long>, times array<long>"), "scores")
    found = part.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("own")).join(fitted.rare, "word")
    others = F.greatest(F.col("n") - F.col("own"), F.lit(0))
    found = found.groupBy("rid").agg(F.sum(F.col("own") * F.log(others + ALPHA)).alias("s2"), F.sum(F.when(others == 0, F.col("own")).otherwise(0)).alias("u2"))
    out = part.select("rid", "doc_id", "n_tokens", "s", "u").join(found, "rid", "left")
    total = F.round(F.col("s") + F.coalesce("s2", F.lit(0.0)), 6)  # sums in another order differ beyond that
    out = out.select("doc_id", "n_tokens", total.alias("pseudo_log_likelihood"), (F.col("u") + F.coalesce("u2", F.lit(0))).cast("long").alias("n_unseen"))
    return out.withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens")))


def op5_masked_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs))
