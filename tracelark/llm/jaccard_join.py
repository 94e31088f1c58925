"""Exact n-gram Jaccard self-join as a metric-space join.

Jaccard distance is a metric on shingle sets; two documents link at distance 1 - 0.8 or less. Pivots
create Voronoi regions, windows from the triangle inequality replicate the documents near a border, and
each region is joined by itself, again by pivots while it is large:

1. Equal sets become one class. A class is known by a 64-bit digest of its set.
2. Near copies first. The class of the least digest among those that share one of their HOMES least shingles is a pivot; a class whose
   sketch may link to its pivot takes the pivot's name as its label. This is a head start only: it finds no answer, it saves work.
3. Coarse regions. The first pivots are the single shingles {s}, ranked: those of the crowded cells of a count of all shingles, and those found in
   many texts, come last, else by hash. All {s} within a set are equally near to it, so its home is that of the lowest rank. A document that links to x lacks at
   most a fifth of x, so x is replicated to its pivots of the first |x| - ceil(0.8 |x|) + 1 ranks: two linked
   documents surely meet. Linked sizes differ by a quarter at most, so a region falls apart where its sizes leave a wider gap; this is found
   from key, class and size alone, and what has no neighbour goes on no further. A region whose classes have one label is done; regions with the same members are one. Within a region classes of
   different labels are compared by their sketches (parity bits; their Hamming distance, a metric too, is never
   above the size of the symmetric difference); those that may link are joined, which yields families.
4. Families. Each class sends its text once to its family. There the sets are held, pivots are taken
   from the documents, and Voronoi regions with windows of twice the radius are joined recursively. A pair
   is settled by the bounds |d(x,p) - d(y,p)| and d(x,p) + d(y,p) where these suffice, by its exact
   intersection otherwise. Counts of links and a spanning forest leave the task, never all pairs.
5. Components of the forests.

A region of more than REGION classes is cut by size (linked sets differ by a quarter at most), and what is still larger into blocks, as is a
family of more than FAMILY shingles (or, to spread the work, of more than SPREAD sets); each pair of blocks is a task of 2 REGION classes or 2 FAMILY shingles (one set is never cut). So no task
holds an unbounded group, and nothing is dropped or capped. The work within such a group grows with the square of its blocks.

Defined results: null and wordless texts have an empty set and link with nothing; fewer than five words are
one shingle. A null id stays null: its component takes the smallest id that there is, or null. Rows that
are equal in id and text are in one class. Of a text of any length all words count. An empty table gives an empty one. Extra columns are
ignored, and one_of_each() returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _store
from ._graph import components
from ._rows import col, packed, unpacked
from ._sieve import marked, sieve
from ._words import SPACED, give_back, mix, rolled, shingles, slices

SIZE = 5
#: A region of more classes, or a family of more shingles, is dealt out as pairs of blocks.
REGION, FAMILY = 1_000, 4_000_000
#: Shingles by which near copies meet first.
HOMES = 4
#: Shingles are counted in 2 ** k cells, k between these by the size of the input; a cell of CROWD times the mean is crowded.
CELLS, CROWD = (18, 22), 8
#: Of the shingles below EARLY, where a set's first fifth lies, those that several texts have are counted, among STRETCH of them at a time; the OFTEN
#: commonest at most that come to SEEN rank last too.
EARLY, STRETCH, OFTEN, SEEN = np.uint64(3 * 2**64 // 10), 2_000_000, 1 << 18, 16
#: Labels up to so many rows (16 bytes each) are broadcast.
BROADCAST_LABELS = 1_000_000
#: A family of more sets is dealt over the cluster, as up to WIDE blocks, though one task could hold it.
SPREAD, WIDE = 96, 16
#: Bits of the largest sketch.
SKETCH = 4096


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    return 100 * inter >= 80 * (a + b - inter)


def digest(s: np.ndarray) -> int:
    """A 64-bit name of a set; 0 for the empty one."""
    if not len(s):
        return 0
    both = int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x51A7)))) + len(s) * 0x9E3779B97F4A7C15
    return int(mix(np.array([both & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    bits = 64
    while bits < len(s) and bits < SKETCH:
        bits *= 2
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _unpack(b: bytes, words: int) -> np.ndarray:
    """A sketch folded to so many 64-bit words."""
    x = np.unpackbits(np.frombuffer(b, np.uint8))
    while len(x) > 64 * words:
        h = len(x) // 2
        x = x[:h] ^ x[h:]
    return np.packbits(x).view(np.uint64)


def _early(w) -> np.ndarray:
    """The shingles below EARLY of each text, once a text."""
    h = rolled(w, SIZE, True)
    text = np.repeat(np.arange(w.n), np.diff(w.at))[:len(h)]
    at = np.flatnonzero((h < EARLY) & (text < w.n) & (w.at[text + 1] - np.arange(len(h)) >= SIZE)) if len(h) else np.zeros(0, np.int64)
    at = at[np.argsort(h[at], kind="stable")]
    h, text = h[at], text[at]
    return h[np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))] if len(h) else h


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its n."""
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, n, len(keys)).astype(np.int64)


def _most(keys: np.ndarray, n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The limit keys of the largest n."""
    if len(keys) <= limit:
        return keys, n
    best = np.sort(np.lexsort((keys, -n))[:limit])
    return keys[best], n[best]


def _cells(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """How many shingles of this task fall into each cell, in CHUNKS pieces; then the early shingles that several of some STRETCH texts' shingles are, by the same number of chunks."""
    total = np.zeros(1 << bits, np.int64)
    keys, n, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def counted():
        k, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        held.clear()
        return _most(*_merged(np.concatenate([keys, k[c > 1]]), np.concatenate([n, c[c > 1]])), OFTEN)

    for batch in batches:
        for w in slices(batch.column(0), SPACED):
            h = rolled(w, SIZE)
            if len(h):
                total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            held.append(_early(w))
            size += len(held[-1])
            if size > STRETCH:
                (keys, n), size = counted(), 0
    keys, n = counted()
    parts = [x.tobytes() for x in np.array_split(np.minimum(total, (1 << 32) - 1).astype(np.uint32), CHUNKS)]
    for c in range(CHUNKS):
        mine = keys % np.uint64(CHUNKS) == c
        parts.append(keys[mine].tobytes() + n[mine].tobytes())
    del total, keys, n
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array(range(2 * CHUNKS), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "n"])


CHUNKS = 64


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    often: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if c < CHUNKS:
                v = np.frombuffer(x, np.uint32).astype(np.int64)
                sums[c] = sums[c] + v if c in sums else v
            else:
                k, n = np.frombuffer(x[:len(x) // 2], np.uint64), np.frombuffer(x[len(x) // 2:], np.int64)
                k0, n0 = often.get(c, (k[:0], n[:0]))
                often[c] = _most(*_merged(np.concatenate([k0, k]), np.concatenate([n0, n])), OFTEN)
    out = {c: x.tobytes() for c, x in sums.items()} | {c: _most(k[n >= SEEN], n[n >= SEEN], OFTEN // CHUNKS)[0].tobytes() for c, (k, n) in often.items()}
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int32()), pa.array(out.values(), pa.binary())], ["chunk", "n"])


def crowded(src: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The cells of shingles that are far fuller than the mean, as flags, and single shingles of many texts, sorted. Only the rank of shingles follows from them, never a result."""
    size = int(str(src._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = min(CELLS[1], max(CELLS[0], size.bit_length() - 13))
    kind = "chunk int, n binary"
    got = src.select("text").mapInArrow(lambda it: _cells(it, bits), kind).repartition(CHUNKS, "chunk").mapInArrow(_sums, kind).collect()  # 2 ** bits and OFTEN numbers, 34 MB at most
    got = sorted(got, key=lambda r: r["chunk"])
    cells = [np.frombuffer(r["n"], np.int64) for r in got if r["chunk"] < CHUNKS]
    n = np.concatenate(cells) if cells else np.zeros(1 << bits, np.int64)
    often = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["n"], np.uint64) for r in got if r["chunk"] >= CHUNKS)]))
    return n > CROWD * max(1.0, n.mean()), often


def _measure(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """doc_id, th, text -> doc_id, th, class, n, sketch, homes, keys, hot (the keys of crowded cells and of many texts; these four only for the first of a class in this task)."""
    full, often = shared.value
    shift = np.uint64(64 - (len(full).bit_length() - 1))
    seen: set[int] = set()
    lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(0 if x is None else len(x) for x in xs)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in xs if x is not None)])))
    for batch in batches:
        ids, ns, sks, homes, keys, hot = [], [], [], [], [], []
        for w in slices(batch.column(2), SPACED):
            for s in shingles(w, SIZE):
                c = digest(s)
                ids.append(c)
                ns.append(len(s))
                if len(s) and c not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    late = full[(s >> shift).astype(np.int64)]
                    if len(often):
                        early = s[:np.searchsorted(s, EARLY)]
                        late[:len(early)] |= often[np.minimum(np.searchsorted(often, early), len(often) - 1)] == early
                    cold = s[~late]
                    m = len(s) - (-(-4 * len(s) // 5)) + 1
                    sks.append(sketch(s))
                    homes.append(s[:HOMES])
                    keys.append(cold[:m])
                    hot.append(s[late][:max(0, m - len(cold))])
                else:
                    for x in (sks, homes, keys, hot):
                        x.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(sks, pa.binary()), lists(homes), lists(keys), lists(hot)], ["doc_id", "th", "class", "n", "sketch", "homes", "keys", "hot"])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int, work: Callable[[pa.Table], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Apply work to each run of rows that are equal in the first n_keys columns (the input is sorted by them)."""
    held: list[pa.RecordBatch] = []
    key = None
    out: list[tuple] = []

    def flush():
        t = pa.Table.from_batches(held)
        out.extend(work(t))
        held.clear()

    def made():
        cols = list(zip(*out)) if out else [()] * len(schema)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for c in range(n_keys):
            v = b.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(b.column(c)[0].as_py() for c in range(n_keys))
        if held and first != key:
            flush()
        at = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(at, at[1:]):
            if i:
                flush()
            held.append(b.slice(i, j - i))
        key = tuple(b.column(c)[b.num_rows - 1].as_py() for c in range(n_keys))
        if len(out) > 10_000:
            yield made()
    if held:
        flush()
    if out:
        yield made()
    give_back()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, n, sketch, b, n2, sketch2 -> class and b where the sketches allow a link."""
    for t in batches:
        n, m = t.column(1).to_numpy(), t.column(4).to_numpy()
        ok = (4 * n <= 5 * m) & (4 * m <= 5 * n)
        for k in np.flatnonzero(ok):
            x, y = t.column(2)[int(k)].as_py(), t.column(5)[int(k)].as_py()
            words = min(len(x), len(y)) // 8
            ok[k] = 9 * int(np.bitwise_count(_unpack(x, words) ^ _unpack(y, words)).sum()) <= n[k] + m[k]
        yield pa.RecordBatch.from_arrays([t.column(0), t.column(3)], ["a", "b"]).filter(pa.array(ok))


def _region(t: pa.Table) -> list[tuple]:
    """Pairs of classes of a region that join its labels into families: those that may link, no more than join two labels."""
    cls, n = t.column("class").to_numpy(), t.column("n").to_numpy()
    if len(cls) == 2:
        if 4 * max(n) > 5 * min(n):
            return []
        sk = t.column("sketch").to_pylist()
        words = min(len(sk[0]), len(sk[1])) // 8
        ok = 9 * int(np.bitwise_count(_unpack(sk[0], words) ^ _unpack(sk[1], words)).sum()) <= n[0] + n[1]
        return [(int(cls[0]), int(cls[1]))] if ok else []
    names, label, count = np.unique(t.column("label").to_numpy(), return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    sk = t.column("sketch").to_pylist()
    full = np.array([len(x) // 8 for x in sk])
    folded: dict[int, np.ndarray] = {}
    for w in np.unique(full):  # partners have half to twice the bits, as sizes differ by a quarter at most
        m = np.zeros((len(sk), w), np.uint64)
        for i in np.flatnonzero((full == w) | (full == 2 * w)):
            m[i] = _unpack(sk[i], int(w))
        folded[int(w)] = m
    out = []
    for i in np.flatnonzero(label != count.argmax()):  # two members of the largest label are no pair
        js = np.flatnonzero((label != label[i]) & (4 * n <= 5 * n[i]) & (4 * n[i] <= 5 * n))
        least = np.minimum(full[js], full[i])
        for w in np.unique(least):
            part = js[least == w]
            m = folded[int(w)]
            far = np.bitwise_count(m[part] ^ m[i]).sum(1, dtype=np.int64)
            for x in np.unique(label[part[9 * far <= n[part] + n[i]]]):
                out.append((int(cls[i]), int(cls[np.flatnonzero(label == x)[0]])))
                label[label == x] = label[i]
    return out


class Family:
    """Exact join of the sets of one task; cross: only pairs of two sides count."""

    LEAF, PIVOTS = 8, 8

    def __init__(self, sets: list[np.ndarray], side: np.ndarray | None = None):
        self.sets, self.side = sets, side
        self.n = np.array([len(s) for s in sets], np.int64)
        self.label = np.arange(len(sets))
        self.links = np.zeros(len(sets), np.int64)
        self.settled = [0, 0, 0]  # pairs settled by the upper bound, by windows, by intersections; pairs of far regions are never met

    def run(self) -> Family:
        k = len(self.sets)
        if k > 1:
            self._join(np.arange(k), 0)
        return self

    def distances(self, p: int, who: np.ndarray) -> np.ndarray:
        """Jaccard distances of who from document p."""
        ref = self.sets[p]
        out = np.empty(len(who))
        for a in range(0, len(who), 2048):
            part = who[a:a + 2048]
            flat = np.concatenate([self.sets[i] for i in part])
            at = np.minimum(np.searchsorted(ref, flat), len(ref) - 1)
            hits = np.add.reduceat((ref[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(self.n[part])[:-1]]))
            out[a:a + 2048] = 1 - hits / (self.n[part] + len(ref) - hits)
        return out

    def _join(self, who: np.ndarray, depth: int) -> None:
        """All pairs within who. A pair of two regions is settled in the lower one, whose window holds both."""
        if len(who) <= self.LEAF or depth > 24:
            return self._pairs(who, None, None, None)
        pivots, ds = [who[len(who) // 2]], []
        while True:
            ds.append(self.distances(pivots[-1], who))
            nearest = np.min(ds, 0)
            if len(pivots) == self.PIVOTS or nearest.max() <= 0.4:
                break
            pivots.append(who[int(nearest.argmax())])
        d = np.array(ds)
        cell, best = d.argmin(0), d.min(0)
        if np.bincount(cell).max() > 0.8 * len(who):  # no use in cutting
            return self._pairs(who, None, d, d)
        for r in range(len(pivots)):
            core = np.flatnonzero(cell == r)
            border = np.flatnonzero((cell > r) & (d[r] - best <= 0.4 + 1e-9))
            if len(core):
                self._join(who[core], depth + 1)
                if len(border):
                    self._pairs(who[core], who[border], d[:, core], d[:, border])

    def _pairs(self, xs, ys, dx, dy) -> None:
        """Settle xs among themselves (ys None) or xs against ys, in blocks of rows."""
        among = ys is None
        ys = xs if among else ys
        every = np.concatenate([self.sets[i] for i in (xs if among else np.concatenate([xs, ys]))])
        vals, counts = np.unique(every, return_counts=True)
        shared = vals[counts > 1]
        dense = (len(xs) + len(ys)) * len(shared) <= 1 << 30  # bits, so 128 MB
        if dense:
            bits_y = self._bits(ys, shared)
            bits_x = bits_y if among else self._bits(xs, shared)
        else:
            postings = self._postings(ys, shared)
        for a in range(0, len(xs), 256):
            rows = np.arange(a, min(a + 256, len(xs)))
            cols = np.arange(a, len(ys)) if among else np.arange(len(ys))
            nx, ny = self.n[xs[rows]][:, None], self.n[ys[cols]][None]
            open_ = (4 * nx <= 5 * ny) & (4 * ny <= 5 * nx)
            if among:
                open_ &= cols[None] > rows[:, None]
            if self.side is not None:
                open_ &= self.side[xs[rows]][:, None] != self.side[ys[cols]][None]
            sure = np.zeros_like(open_)
            if dx is not None:
                for p in range(len(dx)):
                    u, v = dx[p][rows][:, None], dy[p][cols][None]
                    far = open_ & (np.abs(u - v) > 0.2 + 1e-9)
                    self.settled[1] += int(far.sum())
                    open_ &= ~far
                    sure |= u + v <= 0.2 - 1e-9
            sure &= open_
            ask = open_ & ~sure
            self.settled[0] += int(sure.sum())
            self.settled[2] += int(ask.sum())
            link = sure
            if ask.any():
                link = sure.copy()
                for k in np.flatnonzero(ask.any(1)):
                    js = np.flatnonzero(ask[k])
                    if dense:
                        inter = np.bitwise_count(bits_y[cols[js]] & bits_x[rows[k]]).sum(1, dtype=np.int64)
                    else:
                        inter = self._intersections(xs[rows[k]], shared, postings, len(ys))[cols[js]]
                    link[k, js] = linked(inter, nx[k], ny[0, js])
            for r, c in zip(rows, link):
                js = ys[cols[c]]
                if len(js):
                    x = xs[r]
                    self.links[x] += len(js)
                    self.links[js] += 1
                    ls = np.unique(np.append(self.label[js], self.label[x]))
                    if len(ls) > 1:
                        self.label[np.isin(self.label, ls)] = ls[0]

    def _codes(self, i: int, shared: np.ndarray) -> np.ndarray:
        if not len(shared):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(shared, self.sets[i]), len(shared) - 1)
        return at[shared[at] == self.sets[i]]

    def _bits(self, who, shared) -> np.ndarray:
        """For each of who the shared shingles that it has, as bits."""
        words = len(shared) // 64 + 1
        out = np.zeros((len(who), words), np.uint64)
        for k, i in enumerate(who):
            row = np.zeros(words * 64, np.uint8)
            row[self._codes(i, shared)] = 1
            out[k] = np.packbits(row).view(np.uint64)
        return out

    def _postings(self, who, shared) -> tuple[np.ndarray, np.ndarray]:
        """Rows of who by shared shingle, and where each shingle's rows begin."""
        codes = [self._codes(i, shared) for i in who]
        row = np.repeat(np.arange(len(who)), [len(c) for c in codes])
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        return row[order], np.searchsorted(code[order], np.arange(len(shared) + 1))

    def _intersections(self, i, shared, postings, size) -> np.ndarray:
        rows, base = postings
        code = self._codes(i, shared)
        a, m = base[code], base[code + 1] - base[code]
        idx = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum())) if len(code) else np.zeros(0, np.int64)
        return np.bincount(rows[idx], minlength=size)


def _family(t: pa.Table) -> list[tuple]:
    """(class, root, links) of a family, or of a pair of its blocks (links between the two, or within one)."""
    cls = t.column("class").to_numpy()
    block = t.column("block").to_numpy()
    sets, keep, seen = [], [], set()
    at = 0
    for w in slices(t.column("text"), SPACED):
        for s in shingles(w, SIZE):
            c = int(cls[at])
            if c not in seen and digest(s) == c:
                seen.add(c)
                sets.append(s)
                keep.append(at)
            at += 1
    f = Family(sets, block[keep] if t.column("cross")[0].as_py() else None).run()
    got = cls[keep]
    out = []
    for root in np.unique(f.label):
        members = np.flatnonzero(f.label == root)
        least = int(got[members].min())
        out += [(int(got[i]), least, int(f.links[i])) for i in members if f.links[i]]
    return out


def jaccard_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", region: int = REGION, family: int = FAMILY) -> DataFrame:
    """Each row's doc_id, th (hash of the text), n_shingles, component_id, n_links (links of its set to other sets) and root (a name of its component; null without words)."""
    spark = docs.sparkSession
    src = docs.select(col(key).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("th"), col(text).alias("text"))
    shared = spark.sparkContext.broadcast(crowded(src))
    sets = _store.durable(src.mapInArrow(lambda it: _measure(it, shared), "doc_id long, th long, class long, n long, sketch binary, homes array<long>, keys array<long>, hot array<long>"), "sets")
    classes_path = _store.store(sets.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.max("sketch").alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("rep")), "set_classes")
    classes = _store.reread(spark, classes_path)
    drawn = classes.select("class", "n", "sketch")

    # near copies first: each class against the pivots of its homes
    homes = sets.where("sketch is not null").select(F.explode("homes").alias("key"), "class")
    pivots = homes.groupBy("key").agg(F.min("class").alias("b"), F.max("class").alias("z")).where("b <> z").select("key", "b")
    pairs = homes.join(pivots, "key").where("class <> b").select("class", "b").distinct()
    pairs = pairs.join(drawn, "class").join(drawn.withColumnsRenamed({"class": "b", "n": "n2", "sketch": "sketch2"}), "b").select("class", "n", "sketch", "b", "n2", "sketch2")
    near_path = _store.store(pairs.mapInArrow(_near, "a long, b long"), "near")
    near = _store.reread(spark, near_path)
    labels = near.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = F.broadcast(labels) if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else labels
    named = lambda df: df.join(labels, F.col("class") == F.col("node"), "left").drop("node").withColumn("label", F.coalesce("label", "class"))
    first = sets.where("sketch is not null")

    # regions with two labels or more, cut where sizes leave a gap that no link spans; those with the same members are one. Only key, class and size
    # are dealt out for all; labels and, later, sketches are fetched for what is left. A crowded key may have any number of rows: it is counted first
    cold = _chained(first.select(F.explode("keys").alias("key"), "class", "n").repartition("key"))
    w = _over("key", "chain")
    cold = named(cold).select("class", "n", "label", F.min("label").over(w).alias("x"), F.max("label").over(w).alias("y"), F.count("*").over(w).alias("c"), F.bit_xor(F.xxhash64("class")).over(w).alias("s1"), F.bit_xor(F.xxhash64("class", F.lit(1))).over(w).alias("s2")).where("x <> y")
    hot = named(first.select(F.explode("hot").alias("s1"), "class", "n")).distinct()
    mixed = hot.groupBy("s1").agg(F.count("*").alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("s1", "c")
    hot = hot.join(mixed, "s1").select("class", "n", "label", "c", "s1", F.lit(0).cast("long").alias("s2"))
    members_path = _store.store(cold.select("class", "n", "label", "c", "s1", "s2").unionByName(hot).distinct(), "members")
    members = _store.reread(spark, members_path).join(drawn.select("class", "sketch"), "class")
    small = members.where(F.col("c") <= region).select("s1", "s2", F.lit(0).alias("band"), F.lit(0).alias("pair"), "class", "n", "sketch", "label")
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    large = members.where(F.col("c") > region).withColumn("band", F.explode(F.array(band + 1, band + 2)))
    sizes = large.groupBy("s1", "s2", "band").agg(F.ceil(F.count("*") / region).cast("int").alias("blocks"))
    large = large.join(sizes, ["s1", "s2", "band"]).withColumn("pair", F.explode(_pairs_of(F.pmod(F.xxhash64("class", F.lit(7)), F.col("blocks")).cast("int"), F.col("blocks"))))
    dealt = small.unionByName(large.select(*small.columns)).repartition("s1", "s2", "band", "pair").sortWithinPartitions("s1", "s2", "band", "pair")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    edges = dealt.mapInArrow(lambda it: _groups(it, 4, _region, schema), "a long, b long")
    edges_path = _store.store(edges.unionByName(near).distinct(), "candidates")
    fams = components(_store.reread(spark, edges_path))

    # families with their texts; a bitmap of the texts in question keeps the others from being shuffled
    fam = fams.join(classes.select("class", "n", "rep"), fams.node == F.col("class")).select("class", "comp", "n", "rep.doc_id", "rep.th")
    size = fam.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") / family), F.least(F.ceil(F.count("*") / SPREAD), F.lit(WIDE))).cast("int").alias("blocks"))
    fam_path = _store.store(fam.join(size, "comp").select("class", "comp", "blocks", "doc_id", "th"), "families")
    fam = _store.reread(spark, fam_path)
    rid = [F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("z"), F.col("th").alias("t")]
    d = marked(src, "th", sieve(fam, "th")).where("sieve_hit").groupBy(*rid).agg(F.first("text").alias("text"))  # rows equal in id and text: one
    got = fam.select("class", "comp", "blocks", *rid).join(d, ["d", "z", "t"])
    block = F.pmod(F.xxhash64("class", F.lit(9)), F.col("blocks")).cast("int")
    got = got.select("comp", F.explode(_pairs_of(block, F.col("blocks"))).alias("pair"), "class", block.alias("block"), "text", "blocks").withColumn("cross", F.col("pair") % (F.col("blocks") + 1) != 0).drop("blocks").repartition("comp", "pair").sortWithinPartitions("comp", "pair")
    found_schema = pa.schema([("class", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    found_path = _store.store(got.mapInArrow(lambda it: _groups(it, 2, _family, found_schema), "class long, root long, links long"), "links")
    found = _store.reread(spark, found_path)
    roots = found.where("class != root").select(F.col("class").alias("a"), F.col("root").alias("b"))
    if fam.where("blocks > 1").limit(1).count():
        comp = components(roots).select(F.col("node").alias("class"), F.col("comp").alias("root"))
    else:
        comp = found.select("class", "root")
    links = found.groupBy("class").agg(F.sum("links").alias("n_links"))
    least = classes.select("class", F.col("rep.doc_id").alias("least"))
    whole = comp.join(least, "class").groupBy("root").agg(F.min("least").alias("component"))
    by_class = comp.join(whole, "root").join(links, "class").select(F.col("class").alias("k"), "root", "component", "n_links")
    by_class = least.join(by_class, F.col("class") == F.col("k"), "left").select(F.col("class").alias("k"), F.coalesce("root", "class").alias("root"), F.coalesce("component", "least").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    by_class = _store.durable(by_class, "classes")
    for path in (classes_path, near_path, members_path, edges_path, fam_path, found_path):
        _store.drop(spark, path)
    out = sets.join(by_class, (F.col("n") > 0) & (F.col("class") == F.col("k")), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "root")


def _over(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _chained(rows: DataFrame) -> DataFrame:
    """key, class, n -> key, chain, class, n, each once. Sizes of a key's rows that follow one another by a quarter at most are a chain, so linked sets are in one; chains of one row go."""
    w = _over("key").orderBy("n")
    near = lambda a, b: F.coalesce(4 * F.col(b) <= 5 * F.col(a), F.lit(False))
    rows = rows.select("key", "class", "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"))
    rows = rows.select("key", "class", "n", near("before", "n").alias("goes_on"), near("n", "after").alias("ahead")).where("goes_on or ahead")
    return rows.select("key", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w).alias("chain"), "class", "n").distinct()


def _pairs_of(block, blocks):
    """The pairs of blocks that a row of this block belongs to, as numbers; its block alone where there is one."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(block, j) * blocks + F.greatest(block, j))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of the smallest id. Wordless documents stay, repeated rows of theirs once."""
    got = jaccard_classes(docs, text, key)
    alone = F.col("root").isNull()
    comp = F.struct("root", F.when(alone, F.col("doc_id")).alias("c"), F.when(alone, F.col("th")).alias("t"))
    rows = got.groupBy("root", "doc_id", "th").agg(F.count("*").alias("same")).withColumn("comp", comp).withColumn("k", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th"))
    best = rows.groupBy("comp").agg(F.min("k").alias("best"), F.count("*").alias("m"), F.max("same").alias("same")).where("m > 1 or same > 1").drop("same")
    # rows to judge: those of components with more than one row; all others stay without a shuffle of their texts
    judged = rows.join(best, "comp").where(~((F.col("k") == F.col("best")) & (F.col("same") == 1))).select("doc_id", "th", (F.col("k") == F.col("best")).alias("first"))
    judged = _store.durable(judged, "repeats").withColumnsRenamed({"doc_id": "kd", "th": "kt"})
    src = marked(packed(docs, d=col(key).cast("long"), t=F.xxhash64(col(text))), "t", sieve(judged, "kt"))
    sure = src.where("not sieve_hit").select("row")
    asked = src.where("sieve_hit").join(judged, F.col("d").eqNullSafe(F.col("kd")) & (F.col("t") == F.col("kt")), "left").where("first is null or first")
    once = asked.where("first").groupBy("d", "t").agg(F.first("row").alias("row")).select("row")
    return unpacked(sure.unionByName(asked.where("first is null").select("row")).unionByName(once), docs.columns)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, [e FOR e IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF e <> ''] AS w FROM documents),
s AS (SELECT DISTINCT rid, g FROM (SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t)),
n AS (SELECT rid, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY rid),
c AS (SELECT k, min(n) AS n, min(rid) AS r FROM n GROUP BY k),
cs AS (SELECT k, c.n, g FROM s JOIN c ON rid = r),
l AS (SELECT a.k AS x, b.k AS y FROM cs a JOIN cs b USING (g) WHERE a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT k AS x, k AS y FROM c UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
comp AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN n ON n.k = y JOIN t USING (rid) GROUP BY x),
deg AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE component_id END AS component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM t LEFT JOIN n USING (rid) LEFT JOIN comp ON comp.x = n.k LEFT JOIN deg ON deg.x = n.k
"""
