"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, and which of them a chunk uses is chosen jointly. A sequence of length c costs
OVERHEAD + c (1 + c / ATTENTION): its tokens, padding too, and its attention, so that a short sequence is cheaper for each token
and a long one pays only for what needs it. Pieces are placed longest first: into the open bin that they fill best (the least
room left), else into a new bin. The new bin's length is the one of least cost for each token it will hold: the piece and what
of the shorter pieces still to come can fill the rest. At the end each bin is cut down to the shortest permitted length that holds its contents.
This is done for each set of lengths that can take the longest piece (2 ** (k - 1) sets for k lengths at most), and the
cheapest outcome is taken; so none costs more than best fit at a single length.

A document longer than the longest length is cut into full sequences and a rest; no token is dropped, and the texts of a document's pieces,
joined in order, are the document's text to the byte. Rows are packed in chunks of CHUNK pieces or CHUNK_BYTES of text within
their partition, so no task holds more, and no shuffle is needed. The order of rows within a chunk does not matter.

Defined results: a null or wordless text has no tokens and goes into no bin (bin null, capacity 0). Null and repeated ids are packed row by row.
Ties: equal pieces by id, then by place in the text, then by text; bins of equal room by number. An empty table gives an empty one.
Only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._rows import col
from ._words import SPACED, give_back, slices

LENGTHS = (256, 512, 1024, 2048)
CHUNK, CHUNK_BYTES = 20_000, 32_000_000
#: What a sequence costs besides its own length, in tokens, and the length at which attention costs as much as all else.
OVERHEAD, ATTENTION = 8, 4096


def cost(length: int) -> float:
    """Cost of a sequence of this length, in tokens."""
    return OVERHEAD + length * (1 + length / ATTENTION)


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[list]:
    """Bins as [capacity, [number of the piece, ...], tokens], the cheapest over the sets of lengths. Each size is 1 .. max(lengths)."""
    lengths = tuple(sorted(set(lengths)))
    if not sizes:
        return []
    least = max(sizes)
    sets = [x for k in range(1, len(lengths) + 1) for x in combinations(lengths, k) if x[-1] >= least]
    return min((fit(sizes, x, lengths) for x in sets), key=lambda bins: sum(cost(b[0]) for b in bins))


def fit(sizes: list[int], opened: tuple[int, ...], lengths: tuple[int, ...]) -> list[list]:
    """Best fit with bins of the lengths `opened`, cut down at the end to the permitted lengths."""
    top = opened[-1]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    waiting = np.bincount(np.asarray(sizes, np.int64), minlength=top + 1)
    tree = _Sums((waiting * np.arange(top + 1)).tolist()) if len(opened) > 1 else None
    bins: list[list] = []
    rooms: list[int] = []  # the rooms that open bins have, sorted
    by_room: dict[int, list[int]] = {}
    for i in order:
        s = sizes[i]
        if tree is not None:
            tree.add(s, -s)
        k = bisect.bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop(0)
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
            bins[b][1].append(i)
            bins[b][2] += s
        else:
            able = [c for c in opened if c >= s]
            room = able[0] if len(able) == 1 else min(able, key=lambda c: (cost(c) / (s + min(c - s, tree.upto(c - s))), c))
            b = len(bins)
            bins.append([room, [i], s])
        if room > s:
            if room - s not in by_room:
                bisect.insort(rooms, room - s)
                by_room[room - s] = []
            bisect.insort(by_room[room - s], b)
    for b in bins:
        b[0] = lengths[bisect.bisect_left(lengths, b[2])]
    return bins


class _Sums:
    """Sums of tokens by piece size (a Fenwick tree)."""

    def __init__(self, values):
        self.n = len(values)
        self.t = [0] * (self.n + 1)
        for i, v in enumerate(values):
            if v:
                self.add(i, int(v))

    def add(self, i: int, v: int) -> None:
        i += 1
        while i <= self.n:
            self.t[i] += v
            i += i & -i

    def upto(self, i: int) -> int:
        """Sum of sizes 0 .. i."""
        i = min(i + 1, self.n)
        out = 0
        while i > 0:
            out += self.t[i]
            i -= i & -i
        return out


_NAMES = ["doc_id", "piece", "start", "tokens", "bin", "position", "capacity", "bin_tokens", "text"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
_SCHEMA = "doc_id long, piece int, start long, tokens int, bin string, position int, capacity int, bin_tokens int, text string"


def pieces(texts: pa.Array, top: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(row, piece, first token, tokens, text) of each piece of each text; a piece's text ends where the next one's first token begins."""
    for w in slices(texts, SPACED):
        for i in range(w.n):
            a, n, base = int(w.at[i]), int(w.at[i + 1] - w.at[i]), int(w.rel[i])
            raw = w.text(i)
            cuts = [0, *(int(w.start[a + s]) - base for s in range(top, n, top)), len(raw)]
            for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                yield w.first + i, k, k * top, min(top, n - k * top), raw[x:y]


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, chunk: int = CHUNK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, piece (from 0), start (its first token), tokens (words between white space), bin (partition-chunk-number), position in the bin, capacity of the bin, its tokens, and the piece's text."""
    top = max(lengths)
    src = docs.select(col(key).cast("long").alias("doc_id"), col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, size, held = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            held.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1], p[3], p[4] or b""))
            full = [p for p in held if p[3] > 0]
            rows = []
            for b, (cap, inside, used) in enumerate(pack([p[3] for p in full], lengths)):
                rows += [(*full[i][:4], f"{part}-{number}-{b}", at, cap, used, full[i][4]) for at, i in enumerate(inside)]
            rows += [(*p[:4], None, None, 0, 0, p[4]) for p in held if p[3] == 0]
            held.clear()
            number, size = number + 1, 0
            for k in range(0, len(rows), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 2_000]), _TYPES)], _NAMES)

        for b in batches:
            ids, null = b.column(0).to_pylist(), b.column(1).is_null().to_pylist()
            for row, k, start, n, raw in pieces(b.column(1), top):
                held.append((ids[row], k, start, n, None if null[row] else raw))
                size += len(raw)
                if len(held) >= chunk or size >= CHUNK_BYTES:
                    yield from flush()
        if held:
            yield from flush()
        give_back()

    return src.mapInArrow(work, _SCHEMA)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
