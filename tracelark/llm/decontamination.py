"""Benchmark decontamination with a generalised suffix automaton.

The normalised items (A-Z lowered, words of a-z, 0-9 and everything beyond ASCII) make one automaton
over word sequences. Training texts stream through it: at each word the automaton holds the longest
suffix that occurs in some item. A window is 10 consecutive item words; a shorter item is one window.
Words inside an occurrence of a window are hit; runs of hit words are the spans to remove. Where a span is taken out, the
blanks beside it become one (none at the edge of a line); nothing else of the text changes.

Most texts hold no run of words that could fill a window, so each batch is first put to a filter that
misses nothing: runs of known words whose neighbours are neighbours in some item.

Size: the items are collected in groups of at most GROUP_BYTES (their size is counted first), one automaton
for each, its transitions in flat sorted arrays; the usual benchmark is one group. A further group is a further pass over the texts.

Defined results: null, blank or wordless texts have no words and no hits; null or wordless items have no windows;
an item without an id hits but is not listed. Empty tables give no hits. Repeated items count once
by their id; repeated rows are judged alike. find_contamination() replaces columns of the input that are named as those it adds;
decontaminate() returns the input's columns, whatever their names.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._rows import col, packed, unpacked
from ._store import durable
from ._words import ALNUM, LOWER, slices

WINDOW = 10
GROUP_BYTES = 2_000_000
ADDED = ("n_words", "n_hit", "longest", "items", "spans", "clean_text")
_SPLIT = bytes(LOWER[i] if ALNUM[i] else 32 for i in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_SPLIT).split()


class SuffixAutomaton:
    """All word sequences within the items; states by number, 0 is the start."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.ids, self.words = window, [], {}
        self.next: list[dict[int, int]] = [{}]  # while it is built
        self.link, self.len = array("i", [-1]), array("i", [0])
        coded = []
        for item, words in items:
            if words:
                coded.append([self.words.setdefault(w, len(self.words)) for w in words])
                self.ids.append(item)
                last = 0
                for c in coded[-1]:
                    last = self._extend(last, c)
        self.whole: dict[int, set[int]] = {}  # state of a full window -> items with it
        self.short: dict[int, list[tuple[int, int]]] = {}  # state of a short item -> its length and number
        for k, codes in enumerate(coded):
            v = n = 0
            for c in codes:
                v, n = self.next[v][c], n + 1
                if n >= window:
                    self.whole.setdefault(self.cut(v, window), set()).add(k)
            if n < window:
                self.short.setdefault(self.cut(v, n), []).append((n, k))
        self.least = min((min(window, len(c)) for c in coded), default=0)
        pairs = {(a, b) for c in coded for a, b in zip(c, c[1:])}
        self.pairs = np.array(sorted(a * len(self.words) + b for a, b in pairs), np.int64)
        n = len(self.words)
        flat = sorted((v * n + c, to) for v, out in enumerate(self.next) for c, to in out.items())
        self.keys, self.to = array("q", (k for k, _ in flat)), array("i", (t for _, t in flat))
        del self.next
        self._tables()

    def step(self, v: int, c: int) -> int:
        """The state after word c, or -1."""
        k = v * len(self.words) + c
        i = bisect_left(self.keys, k)
        return self.to[i] if i < len(self.keys) and self.keys[i] == k else -1

    def _extend(self, p: int, c: int) -> int:
        if c in self.next[p]:
            q = self.next[p][c]
            return q if self.len[p] + 1 == self.len[q] else self._clone(p, q, c)
        cur = self._new(self.len[p] + 1, {})
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[p] + 1 == self.len[q] else self._clone(p, q, c)
        return cur

    def _new(self, length: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        r = self._new(self.len[p] + 1, dict(self.next[q]))
        self.link[r], self.link[q] = self.link[q], r
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def cut(self, v: int, n: int) -> int:
        """The state of the last n words of what v holds."""
        while self.len[self.link[v]] >= n:
            v = self.link[v]
        return v

    def _tables(self) -> None:
        """Sorted word values and their codes, for the filter."""
        from ._words import Words

        vocab = list(self.words)
        if not vocab:
            self.values, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        data = b" ".join(vocab)
        w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0, ALNUM)
        order = np.argsort(w.hash, kind="stable")
        self.values, self.codes = w.hash[order], order.astype(np.int64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.values >> np.uint64(48)).astype(np.int64)] = True

    def suspects(self, w) -> np.ndarray:
        """Numbers of the texts of a slice that may hold a window; no text that holds one is left out."""
        if not len(self.values) or not len(w.hash):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.sieve[(w.hash >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.values, w.hash[at]), len(self.values) - 1)
        same = self.values[k] == w.hash[at]
        at, code = at[same], self.codes[k[same]]
        if self.least <= 1:
            return np.unique(np.searchsorted(w.at, at, "right") - 1)
        ok = (at[1:] == at[:-1] + 1) if len(at) else np.zeros(0, bool)
        pair = code[:-1] * len(self.words) + code[1:]
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1) if len(self.pairs) else None
        ok = ok & (self.pairs[k] == pair) if k is not None else ok & False
        text = np.searchsorted(w.at, at, "right") - 1
        ok &= text[1:] == text[:-1] if len(at) else ok
        stops = np.concatenate([[-1], np.flatnonzero(~ok), [len(ok)]])
        runs = np.diff(stops) - 1
        return np.unique(text[stops[:-1][runs >= self.least - 1] + 1])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Runs of hit words (first, one past the last), numbers of the items, longest match."""
        code, step, link, length, window = self.words.get, self.step, self.link, self.len, self.window
        v = n = longest = 0
        runs: list[list[int]] = []
        items: set[int] = set()
        seen: set[int] = set()
        for i, w in enumerate(words):
            c = code(w)
            if c is None:
                v = n = 0
                continue
            to = step(v, c)
            while v and to < 0:
                v = link[v]
                n = length[v]
                to = step(v, c)
            if to >= 0:
                v, n = to, n + 1
            if n > longest:
                longest = n
            hit = 0
            if n >= window:
                hit = window
                u = self.cut(v, window)
                if u not in seen:
                    seen.add(u)
                    items |= self.whole[u]
            if self.short:
                u = v
                while u > 0:
                    for k, item in self.short.get(u, ()):
                        if k <= n:
                            items.add(item)
                            hit = max(hit, k)
                    u = link[u]
            if hit:
                if runs and i + 1 - hit <= runs[-1][1]:
                    runs[-1][0] = min(runs[-1][0], i + 1 - hit)
                    runs[-1][1] = i + 1
                    while len(runs) > 1 and runs[-1][0] <= runs[-2][1]:
                        a, b = runs.pop()
                        runs[-1] = [min(runs[-1][0], a), max(runs[-1][1], b)]
                else:
                    runs.append([i + 1 - hit, i + 1])
        return [tuple(r) for r in runs], items, longest


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[dict[str, int]]) -> bytes:
    """raw without its spans; only the blanks beside them change."""
    out = raw[:spans[0]["start"]]
    for s, stop in zip(spans, [*(x["start"] for x in spans[1:]), len(raw)]):
        part = raw[s["end"]:stop]
        left, right = out.rstrip(b" \t"), part.lstrip(b" \t")
        gap = (len(left) < len(out) or len(right) < len(part)) and left and right and left[-1] not in b"\n\r" and right[0] not in b"\n\r"
        out = left + (b" " if gap else b"") + right
    return out


def _pass(batches: Iterator[pa.RecordBatch], automaton, last: bool, clean: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """row, text and, after a first pass, longest, items and runs (in words) -> the same, or in the last pass the results."""
    a: SuffixAutomaton = automaton.value
    for batch in batches:
        texts, size = batch.column(1), batch.num_rows
        n_words, n_hit, longest = (np.zeros(size, np.int64) for _ in range(3))
        items: list = [[]] * size
        runs: list = [[]] * size
        if batch.num_columns > 2:
            longest = batch.column(2).to_numpy().copy()
            items, runs = batch.column(3).to_pylist(), [[(r["start"], r["end"]) for r in x] for x in batch.column(4).to_pylist()]
        spans: list = [[]] * size
        cleaned: dict[int, str] = {}
        for w in slices(texts, ALNUM):
            n_words[w.first:w.first + w.n] = np.diff(w.at)
            for i in a.suspects(w):
                k = w.first + i
                got, found, most = a.scan(words_of(w.text(i)))
                longest[k] = max(longest[k], most)
                if got:
                    runs[k] = merged([*runs[k], *got])
                    items[k] = sorted({*items[k], *(a.ids[x] for x in found if a.ids[x] is not None)})
            if last:
                for i in range(w.n):
                    k = w.first + i
                    if runs[k]:
                        first, base = w.at[i], w.rel[i]
                        n_hit[k] = sum(y - x for x, y in runs[k])
                        spans[k] = [{"start": int(w.start[first + x] - base), "end": int(w.end[first + y - 1] - base)} for x, y in runs[k]]
                        if clean:
                            cleaned[k] = without(w.text(i), spans[k]).decode("utf-8", "replace")
        if last:
            cols = [batch.column(0), n_words, n_hit, longest, items, spans]
        else:
            cols = [batch.column(0), texts, longest, items, [[{"start": x, "end": y} for x, y in r] for r in runs]]
        if clean:
            old = texts.to_pylist() if cleaned else None
            cols.append([cleaned.get(k, old[k]) for k in range(size)] if cleaned else texts)
        yield pa.RecordBatch.from_arrays([(c if c.type == f.type else c.cast(f.type)) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def item_groups(items: DataFrame, key: str, text: str, most: int = GROUP_BYTES) -> list[DataFrame]:
    """items in groups of about most bytes at the most."""
    items = items.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total * 3 // (2 * most))) if total > most else 1
    if groups == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g) for g in range(groups)]


def _found(src: DataFrame, items: DataFrame, item_key: str, item_text: str, window: int, clean: bool, group_bytes: int) -> DataFrame:
    """src (row, text) -> row, the columns of ADDED."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = src.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    field = {"row": src.schema["row"].dataType, "text": T.StringType(), "items": T.ArrayType(T.StringType()), "runs": span, "spans": span, "clean_text": T.StringType()}
    groups = item_groups(items, item_key, item_text, group_bytes)
    for k, group in enumerate(groups):
        found = SuffixAutomaton([(r["id"], words_of(r["text"])) for r in group.collect()], window)  # at most about group_bytes
        shared = spark.sparkContext.broadcast(found)
        last = k == len(groups) - 1
        names = ["row", "n_words", "n_hit", "longest", "items", "spans"] + ["clean_text"] * clean if last else ["row", "text", "longest", "items", "runs"]
        schema = T.StructType([T.StructField(n, field.get(n, T.LongType())) for n in names])
        arrow = to_arrow_schema(schema)
        src = src.mapInArrow(lambda it, b=shared, end=last, a=arrow: _pass(it, b, end, clean and end, a), schema)
        if not last:
            src = durable(src, "runs")
    return src


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, clean: bool = False, keep: list[str] | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs (or its columns `keep`) with n_words, n_hit, longest (in words), items (ids) and spans (byte offsets within the text).

    clean: also clean_text, the text without its spans. With several item groups n_hit counts the words of the merged spans.
    """
    keep = docs.columns if keep is None else list(keep)
    src = packed(docs, keep, text=col(text))
    added = [c for c in ADDED if clean or c != "clean_text"]
    return unpacked(_found(src, items, item_key, item_text, window, clean, group_bytes), keep, *added)


def decontaminate(docs: DataFrame, items: DataFrame, *, max_coverage: float = 0.5, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs without the spans; documents of which more than max_coverage of the words are hit go. n_chars, where there is a number of that name, follows the text."""
    others = [c for c in docs.columns if c != text]
    src = packed(docs, others, text=col(text))
    got = _found(src, items, item_key, item_text, window, True, group_bytes).where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    kinds = {f.name: f.dataType for f in docs.schema}
    out = []
    for c in docs.columns:
        old = F.col("clean_text") if c == text else F.col("row").getField(c)
        if c == "n_chars" and c != text and isinstance(kinds[c], T.NumericType):
            old = F.when(F.col("n_hit") > 0, F.length("clean_text").cast(kinds[c])).otherwise(old)
        out.append(old.alias(c))
    return got.select(*out)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = find_contamination(docs, items, keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_NORMAL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_NORMAL} AS w FROM documents),
i AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT *, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, k, j, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT rid, k, j, item_id FROM dw JOIN iw USING (k, g)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(j, j + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
