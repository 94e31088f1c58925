"""Histogram-sort sharding, in DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id, row), so that copies lie side by side. The driver
refines a byte histogram of that key space: each round counts exact bytes and rows of the cells that
still matter, 12 bits of the key at a time. A cell matters while a target (k/24 of all bytes) lies
within it and its bytes exceed the tolerance, or while it has too many rows for one sort task. Then
one exchange deals the cells out and numbers the rows.

Law `bytes`: shards are key ranges of nearly equal bytes. Size: UTF-8 bytes of the text (null: none)
plus 8. A third of all rows in one group of copies is no matter: the id, then the row, splits it.

Defined results: a null text has size 8 and crc32 0; null ids hash like any value; rows that are equal in
id and text are told apart by a row number, so each has a slot of its own. An empty table gives an empty one. A very long text is one row of
one shard. shard_documents() reads the id and the text only; write_shards() writes all columns, but for own ones named shard and slot.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, functions as F, Window as W

from ._rows import col, packed, unpacked
from ._store import durable

#: Hex digits (4 bits each) that a round refines, and the digits of the whole key.
STEP, DIGITS = 3, 48
#: Share of a shard's bytes that a splitter may be off its target.
TOLERANCE = 0.002
#: A cell of more than this many times the mean rows of a first-round cell is cut further.
LEAF = 8


def _sizes(docs: DataFrame, text: str, key: str, whole: bool = False) -> DataFrame:
    t = col(text)
    return packed(
        docs, None if whole else [], doc_id=col(key),
        size=(F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long"),
        text_crc32=F.crc32(F.coalesce(t, F.lit("")).cast("binary")),
        _h1=F.xxhash64(t), _h2=F.xxhash64(col(key)), _row=F.monotonically_increasing_id(),
    )


def _key():
    """48 hex digits that sort as the three unsigned hashes do."""
    return F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("_h1", "_h2", F.xxhash64("_row"))))


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[tuple[str, int, int]], int]:
    """The leaf cells in key order, each (prefix, shard, slot of its first row), and the number of rounds.

    rows has _k and size. Cells on the driver: at most 4096 in the first round and 4096 for each cell
    that is cut; cut are only cells with a splitter (below `shards`) or with over LEAF / 4096 of all rows
    (below 4096 / LEAF), so the list is bounded whatever the input is.
    """
    cells: list[tuple[str, int, int]] = [("", 0, 0)]
    total = rows_all = None
    heavy, depth, rounds = {""}, 0, 0
    while heavy and depth < DIGITS:
        cut = rows if depth == 0 else rows.where(F.substring("_k", 1, depth).isin(sorted(heavy))) if len(heavy) <= 64 else rows.join(F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in heavy], "_c string")), F.substring("_k", 1, depth) == F.col("_c"), "left_semi")
        got = cut.groupBy(F.substring("_k", 1, depth + STEP).alias("c")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        rounds += 1
        kids = defaultdict(list)
        for r in got:
            kids[r["c"][:depth]].append((r["c"], r["b"], r["n"]))
        cells = [y for x in cells for y in (sorted(kids[x[0]]) if x[0] in heavy else [x])]
        depth += STEP
        if total is None:
            total, rows_all = sum(c[1] for c in cells), sum(c[2] for c in cells)
        slack, most, below, heavy = tolerance * total / shards, max(64, LEAF * rows_all / 4096), 0, set()
        for c, b, n in cells:
            inside = int((below + b) * shards / total) > int(below * shards / total) if total else False
            near = min(_off(below, total, shards), _off(below + b, total, shards)) <= slack
            if len(c) == depth and n > 1 and (n > most or inside and not near):
                heavy.add(c)
            below += b
    out, below, shard, slot = [], 0, 0, 0
    for c, b, n in cells:
        # the cell's start is a boundary if that is nearer to the target than its end
        while shard < shards - 1 and below >= (t := (shard + 1) * total / shards) - 1e-9 or shard < shards - 1 and below + b > t and t - below < below + b - t:
            shard, slot = shard + 1, 0
        out.append((c, shard, slot))
        slot, below = slot + n, below + b
    return out, rounds


def _off(x: float, total: int, shards: int) -> float:
    y = x * shards / total
    return abs(y - round(y)) * total / shards


def _placed(docs: DataFrame, shards: int, text: str, key: str, whole: bool) -> DataFrame:
    """row (all columns, or none), doc_id, size, text_crc32, shard and slot."""
    spark = docs.sparkSession
    narrow = durable(_sizes(docs, text, key, whole), "sizes").withColumn("_k", _key())
    cells, _ = splitters(narrow.drop("row"), shards)
    out = narrow
    depths = sorted({len(c) for c, *_ in cells if c})
    for d in depths:  # at most as many as rounds; each table is bounded as splitters() says
        leaf = spark.createDataFrame([x for x in cells if len(x[0]) == d], "_c string, _shard int, _slot long").withColumnsRenamed({k: f"{k}{d}" for k in ("_c", "_shard", "_slot")})
        out = out.join(F.broadcast(leaf), F.substring("_k", 1, d) == F.col(f"_c{d}"), "left")
    pick = (lambda k: F.coalesce(*(F.col(f"{k}{d}") for d in depths))) if depths else (lambda k: F.lit(None))
    out = out.select("row", "doc_id", "size", "text_crc32", "_k", pick("_c").cast("string").alias("_c"), pick("_shard").cast("int").alias("shard"), pick("_slot").cast("long").alias("_s"))
    slot = F.row_number().over(W.partitionBy("_c").orderBy("_k")) - 1 + F.col("_s")
    return out.withColumn("slot", slot.cast("long"))


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of each row of docs."""
    return _placed(docs, shards, text, key, False).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24, text: str = "text", key: str = "doc_id") -> None:
    """Write docs to path, one folder for each shard, with shard and slot. Rows travel with their place, so ids may repeat or be null."""
    unpacked(_placed(docs, shards, text, key, True), docs.columns, "shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).withColumn("grown_shard", F.lit(None).cast("int"))
