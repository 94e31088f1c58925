"""Host-level quality rules, in DataFrame functions only.

Each document is measured and put to four rules. The failures are summed by host, the hosts' rates are
shrunk towards an empirical beta prior (fitted by the method of moments over all hosts), and a host
whose shrunk rate passes the limit is rejected with all its documents.

Texts are measured once: the measured rows are stored, the hosts' failures are summed from there, and the verdicts join them.

Defined results: a null or blank text has no words, so it fails the length rule. A null host is a host
of its own, never rejected (nothing says that its documents belong together). An empty table gives an
empty table. Repeated rows are judged one by one; texts of any length are measured whole. quality_rules() replaces columns of the input that are named as those
it adds; passing() returns the input's columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ._rows import col, packed, unpacked
from ._store import durable

SPACE = r"[\x20\x09-\x0D]+"
#: Host tables up to so many rows (under 100 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_HOSTS = 50_000


@dataclass(frozen=True)
class RuleLimits:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.1
    max_dup_line_share: float = 0.3
    max_host_rate: float = 0.5


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measures(src: DataFrame) -> DataFrame:
    """src (row, host, text) as row, host and the MEASURES (all long)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = src.withColumns({
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "_w": words,
        "_l": lines,
    })
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": _windows(F.col("_w")),
    }).drop("_w", "_l", "text")
    return _covered(out)


def _windows(words: Column) -> Column:
    """A 64-bit hash of each 3-word window, in text order."""
    at = F.when(F.size(words) >= 3, F.sequence(F.lit(1), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))


def _covered(df: DataFrame) -> DataFrame:
    """n_repeat_words: the words within windows of _h that occur twice or more.

    The hashes are sorted; neighbours that are equal name the repeated windows. Few of them are looked
    up one by one; with many, (hash, place) pairs are sorted instead, so that the work stays n log n.
    """
    s = F.sort_array("_h")
    df = df.withColumn("_s", s)
    twice = F.filter(F.zip_with(F.col("_s"), F.slice(F.col("_s"), 2, F.greatest(F.size("_s"), F.lit(1))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    df = df.withColumn("_d", F.array_distinct(twice)).drop("_s")
    few = F.filter(F.transform("_h", lambda h, i: F.when(F.array_contains("_d", h), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<int>")
    df = df.withColumn("_p", F.when(F.size("_d") > 48, pairs))
    n = F.size("_p")
    many = F.sort_array(F.filter(F.transform("_p", lambda x, k: F.when(
        ((k > 0) & (F.get("_p", F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | ((k < n - 1) & (F.get("_p", F.least(k + 1, n - 1))["h"] == x["h"])), x["i"])), lambda i: i.isNotNull()))
    df = df.withColumn("_i", F.when(F.size("_d") == 0, none).when(F.size("_d") <= 48, few).otherwise(many)).drop("_h", "_d", "_p")
    gaps = F.zip_with(F.col("_i"), F.slice(F.col("_i"), 2, F.greatest(F.size("_i"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    df = df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda x, y: x + y).cast("long")).drop("_i")
    # one row in, one row out: a generator keeps the optimizer from copying these expressions into later filters
    return df.select(*[c for c in df.columns if c not in MEASURES], F.inline(F.array(F.struct(*MEASURES))))


def judged(src: DataFrame, limits: RuleLimits = RuleLimits()) -> DataFrame:
    """measures() and base_failed, and failed: at least one of the four rules is broken."""
    m = measures(src)
    base = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    return m.withColumn("base_failed", base).withColumn("failed", base | (F.col("n_symbols") > limits.max_symbols_per_word * F.col("n_words")) | (F.col("n_dup_lines") > limits.max_dup_line_share * F.col("n_lines")))


def host_verdicts(rules: DataFrame, limits: RuleLimits = RuleLimits()) -> DataFrame:
    """One row for each host: host, docs, failures, host_rate (shrunk) and host_kept.

    With rates p_i = f_i / n_i, mean m and variance v over the hosts, the prior has strength
    s = m (1 - m) / v - 1, held within [1, 1000]; the shrunk rate is (f_i + m s) / (n_i + s).
    """
    by = rules.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("docs")
    prior = by.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    m, v = F.col("m"), F.col("v")
    strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(F.lit(1000.0))
    got = by.join(F.broadcast(prior), F.lit(True))  # one row
    shrunk = (F.col("failures") + m * strength) / (F.col("docs") + strength)
    return got.select("host", "docs", "failures", shrunk.alias("host_rate"), (F.col("host").isNull() | (F.round(shrunk, 9) <= limits.max_host_rate)).alias("host_kept"))


def with_verdicts(rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """rules with host_rate, host_kept and kept; the host table is broadcast only up to BROADCAST_HOSTS rows."""
    small = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    right = hosts.select(F.col("host").alias("h"), "host_rate", "host_kept")
    out = rules.join(F.broadcast(right) if small else right, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def _verdicts(rules: DataFrame, limits: RuleLimits) -> DataFrame:
    rules = durable(rules, "rules")
    return with_verdicts(rules, durable(host_verdicts(rules, limits), "hosts"))


def quality_rules(docs: DataFrame, limits: RuleLimits = RuleLimits(), host: str = "source", text: str = "text") -> DataFrame:
    """docs, all columns, with the measures, failed, base_failed, host_rate, host_kept and kept."""
    got = _verdicts(judged(packed(docs, host=col(host), text=col(text)), limits), limits)
    return unpacked(got, docs.columns, *MEASURES, "base_failed", "failed", "host_rate", "host_kept", "kept")


def passing(docs: DataFrame, limits: RuleLimits = RuleLimits(), host: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns; of those that fail by themselves only the verdict is stored."""
    rules = judged(packed(docs, host=col(host), text=col(text)), limits)
    rules = rules.select(F.when(~F.col("base_failed"), F.col("row")).alias("row"), "host", "base_failed", "failed")
    return unpacked(_verdicts(rules, limits).where("kept"), docs.columns)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = _verdicts(judged(packed(docs, ["doc_id"], host=col("source"), text=col("text"))), RuleLimits())
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, [e FOR e IN regexp_split_to_array(x, '[\x20\x09-\x0D]+') IF e <> ''] AS w,
  [e FOR e IN string_split(x, chr(10)) IF regexp_matches(e, '[^\x20\x09-\x0D]')] AS l FROM t),
tri AS (SELECT rid, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * n_lines AS failed FROM m),
h AS (SELECT source, count(*) AS docs, sum(failed::INT) AS f FROM j GROUP BY source),
p AS (SELECT avg(f / docs) AS a, var_pop(f / docs) AS v FROM h),
s AS (SELECT source, (f + a * k) / (docs + k) AS host_rate FROM (SELECT *, CASE WHEN v > 0 THEN least(greatest(a * (1 - a) / v - 1, 1.0), 1000.0) ELSE 1000.0 END AS k FROM h, p))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (j.source IS NULL OR round(host_rate, 9) <= 0.5) AS kept, round(host_rate, 9) AS host_rate
FROM j JOIN s ON j.source IS NOT DISTINCT FROM s.source
"""
