"""The engine's queries over the driver's tables, each with SQL that says the same where SQL can.

Corpora: sources are the benchmark items (b<id>), targets the documents (d<id>), intermediates the conversations (c<id>, turns in order).
Scores that are ranked are rounded first, so that sums in another order rank alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import enrich as E, evaluate as V, links as L, models as M, paths as P, postings as T
from ..operators.settle import settled
from ..operators.shares import shared_windows
from ..sources import writers

DIGITS = 9


def corpus(spark: SparkSession, sf: str, role: str, stemmed: bool = False, tokens: bool = False) -> DataFrame:
    """artifact_id, raw_text, ir_text (and tokens) of a role: s, t or m."""
    if role == "s":
        docs = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.concat(F.lit("b"), F.col("item_id")).alias("artifact_id"), F.col("text").alias("raw_text"))
    elif role == "t":
        docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id")).alias("artifact_id"), F.col("text").alias("raw_text"))
    else:
        c = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
        docs = c.select(F.concat(F.lit("c"), F.col("conv_id")).alias("artifact_id"), F.array_join(F.transform("x", lambda y: y["text"]), "\n").alias("raw_text"))
    docs = spread(docs).withColumn("tokens", X.process_tokens(F.col("raw_text"), stemmed=stemmed))
    docs = docs.withColumn("ir_text", F.array_join("tokens", " "))
    return docs if tokens else docs.drop("tokens")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its input has fewer splits than that (small tables of one row group); else as it is, without a shuffle."""
    sc = df.sparkSession.sparkContext
    few = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 16_000_000 * sc.defaultParallelism
    return df.repartition(sc.defaultParallelism) if few else df


def rounded(links: DataFrame) -> DataFrame:
    return links.withColumn("score", F.round("score", DIGITS))


def _post(spark, sf, role="t", total=False):
    return T.postings(corpus(spark, sf, role), total=total)


def once(docs: DataFrame) -> DataFrame:
    """artifact_id, ir_text and tokens of a corpus whose texts are normalised once, however often they are read."""
    return settled(docs.select("artifact_id", "ir_text")).withColumn("tokens", X.ir_tokens(F.col("ir_text")))


def _both(spark, sf) -> tuple[DataFrame, DataFrame]:
    return once(corpus(spark, sf, "s")), once(corpus(spark, sf, "t"))


def _evaluated(spark, sf, model, dense, **more):
    """Links and gold from one normalisation of the texts."""
    s, t = _both(spark, sf)
    return model(s, t, dense, digits=DIGITS, **more), known(_gold(s, t))


#: Rows of a table up to which it goes to every task.
SMALL = 500_000


def known(pairs: DataFrame) -> DataFrame:
    """pairs computed once; where they are few, joins send them to every task."""
    pairs = settled(pairs)
    return F.broadcast(pairs) if pairs.count() <= SMALL else pairs


def vsm_links(spark, sf, a="s", b="t", dense=True, best=None):
    """best: only so many links of each source."""
    return M.vsm(once(corpus(spark, sf, a)), once(corpus(spark, sf, b)), dense, best, DIGITS)


def jsd_links(spark, sf, a="s", b="t", dense=True):
    return M.jsd(once(corpus(spark, sf, a)), once(corpus(spark, sf, b)), dense, DIGITS)


def gold(spark, sf) -> DataFrame:
    """Items and documents that share a window of eight tokens."""
    return _gold(corpus(spark, sf, "s", tokens=True), corpus(spark, sf, "t", tokens=True))


def _gold(s: DataFrame, t: DataFrame) -> DataFrame:
    def windows(d, name):
        at = F.when(F.size("tokens") >= 8, F.sequence(F.lit(1), F.size("tokens") - 7)).otherwise(F.array().cast("array<int>"))
        return d.select(F.col("artifact_id").alias(name), F.explode(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("tokens", i, 8), " ")))).alias("w"))

    if (s.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= SMALL:
        return shared_windows(s, t, 8)
    return windows(t, "target_id").join(windows(s, "source_id"), "w").select("source_id", "target_id").distinct()


def _votes(spark, sf, role="s"):
    freq = E.pair_frequencies(E.adjacent_pairs(corpus(spark, sf, "m", tokens=True)))
    v = E.votes(vsm_links(spark, sf, role, "m", False, E.EnrichParams().top_k), freq)
    return v.withColumn("vote", F.round("vote", DIGITS))


def _plain_text(docs):
    return docs.withColumn("ir_text", X.process_text(F.col("raw_text"), stemmed=False))


def _enriched(spark, sf):
    """Sources and targets enriched from the intermediates."""
    s, t = settled(corpus(spark, sf, "s")), settled(corpus(spark, sf, "t"))
    m = settled(corpus(spark, sf, "m", tokens=True))
    freq = settled(E.pair_frequencies(E.adjacent_pairs(m)))
    best = [sparse_vsm(d, m, E.EnrichParams().top_k) for d in (s, t)]
    return E.enrich_three(s, t, freq, *best, sparse_vsm, _plain_text)


def sparse_vsm(a, b, best=None, only=None):
    return M.vsm(a, b, False, best, DIGITS, only)


def _hops(spark, sf):
    """sm, mt, ss, mm as far as paths go: the best links of each source, and only of intermediates that a source reaches."""
    s, m, t = (once(corpus(spark, sf, r)) for r in ("s", "m", "t"))
    return P.hops(sparse_vsm, s, m, t)


def _inner_source(sm, mt, ss, mm):
    return P.inner_source_paths(ss, sm, mt)


def _inner_mid(sm, mt, ss, mm):
    return P.inner_intermediate_paths(sm, mm, mt)


def _split_urls(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", X.split_camel(F.col("url")).alias("split"))


def _part_pairs(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("artifact_id"), F.split(F.lower("p_name"), " ").alias("tokens"))
    return E.identifier_pairs(p)


def _f1s(spark, sf, *models):
    """The F measures of models, from one normalisation of the texts."""
    s, t = _both(spark, sf)
    g = known(_gold(s, t))
    return [V.f_at_11(m(s, t, False, digits=DIGITS), g) for m in models]


def _cliffs(spark, sf):
    return V.cliffs_delta(*[f.select(F.round("f1", DIGITS).alias("x")) for f in _f1s(spark, sf, M.vsm, M.jsd)]).select(F.round("delta", 6).alias("delta"))


def _wilcoxon(spark, sf):
    both = [[r["f1"] for r in f.orderBy("recall_level").collect()] for f in _f1s(spark, sf, M.jsd, M.vsm)]
    return spark.createDataFrame([(V.wilcoxon(*both),)], "p double")


def _upserted(spark, sf):
    return L.upsert_of(_two_models(spark, sf, False), 0.1)


def _two_models(spark, sf, dense):
    """Cosines and divergences side by side, from one normalisation of the texts."""
    return M.vsm_and_jsd(*_both(spark, sf), dense, DIGITS)


def _matrix(spark, sf):
    return writers.link_matrix(vsm_links(spark, sf, "s", "s"))


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


QUERIES = {
    "clean_tokens": lambda s, d: corpus(s, d, "t").select("artifact_id", "ir_text"),
    "camel_split": _split_urls,
    "term_counts": lambda s, d: _post(s, d),
    "document_frequency": lambda s, d: T.document_frequency(_post(s, d)),
    "idf": lambda s, d: _r6(T.idf(_post(s, d), corpus(s, d, "t").agg(F.count("*").alias("n_docs"))), "idf"),
    "tfidf": lambda s, d: _r6(T.tfidf(_post(s, d, total=True), corpus(s, d, "t").agg(F.count("*").alias("n_docs"))), "weight").select("doc_id", "term", "weight"),
    "vsm_links": lambda s, d: vsm_links(s, d),
    "vsm_topk": lambda s, d: vsm_links(s, d, dense=False, best=5),
    "vsm_above": lambda s, d: L.above(vsm_links(s, d, dense=False), 0.1),
    "vsm_below": lambda s, d: L.below(vsm_links(s, d), 0.01),
    "jsd_links": lambda s, d: jsd_links(s, d),
    "vsm_jsd_mean": lambda s, d: L.average_of(_two_models(s, d, True)),
    "lsi_links": lambda s, d: rounded(M.lsi(corpus(s, d, "s"), corpus(s, d, "t"), False)),
    "union_links": lambda s, d: rounded(M.union(corpus(s, d, "s"), corpus(s, d, "t"))),
    "relative_topk": lambda s, d: L.relative_top_k(vsm_links(s, d, dense=False, best=3)),
    "fuse_avg": lambda s, d: L.fuse_of(_two_models(s, d, True)),
    "fuse_max": lambda s, d: L.fuse_of(_two_models(s, d, True), strategy="max"),
    "fuse_guarded": lambda s, d: L.fuse_of(_two_models(s, d, True), strategy="guarded_avg"),
    "max_links": lambda s, d: L.maximum_of(_two_models(s, d, False)),
    "upsert_links": _upserted,
    "identifier_pairs": lambda s, d: E.merge_pairs(_part_pairs(s, d)).select("artifact_id", "canonical", F.col("weight").cast("long").alias("weight")),
    "biterm_freq": lambda s, d: E.pair_frequencies(E.adjacent_pairs(corpus(s, d, "m", tokens=True))).select("artifact_id", "biterm", F.col("freq").cast("long").alias("freq")),
    "neighbour_votes": lambda s, d: _votes(s, d),
    "extended_text": lambda s, d: E.extended_text(corpus(s, d, "s"), _votes(s, d)).select("artifact_id", "raw_text"),
    "enriched_links": lambda s, d: _enriched(s, d),
    "paths_outer": lambda s, d: P.outer_paths(*_hops(s, d)[:2]),
    "paths_inner_src": lambda s, d: _inner_source(*_hops(s, d)),
    "paths_inner_mid": lambda s, d: _inner_mid(*_hops(s, d)),
    "transitive_links": lambda s, d: P.transitive(vsm_links(s, d, dense=False), *_hops(s, d)),
    "gold_links": gold,
    "prf": lambda s, d: _r6(V.prf(*_evaluated(s, d, M.vsm, True)), "precision", "recall", "f1"),
    "prf_sweep": lambda s, d: _r6(V.threshold_sweep(*_evaluated(s, d, M.vsm, False)), "threshold", "precision", "recall", "f1"),
    "prf_topk": lambda s, d: _r6(V.top_k_sweep(*_evaluated(s, d, M.vsm, True)), "precision", "recall", "f1"),
    "map": lambda s, d: _r6(V.mean_average_precision(*_evaluated(s, d, M.vsm, True)), "map"),
    "pr_curve20": lambda s, d: _r6(V.pr_curve(*_evaluated(s, d, M.vsm, False)), "precision"),
    "f11": lambda s, d: _r6(V.f_at_11(*_evaluated(s, d, M.vsm, False)), "precision", "f1"),
    "wilcoxon": _wilcoxon,
    "cliffs_delta": _cliffs,
    "link_matrix": _matrix,
    "stemmed_tokens": lambda s, d: corpus(s, d, "t", stemmed=True).select("artifact_id", "ir_text"),
}

# ---- the same in SQL ----

_WORDS = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _re(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{new}', 'g')"


_CLEAN = _re(f"trim({_re('coalesce(text, chr(32))', '[^a-zA-Z]+', ' ')})", r"\bUAVs\b", "UAV")
_CLEAN = _re(_CLEAN, "([A-Z])s( |$)", r"\1\2")
for _ in range(2):
    _CLEAN = _re(_CLEAN, "([A-Z])s([A-Z])", r"\1 s \2")
_CLEAN = _re(_re(_CLEAN, "([A-Z])([A-Z][a-z])", r"\1 \2"), "([^A-Z ])([A-Z])", r"\1 \2")
BASE = f"""WITH corpus AS (SELECT 's' AS role, 'b' || item_id AS id, text FROM benchmark UNION ALL SELECT 't', 'd' || doc_id, text FROM documents
  UNION ALL SELECT 'm', 'c' || conv_id, string_agg(text, chr(10) ORDER BY turn) FROM conversations GROUP BY conv_id),
tok AS (SELECT role, id, text, [w FOR w IN string_split(lower({_CLEAN}), ' ') IF len(w) >= 2 AND w NOT IN ({_WORDS})] AS w FROM corpus),
flat AS (SELECT role, id, unnest(w) AS term FROM tok),
post AS (SELECT role, id, term, count(*) AS n FROM flat GROUP BY ALL)"""


def _vsm(name: str, a: str, b: str, dense: bool = False, post_a: str = "post", post_b: str = "post") -> str:
    pair = f"""{name}_p AS (SELECT 's' AS side, id, term, n FROM {post_a} WHERE role = '{a}' UNION ALL SELECT 't', id, term, n FROM {post_b} WHERE role = '{b}'),
{name}_n AS (SELECT count(*) AS n FROM (SELECT id FROM tok WHERE role = '{a}' UNION ALL SELECT id FROM tok WHERE role = '{b}')),
{name}_w AS (SELECT side, id, term, n / sum(n) OVER (PARTITION BY side, id) * ln((SELECT n FROM {name}_n) / count(*) OVER (PARTITION BY term)) AS w FROM {name}_p),
{name}_l AS (SELECT side, id, sqrt(sum(w * w)) AS l FROM {name}_w GROUP BY ALL),
{name}_d AS (SELECT x.id AS source_id, y.id AS target_id, sum(x.w * y.w) AS dot FROM {name}_w x JOIN {name}_w y ON x.term = y.term AND x.side = 's' AND y.side = 't' AND x.w <> 0 AND y.w <> 0 GROUP BY ALL),
{name}_s AS (SELECT source_id, target_id, round(dot / (p.l * q.l), {DIGITS}) AS score FROM {name}_d JOIN {name}_l p ON p.side = 's' AND p.id = source_id JOIN {name}_l q ON q.side = 't' AND q.id = target_id)"""
    if not dense:
        return f"{pair},\n{name} AS (SELECT * FROM {name}_s)"
    return f"""{pair},
{name} AS (SELECT a.id AS source_id, b.id AS target_id, coalesce(score, 0.0) AS score FROM (SELECT id FROM tok WHERE role = '{a}') a CROSS JOIN (SELECT id FROM tok WHERE role = '{b}') b LEFT JOIN {name}_s ON source_id = a.id AND target_id = b.id)"""


def _jsd(name: str, a: str, b: str, dense: bool = False) -> str:
    h = lambda x: f"(-({x}) * log2({x}))"
    common = f"""{name}_f AS (SELECT role, id, term, n / sum(n) OVER (PARTITION BY role, id) AS p FROM post),
{name}_c AS (SELECT x.id AS source_id, y.id AS target_id, sum(x.p + y.p) AS m, sum({h('(x.p + y.p) / 2')} - {h('x.p')} / 2 - {h('y.p')} / 2) AS d FROM {name}_f x JOIN {name}_f y USING (term) WHERE x.role = '{a}' AND y.role = '{b}' GROUP BY ALL)"""
    if not dense:
        return f"{common},\n{name} AS (SELECT source_id, target_id, round(greatest(0.0, m / 2 - d), {DIGITS}) AS score FROM {name}_c WHERE greatest(0.0, m / 2 - d) > 0)"
    return f"""{common},
{name} AS (SELECT a.id AS source_id, b.id AS target_id, round(greatest(0.0, 1 - (a.s + b.s) / 2 + coalesce(m, 0) / 2 - coalesce(d, 0)), {DIGITS}) AS score
  FROM (SELECT id, (len(w) > 0)::INT::DOUBLE AS s FROM tok WHERE role = '{a}') a CROSS JOIN (SELECT id, (len(w) > 0)::INT::DOUBLE AS s FROM tok WHERE role = '{b}') b LEFT JOIN {name}_c ON source_id = a.id AND target_id = b.id)"""


def _top(name: str, src: str, k: int, relative: bool = False) -> str:
    if relative:
        src = f"(SELECT * FROM {src} QUALIFY max(score) OVER (PARTITION BY source_id) > 0 AND score >= 0.5 * max(score) OVER (PARTITION BY source_id))"
    return f"{name} AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) <= {k})"


_GOLD = """g8 AS (SELECT DISTINCT role, id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT role, id, w, unnest(range(1, len(w) - 6)) AS i FROM tok)),
gold AS (SELECT DISTINCT x.id AS source_id, y.id AS target_id FROM g8 x JOIN g8 y USING (g) WHERE x.role = 's' AND y.role = 't'),
rel AS (SELECT count(*) AS relevant FROM gold)"""
def _pairs(name: str, role: str) -> str:
    return f"""{name} AS (SELECT id AS artifact_id, t1 || ' ' || t2 AS biterm, count(*) AS freq FROM (SELECT id, unnest(w[1:len(w) - 1]) AS t1, unnest(w[2:]) AS t2 FROM tok WHERE role = '{role}' AND len(w) >= 2) GROUP BY ALL)"""


def _voting(links: str, pairs: str, p: str = "", share: float = 0.5, k: int = 3) -> str:
    """{p}votes and {p}sel of the sources of links."""
    return f"""{p}near AS (SELECT source_id, target_id, score / best AS share FROM (SELECT *, max(score) OVER (PARTITION BY source_id) AS best FROM {links}) WHERE best > 0 AND score >= {share} * best QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) <= {k}),
{p}votes AS (SELECT source_id AS artifact_id, biterm, round(sum(share * ln(1 + freq)), {DIGITS}) AS vote FROM {p}near JOIN {pairs} ON artifact_id = target_id GROUP BY ALL),
{p}sel AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY vote DESC, biterm) AS rk, least(CAST(round(vote) AS INT), 4) AS reps FROM {p}votes WHERE vote >= 2.0 - 1e-9 QUALIFY rk <= 24)"""


def _plus(name: str, role: str, sel: str) -> str:
    """Postings of a role with the selected pairs appended."""
    return f"{name} AS (SELECT role, id, term, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM post WHERE role = '{role}' UNION ALL SELECT '{role}', artifact_id, unnest(string_split(biterm, ' ')), reps FROM {sel}) GROUP BY ALL)"


def _mean(a: str, b: str) -> str:
    return f"SELECT * FROM (SELECT source_id, target_id, (coalesce({a}.score, 0) + coalesce({b}.score, 0)) / 2.0 AS score FROM {a} FULL JOIN {b} USING (source_id, target_id)) WHERE score > 0"


_PAIRS = _pairs("bi", "m")
_VOTES = f"{_PAIRS},\n{_voting('sm', 'bi')}"
_THREE = f"""{_VOTES},\n{_vsm('tm', 't', 'm')},\n{_voting('tm', 'bi', 't_')},\n{_plus('splus', 's', 'sel')},\n{_plus('tplus', 't', 't_sel')},
{_vsm('e1', 's', 't', post_a='splus')},\n{_vsm('e2', 's', 't', post_b='tplus')},\nenr AS ({_mean('e1', 'e2')})"""
_RATES = "CASE WHEN amount > 0 THEN tp / amount ELSE 1.0 END AS p, CASE WHEN relevant > 0 THEN tp / relevant ELSE 0.0 END AS r"
_OUT = "amount, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1"
_ORDER = "ORDER BY score DESC, source_id, target_id"


def _curve(links: str, name: str = "c") -> str:
    return f"""{name}_h AS (SELECT row_number() OVER ({_ORDER}) AS rank, (g.source_id IS NOT NULL)::INT AS hit, sum((g.source_id IS NOT NULL)::INT) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS cum FROM {links} LEFT JOIN gold g USING (source_id, target_id)),
{name} AS (SELECT cum / relevant AS r, cum / rank AS p FROM {name}_h, rel WHERE hit = 1)"""


def _f11(curve: str) -> str:
    return f"(SELECT lv AS recall_level, p AS precision, CASE WHEN p + lv > 0 THEN 2 * p * lv / (p + lv) ELSE 0 END AS f1 FROM (SELECT lv, coalesce((SELECT max(p) FROM {curve} WHERE r >= lv), 0.0) AS p FROM (SELECT unnest(range(0, 11)) / 10 AS lv)))"


_VD, _VS = _vsm("v", "s", "t", True), _vsm("v", "s", "t")
_JD, _JS = _jsd("j", "s", "t", True), _jsd("j", "s", "t")
_HOPS = ",\n".join(_vsm(n, *n) for n in ("sm", "mt", "ss", "mm"))
_CUT = ",\n".join(_top(f"{n}3", n, 3, True) for n in ("sm", "mt", "ss", "mm"))
_PATHS = {
    "outer": "SELECT a.source_id, b.target_id, a.score * b.score AS score FROM sm3 a JOIN mt3 b ON a.target_id = b.source_id",
    "src": "SELECT w.source_id, b.target_id, w.score * a.score * b.score AS score FROM ss3 w JOIN sm3 a ON w.target_id = a.source_id JOIN mt3 b ON a.target_id = b.source_id",
    "mid": "SELECT a.source_id, b.target_id, a.score * w.score * b.score AS score FROM sm3 a JOIN mm3 w ON a.target_id = w.source_id JOIN mt3 b ON w.target_id = b.source_id",
}
_R = "SELECT source_id, target_id, score FROM "


def _fused(expr: str) -> str:
    return f"{BASE},\n{_VD},\n{_JD}\nSELECT source_id, target_id, {expr} AS score FROM (SELECT v.source_id, v.target_id, v.score AS a, j.score AS b FROM v JOIN j USING (source_id, target_id))"


ORACLES = {
    "clean_tokens": f"{BASE} SELECT id AS artifact_id, array_to_string(w, ' ') AS ir_text FROM tok WHERE role = 't'",
    "camel_split": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '([A-Z])s([A-Z]|\s|$)', '\1 s \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([^A-Z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([^A-Za-z])', '\1 \2', 'g'), ' +', ' ', 'g'), '^ ', '')) AS split FROM pages",
    "term_counts": f"{BASE} SELECT id AS doc_id, term, n FROM post WHERE role = 't'",
    "document_frequency": f"{BASE} SELECT term, count(*) AS df FROM post WHERE role = 't' GROUP BY term",
    "idf": f"{BASE} SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM post WHERE role = 't' GROUP BY term",
    "tfidf": f"{BASE} SELECT id AS doc_id, term, round(n / sum(n) OVER (PARTITION BY id) * ln((SELECT count(*) FROM documents) / count(*) OVER (PARTITION BY term)), 6) AS weight FROM post WHERE role = 't'",
    "vsm_links": f"{BASE},\n{_VD}\n{_R} v",
    "vsm_topk": f"{BASE},\n{_VS},\n{_top('k', 'v', 5)}\n{_R} k",
    "vsm_above": f"{BASE},\n{_VS}\n{_R} v WHERE score > 0.1",
    "vsm_below": f"{BASE},\n{_VD}\n{_R} v WHERE score < 0.01",
    "jsd_links": f"{BASE},\n{_JD}\n{_R} j",
    "vsm_jsd_mean": f"SELECT * FROM ({_fused('(a + b) / 2.0')}) WHERE score > 0",
    "relative_topk": f"{BASE},\n{_VS},\n{_top('k', 'v', 3, True)}\n{_R} k",
    "fuse_avg": _fused("0.5 * (a + b)"),
    "fuse_max": _fused("greatest(a, b)"),
    "fuse_guarded": _fused("greatest(a, 0.5 * (a + b))"),
    "max_links": f"{BASE},\n{_VS},\n{_JS}\nSELECT source_id, target_id, greatest(v.score, coalesce(j.score, 0)) AS score FROM v LEFT JOIN j USING (source_id, target_id) WHERE greatest(v.score, coalesce(j.score, 0)) > 0",
    "upsert_links": f"{BASE},\n{_VS},\n{_JS}\nSELECT source_id, target_id, coalesce(n.score, v.score) AS score FROM v FULL JOIN (SELECT * FROM j WHERE score > 0.1) n USING (source_id, target_id)",
    "identifier_pairs": "WITH w AS (SELECT 'p' || p_partkey AS artifact_id, string_split(lower(p_name), ' ') AS w FROM part), i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w), p AS (SELECT artifact_id, w[i] AS a, unnest(w[i + 1:]) AS b FROM i) SELECT artifact_id, a || upper(b[1]) || b[2:] AS canonical, count(*) AS weight FROM p GROUP BY ALL",
    "biterm_freq": f"{BASE},\n{_PAIRS}\nSELECT * FROM bi",
    "neighbour_votes": f"{BASE},\n{_vsm('sm', 's', 'm')},\n{_VOTES}\nSELECT artifact_id, biterm, vote FROM votes",
    "extended_text": f"{BASE},\n{_vsm('sm', 's', 'm')},\n{_VOTES}\nSELECT id AS artifact_id, CASE WHEN more IS NULL THEN text ELSE coalesce(text, '') || chr(10) || more END AS raw_text FROM tok LEFT JOIN (SELECT artifact_id, string_agg(repeat(biterm || ' ', reps), '' ORDER BY rk) AS more FROM sel GROUP BY ALL) ON id = artifact_id WHERE role = 's'",
    "enriched_links": f"{BASE},\n{_vsm('sm', 's', 'm')},\n{_THREE}\n{_R} enr",
    **{f"paths_{q}": f"{BASE},\n{_HOPS},\n{_CUT}\n{_R} ({_PATHS[k]})" for k, q in (("outer", "outer"), ("src", "inner_src"), ("mid", "inner_mid"))},
    "transitive_links": f"{BASE},\n{_HOPS},\n{_CUT},\n{_VS},\nb AS (SELECT source_id, target_id, max(score) AS path FROM ({' UNION ALL '.join(_PATHS.values())}) GROUP BY ALL HAVING max(score) > 0)\nSELECT source_id, target_id, greatest(coalesce(score, 0), coalesce(path, 0)) AS score FROM v FULL JOIN b USING (source_id, target_id)",
    "link_matrix": f"{BASE},\n{_vsm('ss', 's', 's', True)}\nSELECT * FROM (PIVOT (SELECT source_id AS \"Source Artifact\", target_id, printf('%.4f', round(score, 4)) AS score FROM ss) ON target_id USING first(score) GROUP BY \"Source Artifact\")",
    "gold_links": f"{BASE},\n{_GOLD}\nSELECT * FROM gold",
    "prf": f"{BASE},\n{_VD},\n{_GOLD}\nSELECT {_OUT} FROM (SELECT *, {_RATES} FROM (SELECT count(*) AS amount, count(g.source_id) AS tp FROM v LEFT JOIN gold g USING (source_id, target_id)), rel)",
    "prf_sweep": f"""{BASE},\n{_VS},\n{_GOLD},
t AS (SELECT unnest({V.THRESHOLDS}::DOUBLE[]) AS threshold), n AS (SELECT threshold, count(*) AS amount, count(g.source_id) AS tp FROM v LEFT JOIN gold g USING (source_id, target_id) JOIN t ON score > threshold GROUP BY ALL)
SELECT round(threshold, 6) AS threshold, {_OUT} FROM (SELECT *, {_RATES} FROM (SELECT threshold, coalesce(amount, 0) AS amount, coalesce(tp, 0) AS tp FROM t LEFT JOIN n USING (threshold)), rel)""",
    "prf_topk": f"""{BASE},\n{_VD},\n{_GOLD},
x AS (SELECT (g.source_id IS NOT NULL)::INT AS hit, row_number() OVER (PARTITION BY v.source_id ORDER BY score DESC, v.target_id) AS r FROM v LEFT JOIN gold g USING (source_id, target_id))
SELECT k, {_OUT} FROM (SELECT *, {_RATES} FROM (SELECT k, count(*) AS amount, CAST(sum(hit) AS BIGINT) AS tp FROM x JOIN (SELECT CAST(unnest(range(1, 6)) AS INT) AS k) ON r <= k GROUP BY ALL), rel)""",
    "map": f"""{BASE},\n{_VD},\n{_GOLD},
x AS (SELECT v.source_id, (g.source_id IS NOT NULL)::INT AS hit, row_number() OVER w AS rank, sum((g.source_id IS NOT NULL)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM v LEFT JOIN gold g USING (source_id, target_id) WINDOW w AS (PARTITION BY v.source_id ORDER BY score DESC, v.target_id)),
a AS (SELECT source_id, sum(hit * cum / rank) AS s FROM x GROUP BY ALL)
SELECT round(avg(coalesce(s / n, 0)), 6) AS map FROM a LEFT JOIN (SELECT source_id, count(*) AS n FROM gold GROUP BY ALL) USING (source_id)""",
    "pr_curve20": f"{BASE},\n{_VS},\n{_GOLD},\n{_curve('v')}\nSELECT lv AS recall_level, round(coalesce((SELECT max(p) FROM c WHERE r >= lv), 0.0), 6) AS precision FROM (SELECT unnest(range(1, 21)) / 20 AS lv)",
    "f11": f"{BASE},\n{_VS},\n{_GOLD},\n{_curve('v')}\nSELECT recall_level, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM {_f11('c')}",
    "cliffs_delta": f"{BASE},\n{_VS},\n{_JS},\n{_GOLD},\n{_curve('v', 'c')},\n{_curve('j', 'k')}\nSELECT round(avg(sign(round(x.f1, {DIGITS}) - round(y.f1, {DIGITS}))), 6) AS delta FROM {_f11('c')} x, {_f11('k')} y",
}
