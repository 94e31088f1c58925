"""Queries of single operators, of sources and sinks (written to the shared folder and read again), and of the whole pipelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import phrases as G, text as X
from ..operators import enrich as E, evaluate as V, links as L, models as M
from ..operators.settle import scratch, settled
from ..sources import readers as R, writers as K
from .pipeline import run_full, run_ir_only
from .queries import _CUT, _GOLD, _HOPS, _JS, _PAIRS, _PATHS, _R, _RATES, _THREE, _VD, _VOTES, _VS, BASE, DIGITS, _both, _curve, _evaluated, _f11, _gold, _mean, _pairs, _plain_text, _plus, _r6, _top, _votes, _voting, _vsm, corpus, gold, jsd_links, known, rounded, sparse_vsm, vsm_links

LEMMAS = {"ring": "circle", "gear": "cog", "widget": "thing"}


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet")


def _id():
    return F.concat(F.lit("p"), F.col("p_partkey")).alias("artifact_id")


def _identifiers(spark, sf):
    """Names such as small_ring_Brand17IDs."""
    return _part(spark, sf).select(_id(), F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.translate("p_brand", "#", ""), F.lit("IDs")).alias("w"))


def _stripped(spark, sf):
    return _part(spark, sf).select(_id(), X.strip_tags(F.concat(F.lit("[Summary] "), "p_type", F.lit("-[DESCRIPTION]-"), "p_name", F.lit(" [other]"))).alias("stripped"))


def _javadoc(spark, sf):
    c = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("/**\n * "), "p_name", F.lit(".\n\n *   @see "), "p_brand", F.lit("\n *\n */")))
    return _part(spark, sf).select(_id(), X.clean_javadoc(c).alias("doc"))


def _scores(spark, sf):
    k = vsm_links(spark, sf, dense=False, best=5)
    return k.select(X.link_key(F.col("source_id"), F.col("target_id")).alias("link"), X.score_text(F.col("score")).alias("score4"), X.score_text(F.col("score"), 2).alias("score2"))


def _lookup(spark, sf):
    links, g = _evaluated(spark, sf, M.vsm, False)
    pairs = g.unionByName(spark.createDataFrame([("b0", "nowhere"), ("none", "d0")], "source_id string, target_id string"))
    return L.lookup(L.among(links, pairs), pairs)


def _ends(spark, sf):
    links = L.above(vsm_links(spark, sf, dense=False), 0.05)
    return L.sources(links).select(F.lit("source").alias("side"), F.col("source_id").alias("id")).unionByName(L.targets(links).select(F.lit("target").alias("side"), F.col("target_id").alias("id")))


def _compare(spark, sf):
    s, t = _both(spark, sf)
    got = V.compare(M.vsm(s, t, False, digits=DIGITS), M.jsd(s, t, False, DIGITS), known(_gold(s, t)))
    return spark.createDataFrame([(round(got["p"], 9), round(got["delta"], 6))], "p double, delta double")


def _over(spark, sf, threshold):
    links, g = _evaluated(spark, sf, M.vsm, False)
    return L.above(links, threshold), g


def _members(spark, sf):
    links, g = _evaluated(spark, sf, M.vsm, False, best=3)
    return V.is_link(g, links)


def _targets(spark, sf):
    t = V.relevant_targets(gold(spark, sf))
    return t.select("source_id", F.size("targets").cast("long").alias("n"), F.array_join("targets", ",").alias("targets"))


def _bundle(spark, sf):
    parts = V.evaluate(*_evaluated(spark, sf, M.vsm, False))
    zero = {"prf": F.lit(0.0), "map": F.lit(0.0), "pr_curve": F.col("recall_level"), "thresholds": F.col("threshold"), "top_k": F.col("k").cast("double")}
    out = None
    for name, df in parts.items():
        have = lambda c: F.round(F.col(c).cast("double"), 6) if c in df.columns else F.lit(None).cast("double")  # noqa: B023, E731
        df = df.select(F.lit(name).alias("part"), F.round(zero[name], 6).alias("level"), *[have(c).alias(c) for c in ("amount", "tp", "precision", "recall", "f1", "map")])
        out = df if out is None else out.unionByName(df)
    return out


def _full(spark, sf, **more):
    s, m, t = (corpus(spark, sf, r) for r in ("s", "m", "t"))
    pairs = {"intermediate": E.adjacent_pairs(corpus(spark, sf, "m", tokens=True))}
    return run_full(s, m, t, sparse_vsm, make_text=_plain_text, pairs=pairs, all_pairs=sparse_vsm, **more)


def _two(spark, sf):
    s, t = (settled(corpus(spark, sf, r)) for r in ("s", "t"))
    near = E.EnrichParams().top_k
    st, ts = settled(sparse_vsm(s, t, near)), settled(sparse_vsm(t, s, near))
    freq = [settled(E.pair_frequencies(E.adjacent_pairs(E.linked(d, links).withColumn("tokens", X.ir_tokens(F.col("ir_text")))))) for d, links in ((s, ts), (t, st))]
    return E.enrich_two(s, t, *freq, st, ts, sparse_vsm, _plain_text)


def _params_votes(spark, sf):
    params = E.EnrichParams.of({"share": "0.3", "top_k": "5", "max_pairs": "many", "min_agree": None})
    freq = E.pair_frequencies(E.adjacent_pairs(corpus(spark, sf, "m", tokens=True)))
    v = E.votes(vsm_links(spark, sf, "s", "m", False, params.top_k), freq, params)
    return E.selected_pairs(v, params).select("artifact_id", "biterm", "vote", F.col("rank").cast("long").alias("rank"), F.col("reps").cast("long").alias("reps"))


def _stats(spark, sf):
    v = _votes(spark, sf)
    means = E.enrichment_stats(v).select(F.lit("").alias("artifact_id"), F.round("mean_pairs", 6).alias("pairs"), F.round("mean_terms", 6).alias("terms"))
    return means.unionByName(E.enrichment_listing(v).select("artifact_id", F.col("pairs").cast("double").alias("pairs"), F.col("terms").cast("double").alias("terms")))


def _part_pairs(spark, sf):
    p = _part(spark, sf).select(_id(), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("tokens"))
    return E.merge_pairs(E.identifier_pairs(p))


def _allowed(spark, sf):
    pairs = _part_pairs(spark, sf)
    return E.allowed_pairs(pairs, pairs.where("artifact_id in ('p0', 'p1', 'p2', 'p3')")).select("artifact_id", "term1", "term2", "canonical", F.col("weight").cast("long").alias("weight"))


def _appended(spark, sf):
    docs = _part(spark, sf).select(_id(), F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).alias("raw_text"))
    return E.append_pairs(docs, _part_pairs(spark, sf).withColumn("weight", F.col("weight") + 1))


def _consensual(spark, sf):
    p = _part(spark, sf).select(_id(), F.col("p_brand").alias("source"), F.col("p_type").alias("destination"))
    found = _part_pairs(spark, sf).join(p, "artifact_id")
    return E.consensual_counts(found).select("canonical", "source", "destination", "term1", "term2", F.col("n").cast("long").alias("n"))


RELS = ("compound", "amod", "obj", "xcomp", "nmod:of", "nmod:for", "obl:to", "nsubj", "acl:relcl", "det")
SPECIAL = ("code", "context", "use", "set", "ssl")


def _edges(spark, sf):
    """Edges between neighbouring tokens of the conversations; relations, tags and some words follow from their lengths."""
    def special(w):
        k = F.length(w) % 13
        out = w
        for i, x in enumerate(SPECIAL):
            out = F.when(k == i, F.lit(x)).otherwise(out)
        return out

    d = corpus(spark, sf, "m", tokens=True).select("artifact_id", F.posexplode(F.zip_with(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "p"))
    a, b = F.col("p.a"), F.col("p.b")
    tag = lambda w: F.when(F.length(w) % 5 == 0, "DT").when(F.length(w) % 5 == 1, "VB").when(F.length(w) % 5 == 2, "JJ").otherwise("NN")
    rel = F.element_at(F.array(*map(F.lit, RELS)), ((F.length(a) + 2 * F.length(b) + F.col("i")) % len(RELS) + 1).cast("int"))
    return d.select("artifact_id", F.floor(F.col("i") / 10).cast("int").alias("sentence"), special(b).alias("gov"), tag(b).alias("gov_pos"), special(a).alias("dep"), tag(a).alias("dep_pos"), rel.alias("rel"))


def _heads(spark, sf):
    return G.head_modifiers(_edges(spark, sf).withColumns({"g": F.col("gov"), "d": F.col("dep")}))


def _phrases(spark, sf):
    return G.phrase_pairs(_edges(spark, sf), stemmed=False, stopwords=()).select("artifact_id", "term1", "term2", "canonical", F.col("weight").cast("long").alias("weight"))


# ---- files ----
def _gold_file(spark, sf):
    k = F.col("p_partkey") % 6
    line = F.when(k == 0, F.concat(F.lit("  S"), "p_size", F.lit(" \t T"), "p_partkey")).when(k == 1, F.concat(F.lit("S"), "p_size", F.lit(" , T"), "p_partkey", F.lit(",more"))).when(k == 2, F.lit("# A B")).when(k == 3, F.lit(" "))
    line = line.when(k == 4, F.concat(F.lit("S"), "p_size")).otherwise(F.concat(F.lit("S"), "p_size", F.lit(" T")))
    path = scratch(spark, "gold")
    _part(spark, sf).select(line.alias("value")).coalesce(1).write.text(path)
    return R.read_gold(spark, spark.read.text(path).inputFiles()[0])


def _pair_texts(spark, sf) -> DataFrame:
    """A pair file for each brand: lines `name:weight`, some of them malformed."""
    k = F.col("p_partkey") % 5
    first, second = (F.element_at(F.split("p_name", " "), i) for i in (1, 2))
    name = F.when(k == 0, X.canonical(first, second)).when(k == 1, F.lower("p_type")).when(k == 2, F.substring("p_name", 1, 2)).otherwise(F.concat(first, F.lit("_"), second))
    line = F.when(k == 3, name).when(F.col("p_partkey") % 11 == 0, F.concat(name, F.lit(": 2"))).otherwise(F.concat(F.lit(" "), name, F.lit(":"), (F.col("p_partkey") % 3).cast("string")))
    p = _part(spark, sf).select("p_brand", "p_partkey", line.alias("line"))
    return p.groupBy(F.col("p_brand").alias("artifact_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\r\n").alias("raw_text"))


def _pair_file(spark, sf):
    return R.parse_pairs(_pair_texts(spark, sf)).select("artifact_id", F.col("place").cast("long").alias("place"), "name", "term1", "term2", "canonical", F.col("weight").cast("long").alias("weight"))


def _preprocessed(spark, sf):
    originals = _part(spark, sf).where("p_size > 25").groupBy(F.col("p_brand").alias("artifact_id")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), " and the ").alias("raw_text"))
    docs, pairs = R.combine_preprocessed(originals, _pair_texts(spark, sf).where("artifact_id <> 'Brand#1'"), stemmed=False)
    n = pairs.groupBy("artifact_id").agg(F.count("*").alias("n_pairs"))
    return docs.join(n, "artifact_id", "left").select("artifact_id", "raw_text", "ir_text", "base_text", "n_pairs")


def _stopword_file(spark, sf):
    path = scratch(spark, "stopwords")
    _part(spark, sf).select(F.concat(F.lit(" "), F.element_at(F.split("p_name", " "), 1), F.lit("  ")).alias("value")).union(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(path)
    return spark.createDataFrame([(w,) for w in R.read_stopwords(spark, path)], "word string")


def _matrix_file(spark, sf):
    """The matrix of all sources and targets as it was written, cell by cell."""
    path = scratch(spark, "matrix")
    K.write_link_matrix(vsm_links(spark, sf, dense=False), path)
    lines = spark.read.text(path).select(F.split("value", ",").alias("x"))
    head = lines.where("x[0] = 'Source Artifact'").select(F.col("x").alias("h"))
    cells = lines.where("x[0] <> 'Source Artifact'").join(F.broadcast(head), F.lit(True)).select(F.col("x")[0].alias("source_id"), F.posexplode("x").alias("i", "score"), "h")  # one row of names
    return cells.where("i > 0").select("source_id", F.get("h", "i").alias("target_id"), "score")


def _csv(spark, path):
    return spark.read.csv(path, header=True)


def _link_file(spark, sf):
    path = scratch(spark, "links")
    K.write_links(vsm_links(spark, sf, dense=False, best=3), path)
    return _csv(spark, path)


def _biterm_file(spark, sf):
    path = scratch(spark, "biterms")
    K.write_pairs(_part_pairs(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("canonical"))


def _curve_file(spark, sf):
    path = scratch(spark, "curve")
    K.write_pr_curve(V.pr_curve(*_evaluated(spark, sf, M.vsm, False)), path, "VSM")
    return _csv(spark, path)


def _summary_file(spark, sf):
    path, (links, g) = scratch(spark, "summary"), _evaluated(spark, sf, M.vsm, True)
    K.write_summary(V.prf(links, g), V.mean_average_precision(links, g), path, "one", "VSM")
    K.write_summary(V.prf(links.limit(0), g), V.mean_average_precision(links, g), path, "two", "VSM")
    return _csv(spark, path)


def _threshold_file(spark, sf):
    path = scratch(spark, "thresholds")
    K.write_sweep(V.threshold_sweep(*_evaluated(spark, sf, M.vsm, False)), path, "one", "VSM")
    return _csv(spark, path)


def _top_file(spark, sf):
    path = scratch(spark, "top")
    K.write_sweep(V.top_k_sweep(*_evaluated(spark, sf, M.vsm, False)), path, "one", "VSM")
    return _csv(spark, path)


def _model_weights(spark, sf):
    w = M.weights(corpus(spark, sf, "s"), corpus(spark, sf, "t"))
    return w.select("role", "doc_id", "term", "n", F.round("weight", DIGITS).alias("weight"))


QUERIES = {
    "word_tokens": lambda s, d: _identifiers(s, d).select("artifact_id", X.process_word(F.col("w"), stemmed=False).alias("words")),
    "identifier_tokens": lambda s, d: _identifiers(s, d).select("artifact_id", X.process_identifier(F.col("w"), stemmed=False).alias("words")),
    "stripped_text": _stripped,
    "javadoc_text": _javadoc,
    "lemmas": lambda s, d: _part(s, d).select(_id(), X.lemmatise(F.col("p_name"), LEMMAS).alias("lemmas")),
    "score_text": _scores,
    "link_lookup": _lookup,
    "added_links": lambda s, d: L.add(vsm_links(s, d, dense=False, best=2), L.above(jsd_links(s, d, dense=False), 0.1)),
    "link_ends": _ends,
    "link_row": lambda s, d: L.row(vsm_links(s, d, dense=False), "b7"),
    "precision": lambda s, d: _r6(V.precision(*_over(s, d, 0.1)), "precision"),
    "recall": lambda s, d: _r6(V.recall(*_over(s, d, 0.1)), "recall"),
    "compare_models": _compare,
    "gold_targets": _targets,
    "gold_members": _members,
    "prf_below": lambda s, d: _r6(V.below_evaluation(*_evaluated(s, d, M.vsm, True), 0.05), "precision", "recall", "f1"),
    "evaluation_bundle": _bundle,
    "ir_only": lambda s, d: run_ir_only(*_both(s, d), lambda a, b: M.vsm(a, b, digits=DIGITS)),
    "full_pipeline": lambda s, d: _full(s, d),
    "full_pipeline_max_no_paths": lambda s, d: _full(s, d, strategy="max", transitivity=False),
    "enriched_two_way": _two,
    "enrich_params": _params_votes,
    "enrichment_stats": _stats,
    "allowed_pairs": _allowed,
    "appended_pairs": _appended,
    "consensual_counts": _consensual,
    "head_modifiers": _heads,
    "phrase_pairs": _phrases,
    "relations": lambda s, d: G.relations(_edges(s, d)),
    "gold_file": _gold_file,
    "pair_file": _pair_file,
    "pair_text": lambda s, d: R.text_of_pairs(R.parse_pairs(_pair_texts(s, d))),
    "pair_plain_text": lambda s, d: R.plain_text_of_pairs(R.parse_pairs(_pair_texts(s, d))),
    "preprocessed": _preprocessed,
    "stopword_file": _stopword_file,
    "matrix_file": _matrix_file,
    "link_file": _link_file,
    "biterm_file": _biterm_file,
    "curve_file": _curve_file,
    "summary_file": _summary_file,
    "threshold_file": _threshold_file,
    "top_k_file": _top_file,
    "model_weights": _model_weights,
}

# ---- the same in SQL ----
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_W = "replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '') || 'ID'"
_words = lambda pattern: f"SELECT 'p' || p_partkey AS artifact_id, array_to_string([lower(x) FOR x IN regexp_extract_all({_W}, '{pattern}') IF len(x) >= 2 AND lower(x) NOT IN ({_STOP})], ' ') AS words FROM part"
_four = lambda x: f"printf('%.4f', round({x}, 4))"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
_ABOVE = "SELECT count(*) AS amount, count(g.source_id) AS tp FROM {links} LEFT JOIN gold g USING (source_id, target_id)"
_IDP = """w AS (SELECT 'p' || p_partkey AS artifact_id, p_brand, p_type, p_name, p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part),
ip AS (SELECT artifact_id, w[i] AS a, unnest(w[i + 1:]) AS b FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
mp AS (SELECT artifact_id, a || upper(b[1]) || b[2:] AS canonical, min({'t': a, 'u': b}) AS t, count(*) AS weight FROM ip GROUP BY ALL),
pairs AS (SELECT artifact_id, t.t AS term1, t.u AS term2, canonical, weight FROM mp)"""
_tag = lambda w: f"CASE len({w}) % 5 WHEN 0 THEN 'DT' WHEN 1 THEN 'VB' WHEN 2 THEN 'JJ' ELSE 'NN' END"
_spec = lambda w: f"CASE len({w}) % 13 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SPECIAL)) + f" ELSE {w} END"
_EDGES = f"""nb AS (SELECT id AS artifact_id, w[i + 1] AS a, w[i + 2] AS b, i FROM (SELECT id, w, unnest(range(0, len(w) - 1)) AS i FROM tok WHERE role = 'm')),
edges AS (SELECT artifact_id, i // 10 AS sentence, {_spec('b')} AS g, {_tag('b')} AS gp, {_spec('a')} AS d, {_tag('a')} AS dp, [{', '.join(repr(x) for x in RELS)}][(len(a) + 2 * len(b) + i) % {len(RELS)} + 1] AS rel FROM nb),
m1 AS (SELECT DISTINCT artifact_id, sentence, g AS head, d AS modifier FROM edges WHERE rel IN ('compound', 'amod') AND g <> d),
heads AS (SELECT * FROM m1 UNION SELECT x.artifact_id, x.sentence, x.head, y.modifier FROM m1 x JOIN m1 y ON x.artifact_id = y.artifact_id AND x.sentence = y.sentence AND x.modifier = y.head AND y.modifier <> x.head)"""
_PHRASES = """ok AS (SELECT *, (g = 'code' OR d = 'code') AND rel NOT IN ('compound', 'amod') AS bridge FROM edges WHERE gp <> 'DT' AND dp <> 'DT' AND g <> d
  AND NOT (g = 'context' AND d NOT IN ('ssl', 'use')) AND NOT (d = 'context' AND g <> 'context' AND g NOT IN ('ssl', 'use'))),
found AS (SELECT artifact_id, g AS x, d AS y FROM ok WHERE NOT bridge AND (rel IN ('compound', 'amod', 'obj', 'dobj', 'xcomp', 'nmod:of') OR rel LIKE 'acl%' OR (g = 'use' AND (rel LIKE 'nmod:for%' OR rel LIKE 'obl:for%')) OR (g = 'set' AND (rel LIKE 'nmod:to%' OR rel LIKE 'obl:to%' OR rel = 'nsubj')))
  UNION ALL SELECT o.artifact_id, CASE WHEN g = 'code' THEN d ELSE g END, h.modifier FROM ok o JOIN heads h ON o.artifact_id = h.artifact_id AND o.sentence = h.sentence AND h.head = 'code' WHERE bridge),
two AS (SELECT artifact_id, x AS t, y AS u FROM found UNION ALL SELECT artifact_id, y, x FROM found)
SELECT artifact_id, min({'t': t, 'u': u}).t AS term1, min({'t': t, 'u': u}).u AS term2, t || upper(u[1]) || u[2:] AS canonical, count(*) AS weight FROM two GROUP BY artifact_id, t || upper(u[1]) || u[2:]"""
_FILES = r"""pf AS (SELECT *, string_split(p_name, ' ') AS s, CASE p_partkey % 5 WHEN 0 THEN string_split(p_name, ' ')[1] || upper(string_split(p_name, ' ')[2][1]) || string_split(p_name, ' ')[2][2:] WHEN 1 THEN lower(p_type) WHEN 2 THEN p_name[1:2] ELSE replace(p_name, ' ', '_') END AS name,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM part),
pl AS (SELECT p_brand AS artifact_id, place, name, p_partkey % 3 AS weight FROM pf WHERE p_partkey % 5 <> 3 AND p_partkey % 11 <> 0),
pt AS (SELECT *, coalesce(len(regexp_extract(name, '^[^A-Z]*')), 0) AS cut FROM pl),
pp AS (SELECT artifact_id, place, name, weight, CASE WHEN cut > 0 AND cut < len(name) THEN name[1:cut] WHEN len(name) >= 3 THEN name[1:len(name) // 2] ELSE name END AS term1,
  CASE WHEN cut > 0 AND cut < len(name) THEN name[cut + 1:] WHEN len(name) >= 3 THEN name[len(name) // 2 + 1:] ELSE name END AS term2 FROM pt)"""
_TEXTS = "ptx AS (SELECT artifact_id, coalesce(string_agg(trim(repeat({x} || ' ', CAST(weight AS BIGINT))), ' ' ORDER BY place) FILTER (WHERE weight > 0), '') AS ir_text FROM pp GROUP BY ALL)"
_PRF = f"SELECT *, {_RATES} FROM ({_ABOVE}), rel"
_X = "x AS (SELECT v.source_id, (g.source_id IS NOT NULL)::INT AS hit, row_number() OVER w AS rank, sum((g.source_id IS NOT NULL)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM v LEFT JOIN gold g USING (source_id, target_id) WINDOW w AS (PARTITION BY v.source_id ORDER BY score DESC, v.target_id))"
_MAP = f"{_X},\nap AS (SELECT source_id, sum(hit * cum / rank) AS s FROM x GROUP BY ALL),\nmapped AS (SELECT avg(coalesce(s / n, 0)) AS map FROM ap LEFT JOIN (SELECT source_id, count(*) AS n FROM gold GROUP BY ALL) USING (source_id))"
_SWEEP = f"t AS (SELECT unnest({V.THRESHOLDS}::DOUBLE[]) AS threshold), sw AS (SELECT threshold, coalesce(amount, 0) AS amount, coalesce(tp, 0) AS tp FROM t LEFT JOIN (SELECT threshold, count(*) AS amount, count(g.source_id) AS tp FROM v LEFT JOIN gold g USING (source_id, target_id) JOIN t ON score > threshold GROUP BY ALL) USING (threshold))"
_TOPS = "tk AS (SELECT k, count(*) AS amount, CAST(sum(hit) AS BIGINT) AS tp FROM x JOIN (SELECT unnest(range(1, 6)) AS k) ON rank <= k GROUP BY ALL)"
_LEVELS = "lv AS (SELECT lv AS recall_level, coalesce((SELECT max(p) FROM c WHERE r >= lv), 0.0) AS precision FROM (SELECT unnest(range(1, 21)) / 20 AS lv))"
_PAIRED = f"""fx AS (SELECT x.recall_level, x.f1 AS a, y.f1 AS b FROM {_f11('c')} x JOIN {_f11('k')} y USING (recall_level)),
dx AS (SELECT round(b - a, 12) AS d FROM fx),
rx AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM dx),
wx AS (SELECT greatest(sum(rk) FILTER (WHERE d > 0), 66 - coalesce(sum(rk) FILTER (WHERE d > 0), 0)) AS most FROM rx),
sub AS (SELECT s, (SELECT sum(i + 1) FROM range(11) t(i) WHERE (s >> i) & 1 = 1) AS total FROM range(2048) u(s)),
px AS (SELECT least(1.0, 2 * count(*) / 2048) AS p FROM sub, wx WHERE coalesce(total, 0) >= ceil(most))"""
_CURVES = f"{BASE},\n{_VS},\n{_JS},\n{_GOLD},\n{_curve('v', 'c')},\n{_curve('j', 'k')},\n{_PAIRED}"
_BEST = f"b AS (SELECT source_id, target_id, max(score) AS path FROM ({' UNION ALL '.join(_PATHS.values())}) GROUP BY ALL HAVING max(score) > 0)"
_HOPPED = f"{BASE},\n{_HOPS},\n{_CUT},\n{_VS}"
_row = lambda part, level, cols: f"SELECT '{part}' AS part, round(CAST({level} AS DOUBLE), 6) AS level, {cols}"
_RATED = f"CAST(amount AS DOUBLE) AS amount, CAST(tp AS DOUBLE) AS tp, round(p, 6) AS precision, round(r, 6) AS recall, round({_F1}, 6) AS f1, CAST(NULL AS DOUBLE) AS map"
_of = lambda name: f"(SELECT *, {_RATES} FROM {name}, rel)"

ORACLES = {
    "word_tokens": _words("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"),
    "identifier_tokens": _words("[A-Z]?[a-z]+|[A-Z]+"),
    "stripped_text": r"SELECT 'p' || p_partkey AS artifact_id, replace(regexp_replace('[Summary] ' || p_type || '-[DESCRIPTION]-' || p_name || ' [other]', '\[(SUMMARY|DESCRIPTION)\]', ' ', 'gi'), '-', ' ') AS stripped FROM part",
    "javadoc_text": "SELECT 'p' || p_partkey AS artifact_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || '. @see ' || p_brand END AS doc FROM part",
    "lemmas": "SELECT 'p' || p_partkey AS artifact_id, array_to_string([CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEMMAS.items()) + " ELSE w END FOR w IN string_split(p_name, ' ')], ' ') AS lemmas FROM part",
    "score_text": f"{BASE},\n{_VS},\n{_top('k', 'v', 5)}\nSELECT source_id || ' -> ' || target_id AS link, {_four('score')} AS score4, printf('%.2f', round(score, 2)) AS score2 FROM k",
    "link_lookup": f"{BASE},\n{_VS},\n{_GOLD}\nSELECT source_id, target_id, coalesce(score, 0.0) AS score FROM (SELECT * FROM gold UNION ALL VALUES ('b0', 'nowhere'), ('none', 'd0')) LEFT JOIN v USING (source_id, target_id)",
    "added_links": f"{BASE},\n{_VS},\n{_JS},\n{_top('k', 'v', 2)}\n{_R} k UNION ALL {_R} j WHERE score > 0.1",
    "link_ends": f"{BASE},\n{_VS}\nSELECT DISTINCT 'source' AS side, source_id AS id FROM v WHERE score > 0.05 UNION ALL SELECT DISTINCT 'target', target_id FROM v WHERE score > 0.05",
    "link_row": f"{BASE},\n{_VS}\n{_R} v WHERE source_id = 'b7'",
    "precision": f"{BASE},\n{_VS},\n{_GOLD}\nSELECT round(CASE WHEN amount > 0 THEN tp / amount ELSE 0.0 END, 6) AS precision FROM ({_ABOVE.format(links='(SELECT * FROM v WHERE score > 0.1)')})",
    "recall": f"{BASE},\n{_VS},\n{_GOLD}\nSELECT round(CASE WHEN relevant > 0 THEN tp / relevant ELSE 0.0 END, 6) AS recall FROM ({_ABOVE.format(links='(SELECT * FROM v WHERE score > 0.1)')}), rel",
    "wilcoxon": f"{_CURVES.replace('round(b - a, 12)', 'round(a - b, 12)')}\nSELECT p FROM px",  # the other way round; zeros count for neither
    "compare_models": f"{_CURVES}\nSELECT round(p, 9) AS p, (SELECT round(avg(sign(y.b - x.a)), 6) FROM fx x, fx y) AS delta FROM px",
    "gold_targets": f"{BASE},\n{_GOLD}\nSELECT source_id, count(*) AS n, string_agg(target_id, ',' ORDER BY target_id) AS targets FROM gold GROUP BY ALL",
    "gold_members": f"{BASE},\n{_VS},\n{_GOLD},\n{_top('k', 'v', 3)}\n{_R} k SEMI JOIN gold USING (source_id, target_id)",
    "prf_below": f"{BASE},\n{_VD},\n{_GOLD}\nSELECT amount, tp, round(p, 6) AS precision, round(r, 6) AS recall, round({_F1}, 6) AS f1 FROM ({_PRF.format(links='(SELECT * FROM v WHERE score < 0.05)')})",
    "evaluation_bundle": f"{BASE},\n{_VS},\n{_GOLD},\n{_MAP},\n{_SWEEP},\n{_TOPS},\n{_curve('v')},\n{_LEVELS},\nal AS ({_ABOVE.format(links='v')})\n" + " UNION ALL ".join([
        f"{_row('prf', '0', _RATED)} FROM {_of('al')}", f"{_row('map', '0', 'NULL, NULL, NULL, NULL, NULL, round(map, 6)')} FROM mapped", f"{_row('pr_curve', 'recall_level', 'NULL, NULL, round(precision, 6), NULL, NULL, NULL')} FROM lv",
        f"{_row('thresholds', 'threshold', _RATED)} FROM {_of('sw')}", f"{_row('top_k', 'k', _RATED)} FROM {_of('tk')}"]),
    "ir_only": f"{BASE},\n{_VD}\n{_R} v",
    "full_pipeline": f"{_HOPPED},\n{_THREE},\n{_BEST},\nfu AS (SELECT v.source_id, v.target_id, 0.5 * (v.score + coalesce(enr.score, 0)) AS score FROM v LEFT JOIN enr USING (source_id, target_id))\nSELECT source_id, target_id, greatest(coalesce(score, 0), coalesce(path, 0)) AS score FROM fu FULL JOIN b USING (source_id, target_id)",
    "full_pipeline_max_no_paths": f"{BASE},\n{_vsm('sm', 's', 'm')},\n{_VS},\n{_THREE}\nSELECT v.source_id, v.target_id, greatest(v.score, coalesce(enr.score, 0)) AS score FROM v LEFT JOIN enr USING (source_id, target_id)",
    "enriched_two_way": f"{BASE},\n{_vsm('st', 's', 't')},\n{_vsm('ts', 't', 's')},\n{_pairs('bs', 's')},\n{_pairs('bt', 't')},\n{_voting('st', 'bt', 's_')},\n{_voting('ts', 'bs', 't_')},\n{_plus('splus', 's', 's_sel')},\n{_plus('tplus', 't', 't_sel')},\n{_vsm('e1', 's', 't', post_a='splus')},\n{_vsm('e2', 's', 't', post_b='tplus')}\n{_mean('e1', 'e2')}",
    "enrich_params": f"{BASE},\n{_vsm('sm', 's', 'm')},\n{_PAIRS},\n{_voting('sm', 'bi', share=0.3, k=5)}\nSELECT artifact_id, biterm, vote, rk AS rank, CAST(reps AS BIGINT) AS reps FROM sel",
    "enrichment_stats": f"{BASE},\n{_vsm('sm', 's', 'm')},\n{_VOTES},\nby_id AS (SELECT artifact_id, CAST(count(*) AS DOUBLE) AS pairs, CAST(sum(2 * reps) AS DOUBLE) AS terms FROM sel GROUP BY ALL)\nSELECT '' AS artifact_id, round(avg(pairs), 6) AS pairs, round(avg(terms), 6) AS terms FROM by_id UNION ALL SELECT * FROM (SELECT * FROM by_id ORDER BY artifact_id LIMIT 5)",
    "allowed_pairs": f"WITH {_IDP}\nSELECT * FROM pairs WHERE canonical IN (SELECT canonical FROM pairs WHERE artifact_id IN ('p0', 'p1', 'p2', 'p3'))",
    "appended_pairs": f"WITH {_IDP},\nmore AS (SELECT artifact_id, string_agg(repeat(term1 || ' ' || term2 || ' ', CAST(weight + 1 AS BIGINT)), '' ORDER BY canonical) AS more FROM pairs GROUP BY ALL)\nSELECT artifact_id, CASE WHEN more IS NULL THEN CASE WHEN p_partkey % 7 > 0 THEN p_name END ELSE CASE WHEN p_partkey % 7 > 0 THEN p_name ELSE '' END || ' ' || more END AS raw_text FROM w LEFT JOIN more USING (artifact_id)",
    "consensual_counts": f"WITH {_IDP}\nSELECT canonical, p_brand AS source, p_type AS destination, min(term1) AS term1, min(term2) AS term2, count(*) AS n FROM pairs JOIN w USING (artifact_id) GROUP BY ALL",
    "head_modifiers": f"{BASE},\n{_EDGES}\nSELECT artifact_id, CAST(sentence AS INT) AS sentence, head, modifier FROM heads",
    "phrase_pairs": f"{BASE},\n{_EDGES},\n{_PHRASES}",
    "relations": f"{BASE},\n{_EDGES}\nSELECT artifact_id, '''' || g || ''' -> ''' || d || '''' AS pair, max({{'s': sentence, 'r': rel}}).r AS rel FROM edges GROUP BY ALL",
    "gold_file": "SELECT DISTINCT 'S' || p_size AS source_id, 'T' || CASE WHEN p_partkey % 6 < 2 THEN p_partkey::VARCHAR ELSE '' END AS target_id FROM part WHERE p_partkey % 6 IN (0, 1, 5)",
    "pair_file": f"WITH {_FILES}\nSELECT artifact_id, place, name, term1, term2, term1 || upper(term2[1]) || term2[2:] AS canonical, weight FROM pp",
    "pair_text": f"WITH {_FILES},\n{_TEXTS.format(x='name')}\nSELECT * FROM ptx",
    "pair_plain_text": f"WITH {_FILES},\n" + _TEXTS.format(x="lower(regexp_replace(replace(replace(name, '_', ' '), '-', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'))") + "\nSELECT * FROM ptx",
    "preprocessed": f"WITH {_FILES},\n{_TEXTS.format(x='name')},\no AS (SELECT p_brand AS artifact_id, string_agg(DISTINCT p_type, ' and the ' ORDER BY p_type) AS raw_text FROM part WHERE p_size > 25 GROUP BY ALL)\nSELECT artifact_id, raw_text, coalesce(ir_text, '') AS ir_text, lower(replace(raw_text, ' and the ', ' ')) AS base_text, n_pairs FROM o LEFT JOIN ptx USING (artifact_id) LEFT JOIN (SELECT artifact_id, count(*) AS n_pairs FROM pp GROUP BY ALL) USING (artifact_id) WHERE artifact_id <> 'Brand#1'",
    "stopword_file": "SELECT DISTINCT string_split(p_name, ' ')[1] AS word FROM part",
    "matrix_file": f"{BASE},\n{_VS}\nSELECT source_id, target_id, {_four('coalesce(score, 0)')} AS score FROM (SELECT DISTINCT source_id FROM v) CROSS JOIN (SELECT DISTINCT target_id FROM v) LEFT JOIN v USING (source_id, target_id)",
    "link_file": f"{BASE},\n{_VS},\n{_top('k', 'v', 3)}\nSELECT source_id AS \"Source\", target_id AS \"Target\", {_four('score')} AS \"Score\" FROM k",
    "biterm_file": f"WITH {_IDP}\nSELECT DISTINCT canonical FROM pairs",
    "curve_file": f"{BASE},\n{_VS},\n{_GOLD},\n{_curve('v')},\n{_LEVELS}\nSELECT 'VSM' AS \"Approach\", printf('%.2f', recall_level) AS \"Recall\", {_four('precision')} AS \"Precision\" FROM lv",
    "summary_file": f"{BASE},\n{_VD},\n{_GOLD},\n{_MAP},\nal AS ({_ABOVE.format(links='v')}), no AS (SELECT 0 AS amount, 0 AS tp)\n" + " UNION ALL ".join(f"SELECT '{n}' AS \"Project\", 'VSM' AS \"Approach\", {_four('p')} AS \"Precision\", {_four('r')} AS \"Recall\", {_four(_F1)} AS \"F1\", {_four('map')} AS \"MAP\" FROM {_of(t)}, mapped" for n, t in (("one", "al"), ("two", "no"))),
    "threshold_file": f"{BASE},\n{_VS},\n{_GOLD},\n{_SWEEP}\nSELECT 'VSM' AS \"Approach\", 'one' AS \"Project\", {_four('threshold')} AS \"Threshold\", {_four('p')} AS \"Precision\", {_four('r')} AS \"Recall\", {_four(_F1)} AS \"F1\", CAST(amount AS VARCHAR) AS \"Amount\" FROM {_of('sw')}",
    "top_k_file": f"{BASE},\n{_VS},\n{_GOLD},\n{_X},\n{_TOPS}\nSELECT 'VSM' AS \"Approach\", 'one' AS \"Project\", CAST(k AS VARCHAR) AS \"Threshold\", {_four('p')} AS \"Precision\", {_four('r')} AS \"Recall\", {_four(_F1)} AS \"F1\", CAST(amount AS VARCHAR) AS \"Amount\" FROM {_of('tk')}",
    "model_weights": f"{BASE},\n{_VS}\nSELECT side AS role, id AS doc_id, term, n, round(w, {DIGITS}) AS weight FROM v_w JOIN v_p USING (side, id, term)",
}
