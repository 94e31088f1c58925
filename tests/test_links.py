import pytest

from tracelark.operators import enrich as E, evaluate as V, links as L, paths as P


def links(spark, *rows):
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "source_id string, target_id string, score double")


def gold(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, target_id string")


def as_dict(df):
    return {(r["source_id"], r["target_id"]): pytest.approx(r["score"]) for r in df.collect()}


def test_link_operators(spark):
    a = links(spark, ("s", "t1", 0.8), ("s", "t2", 0.4), ("s", "t3", 0.39), ("r", "t1", 0))
    b = links(spark, ("s", "t1", 0.2), ("s", "t4", 0.6))
    assert as_dict(L.relative_top_k(a, 3)) == {("s", "t1"): 0.8, ("s", "t2"): 0.4}
    assert as_dict(L.top_k(links(spark, ("s", "b", 1), ("s", "a", 1), ("s", "c", 2)), 2)) == {("s", "c"): 2, ("s", "a"): 1}
    assert as_dict(L.average(a, b)) == {("s", "t1"): 0.5, ("s", "t2"): 0.2, ("s", "t3"): 0.195, ("s", "t4"): 0.3}
    assert as_dict(L.maximum(a, b)) == {("s", "t1"): 0.8, ("s", "t2"): 0.4, ("s", "t3"): 0.39}
    assert as_dict(L.fuse(a, b)) == {("s", "t1"): 0.5, ("s", "t2"): 0.2, ("s", "t3"): 0.195, ("r", "t1"): 0}
    assert as_dict(L.fuse(a, b, "max"))["s", "t1"] == 0.8 and as_dict(L.fuse(a, b, "guarded_avg"))["s", "t2"] == 0.4
    assert as_dict(L.fuse(a, b, guard=True))["s", "t2"] == 0.4
    assert as_dict(L.upsert(a, b))["s", "t1"] == 0.2 and L.upsert(a, b).count() == 5
    assert as_dict(L.lookup(a, gold(spark, ("s", "t1"), ("s", "zz")))) == {("s", "t1"): 0.8, ("s", "zz"): 0}
    assert L.above(a, 0.4).count() == 1 and L.below(a, 0.4).count() == 2 and L.add(a, b).count() == 6
    assert L.sources(a).count() == 2 and L.targets(a).count() == 3 and L.row(a, "s").count() == 3


def test_paths(spark):
    sm = links(spark, ("S1", "I1", .8), ("S1", "I2", .6), ("S2", "I1", .7), ("S2", "I2", .5))
    mt = links(spark, ("I1", "T1", .9), ("I1", "T2", .4), ("I2", "T1", .3), ("I2", "T2", .8))
    ss, mm = links(spark, ("S1", "S2", .6), ("S2", "S1", .6)), links(spark, ("I1", "I2", .5), ("I2", "I1", .5))
    key = lambda a, b, c, d: {("S1", "T1"): a, ("S1", "T2"): b, ("S2", "T1"): c, ("S2", "T2"): d}
    assert as_dict(P.outer_paths(sm, mt)) == key(.72, .48, .63, .40)
    assert as_dict(P.inner_source_paths(ss, sm, mt)) == key(.378, .24, .432, .288)
    assert as_dict(P.inner_intermediate_paths(sm, mm, mt)) == key(.27, .32, .225, .28)
    base = links(spark, ("S1", "T1", .7), ("S1", "T2", .2), ("S2", "T1", .3), ("S2", "T2", .6), ("S9", "T9", .1))
    assert as_dict(P.transitive(base, sm, mt, ss, mm)) == key(.72, .48, .63, .60) | {("S9", "T9"): .1}
    assert as_dict(P.transitive(links(spark), sm, mt, ss, mm)) == key(.72, .48, .63, .40)


def test_votes_and_enrichment(spark):
    near = links(spark, ("a", "n1", .8), ("a", "n2", .6), ("a", "n3", .3))
    f = spark.createDataFrame([("n1", "ab cd", 10), ("n2", "ab cd", 10), ("n1", "lo w", 1), ("n2", "lo w", 1), ("n1", "se ven", 7), ("n1", "si x", 6), ("n3", "no no", 99)], "artifact_id string, biterm string, freq long")
    v = E.votes(near, f)
    got = {r["biterm"]: r["vote"] for r in v.collect()}
    assert got == {"ab cd": pytest.approx(4.196317, abs=1e-6), "lo w": pytest.approx(1.213008, abs=1e-6), "se ven": pytest.approx(2.079442, abs=1e-6), "si x": pytest.approx(1.945910, abs=1e-6)}
    docs = spark.createDataFrame([("a", "base"), ("z", "other")], "artifact_id string, raw_text string")
    text = {r["artifact_id"]: r["raw_text"] for r in E.extended_text(docs, v).collect()}
    assert text == {"a": "base\n" + "ab cd " * 4 + "se ven " * 2, "z": "other"}
    assert E.EnrichParams.of({"top_k": "5", "share": "x"}) == E.EnrichParams(top_k=5)
    assert tuple(E.enrichment_stats(v).first()) == (2.0, 12.0)


def test_pairs(spark):
    w = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["q"]), ("z", ["r", "r"])], "artifact_id string, tokens array<string>")
    got = [(r["artifact_id"], r["term1"], r["term2"]) for r in E.identifier_pairs(w).collect()]
    assert sorted(got) == [("x", "a", "b"), ("x", "a", "c"), ("x", "b", "c"), ("z", "r", "r")]
    assert sorted((r["term1"], r["term2"]) for r in E.adjacent_pairs(w).collect()) == [("a", "b"), ("b", "c"), ("r", "r")]
    freq = E.pair_frequencies(spark.createDataFrame([("x", "A", "b", 2), ("x", "a", "B", 3), ("x", "", "c", 1)], "artifact_id string, term1 string, term2 string, weight int"))
    assert [tuple(r) for r in freq.collect()] == [("x", "a b", 5)]


def test_evaluation(spark):
    lk = links(spark, ("s1", "t1", .9), ("s1", "t2", .5), ("s1", "t3", .4))
    g = gold(spark, ("s1", "t1"), ("s1", "t3"), ("s1", "t3"))
    assert V.mean_average_precision(lk, g).first()[0] == pytest.approx(0.833333, abs=1e-6)
    assert V.mean_average_precision(L.add(lk, links(spark, ("s2", "t1", .1))), g).first()[0] == pytest.approx(0.416667, abs=1e-6)
    r = V.above_evaluation(lk, g, .5).first()
    assert (r["precision"], r["recall"], r["f1"]) == (1.0, 0.5, pytest.approx(2 / 3))
    r = V.above_evaluation(lk, g, .9).first()
    assert (r["precision"], r["recall"], r["f1"], r["amount"]) == (1.0, 0.0, 0.0, 0)
    assert V.precision(L.above(lk, .9), g).first()[0] == 0.0 and V.recall(lk, g).first()[0] == 1.0
    c = {r["recall_level"]: r["precision"] for r in V.pr_curve(lk, g).collect()}
    assert len(c) == 20 and all(v == pytest.approx(1.0 if k <= 0.5 else 2 / 3) for k, v in c.items())
    assert all(r["precision"] == 0 for r in V.pr_curve(lk, gold(spark)).collect())
    assert len(V.THRESHOLDS) == 10 and V.threshold_sweep(lk, g).count() == 10
    t = {r["k"]: (r["amount"], r["tp"]) for r in V.top_k_sweep(lk, g).collect()}
    assert t == {1: (1, 1), 2: (2, 1), 3: (3, 2), 4: (3, 2), 5: (3, 2)}
    x = lambda *v: spark.createDataFrame([(float(y),) for y in v], "x double")
    assert V.cliffs_delta(x(1, 2), x(1, 1)).first()[0] == 0.5 and V.cliffs_delta(x(), x(1)).first()[0] == 0.0
    assert V.wilcoxon([1, 2, 3, 4, 5], [2, 3, 4, 5, 6]) == pytest.approx(2 / 32)
    with pytest.raises(ValueError):
        V.wilcoxon([1], [])
    assert V.f_at_11(lk, g).count() == 11 and set(V.compare(lk, lk, g)) == {"p", "delta"} and V.compare(lk, lk, gold(spark, ("q", "q"))) is None
    assert V.is_link(g, gold(spark, ("s1", "t1"), ("s1", "t2"))).count() == 1 and V.relevant_targets(g).first()["targets"] == ["t1", "t3"]


def test_appended_and_counted(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", None)], "artifact_id string, raw_text string")
    pairs = spark.createDataFrame([("a", "p", "q", "pQ", 2), ("a", "m", "n", "mN", 1)], "artifact_id string, term1 string, term2 string, canonical string, weight int")
    assert {r["artifact_id"]: r["raw_text"] for r in E.append_pairs(docs, pairs).collect()} == {"a": "x m n p q p q ", "b": None}
    found = spark.createDataFrame([("p", "q", "pQ", "s", "t")] * 2, "term1 string, term2 string, canonical string, source string, destination string")
    assert E.consensual_counts(found).first()["n"] == 2
    assert E.allowed_pairs(pairs, spark.createDataFrame([("pQ",)], "canonical string")).count() == 1
