"""Scores by blocks against brute force, and the best links of each source against all links."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tracelark.operators import blocks as B, evaluate as V, links as L, models as M, paths as P, shares as S
from tracelark.plans import queries as engine


def corpus(spark, p, texts):
    return spark.createDataFrame([(f"{p}{i}", t) for i, t in enumerate(texts)], "artifact_id string, ir_text string")


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choices([f"w{i}" for i in range(30)], k=r.randint(0, 12))) for _ in range(n)]


def as_rows(df):
    return {(r["source_id"], r["target_id"]): r["score"] for r in df.collect()}


def test_many_blocks_give_the_same_links(spark, monkeypatch):
    s, t = corpus(spark, "s", texts(1, 30)), corpus(spark, "t", texts(2, 50) + texts(2, 10))  # copies tie
    whole = {(m, dense): as_rows(m(s, t, dense)) for m in (M.vsm, M.jsd) for dense in (True, False)}
    assert len(whole[M.vsm, True]) == len(whole[M.jsd, True]) == 1800
    monkeypatch.setattr(B, "ROWS", 7)
    monkeypatch.setattr(B, "LINKS", 150)
    for (m, dense), want in whole.items():
        got = as_rows(m(s, t, dense))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    best = as_rows(M.vsm(s, t, False, 3, 9))
    want = as_rows(L.top_k(M.vsm(s, t, False).selectExpr("source_id", "target_id", "round(score, 9) score"), 3))
    assert best == want and len(best) <= 90
    only = as_rows(M.vsm(s, t, False, 3, 9, s.where("artifact_id in ('s1', 's2')")))
    assert only == {k: v for k, v in want.items() if k[0] in ("s1", "s2")}
    assert "CoGroups" in M.vsm(s, t, False)._jdf.queryExecution().executedPlan().toString()  # no row for each common term of a pair


@pytest.mark.parametrize("heavy", [0, 4, 1024])
def test_parts_of_a_block(monkeypatch, heavy):
    r = np.random.default_rng(3)
    a, b = (np.where(r.random((n, 12)) < 0.4, r.random((n, 12)), 0) for n in (9, 11))
    table = lambda m: pa.table({"doc_id": [f"{i:02}" for i, _ in zip(*np.nonzero(m))], "term": [str(j) for _, j in zip(*np.nonzero(m))], "x": m[np.nonzero(m)]})
    for name, value in (("CELLS", 25), ("PRODUCTS", 5), ("HEAVY", heavy)):
        monkeypatch.setattr(B, name, value)
    left, right = table(a), table(b)
    vocabulary = pc.unique(left["term"])
    got = np.concatenate([x for _, x in B._cosines(B._Side(left, vocabulary, "norm", False), B._Side(right, vocabulary, "norm", True), len(vocabulary))])
    a, b = a[a.any(1)], b[b.any(1)]
    assert got == pytest.approx(a @ b.T / np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))))


def test_best_cells_break_ties_by_column():
    score = np.array([[0.5, 0.7, 0.5, 0.5], [0.0, 0.0, 0.1, 0.0]])
    r, c = B._best(score, np.array([[True] * 4, [False, False, True, True]]), 3)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 1), (0, 0), (0, 2), (1, 2), (1, 3)]


def test_paths_need_few_intermediates(spark):
    s, m, t = (corpus(spark, p, texts(i, n)) for i, (p, n) in enumerate((("s", 3), ("m", 40), ("t", 20))))
    model = lambda a, b, best=None, only=None: M.vsm(a, b, False, best, 9, only)
    full = [model(a, b) for a, b in ((s, m), (m, t), (s, s), (m, m))]
    few = P.hops(model, s, m, t)
    assert few[1].select("source_id").distinct().count() < 40
    rows = lambda df: sorted((r["source_id"], r["target_id"], round(r["score"], 8)) for r in df.collect())
    full = [x.selectExpr("source_id", "target_id", "round(score, 9) score") for x in full]
    assert rows(P.best_paths(*few)) == rows(P.best_paths(*full))


def test_average_precision_ranks_up_to_the_last_hit(spark):
    rows = [("a", f"t{i}", score) for i, score in enumerate((0.9, 0.5, 0.5, 0.2, 0.0))] + [("b", "t1", 0.3), ("c", "t9", 0.0), ("c", "t8", 0.0)]
    links = spark.createDataFrame(rows, "source_id string, target_id string, score double")
    gold = spark.createDataFrame([("a", "t2"), ("a", "t0"), ("a", "zz"), ("c", "t9"), ("q", "t1")], "source_id string, target_id string")
    lab = V.labelled(links, gold)
    assert sorted(r["target_id"] for r in V.up_to_last_hit(lab, V.last_hits(lab)).collect()) == ["t0", "t1", "t2", "t8", "t9"]
    got = {r["source_id"]: r["ap"] for r in V.average_precision(links, gold).collect()}
    assert got == {"a": pytest.approx((1 + 2 / 3) / 3), "b": 0.0, "c": 0.5}


@pytest.mark.parametrize("most, dense", [(5, True), (1000, False)])
def test_two_models_of_a_block_need_no_join(spark, monkeypatch, most, dense):
    s, t = corpus(spark, "s", texts(5, 9) + ["", "only here"]), corpus(spark, "t", texts(6, 15) + [None, "alone there w1"])
    for name, value in (("ROWS", 9), ("LINKS", 150), ("CELLS", 50)):
        monkeypatch.setattr(B, name, value)
    monkeypatch.setattr(S, "TERMS", most)
    v, j = as_rows(M.vsm(s, t, dense, digits=9)), as_rows(M.jsd(s, t, dense, 9))
    got = {(r["source_id"], r["target_id"]): (r["a"], r["b"]) for r in M.vsm_and_jsd(s, t, dense, 9).collect()}
    assert got.keys() == v.keys() | j.keys() and len(got) > 50
    assert all(got[k] == tuple(None if k not in m else pytest.approx(m[k], abs=2e-9) for m in (v, j)) for k in got)


def test_operators_on_links_side_by_side(spark):
    two = spark.createDataFrame([("s", "t1", 0.8, 0.2), ("s", "t2", 0.4, None), ("s", "t3", None, 0.6), ("s", "t4", 0.0, 0.0), ("s", "t5", None, 0.1)], "source_id string, target_id string, a double, b double")
    v, j = (two.selectExpr("source_id", "target_id", f"{c} score").where("score is not null") for c in ("a", "b"))
    assert as_rows(L.average_of(two)) == as_rows(L.average(v, j)) and as_rows(L.maximum_of(two)) == as_rows(L.maximum(v, j))
    assert as_rows(L.upsert_of(two, 0.1)) == as_rows(L.upsert(v, L.above(j, 0.1)))
    assert all(as_rows(L.fuse_of(two, k)) == as_rows(L.fuse(v, j, k)) for k in ("avg", "max", "guarded_avg"))


@pytest.mark.parametrize("name", ["vsm_jsd_mean", "max_links", "upsert_links", "fuse_avg", "fuse_max", "fuse_guarded"])
def test_links_of_two_models_are_not_shuffled(spark, tmp_path, name):
    for table, columns in (("benchmark", "item_id long, text string"), ("documents", "doc_id long, text string")):
        spark.createDataFrame(list(enumerate(texts(7, 6))), columns).write.parquet(f"{tmp_path}/{table}.parquet")
    plan = engine.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "Join" not in plan
