import math
import random

import numpy as np
import pytest

from tracelark.operators import models as M, postings as T


def corpus(spark, rows):
    return spark.createDataFrame(rows, "artifact_id string, ir_text string")


def scores(links):
    return {(r["source_id"], r["target_id"]): r["score"] for r in links.collect()}


S = [("s1", "alpha alpha beta"), ("s2", "gamma")]
TT = [("t1", "alpha beta beta"), ("t2", "delta gamma")]


def test_goldens(spark):
    s, t = corpus(spark, S), corpus(spark, TT)
    want = {"VSM": (0.8, 0.447213595), "LSI": (1.0, 1.0), "JSD": (0.918295834, 0.688721876), "UNION": (0.906098611, 0.711978490)}
    for name, (a, b) in want.items():
        got = scores(M.model(name)(s, t))
        assert got["s1", "t1"] == pytest.approx(a, abs=1e-8) and got["s2", "t2"] == pytest.approx(b, abs=1e-8), name
        assert len(got) == (2 if name == "UNION" else 4)
        assert all(v == pytest.approx(0, abs=1e-9) for k, v in got.items() if k in (("s1", "t2"), ("s2", "t1")))
    with pytest.raises(ValueError):
        M.model("BM25")


def test_empty_documents(spark):
    s, t = corpus(spark, [("a", ""), ("b", "x y")]), corpus(spark, [("c", None), ("d", "x z")])
    got = scores(M.jsd(s, t))
    assert got["a", "c"] == 1.0 and got["a", "d"] == 0.5 and got["b", "c"] == 0.5
    assert scores(M.vsm(s, t))["a", "d"] == 0.0
    assert scores(M.lsi(corpus(spark, []), t)) == {}


def brute(S, T):
    docs = [("s", i, x.split()) for i, x in S] + [("t", i, x.split()) for i, x in T]
    vocab = sorted({w for *_, d in docs for w in d})
    n = np.array([[d.count(w) for w in vocab] for *_, d in docs], float)
    tf = n / n.sum(1, keepdims=True)
    w = tf * np.log(len(docs) / (n > 0).sum(0))
    cos = lambda a, b: float(a @ b / math.sqrt((a @ a) * (b @ b))) if a.any() and b.any() else 0.0
    k = min(len(S), len(T), 100)
    u, s, vt = np.linalg.svd(w, full_matrices=False)
    wk = (u[:, :k] * s[:k]) @ vt[:k]
    l = np.where(wk > 1e-12, wk, w)
    h = lambda p: -sum(x * math.log2(x) for x in p if x > 0)
    out = {}
    for i, a in enumerate(S):
        for j, b in enumerate(T):
            p, q = tf[i], tf[len(S) + j]
            out[a[0], b[0]] = (cos(w[i], w[len(S) + j]), cos(l[i], l[len(S) + j]), max(0.0, 1 - (h((p + q) / 2) - (h(p) + h(q)) / 2)))
    return out


def test_against_numpy(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    make = lambda p, n: [(f"{p}{i}", " ".join(r.choices(words, k=r.randint(3, 15)))) for i in range(n)]
    a, b = make("s", 5), make("t", 8)
    want = brute(a, b)
    s, t = corpus(spark, a), corpus(spark, b)
    for k, f in enumerate((M.vsm, M.lsi, M.jsd)):
        got = scores(f(s, t))
        assert all(got[p] == pytest.approx(v[k], abs=1e-7) for p, v in want.items()), f
    sparse = scores(M.vsm(s, t, dense=False))
    assert {p for p, v in sparse.items() if v > 1e-12} == {p for p, v in want.items() if v[0] > 1e-12}
    far = scores(M.lsi(s, t, local_docs=0))
    assert all(far[p] == pytest.approx(v[1], abs=1e-6) for p, v in want.items())


def test_self_similarity(spark):
    s = corpus(spark, [("a", "x y y"), ("b", "y z"), ("c", "x z q")])
    got = scores(M.vsm(s, s))
    assert all(got[k, k] == pytest.approx(1) for k in "abc")
    assert all(got[a, b] == pytest.approx(got[b, a]) for a, b in got)


def test_postings(spark):
    p = T.postings(corpus(spark, [("a", "x  x y"), ("b", None)]))
    assert sorted(map(tuple, p.collect())) == [("a", "x", 2), ("a", "y", 1)]
    assert {r["term"]: r["weight"] for r in T.tfidf(p, 2).collect()} == {"x": pytest.approx(2 / 3 * math.log(2)), "y": pytest.approx(math.log(2) / 3)}
    d = spark.createDataFrame([("a", "1.c", "x"), ("a", "2.h", "y")], "artifact_id string, path string, raw_text string")
    assert [r["raw_text"] for r in T.dedup_artifacts(d).collect()] == ["y"]
