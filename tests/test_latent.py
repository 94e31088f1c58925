"""Latent scores of many documents against brute force: equal columns are one, and rows are rebuilt a strip at a time."""

import random

import numpy as np
import pytest

from tracelark.operators import blocks as B, latent as Z, models as M

from .test_models import brute, corpus, scores


def made(p, seed, n):
    """Texts with words of their own, words that always go together, and copies."""
    r = random.Random(seed)
    out = [" ".join(r.choices([f"w{i}" for i in range(25)], k=r.randint(3, 15))) + f" {p}{i}own {p}{i}own {p}{i}too" + (" left right right" if i % 3 == 0 else "") for i in range(n)]
    return [(f"{p}{i}", x) for i, x in enumerate(out + out[:2])]


@pytest.mark.parametrize("small", [True, False])
def test_many_documents(spark, monkeypatch, small):
    a, b = made("s", 1, 7), made("t", 2, 30)
    want = brute(a, b)
    if small:
        for m, name, value in ((Z, "POSTINGS", 50), (Z, "COLUMNS", 7), (Z, "DOCUMENTS", 9), (Z, "SLICE", 16), (Z, "TRAVEL", 1), (Z, "STEP", 15000), (Z, "BASIS", 0), (B, "LINKS", 140), (B, "ROWS", 16)):
            monkeypatch.setattr(m, name, value)
    s, t = corpus(spark, a), corpus(spark, b)
    got = scores(M.lsi(s, t, local_docs=0))
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(v[1], abs=1e-9) for p, v in want.items())
    mean = {p: sum(v) / 3 for p, v in want.items()}
    for dense in (True, False):
        links = M.union(s, t, dense, local_docs=0)
        assert "Join" not in links._jdf.queryExecution().executedPlan().toString()  # scores of three models need none
        got = scores(links)
        assert all(got[p] == pytest.approx(v, abs=1e-9) for p, v in mean.items() if v > 1e-9) and got.keys() <= mean.keys()


def test_empty_documents_of_many(spark):
    s, t = corpus(spark, [("s1", "a b c"), ("s2", ""), ("s3", "d d e"), ("s4", "f f")]), corpus(spark, [("t1", "a c"), ("t2", None), ("t3", "e d"), ("t4", "g"), ("s1", "b h")])
    for dense in (True, False):
        near, far = (scores(M.union(s, t, dense, local_docs=n)) for n in (3000, 0))
        assert far.keys() == near.keys() and all(far[p] == pytest.approx(near[p], abs=1e-9) for p in near)
        near, far = (scores(M.lsi(s, t, dense, local_docs=n)) for n in (3000, 0))
        assert far.keys() == near.keys() and all(far[p] == pytest.approx(near[p], abs=1e-9) for p in near)
    assert scores(M.union(corpus(spark, []), t, local_docs=0)) == {} and scores(M.lsi(corpus(spark, [("x", "")]), corpus(spark, [("y", " ")]), False, local_docs=0)) == {}


def test_equal_columns_are_one():
    df, h, d = np.array([1, 2, 1, 2, 1, 3]), np.array([7, 9, 8, 9, 5, 9]), np.array([4, 0, 4, 1, 6, 0])
    place, wide = Z._placed(df, h, d, 2)
    assert place[0] == place[2] != place[4] and place[1] == place[3] != place[5] and len(set(place.tolist())) == 4 and wide == 2


@pytest.mark.parametrize("most", [0, 1000])
def test_left_vectors(most):
    r = np.random.default_rng(5)
    a = r.standard_normal((150, 40)) @ np.diag(np.linspace(3, 1, 40))
    a[7] = 0
    value, v = np.linalg.eigh(a @ a.T)
    u = Z.left_vectors(lambda x: a @ (a.T @ x), a.any(1), 10, 4, most)
    assert u @ (u.T @ a) == pytest.approx(v[:, -10:] @ (v[:, -10:].T @ a), abs=1e-8) and not u[7].any()
    few = a[:, :5]
    u = Z.left_vectors(lambda x: few @ (few.T @ x), few.any(1), 10, 4, most)
    assert u.shape == (150, 10) and u @ (u.T @ few) == pytest.approx(few, abs=1e-9)
