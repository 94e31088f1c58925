"""Postings counted where texts lie, shared windows, and ranks of hits, each against the plain form."""

import random

import pytest

from tracelark.operators import evaluate as V, models as M, shares as S

from .test_blocks import as_rows, corpus, texts


@pytest.mark.parametrize("most", [0, 5, 12])
def test_rare_terms_are_joined_by_shuffle(spark, monkeypatch, most):
    s = corpus(spark, "s", texts(1, 9) + [None, "only\x0bhere  w1"])
    t = corpus(spark, "t", texts(2, 20) + ["alone there w1", ""])
    w = M.weights(s, t).collect()
    monkeypatch.setattr(S, "TERMS", most)
    terms = S.Terms(s, t, 11 + 22)
    assert not terms.all
    for d, role in ((s, "s"), (t, "t")):
        names = {r["term"] for r in w if r["role"] != role}
        got = terms.postings(d, True, False).collect()
        assert {(r["doc_id"], r["term"]): r["x"] for r in got if r["term"] is not None} == {(r["doc_id"], r["term"]): pytest.approx(r["weight"]) for r in w if r["role"] == role and r["term"] in names}
        for i in {r["doc_id"] for r in w if r["role"] == role}:
            assert sum(r["x"] ** 2 for r in got if r["doc_id"] == i) == pytest.approx(sum(r["weight"] ** 2 for r in w if r["role"] == role and r["doc_id"] == i))
    some = {m: as_rows(m(s, t, True)) for m in (M.vsm, M.jsd)}
    monkeypatch.setattr(S, "TERMS", 1000)
    for m, got in some.items():
        assert len(got) == 242 and got == {k: pytest.approx(v, abs=1e-12) for k, v in as_rows(m(s, t, True)).items()}


def test_few_rows_at_a_time(spark, monkeypatch):
    d = corpus(spark, "d", texts(4, 40)).coalesce(1)
    want = {r["term"]: r["df"] for r in S.term_documents(d).collect()}
    monkeypatch.setattr(S, "CHARACTERS", 30)
    assert {r["term"]: r["df"] for r in S.term_documents(d).collect()} == want and len(want) == 30


def test_shared_windows(spark):
    r = random.Random(1)
    make = lambda n: [[r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(n)]
    s, t = make(20), make(60) + [["zz"] * 9]
    table = lambda p, x: spark.createDataFrame([(f"{p}{i}", w) for i, w in enumerate(x)], "artifact_id string, tokens array<string>")
    has = lambda w: {tuple(w[i:i + 4]) for i in range(len(w) - 3)}
    got = [tuple(x) for x in S.shared_windows(table("s", s), table("t", t), 4).collect()]
    assert sorted(got) == sorted((f"s{i}", f"t{j}") for i, a in enumerate(s) for j, b in enumerate(t) if has(a) & has(b)) and len(got) > 20
    assert S.shared_windows(table("s", [["a"]]), table("t", t), 4).collect() == []


@pytest.mark.parametrize("most", [0, 1000])
def test_ranks_of_hits(spark, monkeypatch, most):
    monkeypatch.setattr(V, "HITS", most)
    r = random.Random(7)
    rows = [(f"s{i}", f"t{j}", r.choice([0.0, 0.1, 0.25, 0.5, r.random()])) for i in range(12) for j in range(15)]
    gold = [(a, b) for a, b, _ in r.sample(rows, 30)] + [("none", "t0")]
    links = spark.createDataFrame(rows, "source_id string, target_id string, score double")
    got = V._hits(links, spark.createDataFrame(gold, "source_id string, target_id string")).collect()
    order = sorted(rows, key=lambda x: (-x[2], x[0], x[1]))
    ranks = [k for k, x in enumerate(order, 1) if (x[0], x[1]) in set(gold)]
    assert sorted((x["rank"], x["cum"]) for x in got) == [(k, c) for c, k in enumerate(ranks, 1)]
    assert V._hits(links, spark.createDataFrame([("none", "t0")], "source_id string, target_id string")).collect() == []
