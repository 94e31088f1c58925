"""Enrichment of both sides against a brute-force version."""

import math
import random
from collections import Counter

import pytest

from tracelark.operators import enrich as E
from tracelark.plans import queries as engine

R = random.Random(3)
WORDS = [a + b for a in ("kal", "lom", "mir", "ret", "nuv") for b in ("ba", "tor", "lin", "dex")]


def vsm(a, b):
    n, df = len(a) + len(b), Counter(w for side in (a, b) for x in side.values() for w in set(x))
    weigh = lambda x: {w: c / len(x) * math.log(n / df[w]) for w, c in Counter(x).items()}
    out = {}
    for i, x in a.items():
        for j, y in b.items():
            p, q = weigh(x), weigh(y)
            dot = sum(p[w] * q.get(w, 0) for w in p)
            if dot:
                out[i, j] = round(dot / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values())), 9)
    return out


def plus(docs, mid):
    links, out = vsm(docs, mid), {}
    for i, x in docs.items():
        near = sorted((-s, j) for (k, j), s in links.items() if k == i)
        vote = Counter()
        for s, j in [v for v in near if v[0] <= 0.5 * near[0][0]][:3]:
            for pair, f in Counter(zip(mid[j], mid[j][1:])).items():
                vote[" ".join(pair)] += s / near[0][0] * math.log(1 + f)
        top = sorted((-round(v, 9), p) for p, v in vote.items() if round(v, 9) >= 2 - 1e-9)[:24]
        out[i] = x + [w for v, p in top for w in p.split() * min(4, math.floor(0.5 - v))]
    return out


def test_both_sides_are_enriched(spark, tmp_path):
    # conversations repeat few words, so that pairs recur and their votes pass
    topics = [R.sample(WORDS, 4) for _ in range(6)]
    some = lambda n, t: [R.choice(topics[t] if R.random() < 0.8 else WORDS) for _ in range(n)]
    s, t = {f"b{i}": some(15, i) for i in range(4)}, {f"d{i}": some(20, i % 6) for i in range(12)}
    m = {f"c{i}": some(90, i % 6) for i in range(12)}
    for name, docs, columns in (("benchmark", s, "item_id long, text string"), ("documents", t, "doc_id long, text string")):
        spark.createDataFrame([(int(k[1:]), " ".join(x)) for k, x in docs.items()], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    turns = [(int(k[1:]), turn, " ".join(x[60 * turn:60 * turn + 60])) for k, x in m.items() for turn in (1, 0)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    s_plus, t_plus = plus(s, m), plus(t, m)
    assert s_plus != s and t_plus != t
    a, b = vsm(s_plus, t), vsm(s, t_plus)
    want = {k: (a.get(k, 0) + b.get(k, 0)) / 2 for k in a.keys() | b.keys()}
    got = {(r["source_id"], r["target_id"]): r["score"] for r in engine.QUERIES["enriched_links"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


@pytest.mark.parametrize("voters", [3, 2048])
def test_best_votes_are_the_selected_votes(spark, monkeypatch, voters):
    monkeypatch.setattr(E, "VOTERS", voters)
    links = spark.createDataFrame([(f"a{i}", f"n{R.randrange(9)}", R.choice([0.2, 0.4, 0.7, 0.71])) for i in range(30) for _ in range(4)] + [("zero", "n1", 0.0)], "source_id string, target_id string, score double").dropDuplicates(["source_id", "target_id"]).localCheckpoint()
    freq = spark.createDataFrame([(f"n{i}", f"{a} {b}", R.choice([1, 2, 7])) for i in range(8) for a in WORDS[:8] for b in WORDS[:8] if R.random() < 0.7], "artifact_id string, biterm string, freq long")
    for params in (E.EnrichParams(), E.EnrichParams(top_k=2, share=0.6, max_pairs=5, min_agree=0.5)):
        rows = lambda v: sorted((r["artifact_id"], r["biterm"], r["rank"], r["reps"], round(r["vote"], 8)) for r in E.selected_pairs(v, params).collect())  # noqa: B023, E731
        best = E.best_votes(links, freq, params)
        assert rows(best) == rows(E.votes(links, freq, params)) and len(rows(best)) > 50
        assert "part" in best._jdf.queryExecution().executedPlan().toString() and best.count() == len(rows(best))  # no vote that fails is a row
