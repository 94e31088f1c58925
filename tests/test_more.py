"""Scanners on nested input, settings of the batch driver, files that are left out, and sparse against dense plans."""

import json
import logging

import pytest

from tracelark.functions.codescan import scan_c, scan_java
from tracelark.operators import evaluate as V, models
from tracelark.operators.settle import shared_folder
from tracelark.plans import pipeline
from tracelark.plans.config import Config
from tracelark.sources import readers as R, writers as W

JAVA = """/** Routes. */
public abstract class RouteBook<T extends Comparable<T>> extends Base<Map<String, List<T>>> implements Runnable {
  private final Map<String, List<RoutePoint>> pointsByName = new HashMap<>();
  private static int[] counts = {1, 2}, moreCounts; long total = 3, rest;
  public <K> Map<K, List<T>> findAll(@Size(max = 3) final Map<K, List<T>> sourceMap, int depth, String... sizes) throws IOException {
    sourceMap.forEach((key, val) -> process(key, val));
    Runnable later = () -> { doLater(); };
    for (RoutePoint p : points) { if (p.isActive()) visitPoint(p); }
  }
  static class InnerCell { String cellName; void touchCell() { helper.touch(); } }
  enum Color { RED, GREEN; Color nextColor() { return RED; } }
}"""
C = """typedef struct node_s { struct node_s *next_node; char name_buf[16]; } node_t;
int lookup(const char *name, int);
static const char *find_name(const node_t *first_node) { return pick_name(first_node); }
int walk(const node_t *first_node, unsigned int max_len, struct node_s *other, void (*call_back)(int)) {
  char *found_name = NULL, **other_ptr; struct node_s local_node; int idx = 0, last_idx = 1, arr_len[4];
  for (idx = 0; idx < max_len; idx++) { call_back(idx); if (!strcmp(first_node->name_buf, "a")) return get_name(first_node); }
}"""


def test_nested_java():
    assert scan_java(JAVA) == [
        ("comment", "/** Routes. */", 1), ("type", "RouteBook", 2), ("field_type", "Map String List RoutePoint", 1), ("field", "pointsByName", 1), ("field_type", "int", 1), ("field", "counts", 1), ("field", "total", 1),
        ("method", "findAll", 2), ("parameter_type", "Map K List T", 1), ("parameter", "sourceMap", 1), ("parameter", "depth", 1), ("call", "sourceMap", 1), ("call", "process", 1), ("call", "doLater", 1), ("call", "p", 1), ("call", "visitPoint", 1),
        ("type", "InnerCell", 2), ("field_type", "String", 1), ("field", "cellName", 1), ("method", "touchCell", 2), ("call", "helper", 1), ("type", "Color", 2), ("method", "nextColor", 2)]


def test_pointers_in_c():
    assert scan_c(C) == [
        ("type", "node_s", 2), ("type", "node_s", 2), ("declaration_type", "int", 1), ("call", "pick_name", 1), ("function", "walk", 2), ("parameter", "first_node", 1), ("parameter_type", "node_t", 1), ("parameter_type", "unsigned int", 1),
        ("parameter", "other", 1), ("parameter_type", "void", 1), ("declaration_type", "char", 1), ("type", "node_s", 2), ("declaration_type", "int", 1), ("declarator", "idx", 1), ("declarator", "last_idx", 1), ("call", "call_back", 1), ("call", "strcmp", 1), ("call", "get_name", 1)]


def test_settings_reach_the_full_pipeline(spark, tmp_path, monkeypatch):
    for role in "smt":
        (tmp_path / role).mkdir()
        (tmp_path / role / "a.txt").write_text("flight route")
    part = lambda x: {"path": str(tmp_path / x)}
    raw = {"doEvaluate": False, "runTriad": True, "irMethod": "JSD", "enrichment": {"share": "0.25", "top_k": 7, "max_pairs": "many"}, "fusionStrategy": "max", "fusionGuard": True, "transitivity": False,
           "projects": [{"name": "p", "source": part("s"), "intermediate": part("m"), "target": part("t")}]}
    seen = {}

    def full(src, mid, tgt, model, params, **more):
        seen.update(more, model=model, params=params)
        return spark.createDataFrame([("a", "a", 0.5)], "source_id string, target_id string, score double")

    monkeypatch.setattr(pipeline, "run_full", full)
    config = Config.of(json.loads(json.dumps(raw)))
    pipeline.run_project(spark, config.projects[0], config, str(tmp_path / "out"))
    assert (seen["model"], seen["strategy"], seen["guard"], seen["transitivity"]) == ("JSD", "max", True, False)
    assert (seen["params"].share, seen["params"].top_k, seen["params"].max_pairs, seen["params"].max_repeat) == (0.25, 7, 24, 4)
    assert (tmp_path / "out" / "p" / "similarities").exists()


def test_files_left_out_are_logged(spark, tmp_path, caplog):
    (tmp_path / "good.txt").write_text("été")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00 no text")
    with caplog.at_level(logging.WARNING):
        got = R.read_artifacts(spark, str(tmp_path)).collect()
    assert [(r["artifact_id"], r["raw_text"]) for r in got] == [("good", "été")] and "bad.txt" in caplog.text
    originals, pairs = (spark.createDataFrame([(i, "aB:1") for i in ids], "artifact_id string, raw_text string") for ids in ("xy", "xz"))
    with caplog.at_level(logging.WARNING):
        docs, _ = R.combine_preprocessed(originals, pairs)
    assert [r["artifact_id"] for r in docs.collect()] == ["x"] and "left out: z" in caplog.text


def test_base_text_is_extended(spark):
    from tracelark.operators import enrich as E

    docs = lambda i, base: spark.createDataFrame([(i, "whole text", base, "x")], "artifact_id string, raw_text string, base_text string, ir_text string")
    votes = spark.createDataFrame([("s", "one two", 3.0)], "artifact_id string, biterm string, vote double")
    seen = []

    def model(a, b):
        seen.extend(r["ir_text"] for x in (a, b) for r in x.collect())
        return spark.createDataFrame([], "source_id string, target_id string, score double")

    E.enriched_links(docs("s", "base"), docs("t", None), votes, votes.limit(0), model, lambda d: d.withColumn("ir_text", d.raw_text)).collect()
    assert "base\none two one two one two " in seen and "whole text" in seen


def test_sparse_union_is_the_union(spark):
    def docs(p, texts):
        return spark.createDataFrame([(f"{p}{i}", t) for i, t in enumerate(texts)], "artifact_id string, ir_text string")

    s, t = docs("s", ["a b c", "d e", "", "f"]), docs("t", ["a c", "", "e e d", "g", None])
    dense, sparse = ({(r["source_id"], r["target_id"]): r["score"] for r in models.union(s, t, x).collect()} for x in (True, False))
    assert dense.keys() == sparse.keys() and all(dense[k] == pytest.approx(sparse[k]) for k in dense) and ("s2", "t1") in dense


def test_matrix_of_many_targets(spark, tmp_path):
    links = spark.range(12_000).selectExpr("concat('s', id % 3) source_id", "concat('t,', id) target_id", "id / 12000d score")
    W.write_link_matrix(links, str(tmp_path / "m"))
    lines = spark.read.text(str(tmp_path / "m")).collect()
    assert len(lines) == 4 and lines[0][0].startswith('Source Artifact,"t,0","t,1","t,10"') and lines[0][0].count('"t,') == 12_000
    assert [x[0].split(",", 1)[0] for x in lines[1:]] == ["s0", "s1", "s2"] and all(x[0].count(",") == 12_000 for x in lines[1:])


def test_running_sums_over_slices(spark):
    import random

    r = random.Random(1)
    rows = sorted({round(r.uniform(-0.5, 1.5), 3) for _ in range(500)})
    df = spark.createDataFrame([(x, i % 5) for i, x in enumerate(rows)], "score double, n long")
    for down in (False, True):
        order = sorted(((x, i % 5) for i, x in enumerate(rows)), reverse=down)
        want, total = {}, 0
        for x, n in order:
            want[x] = total
            total += n
        assert {y["score"]: y["n0"] for y in V._before(df, "score", {"n": "n0"}, down).collect()} == want


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    with pytest.raises(ValueError):
        shared_folder(N(sparkContext=N(master="yarn"), conf=N(get=lambda k, v=None: None)))
