import json

import pytest

from tracelark.functions.codescan import code_ir_text, code_pairs, scan_c, scan_java
from tracelark.functions.phrases import edges_from_text, phrase_pairs
from tracelark.operators import models
from tracelark.plans.config import Config
from tracelark.plans.pipeline import main, run_full
from tracelark.sources import readers as R, writers as W
from tracelark.streaming.terms import term_counts

JAVA = '''package a; import b.C;
/** Manages flight routes. */
public class FlightManager extends Base {
  private RouteList homeRoutes = new RouteList("a;b", 1), other;
  // ignored comment
  @Override public void assignRoute(DroneState droneState, int n) throws IOException { homeRoutes.addRoute(droneState); stopNow(); this.x.callMe(); }
}'''
C_SOURCE = '''#include <a.h>
/* the request code */
struct est_client { int x; };
static int send_request(SSL_CTX *ssl_ctx, int len) { int rv = 0; rv = est_write(ssl_ctx); return rv; }'''


def test_scanners():
    found = scan_java(JAVA)
    assert {("type", "FlightManager", 2), ("method", "assignRoute", 2), ("parameter", "droneState", 1), ("parameter_type", "DroneState", 1), ("field_type", "RouteList", 1), ("field", "homeRoutes", 1), ("call", "homeRoutes", 1), ("call", "stopNow", 1), ("call", "callMe", 1)} <= set(found)
    assert sum(k == "comment" for k, *_ in found) == 1
    found = scan_c(C_SOURCE)
    assert {("type", "est_client", 2), ("function", "send_request", 2), ("parameter", "ssl_ctx", 1), ("parameter_type", "SSL_CTX", 1), ("parameter_type", "int", 1), ("call", "est_write", 1), ("declarator", "rv", 1)} <= set(found)
    assert scan_java("") == [] and scan_c("}}}((") is not None and scan_java("class {{{ ((") is not None


def test_code_tables(spark):
    a = spark.createDataFrame([("J", "JAVA_CODE", JAVA), ("C", "C_CODE", C_SOURCE)], "artifact_id string, type string, raw_text string")
    text = {r["artifact_id"]: r["ir_text"] for r in code_ir_text(a.where("type = 'JAVA_CODE'"), stemmed=False).collect()}
    assert "flight manager" in text["J"] and "assign route" in text["J"] and "ignored" not in text["J"]
    pairs = {(r["artifact_id"], r["canonical"]): r["weight"] for r in code_pairs(a, stemmed=False).collect()}
    assert pairs["J", "flightManager"] == 2 and pairs["J", "assignRoute"] == 2 and pairs["C", "sendRequest"] == 2


def test_phrase_rules(spark):
    e = spark.createDataFrame([
        ("a", 0, "pattern", "NN", "flight", "NN", "compound"), ("a", 0, "code", "NN", "source", "NN", "compound"), ("a", 0, "compile", "VB", "code", "NN", "obj"),
        ("a", 0, "thing", "NN", "context", "NN", "compound"), ("a", 0, "use", "VB", "drone", "NN", "nmod:for"), ("a", 0, "go", "VB", "drone", "NN", "nmod:for"), ("a", 0, "the", "DT", "drone", "NN", "obj"),
    ], "artifact_id string, sentence int, gov string, gov_pos string, dep string, dep_pos string, rel string")
    got = {r["canonical"]: r["weight"] for r in phrase_pairs(e, stemmed=False, stopwords=()).collect()}
    assert got == {x: 1 for x in ("patternFlight", "flightPattern", "codeSource", "sourceCode", "compileSource", "sourceCompile", "useDrone", "droneUse")}
    made = edges_from_text(spark.createDataFrame([("a", "The system shall store the flight pattern.")], "artifact_id string, raw_text string"))
    assert ("pattern", "flight", "compound") in {(r["gov"], r["dep"], r["rel"]) for r in made.collect()}


def test_readers(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "RE-1.v2.txt").write_text("one")
    (tmp_path / "d" / "sub" / "b.h").write_text("last")
    (tmp_path / "d" / "b.c").write_text("first")
    got = {r["artifact_id"]: r["raw_text"] for r in R.read_artifacts(spark, str(tmp_path / "d")).collect()}
    assert got == {"RE-1.v2": "one", "b": "last"}
    assert R.read_artifacts(spark, None).count() == 0
    with pytest.raises(ValueError):
        R.read_artifacts(spark, "x", "PASCAL")
    g = tmp_path / "gold.txt"
    g.write_text("# c\n\nA B\nA , B\nC,D,E\nsingle\n  F\tG \n")
    assert sorted(map(tuple, R.read_gold(spark, str(g)).collect())) == [("A", "B"), ("C", "D"), ("F", "G")]
    for bad, error in ((None, ValueError), (str(tmp_path), ValueError), (str(tmp_path / "no"), FileNotFoundError)):
        with pytest.raises(error):
            R.read_gold(spark, bad)
    p = spark.createDataFrame([("x", "returnHome:3\r\nabcdef:1\nab:2\nbad\nw: 3\nq:z\n")], "artifact_id string, raw_text string")
    pairs = R.parse_pairs(p)
    assert {(r["term1"], r["term2"], r["weight"]) for r in pairs.collect()} == {("return", "Home", 3), ("abc", "def", 1), ("ab", "ab", 2)}
    assert R.text_of_pairs(pairs).first()["ir_text"] == "returnHome returnHome returnHome abcdef ab ab"
    o = spark.createDataFrame([("x", "Some text"), ("y", "none")], "artifact_id string, raw_text string")
    docs, kept = R.combine_preprocessed(o, p)
    assert [r["artifact_id"] for r in docs.collect()] == ["x"] and kept.count() == 3
    (tmp_path / "stop").write_text("a\n b \n\n")
    assert R.read_stopwords(spark, str(tmp_path / "stop")) == ("a", "b")


def test_writers_and_batch(spark, tmp_path):
    for role, files in {"s": {"r1.txt": "flight route planning", "r2.txt": "battery charge"}, "m": {"d1.txt": "route planner design", "d2.txt": "battery design"}, "t": {"c1.txt": "class plans the flight route", "c2.txt": "charges a battery"}}.items():
        (tmp_path / role).mkdir()
        for n, x in files.items():
            (tmp_path / role / n).write_text(x)
    (tmp_path / "gold.txt").write_text("r1 c1\nr2 c2\n")
    part = lambda x: {"path": str(tmp_path / x), "type": "TEXTUAL"}
    project = {"name": "p", "source": part("s"), "intermediate": part("m"), "target": part("t"), "goldStandardPath": str(tmp_path / "gold.txt")}
    config = {"doEvaluate": True, "irMethod": "VSM", "runTriad": False, "projects": [project]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert Config.load(str(tmp_path / "c.json")).projects[0].intermediate.path == str(tmp_path / "m")
    from pyspark.sql import SparkSession

    assert SparkSession.getActiveSession() is spark
    assert main([str(tmp_path / "c.json"), str(tmp_path / "out")]) == 0 and main([]) == 2
    summary = spark.read.csv(str(tmp_path / "out" / "evaluation_summary"), header=True).first()
    assert summary["Project"] == "p" and summary["Recall"] == "1.0000" and summary["MAP"] == "1.0000"
    matrix = spark.read.csv(str(tmp_path / "out" / "p" / "similarities"), header=True)
    assert matrix.columns == ["Source Artifact", "c1", "c2"] and matrix.count() == 2
    from tracelark.plans.pipeline import load_corpus

    c = Config.of(config).projects[0]
    s, m, t = (load_corpus(spark, x, r)[0] for x, r in ((c.source, "source"), (c.intermediate, "intermediate"), (c.target, "target")))
    for mid in (m, None):
        got = {(r["source_id"], r["target_id"]): r["score"] for r in run_full(s, mid, t, all_pairs=models.vsm).collect()}
        assert got["r1", "c1"] > got.get(("r1", "c2"), 0) and got["r2", "c2"] > got.get(("r2", "c1"), 0)
    links = spark.createDataFrame([("a", "b", 0.5)], "source_id string, target_id string, score double")
    W.write_links(links, str(tmp_path / "l"))
    assert spark.read.csv(str(tmp_path / "l"), header=True).first()["Score"] == "0.5000"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a b a",), ("b",)], "ir_text string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ir_text string").parquet(str(tmp_path / "in"))
    q = term_counts(stream).writeStream.format("memory").queryName("terms").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert {r["term"]: r["n"] for r in spark.table("terms").collect()} == {"a": 2, "b": 2}


def test_matrix_rows_of_many_targets(spark):
    # a look-up that goes through a row's links for each target would take minutes here
    targets = [f"t{i:06}" for i in range(40_000)]
    links = spark.range(80_000).selectExpr("concat('s', id % 2) source_id", "format_string('t%06d', id div 2) target_id", "(id div 2) / 40000 score").where("score >= 0.25").unionByName(spark.createDataFrame([("s0", "t000001", None)], "source_id string, target_id string, score double"))
    got = {r["source_id"]: r["scores"] for r in W.link_rows(links, targets).collect()}
    assert sorted(got) == ["s0", "s1"] and all(x == ["0.0000"] * 10_000 + [f"{i / 40_000 + 1e-12:.4f}" for i in range(10_000, 40_000)] for x in got.values())
