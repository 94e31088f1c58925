"""The pipeline against a brute-force version over a small corpus."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from tracelark.llm import ordinal_quality as O

from .test_text_operators import brute_components, brute_hits, brute_rules, edited, prose, ws


def test_pipeline(spark, tmp_path):
    r = random.Random(9)
    base = [prose(r.randint(70, 120)) for _ in range(60)]
    item = " ".join(base[7].split()[5:40])
    texts = base + base[:6] + [edited(t, 1) for t in base[10:20]] + ["short text", None, "### $$$ %%% &&& " * 40] * 4 + [t + "\n" + item for t in base[30:33]] + [item + " " + item.upper() + " " + prose(10)]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts) if t and i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "jaccard_join", "decontamination", "packing"]
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(x["doc_id"], 0)
        got[x["doc_id"]] += x["tokens"]

    kept = [(i, t) for i, t in enumerate(texts) if not brute_rules(t)[5]]  # no host fails here
    model = O.train(spark.createDataFrame(kept, "doc_id long, text string"), O.graded(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    kept = [(i, t) for i, t in kept if model.tails(O.Hasher(), t)[0] >= O.KEEP]
    kept = [x for x, (i, _, c) in zip(kept, brute_components(kept)) if i == c]
    want = {}
    for i, t in kept:
        n, hit, _ = brute_hits(t, [(1, item)])
        if hit <= 0.5 * n:
            want[i] = len(ws(t)) - hit
    assert got == want and 7 in want and len(texts) - 1 not in want and 30 in want


def write(spark, folder, docs, items=(), labels=()):
    docs.write.mode("overwrite").parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.mode("overwrite").parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(folder / "labels.parquet"))
    return str(folder)


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_without_rows(spark, tmp_path):
    got = corpus_pipeline.run(spark, write(spark, tmp_path, spark.createDataFrame([], KIND)))
    assert got.count() == 0 and {"doc_id", "piece", "text", "bin", "capacity"} <= set(got.columns)


def test_pipeline_nulls_ties_long_texts_and_foreign_columns(spark, tmp_path):
    r = random.Random(4)
    a, b = prose(80), prose(90)
    long = " ".join(f"{x}{r.randrange(10 ** 6)}" for x in prose(9000).split())
    rows = [(3, a, None, None, None), (2, a, "en", "s", 1), (2, a, "en", "s", 1), (None, b, None, None, None), (None, None, None, None, None), (7, "", "", "", 0), (8, long, "en", "s", 5)]
    docs = spark.createDataFrame(rows, KIND).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("_w", "_h", "_host", "_text", "_d", "_t", "_kd", "kept", "n_words", "items", "row", "text2")})
    folder = write(spark, tmp_path, docs)
    got = corpus_pipeline.run(spark, folder).orderBy("piece").collect()
    texts = {}
    for x in got:
        texts.setdefault(x["doc_id"], []).append(x["text"])
    assert {k: "".join(v) for k, v in texts.items()} == {2: a, None: b, 8: long}
    # the stages one by one keep every column as it is
    step = spark.read.parquet(folder + "/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, step, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/step{k}")
        step = spark.read.parquet(f"{tmp_path}/step{k}")
        assert step.where("doc_id is not null and (_w <> concat('_w', doc_id) or n_words <> concat('n_words', doc_id) or items <> concat('items', doc_id))").count() == 0


def test_pipeline_leaves_only_what_its_result_reads(spark, tmp_path):
    from tracelark.llm import _store

    before = set(_store.since())
    docs = spark.createDataFrame([(i, prose(70), "en", "s", 1) for i in range(12)], KIND)
    out = corpus_pipeline.run(spark, write(spark, tmp_path, docs))
    assert out.count() == 12 and len(set(_store.since()) - before) <= 2
