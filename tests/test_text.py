import random

import pytest
from pyspark.sql import functions as F

from tracelark.functions import text as X
from tracelark.functions.stemmer import stem


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("word, out", [
    ("flight", "flight"), ("manager", "manag"), ("service", "servic"), ("consistency", "consist"), ("knightly", "knight"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"),
    ("luxuriated", "luxuri"), ("hopped", "hop"), ("hoped", "hope"), ("hopping", "hop"), ("say", "say"), ("by", "by"), ("cry", "cri"), ("generously", "generous"), ("relational", "relat"), ("skies", "sky"), ("dying", "die"), ("succeed", "succeed"),
    ("controlling", "control"), ("sensational", "sensat"), ("electricity", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("news", "news"),
])
def test_stem(word, out):
    assert stem(word) == out


def test_process_text(spark):
    assert one(spark, "FlightManagerService", X.process_text) == "flight manag servic"
    assert one(spark, None, X.process_text) == "" and one(spark, " \t", X.process_text) == ""
    assert one(spark, "The UAVs_2 shall-fly é x", lambda c: X.process_text(c, stemmed=False)) == "uav fly"


def test_splits(spark):
    assert one(spark, "parseXMLDoc", X.split_camel) == "parse XML Doc"
    assert one(spark, "UAVs", X.split_acronyms) == "UAV s"
    assert one(spark, "UAVsFoo", X.split_camel) == "UAV s Foo"
    assert one(spark, "snake_case", X.process_word) == "snake case"
    assert one(spark, "GPSs", lambda c: X.process_word(c, stemmed=False)) == "gps"


def test_cleaned_words_are_cut_as_raw_words(spark):
    r = random.Random(5)
    rows = [("".join(r.choices("aabsssABSSUV  _.9é\n", k=r.randint(0, 30))),) for _ in range(3000)] + [("UAVs UAVsUAVs XMLs",), ("",), (None,)]
    c = X.clean_characters(F.coalesce(F.col("x"), F.lit("")))
    got = spark.createDataFrame(rows, "x string").select(F.array_join(X.clean_words(c), " ").alias("a"), F.array_join(X.raw_words(c), " ").alias("b"))
    assert all(x["a"] == x["b"] for x in got.collect())
    both = spark.createDataFrame(rows, "x string").select(X.split_acronyms(c).alias("a"), F.trim(F.regexp_replace(F.regexp_replace(c, r"(?<=\p{Lu})s(?=$|\s|\p{Lu})", " s "), " {2,}", " ")).alias("b"), X._less_final_s(c).alias("d"), F.regexp_replace(c, r"(?<=\p{Lu})s(?=\s|$)", "").alias("e"))
    assert all(x["a"] == x["b"] and x["d"] == x["e"] for x in both.collect())


def test_pairs_and_tags(spark):
    df = spark.createDataFrame([("flight", "pattern"), ("", "x"), ("y", None)], "a string, b string")
    assert [r[0] for r in df.select(X.canonical(F.col("a"), F.col("b"))).collect()] == ["flightPattern", "x", "y"]
    assert one(spark, "Return_home now", X.normalised_pair) == ["return", "home"] and one(spark, "one", X.normalised_pair) is None
    assert one(spark, "[summary]a-b", X.strip_tags) == " a b"
    assert one(spark, "/** Does it.\n * And more.\n */", X.clean_javadoc) == "Does it. And more."
    assert one(spark, "// no", X.clean_javadoc) == ""
    assert one(spark, 0.5, X.score_text, "double") == "0.5000"


def test_lemmas_and_relations(spark):
    from tracelark.functions.phrases import relations

    assert one(spark, "mice ran off", lambda c: X.lemmatise(c, {"mice": "mouse", "ran": "run"})) == "mouse run off"
    e = spark.createDataFrame([("a", 0, "x", "NN", "y", "NN", "obj"), ("a", 1, "x", "NN", "y", "NN", "amod")], "artifact_id string, sentence int, gov string, gov_pos string, dep string, dep_pos string, rel string")
    assert [tuple(r) for r in relations(e).collect()] == [("a", "'x' -> 'y'", "amod")]
