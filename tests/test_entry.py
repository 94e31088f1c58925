import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns == ["source_id", "target_id", "score"]
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len([k for k in q if k not in o and not k.startswith("op") and k != "pipeline"]) <= 3  # stems and the two models with singular values
