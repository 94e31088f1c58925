"""Connected components of an edge table, by least label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import _store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the least node that node reaches. Each round is stored in the shared folder; nothing of the graph comes to the driver."""
    spark = edges.sparkSession
    path_e = _store.store(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    both = _store.reread(spark, path_e)
    path = _store.store(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("comp")), "labels")
    while True:
        labels = _store.reread(spark, path)
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("comp").alias("m"))
        low = labels.join(near, labels.node == near.u).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("low"))
        up = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        new = low.join(up, F.col("low") == F.col("n2"), "left").select("node", "old", F.least("low", F.coalesce("c2", "low")).alias("comp"))
        nxt = _store.store(new, "labels")
        _store.drop(spark, path)
        path = nxt
        if not _store.reread(spark, path).where("comp < old").limit(1).count():
            break
    _store.drop(spark, path_e)
    return _store.reread(spark, path).select("node", "comp")
