"""Writers of links and evaluations. Numbers have decimal points, folders are made by Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.text import score_text


def link_matrix(links: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """The pivot of links: `Source Artifact` and a column for each target, scores as %.4f, 0 where there is no link."""
    p = links.groupBy(F.col("source_id").alias("Source Artifact"))
    p = (p.pivot("target_id", targets) if targets else p.pivot("target_id")).agg(F.first("score")).na.fill(0.0)
    cols = sorted(c for c in p.columns if c != "Source Artifact")
    return p.select("Source Artifact", *[score_text(F.col(f"`{c}`")).alias(c) for c in cols]).orderBy("Source Artifact")


def link_rows(links: DataFrame, targets: list[str]) -> DataFrame:
    """source_id and its scores as text in the order of targets. A row is filled by the places of its links, so targets may be many."""
    shared = links.sparkSession.sparkContext.broadcast(pa.array(targets, pa.string()))

    def row(key, got):
        at = pc.index_in(got["target_id"], value_set=shared.value).to_numpy()
        cells = np.full(len(shared.value), "0.0000", object)
        there = ~np.isnan(at)
        cells[at[there].astype(int)] = got["score"].to_numpy()[there]
        return pa.table({"source_id": [key[0].as_py()], "scores": pa.array([cells], pa.list_(pa.string()))})

    return links.select("source_id", "target_id", score_text(F.coalesce("score", F.lit(0.0))).alias("score")).groupBy("source_id").applyInArrow(row, "source_id string, scores array<string>")


def _quoted(c):
    return F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_link_matrix(links: DataFrame, path: str) -> None:
    """One CSV file: the header `Source Artifact` and the sorted targets, then the sorted sources. Its rows are made in parallel; only the last step is one task."""
    targets = sorted(r[0] for r in links.select("target_id").distinct().collect())  # they are the file's first line
    lines = link_rows(links, targets).select(F.col("source_id").alias("k"), F.concat_ws(",", F.array(_quoted(F.col("source_id"))), "scores").alias("value"))
    head = links.sparkSession.createDataFrame([(None, ",".join('"' + t.replace('"', '""') + '"' if any(c in t for c in '",\r\n') else t for t in ["Source Artifact", *targets]))], "k string, value string")
    lines.unionByName(head).repartition(1).sortWithinPartitions(F.asc_nulls_first("k")).select("value").write.mode("overwrite").text(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("canonical").distinct().write.mode("overwrite").text(path)


def write_links(links: DataFrame, path: str) -> None:
    links.select(F.col("source_id").alias("Source"), F.col("target_id").alias("Target"), score_text(F.col("score")).alias("Score")).write.mode("overwrite").csv(path, header=True)


def write_pr_curve(curve: DataFrame, path: str, approach: str) -> None:
    out = curve.orderBy("recall_level").select(F.lit(approach).alias("Approach"), F.format_string("%.2f", "recall_level").alias("Recall"), F.format_string("%.4f", "precision").alias("Precision"))
    out.coalesce(1).write.mode("append").csv(path, header=True)


def write_summary(prf: DataFrame, mean_ap: DataFrame, path: str, project: str, approach: str) -> None:
    out = prf.crossJoin(mean_ap).select(F.lit(project).alias("Project"), F.lit(approach).alias("Approach"), *[score_text(F.col(c)).alias(n) for c, n in (("precision", "Precision"), ("recall", "Recall"), ("f1", "F1"), ("map", "MAP"))])
    out.coalesce(1).write.mode("append").csv(path, header=True)


def write_sweep(sweep: DataFrame, path: str, project: str, approach: str) -> None:
    """A threshold sweep or a top-k sweep (the k stands in the column Threshold)."""
    by = "threshold" if "threshold" in sweep.columns else "k"
    at = score_text(F.col(by)) if by == "threshold" else F.col(by).cast("string")
    out = sweep.orderBy(by).select(F.lit(approach).alias("Approach"), F.lit(project).alias("Project"), at.alias("Threshold"), *[score_text(F.col(c)).alias(n) for c, n in (("precision", "Precision"), ("recall", "Recall"), ("f1", "F1"))], F.col("amount").alias("Amount"))
    out.coalesce(1).write.mode("append").csv(path, header=True)
