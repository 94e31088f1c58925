"""Documents to packed training sequences, in five stages.

All stages but the last return the columns of documents, whatever further columns there are and whatever their names. The last
returns the pieces of the documents with their text and their place in the sequences.

Defined results: null, blank and short texts fail the quality rules. Without labels nothing is rejected by the classifier. Of near
duplicates and of repeated rows the one with the smallest id stays (ties: the least hash of the text), once. Rows with a null id are documents like others.
Without benchmark items nothing is cut. A very long text is cut into pieces at the end, whole. No documents give an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tracelark.llm import _store, decontamination, jaccard_join, ordinal_quality, packing, quality_rules


_left: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the stages before it have stored for themselves: their rows are written by now, and are its docs."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _store.sweep(spark, _left, docs)
        there = set(_store.since())
        out = work(spark, docs, sf_dir)
        _left[:] = [p for p in _store.since() if p not in there or p in _left]
        return out

    return run_stage


@_stage
def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, their own and their host's."""
    return quality_rules.passing(docs)


@_stage
def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, trained on the labels, does not reject."""
    model = ordinal_quality.train(docs, ordinal_quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return ordinal_quality.good(docs, model)


@_stage
def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    return jaccard_join.one_of_each(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; those that consist of such passages go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_quality),
    ("jaccard_join", keep_one_copy),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: The classifier and the automaton are no SQL: tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _left.clear()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _store.durable(docs, name)
            _left.extend(_store.since()[-1:])
    _left.clear()  # what is left is read by the result
    return docs
