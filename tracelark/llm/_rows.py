"""Rows of the caller as one column, so that no name of theirs can clash with an operator's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, columns: list[str] | None = None, **more: Column) -> DataFrame:
    """docs (or its columns named here) as one struct column `row`, and the columns given in `more`."""
    columns = docs.columns if columns is None else columns
    row = F.struct(*[col(c).alias(c) for c in columns]) if columns else F.struct(F.lit(0).alias("none"))
    return docs.select(row.alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], *more: str, text: str | None = None) -> DataFrame:
    """The caller's columns as they were, then those of df named in `more`; an own column of such a name gives way.

    text: a column of the caller that df carries beside `row`, as `text`.
    """
    own = lambda c: F.col("text") if c == text else F.col("row").getField(c)
    return df.select(*[own(c).alias(c) for c in columns if c not in more], *[F.col(c) for c in more])
