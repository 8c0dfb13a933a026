"""Predicates, row selection and set operations that are more than one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_class(first: Column, second: Column, classes: Sequence[str] | None, how: str = "either") -> Column:
    """Whether a pair's classes match: ``either`` side, ``both`` sides, or the unordered ``pair`` itself; None is all."""
    if classes is None:
        return F.lit(True)
    if how == "either":
        return first.isin(*classes) | second.isin(*classes)
    if how == "both":
        return first.isin(*classes) & second.isin(*classes)
    if how == "pair" and len(classes) == 2:
        a, b = classes
        return ((first == a) & (second == b)) | ((first == b) & (second == a))
    raise ValueError(f"unknown way of matching classes: {how}")


def top(df: DataFrame, n: int, *, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first ``n`` rows of each key in a total order, with ``place``.  Spark prunes before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def representatives(df: DataFrame, *, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first, middle (``ceil(n / 2)``) and last row of each key."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("place", F.row_number().over(w)).withColumn("n", n).where((F.col("place") == 1) | (F.col("place") == F.ceil(F.col("n") / 2)) | (F.col("place") == F.col("n")))


def sampled(df: DataFrame, n: int, *, key: str, seed: int = 1) -> DataFrame:
    """``n`` rows by the order of a hash of ``key`` and a seed: the same draw wherever and however often it runs."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def spaced(df: DataFrame, *, distance: int, position: str = "lo", chrom: str = "chrom", order: Sequence[str], most: int, batch: int = 1000) -> DataFrame:
    """Greedy choice of at most ``most`` rows in a total order, none within ``distance`` of a chosen one on its chromosome.

    The driver sees ``batch`` rows at a time, the first of those that no chosen row rules out; as the very first of them is
    always chosen, there are at most ``most`` steps.  Rows without a chromosome or position are never chosen."""
    chosen: list = []
    rest = df.where(F.col(chrom).isNotNull() & F.col(position).isNotNull())
    while len(chosen) < most:
        rows, before = rest.orderBy(*order).limit(batch).collect(), len(chosen)
        for r in rows:
            if len(chosen) < most and all(c[chrom] != r[chrom] or abs(c[position] - r[position]) > distance for c in chosen):
                chosen.append(r)
        if len(rows) < batch:
            break
        for c in chosen[before:]:
            rest = rest.where((F.col(chrom) != F.lit(c[chrom])) | (F.abs(F.col(position) - F.lit(c[position])) > distance))
    return df.sparkSession.createDataFrame(chosen, df.schema)


def complete_rows(cells: DataFrame, *, row: str, column: str, value: str) -> DataFrame:
    """Cells of the rows without a missing value, then of the columns that are not all zero among these."""
    good = cells.groupBy(row).agg(F.count_if(F.col(value).isNull()).alias("__n")).where("__n = 0").select(row)
    kept = cells.join(good, row, "left_semi")
    live = kept.groupBy(column).agg(F.max(F.abs(value)).alias("__m")).where("__m > 0").select(column)
    return kept.join(live, column, "left_semi")


def same_set(a: DataFrame, b: DataFrame) -> None:
    """Raises unless two tables hold the same distinct rows."""
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("the tables differ")


def overlap_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two sets' parts: only the first, both, only the second."""
    x, y = a.select(key).distinct().withColumn("x", F.lit(1)), b.select(key).distinct().withColumn("y", F.lit(1))
    return x.join(y, key, "full").agg(F.count_if(F.col("y").isNull()).alias("only_first"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count_if(F.col("x").isNull()).alias("only_second"))
