"""Block-encoded records and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbers(text: Column) -> Column:
    """A comma list as an array of whole numbers; one comma at the end is allowed."""
    return F.split(F.regexp_replace(text, ",$", ""), ",").cast("array<bigint>")


def expand(records: DataFrame, *, sizes: str = "sizes", starts: str = "starts", scores: str | None = None, count: str | None = "block_count", sentinels: bool = True, per: str | None = None, size: tuple[int, int] | None = None, least_score: float | None = None) -> DataFrame:
    """One row per block: the record's other columns, ``block``, ``lo``, ``hi`` and, if given, ``score``.

    A record whose lists disagree in length with each other or with ``count`` is an error.  ``sentinels`` drops the
    first and last block by position: of each record, or, with ``per``, of all records of that key taken in order.
    ``size`` keeps lengths within closed bounds.
    """
    lists = {"size": numbers(F.col(sizes)), "off": numbers(F.col(starts))}
    if scores:
        lists["score"] = numbers(F.col(scores))
    for name, column in lists.items():
        records = records.withColumn(f"__{name}", column)
    n = F.size("__size")
    agree = F.size("__off") == n
    if scores:
        agree = agree & (F.size("__score") == n)
    if count:
        agree = agree & (F.col(count) == n)
    drop = {sizes, starts, *([scores] if scores else []), *([count] if count else [])}
    kept = [c for c in records.columns if c not in drop and not c.startswith("__") and c not in ("lo", "hi")]
    zipped = F.arrays_zip(*(F.col(f"__{x}") for x in lists))
    checked = F.when(agree, zipped).otherwise(F.raise_error(F.lit("block lists of different lengths")))
    rows = records.select(*kept, F.col("lo").alias("__base"), n.alias("__n"), F.posexplode(checked).alias("block", "__b"))
    if sentinels and not per:
        rows = rows.where((F.col("block") > 0) & (F.col("block") < F.col("__n") - 1))
    elif sentinels:
        w = Window.partitionBy(per)
        place = F.struct("__base", "block")
        rows = rows.withColumn("__p", place).where("true").withColumn("__f", F.min("__p").over(w)).withColumn("__l", F.max("__p").over(w)).where("__p <> __f AND __p <> __l")
    low, high = size or (None, None)
    if size:
        rows = rows.where(F.col("__b.__size").between(low, high))
    if least_score is not None:
        rows = rows.where(F.col("__b.__score") >= least_score)
    out = [*kept, "block", (F.col("__base") + F.col("__b.__off")).alias("lo"), (F.col("__base") + F.col("__b.__off") + F.col("__b.__size")).alias("hi")]
    return rows.select(*out, *([F.col("__b.__score").alias("score")] if scores else []))


def longest(df: DataFrame, *, key: str = "read", order: tuple[str, ...] = ("lo",)) -> DataFrame:
    """Of each key's rows the longest; ties go to the first in ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(F.col("hi") - F.col("lo")), *order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def valid_blocks(blocks: Column, length: Column) -> Column:
    """Whether an array of (off, size) is sorted, without overlaps and inside its record; empty blocks do not count."""
    solid = F.filter(blocks, lambda b: b["size"] > 0)
    ordered = F.forall(F.sequence(F.lit(1), F.size(solid)), lambda i: (i == 1) | (F.element_at(solid, i)["off"] >= F.element_at(solid, F.greatest(i - 1, F.lit(1)))["off"] + F.element_at(solid, F.greatest(i - 1, F.lit(1)))["size"]))
    inside = F.forall(solid, lambda b: (b["off"] >= 0) & (b["off"] + b["size"] <= length))
    return F.when(F.size(solid) == 0, True).otherwise(ordered & inside)


def size_class(size: Column, breaks: list[int], *, half_open: bool = False, names: list[str] | None = None) -> Column:
    """The class of a size among bins; null outside.

    ``breaks`` are bounds in pairs (10, 30, 30, 60).  Closed bins by default, a shared bound belonging to the upper one;
    ``half_open`` leaves each upper bound out."""
    out: Column | None = None
    pairs = list(zip(breaks[::2], breaks[1::2]))
    for k, (low, high) in reversed(list(enumerate(pairs))):
        hit = (size >= low) & ((size < high) if half_open else (size <= high))
        name = names[k] if names else f"{low}-{high} bp"
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def relative(lo: Column, hi: Column, anchor: Column, strand: Column) -> tuple[Column, Column]:
    """A half-open interval as closed positions relative to a 0-based anchor, mirrored on the minus strand."""
    a, b = lo - anchor, hi - 1 - anchor
    minus = strand == "-"
    return F.when(minus, -b).otherwise(a), F.when(minus, -a).otherwise(b)


def strand_sign(strand: Column) -> Column:
    return F.when(strand == "-", -1).otherwise(1)


def tss(lo: Column, hi: Column, strand: Column) -> Column:
    """0-based 5' end."""
    return F.when(strand == "-", hi - 1).otherwise(lo)


def window(anchor: Column, strand: Column, before: int, after: int) -> tuple[Column, Column]:
    """Half-open window of ``before`` bases upstream of an anchor to ``after`` downstream of it, never below 0."""
    low = F.when(strand == "-", anchor - after).otherwise(anchor - before)
    high = F.when(strand == "-", anchor + before + 1).otherwise(anchor + after + 1)
    return F.greatest(low, F.lit(0)), high


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTNacgtn", "TGCANtgcan"))


def cpg_ratio(sequence: Column) -> Column:
    """Observed over expected CpG; null without C or G."""
    s = F.upper(sequence)
    n = {x: F.length(s) - F.length(F.replace(s, F.lit(x))) for x in ("C", "G")}
    pairs = (F.length(s) - F.length(F.replace(s, F.lit("CG")))) / 2
    return F.when((n["C"] > 0) & (n["G"] > 0), pairs * F.length(s) / (n["C"] * n["G"]))


def grid(lo: Column, hi: Column, step: int, first: int, last: int) -> Column:
    """Positions of a grid that a closed interval covers, clamped to the grid's ends; an empty array for none."""
    a, b = F.greatest(F.ceil(lo / step) * step, F.lit(first)), F.least(F.floor(hi / step) * step, F.lit(last))
    return F.when(a <= b, F.sequence(a, b, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
