"""Relations between intervals.

Intervals are 0-based and half-open: ``chrom``, ``lo``, ``hi``.  Range predicates alone would plan as nested loops, so
both sides are spread over bins of a fixed width and joined on (chromosome, bin); a pair that shares several bins counts
in the first of them.  Bins, not chromosomes, are what is shuffled, so a large chromosome is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Near the median span of what is joined, an interval falls into one or two bins.
BIN = 2_000
#: Running values go over buckets of this many positions first, then over one row per bucket.
BUCKET = 1_000_000


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns))


def _bins(lo: str, hi: str, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))


def overlap_join(left: DataFrame, right: DataFrame, *, on: Sequence[str] = ("chrom",), width: int = BIN, prefixes: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """All pairs that share a base and agree on ``on``; columns of both sides, prefixed, and ``overlap``.

    Empty intervals overlap nothing."""
    p, q = prefixes
    a = _prefixed(left.where("hi > lo"), p).withColumn("__bin", _bins(f"{p}lo", f"{p}hi", width))
    b = _prefixed(right.where("hi > lo"), q).withColumn("__bin", _bins(f"{q}lo", f"{q}hi", width))
    keys = [F.col(f"{p}{c}") == F.col(f"{q}{c}") for c in on]
    a, b = a.alias("x"), b.alias("y")
    cond = F.col("x.__bin") == F.col("y.__bin")
    for k in keys:
        cond = cond & k
    meet = (F.col(f"{p}lo") < F.col(f"{q}hi")) & (F.col(f"{q}lo") < F.col(f"{p}hi"))
    first = F.col("x.__bin") == F.floor(F.greatest(f"{p}lo", f"{q}lo") / width)
    width_ = F.least(f"{p}hi", f"{q}hi") - F.greatest(f"{p}lo", f"{q}lo")
    return a.join(b, cond & meet & first).drop("__bin").withColumn("overlap", width_)


def point_join(points: DataFrame, intervals: DataFrame, *, pos: str = "pos", width: int = BIN, on: Sequence[str] = ("chrom",), prefixes: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Pairs of a position and an interval that holds it.  A point is in one bin, so nothing is spread on its side."""
    p, q = prefixes
    a = _prefixed(points, p).withColumn("__bin", F.floor(F.col(f"{p}{pos}") / width)).alias("x")
    b = _prefixed(intervals.where("hi > lo"), q).withColumn("__bin", _bins(f"{q}lo", f"{q}hi", width)).alias("y")
    cond = F.col("x.__bin") == F.col("y.__bin")
    for c in on:
        cond = cond & (F.col(f"{p}{c}") == F.col(f"{q}{c}"))
    return a.join(b, cond & (F.col(f"{p}{pos}") >= F.col(f"{q}lo")) & (F.col(f"{p}{pos}") < F.col(f"{q}hi"))).drop("__bin")


def containment_join(inner: DataFrame, outer: DataFrame, **options) -> DataFrame:
    """Pairs whose first interval lies within the second.  The inner side only needs its first bin."""
    pos = inner.where("hi > lo").withColumn("__at", F.col("lo"))
    got = point_join(pos, outer, pos="__at", **options)
    p, q = options.get("prefixes", ("a_", "b_"))
    return got.where(F.col(f"{p}hi") <= F.col(f"{q}hi")).drop(f"{p}__at")


def fraction_join(regions: DataFrame, elements: DataFrame, fraction: float, *, of: str = "left", **options) -> DataFrame:
    """Overlapping pairs in which one element covers at least ``fraction`` of the region (``of="left"``), or of the
    element itself (``of="right"``).  Elements are never added up."""
    p, q = options.get("prefixes", ("a_", "b_"))
    side = p if of == "left" else q
    return overlap_join(regions, elements, **options).where(F.col("overlap") >= fraction * (F.col(f"{side}hi") - F.col(f"{side}lo")))


def covered_and_open(regions: DataFrame, reads: DataFrame, elements: DataFrame, *, fraction: float = 0.5, read: str = "read", region: str = "region") -> DataFrame:
    """``region``, ``read`` for every read that spans a region, and ``open``: whether one of its elements covers enough
    of the region.  Elements of reads that do not span it are orphans and do not count."""
    spans = containment_join(regions, reads).select(F.col(f"a_{region}").alias(region), F.col(f"b_{read}").alias(read))
    hits = fraction_join(regions, elements, fraction).select(F.col(f"a_{region}").alias(region), F.col(f"b_{read}").alias(read)).distinct().withColumn("open", F.lit(True))
    return spans.join(hits, [region, read], "left").withColumn("open", F.coalesce("open", F.lit(False)))


def with_running_max(df: DataFrame, value: str, into: str, *, keys: Sequence[str] = ("chrom",), order: Sequence[str] = ("lo", "hi"), position: str = "lo", bucket: int = BUCKET) -> DataFrame:
    """Adds the largest ``value`` of all earlier rows of the keys (null for the first).

    Rows are ordered within buckets of positions; what earlier buckets hold comes from one row per bucket."""
    marked = df.withColumn("__k", F.floor(F.col(position) / bucket))
    own = Window.partitionBy(*keys, "__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(*keys, "__k").agg(F.max(value).alias("__m")).select(*keys, "__k", F.max("__m").over(over).alias("__before"))
    return marked.withColumn("__own", F.max(value).over(own)).join(sums, [*keys, "__k"]).withColumn(into, F.greatest("__own", "__before")).drop("__k", "__own", "__before")


def merge(df: DataFrame, *, keys: Sequence[str] = ("chrom",), bucket: int = BUCKET) -> DataFrame:
    """The union of intervals: overlapping and touching ones become one; ``n`` counts them."""
    distinct = df.where("hi > lo").groupBy(*keys, "lo", "hi").agg(F.count("*").alias("n"))  # so that no rows tie
    rows = with_running_max(distinct, "hi", "__top", keys=keys, bucket=bucket)
    starts = rows.withColumn("__new", (F.col("__top").isNull() | (F.col("lo") > F.col("__top"))).cast("long"))
    # islands are numbered by their first position: the latest start at or before a row
    head = starts.withColumn("__head", F.when(F.col("__new") == 1, F.col("lo")))
    ranked = with_running_max(head, "__head", "__earlier", keys=keys, bucket=bucket).withColumn("__island", F.coalesce("__head", "__earlier"))
    return ranked.groupBy(*keys, "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("__island")


def gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Bases between two intervals; 0 if they overlap or touch."""
    return F.greatest(lo2 - hi1, lo1 - hi2, F.lit(0))


def best_overlap(left: DataFrame, right: DataFrame, *, key: str, rank: Sequence[str], **options) -> DataFrame:
    """Of each left row's hits the one with the largest overlap; ``rank`` breaks ties."""
    hits = overlap_join(left, right, **options)
    p = options.get("prefixes", ("a_", "b_"))[0]
    w = Window.partitionBy(f"{p}{key}").orderBy(F.desc("overlap"), *rank)
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def nearest(left: DataFrame, right: DataFrame, *, key: str, right_key: str, keys: Sequence[str] = ("chrom",), width: int = BIN, bucket: int = BUCKET) -> DataFrame:
    """``key``, ``right_key``, ``distance`` of the nearest right interval of each left one: 0 where they overlap or touch;
    ties go to the smallest ``right_key``.  Without any right interval on the chromosome both are null.

    Beside overlaps only the last interval that ends before and the first that begins after can be nearest; both are
    carried along in order, bucket by bucket.
    """
    over = overlap_join(left, right, on=keys, width=width).select(F.col(f"a_{key}").alias(key), F.col(f"b_{right_key}").alias(right_key), F.lit(0).cast("long").alias("distance"))
    parts = [over]
    for before in (True, False):
        at, end = ("hi", "lo") if before else ("lo", "hi")
        sign = 1 if before else -1
        ends = right.where("hi > lo").groupBy(*keys, F.col(at).alias("__at")).agg(F.min(right_key).alias("__id")).withColumn("__pos", F.col("__at") * sign)
        events = ends.select(*keys, "__pos", F.lit(0).alias("__t"), F.struct("__pos", (-F.col("__id")).alias("i")).alias("__v"), F.lit(None).cast(left.schema[key].dataType).alias(key))
        asks = left.select(*keys, (F.col(end) * sign).alias("__pos"), F.lit(1).alias("__t"), F.lit(None).cast(events.schema["__v"].dataType).alias("__v"), key)
        ran = with_running_max(events.unionByName(asks), "__v", "__last", keys=keys, order=("__pos", "__t"), position="__pos", bucket=bucket)
        parts.append(ran.where("__t = 1 AND __last IS NOT NULL").select(key, (-F.col("__last.i")).alias(right_key), (F.col("__pos") - F.col("__last.__pos")).alias("distance")))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = found.groupBy(key).agg(F.min(F.struct("distance", right_key)).alias("b")).select(key, f"b.{right_key}", "b.distance")
    return left.select(key).join(best, key, "left")


def pairs_within(members: DataFrame, *, group: str = "gene", item: str = "region", least: int = 500, most: int = 20_000) -> DataFrame:
    """Pairs of items of one group, ordered by (lo, hi, item), whose gap is strictly between the bounds.

    The self-join is keyed by group and by bins of ``most`` positions, so that a group with many items stays many rows
    of several keys, and only neighbouring bins meet."""
    rows = members.select(group, item, "lo", "hi").distinct()
    a = rows.select(group, F.col(item).alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")).withColumn("__bin", F.explode(F.sequence(F.floor(F.col("a_lo") / most), F.floor((F.col("a_hi") + most) / most))))
    b = rows.select(group, F.col(item).alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi")).withColumn("__bin", F.floor(F.col("b_lo") / most))
    later = (F.col("b_lo") > F.col("a_lo")) | ((F.col("b_lo") == F.col("a_lo")) & ((F.col("b_hi") > F.col("a_hi")) | ((F.col("b_hi") == F.col("a_hi")) & (F.col("b") > F.col("a")))))
    far = gap(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))
    return a.join(b, [group, "__bin"]).where(later).withColumn("gap", far).where((F.col("gap") > least) & (F.col("gap") < most)).drop("__bin")


def clip(elements: DataFrame, blocks: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """The parts of elements that fall into blocks of the same key, other columns of the elements kept."""
    both = overlap_join(elements, blocks, on=on)
    rest = [c for c in elements.columns if c not in ("lo", "hi")]
    return both.select(*(F.col(f"a_{c}").alias(c) for c in rest), F.greatest("a_lo", "b_lo").alias("lo"), F.least("a_hi", "b_hi").alias("hi"))
