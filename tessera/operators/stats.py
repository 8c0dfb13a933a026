"""Tests, corrections, ranks, diversity and signal summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


# ---------------------------------------------------------------- ratios


def ratio(n: Column, d: Column) -> Column:
    """``n / d``, null where ``d`` is not positive."""
    return F.when(d > 0, n / d)


def finite(x: Column) -> Column:
    """A number, null where it is not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def effects(df: DataFrame, *, pseudocount: float = 1.0) -> DataFrame:
    """Adds n, expected, odds ratios, ratio and excess of 2x2 tables (neither, first, second, both)."""
    a, b, c, d = (F.col(x).cast("double") for x in ("joint", "first", "second", "neither"))
    n = a + b + c + d
    expected = ratio((a + b) * (a + c), n)
    pc = pseudocount
    haldane = ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))
    return df.select("*", expected.alias("expected"), (((a + pc) * (d + pc)) / ((b + pc) * (c + pc))).alias("odds_ratio"), (F.log(haldane) / LN2).alias("log2_odds"), ratio(a, expected).alias("observed_to_expected"), (a - expected).alias("excess"), ((b == 0) | (c == 0)).alias("zero_cell"))


# ---------------------------------------------------------------- Fisher's exact test


def _log_factorials(tables: DataFrame) -> DataFrame:
    """``k``, ``lf`` for every whole number that the tables need, by one running sum over their range."""
    spark = tables.sparkSession
    most = tables.agg(F.max(F.col("neither") + F.col("first") + F.col("second") + F.col("joint"))).first()[0]
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return spark.range(0, (most or 0) + 1, 1, 1).select(F.col("id").alias("k"), F.sum(F.log(F.greatest(F.col("id"), F.lit(1)).cast("double"))).over(w).alias("lf"))


def fisher(tables: DataFrame, *, tie: float = 1e-7) -> DataFrame:
    """Adds the two-sided p value of 2x2 tables: all tables of the same margins that are no likelier than the observed
    one, ties within a relative tolerance.  Each distinct table is tested once, its support as rows; log factorials come
    from one table as long as the largest total."""
    cells = ["neither", "first", "second", "joint"]
    once = tables.select(*(F.col(c).cast("long").alias(c) for c in cells)).distinct()
    m, k, n = F.col("joint") + F.col("first"), F.col("joint") + F.col("second"), F.col("neither") + F.col("first") + F.col("second") + F.col("joint")
    margins = once.select(*cells, m.alias("m"), k.alias("k"), n.alias("n"))
    support = margins.select("m", "k", "n").distinct().withColumn("x", F.explode(F.sequence(F.greatest(F.lit(0), F.col("m") + F.col("k") - F.col("n")), F.least("m", "k"))))
    lf = _log_factorials(once)
    long = support.select("m", "k", "n", "x", F.explode(F.array(*(F.struct(v.alias("i"), F.lit(s).alias("s")) for v, s in ((F.col("x"), -1), (F.col("m") - F.col("x"), -1), (F.col("k") - F.col("x"), -1), (F.col("n") - F.col("m") - F.col("k") + F.col("x"), -1), (F.col("m"), 1), (F.col("n") - F.col("m"), 1), (F.col("k"), 1), (F.col("n") - F.col("k"), 1), (F.col("n"), -1))))).alias("t"))
    logs = long.join(lf.withColumnRenamed("k", "i"), F.col("t.i") == F.col("i")).groupBy("m", "k", "n", "x").agg(F.sum(F.col("t.s") * F.col("lf")).alias("lp"))
    seen = margins.select(*cells, "m", "k", "n", F.col("joint").alias("x")).join(logs, ["m", "k", "n", "x"]).select(*cells, "m", "k", "n", F.col("lp").alias("own"))
    p = seen.join(logs, ["m", "k", "n"]).where(F.col("lp") <= F.col("own") + F.log1p(F.lit(tie))).groupBy(*cells).agg(F.least(F.sum(F.exp("lp")), F.lit(1.0)).alias("p"))
    return tables.join(p, cells, "left")


# ---------------------------------------------------------------- families of p values


def benjamini_hochberg(df: DataFrame, *, p: str = "p", into: str = "fdr", family: Sequence[str] = (), size: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Adds adjusted p values over the non-null ``p`` of each family; null where ``p`` is.  ``size``: a family size that
    may exceed the number of values.

    With equal p values the running minimum is the same whichever comes first.  Values are ordered within ranges of p;
    how many stand in lower ranges, and the least of the higher ones, come from one row per family and range."""
    x = F.col(p)
    some = df.where(x.isNotNull() & ~F.isnan(x))
    name = F.to_json(F.struct(*family), {"ignoreNullFields": "false"}) if family else F.lit("")
    # 1024 ranges from 0 to 1, eight for each halving below the first of them
    place = F.when(x <= 0, -20_000).when(x < 1 / 1024, F.floor(8 * F.log2(x))).otherwise(F.floor(1024 * x)).cast("int")
    some, keys = some.withColumn("__f", name).withColumn("__b", place), ["__f", "__b"]
    lower = Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = some.groupBy(*keys).agg(F.count("*").alias("__k"))
    sums = sums.select(*keys, F.coalesce(F.sum("__k").over(lower), F.lit(0)).alias("__below"), F.sum("__k").over(Window.partitionBy("__f")).alias("__n"))
    own = Window.partitionBy(*keys).orderBy(x, *order)
    n = size if size is not None else F.col("__n")
    raw = some.join(sums, keys).withColumn("__raw", x * n / (F.col("__below") + F.row_number().over(own)))
    higher = Window.partitionBy("__f").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    least = raw.groupBy(*keys).agg(F.min("__raw").alias("__m")).select(*keys, F.min("__m").over(higher).alias("__above"))
    down = Window.partitionBy(*keys).orderBy(x.desc(), "__raw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = raw.withColumn("__least", F.min("__raw").over(down)).join(least, keys)
    done = done.withColumn(into, F.least("__least", "__above", F.lit(1.0))).select(*df.columns, into)
    return done.unionByName(df.where(x.isNull() | F.isnan(x)).withColumn(into, F.lit(None).cast("double")))


def empirical(observed: Column, null: Column, *, upper: bool = True) -> Column:
    """Aggregate: (1 + extreme draws, ties included) / (1 + draws)."""
    hit = (null >= observed) if upper else (null <= observed)
    return (1 + F.count_if(hit)) / (1 + F.count(null))


# ---------------------------------------------------------------- ranks


def average_rank(df: DataFrame, value: str, into: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Adds ranks from 1, ties sharing their mean; null for null values.  Values are counted first, so that only
    distinct ones are ordered."""
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(*keys, value, (F.coalesce(F.sum("__n").over(below), F.lit(0)) + (F.col("__n") + 1) / 2).alias(into))
    return df.join(ranks, [*keys, value], "left")


def spearman(df: DataFrame, x: str, y: str, *, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n``, ``rho``: rank correlation over complete pairs; null unless three pairs vary in both."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, x, "__x", by=by), y, "__y", by=by)
    agg = [F.count("*").alias("n"), F.corr("__x", "__y").alias("__rho"), F.countDistinct(x).alias("__dx"), F.countDistinct(y).alias("__dy")]
    got = ranked.groupBy(*by).agg(*agg) if by else ranked.agg(*agg)
    return got.withColumn("rho", F.when((F.col("n") >= 3) & (F.col("__dx") > 1) & (F.col("__dy") > 1), F.col("__rho"))).drop("__rho", "__dx", "__dy")


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal, by a continued series of the complementary error function accurate to 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = F.lit(c) + t * poly
    erfc = t * F.exp(-x * x - 1.26551223 + t * poly)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def kruskal(df: DataFrame, value: str, group: str, *, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n``, ``groups``, ``h``: the Kruskal-Wallis statistic with tie correction; null where values do not vary."""
    keys = list(by)
    some = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranked = average_rank(some, value, "__r", by=by)
    ties = some.groupBy(*keys, value).agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("__ties"))
    sums = ranked.groupBy(*keys, group).agg(F.sum("__r").alias("s"), F.count("*").alias("k"))
    total = sums.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("__q"), F.sum("k").alias("n"), F.count("*").alias("groups"))
    both = total.join(ties, keys) if keys else total.crossJoin(ties)
    n = F.col("n").cast("double")
    c = 1 - F.col("__ties") / (n * n * n - n)
    h = (12 / (n * (n + 1)) * F.col("__q") - 3 * (n + 1)) / c
    return both.select(*keys, "n", "groups", F.when((F.col("n") > 1) & (c > 0), h).alias("h"))


def wilcoxon(df: DataFrame, value: str, is_first: Column, *, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n1``, ``n2``, ``u``, ``p``: rank-sum test by the normal approximation with tie and continuity corrections."""
    keys = list(by)
    some = df.where(F.col(value).isNotNull()).withColumn("__g", is_first.cast("int"))
    ranked = average_rank(some, value, "__r", by=by)
    ties = some.groupBy(*keys, value).agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("__ties"))
    sums = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("__g") == 1, F.col("__r"))).alias("__s"), F.count_if(F.col("__g") == 1).alias("n1"), F.count_if(F.col("__g") == 0).alias("n2"))
    both = sums.join(ties, keys) if keys else sums.crossJoin(ties)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("__s") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("__ties") / (n * (n - 1))))
    d = u - n1 * n2 / 2
    z = (F.abs(d) - 0.5) / sd
    return both.select(*keys, "n1", "n2", u.alias("u"), F.when(sd > 0, F.least(F.lit(1.0), 2 * normal_tail(F.greatest(z, F.lit(0.0))))).otherwise(F.lit(1.0)).alias("p"))


def hypergeometric_upper(df: DataFrame, *, hits: str, drawn: str, marked: str, total: str, into: str = "p") -> DataFrame:
    """Adds P(X >= hits) when ``drawn`` of ``total`` are taken, ``marked`` of which count; by sums of log factorials."""

    def lf(x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(x, F.lit(1)).cast("long")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))

    K, n, N = F.col(marked), F.col(drawn), F.col(total)
    base = lf(K) + lf(N - K) + lf(n) + lf(N - n) - lf(N)
    df = df.withColumn("__base", base)
    terms = F.transform(F.sequence(F.greatest(F.col(hits), n + K - N, F.lit(0)), F.least(K, n)), lambda x: F.exp(F.col("__base") - lf(x) - lf(K - x) - lf(n - x) - lf(N - K - n + x)))
    top = F.least(K, n)
    p = F.when(F.col(hits) > top, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))
    return df.withColumn(into, p).drop("__base")


# ---------------------------------------------------------------- diversity


def diversity(counts: DataFrame, n: str = "n", *, by: Sequence[str] = ()) -> DataFrame:
    """``by``, total, categories, Shannon entropy in bits (plain, normalised, effective number) and the Gini-Simpson
    family, over the positive counts of each key.  Normalised values are null with one category."""
    keys = list(by)
    some = counts.where(F.col(n) > 0)
    totals = some.groupBy(*keys).agg(F.sum(n).alias("total"), F.count("*").alias("k"))
    joined = some.join(totals, keys) if keys else some.crossJoin(totals)
    p = F.col(n) / F.col("total")
    sums = joined.groupBy(*keys).agg(F.max("total").alias("total"), F.max("k").alias("k"), F.sum(-p * F.log(p) / LN2).alias("h"), F.sum(p * p).alias("s"))
    k = F.col("k")
    return sums.select(*keys, "total", k.alias("categories"), F.col("h").alias("entropy"), F.when(k > 1, F.col("h") / (F.log(k.cast("double")) / LN2)).alias("normalised_entropy"), F.pow(F.lit(2.0), "h").alias("effective"), (1 - F.col("s")).alias("gini_simpson"), F.when(k > 1, (1 - F.col("s")) / (1 - 1 / k)).alias("normalised_simpson"), (1 / F.col("s")).alias("inverse_simpson"))


def rao(sites: DataFrame, *, key: Sequence[str], cluster: str, site: str, value: str, width: float) -> DataFrame:
    """``key``, total, within and between diversity of 0/1 profiles per site, and the share between clusters.

    Two draws from all rows differ at a site with chance 2p(1-p); within clusters the same, weighted by cluster size."""
    keys = list(key)
    cell = sites.where(F.col(value).isNotNull()).groupBy(*keys, site, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    per = cell.groupBy(*keys, site).agg(F.sum("s").alias("S"), F.sum("n").alias("N"), F.sum(2 * F.col("s") * (1 - F.col("s") / F.col("n"))).alias("w"))
    p = F.col("S") / F.col("N")
    sums = per.groupBy(*keys).agg((F.sum(2 * p * (1 - p)) / width).alias("total"), (F.sum(F.col("w") / F.col("N")) / width).alias("within"))
    return sums.select(*keys, "total", "within", (F.col("total") - F.col("within")).alias("between"), F.when(F.col("total") > 0, (F.col("total") - F.col("within")) / F.col("total")).alias("share"))


def shape_index(tags: DataFrame, n: str = "n", *, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``shape_index``: 2 + sum p log2 p over positions with tags."""
    keys = list(by)
    some = tags.where(F.col(n) > 0)
    totals = some.groupBy(*keys).agg(F.sum(n).alias("t"))
    p = F.col(n) / F.col("t")
    return some.join(totals, keys).groupBy(*keys).agg((2 + F.sum(p * F.log(p) / LN2)).alias("shape_index"))


def quantile_width(tags: DataFrame, *, by: Sequence[str], pos: str, n: str) -> DataFrame:
    """``by``, first positions at which a tenth and nine tenths of the tags are reached (whole-number tests), and width."""
    keys = list(by)
    along = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    run = tags.where(F.col(n) > 0).withColumn("c", F.sum(n).over(along)).withColumn("t", F.sum(n).over(every))
    got = run.groupBy(*keys).agg(F.min(F.when(10 * F.col("c") >= F.col("t"), F.col(pos))).alias("q10"), F.min(F.when(10 * F.col("c") >= 9 * F.col("t"), F.col(pos))).alias("q90"))
    return got.withColumn("width", F.col("q90") - F.col("q10") + 1)


# ---------------------------------------------------------------- windows


def rolling_rows(df: DataFrame, value: str, into: str, k: int, *, by: Sequence[str], order: str) -> DataFrame:
    """Centred mean of ``k`` rows, null at the edges; an even ``k`` reaches one further forward."""
    back = (k - 1) // 2
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-back, k - 1 - back)
    return df.withColumn(into, F.when(F.count("*").over(w) == k, F.avg(value).over(w)))


def rolling_distance(df: DataFrame, value: str, into: str, span: float, *, by: Sequence[str], order: str) -> DataFrame:
    """Mean over all rows within ``span / 2`` of each row's position."""
    half = int(span // 2)
    return df.withColumn(into, F.avg(value).over(Window.partitionBy(*by).orderBy(order).rangeBetween(-half, half)))


def autocorrelation(values: Column, most: int) -> Column:
    """Autocorrelations of an array at lags 0 to ``most``; null if it is constant or shorter."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    centred = F.transform(values, lambda x: x - mean)
    zero = F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x)

    def at(lag: Column) -> Column:
        pairs = F.zip_with(F.slice(centred, F.lit(1), n - lag), F.slice(centred, lag + 1, n - lag), lambda x, y: x * y)
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / zero

    return F.when((n > most) & (zero > 0), F.transform(F.sequence(F.lit(0), F.lit(most)), at))
