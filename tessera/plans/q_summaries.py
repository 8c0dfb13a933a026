"""Summaries of the survey: profiles, proportions, counts by group and attachments, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import select as P
from ..operators import stats as S
from .registry import Tables, query


def _n(x, k=6):
    return F.round(x, k)


@query("a19_reads_from_segments", "SELECT read, min(lo) AS lo, max(hi) AS hi, min(sample) AS sample, min(chrom) AS chrom, count(DISTINCT sample) = 1 AND count(DISTINCT chrom) = 1 AS consistent FROM elements GROUP BY read")
def a19(v: Tables):
    one = (F.min("sample") == F.max("sample")) & (F.min("chrom") == F.max("chrom"))
    return v.elements.groupBy("read").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("sample").alias("sample"), F.min("chrom").alias("chrom"), one.alias("consistent"))


_PLACE = "SELECT c.sample, floor((c.pos - r.lo) / 50) AS place, c.called AS value, 'calls' AS track FROM calls c JOIN reads r ON c.read = r.read UNION ALL SELECT e.sample, floor((e.lo - r.lo) / 50), CASE WHEN e.hi - e.lo > 300 THEN 1 ELSE 0 END, 'elements' FROM elements e JOIN reads r ON e.read = r.read"


def _tracks(v: Tables):
    """Places along reads, in steps of 50 bases, with values of both tracks."""
    starts = v.reads.select("read", F.col("lo").alias("from"))
    place = lambda x: F.floor((F.col(x) - F.col("from")) / 50).alias("place")
    calls = v.calls.join(starts, "read").select("sample", place("pos"), F.col("called").alias("value"), F.lit("calls").alias("track"))
    elements = v.elements.join(starts, "read").select("sample", place("lo"), (F.col("hi") - F.col("lo") > 300).cast("int").alias("value"), F.lit("elements").alias("track"))
    return calls.unionByName(elements)


@query("a25_signal_profiles", f"SELECT track, sample, CAST(place AS BIGINT) AS place, count(*) AS n, round(avg(value), 6) AS mean FROM ({_PLACE}) GROUP BY track, sample, place")
def a25(v: Tables):
    return _tracks(v).groupBy("track", "sample", "place").agg(F.count("*").alias("n"), _n(F.avg("value")).alias("mean"))


@query("a24_occupancy_profiles", "SELECT cluster, CAST(floor((e.lo - r.lo) / 50) AS BIGINT) AS place, round(avg(CASE WHEN e.hi - e.lo > 300 THEN 1 ELSE 0 END), 6) AS occupancy FROM elements e JOIN reads r ON e.read = r.read JOIN clusters c ON c.read = r.read WHERE cluster IS NOT NULL GROUP BY 1, 2")
def a24(v: Tables):
    known = v.clusters.where("cluster IS NOT NULL").select("read", "cluster")
    at = v.elements.join(v.reads.select("read", F.col("lo").alias("from")), "read").join(known, "read")
    return at.groupBy("cluster", F.floor((F.col("lo") - F.col("from")) / 50).alias("place")).agg(_n(F.avg((F.col("hi") - F.col("lo") > 300).cast("int"))).alias("occupancy"))


@query("a43_average_profiles", "SELECT sample, round(avg(joint * 1.0 / n), 6) AS joint, round(avg(first * 1.0 / n), 6) AS first, count(*) AS pairs FROM tables WHERE n >= 5 GROUP BY sample")
def a43(v: Tables):
    deep = v.tables.where("n >= 5").groupBy("sample")
    return deep.agg(_n(F.avg(F.col("joint") / F.col("n"))).alias("joint"), _n(F.avg(F.col("first") / F.col("n"))).alias("first"), F.count("*").alias("pairs"))


@query("a53_footprint_presence", "SELECT region, count(DISTINCT read) AS reads, count(*) AS footprints FROM regions a JOIN elements b ON a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.5 * (b.hi - b.lo) GROUP BY region")
def a53(v: Tables):
    hits = I.fraction_join(v.regions, v.elements, 0.5, of="right").groupBy(F.col("a_region").alias("region"), "b_read").agg(F.count("*").alias("n"))
    return hits.groupBy("region").agg(F.count("*").alias("reads"), F.sum("n").alias("footprints"))


@query("a56_called_proportion", "WITH f AS (SELECT region, read, sum(called) AS called, count(*) AS n FROM regions a JOIN calls b ON a.chrom = b.chrom AND a.lo <= b.pos AND b.pos < a.hi GROUP BY region, read) SELECT region, round(sum(called) * 1.0 / sum(n), 6) AS proportion, round(median(called * 1.0 / n), 6) AS median FROM f GROUP BY region")
def a56(v: Tables):
    each = I.point_join(v.calls, v.regions).groupBy(F.col("b_region").alias("region"), "a_read").agg(F.sum("a_called").alias("called"), F.count("*").alias("n"))
    share = F.col("called") / F.col("n")
    return each.groupBy("region").agg(_n(F.sum("called") / F.sum("n")).alias("proportion"), _n(F.percentile(share, F.lit(0.5))).alias("median"))


@query("a61_cluster_fractions", "SELECT sample, gene, cluster, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY sample, gene), 6) AS fraction FROM clusters WHERE cluster IS NOT NULL GROUP BY sample, gene, cluster")
def a61(v: Tables):
    known = v.clusters.where("cluster IS NOT NULL")
    n = known.groupBy("sample", "gene", "cluster").agg(F.count("*").alias("n"))  # a row for each cluster of a gene
    total = n.groupBy("sample", "gene").agg(F.sum("n").alias("all"))
    return n.join(total, ["sample", "gene"]).select("sample", "gene", "cluster", "n", _n(F.col("n") / F.col("all")).alias("fraction"))


@query("a66_usage_by_time", "SELECT vec_id % 4 AS \"time\", i AS feature, round(avg(x), 5) AS usage FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i FROM embeddings) GROUP BY 1, 2")
def a66(v: Tables):
    long = v.embeddings.select((F.col("vec_id") % 4).alias("time"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return long.groupBy("time", (F.col("i") + 1).alias("feature")).agg(_n(F.avg("x"), 5).alias("usage"))


@query("a69_cluster_spread", "SELECT cluster, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(stddev_samp(value) / sqrt(count(*)), 4) AS sem, count(DISTINCT sample) AS samples FROM clusters WHERE cluster IS NOT NULL GROUP BY cluster")
def a69(v: Tables):
    known = v.clusters.where("cluster IS NOT NULL").select("cluster", "sample", F.col("value").cast("double").alias("value"))
    sd = F.stddev_samp("value")
    return known.groupBy("cluster").agg(F.count("*").alias("n"), _n(F.avg("value"), 4).alias("mean"), _n(sd, 4).alias("sd"), _n(sd / F.sqrt(F.count("*")), 4).alias("sem"), F.size(F.collect_set("sample")).cast("long").alias("samples"))


_STATES = ("neither", "first", "second", "joint")


@query("a79_configuration_proportions", " UNION ALL ".join(f"SELECT sample, '{s}' AS state, CAST(sum({s}) AS BIGINT) AS n, round(sum({s}) * 1.0 / sum(n), 6) AS proportion FROM tables GROUP BY sample" for s in _STATES))
def a79(v: Tables):
    sums = v.tables.groupBy("sample").agg(F.sum("n").alias("all"), *(F.sum(s).alias(s) for s in _STATES))
    long = sums.unpivot(["sample", "all"], list(_STATES), "state", "n")
    return long.select("sample", "state", F.col("n").cast("long").alias("n"), _n(F.col("n") / F.col("all")).alias("proportion"))


@query("a80_finite_means", "SELECT gene, count(*) AS n, count(x) AS finite, round(avg(x), 6) AS mean FROM (SELECT gene, CASE WHEN cluster > 0 THEN value / cluster END AS x FROM clusters) GROUP BY gene")
def a80(v: Tables):
    ratio = F.col("value").cast("double") / F.nullif(F.col("cluster"), F.lit(0))
    finite = F.when(~F.isnan(ratio) & (F.abs(ratio) != float("inf")), ratio)
    return v.clusters.select("gene", finite.alias("x")).groupBy("gene").agg(F.count("*").alias("n"), F.count("x").alias("finite"), _n(F.avg("x")).alias("mean"))


@query("a83_variant_per_pair", "WITH s AS (SELECT pair, 1 AS side, sample, first * 1.0 / n AS score FROM tables UNION ALL SELECT pair, 2, sample, second * 1.0 / n FROM tables) SELECT pair, side, sample, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY pair ORDER BY score DESC, side, sample) = 1")
def a83(v: Tables):
    score = lambda x: (F.col(x) / F.col("n")).alias("score")
    sides = v.tables.select("pair", F.lit(1).alias("side"), "sample", score("first")).unionByName(v.tables.select("pair", F.lit(2).alias("side"), "sample", score("second")))
    return P.top(sides, 1, by=["pair"], order=[F.desc("score"), "side", "sample"]).select("pair", "side", "sample", _n("score").alias("score"))


@query("f12_example_choice", "WITH n AS (SELECT gene, cluster, count(*) AS k FROM clusters WHERE cluster IS NOT NULL GROUP BY gene, cluster), f AS (SELECT gene, cluster, k, k * 1.0 / sum(k) OVER (PARTITION BY gene) AS share, sum(k) OVER (PARTITION BY gene) AS depth FROM n) SELECT cluster, gene, k AS reads, round(share, 6) AS share FROM f WHERE depth >= 10 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY share DESC, gene) = 1")
def f12(v: Tables):
    n = v.clusters.where("cluster IS NOT NULL").groupBy("gene", "cluster").agg(F.count("*").alias("reads"))
    depth = n.groupBy("gene").agg(F.sum("reads").alias("depth")).where("depth >= 10")
    shares = n.join(depth, "gene").withColumn("share", F.col("reads") / F.col("depth"))
    return P.top(shares, 1, by=["cluster"], order=[F.desc("share"), "gene"]).select("cluster", "gene", "reads", _n("share").alias("share"))


@query("j37_pair_alleles", "SELECT e.read, e.el, coalesce(g.allele, 'Unassigned') AS allele FROM elements e LEFT JOIN (SELECT read, CASE WHEN read % 3 = 1 THEN 'REF' WHEN read % 3 = 2 THEN 'ALT' END AS allele FROM reads WHERE strand = '+') g ON e.read = g.read")
def j37(v: Tables):
    known = v.reads.where("strand = '+'").select("read", F.when(F.col("read") % 3 == 1, "REF").when(F.col("read") % 3 == 2, "ALT").alias("allele"))
    return v.elements.select("read", "el").join(known, "read", "left").select("read", "el", F.coalesce("allele", F.lit("Unassigned")).alias("allele"))


@query("n04_test_summary", "SELECT sample, count(*) AS tested, count(*) FILTER (joint * 1.0 / n > 0.2) AS significant, count(*) FILTER (joint * neither > first * second) AS positive, round(count(*) FILTER (pair % 5 = 0) * 100.0 / count(*), 4) AS percent_chrom FROM tables GROUP BY sample")
def n04(v: Tables):
    share = F.col("joint") / F.col("n") > 0.2
    above = F.col("joint") * F.col("neither") > F.col("first") * F.col("second")
    return v.tables.groupBy("sample").agg(F.count("*").alias("tested"), F.count_if(share).alias("significant"), F.count_if(above).alias("positive"), _n(F.count_if(F.col("pair") % 5 == 0) * 100 / F.count("*"), 4).alias("percent_chrom"))


@query("n06_adjusted_overlap", "WITH a AS (SELECT pair, max(joint * 1.0 / n) > 0.2 AS pooled, avg(joint * 1.0 / n) > 0.1 AS adjusted FROM tables GROUP BY pair) SELECT scope, count(*) AS tested, count(*) FILTER (pooled) AS pooled, count(*) FILTER (adjusted) AS adjusted, count(*) FILTER (pooled AND adjusted) AS both FROM (SELECT 'all' AS scope, pooled, adjusted FROM a UNION ALL SELECT 'chrom', pooled, adjusted FROM a WHERE pair % 5 = 0) GROUP BY scope".replace(" AS both", ' AS "both"'))
def n06(v: Tables):
    share = F.col("joint") / F.col("n")
    a = v.tables.groupBy("pair").agg((F.max(share) > 0.2).alias("p"), (F.avg(share) > 0.1).alias("q"))
    scoped = a.select(F.explode(F.when(F.col("pair") % 5 == 0, F.array(F.lit("all"), F.lit("chrom"))).otherwise(F.array(F.lit("all")))).alias("scope"), "p", "q")
    return scoped.groupBy("scope").agg(F.count("*").alias("tested"), F.count_if("p").alias("pooled"), F.count_if("q").alias("adjusted"), F.count_if(F.col("p") & F.col("q")).alias("both"))


@query("n14_supported_reads", "SELECT cluster, kind, count(DISTINCT b.read) AS reads FROM regions a JOIN elements b ON a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi JOIN clusters c ON c.read = b.read WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.5 * (a.hi - a.lo) AND cluster IS NOT NULL GROUP BY cluster, kind")
def n14(v: Tables):
    hits = I.fraction_join(v.regions, v.elements, 0.5).select(F.col("a_kind").alias("kind"), F.col("b_read").alias("read")).distinct()
    return hits.join(v.clusters.where("cluster IS NOT NULL").select("read", "cluster"), "read").groupBy("cluster", "kind").agg(F.count("*").alias("reads"))


@query("n19_entropy_quantiles", "WITH p AS (SELECT gene, sample, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY gene, sample) AS p FROM clusters WHERE cluster IS NOT NULL GROUP BY gene, sample, cluster), e AS (SELECT gene, sample, sum(-p * ln(p) / ln(2)) AS h FROM p GROUP BY gene, sample) SELECT sample, round(median(h), 6) AS median, round(quantile_cont(h, 0.25), 6) AS q25, round(quantile_cont(h, 0.75), 6) AS q75, round(min(h), 6) AS low, round(max(h), 6) AS high FROM e GROUP BY sample")
def n19(v: Tables):
    n = v.clusters.where("cluster IS NOT NULL").groupBy("gene", "sample", "cluster").agg(F.count("*").alias("n"))
    h = S.diversity(n.drop("cluster"), by=["gene", "sample"])
    level = lambda q, name: _n(F.percentile("entropy", F.lit(q))).alias(name)
    return h.groupBy("sample").agg(level(0.5, "median"), level(0.25, "q25"), level(0.75, "q75"), _n(F.min("entropy")).alias("low"), _n(F.max("entropy")).alias("high"))


@query("n26_flagged_pairs", "WITH a AS (SELECT pair, CAST(sum(first) AS BIGINT) AS first, CAST(sum(second) AS BIGINT) AS second FROM tables GROUP BY pair), b AS (SELECT s_suppkey AS pair, s_nationkey AS nation FROM supplier WHERE s_nationkey < 12) SELECT a.pair, first, second, b.pair IS NOT NULL AS annotated, CASE WHEN b.nation IS NULL THEN 'not tested' WHEN first > second THEN 'first' WHEN first < second THEN 'second' ELSE 'even' END AS flag FROM a LEFT JOIN b ON a.pair = b.pair")
def n26(v: Tables):
    a = v.tables.groupBy("pair").agg(F.sum("first").cast("long").alias("first"), F.sum("second").cast("long").alias("second"))
    b = v.supplier.where("s_nationkey < 12").select(F.col("s_suppkey").alias("pair"), F.col("s_nationkey").alias("nation"))
    known = F.col("nation").isNotNull()
    flag = F.when(~known, "not tested").when(F.col("first") > F.col("second"), "first").when(F.col("first") < F.col("second"), "second").otherwise("even")
    return a.join(b, "pair", "left").select("pair", "first", "second", known.alias("annotated"), flag.alias("flag"))


@query("u05_set_equality", "WITH s AS (SELECT (SELECT count(*) FROM (SELECT read FROM reads EXCEPT SELECT read FROM elements)) AS only_left, (SELECT count(*) FROM (SELECT read FROM elements EXCEPT SELECT read FROM reads)) AS only_right) SELECT only_left, only_right, only_left + only_right = 0 AS same FROM s")
def u05(v: Tables):
    sides = v.reads.select("read", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(v.elements.select("read", F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = sides.groupBy("read").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    found = each.agg(F.count_if(F.col("b") == 0).alias("only_left"), F.count_if(F.col("a") == 0).alias("only_right"))
    return found.withColumn("same", F.col("only_left") + F.col("only_right") == 0)


@query("x39_low_count_filter", "SELECT gene, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n >= 3) AS deep FROM (SELECT gene, sample, count(*) AS n FROM clusters GROUP BY gene, sample) GROUP BY gene HAVING count(*) FILTER (n >= 3) >= 2 AND sum(n) >= 10")
def x39(v: Tables):
    n = v.clusters.groupBy("gene", "sample").agg(F.count("*").alias("n"))
    return n.groupBy("gene").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= 3).alias("deep")).where("deep >= 2 AND total >= 10")


@query("y30_diversity_summary", "WITH p AS (SELECT gene, sample, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY gene, sample) AS p FROM clusters WHERE cluster IS NOT NULL GROUP BY gene, sample, cluster), e AS (SELECT gene, sample, sum(-p * ln(p) / ln(2)) AS h, count(*) AS k FROM p GROUP BY gene, sample) SELECT gene, count(*) AS samples, round(avg(h), 6) AS mean, round(median(h), 6) AS median, CAST(max(k) AS BIGINT) AS most FROM e GROUP BY gene")
def y30(v: Tables):
    n = v.clusters.where("cluster IS NOT NULL").groupBy("gene", "sample", "cluster").agg(F.count("*").alias("n"))
    h = S.diversity(n.drop("cluster"), by=["gene", "sample"])
    return h.groupBy("gene").agg(F.count("*").alias("samples"), _n(F.avg("entropy")).alias("mean"), _n(F.percentile("entropy", F.lit(0.5))).alias("median"), F.max("categories").cast("long").alias("most"))


@query("y22_occupancy_cells", "SELECT read, concat(CASE WHEN hi - lo > 300 THEN 'large' ELSE 'small' END, '@', CAST(CAST(floor(rel / 100) AS BIGINT) AS VARCHAR)) AS feature, count(*) AS n FROM (SELECT e.read, e.lo, e.hi, e.lo - r.lo AS rel FROM elements e JOIN reads r ON e.read = r.read) GROUP BY 1, 2")
def y22(v: Tables):
    at = v.elements.join(v.reads.select("read", F.col("lo").alias("from")), "read")
    size = F.when(F.col("hi") - F.col("lo") > 300, "large").otherwise("small")
    return at.groupBy("read", F.concat(size, F.lit("@"), F.floor((F.col("lo") - F.col("from")) / 100).cast("string")).alias("feature")).agg(F.count("*").alias("n"))
