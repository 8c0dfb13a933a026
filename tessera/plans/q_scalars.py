"""Scalar expressions, and queries that combine a selection or a correction with an operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import stats as S
from .q_statistics import _BH, _FISHER
from .registry import Tables, query


@query("t08_relative_from_starts", "SELECT r.read, g.gene, CASE WHEN g.strand = '-' THEN g.tss - r.hi + 1 ELSE r.lo - g.tss END AS rel_lo, CASE WHEN g.strand = '-' THEN g.tss - r.lo + 1 ELSE r.hi - g.tss END AS rel_hi FROM reads r JOIN genes g ON r.chrom = g.chrom AND g.tss >= r.lo AND g.tss < r.hi")
def t08(v: Tables):
    hits = I.point_join(v.genes, v.reads, pos="tss")
    minus = F.col("a_strand") == "-"
    return hits.select(
        F.col("b_read").alias("read"),
        F.col("a_gene").alias("gene"),
        F.when(minus, F.col("a_tss") - F.col("b_hi") + 1).otherwise(F.col("b_lo") - F.col("a_tss")).alias("rel_lo"),
        F.when(minus, F.col("a_tss") - F.col("b_lo") + 1).otherwise(F.col("b_hi") - F.col("a_tss")).alias("rel_hi"),
    )


@query("t11_tss_regions", "SELECT gene, chrom, greatest(CASE WHEN strand = '-' THEN tss - 299 ELSE tss - 50 END, 0) AS lo, CASE WHEN strand = '-' THEN tss + 51 ELSE tss + 300 END AS hi FROM genes")
def t11(v: Tables):
    minus, tss = F.col("strand") == "-", F.col("tss")
    return v.genes.select("gene", "chrom", F.greatest(F.when(minus, tss - 299).otherwise(tss - 50), F.lit(0)).alias("lo"), F.when(minus, tss + 51).otherwise(tss + 300).alias("hi"))


@query("t13_reads_per_million_per_base", "SELECT region, round(1e6 * count(r.read) / (SELECT count(*) FROM reads) / max(g.hi - g.lo), 9) AS density FROM regions g LEFT JOIN reads r ON r.chrom = g.chrom AND r.lo >= g.lo AND r.lo < g.hi GROUP BY region")
def t13(v: Tables):
    hits = I.point_join(v.reads, v.regions, pos="lo").groupBy(F.col("b_region").alias("region")).agg(F.count("*").alias("k"))
    total = v.reads.agg(F.count("*").alias("total"))  # one row
    each = v.regions.join(hits, "region", "left").crossJoin(F.broadcast(total))
    return each.select("region", F.round(1e6 * F.coalesce("k", F.lit(0)) / F.col("total") / (F.col("hi") - F.col("lo")), 9).alias("density"))


@query("t16_widened_regions", "SELECT region, chrom, greatest(lo - 250, 0) AS lo, hi + 250 AS hi FROM regions")
def t16(v: Tables):
    return v.regions.select("region", "chrom", F.greatest(F.col("lo") - 250, F.lit(0)).alias("lo"), (F.col("hi") + 250).alias("hi"))


@query("t17_gap_distance", "SELECT a.region AS a, b.region AS b, greatest(greatest(a.lo, b.lo) - least(a.hi, b.hi), 0) AS gap FROM regions a JOIN regions b ON a.chrom = b.chrom AND a.region < b.region AND a.lo - 200 < b.hi AND b.lo < a.hi + 200")
def t17(v: Tables):
    wide = v.regions.select("region", "chrom", (F.col("lo") - 200).alias("lo"), (F.col("hi") + 200).alias("hi"))
    near = I.overlap_join(wide, v.regions.select("region", "chrom", "lo", "hi")).where("a_region < b_region")
    gap = F.greatest(F.greatest(F.col("a_lo") + 200, F.col("b_lo")) - F.least(F.col("a_hi") - 200, F.col("b_hi")), F.lit(0))
    return near.select(F.col("a_region").alias("a"), F.col("b_region").alias("b"), gap.alias("gap"))


@query("t21_closed_contains", "SELECT g.gene, r.region FROM genes g JOIN regions r ON g.chrom = r.chrom AND g.tss BETWEEN r.lo AND r.hi")
def t21(v: Tables):
    closed = v.regions.withColumn("hi", F.col("hi") + 1)
    return I.point_join(v.genes, closed, pos="tss").select(F.col("a_gene").alias("gene"), F.col("b_region").alias("region"))


@query("f10_candidate_footprints", "SELECT e.read, e.el, g.gene, CASE WHEN g.strand = '-' THEN -1 ELSE 1 END * ((e.lo + e.hi) / 2.0 - g.tss) AS middle FROM elements e JOIN genes g ON e.chrom = g.chrom AND e.hi - e.lo BETWEEN 30 AND 60 AND e.lo < g.tss + 200 AND g.tss - 200 < e.hi")
def f10(v: Tables):
    windows = v.genes.select("gene", "chrom", "strand", "tss", (F.col("tss") - 200).alias("lo"), (F.col("tss") + 200).alias("hi"))
    hits = I.overlap_join(v.elements.where("hi - lo BETWEEN 30 AND 60"), windows)
    sign = F.when(F.col("b_strand") == "-", -1).otherwise(1)
    return hits.select(F.col("a_read").alias("read"), F.col("a_el").alias("el"), F.col("b_gene").alias("gene"), (sign * ((F.col("a_lo") + F.col("a_hi")) / 2.0 - F.col("b_tss"))).alias("middle"))


@query("e03_prefix_and_suffix", "SELECT s_suppkey AS gene, starts_with(s_name, 'Supp') AS starts, contains(s_name, '#00') AS holds, ends_with(s_name, '7') AS ends FROM supplier")
def e03(v: Tables):
    name = F.col("s_name")
    return v.supplier.select(F.col("s_suppkey").alias("gene"), name.startswith("Supp").alias("starts"), name.contains("#00").alias("holds"), name.endswith("7").alias("ends"))


@query("e05_zero_padding", "SELECT p_partkey AS region, lpad(CAST(p_size AS VARCHAR(9)), 5, '0') AS padded FROM part")
def e05(v: Tables):
    return v.part.select(F.col("p_partkey").alias("region"), F.lpad(F.col("p_size").cast("string"), 5, "0").alias("padded"))


@query("e06_sorted_distinct_join", "SELECT nation, string_agg(strand, ',' ORDER BY strand) AS strands FROM (SELECT DISTINCT nation, strand FROM genes) GROUP BY nation")
def e06(v: Tables):
    return v.genes.groupBy("nation").agg(F.array_join(F.array_sort(F.collect_set("strand")), ",").alias("strands"))


@query("e07_log_odds", "SELECT pair, sample, round(log2((joint + 0.5) * (neither + 0.5) / ((first + 0.5) * (second + 0.5))), 6) AS log_odds FROM tables")
def e07(v: Tables):
    j, n, a, b = (F.col(c) + 0.5 for c in ("joint", "neither", "first", "second"))
    return v.tables.select("pair", "sample", F.round(F.log2(j * n / (a * b)), 6).alias("log_odds"))


@query("e09_floored_division", "SELECT region, CAST(floor((lo - 50000) / 147.0) AS BIGINT) AS bin, ((lo - 50000) % 147 + 147) % 147 AS rest FROM regions")
def e09(v: Tables):
    x = F.col("lo") - 50000
    return v.regions.select("region", F.floor(x / 147).alias("bin"), F.pmod(x, F.lit(147)).alias("rest"))


@query("e10_half_even", "SELECT region, round_even((hi - lo) / 4.0, 0) AS half_even, round((hi - lo) / 4.0, 0) AS half_up FROM regions")
def e10(v: Tables):
    x = (F.col("hi") - F.col("lo")) / 4
    return v.regions.select("region", F.bround(x, 0).alias("half_even"), F.round(x, 0).alias("half_up"))


@query("e12_spread", "SELECT gene, round(stddev_samp(v), 6) AS sd, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM (SELECT gene, CAST(floor(value / 1000) AS DOUBLE) AS v FROM clusters) GROUP BY gene")
def e12(v: Tables):
    x = F.floor(F.col("value") / 1000).cast("double")
    return v.clusters.groupBy("gene").agg(F.round(F.stddev_samp(x), 6).alias("sd"), F.percentile(x, 0.5).alias("median"), (F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias("iqr"))


_PER_SAMPLE = "SELECT pair, sample, CAST(neither AS BIGINT) AS neither, CAST(first AS BIGINT) AS first, CAST(second AS BIGINT) AS second, CAST(joint AS BIGINT) AS joint FROM tables"
_TESTABLE = "first + joint >= 2 AND second + joint >= 2"


@query("x04_fisher_by_family", f"WITH {_FISHER.format(src=_PER_SAMPLE)}, ok AS (SELECT pair, sample, round(p, 6) AS p FROM t JOIN p USING (neither, first, second, joint) WHERE {_TESTABLE}), {_BH.format(fam='sample', src='ok')} SELECT pair, sample, p, round(fdr, 6) AS fdr FROM q UNION ALL SELECT pair, sample, NULL, NULL FROM t WHERE NOT ({_TESTABLE})")
def x04(v: Tables):
    tested = S.fisher(v.tables).withColumn("p", F.when(F.expr(_TESTABLE), F.round("p", 6)))
    return S.benjamini_hochberg(tested, family=["sample"]).select("pair", "sample", "p", F.round("fdr", 6).alias("fdr"))


_METRICS = "s AS (SELECT gene, sample, 'coarse' AS metric, floor(value / 10000) AS v FROM clusters UNION ALL SELECT gene, sample, 'fine', floor(value / 100) FROM clusters UNION ALL SELECT gene, sample, 'kind', CAST(cluster AS DOUBLE) FROM clusters WHERE cluster IS NOT NULL)"


@query("x25_three_metrics", f"WITH {_METRICS}, r AS (SELECT *, rank() OVER (PARTITION BY gene, metric ORDER BY v) + (count(*) OVER (PARTITION BY gene, metric, v) - 1) / 2.0 AS r FROM s), ties AS (SELECT gene, metric, sum(t * t * t - t) AS ties FROM (SELECT gene, metric, count(*) * 1.0 AS t FROM s GROUP BY gene, metric, v) GROUP BY gene, metric), g AS (SELECT gene, metric, sample, sum(r) AS s, count(*) AS k FROM r GROUP BY gene, metric, sample), q AS (SELECT gene, metric, sum(s * s / k) AS q, CAST(sum(k) AS BIGINT) AS n, count(*) AS groups FROM g GROUP BY gene, metric) SELECT q.gene, q.metric, n, groups, round((12.0 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - ties / (n * 1.0 * n * n - n)), 6) AS h FROM q JOIN ties ON q.gene = ties.gene AND q.metric = ties.metric")
def x25(v: Tables):
    metrics = {"coarse": F.floor(F.col("value") / 10_000), "fine": F.floor(F.col("value") / 100), "kind": F.col("cluster")}
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), x.cast("double").alias("v")) for k, x in metrics.items())))
    rows = v.clusters.select("gene", "sample", long.alias("m")).select("gene", "sample", "m.metric", "m.v").where("v IS NOT NULL")
    return S.kruskal(rows, "v", "sample", by=["gene", "metric"]).withColumn("h", F.round("h", 6))
