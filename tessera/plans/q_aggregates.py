"""Aggregation, ranking and ordering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import intervals as I
from ..operators import stats as S
from .q_intervals import _BLK, _OPEN, _OVER, _PAIRS, _members
from .registry import Tables, query


def _opened(v: Tables):
    spans = I.covered_and_open(v.regions, v.reads, v.elements)
    return spans.join(v.reads.select("read", "sample", "donor", F.col("lo").alias("rlo")), "read").join(v.regions.select("region", "kind"), "region")


def _pair_reads(v: Tables):
    """Per pair and shared read, the openness of both sides: reads carry their regions, pairs meet them there."""
    pairs = I.pairs_within(_members(v), least=500, most=2000).select("a", "b").distinct()
    o = _opened(v).select("region", "read", "sample", "open")
    first = o.select(F.col("region").alias("a"), "read", "sample", F.col("open").alias("oa"))
    second = o.select(F.col("region").alias("b"), "read", F.col("open").alias("ob"))
    return pairs.join(first, "a").join(second, ["b", "read"])


_PR = f"{_PAIRS}, {_OPEN}, pr AS (SELECT p.a, p.b, x.read, x.sample, x.open AS oa, y.open AS ob FROM (SELECT DISTINCT a, b FROM prs) p JOIN opened x ON x.region = p.a JOIN opened y ON y.region = p.b AND y.read = x.read)"
_CELLS = "count(*) AS n, count(*) FILTER (NOT oa AND NOT ob) AS neither, count(*) FILTER (oa AND NOT ob) AS first, count(*) FILTER (NOT oa AND ob) AS second, count(*) FILTER (oa AND ob) AS joint"


def _cells():
    a, b = F.col("oa"), F.col("ob")
    return [F.count("*").alias("n"), F.count_if(~a & ~b).alias("neither"), F.count_if(a & ~b).alias("first"), F.count_if(~a & b).alias("second"), F.count_if(a & b).alias("joint")]


@query("a01_pair_counts", f"WITH {_PR} SELECT a, b, {_CELLS} FROM pr GROUP BY a, b")
def a01(v: Tables):
    return _pair_reads(v).groupBy("a", "b").agg(*_cells())


@query("a02_read_configuration", f"WITH {_PR} SELECT a, b, read, CASE WHEN oa AND ob THEN 'both' WHEN oa THEN 'first' WHEN ob THEN 'second' ELSE 'neither' END AS config FROM pr")
def a02(v: Tables):
    return _pair_reads(v).select("a", "b", "read", F.when(F.col("oa") & F.col("ob"), "both").when(F.col("oa"), "first").when(F.col("ob"), "second").otherwise("neither").alias("config"))


@query("a03_pooled_counts", "SELECT pair, CAST(sum(neither) AS BIGINT) AS neither, CAST(sum(first) AS BIGINT) AS first, CAST(sum(second) AS BIGINT) AS second, CAST(sum(joint) AS BIGINT) AS joint, count(*) AS n_samples, count(*) FILTER (n > 5) AS contributing FROM tables GROUP BY pair HAVING sum(first + second + joint) > 0")
def a03(v: Tables):
    got = v.tables.groupBy("pair").agg(*(F.sum(c).alias(c) for c in ("neither", "first", "second", "joint")), F.count("*").alias("n_samples"), F.count_if(F.col("n") > 5).alias("contributing"))
    return got.where("first + second + joint > 0")


@query("a04_counts_per_sample", f"WITH {_PR} SELECT sample, a, b, {_CELLS} FROM pr GROUP BY sample, a, b")
def a04(v: Tables):
    return _pair_reads(v).groupBy("sample", "a", "b").agg(*_cells())


_ALLELE = f"WITH {_OPEN} SELECT region, donor % 5 AS unit, CASE WHEN read % 2 = 0 THEN 'ref' ELSE 'alt' END AS allele, open FROM opened"


@query("a05_allele_counts", f"SELECT region, count(*) FILTER (allele = 'ref' AND open) AS ref_open, count(*) FILTER (allele = 'ref' AND NOT open) AS ref_closed, count(*) FILTER (allele = 'alt' AND open) AS alt_open, count(*) FILTER (allele = 'alt' AND NOT open) AS alt_closed FROM ({_ALLELE}) GROUP BY region")
def a05(v: Tables):
    ref, o = F.col("read") % 2 == 0, F.col("open")
    return _opened(v).groupBy("region").agg(F.count_if(ref & o).alias("ref_open"), F.count_if(ref & ~o).alias("ref_closed"), F.count_if(~ref & o).alias("alt_open"), F.count_if(~ref & ~o).alias("alt_closed"))


@query("a06_donor_sums", "SELECT pair, sample % 3 AS donor, CAST(sum(neither) AS BIGINT) AS neither, CAST(sum(joint) AS BIGINT) AS joint FROM tables GROUP BY pair, sample % 3")
def a06(v: Tables):
    return v.tables.groupBy("pair", (F.col("sample") % 3).alias("donor")).agg(F.sum("neither").alias("neither"), F.sum("joint").alias("joint"))


@query("a07_pooled_alleles", f"WITH u AS (SELECT region, unit, count(*) FILTER (allele = 'ref') AS r, count(*) FILTER (allele = 'alt') AS a, count(*) FILTER (allele = 'ref' AND open) AS ro FROM ({_ALLELE}) GROUP BY region, unit HAVING count(*) FILTER (allele = 'ref') >= 3 AND count(*) FILTER (allele = 'alt') >= 3), s AS (SELECT region, CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(a) AS BIGINT) AS n_alt, CAST(sum(ro) AS BIGINT) AS ref_open, count(*) AS units FROM u GROUP BY region) SELECT g.region, coalesce(n_ref, 0) AS n_ref, coalesce(n_alt, 0) AS n_alt, coalesce(ref_open, 0) AS ref_open, coalesce(units, 0) AS units FROM regions g LEFT JOIN s ON g.region = s.region")
def a07(v: Tables):
    ref = F.col("read") % 2 == 0
    u = _opened(v).groupBy("region", (F.col("donor") % 5).alias("unit")).agg(F.count_if(ref).alias("r"), F.count_if(~ref).alias("a"), F.count_if(ref & F.col("open")).alias("ro")).where("r >= 3 AND a >= 3")
    s = u.groupBy("region").agg(F.sum("r").alias("n_ref"), F.sum("a").alias("n_alt"), F.sum("ro").alias("ref_open"), F.count("*").alias("units"))
    return v.regions.select("region").join(s, "region", "left").select("region", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_ref", "n_alt", "ref_open", "units")))


@query("a09_ratio_of_means", "SELECT donor % 10 AS unit, round(avg(CASE WHEN chrom = 0 THEN hi - lo END) / avg(CASE WHEN chrom > 0 THEN hi - lo END), 6) AS ratio FROM reads GROUP BY donor % 10")
def a09(v: Tables):
    w = F.col("hi") - F.col("lo")
    return v.reads.groupBy((F.col("donor") % 10).alias("unit")).agg(F.round(F.avg(F.when(F.col("chrom") == 0, w)) / F.avg(F.when(F.col("chrom") > 0, w)), 6).alias("ratio"))


_FREQ = f"{_OPEN}, fr AS (SELECT g.region, t.sample, count(o.read) AS n_reads, count(*) FILTER (o.open) AS n_open FROM regions g CROSS JOIN (SELECT DISTINCT sample FROM reads) t LEFT JOIN opened o ON o.region = g.region AND o.sample = t.sample GROUP BY g.region, t.sample), freq AS (SELECT *, CASE WHEN n_reads > 0 THEN n_open * 1.0 / n_reads END AS freq FROM fr)"


def _freq(v: Tables):
    o = _opened(v).groupBy("region", "sample").agg(F.count("*").alias("n_reads"), F.count_if("open").alias("n_open"))
    grid = v.regions.select("region").crossJoin(F.broadcast(v.reads.select("sample").distinct()))
    f = grid.join(o, ["region", "sample"], "left").select("region", "sample", F.coalesce("n_reads", F.lit(0)).alias("n_reads"), F.coalesce("n_open", F.lit(0)).alias("n_open"))
    return f.withColumn("freq", S.ratio(F.col("n_open"), F.col("n_reads")))


@query("a10_open_frequency", f"WITH {_FREQ} SELECT region, sample, n_reads, n_open, round(freq, 6) AS freq FROM freq")
def a10(v: Tables):
    return _freq(v).withColumn("freq", F.round("freq", 6))


@query("a11_wide", f"WITH {_FREQ} SELECT region, {', '.join(f'max(n_reads) FILTER (sample = {k}) AS reads_{k}, round(max(freq) FILTER (sample = {k}), 6) AS freq_{k}' for k in range(4))} FROM freq GROUP BY region")
def a11(v: Tables):
    wide = _freq(v).groupBy("region").pivot("sample", [0, 1, 2, 3]).agg(F.max("n_reads").alias("reads"), F.round(F.max("freq"), 6).alias("freq"))
    return wide.select("region", *(F.col(f"{k}_{c}").alias(f"{c}_{k}") for k in range(4) for c in ("reads", "freq")))


@query("a12_gene_lists", f"WITH {_PAIRS} SELECT a, b, count(DISTINCT gene) AS n_genes, string_agg(DISTINCT CAST(gene AS VARCHAR), ';' ORDER BY CAST(gene AS VARCHAR)) AS genes FROM prs GROUP BY a, b")
def a12(v: Tables):
    return I.pairs_within(_members(v), least=500, most=2000).groupBy("a", "b").agg(F.countDistinct("gene").alias("n_genes"), F.array_join(F.array_sort(F.collect_set(F.col("gene").cast("string"))), ";").alias("genes"))


@query("a13_pileup", "SELECT sample, chrom, pos, count(*) FILTER (called = 1) AS calls, round(count(*) FILTER (called = 1) * 1.0 / max(g.n), 6) AS fraction FROM calls c JOIN (SELECT sample AS s2, count(*) AS n FROM reads GROUP BY sample) g ON c.sample = g.s2 GROUP BY sample, chrom, pos")
def a13(v: Tables):
    size = v.reads.groupBy("sample").agg(F.count("*").alias("g"))
    return v.calls.groupBy("sample", "chrom", "pos").agg(F.count_if(F.col("called") == 1).alias("calls")).join(F.broadcast(size), "sample").select("sample", "chrom", "pos", "calls", F.round(F.col("calls") / F.col("g"), 6).alias("fraction"))


@query("a14_covering_fraction", "SELECT g.region, g.mid, count(DISTINCT r.read) AS covering, count(DISTINCT c.read) AS called, round(count(DISTINCT c.read) * 1.0 / count(DISTINCT r.read), 6) AS fraction FROM (SELECT region, chrom, CAST(floor((lo + hi) / 2) AS BIGINT) AS mid FROM regions) g JOIN reads r ON r.chrom = g.chrom AND g.mid >= r.lo AND g.mid < r.hi LEFT JOIN calls c ON c.read = r.read AND c.pos = g.mid AND c.called = 1 GROUP BY g.region, g.mid")
def a14(v: Tables):
    mid = v.regions.select("region", "chrom", F.floor((F.col("lo") + F.col("hi")) / 2).alias("mid"))
    cov = I.point_join(mid, v.reads, pos="mid").select(F.col("a_region").alias("region"), F.col("a_mid").alias("mid"), F.col("b_read").alias("read"))
    hit = v.calls.where("called = 1").select("read", F.col("pos").alias("mid")).distinct().withColumn("hit", F.lit(1))
    return cov.join(hit, ["read", "mid"], "left").groupBy("region", "mid").agg(F.countDistinct("read").alias("covering"), F.count("hit").alias("called"), F.round(F.count("hit") / F.countDistinct("read"), 6).alias("fraction"))


@query("a15_read_proportion_all", "SELECT c.chrom, c.read, round(sum(c.called) * 1.0 / s.sites, 6) AS proportion FROM calls c LEFT JOIN (SELECT chrom, count(DISTINCT pos) AS sites FROM calls WHERE called = 1 GROUP BY chrom) s ON s.chrom = c.chrom GROUP BY c.chrom, c.read, s.sites")
def a15_all(v: Tables):
    sites = v.calls.where("called = 1").groupBy("chrom").agg(F.countDistinct("pos").alias("sites"))
    each = v.calls.groupBy("chrom", "read").agg(F.sum("called").alias("s"))
    return each.join(F.broadcast(sites), "chrom", "left").select("chrom", "read", F.round(F.col("s") / F.col("sites"), 6).alias("proportion"))


_MATRIX = "pos AS (SELECT DISTINCT chrom, pos FROM calls WHERE called = 1), mat AS (SELECT r.read, r.sample, p.chrom, p.pos, coalesce(max(c.called), 0) AS v FROM pos p JOIN reads r ON r.chrom = p.chrom AND p.pos >= r.lo AND p.pos < r.hi LEFT JOIN calls c ON c.read = r.read AND c.pos = p.pos GROUP BY r.read, r.sample, p.chrom, p.pos)"


def _matrix(v: Tables):
    pos = v.calls.where("called = 1").select("chrom", "pos").distinct()
    # each read carries its own few calls, so that the matrix, far larger than its sources, is never shuffled
    c = v.calls.groupBy("read", "pos").agg(F.max("called").alias("v")).groupBy("read").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("own"))
    cov = I.point_join(pos, v.reads.join(c, "read", "left"))
    return cov.select(F.col("b_read").alias("read"), F.col("b_sample").alias("sample"), F.col("a_chrom").alias("chrom"), F.col("a_pos").alias("pos"), F.coalesce(F.element_at("b_own", F.col("a_pos")), F.lit(0)).alias("v"))


@query("a17_matrix_all", f"WITH {_MATRIX} SELECT read, pos, v FROM mat")
def a17_all(v: Tables):
    return _matrix(v).select("read", "pos", "v")


@query("a16_observed_columns_all", f"WITH {_MATRIX} SELECT chrom, pos, count(*) AS reads, CAST(sum(v) AS BIGINT) AS calls FROM mat GROUP BY chrom, pos HAVING count(*) >= 3")
def a16_all(v: Tables):
    return _matrix(v).groupBy("chrom", "pos").agg(F.count("*").alias("reads"), F.sum("v").alias("calls")).where("reads >= 3")


@query("a18_read_info", "SELECT read, min(lo) AS lo, max(hi) AS hi, count(*) AS blocks, min(sample) AS sample FROM elements GROUP BY read")
def a18(v: Tables):
    return v.elements.groupBy("read").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("blocks"), F.min("sample").alias("sample"))


@query("a20_cluster_means", "SELECT cluster, gene, round(avg(value), 6) AS mean, count(*) AS n FROM clusters WHERE cluster IS NOT NULL GROUP BY cluster, gene")
def a20(v: Tables):
    return v.clusters.where("cluster IS NOT NULL").groupBy("cluster", "gene").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("a21_cluster_profile_filled", "WITH g AS (SELECT DISTINCT c.cluster, p.bin FROM clusters c CROSS JOIN (SELECT unnest(generate_series(0, 99)) AS bin) p WHERE c.cluster IS NOT NULL), s AS (SELECT k.cluster, CAST(floor((c.pos % 1000) / 10) AS BIGINT) AS bin, sum(c.called) * 1.0 / count(*) AS f FROM calls c JOIN clusters k ON c.read = k.read WHERE k.cluster IS NOT NULL GROUP BY 1, 2) SELECT g.cluster, CAST(g.bin AS BIGINT) AS bin, round(coalesce(s.f, 0), 6) AS fraction FROM g LEFT JOIN s ON g.cluster = s.cluster AND g.bin = s.bin")
def a21(v: Tables):
    k = v.clusters.where("cluster IS NOT NULL").select("read", "cluster")
    s = v.calls.join(k, "read").groupBy("cluster", F.floor((F.col("pos") % 1000) / 10).alias("bin")).agg((F.sum("called") / F.count("*")).alias("f"))
    g = k.select("cluster").distinct().select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("bin"))
    return g.join(s, ["cluster", "bin"], "left").select("cluster", "bin", F.round(F.coalesce("f", F.lit(0.0)), 6).alias("fraction"))


@query("a22_group_rate", "SELECT k.cluster, CAST(sum(c.called) AS BIGINT) AS calls, count(DISTINCT c.read) AS reads, round(sum(c.called) * 1.0 / count(*), 6) AS rate FROM calls c JOIN clusters k ON c.read = k.read GROUP BY k.cluster")
def a22(v: Tables):
    return v.calls.join(v.clusters.select("read", "cluster"), "read").groupBy("cluster").agg(F.sum("called").alias("calls"), F.countDistinct("read").alias("reads"), F.round(F.sum("called") / F.count("*"), 6).alias("rate"))


@query("a23_occupancy_all", f"WITH {_BLK} SELECT chrom, pos, count(DISTINCT read) AS n FROM (SELECT read, chrom, unnest(generate_series(lo, hi - 1)) AS pos FROM blk) GROUP BY chrom, pos")
def a23_all(v: Tables):
    each = B.expand(v.beds).select("read", "chrom", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"))
    return each.distinct().groupBy("chrom", "pos").agg(F.count("*").alias("n"))


@query("a26_composition", "WITH n AS (SELECT cluster, sample, count(*) AS n FROM clusters WHERE cluster IS NOT NULL GROUP BY cluster, sample), g AS (SELECT c.cluster, s.sample FROM (SELECT DISTINCT cluster FROM clusters WHERE cluster IS NOT NULL) c CROSS JOIN (SELECT DISTINCT sample FROM clusters) s) SELECT g.cluster, g.sample, coalesce(n.n, 0) AS n, round(coalesce(n.n, 0) * 1.0 / sum(coalesce(n.n, 0)) OVER (PARTITION BY g.cluster), 6) AS proportion FROM g LEFT JOIN n ON g.cluster = n.cluster AND g.sample = n.sample")
def a26(v: Tables):
    some = v.clusters.where("cluster IS NOT NULL")
    n = some.groupBy("cluster", "sample").agg(F.count("*").alias("n"))
    grid = n.select("cluster").distinct().crossJoin(v.clusters.select("sample").distinct())
    full = grid.join(n, ["cluster", "sample"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("proportion", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("cluster")), 6))


@query("a28_occupancy_fraction", f"WITH {_BLK}, s AS (SELECT g.region, CAST(floor((lo + hi) / 2) AS BIGINT) AS mid, g.chrom FROM regions g), spanning AS (SELECT region, mid, read FROM s JOIN reads r ON r.chrom = s.chrom AND mid >= r.lo AND mid < r.hi), occ AS (SELECT DISTINCT region, read FROM s JOIN blk b ON b.chrom = s.chrom AND mid >= b.lo AND mid < b.hi) SELECT a.region, count(*) AS spanning, count(o.read) AS occupied, round(count(o.read) * 1.0 / count(*), 6) AS fraction FROM spanning a LEFT JOIN occ o ON a.region = o.region AND a.read = o.read GROUP BY a.region")
def a28(v: Tables):
    mid = v.regions.select("region", "chrom", F.floor((F.col("lo") + F.col("hi")) / 2).alias("mid"))
    spanning = I.point_join(mid, v.reads, pos="mid").select(F.col("a_region").alias("region"), F.col("b_read").alias("read"))
    occ = I.point_join(mid, B.expand(v.beds), pos="mid").select(F.col("a_region").alias("region"), F.col("b_read").alias("read")).distinct().withColumn("o", F.lit(1))
    return spanning.join(occ, ["region", "read"], "left").groupBy("region").agg(F.count("*").alias("spanning"), F.count("o").alias("occupied"), F.round(F.count("o") / F.count("*"), 6).alias("fraction"))


@query("a29_nearest_each_side", "SELECT r.read, max(CASE WHEN (e.lo + e.hi) / 2 <= (r.lo + r.hi) / 2 THEN e.lo + e.hi - r.lo - r.hi END) AS before2, min(CASE WHEN (e.lo + e.hi) / 2 > (r.lo + r.hi) / 2 THEN e.lo + e.hi - r.lo - r.hi END) AS after2, bool_or(e.lo * 2 <= r.lo + r.hi AND r.lo + r.hi < e.hi * 2) AS occupied, count(*) AS n FROM reads r JOIN elements e ON r.read = e.read GROUP BY r.read")
def a29(v: Tables):
    r = v.reads.select("read", (F.col("lo") + F.col("hi")).alias("c"))
    d = F.col("lo") + F.col("hi") - F.col("c")
    return v.elements.join(r, "read").groupBy("read").agg(F.max(F.when(d <= 0, d)).alias("before2"), F.min(F.when(d > 0, d)).alias("after2"), F.bool_or((F.col("lo") * 2 <= F.col("c")) & (F.col("c") < F.col("hi") * 2)).alias("occupied"), F.count("*").alias("n"))


@query("a30_grouped_medians", "SELECT cluster, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, min(value) AS least, max(value) AS most, round(stddev_samp(value), 4) AS sd FROM clusters GROUP BY cluster")
def a30(v: Tables):
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return v.clusters.groupBy("cluster").agg(q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 4).alias("sd"))


@query("a31_binned_features", "SELECT read, CAST(floor(pos / 50) AS BIGINT) AS bin, round(avg(called), 6) AS mean, count(*) AS sites FROM calls GROUP BY 1, 2")
def a31(v: Tables):
    return v.calls.groupBy("read", F.floor(F.col("pos") / 50).alias("bin")).agg(F.round(F.avg("called"), 6).alias("mean"), F.count("*").alias("sites"))


@query("a32_complete_bins", "SELECT sample, CAST(floor((pos % 1000) / 50) AS BIGINT) AS bin, round(sum(called) * 1.0 / count(*), 6) AS pooled FROM calls WHERE sample IN (SELECT sample FROM calls GROUP BY sample HAVING count(DISTINCT CAST(floor((pos % 1000) / 50) AS BIGINT)) = 20) GROUP BY 1, 2")
def a32(v: Tables):
    bins = v.calls.groupBy("sample", F.floor((F.col("pos") % 1000) / 50).alias("bin")).agg(F.round(F.sum("called") / F.count("*"), 6).alias("pooled"))
    return bins.withColumn("k", F.count("*").over(Window.partitionBy("sample"))).where("k = 20").drop("k")


@query("a34_regional_features", "SELECT read, round(avg(CASE WHEN rel < 300 THEN called END), 6) AS near, round(avg(CASE WHEN rel >= 300 AND rel < 700 THEN called END), 6) AS middle, round(avg(CASE WHEN rel >= 700 THEN called END), 6) AS far, CASE WHEN sum(called) = 0 THEN 'closed' WHEN avg(called) > 0.6 THEN 'open' ELSE 'mixed' END AS archetype FROM (SELECT c.read, called, pos - r.lo AS rel FROM calls c JOIN reads r ON c.read = r.read) GROUP BY read")
def a34(v: Tables):
    c = v.calls.join(v.reads.select("read", "lo"), "read").withColumn("rel", F.col("pos") - F.col("lo"))
    part = lambda cond: F.round(F.avg(F.when(cond, F.col("called"))), 6)
    rel = F.col("rel")
    return c.groupBy("read").agg(part(rel < 300).alias("near"), part((rel >= 300) & (rel < 700)).alias("middle"), part(rel >= 700).alias("far"), F.when(F.sum("called") == 0, "closed").when(F.avg("called") > 0.6, "open").otherwise("mixed").alias("archetype"))


@query("a36_last_writer", "SELECT read, pos, el FROM (SELECT read, el, unnest(generate_series(lo - lo % 25, hi, 25)) AS pos FROM elements) QUALIFY row_number() OVER (PARTITION BY read, pos ORDER BY el DESC) = 1")
def a36(v: Tables):
    each = v.elements.select("read", "el", F.explode(F.sequence(F.col("lo") - F.col("lo") % 25, F.col("hi"), F.lit(25).cast("long"))).alias("pos"))
    return each.groupBy("read", "pos").agg(F.max("el").alias("el"))


@query("a37_first_offset", "SELECT r.read, min(e.lo - r.lo) AS offset FROM reads r LEFT JOIN elements e ON r.read = e.read AND e.lo - r.lo BETWEEN 0 AND 299 GROUP BY r.read".replace(" AS offset", ' AS "offset"'))
def a37(v: Tables):
    e = v.elements.select("read", F.col("lo").alias("elo"))
    return v.reads.join(e, "read", "left").withColumn("d", F.col("elo") - F.col("lo")).groupBy("read").agg(F.min(F.when(F.col("d").between(0, 299), F.col("d"))).alias("offset"))


@query("a38_contained_counts", "SELECT g.gene, count(r.read) AS n, count(*) FILTER (r.strand = g.strand) AS same FROM genes g LEFT JOIN reads r ON r.chrom = g.chrom AND g.lo <= r.lo AND r.hi <= g.hi GROUP BY g.gene")
def a38(v: Tables):
    n = I.containment_join(v.reads, v.genes, width=10_000).groupBy(F.col("b_gene").alias("gene")).agg(F.count("*").alias("n"), F.count_if(F.col("a_strand") == F.col("b_strand")).alias("same"))
    return v.genes.select("gene").join(n, "gene", "left").select("gene", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("same", F.lit(0)).alias("same"))


@query("a42_grouping_sets", "SELECT k.cluster, k.sample, grouping(k.cluster, k.sample) AS level, CAST(sum(c.called) AS BIGINT) AS calls, round(sum(c.called) * 1.0 / count(*), 6) AS rate FROM calls c JOIN clusters k ON c.read = k.read GROUP BY GROUPING SETS ((k.cluster, k.sample), (k.cluster), ())")
def a42(v: Tables):
    j = v.calls.select("read", "called").join(v.clusters.select("read", "cluster", "sample"), "read")
    return j.groupingSets([[F.col("cluster"), F.col("sample")], [F.col("cluster")], []], F.col("cluster"), F.col("sample")).agg(F.grouping_id().alias("level"), F.sum("called").alias("calls"), F.round(F.sum("called") / F.count("*"), 6).alias("rate"))


@query("a46_filled_profile", "WITH g AS (SELECT gene, unnest(generate_series(0, 96)) AS pos FROM (SELECT DISTINCT gene FROM tags)), s AS (SELECT gene, pos, CAST(sum(n) AS BIGINT) AS n FROM tags GROUP BY gene, pos) SELECT g.gene, CAST(g.pos AS BIGINT) AS pos, coalesce(s.n, 0) AS n FROM g LEFT JOIN s ON g.gene = s.gene AND g.pos = s.pos")
def a46(v: Tables):
    grid = v.tags.select("gene").distinct().select("gene", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(96).cast("long"))).alias("pos"))
    return grid.join(v.tags.groupBy("gene", "pos").agg(F.sum("n").alias("n")), ["gene", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("a47_cpm", "SELECT gene, pos, round(n * 1e6 / sum(n) OVER (), 4) AS cpm, round(n * 1.0 / sum(n) OVER (PARTITION BY gene), 6) AS share FROM (SELECT gene, pos, sum(n) AS n FROM tags GROUP BY gene, pos)")
def a47(v: Tables):
    t = v.tags.groupBy("gene", "pos").agg(F.sum("n").alias("n"))
    total = v.tags.agg(F.sum("n").alias("total"))
    return t.crossJoin(F.broadcast(total)).select("gene", "pos", F.round(F.col("n") * 1e6 / F.col("total"), 4).alias("cpm"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gene")), 6).alias("share"))


@query("a48_region_sum", "SELECT r.region, coalesce(CAST(sum(c.n) AS BIGINT), 0) AS total FROM regions r LEFT JOIN (SELECT chrom, pos, count(*) AS n FROM calls GROUP BY chrom, pos) c ON c.chrom = r.chrom AND c.pos >= r.lo AND c.pos < r.hi GROUP BY r.region")
def a48(v: Tables):
    n = v.calls.groupBy("chrom", "pos").agg(F.count("*").alias("n"))
    s = I.point_join(n, v.regions).groupBy(F.col("b_region").alias("region")).agg(F.sum("a_n").alias("t"))
    return v.regions.select("region").join(s, "region", "left").select("region", F.coalesce("t", F.lit(0)).alias("total"))


@query("a49_choice", "SELECT chrom, region, hi - lo AS width FROM regions QUALIFY row_number() OVER (PARTITION BY chrom, kind ORDER BY hi - lo DESC, lo, region) = 1")
def a49(v: Tables):
    w = Window.partitionBy("chrom", "kind").orderBy(F.desc(F.col("hi") - F.col("lo")), "lo", "region")
    return v.regions.withColumn("r", F.row_number().over(w)).where("r = 1").select("chrom", "region", (F.col("hi") - F.col("lo")).alias("width"))


@query("a52_label_consensus", "SELECT gene, CASE WHEN count(DISTINCT cluster) = 0 THEN 'missing' WHEN count(DISTINCT cluster) = 1 THEN 'unique' ELSE 'ambiguous' END AS status, count(DISTINCT cluster) AS labels, count(*) FILTER (cluster IS NULL) AS unassigned FROM (SELECT gene * 100 + read % 97 AS gene, cluster FROM clusters) GROUP BY gene")
def a52(v: Tables):
    k = F.countDistinct("cluster")
    return v.clusters.select((F.col("gene") * 100 + F.col("read") % 97).alias("gene"), "cluster").groupBy("gene").agg(F.when(k == 0, "missing").when(k == 1, "unique").otherwise("ambiguous").alias("status"), k.alias("labels"), F.count_if(F.col("cluster").isNull()).alias("unassigned"))


@query("a54_class_fraction", "WITH c AS (SELECT read, CASE WHEN hi - lo < 200 THEN 'short' WHEN hi - lo < 400 THEN 'middle' ELSE 'long' END AS class, sample FROM elements), n AS (SELECT sample, count(*) AS reads FROM reads GROUP BY sample) SELECT c.sample, class, count(DISTINCT read) AS n, round(count(DISTINCT read) * 1.0 / max(n.reads), 6) AS fraction FROM c JOIN n ON c.sample = n.sample GROUP BY c.sample, class")
def a54(v: Tables):
    w = F.col("hi") - F.col("lo")
    c = v.elements.select("read", "sample", F.when(w < 200, "short").when(w < 400, "middle").otherwise("long").alias("class"))
    n = v.reads.groupBy("sample").agg(F.count("*").alias("reads"))
    return c.groupBy("sample", "class").agg(F.countDistinct("read").alias("n")).join(F.broadcast(n), "sample").select("sample", "class", "n", F.round(F.col("n") / F.col("reads"), 6).alias("fraction"))


@query("a57_percent_wide", "SELECT gene, round(100.0 * count(*) FILTER (sample = 0) / count(*), 4) AS p0, round(100.0 * count(*) FILTER (sample = 1) / count(*), 4) AS p1, round(100.0 * count(*) FILTER (sample = 2) / count(*), 4) AS p2, round(100.0 * count(*) FILTER (sample = 3) / count(*), 4) AS p3 FROM clusters GROUP BY gene")
def a57(v: Tables):
    n = v.clusters.groupBy("gene").pivot("sample", [0, 1, 2, 3]).agg(F.count("read")).fillna(0)
    total = F.col("0") + F.col("1") + F.col("2") + F.col("3")
    return n.select("gene", *(F.round(F.lit(100.0) * F.col(f"{k}") / total, 4).alias(f"p{k}") for k in range(4)))


@query("a58_exploded_categories", "SELECT category, count(*) AS n, CAST(sum(hi - lo) AS BIGINT) AS bases FROM (SELECT 'All' AS category, lo, hi FROM regions UNION ALL SELECT 'Annotated', lo, hi FROM regions WHERE kind > 0 UNION ALL SELECT concat('kind ', CAST(kind AS VARCHAR)), lo, hi FROM regions) GROUP BY category")
def a58(v: Tables):
    names = F.filter(F.array(F.lit("All"), F.when(F.col("kind") > 0, "Annotated"), F.concat(F.lit("kind "), F.col("kind").cast("string"))), lambda x: x.isNotNull())
    return v.regions.select(F.explode(names).alias("category"), (F.col("hi") - F.col("lo")).alias("w")).groupBy("category").agg(F.count("*").alias("n"), F.sum("w").alias("bases"))


@query("a62_distinct_summary", "SELECT cluster, count(*) AS genes, round(median(gene), 4) AS median_gene FROM (SELECT DISTINCT cluster, gene FROM clusters) GROUP BY cluster")
def a62(v: Tables):
    return v.clusters.select("cluster", "gene").distinct().groupBy("cluster").agg(F.count("*").alias("genes"), F.round(F.percentile("gene", F.lit(0.5)), 4).alias("median_gene"))


@query("a67_contingency", "SELECT cluster, count(*) FILTER (sample = 0) AS s0, count(*) FILTER (sample = 1) AS s1, count(*) FILTER (sample = 2) AS s2, count(*) FILTER (sample = 3) AS s3 FROM clusters GROUP BY cluster")
def a67(v: Tables):
    wide = v.clusters.groupBy("cluster").pivot("sample", [0, 1, 2, 3]).agg(F.count("read")).fillna(0, ["0", "1", "2", "3"])
    return wide.select("cluster", *(F.col(str(k)).alias(f"s{k}") for k in range(4)))


@query("a75_trend", "WITH w AS (SELECT pair, sample AS t, ln((joint + 0.5) * (neither + 0.5) / ((first + 0.5) * (second + 0.5))) AS lor, 1 / (1 / (joint + 0.5) + 1 / (neither + 0.5) + 1 / (first + 0.5) + 1 / (second + 0.5)) AS wt FROM tables), s AS (SELECT pair, sum(wt) AS sw, sum(wt * t) AS st, sum(wt * lor) AS sl, sum(wt * t * t) AS stt, sum(wt * t * lor) AS stl, count(*) AS k FROM w GROUP BY pair) SELECT pair, k, round((sw * stl - st * sl) / (sw * stt - st * st), 4) AS slope, round((sw * stl - st * sl) / (sw * stt - st * st) / sqrt(sw / (sw * stt - st * st)), 4) AS z FROM s WHERE k > 1")
def a75(v: Tables):
    c = {x: F.col(x) + 0.5 for x in ("joint", "neither", "first", "second")}
    w = v.tables.select("pair", F.col("sample").alias("t"), F.log(c["joint"] * c["neither"] / (c["first"] * c["second"])).alias("lor"), (1 / (1 / c["joint"] + 1 / c["neither"] + 1 / c["first"] + 1 / c["second"])).alias("wt"))
    s = w.groupBy("pair").agg(F.sum("wt").alias("sw"), F.sum(F.col("wt") * F.col("t")).alias("st"), F.sum(F.col("wt") * F.col("lor")).alias("sl"), F.sum(F.col("wt") * F.col("t") * F.col("t")).alias("stt"), F.sum(F.col("wt") * F.col("t") * F.col("lor")).alias("stl"), F.count("*").alias("k")).where("k > 1")
    det = F.col("sw") * F.col("stt") - F.col("st") * F.col("st")
    slope = (F.col("sw") * F.col("stl") - F.col("st") * F.col("sl")) / det
    return s.select("pair", "k", F.round(slope, 4).alias("slope"), F.round(slope / F.sqrt(F.col("sw") / det), 4).alias("z"))


@query("a77_pairwise_delta", f"WITH {_FREQ} SELECT x.region, x.sample AS s1, y.sample AS s2, round(y.freq - x.freq, 6) AS delta FROM freq x JOIN freq y ON x.region = y.region AND x.sample < y.sample WHERE x.freq IS NOT NULL AND y.freq IS NOT NULL")
def a77(v: Tables):
    f = _freq(v).where("freq IS NOT NULL").select("region", "sample", "freq")
    held = f.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("sample", "freq"))).alias("p"))  # at most one entry per sample
    pairs = held.select("region", F.posexplode("p").alias("i", "x"), "p").select("region", "x", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("y"))
    return pairs.select("region", F.col("x.sample").alias("s1"), F.col("y.sample").alias("s2"), F.round(F.col("y.freq") - F.col("x.freq"), 6).alias("delta"))


@query("a82_choice_by_votes", "SELECT region, read FROM (SELECT region, read, count(*) AS n, min(abs(e.lo - a.lo)) AS d FROM regions a JOIN elements e ON a.chrom = e.chrom AND a.lo < e.hi AND e.lo < a.hi GROUP BY region, read) QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, d, read) = 1")
def a82(v: Tables):
    n = I.overlap_join(v.regions, v.elements).groupBy(F.col("a_region").alias("region"), F.col("b_read").alias("read")).agg(F.count("*").alias("n"), F.min(F.abs(F.col("b_lo") - F.col("a_lo"))).alias("d"))
    best = n.groupBy("region").agg(F.min(F.struct((-F.col("n")).alias("n"), "d", "read")).alias("b"))
    return best.select("region", "b.read")


# ---------------------------------------------------------------- windows (W)


@query("w01_rank_of_passing", "SELECT region, kind, CASE WHEN kind > 0 THEN rank() OVER (PARTITION BY kind > 0, chrom ORDER BY hi - lo DESC) END AS place FROM regions")
def w01(v: Tables):
    w = Window.partitionBy(F.col("kind") > 0, "chrom").orderBy(F.desc(F.col("hi") - F.col("lo")))
    return v.regions.select("region", "kind", F.when(F.col("kind") > 0, F.rank().over(w).cast("long")).alias("place"))


@query("w02_average_ranks", "SELECT region, (rank() OVER (ORDER BY hi - lo) + (count(*) OVER (PARTITION BY hi - lo) - 1) / 2.0) AS r, (rank() OVER (PARTITION BY chrom ORDER BY hi - lo) + (count(*) OVER (PARTITION BY chrom, hi - lo) - 1) / 2.0) AS by_chrom FROM regions")
def w02(v: Tables):
    sized = v.regions.withColumn("w", F.col("hi") - F.col("lo"))
    return S.average_rank(S.average_rank(sized, "w", "r"), "w", "by_chrom", by=["chrom"]).select("region", "r", "by_chrom")


@query("w03_rolling_rows", "SELECT gene, pos, CASE WHEN count(*) OVER w = 4 THEN round(avg(n) OVER w, 6) END AS mean FROM (SELECT gene, pos, sum(n) AS n FROM tags GROUP BY gene, pos) WINDOW w AS (PARTITION BY gene ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
def w03(v: Tables):
    t = v.tags.groupBy("gene", "pos").agg(F.sum("n").alias("n"))
    return S.rolling_rows(t, "n", "mean", 4, by=["gene"], order="pos").select("gene", "pos", F.round("mean", 6).alias("mean"))


@query("w04_rolling_distance", "SELECT gene, pos, round(avg(n) OVER (PARTITION BY gene ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS mean FROM (SELECT gene, pos, sum(n) AS n FROM tags GROUP BY gene, pos)")
def w04(v: Tables):
    t = v.tags.groupBy("gene", "pos").agg(F.sum("n").alias("n"))
    return S.rolling_distance(t, "n", "mean", 20, by=["gene"], order="pos").select("gene", "pos", F.round("mean", 6).alias("mean"))


@query("w05_cdf_and_quantile", "SELECT read, round(row_number() OVER w * 1.0 / count(*) OVER (PARTITION BY cluster), 6) AS cdf, round((row_number() OVER w - 0.5) / count(*) OVER (PARTITION BY cluster), 6) AS expected FROM clusters WINDOW w AS (PARTITION BY cluster ORDER BY value, read)")
def w05(v: Tables):
    r = F.row_number().over(Window.partitionBy("cluster").orderBy("value", "read"))
    n = F.count("*").over(Window.partitionBy("cluster"))
    return v.clusters.select("read", F.round(r / n, 6).alias("cdf"), F.round((r - 0.5) / n, 6).alias("expected"))


@query("w07_tag_width", "WITH t AS (SELECT gene, pos, sum(n) AS n FROM tags GROUP BY gene, pos), c AS (SELECT gene, pos, sum(n) OVER (PARTITION BY gene ORDER BY pos) AS c, sum(n) OVER (PARTITION BY gene) AS t FROM t) SELECT gene, min(pos) FILTER (10 * c >= t) AS q10, min(pos) FILTER (10 * c >= 9 * t) AS q90, min(pos) FILTER (10 * c >= 9 * t) - min(pos) FILTER (10 * c >= t) + 1 AS width FROM c GROUP BY gene")
def w07(v: Tables):
    return S.quantile_width(v.tags.groupBy("gene", "pos").agg(F.sum("n").alias("n")), by=["gene"], pos="pos", n="n")


@query("w09_fraction_in_group", "SELECT sample, cluster, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY sample), 6) AS fraction FROM clusters GROUP BY sample, cluster")
def w09(v: Tables):
    n = v.clusters.groupBy("sample", "cluster").agg(F.count("*").alias("n"))
    return n.select("sample", "cluster", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("sample")), 6).alias("fraction"))


@query("w10_relabel_by_size", "SELECT cluster, n, concat('cluster', CAST(row_number() OVER (ORDER BY n DESC, cluster) AS VARCHAR)) AS label FROM (SELECT cluster, count(*) AS n FROM clusters WHERE cluster IS NOT NULL GROUP BY cluster)")
def w10(v: Tables):
    n = v.clusters.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"))
    return n.select("cluster", "n", F.concat(F.lit("cluster"), F.row_number().over(Window.orderBy(F.desc("n"), "cluster")).cast("string")).alias("label"))


@query("w11_read_order", "SELECT read, row_number() OVER (PARTITION BY gene ORDER BY cluster NULLS LAST, value, read) AS place FROM clusters")
def w11(v: Tables):
    return v.clusters.select("read", F.row_number().over(Window.partitionBy("gene").orderBy(F.asc_nulls_last("cluster"), "value", "read")).cast("long").alias("place"))


@query("w16_thirds", "SELECT read, CASE WHEN r <= n / 3.0 THEN 'low' WHEN r <= 2 * n / 3.0 THEN 'middle' ELSE 'high' END AS third FROM (SELECT read, row_number() OVER (PARTITION BY gene ORDER BY value, read) AS r, count(*) OVER (PARTITION BY gene) AS n FROM clusters)")
def w16(v: Tables):
    r = F.row_number().over(Window.partitionBy("gene").orderBy("value", "read"))
    n = F.count("*").over(Window.partitionBy("gene"))
    return v.clusters.select("read", r.alias("r"), n.alias("n")).select("read", F.when(F.col("r") <= F.col("n") / 3.0, "low").when(F.col("r") <= 2 * F.col("n") / 3.0, "middle").otherwise("high").alias("third"))


@query("w17_tertiles", "SELECT read, CASE WHEN value <= q1 THEN 1 WHEN value <= q2 THEN 2 ELSE 3 END AS tertile FROM clusters c JOIN (SELECT sample, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q2 FROM clusters GROUP BY sample) q ON c.sample = q.sample")
def w17(v: Tables):
    q = v.clusters.groupBy("sample").agg(F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q2"))
    return v.clusters.join(F.broadcast(q), "sample").select("read", F.when(F.col("value") <= F.col("q1"), 1).when(F.col("value") <= F.col("q2"), 2).otherwise(3).alias("tertile"))
