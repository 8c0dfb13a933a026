"""Further operators of the survey: attachments, audits, summaries, ranks and supporting projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import select as P
from ..operators import stats as S
from .q_aggregates import _FREQ, _OPEN, _freq, _opened
from .q_statistics import _BH, _FISHER
from .registry import Tables, query


def _n(x, k=6):
    return F.round(x, k)


# ---------------------------------------------------------------- coordinates, identities, attachments


@query("t18_class_from_id", "SELECT p_partkey, regexp_replace(concat('E', CAST(p_partkey AS VARCHAR), '.', CAST(p_size AS VARCHAR), '.', replace(p_brand, '#', '')), '^[^.]*\\.[^.]*\\.', '') AS class FROM part")
def t18(v: Tables):
    name = F.concat(F.lit("E"), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit("."), F.replace("p_brand", F.lit("#"), F.lit("")))
    return v.part.select("p_partkey", F.regexp_replace(name, r"^[^.]*\.[^.]*\.", "").alias("class"))


@query("t19_read_identity", "SELECT read, split_part(id, '::', 1) AS sample, split_part(id, '::', 2) AS name, split_part(id, '::', 2) = '' AS invalid FROM (SELECT read, CASE WHEN read % 13 = 0 THEN concat('s', CAST(sample AS VARCHAR), '::') ELSE concat('s', CAST(sample AS VARCHAR), '::', CAST(read AS VARCHAR)) END AS id FROM reads)")
def t19(v: Tables):
    id_ = F.concat(F.lit("s"), F.col("sample").cast("string"), F.lit("::"), F.when(F.col("read") % 13 == 0, "").otherwise(F.col("read").cast("string")))
    parts = lambda k: F.split_part("id", F.lit("::"), F.lit(k))
    return v.reads.select("read", id_.alias("id")).select("read", parts(1).alias("sample"), parts(2).alias("name"), (parts(2) == "").alias("invalid"))


@query("t22_dominant", "SELECT vec_id, list_position(v, list_max(v)) AS dominant, round(list_max(v), 6) AS loading FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def t22(v: Tables):
    e = v.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.array_position("v", F.array_max("v")).cast("int").alias("dominant"), _n(F.array_max("v")).alias("loading"))


@query("t28_profile_long", "SELECT vec_id, i AS feature, round(x, 6) AS value FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i FROM embeddings)")
def t28(v: Tables):
    return v.embeddings.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).select("vec_id", (F.col("i") + 1).alias("feature"), _n("x").alias("value"))


@query("t29_allele_orientation", "SELECT read, CASE WHEN (read % 3 = 1 AND read % 2 = 0) OR (read % 3 = 2 AND read % 2 = 1) THEN 'ALT' WHEN read % 3 > 0 THEN 'REF' ELSE 'Unassigned' END AS allele FROM reads")
def t29(v: Tables):
    hp, gt = F.col("read") % 3, F.col("read") % 2
    return v.reads.select("read", F.when(((hp == 1) & (gt == 0)) | ((hp == 2) & (gt == 1)), "ALT").when(hp > 0, "REF").otherwise("Unassigned").alias("allele"))


@query("f03_ordered_subset", "SELECT read, CAST(i AS INTEGER) AS place, s AS size FROM (SELECT read, unnest(string_split(rtrim(sizes, ','), ',')) AS s, generate_subscripts(string_split(rtrim(sizes, ','), ','), 1) AS i FROM beds) WHERE CAST(s AS BIGINT) > 30")
def f03(v: Tables):
    from ..operators.blocks import numbers

    return v.beds.select("read", F.posexplode(numbers(F.col("sizes"))).alias("i", "s")).where("s > 30").select("read", (F.col("i") + 1).alias("place"), F.col("s").cast("string").alias("size"))


@query("f08_both_alleles", "SELECT donor, count(*) FILTER (read % 2 = 0) AS ref, count(*) FILTER (read % 2 = 1) AS alt FROM reads GROUP BY donor HAVING count(*) >= 3 AND count(DISTINCT read % 2) = 2")
def f08(v: Tables):
    n = v.reads.groupBy("donor").agg(F.count_if(F.col("read") % 2 == 0).alias("ref"), F.count_if(F.col("read") % 2 == 1).alias("alt"))
    return n.where("ref + alt >= 3 AND ref > 0 AND alt > 0")


@query("f11_sampled_molecules")
def f11(v: Tables):
    return P.sampled(v.reads, 500, key="read", seed=11).select("read", "chrom", "lo", "hi")


@query("f17_response_tiers", f"WITH {_FREQ}, w AS (SELECT region, max(freq) FILTER (sample = 0) AS f0, max(freq) FILTER (sample > 0) AS top, arg_min(sample, (-round(freq, 6), sample)) FILTER (sample > 0 AND freq IS NOT NULL) AS peak FROM freq GROUP BY region) SELECT region, CASE WHEN f0 IS NULL OR top IS NULL THEN 'not called' WHEN top - f0 >= 0.5 THEN 'core' ELSE 'subtle' END AS tier, peak FROM w")
def f17(v: Tables):
    f = _freq(v)
    later = F.col("sample") > 0
    key = F.when(later & F.col("freq").isNotNull(), F.struct((-_n("freq")).alias("f"), "sample"))
    w = f.groupBy("region").agg(F.max(F.when(F.col("sample") == 0, F.col("freq"))).alias("f0"), F.max(F.when(later, F.col("freq"))).alias("top"), F.min(key).alias("k"))
    return w.select("region", F.when(F.col("f0").isNull() | F.col("top").isNull(), "not called").when(F.col("top") - F.col("f0") >= 0.5, "core").otherwise("subtle").alias("tier"), F.col("k.sample").alias("peak"))


@query("j25_fallback", "SELECT g.gene, coalesce(d.pos, g.tss) AS tss, CASE WHEN d.pos IS NULL THEN 'canonical' ELSE 'dominant' END AS source FROM genes g LEFT JOIN (SELECT gene, min(pos) AS pos FROM tags WHERE n > 5 GROUP BY gene) d ON g.gene = d.gene")
def j25(v: Tables):
    d = v.tags.where("n > 5").groupBy("gene").agg(F.min("pos").alias("pos"))
    return v.genes.join(d, "gene", "left").select("gene", F.coalesce("pos", "tss").alias("tss"), F.when(F.col("pos").isNull(), "canonical").otherwise("dominant").alias("source"))


@query("j30_outer_coverage", "WITH a AS (SELECT read, sum(called) AS m FROM calls WHERE pos % 2 = 0 GROUP BY read), b AS (SELECT read, sum(called) AS m FROM calls WHERE pos % 2 = 1 GROUP BY read) SELECT coalesce(a.read, b.read) AS read, CAST(coalesce(a.m, 0) AS BIGINT) AS even, CAST(b.m AS BIGINT) AS odd, a.read IS NULL AS only_odd FROM a FULL OUTER JOIN b ON a.read = b.read")
def j30(v: Tables):
    c = v.calls
    a = c.where("pos % 2 = 0").groupBy("read").agg(F.sum("called").alias("a"))
    b = c.where("pos % 2 = 1").groupBy("read").agg(F.sum("called").alias("odd"))
    return a.join(b, "read", "full").select("read", F.coalesce("a", F.lit(0)).alias("even"), "odd", F.col("a").isNull().alias("only_odd"))


@query("j33_haplotype_groups", "SELECT k.hap, c.chrom, c.pos, count(*) AS reads, CAST(sum(called) AS BIGINT) AS calls FROM calls c JOIN (SELECT read, concat('H', CAST(donor % 3 AS VARCHAR)) AS hap FROM reads WHERE donor % 3 > 0) k ON c.read = k.read GROUP BY k.hap, c.chrom, c.pos")
def j33(v: Tables):
    k = v.reads.where("donor % 3 > 0").select("read", F.concat(F.lit("H"), (F.col("donor") % 3).cast("string")).alias("hap"))
    return v.calls.join(k, "read").groupBy("hap", "chrom", "pos").agg(F.count("*").alias("reads"), F.sum("called").alias("calls"))


@query("j39_audit", "SELECT r.read, CASE WHEN e.read IS NULL THEN 'missing' WHEN r.hi - r.lo < 2000 THEN 'too short' ELSE 'kept' END AS status FROM reads r LEFT JOIN (SELECT DISTINCT read FROM elements) e ON r.read = e.read")
def j39(v: Tables):
    e = v.elements.select("read").distinct().withColumn("e", F.lit(1))
    return v.reads.join(e, "read", "left").select("read", F.when(F.col("e").isNull(), "missing").when(F.col("hi") - F.col("lo") < 2000, "too short").otherwise("kept").alias("status"))


# ---------------------------------------------------------------- aggregation

_CELLS = "SELECT pair, sample, CAST(neither AS BIGINT) AS neither, CAST(first AS BIGINT) AS first, CAST(second AS BIGINT) AS second, CAST(joint AS BIGINT) AS joint FROM tables"


@query("a08_within_sample", f"WITH {_FISHER.format(src=_CELLS)}, j AS (SELECT pair, sample AS fam, round(p, 9) AS p FROM t JOIN p USING (neither, first, second, joint)), {_BH.format(fam='fam', src='j')} SELECT pair, fam AS sample, round(fdr, 6) AS fdr FROM q")
def a08(v: Tables):
    tested = S.fisher(v.tables).withColumn("p", _n("p", 9))
    return S.benjamini_hochberg(tested, family=["sample"]).select("pair", "sample", _n("fdr").alias("fdr"))


@query("a39_body_summary", "SELECT gene, count(*) AS n, round(count(*) FILTER (value > 150000) * 1.0 / count(*), 6) AS fraction, round(median(value), 4) AS median, round(count(*) / 10.001, 6) AS per_kb FROM clusters GROUP BY gene")
def a39(v: Tables):
    return v.clusters.groupBy("gene").agg(F.count("*").alias("n"), _n(F.count_if(F.col("value") > 150_000) / F.count("*")).alias("fraction"), _n(F.percentile("value", F.lit(0.5)), 4).alias("median"), _n(F.count("*") / 10.001).alias("per_kb"))


@query("a51_completed_grid", "SELECT g.gene, s.sample, coalesce(n.n, 0) AS n, round(n.m, 6) AS mean FROM (SELECT DISTINCT gene FROM clusters) g CROSS JOIN (SELECT DISTINCT sample FROM clusters) s LEFT JOIN (SELECT gene, sample, count(*) AS n, avg(value) AS m FROM clusters GROUP BY gene, sample) n ON n.gene = g.gene AND n.sample = s.sample")
def a51(v: Tables):
    n = v.clusters.groupBy("gene", "sample").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    grid = v.clusters.select("gene").distinct().crossJoin(F.broadcast(v.clusters.select("sample").distinct()))
    return grid.join(n, ["gene", "sample"], "left").select("gene", "sample", F.coalesce("n", F.lit(0)).alias("n"), _n("m").alias("mean"))


@query("a55_finite_summary", "SELECT donor, count(*) AS n, round(avg(hi - lo), 6) AS mean, round(CASE WHEN count(*) >= 2 THEN stddev_samp(hi - lo) END, 4) AS sd FROM reads GROUP BY donor")
def a55(v: Tables):
    w = (F.col("hi") - F.col("lo")).cast("double")
    return v.reads.groupBy("donor").agg(F.count("*").alias("n"), _n(F.avg(S.finite(w))).alias("mean"), _n(F.when(F.count("*") >= 2, F.stddev_samp(w)), 4).alias("sd"))


@query("a59_counts_per_region", f"WITH {_OPEN} SELECT region, count(*) AS n_reads, count(*) FILTER (open) AS n_open, count(DISTINCT sample) AS samples, min(rlo) AS first_lo FROM opened GROUP BY region")
def a59(v: Tables):
    return _opened(v).groupBy("region").agg(F.count("*").alias("n_reads"), F.count_if("open").alias("n_open"), F.countDistinct("sample").alias("samples"), F.min("rlo").alias("first_lo"))


@query("a64_observed_profile_all", "SELECT g.chrom, g.bin, CAST(sum(c.called) AS BIGINT) AS calls, count(c.read) AS chances, round(CASE WHEN count(c.read) > 0 THEN sum(c.called) * 1.0 / count(c.read) END, 6) AS rate FROM (SELECT chrom, unnest(generate_series(0, 120)) AS bin FROM (SELECT DISTINCT chrom FROM calls)) g LEFT JOIN calls c ON CAST(floor((c.pos - c.pos % 10) % 1000 / 10.0) AS BIGINT) = g.bin AND c.chrom = g.chrom GROUP BY g.chrom, g.bin")
def a64_all(v: Tables):
    c = v.calls.groupBy("chrom", F.floor(((F.col("pos") - F.col("pos") % 10) % 1000) / 10).alias("bin")).agg(F.sum("called").alias("calls"), F.count("*").alias("k"))
    grid = v.calls.select("chrom").distinct().select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(120).cast("long"))).alias("bin"))
    return grid.join(c, ["chrom", "bin"], "left").select("chrom", "bin", "calls", F.coalesce("k", F.lit(0)).alias("chances"), _n(S.ratio(F.col("calls"), F.col("k"))).alias("rate"))


@query("a72_nearest_class", "SELECT kind, status, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY kind), 6) AS fraction FROM (SELECT kind, CASE WHEN lo % 3 = 0 THEN 'a' WHEN hi % 3 = 0 THEN 'b' ELSE 'c' END AS status FROM regions) GROUP BY kind, status")
def a72(v: Tables):
    s = F.when(F.col("lo") % 3 == 0, "a").when(F.col("hi") % 3 == 0, "b").otherwise("c")
    n = v.regions.groupBy("kind", s.alias("status")).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", _n(F.col("n") / F.sum("n").over(Window.partitionBy("kind"))))


@query("a73_guarded_summary", "SELECT donor, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(quantile_cont(hi - lo, 0.75) - quantile_cont(hi - lo, 0.25), 4) END AS iqr FROM reads GROUP BY donor")
def a73(v: Tables):
    w = F.col("hi") - F.col("lo")
    q = lambda p: F.percentile(w, F.lit(p))
    return v.reads.groupBy("donor").agg(F.count("*").alias("n"), F.when(F.count("*") >= 10, _n(q(0.75) - q(0.25), 4)).alias("iqr"))


@query("a76_genotype_calls", "SELECT chrom, pos, count(*) FILTER (called = 0) AS n_ref, count(*) FILTER (called = 1) AS n_alt, round(count(*) FILTER (called = 1) * 1.0 / count(*), 6) AS fraction FROM calls GROUP BY chrom, pos HAVING count(*) >= 2")
def a76(v: Tables):
    return v.calls.groupBy("chrom", "pos").agg(F.count_if(F.col("called") == 0).alias("n_ref"), F.count_if(F.col("called") == 1).alias("n_alt")).where("n_ref + n_alt >= 2").withColumn("fraction", _n(F.col("n_alt") / (F.col("n_ref") + F.col("n_alt"))))


@query("a78_baseline_delta", f"WITH {_FREQ} SELECT y.region, y.sample, round(y.freq - x.freq, 6) AS delta FROM freq x JOIN freq y ON x.region = y.region AND x.sample = 0 AND y.sample > 0 WHERE x.freq IS NOT NULL AND y.freq IS NOT NULL")
def a78(v: Tables):
    f = _freq(v).where("freq IS NOT NULL").withColumn("base", F.max(F.when(F.col("sample") == 0, F.col("freq"))).over(Window.partitionBy("region")))
    return f.where("sample > 0 AND base IS NOT NULL").select("region", "sample", _n(F.col("freq") - F.col("base")).alias("delta"))


@query("a74_group_against_rest", "SELECT cluster, round(avg(value), 4) AS mean, round(stddev_samp(value) / sqrt(count(*)), 4) AS se, round((max(ts) - sum(value)) / (max(tn) - count(*)), 4) AS rest FROM (SELECT cluster, value, sum(value) OVER () AS ts, count(*) OVER () AS tn FROM clusters) GROUP BY cluster")
def a74(v: Tables):
    c = v.clusters.groupBy("cluster").agg(F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("e"), F.sum("value").alias("s"), F.count("*").alias("n"))
    t = c.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return c.crossJoin(F.broadcast(t)).select("cluster", _n("m", 4).alias("mean"), _n("e", 4).alias("se"), _n((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 4).alias("rest"))


# ---------------------------------------------------------------- ranks, sets, tests


@query("w12_abundance_rank", "SELECT gene, cluster, n, row_number() OVER (PARTITION BY gene ORDER BY n DESC, cluster) AS place FROM (SELECT gene, cluster, count(*) AS n FROM clusters WHERE cluster IS NOT NULL GROUP BY gene, cluster)")
def w12(v: Tables):
    n = v.clusters.where("cluster IS NOT NULL").groupBy("gene", "cluster").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("n"), "cluster")).cast("long"))


@query("w18_genomic_order", "SELECT region, row_number() OVER (ORDER BY concat('chr', CAST(chrom AS VARCHAR)), lo, region) AS place FROM regions")
def w18(v: Tables):
    name = F.concat(F.lit("chr"), F.col("chrom").cast("string"))
    # places within a chromosome, moved by how many rows earlier chromosomes have: one row per chromosome
    sizes = v.regions.groupBy(name.alias("c")).agg(F.count("*").alias("n"))
    before = sizes.select("c", F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = v.regions.select("region", name.alias("c"), F.row_number().over(Window.partitionBy(name).orderBy("lo", "region")).alias("r"))
    return inner.join(F.broadcast(before), "c").select("region", (F.col("r") + F.col("before")).alias("place"))


@query("u06_union_of_significant", "SELECT id, min(p) AS p FROM (SELECT region AS id, lo AS p FROM regions WHERE lo < 20000 UNION ALL SELECT region, hi FROM regions WHERE hi < 30000 AND kind = 1) GROUP BY id")
def u06(v: Tables):
    a = v.regions.where("lo < 20000").select(F.col("region").alias("id"), F.col("lo").alias("p"))
    b = v.regions.where("hi < 30000 AND kind = 1").select(F.col("region").alias("id"), F.col("hi").alias("p"))
    return a.unionByName(b).groupBy("id").agg(F.min("p").alias("p"))


@query("x18_pairwise_fisher", f"WITH {_FISHER.format(src='SELECT x.pair, x.sample AS s1, y.sample AS s2, CAST(x.neither AS BIGINT) AS neither, CAST(x.joint AS BIGINT) AS first, CAST(y.neither AS BIGINT) AS second, CAST(y.joint AS BIGINT) AS joint FROM tables x JOIN tables y ON x.pair = y.pair AND x.sample < y.sample')} SELECT pair, s1, s2, round(p, 6) AS p FROM t JOIN p USING (neither, first, second, joint)")
def x18(v: Tables):
    x = v.tables.select("pair", F.col("sample").alias("s1"), "neither", F.col("joint").alias("first"))
    y = v.tables.select("pair", F.col("sample").alias("s2"), F.col("neither").alias("second"), "joint")
    both = x.join(y, "pair").where("s1 < s2")  # a few samples per pair
    return S.fisher(both).select("pair", "s1", "s2", _n("p").alias("p"))


@query("x12_labels_to_tables", "SELECT d.lang, count(*) FILTER (quality = 0 AND toxic = 0) AS neither, count(*) FILTER (quality = 1 AND toxic = 0) AS first, count(*) FILTER (quality = 0 AND toxic = 1) AS second, count(*) FILTER (quality = 1 AND toxic = 1) AS joint FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang")
def x12(v: Tables):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    j = v.labels.join(v.documents.select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.count_if(~q & ~t).alias("neither"), F.count_if(q & ~t).alias("first"), F.count_if(~q & t).alias("second"), F.count_if(q & t).alias("joint"))


@query("y26_covered_entropy", "WITH b AS (SELECT donor % 50 AS g, CAST(floor(lo / 10000) AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY 1, 2), p AS (SELECT g, n * 1.0 / sum(n) OVER (PARTITION BY g) AS p, count(*) OVER (PARTITION BY g) AS k FROM b) SELECT g, CASE WHEN max(k) = 10 THEN round(sum(-p * ln(p) / ln(2)), 6) END AS entropy, CASE WHEN max(k) = 10 THEN 'complete' ELSE 'incomplete' END AS status FROM p GROUP BY g")
def y26(v: Tables):
    b = v.reads.groupBy((F.col("donor") % 50).alias("g"), F.floor(F.col("lo") / 10_000).alias("bin")).agg(F.count("*").alias("n"))
    d = S.diversity(b, by=["g"])
    whole = F.col("categories") == 10
    return d.select("g", F.when(whole, _n("entropy")).alias("entropy"), F.when(whole, "complete").otherwise("incomplete").alias("status"))


# ---------------------------------------------------------------- notebooks, projections


@query("n02_significant_counts", "WITH b AS (SELECT pair, sample, joint * 1.0 / n AS f FROM tables) SELECT CAST(sample AS VARCHAR) AS comparison, count(*) AS tested, count(*) FILTER (f > 0.2) AS significant FROM b GROUP BY sample UNION ALL SELECT 'any', count(DISTINCT pair), count(DISTINCT pair) FILTER (f > 0.2) FROM b")
def n02(v: Tables):
    b = v.tables.select("pair", "sample", (F.col("joint") / F.col("n")).alias("f"))
    each = b.groupBy(F.col("sample").cast("string").alias("comparison")).agg(F.count("*").alias("tested"), F.count_if(F.col("f") > 0.2).alias("significant"))
    any_ = b.agg(F.countDistinct("pair").alias("tested"), F.countDistinct(F.when(F.col("f") > 0.2, F.col("pair"))).alias("significant")).select(F.lit("any").alias("comparison"), "tested", "significant")
    return each.unionByName(any_)


@query("n05_depth_retained", "SELECT a.gene, a.n AS before, coalesce(b.n, 0) AS after, round(b.n * 1.0 / a.n, 6) AS kept FROM (SELECT gene, count(*) AS n FROM clusters GROUP BY gene) a LEFT JOIN (SELECT gene, count(*) AS n FROM clusters WHERE cluster > 3 GROUP BY gene) b ON a.gene = b.gene")
def n05(v: Tables):
    got = v.clusters.groupBy("gene").agg(F.count("*").alias("before"), F.count_if(F.col("cluster") > 3).alias("after"))
    return got.select("gene", "before", "after", F.when(F.col("after") > 0, _n(F.col("after") / F.col("before"))).alias("kept"))


@query("n07_rank_migration", "WITH a AS (SELECT read, row_number() OVER (ORDER BY value DESC, read) AS r FROM clusters QUALIFY r <= 10), b AS (SELECT read, row_number() OVER (ORDER BY value DESC, read) AS r FROM clusters WHERE sample > 0) SELECT a.read, a.r AS old_place, b.r AS new_place, b.read IS NULL AS out_of_scope FROM a LEFT JOIN b ON a.read = b.read")
def n07(v: Tables):
    top = v.clusters.orderBy(F.desc("value"), "read").limit(10)
    ranked = top.select("read", "sample", "value", F.row_number().over(Window.orderBy(F.desc("value"), "read")).cast("long").alias("old_place"))  # ten rows
    # a row's new place: one more than the rows in scope that come before it
    scope = v.clusters.where("sample > 0").select(F.col("read").alias("r2"), F.col("value").alias("v2"))
    ahead = scope.join(F.broadcast(ranked.where("sample > 0")), (F.col("v2") > F.col("value")) | ((F.col("v2") == F.col("value")) & (F.col("r2") < F.col("read")))).groupBy("read").agg(F.count("*").alias("a"))
    out = F.col("sample") == 0
    return ranked.join(ahead, "read", "left").select("read", "old_place", F.when(~out, F.coalesce("a", F.lit(0)) + 1).alias("new_place"), out.alias("out_of_scope"))


@query("n13_best_per_family", "SELECT kind, chrom, region FROM regions QUALIFY row_number() OVER (PARTITION BY kind, chrom ORDER BY hi - lo DESC, lo % 100, region) = 1")
def n13(v: Tables):
    return P.top(v.regions, 1, by=["kind", "chrom"], order=[F.desc(F.col("hi") - F.col("lo")), F.col("lo") % 100, "region"]).select("kind", "chrom", "region")


@query("p02_composition_within_sample", "SELECT cluster, sample, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY sample), 6) AS proportion FROM clusters GROUP BY cluster, sample")
def p02(v: Tables):
    n = v.clusters.groupBy("cluster", "sample").agg(F.count("*").alias("n"))
    return n.withColumn("proportion", _n(F.col("n") / F.sum("n").over(Window.partitionBy("sample"))))


@query("p47_strongest_per_peak", "SELECT region, el, read, score FROM regions a JOIN elements b ON a.chrom = b.chrom AND a.lo <= b.lo AND b.lo < a.hi QUALIFY row_number() OVER (PARTITION BY region ORDER BY score DESC, read, el, b.lo) = 1")
def p47(v: Tables):
    hits = I.point_join(v.elements.select("chrom", "read", "el", "score", F.col("lo").alias("pos")), v.regions)
    return P.top(hits, 1, by=["b_region"], order=[F.desc("a_score"), "a_read", "a_el", "a_pos"]).select(F.col("b_region").alias("region"), F.col("a_el").alias("el"), F.col("a_read").alias("read"), F.col("a_score").alias("score"))


@query("p55_reads_per_time", "SELECT CASE WHEN sample IS NULL THEN 'total' ELSE CAST(sample AS VARCHAR) END AS time, n FROM (SELECT sample, count(*) AS n FROM reads GROUP BY ROLLUP (sample))".replace(" AS time,", ' AS "time",'))
def p55(v: Tables):
    return v.reads.rollup("sample").agg(F.count("*").alias("n"), F.grouping("sample").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("sample").cast("string")).alias("time"), "n")


@query("p80_class_medians", "SELECT kind, round(median(w0), 4) AS small, round(median(w1), 4) AS large FROM (SELECT a.kind, a.region, count(*) FILTER (b.hi - b.lo < 300) AS w0, count(*) FILTER (b.hi - b.lo >= 300) AS w1 FROM regions a JOIN elements b ON a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi GROUP BY a.kind, a.region) GROUP BY kind")
def p80(v: Tables):
    small = F.col("b_hi") - F.col("b_lo") < 300
    n = I.overlap_join(v.regions, v.elements).groupBy(F.col("a_kind").alias("kind"), "a_region").agg(F.count_if(small).alias("w0"), F.count_if(~small).alias("w1"))
    return n.groupBy("kind").agg(_n(F.percentile("w0", F.lit(0.5)), 4).alias("small"), _n(F.percentile("w1", F.lit(0.5)), 4).alias("large"))


@query("p81_renumbered", "SELECT read, coalesce(CAST(TRY_CAST(label AS BIGINT) + 1 AS VARCHAR), label) AS label FROM (SELECT read, CASE WHEN cluster IS NULL THEN 'none' ELSE CAST(cluster AS VARCHAR) END AS label FROM clusters)")
def p81(v: Tables):
    label = F.coalesce(F.col("cluster").cast("string"), F.lit("none"))
    return v.clusters.select("read", label.alias("l")).select("read", F.coalesce((F.expr("try_cast(l AS bigint)") + 1).cast("string"), "l").alias("label"))
