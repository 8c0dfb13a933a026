"""Tests, corrections, diversity, neighbours and signals."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import neighbours as N
from ..operators import stats as S
from .registry import Tables, query

_T = "SELECT pair, CAST(sum(neither) AS BIGINT) AS neither, CAST(sum(first) AS BIGINT) AS first, CAST(sum(second) AS BIGINT) AS second, CAST(sum(joint) AS BIGINT) AS joint FROM tables GROUP BY pair"
_FISHER = """t AS ({src}), u AS (SELECT DISTINCT neither, first, second, joint, joint + first AS m, joint + second AS k, neither + first + second + joint AS n FROM t),
x AS (SELECT *, unnest(generate_series(greatest(0, m + k - n), least(m, k))) AS x FROM u),
l AS (SELECT *, lgamma(m + 1) + lgamma(n - m + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(m - x + 1) - lgamma(k - x + 1) - lgamma(n - m - k + x + 1) AS lp FROM x),
o AS (SELECT *, max(lp) FILTER (x = joint) OVER (PARTITION BY neither, first, second, joint) AS own FROM l),
p AS (SELECT neither, first, second, joint, least(sum(exp(lp)), 1.0) AS p FROM o WHERE lp <= own + ln(1 + 1e-7) GROUP BY neither, first, second, joint)"""


def _pooled(v: Tables):
    return v.tables.groupBy("pair").agg(*(F.sum(c).alias(c) for c in ("neither", "first", "second", "joint")))


@query("x01_fisher", f"WITH {_FISHER.format(src=_T)} SELECT pair, t.neither, t.first, t.second, t.joint, round(p, 6) AS p FROM t JOIN p USING (neither, first, second, joint)")
def x01(v: Tables):
    return S.fisher(_pooled(v)).select("pair", "neither", "first", "second", "joint", F.round("p", 6).alias("p"))


@query("x03_fisher_distinct_tables", f"WITH {_FISHER.format(src='SELECT pair, sample, CAST(neither AS BIGINT) AS neither, CAST(first AS BIGINT) AS first, CAST(second AS BIGINT) AS second, CAST(joint AS BIGINT) AS joint FROM tables')} SELECT pair, sample, round(p, 6) AS p FROM t JOIN p USING (neither, first, second, joint)")
def x03(v: Tables):
    return S.fisher(v.tables).select("pair", "sample", F.round("p", 6).alias("p"))


_BH = "b AS (SELECT *, row_number() OVER (PARTITION BY {fam} ORDER BY p) AS r, count(*) OVER (PARTITION BY {fam}) AS n FROM {src}), q AS (SELECT *, least(min(p * n / r) OVER (PARTITION BY {fam} ORDER BY p DESC, r DESC ROWS UNBOUNDED PRECEDING), 1.0) AS fdr FROM b)"
#: p values without ties below the rounding: a fixed function of the key.
_PV = "pv AS (SELECT l_orderkey AS read, l_linenumber AS el, l_suppkey % 6 AS family, ((l_orderkey * 7919 + l_linenumber * 104729) % 100003) / 100003.0 AS p, l_quantity AS n_shared FROM lineitem)"


def _pv(v: Tables):
    return v.lineitem.select(F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("el"), (F.col("l_suppkey") % 6).alias("family"), ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 100003 / F.lit(100003.0)).alias("p"), F.col("l_quantity").alias("n_shared"))


@query("x05_benjamini_hochberg", f"WITH {_PV}, {_BH.format(fam='family', src='pv')} SELECT read, el, family, round(fdr, 6) AS fdr FROM q")
def x05(v: Tables):
    return S.benjamini_hochberg(_pv(v), family=["family"]).select("read", "el", "family", F.round("fdr", 6).alias("fdr"))


@query("x07_gated_correction", f"WITH {_PV}, ok AS (SELECT * FROM pv WHERE n_shared >= 20), {_BH.format(fam='family', src='ok')} SELECT read, el, round(fdr, 6) AS fdr, CASE WHEN fdr <= 0.9 THEN 'called' ELSE 'ns' END AS status FROM q UNION ALL SELECT read, el, NULL, 'untested' FROM pv WHERE n_shared < 20")
def x07(v: Tables):
    gated = _pv(v).withColumn("p", F.when(F.col("n_shared") >= 20, F.col("p")))
    done = S.benjamini_hochberg(gated, family=["family"])
    return done.select("read", "el", F.round("fdr", 6).alias("fdr"), F.when(F.col("fdr").isNull(), "untested").when(F.col("fdr") <= 0.9, "called").otherwise("ns").alias("status"))


@query("x08_effects", f"SELECT pair, round((joint + first) * (joint + second) * 1.0 / (joint + first + second + neither), 6) AS expected, round((joint + 1.0) * (neither + 1) / ((first + 1) * (second + 1)), 6) AS odds_ratio, round(ln((joint + 0.5) * (neither + 0.5) / ((first + 0.5) * (second + 0.5))) / ln(2), 6) AS log2_odds, round(joint / ((joint + first) * (joint + second) * 1.0 / (joint + first + second + neither)), 6) AS ratio, first = 0 OR second = 0 AS zero_cell FROM ({_T})")
def x08(v: Tables):
    e = S.effects(_pooled(v))
    return e.select("pair", *(F.round(c, 6).alias(n) for c, n in (("expected", "expected"), ("odds_ratio", "odds_ratio"), ("log2_odds", "log2_odds"), ("observed_to_expected", "ratio"))), "zero_cell")


@query("x10_empirical_p", "SELECT c.sample, round((1.0 + count(*) FILTER (c.value >= o.m)) / (1 + count(*)), 6) AS p FROM clusters c JOIN (SELECT sample, avg(value) * 1.5 AS m FROM clusters GROUP BY sample) o ON c.sample = o.sample GROUP BY c.sample")
def x10(v: Tables):
    o = v.clusters.groupBy("sample").agg((F.avg("value") * 1.5).alias("m"))
    return v.clusters.join(F.broadcast(o), "sample").groupBy("sample").agg(F.round(S.empirical(F.col("m"), F.col("value")), 6).alias("p"))


def _log_factorial(n):
    """Stirling's series, shifted by eight places; at 8 and beyond it is exact to 1e-11, whatever the size."""
    m = n.cast("double") + 8
    series = m * F.log(m) - m + F.log(m * 2 * math.pi) / 2 + 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * F.pow(m, F.lit(5.0))) - 1 / (1680 * F.pow(m, F.lit(7.0)))
    return series - sum(F.log(n + i) for i in range(1, 9))


@query("x11_separation_all", "SELECT gene, status, round(exp(least), 9) AS least_p, round(least, 6) AS log_least_p FROM (SELECT gene, CASE WHEN min(value) FILTER (sample = 0) > max(value) FILTER (sample > 0) THEN 'separated' ELSE 'mixed' END AS status, lgamma(count(*) FILTER (sample = 0) + 1) + lgamma(count(*) FILTER (sample > 0) + 1) - lgamma(count(*) + 1) AS least FROM clusters GROUP BY gene)")
def x11_all(v: Tables):
    # by gene itself and at every size; the logarithm stays where the probability is too small to write
    first = F.col("sample") == 0
    g = v.clusters.groupBy("gene").agg(F.min(F.when(first, F.col("value"))).alias("lo"), F.max(F.when(~first, F.col("value"))).alias("hi"), F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    least = _log_factorial(F.col("a")) + _log_factorial(F.col("b")) - _log_factorial(F.col("a") + F.col("b"))
    return g.select("gene", F.when(F.col("lo") > F.col("hi"), "separated").otherwise("mixed").alias("status"), F.round(F.exp(least), 9).alias("least_p"), F.round(least, 6).alias("log_least_p"))


@query("x21_pi0", f"WITH {_PV} SELECT family, round(least(1.0, avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0 END) / 0.5), 6) AS pi0 FROM pv GROUP BY family")
def x21(v: Tables):
    return _pv(v).groupBy("family").agg(F.round(F.least(F.lit(1.0), F.avg(F.when(F.col("p") > 0.5, 1.0).otherwise(0.0)) / 0.5), 6).alias("pi0"))


_RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS r FROM s), ties AS (SELECT gene, sum(t * t * t - t) AS ties FROM (SELECT gene, count(*) * 1.0 AS t FROM s GROUP BY gene, v) GROUP BY gene)"
_S = "s AS (SELECT gene, sample, floor(value / 10000) AS v FROM clusters)"


def _s(v: Tables):
    return v.clusters.select("gene", "sample", F.floor(F.col("value") / 10_000).cast("double").alias("v"))


@query("x23_kruskal", f"WITH {_S}, {_RANKED}, g AS (SELECT gene, sample, sum(r) AS s, count(*) AS k FROM r GROUP BY gene, sample), q AS (SELECT gene, sum(s * s / k) AS q, CAST(sum(k) AS BIGINT) AS n, count(*) AS groups FROM g GROUP BY gene) SELECT q.gene, n, groups, round((12.0 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - ties / (n * 1.0 * n * n - n)), 6) AS h FROM q JOIN ties ON q.gene = ties.gene")
def x23(v: Tables):
    return S.kruskal(_s(v), "v", "sample", by=["gene"]).withColumn("h", F.round("h", 6))


_ERFC = "t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))"


@query("x24_wilcoxon", f"WITH {_S}, {_RANKED}, w AS (SELECT gene, sum(r) FILTER (sample = 0) AS s, count(*) FILTER (sample = 0) AS n1, count(*) FILTER (sample > 0) AS n2 FROM r GROUP BY gene), z AS (SELECT w.gene, n1, n2, s - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1 * 1.0 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * 1.0 * (n1 + n2 - 1)))) AS sd FROM w JOIN ties ON w.gene = ties.gene), e AS (SELECT *, greatest((abs(u - n1 * n2 / 2.0) - 0.5) / sd, 0) / sqrt(2) AS x FROM z), f AS (SELECT *, 1 / (1 + 0.5 * x) AS t FROM e) SELECT gene, n1, n2, u, round(least(1.0, {_ERFC}), 6) AS p FROM f")
def x24(v: Tables):
    return S.wilcoxon(_s(v), "v", F.col("sample") == 0, by=["gene"]).withColumn("p", F.round("p", 6))


@query("x26_over_representation", "WITH k AS (SELECT c.nation, count(*) AS marked, count(*) FILTER (c.gene % 3 = 0) AS hits FROM genes c GROUP BY c.nation), z AS (SELECT count(*) AS total, count(*) FILTER (gene % 3 = 0) AS drawn FROM genes), x AS (SELECT nation, marked, hits, drawn, total, unnest(generate_series(hits, least(marked, drawn))) AS x FROM k, z), p AS (SELECT nation, sum(exp(lgamma(marked + 1) + lgamma(total - marked + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1) - lgamma(total + 1) - lgamma(x + 1) - lgamma(marked - x + 1) - lgamma(drawn - x + 1) - lgamma(total - marked - drawn + x + 1))) AS p FROM x WHERE x >= marked + drawn - total GROUP BY nation) SELECT k.nation, marked, hits, round(least(p, 1.0), 6) AS p FROM k JOIN p ON k.nation = p.nation")
def x26(v: Tables):
    z = v.genes.agg(F.count("*").alias("total"), F.count_if(F.col("gene") % 3 == 0).alias("drawn"))
    k = v.genes.groupBy("nation").agg(F.count("*").alias("marked"), F.count_if(F.col("gene") % 3 == 0).alias("hits")).crossJoin(F.broadcast(z))
    return S.hypergeometric_upper(k, hits="hits", drawn="drawn", marked="marked", total="total").select("nation", "marked", "hits", F.round("p", 6).alias("p"))


@query("x28_spearman", "WITH r AS (SELECT chrom, rank() OVER (PARTITION BY chrom ORDER BY hi - lo) + (count(*) OVER (PARTITION BY chrom, hi - lo) - 1) / 2.0 AS x, rank() OVER (PARTITION BY chrom ORDER BY lo) + (count(*) OVER (PARTITION BY chrom, lo) - 1) / 2.0 AS y FROM regions) SELECT chrom, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY chrom")
def x28(v: Tables):
    return S.spearman(v.regions.withColumn("w", F.col("hi") - F.col("lo")), "w", "lo", by=["chrom"]).withColumn("rho", F.round("rho", 6))


@query("x35_anova", "WITH g AS (SELECT gene, sample, sum(value) AS s, sum(value * value) AS ss, count(*) AS k FROM clusters GROUP BY gene, sample), t AS (SELECT gene, sum(s) AS s, sum(ss) AS ss, sum(k) AS n, count(*) AS g, sum(s * s / k) AS b FROM g GROUP BY gene) SELECT gene, CAST(g - 1 AS BIGINT) AS df1, CAST(n - g AS BIGINT) AS df2, round(((b - s * s / n) / (g - 1)) / ((ss - b) / (n - g)), 4) AS f FROM t WHERE g > 1 AND n > g")
def x35(v: Tables):
    g = v.clusters.groupBy("gene", "sample").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count("*").alias("k"))
    t = g.groupBy("gene").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("k").alias("n"), F.count("*").alias("g"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("b")).where("g > 1 AND n > g")
    f = ((F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("g") - 1)) / ((F.col("ss") - F.col("b")) / (F.col("n") - F.col("g")))
    return t.select("gene", (F.col("g") - 1).alias("df1"), (F.col("n") - F.col("g")).alias("df2"), F.round(f, 4).alias("f"))


@query("x34_enrichment", "SELECT cluster, round(ln((avg(v) + 1) / ((max(ts) - sum(v)) / (max(tn) - count(*)) + 1)) / ln(2), 6) AS log2_ratio FROM (SELECT cluster, value / 1000 AS v, sum(value / 1000) OVER () AS ts, count(*) OVER () AS tn FROM clusters WHERE cluster IS NOT NULL) GROUP BY cluster")
def x34(v: Tables):
    c = v.clusters.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("value") / 1000).alias("s"), F.count("*").alias("n"))
    t = c.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rest = (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    return c.crossJoin(F.broadcast(t)).select("cluster", F.round(F.log((F.col("s") / F.col("n") + 1) / (rest + 1)) / S.LN2, 6).alias("log2_ratio"))


# ---------------------------------------------------------------- diversity and signals (Y)

_DIV = "n AS (SELECT gene, cluster, count(*) AS n FROM clusters WHERE cluster IS NOT NULL GROUP BY gene, cluster), p AS (SELECT gene, n * 1.0 / sum(n) OVER (PARTITION BY gene) AS p, n FROM n), d AS (SELECT gene, CAST(sum(n) AS BIGINT) AS total, count(*) AS categories, sum(-p * ln(p) / ln(2)) AS h, sum(p * p) AS s FROM p GROUP BY gene)"


def _div(v: Tables):
    return S.diversity(v.clusters.where("cluster IS NOT NULL").groupBy("gene", "cluster").agg(F.count("*").alias("n")), by=["gene"])


@query("y25_entropy", f"WITH {_DIV} SELECT gene, total, categories, round(h, 6) AS entropy, round(CASE WHEN categories > 1 THEN h / (ln(categories) / ln(2)) END, 6) AS normalised, round(pow(2, h), 6) AS effective FROM d")
def y25(v: Tables):
    return _div(v).select("gene", "total", "categories", F.round("entropy", 6).alias("entropy"), F.round("normalised_entropy", 6).alias("normalised"), F.round("effective", 6).alias("effective"))


@query("y28_gini_simpson", f"WITH {_DIV} SELECT gene, round(1 - s, 6) AS gini_simpson, round(CASE WHEN categories > 1 THEN (1 - s) / (1 - 1.0 / categories) END, 6) AS normalised, round(1 / s, 6) AS inverse FROM d")
def y28(v: Tables):
    return _div(v).select("gene", F.round("gini_simpson", 6).alias("gini_simpson"), F.round("normalised_simpson", 6).alias("normalised"), F.round("inverse_simpson", 6).alias("inverse"))


@query("y29_rao", "WITH s AS (SELECT c.chrom, c.pos % 200 AS site, k.cluster, c.called AS v FROM calls c JOIN clusters k ON c.read = k.read WHERE k.cluster IS NOT NULL), a AS (SELECT chrom, site, cluster, sum(v) AS s, count(*) AS n FROM s GROUP BY chrom, site, cluster), b AS (SELECT chrom, site, sum(s) AS s, sum(n) AS n, sum(2 * s * (1 - s * 1.0 / n)) AS w FROM a GROUP BY chrom, site), t AS (SELECT chrom, sum(2.0 * s / n * (1 - s * 1.0 / n)) / 200 AS total, sum(w / n) / 200 AS within FROM b GROUP BY chrom) SELECT chrom, round(total, 6) AS total, round(within, 6) AS within, round(total - within, 6) AS between, round((total - within) / total, 6) AS share FROM t".replace(" AS between", ' AS "between"'))
def y29(v: Tables):
    s = v.calls.select("read", "chrom", (F.col("pos") % 200).alias("site"), F.col("called").alias("v")).join(v.clusters.where("cluster IS NOT NULL").select("read", "cluster"), "read")
    r = S.rao(s, key=["chrom"], cluster="cluster", site="site", value="v", width=200.0)
    return r.select("chrom", *(F.round(c, 6).alias(c) for c in ("total", "within", "between", "share")))


@query("y31_shape_index", "SELECT gene, round(2 + sum(p * ln(p) / ln(2)), 6) AS shape_index FROM (SELECT gene, sum(n) * 1.0 / sum(sum(n)) OVER (PARTITION BY gene) AS p FROM tags GROUP BY gene, pos) GROUP BY gene")
def y31(v: Tables):
    return S.shape_index(v.tags.groupBy("gene", "pos").agg(F.sum("n").alias("n")), by=["gene"]).withColumn("shape_index", F.round("shape_index", 6))


@query("y32_strongest_site", "SELECT gene, pos, CAST(n AS BIGINT) AS n, round(n * 1.0 / t, 6) AS share FROM (SELECT gene, pos, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY gene) AS t FROM tags GROUP BY gene, pos) QUALIFY row_number() OVER (PARTITION BY gene ORDER BY n DESC, abs(pos - 48), pos) = 1")
def y32(v: Tables):
    t = v.tags.groupBy("gene", "pos").agg(F.sum("n").alias("n"))
    best = t.groupBy("gene").agg(F.sum("n").alias("t"), F.max(F.struct("n", (-F.abs(F.col("pos") - 48)).alias("d"), (-F.col("pos")).alias("p"))).alias("b"))
    return best.select("gene", (-F.col("b.p")).alias("pos"), F.col("b.n").alias("n"), F.round(F.col("b.n") / F.col("t"), 6).alias("share"))


@query("y33_pausing_index", "SELECT g.gene, count(r.read) FILTER (r.lo < g.tss + 300) AS near, count(r.read) FILTER (r.lo >= g.tss + 300) AS body, CASE WHEN count(r.read) FILTER (r.lo >= g.tss + 300) > 0 THEN round((count(r.read) FILTER (r.lo < g.tss + 300) / 300.0) / (count(r.read) FILTER (r.lo >= g.tss + 300) / 9700.0), 6) END AS index FROM genes g LEFT JOIN reads r ON r.chrom = g.chrom AND r.lo >= g.tss AND r.lo < g.tss + 10000 GROUP BY g.gene".replace(" AS index", ' AS "index"'))
def y33(v: Tables):
    from ..operators.intervals import point_join

    windows = v.genes.select("gene", "chrom", "tss", F.col("tss").alias("lo"), (F.col("tss") + 10_000).alias("hi"))
    starts = v.reads.select("read", "chrom", F.col("lo").alias("pos"))
    near = F.col("a_pos") < F.col("b_tss") + 300
    n = point_join(starts, windows, width=10_000).groupBy(F.col("b_gene").alias("gene")).agg(F.count_if(near).alias("near"), F.count_if(~near).alias("body"))
    full = v.genes.select("gene").join(n, "gene", "left").select("gene", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("body", F.lit(0)).alias("body"))
    return full.withColumn("index", F.when(F.col("body") > 0, F.round((F.col("near") / 300.0) / (F.col("body") / 9700.0), 6)))


@query("y01_autocorrelation", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), i AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i, list_avg(v) AS m FROM e), c AS (SELECT vec_id, i, x - m AS x FROM i), z AS (SELECT vec_id, sum(x * x) AS z FROM c GROUP BY vec_id) SELECT a.vec_id, b.i - a.i AS lag, round(sum(a.x * b.x) / max(z.z), 5) AS acf FROM c a JOIN c b ON a.vec_id = b.vec_id AND b.i >= a.i AND b.i - a.i <= 5 JOIN z ON z.vec_id = a.vec_id GROUP BY a.vec_id, b.i - a.i".replace(" AS lag", ' AS "lag"'))
def y01(v: Tables):
    acf = S.autocorrelation(F.col("embedding").cast("array<double>"), 5)
    return v.embeddings.select("vec_id", F.posexplode(acf).alias("lag", "acf")).select("vec_id", F.col("lag").cast("long").alias("lag"), F.round("acf", 5).alias("acf"))


_KNN = "e AS (SELECT label AS g, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), d AS (SELECT a.g, a.vec_id AS src, b.vec_id AS dst, sum(abs(a.x - b.x)) AS distance FROM e a JOIN e b ON a.g = b.g AND a.i = b.i AND a.vec_id <> b.vec_id GROUP BY a.g, a.vec_id, b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM d QUALIFY rank <= 5)"


def _knn(v: Tables):
    return N.nearest(v.embeddings, 5, group="label", row="vec_id", vector="embedding")


@query("y07_manhattan_neighbours", f"WITH {_KNN} SELECT src, dst, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM k")
def y07(v: Tables):
    return _knn(v).select("src", "dst", F.round("distance", 5).alias("distance"), "rank")


@query("y07_neighbour_graph", f"WITH {_KNN}, s AS (SELECT g, avg(distance) AS s FROM k GROUP BY g), u AS (SELECT g, least(src, dst) AS src, greatest(src, dst) AS dst, min(distance) AS distance FROM k GROUP BY g, least(src, dst), greatest(src, dst)) SELECT src, dst, round(exp(-distance / s), 5) AS weight FROM u JOIN s ON u.g = s.g")
def y07g(v: Tables):
    return N.graph(_knn(v), group="label").select("src", "dst", F.round("weight", 5).alias("weight"))


@query("y06_correlation_neighbours", "WITH e AS (SELECT label AS g, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), d AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1 - corr(a.x, b.x) AS distance FROM e a JOIN e b ON a.g = b.g AND a.i = b.i AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id) SELECT src, dst, round(distance, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY distance, dst) <= 3")
def y06(v: Tables):
    return N.nearest(v.embeddings, 3, group="label", row="vec_id", vector="embedding", distance=N.correlation_distance).select("src", "dst", F.round("distance", 5).alias("distance"))


@query("y13_majority_label", f"WITH {_KNN}, n AS (SELECT src, dst % 3 AS label, count(*) AS n, min(rank) AS r FROM k GROUP BY src, dst % 3) SELECT src, label FROM n QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, r) = 1")
def y13(v: Tables):
    labels = v.embeddings.select(F.col("vec_id").alias("src"), (F.col("vec_id") % 3).alias("label"))
    return N.majority(_knn(v).drop("label"), labels)


@query("a27_neighbour_agreement", f"WITH {_KNN} SELECT src % 2 = 0 AS allele, count(*) AS edges, round(avg(CASE WHEN src % 2 = dst % 2 THEN 1.0 ELSE 0 END), 6) AS same FROM k GROUP BY src % 2 = 0")
def a27(v: Tables):
    return _knn(v).groupBy((F.col("src") % 2 == 0).alias("allele")).agg(F.count("*").alias("edges"), F.round(F.avg(F.when(F.col("src") % 2 == F.col("dst") % 2, 1.0).otherwise(0.0)), 6).alias("same"))


@query("y39_scaled_profile", "SELECT gene, pos, round((n - first_value(n) OVER w) * 1.0 / nullif(max(abs(n - f)) OVER (PARTITION BY gene), 0), 6) AS scaled FROM (SELECT gene, pos, n, first_value(n) OVER (PARTITION BY gene ORDER BY pos) AS f FROM (SELECT gene, pos, sum(n) AS n FROM tags GROUP BY gene, pos)) WINDOW w AS (PARTITION BY gene ORDER BY pos)")
def y39(v: Tables):
    t = v.tags.groupBy("gene", "pos").agg(F.sum("n").alias("n")).withColumn("d", F.col("n") - F.first("n").over(Window.partitionBy("gene").orderBy("pos")))
    most = F.max(F.abs("d")).over(Window.partitionBy("gene"))
    return t.select("gene", "pos", F.round(F.when(most != 0, F.col("d") / most), 6).alias("scaled"))


@query("n22_row_z_score", "SELECT read, round((value - avg(value) OVER (PARTITION BY gene)) / stddev_samp(value) OVER (PARTITION BY gene), 5) AS z FROM clusters")
def n22(v: Tables):
    w = Window.partitionBy("gene")
    return v.clusters.select("read", F.round((F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w), 5).alias("z"))
