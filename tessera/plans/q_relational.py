"""Row selection, set operations, scalar functions and supporting projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import select as P
from ..operators import stats as S
from .q_aggregates import _FREQ, _freq
from .q_intervals import _OVER, _PAIRS, _members
from .q_statistics import _FISHER, _T, _pooled
from .registry import Tables, query

# ---------------------------------------------------------------- selection (F)


@query("f01_pair_classes", f"WITH {_PAIRS}, k AS (SELECT DISTINCT a, b, x.kind AS ka, y.kind AS kb FROM prs JOIN regions x ON x.region = a JOIN regions y ON y.region = b) SELECT a, b, ka IN (0, 1) OR kb IN (0, 1) AS either, ka IN (0, 1) AND kb IN (0, 1) AS each_side, (ka = 0 AND kb = 1) OR (ka = 1 AND kb = 0) AS as_pair FROM k")
def f01(v: Tables):
    pairs = I.pairs_within(_members(v), least=500, most=2000).select("a", "b").distinct()
    r = v.regions.select("region", F.col("kind").cast("string").alias("k"))
    k = pairs.join(r.toDF("a", "ka"), "a").join(r.toDF("b", "kb"), "b")
    a, b = F.col("ka"), F.col("kb")
    return k.select("a", "b", P.pair_class(a, b, ["0", "1"]).alias("either"), P.pair_class(a, b, ["0", "1"], "both").alias("each_side"), P.pair_class(a, b, ["0", "1"], "pair").alias("as_pair"))


@query("f02_ranked_selection", "SELECT gene, read, value FROM (SELECT gene, read, value FROM clusters WHERE value > 100000 AND cluster IS NOT NULL AND sample > 0) QUALIFY row_number() OVER (PARTITION BY gene ORDER BY value DESC, read) <= 3")
def f02(v: Tables):
    some = v.clusters.where("value > 100000 AND cluster IS NOT NULL AND sample > 0")
    return P.top(some, 3, by=["gene"], order=[F.desc("value"), "read"]).select("gene", "read", "value")


@query("f04_complete_rows_all", "WITH c AS (SELECT read, gene, CASE WHEN cluster IS NULL THEN NULL ELSE cluster % 3 END AS v FROM clusters), g AS (SELECT read FROM c GROUP BY read HAVING count(*) = count(v)), k AS (SELECT c.* FROM c JOIN g ON c.read = g.read) SELECT read, gene, v FROM k WHERE gene IN (SELECT gene FROM k GROUP BY gene HAVING max(abs(v)) > 0)")
def f04_all(v: Tables):
    c = v.clusters.select("read", "gene", (F.col("cluster") % 3).alias("v"))
    return P.complete_rows(c, row="read", column="gene", value="v").select("read", "gene", "v")


@query("f05_top_pairs", f"WITH {_FISHER.format(src=_T)}, j AS (SELECT t.*, p.p FROM t JOIN p USING (neither, first, second, joint)) SELECT pair, joint, round(p, 6) AS p FROM j WHERE (joint + 1.0) * (neither + 1) / ((first + 1) * (second + 1)) > 1 ORDER BY round(p, 6), pair LIMIT 10")
def f05(v: Tables):
    t = S.effects(S.fisher(_pooled(v))).where("odds_ratio > 1").withColumn("p", F.round("p", 6))
    return t.orderBy("p", "pair").limit(10).select("pair", "joint", "p")


@query("f06_spaced_choice")
def f06(v: Tables):
    return P.spaced(v.regions, distance=5000, order=["kind", "lo", "region"], most=20)


@query("f07_coverage_window", "WITH n AS (SELECT donor, count(*) AS n FROM reads GROUP BY donor), m AS (SELECT median(n) AS m FROM n) SELECT donor, n FROM n, m WHERE n >= greatest(m - 3 * sqrt(m), 5) AND n <= m + 3 * sqrt(m)")
def f07(v: Tables):
    n = v.reads.groupBy("donor").agg(F.count("*").alias("n"))
    m = n.agg(F.percentile("n", F.lit(0.5)).alias("m"))
    return n.crossJoin(F.broadcast(m)).where((F.col("n") >= F.greatest(F.col("m") - 3 * F.sqrt("m"), F.lit(5.0))) & (F.col("n") <= F.col("m") + 3 * F.sqrt("m"))).select("donor", "n")


@query("f09_eligible_reads", "SELECT read FROM reads r WHERE EXISTS (SELECT 1 FROM regions g WHERE g.kind = 3 AND g.chrom = r.chrom AND r.lo <= g.lo AND g.hi <= r.hi) AND read IN (SELECT read FROM clusters WHERE cluster = 2)")
def f09(v: Tables):
    spans = I.containment_join(v.regions.where("kind = 3"), v.reads).select(F.col("b_read").alias("read")).distinct()
    return spans.join(v.clusters.where("cluster = 2").select("read"), "read", "left_semi")


@query("f13_representatives", "SELECT gene, read, r AS place FROM (SELECT gene, read, row_number() OVER (PARTITION BY gene ORDER BY value, read) AS r, count(*) OVER (PARTITION BY gene) AS n FROM clusters) WHERE r = 1 OR r = ceil(n / 2.0) OR r = n")
def f13(v: Tables):
    return P.representatives(v.clusters, by=["gene"], order=["value", "read"]).select("gene", "read", F.col("place").cast("long").alias("place"))


@query("f16_induced", "SELECT cluster, round(avg(CASE WHEN sample = 0 THEN value END), 4) AS base, round(avg(CASE WHEN sample = 3 THEN value END), 4) AS late FROM clusters GROUP BY cluster HAVING avg(CASE WHEN sample = 0 THEN value END) < avg(CASE WHEN sample = 3 THEN value END)")
def f16(v: Tables):
    at = lambda k: F.avg(F.when(F.col("sample") == k, F.col("value")))
    return v.clusters.groupBy("cluster").agg(at(0).alias("b"), at(3).alias("l")).where("b < l").select("cluster", F.round("b", 4).alias("base"), F.round("l", 4).alias("late"))


@query("f18_status", "SELECT read, CASE WHEN cluster IS NULL THEN 'unassigned' WHEN value < 50000 THEN 'low' WHEN sample = 3 THEN 'late' ELSE 'pass' END AS status FROM clusters")
def f18(v: Tables):
    return v.clusters.select("read", F.when(F.col("cluster").isNull(), "unassigned").when(F.col("value") < 50_000, "low").when(F.col("sample") == 3, "late").otherwise("pass").alias("status"))


# ---------------------------------------------------------------- sets (U)


@query("u01_bag_union", "SELECT region AS id, lo, kind, NULL AS tss FROM regions UNION ALL SELECT gene, lo, NULL, tss FROM genes")
def u01(v: Tables):
    return v.regions.select(F.col("region").alias("id"), "lo", "kind").unionByName(v.genes.select(F.col("gene").alias("id"), "lo", "tss"), allowMissingColumns=True)


@query("u02_set_union", "SELECT read FROM reads WHERE sample = 0 UNION SELECT read FROM elements WHERE el = 1")
def u02(v: Tables):
    return v.reads.where("sample = 0").select("read").union(v.elements.where("el = 1").select("read")).distinct()


@query("u03_intersect", "SELECT read FROM reads WHERE sample = 0 INTERSECT SELECT read FROM elements WHERE el = 1")
def u03(v: Tables):
    return v.reads.where("sample = 0").select("read").intersect(v.elements.where("el = 1").select("read"))


@query("u04_difference", "SELECT read FROM reads EXCEPT SELECT read FROM elements WHERE el = 1")
def u04(v: Tables):
    return v.reads.select("read").distinct().join(v.elements.where("el = 1").select("read"), "read", "left_anti")


@query("u07_overlap_counts", "WITH a AS (SELECT DISTINCT read FROM elements WHERE el = 1), b AS (SELECT DISTINCT read FROM elements WHERE el = 2) SELECT (SELECT count(*) FROM a WHERE read NOT IN (SELECT read FROM b)) AS only_first, (SELECT count(*) FROM a JOIN b USING (read)) AS shared, (SELECT count(*) FROM b WHERE read NOT IN (SELECT read FROM a)) AS only_second")
def u07(v: Tables):
    return P.overlap_counts(v.elements.where("el = 1"), v.elements.where("el = 2"), "read")


@query("u08_distinct", "SELECT DISTINCT chrom, sample, strand FROM reads")
def u08(v: Tables):
    return v.reads.select("chrom", "sample", "strand").dropDuplicates()


# ---------------------------------------------------------------- scalars (E)


@query("e01_explode_strings", "SELECT read, CAST(unnest(string_split(rtrim(sizes, ','), ',')) AS BIGINT) AS size FROM beds")
def e01(v: Tables):
    from ..operators.blocks import numbers

    return v.beds.select("read", F.explode(numbers(F.col("sizes"))).alias("size"))


@query("e02_regex_extract", "SELECT event_id, regexp_extract(props, '\"([a-z_]+)\":', 1) AS first_key, regexp_replace(event_type, '[aeiou]', '', 'g') AS plain FROM events")
def e02(v: Tables):
    return v.events.select("event_id", F.regexp_extract("props", '"([a-z_]+)":', 1).alias("first_key"), F.regexp_replace("event_type", "[aeiou]", "").alias("plain"))


@query("e04_formatted_ids", "SELECT region, concat('chr', CAST(chrom AS VARCHAR), ':', CAST(lo AS VARCHAR), '-', CAST(hi AS VARCHAR)) AS id, concat('rank', lpad(CAST(kind AS VARCHAR), 2, '0')) AS label, regexp_replace(concat('v', CAST(lo AS VARCHAR), '.12'), '\\.[0-9]+$', '') AS stem FROM regions")
def e04(v: Tables):
    s = lambda c: F.col(c).cast("string")
    return v.regions.select("region", F.concat(F.lit("chr"), s("chrom"), F.lit(":"), s("lo"), F.lit("-"), s("hi")).alias("id"), F.concat(F.lit("rank"), F.lpad(s("kind"), 2, "0")).alias("label"), F.regexp_replace(F.concat(F.lit("v"), s("lo"), F.lit(".12")), r"\.[0-9]+$", "").alias("stem"))


@query("e08_clamps", "SELECT region, greatest(lo - 5000, 0) AS low, least(hi, 90000) AS high, CAST(floor((lo - 50000) / 7.0) AS BIGINT) AS floored, ((lo - 50000) % 7 + 7) % 7 AS modulo, round_even(lo / 8.0, 0) AS even FROM regions")
def e08(v: Tables):
    lo = F.col("lo")
    return v.regions.select("region", F.greatest(lo - 5000, F.lit(0)).alias("low"), F.least("hi", F.lit(90_000)).alias("high"), F.floor((lo - 50_000) / 7).alias("floored"), F.pmod(lo - 50_000, F.lit(7)).alias("modulo"), F.bround(lo / 8, 0).alias("even"))


@query("e11_quantiles", "SELECT sample, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(stddev_samp(value), 4) AS sd FROM clusters GROUP BY sample")
def e11(v: Tables):
    q = lambda p: F.percentile("value", F.lit(p))
    return v.clusters.groupBy("sample").agg(F.round(q(0.1), 6).alias("p10"), F.round(q(0.5), 6).alias("p50"), F.round(q(0.75) - q(0.25), 6).alias("iqr"), F.round(F.stddev_samp("value"), 4).alias("sd"))


@query("e13_safe_ratio", "SELECT pair, sample, round(CASE WHEN joint + first > 0 THEN joint * 1.0 / (joint + first) END, 6) AS fraction FROM tables")
def e13(v: Tables):
    return v.tables.select("pair", "sample", F.round(S.ratio(F.col("joint"), F.col("joint") + F.col("first")), 6).alias("fraction"))


@query("e14_fingerprint", "SELECT region, sha256(concat('{\"chrom\":', CAST(chrom AS VARCHAR), ',\"hi\":', CAST(hi AS VARCHAR), ',\"lo\":', CAST(lo AS VARCHAR), '}')) AS signature FROM regions")
def e14(v: Tables):
    return v.regions.select("region", F.sha2(F.to_json(F.struct("chrom", "hi", "lo")), 256).alias("signature"))


@query("e16_log_factorial_all", "SELECT region, round(lgamma(hi - lo + 1), 4) AS log_factorial FROM regions")
def e16_all(v: Tables):
    n = F.col("hi") - F.col("lo")
    return v.regions.select("region", F.round(F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0.0), lambda a, i: a + F.log(i.cast("double"))), 4).alias("log_factorial"))


# ---------------------------------------------------------------- notebooks and projections (N, P)


@query("n01_frequency_rank", f"WITH {_FREQ} SELECT region, sample, row_number() OVER (PARTITION BY sample ORDER BY -round(freq, 6), region) AS place FROM freq WHERE freq IS NOT NULL")
def n01(v: Tables):
    f = _freq(v).where("freq IS NOT NULL")
    w = Window.partitionBy("sample").orderBy(-F.round("freq", 6), "region")
    return f.select("region", "sample", F.row_number().over(w).cast("long").alias("place"))


@query("n03_best_comparison", f"WITH {_FREQ} SELECT region, count(*) AS n, max(round(freq, 6)) AS best, arg_min(sample, (-round(freq, 6), sample)) AS sample FROM freq WHERE freq IS NOT NULL GROUP BY region")
def n03(v: Tables):
    f = _freq(v).where("freq IS NOT NULL").withColumn("freq", F.round("freq", 6))
    return f.groupBy("region").agg(F.count("*").alias("n"), F.max("freq").alias("best"), F.min_by("sample", F.struct(-F.col("freq"), "sample")).alias("sample"))


@query("n08_full_outer_tallies", "WITH a AS (SELECT gene, count(*) AS n FROM clusters WHERE sample = 0 AND gene % 7 > 0 GROUP BY gene), b AS (SELECT gene, count(*) AS n FROM clusters WHERE sample = 1 AND gene % 5 > 0 GROUP BY gene) SELECT coalesce(a.gene, b.gene) AS gene, coalesce(a.n, 0) AS first, coalesce(b.n, 0) AS second FROM a FULL OUTER JOIN b ON a.gene = b.gene")
def n08(v: Tables):
    a = v.clusters.where("sample = 0 AND gene % 7 > 0").groupBy("gene").agg(F.count("*").alias("first"))
    b = v.clusters.where("sample = 1 AND gene % 5 > 0").groupBy("gene").agg(F.count("*").alias("second"))
    return a.join(b, "gene", "full").fillna(0)


@query("n11_observed_expected_long", f"SELECT pair, state, n FROM (SELECT pair, 'neither' AS state, neither AS n FROM ({_T}) UNION ALL SELECT pair, 'first', first FROM ({_T}) UNION ALL SELECT pair, 'second', second FROM ({_T}) UNION ALL SELECT pair, 'joint', joint FROM ({_T}))")
def n11(v: Tables):
    return _pooled(v).unpivot("pair", ["neither", "first", "second", "joint"], "state", "n")


@query("n20_three_way_counts", "SELECT cluster, sample, chrom, count(*) AS n FROM clusters GROUP BY cluster, sample, chrom")
def n20(v: Tables):
    return v.clusters.groupBy("cluster", "sample", "chrom").agg(F.count("*").alias("n"))


@query("n25_points_in_significant", f"WITH {_PAIRS} SELECT g.gene, r.region, string_agg(DISTINCT CAST(p.b AS VARCHAR), ',' ORDER BY CAST(p.b AS VARCHAR)) AS partners FROM genes g JOIN regions r ON r.chrom = g.chrom AND g.tss >= r.lo AND g.tss < r.hi JOIN prs p ON p.a = r.region GROUP BY g.gene, r.region")
def n25(v: Tables):
    hits = I.point_join(v.genes, v.regions, pos="tss").select(F.col("a_gene").alias("gene"), F.col("b_region").alias("a"))
    pairs = I.pairs_within(_members(v), least=500, most=2000).select("a", "b").distinct()
    return hits.join(pairs, "a").groupBy("gene", F.col("a").alias("region")).agg(F.array_join(F.array_sort(F.collect_set(F.col("b").cast("string"))), ",").alias("partners"))


@query("p06_alleles_per_position", "SELECT chrom, pos, string_agg(DISTINCT CASE WHEN called = 1 THEN 'C' ELSE 'T' END, '/' ORDER BY CASE WHEN called = 1 THEN 'C' ELSE 'T' END) AS alleles FROM calls GROUP BY chrom, pos")
def p06(v: Tables):
    return v.calls.groupBy("chrom", "pos").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("called") == 1, "C").otherwise("T"))), "/").alias("alleles"))


@query("p10_track_rows", "SELECT read, row_number() OVER (PARTITION BY chrom, sample ORDER BY lo, read) AS row, greatest(lo, 20000) AS lo, least(hi, 60000) AS hi FROM reads WHERE lo < 60000 AND hi > 20000".replace(" AS row,", ' AS "row",'))
def p10(v: Tables):
    some = v.reads.where("lo < 60000 AND hi > 20000")
    w = Window.partitionBy("chrom", "sample").orderBy("lo", "read")
    return some.select("read", F.row_number().over(w).cast("long").alias("row"), F.greatest("lo", F.lit(20_000)).alias("lo"), F.least("hi", F.lit(60_000)).alias("hi"))


@query("p46_ordered_groups", f"SELECT a.region, CASE WHEN count(b.gene) = 0 THEN 'intergenic' WHEN bool_or(b.strand = '-') AND bool_or(b.strand = '+') THEN 'both strands' WHEN bool_or(b.strand = '-') THEN 'minus' ELSE 'plus' END AS place FROM regions a LEFT JOIN genes b ON {_OVER} GROUP BY a.region")
def p46(v: Tables):
    minus, plus = F.bool_or(F.col("b_strand") == "-"), F.bool_or(F.col("b_strand") == "+")
    hits = I.overlap_join(v.regions, v.genes, width=10_000).groupBy(F.col("a_region").alias("region")).agg(F.when(minus & plus, "both strands").when(minus, "minus").otherwise("plus").alias("place"))
    return v.regions.select("region").join(hits, "region", "left").fillna("intergenic", ["place"])


@query("p76_trajectories", "SELECT sample, cluster, round(avg(value), 4) AS mean, round(stddev_samp(value) / sqrt(count(*)), 4) AS sem FROM clusters GROUP BY sample, cluster")
def p76(v: Tables):
    return v.clusters.groupBy("sample", "cluster").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value") / F.sqrt(F.count("*")), 4).alias("sem"))


@query("p79_extremes", "SELECT sample, read, CASE WHEN top <= 5 THEN 'top' ELSE 'bottom' END AS tail FROM (SELECT sample, read, row_number() OVER (PARTITION BY sample ORDER BY value DESC, read) AS top, row_number() OVER (PARTITION BY sample ORDER BY value, read) AS low FROM clusters) WHERE top <= 5 OR low <= 5")
def p79(v: Tables):
    top = P.top(v.clusters, 5, by=["sample"], order=[F.desc("value"), "read"]).withColumn("tail", F.lit("top"))
    low = P.top(v.clusters, 5, by=["sample"], order=["value", "read"]).withColumn("tail", F.lit("bottom"))
    return top.unionByName(low).select("sample", "read", "tail")


@query("s36_annotation_parse", "SELECT gene, split_part(a, ';', 1) AS gene_id, split_part(a, ';', 2) AS name, regexp_replace(split_part(a, ';', 1), '\\.[0-9]+$', '') AS stem FROM (SELECT gene, concat('G', CAST(gene AS VARCHAR), '.', CAST(nation AS VARCHAR), ';', name, ';x') AS a FROM genes)")
def s36(v: Tables):
    a = v.genes.select("gene", F.concat(F.lit("G"), F.col("gene").cast("string"), F.lit("."), F.col("nation").cast("string"), F.lit(";"), "name", F.lit(";x")).alias("a"))
    first = F.split_part("a", F.lit(";"), F.lit(1))
    return a.select("gene", first.alias("gene_id"), F.split_part("a", F.lit(";"), F.lit(2)).alias("name"), F.regexp_replace(first, r"\.[0-9]+$", "").alias("stem"))


@query("s54_weighted_signal", f"SELECT a.region, round(sum((least(a.hi, b.hi) - greatest(a.lo, b.lo)) * b.score) * 1.0 / sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)), 6) AS mean FROM regions a JOIN elements b ON {_OVER} GROUP BY a.region")
def s54(v: Tables):
    return I.overlap_join(v.regions, v.elements).groupBy(F.col("a_region").alias("region")).agg(F.round(F.sum(F.col("overlap") * F.col("b_score")) / F.sum("overlap"), 6).alias("mean"))


@query("s32_read_ends", "SELECT chrom, CASE WHEN strand = '-' THEN hi ELSE lo + 1 END AS pos, count(*) AS n FROM reads GROUP BY 1, 2")
def s32(v: Tables):
    return v.reads.groupBy("chrom", F.when(F.col("strand") == "-", F.col("hi")).otherwise(F.col("lo") + 1).alias("pos")).agg(F.count("*").alias("n"))


@query("s44_filter_then_overlap", "SELECT c.read, c.pos, r.region FROM (SELECT read, chrom, pos FROM calls WHERE called = 1 AND sample = 2) c JOIN regions r ON c.chrom = r.chrom AND c.pos >= r.lo AND c.pos < r.hi")
def s44(v: Tables):
    got = I.point_join(v.calls.where("called = 1 AND sample = 2").select("read", "chrom", "pos"), v.regions)
    return got.select(F.col("a_read").alias("read"), F.col("a_pos").alias("pos"), F.col("b_region").alias("region"))
