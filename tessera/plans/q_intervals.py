"""Blocks, coordinates and interval joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import intervals as I
from .registry import Tables, query

# ---------------------------------------------------------------- blocks and coordinates (T)


@query("t01_longest_alignment", "SELECT donor, read, lo, hi FROM reads QUALIFY row_number() OVER (PARTITION BY donor ORDER BY hi - lo DESC, lo, read) = 1")
def t01(v: Tables):
    return B.longest(v.reads, key="donor", order=("lo", "read")).select("donor", "read", "lo", "hi")


_BLOCKS = """
WITH p AS (SELECT read, chrom, lo, CAST(string_split(rtrim(sizes, ','), ',') AS BIGINT[]) AS s, CAST(string_split(rtrim(starts, ','), ',') AS BIGINT[]) AS o, CAST(string_split(scores, ',') AS BIGINT[]) AS c FROM beds),
x AS (SELECT read, chrom, lo, s, o, c, unnest(generate_series(1, 4)) AS i FROM p)
SELECT {cols} FROM x WHERE {cond}
"""


@query("t02_block_expand", _BLOCKS.format(cols="read, chrom, CAST(i - 1 AS INTEGER) AS block, lo + o[i] AS lo, lo + o[i] + s[i] AS hi, c[i] AS score", cond="i IN (2, 3)"))
def t02(v: Tables):
    return B.expand(v.beds, scores="scores").select("read", "chrom", "block", "lo", "hi", "score")


@query("t03_block_expand_filtered", _BLOCKS.format(cols="read, lo + o[i] AS lo, lo + o[i] + s[i] AS hi, c[i] AS score", cond="i IN (2, 3) AND s[i] BETWEEN 20 AND 60 AND c[i] >= 50"))
def t03(v: Tables):
    return B.expand(v.beds, scores="scores", size=(20, 60), least_score=50).select("read", "lo", "hi", "score")


@query("t04_valid_blocks", "WITH p AS (SELECT read, CAST(string_split(rtrim(sizes, ','), ',') AS BIGINT[]) AS s, CAST(string_split(rtrim(starts, ','), ',') AS BIGINT[]) AS o, hi - lo AS n FROM beds) SELECT read, o[1] + s[1] <= o[2] AND o[2] + s[2] <= o[3] AND o[3] + s[3] <= o[4] AND o[4] + s[4] <= n AS valid FROM p")
def t04(v: Tables):
    zipped = F.arrays_zip(B.numbers(F.col("sizes")).alias("size"), B.numbers(F.col("starts")).alias("off"))
    return v.beds.select("read", B.valid_blocks(zipped, F.col("hi") - F.col("lo")).alias("valid"))


@query("t05_size_class", "SELECT read, el, CASE WHEN hi - lo BETWEEN 300 AND 550 THEN '300-550 bp' WHEN hi - lo BETWEEN 150 AND 300 THEN '150-300 bp' WHEN hi - lo BETWEEN 60 AND 100 THEN '60-100 bp' END AS class FROM elements")
def t05(v: Tables):
    return v.elements.select("read", "el", B.size_class(F.col("hi") - F.col("lo"), [60, 100, 150, 300, 300, 550]).alias("class"))


@query("t06_half_open_bins", "SELECT read, CAST(sum(CASE WHEN hi - lo >= 60 AND hi - lo < 100 THEN 1 ELSE 0 END) AS BIGINT) AS small, CAST(sum(CASE WHEN hi - lo >= 150 AND hi - lo < 300 THEN 1 ELSE 0 END) AS BIGINT) AS middle FROM elements GROUP BY read")
def t06(v: Tables):
    name = B.size_class(F.col("hi") - F.col("lo"), [60, 100, 150, 300], half_open=True, names=["small", "middle"])
    return v.elements.withColumn("c", name).groupBy("read").agg(F.count_if(F.col("c") == "small").alias("small"), F.count_if(F.col("c") == "middle").alias("middle"))


@query("t07_relative_interval", "SELECT region, gene, CASE WHEN strand = '-' THEN -(r.hi - 1 - tss) ELSE r.lo - tss END AS rel_lo, CASE WHEN strand = '-' THEN -(r.lo - tss) ELSE r.hi - 1 - tss END AS rel_hi FROM regions r JOIN genes g ON r.chrom = g.chrom AND r.lo < g.hi AND g.lo < r.hi")
def t07(v: Tables):
    both = I.overlap_join(v.regions, v.genes, width=10_000)
    lo, hi = B.relative(F.col("a_lo"), F.col("a_hi"), F.col("b_tss"), F.col("b_strand"))
    return both.select(F.col("a_region").alias("region"), F.col("b_gene").alias("gene"), lo.alias("rel_lo"), hi.alias("rel_hi"))


@query("t09_strand_sign_tss", "SELECT read, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS sign, CASE WHEN strand = '-' THEN hi - 1 ELSE lo END AS five_prime FROM reads")
def t09(v: Tables):
    return v.reads.select("read", B.strand_sign(F.col("strand")).alias("sign"), B.tss(F.col("lo"), F.col("hi"), F.col("strand")).alias("five_prime"))


@query("t10_strand_windows", "SELECT gene, greatest(CASE WHEN strand = '-' THEN tss - 999 ELSE tss - 1000 END, 0) AS lo, CASE WHEN strand = '-' THEN tss + 1001 ELSE tss + 1000 END AS hi, greatest(CASE WHEN strand = '-' THEN tss - 299 ELSE tss - 50 END, 0) AS near_lo, CASE WHEN strand = '-' THEN tss + 51 ELSE tss + 300 END AS near_hi FROM genes")
def t10(v: Tables):
    lo, hi = B.window(F.col("tss"), F.col("strand"), 1000, 999)
    near_lo, near_hi = B.window(F.col("tss"), F.col("strand"), 50, 299)
    return v.genes.select("gene", lo.alias("lo"), hi.alias("hi"), near_lo.alias("near_lo"), near_hi.alias("near_hi"))


@query("t12_density", "SELECT region, round(count(*) / (max(r.hi) - max(r.lo)) / (SELECT count(*) / 1e6 FROM reads), 6) AS rpm_per_base, round(greatest(count(*) / 10.0 - 2, 1), 6) AS clamped FROM regions r JOIN reads d ON r.chrom = d.chrom AND r.lo < d.hi AND d.lo < r.hi GROUP BY region")
def t12(v: Tables):
    n = v.reads.agg((F.count("*") / F.lit(1e6)).alias("m"))
    got = I.overlap_join(v.regions, v.reads).groupBy(F.col("a_region").alias("region")).agg(F.count("*").alias("n"), F.max(F.col("a_hi") - F.col("a_lo")).alias("w"))
    return got.crossJoin(F.broadcast(n)).select("region", F.round(F.col("n") / F.col("w") / F.col("m"), 6).alias("rpm_per_base"), F.round(F.greatest(F.col("n") / 10.0 - 2, F.lit(1.0)), 6).alias("clamped"))


@query("t14_region_anchors", "SELECT region, coalesce(min(g.tss), CAST(floor((max(r.lo) + max(r.hi)) / 2) AS BIGINT)) AS anchor, count(g.gene) AS n_tss FROM regions r LEFT JOIN genes g ON r.chrom = g.chrom AND g.tss >= r.lo AND g.tss < r.hi GROUP BY region")
def t14(v: Tables):
    hits = I.point_join(v.genes, v.regions, pos="tss").groupBy(F.col("b_region").alias("region")).agg(F.min("a_tss").alias("tss"), F.count("*").alias("n"))
    return v.regions.join(hits, "region", "left").select("region", F.coalesce("tss", F.floor((F.col("lo") + F.col("hi")) / 2)).alias("anchor"), F.coalesce("n", F.lit(0)).alias("n_tss"))


@query("t15_resize_on_focus", "SELECT region, greatest(lo - 250, 0) AS lo, hi + 250 AS hi, CAST(floor((lo + hi) / 2) AS BIGINT) - 1000 AS window_lo FROM regions")
def t15(v: Tables):
    return v.regions.select("region", F.greatest(F.col("lo") - 250, F.lit(0)).alias("lo"), (F.col("hi") + 250).alias("hi"), (F.floor((F.col("lo") + F.col("hi")) / 2) - 1000).alias("window_lo"))


@query("t20_grid_positions", "SELECT pos, count(*) AS n FROM (SELECT unnest(generate_series(CAST(greatest(ceil(lo / 50.0) * 50, 0) AS BIGINT), CAST(least(floor((hi - 1) / 50.0) * 50, 90000) AS BIGINT), 50)) AS pos FROM elements) GROUP BY pos")
def t20(v: Tables):
    return v.elements.select(F.explode(B.grid(F.col("lo"), F.col("hi") - 1, 50, 0, 90_000)).alias("pos")).groupBy("pos").agg(F.count("*").alias("n"))


@query("t23_reverse_complement", "SELECT doc_id, reverse(translate(text, 'ACGTNacgtn', 'TGCANtgcan')) AS rc, round(CASE WHEN length(text) - length(replace(upper(text), 'C', '')) > 0 AND length(text) - length(replace(upper(text), 'G', '')) > 0 THEN (length(text) - length(replace(upper(text), 'CG', ''))) / 2.0 * length(text) / ((length(text) - length(replace(upper(text), 'C', ''))) * (length(text) - length(replace(upper(text), 'G', '')))) END, 6) AS cpg FROM (SELECT item_id AS doc_id, text FROM benchmark)")
def t23(v: Tables):
    return v.benchmark.select(F.col("item_id").alias("doc_id"), B.reverse_complement(F.col("text")).alias("rc"), F.round(B.cpg_ratio(F.col("text")), 6).alias("cpg"))


@query("t23_reverse_complement_all", "SELECT item_id AS doc_id, reverse(translate(text, 'ACGTNacgtn', 'TGCANtgcan')) AS rc, length(text) AS n FROM benchmark")
def t23_all(v: Tables):
    return v.benchmark.select(F.col("item_id").alias("doc_id"), B.reverse_complement(F.col("text")).alias("rc"), F.length("text").cast("long").alias("n"))


@query("t26_chromosome_filter", "SELECT n_nationkey, concat('chr', CAST(n_nationkey AS VARCHAR)) AS chrom FROM nation WHERE regexp_matches(concat('chr', CAST(n_nationkey AS VARCHAR)), '^chr([1-9]|1[0-9]|2[0-2]|X|Y)$')")
def t26(v: Tables):
    name = F.concat(F.lit("chr"), F.col("n_nationkey").cast("string"))
    return v.nation.select("n_nationkey", name.alias("chrom")).where(F.col("chrom").rlike("^chr([1-9]|1[0-9]|2[0-2]|X|Y)$"))


@query("t27_zero_crossings", "WITH s AS (SELECT gene, tss AS x, (gene * 37) % 21 - 10 AS y, lead(tss) OVER w AS x2, lead((gene * 37) % 21 - 10) OVER w AS y2 FROM genes WINDOW w AS (ORDER BY tss, gene)) SELECT gene, round(x + (x2 - x) * (0 - y) * 1.0 / (y2 - y), 6) AS crossing FROM s WHERE y * y2 < 0")
def t27(v: Tables):
    y = (F.col("gene") * 37) % 21 - 10
    # a profile of one locus; longer tracks go by locus
    s = v.genes.select("gene", F.col("tss").alias("x"), y.alias("y")).withColumn("x2", F.lead("x").over(Window.partitionBy(F.lit(1)).orderBy("x", "gene"))).withColumn("y2", F.lead("y").over(Window.partitionBy(F.lit(1)).orderBy("x", "gene")))
    return s.where("y * y2 < 0").select("gene", F.round(F.col("x") + (F.col("x2") - F.col("x")) * (-F.col("y")) / (F.col("y2") - F.col("y")), 6).alias("crossing"))


# ---------------------------------------------------------------- joins (J)

_OVER = "a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi"


@query("j01_overlap_join", f"SELECT region, read, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap FROM regions a JOIN reads b ON {_OVER}")
def j01(v: Tables):
    return I.overlap_join(v.regions, v.reads).select(F.col("a_region").alias("region"), F.col("b_read").alias("read"), "overlap")


@query("j02_containment", "SELECT region, count(*) AS n FROM regions a JOIN reads b ON a.chrom = b.chrom AND b.lo <= a.lo AND a.hi <= b.hi GROUP BY region")
def j02(v: Tables):
    return I.containment_join(v.regions, v.reads).groupBy(F.col("a_region").alias("region")).agg(F.count("*").alias("n"))


@query("j03_minimum_fraction", f"SELECT region, read, el FROM regions a JOIN elements b ON {_OVER} WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.5 * (a.hi - a.lo)")
def j03(v: Tables):
    return I.fraction_join(v.regions, v.elements, 0.5).select(F.col("a_region").alias("region"), F.col("b_read").alias("read"), F.col("b_el").alias("el"))


_BLK = "blk AS (SELECT read, chrom, lo + o[i] AS lo, lo + o[i] + s[i] AS hi FROM (SELECT read, chrom, lo, CAST(string_split(rtrim(sizes, ','), ',') AS BIGINT[]) AS s, CAST(string_split(rtrim(starts, ','), ',') AS BIGINT[]) AS o, unnest(generate_series(2, 3)) AS i FROM beds))"


@query("j04_block_coverage", f"WITH {_BLK} SELECT region, read, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS covered, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) = max(a.hi - a.lo) AS whole FROM regions a JOIN blk b ON {_OVER} GROUP BY region, read")
def j04(v: Tables):
    hits = I.overlap_join(v.regions, B.expand(v.beds))
    return hits.groupBy(F.col("a_region").alias("region"), F.col("b_read").alias("read")).agg(F.sum("overlap").alias("covered"), (F.sum("overlap") == F.max(F.col("a_hi") - F.col("a_lo"))).alias("whole"))


@query("j05_within_entity", f"WITH {_BLK} SELECT b.read, b.lo, b.hi FROM blk b WHERE EXISTS (SELECT 1 FROM elements e WHERE e.read = b.read AND e.lo <= b.lo AND b.hi <= e.hi)")
def j05(v: Tables):
    b, e = B.expand(v.beds).select("read", "lo", "hi").alias("b"), v.elements.alias("e")
    return b.join(e, (F.col("b.read") == F.col("e.read")) & (F.col("e.lo") <= F.col("b.lo")) & (F.col("b.hi") <= F.col("e.hi")), "left_semi")


@query("j06_clip_to_blocks", f"WITH {_BLK} SELECT a.read, a.el, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM elements a JOIN blk b ON a.read = b.read AND a.lo < b.hi AND b.lo < a.hi")
def j06(v: Tables):
    return I.clip(v.elements, B.expand(v.beds), on=["read"]).select("read", "el", "lo", "hi")


@query("j07_element_fraction", f"SELECT region, read, count(*) AS n FROM regions a JOIN elements b ON {_OVER} WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.8 * (b.hi - b.lo) GROUP BY region, read")
def j07(v: Tables):
    return I.fraction_join(v.regions, v.elements, 0.8, of="right").groupBy(F.col("a_region").alias("region"), F.col("b_read").alias("read")).agg(F.count("*").alias("n"))


_OPEN = "spans AS (SELECT region, kind, read, sample, donor, b.lo AS rlo FROM regions a JOIN reads b ON a.chrom = b.chrom AND b.lo <= a.lo AND a.hi <= b.hi), hits AS (SELECT DISTINCT region, read FROM regions a JOIN elements b ON a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.5 * (a.hi - a.lo)), opened AS (SELECT s.*, h.read IS NOT NULL AS open FROM spans s LEFT JOIN hits h ON s.region = h.region AND s.read = h.read)"


@query("j08_covered_and_open", f"WITH {_OPEN} SELECT region, read, open FROM opened")
def j08(v: Tables):
    return I.covered_and_open(v.regions, v.reads, v.elements)


_MERGED = "m1 AS (SELECT chrom, lo, hi, CASE WHEN lo > max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY chrom ORDER BY lo, hi) = 1 THEN 1 ELSE 0 END AS new FROM {src}), m2 AS (SELECT chrom, lo, hi, sum(new) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m1), merged AS (SELECT chrom, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM m2 GROUP BY chrom, island)"


@query("j09_universe", f"WITH {_MERGED.format(src='regions WHERE kind > 0')} SELECT region FROM regions a WHERE EXISTS (SELECT 1 FROM merged b WHERE {_OVER} AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.5 * (a.hi - a.lo))")
def j09(v: Tables):
    return I.fraction_join(v.regions, I.merge(v.regions.where("kind > 0")), 0.5).select(F.col("a_region").alias("region")).distinct()


@query("j10_interval_merge", f"WITH {_MERGED.format(src='regions')} SELECT chrom, lo, hi, n FROM merged")
def j10(v: Tables):
    return I.merge(v.regions)


@query("j11_membership", f"SELECT region, {', '.join(f'CAST(coalesce(max(CASE WHEN b.sample = {k} AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.5 * (a.hi - a.lo) THEN 1 END), 0) AS INTEGER) AS sample_{k}' for k in range(4))} FROM regions a LEFT JOIN elements b ON {_OVER} GROUP BY region")
def j11(v: Tables):
    hits = I.fraction_join(v.regions, v.elements, 0.5).groupBy(F.col("a_region").alias("region")).pivot("b_sample", [0, 1, 2, 3]).agg(F.max(F.lit(1)))
    return v.regions.select("region").join(hits, "region", "left").select("region", *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"sample_{k}") for k in range(4)))


@query("j12_gene_windows", f"SELECT region, gene FROM regions a JOIN genes b ON {_OVER}")
def j12(v: Tables):
    return I.overlap_join(v.regions, v.genes, width=10_000).select(F.col("a_region").alias("region"), F.col("b_gene").alias("gene"))


_PAIRS = f"mem AS (SELECT gene, region, a.lo, a.hi FROM regions a JOIN genes b ON {_OVER}), prs AS (SELECT x.gene, x.region AS a, y.region AS b, greatest(y.lo - x.hi, x.lo - y.hi, 0) AS gap FROM mem x JOIN mem y ON x.gene = y.gene AND (y.lo, y.hi, y.region) > (x.lo, x.hi, x.region) WHERE greatest(y.lo - x.hi, x.lo - y.hi, 0) > 500 AND greatest(y.lo - x.hi, x.lo - y.hi, 0) < 2000)"


def _members(v: Tables):
    both = I.overlap_join(v.regions, v.genes, width=10_000)
    return both.select(F.col("b_gene").alias("gene"), F.col("a_region").alias("region"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi"))


@query("j13_pairs_in_windows", f"WITH {_PAIRS} SELECT gene, a, b, gap FROM prs")
def j13(v: Tables):
    return I.pairs_within(_members(v), least=500, most=2000).select("gene", "a", "b", "gap")


@query("j14_distinct_pairs", f"WITH {_PAIRS} SELECT a, b, min(gap) AS gap, count(DISTINCT gene) AS genes FROM prs GROUP BY a, b")
def j14(v: Tables):
    return I.pairs_within(_members(v), least=500, most=2000).groupBy("a", "b").agg(F.min("gap").alias("gap"), F.countDistinct("gene").alias("genes"))


@query("j15_best_overlap", f"SELECT region, b.state, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap FROM regions a JOIN states b ON {_OVER} QUALIFY row_number() OVER (PARTITION BY region ORDER BY least(a.hi, b.hi) - greatest(a.lo, b.lo) DESC, b.lo, b.state) = 1")
def j15(v: Tables):
    return I.best_overlap(v.regions, v.states, key="region", rank=["b_lo", "b_state"]).select(F.col("a_region").alias("region"), F.col("b_state").alias("state"), "overlap")


@query("j16_states", f"WITH c AS (SELECT region, min(b.state) AS centre FROM regions a JOIN states b ON a.chrom = b.chrom AND CAST(floor((a.lo + a.hi) / 2) AS BIGINT) >= b.lo AND CAST(floor((a.lo + a.hi) / 2) AS BIGINT) < b.hi GROUP BY region), w AS (SELECT region, b.state, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS bases FROM regions a JOIN states b ON {_OVER} GROUP BY region, b.state) SELECT w.region, w.state, w.bases, c.centre FROM w LEFT JOIN c ON w.region = c.region")
def j16(v: Tables):
    mid = v.regions.select("region", "chrom", F.floor((F.col("lo") + F.col("hi")) / 2).alias("mid"))
    centre = I.point_join(mid, v.states, pos="mid").groupBy(F.col("a_region").alias("region")).agg(F.min("b_state").alias("centre"))
    bases = I.overlap_join(v.regions, v.states).groupBy(F.col("a_region").alias("region"), F.col("b_state").alias("state")).agg(F.sum("overlap").alias("bases"))
    return bases.join(centre, "region", "left").select("region", "state", "bases", "centre")


@query("j17_best_fraction", f"SELECT region, b.lo AS state_lo, round((least(a.hi, b.hi) - greatest(a.lo, b.lo)) * 1.0 / (a.hi - a.lo), 6) AS fraction FROM regions a JOIN states b ON {_OVER} WHERE (least(a.hi, b.hi) - greatest(a.lo, b.lo)) * 2 >= a.hi - a.lo QUALIFY row_number() OVER (PARTITION BY region ORDER BY least(a.hi, b.hi) - greatest(a.lo, b.lo) DESC, b.lo, b.state) = 1")
def j17(v: Tables):
    best = I.best_overlap(v.regions, v.states, key="region", rank=["b_lo", "b_state"]).where(F.col("overlap") * 2 >= F.col("a_hi") - F.col("a_lo"))
    return best.select(F.col("a_region").alias("region"), F.col("b_lo").alias("state_lo"), F.round(F.col("overlap") / (F.col("a_hi") - F.col("a_lo")), 6).alias("fraction"))


@query("j18_nearest", "WITH g AS (SELECT gene, chrom, tss AS lo, tss + 1 AS hi FROM genes) SELECT r.region, g.gene, greatest(g.lo - r.hi, r.lo - g.hi, 0) AS distance FROM regions r LEFT JOIN g ON r.chrom = g.chrom QUALIFY row_number() OVER (PARTITION BY r.region ORDER BY greatest(g.lo - r.hi, r.lo - g.hi, 0), g.gene) = 1")
def j18(v: Tables):
    points = v.genes.select("gene", "chrom", F.col("tss").alias("lo"), (F.col("tss") + 1).alias("hi"))
    return I.nearest(v.regions, points, key="region", right_key="gene", bucket=25_000)


@query("j20_support_exists", f"SELECT region, EXISTS (SELECT 1 FROM elements b WHERE {_OVER} AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= ceil(0.9 * (a.hi - a.lo))) AS supported FROM regions a")
def j20(v: Tables):
    need = F.ceil((F.col("a_hi") - F.col("a_lo")) * F.lit(0.9).cast("decimal(3,1)"))
    hits = I.overlap_join(v.regions, v.elements).where(F.col("overlap") >= need).select(F.col("a_region").alias("region")).distinct().withColumn("supported", F.lit(True))
    return v.regions.select("region").join(hits, "region", "left").select("region", F.coalesce("supported", F.lit(False)).alias("supported"))


@query("j21_pooled_distinct_index", f"WITH {_BLK}, s AS (SELECT b.* FROM blk b WHERE hi - lo BETWEEN 10 AND 80 AND EXISTS (SELECT 1 FROM elements e WHERE e.read = b.read AND e.lo <= b.lo AND b.hi <= e.hi)) SELECT DISTINCT chrom, lo, hi FROM s")
def j21(v: Tables):
    b, e = B.expand(v.beds, size=(10, 80)).alias("b"), v.elements.alias("e")
    return b.join(e, (F.col("b.read") == F.col("e.read")) & (F.col("e.lo") <= F.col("b.lo")) & (F.col("b.hi") <= F.col("e.hi")), "left_semi").select("chrom", "lo", "hi").distinct()


@query("j22_same_molecule_overlap", f"WITH {_BLK}, f AS (SELECT b.read, b.lo, (least(b.hi, e.hi) - greatest(b.lo, e.lo)) * 1.0 / (b.hi - b.lo) AS fr, e.el FROM blk b JOIN elements e ON b.read = e.read AND b.lo < e.hi AND e.lo < b.hi) SELECT read, lo, bool_or(fr >= 0.5) AS hit, round(max(fr), 6) AS most, string_agg(DISTINCT CAST(el AS VARCHAR), ',' ORDER BY CAST(el AS VARCHAR)) AS els FROM f GROUP BY read, lo")
def j22(v: Tables):
    f = I.overlap_join(B.expand(v.beds), v.elements, on=["read"]).withColumn("fr", F.col("overlap") / (F.col("a_hi") - F.col("a_lo")))
    return f.groupBy(F.col("a_read").alias("read"), F.col("a_lo").alias("lo")).agg(F.bool_or(F.col("fr") >= 0.5).alias("hit"), F.round(F.max("fr"), 6).alias("most"), F.array_join(F.array_sort(F.collect_set(F.col("b_el").cast("string"))), ",").alias("els"))


@query("j24_dominant_site", "WITH h AS (SELECT g.gene, c.pos, c.n, abs(c.pos - g.tss) AS d FROM genes g JOIN calls2 c ON g.chrom = c.chrom AND c.pos >= g.tss - 250 AND c.pos <= g.tss + 250), one AS (SELECT * FROM h QUALIFY count(*) OVER (PARTITION BY pos, n) >= 1) SELECT gene, pos, n, d FROM one QUALIFY row_number() OVER (PARTITION BY gene ORDER BY n DESC, d, pos) = 1".replace("calls2", "(SELECT chrom, pos, count(*) AS n FROM calls GROUP BY chrom, pos)"))
def j24(v: Tables):
    sites = v.calls.groupBy("chrom", "pos").agg(F.count("*").alias("n"))
    near = v.genes.select("gene", "chrom", "tss", (F.col("tss") - 250).alias("lo"), (F.col("tss") + 251).alias("hi"))
    hits = I.point_join(sites, near).withColumn("d", F.abs(F.col("a_pos") - F.col("b_tss")))
    w = Window.partitionBy("b_gene").orderBy(F.desc("a_n"), "d", "a_pos")
    return hits.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("b_gene").alias("gene"), F.col("a_pos").alias("pos"), F.col("a_n").alias("n"), "d")


@query("j23_candidates_full_outer", "WITH a AS (SELECT region FROM regions WHERE kind = 0), b AS (SELECT DISTINCT region FROM regions r JOIN genes g ON r.chrom = g.chrom AND g.tss >= r.lo AND g.tss < r.hi) SELECT coalesce(a.region, b.region) AS region, a.region IS NOT NULL AS annotated, b.region IS NOT NULL AS holds_tss FROM a FULL OUTER JOIN b ON a.region = b.region")
def j23(v: Tables):
    a = v.regions.where("kind = 0").select("region", F.lit(True).alias("x"))
    b = I.point_join(v.genes, v.regions, pos="tss").select(F.col("b_region").alias("region")).distinct().withColumn("y", F.lit(True))
    return a.join(b, "region", "full").select("region", F.col("x").isNotNull().alias("annotated"), F.col("y").isNotNull().alias("holds_tss"))


@query("j26_replicate_intersection", "SELECT a.pos, a.chrom, a.n + b.n AS total, least(a.n, b.n) AS least_n FROM (SELECT chrom, pos, count(*) AS n FROM calls WHERE sample = 0 GROUP BY chrom, pos) a JOIN (SELECT chrom, pos, count(*) AS n FROM calls WHERE sample = 1 GROUP BY chrom, pos) b ON a.chrom = b.chrom AND a.pos = b.pos")
def j26(v: Tables):
    n = v.calls.where("sample IN (0, 1)").groupBy("chrom", "pos").pivot("sample", [0, 1]).agg(F.count("pos"))
    return n.where("`0` IS NOT NULL AND `1` IS NOT NULL").select("pos", "chrom", (F.col("0") + F.col("1")).alias("total"), F.least("0", "1").alias("least_n"))


@query("j27_consensus", "SELECT chrom, pos, CAST(sum(n) AS BIGINT) AS n FROM (SELECT chrom, pos, sample, count(*) AS n FROM calls GROUP BY chrom, pos, sample) GROUP BY chrom, pos HAVING count(*) = 3")
def j27(v: Tables):
    return v.calls.groupBy("chrom", "pos", "sample").agg(F.count("*").alias("n")).groupBy("chrom", "pos").agg(F.sum("n").alias("n"), F.count("*").alias("k")).where("k = 3").drop("k")


@query("j28_near_other_gene", "SELECT gene, EXISTS (SELECT 1 FROM genes b WHERE b.gene <> a.gene AND b.chrom = a.chrom AND a.tss - 3000 <= b.tss AND b.tss <= a.tss + 3000) AS near FROM genes a")
def j28(v: Tables):
    wide = v.genes.select("gene", "chrom", (F.col("tss") - 3000).alias("lo"), (F.col("tss") + 3001).alias("hi"))
    hits = I.point_join(v.genes.select("gene", "chrom", "tss"), wide, pos="tss").where("a_gene <> b_gene").select(F.col("b_gene").alias("gene")).distinct().withColumn("near", F.lit(True))
    return v.genes.select("gene").join(hits, "gene", "left").select("gene", F.coalesce("near", F.lit(False)).alias("near"))


@query("j29_match_status", "SELECT read, CASE count(g.gene) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM reads r LEFT JOIN genes g ON r.chrom = g.chrom AND r.strand = g.strand AND g.tss >= r.lo AND g.tss < r.hi GROUP BY read")
def j29(v: Tables):
    hits = I.point_join(v.genes.select("gene", "chrom", "strand", "tss"), v.reads, pos="tss", on=("chrom", "strand")).groupBy(F.col("b_read").alias("read")).agg(F.count("*").alias("n"))
    return v.reads.select("read").join(hits, "read", "left").select("read", F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("status"))


@query("j34_phase_block_status", "SELECT region, CASE WHEN count(b.gene) = 0 THEN 'unphased' WHEN count(b.gene) > 1 THEN 'ambiguous' ELSE 'phased' END AS status, CASE WHEN count(b.gene) = 1 THEN min(b.gene) END AS block FROM (SELECT region, chrom, CAST(floor((lo + hi) / 2) AS BIGINT) AS mid FROM regions) a LEFT JOIN genes b ON a.chrom = b.chrom AND a.mid >= b.lo AND a.mid < b.hi GROUP BY region")
def j34(v: Tables):
    mid = v.regions.select("region", "chrom", F.floor((F.col("lo") + F.col("hi")) / 2).alias("mid"))
    hits = I.point_join(mid, v.genes, pos="mid", width=10_000).groupBy(F.col("a_region").alias("region")).agg(F.count("*").alias("n"), F.min("b_gene").alias("g"))
    return mid.join(hits, "region", "left").select("region", F.when(F.col("n").isNull(), "unphased").when(F.col("n") > 1, "ambiguous").otherwise("phased").alias("status"), F.when(F.col("n") == 1, F.col("g")).alias("block"))


@query("j38_attach_with_status", "SELECT c.read, c.gene, g.name, CASE WHEN g.gene IS NULL THEN 'no record' WHEN g.nation % 2 = 0 THEN 'kept' ELSE 'excluded' END AS status FROM clusters c LEFT JOIN genes g ON c.gene = g.gene")
def j38(v: Tables):
    g = v.genes.select("gene", "name", "nation")
    return v.clusters.join(g, "gene", "left").select("read", "gene", "name", F.when(F.col("nation").isNull(), "no record").when(F.col("nation") % 2 == 0, "kept").otherwise("excluded").alias("status"))


@query("j40_exact_rematch", "SELECT c.read, c.gene, CASE WHEN r.lo % 2 = 0 THEN r.hi - r.lo END AS body FROM clusters c LEFT JOIN reads r ON c.read = r.read AND c.chrom = r.chrom")
def j40(v: Tables):
    r = v.reads.select("read", "chrom", "lo", "hi")
    return v.clusters.join(r, ["read", "chrom"], "left").select("read", "gene", F.when(F.col("lo") % 2 == 0, F.col("hi") - F.col("lo")).alias("body"))


@query("w08_running_max_end", "SELECT region, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi, region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM regions")
def w08(v: Tables):
    return I.with_running_max(v.regions, "hi", "top", order=("lo", "hi", "region"), bucket=20_000).select("region", "top")
