"""Queries over whole tables leave no row out: held against plain versions on the smallest supplied tables."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.plans import QUERIES
from tessera.plans.q_statistics import _log_factorial
from tessera.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_matrix_has_every_called_site(spark):
    v = Tables(spark, SF)
    reads, calls = v.reads.collect(), v.calls.collect()
    called, value = defaultdict(set), {}
    for c in calls:
        value[c.read, c.pos] = max(c.called, value.get((c.read, c.pos), 0))
        if c.called:
            called[c.chrom].add(c.pos)
    want = {(r.read, p): value.get((r.read, p), 0) for r in reads for p in called[r.chrom] if r.lo <= p < r.hi}
    got = QUERIES["a17_matrix_all"](spark, SF).collect()
    assert len(got) == len(want) and {(r.read, r.pos): r.v for r in got} == want
    chrom, sums = {r.read: r.chrom for r in reads}, defaultdict(lambda: [0, 0])
    for (read, p), x in want.items():
        sums[chrom[read], p][0] += 1
        sums[chrom[read], p][1] += x
    columns = {(r.chrom, r.pos): [r.reads, r.calls] for r in QUERIES["a16_observed_columns_all"](spark, SF).collect()}
    assert columns == {k: x for k, x in sums.items() if x[0] >= 3} and any(p % 40 for _, p in columns)


def test_separation_of_groups_of_every_size(spark):
    v = Tables(spark, SF)
    sizes = {r["gene"]: r["count"] for r in v.clusters.groupBy("gene").count().collect()}
    got = {r.gene: r for r in QUERIES["x11_separation_all"](spark, SF).collect()}
    assert set(got) == set(sizes)
    first = {r["gene"]: r["count"] for r in v.clusters.where("sample = 0").groupBy("gene").count().collect()}
    for gene, n in sizes.items():
        assert abs(got[gene].log_least_p + math.log(math.comb(n, first.get(gene, 0)))) < 1e-5


def test_log_factorial(spark):
    some = [0, 1, 2, 5, 39, 40, 41, 1000, 10**7]
    got = spark.createDataFrame([(n,) for n in some], "n long").select("n", _log_factorial(F.col("n")).alias("f")).collect()
    assert all(abs(r.f - math.lgamma(r.n + 1)) <= 1e-10 + 1e-14 * r.f for r in got)


def test_all_chromosomes_genes_widths_and_whole_texts(spark):
    v = Tables(spark, SF)
    run = lambda name: QUERIES[name](spark, SF).collect()
    calls, clusters = v.calls.collect(), v.clusters.collect()
    assert {(r.chrom, r.read) for r in run("a15_read_proportion_all")} == {(c.chrom, c.read) for c in calls}
    assert {r.chrom for r in run("a23_occupancy_all")} == {r.chrom for r in v.beds.select("chrom").distinct().collect()}
    profile = run("a64_observed_profile_all")
    assert sum(r.chances for r in profile) == len(calls) and len(profile) == 121 * len({c.chrom for c in calls})
    live = {c.gene for c in clusters if c.cluster is not None and c.cluster % 3}
    assert {r.read for r in run("f04_complete_rows_all")} == {c.read for c in clusters if c.cluster is not None and c.gene in live}
    assert {(r.chrom, r.sample, r.row) for r in run("y20_topics")} == {(c.chrom, c.sample, c.read) for c in calls}
    widths = {r.region: r.hi - r.lo for r in v.regions.collect()}
    assert {r.region: r.log_factorial for r in run("e16_log_factorial_all")} == {k: round(math.lgamma(n + 1), 4) for k, n in widths.items()}
    texts = {r.item_id: r.text for r in v.benchmark.collect()}
    flip = str.maketrans("ACGTNacgtn", "TGCANtgcan")
    assert {r.doc_id: r.rc for r in run("t23_reverse_complement_all")} == {k: t.translate(flip)[::-1] for k, t in texts.items()}
    assert max(map(len, texts.values())) > 60
