"""Per-group models.  SQL cannot express them; tests hold the kernels against brute force and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import neighbours as N
from ..operators import stats as S
from .q_statistics import _knn, _pooled
from .registry import Tables, query


@query("y08_graph_communities")
def y08(v: Tables):
    return M.cluster_graph(N.graph(_knn(v), group="label"), group="label")


@query("y19_ward_silhouette")
def y19(v: Tables):
    return M.cluster_ward(v.embeddings, group="label", row="vec_id", vector="embedding")


@query("x02_conditional_odds")
def x02(v: Tables):
    return M.odds_ratios(_pooled(v)).select("pair", F.round("conditional_odds", 6).alias("conditional_odds"))


@query("x15_adjusted_logistic")
def x15(v: Tables):
    return M.adjusted_logistic(v.tables, pair="pair", unit="sample")


@query("x20_heterogeneity")
def x20(v: Tables):
    return M.heterogeneity(v.tables, pair="pair")


@query("x13_permuted_spearman")
def x13(v: Tables):
    return M.permuted_spearman(v.regions.withColumn("w", (F.col("hi") - F.col("lo")).cast("double")).withColumn("x", F.col("lo").cast("double")), "w", "x", by="chrom", stratum="kind", draws=200)


@query("x42_bootstrap_median")
def x42(v: Tables):
    return M.bootstrap_median(v.clusters, "value", by="gene", draws=200)


@query("y20_topics")
def y20(v: Tables):
    place = F.struct("chrom", "sample").alias("place")
    n = v.calls.withColumn("bin", F.floor((F.col("pos") % 1000) / 100)).groupBy(F.to_json(place).alias("place"), "read", "bin").agg(F.count("*").alias("n"))
    each = M.fit_topics(n, group="place", row="read", feature="bin", n="n")
    of = F.from_json("place", "chrom long, sample long")
    return each.select(of["chrom"].alias("chrom"), of["sample"].alias("sample"), "row", "loadings", "dominant")


@query("y03_acf_peaks")
def y03(v: Tables):
    acf = v.embeddings.select("vec_id", S.autocorrelation(F.col("embedding").cast("array<double>"), 40).alias("acf"))
    return M.peaks(acf, key="vec_id", curve="acf", distance=5)
