"""Per-group models: kernels applied to one region, pair or gene at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K


def cluster_graph(edges: DataFrame, *, group: str, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """``group``, ``row``, ``cluster`` (1 is the largest) of an edge table (src, dst, weight), and ``modularity``."""
    kind = edges.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, index = np.unique(np.concatenate([pdf.src, pdf.dst]), return_inverse=True)
        s, d = index[: len(pdf)], index[len(pdf) :]
        order = np.lexsort((d, s))
        s, d, w = s[order], d[order], pdf.weight.to_numpy()[order]
        labels = K.communities(len(names), s, d, w, resolution=resolution, seed=seed)
        rank = np.empty(labels.max() + 1, int)
        rank[np.lexsort((np.arange(labels.max() + 1), -np.bincount(labels)))] = np.arange(1, labels.max() + 2)
        return pd.DataFrame({group: pdf[group].iloc[0], "row": names, "cluster": rank[labels], "modularity": K.modularity(labels, s, d, w, resolution)})

    return edges.groupBy(group).applyInPandas(one, f"{group} {kind}, row long, cluster long, modularity double")


def cluster_ward(rows: DataFrame, *, group: str, row: str, vector: str, most: int = 10) -> DataFrame:
    """``group``, ``row``, ``cluster``, ``k``: minimal-variance clustering cut where the mean silhouette is best."""
    kind = rows.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        points = np.stack(pdf[vector].to_list()).astype(float)
        merges, best = K.ward(points), (-2.0, 1, np.zeros(len(points), int))
        finest = min(most, len(points) - 1)
        small = K.cut(merges, len(points), finest) if finest > 1 else best[2]
        sums, head = K.cluster_sums(points, small), np.unique(small, return_index=True)[1]
        for k in range(2, finest + 1):
            labels = K.cut(merges, len(points), k)
            of = np.eye(k)[labels[head]]  # the cluster that holds each of the smallest ones
            best = max(best, (K.silhouette(points, labels, sums @ of), -k, labels), key=lambda b: b[:2])
        return pd.DataFrame({group: pdf[group].iloc[0], "row": pdf[row], "cluster": best[2] + 1, "k": int(best[2].max()) + 1})

    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # by number, as a few bytes are much work here
    dealt = rows.select(group, row, F.col(vector).cast("array<double>").alias(vector)).repartition(tasks, group)
    return dealt.groupBy(group).applyInPandas(one, f"{group} {kind}, row long, cluster long, k long")


def odds_ratios(tables: DataFrame) -> DataFrame:
    """Adds the conditional maximum-likelihood odds ratio; each distinct table is solved once."""
    cells = ["neither", "first", "second", "joint"]
    once = tables.select(*(F.col(c).cast("long").alias(c) for c in cells)).distinct()

    def solve(batches):
        for pdf in batches:
            yield pdf.assign(conditional_odds=[K.conditional_odds_ratio(*t) for t in pdf[cells].itertuples(index=False)])

    return tables.join(once.mapInPandas(solve, "neither long, first long, second long, joint long, conditional_odds double"), cells)


def adjusted_logistic(tables: DataFrame, *, pair: str, unit: str, least: int = 1) -> DataFrame:
    """Per pair, a binomial regression of openness of one side on that of the other with an intercept per unit:
    ``estimate``, ``se``, ``lrt`` and ``status``.  Units without variation say nothing; separated pairs are not tested."""
    kind = tables.schema[pair].dataType.simpleString()
    cells = ["neither", "first", "second", "joint"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.sort_values(unit)[cells].to_numpy(float)
        closed, opened = t[:, [0, 2]], t[:, [1, 3]]  # columns: second closed, second open
        n, y = closed + opened, opened
        t_ok = (n.sum(axis=1) >= least) & (y.sum(axis=1) > 0) & (y.sum(axis=1) < n.sum(axis=1)) & (n > 0).all(axis=1)
        n, y = n[t_ok], y[t_ok]
        out = {pair: pdf[pair].iloc[0], "units": int(t_ok.sum()), "estimate": None, "se": None, "lrt": None, "status": "tested"}
        totals = np.array([(n - y)[:, 0].sum(), y[:, 0].sum(), (n - y)[:, 1].sum(), y[:, 1].sum()])
        if not len(n):
            out["status"] = "no informative unit"
        elif (totals == 0).any():
            out["status"] = "separated"
        else:
            units = np.repeat(np.eye(len(n)), 2, axis=0)
            x = np.tile([0.0, 1.0], len(n))[:, None]
            beta, full, se = K.logistic(np.hstack([units, x]), y.ravel(), n.ravel())
            _, null, _ = K.logistic(units, y.ravel(), n.ravel())
            out |= {"estimate": float(beta[-1]), "se": float(se[-1]), "lrt": max(0.0, 2 * (full - null))}
        return pd.DataFrame([out])

    return tables.select(pair, unit, *cells).groupBy(pair).applyInPandas(one, f"{pair} {kind}, units long, estimate double, se double, lrt double, status string")


def heterogeneity(tables: DataFrame, *, pair: str) -> DataFrame:
    """``pair``, ``statistic``, ``df``: Breslow-Day over a pair's strata."""
    kind = tables.schema[pair].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        value, df = K.breslow_day(pdf[["neither", "first", "second", "joint"]].to_numpy())
        return pd.DataFrame([{pair: pdf[pair].iloc[0], "statistic": None if np.isnan(value) else value, "df": df}])

    return tables.groupBy(pair).applyInPandas(one, f"{pair} {kind}, statistic double, df long")


def permuted_spearman(rows: DataFrame, x: str, y: str, *, by: str, stratum: str, draws: int = 1000, seed: int = 1) -> DataFrame:
    """``by``, ``n``, ``rho``, ``p``: pooled rank correlation against shuffles within strata; one-sided, plus-one."""
    kind = rows.schema[by].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[x, y]).sort_values([stratum, x, y])
        a, b = pdf[x].rank().to_numpy(), pdf[y].rank().to_numpy()
        out = {by: pdf[by].iloc[0] if len(pdf) else None, "n": len(pdf), "rho": None, "p": None}
        if len(pdf) > 2 and a.std() and b.std():
            rng, groups = np.random.default_rng(seed), [np.flatnonzero(pdf[stratum] == s) for s in pdf[stratum].unique()]
            a, b = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
            rho, hits = float((a * b).mean()), 0
            for _ in range(draws):
                c = b.copy()
                for g in groups:
                    c[g] = rng.permutation(c[g])
                hits += (a * c).mean() >= rho - 1e-12
            out |= {"rho": rho, "p": (1 + hits) / (1 + draws)}
        return pd.DataFrame([out])

    return rows.select(by, stratum, x, y).groupBy(by).applyInPandas(one, f"{by} {kind}, n long, rho double, p double")


def bootstrap_median(rows: DataFrame, value: str, *, by: str, draws: int = 500, seed: int = 1) -> DataFrame:
    """``by``, ``median``, ``low``, ``high``: the median with the middle 95 % of its resampled values."""
    kind = rows.schema[by].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v, rng = np.sort(pdf[value].dropna().to_numpy(float)), np.random.default_rng(seed)
        drawn = np.array([np.median(v[rng.integers(0, len(v), len(v))]) for _ in range(draws)]) if len(v) else np.array([np.nan])
        return pd.DataFrame([{by: pdf[by].iloc[0], "median": float(np.median(v)) if len(v) else None, "low": float(np.quantile(drawn, 0.025)), "high": float(np.quantile(drawn, 0.975))}])

    return rows.select(by, value).groupBy(by).applyInPandas(one, f"{by} {kind}, median double, low double, high double")


def fit_topics(counts: DataFrame, *, group: str, row: str, feature: str, n: str, k: int = 3, seed: int = 0) -> DataFrame:
    """``group``, ``row``, ``loadings``, ``dominant`` of each row of a region's row-by-feature counts."""
    kind = counts.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=row, columns=feature, values=n, aggfunc="sum", fill_value=0).sort_index()
        loadings, _ = K.topics(wide.to_numpy(float), k, seed=seed)
        return pd.DataFrame({group: pdf[group].iloc[0], "row": wide.index, "loadings": loadings.tolist(), "dominant": loadings.argmax(axis=1) + 1})

    return counts.groupBy(group).applyInPandas(one, f"{group} {kind}, row long, loadings array<double>, dominant long")


def peaks(rows: DataFrame, *, key: str, curve: str, distance: int = 20, prominence: float = 0.01) -> DataFrame:
    """``key``, ``lag``, ``height`` of the local maxima of each row's curve."""
    kind = rows.schema[key].dataType.simpleString()

    def each(batches):
        for pdf in batches:
            out = [(k, int(p), float(c[p])) for k, c in zip(pdf[key], pdf[curve]) if c is not None for p in K.local_peaks(np.asarray(c, float), distance=distance, prominence=prominence)]
            yield pd.DataFrame(out, columns=[key, "lag", "height"])

    return rows.select(key, curve).mapInPandas(each, f"{key} {kind}, lag long, height double")
