"""Neighbours over many blocks and odd vectors equal SQL; clustering holds no matrix of pairs."""

import math
import tracemalloc

import duckdb
import numpy as np
import pytest

from tessera.functions import kernels as K
from tessera.operators import neighbours as N
from tessera.plans import QUERIES, SQL
from tests.test_oracle import norm


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(3).tolist(), i % 3) for i in range(120)]
    rows[9:15] = [(i, rows[3][1], 0) for i in range(9, 15)]  # copies
    rows[20] = (20, [*rows[20][1][:4], None, *rows[20][1][5:]], 2)  # a component is null
    rows[21] = (21, rows[21][1][:5], 0)  # a shorter vector
    rows[22:24] = [(22, [0.3] * 8, 1), (23, [0.3] * 8, 1)]  # constant
    rows[24:28] = [(24, None, 0), (25, [], 1), (26, rows[26][1], None), (27, [None] * 8, 0)]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def same_as_sql(name, spark, path, monkeypatch, rows):
    monkeypatch.setattr(N, "BLOCK_ROWS", rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    df, got = QUERIES[name](spark, path), con.execute(SQL[name])
    names = [d[0] for d in got.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in df.columns) for r in got.fetchall())
    assert want and sorted(tuple(map(norm, r)) for r in df.collect()) == want


@pytest.mark.parametrize("rows", [7, 1024])
def test_manhattan_neighbours_of_odd_vectors(spark, odd, monkeypatch, rows):
    same_as_sql("y07_manhattan_neighbours", spark, odd, monkeypatch, rows)


def test_graph_of_odd_vectors(spark, odd, monkeypatch):
    same_as_sql("y07_neighbour_graph", spark, odd, monkeypatch, 7)


def test_majority_of_odd_vectors(spark, odd, monkeypatch):
    same_as_sql("y13_majority_label", spark, odd, monkeypatch, 7)


def test_majority_deals_votes_once(spark):
    near = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 1), (2, 5, 2)], "src long, dst long, rank int")
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(1, 6)], "src long, label string")
    got = N.majority(near, labels)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b")]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert sum("hashpartitioning(src" in line for line in plan.splitlines() if "Exchange" in line) == 1


@pytest.mark.parametrize("rows", [7, 1024])
def test_correlation_neighbours_of_odd_vectors(spark, odd, monkeypatch, rows):
    same_as_sql("y06_correlation_neighbours", spark, odd, monkeypatch, rows)


def odd_block(rng, rows):
    """Vectors of which some are copies, multiples, constant, or lack components; names of which two are equal."""
    x, has = rng.normal(size=(rows, 12)), np.ones((rows, 12), bool)
    x[5:9], x[9], x[10] = x[4], 2 * x[4], 0.25
    has[11, 3:], has[12, 5] = False, False
    x[~has], x[13, 2] = 0, np.inf
    return x, has, np.array([0, 0, *range(2, rows)])


def best(pieces, way, k):
    """Row: its k best columns with values, from pieces in the order of SQL."""
    rows = {}
    for at, *found in pieces:
        for r, c, d, none in zip(*found) if at == way else ():
            rows.setdefault(int(r), []).append((bool(none), bool(np.isnan(d)), 0.0 if np.isnan(d) else float(d), int(c)))
    return {r: sorted(v)[:k] for r, v in rows.items()}


def closest_is_plain(distance, monkeypatch, tile):
    monkeypatch.setattr(K, "_TILE", tile)
    rng = np.random.default_rng(11)
    for rows, k in ((150, 5), (40, 50), (14, 1)):
        (x, has_x, names), (y, has_y, _) = odd_block(rng, rows), odd_block(rng, rows + 9)
        y[14:20] = x[4:10]
        d, none = distance(x, y, has_x, has_y)
        pieces = K.closest(distance, x, y, has_x, has_y, None, k)
        assert best(pieces, 0, k) == best([(0, *K.least(d, none, None, k))], 0, k)
        assert best(pieces, 1, k) == best([(1, *K.least(d.T, none.T, None, k))], 1, k)
        d, none = distance(x, x, has_x, has_x)
        assert best(K.closest(distance, x, x, has_x, has_x, names, k), 0, k) == best([(0, *K.least(d, none, names[:, None] == names, k))], 0, k)


def pairs_computed(distance, monkeypatch, x, k):
    """How many distances are computed one by one for the k nearest within x; none may be left to the kernel of all pairs."""
    sound, rough, exact = K._SCREENS[distance]
    done = []
    monkeypatch.setitem(K._SCREENS, distance, (sound, rough, lambda p, q, r, c: done.append(len(r)) or exact(p, q, r, c)))
    has = np.ones(x.shape, bool)
    pieces = K.closest(distance, x, x, has, has, np.arange(len(x)), k)
    assert done and [len(p[1]) for p in pieces] == [len(x) * k]
    return sum(done)


@pytest.mark.parametrize("tile", [16, 2048])
def test_correlation_screen_is_exact(monkeypatch, tile):
    closest_is_plain(K.correlation_distance, monkeypatch, tile)


def test_correlation_of_few_pairs_is_computed(monkeypatch):
    assert pairs_computed(K.correlation_distance, monkeypatch, np.random.default_rng(12).normal(size=(1500, 64)), 3) < 4 * 1500


@pytest.mark.parametrize("tile", [16, 2048])
def test_manhattan_screen_is_exact(monkeypatch, tile):
    closest_is_plain(K.manhattan, monkeypatch, tile)


@pytest.mark.parametrize("distance", [K.manhattan, K.correlation_distance])
def test_copies_are_left_to_the_kernel(distance, monkeypatch):
    for name, value in (("_TILE", 32), ("_FEW", 50), ("_SIDE", 20)):
        monkeypatch.setattr(K, name, value)
    closest_is_plain(distance, monkeypatch, 32)
    x, has = np.random.default_rng(14).normal(size=(90, 6)), np.ones((90, 6), bool)
    x[30:80] = x[3]
    d, none = distance(x, x, has, has)
    assert best(K.closest(distance, x, x, has, has, np.arange(90), 4), 0, 4) == best([(0, *K.least(d, none, np.eye(90, dtype=bool), 4))], 0, 4)


@pytest.mark.parametrize("distance", [K.manhattan, K.correlation_distance])
def test_later_tiles_leave_fewer_pairs(distance, monkeypatch):
    monkeypatch.setattr(K, "_TILE", 250)
    x = np.random.default_rng(15).normal(size=(1500, 64))
    assert pairs_computed(distance, monkeypatch, x, 5) < 20 * 1500  # each tile by itself: 30 at least


def test_manhattan_of_few_pairs_is_computed(monkeypatch):
    x = np.random.default_rng(12).normal(size=(1500, 64))
    assert pairs_computed(K.manhattan, monkeypatch, x, 5) < 8 * 1500
    assert pairs_computed(K.manhattan, monkeypatch, np.repeat(x, 5, axis=1), 5) < 6 * 1500


@pytest.mark.parametrize("scale, shift, width", [(1.0, 0.0, 64), (1e-200, 0.0, 64), (1e200, 0.0, 3), (1e-3, 1e9, 64), (1.0, -5.0, 300)])
def test_steps_are_as_near_as_they_say(scale, shift, width):
    x, y = np.random.default_rng(13).standard_cauchy(size=(2, 90, width)).clip(-9, 9) * scale + shift
    y[:9] = x[:9]
    a, b, values, error, measure = K._rough_manhattan(x, y)
    rough = values(a, b)
    d = np.array([[math.fsum(abs(u - v)) for v in y] for u in x])
    assert np.abs(measure(d) - rough).max() <= error < 1.1 * width and rough.max() < np.iinfo(rough.dtype).max
    assert K._rough_manhattan(x[:1], x[:1]) is None


def test_ward_equals_updated_distances():
    rng = np.random.default_rng(8)
    for points in (rng.normal(size=(40, 5)), np.repeat(rng.normal(size=(12, 3)), 3, axis=0), rng.normal(size=(3, 2)) + 1e4):
        n = len(points)
        d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        size, heights = np.ones(n), []
        for _ in range(n - 1):
            i, j = sorted(divmod(int(np.argmin(d)), n))
            heights.append(d[i, j])
            rest = np.isfinite(d[i]) & np.isfinite(d[j])
            d[i, rest] = d[rest, i] = ((size[i] + size[rest]) * d[i, rest] + (size[j] + size[rest]) * d[j, rest] - size[rest] * d[i, j]) / (size[i] + size[j] + size[rest])
            d[j, :] = d[:, j] = np.inf
            size[i] += size[j]
        merges = K.ward(points)
        assert np.allclose(merges[:, 2] ** 2, heights, atol=1e-9) and merges[-1, 3] == n
        labels = K.cut(merges, n, 3)
        e = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        assert np.allclose(K.cluster_sums(points, labels), np.stack([e[:, labels == c].sum(axis=1) for c in range(3)], axis=1))


def test_clustering_holds_no_matrix_of_pairs():
    points = np.random.default_rng(9).normal(size=(2000, 64))
    tracemalloc.start()
    K.silhouette(points, K.cut(K.ward(points), len(points), 4))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000  # all differences of pairs are 2 GB
