import itertools

import numpy as np

from tessera.functions import kernels as K


def blobs(seed=0, n=20):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.2, (n, 3)) for c in (0, 3, 6)])


def test_communities_beat_trivial_partitions_and_are_connected():
    points = blobs()
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    src, dst = np.nonzero(np.triu(d < 4, 1))
    weight = np.exp(-d[src, dst])
    labels = K.communities(len(points), src, dst, weight)
    q = K.modularity(labels, src, dst, weight)
    assert q >= K.modularity(np.arange(len(points)), src, dst, weight)
    assert q >= K.modularity(np.zeros(len(points), int), src, dst, weight)
    assert [len(set(labels[k : k + 20])) for k in (0, 20, 40)] == [1, 1, 1] and len(set(labels)) == 3


def test_ward_finds_groups():
    points = blobs(1, 8)
    merges = K.ward(points)
    labels = K.cut(merges, len(points), 3)
    assert [len(set(labels[k : k + 8])) for k in (0, 8, 16)] == [1, 1, 1]
    assert K.silhouette(points, labels) > K.silhouette(points, K.cut(merges, len(points), 2))
    assert (np.diff(merges[:, 2]) >= -1e-9).all()


def test_conditional_odds_ratio_solves_its_equation():
    for t in [(8, 2, 3, 9), (30, 5, 6, 4), (3, 1, 1, 3)]:
        r = K.conditional_odds_ratio(*t)
        neither, first, second, joint = t
        m, k, n = joint + first, joint + second, sum(t)
        x = np.arange(max(0, m + k - n), min(m, k) + 1)
        from math import comb

        w = np.array([comb(m, i) * comb(n - m, k - i) * r**i for i in x.tolist()])
        assert abs((x * w).sum() / w.sum() - joint) < 1e-6
    assert K.conditional_odds_ratio(3, 1, 1, 0) == 0 and K.conditional_odds_ratio(3, 0, 2, 4) == float("inf")


def test_logistic_equals_the_log_odds_of_one_table():
    x = np.array([[1.0, 0.0], [1.0, 1.0]])
    beta, _, se = K.logistic(x, np.array([10.0, 24.0]), np.array([40.0, 40.0]))
    assert abs(beta[1] - np.log(24 / 16 / (10 / 30))) < 1e-6
    assert abs(se[1] - np.sqrt(1 / 10 + 1 / 30 + 1 / 24 + 1 / 16)) < 1e-6


def test_heterogeneity_is_zero_for_equal_tables():
    value, df = K.breslow_day(np.array([[20, 10, 8, 12]] * 3))
    assert abs(value) < 1e-9 and df == 2
    assert K.breslow_day(np.array([[20, 1, 1, 20], [1, 20, 20, 1]]))[0] > 10


def test_topics_recover_blocks():
    rng = np.random.default_rng(3)
    counts = np.zeros((40, 10))
    counts[:20, :5] = rng.poisson(5, (20, 5))
    counts[20:, 5:] = rng.poisson(5, (20, 5))
    l, f = K.topics(counts, 2)
    assert np.allclose(l.sum(axis=1), 1) and np.allclose(f.sum(axis=1), 1)
    best = l.argmax(axis=1)
    assert len(set(best[:20])) == len(set(best[20:])) == 1 and best[0] != best[-1]


def test_peaks_and_sites():
    curve = np.zeros(100)
    curve[30], curve[35], curve[70:73] = 1.0, 0.9, 0.5
    assert K.local_peaks(curve).tolist() == [30, 71]
    kept = K.representative_sites(np.array([0, 1, 50, 0]), np.array([10, 11, 60, 10]), np.array([1e-5, 1e-6, 1e-4, 1e-3]), np.array(["a", "b", "c", "b"]))
    assert kept.tolist() == [1, 2, 3]


def test_small_partitions_by_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = 6
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        if not pairs:
            continue
        src, dst = np.array(pairs).T
        weight = rng.random(len(pairs))
        best = max(K.modularity(np.array(x), src, dst, weight) for x in itertools.product(range(n), repeat=n) if list(dict.fromkeys(x)) == sorted(set(x)))
        assert K.modularity(K.communities(n, src, dst, weight), src, dst, weight) >= best - 0.08
