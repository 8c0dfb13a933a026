import numpy as np

from tessera.llm import ann


def exact(rows, k):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        vectors[i] = min(vectors.get(i, v), v)
    out = {}
    for q, x in vectors.items():
        if q % 20 == 0:
            scored = sorted((-float(np.dot(np.array(x, float), np.array(y, float))), i) for i, y in vectors.items() if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def check(got, want, least):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by.keys() == {q for q, hits in want.items() if hits}
    hit = total = 0
    for q, hits in by.items():
        assert len(hits) == len(want[q]) and hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        hit += len({i for i, _ in hits} & {i for i, _ in want[q]})
        total += len(hits)
    assert hit >= least * total
    return by


def test_recall_with_copies_and_lengths(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * rng.uniform(0.3, 1.5)).astype(np.float32).tolist()) for i in range(1500)]
    longest = max(rows, key=lambda r: np.linalg.norm(r[1]))
    rows += [(i, longest[1]) for i in range(1500, 2000)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS p", "4 AS shard", "5 AS label")
    by = check(ann.nearest(docs, lambda i: i % 20 == 0, shard_points=400).collect(), exact(rows, 20), 0.97)
    # the copies come first for each other, smallest ids first
    assert [i for i, _ in by[1520]][:3] == [longest[0], 1500, 1501]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 0.0]), (None, [1.0, 1.0]), (7, []), (8, [0.5, 0.5]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 2.0, 3.0]), (60, [2.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(docs, lambda i: i % 20 == 0).collect()
    check(got, exact(rows, 20), 1.0)
    assert [(r.vec_id, r.score) for r in got if r.query_id == 0] == [(20, 1.0), (1, 0.5), (8, 0.5)]


def test_no_rows(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 20 == 0).count() == 0
