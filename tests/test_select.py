import random

from tessera.operators import select as P


def greedy(rows, distance, most):
    chosen = []
    for r in sorted(rows, key=lambda r: (-r[2], r[3])):
        if r[1] is not None and len(chosen) < most and all(c[0] != r[0] or abs(c[1] - r[1]) > distance for c in chosen):
            chosen.append(r)
    return chosen


def test_spaced_equals_the_greedy_loop(spark):
    rows = [(1, p, s, i) for i, (p, s) in enumerate([(150, 9.0), (99, 8.0), (98, 7.0), (5, 6.0), (None, 10.0)])]
    rng = random.Random(3)
    more = [(rng.randrange(3), rng.randrange(3000), float(rng.randrange(50)), i) for i in range(400)]
    for own, most in ((rows, 5), (more, 25), (more, 3), (rows[:0], 3)):
        df = spark.createDataFrame(own, "chrom int, lo long, score double, id int")
        for batch in (3, 1000):
            got = P.spaced(df.selectExpr("*", "-score AS first"), distance=100, order=["first", "id"], most=most, batch=batch).drop("first").collect()
            assert sorted(map(tuple, got)) == sorted(greedy(own, 100, most))
