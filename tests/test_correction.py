import random

from tessera.operators import stats as S


def plain(rows):
    out = {}
    for family in {f for f, _, p in rows}:
        own = sorted((r for r in rows if r[0] == family and r[2] is not None and r[2] == r[2]), key=lambda r: r[2])
        least = 1.0
        for rank in range(len(own), 0, -1):
            least = min(least, own[rank - 1][2] * len(own) / rank)
            out[own[rank - 1][1]] = least
    return out


def test_correction_equals_the_plain_loop(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["x", "y", None]), i, rng.choice([None, float("nan"), 0.0, 1.0, 10 ** -rng.uniform(0, 30), rng.random() ** 4, 0.25])) for i in range(600)]
    df = spark.createDataFrame(rows, "f string, i int, p double")
    for family, own in ((["f"], rows), ([], [(0, i, p) for _, i, p in rows])):
        got = {r.i: r.fdr for r in S.benjamini_hochberg(df, family=family).collect()}
        want = plain(own)
        assert len(got) == 600 and all((got[i] is None) == (i not in want) for i in got)
        assert all(abs(got[i] - want[i]) <= 1e-12 * want[i] for i in want)
    assert S.benjamini_hochberg(df.limit(0), family=["f"]).count() == 0
