import itertools
import random
import zlib
from functools import cache

import numpy as np

from tessera.llm import packing, tokens


def least_bins(items, capacity):
    items = tuple(sorted(items, reverse=True))

    @cache
    def solve(rest):
        if not rest:
            return 0
        first, others = rest[0], rest[1:]
        best = None
        for k in range(len(others) + 1):
            for pick in itertools.combinations(range(len(others)), k):
                if first + sum(others[i] for i in pick) <= capacity:
                    got = 1 + solve(tuple(x for i, x in enumerate(others) if i not in pick))
                    best = got if best is None else min(best, got)
        return best

    return solve(items)


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(400):
        capacity = rng.choice([10, 17, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = [0] * (capacity + 1)
        for x in items:
            counts[x] += 1
        want, rest = least_bins(items, capacity), list(counts)
        fixed = packing.reduce(rest, capacity)
        left = [x for x, n in enumerate(rest) for _ in range(n)]
        assert sum(n for _, n in fixed) + least_bins(left, capacity) == want
        assert all(sum(p) <= capacity for p, _ in fixed)


def test_plan_places_every_item_once():
    rng = random.Random(6)
    for _ in range(60):
        capacity = 64
        counts = [0] + [rng.choice([0, 0, rng.randint(1, 50)]) for _ in range(capacity)]
        patterns = packing.plan(counts, capacity)
        got = [0] * (capacity + 1)
        for p, n in patterns:
            assert sum(p) <= capacity and n > 0
            for x in p:
                got[x] += n
        assert got == counts
        rooms = []  # best-fit decreasing, item by item
        for x in sorted((x for x, n in enumerate(counts) for _ in range(n)), reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - x)
        assert sum(n for _, n in patterns) <= len(rooms)
        assert sum(n for _, n in packing.best_fit(counts, capacity)) == len(rooms)


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "xyzzy"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(5, "the cat"), (5, "the cat"), (None, None), (900, "abc " * 5000), (901, "")] + [(1000 + i, "same text here") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS length", "3 AS id", "4 AS salt")
    got = packing.pack(docs, capacity=64, salts=4).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    library, want = tokens.byte_bpe().library, []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    assert len(bins) <= -(-sum(w[3] for w in want) // 64) * 1.05 + 1


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
