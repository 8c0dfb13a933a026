import random

import numpy as np

from tessera.llm import ngram_join as nj
from tessera.llm.components import components


def plain_set(text, k=5):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k=5, percent=75):
    sets = [plain_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(map(str, ((r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))))


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.3:
            base = passage + base[: rng.randint(0, 40)]
        for _ in range(rng.choice([1, 1, 1, 3, 8])):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: rng.randint(max(1, len(words) * 7 // 10), len(words))]
            rows.append((len(rows) * 3 % 1000, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


EDGES = [(5000, None), (5001, ""), (5002, " \n "), (None, "a b c"), (5003, "A b\tc"), (5003, "a b c"), (5004, "é É ß x"), (5005, "word " * 30_000), (5006, "word " * 7), (None, "lonely text without an id here now"), (5007, "É é ß x")]


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nj, "COMMON", 3)
    for seed in (1, 2):
        rows = corpus(seed) + (EDGES if seed == 1 else [])
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS t", "3 AS n", "4 AS node", "5 AS component_id").repartition(3)
        assert sorted(map(str, map(tuple, nj.near_duplicates(docs).collect()))) == brute(rows)


def test_split_tiles_equal_brute_force(spark, monkeypatch):
    """Very common shingles, in tiles of a few rows a part."""
    monkeypatch.setattr(nj, "COMMON", 3)
    monkeypatch.setattr(nj, "NEAR", 2)
    monkeypatch.setattr(nj, "BLOCK", 1 << 40)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(40)] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(words[: rng.randint(25, 40)])))
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    members, labels = nj.join(docs, id_col="id", part=4)
    found = {r.node: r.label for r in labels.collect()}
    own = [(r.id, r.n, r.node) for r in members.collect()]
    least = {}
    for i, _, node in own:
        label = found.get(node, node)
        least[label] = min(least.get(label, i), i)
    assert sorted(str((i, n, least[found.get(node, node)])) for i, n, node in own) == brute(rows)


def test_bounds_and_reach():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        i = len(np.intersect1d(x, y))
        assert nj.bound(nj.bitmap(x).view(np.uint64), len(x), nj.bitmap(y).view(np.uint64), len(y)) >= i
        if nj.similar(i, len(x), len(y), 75):
            assert set(x[: nj.reach(len(x), 75)].tolist()) & set(y[: nj.reach(len(y), 75)].tolist())


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 5, 30, 300]))) for _ in range(300)]
    monkeypatch.setattr(nj, "_SPAN", 200)
    monkeypatch.setattr(nj, "_LONG", 250)
    nj._powers.cache_clear()
    got = nj.words_of("\n ".join(words).encode())
    alone = {w: nj.words_of(w.encode())[0] for w in words}
    assert got.tolist() == [alone[w] for w in words]
    assert len(set(alone.values())) == len(alone)
    assert nj.words_of(("x " + "y" * 500 + " x").encode())[[0, 2]].tolist() == [nj.words_of(b"X")[0]] * 2
    nj._powers.cache_clear()


def test_components_of_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 90), (None, 3), (100, 90), (80, 100)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 80: 80, 90: 80, 100: 80}


def test_no_rows(spark):
    assert nj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_shingles_go_when_the_tiles_are_there(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.llm.common.shared_dir", lambda _: str(tmp_path))
    rows = [(i, f"the same words again and again in document {i // 2}") for i in range(6)]
    members, labels = nj.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert members.count() == 6 and labels.count() >= 0
    assert not [f for d in tmp_path.glob("nodes-*") for f in d.glob("part-*")]
