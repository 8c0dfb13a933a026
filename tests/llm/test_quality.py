import functools
import math
import random
from collections import Counter, defaultdict

from tessera.llm import quality as q


def slow_kneser_ney(texts):
    """The textbook recursion over dictionaries, as a function of an n-gram."""
    size = q.ORDER
    padded = [q.BOUNDARY * (size - 1) + t for t in texts]
    orders = {size: Counter(p[i : i + size] for p in padded for i in range(len(p) - size + 1))}
    for n in range(size - 1, 0, -1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    discounts, histories = {}, {}
    for n, counts in orders.items():
        k1, k2, k3, k4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
        y = k1 / (k1 + 2 * k2) if k1 and k2 else 0.5
        discounts[n] = [min(k, max(0.05, k - (k + 1) * y * b / a)) if a and b else 0.5 for k, a, b in ((1, k1, k2), (2, k2, k3), (3, k3, k4))]
        histories[n] = defaultdict(list)
        for g, c in counts.items():
            histories[n][g[:-1]].append(c)

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / q.CODE_POINTS
        own = histories[n].get(g[:-1])
        if not own:
            return lower
        c, d = orders[n].get(g, 0), discounts[n]
        spare = sum(d[min(x, 3) - 1] for x in own)
        return (c - (d[min(c, 3) - 1] if c else 0)) / sum(own) + spare / sum(own) * lower

    return p


def slow_perplexity(trusted):
    """Perplexity under the model of the trusted texts, as a function of a text."""
    p, size = functools.cache(slow_kneser_ney(trusted)), q.ORDER

    def logs(text):
        padded = q.BOUNDARY * (size - 1) + text
        return [math.log(p(padded[i : i + size])) for i in range(len(text))]

    every = [x for t in trusted for x in logs(t)]
    mean = sum(every) / len(every)
    return lambda text: math.exp(-(sum(logs(text)) + q.PRIOR * mean) / (len(text) + q.PRIOR)) if text else None


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."


def test_perplexities_equal_the_textbook(spark, monkeypatch):
    rng = random.Random(2)
    trusted = [words(rng, "abcdeжщ中文", 30) for _ in range(20)] + ["", trusted_once := "only once here"]
    many = "".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(9000))
    others = [many, many[:300], "abc de", "Zx 12!", "", "中中中中中中", trusted_once * 2, words(rng, "abжz", 3000), "\U0001f600 a", "a"]
    docs = [(i, t) for i, t in enumerate([*trusted, *others, None])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(q, "SPAN", 500)
    monkeypatch.setattr(q, "HELD", 300)
    monkeypatch.setattr(q, "BLOCK_CHARS", 9000)
    m = q.train(frame, spark.createDataFrame([(i,) for i in range(len(trusted))], "i long"))
    want = slow_perplexity(trusted)
    got = {r.doc_id: r.perplexity for r in q.with_perplexity(frame, m).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert got[i] is None if not t else math.isclose(got[i], want(t), rel_tol=1e-9), t


def test_letters_of_every_script_differ(spark):
    """Russian and Chinese text is told apart from its letters in disorder."""
    rng = random.Random(3)
    lexicons = {"ru": [words(rng, "авеинорстлкм", 1)[:-1] for _ in range(60)], "zh": ["".join(rng.choice("的一是不了人我在有他这中大来上国") for _ in range(3)) for _ in range(60)]}
    rows, labels = [], []
    for i in range(400):
        lang = ("ru", "zh")[i % 2]
        text = " ".join(rng.choice(lexicons[lang]) for _ in range(60))
        if i % 10 > 7:
            text = "".join(rng.sample(text, len(text))) if i % 4 > 1 else text[0] * len(text)
        rows.append((i, text, lang))
        labels.append((i, int(i % 10 <= 7)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.good for r in q.classify(docs, marks, train_rows=lambda i: i % 3 != 1, least=5).collect()}
    assert all(got[i] == (i % 10 <= 7) for i in range(400) if i % 3 == 1)


def test_classifier(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        lang = ["en", "de"][i % 2]
        text = words(rng, "etaoin" if lang == "en" else "ruhßöz", rng.randint(20, 120))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), lang))
        labels.append((i, int(good), i % 3))
    rows += [(None, words(rng, "etaoin", 40), "en"), (700, None, "en"), (701, "", None), (702, words(rng, "etaoin", 30_000), "zz"), (3, rows[3][1], "en"), (703, words(rng, "etaoin", 50), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS perplexity", "2 AS good", "3 AS id", "4 AS t", "5 AS language")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.classify(docs, marks, train_rows=lambda i: i % 3 != 1, least=5).collect()
    assert len(got) == len(rows) and {"id", "t", "language"} <= set(got[0].asDict())
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 1]
    wrong = [(r.doc_id, r.perplexity, r.threshold, r.text[:30]) for r in held if r.good != (r.doc_id % 4 > 0)]
    assert len(wrong) <= 0.02 * len(held), wrong[:5]
    by = {r.doc_id: r for r in got}
    assert not by[700].good and not by[701].good and by[702].good and by[703].good and by[None].good
    assert by[700].perplexity is None and by[0].threshold != by[1].threshold


def test_nothing_trusted(spark):
    docs = spark.createDataFrame([(1, "abc", "en"), (2, "", "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.good for r in q.classify(docs, marks).collect()} == {1: True, 2: False}
    assert q.classify(docs.limit(0), marks).count() == 0
