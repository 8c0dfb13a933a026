import random
import zlib

from tessera.llm import toxicity as tx


def test_folding():
    assert tx.fold("ІDІ0T! sc.u.m, $tup1d Ébène 12.5 ...") == " idiot scum stupid ebene 125 "
    assert tx.fold("") == "  "


def test_exceptions_and_word_edges():
    lexicon = tx.Lexicon({" trash ": 4.0, " idio": 5.0}, ("trash can",), slope=10.0, middle=0.5)
    a = lexicon.automaton()
    assert lexicon.density(a, "the trash can is full") == 0
    assert lexicon.density(a, "they are TR4SH") == 4 / 2
    assert lexicon.density(a, "an 1diotic plan, trashy") == 5 / 5**0.5
    assert lexicon.density(a, "") == 0 and lexicon.density(a, "...") == 0
    assert 0 < lexicon.score(a, "") < 0.1 < 0.9 < lexicon.score(a, "idiot " * 3) <= 1
    assert tx.Lexicon().score(tx.Lexicon().automaton(), "idiot") < 0.7


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        y = int(i % 5 == 0)
        for _ in range(6 * y):
            text.insert(rng.randrange(len(text)), rng.choice(["scumbag", "m0ron", "zzloser"]) + rng.choice(["", "!", "s"]))
        rows.append((i, " ".join(text), y))
    return rows


def test_held_out_accuracy_and_edge_rows(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "scumbag"), (9001, None), (9001, None), (9002, ""), (9003, "clean words " * 40_000)], "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS t", "2 AS y", "3 AS id", "4 AS toxic")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (9002, None, 1), (3, 0, 1)], "doc_id long, toxic int, quality int")
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == 605
    by = {r.doc_id: r for r in got}
    for i, _, y in rows:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [(by[i].predicted, y) for i, _, y in rows if by[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert by[9001].predicted == by[9002].predicted == by[9003].predicted == 0 and by[None].held_out is False


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    real = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    other = spark.createDataFrame([(i, 1 - y if tx.held_out(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    assert sorted(map(tuple, tx.toxicity(docs, real).collect())) == sorted(map(tuple, tx.toxicity(docs, other).collect()))


def repeated(stem, other, n=400, seed=5):
    """Texts of which every fifth is toxic and repeats a stem; every sixth clean one has it once, every third has ``other``."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text, y = [rng.choice(words) for _ in range(rng.randint(60, 120))], int(i % 5 == 0)
        for _ in range(rng.randint(4, 8) if y else i % 6 == 1):
            text.insert(rng.randrange(len(text)), stem + rng.choice(words))
        for _ in range(3 if not y and i % 3 == 2 else 0):
            text.insert(rng.randrange(len(text)), other + rng.choice(words))
        rows.append((" ".join(text), y))
    return rows


def test_repetition_and_accents_count():
    for stem, other in (("zorklich", "vampen"), ("réeux", "reeux")):
        rows = repeated(stem, other)
        lexicon = tx.learn(rows[:250])
        automaton = lexicon.automaton()
        held = [(lexicon.score(automaton, t) >= 0.7, y) for t, y in rows[250:]]
        assert sum(p == y for p, y in held) >= 0.97 * len(held)
        assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held)


def test_the_query_spares_exceptions(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(40)]
        for _ in range(5 * (i % 5 == 0)):
            text.insert(rng.randrange(len(text)), rng.choice(["pathetic", "worthless", "idiotic", "moronic"]))
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    clean = "the path to Morocco was worth it, Wort for Wort an idiom; paths are worthy"
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, clean), (1001, "pathetic worthless idiot, moronic path")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    by = {r.doc_id: r.predicted for r in tx.toxicity(docs, labels).collect()}
    assert by[1000] == 0 and by[1001] == 1


def test_forms_have_the_same_words():
    for text in ("Réeux d'Été ... 12.5 n\u0303a", "\u0301a é\u00b4x ª ŉ", "", "Łódź Straße ІDІ0T"):
        plain, accented = tx.fold_both(text)
        assert plain == tx.fold(text) and plain.count(" ") == accented.count(" ")
    assert tx.fold_both("Réeux re\u0301eux") == (" reeux reeux ", " réeux réeux ")


def test_no_rows(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.toxicity(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert [r.predicted for r in tx.toxicity(some, labels).collect()] == [0]


def test_long_words_take_linear_time():
    import time

    began = time.perf_counter()
    for word in ("a" + "!" * 1_000_000 + "x", "!" * 1_000_000, "!" * 500_000 + "moron" + "." * 500_000):
        tx.fold_both(word)
    assert time.perf_counter() - began < 10


def test_fit_equals_learn(spark):
    """Counting on executors gives the lexicon that counting in one place gives."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))] + ["scümbag", "m0ron"][: 2 * (i % 8 == 0)] * 3
        rng.shuffle(text)
        rows.append((i, " ".join(text) if i % 50 else None, i % 8 == 0))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(3, rows[3][1])] * 5, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1)], "doc_id long, toxic int")
    a, b = tx.fit(docs, marks), tx.learn([(t, y) for _, t, y in rows])
    assert a.weights.keys() == b.weights.keys() and all(abs(a.weights[e] - b.weights[e]) < 1e-9 for e in b.weights)
    assert abs(a.slope - b.slope) < 1e-6 and abs(a.middle - b.middle) < 1e-6
