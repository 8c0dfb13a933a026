import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import bpe_tree, ngram_join, quality, tokens, toxicity
from tests.llm.test_ngram_join import plain_set
from tests.llm.test_pii import brute
from tests.llm.test_quality import slow_perplexity


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(250)]
    docs, labels = [], []
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        toxic, bad = int(i % 10 == 0), int(i % 7 == 0)
        for _ in range(8 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["scumbag", "zmoron"]))
        if i % 9 == 1:
            text.insert(5, rng.choice(["me@x.org", "10.0.0.7", "+1 (988) 555-2485"]))
        text = " ".join(text)
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1 - bad, toxic))
    for i in range(500, 560):
        source = docs[rng.randrange(500)]
        docs.append((i, source[1] + rng.choice(["", " hi"]), *source[2:]))
    return docs, labels


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    states, frame = [docs], spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in cp.STAGES:
        out = f"{where}/{name}"
        stage(spark, frame, where).write.parquet(out)
        frame = spark.read.parquet(out)
        states.append(sorted(tuple(r) for r in frame.collect()))
    return where, labels, states


def test_stages_equal_plain_versions(run, spark):
    where, labels, (docs, good, clean, single, redacted, packed) = run
    by = {i: (q, t) for i, q, t in labels}
    # quality: the model of the trusted texts, thresholds from their own perplexities
    trusted = [d for d in docs if d[0] in by and by[d[0]][0] == 1 and not toxicity.held_out(d[0])]
    ids = spark.createDataFrame([(d[0],) for d in trusted], "i long")
    apart = {r.i for r in ids.where(quality.calibrates(F.col("i"))).collect()}
    perplexity = slow_perplexity([d[1] for d in trusted if d[0] not in apart])
    scores = sorted(perplexity(d[1]) for d in trusted if d[0] in apart)
    limit = scores[math.ceil(0.99 * len(scores)) - 1] * 1.1
    assert good == sorted(d for d in docs if perplexity(d[1]) <= limit)
    assert sum(1 for d in good if d[0] in by and not by[d[0]][0]) == 0
    assert sum(1 for d in good if d[0] in by) >= 0.99 * sum(q for q, _ in by.values())
    # toxicity
    lexicon = toxicity.learn([(d[1], by[d[0]][1]) for d in good if d[0] in by and not toxicity.held_out(d[0])])
    automaton = lexicon.automaton()
    assert clean == sorted(d for d in good if lexicon.score(automaton, d[1]) < cp.TOXIC)
    assert not any(re.search("scumbag|zmoron", d[1]) for d in clean)
    # near duplicates
    sets = [plain_set(d[1]) for d in clean]
    parent = list(range(len(clean)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(clean)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert single == [clean[i] for i in range(len(clean)) if find(i) == i]
    # personal data
    for before, after in zip(single, redacted):
        text = before[1]
        for kind, a, b in sorted(brute(text), key=lambda s: -s[1]):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        assert after == (before[0], text, before[2], before[3], len(text))
    # packing: every piece once, sequences gapless and within bounds
    want = {d[0]: len(tokens.byte_bpe().encode(d[1])) + 1 for d in redacted}
    assert {i: sum(p[3] for p in packed if p[0] == i) for i in want} == want and {p[0] for p in packed} == set(want)
    bins = {}
    for p in packed:
        bins.setdefault(p[5], []).append((p[6], p[3]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(want.values()) // 1024) + 1


def test_run_equals_the_stages(run, spark):
    where, _, states = run
    key = lambda rows: sorted(tuple(r)[:5] for r in rows)
    assert key(cp.run(spark, where).collect()) == key(states[-1])


def test_one_row_of_each_group(spark):
    rows = [(3, "a b c d e f", 1), (3, "a b c d e f", 1), (1, "A b c d e f", 2), (None, "a b c d e f", 3), (4, "", 4), (5, None, 5), (None, "x y", 6), (None, "X y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    got = sorted((r.doc_id, (r.text or "").lower(), r.node) if r.doc_id is not None else (-1, r.text.lower(), 0) for r in ngram_join.first_of_each(docs).collect())
    assert got == [(-1, "x y", 0), (1, "a b c d e f", 2), (4, "", 4), (5, "", 5)]
