import hashlib
import re

from tessera.llm import spotsigs as ss

STOP = set(ss.ANCHORS)


def chains(text):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    out = set()
    for i, w in enumerate(words):
        if w in STOP and not (i + 1 < len(words) and words[i + 1] in STOP):
            rest = [x for x in words[i + 1 :] if x not in STOP][:2]
            if len(rest) == 2:
                out.add(" ".join(rest))
    return out or ({"<" + " ".join(words)} if words else set())


TEXTS = [
    "The cat of the house and a dog. Was it the very end of it?", "plain words without any chain", "", "the the the", "Der Hund und die Katze, le chien et les chats noirs",
    "of alpha the beta gamma of", "the cat sat on the mat with a hat " * 2000, "the " + "x" * 50_000 + " y", "Über das schöne Wetter: für 12 Tage", "!!! ...",
]


def test_signature_counts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", ss.signatures("t").alias("s")).collect()
    for r in rows:
        assert len(r.s) == len(chains(TEXTS[r.i])), TEXTS[r.i][:60]
        assert list(r.s) == sorted(set(r.s))


def test_compared_with_edited_and_next(spark):
    rows = [(3, "the cat of the house and the dog in the garden with the big tree"), (1, "the sun and the moon are in the sky of the night with the stars"), (7, None), (7, ""), (None, "abc"), (9, "éé🙂 the one two"), (9, "éé🙂 the one two"), (12, "the cat of the house and the dog in the garden with the big tree")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS s", "3 AS t", "4 AS n", "5 AS q")
    got = ss.compare_edited(docs).collect()
    assert len(got) == len(rows)
    order = [(None, "abc"), (1, rows[1][1]), (3, rows[0][1]), (7, ""), (9, rows[5][1]), (12, rows[7][1])]
    follows = {k[0]: order[(i + 1) % len(order)][1] for i, k in enumerate(order)}
    own = {}
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id)
        q = len(text) // 4
        edited = text[: len(text) - q] + follows[r.doc_id][:q]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        own[r.doc_id] = r
    assert own[3].fingerprint == own[12].fingerprint and len(own[3].fingerprint) % 8 == 0
    a, b = chains(rows[0][1]), chains(rows[0][1][: -(len(rows[0][1]) // 4)])
    assert abs(own[3].near_edited - len(a & b) / len(a | b)) < 1e-9
    assert own[1].near_next == 0 and own[7].near_edited == 1 and 0 < own[3].near_edited < 1


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(5, "the only one here")], "doc_id long, text string")
    assert [(r.near_next, r.doc_id) for r in ss.compare_edited(docs).collect()] == [(1.0, 5)]
    assert ss.compare_edited(docs.limit(0)).count() == 0


def test_partitions_hold_what_can_be_similar(spark):
    sizes = spark.range(1, 300).selectExpr("sequence(1, cast(id AS int)) AS s")
    got = {len(r.s): r.p for r in sizes.select("s", ss.partition_of(sizes.s).alias("p")).collect()}
    assert all(abs(got[a] - got[b]) <= 1 for a in got for b in got if min(a, b) >= 0.75 * max(a, b))
