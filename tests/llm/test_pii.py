import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, r in RULES.items() for m in r.finditer(text) if holds(k, m.group())]


PARTS = ["a", "b.c", "@", "x@y.com", ".", "+x@y.org", "_", " ", "  ", "-", "1", "255", "256", "1.2.3.4", "4041894974608795", "4041 8949 7460 8795", "+1 (988) 555-2485", "+", "(", ")", "🙂", "é", "\n", "007.000000.1.0255", "12-34", "٣"]


def listed(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def test_base_spans_equal_plain_patterns(spark):
    texts = [""]

    @settings(max_examples=1500, deadline=None, database=None)
    @given(st.lists(st.sampled_from(PARTS), max_size=12))
    def gather(parts):
        texts.append("".join(parts))

    gather()
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", "t", pii.base_spans().alias("s")).collect()
    for r in rows:
        assert [tuple(s) for s in r.s] == brute(r.t), r.t


ROWS = [(1, "mail x@y.com and 1.2.3.4"), (2, None), (3, ""), (3, ""), (None, "+1 (988) 555-2485"), (5, "9" * 30_000), (6, "a" * 100_000), (7, "1 " * 20_000), (8, "x.y" * 20_000 + "@"), (9, "no data 12"), (9, "other x@y.com")]


def test_query_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS h", "3 AS spans", "4 AS kind", "5 AS t")
    got = pii.pii(docs).collect()
    want = []
    for i, t in ROWS:
        b = brute(t or "") if i != 5 else []
        want.append((i, *(sum(s[0] == k for s in b) for k in pii.KINDS), hashlib.sha256(listed(b).encode()).hexdigest(), listed(b)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"some prose here. Call Phone: +1 (988) 555-{1000 + i} today") for i in range(40)]
    rows += [(100 + i, f"More prose. Phone: 555-{7000 + i} maybe") for i in range(4)]
    rows += [(200 + i, f"Version the 10.{i}.7788 of the +1 (988) 555-{2000 + i} the end of the the day") for i in range(10)]
    got = {r.doc_id: r for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:19:27" and got[100].n_phone == 0
    assert all(got[i].spans == listed(brute(t)) for i, t in rows if i < 100 or i >= 200)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail x@y.com, ip 1.2.3.4.", "a"), (2, None, "b"), (2, "none", "c"), (None, "é🙂 +1 (988) 555-2485", "d")], "doc_id long, text string, id string")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "mail [EMAIL], ip [IP].", "a"), (2, None, "b"), (2, "none", "c"), (None, "é🙂 [PHONE]", "d")]))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pii(docs).count() == 0 and pii.redact(docs).count() == 0
