import hashlib

import duckdb

from tessera.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "user", "again <|end|>"), (1, 2, "assistant", "a<\\|next|>b<|text|>"), (1, 3, "assistant", None), (1, 4, "assistant", "é🙂"),
    (2, 0, None, ""), (2, None, "sys<|text|>tem", "[INST]\\"), (None, 1, "assistant", "x"), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "assistant", "tie"),
    (4, 0, "assistant", "long " * 50_000), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]
DDL = "conv_id long, turn long, role string, text string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS formatted", "2 AS t", "3 AS n", "4 AS conv", "5 AS lead")


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c))
        trained = "".join(x for _, r, x in own if r == "assistant")
        listed = "".join(f"{r}\n{x}\n" for _, r, x in own)
        out[c] = (len(own), hashlib.sha256(listed.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest())
    return out


def test_digests_read_back(spark):
    got = {r.conv_id: tuple(r)[1:5] for r in chat.conversation_digests(frame(spark)).collect()}
    assert got == expected(ROWS)


def test_adjacent_turns_of_a_role_share_a_block(spark):
    made = {r.conv_id: r for r in chat.format_conversations(frame(spark)).collect()}
    assert made[1].formatted == "<|turn|>user<|text|>hi<|next|>again <\\|end|><|end|><|turn|>assistant<|text|>a<\\\\|next|>b<\\|text|><|next|><|next|>é🙂<|end|>"
    assert [made[1].formatted[s.start : s.end] for s in made[1].loss] == ["a<\\\\|next|>b<\\|text|>", "", "é🙂"]


def test_conversations_longer_than_a_chunk(spark):
    rows = [(c, n, "user" if n % 7 < 3 else "assistant", f"{n}<|next|>") for c, size in ((1, chat.CHUNK), (2, chat.CHUNK + 1), (3, 3 * chat.CHUNK - 1)) for n in range(size)]
    assert {r.conv_id: tuple(r)[1:5] for r in chat.conversation_digests(frame(spark, rows)).collect()} == expected(rows)
    blocks = {r.conv_id: r.formatted.count(chat.TURN) for r in chat.format_conversations(frame(spark, rows)).collect()}
    for c in (1, 2, 3):
        roles = [r for i, _, r, _ in rows if i == c]
        assert blocks[c] == 1 + sum(x != y for x, y in zip(roles, roles[1:]))


def test_sql_agrees(spark):
    own = [r for r in ROWS if r[0] != -7]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", own)
    want = con.execute(chat.DIGESTS_SQL).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in chat.conversation_digests(frame(spark)).collect())


def test_no_conversations(spark):
    assert chat.conversation_digests(frame(spark, [])).count() == 0
