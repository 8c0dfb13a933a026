r"""Conversations as training strings, by Spark expressions only.

A conversation becomes ``<|turn|>role<|text|>text<|end|>`` per turn; adjacent turns of one role share a block, their
texts joined by ``<|next|>``.  Control strings inside roles and texts are escaped by a backslash after their first
character (``<|end|>`` becomes ``<\|end|>``, ``<\|end|>`` becomes ``<\\|end|>``), so no control string is left in them and
taking one backslash away gives them back exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings of this template, and others that tokenizers commonly treat as such.
CONTROLS = (TURN, TEXT, NEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def _pattern(backslashes: str, controls: tuple[str, ...] = CONTROLS) -> str:
    firsts = "".join(sorted({re.escape(c[0]) for c in controls}))
    rests = "|".join(re.escape(c[1:]) for c in controls)
    return rf"([{firsts}]){backslashes}({rests})"


ESCAPE = _pattern(r"(\\*)")
UNESCAPE = _pattern(r"\\(\\*)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


#: Turns merged at a time: appending to an array copies it, so a long conversation is merged part by part.
CHUNK = 512


def _merged(trained_role: str) -> Column:
    """The sorted turns ``t`` (role, escaped role ``er``, escaped text ``et``) merged into ``parts`` and ``loss``.

    The state of the aggregation is the last role, the code points so far, the parts and the spans.  Each chunk is
    aggregated from the role and the place that the chunks before it left; then its parts and spans are appended."""

    def state(role: Column, at: Column, parts: Column, loss: Column) -> Column:
        return F.struct(role.alias("role"), at.alias("at"), parts.alias("parts"), loss.alias("loss"))

    none = F.array().cast("array<string>"), F.array().cast("array<struct<start:bigint,end:bigint>>")

    def turn(a: Column, x: Column) -> Column:
        opening = F.concat(F.when(a["role"].isNull(), "").otherwise(END), F.lit(TURN), x["er"], F.lit(TEXT))
        lead = F.when(a["role"].eqNullSafe(x["role"]), NEXT).otherwise(opening)
        start = a["at"] + F.length(lead)
        end = start + F.length(x["et"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return state(x["role"], end, F.concat(a["parts"], F.array(F.concat(lead, x["et"]))), F.when(x["role"] == trained_role, F.concat(a["loss"], span)).otherwise(a["loss"]))

    def chunk(a: Column, first: Column) -> Column:
        own = F.aggregate(F.slice("t", first, F.lit(CHUNK)), state(a["role"], a["at"], *none), turn)
        return F.transform(F.array(own), lambda o: state(o["role"], o["at"], F.concat(a["parts"], o["parts"]), F.concat(a["loss"], o["loss"])))[0]

    return F.aggregate(F.sequence(F.lit(1), F.size("t"), F.lit(CHUNK)), state(F.lit(None).cast("string"), F.lit(0).cast("long"), *none), chunk)


def format_conversations(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss`` (code-point spans of the trained role's texts).

    A conversation's turns are collected as structs and sorted; adjacent ones of a role are merged by aggregating that
    array.  Null roles and texts count as empty, null turns come first, rows with the same turn are ordered by role and
    text and all stay, null ids form one conversation, and other columns are ignored.
    """
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gathered = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    escaped = gathered.select("conv", F.transform("t", lambda x: F.struct(x["role"].alias("role"), escape(x["role"]).alias("er"), escape(x["text"]).alias("et"))).alias("t"))
    made = escaped.select("conv", _merged(trained_role).alias("m"))
    return made.select(F.col("conv").alias(conv_id), F.concat(F.array_join("m.parts", ""), F.lit(END)).alias("formatted"), F.col("m.loss").alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string as an array of (role, text), in order."""
    blocks = F.filter(F.split(formatted, re.escape(END)), lambda b: b != "")

    def turns(block: Column) -> Column:
        halves = F.split(F.substring(block, len(TURN) + 1, 2**31 - 1), re.escape(TEXT))
        return F.transform(F.split(halves[1], re.escape(NEXT)), lambda t: F.struct(unescape(halves[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between its spans."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations finds in them."""
    made = format_conversations(turns)
    read = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("trained"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.encode("trained", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_ESCAPE = ESCAPE.replace("'", "''")
#: DuckDB: each turn escaped by itself, marks counted at the changes of role.
DIGESTS_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '{_SQL_ESCAPE}', '\1\\\2\3', 'g') AS er, regexp_replace(text, '{_SQL_ESCAPE}', '\1\\\2\3', 'g') AS et,
    lag(role) OVER w IS DISTINCT FROM role AS first, row_number() OVER w AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + CASE WHEN first THEN {len(TURN) + len(TEXT) + len(END)} + length(er) ELSE {len(NEXT)} END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
