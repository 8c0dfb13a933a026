"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe_tree import bpe_round_trip
from .chat import DIGESTS_SQL, conversation_digests
from .common import table
from .ngram_join import near_duplicates
from .packing import pack
from .pii import pii
from .quality import classify
from .spotsigs import compare_edited
from .token_store import token_store
from .toxicity import train_rows, toxicity


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts are full of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], turns.schema)
    return conversation_digests(turns.unionByName(more))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its perplexity under the model of the trusted texts outside the held-out third of ids."""
    judged = classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"), train_rows=train_rows, drop_text=True)
    return judged.select("doc_id", "lang", (~F.coalesce(train_rows(F.col("doc_id")), F.lit(True))).alias("held_out"), "perplexity", "threshold", "good")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_token_store, op3_spotsigs, op4_pii, op5_packing, op6_ngram_join, op7_chat, op8_ann, op9_quality, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": DIGESTS_SQL}
