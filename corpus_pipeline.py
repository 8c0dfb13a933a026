"""The corpus pipeline: its stages in order, each a function of the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, fresh, table, written
from tessera.llm.ngram_join import first_of_each
from tessera.llm.packing import pack
from tessera.llm.pii import redact
from tessera.llm.quality import classify
from tessera.llm.toxicity import apply, fit, train_rows

#: Documents that reach this score go.
TOXIC = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose perplexity is within their language's threshold."""
    into = tuple(fresh(docs, c) for c in ("perplexity", "threshold", "good"))
    return classify(docs, table(spark, sf_dir, "labels"), train_rows=train_rows, into=into).where(F.col(into[2])).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity stays below TOXIC."""
    lexicon, score = fit(docs, table(spark, sf_dir, "labels"), train=train_rows), fresh(docs, "score")
    return apply(docs, lexicon, score_col=score).where(F.col(score) < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of similar ones."""
    return first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the text."""
    return redact(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]
#: Models and graph components are not SQL's; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again; a stage's input goes when its result is there.

    Null and empty texts go with the first stage, as they have no perplexity.  Very long texts pass whole, repeated rows
    are one document from the third stage on, an empty table gives an empty result, and further columns stay as they are
    up to the last stage, whatever their names."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if number:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
