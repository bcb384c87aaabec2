"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarloom.llm import packing, pii, simhash, substring, toxicity
from lidarloom.llm.common import free, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the limit go. A null text counts as empty and is scored like one; rows
    with a repeated or null id are scored each on its own; an empty table stays empty. Extra columns pass through,
    whatever their names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = free(docs, "score")
    return toxicity.scored(docs, labels, score).where(F.col(score) < toxicity.REJECT).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, the one with the least id stays. A null id is the
    least, and of texts under one id the one with the least hash; rows that agree in id and text are one row. Null texts
    and texts without words are copies of one another; texts of fewer than five words are copies if their words are the
    same. Extra columns pass through."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of passages that stand in an earlier document go from the later ones. Every row stays: null texts stay
    null, and texts with fewer words than a run stay as they are. Rows with the same id, or with none, and different texts
    are different documents. Extra columns pass through."""
    return substring.deduplicate(docs).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in angle brackets. Every row stays, a null text as null; repeated rows get
    the same result. Extra columns pass through."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 2048 tokens. A null or empty text is a piece of one
    token; rows with the same id, or with none, are packed each on its own; an empty table gives no rows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Trained scores, fingerprints and token ids are beyond SQL; the tests hold ``run`` against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
