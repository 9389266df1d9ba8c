"""A corpus through five operators: toxicity, near duplicates, leaks, secrets, and the mix.

Nulls: null and empty texts are scored as empty ones, are no copies of one another, hold no item and
no secret, and end at the mix, which takes nothing of them; null identifiers stay, a null source is a
source of its own. Repeated rows stay or go together up to the mix, which counts each; of near copies
the row of the least identifier stays, ties among equal ones staying together. Empty tables go through
and give no rows. Further columns are kept, but for ``position``, ``epoch`` and ``words``, which the mix
gives out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontam, mixing, secrets, simhash, toxicity
from waymark.llm.common import dropped, new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    return toxicity.reject(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8."""
    return simhash.keep_first(docs, simhash.SIMILAR)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text no benchmark item is found."""
    return decontam.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus to train on: the documents' columns, a row each time that one is taken, at its position, in part where so taken."""
    return mixing.corpus(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", no_toxic), ("near_copies", no_near_copies), ("leaks", no_leaks), ("secrets", no_secrets), ("mix", mixed),
]

#: Fitted models and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; only the last one's table stays."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            dropped(before)
        before = docs
    return docs
