"""A corpus pipeline: language ID, near-duplicates, secrets, mixing and packing, each over all that came before.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the cluster's shared folder and reads them again.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns
of any name: an empty table stays empty, other columns pass through as they are, and each stage says the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newslake.llm import langid, mixing, packing, secrets, simhash
from newslake.llm.common import written
from newslake.llm.queries import BYTE_BPE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model of the labelled ones knows.

    Null and empty texts and those without a letter go, and texts that every learned language explains worse than a
    guess. Without a labelled document all go. Rows that repeat are judged alike, a null id or source is no reason.
    """
    return langid.rejected_out(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one with the smallest doc_id.

    Rows with a null id stay only where a group has no other; of rows that share the id, the one of the least
    fingerprint, then of the least text. Null and empty texts are one group.
    """
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live credentials masked in ``text`` and ``n_chars`` following.

    Null texts stay null. Rows that repeat count one holder; a null source or language is a name of its own.
    """
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: clean ones once or twice, toxic and poor ones less.

    Texts without a word keep the rate of the prior; a null id has one copy at least where its rate says so. Rows that
    repeat have equal rates and copies. Without usable labels every document stays once.
    """
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Slots of all documents in sequences of 2048 tokens.

    A null or empty text is its end id alone; a longer one than a sequence is cut into pieces; rows that repeat are
    packed as often as they occur.
    """
    return packing.packed(docs, BYTE_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mixture),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: Models and tokenizers cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
