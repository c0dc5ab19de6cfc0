"""Queries of the llm operators for the driver."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newslake.llm import ann, arrowfile, html, langid, lm, media, mixing, packing, periodic, secrets, simhash, spelling, urlfilter

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op4_arrow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrowfile.encoded(_table(spark, sf_dir, "documents"), WORD_BPE)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(_table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned_secrets(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered_urls(_table(spark, sf_dir, "pages"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic(_table(spark, sf_dir, "documents"), plant=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm, op2_html, op3_media, op4_arrow_ids, op5_mix, op6_language, op7_pack, op8_simhash, op9_ann, op10_secrets, op11_spelling, op12_urls, op13_periodic)}


def oracle_sql() -> dict[str, str]:
    return {"op10_secrets": secrets.oracle(), "op12_urls": urlfilter.oracle()}
