"""The queries of the text operators by name, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from umbra.llm import bpe, chat, divergence, imatch, langid, license_scan, mixing, pii, quality, runs, secrets, simhash, toxicity
from umbra.llm.common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license": lambda spark, d: license_scan.query(documents(spark, d)),
        "op2_bpe": lambda spark, d: bpe.query(documents(spark, d), public_tokenizers.path("word_bpe_49k.json")),
        "op3_simhash": lambda spark, d: simhash.query(documents(spark, d)),
        "op4_imatch": lambda spark, d: imatch.query(documents(spark, d)),
        "op5_pii": lambda spark, d: pii.query(documents(spark, d)),
        "op6_chat": lambda spark, d: chat.query(spark.read.parquet(f"{d}/conversations.parquet")),
        "op7_mixing": lambda spark, d: mixing.query(documents(spark, d)),
        "op8_secrets": lambda spark, d: secrets.query(documents(spark, d)),
        "op9_quality": lambda spark, d: quality.query(documents(spark, d)),
        "op10_langid": lambda spark, d: langid.query(documents(spark, d)),
        "op11_divergence": lambda spark, d: divergence.query(documents(spark, d)),
        "op12_toxicity": lambda spark, d: toxicity.query(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op13_runs": lambda spark, d: runs.query(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": chat.ORACLE_SQL, "op11_divergence": divergence.ORACLE_SQL}
