"""The corpus pipeline: each stage works on all that the one before it kept.

Quality rules drop what they reject; of near-duplicates one document stays; secrets are masked; sources are mixed to their
weights, in whole documents, of which one may then stand twice; the last stage turns texts into tokens.

Null and empty texts have no words and go in the first stage, as do texts of very few; very long ones are read whole by every stage. Of equal
rows one is left after the second. A null source or language is one of its own. An empty table passes through all stages as one. Stages but the last
return the columns of documents; further columns come through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import bpe, mixing, quality, secrets, simhash
from umbra.llm.common import documents, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedupe(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, whole_docs=True)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids; a document that stands twice in the mix has two rows."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("simhash", drop_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: Fingerprints, hypergeometric draws and merges aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
