"""A corpus pipeline: language, exact copies, near copies, personal data, packing. Each stage reads all that its predecessor kept.

Defined cases: null texts and texts without a letter go in the first stage; rows whose id is null or repeated are documents like others in every stage; of rows
that repeat one, one stays; very long texts are read whole; an empty table gives an empty result; other columns stay until the last stage, whatever their names.
The key of pseudonyms is the session's ``framewise.pii.key``; without it, one for synthetic tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framewise.llm import exact_dedup, langid, near_dedup, packing, pii
from framewise.llm.common import saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter in them) go; a missing label becomes the predicted one."""
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share four fifths of their five-word shingles, directly or in a chain, the row with the smallest id stays."""
    return near_dedup.keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by pseudonyms in the text."""
    return pii.pseudonymise(docs, spark.conf.get("framewise.pii.key", "synthetic tables"), count_col=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("pii", personal_data), ("packing", pack)]

#: No SQL expresses the network, the shingle sets or the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
