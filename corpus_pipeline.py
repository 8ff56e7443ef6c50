"""A training-data pipeline over documents: quality, near duplicates, substrings, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; the last returns doc_id, source, lang, n_tokens and ids (packed little-endian 32-bit).
Nulls, empty texts, repeated rows and empty tables are handled as the operators' docstrings state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.bpe_codec import bpe_encode
from pulsegrid.llm.common import drop_table, read_table, write_table
from pulsegrid.llm.mixing import sample_mix
from pulsegrid.llm.near_dedup import keep_one
from pulsegrid.llm.quality import keep_good
from pulsegrid.llm.suffix_dedup import dedup_texts

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least id."""
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 and more that start earlier too are cut out of the texts, in whole characters; n_chars is as before."""
    return dedup_texts(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics have their target weights."""
    return sample_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as token ids."""
    coded = bpe_encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("encoding", encoding)]

#: A trained classifier, signatures and drawn samples have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again; what the next one has
    written replaces it."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, name)
            if before is not None:
                drop_table(before)
            before = docs
    return docs
