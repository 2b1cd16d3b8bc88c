"""A training corpus from raw documents, in five stages.

Each stage gets what the one before wrote, and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from echotable.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from echotable.llm.base import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go. A null or empty text has nothing to reject and stays, as do null ids; rows that repeat are judged alike; an empty table stays empty."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go; documents stay, with an empty text if all lines go.

    Earlier means by id, then by place; of rows that repeat an id one comes first by its text. A null text stays null, blank lines stay, rows with a null id lose nothing; an empty table stays empty.
    """
    return line_dedup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays.

    Texts without words, null ones among them, are like none and stay; of rows of one id and text one stays; rows with a null id stay. An empty table stays empty.
    """
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null or empty texts and null ids hold none and stay; rows that repeat are judged alike; without items, or without documents, nothing changes."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 1024 tokens. A null or empty text is the end token alone; rows that repeat and null ids are packed like any others; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL expresses neither a learned grammar nor tokenizers; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = stored(docs)
    return docs
