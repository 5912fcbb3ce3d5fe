"""From raw documents to token ids: quality rules, language ID, SimHash near-dedup, source mixing, byte-level BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, and the next stage
gets it as written to Parquet and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import byte_pieces, ecoc, mixing, quality, simhash
from kinfold.llm.common import cut, remove, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go.

    A null or empty text has no words and goes; whole texts are measured whatever their length; rows are judged one by one, so repeated rows and
    ids alike, null ids too; an empty table stays one; all columns are kept, whatever they are called.
    """
    return quality.apply(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or that tie exactly between two, go.  The classifiers learn from this stage's own labelled input.

    A null text, or one without a letter, goes, and so does everything where no row has a language to learn from; rows with a null id or language are
    judged but not learned from; very long texts are read in blocks; repeated rows are judged alike; an empty table stays one; all columns are kept.
    """
    return ecoc.keep_known(docs, ecoc.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Null and empty texts are one group; a null id stays only in a group of null ids; of rows that repeat id and text one stays; very long texts are hashed
    in blocks; an empty table stays one; all columns are kept.
    """
    return simhash.dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that sources come near their target weights.

    A null source is one of its own; documents without words are drawn like others and take nothing; a very long text is drawn whole or not at
    all; rows that repeat id and text draw alike; an empty table stays one; all columns are kept.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests.

    A null text is empty and has no ids; whole texts are encoded whatever their length; every row, repeated or not, has its row; an empty table gives
    no rows; only ids and texts are read.
    """
    return byte_pieces.encode(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", encode),
]
#: Language ID can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs, path = cut(stage(spark, docs, sf_dir), name)
            keep.add(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
