"""The contract queries ``opN_<name>``: thin digests of the operators' own results, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pieces, ecoc, feistel, licenses, mixing, quality, rp_forest, simhash, token_cache, warc
from .common import scratch, scratch_path, settled, table
from .sql import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``: who links with whom by cosine >= 0.95.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing; equal vectors are
    copies and all link; a pair at 0.95 links; an empty table gives no rows; ``label`` and further columns aren't read.
    """
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 7 by the law ``rows``.

    A null text has size 1 and checksum 0; equal rows get different slots and are interchangeable; a very long text is only sized and hashed;
    an empty table gives no rows; further columns aren't read.
    """
    return feistel.shard(table(spark, sf_dir, "documents"), shards=8)


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: fingerprint and group at 2 or fewer differing bits.

    Null, empty and wordless texts have fingerprint 0 and are one group; a bit set in exactly half of the hashes is 0; a very long text is hashed
    in blocks; repeated rows share a group; an empty table gives no rows; further columns aren't read.
    """
    x = simhash.groups(table(spark, sf_dir, "documents"))
    return x.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: bytes and tokens, from an empty digest cache.

    A null text is empty and has no tokens; equal texts are encoded once; whole texts whatever their length; an empty table gives no rows;
    further columns aren't read.
    """
    return token_cache.count_tokens(table(spark, sf_dir, "documents"))


def op5_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: encoded, and decoded again.

    A null text is empty: no ids, digests of nothing; whole texts whatever their length; every row has its row; an empty table gives no rows;
    further columns aren't read.
    """
    return byte_pieces.encode(table(spark, sf_dir, "documents"))


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``, written as an archive and read back; the archive is removed once read.

    A null payload is empty; a null id is never referred to; rows that share the largest id of their payload are all responses; an empty table
    gives no rows; further columns aren't read.
    """
    with scratch(spark) as keep:
        out = scratch_path(spark, "warc")
        warc.write_archives(table(spark, sf_dir, "pages"), out)
        x = warc.read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        return settled(x, "records", keep)


def op7_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: the language of each text, learned from the others' ``lang``.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned; exact ties go to the first name and are flagged; very long
    texts are read in blocks; an empty table gives no rows; further columns aren't read.
    """
    docs = table(spark, sf_dir, "documents")
    x = ecoc.predict(docs, ecoc.fit(docs))
    return x.select("doc_id", ecoc.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: places of the base phrases, and labels.

    A null text has no words and empty labels; whole texts whatever their length; labels that tie are all given; every row has its row; an
    empty table gives no rows; further columns aren't read.
    """
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: words that the mix takes of each.

    A null source is one of its own, last; a null text has size 0; rows that repeat id and text draw alike; an empty table gives no rows;
    further columns aren't read.
    """
    return mixing.plan(table(spark, sf_dir, "documents"))


def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: measurements and verdicts.

    A null text has no words and fails; whole texts whatever their length; rows are judged one by one, so repeated ones alike; an empty table gives
    no rows; further columns aren't read.
    """
    x = quality.ledger(table(spark, sf_dir, "documents"))
    return x.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejected_by(F.col("fail_bits"), "base").alias("base_failed"),
        (~quality.rejected_by(F.col("fail_bits"))).alias("kept"),
        "fail_bits",
    )


QUERIES: dict[str, Query] = {
    "op1_projection_forest": op1_projection_forest,
    "op2_feistel_shards": op2_feistel_shards,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_token_counts": op4_token_counts,
    "op5_byte_pieces": op5_byte_pieces,
    "op6_warc_archives": op6_warc_archives,
    "op7_language_codes": op7_language_codes,
    "op8_license_diagonals": op8_license_diagonals,
    "op9_weighted_mix": op9_weighted_mix,
    "op10_quality_ledger": op10_quality_ledger,
}