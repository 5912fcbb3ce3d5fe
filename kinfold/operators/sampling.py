"""Samples and folds that depend on ids alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N_FOLDS = 5
HOLDOUT_PCT = 15


def in_sample(id_col: Column, frac: float) -> Column:
    return id_col % 10_000 < round(frac * 10_000)


def in_queries(id_col: Column, frac: float) -> Column:
    """Another share of ids than ``in_sample`` takes."""
    return F.lit(True) if frac >= 1 else F.expr("true") & (F.floor(id_col / 10_000) % 10_000 < round(frac * 10_000))


def sample_groups(records: DataFrame, pairs: DataFrame, frac: float) -> DataFrame:
    """Sampled first-source records, all their matches, and the same share of the records that match nothing."""
    first, other = records.where("src = 1"), records.where("src <> 1")
    kept = first.where(in_sample(F.col("id"), frac))
    mates = other.join(pairs.join(kept.select(F.col("id").alias("s1")), "s1", "left_semi"), ["src", "id"], "left_semi")
    decoys = other.join(pairs, ["src", "id"], "left_anti").where(in_sample(F.col("id"), frac))
    return kept.unionByName(mates).unionByName(decoys)


def fold(s1: Column) -> Column:
    """-1 for the locked holdout, else the cross-validation fold; a multiplicative hash in exact decimal arithmetic."""
    b = fold_bucket(s1)
    return F.when(b < HOLDOUT_PCT * 10, F.lit(-1)).otherwise(b % N_FOLDS).cast("int")


def fold_bucket(s1: Column) -> Column:
    wide = s1.cast("decimal(18,0)") * F.lit("11400714819323198485").cast("decimal(20,0)")
    low = F.pmod(wide, F.lit("18446744073709551616").cast("decimal(20,0)"))
    return (F.floor(low / F.lit("4294967296").cast("decimal(10,0)")).cast("decimal(20,0)") % 1000).cast("int")


def seeded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows that only their keys decide, by a digest that other engines share."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit("sample"), *[F.col(k).cast("string") for k in keys]).cast("binary")), *keys).limit(n)


def shuffled_partners(pairs: DataFrame, group: str) -> DataFrame:
    """A random partner of the same group for each pair: both sides are numbered in hash order and joined by number."""
    a = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit("a"), "s1", "src", "id")))
    b = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit("b"), "s1", "src", "id")))
    left = pairs.select(group, "s1", F.row_number().over(a).alias("n"))
    right = pairs.select(group, "src", "id", F.row_number().over(b).alias("n"))
    return left.join(right, [group, "n"]).select(group, "s1", "src", "id")
