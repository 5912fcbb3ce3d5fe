"""Duplicate records within the other sources: found, checked, and scored together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import joined, simple_norm


def groups(rec: DataFrame, name: str = "name", addr: str = "addr") -> DataFrame:
    """(src, id, g) of records of the other sources whose country, name words and address words agree, in any order; two or more.

    The key is the text itself; sizes come from an aggregation, so a group that holds a third of the records is one row of it.
    """
    n, a = simple_norm(F.col(name)), simple_norm(F.col(addr))
    words = lambda c: joined(F.array_sort(F.split(c, " ")))
    k = rec.where((F.col("src") != 1) & (n != "") & (a != "")).select("src", "id", F.concat_ws("|", F.coalesce("cty", F.lit("")), words(n), words(a)).alias("g"))
    many = k.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").drop("c")
    return k.join(many, "g").select("src", "id", "g")


def pool(pairs: DataFrame, twins: DataFrame, score: str = "p", how: str = "max") -> DataFrame:
    """Scores of a group pooled for each first-source record; the whole group goes to the best one.  Others keep their scores."""
    x = pairs.select("s1", "src", "id", F.col(score).alias("p")).join(twins, ["src", "id"], "left")
    solo = x.where("g is null").select("s1", "src", "id", "p")
    p = F.greatest(F.least(F.col("p"), F.lit(0.999999)), F.lit(0.0))
    agg = F.max("p") if how == "max" else 1 - F.exp(F.sum(F.ln(1 - p)))
    best = x.where("g is not null").groupBy("g", "s1").agg(F.round(agg, 9).alias("gp"))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("gp"), "s1"))).where("_r = 1")
    return solo.unionByName(best.join(twins, "g").select("s1", "src", "id", F.col("gp").alias("p")))


def owners(rec: DataFrame, truth: DataFrame, keys: dict[str, tuple]) -> DataFrame:
    """Whether duplicates have one owner, for several definitions of a duplicate: ``keys`` maps a title to (key, filter)."""
    o = rec.where("src <> 1").select("*", simple_norm(F.col("name")).alias("n"), simple_norm(F.col("addr")).alias("a")).join(truth, ["src", "id"], "left")
    out = None
    for title, (key, where) in keys.items():
        g = o.where(where).groupBy("cty", key.alias("k")).agg(
            F.count(F.lit(1)).alias("sz"), F.count(F.when(F.col("s1").isNull(), 1)).alias("norph"), F.countDistinct("s1").alias("nown"), F.countDistinct("src").alias("nsrc")
        ).where("sz >= 2")
        same = (F.col("nown") == 1) & (F.col("norph") == 0)
        t = g.groupBy("cty").agg(
            F.count(F.lit(1)).alias("groups"), F.sum("sz").alias("n_rows"), F.avg((F.col("nsrc") == 2).cast("double")).alias("cross_src"),
            F.avg(same.cast("double")).alias("all_same_owner"), F.avg(((F.col("nown") >= 1) & (F.col("norph") > 0)).cast("double")).alias("owner_orphan_mix"),
            F.avg((F.col("nown") == 0).cast("double")).alias("all_orphan"), F.avg((F.col("nown") > 1).cast("double")).alias("diff_owners"),
            F.try_divide(F.count(F.when(same, 1)), F.count(F.when(F.col("nown") >= 1, 1))).alias("rule_precision"),
        ).withColumn("title", F.lit(title))
        out = t if out is None else out.unionByName(t)
    return out
