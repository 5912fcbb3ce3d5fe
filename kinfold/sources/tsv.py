"""Tab-separated sources and sinks without quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = {"sep": "\t", "header": True, "quote": "", "escape": ""}


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; quotes and backslashes are text, bytes that aren't UTF-8 become U+FFFD, empty is null."""
    return spark.read.options(**_PLAIN).schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)


def entity_key(c: Column) -> tuple[Column, Column]:
    """(source, number) of an entity id: its second character, and all from the fourth on."""
    return F.substring(c, 2, 1).try_cast("int"), F.substring(c, 4, 1 << 20).try_cast("long")


def load_source(spark: SparkSession, path: str) -> DataFrame:
    """(id, src, name, addr, country) of one source file; missing text is empty."""
    d = scan(spark, path, ["entity_id", "business_name", "business_address", "country"])
    src, num = entity_key(F.col("entity_id"))
    return d.select(num.alias("id"), src.alias("src"), *[F.coalesce(c, F.lit("")).alias(n) for c, n in (("business_name", "name"), ("business_address", "addr"), ("country", "country"))])


def load_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All first-source ids, and the true pairs (s1, src, id) from comma-separated lists that may be empty."""
    d = scan(spark, path, ["source1_entity_id", "matched_entity_ids"])
    d = d.select(entity_key(F.col("source1_entity_id"))[1].alias("s1"), F.col("matched_entity_ids").alias("m"))
    one = d.select("s1", F.explode(F.split("m", ",")).alias("e")).select("s1", F.trim("e").alias("e")).where("e <> ''")
    src, num = entity_key(F.col("e"))
    return d.select("s1"), one.select("s1", src.alias("src"), num.alias("id"))


def sniff(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """Columns found by a part of their header: ``wanted`` maps the new name to the part to look for."""
    header = spark.read.options(**_PLAIN).csv(path)
    found = {new: next(c for c in header.columns if part in c.lower()) for new, part in wanted.items()}
    return header.select(*[F.col(f"`{c}`").alias(new) for new, c in found.items()])


def match_lists(all_s1: DataFrame, chosen: DataFrame, score: str, name: str = "matched_entity_ids") -> DataFrame:
    """One row per first-source record: its chosen ids, best first, without repeats, joined by commas; none: empty."""
    one = chosen.select("s1", F.struct((-F.col(score)).alias("o"), "src", "id").alias("x"))
    lists = one.groupBy("s1").agg(F.sort_array(F.collect_list("x")).alias("l"))
    ids = F.array_distinct(F.transform("l", lambda x: F.concat(F.lit("S"), x["src"], F.lit("_"), x["id"])))
    return all_s1.join(lists, "s1", "left").select(
        F.concat(F.lit("S1_"), F.col("s1")).alias("source1_entity_id"), F.coalesce(F.array_join(ids, ","), F.lit("")).alias(name)
    )


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_PLAIN, emptyValue="", nullValue="").csv(path)


def write_map(df: DataFrame, path: str) -> None:
    """A lookup table of two columns, or a chosen rule, as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _members(lists: DataFrame, column: str) -> DataFrame:
    one = lists.select("source1_entity_id", F.explode(F.split(column, ",")).alias("e"))
    return one.where("e <> ''")


def violations(lists: DataFrame, candidates: DataFrame, all_s1: DataFrame) -> DataFrame:
    """One row of counts, all zero for sound output: records without a row, rows that repeat or name no record, ill-formed or repeated ids,
    other-source ids in several lists, and matches that aren't candidates."""
    owner = lists.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n"))
    want = all_s1.select(F.concat(F.lit("S1_"), F.col("s1")).alias("source1_entity_id"), F.lit(True).alias("wanted"))
    rows = want.join(owner, "source1_entity_id", "full").agg(
        F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"), F.count(F.when(F.col("wanted").isNull(), 1)).alias("unknown")
    )
    m = _members(lists, "matched_entity_ids")
    c = _members(candidates, "candidate_entity_ids").distinct().withColumn("ok", F.lit(True))
    per = m.join(c, ["source1_entity_id", "e"], "left").groupBy("e").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source1_entity_id").alias("owners"), F.count(F.when(F.col("ok").isNull(), 1)).alias("outside")
    )
    ids = per.agg(
        F.count(F.when(~F.col("e").rlike("^S[23]_[0-9]+$"), 1)).alias("ill_formed"), F.coalesce(F.sum(F.col("n") - F.col("owners")), F.lit(0)).alias("twice_in_a_list"),
        F.count(F.when(F.col("owners") > 1, 1)).alias("shared"), F.coalesce(F.sum("outside"), F.lit(0)).alias("not_candidates"),
    )
    # One row each.
    return rows.crossJoin(ids)
