"""Lookup tables that are counted from data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATORS = r"[\s,.\-()\[\]/&]+"
FOREIGN = r"[^\x00-\x7F]"


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SEPARATORS), lambda t: t != "")


def word_map(pairs: DataFrame, native: str, latin: str, min_count: int = 5, min_purity: float = 0.6, source: Column | None = None) -> DataFrame:
    """(x, y, n, purity): words at the same place of two names with as many words, kept if they agree often enough.

    ``source`` says which words to translate; by default those outside ASCII, to ones inside, of names inside ASCII.
    """
    d = pairs.where((F.col(native) != "") & (F.col(latin) != ""))
    if source is None:
        d = d.where(~F.col(latin).rlike(FOREIGN))
    d = d.select(name_tokens(F.col(native)).alias("a"), name_tokens(F.col(latin)).alias("b")).where(F.size("a") == F.size("b"))
    co = d.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select(F.col("z.a").alias("x"), F.col("z.b").alias("y"))
    co = co.where(source if source is not None else F.col("x").rlike(FOREIGN) & ~F.col("y").rlike(FOREIGN)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    # Totals and the best partner by aggregation: a word with millions of partners is no window in one task.
    per = co.groupBy("x").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("o"), "y")).alias("best"))
    per = per.select("x", F.col("best.y").alias("y"), (-F.col("best.o")).alias("n"), (-F.col("best.o") / F.col("total")).alias("purity"))
    return per.where((F.col("n") >= min_count) & (F.col("purity") >= min_purity))


def apply_word_map(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Foreign names that hold a word of the map, rewritten word by word; each distinct name once."""
    names = df.where(F.col(column).rlike(FOREIGN)).select(F.col(column).alias("_from")).distinct()
    one = names.select("_from", F.posexplode(name_tokens(F.col("_from"))).alias("at", "x")).join(words.select("x", "y"), "x", "left")
    new = one.groupBy("_from").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("y", "x").alias("w")))).alias("l"), F.count("y").alias("hits"))
    new = new.where("hits > 0").select("_from", F.array_join(F.transform("l", lambda s: s["w"]), " ").alias("_to"))
    return df.join(new, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def city_map(addresses: DataFrame, column: str, min_count: int = 20, min_purity: float = 0.95, min_state: int = 1000, plain: Callable[[Column], Column] | None = None) -> DataFrame:
    """(city, state): the last two comma parts of addresses, where a city almost always has the same state."""
    parts = F.transform(F.split(column, ","), lambda s: F.trim(s))
    p = addresses.select(parts.alias("p")).where(F.size("p") >= 2).select(F.lower(F.try_element_at("p", F.lit(-2))).alias("city"), F.try_element_at("p", F.lit(-1)).alias("state"))
    good = p.groupBy("state").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_state).select("state")
    p = p.join(good, "state", "left_semi").where((F.length("city") >= 3) & ~F.col("city").rlike("[0-9]"))
    c = p.groupBy("city", "state").agg(F.count(F.lit(1)).alias("n"))
    c = c.join(c.groupBy("city").agg(F.sum("n").alias("total")), "city").where((F.col("n") / F.col("total") >= min_purity) & (F.col("total") >= min_count))
    c = c.select("city", "state")
    if plain is None:
        return c
    other = c.select(plain(F.col("city")).alias("city"), "state").join(c.select("city"), "city", "left_anti").groupBy("city").agg(F.min("state").alias("state"))
    return c.unionByName(other)


def apply_city_map(df: DataFrame, column: str, cities: DataFrame, *keys: str) -> DataFrame:
    """The state of the first comma part that is a known city goes to the end of the address."""
    one = df.select(*keys, F.posexplode(F.split(column, ",")).alias("at", "part")).select(*keys, "at", F.lower(F.trim("part")).alias("city")).join(cities, "city")
    first = one.groupBy(*keys).agg(F.min(F.struct("at", "state")).alias("f")).select(*keys, F.col("f.state").alias("_st"))
    return df.join(first, list(keys), "left").withColumn(column, F.when(F.col("_st").isNotNull(), F.concat_ws(", ", column, "_st")).otherwise(F.col(column))).drop("_st")
