"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights, and the rate of a source is its target
over its size.  Each document is emitted floor(rate) times, and once more by a Bernoulli draw: a number in [0, 1) made from a
hash of the seed, its id and its text.  Nothing depends on partitions or task order.

The probability of the draw is the fraction of the rate, for every document.  So that the drawn words come near their target,
the draws are stratified by size: documents of a source whose sizes begin with the same three binary digits and have as many of them
are a stratum, and a document is drawn if its number is below the stratum's own quantile of that fraction, interpolated within one of
``BINS`` bins.  The expected number of drawn documents of a stratum, given its bins, is the fraction of its
documents exactly, and no document of a stratum is told from another, so each is drawn with the probability of the fraction; what
differs from independent draws is only that a stratum as a whole can't draw far too many or too few.  A stratum of one document is a plain draw.
The bounds come from counts over (source, stratum, bin), whatever the number of documents.

Targets: every source gets its weight's share of the total; one that would exceed ``max_repeat`` times its own
size is held there, and the excess is shared again by weight among the others until none is above.  That is the
level L with sum(min(max_repeat * size, weight * L)) = total, found by sorting the sources by the
level at which they are full; it takes one row per source.

Defined results: a null source is a source of its own, last in order; a null text has size 0; a source without words has
target 0 and rate 0; rows with the same id and text draw alike; an empty table gives an empty result; further columns of the
input are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, n_words_of, remove, scratch, settled, text_of

SEED = "mix-1"
MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)
#: Bins of a stratum's draws.
BINS = 512


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes``: source, source_size, one row per source.  Adds weight and target.

    Sources are ordered by code point, null last, and weigh ``weights``, repeating.
    """
    n = len(weights)
    cycle = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(n)) + 1)
    s = sizes.select("source", "source_size", cycle.alias("weight"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full_at = F.col("source_size") * max_repeat / F.col("weight")
    before = Window.orderBy(full_at, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, w_total = F.sum("source_size").over(every), F.sum("weight").over(every)
    s = s.withColumn(
        "level",
        (total - F.coalesce(F.sum(F.col("source_size") * max_repeat).over(before), F.lit(0)))
        / (w_total - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    s = s.withColumn("held", full_at < F.col("level"))
    # The level that holds in the end is that of the first source that isn't full.
    s = s.withColumn("final", F.min(F.when(~F.col("held"), F.struct(full_at, F.col("source").isNull(), F.coalesce("source", F.lit("")), "level"))).over(every)["level"])
    return s.select(
        "source", "source_size", "weight",
        F.when(F.col("held"), (F.col("source_size") * max_repeat).cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target"),
    )


def _draw(id_col: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a digest that SQL engines share."""
    word = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _stratum(size: Column) -> Column:
    """Number and first three of the binary digits of a size, so sizes of a stratum differ by less than a quarter."""
    return F.concat_ws(":", F.length(F.bin(size)).cast("string"), F.substring(F.bin(size), 1, 3))


def _narrow(docs: DataFrame, id_col: str, text: str, source: str, seed: str) -> tuple[DataFrame, str]:
    """Id, source, size, stratum and draw of each document, written: the texts are read once for all that follows."""
    t = text_of(f"`{text}`")
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), n_words_of(t).alias("size"), _draw(F.col(f"`{id_col}`"), t, seed).alias("u"))
    return cut(d.withColumn("stratum", _stratum(F.col("size"))), "draws")


def rates(narrow: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source and stratum: _kf_source, _kf_stratum, source_size, target, whole (copies of every document), part (the fraction) and bound (of the draw).

    Written, so the planner knows its size and broadcasts it only below the session's threshold.
    """
    bins = narrow.groupBy("source", "stratum", F.floor(F.col("u") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    rows = narrow.count()
    bins, path = cut(bins, "bins", rows)
    t = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), max_repeat)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = t.select(F.col("source").alias("_kf_source"), "source_size", "target", F.floor(rate).cast("long").alias("whole"), (rate - F.floor(rate)).alias("part"))
    t, sources = cut(t, "sources", rows)
    own = Window.partitionBy("source", "stratum")
    b = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(own))
    b = b.join(t, b["source"].eqNullSafe(t["_kf_source"])).withColumn("need", F.col("part") * F.col("all"))
    # The bin that reaches what is needed, and the share of it that is; a fraction of 0 needs none.
    at = F.when((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")), (F.col("bin") + (F.col("need") - (F.col("upto") - F.col("n"))) / F.col("n")) / F.lit(float(BINS)))
    keys = ("_kf_source", "source_size", "target", "whole", "part")
    out = b.withColumn("at", at).groupBy(*keys, F.col("stratum").alias("_kf_stratum")).agg(F.coalesce(F.min("at"), F.lit(0.0)).alias("bound"))
    out, _ = cut(out, "rates", rows)
    remove(narrow.sparkSession, path, sources)
    return out


def _copies(u: Column, whole: Column, bound: Column) -> Column:
    return whole + (u < bound).cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Id, size, source_size, target, copies and taken for each document."""
    with scratch(docs.sparkSession) as keep:
        d, _ = _narrow(docs, id_col, text, source, seed)
        t = rates(d, max_repeat)
        p = d.join(t, d["source"].eqNullSafe(t["_kf_source"]) & (d["stratum"] == t["_kf_stratum"]))
        copies = _copies(F.col("u"), F.col("whole"), F.col("bound"))
        return settled(p.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")), "mix", keep, d.count())


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed documents themselves: all columns of the input, each row as often as its rate and draw say."""
    names = ("_kf_source", "_kf_stratum", "whole", "bound")
    key, skey, whole, bound, stratum, u, n, copy = fresh(docs, *names, "stratum", "u", "n", "copy")
    narrow, path = _narrow(docs, id_col, text, source, seed)
    t = rates(narrow, max_repeat).select(*[F.col(a).alias(b) for a, b in zip(names, (key, skey, whole, bound), strict=True)])
    remove(docs.sparkSession, path)
    t_ = text_of(f"`{text}`")
    # What reads the text comes before the join, once for each row; an empty array drops the rows that aren't taken.
    d = docs.withColumns({stratum: _stratum(n_words_of(t_)), u: _draw(F.col(f"`{id_col}`"), t_, seed)})
    d = d.join(t, F.col(f"`{source}`").cast("string").eqNullSafe(F.col(key)) & (F.col(stratum) == F.col(skey)))
    d = d.withColumn(n, _copies(*[F.col(c) for c in (u, whole, bound)]).cast("int"))
    return d.withColumn(copy, F.explode(F.array_repeat(F.lit(True), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
