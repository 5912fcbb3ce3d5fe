"""Sharding through a Feistel permutation of global row numbers.

Rows get global numbers 0..N-1.  A keyed Feistel permutation gives each number its place in a
reproducible shuffle; place p belongs to shard ``p mod shards`` at slot ``p div shards``.  Shard
sizes differ by one row at most and slots have no gaps.  All of it can be computed from a row number
alone, and inverted (``place_of_row``, ``row_of_place``).

The network works on pairs (l, r) with l < a and r < b, where a = ceil(sqrt(N)) and b = ceil(N / a), so its domain
exceeds N by less than a.  A place outside 0..N-1 is permuted again until it lies inside (cycle walking);
no walk is longer than a*b - N + 1 steps, so the loop for the few rows that need one always ends.

Row numbers don't come from a global sort.  Equal rows are counted first, the distinct ones are dealt
to buckets by a hash of all that tells them apart, numbered within their bucket, and shifted by the
totals of earlier buckets.  There is a bucket for every ``BUCKET_ROWS`` rows, so no task sorts more than a few times that, and the table of
totals has a row per bucket (at 10^11 rows 400,000, some 10 MB).  A row that fills a third of the table is one group.

Defined results: a null id or text is a value like any other, and a null text has size 1 and checksum 0; equal rows (same
id and text) get different slots and are interchangeable; a very long text counts by its size and checksum alone; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, scratch, settled

#: Rows for each of which there is a bucket.
BUCKET_ROWS = 1 << 18
LEAST_BUCKETS = 64
ROUNDS = 6
#: Rows that one array holds while equal rows are spread out again.
CHUNK = 65_536


def _key(half: Column, r: int, key: int, modulus: Column) -> Column:
    return F.pmod(F.xxhash64(half, F.lit(r), F.lit(key).cast("long")), modulus)


def _columns(df: DataFrame, x: Column, a: Column, b: Column, key: int, out: str, inverse: bool = False) -> DataFrame:
    """``out``: the permutation of x, one generated-code projection for each round."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    lo, hi = fresh(df, "l", "r")
    df = df.select(*keep, F.pmod(x, a).alias(lo), F.floor(x / a).cast("long").alias(hi))
    sign = -1 if inverse else 1
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        if r % 2 == 0:
            df = df.withColumn(lo, F.pmod(F.col(lo) + sign * _key(F.col(hi), r, key, a), a))
        else:
            df = df.withColumn(hi, F.pmod(F.col(hi) + sign * _key(F.col(lo), r, key, b), b))
    return df.select(*keep, (F.col(lo) + F.col(hi) * a).alias(out))


def _once(x: Column, a: Column, b: Column, key: int, inverse: bool = False) -> Column:
    """The same permutation as one expression, for use inside a loop."""
    step = lambda h, r: F.when(
        r % 2 == 0, F.array(F.pmod(h[0] + sign * F.pmod(F.xxhash64(h[1], r, F.lit(key).cast("long")), a), a), h[1])
    ).otherwise(F.array(h[0], F.pmod(h[1] + sign * F.pmod(F.xxhash64(h[0], r, F.lit(key).cast("long")), b), b)))
    sign = -1 if inverse else 1
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.array(F.pmod(x, a), F.floor(x / a).cast("long")), step, lambda h: h[0] + h[1] * a)


def _walked(df: DataFrame, x: str, n: str, key: int, out: str, inverse: bool = False) -> DataFrame:
    """``out``: the permutation of 0..n-1 at x; n is a column (the same in all rows)."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    a, b, y = fresh(df, "a", "b", "y")
    df = df.select(*keep, F.ceil(F.sqrt(F.col(n).cast("double"))).cast("long").alias(a))
    df = df.withColumn(b, F.ceil(F.col(n) / F.col(a)).cast("long"))
    df = _columns(df, F.col(x), F.col(a), F.col(b), key, y, inverse)
    extra = F.col(a) * F.col(b) - F.col(n)
    walk = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(extra, F.lit(1))),
        F.col(y),
        lambda v, _: F.when(v < F.col(n), v).otherwise(_once(v, F.col(a), F.col(b), key, inverse)),
    )
    return df.select(*keep, F.when(F.col(y) < F.col(n), F.col(y)).otherwise(walk).alias(out))


def place_of_row(df: DataFrame, row: str, n: str, key: int, out: str = "place") -> DataFrame:
    """The place in the shuffle of each global row number."""
    return _walked(df, row, n, key, out)


def row_of_place(df: DataFrame, place: str, n: str, key: int, out: str = "row") -> DataFrame:
    """The global row number at each place of the shuffle."""
    return _walked(df, place, n, key, out, inverse=True)


def numbered(df: DataFrame, columns: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``columns`` of every row with ``row`` (0..N-1, gapless) and ``n_total`` (N).

    The number depends on the values and N alone, not on files, partitions or task order.
    """
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_kf_n"))
    groups, _ = cut(groups.withColumn("_kf_h", F.xxhash64(*columns)), "numbered")
    rows = groups.agg(F.sum("_kf_n")).first()[0] or 0
    groups = groups.withColumn("_kf_b", F.pmod("_kf_h", F.lit(max(LEAST_BUCKETS, -(-rows // bucket_rows)))))
    totals = groups.groupBy("_kf_b").agg(F.sum("_kf_n").alias("t"))
    before = Window.orderBy("_kf_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A row per bucket: safe in one task, and to broadcast.
    totals = totals.select("_kf_b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_kf_off"), F.sum("t").over(everything).alias("n_total"))
    own = Window.partitionBy("_kf_b").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    g = groups.withColumn("_kf_at", F.coalesce(F.sum("_kf_n").over(own), F.lit(0))).join(F.broadcast(totals), "_kf_b")
    g = g.withColumn("_kf_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_kf_n") - 1) / CHUNK).cast("long"))))
    g = g.withColumn(
        "_kf_i", F.explode(F.sequence(F.col("_kf_c") * CHUNK, F.least(F.col("_kf_n"), (F.col("_kf_c") + 1) * CHUNK) - 1))
    )
    return g.select(*columns, (F.col("_kf_off") + F.col("_kf_at") + F.col("_kf_i")).alias("row"), "n_total")


def shard(docs: DataFrame, shards: int = 8, key: int = 20260101, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, size, checksum, global row, shard and slot.

    The law that holds is ``rows``: shard counts differ by one at most.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(f"`{text}`")).alias("th"),
    )
    with scratch(docs.sparkSession) as keep:
        p = place_of_row(numbered(d, ["id", "size", "text_crc32", "th"]), "row", "n_total", key)
        p = p.select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
            F.floor(F.col("place") / shards).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("row").alias("global_row"),
        )
        return settled(p, "sharded", keep)
