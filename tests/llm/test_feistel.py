import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from kinfold.llm import feistel

from .helpers import documents, empty


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 17, 100, 1009])
def test_permutation_and_inverse(spark, n):
    rows = spark.range(n).select(F.col("id").alias("row"), F.lit(n).cast("long").alias("n"))
    placed = feistel.place_of_row(rows, "row", "n", 7)
    assert sorted(r.place for r in placed.collect()) == list(range(n))
    back = feistel.row_of_place(placed, "place", "n", 7, "again")
    assert all(r.again == r["row"] for r in back.collect())


def test_rows_law_and_sizes(spark):
    docs = documents(spark)
    got = feistel.shard(docs, shards=8).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sorted(r.global_row for r in got) == list(range(len(got)))


def test_result_does_not_depend_on_partitions(spark):
    docs = documents(spark)
    one = Counter(map(tuple, feistel.shard(docs.repartition(1)).collect()))
    assert one == Counter(map(tuple, feistel.shard(docs.repartition(7, "text")).collect()))


def test_large_group_of_equal_rows(spark):
    docs = spark.range(150_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    x = feistel.shard(docs).agg(F.countDistinct("global_row"), F.max("global_row")).first()
    assert tuple(x) == (150_000, 149_999)


def test_empty_table(spark):
    assert feistel.shard(empty(spark)).count() == 0


def brute_place(row, n, key):
    """The permutation from its definition, with plain integers."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    b = -(-n // a)

    def round_key(half, r, modulus):
        h = xxhash.xxh64_intdigest(struct.pack("<q", half), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", r), h)
        return signed(xxhash.xxh64_intdigest(struct.pack("<q", key), h)) % modulus

    while True:
        low, high = row % a, row // a
        for r in range(feistel.ROUNDS):
            if r % 2 == 0:
                low = (low + round_key(high, r, a)) % a
            else:
                high = (high + round_key(low, r, b)) % b
        row = low + high * a
        if row < n:
            return row


def test_shards_and_slots_equal_the_definition(spark):
    docs = documents(spark, [*(f"text {i}" for i in range(300)), None, "", "Größe 你好"])
    rows = feistel.shard(docs, shards=8, key=77).collect()
    n = len(rows)
    assert sorted(r.global_row for r in rows) == list(range(n))
    for r in rows:
        place = brute_place(r.global_row, n, 77)
        assert (r.shard, r.slot) == (place % 8, place // 8)
    sizes = {(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == sizes
