from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixing

from .helpers import documents, empty


def levels(sizes, repeat=3, weights=(1, 2, 3)):
    """Targets by sharing again and again, in exact arithmetic."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = Fraction(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > repeat * sizes[s]}
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        target |= {s: Fraction(repeat * sizes[s]) for s in full}
        left -= sum(repeat * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 3, "c": 1, None: 50}, {"a": 5}, {None: 7, "z": 0, "é": 1}, {f"s{i:03}": i * i % 97 for i in range(50)}, {"a": 0, "b": 0}]
)
def test_targets_equal_iterated_sharing(spark, sizes):
    t = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(t).collect()}
    want = levels(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - float(want[s])) < 1e-6 for s in want)


def test_plan_copies_and_mix_agree(spark):
    docs = documents(spark)
    plan = mixing.plan(docs).collect()
    assert len(plan) == docs.count()
    assert all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, mixed.collect()))


def test_taken_comes_near_target(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source")
    )
    p = docs.select("doc_id", "source").join(mixing.plan(docs), "doc_id")
    for r in p.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.01 * r.target


def test_few_documents_and_one_huge_one(spark):
    rows = [(s * 100 + i, "w " * (3000 if i == 0 else 40 + 7 * i % 50), f"s{s}") for s in range(12) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = docs.select("doc_id", "source").join(mixing.plan(docs), "doc_id").toPandas()
    # The huge one is drawn whole or not at all; the others come near the fraction by themselves.
    rest = p[p["size"] < 3000]
    for _, g in rest.groupby("source"):
        want = g["target"].iloc[0] * g["size"].sum() / g["source_size"].iloc[0]
        assert abs(g["taken"].sum() - want) < 0.06 * want
    assert (p["taken"] <= 3 * p["size"]).all()


def test_every_document_is_drawn_with_the_probability_of_the_fraction(spark):
    """Frequencies over 200 seeds: of the lone huge document, of those of a full stratum, and of copies."""
    rows = [(i, "w " * (700 if i == 0 else 20 + i % 3), "ab"[i % 2]) for i in range(24)] + [(30 + i, "same text", "b") for i in range(6)]
    docs = spark.createDataFrame([(seed * 100 + i, i, seed, t, f"{s}{seed:03}") for seed in range(200) for i, t, s in rows], "doc_id long, i long, seed long, text string, source string")
    # 400 sources of one mix; ids differ, so each source is drawn anew.
    p = docs.select("doc_id", "i").join(mixing.plan(docs), "doc_id")
    p = p.withColumn("rate", F.col("target") / F.col("source_size")).withColumn("part", F.col("rate") - F.floor("rate")).withColumn("drawn", F.col("copies") - F.floor("rate"))
    per = p.groupBy("i").agg(F.sum("drawn").alias("got"), F.sum("part").alias("want"), F.sum(F.col("part") * (1 - F.col("part"))).alias("var")).collect()
    assert len(per) == 30
    assert all(abs(r.got - r.want) <= 3.3 * r["var"] ** 0.5 + 1e-9 for r in per)
    total = sum(r.got for r in per), sum(r.want for r in per), sum(r["var"] for r in per) ** 0.5
    assert abs(total[0] - total[1]) <= 3 * total[2]


def test_a_fraction_of_zero_draws_nothing(spark):
    docs = spark.createDataFrame([(i, "a b c", "x") for i in range(50)], "doc_id long, text string, source string")
    assert {r.copies for r in mixing.plan(docs).collect()} == {1}


def test_empty_table(spark):
    assert mixing.plan(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
