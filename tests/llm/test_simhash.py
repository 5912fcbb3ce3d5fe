import itertools
import random
import re

import xxhash
from pyspark.sql import functions as F

from kinfold.llm import common, components, simhash

from .helpers import documents, empty


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_equal_brute_force(spark):
    docs = documents(spark)
    got = sorted((str(r.id), r.fp & (1 << 64) - 1) for r in simhash.groups(docs).collect())
    assert got == sorted((str(r.doc_id), brute_fingerprint(r.text)) for r in docs.collect())


def test_links_equal_all_pairs(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1, 1, 3, 7, 1 << 63}
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for k in (1, 2, 3, 4):
            g = f
            for b in rng.sample(range(64), k):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for segments in (1, 2, 3, 4):
        assert {tuple(r) for r in simhash.links(df, 2, segments).collect()} == want


def test_groups_and_dedup(spark):
    docs = documents(spark, null_ids=True)
    rows = simhash.groups(docs).collect()
    fp = {}
    for r in rows:
        if r.id is not None:
            fp.setdefault(r.id, r.fp & (1 << 64) - 1)
    edges = [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2]
    want = groups_of(fp, edges)
    assert all(r.component_id == want[r.id] for r in rows if r.id is not None)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(set(want.values()))


def test_group_of_null_ids_keeps_one(spark):
    docs = spark.createDataFrame([(None, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (3, "other words here now")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.dedup(docs).collect()) == ["3", "None"]


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 70)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    rng.shuffle(edges)
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").union(spark.createDataFrame([(None, 1)], "a long, b long")))
    assert {r.id: r.component for r in got.collect()} == groups_of(nodes, [e for e in edges if e[0] != e[1]])
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_group_of_copies_makes_no_pairs(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the same text for all of them").alias("text"))
    x = simhash.groups(docs).agg(F.countDistinct("component_id"), F.max("component_id")).first()
    assert tuple(x) == (1, 0)


def test_rounds_of_components_are_told_apart_beyond_2_to_24_edges(spark):
    e = spark.range((1 << 24) + 5).select(F.col("id").alias("u"), F.lit(-1).cast("long").alias("v"))
    n, digest = components.state_of(e)
    assert n == (1 << 24) + 5 and digest != 0
    assert components.state_of(e.where("u <> 7")) != (n, digest)
    assert components.state_of(e.repartition(3)) == (n, digest)


def test_components_of_a_large_star_and_a_long_chain(spark):
    star = spark.range(1, 2_000_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = components.connected_components(star).agg(F.count("id"), F.countDistinct("component"), F.max("component")).first()
    assert tuple(got) == (2_000_000, 1, 0)
    chain = spark.range(3_000).select((F.col("id") * 7919 % 3001).alias("a"), ((F.col("id") + 1) * 7919 % 3001).alias("b"))
    got = components.connected_components(chain).agg(F.count("id"), F.countDistinct("component"), F.max("component")).first()
    assert tuple(got) == (3_001, 1, 0)


def test_few_edges_are_joined_up_by_one_task(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(350)] + [((i * 7919 + 3) % 1001 + 10_000, ((i + 1) * 7919 + 3) % 1001 + 10_000) for i in range(900)]
    table = spark.createDataFrame([*edges, (None, 5), (6, None), *edges[:20]], "a long, b long").repartition(7)
    want = groups_of({n for a, b in edges if a != b for n in (a, b)}, [e for e in edges if e[0] != e[1]])
    monkeypatch.setattr(components, "FEW", 0, raising=False)
    by_rounds = components.connected_components(table)
    assert sorted(map(tuple, by_rounds.collect())) == sorted(want.items())
    monkeypatch.undo()
    monkeypatch.setattr(components, "_star", None)
    at_once = components.connected_components(table)
    assert sorted(map(tuple, at_once.collect())) == sorted(want.items()) and at_once.schema == by_rounds.schema


def test_a_statement_of_the_rounds_has_the_joins_of_one_step(spark, monkeypatch):
    joins, real = [], components.cut

    def counted(df, *a):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return real(df, *a)

    monkeypatch.setattr(components, "cut", counted)
    monkeypatch.setattr(components, "FEW", 0, raising=False)
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.connected_components(chain).count() == 41
    assert 0 < max(joins) <= 4, joins


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("m"))
    got = common.join_spread(rows, per, "k", "n", 5_000)
    assert got.columns == ["k", "x", "m"]
    want = rows.join(per.drop("n"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    few = common.join_spread(rows, per.where("m < 100"), "k", "n", 5_000, "left")
    assert few.count() == 5_000 and few.where("m is not null").count() == per.where("m < 100").agg(F.sum("n")).first()[0]


def test_scratch_tables_are_removed(spark):
    with common.scratch(spark) as keep:
        a, path = common.cut(spark.range(3), "a")
        _, other = common.cut(spark.range(3), "b")
        keep.add(path)
    assert a.count() == 3 and not common.exists(spark, other)


def test_empty_table(spark):
    assert simhash.groups(empty(spark)).count() == 0
    assert simhash.dedup(empty(spark)).count() == 0
