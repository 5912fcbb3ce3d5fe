"""Train on one split of made-up businesses, match another, and look at the files."""

import random

import pytest

from kinfold.operators import models
from kinfold.plans import linkage
from kinfold.sources import tsv


def write_split(folder, split, seed, n, truth):
    rng = random.Random(seed)
    words = "oak elm red blue stone river lake hill north sun star moon cedar maple iron gold silver green delta royal".split()
    kinds = "bakery garage studio market clinic hotel cafe foods motors textiles books tools".split()
    rows, matched = {1: [], 2: [], 3: []}, []
    for i in range(n):
        name = f"{rng.choice(words)} {rng.choice(words)} {rng.choice(kinds)}"
        street, no, town = rng.choice(words), rng.randint(1, 400), rng.choice(["Austin, TX", "Reno, NV", "Albany, NY"])
        rows[1].append((f"S1_{i}", f"{name} Inc", f"{no} {street} Street, {town}", "us"))
        own = []
        for src in (2, 3):
            if rng.random() < 0.6:
                own.append(f"S{src}_{i}")
                rows[src].append((f"S{src}_{i}", name.upper() if src == 2 else f"The {name}", f"{no} {street} St, {town}", "us"))
            elif rng.random() < 0.5:
                rows[src].append((f"S{src}_{i}", f"{rng.choice(words)} {rng.choice(kinds)}", f"{rng.randint(1, 400)} {rng.choice(words)} Ave, {town}", "us"))
        matched.append((f"S1_{i}", ",".join(own)))
    for src, r in rows.items():
        with open(f"{folder}/{split}_source{src}.tsv", "w") as f:
            f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(x) + "\n" for x in r))
    if truth:
        with open(f"{folder}/{split}_ground_truth.tsv", "w") as f:
            f.write("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(x) + "\n" for x in matched))
    return {k: set(v.split(",")) - {""} for k, v in matched}


def test_train_and_match(spark, tmp_path):
    write_split(tmp_path, "train", 1, 120, True)
    want = write_split(tmp_path, "test", 2, 80, False)
    seeds = (42, 43)
    rules = linkage.train(spark, str(tmp_path), f"{tmp_path}/models", rounds=3, depth=3, seeds=seeds, min_town=5, min_state=10)
    by = {(r.kind, r.v): r.dev for r in rules.collect()}
    assert len(by) == 15 and max(by.values()) > 0.8
    # What was learned: towns with their states, models for each seed and fold, and a rule with a default.
    cities = {r.city: r.state for r in tsv.read_map(spark, f"{tmp_path}/models/city_map", "city string, state string").collect()}
    assert cities == {"austin": "TX", "reno": "NV", "albany": "NY"}
    assert len(list((tmp_path / "models/ensemble").iterdir())) == 10
    rule = tsv.read_map(spark, f"{tmp_path}/models/rule", "kind string, cty string, w double, v double").collect()
    assert sum(r.cty is None for r in rule) == 1 and {r.kind for r in rule} == {max(by, key=lambda k: (round(by[k], 9), -ord(k[0][0]), -k[1]))[0]}
    for pool in ("max", None):
        wrong = linkage.match(spark, str(tmp_path), f"{tmp_path}/models", f"{tmp_path}/out", seeds=seeds, pool=pool).first().asDict()
        assert not any(wrong.values())
    got = {r.source1_entity_id: set((r.matched_entity_ids or "").split(",")) - {""} for r in tsv.scan(spark, f"{tmp_path}/out/matching_results", ["source1_entity_id", "matched_entity_ids"]).collect()}
    assert got.keys() == want.keys()
    right, said, there = sum(len(got[k] & want[k]) for k in want), sum(map(len, got.values())), sum(map(len, want.values()))
    assert right >= 0.8 * said and right >= 0.7 * there


@pytest.mark.parametrize(
    "lists, what",
    [
        ([("S1_1", "S2_1"), ("S1_2", "")], {}),
        ([("S1_1", "S2_1")], {"missing": 1}),
        ([("S1_1", "S2_1"), ("S1_2", None), ("S1_2", None)], {"repeated": 1}),
        ([("S1_1", "S2_1,S2_1"), ("S1_2", ""), ("S1_9", "")], {"twice_in_a_list": 1, "unknown": 1}),
        ([("S1_1", "S2_1"), ("S1_2", "S2_1")], {"shared": 1}),
        ([("S1_1", "S2_1,S4_x"), ("S1_2", "S3_7")], {"ill_formed": 1, "not_candidates": 2}),
    ],
)
def test_violations(spark, lists, what):
    s1 = spark.createDataFrame([(1,), (2,)], "s1 long")
    cand = spark.createDataFrame([("S1_1", "S2_1,S3_1"), ("S1_2", "S2_1")], "source1_entity_id string, candidate_entity_ids string")
    got = tsv.violations(spark.createDataFrame(lists, "source1_entity_id string, matched_entity_ids string"), cand, s1).first().asDict()
    assert {k: v for k, v in got.items() if v} == what


def test_blend_and_rule_by_country(spark):
    rows = [(w, v, c, 0.5 + 0.1 * w + (0.2 if v == best else 0.0), 10) for w in (0.0, 0.7) for v in (1.0, 1.5) for c, best in (("us", 1.0), ("fr", 1.5))]
    w, dev, rule = linkage.choose_blend(spark.createDataFrame(rows, "w double, v double, cty string, f05 double, n long"))
    assert (w, round(dev, 6)) == (0.7, 0.77) and sorted(rule, key=str) == sorted([("us", 0.7, 1.0), ("fr", 0.7, 1.5), (None, 0.7, 1.0)], key=str)
    scored = spark.createDataFrame([(1, 2, 5, "us", 0.1, 0.9, 0.9), (2, 2, 5, "us", 0.1, 0.2, 0.3), (3, 3, 9, "xx", 0.5, 0.01, 0.02)], "s1 long, src int, id long, cty string, p double, pb double, pc double")
    stored = spark.createDataFrame([("blend", *r) for r in rule], "kind string, cty string, w double, v double")
    assert [(r.s1, r.id) for r in linkage.decided(scored, stored).collect()] == [(1, 5)]


def test_early_stopping_by_the_left_out_fold(spark):
    """Noise learns nothing that holds on another fold, so it stops before a signal does."""
    rng = random.Random(5)
    rows = [(i % 5, rng.random(), rng.random()) for i in range(400)]
    trees = []
    for signal in (True, False):
        df = spark.createDataFrame([(f, x, y, int((x if signal else rng.random()) > 0.5)) for f, x, y in rows], "fold int, x double, y double, label int")
        fitted = models.fit_folds(df, ["x", "y"], rounds=12, depth=3)
        trees.append(sum(m.stages[-1].getNumTrees for _, m in fitted))
    assert trees[1] < trees[0] <= 60
