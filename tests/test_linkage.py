import math
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.functions import similarity
from kinfold.operators import blocking, cells, context, decide, learned, pairs, reports, sampling, twins
from kinfold.sources import tables, tsv

REC = "id long, src int, cty string, name string, addr string, st string"


def records(spark, rows):
    return spark.createDataFrame(rows, REC)


def scored(spark, rows):
    return spark.createDataFrame(rows, "s1 long, src int, id long, p double")


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "s.tsv").write_bytes(b'entity_id\tbusiness_name\tbusiness_address\tcountry\nS2_7\tsay "hi" \\ x\t\tFrance\nS3_8\tbad \xff byte\ta, b\t\n')
    rows = {r.id: r for r in tsv.load_source(spark, f"{tmp_path}/s.tsv").collect()}
    assert (rows[7].name, rows[7].addr, rows[7].src) == ('say "hi" \\ x', "", 2)
    assert "�" in rows[8].name and rows[8].country == ""
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1_1\tS2_7, S3_8,\nS1_2\t\n")
    ids, truth = tsv.load_truth(spark, f"{tmp_path}/t.tsv")
    assert sorted(r.s1 for r in ids.collect()) == [1, 2]
    assert sorted(map(tuple, truth.collect())) == [(1, 2, 7), (1, 3, 8)]
    chosen = scored(spark, [(1, 3, 8, 0.9), (1, 2, 7, 0.4), (1, 3, 8, 0.9)])
    tsv.write(tsv.match_lists(ids, chosen, "p"), f"{tmp_path}/out")
    back = {r.source1_entity_id: r.matched_entity_ids for r in tsv.scan(spark, f"{tmp_path}/out", ["source1_entity_id", "matched_entity_ids"]).collect()}
    assert back == {"S1_1": "S3_8,S2_7", "S1_2": None}
    assert tsv.sniff(spark, f"{tmp_path}/s.tsv", {"n": "name", "i": "id"}).columns == ["n", "i"]


def test_folds_match_known_values(spark):
    want = {1: 769, 7: 202, 123456: 250, 999999999: 78}
    d = spark.createDataFrame([(k,) for k in want], "s1 long").select("s1", sampling.fold_bucket(F.col("s1")).alias("b"), sampling.fold(F.col("s1")).alias("f"))
    assert {r.s1: r.b for r in d.collect()} == want
    assert {r.s1: r.f for r in d.collect()} == {1: 4, 7: 2, 123456: 0, 999999999: -1}


def test_ngrams_pad_each_word(spark):
    d = spark.createDataFrame([("ab c",)], "n string").select(blocking.char_ngrams(F.col("n")).alias("g"))
    assert d.first().g == [" ab", "ab ", " c "]


def test_blocking_finds_copies_and_respects_limits(spark):
    names = ["alpha beta", "gamma delta", "epsilon zeta", "eta theta", "iota kappa"]
    rows = [(10 * s + i, s, "en", n, f"{i} road {i}", "x" if i % 2 else "") for s in (1, 2, 3) for i, n in enumerate(names)] + [(99, 2, "en", "", "", "x")]
    rec = records(spark, rows)
    sims = blocking.similarities(blocking.weights(rec, max_df=0.9))
    c = blocking.candidates(sims, k=2, cap=1)
    assert {(r.s1, r.src, r.id) for r in c.collect()} == {(10 + i, s, 10 * s + i) for i in range(5) for s in (2, 3)}
    assert all(abs(r.max_score - 1) < 1e-6 and r.pos == 0 and r.nb >= 3 for r in c.collect())
    kept = blocking.same_state(rec)(sims.where("name_sim > 0.9"))
    assert kept.count() == 10


def _all_pairs(spark, rec, state=False):
    """Every pair that shares a token, by a plain join, as the lists' rows of any length."""
    w = blocking.weights(rec)
    q = w.where("src = 1").select("cty", "field", "t", F.col("id").alias("s1"), F.col("w").alias("wq"))
    x = q.join(w.where("src <> 1"), ["cty", "field", "t"]).withColumn("b", F.col("wq") * F.col("w")).groupBy("s1", "src", "id").agg(
        *[F.coalesce(F.sum(F.when(F.col("field") == f, F.col("b"))), F.lit(0.0)).alias(f) for f in ("name", "addr")]
    )
    x = x.select("s1", "src", "id", F.round("name", 6).alias("name_sim"), F.round("addr", 6).alias("addr_sim"), F.round((F.col("name") + F.col("addr")) * 0.5, 6).alias("combo_sim"))
    x = x.withColumn("forward", F.lit(True)).withColumn("back", F.lit(True))
    return blocking.same_state(rec)(x) if state else x


@pytest.mark.parametrize("state", [None, "st"])
def test_blocking_gives_out_lists_and_not_pairs(spark, monkeypatch, state):
    monkeypatch.setattr(blocking, "FIRST_BLOCK", 90)
    monkeypatch.setattr(blocking, "OTHER_BLOCK", 200)
    part = ["red", "reed", "shop", "ship", "bar", "barn", "oak", "elm"]
    rows = [(i, i % 3 + 1, "fr" if i % 7 == 0 else "en", f"{part[i * 5 % 8]} {part[i // 8 % 8]} {part[i // 5 % 8]}", f"{i % 40} {part[i % 8]} road", ["", "x", "y", "x y"][i // 3 % 4]) for i in range(600)]
    rows += [(600, 1, "en", "", "5 oak road", None), (601, 2, "en", "red shop", "", None), (602, 3, None, "red shop", "5 oak road", "x"), (603, 2, "es", "alone", "1 elm", "x")]
    rec = records(spark, rows).cache()
    whole = _all_pairs(spark, rec, bool(state)).cache()
    kinds = [blocking.record_similarities(rec, state=state, k=4, reverse_k=2)] + ([] if state else [blocking.similarities(blocking.weights(rec), 4, 2)])
    for sims in kinds:
        sims = sims.cache()
        assert sims.count() == sims.select("s1", "src", "id").distinct().count() < whole.count()
        for score, k, reverse in (("name_sim", 4, False), ("addr_sim", 4, False), ("combo_sim", 4, False), ("name_sim", 2, True)):
            want = {tuple(r) for r in blocking.top(whole, score, k, reverse).collect()}
            assert {tuple(r) for r in blocking.top(sims, score, k, reverse).collect()} == want
        assert set(blocking.candidates(sims, 4, 2, 5).collect()) == set(blocking.candidates(whole, 4, 2, 5).collect())


def test_empty_pool(spark):
    rec = records(spark, [])
    assert blocking.candidates(blocking.similarities(blocking.weights(rec))).count() == 0


def test_ownership(spark):
    p = scored(spark, [(1, 2, 5, 0.9), (2, 2, 5, 0.9), (3, 2, 5, 0.1), (1, 3, 5, 0.2)])
    assert sorted((r.s1, r.src) for r in decide.own(p, "p", keep_ties=True).collect()) == [(1, 2), (1, 3), (2, 2)]
    assert sorted((r.s1, r.src) for r in decide.own(p, "p").collect()) == [(1, 2), (1, 3)]


def test_expected_rule_equals_enumeration(spark):
    rows = [(1, 2, 1, 0.9), (1, 2, 2, 0.8), (1, 3, 3, 0.2), (2, 2, 4, 0.05), (3, 2, 6, 1.0), (3, 2, 7, 1.0)]
    got = sorted((r.s1, r.id) for r in decide.rule_expected(scored(spark, rows), "p", 1.0).collect())
    want = []
    for s in (1, 2, 3):
        q = sorted(((min(p, 0.999999), i) for s1, _, i, p in rows if s1 == s), key=lambda x: (-x[0], x[1]))
        total = sum(x[0] for x in q)
        ef = [1.25 * sum(x[0] for x in q[:k]) / (k + 0.25 * total) for k in range(1, len(q) + 1)]
        k = ef.index(max(ef)) + 1
        if max(ef) > math.prod(1 - x[0] for x in q):
            want += [(s, x[1]) for x in q[:k]]
    assert got == sorted(want)


def test_f05_cases(spark):
    universe = spark.createDataFrame([(1,), (2,), (3,), (4,)], "s1 long")
    truth = spark.createDataFrame([(1, 2, 1), (2, 2, 2)], "s1 long, src int, id long")
    chosen = spark.createDataFrame([(1, 2, 1), (3, 2, 9)], "s1 long, src int, id long")
    assert {r.s1: r.f for r in decide.per_record(chosen, universe, truth).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0}


def test_grid_equals_rule(spark):
    p = scored(spark, [(1, 2, 1, 0.95), (1, 2, 2, 0.5), (2, 2, 3, 0.35), (2, 3, 3, 0.15), (3, 2, 1, 0.4)])
    truth = spark.createDataFrame([(1, 2, 1), (2, 2, 3)], "s1 long, src int, id long")
    universe = spark.createDataFrame([(1,), (2,), (3,), (4,)], "s1 long")
    g = {(r.t_single, r.t_abs, r.t_rel): r.f05 for r in decide.grid(p, "p", universe, truth).collect()}
    assert len(g) == sum(len(decide.T_REL) for ts in decide.T_SINGLE for ta in decide.T_ABS if ta <= ts)
    for cell in ((0.3, 0.1, 0.0), (0.9, 0.5, 0.4), (0.3, 0.3, 0.6)):
        f = decide.per_record(decide.rule_threshold(p, "p", *cell), universe, truth).agg(F.avg("f")).first()[0]
        assert abs(g[cell] - f) < 1e-9


def test_group_context_of_single_rows_and_ties(spark):
    x = {(r.s1, r.id): r for r in context.group_features(scored(spark, [(1, 2, 1, 0.5), (2, 2, 2, 0.7), (2, 2, 3, 0.7)])).collect()}
    assert x[1, 1].a_id is None and x[1, 1].p_2 is None and x[1, 1].rk == 0
    assert (x[2, 2].rk, x[2, 2].a_id, x[2, 3].rk, x[2, 3].a_id) == (0, 3, 1, 2)


def test_anchor_and_rival_similarity(spark):
    rows = [(1, 1, "en", "red shop", "5 oak road", ""), (2, 1, "en", "red shop", "9 elm lane", ""), (3, 2, "en", "red shop", "5 oak road", ""), (4, 3, "en", "red shop two", "", "")]
    rec = records(spark, rows)
    p = scored(spark, [(1, 2, 3, 0.9), (1, 3, 4, 0.5), (2, 2, 3, 0.4)])
    got = {(r.s1, r.id): r for r in context.anchor_similarity(context.group_features(p), rec).collect()}
    assert (got[1, 3].anc_name, got[1, 3].anc_addr, got[1, 3].anc_same_src) == (1.0, None, 0)
    assert (got[1, 4].anc_name, got[1, 4].anc_addr) == (1.0, None)
    assert (got[2, 3].anc_name, got[2, 3].anc_same_src) == (None, None)
    r = {(x.s1, x.id): x for x in context.rival_addresses(p, rec).collect()}
    far = similarity.token_set_ratio("5 oak road", "9 elm lane") / 100
    assert r[1, 3].rv_addr == pytest.approx(far) and r[1, 3].rv_gap == pytest.approx(1 - far)
    assert r[2, 3].rv_addr == 1.0 and r[2, 3].rv_gap == pytest.approx(far - 1)
    assert r[1, 4].rv_addr is None and r[1, 4].rv_gap is None
    assert all(x.rv_addr is None for x in context.rival_addresses(p, rec, most=1).collect())


def test_outcomes_add_up(spark):
    judged = spark.createDataFrame([("en", 2, 1, 1, 0.5), ("en", 0, 12, 0, 0.0), ("fr", 0, 0, 0, 1.0)], "cty string, k long, t long, a long, f double")
    by = {r.true_count: (r.f05, r.n, r.wrong, r.missed) for r in reports.outcome_by_count(judged).collect()}
    assert by == {1: (0.5, 1, 1, 0), 8: (0.0, 1, 0, 12), 0: (1.0, 1, 0, 0)}
    c = {r.cty: (r.precision, r.recall) for r in reports.outcome_by_country(judged).collect()}
    assert c == {"en": (0.5, 1 / 13), "fr": (None, None)}


def test_twins(spark):
    rec = records(spark, [(1, 2, "en", "red shop", "5 road", ""), (2, 3, "en", "shop red", "road 5", ""), (3, 2, "en", "shop", "", ""), (4, 1, "en", "red shop", "5 road", "")])
    t = twins.groups(rec)
    assert {(r.src, r.id) for r in t.collect()} == {(2, 1), (3, 2)}
    p = scored(spark, [(7, 2, 1, 0.5), (8, 3, 2, 0.6), (7, 3, 2, 0.4), (9, 2, 3, 0.3)])
    assert sorted(map(tuple, twins.pool(p, t).collect())) == [(8, 2, 1, 0.6), (8, 3, 2, 0.6), (9, 2, 3, 0.3)]
    assert sorted(map(tuple, twins.pool(p, t, how="noisy_or").collect())) == [(7, 2, 1, 0.7), (7, 3, 2, 0.7), (9, 2, 3, 0.3)]


def test_word_and_city_maps(spark):
    d = spark.createDataFrame([("राम शॉप", "ram shop")] * 5 + [("राम", "rama")] + [("राम एक दो", "ram one")], "a string, b string")
    m = {r.x: r.y for r in learned.word_map(d, "a", "b").collect()}
    assert m == {"राम": "ram", "शॉप": "shop"}
    words = spark.createDataFrame(list(m.items()), "x string, y string")
    out = learned.apply_word_map(spark.createDataFrame([(1, "राम, एक"), (2, "latin"), (3, "एक")], "id int, n string"), "n", words)
    assert {r.id: r.n for r in out.collect()} == {1: "ram एक", 2: "latin", 3: "एक"}
    a = spark.createDataFrame([("1 x, Lyon, Rhone",)] * 30 + [("2 y, Lyon, Ain",), ("3, A1, Rhone",)], "a string")
    cities = learned.city_map(a, "a", min_state=20)
    assert [tuple(r) for r in cities.collect()] == [("lyon", "Rhone")]
    fixed = learned.apply_city_map(spark.createDataFrame([(1, "5 rue, LYON"), (2, "nowhere")], "id int, addr string"), "addr", cities, "id")
    assert {r.id: r.addr for r in fixed.collect()} == {1: "5 rue, LYON, Rhone", 2: "nowhere"}


def test_set_features(spark):
    cols = "s1 long, legal_1 string, legal_2 string, addr_nums_1 array<string>, addr_nums_2 array<string>, addr_num1_1 string, addr_num1_2 string, addr_state_1 string, addr_state_2 string, name_core_1 string, name_core_2 string, addr_norm_1 string, addr_norm_2 string"
    flags = ["name_nonlatin", "is_handle", "name_phone", "addr_nonlatin", "addr_empty", "has_landmark"]
    d = spark.createDataFrame([(1, "ltd", "ltd", ["5", "7"], ["7"], "5", "7", "tx", "tx oh", "ab", "abc", "x", ""), (2, "", "inc", [], ["1"], None, "1", "", "tx", "", "", "", "")], cols)
    for f in flags:
        d = d.withColumn(f"{f}_1", F.lit(True)).withColumn(f"{f}_2", F.lit(False))
    r = {x.s1: x for x in d.select("s1", *pairs.set_features(d)).collect()}
    assert (r[1].legal_eq, r[1].num_inter, r[1].num_jac, r[1].num_conflict, r[1].num1_eq, r[1].state_eq) == (1, 1, 0.5, 0, 0, 1)
    assert (r[2].legal_eq, r[2].num_jac, r[2].num1_eq, r[2].state_eq, r[2].num_conflict) == (None, None, None, None, 0)


def test_step_cache_notices_changed_input(spark, tmp_path):
    calls = []
    p = f"{tmp_path}/in.parquet"
    for n in (3, 3, 5):
        if n == 5 or not calls:
            spark.range(n).write.mode("overwrite").parquet(p)
        out = tables.step(spark, "t", lambda: calls.append(1) or spark.read.parquet(p), p, k=1)
        assert out.count() == n
    assert len(calls) == 2


@pytest.mark.parametrize("frac", [0.0, 0.5, 1.0])
def test_group_sample(spark, frac):
    rec = records(spark, [(i, i % 3 + 1, "en", "n", "a", "") for i in range(0, 9000, 100)])
    truth = spark.createDataFrame([(0, 2, 100), (8700, 3, 200)], "s1 long, src int, id long")
    got = {(r.src, r.id) for r in sampling.sample_groups(rec, truth, frac).collect()}
    assert ((2, 100) in got) == ((1, 0) in got) and ((3, 200) in got) == ((1, 8700) in got)


def test_word_differences_keep_pairs_whole(spark):
    rec = records(spark, [(1, 1, "en", "red shop red", "", ""), (2, 1, "en", "", "", ""), (3, 2, "en", "red old shops", "", ""), (4, 3, "en", None, "", "")])
    words = spark.createDataFrame([("en", "old", 0.5, 7), ("en", "shops", -0.5, 2), ("en", "red", 0.1, 9)], "cty string, t string, sib double, tdf long")
    p = spark.createDataFrame([(1, 2, 3), (1, 3, 4), (2, 2, 3), (2, 3, 4)], "s1 long, src int, id long")
    d = context.word_differences(p, rec, words)
    got = {(r.s1, r.id): tuple(r)[3:] for r in d.collect()}
    assert got == {(1, 3): (2, 0.5, 2, 1, None, None), (1, 4): (0, None, None, 2, 0.1, 9), (2, 3): (3, 0.5, 2, 0, None, None), (2, 4): (0, None, None, 0, None, None)}
    # Words become rows for records, never for pairs, of which there are many more.
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert all("s1" not in line for line in plan.splitlines() if "Generate " in line)
    assert plan.count("Generate ") == 2 and plan.count("Join ") == 4


def test_steps_leave_no_shuffle_files(spark, tmp_path):
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    spark.range(10).write.parquet(f"{tmp_path}/t.parquet")
    before = files()
    got = tables.step(spark, "counted", lambda: spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count(), f"{tmp_path}/t.parquet")
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and got.count() == 100
    assert spark.conf.get(tables.CLEANUP) == "false"


def test_cells_hold_vectors_in_flat_arrays():
    n_q, n, each = 20, 16000, 40
    tokens = [f"t{i}" for i in range(1000)]
    vectors = [[tokens[(i * 7 + j * 13) % 1000] for j in range(each)] for i in range(n_q + n)]
    schema = pa.schema([("first", pa.bool_()), ("cty", pa.string()), ("src", pa.int32()), ("id", pa.int64()), ("names", pa.list_(pa.string())), ("st", pa.string()), ("nt", pa.list_(pa.string())), ("nw", pa.list_(pa.float64())), ("at", pa.list_(pa.string())), ("aw", pa.list_(pa.float64()))])
    rows = [(i < n_q, "en", 1 if i < n_q else 2, i, None, None, v, [1 / (1 + (i + j) % 97) for j in range(each)], None, None) for i, v in enumerate(vectors)]
    t = pa.table({c.name: pa.array(v, c.type) for c, v in zip(schema, zip(*rows, strict=True), strict=True)}, schema=schema)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in cells._joined(t, 30, 5, 50_000, {})) > 0
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak / (n * each) < 40
