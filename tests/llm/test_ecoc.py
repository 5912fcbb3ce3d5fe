import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import ecoc

from .helpers import documents, empty

SYLLABLES = {"aa": "ba be bi bo bu", "bb": "kra kre kri kro kru", "cc": "šin šan šun šon šen", "dd": "lolo lala lili lulu lele", "ee": "quo qua que qui quu", "ff": "zur zar zer zir zor", "gg": "mnt mnk mnd mnp mng"}


def corpus(n_langs, per=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for lang in list(SYLLABLES)[:n_langs]:
        for _ in range(per):
            text = " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))
            rows.append((len(rows), text, lang))
    return rows


@pytest.mark.parametrize("n", [2, 3, 6, 7, 12])
def test_codewords_split_and_differ(n):
    code = ecoc.codewords(n)
    assert len({tuple(r) for r in code}) == n
    assert (np.abs(code.sum(0)) < n).all()
    if n == 4:
        assert code.shape[1] == 7


def brute_decode(model, text):
    """The nearest codeword, from the definition: trigram by trigram, bit by bit, language by language."""
    raw = f" {text.lower()} ".encode()
    b = [c - 96 if 97 <= c <= 122 else c if c >= 128 else 0 for c in raw]
    buckets = [((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> 16 for x, y, z in zip(b, b[1:], b[2:])]
    margins = [model.slope[k] * sum(float(model.weights[i, k]) for i in buckets) / len(buckets) + model.offset[k] for k in range(model.code.shape[1])]
    losses = [
        sum(model.trust[k] * math.log1p(math.exp(-int(model.code[m, k]) * margins[k])) for k in range(len(margins))) / sum(model.trust)
        for m in range(len(model.languages))
    ]
    p = [math.exp(-(x - min(losses)) * len(margins)) for x in losses]
    best = min(range(len(losses)), key=lambda m: losses[m])
    return model.languages[best], p[best] / sum(p)


def test_codewords_of_the_registered_fit_are_learned_and_decoded_as_defined(spark):
    """Counts, weights, curves and decoding against plain loops, on every text."""
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ecoc.fit(docs)
    learned = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    counts = {lang: Counter() for lang in model.languages}
    for t, lang in learned:
        b = [c - 96 if 97 <= c <= 122 else c if c >= 128 else 0 for c in f" {t.lower()} ".encode()]
        counts[lang].update(((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> 16 for x, y, z in zip(b, b[1:], b[2:]))
    floor = ecoc.SMOOTHING / sum(n for c in counts.values() for n in c.values())
    for k in range(model.code.shape[1]):
        for bucket in random.Random(k).sample(sorted(set().union(*counts.values())), 40):
            side = {}
            for sign in (1, -1):
                own = [lang for m, lang in enumerate(model.languages) if model.code[m, k] == sign]
                side[sign] = sum(counts[x][bucket] / sum(counts[x].values()) for x in own) / len(own)
            want = math.log(side[1] + floor) - math.log(side[-1] + floor)
            assert model.weights[bucket, k] == pytest.approx(want, rel=1e-3, abs=1e-4)
    got = {r.doc_id: r for r in ecoc.predict(docs, model).collect()}
    for i, t, _ in rows:
        lang, score = brute_decode(model, t)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-6)


def test_only_exact_ties_are_rejected(spark):
    code = ecoc.codewords(2)
    for offset, kept in ((0.0, 0), (1e-6, 1)):
        model = ecoc.Model(["aa", "bb"], code, np.zeros((ecoc.BUCKETS, 1), np.float32), np.ones(1), np.full(1, offset), np.ones(1))
        docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
        assert ecoc.keep_known(docs, model).count() == kept
        r = ecoc.predict(docs, model).first()
        assert (r.lang_pred, r.ambiguous) == ("aa", True)


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_held_out_accuracy(spark, n):
    docs = spark.createDataFrame(corpus(n), "doc_id long, text string, lang string")
    got = ecoc.predict(docs, ecoc.fit(docs)).join(docs, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 10 and sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_change_nothing(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows], docs.schema)
    a, b = (sorted(map(tuple, ecoc.predict(docs, ecoc.fit(x)).collect())) for x in (docs, other))
    assert a == b


def test_edge_texts(spark):
    model = ecoc.fit(spark.createDataFrame(corpus(2), "doc_id long, text string, lang string"))
    docs = documents(spark, [None, "", " \n", "123 !!", "²", "a", "你好", "ba " * 500_000])
    rows = {r.doc_id: r for r in ecoc.predict(docs, model).collect() if r.doc_id is not None}
    assert [rows[i].lang_pred for i in range(5)] == ["und"] * 5 and rows[0].score == 0.0
    assert all(rows[i].lang_pred in ("aa", "bb") for i in (5, 6, 7)) and rows[7].lang_pred == "aa"
    kept = ecoc.keep_known(docs, model)
    assert kept.columns == docs.columns and 7 in {r.doc_id for r in kept.collect()} and 3 not in {r.doc_id for r in kept.collect()}


def test_between_two_languages_is_flagged(spark):
    model = ecoc.fit(spark.createDataFrame(corpus(2), "doc_id long, text string, lang string"))
    lead = [model.predict(t)[2] for t in ("ba be bi bo bu baba bebi", "kra kre kri krokru")]
    assert min(lead) > 0.5


def test_nothing_to_learn_from(spark):
    docs = documents(spark, ["plain words"], null_ids=True).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert {r.lang_pred for r in ecoc.predict(docs, ecoc.fit(docs)).collect()} == {"und"}
    assert ecoc.predict(empty(spark), ecoc.fit(empty(spark))).count() == 0


def test_crc32_split(spark):
    docs = documents(spark)
    for r in docs.select("doc_id", ecoc.held_out(docs.doc_id).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
