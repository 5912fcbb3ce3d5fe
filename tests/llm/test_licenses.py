import re

import pytest
from pyspark.sql import functions as F

from kinfold.llm import licenses

from .helpers import documents, empty

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(i, label) for p, label in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


def test_base_equals_brute_force(spark):
    docs = documents(spark)
    got = sorted((tuple(r)[:6] for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)


def test_damaged_notice_is_found_and_others_are_not(spark):
    notice = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    words = notice.split()
    damaged = " ".join(words[:9] + ["surely"] + words[9:])
    texts = [f"intro {notice} end", f"intro text {damaged} end", "redistribution of water in source rivers", "GNU General Public License, version 3", "GNU General Public License, version 2"]
    rows = {r.doc_id: r for r in licenses.scan(documents(spark, texts, null_ids=False, repeat=False)).collect()}
    assert rows[0].labels == "bsd" and rows[0].score == 1.0
    assert rows[1].labels == "bsd" and 0.8 <= rows[1].score < 1
    assert rows[2].labels == "" and rows[2].score == 0.0
    assert (rows[3].labels, rows[4].labels) == ("gpl-3", "gpl-2")
    assert all(r.n_base == 0 and r.first_word is None for r in rows.values())


def test_many_occurrences_in_one_text(spark):
    text = "under the mit license " * 3000
    r = licenses.scan(documents(spark, [text], null_ids=False, repeat=False)).first()
    assert (r.n_base, r.first_word, r.last_word) == (3000, 0, 4 * 2999)


def test_base_labels_stay_among_labels(spark):
    for r in licenses.scan(documents(spark)).collect():
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_only_ascii_letters_are_lowered(spark):
    texts = ["x this wor\u212a is licensed under a creative commons attribution 4 0 international license", "under the m\u0130t license", "UNDER THE MIT LICENSE"]
    rows = {r.doc_id: r for r in licenses.scan(documents(spark, texts, null_ids=False, repeat=False)).collect()}
    # Two of the notice's eleven windows hold a word that isn't "work".
    assert (rows[0].labels, rows[0].score) == ("cc-by", pytest.approx(9 / 11))
    assert (rows[1].labels, rows[1].n_base, rows[2].labels, rows[2].n_base) == ("", 0, "mit", 1)
    assert [tuple(rows[i])[:6] for i in range(3)] == [(i, *brute(t)) for i, t in enumerate(texts)]


def test_words_are_compared_and_not_only_hashes(spark, monkeypatch):
    class Same:
        def __getattr__(self, name):
            return (lambda *c: F.lit(7).cast("long")) if name == "xxhash64" else getattr(F, name)

    docs = documents(spark, ["no license here at all my friend", "so it is under the mit license"], null_ids=False, repeat=False).withColumn("n", F.lit(1))
    want = [tuple(r)[:6] for r in licenses.scan(docs).orderBy("doc_id").collect()]
    monkeypatch.setattr(licenses, "F", Same())
    # Every window now has the hash of every other, and both documents the same digest, but their ids differ.
    assert [tuple(r)[:6] for r in licenses.scan(docs).orderBy("doc_id").collect()] == want


def test_many_equal_rows_come_back_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 7)
    docs = spark.range(100).select(F.lit(5).cast("long").alias("doc_id"), F.lit("under the mit license").alias("text"))
    got = licenses.scan(docs).collect()
    assert len(got) == 100 and {tuple(r)[:6] for r in got} == {(5, *brute("under the mit license"))}


def test_empty_table(spark):
    assert licenses.scan(empty(spark)).count() == 0
