"""The stages in order, against brute force on a small corpus, and the registered queries' contracts."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import ecoc, registry, simhash
from kinfold.llm.common import cut

from .test_ecoc import SYLLABLES
from .test_quality import brute as measures
from .test_simhash import brute_fingerprint, groups_of


def make(spark, tmp_path):
    rng = random.Random(11)
    rows = []

    def prose(lang, n):
        return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))) for _ in range(n))

    for i in range(240):
        rows.append([i, prose(["aa", "bb", "cc"][i % 3], rng.randint(60, 150)), ["aa", "bb", "cc"][i % 3], f"s{i % 4}"])
    for i in range(240, 270):
        rows.append([i, rows[i - 240][1], rows[i - 240][2], "s0"])
    rows += [[300, "short text", "aa", "s1"], [301, "ba be bi " * 100, "aa", "s1"], [302, " ".join(str(7 * i) for i in range(100)), None, None], [303, None, None, None], [304, "", "aa", "s2"]]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return df


def test_stages_equal_brute_force(spark, tmp_path):
    docs = make(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "source_mix", "byte_bpe"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out, _ = cut(stage(spark, seen[-1], str(tmp_path)), name)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        seen.append(out)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = [sorted(r.doc_id for r in x.collect()) for x in seen]

    def good(t):
        n, chars, symbols, lines, dup, rep = measures(t)
        return n >= 50 and 100 * rep <= 50 * n and 10 * symbols <= n and not (dup >= 3 and 10 * dup > 3 * lines) and 2 * n <= chars <= 25 * n

    assert ids[1] == sorted(i for i, t in texts.items() if good(t))
    assert ids[2] == [i for i in ids[1] if i != 302]  # no letters, no language
    fp = {i: brute_fingerprint(texts[i]) for i in ids[2]}
    comp = groups_of(ids[2], [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert ids[3] == sorted(set(comp.values())) and len(ids[3]) < len(ids[2])
    assert set(ids[4]) <= set(ids[3]) and all(ids[4].count(i) <= 3 for i in set(ids[4]))
    words = {i: measures(texts[i])[0] for i in ids[3]}
    assert abs(sum(words[i] for i in ids[4]) - sum(words.values())) < 0.25 * sum(words.values())
    for r in seen[5].collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in seen[5].collect())


def test_queries_have_contract_columns(spark, tmp_path):
    make(spark, tmp_path)
    want = {
        "op2": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op3": ["doc_id", "fingerprint", "component_id"],
        "op4": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op5": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op7": ["doc_id", "held_out", "lang_pred", "score"],
        "op8": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op9": ["doc_id", "size", "source_size", "target", "taken"],
        "op10": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    for name, q in registry.QUERIES.items():
        if (columns := want.get(name.split("_")[0])) is None:
            continue
        out = q(spark, str(tmp_path))
        assert out.columns[: len(columns)] == columns
        assert out.count() == 275
    assert len(registry.QUERIES) == 10
    got = registry.QUERIES["op3_simhash_groups"](spark, str(tmp_path)).where("doc_id = 303").first()
    assert got.fingerprint == "0" * 16 and got.component_id == 303


def test_language_stage_keeps_clean_documents(spark, tmp_path):
    docs = make(spark, tmp_path).where(F.col("doc_id") < 270)
    assert ecoc.keep_known(docs, ecoc.fit(docs)).count() == 270
    assert simhash.groups(docs).count() == 270


def test_stages_handle_odd_tables(spark, tmp_path):
    """Nulls in every column, an empty and a very long text, ties and repeated rows, clashing columns; and no rows at all."""
    long = " ".join(f"word{i % 900} and{i % 7} more{i * 7919 % 1013}" for i in range(30_000))
    prose = " ".join(f"alpha{i} beta{i * 3}" for i in range(80))
    other = " ".join(f"gamma{i} delta{i * 5}" for i in range(80))
    rows = [(1, prose, "aa", "x"), (1, prose, "aa", "x"), (2, prose, "aa", None), (None, other, None, "x"), (4, None, "aa", "x"), (5, "", None, None), (6, long, "bb", "y"), (7, other, "bb", "y"), (None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, u double, whole long, `row` int, `_kf_key` string, n_words int"
    for n, part in (("odd", rows), ("none", [])):
        path = f"{tmp_path}/{n}"
        docs = spark.createDataFrame([(*r, None, 1, 2.0, 3, 4, "k", 5) for r in part], schema)
        docs.write.parquet(f"{path}/documents.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            out, _ = cut(stage(spark, docs, path), name)
            if name != "byte_bpe":
                assert out.columns == docs.columns and {r["_kf_key"] for r in out.collect()} <= {"k"}
                docs = out
            counts.append(out.count())
        if part:
            assert counts[:3] == [6, 6, 3]
            assert sorted(str(r.doc_id) for r in spark.read.parquet(f"{path}/documents.parquet").join(out, "doc_id", "left_semi").select("doc_id").distinct().collect())
        else:
            assert counts == [0] * 5
        assert corpus_pipeline.run(spark, path).count() == counts[-1]
