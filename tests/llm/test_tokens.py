import base64
import hashlib
import random
import struct
from collections import Counter

import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import byte_pieces, token_cache

from .helpers import TEXTS, documents, empty

ODD = ["<|endoftext|>", "a<|endoftext|><|endoftext|>b", " " * 5000 + "x", "a" * 3000, "\n" * 1_000_000 + "x", "é" * 999, "don't they'll I'M", " 　x ", "1234567 ½ ² Ⅻ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counter_equals_library(library):
    count = token_cache.counter()
    for t in [*ODD, *(t or "" for t in TEXTS)]:
        assert count(t) == len(library.encode(t, add_special_tokens=False)), t[:30]


def test_counter_equals_library_on_every_token(library):
    count = token_cache.counter()
    words = [library.decode([i]) for i in range(0, 50_256)]
    assert [count(w) for w in words] == [len(e) for e in library.encode_batch(words, add_special_tokens=False)]


def test_counts_cache_and_version(spark, library, tmp_path):
    docs = documents(spark)
    cache = f"file://{tmp_path}/cache"
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())
    for _ in range(2):
        got = token_cache.count_tokens(docs, cache)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got.collect())
    path = f"{cache}/{token_cache.version()}"
    distinct = len({r.text or "" for r in docs.collect()})
    assert spark.read.parquet(path).count() == distinct  # the second call appended nothing
    more = documents(spark, ["something new"], null_ids=False, repeat=False)
    assert token_cache.count_tokens(more, cache).count() == 1
    assert spark.read.parquet(path).count() == distinct + 1
    assert token_cache.version("byte_bpe_50k.json") != token_cache.version("word_bpe_49k.json")


def test_stored_counts_are_used(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    digest = hashlib.sha256(b"known text").digest()
    spark.createDataFrame([(bytearray(digest), 77)], "digest binary, n_tokens long").write.parquet(f"{cache}/{token_cache.version()}")
    docs = spark.createDataFrame([(1, "known text")], "doc_id long, text string")
    assert token_cache.count_tokens(docs, cache).first().n_tokens == 77


def test_each_missing_digest_is_encoded_once(spark, tmp_path):
    """Repeated rows and null ids; by the small and by the large way of choosing texts."""
    rows = [(5, "again and again")] * 50 + [(None, "no id")] * 20 + [(None, "again and again")] + [(i, f"text {i % 30}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            cache = f"file://{tmp_path}/{limit}"
            assert token_cache.count_tokens(docs, cache).count() == len(rows)
            keyed = docs.selectExpr("doc_id id", "unhex(sha2(text, 256)) digest")
            classes = keyed.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
            for total in (len(rows), 1 << 30):  # all digests hot, none hot
                none = token_cache.cached(spark, f"{cache}-none")
                chosen = token_cache.chosen_texts(docs, classes, total, none, "doc_id", "text")
                sent = chosen.mapInPandas(token_cache._encoder(token_cache.VOCABULARY, token_cache.RANKS), token_cache._SCHEMA)
                assert sent.count() == 32 == sent.select("digest").distinct().count()
            warm = token_cache.chosen_texts(docs, classes, len(rows), token_cache.cached(spark, cache), "doc_id", "text")
            assert warm.count() == 0 and "Exchange" not in warm._jdf.queryExecution().executedPlan().toString().replace("Exchange SinglePartition", "")
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pieces_equal_rank_encoder(spark, encoding):
    docs = documents(spark, [*TEXTS, *(t for t in ODD if len(t) < 10**5)])
    for r in byte_pieces.encode(docs.select("doc_id", "text"), with_ids=True).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def codec():
    return byte_pieces.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text_round_trips(codec, encoding, text):
    ids = codec.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == encoding.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_memory_of_pieces_is_bounded(codec, encoding, monkeypatch):
    monkeypatch.setattr(byte_pieces, "REMEMBER", 50)
    codec.known.clear()
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(rng.choice([3, 40, 200])))
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == encoding.encode_ordinary(text)
        assert len(codec.known) <= 50


def test_model_needs_all_bytes_and_gapless_ranks(ranks):
    with pytest.raises(ValueError):
        byte_pieces.model_bytes({b"a": 0})
    assert byte_pieces.model_bytes(ranks)


def test_null_ids_and_empty_tables(spark):
    assert byte_pieces.encode(documents(spark)).count() == documents(spark).count()
    assert byte_pieces.encode(empty(spark)).count() == 0
    assert token_cache.count_tokens(empty(spark)).count() == 0
