"""Token counts with a digest cache.

The cache is a Parquet table in a folder that all machines share: (digest of the normalised content) -> (number of
tokens), one subfolder per tokenizer version.  The version is a digest of the vocabulary file and of everything else that
decides the count.  Texts are joined to the cache by digest; only distinct misses are encoded, and they are appended.
A run that misses nothing reads the texts once, for their digests, and moves none.

The normalisation is that of the tokenizer: byte-level BPE has none, so the content is the text itself and null is empty.

Encoding uses the ranks of the same vocabulary, several times faster than the library that the JSON file is written for and equal
to it: same pattern, same merges, and the special strings that the JSON file declares become one token.  Where the faster one
gives up (white space runs near a million characters) the library itself counts.

Defined results: a null text counts as empty with 0 tokens; ids may be null or repeat, every input row gets its row; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections import OrderedDict
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE_ROWS, HOT_SHARE, cut, exists, join_spread, remove, scratch, scratch_path, settled, text_of

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
LIMIT = 1024
#: Digests that a worker remembers to have encoded, so that rows that repeat an id and a text are encoded once.
REMEMBER = 200_000
#: Bytes that a missing digest and id take when broadcast, about.
ROW_BYTES = 128
_SCHEMA = "digest binary, n_tokens long"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def version(vocabulary: str = VOCABULARY) -> str:
    """Names all that decides a count: the file, how special strings are treated, and the normalisation."""
    h = hashlib.sha256(Path(vocabulary_path(vocabulary)).read_bytes())
    h.update(b"|specials in texts are tokens|no added specials|identity normalisation")
    return h.hexdigest()[:32]


def counter(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Callable[[str], int]:
    """A function from a text to its number of tokens."""
    import public_tokenizers
    import tiktoken

    spec = json.loads(Path(vocabulary_path(vocabulary)).read_text())
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary_path(ranks)).read_bytes().splitlines())}
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    fast = tiktoken.Encoding("counter", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=specials)
    slow = []

    def count(text: str) -> int:
        if not text:
            return 0
        try:
            return len(fast.encode(text, allowed_special="all"))
        except ValueError:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(vocabulary_path(vocabulary)))
            return len(slow[0].encode(text, add_special_tokens=False))

    return count


def _encoder(vocabulary: str, ranks: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count, seen = None, OrderedDict()
        for b in batches:
            count = count or counter(vocabulary, ranks)
            got = []
            for digest, t in zip(b["digest"], b["t"], strict=True):
                if digest in seen:
                    continue
                seen[digest] = None
                if len(seen) > REMEMBER:
                    seen.popitem(last=False)
                got.append((digest, count(t)))
            yield pd.DataFrame(got, columns=["digest", "n_tokens"])

    return encode


def cached(spark, cache: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The stored counts of this tokenizer version, one row per digest even if two writers stored it."""
    path = f"{cache}/{version(vocabulary)}"
    if not exists(spark, path):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def chosen_texts(docs: DataFrame, classes: DataFrame, total: int, cache: DataFrame, id_col: str, text: str) -> DataFrame:
    """(digest, t): one row for each class that the cache lacks; cold rows that repeat an id and a text come together, and the encoder skips them.

    ``classes``: digest, id (the smallest), copies.  Where nothing is missing, no text is read; where the missing classes fit the session's
    broadcast threshold, by their count, no text is moved; else texts are moved by digest, but for the copies of hot texts.
    """
    spark = docs.sparkSession
    missing = classes.join(cache, "digest", "left_anti").select(F.col("digest").alias("_digest"), F.col("id").alias("_id"), "copies")
    missing, path = cut(missing, "missing", total)
    n = missing.count()
    d = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text}`").alias("t"))
    d = d.withColumn("digest", F.unhex(F.sha2("t", 256)))
    if not n:
        remove(spark, path)
        return d.select("digest", "t").limit(0)
    # Said without an equality of the ids, so that the digest alone deals the rows.
    here = (F.col("digest") == F.col("_digest")) & ~F.coalesce(F.col("id") != F.col("_id"), F.col("id").isNull() != F.col("_id").isNull())
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if n * ROW_BYTES <= limit:
        return d.join(F.broadcast(missing), here, "left_semi").select("digest", "t").dropDuplicates(["digest"])
    bound = F.lit(total * HOT_SHARE)
    hot, cold = missing.where(F.col("copies") > bound), missing.where(F.col("copies") <= bound)
    few = F.broadcast(hot)
    near = d.join(few, here, "left_semi").select("digest", "t").dropDuplicates(["digest"])
    far = d.join(few, F.col("digest") == F.col("_digest"), "left_anti").join(cold.hint("shuffle_hash"), here, "left_semi")
    return near.unionByName(far.select("digest", "t"))


def fill(docs: DataFrame, classes: DataFrame, total: int, cache: str, id_col: str, text: str, vocabulary: str, ranks: str) -> None:
    """Encode the distinct texts that the cache lacks and append them."""
    chosen = chosen_texts(docs, classes, total, cached(docs.sparkSession, cache, vocabulary), id_col, text)
    counted = chosen.mapInPandas(_encoder(vocabulary, ranks), _SCHEMA)
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).coalesce(max(1, -(-total // FILE_ROWS)))
    counted.write.mode("append").parquet(f"{cache}/{version(vocabulary)}")


def count_tokens(
    docs: DataFrame, cache: str | None = None, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, ranks: str = RANKS, limit: int = LIMIT
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.  ``cache``: a shared folder; None: a new one for this call."""
    spark = docs.sparkSession
    t = text_of(f"`{text}`")
    with scratch(spark) as keep:
        cache = cache or scratch_path(spark, "token-cache")
        keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(t).cast("long").alias("n_bytes"), F.unhex(F.sha2(t, 256)).alias("digest"))
        keyed, _ = cut(keyed, "digests")
        total = keyed.count()
        classes, _ = cut(keyed.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes", total)
        fill(docs, classes, total, cache, id_col, text, vocabulary, ranks)
        counts = cached(spark, cache, vocabulary).join(classes.select("digest", "copies"), "digest")
        out = join_spread(keyed, counts, "digest", "copies", total).select(
            F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
        )
        return settled(out, "counts", keep, total)
