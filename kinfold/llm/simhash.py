"""SimHash near-duplicates through multi-index hashing.

A 64-bit fingerprint is cut into ``segments``.  If two fingerprints differ in ``radius`` bits or fewer, they differ in
at most ``radius // segments`` bits of one segment.  So each fingerprint looks up, in a table keyed by segment value,
every value of the small Hamming ball around each of its own segments; what it meets is verified over all
64 bits.  Equal fingerprints are one class before that, so copies are never paired, whatever their number.  Lookups are a merge join,
which spills and which Spark can split, so a segment value of many fingerprints needs no more memory.

Texts are lower-cased in A-Z and cut at ASCII white space; a shingle is ``width`` words joined by a space (fewer words:
all of them; none: fingerprint 0), hashed by XXH64 with seed 42.  A bit is 1 if set in over half of the hashes.

Defined results: a null text is empty; a null id never names a group while the group has another id; repeated rows share a
group, and ``dedup`` keeps one of them; a bit that is set in exactly half of the hashes is 0; a very long text is hashed in blocks of ``BLOCK``
shingles; an empty table gives an empty result; further columns of the input are ignored by ``groups`` and kept by ``dedup``,
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_spread, scratch, settled, text_of
from .components import connected_components

WIDTH = 3
RADIUS = 2
SEGMENTS = 2
#: Shingle hashes that are counted at a time, which bounds the memory of a long text.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        rows = [part] if n == 1 else zip(*(part[i:] for i in range(width)), strict=False)
        h = np.fromiter((digest(b" ".join(r), 42) for r in rows), "<u8")
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([fingerprint(t) for t in s], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    udf = F.pandas_udf(_fingerprints, "long")  # type: ignore[call-overload]
    return docs.withColumn(out, udf(F.col(f"`{text}`")))


def _segments(bits: int, segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [bits * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _ball(width: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` bits among ``width``."""
    masks = [0]
    last = [0]
    for _ in range(radius):
        last = sorted({m | 1 << i for m in last for i in range(width) if not m >> i & 1})
        masks += last
    return masks


def _probe(i: int, value: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(F.lit(i).alias("seg"), value.bitwiseXOR(mask).alias("key"))


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``fps``: distinct fingerprints in a column fp.  Returns (a, b) with a < b that differ in 1 to ``radius`` bits."""
    reach = radius // segments
    keys, probes = [], []
    for i, (shift, width) in enumerate(_segments(64, segments)):
        value = F.shiftrightunsigned("fp", shift)
        value = value.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else value
        masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in _ball(width, reach)])
        keys.append(F.struct(F.lit(i).alias("seg"), value.alias("key")))
        probes.append(F.transform(masks, _probe(i, value)))
    indexed = fps.select(F.col("fp").alias("b"), F.explode(F.array(*keys)).alias("k")).select("b", "k.seg", "k.key")
    asked = fps.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probes))).alias("k")).select("a", "k.seg", "k.key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return asked.join(indexed, ["seg", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """One row per input row: id, th (hash of the text), fp, component_id (smallest id of its group) and root, which names the group."""
    with scratch(docs.sparkSession) as keep:
        d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
        d = with_fingerprint(d, "text").select("id", F.xxhash64(text_of("text")).alias("th"), "fp")
        d, _ = cut(d, "fingerprints")
        total = d.count()
        classes, _ = cut(d.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes", total)
        comp = connected_components(links(classes.select("fp"), radius, segments), total)
        linked = comp.withColumnRenamed("id", "fp").join(classes, "fp")
        # A component of many fingerprints is a group like any other: its members meet its smallest id without meeting in a task.
        first = linked.groupBy("component").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n"))
        named = join_spread(linked, first, "component", "n", total).select("fp", "component", "first")
        named = classes.join(named, "fp", "left").select(
            "fp", "copies", F.coalesce("component", "fp").alias("root"),
            F.when(F.col("component").isNotNull(), F.col("first")).otherwise(F.col("rep")).alias("component_id"),
        )
        named, _ = cut(named, "groups", total)
        out = join_spread(d, named, "fp", "copies", total).select("id", "th", "fp", "root", "component_id")
        return settled(out, "grouped", keep, total)


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """One document of each group, that with the smallest id, with all its columns."""
    key, kkey = fresh(docs, "key", "kept")
    named = lambda i, th: F.concat_ws(":", th.cast("string"), i.cast("string"))
    g = groups(docs, id_col, text, radius, segments)
    keep = g.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("id", "th")).alias("k"))
    keep = keep.select(named(F.col("k.id"), F.col("k.th")).alias(kkey))
    # One key for the join and for rows that repeat, so the texts are moved and sorted once.
    d = docs.withColumn(key, named(F.col(f"`{id_col}`"), F.xxhash64(text_of(f"`{text}`"))))
    kept = d.join(keep, F.col(key) == F.col(kkey), "left_semi")
    return kept.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
