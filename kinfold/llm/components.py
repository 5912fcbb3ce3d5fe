"""Connected components of a distributed edge table, by alternating large-star and small-star steps.

Up to ``FEW`` edges of whole numbers are joined up by one task, which costs the driver one small statement.  More go through the steps.  Each step replaces the edges of a node by edges to its smallest neighbour, so paths shorten by half
and the table ends as one star per component, after a number of rounds that is logarithmic in practice.  A step is
two aggregations with map-side combine and two joins; nothing is collected, and no group of edges is gathered in one
task: the minima of hubs, of which there are few, are broadcast to their edges.  Every step is written to the shared folder, so a
statement has the joins of one step: where it had those of a round, the second step repeated all of the first wherever it read it, and the driver
held plans, generated classes and broadcasts of both.

The rounds end when the table no longer changes, which is seen by its number of edges and the exclusive or of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, join_spread, remove

MAX_ROUNDS = 60
#: Edges that one task takes: 16 bytes each to read, some 200 in its union-find.
FEW = 1 << 17


def _star(pairs: DataFrame, total: int, larger: bool) -> DataFrame:
    """pairs: (u, v), at most ``total``.  Each u tells its chosen neighbours the smallest id that it knows."""
    m = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    x = join_spread(pairs, m, "u", "n", total)
    if larger:
        return x.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return x.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): the edges of all batches; gives each of their nodes with the smallest of its component."""
    root: dict[int, int] = {}
    schema = None
    for b in batches:
        schema = b.schema
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ends = []
            for x in (u, v):
                root.setdefault(x, x)
                while root[x] != x:
                    root[x] = x = root[root[x]]
                ends.append(x)
            root[max(ends)] = min(ends)
    if schema is not None:
        for x in sorted(root):  # a root is smaller than what hangs on it, so it is settled first
            root[x] = root[root[x]]
        yield pa.record_batch([pa.array(list(root), schema.types[0]), pa.array(list(root.values()), schema.types[1])], names=["id", "component"])


def state_of(edges: DataFrame) -> tuple[int, int | None]:
    """Number of rows and a digest of distinct rows (u, v) that no order and no number of rows can make overflow."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``edges``: (a, b) of one orderable type, about ``rows`` at most.  Returns (id, component) for every id in an edge with a != b.

    The component is its smallest id.  Null ends and loops are ignored; repeated edges change nothing; no edges: no rows.
    """
    spark = edges.sparkSession
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = cut(e, "edges", rows)
    state, now = None, state_of(e)
    kind = e.schema["u"].dataType
    if 0 < now[0] <= FEW and isinstance(kind, IntegralType):
        out, _ = cut(e.coalesce(1).mapInArrow(_joined_up, f"id {kind.simpleString()}, component {kind.simpleString()}"), "components")
        remove(spark, path)
        return out
    for _ in range(MAX_ROUNDS):
        if now[0] == 0 or now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, mid = cut(_star(both, 2 * now[0], larger=True).distinct(), "stars", 2 * now[0])
        e, new = cut(_star(large, 2 * now[0], larger=False).distinct(), "edges", 2 * now[0])
        remove(spark, path, mid)
        path, now = new, state_of(e)
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
