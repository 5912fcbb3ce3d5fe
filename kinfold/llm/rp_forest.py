"""Near-duplicate vectors through a forest of random-projection trees with spill overlap.

Equal vectors are one class before anything else; one row of each class goes on.  Each tree splits the space again and again by
a random projection; the ``spill`` share of rows on either side of a cut goes to both children, so a close pair is separated only if
it straddles the whole band.  The rows of a leaf are compared with each other in double precision, and the links that the
trees find are united.  Splits are fitted on a bounded sample (``SAMPLE`` rows of the table, later ``LEAF_SAMPLE`` of a leaf),
every row is routed.  Leaves of more than ``MOST`` times ``LEAF`` rows are split again in distributed rounds.

Loose groups.  A group of near copies that is larger than a leaf would be cut through by every further split.  So a node knows the links
among its sampled rows: of a few random directions and cuts it takes one that separates least of them, and where its pairs
are linked more often than ``DENSE`` and every cut loses more than ``LOSS`` of the links, it isn't split.  Such a leaf may hold any number of
rows.  They are dealt into blocks of ``BLOCK`` rows and a task compares two blocks, so memory is bounded; and as at least the share
``DENSE`` of what is compared is a link, the work is in proportion to the number of links, as it must be to count them.

Links are counted, not listed.  A pair can meet in several leaves; it counts in that of the smallest number, which the rows of a leaf
tell from the leaf numbers that each of them carries.  A leaf gives its rows their links and the smallest row of their component within the
leaf, so a group of m rows gives m rows however many links it has.  Large leaves have the smallest numbers, and rows that
shared one before aren't compared again.

Tight balls.  Vectors within half the angle of the threshold around one centre are all linked to each other,
which needs no comparison.  Dense centres are looked for in the sample; such a ball is one group, counted by an aggregation.

``exact=True`` makes one leaf of the whole table: blocks of it are compared with each other, in as many tasks as there are pairs of blocks.

Links are pairs with cosine >= ``threshold``, all verified.  Defined results: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing, and so does a row without an id; vectors of different lengths don't link; rows that repeat an id and a vector
count as further copies of it; a pair at the threshold itself links; an empty table gives an empty result; further columns are ignored,
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, scratch
from .components import connected_components

THRESHOLD = 0.95
TREES = 8
#: Rows that a leaf should hold, and the share of rows on either side of a cut that goes to both sides.
LEAF = 1024
SPILL = 0.06
#: Rows that the first splits and the dense centres are fitted on, and how many of them a leaf or a ball needs.
SAMPLE = 8192
LEAST = 16
#: Leaves of more than this many times LEAF rows are split in rounds, of so many levels and sampled rows of a leaf each.
MOST = 4
DEPTH = 5
LEAF_SAMPLE = 1024
ROUNDS = 8
#: Directions and cuts that a split is chosen from.
DIRECTIONS = 4
CUTS = (0.5, 0.42, 0.58, 0.35, 0.65)
#: Share of linked pairs at which a node isn't cut if that loses more than the other share of its links.
DENSE = 1 / 64
LOSS = 0.02
#: Sampled links that are kept for each 1,024 rows of a sample; more are thinned and weighted.
LINKS = 16_384
#: Rows of a block of a large leaf.
BLOCK = 8192
#: Sets of directions that the leaves of a round draw from by their number.
SLOTS = 256
SEED = 20260101
#: Leaf numbers are below this; large leaves are moved below zero by it.
_SPAN = 1 << 62


def unit(rows: list | np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, scaled first so that squares neither vanish nor overflow."""
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def half_angle(threshold: float) -> float:
    """Cosine of half the angle whose cosine is ``threshold``, rounded up a little."""
    return float(np.cos(np.arccos(threshold) / 2) + 1e-9)


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1))


def leaf_number(parent: np.ndarray | int, child: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 2^62) for children of leaves; two leaves sharing one by chance would only be compared as one."""
    z = np.asarray(parent, np.int64).reshape(-1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(child, np.int64).astype(np.uint64) + np.uint64(1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) & np.uint64(_SPAN - 1)).astype(np.int64)


class Links:
    """Links among sampled rows, weighted where they were thinned; those within one ball don't count, as no leaf has to find them."""

    def __init__(self, x: np.ndarray, ball: np.ndarray, threshold: float, seed: int):
        rng = np.random.default_rng(seed)
        f, ends, weights = x.astype(np.float32), [], []
        for at in range(0, len(x), 1024):
            i, j = np.nonzero(f[at : at + 1024] @ f[at:].T >= threshold)
            i, j = i + at, j + at
            keep = (i < j) & ((ball[i] < 0) | (ball[i] != ball[j]))
            pair, weight = np.stack([i[keep], j[keep]]), 1.0
            if pair.shape[1] > LINKS:
                weight = pair.shape[1] / LINKS
                pair = pair[:, rng.choice(pair.shape[1], LINKS, replace=False)]
            ends.append(pair)
            weights.append(np.full(pair.shape[1], weight))
        self.a, self.b = np.concatenate(ends, 1) if ends else np.zeros((2, 0), int)
        self.w = np.concatenate(weights) if weights else np.zeros(0)

    def among(self, members: np.ndarray, n: int) -> np.ndarray:
        inside = np.zeros(n, bool)
        inside[members] = True
        return np.flatnonzero(inside[self.a] & inside[self.b])


def best_cut(x: np.ndarray, members: np.ndarray, own: np.ndarray, links: Links, candidates: np.ndarray, spill: float) -> tuple | None:
    """(candidate, low, middle, high, projections) of the split that separates the fewest links, or None if there is none to make.

    ``own`` are the links within the members.  A split is good enough if it loses a hundredth of the links at the median.
    """
    weight = links.w[own].sum()
    p, best = np.empty(len(x)), None
    for c, v in enumerate(candidates):
        p[members] = q = x[members] @ v
        for at in CUTS:
            low, mid, high = np.quantile(q, [at - spill, at, at + spill])
            if not ((q <= mid).any() and (q > mid).any() and (q > low).any()):
                continue
            lost = 0.0
            if weight:
                a, b = p[links.a[own]], p[links.b[own]]
                lost = links.w[own][((a <= low) & (b > high)) | ((b <= low) & (a > high))].sum() / weight
            key = (round(lost, 2), abs(at - 0.5))
            if best is None or key < best[0]:
                best = (key, (c, low, mid, high, q), lost)
            if not weight or key <= (0.01, 0.0):
                break
        if best and best[0] <= (0.01, 0.0):
            break
    if best is None:
        return None
    n = len(members)
    if weight >= DENSE * n * (n - 1) / 2 and best[2] > LOSS:
        return None
    return best[1]


def _drawn(rng: np.random.Generator, dim: int) -> np.ndarray:
    d = rng.standard_normal((DIRECTIONS, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def grow(x: np.ndarray, leaves: int, spill: float, seed: int, links: Links) -> list[tuple]:
    """Nodes (direction, low, high, left, right) of one tree, children as indices, or a negative number for a leaf.

    A row goes left if its projection is at most ``high``, and right if it is above ``low``.
    """
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    n_leaves = 0

    def split(members: np.ndarray, want: int) -> int:
        nonlocal n_leaves
        if want > 1 and len(members) >= 2 * LEAST:
            candidates = _drawn(rng, x.shape[1])
            found = best_cut(x, members, links.among(members, len(x)), links, candidates, spill)
            if found:
                c, low, mid, high, p = found
                at = len(nodes)
                nodes.append(())
                to_left = p <= mid
                share = min(want - 1, max(1, round(want * to_left.mean())))
                left = split(members[to_left], share)
                right = split(members[~to_left], want - share)
                nodes[at] = (candidates[c], low, high, left, right)
                return at
        n_leaves += 1
        return -n_leaves

    root = split(np.arange(len(x)), leaves)
    nodes.append((None, 0.0, 0.0, root, root))
    return nodes


def route(x: np.ndarray, nodes: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) of one tree; a row can be in several leaves."""
    todo = [(nodes[-1][3], np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if at < 0:
            yield -at, rows
            continue
        v, low, high, left, right = nodes[at]
        p = x[rows] @ v
        for child, mask in ((left, p <= high), (right, p > low)):
            if mask.any():
                todo.append((child, rows[mask]))


def directions(slot: int, turn: int, dim: int) -> np.ndarray:
    """The directions that a round's splits choose from, (node in heap order, choice, dim); leaves store choices and bounds."""
    rng = np.random.default_rng([SEED, slot, turn])
    return np.stack([_drawn(rng, dim) for _ in range(2**DEPTH - 1)])


def bounds(x: np.ndarray, ball: np.ndarray, d: np.ndarray, want: int, spill: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(choice, low, high) of each split of a leaf, from sampled rows; what isn't split sends every row left."""
    links = Links(x, ball, threshold, SEED)
    choice, low, high = np.zeros(len(d), np.int32), np.full(len(d), np.inf), np.full(len(d), np.inf)
    todo = {0: (np.arange(len(x)), want)}
    for i in range(len(d)):
        m, n = todo.pop(i, (None, 0))
        if m is None or n < 2 or len(m) < 2 * LEAST:
            continue
        found = best_cut(x, m, links.among(m, len(x)), links, d[i], spill)
        if not found:
            continue
        choice[i], low[i], mid, high[i], p = found
        share = min(n - 1, max(1, round(n * (p <= mid).mean())))
        todo[2 * i + 1], todo[2 * i + 2] = (m[p <= mid], share), (m[p > mid], n - share)
    return choice, low, high


def descend(x: np.ndarray, d: np.ndarray, choice: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, child) after ``DEPTH`` levels; ``choice``, ``low`` and ``high`` hold a row for each row's own leaf."""
    rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        q = np.einsum("ij,ij->i", x[rows], d[at, choice[rows, at]])
        left, right = q <= high[rows, at], q > low[rows, at]
        rows, at = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
    return rows, at - (2**DEPTH - 1)


def dense_centres(x: np.ndarray, near: float, least: int = LEAST) -> np.ndarray:
    """Centres of balls that hold ``least`` or more of the rows, found greedily from the fullest neighbourhoods."""
    if len(x) < least:
        return np.zeros((0, x.shape[1]))
    f = x.astype(np.float32)
    counts = np.concatenate([(f[i : i + 1024] @ f.T >= near).sum(1) for i in range(0, len(f), 1024)])
    free, centres = np.ones(len(x), bool), []
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < least:
            break
        if not free[i]:
            continue
        centre = x[i]
        for _ in range(3):
            inside = free & (x @ centre >= near)
            if inside.sum() < least:
                break
            centre = x[inside].mean(0)
            centre /= np.linalg.norm(centre)
        inside = free & (x @ centre >= near)
        if inside.sum() >= least:
            centres.append(centre)
            free &= ~inside
        free[i] = False
    return np.array(centres).reshape(-1, x.shape[1])


def ball_of(x: np.ndarray, centres: np.ndarray, near: float) -> np.ndarray:
    """The ball of each row, that of the nearest centre, or -1."""
    if not len(centres):
        return np.full(len(x), -1, np.int32)
    s = x @ centres.T
    best = s.argmax(1)
    return np.where(s[np.arange(len(s)), best] >= near, best, -1).astype(np.int32)


def _merge(label: np.ndarray, own: np.ndarray, i: int, linked: np.ndarray) -> None:
    """Give row ``own[i]`` and the rows ``linked`` one component label, the smallest of theirs."""
    at, there = label[own[i]], label[linked]
    if (there == at).all():
        return
    old = np.union1d(there, at)
    label[np.isin(label, old[1:])] = old[0]


def leaf_links(
    x: np.ndarray, copies: np.ndarray, ball: np.ndarray, leaves: np.ndarray, side: np.ndarray | None, threshold: float, seen: int
) -> tuple[np.ndarray, np.ndarray]:
    """(links, component) of each row within a leaf, rows sorted so that the smallest row number names a component.

    ``leaves`` are the padded leaf numbers below this leaf's that a row is also in (padding is below ``seen``, and differs from row to row):
    pairs that share one have been counted there.  ``side``: None compares all rows, else rows of 0 are compared with rows of 1.
    """
    n = len(x)
    degree, label = np.zeros(n, np.int64), np.arange(n)
    first, second = (np.arange(n), np.arange(n)) if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for at in range(0, len(first), 512):
        a = first[at : at + 512]
        b = second[at:] if side is None else second
        s = x[a] @ x[b].T >= threshold
        if side is None:
            s &= b[None, :] > a[:, None]
        s &= (ball[a][:, None] != ball[b][None, :]) | (ball[a] < 0)[:, None]
        for i in np.flatnonzero(s.any(1)):
            _merge(label, a, i, b[s[i]])
        i, j = np.nonzero(s)
        for k in range(0, len(i), 50_000):
            p, q = a[i[k : k + 50_000]], b[j[k : k + 50_000]]
            if leaves.shape[1]:
                left, right = leaves[p][:, :, None], leaves[q][:, None, :]
                new = ~((left == right) & (left >= seen)).any((1, 2))
                p, q = p[new], q[new]
            degree += np.bincount(p, copies[q], n).astype(np.int64) + np.bincount(q, copies[p], n).astype(np.int64)
    return degree, label


def _placer(forest: list[list[tuple]], centres: np.ndarray, near: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the ball and the leaves of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            got = [(rows, np.repeat(leaf_number(t, leaf), len(rows))) for t, nodes in enumerate(forest) for leaf, rows in route(x, nodes)]
            rows, numbers = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.argsort(rows, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(x)))]).astype(np.int32)
            leaves = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[order]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "copies", "k", "v")), pa.array(ball_of(x, centres, near)), leaves], ["rep", "copies", "k", "v", "ball", "leaves"])

    return run


def _fitter(turn: int, leaf: int, spill: float, threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("v").combine_chunks())
        number, n = group.column("leaf")[0].as_py(), group.column("n")[0].as_py()
        choice, low, high = bounds(x, group.column("ball").to_numpy(), directions(number % SLOTS, turn, x.shape[1]), -(-n // leaf), spill, threshold)
        return pa.table({"leaf": pa.array([number], pa.int64()), "choice": [choice], "low": [low], "high": [high]})

    return run


def _descender(turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            choice, low, high = (b.column(c).flatten().to_numpy().reshape(len(x), -1) for c in ("choice", "low", "high"))
            number = b.column("leaf").to_numpy()
            for slot in np.unique(number % SLOTS).tolist():
                own = np.flatnonzero(number % SLOTS == slot)
                if slot not in known:
                    known[slot] = directions(slot, turn, x.shape[1])
                rows, child = descend(x[own], known[slot], choice[own], low[own], high[own])
                rows = own[rows]
                yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(rows)), pa.array(number[rows]), pa.array(leaf_number(number[rows], child))], ["rep", "leaf", "child"])

    return run


def _sizes(placed: DataFrame) -> DataFrame:
    return cut(placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaves", placed.count())[0]


def _renumbered(placed: DataFrame, changes: DataFrame) -> DataFrame:
    """``placed`` with leaves replaced: ``changes`` says (rep, leaf, child), one or more children for each leaf of a row that changes."""
    per = changes.groupBy("rep").agg(F.collect_set("leaf").alias("_old"), F.collect_set("child").alias("_new"))
    leaves = F.when(F.col("_old").isNull(), F.col("leaves")).otherwise(F.concat(F.array_except("leaves", "_old"), "_new"))
    return cut(placed.join(per, "rep", "left").withColumn("leaves", leaves).drop("_old", "_new"), "placed")[0]


def refined(placed: DataFrame, leaf: int, most: int, spill: float, threshold: float, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(placed, sizes) with leaves of more than ``most`` rows split, but for those that are dense, until none is left or ``rounds`` are over.

    What is stored and joined is a row for each large leaf.  Rows of a leaf that holds a large share of the table stay where they are
    (``join_spread``); vectors are moved once a round, by their own number.
    """
    sizes, whole = _sizes(placed), None
    for turn in range(rounds):
        large = sizes.where(F.col("n") > most)
        large, _ = cut(large if whole is None else large.join(whole, "leaf", "left_anti"), "large", placed.count())
        total = large.agg(F.sum("n")).first()[0]
        if not total:
            break
        rows = placed.select("rep", "ball", "v", F.explode("leaves").alias("leaf"))
        own = join_spread(rows, large.select("leaf", "n", F.col("n").alias("copies")), "leaf", "copies", total)
        u = F.pmod(F.xxhash64("rep", "leaf", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        sample = own.where(u * F.col("n") < LEAF_SAMPLE)
        fitted = sample.groupBy("leaf").applyInArrow(_fitter(turn, leaf, spill, threshold), "leaf long, choice array<int>, low array<double>, high array<double>")
        fitted, _ = cut(fitted.join(large, "leaf"), "bounds")
        split = F.col("low")[0] < float("inf")
        asked = join_spread(rows.drop("ball"), fitted.where(split).withColumnRenamed("n", "copies"), "leaf", "copies", total)
        changes, _ = cut(asked.mapInArrow(_descender(turn), "rep long, leaf long, child long"), "children")
        # A leaf that the sample says is dense, or that had no sampled rows, stays whole.
        stay = large.select("leaf").join(fitted.where(split), "leaf", "left_anti")
        whole = cut(stay if whole is None else whole.unionByName(stay), "whole")[0]
        placed = _renumbered(placed, changes)
        sizes = _sizes(placed)
    return placed, sizes


def _comparer(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Links of each row within a leaf, or between two blocks of one, as (rep, n, root)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rep = group.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        group = group.take(pa.array(order))
        rep, copies, ball = (group.column(c).to_numpy() for c in ("rep", "copies", "ball"))
        number = group.column("leaf")[0].as_py()
        lists = group.column("leaves").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(rep)), sizes)
        flat, row = flat[flat < number], row[flat < number]
        n = np.bincount(row, minlength=len(rep))
        least = -(1 << 63)
        leaves = np.full((len(rep), n.max(initial=0)), least)
        leaves[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = flat
        side = group.column("side").to_numpy() if "side" in group.column_names else None
        if side is not None and (side == 2).any():
            side = None
        degree, label = leaf_links(_matrix(group.column("v").combine_chunks()), copies, ball, leaves, side, threshold, least + 1)
        some = (degree > 0) | (label != np.arange(len(label)))
        return pa.table({"rep": rep[some], "n": degree[some], "root": rep[label[some]]})

    return run


def block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """Rows of large leaves with the pairs of blocks (b1, b2) that each takes part in, and its side; 2 where both blocks are one.

    Rows that a ball or an earlier large leaf has brought together are dealt into blocks of their own, which needn't be compared within.
    """
    kept = ["leaf", "rep", "copies", "ball", "v", "leaves"]
    first = F.array_min("leaves")
    rows = rows.withColumn("_g", F.concat_ws(":", F.when(F.col("ball") >= 0, F.concat(F.lit("b"), "ball")), F.when(first < F.col("leaf"), first)))
    groups = rows.groupBy("leaf", "_g").agg(F.count(F.lit(1)).alias("n"))
    # Small groups share the blocks of the rest, so there are at most 4 n / block of them, and one.
    groups = groups.withColumn("g", F.when(F.col("n") * 4 >= block, F.col("_g")).otherwise(""))
    sizes = groups.groupBy("leaf", "g").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    groups, _ = cut(groups.join(sizes, ["leaf", "g"]).select("leaf", "_g", "g", "parts"), "groups")
    blocks = sizes.select("leaf", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks, _ = cut(blocks.select("leaf", "g", F.concat_ws("/", "g", "part").alias("b")), "blocks")
    other = blocks.select("leaf", F.col("g").alias("g2"), F.col("b").alias("b2"))
    known = F.col("g") != ""
    pairs = blocks.withColumnRenamed("b", "b1").join(other, "leaf").where((F.col("b1") <= F.col("b2")) & ~(known & (F.col("g") == F.col("g2")))).select("leaf", "b1", "b2")
    side = F.explode(F.when(F.col("b1") == F.col("b2"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))))
    pairs = pairs.withColumn("side", side).withColumn("b", F.when(F.col("side") == 1, F.col("b2")).otherwise(F.col("b1")))
    pairs, _ = cut(pairs, "block-pairs")
    dealt = rows.join(groups, ["leaf", "_g"]).withColumn("b", F.concat_ws("/", "g", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("string")))
    return dealt.join(pairs, ["leaf", "b"]).select(*kept, "b1", "b2", "side")


def compared(placed: DataFrame, sizes: DataFrame, most: int, block: int, threshold: float) -> DataFrame:
    """(rep, n, root): links newly counted in a leaf and the smallest rep of the row's component there."""
    large, _ = cut(sizes.where(F.col("n") > most), "large", placed.count())
    total = large.agg(F.sum("n")).first()[0]
    if total:
        rows = placed.select("rep", F.explode("leaves").alias("leaf"))
        moved = join_spread(rows, large.withColumnRenamed("n", "copies"), "leaf", "copies", total)
        placed = _renumbered(placed, moved.select("rep", "leaf", (F.col("leaf") - F.lit(_SPAN)).alias("child")))
    rows = placed.select(F.explode("leaves").alias("leaf"), "rep", "copies", "ball", "v", "leaves")
    out, kind = _comparer(threshold), "rep long, n long, root long"
    found = rows.where(F.col("leaf") >= 0).groupBy("leaf").applyInArrow(out, kind)
    if total:
        found = found.unionByName(block_pairs(rows.where(F.col("leaf") < 0), block).groupBy("leaf", "b1", "b2").applyInArrow(out, kind))
    return found


def representatives(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rep, copies, k, v) of the distinct usable vectors, and all rows (id, k); k is 128 bits of hashes of the vector, null where it can't be used."""
    v = F.col(f"`{vector}`")
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(F.col(f"`{id_col}`").isNotNull() & F.coalesce(usable, F.lit(False)), v).alias("v"))
    rows = rows.withColumn("k", F.when(F.col("v").isNotNull(), F.concat(F.hex(F.xxhash64("v")), F.lit("."), F.hex(F.xxhash64(F.lit(1), "v")))))
    reps = rows.where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "copies", "k", "v")
    return reps, rows.select("id", "k")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, most: int | None = None, block: int = BLOCK, exact: bool = False,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    spark, most = vectors.sparkSession, most or MOST * leaf
    with scratch(spark) as keep:
        reps, rows = representatives(vectors, id_col, vector)
        reps, _ = cut(reps, "vectors")
        rows, path = cut(rows, "keys")
        keep.add(path)
        total = rows.count()
        near = half_angle(threshold)
        parts = []
        # Usually one length; each length has a forest of its own.
        for (length, n) in sorted(tuple(r) for r in reps.groupBy(F.size("v")).count().collect()):
            own = reps.where(F.size("v") == length)
            x = unit([r[0] for r in own.orderBy(F.xxhash64("rep"), "rep").select("v").limit(sample).collect()])
            centres = np.zeros((0, length)) if exact else dense_centres(x, near)
            leaves = 1 if exact else max(1, min(-(-n // leaf), len(x) // LEAST))
            links = Links(x, ball_of(x, centres, near), threshold, SEED) if leaves > 1 else None
            forest = [grow(x, leaves, spill, SEED + t, links) for t in range(trees)] if links else [[(None, 0.0, 0.0, -1, -1)]]
            kind = own.schema["v"].dataType.simpleString()
            placed, _ = cut(own.mapInArrow(_placer(forest, centres, near), f"rep long, copies long, k string, v {kind}, ball int, leaves array<long>"), "placed")
            placed, sizes = refined(placed, leaf, most, spill, threshold, 0 if exact else ROUNDS)
            found = compared(placed, sizes, most, block, threshold)
            parts.append((placed.select("rep", "copies", "k", F.when(F.col("ball") >= 0, F.concat_ws(":", F.lit(length), "ball")).alias("ball")), found))
        if parts:
            nodes, found = parts[0]
            for p, f in parts[1:]:
                nodes, found = nodes.unionByName(p), found.unionByName(f)
            found, _ = cut(found, "links")
            groups = nodes.where(F.col("ball").isNotNull()).groupBy("ball").agg(F.sum("copies").alias("size"), F.min("rep").alias("first"))
            # A ball holds LEAST of the sampled rows of its length, so there are at most sample / LEAST balls a length, whatever the table's size.
            nodes = nodes.join(F.broadcast(groups), "ball", "left")
            across = found.groupBy("rep").agg(F.sum("n").alias("across"))
            edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
            comp = connected_components(edges.unionByName(nodes.where(F.col("first").isNotNull()).select(F.col("rep").alias("a"), F.col("first").alias("b"))), trees * total)
            per = nodes.join(across, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
            per = per.select(
                "k", "copies",
                (F.coalesce("size", "copies") - 1 + F.coalesce("across", F.lit(0))).cast("long").alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"),
            )
            per, path = cut(per, "groups", total)
            keep.add(path)
    if not parts:
        per = spark.createDataFrame([], "k string, copies long, n_links long, component_id long")
    out = join_spread(rows.where(F.col("k").isNotNull()), per, "k", "copies", total).drop("k")
    lone = rows.where(F.col("k").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(lone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
