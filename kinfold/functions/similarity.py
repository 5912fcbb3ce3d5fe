"""String similarities in [0, 100] that Spark has no function for, as Arrow UDFs.

The longest common subsequence is counted bit-parallel on Python integers, one word of bits per string.
A side that is null or empty makes the result null.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _bits(a: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def _common(where: dict[str, int], n: int, b: str) -> int:
    full = s = (1 << n) - 1
    for ch in b:
        u = s & where.get(ch, 0)
        s = (s + u | s - u) & full
    return n - s.bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _common(_bits(a), len(a), b) if a and b else 0


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio(with_left, with_right)
    return max(best, ratio(both, with_left), ratio(both, with_right)) if both else best


def _best_window(a: str, b: str) -> float:
    """The best ratio of ``a`` to a window of its length in ``b``, windows cut off at the edges included.

    Characters that a window shares with ``a``, in any order, bound its ratio; they are counted by sliding, and
    windows are compared from the highest bound on, until the next one can't win.
    """
    n, need = len(a), Counter(a)
    have: dict[str, int] = dict.fromkeys(need, 0)
    shared, bounds = 0, []
    for i in range(1 - n, len(b)):
        new, old = i + n - 1, i - 1
        if new < len(b) and (ch := b[new]) in have:
            have[ch] += 1
            shared += have[ch] <= need[ch]
        if old >= 0 and (ch := b[old]) in have:
            shared -= have[ch] <= need[ch]
            have[ch] -= 1
        lo, hi = max(0, i), min(len(b), i + n)
        bounds.append((200.0 * shared / (n + hi - lo), lo, hi))
    where, best = _bits(a), 0.0
    for bound, lo, hi in sorted(bounds, reverse=True):
        if bound <= best:
            break
        best = max(best, 200.0 * _common(where, n, b[lo:hi]) / (n + hi - lo))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The shorter string against its best window in the longer one; of equally long ones, the better way round."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a == b:
        return 100.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) and best < 100.0 else best


#: Bits of a word, and window states that are counted at once: what fits a core's cache.
WORD, STATES = 64, 1 << 14


def _windows(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``_best_window`` of pairs whose first strings are equally long and fit a word: all windows of all pairs side by side."""
    n, m = len(pairs[0][0]), max(len(b) for _, b in pairs)
    a, b = (np.array(x, f"U{w}").view(np.uint32).reshape(len(pairs), w) for x, w in zip(zip(*pairs, strict=True), (n, m), strict=True))
    # The characters of a window that sticks out match nothing.
    where = np.zeros((len(pairs), m + 2 * n - 2), np.uint64)
    inner = where[:, n - 1 : n - 1 + m]
    for i in range(n):
        inner |= (b == a[:, i : i + 1]).astype(np.uint64) << np.uint64(i)
    full = np.uint64((1 << n) - 1)
    s = np.full((len(pairs), n + m - 1), full)
    for i in range(n):
        u = s & where[:, i : i + n + m - 1]
        s = (s + u) | (s - u)
    start, size = np.arange(1 - n, m), np.array([[len(b)] for _, b in pairs])
    held = np.minimum(size, start + n) - np.maximum(start, 0)
    return (200.0 * (n - np.bitwise_count(s & full).astype(np.int64)) / (n + np.maximum(held, 0))).max(1)


def partial_ratios(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """``partial_ratio`` of many pairs; those longer than a word of bits, and odd ones, one by one."""
    out, groups = [0.0] * len(pairs), defaultdict(list)
    for at, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if not a or a == b or len(a) > WORD or len(b) > 4 * WORD or "\0" in a + b:
            out[at] = partial_ratio(a, b)
            continue
        groups[len(a)].append((len(b), at, a, b))
        if len(a) == len(b):
            groups[len(a)].append((len(b), at, b, a))
    for n, own in groups.items():
        own.sort()
        step = max(1, STATES // (n + own[len(own) // 2][0]))
        for i in range(0, len(own), step):
            part = own[i : i + step]
            for (_, at, _, _), x in zip(part, _windows([(a, b) for _, _, a, b in part]).tolist(), strict=True):
                out[at] = max(out[at], x)
    return out


def jaro_winkler(a: str, b: str) -> float:
    """In [0, 1]; a common prefix of up to four counts where the Jaro similarity is above 0.7."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (ch for ch, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def column(score: Callable[[str, str], float], scale: float = 1.0):
    """A two-column Arrow UDF; equal pairs within a batch are scored once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b, strict=True))
        new = list(dict.fromkeys(p for p in pairs if p[0] and p[1]))
        scores = partial_ratios(new) if score is partial_ratio else [score(*p) for p in new]
        seen = {p: x / scale for p, x in zip(new, scores, strict=True)}
        return pd.Series([seen.get(p) for p in pairs], dtype="float64")

    return F.pandas_udf(run, "double")
