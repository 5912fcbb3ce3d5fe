"""Best lists of a TF-IDF join, computed cell by cell: a block of first-source records against a block of the others.

A cell adds up its pairs' products on dense vectors and gives out only what is in some list of its own, so a join's disk grows with the
lists, not with the pairs.  Each pair is in one cell, and the best of all cells are among the best of each cell: nothing is lost.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Digits of a score, as a factor.
UNIT = 1_000_000
#: Rows of a batch that a cell gives out.
CHUNK = 65_536

Batches = Iterator[pa.RecordBatch]


def grams(names: list[str]) -> dict[str, int]:
    """Counted trigrams of each word with a space on both sides."""
    out: dict[str, int] = {}
    for name in names:
        if name:
            for word in name.split(" "):
                s = f" {word} "
                for i in range(max(len(word), 1)):
                    out[s[i : i + 3]] = out.get(s[i : i + 3], 0) + 1
    return out


def weigh(names: list[str], idf: dict[str, float]) -> tuple[list[str], list[float]]:
    """The unit-length TF-IDF vector of a record's names."""
    found = [(t, (1 + math.log(n)) * idf[t]) for t, n in grams(names).items() if t in idf]
    norm = math.sqrt(sum(w * w for _, w in found))
    return [t for t, _ in found], [w / norm for _, w in found]


def units(x: np.ndarray) -> np.ndarray:
    return np.floor(x * UNIT + 0.5).astype(np.int32)


def _best(r: np.ndarray, k: int, least: int) -> np.ndarray:
    """Where the ``k`` largest values from ``least`` on stand; of equal ones the first."""
    at = np.flatnonzero(r >= least)
    if len(at) > k:
        own = r[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.argsort(-r[at], kind="stable")[:k]]


class _Postings:
    """Which records have a token, and its weight there."""

    def __init__(self, codes: array, at: array, weights: array, n_codes: int, n: int) -> None:
        c = np.array(codes, np.int32)
        order = np.argsort(c, kind="stable")
        self.at, self.w, self.n = np.array(at, np.int32)[order].astype(np.intp), np.array(weights)[order], n
        self.start = np.searchsorted(c[order], np.arange(n_codes + 1)).tolist()

    def dots(self, vector: Iterable[tuple[int, float]]) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Dot products with all records, and the records met; both None if none is."""
        spans = [(a, b, w) for c, w in vector if (a := self.start[c]) < (b := self.start[c + 1])]
        if not spans:
            return None, None
        at = np.concatenate([self.at[a:b] for a, b, _ in spans])
        return np.bincount(at, np.concatenate([self.w[a:b] * w for a, b, w in spans]), self.n), at


def _vectors(t: pa.Table, idf: dict[str, dict[str, float]]) -> Iterator[tuple[tuple[list[str], list[float]], tuple[list[str], list[float]]]]:
    """Name and address vectors of each row; names without a vector are weighed here."""
    for b in t.to_batches(2048):
        for cty, names, nt, nw, at, aw in zip(*(b.column(c).to_pylist() for c in ("cty", "names", "nt", "nw", "at", "aw")), strict=True):
            yield (nt, nw) if nt is not None else weigh(names or [], idf.get(cty, {})), (at or [], aw or [])


class _Queries:
    """Vectors one after another in flat arrays: as lists of pairs they would take ten times the room."""

    def __init__(self) -> None:
        self.codes, self.w, self.ends = array("i"), array("d"), array("q", [0])

    def add(self, codes: Iterable[int], weights: list[float]) -> None:
        self.codes.extend(codes)
        self.w.extend(weights)
        self.ends.append(len(self.w))

    def __getitem__(self, i: int) -> Iterator[tuple[int, float]]:
        own = slice(self.ends[i], self.ends[i + 1])
        return zip(self.codes[own], self.w[own], strict=True)


def _joined(t: pa.Table, k: int, back_k: int, least: int, idf: dict[str, dict[str, float]]) -> Batches:
    """The rows of one cell.  Both sides come sorted by source and id."""
    mine = t.column("first").to_numpy(zero_copy_only=False)
    q, p = t.filter(pa.array(mine)), t.filter(pa.array(~mine))
    n_q, n = q.num_rows, p.num_rows
    if not n_q or not n:
        return
    codes: tuple[dict[str, int], dict[str, int]] = ({}, {})
    asked = _Queries(), _Queries()
    for both in _vectors(q, idf):
        for known, to, (ts, ws) in zip(codes, asked, both, strict=True):
            to.add((known.setdefault(x, len(known)) for x in ts), ws)
    flat = [(array("i"), array("i"), array("d")) for _ in codes]
    for i, both in enumerate(_vectors(p, idf)):
        for known, (cs, at, ws), v in zip(codes, flat, both, strict=True):
            for x, w in zip(*v, strict=True):
                if (c := known.get(x)) is not None:
                    cs.append(c)
                    at.append(i)
                    ws.append(w)
    name, addr = (_Postings(*f, len(known), n) for f, known in zip(flat, codes, strict=True))
    del flat
    s1, ids, src = q.column("id").to_numpy(), p.column("id").to_numpy(), p.column("src").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(src)) + 1).tolist(), n]
    # Which records a state lets through, by its text.
    states, kinds = q.column("st").to_pylist(), p.column("st").combine_chunks().dictionary_encode()
    split = [set((x or "").split()) for x in kinds.dictionary.to_pylist()]
    of = kinds.indices.fill_null(len(split)).to_numpy(zero_copy_only=False)
    allowed: dict[str, np.ndarray | None] = {}

    def passed(state: str | None) -> np.ndarray | None:
        own = set((state or "").split())
        if state not in allowed:
            allowed[state] = np.array([not own or not x or bool(own & x) for x in [*split, set()]])[of].astype(float) if own else None
        return allowed[state]

    floor = (least - 0.5) / UNIT - 1e-12
    guess = [0.5] * (len(edges) - 1)
    kept: list[tuple[np.ndarray, ...]] = []
    back = [np.full((n, back_k), x, np.int32) for x in (least - 1, -1, 0, 0)]
    low = np.full(n, floor)
    none = np.zeros(n)
    for i in range(n_q):
        x, _ = name.dots(asked[0][i])
        y, met = addr.dots(asked[1][i])
        ok = passed(states[i])
        x = none if x is None else x if ok is None else x * ok
        y = none if y is None else y if ok is None else y * ok
        met = np.unique(met) if met is not None else np.zeros(0, np.intp)
        chosen = []
        for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            own, g = x[a:b], max(guess[s], floor)
            while True:
                at = np.flatnonzero(own >= g)
                if len(at) < k and g > floor:
                    g = max(g * 0.7, floor)
                    continue
                r = units(own[at])
                if len(at) >= k:
                    # A combined score is half of the name's: what may round to a tie in it is here too.
                    last = (int(np.partition(r, len(r) - k)[len(r) - k]) - 3) / UNIT
                    if last < g and g > floor:
                        g = max(last, floor)
                        continue
                    guess[s] = last * 0.95
                else:
                    guess[s] = floor
                break
            near = met[np.searchsorted(met, a) : np.searchsorted(met, b)]
            one = [a + at[_best(r, k, least)]]
            if len(near):
                one.append(near[_best(units(y[near]), k, least)])
            both = np.union1d(a + at, near) if len(near) else a + at
            one.append(both[_best(units((x[both] + y[both]) * 0.5), k, least)])
            chosen.append(np.unique(np.concatenate(one)))
        at = np.concatenate(chosen)
        kept.append((np.full(len(at), i, np.int32), at.astype(np.int32), units(x[at]), units(y[at]), units((x[at] + y[at]) * 0.5)))
        up = np.flatnonzero(x >= low)
        if len(up):
            r = units(x[up])
            up, r = up[r > back[0][up, -1]], r[r > back[0][up, -1]]
            new = r, np.full(len(up), i, np.int32), units(y[up]), units((x[up] + y[up]) * 0.5)
            wide = [np.concatenate([old[up], v[:, None]], 1) for old, v in zip(back, new, strict=True)]
            order = np.argsort(-wide[0], axis=1, kind="stable")[:, :back_k]
            for old, v in zip(back, wide, strict=True):
                old[up] = np.take_along_axis(v, order, 1)
            low[up] = (back[0][up, -1] + 0.5) / UNIT - 1e-12
    fq, fp, fx, fy, fz = (np.concatenate(v) for v in zip(*kept, strict=True))
    del kept
    bp, slot = np.nonzero(back[1] >= 0)
    bx, bq, by, bz = (v[bp, slot] for v in back)
    forward, backward = fq.astype(np.int64) * n + fp, bq.astype(np.int64) * n + bp
    also = np.isin(forward, backward)
    extra = ~np.isin(backward, forward)
    fq, fp, fx, fy, fz = (np.concatenate([f, v[extra].astype(np.int32)]) for f, v in ((fq, bq), (fp, bp), (fx, bx), (fy, by), (fz, bz)))
    is_forward, is_back = np.arange(len(fq)) < len(also), np.concatenate([also, np.ones(len(fq) - len(also), bool)])
    for j in range(0, len(fq), CHUNK):
        c = slice(j, j + CHUNK)
        columns = [s1[fq[c]], src[fp[c]], ids[fp[c]], fx[c], fy[c], fz[c], is_forward[c], is_back[c]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["s1", "src", "id", "name_u", "addr_u", "combo_u", "forward", "back"])


SCHEMA = "s1 long, src int, id long, name_u int, addr_u int, combo_u int, forward boolean, back boolean"


def join(k: int, back_k: int, least: int, shared) -> Callable[[Batches], Batches]:
    """For ``mapInArrow``, over rows sorted by cell.  ``shared``: a broadcast of the trigrams' idf by country."""

    def run(batches: Batches) -> Batches:
        idf, cell, held = shared.value, None, []
        for b in batches:
            names = b.column("cell")
            cuts = pc.indices_nonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1))).to_pylist() if len(names) > 1 else []
            cuts = [0, *(c + 1 for c in cuts), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if (now := names[lo].as_py()) != cell and held:
                    yield from _joined(pa.Table.from_batches(held), k, back_k, least, idf)
                    held = []
                cell = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from _joined(pa.Table.from_batches(held), k, back_k, least, idf)

    return run
