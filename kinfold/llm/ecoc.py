"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1.  For each bit a binary classifier over hashed byte trigrams tells the languages
with +1 from those with -1: the weights are log-odds of the trigram frequencies of both sides, each language counting alike,
and a logistic curve fitted on the sample turns a text's mean weight into the bit's margin.  Decoding is
loss-weighted: a language's loss is the sum over bits of weight * log(1 + exp(-bit * margin)), with
the weight log((1 - error) / error) of the bit's error on the sample; the nearest codeword wins.  The result is
flagged ambiguous where the two nearest codewords are about equally near.

Up to six languages get all distinct splits as bits; more get the best of seeded random codes.  The classifiers are fitted on a
sample of ``sample`` labelled documents for each language, in expectation; the n-gram counts are summed on the executors.
Prediction is one pass over whole texts without a shuffle, in blocks, so a long text needs no more memory.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was learned; one learned language is
predicted for every other text; where the two nearest codewords tie exactly, ``predict`` gives the first language in the order of names and
flags it, and ``keep_known`` rejects it; ids may be null or repeat, and rows with a null id are not learned from; an empty table
gives an empty result; further columns are ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Labelled documents to learn from, for each language.
SAMPLE = 2000
BUCKETS = 1 << 16
BLOCK = 1 << 20
SMOOTHING = 0.5
AMBIGUOUS = 0.1
UNKNOWN = "und"
_ALL_SPLITS = 6

_table = np.zeros(256, np.uint8)
_table[ord("a") : ord("z") + 1] = np.arange(1, 27)
_table[0x80:] = np.arange(0x80, 0x100)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all byte trigrams of the lower-cased text between two spaces; other ASCII is a space."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(raw) - 2, BLOCK):
        b = _table[raw[at : at + BLOCK + 2]].astype(np.uint32)
        code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        code *= np.uint32(2654435761)
        yield code >> np.uint32(16)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1; every bit splits the languages, and no two rows are alike."""
    if n <= _ALL_SPLITS:
        rows = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(rows, np.int8).reshape(-1, n).T
    bits, best = max(15, int(np.ceil(10 * np.log2(n)))), None
    for seed in range(50):
        m = np.random.default_rng(seed).choice(np.array([1, -1], np.int8), (n, bits))
        m = m[:, np.abs(m.sum(0, dtype=int)) < n]
        agree = m.astype(int) @ m.T
        np.fill_diagonal(agree, -m.shape[1])
        gap = m.shape[1] - agree.max()
        if best is None or gap > best[0]:
            best = (gap, m)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray | None
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def means(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for idx in trigrams(text):
            total += self.weights.take(idx, axis=0).sum(0, dtype=np.float64)
            n += len(idx)
        return total / max(n, 1)

    def decide(self, means: np.ndarray) -> tuple[str, float, float]:
        """The nearest language, its share, and by how much it leads."""
        margin = self.slope * means + self.offset
        loss = (self.trust * np.logaddexp(0, -self.code * margin)).sum(1) / self.trust.sum()
        p = np.exp(-(loss - loss.min()) * self.code.shape[1])
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.languages[order[0]], float(p[order[0]]), float(p[order[0]] - p[order[1]])

    def predict(self, text: str | None) -> tuple[str, float, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 1.0
        return self.decide(self.means(text))


def learnable(docs: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    """id, t and lang of the documents that may be learned from."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("lang"))
    return d.where(F.col("t").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))


def held_out(id_col):
    """Documents that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for t, lang in zip(b.column("t"), b.column("lang"), strict=True):
            c = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
            for idx in trigrams(t.as_py()):
                c += np.bincount(idx, minlength=BUCKETS)
    for lang, c in sums.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype("i4")), pa.array(c[at])], ["lang", "bucket", "n"])


def _mean_rows(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means = [model.means(t.as_py()) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(means, pa.list_(pa.float64()))], ["lang", "means"])

    return run


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps on the standardised value."""
    mu, sd = np.average(x, weights=w), x.std() or 1.0
    z = np.stack([(x - mu) / sd, np.ones_like(x)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-3 * w.sum()
        step = np.linalg.solve(h, z.T @ (w * (y - p)) - 1e-3 * w.sum() * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta[0] / sd, beta[1] - beta[0] * mu / sd


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` documents of each language, chosen by a hash of their ids."""
    d = learnable(docs, id_col, text, lang)
    sizes = d.groupBy("lang").count().select(F.col("lang").alias("_lang"), (F.lit(float(sample)) / F.col("count")).alias("share"))
    # Written first: the planner then knows the size of this table, and broadcasts it only below the session's threshold.
    sizes, _ = cut(sizes, "languages", 1)
    u = F.pmod(F.xxhash64("id", F.lit("ecoc")), F.lit(1 << 30)) / float(1 << 30)
    chosen = d.join(sizes, F.col("lang") == F.col("_lang")).where(u < F.col("share")).select("t", "lang")
    counts = chosen.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), 0)), None, np.zeros(0), np.zeros(0), np.zeros(0))
    code = codewords(len(languages))
    freq = np.zeros((len(languages), BUCKETS))
    for i, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        freq[i, own["bucket"]] = own["n"]
    freq /= freq.sum(1, keepdims=True)
    floor = SMOOTHING / max(counts["n"].sum(), 1)
    plus, minus = (code == 1).T.astype(float), (code == -1).T.astype(float)
    log = [np.log(side / side.sum(1, keepdims=True) @ freq + floor) for side in (plus, minus)]
    n_bits = code.shape[1]
    model = Model(languages, code, np.ascontiguousarray((log[0] - log[1]).T.astype(np.float32)), np.ones(n_bits), np.zeros(n_bits), np.ones(n_bits))
    rows = chosen.mapInArrow(_mean_rows(model), "lang string, means array<double>").toPandas()
    x = np.stack(rows["means"].to_numpy())
    who = rows["lang"].map({n: i for i, n in enumerate(languages)}).to_numpy()
    balance = 1 / np.bincount(who, minlength=len(languages))[who]
    for k in range(n_bits):
        y = (code[who, k] == 1).astype(float)
        w = balance / balance.sum() * len(who)
        model.slope[k], model.offset[k] = _curve(x[:, k], y, w)
        error = np.average((model.slope[k] * x[:, k] + model.offset[k] > 0) != (y > 0), weights=w)
        error = min(max(error, 1e-3), 0.499)
        model.trust[k] = np.log((1 - error) / error)
    return model


def _predictor(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for b in batches:
            got = [(lang, score, lead < AMBIGUOUS) for lang, score, lead in (model.predict(t.as_py()) for t in b.column("t"))]
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            rest = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, *columns], [*b.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, ambiguous; from the text alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"))
    out = d.mapInArrow(_predictor(shared), f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)


def _verdicts(shared) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(**shared.value)
        for s in batches:
            got = [model.predict(t) for t in s]
            yield pd.Series([lang != UNKNOWN and (lead > 0 or score == 1.0) for lang, score, lead in got], dtype=bool)

    return run


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that have a language, and not two that tie for it exactly, with all their columns."""
    (ok,) = fresh(docs, "known")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    udf = F.pandas_udf(_verdicts(shared), "boolean")  # type: ignore[call-overload]
    return docs.withColumn(ok, udf(F.col(f"`{text}`"))).where(F.col(ok)).drop(ok)
