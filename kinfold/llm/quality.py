"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger stores the measurements and one bit for
each rule that failed.  A policy is a version with the set of rules that it applies, so other
policies and ablations are bitwise operations on the ledger and never read the texts again.

All of it is JVM-side and row-local: no shuffle, no Python.  Repeated word windows are found inside the row
by sorting (hash, position) pairs, so a document of n words costs n log n and never meets another.

Defined results: a null text has no words and no lines; it fails ``few_words``.  Rows are judged one by one, so
repeated rows and null ids change nothing; extra columns of the input are ignored by ``ledger`` and kept by ``apply``.
Windows are compared by a 64-bit hash of their three words, inside one document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, fresh, text_of, words_of

#: Bit of each rule, and when it fails, over the measurements.  Bits are never reused.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "duplicate_lines": (3, "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 25 * n_words"),
}
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "2026-1": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words"),
}
DEFAULT_POLICY = "2026-1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _measured(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with a struct of the measurements, in steps so that no array is made twice."""
    t, words, lines, grams, pairs, at = fresh(docs, "text", "words", "lines", "grams", "pairs", "at")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    nothing = F.array().cast("array<bigint>")
    d = docs.select(*keep, text_of(f"`{text}`").alias(t))
    # Lines with a word, and the words.
    d = d.select(
        *keep,
        t,
        words_of(F.col(t)).alias(words),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "").alias(lines),
    )
    d = d.select(
        *keep,
        F.size(words).cast("long").alias(f"{words}_n"),
        F.length(F.array_join(words, "")).cast("long").alias(f"{words}_c"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias(f"{t}_s"),
        F.size(lines).cast("long").alias(f"{lines}_n"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{lines}_d"),
        F.when(
            F.size(words) >= 3,
            F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.size(words) - 2),
        )
        .otherwise(nothing)
        .alias(grams),
    )
    counts = [f"{words}_n", f"{words}_c", f"{t}_s", f"{lines}_n", f"{lines}_d"]
    # Windows that occur twice lie next to each other once sorted; rows without one skip the sort.
    d = d.select(
        *keep,
        *counts,
        F.when(
            F.size(grams) > F.size(F.array_distinct(grams)),
            F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ).alias(pairs),
    )
    same = lambda e, j: (F.get(pairs, j - 1)["h"] == e["h"]) | (F.get(pairs, j + 1)["h"] == e["h"])
    d = d.select(*keep, *counts, F.sort_array(F.transform(F.filter(pairs, lambda e, j: F.coalesce(same(e, j), F.lit(False))), lambda e: e["p"])).alias(at))
    # A window covers three words; where the next one starts sooner, only those before it are new.
    covered = F.aggregate(
        F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    n, c, s, ln, ld = counts
    return d.select(
        *keep,
        F.struct(
            F.col(n).alias("n_words"),
            F.col(c).alias("word_chars"),
            F.col(s).alias("n_symbols"),
            F.col(ln).alias("n_lines"),
            F.col(ld).alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        ).alias(out),
    )


def _fails(measured: str) -> Column:
    """The failure bits, from the struct of measurements."""
    mask = F.lit(0).cast("long")
    for bit, rule in RULES.values():
        expr = rule
        for m in sorted(MEASURES, key=len, reverse=True):
            expr = expr.replace(m, f"@{MEASURES.index(m)}@")
        for i, m in enumerate(MEASURES):
            expr = expr.replace(f"@{i}@", f"`{measured}`.{m}")
        mask = mask.bitwiseOR(F.when(F.expr(expr), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return mask


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``fail_bits``."""
    (m,) = fresh(docs, "m")
    d = _measured(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), text, m)
    return d.select(F.col(f"`{id_col}`"), *[F.col(f"`{m}`.{x}").alias(x) for x in MEASURES], _fails(m).alias("fail_bits"))


def rejected_by(fail_bits: Column, policy: str = DEFAULT_POLICY) -> Column:
    return fail_bits.bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) != 0


def apply(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The documents that ``policy`` keeps, with all their columns.

    The verdict drops rows as an empty array does in ``explode``: a filter would be pushed below the steps of
    ``_measured``, and its copies of them evaluated anew for every word.
    """
    m, one = fresh(docs, "m", "one")
    kept = F.when(~rejected_by(_fails(m), policy), F.array(F.lit(True)))
    d = _measured(docs, text, m)
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(kept).alias(one)).drop(one)


def ablation(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """What each rule of ``policy`` does, from the ledger alone: documents that fail it, and those that only it rejects.

    The ledger is first counted by its bits, of which there are at most 2^rules, so what is
    shuffled doesn't grow with the corpus.
    """
    mask = mask_of(POLICIES[policy])
    by_bits = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).count()
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    x = by_bits.select("bits", "count", rules.alias("r")).select("bits", "count", "r.rule", "r.bit")
    return x.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only"),
    )
