import re

from kinfold.llm import quality

from .helpers import documents, empty

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen: dict = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    covered = {p + k for places in seen.values() if len(places) > 1 for p in places for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark):
    docs = documents(spark)
    got = sorted((tuple(r) for r in quality.ledger(docs).select("doc_id", *quality.MEASURES).collect()), key=str)
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)
    assert got == want


def test_policy_bits_and_base(spark):
    rows = {r.doc_id: r for r in quality.ledger(documents(spark, null_ids=False, repeat=False)).collect()}
    for r in rows.values():
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert bool(r.fail_bits & quality.mask_of(quality.BASE)) == base
    assert rows[10].fail_bits & quality.mask_of(("few_words",)) == 0


def test_apply_keeps_all_columns_and_ledger_verdict(spark):
    docs = documents(spark, ["w%d " % i * 2 + " ".join(f"x{j}y{i}" for j in range(60)) for i in range(3)] + ["short"])
    kept = quality.apply(docs)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality.ledger(docs).collect() if r.fail_bits == 0}
    assert {r.doc_id for r in kept.collect()} == good == {0, 1, 2, None}


def test_ablation_counts_from_bits(spark):
    entries = quality.ledger(documents(spark))
    rows = entries.collect()
    mask = quality.mask_of(quality.POLICIES[quality.DEFAULT_POLICY])
    for r in quality.ablation(entries).collect():
        bit = quality.mask_of((r["rule"],))
        assert r["n_failed"] == sum(bool(x.fail_bits & bit) for x in rows)
        assert r["n_only"] == sum(x.fail_bits & mask == bit for x in rows)


def test_empty_table(spark):
    assert quality.ledger(empty(spark)).count() == 0
    assert quality.apply(empty(spark)).count() == 0
