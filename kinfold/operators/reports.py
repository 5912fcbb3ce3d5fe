"""Profiles of records, truth, candidates and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.text import joined, mapped, simple_norm
from .decide import KEYS, f05


def share(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def quality(rec: DataFrame) -> DataFrame:
    """Rows, empty fields, mean lengths and addresses with a number, for each source and country."""
    return rec.groupBy("src", "cty").agg(
        F.count(F.lit(1)).alias("n_rows"), share(F.col("name") == "").alias("name_empty"), share(F.col("addr") == "").alias("addr_empty"),
        F.avg(F.length("name")).alias("name_len"), F.avg(F.length("addr")).alias("addr_len"), share(F.col("addr").rlike("[0-9]")).alias("has_number"),
    )


def truth_sanity(rec: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs whose ends are missing or lie in different countries."""
    a = rec.where("src = 1").select(F.col("id").alias("s1"), F.col("cty").alias("c1"))
    b = rec.where("src <> 1").select("src", "id", F.col("cty").alias("c2"))
    x = truth.join(a, "s1", "left").join(b, ["src", "id"], "left")
    n = lambda c: F.count(F.when(c, 1))
    return x.groupBy("src").agg(F.count(F.lit(1)).alias("pairs"), n(F.col("c1").isNull()).alias("no_first"), n(F.col("c2").isNull()).alias("no_other"), n(F.col("c1") != F.col("c2")).alias("cross_country"))


def matches_per_record(rec: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of first-source records without a match, and percentiles of their number, by country."""
    m = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("m"))
    x = rec.where("src = 1").select(F.col("id").alias("s1"), "cty").join(m, "s1", "left").fillna(0, ["m"])
    return x.groupBy("cty").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("m") == 0).alias("singleton"), F.avg("m").alias("mean_m"),
        F.percentile("m", F.lit(0.5)).alias("p50"), F.percentile("m", F.lit(0.99)).alias("p99"), F.max("m").alias("max_m"),
    )


def unseen_countries(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.select("cty").distinct().join(train.select("cty").distinct(), "cty", "left_anti")


def flags(norm: DataFrame) -> DataFrame:
    """Shares of the normalisation flags by source and country."""
    names = ["name_nonlatin", "is_handle", "name_phone", "addr_nonlatin", "addr_empty", "has_landmark"]
    extra = [share(F.col("legal") != "").alias("has_legal"), share(F.col("addr_state") != "").alias("has_state"), share(F.size("addr_nums") > 0).alias("has_number"), share(F.col("name_alias").isNotNull()).alias("has_alias")]
    return norm.groupBy("src", "cty").agg(*[share(F.col(n)).alias(n) for n in names], *extra)


def top_tokens(rec: DataFrame, column: str, n: int = 40, skip_digits: bool = True) -> DataFrame:
    """The most frequent words by country; ties by the word."""
    t = rec.select("cty", F.explode(F.split(column, " ")).alias("t")).where("t <> ''")
    if skip_digits:
        t = t.where(~F.col("t").rlike("[0-9]"))
    c = t.groupBy("cty", "t").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("cty").orderBy(F.desc("n"), "t"))).where(F.col("rank") <= n)


def similarity_percentiles(pairs: DataFrame, similarity: Column, kind: str) -> DataFrame:
    """Percentiles of a similarity over pairs that already carry both records' columns."""
    at = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95]
    p = F.percentile("v", F.array(*[F.lit(x) for x in at]))
    x = pairs.select(similarity.alias("v")).agg(F.count("v").alias("n"), p.alias("p"))
    return x.select(F.lit(kind).alias("kind"), "n", *[F.col("p")[i].alias(f"p{round(100 * a):02d}") for i, a in enumerate(at)])


def recall_at_k(candidates: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20, 30)) -> DataFrame:
    """Share of true pairs that each blocker has among its first k."""
    x = truth.join(candidates, KEYS, "left")
    total = F.count(F.lit(1))
    cells = [F.struct(F.lit(b).alias("blocker"), F.lit(k).alias("k"), (F.count(F.when(F.col(c) < k, 1)) / total).alias("recall")) for b, c in (("name", "r_name"), ("addr", "r_addr"), ("combo", "r_combo"), ("rev", "q_rev")) for k in ks]
    return x.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def recall_by_cap(candidates: DataFrame, truth: DataFrame, universe: DataFrame, caps: tuple[int, ...] = (1, 3, 5, 10, 20, 30)) -> DataFrame:
    """Recall, best reachable F0.5 and list sizes for each cap on the position.

    Per record the counts under all caps are conditional sums of one pass.
    """
    hit = candidates.join(truth.withColumn("hit", F.lit(1)), KEYS, "left")
    per = hit.groupBy("s1").agg(*[F.count(F.when((F.col("pos") < c) & F.col("hit").isNotNull(), 1)).alias(f"a{c}") for c in caps], *[F.count(F.when(F.col("pos") < c, 1)).alias(f"n{c}") for c in caps])
    t = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("t"))
    x = universe.select("s1").join(per, "s1", "left").join(t, "s1", "left").fillna(0)
    cells = [F.struct(F.lit(c).alias("cap"), F.try_divide(F.sum(f"a{c}"), F.sum("t")).alias("recall"), F.avg(f05(F.col("t"), F.col(f"a{c}"), F.col(f"a{c}"))).alias("ceiling"), F.avg(f"n{c}").alias("mean_size")) for c in caps]
    return x.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def recall_by_group(candidates: DataFrame, truth: DataFrame, rec: DataFrame) -> DataFrame:
    a = rec.where("src = 1").select(F.col("id").alias("s1"), "cty")
    x = truth.join(candidates.select(*KEYS, F.lit(1).alias("hit")), KEYS, "left").join(a, "s1")
    return x.groupBy("cty", "src").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("hit").isNotNull().cast("double")).alias("recall"))


def missed_pairs(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.join(candidates, KEYS, "left_anti")


def top_scores(candidates: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """Percentiles of the best score of records with and without a match."""
    best = candidates.groupBy("s1").agg(F.max("max_score").alias("m"))
    has = truth.select("s1").distinct().withColumn("matched", F.lit(True))
    x = universe.select("s1").join(best, "s1").join(has, "s1", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    p = F.percentile("m", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return x.groupBy("matched").agg(F.count(F.lit(1)).alias("n"), p.alias("p")).select("matched", "n", *[F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def auc(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Area under the curve of each feature alone, by average ranks.

    Rank sums come from counts by distinct value, so ties cost nothing and a feature is never sorted row by row.
    """
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("z")).select(label, "z.*").where("x is not null")
    v = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("feature").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("rank", before + (F.col("n") + 1) / 2)
    g = v.groupBy("feature").agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("np"), F.sum(F.col("n") - F.col("pos")).alias("nn"))
    return g.select("feature", F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn")).alias("auc"))


def siblings(rec: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether first-source records with a look-alike are matched less often: rates by kind of look-alike."""
    m = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("m"))
    legal, family = L.LEGAL, L.FAMILY
    inside = lambda words: lambda t: F.array_contains(F.array(*[F.lit(w) for w in words]), t)
    outside = lambda words: lambda t: ~F.array_contains(F.array(*[F.lit(w) for w in words]), t)
    x = rec.where("src = 1").select(F.col("id").alias("s1"), "cty", simple_norm(F.col("name")).alias("n"), simple_norm(F.col("addr")).alias("a")).join(m, "s1", "left").fillna(0, ["m"])
    tok = F.split("n", " ")
    x = x.select(
        "s1", "cty", "m", joined(F.filter(tok, outside(legal))).alias("core"), joined(F.array_sort(F.array_distinct(mapped(F.filter(tok, inside(legal)), L.CONTEXT_LEGAL)))).alias("lg"),
        joined(F.filter(tok, outside(legal + family))).alias("base"), F.size(F.filter(tok, inside(family))).alias("nfam"),
        F.trim(F.regexp_replace(F.regexp_replace("a", r"\b[0-9]+\w*\b", " "), r"\s+", " ")).alias("street"),
    )
    by_core = x.where("core <> ''").groupBy("cty", "core").agg(F.count(F.lit(1)).alias("n_core"), F.countDistinct("lg").alias("n_lg"))
    by_street = x.where("street <> ''").groupBy("cty", "street").agg(F.count(F.lit(1)).alias("n_street"), F.countDistinct("core").alias("n_names"))
    by_base = x.groupBy("cty", "base").agg(F.max(((F.col("nfam") == 0) & (F.col("base") != "")).cast("int")).alias("has_plain"), F.max((F.col("nfam") > 0).cast("int")).alias("has_fam"))
    x = x.join(by_core, ["cty", "core"], "left").join(by_street, ["cty", "street"], "left").join(by_base, ["cty", "base"], "left").fillna(1, ["n_core", "n_lg", "n_street", "n_names"])
    legal_sib, street_sib = (F.col("n_core") > 1) & (F.col("n_lg") > 1), (F.col("n_street") > 1) & (F.col("n_names") > 1)
    fam = F.when((F.col("nfam") > 0) & (F.col("has_plain") == 1), "extra family word").when((F.col("nfam") == 0) & (F.col("has_fam") == 1), "plain base").otherwise("none")
    size = F.when(F.col("n_core") == 1, "1").when(F.col("n_core") == 2, "2").when(F.col("n_core") <= 5, "3-5").otherwise("6+")
    side = F.when(~legal_sib, "no sibling").when(F.col("lg") == "", "without legal form").otherwise("with legal form")
    kinds = {"core_group": size, "legal_sib": legal_sib.cast("string"), "legal_side": side, "family": fam, "street_sib": street_sib.cast("string"), "any": (legal_sib | street_sib | (fam != "none")).cast("string")}
    long = x.select("cty", "m", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("z")).select("cty", "m", "z.*")
    return long.groupBy("kind", "value", "cty").agg(F.count(F.lit(1)).alias("n"), share(F.col("m") == 0).alias("singleton"), share(F.col("m") == 1).alias("one_match"), F.avg("m").alias("mean_m"))


def orphans(scores: DataFrame, truth: DataFrame, rec: DataFrame, score: str = "p") -> DataFrame:
    """Expected and observed share of other-source records that someone owns."""
    n = rec.where("src <> 1").agg(F.count(F.lit(1)).alias("n"))
    hit = scores.join(truth, KEYS).agg(share(F.col(score) > 0.5).alias("hit"))
    pairs = truth.agg(F.count(F.lit(1)).alias("t"))
    seen = scores.groupBy("src", "id").agg(F.max(score).alias("m")).agg(F.count(F.when(F.col("m") > 0.5, 1)).alias("seen"))
    # One row each.
    return n.crossJoin(hit).crossJoin(pairs).crossJoin(seen).select((F.col("t") / F.col("n") * F.col("hit")).alias("expected"), (F.col("seen") / F.col("n")).alias("observed"))


def examples(rec: DataFrame, truth: DataFrame, n: int = 4) -> DataFrame:
    """``n`` groups of each country, chosen by a digest of their owner, with the records of all members."""
    first = rec.where("src = 1").select(F.col("id").alias("s1"), "cty")
    owners = truth.select("s1").distinct().join(first, "s1")
    at = F.row_number().over(Window.partitionBy("cty").orderBy(F.md5(F.concat(F.lit("group:"), F.col("s1").cast("string")).cast("binary"))))
    chosen = owners.withColumn("_n", at).where(F.col("_n") <= n).select("cty", "s1")
    members = chosen.join(truth, "s1").select("s1", "src", "id").unionByName(chosen.select("s1", F.lit(1).alias("src"), F.col("s1").alias("id")))
    return members.join(rec.select("src", "id", "cty", "name", "addr"), ["src", "id"])


def decoys(rec: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of other-source records that belong to nobody."""
    owned = truth.select("src", "id").distinct().withColumn("owned", F.lit(True))
    x = rec.where("src <> 1").join(owned, ["src", "id"], "left")
    return x.groupBy("src").agg(F.count(F.lit(1)).alias("n"), share(F.col("owned").isNull()).alias("decoy"))


def agreement(pairs: DataFrame) -> DataFrame:
    """How often both sides of a pair have numbers, share one, lie in one state, and have equal names; ``pairs`` carry both records' columns."""
    numbers = [F.regexp_extract_all(F.col(f"addr_{k}"), F.lit("[0-9]+"), 0) for k in (1, 2)]
    both = (F.size(numbers[0]) > 0) & (F.size(numbers[1]) > 0)
    return pairs.groupBy("src").agg(
        F.count(F.lit(1)).alias("pairs"), share(both).alias("both_numbers"), F.avg(F.when(both, F.arrays_overlap(*numbers).cast("double"))).alias("shared_number"),
        share(F.col("st_1") == F.col("st_2")).alias("same_state"), share(F.col("name_1") == F.col("name_2")).alias("same_name"), share(F.col("addr_2") == "").alias("addr_empty"),
    )


def outcome_by_count(judged: DataFrame, top: int = 8) -> DataFrame:
    """Mean F0.5, wrong and missed pairs by the number of true matches; ``top`` stands for that many or more."""
    return judged.groupBy(F.least("t", F.lit(top)).alias("true_count")).agg(
        F.avg("f").alias("f05"), F.count(F.lit(1)).alias("n"), F.sum(F.col("k") - F.col("a")).alias("wrong"), F.sum(F.col("t") - F.col("a")).alias("missed")
    )


def outcome_by_country(judged: DataFrame) -> DataFrame:
    """Mean F0.5, precision and recall of pairs by country."""
    return judged.groupBy("cty").agg(
        F.avg("f").alias("f05"), F.count(F.lit(1)).alias("n"), F.try_divide(F.sum("a"), F.sum("k")).alias("precision"), F.try_divide(F.sum("a"), F.sum("t")).alias("recall")
    )
