"""The whole linkage, from tab-separated sources to match lists: train on one split, match another.

A pair model scores candidates from their two records; a context model scores the pairs that survive pruning again, with
their lists, neighbours and rivals in view; an ensemble over seeds and folds scores them a third time with the second scores in view, and is
blended with them.  The rule that turns scores into lists is chosen on out-of-fold scores, its strictness for each country.
Words and towns learned from the true pairs and addresses of the training split normalise both splits.  Duplicates within a source can be pooled
before the rule is applied.
Every step is written once under a tag of its parameters and input files, so a run that was cut short goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocking, context, decide, learned, models, pairs, sampling, twins
from ..sources import tables, tsv

KEYS = decide.KEYS
RECORD = [
    "name_core", "name_sq", "name_alias", "legal", "addr_norm", "addr_state", "addr_nums", "addr_num1",
    "name_nonlatin", "is_handle", "name_phone", "addr_nonlatin", "addr_empty", "has_landmark",
]
BLOCKERS = ["r_name", "s_name", "r_addr", "s_addr", "r_combo", "s_combo", "r_rev", "s_rev", "q_rev", "min_rank", "max_score", "nb", "pos"]
#: Seeds of the ensemble.
SEEDS = (42, 43, 44)
_NOT_FEATURES = {*KEYS, "cty", "fold", "label", "a_src", "a_id"}


class Split:
    """The steps of one split of one folder: ``{split}_source1.tsv`` to ``{split}_source3.tsv``."""

    def __init__(self, spark: SparkSession, folder: str, split: str, maps: str | None = None):
        """``maps``: a folder with the learned tables ``word_map`` and ``city_map``."""
        self.spark, self.maps = spark, maps
        self.paths = [f"{folder}/{split}_source{k}.tsv" for k in (1, 2, 3)]
        self.truth_path = f"{folder}/{split}_ground_truth.tsv"

    def _step(self, name: str, build: Callable[[], DataFrame], *more: str, **parameters: object) -> DataFrame:
        learnt = [f"{self.maps}/{m}" for m in ("word_map", "city_map")] if self.maps else []
        return tables.step(self.spark, f"link-{name}", build, *self.paths, *learnt, *more, **parameters)

    def raw(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [tsv.load_source(self.spark, p) for p in self.paths])

    def learn(self, out: str, min_count: int = 5, min_town: int = 20, min_state: int = 1000) -> None:
        """Count both maps from this split: words from the names of true pairs, towns from the addresses of the first source."""
        raw = self.raw()
        one = raw.where("src = 1").select(F.col("id").alias("s1"), F.col("name").alias("latin"))
        named = self.truth().join(raw.where("src <> 1").select("src", "id", F.col("name").alias("native")), ["src", "id"]).join(one, "s1")
        tsv.write_map(learned.word_map(named, "native", "latin", min_count), f"{out}/word_map")
        cities = learned.city_map(raw.where("src = 1"), "addr", min_town, min_state=min_state, plain=T.strip_all_marks)
        tsv.write_map(cities, f"{out}/city_map")

    def records(self) -> DataFrame:
        def build() -> DataFrame:
            raw = self.raw().withColumn("addr", T.replace_states(F.col("addr")))
            if self.maps:
                raw = learned.apply_word_map(raw, "name", tsv.read_map(self.spark, f"{self.maps}/word_map", "x string, y string"))
                raw = learned.apply_city_map(raw, "addr", tsv.read_map(self.spark, f"{self.maps}/city_map", "city string, state string"), "src", "id")
            return T.normalize_records(T.transliterate(T.transliterate(raw, "name"), "addr", only_without_latin=True))

        return self._step("records", build)

    def view(self) -> DataFrame:
        """The records as blocking and context operators take them."""
        return self.records().select("id", "src", "cty", F.col("name_core").alias("name"), F.col("addr_norm").alias("addr"), F.col("addr_state").alias("st"))

    def universe(self) -> DataFrame:
        return self.view().where("src = 1").select(F.col("id").alias("s1"), "cty", sampling.fold(F.col("id")).alias("fold"))

    def truth(self) -> DataFrame:
        return tsv.load_truth(self.spark, self.truth_path)[1]

    def candidates(self) -> DataFrame:
        def build() -> DataFrame:
            return blocking.candidates(blocking.record_similarities(self.view(), state="st"))

        return self._step("candidates", build, top=blocking.TOP, reverse=blocking.REVERSE_TOP, cap=blocking.CAP, max_df=blocking.MAX_DF, least=blocking.MIN_SIM)

    def pair_frame(self) -> DataFrame:
        """Candidates with country, fold and the pair features."""

        def build() -> DataFrame:
            cand, rec = self.candidates(), self.view()
            x = pairs.with_records(cand, self.records(), RECORD)
            x = x.select(*KEYS, "cty", F.col("src").cast("double").alias("src_no"), *BLOCKERS, *pairs.set_features(x), *pairs.string_features(x))
            for column, pre in (("name", "nm"), ("addr", "ad")):
                x = x.join(pairs.weighted_jaccard(cand, rec, column, pairs.rarity(rec, column), pre), KEYS, "left")
            return x.withColumn("fold", sampling.fold(F.col("s1")))

        return self._step("pair-features", build, cap=blocking.CAP)

    def context_frame(self, scored: DataFrame) -> DataFrame:
        """Scored pairs (KEYS, cty, fold, p) with the context features."""
        rec, keys = self.view(), scored.select(*KEYS)
        freq = context.frequencies(rec).drop("cty")
        names = [c for c in freq.columns if c not in ("src", "id")]
        first = freq.where("src = 1").select(F.col("id").alias("s1"), *[F.col(c).alias(f"{c}_1") for c in names])
        other = freq.where("src <> 1").select("src", "id", *[F.col(c).alias(f"{c}_2") for c in names])
        both = pairs.with_records(keys, self.records(), RECORD)
        grouped = context.group_features(scored)
        x = grouped.join(first, "s1", "left").join(other, ["src", "id"], "left")
        more = [
            both.select(*KEYS, *pairs.number_features()), context.anchor_similarity(grouped, rec), context.word_differences(keys, rec, context.sibling_words(rec)),
            context.rivals(keys, rec), context.rival_addresses(keys, rec),
        ]
        return reduce(lambda a, b: a.join(b, KEYS, "left"), more, x)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in _NOT_FEATURES]


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def third_frame(context_frame: DataFrame, scored: DataFrame) -> DataFrame:
    """The context features with the view over the second score ``pb``."""
    return context_frame.join(context.score_features(scored.select(*KEYS, "p", "pb")).drop("p"), KEYS)


def choose_blend(blended: DataFrame) -> tuple[float, float, list[tuple[str | None, float, float]]]:
    """(weight, mean F0.5, rows (cty, w, v)) of the best blend, with the strictness of each country and, under a null country, the default.

    ``blended`` has a row for each weight, strictness and country, so what comes to the driver grows with the countries alone.
    """
    best = decide.best_strictness(blended)
    per = best.groupBy("w").agg((F.sum(F.col("f05") * F.col("n")) / F.sum("n")).alias("dev")).orderBy(F.desc(F.round("dev", 9)), "w").first()
    plain = blended.where("w = 0").groupBy("v").agg((F.sum(F.col("f05") * F.col("n")) / F.sum("n")).alias("dev")).orderBy(F.desc(F.round("dev", 9)), "v").first()
    rows = [(r.cty, float(per.w), float(r.v)) for r in best.where(F.col("w") == per.w).collect()]
    return per.w, per.dev, [*[r for r in rows if r[0] is not None], (None, float(per.w), float(plain.v))]


def train(
    spark: SparkSession, folder: str, out: str, split: str = "train", rounds: int = 20, depth: int = 5, seeds: tuple[int, ...] = SEEDS, min_count: int = 5, min_town: int = 20, min_state: int = 1000,
) -> DataFrame:
    """Learn the maps, fit the three models and choose the rule; all go under ``out``.  Returns the table of rules with their scores in and out of the holdout.

    The second and third model learn at a lower rate than the first.  Every model stops early by the fold that it leaves out.
    """
    Split(spark, folder, split).learn(out, min_count, min_town, min_state)
    s = Split(spark, folder, split, out)
    truth, universe = s.truth(), s.universe()
    a = pairs.label(s.pair_frame(), truth)
    cols = feature_columns(a)
    fitted = models.fit_folds(a, cols, rounds=rounds, depth=depth, rate=0.1)
    models.save(fitted, f"{out}/pair")
    scored = _written(models.out_of_fold(a, cols, fitted, "p").select(*KEYS, "cty", "fold", "p"), f"{out}/pair-scores")
    b = _written(pairs.label(s.context_frame(context.prune(scored)), truth), f"{out}/context-features")
    cols = feature_columns(b)
    fitted = models.fit_folds(b, cols, rounds=rounds, depth=depth, rate=0.06)
    models.save(fitted, f"{out}/context")
    second = _written(models.out_of_fold(b, cols, fitted, "pb").select(*KEYS, "cty", "fold", "p", "pb"), f"{out}/context-scores")
    c = _written(third_frame(b, second), f"{out}/ensemble-features")
    cols = feature_columns(c)
    fitted = models.fit_folds(c, cols, seeds, rounds, depth, rate=0.06)
    models.save(fitted, f"{out}/ensemble")
    final = _written(models.out_of_fold(c, cols, fitted, "pc").select(*KEYS, "cty", "fold", "p", "pb", "pc"), f"{out}/scores")
    rules = decide.tune(final, "pb", universe, truth)
    blended = _written(decide.blend(final, "pb", "pc", universe, truth), f"{out}/blends")
    w, dev, rows = choose_blend(blended)
    rules = _written(rules.unionByName(spark.createDataFrame([("blend", float(w), float(dev), None)], "kind string, v double, dev double, holdout double")), f"{out}/rules")
    # Fifteen rows; ties go to the name and the smaller value.
    kind, v = rules.orderBy(F.desc(F.round("dev", 9)), "kind", "v").select("kind", "v").first()
    chosen = [(kind, *r) for r in rows] if kind == "blend" else [(kind, None, 0.0, v)]
    tsv.write_map(spark.createDataFrame(chosen, "kind string, cty string, w double, v double"), f"{out}/rule")
    return rules


def decided(scored: DataFrame, rule: DataFrame) -> DataFrame:
    """Match lists (KEYS, sc) from scores p, pb and pc by a stored rule (kind, cty, w, v)."""
    default = rule.where("cty IS NULL").first()
    x = scored.withColumn("sc", F.round(F.lit(default.w) * F.col("pc") + (1 - F.lit(default.w)) * F.col("pb"), 9))
    if default.kind == "thr":
        return decide.rule_simple(x, "sc", default.v)
    return decide.rule_by_country(x, "sc", rule.where("cty IS NOT NULL").select("cty", F.col("v").alias("g")), default.v)


def match(spark: SparkSession, folder: str, trained: str, out: str, split: str = "test", seeds: tuple[int, ...] = SEEDS, pool: str | None = None) -> DataFrame:
    """Match a split with trained models: writes ``matching_results`` and ``candidate_pairs``, and returns what is wrong with them.

    ``pool``: how scores of duplicates within a source are pooled, ``max`` or ``or``; None leaves them apart.
    """
    s = Split(spark, folder, split, trained)
    n = sampling.N_FOLDS
    x = s.pair_frame()
    scored = models.score(x, feature_columns(x), [m for _, m in models.load(f"{trained}/pair", n)], "p").select(*KEYS, "cty", "fold", "p")
    scored = _written(scored, f"{out}/pair-scores")
    y = _written(s.context_frame(context.prune(scored)), f"{out}/context-features")
    second = models.score(y, feature_columns(y), [m for _, m in models.load(f"{trained}/context", n)], "pb")
    second = _written(second.select(*KEYS, "cty", "p", "pb"), f"{out}/context-scores")
    z = _written(third_frame(y, second), f"{out}/ensemble-features")
    final = models.score(z, feature_columns(z), [m for _, m in models.load(f"{trained}/ensemble", n, len(seeds))], "pc")
    final = _written(final.select(*KEYS, "cty", "p", "pb", "pc"), f"{out}/scores")
    if pool:
        for c in ("pb", "pc"):
            pooled = twins.pool(final, twins.groups(s.view()), c, pool).select(*KEYS, F.col("p").alias("_q"))
            final = final.join(pooled, KEYS, "left").withColumn(c, F.coalesce("_q", F.lit(0.0))).drop("_q")
    rule = tsv.read_map(spark, f"{trained}/rule", "kind string, cty string, w double, v double")
    chosen = decided(final, rule)
    all_s1 = s.universe().select("s1")
    tsv.write(tsv.match_lists(all_s1, chosen, "sc"), f"{out}/matching_results")
    tsv.write(tsv.match_lists(all_s1, s.candidates(), "max_score", "candidate_entity_ids"), f"{out}/candidate_pairs")
    lists = tsv.scan(spark, f"{out}/matching_results", ["source1_entity_id", "matched_entity_ids"])
    allowed = tsv.scan(spark, f"{out}/candidate_pairs", ["source1_entity_id", "candidate_entity_ids"])
    return tsv.violations(lists, allowed, all_s1)
