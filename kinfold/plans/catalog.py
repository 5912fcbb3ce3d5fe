"""All linkage queries: the DataFrame plan, the columns that it returns, and the same question in SQL.

Columns are declared once for both sides as ``name:kind``: i whole number, d number rounded to six digits, s text, b boolean.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import similarity as S
from ..functions import text as T
from ..operators import blocking, context, decide, learned, models, pairs, reports, sampling, twins
from ..sources import tables, tsv
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


@dataclass
class Data:
    """The tables of one folder, and the steps that several queries share."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name)

    @property
    def rec(self) -> DataFrame:
        return self._step("records", lambda: tables.records(self.table("documents")), name_words=tables.NAME_WORDS, street_words=tables.STREET_WORDS)

    @property
    def truth(self) -> DataFrame:
        return tables.true_pairs(self.table("documents"))

    def _step(self, name: str, build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
        return tables.step(self.spark, name, build, f"{self.sf_dir}/documents.parquet", **parameters)

    @property
    def sims(self) -> DataFrame:
        return self._step("similarities", lambda: blocking.record_similarities(self.rec), **self._lists)

    @property
    def state_sims(self) -> DataFrame:
        return self._step("state-similarities", lambda: blocking.record_similarities(self.rec, state="st"), **self._lists)

    @property
    def _lists(self) -> dict[str, object]:
        return {"top": blocking.TOP, "reverse": blocking.REVERSE_TOP, "max_df": blocking.MAX_DF, "least": blocking.MIN_SIM}

    @property
    def cand(self) -> DataFrame:
        build = lambda: blocking.candidates(self.sims)
        return self._step("candidates", build, cap=blocking.CAP, **self._lists)

    @property
    def universe(self) -> DataFrame:
        return self.rec.where("src = 1").select(F.col("id").alias("s1"), "cty", sampling.fold(F.col("id")).alias("fold"))

    @property
    def pairs(self) -> DataFrame:
        p = F.least(F.greatest("max_score", F.lit(0.0)), F.lit(1.0))
        x = self.cand.select("s1", "src", "id", p.alias("p"), F.coalesce("s_combo", F.lit(0.0)).alias("pb")).join(self.universe, "s1")
        return pairs.label(x, self.truth)


_SPARK_TYPE = {"i": lambda c: c.cast("long"), "d": lambda c: F.round(c.cast("double"), 6), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
_SQL_TYPE = {"i": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6)", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}


def query(columns: str, ctes: list[str] | None = None, source: str | None = None) -> Callable:
    """Register a plan under its function's name; ``ctes`` and ``source`` make its SQL."""
    spec = [c.split(":") for c in columns.split()]

    def register(plan: Callable[[Data], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Data(spark, sf_dir)).select(*[_SPARK_TYPE[k](F.col(n)).alias(n) for n, k in spec])

        _QUERIES[plan.__name__] = run
        if source is not None:
            chosen = ", ".join(f"{_SQL_TYPE[k].format(n)} AS {n}" for n, k in spec)
            _ORACLES[plan.__name__] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + f"SELECT {chosen} FROM {source}"
        return plan

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# ------------------------------------------------------------------ records and samples


@query("id:i src:i cty:s name:s addr:s st:s", [Q.REC], "rec")
def records_view(d: Data) -> DataFrame:
    return d.rec


@query("doc_id:i n:s", [], r"(SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM documents)")
def simple_norm(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", T.simple_norm(F.col("text")).alias("n"))


@query(
    "src:i cty:s n_rows:i name_empty:d addr_empty:d name_len:d addr_len:d has_number:d", [Q.REC],
    """(SELECT src, cty, count(*) AS n_rows, avg(CAST(name = '' AS INT)) AS name_empty, avg(CAST(addr = '' AS INT)) AS addr_empty, avg(length(name)) AS name_len,
        avg(length(addr)) AS addr_len, avg(CAST(regexp_matches(addr, '[0-9]') AS INT)) AS has_number FROM rec GROUP BY src, cty)""",
)
def record_quality(d: Data) -> DataFrame:
    return reports.quality(d.rec)


@query("id:i src:i", [Q.REC], "rec WHERE id % 10000 < 2500")
def sample_mod(d: Data) -> DataFrame:
    return d.rec.where(sampling.in_sample(F.col("id"), 0.25))


@query(
    "id:i src:i", [Q.REC, Q.TRUTH],
    """(SELECT id, src FROM rec WHERE src = 1 AND id % 10000 < 2500
        UNION ALL SELECT r.id, r.src FROM rec r WHERE EXISTS (SELECT 1 FROM truth t WHERE t.src = r.src AND t.id = r.id AND t.s1 % 10000 < 2500)
        UNION ALL SELECT r.id, r.src FROM rec r WHERE r.src <> 1 AND r.id % 10000 < 2500 AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.src = r.src AND t.id = r.id))""",
)
def sample_groups(d: Data) -> DataFrame:
    return sampling.sample_groups(d.rec, d.truth, 0.25)


@query("o_orderkey:i", [], "orders WHERE (o_orderkey // 10000) % 10000 < 500")
def query_sample(d: Data) -> DataFrame:
    return d.table("orders").where(sampling.in_queries(F.col("o_orderkey"), 0.05))


@query("s1:i cty:s fold:i", [Q.REC, Q.UNIVERSE], "universe")
def fold_assign(d: Data) -> DataFrame:
    return d.universe


@query(
    "cty:s s1:i src:i id:i", [Q.REC, Q.TRUTH, Q.UNIVERSE,
    """tp AS (SELECT u.cty, t.* FROM truth t JOIN universe u ON t.s1 = u.s1),
    l AS (SELECT cty, s1, row_number() OVER (PARTITION BY cty ORDER BY md5(concat_ws(':', 'a', s1, src, id))) AS n FROM tp),
    r AS (SELECT cty, src, id, row_number() OVER (PARTITION BY cty ORDER BY md5(concat_ws(':', 'b', s1, src, id))) AS n FROM tp)"""],
    "(SELECT l.cty, s1, src, id FROM l JOIN r ON l.cty = r.cty AND l.n = r.n)",
)
def shuffled_partners(d: Data) -> DataFrame:
    return sampling.shuffled_partners(d.truth.join(d.universe, "s1"), "cty")


@query("doc_id:i lang:s", [], "(SELECT * FROM documents ORDER BY md5('sample:' || doc_id), doc_id LIMIT 100)")
def seeded_sample(d: Data) -> DataFrame:
    return sampling.seeded_sample(d.table("documents"), 100, "doc_id")


# ------------------------------------------------------------------ text


def _customers(d: Data) -> DataFrame:
    """Customers and suppliers as business records of two sources."""
    n = d.table("nation").select("n_nationkey", "n_name")
    c = d.table("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.lit(1).alias("src"), F.col("c_name").alias("name"), F.concat_ws(", ", F.col("c_mktsegment"), "n_name").alias("addr"), F.lit("us").alias("country"))
    s = d.table("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.lit(2).alias("src"), F.col("s_name").alias("name"), F.concat_ws(", ", F.col("s_nationkey").cast("string"), "n_name").alias("addr"), F.lit("us").alias("country"))
    return c.unionByName(s)


_BUSINESS = """raw AS (
  SELECT id, src, name, addr, 'france' AS country FROM rec
  UNION ALL SELECT c_custkey, 1, c_name, c_mktsegment || ', ' || n_name, 'us' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey, 2, s_name, CAST(s_nationkey AS VARCHAR) || ', ' || n_name, 'us' FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("src:i cty:s name_norm:s name_exp:s name_core:s name_sq:s name_alias:s legal:s addr_norm:s addr_state:s addr_num1:s name_nonlatin:b is_handle:b name_phone:b addr_nonlatin:b addr_empty:b has_landmark:b id:i", [Q.REC, _BUSINESS, Q.normalized("raw")], "norm")
def normalized_records(d: Data) -> DataFrame:
    docs = d.rec.select("id", "src", "name", "addr", F.lit("france").alias("country"))
    return T.normalize_records(docs.unionByName(_customers(d)))


_STOP = ", ".join(f"'{w}'" for w in L.LEGAL + L.WEAK + L.NAME_STOP)
_NAME_CASE = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.NAME_WORDS.items()) + " ELSE w END"
_ADDR_CASE = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.ADDRESS_WORDS.items()) + " ELSE w END"


def _distinct_sql(words: str) -> str:
    """Distinct words in order of first occurrence."""
    return f"list_filter({words}, lambda e, i: list_position({words}, e) = i)"


@query(
    "id:i src:i core:s legal:s", [Q.REC,
    f"""w0 AS (SELECT id, src, list_transform(string_split(name, ' '), lambda w: {_NAME_CASE}) AS w FROM rec),
    w1 AS (SELECT id, src, {_distinct_sql('w')} AS w FROM w0)"""],
    f"""(SELECT id, src, array_to_string(list_filter(w, lambda x: x <> '' AND x NOT IN ({_STOP})), ' ') AS core,
         array_to_string(list_sort(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in L.LEGAL)}))), ' ') AS legal FROM w1)""",
)
def name_core(d: Data) -> DataFrame:
    w = F.array_distinct(T.mapped(F.split("name", " "), L.NAME_WORDS))
    legal = F.array(*[F.lit(x) for x in L.LEGAL])
    return d.rec.select("id", "src", T.joined(T.keep(w, L.LEGAL + L.WEAK + L.NAME_STOP)).alias("core"), T.joined(F.array_sort(F.filter(w, lambda x: F.array_contains(legal, x)))).alias("legal"))


@query(
    "id:i src:i addr_norm:s num1:s n_nums:i", [Q.REC,
    f"""w0 AS (SELECT id, src, list_transform(string_split(addr, ' '), lambda v: regexp_replace(v, '^0+([0-9])', '\\1')) AS v FROM rec),
    w1 AS (SELECT id, src, list_filter(list_transform(v, lambda w: {_ADDR_CASE}), lambda x: x <> '' AND x NOT IN ({', '.join(f"'{x}'" for x in L.ADDRESS_STOP)})) AS w FROM w0),
    w2 AS (SELECT id, src, {_distinct_sql('w')} AS w FROM w1),
    w3 AS (SELECT id, src, w, list_filter(list_transform(w, lambda x: regexp_extract(x, '^([0-9]+)', 1)), lambda x: x <> '') AS nums FROM w2)"""],
    "(SELECT id, src, array_to_string(w, ' ') AS addr_norm, nums[1] AS num1, len(list_distinct(nums)) AS n_nums FROM w3)",
)
def address_numbers(d: Data) -> DataFrame:
    w = F.array_distinct(T.keep(T.mapped(F.transform(F.split("addr", " "), lambda x: F.regexp_replace(x, r"^0+([0-9])", "$1")), L.ADDRESS_WORDS), L.ADDRESS_STOP))
    nums = F.array_distinct(F.filter(F.transform(w, lambda x: F.regexp_extract(x, "^([0-9]+)", 1)), lambda x: x != ""))
    return d.rec.select("id", "src", T.joined(w).alias("addr_norm"), F.get(nums, F.lit(0)).alias("num1"), F.size(nums).alias("n_nums"))


_SKEL = "regexp_replace(replace(name, 'x', 'ks'), '[^a-z]', '', 'g')"
for _p, _t in (("ph|bh|b|p|f", "P"), ("kh|gh|ch|k|g|q|c", "K"), ("th|dh|t|d", "T"), ("sh|s|z|j", "S"), ("[vw]", "V"), ("[aeiouyh]", "")):
    _SKEL = f"regexp_replace({_SKEL}, '{_p}', '{_t}', 'g')"
for _c in "PKTSVlmnr":
    _SKEL = f"regexp_replace({_SKEL}, '{_c}+', '{_c}', 'g')"


@query("id:i skel:s", [Q.REC], f"(SELECT id, {_SKEL} AS skel FROM rec)")
def skeleton_phonetic(d: Data) -> DataFrame:
    return d.rec.select("id", T.skeleton(F.col("name")).alias("skel"))


@query(
    "n_nationkey:i state:s", [],
    "(SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_filter([" + "CASE lower(n_name) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.STATES["france"].items()) + " END], lambda x: x IS NOT NULL))), ' ') AS state FROM nation)",
)
def state_gazetteer(d: Data) -> DataFrame:
    segs = T.state_codes(T.segments(F.lower("n_name")), F.lit("france"))
    return d.table("nation").select("n_nationkey", T.joined(F.array_sort(F.array_distinct(F.transform(F.filter(segs, lambda s: s.startswith("~")), lambda s: F.substring(s, 2, 9))))).alias("state"))


@query(
    "x:s y:s n:i purity:d", [
    r"""turns AS (SELECT a.conv_id, a.turn, lower(a.text) AS a, lower(b.text) AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    toks AS (SELECT list_filter(regexp_split_to_array(a, '[\s,.\-()\[\]/&]+'), lambda t: t <> '') AS a, list_filter(regexp_split_to_array(b, '[\s,.\-()\[\]/&]+'), lambda t: t <> '') AS b FROM turns WHERE a <> '' AND b <> ''),
    z AS (SELECT unnest(a) AS x, unnest(b) AS y FROM toks WHERE len(a) = len(b)),
    co AS (SELECT x, y, count(*) AS n FROM z WHERE length(x) > 3 GROUP BY x, y),
    best AS (SELECT x, y, n, sum(n) OVER (PARTITION BY x) AS total, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS r FROM co)"""],
    "(SELECT x, y, n, n / total AS purity FROM best WHERE r = 1 AND n >= 1 AND n / total >= 0.6)",
)
def learned_word_map(d: Data) -> DataFrame:
    c = d.table("conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return learned.word_map(c.join(nxt, ["conv_id", "turn"]), "text", "next", 1, 0.6, source=F.length("x") > 3)


@query(
    "city:s state:s", [
    """p AS (SELECT lower(translate(n_name, '0123456789', 'abcdefghij') || ' ' || c_mktsegment) AS city, n_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT lower(c_mktsegment), n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    good AS (SELECT state FROM p GROUP BY state HAVING count(*) >= 20),
    f AS (SELECT * FROM p WHERE state IN (SELECT state FROM good) AND length(city) >= 3 AND NOT regexp_matches(city, '[0-9]')),
    c AS (SELECT city, state, count(*) AS n, sum(count(*)) OVER (PARTITION BY city) AS total FROM f GROUP BY city, state)"""],
    "(SELECT city, state FROM c WHERE n / total >= 0.95 AND total >= 10)",
)
def city_state_map(d: Data) -> DataFrame:
    c = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # A nation's towns are its own; the bare names of their quarters are everywhere.  A town's name has no digits.
    town = F.concat_ws(" ", F.translate("n_name", "0123456789", "abcdefghij"), "c_mktsegment")
    one = c.select(F.concat_ws(", ", F.lit("1 road"), town, "n_name").alias("a"))
    two = c.select(F.concat_ws(", ", F.lit("2 road"), "c_mktsegment", "n_name").alias("a"))
    return learned.city_map(one.unionByName(two), "a", min_count=10, min_state=20)


# ------------------------------------------------------------------ blocking


@query("cty:s field:s src:i id:i t:s w:d", [Q.REC, Q.WEIGHTS], "vec")
def tfidf_weights(d: Data) -> DataFrame:
    return blocking.weights(d.rec)


def _top_sql(score: str) -> str:
    return f"(SELECT s1, src, id, row_number() OVER (PARTITION BY s1, src ORDER BY {score} DESC, id) - 1 AS r, {score} AS s FROM sims WHERE {score} >= 0.05 QUALIFY r < 30)"


@query("s1:i src:i id:i r:i s:d", Q.BLOCK, _top_sql("name_sim"))
def block_name_topk(d: Data) -> DataFrame:
    return blocking.top(d.sims, "name_sim")


@query("s1:i src:i id:i r:i s:d", Q.BLOCK, _top_sql("addr_sim"))
def block_addr_topk(d: Data) -> DataFrame:
    return blocking.top(d.sims, "addr_sim")


@query("s1:i src:i id:i r:i s:d", Q.BLOCK, _top_sql("combo_sim"))
def block_combo_topk(d: Data) -> DataFrame:
    return blocking.top(d.sims, "combo_sim")


@query("s1:i src:i id:i r:i s:d", Q.BLOCK, "(SELECT s1, src, id, row_number() OVER (PARTITION BY src, id ORDER BY name_sim DESC, s1) - 1 AS r, name_sim AS s FROM sims WHERE name_sim >= 0.05 QUALIFY r < 5)")
def block_reverse(d: Data) -> DataFrame:
    return blocking.top(d.sims, "name_sim", blocking.REVERSE_TOP, reverse=True)


_CAND_COLUMNS = "s1:i src:i id:i r_name:i s_name:d r_addr:i s_addr:d r_combo:i s_combo:d r_rev:i s_rev:d q_rev:i min_rank:i max_score:d nb:i pos:i"


@query(_CAND_COLUMNS, Q.CAND, "cand")
def block_union_rank(d: Data) -> DataFrame:
    return d.cand


@query(
    _CAND_COLUMNS, [*Q.BLOCK, "ok AS (SELECT s.* FROM sims s JOIN rec a ON a.src = 1 AND a.id = s.s1 JOIN rec b ON b.src = s.src AND b.id = s.id WHERE a.st = b.st)", Q.candidates("ok")], "cand"
)
def block_state_bucket(d: Data) -> DataFrame:
    return blocking.candidates(d.state_sims)


# ------------------------------------------------------------------ pair features


_IDF = Q.rarity("name")


@query("cty:s t:s df:i idf:d idfp:d", [Q.REC, _IDF], "idf")
def idf_rarity(d: Data) -> DataFrame:
    return pairs.rarity(d.rec, "name")


@query("s1:i src:i id:i nm_wjac:d nm_share_p:d nm_miss_p:d", [*Q.CAND, Q.weighted_jaccard("name", "nm")], "nm_pg")
def weighted_jaccard(d: Data) -> DataFrame:
    return pairs.weighted_jaccard(d.cand, d.rec, "name", pairs.rarity(d.rec, "name"), "nm")


def _named_pairs(d: Data) -> DataFrame:
    return pairs.with_records(d.cand.select("s1", "src", "id"), d.rec, ["name", "addr"])


_NAMED = "np AS (SELECT c.s1, c.src, c.id, a.name AS n1, b.name AS n2, a.addr AS a1, b.addr AS a2 FROM cand c JOIN rec a ON a.src = 1 AND a.id = c.s1 JOIN rec b ON b.src = c.src AND b.id = c.id)"


@query("s1:i src:i id:i lev:i", [*Q.CAND, _NAMED], "(SELECT s1, src, id, levenshtein(a1, a2) AS lev FROM np)")
def sim_levenshtein(d: Data) -> DataFrame:
    return _named_pairs(d).select("s1", "src", "id", F.levenshtein("addr_1", "addr_2").alias("lev"))


@query("s1:i src:i id:i jw:d", [*Q.CAND, _NAMED], "(SELECT s1, src, id, CASE WHEN n1 <> '' AND n2 <> '' THEN jaro_winkler_similarity(n1, n2) END AS jw FROM np)")
def sim_jaro_winkler(d: Data) -> DataFrame:
    return _named_pairs(d).select("s1", "src", "id", S.column(S.jaro_winkler)(F.col("name_1"), F.col("name_2")).alias("jw"))


@query(
    "s1:i src:i id:i ratio:d tset:d tsort:d part:d", [*Q.CAND, _NAMED, Q.ratios("(SELECT n1 AS a, n2 AS b FROM np)", partial=True)],
    "(SELECT s1, src, id, ratio / 100 AS ratio, tset / 100 AS tset, tsort / 100 AS tsort, part / 100 AS part FROM np LEFT JOIN sim ON n1 = a AND n2 = b)",
)
def sim_ratios(d: Data) -> DataFrame:
    a, b = F.col("name_1"), F.col("name_2")
    return _named_pairs(d).select("s1", "src", "id", *[S.column(f, 100)(a, b).alias(k) for k, f in (("ratio", S.ratio), ("tset", S.token_set_ratio), ("tsort", S.token_sort_ratio), ("part", S.partial_ratio))])


def _normalized(d: Data) -> DataFrame:
    return T.normalize_records(d.rec.select("id", "src", "name", "addr", F.col("cty").alias("country")))


_REC_COLUMNS = ["name_core", "name_sq", "name_alias", "legal", "addr_norm", "addr_state", "addr_nums", "addr_num1", "name_nonlatin", "is_handle", "name_phone", "addr_nonlatin", "addr_empty", "has_landmark"]


_FLAGS = ("name_nonlatin", "is_handle", "name_phone", "addr_nonlatin", "addr_empty", "has_landmark")
_BLOCKERS = "r_name:i s_name:d r_addr:i s_addr:d r_combo:i s_combo:d r_rev:i s_rev:d q_rev:i min_rank:i max_score:d nb:i pos:i"
_SETS = "legal_eq:i legal_has1:i legal_has2:i num_inter:i num_n1:i num_n2:i num_jac:d num_conflict:i num1_eq:i state_eq:i"
_LENGTHS = " ".join(f"len_{n}_{k}:i" for n in ("name_core", "addr_norm") for k in (1, 2)) + " " + " ".join(f"{f}_{k}:i" for f in _FLAGS for k in (1, 2))
_STRINGS = "nm_ratio:d nm_tset:d nm_tsort:d nm_part:d nm_jw:d sq_ratio:d sq_part:d ad_ratio:d ad_tset:d ad_part:d nm_alias:d"
_RARE = "nm_wjac:d nm_share_p:d nm_miss_p:d ad_wjac:d ad_share_p:d ad_miss_p:d"
_NUMBERS = "b_legal:i b_core_eq:i b_core_eq_legal_conf:i b_dnum:i b_dnum_abs:i b_num_samelen:i b_num_edit:i b_nonum_1:i b_nonum_2:i b_skel:d"


def _pair_ctes() -> list[str]:
    """All features of a candidate pair in SQL: ``pf``."""
    legal = lambda k: "array_to_string(list_sort(list_distinct(" + Q.mapped(f"string_split(legal_{k}, ' ')", L.CONTEXT_LEGAL) + ")), ' ')"
    first = lambda k: f"substr(ltrim(regexp_replace(coalesce(addr_num1_{k}, ''), '[^0-9]', '', 'g'), '0'), 1, 9)"
    take = ", ".join(f"{t}.{col} AS {col}_{k}" for k, t in ((1, "a"), (2, "b")) for col in _REC_COLUMNS)
    skel = lambda k: _SKEL.replace("name", f"name_core_{k}")
    said = [("name_core_1", "name_core_2"), ("name_sq_1", "name_sq_2"), ("addr_norm_1", "addr_norm_2"), ("name_alias_1", "name_core_2"), ("name_core_1", "name_alias_2")]
    texts = " UNION ALL ".join(f"SELECT {x} AS a, {y} AS b FROM xp" for x, y in said)
    both = lambda x, y: f"coalesce({x}, '') <> '' AND coalesce({y}, '') <> ''"
    return [
        *Q.CAND, "raw AS (SELECT id, src, name, addr, cty AS country FROM rec)", Q.normalized("raw"),
        f"xp AS (SELECT c.*, {take} FROM cand c JOIN norm a ON a.src = 1 AND a.id = c.s1 JOIN norm b ON b.src = c.src AND b.id = c.id)",
        f"xn AS (SELECT *, {legal(1)} AS l1, {legal(2)} AS l2, {first(1)} AS f1, {first(2)} AS f2, {skel(1)} AS k1, {skel(2)} AS k2, len(list_intersect(addr_nums_1, addr_nums_2)) AS ni, len(addr_nums_1) AS n1, len(addr_nums_2) AS n2 FROM xp)",
        Q.ratios(f"({texts})", "sim", partial=True), Q.ratios("(SELECT k1 AS a, k2 AS b FROM xn)", "sk"),
        Q.weighted_jaccard("name", "nm"), Q.weighted_jaccard("addr", "ad"),
        f"""pf AS (SELECT xn.*, xn.src AS src_no, CASE WHEN {both("legal_1", "legal_2")} THEN legal_1 = legal_2 END AS legal_eq, legal_1 <> '' AS legal_has1, legal_2 <> '' AS legal_has2, ni AS num_inter, n1 AS num_n1, n2 AS num_n2,
          CASE WHEN n1 > 0 AND n2 > 0 THEN ni / (n1 + n2 - ni) END AS num_jac, n1 > 0 AND n2 > 0 AND ni = 0 AS num_conflict, CASE WHEN {both("addr_num1_1", "addr_num1_2")} THEN addr_num1_1 = addr_num1_2 END AS num1_eq, NULL AS state_eq,
          length(name_core_1) AS len_name_core_1, length(name_core_2) AS len_name_core_2, length(addr_norm_1) AS len_addr_norm_1, length(addr_norm_2) AS len_addr_norm_2,
          sn.ratio / 100 AS nm_ratio, sn.tset / 100 AS nm_tset, sn.tsort / 100 AS nm_tsort, sn.part / 100 AS nm_part, CASE WHEN {both("name_core_1", "name_core_2")} THEN jaro_winkler_similarity(name_core_1, name_core_2) END AS nm_jw,
          sq.ratio / 100 AS sq_ratio, sq.part / 100 AS sq_part, sa.ratio / 100 AS ad_ratio, sa.tset / 100 AS ad_tset, sa.part / 100 AS ad_part, greatest(al.tset, ar.tset) / 100 AS nm_alias,
          nm_wjac, nm_share_p, nm_miss_p, ad_wjac, ad_share_p, ad_miss_p, CASE WHEN l1 = '' AND l2 = '' THEN 0 WHEN l1 = '' OR l2 = '' THEN 1 WHEN l1 = l2 THEN 2 ELSE 3 END AS b_legal,
          name_core_1 = name_core_2 AND name_core_1 <> '' AS b_core_eq, name_core_1 = name_core_2 AND name_core_1 <> '' AND l1 <> '' AND l2 <> '' AND l1 <> l2 AS b_core_eq_legal_conf,
          TRY_CAST(f2 AS BIGINT) - TRY_CAST(f1 AS BIGINT) AS b_dnum, abs(TRY_CAST(f2 AS BIGINT) - TRY_CAST(f1 AS BIGINT)) AS b_dnum_abs, CASE WHEN f1 <> '' AND f2 <> '' THEN length(f1) = length(f2) END AS b_num_samelen,
          CASE WHEN f1 <> '' AND f2 <> '' THEN levenshtein(f1, f2) END AS b_num_edit, n1 = 0 AS b_nonum_1, n2 = 0 AS b_nonum_2, sk.ratio / 100 AS b_skel
          FROM xn LEFT JOIN sim sn ON name_core_1 = sn.a AND name_core_2 = sn.b LEFT JOIN sim sq ON name_sq_1 = sq.a AND name_sq_2 = sq.b LEFT JOIN sim sa ON addr_norm_1 = sa.a AND addr_norm_2 = sa.b
          LEFT JOIN sim al ON name_alias_1 = al.a AND name_core_2 = al.b LEFT JOIN sim ar ON name_core_1 = ar.a AND name_alias_2 = ar.b LEFT JOIN sk ON k1 = sk.a AND k2 = sk.b
          LEFT JOIN nm_pg ON xn.s1 = nm_pg.s1 AND xn.src = nm_pg.src AND xn.id = nm_pg.id LEFT JOIN ad_pg ON xn.s1 = ad_pg.s1 AND xn.src = ad_pg.src AND xn.id = ad_pg.id)""",
    ]


@query(f"s1:i src:i id:i src_no:i {_BLOCKERS} {_SETS} {_LENGTHS} {_STRINGS} {_RARE} {_NUMBERS}", _pair_ctes(), "pf")
def pair_features(d: Data) -> DataFrame:
    """Everything that the pair model sees, and the number features of the context model."""
    x = pairs.with_records(d.cand, _normalized(d), _REC_COLUMNS)
    keys = ["s1", "src", "id"]
    x = x.select(*keys, F.col("src").alias("src_no"), *[c.split(":")[0] for c in _BLOCKERS.split()], *pairs.set_features(x), *pairs.string_features(x), *pairs.number_features())
    for column, pre in (("name", "nm"), ("addr", "ad")):
        x = x.join(pairs.weighted_jaccard(d.cand, d.rec, column, pairs.rarity(d.rec, column), pre), keys, "left")
    return x


@query("s1:i src:i id:i label:i", Q.SCORED, "pairs")
def labelled_pairs(d: Data) -> DataFrame:
    return d.pairs


# ------------------------------------------------------------------ context


@query(
    "s1:i src:i id:i rk:i rk_src:i p_max:d p_sum:d p_sum_src:d n50:i n90:i n_c:i p_up:d p_dn:d p_2:d a_src:i a_id:i p_anc:d p_rel:d gap_top:d gap12:d logit:d", [*Q.SCORED,
    """gw AS (SELECT *, row_number() OVER w - 1 AS rk, row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, id) AS rk_src, max(p) OVER g AS p_max, sum(p) OVER g AS p_sum, sum(p) OVER (PARTITION BY s1, src) AS p_sum_src,
      count(*) FILTER (p > 0.5) OVER g AS n50, count(*) FILTER (p > 0.9) OVER g AS n90, count(*) OVER g AS n_c, lag(p) OVER w AS p_up, lead(p) OVER w AS p_dn
      FROM pairs WINDOW g AS (PARTITION BY s1), w AS (PARTITION BY s1 ORDER BY p DESC, src, id)),
    gf AS (SELECT g.*, t1.p AS p_2, CASE WHEN g.rk = 0 THEN t1.src ELSE t0.src END AS a_src, CASE WHEN g.rk = 0 THEN t1.id ELSE t0.id END AS a_id, CASE WHEN g.rk = 0 THEN t1.p ELSE g.p_max END AS p_anc,
      CASE WHEN g.p_max <> 0 THEN g.p / g.p_max END AS p_rel, g.p_max - g.p AS gap_top, g.p_max - t1.p AS gap12, ln(greatest(least(g.p, 1 - 1e-6), 1e-6) / (1 - greatest(least(g.p, 1 - 1e-6), 1e-6))) AS logit
      FROM gw g LEFT JOIN gw t0 ON g.s1 = t0.s1 AND t0.rk = 0 LEFT JOIN gw t1 ON g.s1 = t1.s1 AND t1.rk = 1)"""], "gf",
)
def group_context(d: Data) -> DataFrame:
    return context.group_features(d.pairs)


@query(
    "s1:i src:i id:i c_rk:i c_rk_src:i c_max:d c_sum_src:d c_max_src:d c_n50:i c_rel:d c_gap_up:d c_gap_dn:d c_rest:d c_src_gap:d c_logit:d c_ab_diff:d", [*Q.SCORED,
    """cw AS (SELECT *, row_number() OVER w - 1 AS c_rk, row_number() OVER (PARTITION BY s1, src ORDER BY pb DESC, id) AS c_rk_src, max(pb) OVER g AS c_max, sum(pb) OVER g AS c_sum, sum(pb) OVER gs AS c_sum_src, max(pb) OVER gs AS c_max_src,
      count(*) FILTER (pb > 0.5) OVER g AS c_n50, lag(pb) OVER w - pb AS c_gap_up, pb - lead(pb) OVER w AS c_gap_dn FROM pairs WINDOW g AS (PARTITION BY s1), gs AS (PARTITION BY s1, src), w AS (PARTITION BY s1 ORDER BY pb DESC, src, id)),
    cf AS (SELECT *, pb / greatest(c_max, 1e-6) AS c_rel, c_sum - pb AS c_rest, c_max - c_max_src AS c_src_gap, ln(greatest(least(pb, 1 - 1e-6), 1e-6) / (1 - greatest(least(pb, 1 - 1e-6), 1e-6))) AS c_logit, p - pb AS c_ab_diff FROM cw)"""], "cf",
)
def score_context(d: Data) -> DataFrame:
    return context.score_features(d.pairs)


@query("s1:i src:i id:i", Q.SCORED, "(SELECT * FROM pairs QUALIFY p >= 0.6 OR row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, id) <= 5)")
def pruned_pairs(d: Data) -> DataFrame:
    return context.prune(d.pairs, least=0.6)


@query(
    "src:i id:i cty:s fn1:i fno:i fn1st:i fa1:i", [Q.REC],
    """(SELECT src, id, cty, CASE WHEN name <> '' THEN count(*) FILTER (src = 1) OVER (PARTITION BY cty, name) END AS fn1, CASE WHEN name <> '' THEN count(*) FILTER (src <> 1) OVER (PARTITION BY cty, name) END AS fno,
        CASE WHEN name <> '' THEN count(*) FILTER (src = 1) OVER (PARTITION BY cty, st, name) END AS fn1st, CASE WHEN addr <> '' THEN count(*) FILTER (src = 1) OVER (PARTITION BY cty, addr) END AS fa1 FROM rec)""",
)
def record_frequency(d: Data) -> DataFrame:
    return context.frequencies(d.rec)


_SIB = """sw AS (SELECT cty, src, unnest(list_distinct(string_split(name, ' '))) AS t FROM rec WHERE name <> ''), sn AS (SELECT cty, count(*) FILTER (src = 1) AS n1, count(*) FILTER (src <> 1) AS n_o FROM rec GROUP BY cty),
sd AS (SELECT cty, t, count(*) FILTER (src = 1) AS d1, count(*) FILTER (src <> 1) AS d_o FROM sw GROUP BY cty, t),
sib AS (SELECT sd.cty, t, ln(((d_o + 1) / n_o) / ((d1 + 1) / n1)) AS sib, d1 + d_o AS tdf FROM sd JOIN sn ON sd.cty = sn.cty)"""


@query("cty:s t:s sib:d tdf:i", [Q.REC, _SIB], "sib")
def sibling_words(d: Data) -> DataFrame:
    return context.sibling_words(d.rec)


def _diff_sql(pre: str, one: str, two: str) -> str:
    return f"""{pre}_t AS (SELECT s1, src, id, cty, unnest(list_distinct(list_filter(string_split({one}, ' '), lambda w: w <> '' AND NOT list_contains(string_split({two}, ' '), w)))) AS t FROM dp),
    {pre}_g AS (SELECT x.s1, x.src, x.id, count(*) AS n, max(sib) AS sib, min(tdf) AS mindf FROM {pre}_t x LEFT JOIN sib ON x.cty = sib.cty AND x.t = sib.t GROUP BY ALL)"""


@query(
    "s1:i src:i id:i n_extra:i extra_sib:d extra_mindf:i n_miss:i miss_sib:d miss_mindf:i", [*Q.CAND, _SIB,
    "dp AS (SELECT c.s1, c.src, c.id, a.cty, a.name AS n1, b.name AS n2 FROM cand c JOIN rec a ON a.src = 1 AND a.id = c.s1 JOIN rec b ON b.src = c.src AND b.id = c.id)", _diff_sql("e", "n2", "n1"), _diff_sql("m", "n1", "n2")],
    """(SELECT dp.s1, dp.src, dp.id, coalesce(e.n, 0) AS n_extra, e.sib AS extra_sib, e.mindf AS extra_mindf, coalesce(m.n, 0) AS n_miss, m.sib AS miss_sib, m.mindf AS miss_mindf
        FROM dp LEFT JOIN e_g e ON dp.s1 = e.s1 AND dp.src = e.src AND dp.id = e.id LEFT JOIN m_g m ON dp.s1 = m.s1 AND dp.src = m.src AND dp.id = m.id)""",
)
def extra_tokens(d: Data) -> DataFrame:
    return context.word_differences(d.cand, d.rec, context.sibling_words(d.rec))


@query(
    "s1:i src:i id:i rv_n:i rv_num:i", [*Q.CAND,
    """rf AS (SELECT cty, name, id, regexp_extract(addr, '^([0-9]+)', 1) AS n1 FROM rec WHERE src = 1 AND name <> '' QUALIFY count(*) OVER (PARTITION BY cty, name) <= 20),
    ro AS (SELECT cty, name, src, id, regexp_extract(addr, '^([0-9]+)', 1) AS n2 FROM rec WHERE src <> 1 AND name <> ''),
    rg AS (SELECT c.s1, c.src, c.id, count(*) AS rv_n, max(CAST(n2 = n1 AND n2 <> '' AS INT)) AS rv_num FROM cand c JOIN ro ON ro.src = c.src AND ro.id = c.id JOIN rf ON rf.cty = ro.cty AND rf.name = ro.name AND rf.id <> c.s1 GROUP BY c.s1, c.src, c.id)"""],
    "(SELECT c.s1, c.src, c.id, coalesce(rv_n, 0) AS rv_n, rv_num FROM cand c LEFT JOIN rg ON c.s1 = rg.s1 AND c.src = rg.src AND c.id = rg.id)",
)
def rival_stats(d: Data) -> DataFrame:
    return context.rivals(d.cand, d.rec)


_ANCHOR = """ga AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, src, id) AS k FROM pairs),
an AS (SELECT g.s1, g.src, g.id, r.name AS n, r.addr AS ad, o.name AS an_n, o.addr AS an_ad, CAST(t.src = g.src AS INT) AS same
  FROM ga g JOIN rec r ON r.src = g.src AND r.id = g.id LEFT JOIN ga t ON t.s1 = g.s1 AND t.k = CASE WHEN g.k = 1 THEN 2 ELSE 1 END LEFT JOIN rec o ON o.src = t.src AND o.id = t.id)"""


@query(
    "s1:i src:i id:i anc_name:d anc_addr:d anc_same_src:i", [*Q.SCORED, _ANCHOR, Q.ratios("(SELECT n AS a, an_n AS b FROM an UNION ALL SELECT ad, an_ad FROM an)")],
    "(SELECT s1, src, id, x.tset / 100 AS anc_name, y.tset / 100 AS anc_addr, same AS anc_same_src FROM an LEFT JOIN sim x ON n = x.a AND an_n = x.b LEFT JOIN sim y ON ad = y.a AND an_ad = y.b)",
)
def anchor_similarity(d: Data) -> DataFrame:
    return context.anchor_similarity(context.group_features(d.pairs), d.rec)


_RIVALS = f"""fr AS (SELECT cty, name, id AS s1r, addr, count(*) OVER (PARTITION BY cty, name) AS c FROM rec WHERE src = 1 AND name <> ''),
mt AS (SELECT p.s1, p.src, p.id, r.addr AS a2, fr.addr AS ar FROM pairs p JOIN rec r ON r.src = p.src AND r.id = p.id JOIN fr ON fr.cty = r.cty AND fr.name = r.name WHERE r.name <> '' AND fr.c <= {context.RIVAL_MAX} AND s1r <> p.s1),
ow AS (SELECT p.s1, p.src, p.id, a.addr AS a1, b.addr AS a2 FROM pairs p JOIN rec a ON a.src = 1 AND a.id = p.s1 JOIN rec b ON b.src = p.src AND b.id = p.id)"""


@query(
    "s1:i src:i id:i rv_addr:d rv_gap:d", [*Q.SCORED, _RIVALS, Q.ratios("(SELECT a2 AS a, ar AS b FROM mt UNION ALL SELECT a1, a2 FROM ow)"),
    "rb AS (SELECT s1, src, id, max(tset) / 100 AS rv_addr FROM mt JOIN sim ON a2 = a AND ar = b GROUP BY s1, src, id)"],
    "(SELECT ow.s1, ow.src, ow.id, rv_addr, tset / 100 - rv_addr AS rv_gap FROM ow LEFT JOIN sim ON a1 = a AND a2 = b LEFT JOIN rb ON ow.s1 = rb.s1 AND ow.src = rb.src AND ow.id = rb.id)",
)
def rival_addresses(d: Data) -> DataFrame:
    return context.rival_addresses(d.pairs, d.rec)


# ------------------------------------------------------------------ decisions


@query("s1:i src:i id:i p:d", Q.SCORED, "(SELECT * FROM pairs QUALIFY p = max(p) OVER (PARTITION BY src, id))")
def own_ties(d: Data) -> DataFrame:
    return decide.own(d.pairs, "p", keep_ties=True)


@query("s1:i src:i id:i p:d", [*Q.SCORED, Q.own("p")], "owned")
def own_single(d: Data) -> DataFrame:
    return decide.own(d.pairs, "p")


@query(
    "s1:i src:i id:i p:d", [*Q.SCORED, "o AS (SELECT * FROM pairs WHERE p >= 0.5 QUALIFY p = max(p) OVER (PARTITION BY src, id)), m AS (SELECT *, max(p) OVER (PARTITION BY s1) AS mx FROM o)"],
    "m WHERE mx >= 0.7 AND p >= 0.4 * mx",
)
def rule_threshold(d: Data) -> DataFrame:
    return decide.rule_threshold(d.pairs, "p", 0.7, 0.5, 0.4)


@query("s1:i src:i id:i p:d", [*Q.SCORED, Q.own("p")], "owned WHERE p >= 0.8")
def rule_simple(d: Data) -> DataFrame:
    return decide.rule_simple(d.pairs, "p", 0.8)


@query("s1:i src:i id:i k:i ef:d", [*Q.SCORED, Q.own("p"), Q.expected("p", "1.5")], "chosen")
def rule_expected_f05(d: Data) -> DataFrame:
    return decide.rule_expected(d.pairs, "p", 1.5)


@query("s1:i src:i id:i k:i", [*Q.SCORED, Q.own("p"), "g AS (SELECT *, CASE cty WHEN 'en' THEN 2.0 WHEN 'fr' THEN 0.75 ELSE 1.0 END AS g FROM owned)", Q.expected("p", "g", "g")], "chosen")
def rule_country(d: Data) -> DataFrame:
    g = d.spark.createDataFrame([("en", 2.0), ("fr", 0.75)], "cty string, g double")
    return decide.rule_by_country(d.pairs, "p", g, 1.0)


_CHOSEN = [*Q.SCORED, Q.own("p"), Q.expected("p", "1.5"), Q.TRUE_COUNTS]


@query("s1:i k:i t:i a:i f:d", [*_CHOSEN, Q.per_record()], "judged")
def f05_per_record(d: Data) -> DataFrame:
    return decide.per_record(decide.rule_expected(d.pairs, "p", 1.5), d.universe, d.truth)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_GRID = f"""o AS (SELECT * FROM pairs WHERE p >= 0.1 QUALIFY p = max(p) OVER (PARTITION BY src, id)), om AS (SELECT *, max(p) OVER (PARTITION BY s1) AS mx FROM o),
cells(i, ts, j, ta, k, tr) AS (SELECT a.i, a.v, b.j, b.v, c.k, c.v FROM (VALUES {_values(list(enumerate(decide.T_SINGLE)))}) a(i, v), (VALUES {_values(list(enumerate(decide.T_ABS)))}) b(j, v), (VALUES {_values(list(enumerate(decide.T_REL)))}) c(k, v) WHERE b.v <= a.v),
sel AS (SELECT z.i, z.j, z.k, om.s1, count(*) AS n, sum(label) AS tp FROM om JOIN cells z ON mx >= ts AND p >= ta AND p >= tr * mx GROUP BY ALL),
gr AS (SELECT z.i, z.j, z.k, any_value(ts) AS t_single, any_value(ta) AS t_abs, any_value(tr) AS t_rel,
  avg(CASE WHEN coalesce(n, 0) + coalesce(t, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(tp, 0) / greatest(0.25 * coalesce(t, 0) + coalesce(n, 0), 1e-9) END) AS f05
  FROM universe u CROSS JOIN cells z LEFT JOIN sel ON sel.s1 = u.s1 AND sel.i = z.i AND sel.j = z.j AND sel.k = z.k LEFT JOIN tc ON tc.s1 = u.s1 GROUP BY z.i, z.j, z.k)"""


@query(
    "t_single:d t_abs:d t_rel:d f05:d plateau:d", [*Q.SCORED, Q.TRUE_COUNTS, _GRID],
    "(SELECT any_value(a.t_single) AS t_single, any_value(a.t_abs) AS t_abs, any_value(a.t_rel) AS t_rel, any_value(a.f05) AS f05, avg(b.f05) AS plateau FROM gr a JOIN gr b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY a.i, a.j, a.k)",
)
def grid_plateau(d: Data) -> DataFrame:
    return decide.grid(d.pairs, "p", d.universe, d.truth)


@query(
    "kind:s v:d dev:d holdout:d", [*Q.SCORED, Q.TRUE_COUNTS, Q.own("p"),
    f"vals(v) AS (VALUES {_values([(v,) for v in decide.STRICTNESS])}), ov AS (SELECT o.*, vals.v FROM owned o CROSS JOIN vals)", Q.expected("p", "v", "ov", "efs", "v, "),
    f"thr AS (SELECT o.*, z.v FROM owned o CROSS JOIN (VALUES {_values([(v,) for v in decide.THRESHOLDS])}) z(v) WHERE p >= z.v)",
    f"picked AS (SELECT 'thr' AS kind, v, s1, src, id FROM thr UNION ALL SELECT 'ef', v, s1, src, id FROM efs), kv(kind, v) AS (VALUES {_values([('thr', v) for v in decide.THRESHOLDS] + [('ef', v) for v in decide.STRICTNESS])})",
    Q.per_record("picked", cells="kv", cell_columns=("kind", "v"))],
    "(SELECT kind, v, avg(f) FILTER (fold >= 0) AS dev, avg(f) FILTER (fold < 0) AS holdout FROM judged GROUP BY kind, v)",
)
def tune_rules(d: Data) -> DataFrame:
    return decide.tune(d.pairs, "p", d.universe, d.truth)


_BLEND = [*Q.SCORED, Q.TRUE_COUNTS,
    f"wv(w, v) AS (VALUES {_values([(w, v) for w in decide.BLENDS for v in decide.STRICTNESS])}), mixed AS (SELECT p.*, wv.w, wv.v, round(wv.w * p.p + (1 - wv.w) * p.pb, 9) AS sc FROM pairs p CROSS JOIN wv)",
    Q.own("sc", "owned", "mixed", "w, v, "), Q.expected("sc", "v", "owned", "chosen", "w, v, "), Q.per_record("chosen", cells="wv", cell_columns=("w", "v")),
    "bl AS (SELECT w, v, cty, avg(f) AS f05, count(*) AS n FROM judged WHERE fold >= 0 GROUP BY w, v, cty)"]


@query("w:d v:d cty:s f05:d n:i", _BLEND, "bl")
def blend_search(d: Data) -> DataFrame:
    return decide.blend(d.pairs, "pb", "p", d.universe, d.truth)


@query("w:d v:d cty:s f05:d", _BLEND, "(SELECT * FROM bl QUALIFY row_number() OVER (PARTITION BY w, cty ORDER BY round(f05, 9) DESC, v) = 1)")
def blend_best_strictness(d: Data) -> DataFrame:
    return decide.best_strictness(decide.blend(d.pairs, "pb", "p", d.universe, d.truth))


@query(
    "current:d best_cut:d best_pick:d blocking_loss:d", [*_CHOSEN, Q.per_record(),
    """ol AS (SELECT s1, row_number() OVER w AS k, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS a FROM owned WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, src, id)),
    cut AS (SELECT ol.s1, max(1.25 * a / (k + 0.25 * coalesce(t, 0))) AS fk FROM ol LEFT JOIN tc ON ol.s1 = tc.s1 GROUP BY ol.s1), fnd AS (SELECT s1, sum(label) AS a FROM pairs GROUP BY s1),
    el AS (SELECT j.f, greatest(coalesce(fk, 0), CAST(j.t = 0 AS INT)) AS d, CASE WHEN j.t = 0 THEN 1.0 ELSE 1.25 * coalesce(fnd.a, 0) / (coalesce(fnd.a, 0) + 0.25 * j.t) END AS b
      FROM judged j LEFT JOIN cut ON j.s1 = cut.s1 LEFT JOIN fnd ON j.s1 = fnd.s1)"""],
    "(SELECT avg(f) AS current, avg(d) AS best_cut, avg(b) AS best_pick, 1 - avg(b) AS blocking_loss FROM el)",
)
def oracle_loss(d: Data) -> DataFrame:
    return decide.losses(d.pairs, "p", decide.rule_expected(d.pairs, "p", 1.5), d.universe, d.truth)


@query(
    "source1_entity_id:s matched_entity_ids:s", [*_CHOSEN, "l AS (SELECT s1, string_agg('S' || src || '_' || id, ',' ORDER BY p DESC, src, id) AS m FROM chosen GROUP BY s1)"],
    "(SELECT 'S1_' || u.s1 AS source1_entity_id, coalesce(m, '') AS matched_entity_ids FROM universe u LEFT JOIN l ON u.s1 = l.s1)",
)
def ordered_match_list(d: Data) -> DataFrame:
    return tsv.match_lists(d.universe.select("s1"), decide.rule_expected(d.pairs, "p", 1.5), "p")


# ------------------------------------------------------------------ twins


_TWINS = r"""tw AS (SELECT src, id, concat_ws('|', coalesce(cty, ''), array_to_string(list_sort(string_split(name, ' ')), ' '), array_to_string(list_sort(string_split(addr, ' ')), ' ')) AS g FROM rec WHERE src <> 1 AND name <> '' AND addr <> ''),
twins AS (SELECT * FROM tw QUALIFY count(*) OVER (PARTITION BY g) >= 2)"""


@query("src:i id:i g:s", [Q.REC, _TWINS], "twins")
def twin_groups(d: Data) -> DataFrame:
    return twins.groups(d.rec)


def _pool_sql(agg: str) -> list[str]:
    return [*Q.SCORED, _TWINS, f"""tg AS (SELECT g, s1, round({agg}, 9) AS gp FROM pairs p JOIN twins t ON p.src = t.src AND p.id = t.id GROUP BY g, s1 QUALIFY row_number() OVER (PARTITION BY g ORDER BY round({agg}, 9) DESC, s1) = 1),
    pooled AS (SELECT s1, p.src, p.id, p FROM pairs p LEFT JOIN twins t ON p.src = t.src AND p.id = t.id WHERE t.g IS NULL UNION ALL SELECT tg.s1, t.src, t.id, gp FROM tg JOIN twins t ON tg.g = t.g)"""]  # fmt: skip


@query("s1:i src:i id:i p:d", _pool_sql("max(p)"), "pooled")
def twin_pool_max(d: Data) -> DataFrame:
    return twins.pool(d.pairs, twins.groups(d.rec))


@query("s1:i src:i id:i p:d", _pool_sql("1 - exp(sum(ln(1 - greatest(least(p, 0.999999), 0.0))))"), "pooled")
def twin_pool_noisy_or(d: Data) -> DataFrame:
    return twins.pool(d.pairs, twins.groups(d.rec), how="noisy_or")


def _dup_sql(title: str, key: str, where: str) -> str:
    return f"""SELECT '{title}' AS title, cty, count(*) AS groups, sum(sz) AS n_rows, avg(CAST(nsrc = 2 AS INT)) AS cross_src, avg(CAST(nown = 1 AND norph = 0 AS INT)) AS all_same_owner,
      avg(CAST(nown >= 1 AND norph > 0 AS INT)) AS owner_orphan_mix, avg(CAST(nown = 0 AS INT)) AS all_orphan, avg(CAST(nown > 1 AS INT)) AS diff_owners,
      CASE WHEN count(*) FILTER (nown >= 1) > 0 THEN count(*) FILTER (nown = 1 AND norph = 0) / count(*) FILTER (nown >= 1) END AS rule_precision
      FROM (SELECT cty, {key} AS k, count(*) AS sz, count(*) FILTER (s1 IS NULL) AS norph, count(DISTINCT s1) AS nown, count(DISTINCT src) AS nsrc FROM ow WHERE {where} GROUP BY cty, k HAVING count(*) >= 2) GROUP BY cty"""


@query(
    "title:s cty:s groups:i n_rows:i cross_src:d all_same_owner:d owner_orphan_mix:d all_orphan:d diff_owners:d rule_precision:d",
    [Q.REC, Q.TRUTH, "ow AS (SELECT r.*, t.s1 FROM rec r LEFT JOIN truth t ON r.src = t.src AND r.id = t.id WHERE r.src <> 1)"],
    "(" + " UNION ALL ".join([_dup_sql("exact", "name || '|' || addr", "name <> '' AND addr <> ''"), _dup_sql("sorted", "array_to_string(list_sort(string_split(name, ' ')), ' ') || '|' || array_to_string(list_sort(string_split(addr, ' ')), ' ')", "name <> '' AND addr <> ''"), _dup_sql("name", "name", "name <> ''")]) + ")",
)
def dup_owner_check(d: Data) -> DataFrame:
    words = lambda c: T.joined(F.array_sort(F.split(c, " ")))
    full = (F.col("n") != "") & (F.col("a") != "")
    return twins.owners(d.rec, d.truth, {"exact": (F.concat_ws("|", "n", "a"), full), "sorted": (F.concat_ws("|", words("n"), words("a")), full), "name": (F.col("n"), F.col("n") != "")})


# ------------------------------------------------------------------ reports


@query(
    "src:i pairs:i no_first:i no_other:i cross_country:i", [Q.REC, Q.TRUTH],
    "(SELECT t.src, count(*) AS pairs, count(*) FILTER (a.id IS NULL) AS no_first, count(*) FILTER (b.id IS NULL) AS no_other, count(*) FILTER (a.cty <> b.cty) AS cross_country FROM truth t LEFT JOIN rec a ON a.src = 1 AND a.id = t.s1 LEFT JOIN rec b ON b.src = t.src AND b.id = t.id GROUP BY t.src)",
)
def truth_sanity(d: Data) -> DataFrame:
    return reports.truth_sanity(d.rec, d.truth)


@query(
    "cty:s n:i singleton:d mean_m:d p50:d p99:d max_m:i", [Q.REC, Q.TRUTH, Q.UNIVERSE, Q.TRUE_COUNTS],
    "(SELECT cty, count(*) AS n, avg(CAST(coalesce(t, 0) = 0 AS INT)) AS singleton, avg(coalesce(t, 0)) AS mean_m, quantile_cont(coalesce(t, 0), 0.5) AS p50, quantile_cont(coalesce(t, 0), 0.99) AS p99, max(coalesce(t, 0)) AS max_m FROM universe u LEFT JOIN tc ON u.s1 = tc.s1 GROUP BY cty)",
)
def matches_per_record(d: Data) -> DataFrame:
    return reports.matches_per_record(d.rec, d.truth)


@query("cty:s", [], "(SELECT DISTINCT n_name AS cty FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000 AND s_nationkey IS NOT NULL))")
def unseen_countries(d: Data) -> DataFrame:
    """Nations that none of the wealthier suppliers is from."""
    n = d.table("nation").select(F.col("n_name").alias("cty"), "n_nationkey")
    return reports.unseen_countries(n.join(d.table("supplier").where("s_acctbal > 7000").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey"), n)


@query(
    "src:i cty:s name_nonlatin:d is_handle:d name_phone:d addr_empty:d has_landmark:d has_legal:d has_state:d has_number:d", [Q.REC, "raw AS (SELECT id, src, name, addr, cty AS country FROM rec)", Q.normalized("raw")],
    "(SELECT src, cty, " + ", ".join(f"avg(CAST({e} AS INT)) AS {n}" for n, e in (*((f, f) for f in ("name_nonlatin", "is_handle", "name_phone", "addr_empty", "has_landmark")), ("has_legal", "(legal <> '')"), ("has_state", "(addr_state <> '')"), ("has_number", "(len(addr_nums) > 0)"))) + " FROM norm GROUP BY src, cty)",
)
def normalization_flags(d: Data) -> DataFrame:
    return reports.flags(_normalized(d))


@query("cty:s t:s n:i rank:i", [Q.REC, "w AS (SELECT cty, unnest(string_split(name, ' ')) AS t FROM rec), c AS (SELECT cty, t, count(*) AS n FROM w WHERE t <> '' AND NOT regexp_matches(t, '[0-9]') GROUP BY cty, t)"], "(SELECT *, row_number() OVER (PARTITION BY cty ORDER BY n DESC, t) AS rank FROM c QUALIFY rank <= 40)")
def top_tokens(d: Data) -> DataFrame:
    return reports.top_tokens(d.rec, "name")


_PCT = ", ".join(f"quantile_cont(v, {a}) AS p{round(100 * a):02d}" for a in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95))


@query(
    "kind:s n:i p01:d p05:d p25:d p50:d p75:d p95:d", [Q.REC, Q.TRUTH, Q.UNIVERSE,
    """tp AS (SELECT u.cty, t.* FROM truth t JOIN universe u ON t.s1 = u.s1),
    l AS (SELECT cty, s1, row_number() OVER (PARTITION BY cty ORDER BY md5(concat_ws(':', 'a', s1, src, id))) AS n FROM tp), r AS (SELECT cty, src, id, row_number() OVER (PARTITION BY cty ORDER BY md5(concat_ws(':', 'b', s1, src, id))) AS n FROM tp),
    compared AS (SELECT 'true' AS kind, s1, src, id FROM truth UNION ALL SELECT 'shuffled', s1, src, id FROM l JOIN r ON l.cty = r.cty AND l.n = r.n),
    v AS (SELECT kind, levenshtein(a.name, b.name) AS v FROM compared x JOIN rec a ON a.src = 1 AND a.id = x.s1 JOIN rec b ON b.src = x.src AND b.id = x.id)"""],
    f"(SELECT kind, count(v) AS n, {_PCT} FROM v GROUP BY kind)",
)
def similarity_true_shuffled(d: Data) -> DataFrame:
    shuffled = sampling.shuffled_partners(d.truth.join(d.universe, "s1"), "cty").select("s1", "src", "id")
    lev = F.levenshtein("name_1", "name_2")
    one = [reports.similarity_percentiles(pairs.with_records(p, d.rec, ["name"]), lev, k) for p, k in ((d.truth, "true"), (shuffled, "shuffled"))]
    return one[0].unionByName(one[1])


_RECALL = ", ".join(f"('{b}', {k})" for b in ("name", "addr", "combo", "rev") for k in (1, 3, 5, 10, 20, 30))


@query(
    "blocker:s k:i recall:d", [*Q.CAND, Q.TRUTH, f"tr AS (SELECT t.s1, t.src, t.id, r_name, r_addr, r_combo, q_rev FROM truth t LEFT JOIN cand c ON t.s1 = c.s1 AND t.src = c.src AND t.id = c.id), bk(blocker, k) AS (VALUES {_RECALL})"],
    "(SELECT blocker, k, avg(CAST(coalesce(CASE blocker WHEN 'name' THEN r_name WHEN 'addr' THEN r_addr WHEN 'combo' THEN r_combo ELSE q_rev END < k, false) AS INT)) AS recall FROM tr CROSS JOIN bk GROUP BY blocker, k)",
)
def recall_at_k(d: Data) -> DataFrame:
    return reports.recall_at_k(d.cand, d.truth)


@query(
    "cap:i recall:d ceiling:d mean_size:d", [*Q.SCORED, Q.TRUE_COUNTS,
    """caps(cap) AS (VALUES (1), (3), (5), (10), (20), (30)), cc AS (SELECT c.s1, cap, count(*) AS n, sum(label) AS a FROM cand c JOIN pairs p ON c.s1 = p.s1 AND c.src = p.src AND c.id = p.id JOIN caps ON c.pos < cap GROUP BY c.s1, cap),
    cu AS (SELECT caps.cap, coalesce(cc.a, 0) AS a, coalesce(cc.n, 0) AS n, coalesce(tc.t, 0) AS t FROM universe u CROSS JOIN caps LEFT JOIN cc ON cc.s1 = u.s1 AND cc.cap = caps.cap LEFT JOIN tc ON tc.s1 = u.s1)"""],
    "(SELECT cap, sum(a) / sum(t) AS recall, avg(CASE WHEN t + a = 0 THEN 1.0 ELSE 1.25 * a / greatest(0.25 * t + a, 1e-9) END) AS ceiling, avg(n) AS mean_size FROM cu GROUP BY cap)",
)
def recall_by_cap(d: Data) -> DataFrame:
    return reports.recall_by_cap(d.cand, d.truth, d.universe)


@query("cty:s src:i pairs:i recall:d", [*Q.SCORED], "(SELECT u.cty, t.src, count(*) AS pairs, avg(CAST(p.id IS NOT NULL AS INT)) AS recall FROM truth t JOIN universe u ON t.s1 = u.s1 LEFT JOIN pairs p ON t.s1 = p.s1 AND t.src = p.src AND t.id = p.id GROUP BY u.cty, t.src)")
def recall_by_group(d: Data) -> DataFrame:
    return reports.recall_by_group(d.cand, d.truth, d.rec)


@query("s1:i src:i id:i", [*Q.BLOCK, Q.TRUTH, "n1 AS (SELECT * FROM sims WHERE addr_sim >= 0.05 QUALIFY row_number() OVER (PARTITION BY s1, src ORDER BY addr_sim DESC, id) <= 1)"], "(SELECT t.* FROM truth t LEFT JOIN n1 ON t.s1 = n1.s1 AND t.src = n1.src AND t.id = n1.id WHERE n1.id IS NULL)")
def missed_pairs(d: Data) -> DataFrame:
    return reports.missed_pairs(blocking.top(d.sims, "addr_sim", 1), d.truth)


@query("matched:b n:i p10:d p50:d p90:d", [*Q.SCORED, Q.TRUE_COUNTS, "bm AS (SELECT s1, max(max_score) AS m FROM cand GROUP BY s1)"], "(SELECT tc.s1 IS NOT NULL AS matched, count(*) AS n, quantile_cont(m, 0.1) AS p10, quantile_cont(m, 0.5) AS p50, quantile_cont(m, 0.9) AS p90 FROM bm LEFT JOIN tc ON bm.s1 = tc.s1 GROUP BY matched)")
def top_scores(d: Data) -> DataFrame:
    return reports.top_scores(d.cand, d.truth, d.universe)


_SIBLING = r"""sx AS (SELECT u.s1, u.cty, coalesce(t, 0) AS m, string_split(r.name, ' ') AS w, r.name AS n, r.addr AS a FROM universe u JOIN rec r ON r.src = 1 AND r.id = u.s1 LEFT JOIN tc ON u.s1 = tc.s1),
sy AS (SELECT s1, cty, m, array_to_string(list_filter(w, lambda x: x NOT IN ({legal})), ' ') AS core, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x IN ({legal})))), ' ') AS lg,
  array_to_string(list_filter(w, lambda x: x NOT IN ({legal}, {family})), ' ') AS base, len(list_filter(w, lambda x: x IN ({family}))) AS nfam, trim(regexp_replace(regexp_replace(a, '\b[0-9]+\w*\b', ' ', 'g'), '\s+', ' ', 'g')) AS street FROM sx),
bc AS (SELECT cty, core, count(*) AS n_core, count(DISTINCT lg) AS n_lg FROM sy WHERE core <> '' GROUP BY cty, core), bs AS (SELECT cty, street, count(*) AS n_street, count(DISTINCT core) AS n_names FROM sy WHERE street <> '' GROUP BY cty, street),
bb AS (SELECT cty, base, bool_or(nfam = 0 AND base <> '') AS has_plain, bool_or(nfam > 0) AS has_fam FROM sy GROUP BY cty, base),
sz AS (SELECT sy.*, coalesce(n_core, 1) AS n_core, coalesce(n_core, 1) > 1 AND coalesce(n_lg, 1) > 1 AS legal_sib, coalesce(n_street, 1) > 1 AND coalesce(n_names, 1) > 1 AS street_sib,
  CASE WHEN nfam > 0 AND has_plain THEN 'extra family word' WHEN nfam = 0 AND has_fam THEN 'plain base' ELSE 'none' END AS fam
  FROM sy LEFT JOIN bc ON sy.cty = bc.cty AND sy.core = bc.core LEFT JOIN bs ON sy.cty = bs.cty AND sy.street = bs.street LEFT JOIN bb ON sy.cty = bb.cty AND sy.base = bb.base),
sl AS (SELECT cty, m, 'core_group' AS kind, CASE WHEN n_core = 1 THEN '1' WHEN n_core = 2 THEN '2' WHEN n_core <= 5 THEN '3-5' ELSE '6+' END AS value FROM sz
  UNION ALL SELECT cty, m, 'legal_sib', CAST(legal_sib AS VARCHAR) FROM sz UNION ALL SELECT cty, m, 'legal_side', CASE WHEN NOT legal_sib THEN 'no sibling' WHEN lg = '' THEN 'without legal form' ELSE 'with legal form' END FROM sz
  UNION ALL SELECT cty, m, 'family', fam FROM sz UNION ALL SELECT cty, m, 'street_sib', CAST(street_sib AS VARCHAR) FROM sz UNION ALL SELECT cty, m, 'any', CAST(legal_sib OR street_sib OR fam <> 'none' AS VARCHAR) FROM sz)""".format(
    legal=", ".join(f"'{w}'" for w in L.LEGAL), family=", ".join(f"'{w}'" for w in L.FAMILY)
)


@query("kind:s value:s cty:s n:i singleton:d one_match:d mean_m:d", [Q.REC, Q.TRUTH, Q.UNIVERSE, Q.TRUE_COUNTS, _SIBLING], "(SELECT kind, value, cty, count(*) AS n, avg(CAST(m = 0 AS INT)) AS singleton, avg(CAST(m = 1 AS INT)) AS one_match, avg(m) AS mean_m FROM sl GROUP BY kind, value, cty)")
def sibling_check(d: Data) -> DataFrame:
    return reports.siblings(d.rec, d.truth)


@query("expected:d observed:d", [*Q.SCORED, "bst AS (SELECT src, id, max(p) AS m FROM pairs GROUP BY src, id)"], "(SELECT (SELECT count(*) FROM truth) / (SELECT count(*) FROM rec WHERE src <> 1) * (SELECT avg(CAST(p > 0.5 AS INT)) FROM pairs WHERE label = 1) AS expected, (SELECT count(*) FROM bst WHERE m > 0.5) / (SELECT count(*) FROM rec WHERE src <> 1) AS observed)")
def orphan_check(d: Data) -> DataFrame:
    return reports.orphans(d.pairs, d.truth, d.rec)


@query(
    "cty:s s1:i src:i id:i name:s addr:s", [Q.REC, Q.TRUTH,
    """own1 AS (SELECT cty, s1 FROM (SELECT DISTINCT s1 FROM truth) JOIN rec ON src = 1 AND id = s1 QUALIFY row_number() OVER (PARTITION BY cty ORDER BY md5('group:' || s1)) <= 4),
    mem AS (SELECT s1, 1 AS src, s1 AS id FROM own1 UNION ALL SELECT t.s1, t.src, t.id FROM truth t JOIN own1 o ON t.s1 = o.s1)"""],
    "(SELECT r.cty, s1, m.src, m.id, name, addr FROM mem m JOIN rec r ON m.src = r.src AND m.id = r.id)",
)
def example_groups(d: Data) -> DataFrame:
    return reports.examples(d.rec, d.truth)


@query("src:i n:i decoy:d", [Q.REC, Q.TRUTH], "(SELECT r.src, count(*) AS n, avg(CAST(t.id IS NULL AS INT)) AS decoy FROM rec r LEFT JOIN (SELECT DISTINCT src, id FROM truth) t ON r.src = t.src AND r.id = t.id WHERE r.src <> 1 GROUP BY r.src)")
def decoy_share(d: Data) -> DataFrame:
    return reports.decoys(d.rec, d.truth)


@query(
    "src:i pairs:i both_numbers:d shared_number:d same_state:d same_name:d addr_empty:d", [Q.REC, Q.TRUTH,
    """ag AS (SELECT t.src, regexp_extract_all(a.addr, '[0-9]+') AS n1, regexp_extract_all(b.addr, '[0-9]+') AS n2, coalesce(a.st = b.st, false) AS st, a.name = b.name AS nm, b.addr = '' AS e
    FROM truth t JOIN rec a ON a.src = 1 AND a.id = t.s1 JOIN rec b ON b.src = t.src AND b.id = t.id)"""],
    """(SELECT src, count(*) AS pairs, avg(CAST(len(n1) > 0 AND len(n2) > 0 AS INT)) AS both_numbers, avg(CAST(list_has_any(n1, n2) AS INT)) FILTER (len(n1) > 0 AND len(n2) > 0) AS shared_number,
    avg(CAST(st AS INT)) AS same_state, avg(CAST(nm AS INT)) AS same_name, avg(CAST(e AS INT)) AS addr_empty FROM ag GROUP BY src)""",
)
def true_pair_agreement(d: Data) -> DataFrame:
    return reports.agreement(pairs.with_records(d.truth, d.rec, ["name", "addr", "st"]))


@query("true_count:i f05:d n:i wrong:i missed:i", [*_CHOSEN, Q.per_record()], "(SELECT least(t, 8) AS true_count, avg(f) AS f05, count(*) AS n, sum(k - a) AS wrong, sum(t - a) AS missed FROM judged GROUP BY least(t, 8))")
def outcome_by_count(d: Data) -> DataFrame:
    return reports.outcome_by_count(decide.per_record(decide.rule_expected(d.pairs, "p", 1.5), d.universe, d.truth))


@query("cty:s f05:d n:i precision:d recall:d", [*_CHOSEN, Q.per_record()], "(SELECT cty, avg(f) AS f05, count(*) AS n, sum(a) / nullif(sum(k), 0) AS precision, sum(a) / nullif(sum(t), 0) AS recall FROM judged GROUP BY cty)")
def outcome_by_country(d: Data) -> DataFrame:
    return reports.outcome_by_country(decide.per_record(decide.rule_expected(d.pairs, "p", 1.5), d.universe, d.truth))


# ------------------------------------------------------------------ models


def _graded(d: Data) -> DataFrame:
    """Labelled documents with a few measurements, as stand-in pairs for the pair model."""
    t = F.coalesce("text", F.lit(""))
    x = d.table("documents").join(d.table("labels"), "doc_id")
    return x.select(
        "doc_id", F.col("quality").cast("double").alias("label"), sampling.fold(F.col("doc_id")).alias("fold"), F.length(t).cast("double").alias("chars"),
        F.size(F.split(t, " ")).cast("double").alias("words"), (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>!]", ""))).cast("double").alias("symbols"),
        F.size(F.array_distinct(F.split(t, " "))).cast("double").alias("distinct_words"), (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))).cast("double").alias("capitals"),
    )


_FEATURES = ["chars", "words", "symbols", "distinct_words", "capitals"]
_GRADED = r"""gd AS (SELECT d.doc_id, CAST(quality AS DOUBLE) AS label, CAST(length(t) AS DOUBLE) AS chars, CAST(len(string_split(t, ' ')) AS DOUBLE) AS words, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>!]', '', 'g')) AS DOUBLE) AS symbols,
  CAST(len(list_distinct(string_split(t, ' '))) AS DOUBLE) AS distinct_words, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS DOUBLE) AS capitals FROM (SELECT *, coalesce(text, '') AS t FROM documents) d JOIN labels l ON d.doc_id = l.doc_id),
gl AS (UNPIVOT gd ON chars, words, symbols, distinct_words, capitals INTO NAME feature VALUE x),
gr2 AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS r FROM gl)"""


@query("feature:s auc:d", [_GRADED], "(SELECT feature, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS auc FROM gr2 GROUP BY feature)")
def auc_by_feature(d: Data) -> DataFrame:
    return reports.auc(_graded(d), "label", _FEATURES)


@query("doc_id:i fold:i label:i p:d")
def gbt_out_of_fold(d: Data) -> DataFrame:
    x = _graded(d)
    return models.out_of_fold(x, _FEATURES, models.fit_folds(x, _FEATURES, rounds=5, depth=4))


@query("doc_id:i p:d")
def gbt_seed_ensemble(d: Data) -> DataFrame:
    x = _graded(d)
    fitted = models.fit_folds(x, _FEATURES, seeds=(11, 22), rounds=3, depth=3)
    return models.score(x, _FEATURES, [m for _, m in fitted])


@query("feature:s gain_pct:d")
def feature_importance(d: Data) -> DataFrame:
    x = _graded(d)
    return models.importance(x, _FEATURES, models.fit_folds(x, _FEATURES, rounds=5, depth=4))


# ------------------------------------------------------------------ joins and windows on the star schema


@query("n_name:s customers:i no_supplier:b", [], "(SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AS no_supplier FROM nation)")
def nation_joins(d: Data) -> DataFrame:
    n = d.table("nation")
    c = d.table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = d.table("supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    out = n.join(c, "n_nationkey", "left").fillna(0, ["customers"])
    return out.join(s, "n_nationkey", "left_semi").withColumn("no_supplier", F.lit(False)).unionByName(out.join(s, "n_nationkey", "left_anti").withColumn("no_supplier", F.lit(True)))


@query("key:i customers:i suppliers:i", [], "(SELECT coalesce(a.k, b.k) AS key, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k)")
def full_outer_join(d: Data) -> DataFrame:
    a = d.table("customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("customers"))
    b = d.table("supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "key", "full")


@query("o_orderkey:i prev_key:i next_key:i", [], "(SELECT o_orderkey, lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey) OVER w AS next_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))")
def order_lag(d: Data) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return d.table("orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev_key"), F.lead("o_orderkey").over(w).alias("next_key"))


@query("l_orderkey:i l_linenumber:i running:d total:d", [], "(SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS running, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)")
def lineitem_cumsum(d: Data) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    running = F.sum("l_quantity").over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0))
    return d.table("lineitem").select("l_orderkey", "l_linenumber", running.alias("running"), F.sum("l_quantity").over(w).alias("total"))
