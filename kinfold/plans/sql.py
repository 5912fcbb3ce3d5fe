"""DuckDB statements of the shared steps, written independently of the DataFrame code."""

from __future__ import annotations

from ..functions import lexicon as L

REC = r"""rec AS (
  SELECT doc_id AS id, CAST(doc_id % 3 + 1 AS INTEGER) AS src, lang AS cty, trim(array_to_string(list_transform(w[1:4], lambda x: x.w), ' ')) AS name,
         trim(concat(CAST(n_chars % 500 AS VARCHAR), ' ', array_to_string(list_transform(w[5:8], lambda x: x.w), ' '))) AS addr, source AS st
  FROM (SELECT *, list_sort(list_transform(list_distinct(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ')),
        lambda x: {'n': -length(x), 'w': x})) AS w FROM documents))"""
TRUTH = r"""hashed AS (
  SELECT doc_id AS id, CAST(doc_id % 3 + 1 AS INTEGER) AS src, lang AS cty,
         md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))) AS h FROM documents),
truth AS (
  SELECT o.s1, h.src, h.id FROM hashed h JOIN (SELECT cty, h, min(id) AS s1 FROM hashed WHERE src = 1 GROUP BY cty, h) o
  ON h.cty = o.cty AND h.h = o.h WHERE h.src <> 1)"""
WEIGHTS = r"""grams AS (
  SELECT cty, 'name' AS field, src, id, unnest(flatten(list_transform(string_split(name, ' '),
         lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', CAST(i AS BIGINT), 3))))) AS t
  FROM rec WHERE name <> ''
  UNION ALL SELECT cty, 'addr', src, id, unnest(string_split(addr, ' ')) FROM rec WHERE addr <> ''),
tok AS (SELECT cty, field, src, id, t, count(*) AS tf FROM grams GROUP BY ALL),
sizes AS (SELECT cty, count(*) AS n FROM rec GROUP BY cty),
dfs AS (SELECT cty, field, t, count(*) AS df FROM tok GROUP BY ALL),
weighted AS (
  SELECT tok.cty, tok.field, src, id, tok.t, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w
  FROM tok JOIN dfs ON tok.cty = dfs.cty AND tok.field = dfs.field AND tok.t = dfs.t JOIN sizes ON tok.cty = sizes.cty
  WHERE df <= greatest(floor(0.2 * n), 2)),
vec AS (SELECT cty, field, src, id, t, w / sqrt(sum(w * w) OVER (PARTITION BY cty, field, src, id)) AS w FROM weighted)"""
SIMS = r"""dots AS (
  SELECT q.id AS s1, p.src, p.id, coalesce(sum(CASE WHEN q.field = 'name' THEN q.w * p.w END), 0) AS n,
         coalesce(sum(CASE WHEN q.field = 'addr' THEN q.w * p.w END), 0) AS a
  FROM vec q JOIN vec p ON q.cty = p.cty AND q.field = p.field AND q.t = p.t WHERE q.src = 1 AND p.src <> 1 GROUP BY ALL),
sims AS (SELECT s1, src, id, round(n, 6) AS name_sim, round(a, 6) AS addr_sim, round((n + a) * 0.5, 6) AS combo_sim FROM dots)"""


def _list(blocker: str, score: str) -> str:
    return f"""SELECT s1, src, id, '{blocker}' AS b, row_number() OVER (PARTITION BY s1, src ORDER BY {score} DESC, id) - 1 AS r, {score} AS s
  FROM {{sims}} WHERE {score} >= 0.05 QUALIFY r < 30"""


def candidates(sims: str = "sims") -> str:
    lists = "\n  UNION ALL ".join(_list(b, s).format(sims=sims) for b, s in (("name", "name_sim"), ("addr", "addr_sim"), ("combo", "combo_sim")))
    return rf"""lists AS (
  {lists}
  UNION ALL SELECT s1, src, id, 'rev', row_number() OVER (PARTITION BY src, id ORDER BY name_sim DESC, s1) - 1 AS r, name_sim
  FROM {sims} WHERE name_sim >= 0.05 QUALIFY r < 5),
wide AS (
  SELECT s1, src, id, max(r) FILTER (b = 'name') AS r_name, max(s) FILTER (b = 'name') AS s_name, max(r) FILTER (b = 'addr') AS r_addr,
         max(s) FILTER (b = 'addr') AS s_addr, max(r) FILTER (b = 'combo') AS r_combo, max(s) FILTER (b = 'combo') AS s_combo,
         max(r) FILTER (b = 'rev') AS r_rev, max(s) FILTER (b = 'rev') AS s_rev FROM lists GROUP BY s1, src, id),
again AS (
  SELECT *, CASE WHEN s_rev IS NOT NULL THEN row_number() OVER (PARTITION BY s1, src ORDER BY s_rev DESC NULLS LAST, id) - 1 END AS q_rev FROM wide),
ranked AS (
  SELECT *, list_min([r_name, r_addr, r_combo, q_rev]) AS min_rank, list_max([s_name, s_addr, s_combo, s_rev]) AS max_score,
         CAST(r_name IS NOT NULL AS INT) + CAST(r_addr IS NOT NULL AS INT) + CAST(r_combo IS NOT NULL AS INT) + CAST(q_rev IS NOT NULL AS INT) AS nb FROM again),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY s1, src ORDER BY min_rank, max_score DESC, id) - 1 AS pos FROM ranked QUALIFY pos < 30)"""


UNIVERSE = r"""universe0 AS (
  SELECT id AS s1, cty, CAST(((CAST(id AS HUGEINT) * 11400714819323198485) % 18446744073709551616) // 4294967296 % 1000 AS INTEGER) AS b FROM rec WHERE src = 1),
universe AS (SELECT s1, cty, CASE WHEN b < 150 THEN -1 ELSE b % 5 END AS fold FROM universe0)"""
PAIRS = r"""pairs AS (
  SELECT c.s1, c.src, c.id, u.cty, u.fold, least(greatest(c.max_score, 0.0), 1.0) AS p, coalesce(c.s_combo, 0.0) AS pb,
         CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS label
  FROM cand c JOIN universe u ON c.s1 = u.s1 LEFT JOIN truth t ON c.s1 = t.s1 AND c.src = t.src AND c.id = t.id)"""
TRUE_COUNTS = "tc AS (SELECT s1, count(*) AS t FROM truth GROUP BY s1)"

BLOCK = [REC, WEIGHTS, SIMS]
CAND = [*BLOCK, candidates()]
SCORED = [*CAND, TRUTH, UNIVERSE, PAIRS]


def own(score: str, name: str = "owned", source: str = "pairs", by: str = "") -> str:
    return f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {by}src, id ORDER BY {score} DESC, s1) = 1)"


def expected(score: str, g: str, source: str = "owned", name: str = "chosen", by: str = "") -> str:
    return rf"""{name}_q AS (SELECT *, pow(greatest(least({score}, 0.999999), 0.0), {g}) AS q FROM {source}),
{name}_k AS (
  SELECT *, row_number() OVER w AS k, sum(q) OVER (w ROWS UNBOUNDED PRECEDING) AS qa, sum(q) OVER (PARTITION BY {by}s1) AS qt,
         exp(sum(ln(1 - q)) OVER (PARTITION BY {by}s1)) AS e0 FROM {name}_q WINDOW w AS (PARTITION BY {by}s1 ORDER BY q DESC, src, id)),
{name}_e AS (SELECT *, round(1.25 * qa / (k + 0.25 * qt), 9) AS ef FROM {name}_k),
{name}_m AS (SELECT *, max(ef) OVER (PARTITION BY {by}s1) AS ef_max FROM {name}_e),
{name}_b AS (SELECT *, min(CASE WHEN ef = ef_max THEN k END) OVER (PARTITION BY {by}s1) AS k_best FROM {name}_m),
{name} AS (SELECT * FROM {name}_b WHERE k <= k_best AND ef_max > e0)"""


def per_record(chosen: str = "chosen", name: str = "judged", cells: str = "", cell_columns: tuple[str, ...] = ()) -> str:
    """F0.5 of each first-source record, for each cell if there are cells."""
    cols = "".join(f"x.{c}, " for c in cell_columns)
    both = "".join(f"{c}, " for c in cell_columns)
    match = "".join(f" AND e.{c} = k.{c}" for c in cell_columns)
    frame = f"(SELECT u.*, {', '.join('z.' + c for c in cell_columns)} FROM universe u CROSS JOIN {cells} z)" if cells else "universe"
    return rf"""{name}_k AS (
  SELECT {cols}x.s1, count(*) AS k, count(t.id) AS a FROM {chosen} x LEFT JOIN truth t ON x.s1 = t.s1 AND x.src = t.src AND x.id = t.id GROUP BY {both}x.s1),
{name} AS (
  SELECT e.*, coalesce(k.k, 0) AS k, coalesce(tc.t, 0) AS t, coalesce(k.a, 0) AS a,
         CASE WHEN coalesce(k.k, 0) + coalesce(tc.t, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(k.a, 0) / greatest(0.25 * coalesce(tc.t, 0) + coalesce(k.k, 0), 1e-9) END AS f
  FROM {frame} e LEFT JOIN {name}_k k ON e.s1 = k.s1{match} LEFT JOIN tc ON e.s1 = tc.s1)"""


def _sql_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def mapped(words: str, table: dict[str, str]) -> str:
    return f"list_transform({words}, lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE w END)"


def _distinct(words: str) -> str:
    """Distinct words in order of first occurrence."""
    return f"list_filter({words}, lambda e, i: list_position({words}, e) = i)"


def normalized(raw: str, name: str = "norm") -> str:
    """Normalised records of a relation (id, src, name, addr, country) whose text is ASCII and whose segments name no state."""
    scrub = "lower(coalesce(name, ''))"
    for pattern, to in L.NAME_SCRUB:
        scrub = f"regexp_replace({scrub}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    keep = lambda words, drop: f"list_filter({words}, lambda x: x <> '' AND x NOT IN ({_sql_list(drop)}))"
    clean = r"regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\bn/a\b|\bm/s\b', ' ', 'g'), '[&+]', ' and ', 'g')"
    address = r"regexp_replace(regexp_replace(" + clean.format("addr") + r", '\b[cswd]\s*/\s*o\b', ' ', 'g'), '\bh\s*\.?\s*no\b', ' no ', 'g')"
    return rf"""{name}_0 AS (
  SELECT id, src, trim(lower(country)) AS cty, regexp_matches(trim(name), '^[@#]') OR regexp_matches(lower(name), '{L.DOMAIN_RE}') OR regexp_matches(lower(name), '^\s*www\b') AS is_handle,
         regexp_matches(lower(name), '\d{{7,}}') AS name_phone, trim({scrub}) AS n, {address} AS a FROM {raw}),
{name}_1 AS (
  SELECT *, regexp_matches(a, '{L.LANDMARK_RE}') AS has_landmark, {keep("string_split(n, ' ')", L.NULL_WORDS)} AS nt, nullif(regexp_extract(n, '{L.ALIAS_RE}', 2), '') AS name_alias,
         string_split(trim(regexp_replace(a, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS aw FROM {name}_0),
{name}_2 AS (
  SELECT *, {mapped('nt', L.NAME_WORDS)} AS nm,
         {keep(mapped("list_transform(aw, lambda v: regexp_replace(v, '^0+([0-9])', chr(92) || '1'))", L.ADDRESS_WORDS), L.ADDRESS_STOP + L.NULL_WORDS)} AS am FROM {name}_1),
{name}_3 AS (SELECT *, {_distinct('nm')} AS ne, {_distinct('am')} AS aw2 FROM {name}_2),
{name}_4 AS (
  SELECT *, list_filter(list_transform(aw2, lambda w: regexp_extract(w, '^([0-9]+)', 1)), lambda w: w <> '') AS nums,
         array_to_string({keep('ne', L.LEGAL + L.WEAK + L.NAME_STOP)}, ' ') AS core, array_to_string({keep('nt', L.SQUASH_DROP)}, '') AS sq FROM {name}_3),
{name} AS (
  SELECT id, src, cty, array_to_string({_distinct('nt')}, ' ') AS name_norm, array_to_string(ne, ' ') AS name_exp, CASE WHEN core = '' THEN array_to_string(ne, ' ') ELSE core END AS name_core,
         CASE WHEN sq = '' THEN replace(array_to_string({_distinct('nt')}, ' '), ' ', '') ELSE sq END AS name_sq, name_alias,
         array_to_string(list_sort(list_filter(ne, lambda x: x IN ({_sql_list(L.LEGAL)}))), ' ') AS legal, false AS name_nonlatin, is_handle, name_phone, array_to_string(aw2, ' ') AS addr_norm,
         '' AS addr_state, {_distinct('nums')} AS addr_nums, nums[1] AS addr_num1, false AS addr_nonlatin, array_to_string(aw2, ' ') = '' AS addr_empty, has_landmark FROM {name}_4)"""


def ratios(pairs: str, name: str = "sim", partial: bool = False) -> str:
    """Similarities of the distinct pairs of texts (a, b) of a relation, both filled, at most 120 characters: (a, b, ratio, tset, tsort, part).

    The longest common subsequence is counted on the bits of one number, a character of the second text at a time.
    """
    lcs = "length({0}) - bit_count(list_reduce(list_prepend({1}, {2}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {1}))"
    masks = "list_transform(string_split({1}, ''), lambda c: list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN {0}[i] = c THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS HUGEINT) ELSE 0 END)))"
    full = "(CAST(1 AS HUGEINT) << CAST(length({0}) AS HUGEINT)) - 1"
    best = f"SELECT a, b, max(200.0 * ({lcs.format('x', 'f', 'm[greatest(0, i) + 1 : i + length(x)]')}) / (length(x) + least(length(y), i + length(x)) - greatest(0, i))) AS part FROM {name}_w GROUP BY a, b"
    part = f""",
{name}_v AS (
  SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM {name}_p UNION SELECT a, b, b, a FROM {name}_p WHERE length(a) = length(b)),
{name}_u AS (SELECT a, b, x, y, {full.format('x')} AS f, {masks.format('x', 'y')} AS m FROM {name}_v),
{name}_w AS (SELECT *, unnest(range(1 - length(x), length(y))) AS i FROM {name}_u),
{name}_b AS ({best})""" if partial else ""  # fmt: skip
    return f"""{name}_p AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> ''),
{name}_t AS (SELECT a, b, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb FROM {name}_p),
{name}_s AS (
  SELECT a, b, array_to_string(list_sort(ta), ' ') AS sa, array_to_string(list_sort(tb), ' ') AS sb, array_to_string(list_sort(list_distinct(list_intersect(ta, tb))), ' ') AS common,
         array_to_string(list_sort(list_distinct(list_filter(ta, lambda x: NOT list_contains(tb, x)))), ' ') AS la,
         array_to_string(list_sort(list_distinct(list_filter(tb, lambda x: NOT list_contains(ta, x)))), ' ') AS lb FROM {name}_t),
{name}_c AS (SELECT *, trim(common || ' ' || la) AS wa, trim(common || ' ' || lb) AS wb FROM {name}_s),
{name}_q AS (SELECT a AS s, b AS t FROM {name}_c UNION SELECT sa, sb FROM {name}_c UNION SELECT wa, wb FROM {name}_c),
{name}_m AS (SELECT s, t, {full.format('s')} AS f, {masks.format('s', 't')} AS m FROM {name}_q),
{name}_r AS (SELECT s, t, 200.0 * ({lcs.format('s', 'f', 'm')}) / (length(s) + length(t)) AS r FROM {name}_m){part},
{name} AS (
  SELECT c.a, c.b, r1.r AS ratio, r2.r AS tsort,
         CASE WHEN common <> '' AND (la = '' OR lb = '') THEN 100.0 WHEN common <> ''
              THEN greatest(r3.r, 200.0 * length(common) / (length(common) + length(wa)), 200.0 * length(common) / (length(common) + length(wb))) ELSE r3.r END AS tset{', part' if partial else ''}
  FROM {name}_c c JOIN {name}_r r1 ON c.a = r1.s AND c.b = r1.t JOIN {name}_r r2 ON c.sa = r2.s AND c.sb = r2.t JOIN {name}_r r3 ON c.wa = r3.s AND c.wb = r3.t
  {f'JOIN {name}_b p ON c.a = p.a AND c.b = p.b' if partial else ''})"""


def rarity(column: str, name: str = "idf") -> str:
    return f"""{name}_words AS (SELECT cty, unnest(list_distinct(string_split({column}, ' '))) AS t FROM rec WHERE {column} <> ''), {name}_n AS (SELECT cty, count(*) AS n FROM rec GROUP BY cty),
{name}_d AS (SELECT cty, t, count(*) AS df FROM {name}_words GROUP BY cty, t),
{name} AS (SELECT d.cty, t, df, ln((n + 1) / (df + 1)) + 1 AS idf, sum(df) OVER (PARTITION BY d.cty ORDER BY df DESC RANGE UNBOUNDED PRECEDING) / sum(df) OVER (PARTITION BY d.cty) AS idfp
  FROM {name}_d d JOIN {name}_n n ON d.cty = n.cty)"""


def weighted_jaccard(column: str, pre: str) -> str:
    """Rarity-weighted overlap of the candidates' words: ``{pre}_pg``."""
    return rf"""{rarity(column, f'{pre}_idf')},
{pre}_pw AS (SELECT c.s1, c.src, c.id, a.cty, list_distinct(string_split(a.{column}, ' ')) AS w1, list_distinct(string_split(b.{column}, ' ')) AS w2
  FROM cand c JOIN rec a ON a.src = 1 AND a.id = c.s1 JOIN rec b ON b.src = c.src AND b.id = c.id),
{pre}_pt AS (SELECT s1, src, id, cty, w1, w2, unnest(list_distinct(list_concat(w1, w2))) AS t FROM {pre}_pw),
{pre}_px AS (SELECT p.s1, p.src, p.id, list_contains(w1, p.t) AS in1, list_contains(w2, p.t) AS in2, idf, idfp FROM {pre}_pt p JOIN {pre}_idf i ON p.cty = i.cty AND p.t = i.t),
{pre}_pa AS (SELECT s1, src, id, sum(idf) FILTER (in1) AS wa, sum(idf) FILTER (in2) AS wb, coalesce(sum(idf) FILTER (in1 AND in2), 0) AS wi,
  coalesce(max(idfp) FILTER (in1 AND in2), 0) AS ps, coalesce(max(idfp) FILTER (NOT (in1 AND in2)), 0) AS pm FROM {pre}_px GROUP BY s1, src, id),
{pre}_pg AS (SELECT s1, src, id, wi / (wa + wb - wi) AS {pre}_wjac, ps AS {pre}_share_p, pm AS {pre}_miss_p FROM {pre}_pa)"""
