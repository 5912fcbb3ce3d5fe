"""DuckDB statements for the contract queries that SQL can express, over whole tables.

Not here: sharding (no CRC-32 in DuckDB), SimHash (no seeded XXH64), token counts and byte-level BPE (tokenizers), language
ID (a learned model).  Those are tested against brute force.
"""

from __future__ import annotations

from . import licenses, mixing, quality

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, reach.root FROM reach JOIN l ON reach.id = l.a),
roots AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id), degrees AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN roots ON v.vec_id = roots.id LEFT JOIN degrees ON v.vec_id = degrees.a
"""

_OP6 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, n, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n = m.n
"""


def _op8() -> str:
    rows = [(tid, base, label, len(w), len(w) - licenses.K + 1, j, " ".join(w[j : j + licenses.K])) for tid, base, label, w in licenses.templates() for j in range(len(w) - licenses.K + 1)]
    values = ", ".join(f"({t}, {b}, '{la}', {tw}, {tg}, {j}, '{g}')" for t, b, la, tw, tg, j, g in rows)
    gap, k = licenses.GAP, licenses.K
    return rf"""
WITH tw(tid, base, label, t_words, t_grams, tpos, gram) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, i - 1 AS place, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
votes AS (SELECT r, tid, any_value(base) AS base, any_value(label) AS label, any_value(t_words) AS t_words, any_value(t_grams) AS t_grams, place - tpos AS diag,
  bit_or(CAST(1 AS BIGINT) << tpos) AS bits, min(place) AS lo, max(place) AS hi FROM g JOIN tw ON g.gram = tw.gram GROUP BY r, tid, place - tpos),
ex AS (SELECT *, bit_count(bits) = t_grams AS exact FROM votes),
nw AS (SELECT *, CASE WHEN exact OR coalesce(lag(exact) OVER x, false) OR coalesce(diag - lag(diag) OVER x, {gap + 1}) > {gap} THEN 1 ELSE 0 END AS fresh FROM ex WINDOW x AS (PARTITION BY r, tid ORDER BY diag)),
cl AS (SELECT *, sum(fresh) OVER (PARTITION BY r, tid ORDER BY diag ROWS UNBOUNDED PRECEDING) AS c FROM nw),
mg AS (SELECT r, tid, any_value(base) AS base, any_value(label) AS label, any_value(t_words) AS t_words, any_value(t_grams) AS t_grams, bool_or(exact) AS exact,
  bit_count(bit_or(bits)) / any_value(t_grams) AS score, min(lo) AS lo, max(hi) AS hi FROM cl GROUP BY r, tid, c),
ok AS (SELECT * FROM mg WHERE exact OR (NOT base AND score >= {licenses.THRESHOLD} AND hi - lo + {k} <= t_words + {2 * gap}))
SELECT d.doc_id, CAST(any_value(len(d.w)) AS BIGINT) AS n_words, count(*) FILTER (base AND exact) AS n_base, min(lo) FILTER (base AND exact) AS first_word, max(lo) FILTER (base AND exact) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND exact), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label IS NOT NULL), '') AS labels,
  coalesce(max(score), 0.0) AS score
FROM d LEFT JOIN ok ON d.r = ok.r GROUP BY d.r, d.doc_id
"""


def _op9() -> str:
    n, m = len(mixing.WEIGHTS), mixing.MAX_REPEAT
    return rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5(t) AS h FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
w AS (SELECT *, {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} + 1] AS weight FROM s),
f AS (SELECT *, ss * {m} / weight AS full_at FROM w),
l AS (SELECT *, (sum(ss) OVER () - coalesce(sum(ss * {m}) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM f WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, ss, CASE WHEN full_at < level THEN CAST(ss * {m} AS DOUBLE) ELSE weight * (SELECT level FROM l WHERE full_at >= level ORDER BY full_at, source NULLS LAST LIMIT 1) END AS target FROM l),
u AS (SELECT doc_id, d.source, size, ss, target, CASE WHEN ss > 0 THEN target / ss ELSE 0.0 END AS rate, length(bin(size)) AS digits, substr(bin(size), 1, 3) AS head,
  CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || h), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT source, digits, head, CAST(floor(u * {mixing.BINS}) AS BIGINT) AS bin, count(*) AS n, any_value(rate - floor(rate)) AS part FROM u GROUP BY source, digits, head, bin),
k AS (SELECT *, sum(n) OVER (x ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, part * sum(n) OVER x AS need FROM n WINDOW x AS (PARTITION BY source, digits, head)),
bo AS (SELECT source, digits, head, coalesce(min((bin + (need - (upto - n)) / n) / {float(mixing.BINS)}) FILTER (upto >= need AND upto - n < need), 0.0) AS bound FROM k GROUP BY source, digits, head)
SELECT doc_id, CAST(size AS BIGINT) AS size, ss AS source_size, target, CAST(size * c AS BIGINT) AS taken, c AS copies
FROM (SELECT u.*, CAST(floor(rate) AS BIGINT) + CAST(u < bound AS BIGINT) AS c FROM u JOIN bo ON u.source IS NOT DISTINCT FROM bo.source AND u.digits = bo.digits AND u.head = bo.head)
"""


def _op10() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << bit} ELSE 0 END" for bit, rule in quality.RULES.values())
    base, kept = (quality.mask_of(quality.POLICIES[p]) for p in ("base", quality.DEFAULT_POLICY))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) z(k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered ON w.r = covered.r),
b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {base} <> 0 AS base_failed, fail_bits & {kept} = 0 AS kept, fail_bits FROM b
"""


ORACLES = {
    "op1_projection_forest": _OP1,
    "op6_warc_archives": _OP6,
    "op8_license_diagonals": _op8(),
    "op9_weighted_mix": _op9(),
    "op10_quality_ledger": _op10(),
}
