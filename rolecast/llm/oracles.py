"""DuckDB SQL for those text operators that SQL can express, over the same whole tables."""

from __future__ import annotations

from .license_texts import NOTICES, TEXTS
from .licenses import COPYRIGHT, SPELLINGS
from .quality_rules import GAMMA, RATES, STRENGTH

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op4() -> str:
    words = lambda c: "regexp_extract_all(" + _ASCII_LOWER.format(f"coalesce({c}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {words("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[a:a + least(10, len(w)) - 1], ' ') AS s
  FROM i, unnest(generate_series(1, greatest(1, len(w) - 9))) t(a) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT rid, k.k AS k, a, array_to_string(w[a:a + k.k - 1], ' ') AS s FROM d, k, unnest(generate_series(1, len(w) - k.k + 1)) t(a)),
hits AS (SELECT rid, a, dw.k AS k, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(a, a + k - 1)) AS p FROM hits) GROUP BY rid),
names AS (SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(names.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names.ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.rid = cov.rid LEFT JOIN names ON d.rid = names.rid"""


def op3() -> str:
    rates = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} AS x FROM r WHERE NOT base_failed" for r in RATES)
    sides = ", ".join(f"max(CASE WHEN rate = '{r}' THEN q1 - (3 * (q3 - q1) + {s}E0) END) AS low_{r}, max(CASE WHEN rate = '{r}' THEN q3 + (3 * (q3 - q1) + {s}E0) END) AS high_{r}" for r, s in RATES.items())
    drawn = lambda q, n, above: f"({n}.n * {n}.{q} + {STRENGTH}::DOUBLE * {above}.{q}) / ({n}.n + {STRENGTH}::DOUBLE) AS {q}"
    fine = " AND ".join(f"coalesce(r.{r} BETWEEN f.low_{r} AND f.high_{r}, true)" for r in RATES)
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT doc_id, lang, source, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT rid, sum(n - 1) AS n FROM (SELECT rid, line, count(*) AS n FROM lines WHERE regexp_matches(line, '{word}') GROUP BY rid, line) GROUP BY rid),
win AS (SELECT rid, a, array_to_string(w[a:a + 7], ' ') AS s FROM d, unnest(generate_series(1, len(w) - 7)) t(a)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(a, a + 7)) AS p FROM (SELECT rid, a, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1) GROUP BY rid),
c AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dups ON d.rid = dups.rid LEFT JOIN rep ON d.rid = rep.rid),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word, n_symbols / greatest(n_words, 1)::DOUBLE AS symbols,
  n_dup_lines / greatest(n_words, 1)::DOUBLE AS dup_lines, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeats FROM c),
b AS (SELECT lang, source, rate, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / ln({GAMMA}::DOUBLE)) AS INT) ELSE -1000000 END AS bucket FROM ({rates})),
s AS (SELECT 0 AS level, lang, source, rate, bucket, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, rate, bucket, count(*) FROM b GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, rate, bucket, count(*) FROM b GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total,
  CASE WHEN bucket = -1000000 THEN 0 ELSE 2 * pow({GAMMA}::DOUBLE, bucket) / ({GAMMA}::DOUBLE + 1) END AS v FROM s),
q AS (SELECT level, lang, source, rate, max(total) AS n, min(CASE WHEN upto >= total * 0.25 THEN v END) AS q1, min(CASE WHEN upto >= total * 0.75 THEN v END) AS q3 FROM u GROUP BY ALL),
ql AS (SELECT a.lang, a.rate, {drawn("q1", "a", "o")}, {drawn("q3", "a", "o")} FROM q a JOIN q o ON a.level = 1 AND o.level = 2 AND a.rate = o.rate),
qg AS (SELECT g.lang, g.source, g.rate, {drawn("q1", "g", "l")}, {drawn("q3", "g", "l")} FROM q g JOIN ql l ON g.level = 0 AND g.lang IS NOT DISTINCT FROM l.lang AND g.rate = l.rate),
f AS (SELECT lang, source, {sides} FROM qg GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fine} AS kept
FROM r LEFT JOIN f ON f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source"""


def op6() -> str:
    def lines(column: str) -> str:
        c = f"lower(coalesce({column}, ''))"
        for a, b in SPELLINGS:
            c = f"replace({c}, {_quoted(a)}, {_quoted(b)})"
        return rf"list_filter(list_transform(string_split(regexp_replace({c}, '[^a-z0-9\n\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    values = lambda rows: ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in rows)
    whole = f"array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '{COPYRIGHT}')), ' ')"
    return f"""
WITH k AS (SELECT sha256({whole}) AS digest, min(id) AS license_id FROM (SELECT id, {lines("t")} AS l FROM (VALUES {values(TEXTS)}) v(id, t)) GROUP BY 1),
n AS (SELECT map(list(digest), list(id)) AS m FROM (SELECT id, sha256(l[1]) AS digest FROM (SELECT id, {lines("t")} AS l FROM (VALUES {values(NOTICES)}) v(id, t)) GROUP BY ALL)),
d AS (SELECT doc_id, {lines("text")} AS l FROM documents),
e AS (SELECT doc_id, CASE WHEN {whole} <> '' THEN sha256({whole}) END AS digest, list_filter(list_transform(l, lambda x: m[sha256(x)]), lambda x: x IS NOT NULL) AS hits FROM d, n)
SELECT doc_id, e.digest AS canonical_sha256, license_id, CAST(len(hits) AS BIGINT) AS n_notices, coalesce(array_to_string(list_sort(list_distinct(hits)), ','), '') AS notices
FROM e LEFT JOIN k ON e.digest = k.digest"""


def op9() -> str:
    raw = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
    replica = lambda name, source: f"""
{name} AS (SELECT number, digest, length, count(*) AS copies FROM (SELECT coalesce(page_id, -1) AS number, CAST(strlen({raw}) AS BIGINT) AS length, sha256({raw}) AS digest FROM {source}) GROUP BY ALL),
{name}_at AS (SELECT number, CAST(coalesce(sum(size) OVER (PARTITION BY floor(number / 1000.0) ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM (SELECT number, sum(length * copies) AS size FROM {name} GROUP BY number))"""  # noqa: E731
    return f"""
WITH once AS (SELECT page_id, url, CASE WHEN page_id % 101 = 7 THEN replace(html, 't', 'T') WHEN page_id % 307 = 11 THEN html[1:length(html) // 2] ELSE html END AS html FROM pages WHERE coalesce(page_id % 997 <> 3, true)),
bad AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE page_id % 503 = 9),{replica("p", "pages")},{replica("q", "bad")},
d AS (SELECT coalesce(p.number, q.number) AS number, coalesce(p.copies, 0) - coalesce(q.copies, 0) AS gap, p.length AS pl, q.length AS ql FROM p FULL JOIN q ON p.number = q.number AND p.digest = q.digest WHERE p.copies IS DISTINCT FROM q.copies),
n AS (SELECT number, sum(greatest(gap, 0)) = 1 AND sum(greatest(-gap, 0)) = 1 AS pair FROM d GROUP BY number),
o AS (SELECT d.number, 'corrupt' AS status, 1 AS copies, max(CASE WHEN gap > 0 THEN pl END) AS pl, max(CASE WHEN gap < 0 THEN ql END) AS ql FROM d JOIN n ON d.number = n.number WHERE pair GROUP BY d.number
  UNION ALL SELECT d.number, CASE WHEN gap > 0 THEN 'missing' ELSE 'extra' END, abs(gap), CASE WHEN gap > 0 THEN pl END, CASE WHEN gap < 0 THEN ql END FROM d JOIN n ON d.number = n.number WHERE NOT pair)
SELECT o.number, CAST(floor(o.number / 1000.0) AS BIGINT) AS file, status, CAST(copies AS BIGINT) AS copies, p_at.off AS primary_offset, q_at.off AS replica_offset, pl AS primary_length, ql AS replica_length
FROM o LEFT JOIN p_at ON o.number = p_at.number LEFT JOIN q_at ON o.number = q_at.number"""


def op11() -> str:
    blanks = r"[\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{blanks}', '', 'g') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size, first_value(doc_id) OVER o AS keep_id, first_value(rid) OVER o AS keep_row, rid FROM d WINDOW o AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST, rid))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rid = keep_row AS kept, sha256(t) AS text_sha256 FROM w"""


def op12() -> str:
    lower = _ASCII_LOWER.format("coalesce(text, '')")
    share = lambda n, total, v: f"1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + {v})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({lower}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_size FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "s.size", "v.v")} AS p, {share("k.total", "v.lang_size", "v.v")} AS q
  FROM s JOIN k ON s.lang = k.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT pairs.lang, pairs.source, 'pair' AS part, pairs.item, coalesce(value, 0) AS value FROM pairs LEFT JOIN f ON f.lang = pairs.lang AND f.source = pairs.source AND f.item = pairs.item
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 200"""


def op13() -> str:
    return """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


ORACLES = {"op3_quality_rules": op3(), "op4_winnowing": op4(), "op6_license_scan": op6(), "op9_warc_fixity": op9(), "op11_exact_dedup": op11(), "op12_source_divergence": op12(), "op13_hard_negatives": op13()}
