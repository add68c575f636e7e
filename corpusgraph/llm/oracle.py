"""DuckDB SQL for the queries whose whole result SQL can express."""

from corpusgraph.llm import licenses as _licenses
from corpusgraph.llm.license_rules import KINDS, RULES

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCHMARK_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_BENCHMARK_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCHMARK_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS win
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
p AS (SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT DISTINCT r, p.n, k, item FROM p JOIN i ON i.n = p.n AND i.win = p.win),
x AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS at FROM h) GROUP BY r),
y AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, k, array_to_string(list_slice(w, k, k + 34), ' ') AS win
      FROM (SELECT *, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
g AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS at FROM (SELECT *, count(*) OVER (PARTITION BY win) AS c FROM p) WHERE c > 1),
e AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM d),
k AS (SELECT e.r, count(*) AS n, string_agg(word, ' ' ORDER BY e.at) AS kept FROM e LEFT JOIN g ON g.r = e.r AND g.at = e.at
      WHERE g.r IS NULL GROUP BY e.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

_PIECES = rf"regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')"

COLLOCATIONS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, text FROM documents),
q AS (SELECT r, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w
      FROM (SELECT r, lang, unnest(x) AS piece, generate_subscripts(x, 1) AS p FROM (SELECT r, lang, {_PIECES} AS x FROM d))),
t AS (SELECT lang, sum(len(w)) AS n FROM q GROUP BY lang),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
      FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM q, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
u AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
c AS (SELECT u.lang, u.phrase, u.f AS a, j, x.f AS l, y.f AS r, CAST(n AS HUGEINT) AS n,
             (1000 * CAST(u.f AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM u) u JOIN t USING (lang)
      JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(list_slice(w, 1, j), ' ')
      JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(list_slice(w, j + 1, u.k), ' ')),
s AS (SELECT lang, phrase, unnest(arg_min({{'a': a, 'l': l, 'r': r, 'n': n, 'score': score}}, (score, j))) FROM c GROUP BY lang, phrase),
z AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM (
        SELECT lang, f AS above, array_to_string(list_slice(w, b, b + m - 1), ' ') AS part
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS b FROM (SELECT *, unnest(range(1, k)) AS m FROM u))) o
      WHERE o.lang = s.lang AND o.part = s.phrase AND 100 * o.above >= 100 * s.a)),
v AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
             a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z)
SELECT * FROM v WHERE rank <= 2000"""

_TERMS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"

RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d WHERE len(w) > 0),
b AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
p AS (SELECT i, unnest(t) AS term FROM b),
c AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM p) GROUP BY ALL),
e AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM c, s GROUP BY term, nd),
x AS (SELECT i, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * nd) // nt)))) AS score
      FROM c JOIN e USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY i, r),
y AS (SELECT i, doc_id, CAST(score AS BIGINT) AS score,
             CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank
      FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y JOIN b USING (i) WHERE rank <= 10"""


def licenses() -> str:
    """The rules as a table of patterns; containment by comparing each document's detections with one another."""
    rules = ", ".join(
        f"({n}, {r.kind}, '{r.label}', '{r.keyword}', '{_licenses.numbered(r.pattern)}', {_licenses.STRENGTH[KINDS[r.kind]]})" for n, r in enumerate(RULES))
    phrases = ", ".join(f"('{label}', '{_licenses.numbered(p)}')" for p, label in _licenses.PHRASES.items())
    first = "CAST(regexp_extract(m, '#([0-9]+);', 1) AS BIGINT)"
    last = "CAST(regexp_extract(m, '#([0-9]+);$', 1) AS BIGINT) + 1"
    return f"""
WITH rules(rule, kind, label, keyword, pattern, strength) AS (VALUES {rules}),
phrases(label, pattern) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_BENCHMARK_WORDS} AS w FROM documents),
k AS (SELECT r, array_to_string(list_transform(w, lambda x, i: ' ' || x || '#' || (i - 1) || ';'), '') AS line, w FROM d
      WHERE list_has_any(w, (SELECT list(DISTINCT keyword) FROM rules))),
f AS (SELECT r, rule, kind, label, strength, {first} AS a, {last} AS b
      FROM (SELECT r, rule, kind, label, strength, unnest(regexp_extract_all(line, pattern)) AS m
            FROM k JOIN rules ON list_contains(w, keyword))),
g AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.r = f.r AND o.kind <= f.kind AND o.a <= f.a AND o.b >= f.b
      AND (o.a, -o.b, o.kind, o.rule) < (f.a, -f.b, f.kind, f.rule))),
p AS (SELECT r, label, {first} AS a FROM (SELECT r, label, unnest(regexp_extract_all(line, pattern)) AS m FROM k, phrases)),
q AS (SELECT r, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
      FROM p GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(strength) AS score
      FROM (SELECT r, label, strength FROM g UNION ALL SELECT r, label, {_licenses.STRENGTH["name"]} FROM p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN q USING (r) LEFT JOIN l USING (r)"""
