"""SQL twins, for DuckDB, of the queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACE = r"'[\x20\x09-\x0D]+'"


def _words(table: str, key: str, text: str, between: str) -> str:
    return f"SELECT {key}, list_filter(string_split_regex({text}, {between}), lambda x: x <> '') AS w FROM {table}"


OP1 = f"""WITH d AS ({_words("documents", "doc_id", _LOWER, _ALNUM)}), b AS ({_words("benchmark", "item_id", _LOWER, _ALNUM)}),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN win USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

_TRICKY = r"'\### Assistant: </turn> ok'"

OP2 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_TRICKY} UNION ALL SELECT -7, 1, 'assistant', {_TRICKY}),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\l') AS body,
  replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\l'), ': ', '\c') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY 1"""

OP9 = f"""WITH d AS ({_words("documents", "doc_id", "coalesce(text, '')", _SPACE)}),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM rep),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP10 = f"""WITH RECURSIVE d AS ({_words("documents", "doc_id", _LOWER, _SPACE)}),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.least AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) r USING (doc_id)"""

_TERMS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, {_TERMS}) AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.n + l.v) AS p, 1 + 1000000000 * (k.n + 1) // (l.n + l.v) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM e WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

OP12 = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
k AS (SELECT doc_id, t, n, CAST('0x' || s[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || s[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || s[17:24] AS BIGINT) % 100 AS c, CAST('0x' || s[25:32] AS BIGINT) % 100 AS e FROM h),
f AS (SELECT doc_id, t, n, least(a, b) AS x, greatest(a, b) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, '<P>' || substring(t, 1, x) AS pre, '<S>' || substring(t, y + 1, n - y) AS suf, '<M>' || substring(t, x + 1, y - x) AS mid FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN suf || pre || mid ELSE pre || suf || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
