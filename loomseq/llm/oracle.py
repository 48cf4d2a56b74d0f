"""SQL of the registered queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from .license_scan import RARE, SLACK, TEMPLATES

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links,
  least(e.vec_id, coalesce(p.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(p.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degrees d ON e.vec_id = d.a LEFT JOIN parts p ON e.vec_id = p.a
"""

_WORDS = (r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"""
          r""" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')""")

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
bag AS (SELECT doc_id, sh, count(*) AS n FROM s GROUP BY ALL),
size AS (SELECT doc_id, sum(n) AS t FROM bag GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS o
  FROM bag a JOIN bag b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 5 * o >= 4 * (x.t + y.t - o)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(t, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN low ON d.doc_id = low.a
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, unnest(list_transform(
    range(1, len(ws) - least(len(ws), 13) + 2), lambda k: array_to_string(ws[k:k + least(len(ws), 13) - 1], ' '))) AS w
  FROM i WHERE len(ws) > 0),
spot AS (
  SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, n, k, w FROM spot WHERE w IN (SELECT w FROM win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, list(DISTINCT item_id::VARCHAR) AS l FROM hit JOIN win USING (w) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(list_sort(l), ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_TEMPLATES = ", ".join(
    f"({i}, '{t.label}', {str(t.base).lower()}, {t.text.split()}, {t.key.split()}, {t.key_at})" for i, t in enumerate(TEMPLATES))
_WINDOW = 2 * SLACK

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
templates(template, label, base, whole, part, key_at) AS (VALUES {_TEMPLATES}),
places AS (SELECT template, unnest(whole) AS word, unnest(range(len(whole))) AS place FROM templates),
spot AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS spot_at FROM d),
counts AS (SELECT word, count(DISTINCT r) AS df FROM spot WHERE word IN (SELECT word FROM places) GROUP BY word),
weighed AS (
  SELECT template, word, coalesce(df, 0) AS df,
    floor(1000 * ln(((SELECT count(*) FROM d) + 1.0)::DOUBLE / (coalesce(df, 0) + 1.0)::DOUBLE))::BIGINT + 1 AS idf
  FROM (SELECT DISTINCT template, word FROM places) LEFT JOIN counts USING (word)),
held AS (SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY template ORDER BY df, word) <= {RARE}),
totals AS (SELECT template, sum(idf) AS total FROM held GROUP BY template),
keys AS (
  SELECT d.r, doc_id, template, label, base, spot_at AS start, spot_at - key_at AS rel
  FROM spot JOIN templates t ON word = part[1] JOIN d USING (r) WHERE ws[spot_at + 1:spot_at + len(part)] = part),
near AS (
  SELECT DISTINCT r, template, floor((spot_at - place) / {_WINDOW}.0) + unnest([0, 1]) AS bucket, word, idf
  FROM spot JOIN held USING (word) JOIN places USING (template, word) WHERE r IN (SELECT r FROM keys)),
sums AS (SELECT r, template, bucket, sum(idf) AS got FROM near GROUP BY ALL),
scored AS (
  SELECT k.*, coalesce(got, 0)::DOUBLE / total::DOUBLE AS share
  FROM (SELECT *, floor((rel + {SLACK}) / {_WINDOW}.0) AS bucket FROM keys) k JOIN totals USING (template)
  LEFT JOIN sums USING (r, template, bucket)),
per AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM scored GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN per USING (r)
"""

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS length FROM d WHERE len(ws) > 0),
t AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM t GROUP BY w),
q AS (SELECT item_id, w, count(*) AS q FROM (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark) GROUP BY ALL),
weights AS (SELECT w, floor(1000 * ln((2.0 * n_docs + 2)::DOUBLE / (2.0 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, s),
scores AS (
  SELECT item_id, doc_id, r, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ws) * n_docs) // length))))::BIGINT AS score
  FROM q JOIN weights USING (w) JOIN t USING (w) JOIN d USING (r), s GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in
                   ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = f"""({_EITHER})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: int, pattern: str, value: int, condition: str) -> str:
    """Rows (doc_id, kind, start, end, value) of all matches of a pattern; places follow from the text between matches."""
    return f"""
  SELECT doc_id, owner, {kind} AS kind, m.at AS start, m.at + length(m.whole) AS stop, m.value AS value FROM (
    SELECT doc_id, owner, unnest(list_transform(range(1, len(whole) + 1), lambda i: {{'whole': whole[i], 'value': part[i],
      'at': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0)}})) AS m
    FROM (SELECT doc_id, owner, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {value}) AS part,
      string_split_regex(t, '{pattern}') AS gaps FROM d))
  WHERE {condition}"""


OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
base AS ({_matches(0, _ASSIGN, 2, "length(m.value) >= 8")}
  UNION ALL {_matches(1, "AKIA[A-Z0-9]+", 0, "length(m.whole) >= 16")}
  UNION ALL {_matches(2, "[0-9a-f]{32,}", 0, "true")}),
free AS ({_matches(3, "[A-Za-z0-9+/_=-]{20,}", 0,
                   "regexp_matches(m.value, '[0-9]') AND regexp_matches(m.value, '[A-Za-z]') AND len(list_distinct(string_split(m.value, ''))) >= 10")}),
found AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM free f WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.start < f.stop AND f.start < b.stop)),
values_ AS (SELECT value, count(DISTINCT owner) <= 1 AND count(DISTINCT doc_id) <= 4 AS live FROM found GROUP BY value),
marked AS (
  SELECT doc_id, kind, start, live, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop AS name
  FROM found JOIN values_ USING (value)),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base_names,
    string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_names, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per USING (doc_id)
"""

_STEP = "lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

OP13 = f"""
WITH RECURSIVE polynomial AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), {_STEP}, n)) AS crc),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
keyed AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bytes FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crc[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM keyed, polynomial),
typed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON c.rest = v.word),
near AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS top, max(near_n) AS top_n FROM pairs GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n
  FROM v LEFT JOIN near USING (word)),
chain(word, root, onward) AS (
  SELECT word, word, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.onward = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word AND c.onward IS NULL
"""


def statements() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1, "op4_winnowing_decontamination": OP4, "op5_license_scan": OP5, "op10_bagminhash_near_dedup": OP10,
            "op11_dual_tree_search": OP11, "op12_secret_scan": OP12, "op13_spelling_variants": OP13}
