"""The registered queries once more, as SQL over the given tables.

Written relationally and row by row (recursive cuts, one row per token), so it
shares no method with the Spark side.
"""

from __future__ import annotations

from ..functions import words as W
from .fixtures import SUBJECTS
from .queries import MAX_SAMPLES, MAX_TOKENS, METADATA, SETTINGS, WINDOW

T, L, S = SETTINGS.tokens_per_shard, SETTINGS.sequence_length, SETTINGS.stride
WORLD, EPOCHS, SEED = SETTINGS.world_size, SETTINGS.epochs, SETTINGS.base_seed
C, P, B = W.MARKER_ID, W.PAD_ID, W.BOS_ID


def _word_id(word: str) -> str:
    return f"(('0x' || substr(md5({word}), 1, 8))::BIGINT % 32000)::INT"


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"

_DOC_TOKENS = f"""
doc_tokens AS (SELECT doc_id, list_transform({_WORDS}, lambda w: {_word_id('w')}) AS tokens FROM documents),
doc_words AS (SELECT doc_id, unnest(tokens) AS tok, unnest(range(1, len(tokens) + 1)) AS i FROM doc_tokens),
lens AS (SELECT doc_id, len(tokens)::BIGINT AS n, row_number() OVER (ORDER BY doc_id) AS i
         FROM doc_tokens WHERE len(tokens) > 0)
"""


def _cut(source: str, name: str) -> str:
    return f"""
{name}_cut(i, doc_id, n, shard_idx, before) AS (
  SELECT i, doc_id, n, 0::BIGINT, 0::BIGINT FROM {source} WHERE i = 1
  UNION ALL
  SELECT l.i, l.doc_id, l.n,
         CASE WHEN c.before + c.n >= {T} THEN c.shard_idx + 1 ELSE c.shard_idx END,
         CASE WHEN c.before + c.n >= {T} THEN 0 ELSE c.before + c.n END
  FROM {name}_cut c JOIN {source} l ON l.i = c.i + 1),
{name} AS (
  SELECT doc_id, shard_idx, row_number() OVER (PARTITION BY shard_idx ORDER BY doc_id) - 1 AS doc_ix,
         before AS "start", before + n AS "end", n FROM {name}_cut)
"""


_INDEX = _DOC_TOKENS + "," + _cut("lens", "idx")

_EPOCH_SEED = f"xor({SEED}::BIGINT << 32, epoch::BIGINT * 1315423911)"

_DEALT = _INDEX + f""",
place AS (
  SELECT epoch::INT AS epoch, shard_idx,
         row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws(':', {_EPOCH_SEED}, shard_idx)), shard_idx) - 1
           AS place
  FROM (SELECT DISTINCT shard_idx FROM idx), (SELECT unnest(range({EPOCHS})) AS epoch)),
turns AS (
  SELECT p.epoch, p.shard_idx, p.place, i.doc_id, i.doc_ix, i.n,
         row_number() OVER (PARTITION BY p.epoch, p.shard_idx
           ORDER BY md5(concat_ws(':', xor({_EPOCH_SEED.replace('epoch', 'p.epoch')}, p.place * 2654435761), i.doc_ix)),
                    i.doc_ix) - 1 AS turn
  FROM idx i JOIN place p USING (shard_idx)),
dealt AS (SELECT *, turn % {WORLD} AS rank FROM turns)
"""

_BINS = _DEALT + f""",
lined AS (SELECT *, row_number() OVER (PARTITION BY epoch, shard_idx, rank ORDER BY turn) AS r FROM dealt),
filled(epoch, shard_idx, rank, place, r, doc_id, doc_ix, n, bin, ord, acc) AS (
  SELECT epoch, shard_idx, rank, place, r, doc_id, doc_ix, n, 0::BIGINT, 0::BIGINT, n FROM lined WHERE r = 1
  UNION ALL
  SELECT l.epoch, l.shard_idx, l.rank, l.place, l.r, l.doc_id, l.doc_ix, l.n,
         CASE WHEN f.acc >= {L} THEN f.bin + 1 ELSE f.bin END,
         CASE WHEN f.acc >= {L} THEN 0 ELSE f.ord + 1 END,
         CASE WHEN f.acc >= {L} THEN l.n ELSE f.acc + l.n END
  FROM filled f JOIN lined l ON l.epoch = f.epoch AND l.shard_idx = f.shard_idx AND l.rank = f.rank AND l.r = f.r + 1),
taken AS (
  SELECT * FROM filled QUALIFY max(acc) OVER (PARTITION BY epoch, shard_idx, rank, bin) >= {L}),
seq_order AS (
  SELECT epoch, shard_idx, rank, bin,
         row_number() OVER (PARTITION BY epoch, rank ORDER BY place, bin) - 1 AS seq_ix
  FROM (SELECT DISTINCT epoch, shard_idx, rank, bin, place FROM taken))
"""

_LONG = _BINS + f""",
cells AS (
  SELECT epoch, shard_idx, rank, bin, ord, 0::BIGINT AS o, {B} AS token, NULL AS raw FROM taken
  UNION ALL
  SELECT epoch, shard_idx, rank, bin, ord, i + (i - 1) // {S}, tok, i FROM taken JOIN doc_words USING (doc_id)
  UNION ALL
  SELECT epoch, shard_idx, rank, bin, ord, 1 + i + (i - 1) // {S}, {C}, NULL
  FROM taken JOIN doc_words USING (doc_id) WHERE i % {S} = 0 AND i < n
  UNION ALL
  SELECT epoch, shard_idx, rank, bin, ord, 1 + n + (n - 1) // {S}, {P}, NULL FROM taken),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY epoch, shard_idx, rank, bin ORDER BY ord, o) - 1 AS pos FROM cells),
seqs AS (SELECT epoch, shard_idx, rank, bin, pos, token, ord, raw FROM placed WHERE pos < {L})
"""

_W = "(PARTITION BY epoch, shard_idx, rank, bin ORDER BY pos)"

_GROUPS = _LONG + f""",
flags AS (SELECT *, (token = {P})::INT AS is_pad, (token = {C})::INT AS is_marker FROM seqs),
grouped AS (
  SELECT *, (sum(is_pad) OVER {_W})::BIGINT AS segment_id,
         (sum(is_pad) OVER {_W} - is_pad)::BIGINT AS mask_doc_id,
         (sum(is_marker) OVER {_W} - is_marker)::BIGINT AS marker_group,
         CASE WHEN token IN ({C}, {P}) THEN -100 ELSE token END AS label
  FROM flags)
"""

_STRUCTURE = _GROUPS + """,
structured AS (
  SELECT *,
    row_number() OVER (PARTITION BY epoch, shard_idx, rank, bin, segment_id ORDER BY pos) - 1 AS position_id,
    coalesce(pos - max(CASE WHEN is_marker = 1 THEN pos END) OVER (PARTITION BY epoch, shard_idx, rank, bin
      ORDER BY pos), pos + 1) AS since_marker,
    CASE WHEN is_pad = 1 THEN 0 ELSE
      row_number() OVER (PARTITION BY epoch, shard_idx, rank, bin, mask_doc_id, marker_group ORDER BY pos)
      + sum(is_marker) OVER (PARTITION BY epoch, shard_idx, rank, bin, mask_doc_id ORDER BY pos) - is_marker
      END::BIGINT AS reach,
    row_number() OVER (PARTITION BY epoch, shard_idx, rank, bin, mask_doc_id ORDER BY pos) AS reach_causal
  FROM grouped)
"""

_PREDICTIONS = _GROUPS + f""",
predicted AS (
  SELECT *, CASE WHEN pos % 3 = 0 THEN coalesce(lag(token) OVER {_W}, 0) ELSE token END AS pred,
    -(('0x' || substr(md5(concat_ws(':', epoch, shard_idx, rank, bin, pos)), 1, 8))::BIGINT % 10000) AS logp_milli,
    coalesce(lag(label) OVER {_W}, -100) AS shifted_label,
    lead(label) OVER {_W} AS next_label
  FROM grouped)
"""

_MMLU = r"""
mmlu AS (
  SELECT source AS subject, doc_id AS item_id,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE
      array_to_string(list_filter(ws, lambda w, i: (i - 1) % 16 >= CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 4 END), ' ') END AS question,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE list_filter(list_transform(range(4),
      lambda c: array_to_string(list_filter(ws, lambda w, i: (i - 1) % 16 = c), ' ')), lambda t: t <> '') END AS choices,
    CASE WHEN doc_id % 7 = 0 THEN list_filter(list_transform(range(3),
      lambda c: array_to_string(list_filter(ws, lambda w, i: (i - 1) % 16 = c), ' ')), lambda t: t <> '') END AS options,
    CASE doc_id % 6 WHEN 0 THEN 'B' WHEN 1 THEN ' c) because' WHEN 2 THEN '' WHEN 3 THEN '2' WHEN 4 THEN '1' END
      AS answer,
    doc_id % 6 <> 4 AS answer_is_text
  FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents)),
picked AS (
  SELECT *, CASE WHEN len(choices) > 0 THEN choices ELSE options END AS ch,
    row_number() OVER (PARTITION BY subject ORDER BY item_id) AS place FROM mmlu),
valid AS (SELECT * FROM picked WHERE question <> '' AND len(ch) > 0 AND answer IS NOT NULL),
answers AS (
  SELECT item_id, CASE
    WHEN NOT answer_is_text THEN trunc(try_cast(answer AS DOUBLE))::INT
    WHEN regexp_matches(upper(trim(answer)), '^[A-Z]') THEN ascii(upper(trim(answer))) - 65 END AS answer_idx
  FROM valid),
letters AS (SELECT v.item_id, v.ch, v.question, unnest(range(least(len(ch), 26))) AS j FROM valid v),
prompts AS (
  SELECT v.item_id, concat(regexp_replace(any_value(v.question), '^\s+|\s+$', '', 'g'), chr(10),
    string_agg(concat(chr((65 + j)::INT), '. ', regexp_replace(v.ch[j + 1], '^\s+|\s+$', '', 'g')), chr(10) ORDER BY j),
    chr(10), 'Answer:') AS prompt
  FROM letters v GROUP BY v.item_id),
logp AS (
  SELECT d.doc_id AS item_id, c.c AS choice_idx, p.p AS pos, (p.p >= 4)::INT AS label,
    -(('0x' || substr(md5(concat_ws(':', d.doc_id, c.c, p.p)), 1, 8))::BIGINT % 10000) AS logp_milli
  FROM documents d, (SELECT unnest(range(4)) AS c) c, (SELECT unnest(range(6)) AS p) p),
scores AS (
  SELECT item_id, choice_idx, sum(logp_milli) FILTER (label = 1)::BIGINT AS score_milli FROM logp GROUP BY ALL)
"""


def _marked(ids: str, stride: int, fill: int) -> str:
    """List with ``fill`` after every ``stride`` elements, none at the end."""
    n = f"len({ids})"
    return (f"list_transform(CASE WHEN {n} = 0 THEN []::BIGINT[] ELSE range({n} + ({n} - 1) // {stride}) END, "
            f"lambda p: CASE WHEN p % {stride + 1} = {stride} THEN {fill} ELSE {ids}[p - p // {stride + 1} + 1] END)")


def _with(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def _folded(ctes: str, source: str, *names: str, extra: str = "") -> str:
    cols = ", ".join(f"string_agg({n}::VARCHAR, ',' ORDER BY pos) AS {n}" for n in names)
    return _with(ctes, f"SELECT epoch, shard_idx, rank, bin, {cols} FROM {source} {extra} GROUP BY ALL")


_CAUSAL = "q.pos >= k.pos AND q.mask_doc_id = k.mask_doc_id"
_MARKED = _CAUSAL + " AND (q.marker_group = k.marker_group OR k.is_marker = 1) AND q.is_pad = 0"
_NEAR = _CAUSAL + f" AND (q.pos - k.pos < {WINDOW} OR k.is_marker = 1) AND q.is_pad = 0"


def _tiles(admitted: str) -> str:
    return _with(_GROUPS, f"""
      SELECT epoch, shard_idx, rank, bin, q_block, k_block, cells,
        cells = least(128, n - q_block * 128) * least(128, n - k_block * 128) AS "full"
      FROM (SELECT q.epoch, q.shard_idx, q.rank, q.bin, q.pos // 128 AS q_block, k.pos // 128 AS k_block,
              count(*) AS cells
            FROM grouped q JOIN grouped k ON q.epoch = k.epoch AND q.shard_idx = k.shard_idx AND q.rank = k.rank
              AND q.bin = k.bin AND q.mask_doc_id = k.mask_doc_id
            WHERE {admitted} GROUP BY ALL)
      JOIN (SELECT epoch, shard_idx, rank, bin, count(*) AS n FROM grouped GROUP BY ALL)
        USING (epoch, shard_idx, rank, bin)""")


_VECTORS = """
v AS (SELECT vec_id // 64 AS seq, (vec_id % 64)::INT AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS vec
      FROM embeddings)
"""
_LOGP = """
x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS logit, unnest(range(len(embedding)))::INT AS token
      FROM embeddings),
m AS (SELECT vec_id, max(logit) AS top FROM x GROUP BY 1),
z AS (SELECT vec_id, top + ln(sum(exp(logit - top))) AS norm FROM x JOIN m USING (vec_id) GROUP BY vec_id, top),
lp AS (SELECT vec_id, label, token, logit, logit - norm AS logp FROM x JOIN z USING (vec_id))
"""

_VOCAB = r"""
passages AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM benchmark),
pwords AS (SELECT item_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM passages),
base AS (SELECT token, row_number() OVER (ORDER BY md5(token), token) - 1 AS id FROM (SELECT DISTINCT token FROM pwords)),
vocab AS (
  SELECT token, id::INT AS id, false AS is_special FROM base
  UNION ALL SELECT '<|checkpoint|>', (SELECT max(id) + 1 FROM base)::INT, true
  UNION ALL SELECT '<|pad|>', (SELECT max(id) + 2 FROM base)::INT, true
  UNION ALL SELECT '<|bos|>', (SELECT max(id) + 3 FROM base)::INT, true)
"""


def _index_json() -> str:
    meta = ",".join(f'"{k}":"{v}"' for k, v in METADATA.items())
    return _with(_INDEX, f"""
      SELECT shard_idx, 'shard_' || lpad(shard_idx::VARCHAR, 5, '0') AS stem, sum(n)::BIGINT AS num_tokens,
        '{{"documents":[' || string_agg('{{"start":' || "start" || ',"end":' || "end" || '}}', ',' ORDER BY "start")
        || '],"num_tokens":' || sum(n)::BIGINT || ',"metadata":{{{meta}}}}}' AS index_json
      FROM idx GROUP BY shard_idx""")


def statements() -> dict[str, str]:
    keys = "epoch, shard_idx, rank, bin"
    doc_list = lambda expr: _with(_DOC_TOKENS, f"""
      SELECT doc_id, array_to_string({expr}, ',') AS tokens FROM doc_tokens""")
    marked = _marked("tokens", S, C)
    capped = _DOC_TOKENS + f""",
      few AS (SELECT doc_id, n, row_number() OVER (ORDER BY doc_id) AS i FROM (
        SELECT l.doc_id, l.n, coalesce(sum(l.n) OVER (ORDER BY l.doc_id ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING), 0) AS b
        FROM lens l WHERE l.doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {MAX_SAMPLES}))
        WHERE b < {MAX_TOKENS // 4}),""" + _cut("few", "idx")
    out = {
        "sequence_summary": _with(_STRUCTURE, f"""
          SELECT {keys}, count(*) AS tokens, max(mask_doc_id) + 1 AS documents, sum(is_marker)::BIGINT AS markers,
            sum(is_pad)::BIGINT AS pads, count(*) FILTER (label = -100) AS masked_labels,
            max(position_id) AS longest_position, sum(reach)::BIGINT AS reach_sum,
            round(sum(reach)::DOUBLE / count(*), 6) AS mean_reach
          FROM structured GROUP BY ALL"""),
        "tokenize_docs": _with(_DOC_TOKENS, """
          SELECT doc_id, len(tokens) AS n, array_to_string(tokens, ',') AS tokens FROM doc_tokens"""),
        "conversation_tokens": f"""
          SELECT doc_id, len(tokens) AS n, array_to_string(tokens, ',') AS tokens FROM (
            SELECT doc_id, list_transform({_WORDS}, lambda w: {_word_id('w')}) AS tokens FROM (
              SELECT conv_id AS doc_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10)
                ORDER BY turn, coalesce(role, '') || ': ' || coalesce(text, '')) AS text
              FROM conversations GROUP BY conv_id))""",
        "insert_markers": doc_list(marked),
        "insert_markers_labels": _with(_DOC_TOKENS, f"""
          SELECT doc_id, array_to_string({_marked('tokens', 5, C)}, ',') AS tokens,
            array_to_string({_marked('labels', 5, 0)}, ',') AS labels
          FROM (SELECT doc_id, tokens, list_transform(range(len(tokens)), lambda i: i % 2) AS labels FROM doc_tokens)"""),
        "wrap_documents": doc_list(f"list_concat([{B}], list_concat({marked}, [{P}]))"),
        "sample_cap": f"""
          SELECT doc_id, length(text) AS text_length FROM documents ORDER BY doc_id LIMIT {MAX_SAMPLES}""",
        "token_cap": _with(_DOC_TOKENS, f"""
          SELECT * FROM (SELECT doc_id, n AS len, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN
              UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start", i - 1 AS rn FROM lens)
          WHERE "start" < {MAX_TOKENS}"""),
        "capped_shards": _with(capped, 'SELECT doc_id, shard_idx, doc_ix, "start", "end" FROM idx'),
        "shard_assign": _with(_INDEX, 'SELECT doc_id, shard_idx, doc_ix, "start", "end" FROM idx'),
        "shard_index": _index_json(),
        "dataset_metadata": _with(_INDEX + """,
          langs AS (SELECT shard_idx, string_agg(DISTINCT lang, ',' ORDER BY lang) AS l
                    FROM idx JOIN documents USING (doc_id) GROUP BY shard_idx)""", """
          SELECT name, value, (SELECT count(DISTINCT l) = 1 FROM langs) AS all_equal FROM (""" + " UNION ALL ".join(
            f"SELECT '{k}' AS name, '{v}' AS value" for k, v in METADATA.items()) + """
          UNION ALL SELECT 'languages', l FROM langs WHERE shard_idx = 0)"""),
        "run_totals": _with(_INDEX, """
          SELECT count(*) AS documents, sum(n)::BIGINT AS tokens, max(shard_idx) + 1 AS shards FROM idx"""),
        "skipped_documents": f"""
          SELECT count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (len({_WORDS}) = 0) AS empty_text
          FROM documents""",
        "progress": _with(_DOC_TOKENS, """
          SELECT samples, documents, tokens FROM (
            SELECT row_number() OVER w AS samples, (count(*) FILTER (len(tokens) > 0) OVER w)::BIGINT AS documents,
              (sum(len(tokens)) OVER w)::BIGINT AS tokens
            FROM doc_tokens WINDOW w AS (ORDER BY doc_id)) WHERE samples % 100 = 0"""),
        "doc_slices": _with(_INDEX, """
          SELECT shard_idx, doc_ix, array_to_string(tokens, ',') AS tokens FROM idx JOIN doc_tokens USING (doc_id)"""),
        "epoch_shard_order": _with(_DEALT, "SELECT epoch, shard_idx, place FROM place"),
        "doc_shuffle_rank": _with(_DEALT, "SELECT epoch, shard_idx, doc_ix, doc_id, place, turn, rank FROM dealt"),
        "pack_bins": _with(_BINS, f"""
          SELECT {keys}, ord, doc_id, doc_ix, n AS len, seq_ix FROM taken JOIN seq_order USING ({keys})"""),
        "packed_sequences": _folded(_LONG, "seqs", "token").replace("AS token FROM", "AS tokens FROM"),
        "rank_sequences": _with(_LONG, f"""
          SELECT epoch, seq_ix, string_agg(token::VARCHAR, ',' ORDER BY pos) AS tokens
          FROM seqs JOIN seq_order USING ({keys}) WHERE rank = 1 GROUP BY ALL"""),
        "packing_loss": _with(_LONG, f"""
          SELECT {keys}, count(*) AS documents, sum(n)::BIGINT AS raw_taken, sum(kept)::BIGINT AS raw_kept,
            sum(n - kept)::BIGINT AS raw_cut, count(*) FILTER (kept = 0) AS documents_lost
          FROM (SELECT t.epoch, t.shard_idx, t.rank, t.bin, t.ord, t.n, count(s.raw) AS kept
                FROM taken t LEFT JOIN seqs s USING ({keys}, ord) GROUP BY ALL) GROUP BY ALL"""),
        "packing_rest": _with(_BINS, """
          SELECT epoch, shard_idx, rank, count(*) AS documents, sum(n)::BIGINT AS tokens,
            count(*) FILTER (NOT done) AS documents_open, coalesce(sum(n) FILTER (NOT done), 0)::BIGINT AS tokens_open
          FROM (SELECT f.*, t.doc_id IS NOT NULL AS done FROM filled f
                LEFT JOIN taken t USING (epoch, shard_idx, rank, bin, ord)) GROUP BY ALL"""),
        "pad_counts": _with(_GROUPS, f"""
          SELECT {keys}, sum(is_pad)::BIGINT AS pads, sum(is_pad) > 0 AS has_pads FROM grouped GROUP BY ALL"""),
        "position_ids": _folded(_STRUCTURE, "structured", "position_id", "segment_id"),
        "mask_groups": _folded(_GROUPS, "grouped", "mask_doc_id", "marker_group"),
        "since_last_marker": _folded(_STRUCTURE, "structured", "since_marker"),
        "attention_reach": _folded(_STRUCTURE, "structured", "reach"),
        "attention_reach_causal": _folded(_STRUCTURE, "structured", "reach_causal"),
        "label_mask": _folded(_GROUPS, "grouped", "label"),
        "structure_arrays": _folded(
            _STRUCTURE, "structured", "segment_id", "position_id", "mask_doc_id", "marker_group", "since_marker",
            "label", "reach", "reach_causal"),
        "distinct_segments": _with(_GROUPS, f"""
          SELECT {keys}, string_agg(DISTINCT segment_id::VARCHAR, ',' ORDER BY segment_id::VARCHAR) AS segments
          FROM grouped GROUP BY ALL""").replace(
            "string_agg(DISTINCT segment_id::VARCHAR, ',' ORDER BY segment_id::VARCHAR)",
            "array_to_string(list_sort(list(DISTINCT segment_id)), ',')"),
        "attention_edges": _with(_GROUPS, f"""
          SELECT {keys}, sum(seen)::BIGINT AS edges, sum(key_sum)::BIGINT AS key_sum, max(seen) AS widest FROM (
            SELECT q.epoch, q.shard_idx, q.rank, q.bin, q.pos, count(*) AS seen, sum(k.pos) AS key_sum
            FROM grouped q JOIN grouped k ON q.epoch = k.epoch AND q.shard_idx = k.shard_idx AND q.rank = k.rank
              AND q.bin = k.bin AND q.mask_doc_id = k.mask_doc_id
            WHERE q.pos >= k.pos AND (q.marker_group = k.marker_group OR k.is_marker = 1) AND q.is_pad = 0
            GROUP BY ALL) GROUP BY ALL"""),
        "mask_block_occupancy": _tiles(_MARKED),
        "mask_block_occupancy_causal": _tiles(_CAUSAL),
        "mask_tiles": _tiles(_NEAR),
        "mask_tile_skips": _with(_GROUPS + """,
          zones AS (
            SELECT epoch, shard_idx, rank, bin, pos // 128 AS b, min(pos) AS p0, max(pos) AS p1, min(mask_doc_id) AS d0,
              max(mask_doc_id) AS d1, max(is_marker) AS m1, min(is_marker) AS m0, min(is_pad) AS z0, max(is_pad) AS z1
            FROM grouped GROUP BY ALL)""", f"""
          SELECT epoch, shard_idx, rank, bin, count(*) AS n_tiles, count(*) FILTER (NOT may) AS skipped,
            count(*) FILTER (must) AS filled, count(*) FILTER (may AND NOT must) AS tested
          FROM (
            SELECT q.epoch, q.shard_idx, q.rank, q.bin,
              q.p1 >= k.p0 AND q.d0 <= k.d1 AND k.d0 <= q.d1 AND (q.p0 - k.p1 < {WINDOW} OR k.m1 = 1) AND q.z0 = 0 AS may,
              q.p0 >= k.p1 AND q.d0 = q.d1 AND k.d0 = k.d1 AND q.d0 = k.d0 AND (q.p1 - k.p0 < {WINDOW} OR k.m0 = 1) AND q.z1 = 0 AS must
            FROM zones q JOIN zones k ON q.epoch = k.epoch AND q.shard_idx = k.shard_idx AND q.rank = k.rank AND q.bin = k.bin)
          GROUP BY ALL"""),
        "prefix_view": _with(_GROUPS, f"""
          SELECT {keys}, any_value(n) AS positions, count(k_pos) AS edges, coalesce(sum(k_pos), 0)::BIGINT AS key_sum FROM (
            SELECT q.epoch, q.shard_idx, q.rank, q.bin, k.pos AS k_pos FROM grouped q JOIN grouped k
              ON q.epoch = k.epoch AND q.shard_idx = k.shard_idx AND q.rank = k.rank AND q.bin = k.bin
              AND q.mask_doc_id = k.mask_doc_id
            WHERE q.pos < 256 AND k.pos < 256 AND {_MARKED})
          JOIN (SELECT {keys}, least(count(*), 256) AS n FROM grouped GROUP BY ALL) USING ({keys}) GROUP BY ALL"""),
        "observed_totals": _with(_DOC_TOKENS, f"""
          SELECT count(*) AS rows, count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (len({_WORDS}) = 0) AS empty_text,
            count(*) FILTER (len({_WORDS}) > 0) AS documents, (SELECT sum(n) FROM lens)::BIGINT AS tokens FROM documents"""),
        "violations": f"""
          WITH twice AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0),
          keys AS (SELECT doc_id, count(*) AS n FROM twice GROUP BY doc_id)
          SELECT 'null_key' AS check, coalesce(sum(n) FILTER (doc_id IS NULL), 0)::BIGINT AS rows FROM keys
          UNION ALL SELECT 'repeated_key', coalesce(sum(n) FILTER (doc_id IS NOT NULL AND n > 1), 0)::BIGINT FROM keys
          UNION ALL SELECT 'null_text', count(*) FILTER (text IS NULL) FROM twice
          UNION ALL SELECT 'id_outside_range', 0
          UNION ALL SELECT 'no_tokens', count(*) FILTER (len({_WORDS}) = 0) FROM twice""",
        "corpus_split": "SELECT doc_id, length(text) AS text_length FROM documents WHERE lang = 'de'",
        "logit_loss": _with(_LOGP, """
          SELECT label, count(*) FILTER (token = label) AS positions, round(avg(-logp) FILTER (token = label), 6) AS loss
          FROM lp GROUP BY label"""),
        "maybe_append_marker": _with(_DOC_TOKENS, f"""
          SELECT doc_id, since, len(m) + (since >= 7)::INT AS length,
            CASE WHEN since >= 7 THEN {C} ELSE m[-1] END AS last_id
          FROM (SELECT doc_id, m, CASE WHEN len(tokens) <= {S} THEN len(tokens)
                  ELSE len(tokens) - ((len(tokens) - 1) // {S}) * {S} END AS since
                FROM (SELECT doc_id, tokens, {marked} AS m FROM doc_tokens))"""),
        "prompt_sequences": _with(_MMLU + f""",
          texts AS (SELECT item_id, j AS choice_idx,
            list_transform(list_filter(string_split_regex(prompt, '\\s+'), lambda w: w <> ''),
              lambda w: {_word_id('w')}) AS p, [{_word_id("chr((65 + j)::INT)")}] AS c
            FROM letters JOIN prompts USING (item_id)),
          joined AS (SELECT item_id, choice_idx, list_concat([{B}], list_concat(p, c)) AS ids,
            list_transform(range(len(p) + 2), lambda i: (i > len(p))::INT) AS labels FROM texts)""", f"""
          SELECT item_id, choice_idx, array_to_string({_marked('ids', 7, C)}, ',') AS tokens,
            array_to_string({_marked('labels', 7, 0)}, ',') AS labels FROM joined"""),
        "repeated_pairs": _with(_DOC_TOKENS, f"""
          SELECT doc_id, r AS repeat, concat(m, ',{P},', m, ',{P}') AS tokens
          FROM (SELECT doc_id, array_to_string({_marked('ids', 7, C)}, ',') AS m
                FROM (SELECT doc_id, list_concat([{B}], tokens) AS ids FROM doc_tokens)),
            (SELECT unnest(range(2)) AS r)"""),
        "special_filter": _with(_LONG, f"""
          SELECT {keys}, token, count(*) AS n FROM seqs WHERE token IN ({B}, {C}, {P}) GROUP BY ALL"""),
        "ordinary_filter": _with(_LONG, f"""
          SELECT {keys}, count(*) AS n, sum(token)::BIGINT AS token_sum
          FROM seqs WHERE token NOT IN ({B}, {C}, {P}) GROUP BY ALL"""),
        "vocabulary": _with(_VOCAB, "SELECT token, id, is_special FROM vocab"),
        "special_ids": _with(_VOCAB, """
          SELECT string_agg(id::VARCHAR, ',' ORDER BY id) AS special_ids FROM vocab WHERE is_special"""),
        "encode_docs": _with(_VOCAB + f""",
          dw AS (SELECT doc_id, unnest({_WORDS}) AS token FROM documents),
          coded AS (
            SELECT doc_id, count(*) AS n, sum(coalesce(id, -1))::BIGINT AS id_sum, count(*) FILTER (id IS NULL) AS unknown
            FROM dw LEFT JOIN vocab USING (token) GROUP BY doc_id)""", """
          SELECT doc_id, coalesce(n, 0) AS n, coalesce(id_sum, 0)::BIGINT AS id_sum, coalesce(unknown, 0) AS unknown
          FROM documents LEFT JOIN coded USING (doc_id)"""),
        "decode_docs": _with(_VOCAB, """
          SELECT item_id, array_to_string(ws, ' ') AS text FROM passages"""),
        "mmlu_prompts": _with(_MMLU, "SELECT item_id, prompt FROM prompts"),
        "mmlu_choices": _with(_MMLU, "SELECT item_id, j AS choice_idx, ' ' || chr((65 + j)::INT) AS completion FROM letters"),
        "mmlu_answers": _with(_MMLU, "SELECT item_id, answer_idx FROM answers WHERE answer_idx IS NOT NULL"),
        "first_items": _with(_MMLU, "SELECT subject, item_id FROM picked WHERE place <= 25"),
        "subject_items": f"""
          SELECT source AS subject, count(*) AS items, sum(doc_id)::BIGINT AS id_sum FROM documents
          WHERE source IN ({', '.join(repr(s) for s in SUBJECTS)}) GROUP BY source""",
        "choice_scores": _with(_MMLU, "SELECT item_id, choice_idx, score_milli FROM scores"),
        "best_choice": _with(_MMLU, """
          SELECT item_id, choice_idx AS pred_idx, score_milli FROM scores
          QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score_milli DESC, choice_idx) = 1"""),
        "subject_accuracy": _with(_MMLU + f""",
          wanted AS (SELECT unnest([{', '.join(repr(s) for s in SUBJECTS)}]) AS subject),
          guess AS (
            SELECT s.item_id, s.choice_idx FROM scores s JOIN valid v USING (item_id) WHERE s.choice_idx < len(v.ch)
            QUALIFY row_number() OVER (PARTITION BY s.item_id ORDER BY score_milli DESC, choice_idx) = 1),
          graded AS (
            SELECT v.subject, (g.choice_idx = a.answer_idx)::INT AS ok
            FROM valid v JOIN answers a USING (item_id) JOIN guess g USING (item_id)
            WHERE v.place <= 25 AND a.answer_idx IS NOT NULL AND v.subject IN (SELECT subject FROM wanted))""", """
          SELECT subject, coalesce(sum(ok), 0)::BIGINT AS correct, count(ok) AS total,
            round(coalesce(avg(ok), 0), 6) AS accuracy FROM wanted LEFT JOIN graded USING (subject) GROUP BY subject
          UNION ALL
          SELECT 'overall', sum(ok)::BIGINT, count(*), round(avg(ok), 6) FROM graded"""),
        "next_token_targets": _with(_LONG, f"""
          SELECT {keys}, string_agg(target::VARCHAR, ',' ORDER BY pos) AS target
          FROM (SELECT *, lead(token) OVER {_W} AS target FROM seqs) WHERE target IS NOT NULL GROUP BY ALL"""),
        "shifted_labels": _folded(_PREDICTIONS, "predicted", "shifted_label"),
        "marker_accuracy": _with(_PREDICTIONS, f"""
          SELECT {keys}, count(*) FILTER (is_marker = 1) = 0 AS undefined,
            round(avg((pred = shifted_label)::INT) FILTER (is_marker = 1), 6) AS marker_accuracy
          FROM predicted GROUP BY ALL"""),
        "masked_loss": _with(_PREDICTIONS, f"""
          SELECT {keys}, round(avg(-logp_milli), 4) AS loss_milli
          FROM predicted WHERE next_label IS NOT NULL AND next_label <> -100 GROUP BY ALL"""),
        "metric_log": _with(_PREDICTIONS + f""",
          steps AS (
            SELECT epoch, rank, seq_ix AS step,
              round(avg(-logp_milli) FILTER (next_label IS NOT NULL AND next_label <> -100), 4) AS loss,
              round(avg((pred = shifted_label)::INT) FILTER (is_marker = 1), 6) AS acc
            FROM predicted JOIN seq_order USING ({keys}) GROUP BY ALL)""", """
          SELECT 'epoch' || epoch || '-rank' || rank AS run_id, step, metric, value
          FROM (SELECT *, unnest(['loss_milli', 'ckpt_acc']) AS metric, unnest([loss, acc]) AS value FROM steps
                WHERE step % 10 = 0 OR step = 1)"""),
        "scaled_scores": _with(_VECTORS + """,
          s AS (SELECT q.seq, q.pos AS q_pos, k.pos AS k_pos,
                  list_dot_product(q.vec, k.vec) / sqrt(len(q.vec)) - 0.01::DOUBLE * (q.pos - k.pos) AS score
                FROM v q JOIN v k ON q.seq = k.seq AND q.pos >= k.pos)""", """
          SELECT seq, q_pos, count(*) AS keys, round(sum(score), 6) AS score_sum, round(max(score), 6) AS best,
            arg_max(k_pos, score) AS best_key FROM s GROUP BY ALL"""),
        "plain_scores": _with(_VECTORS, """
          SELECT q.seq, q.pos AS q_pos, count(*) AS keys,
            round(sum(list_dot_product(q.vec, k.vec) * 0.5::DOUBLE), 6) AS score_sum
          FROM v q JOIN v k ON q.seq = k.seq GROUP BY ALL"""),
        "log_softmax": _with(_LOGP, """
          SELECT vec_id, round(max(logp) FILTER (token = label), 6) AS target_logp, round(sum(logp), 4) AS logp_sum
          FROM lp GROUP BY vec_id"""),
        "log_softmax_rows": _with(_LOGP, """
          SELECT vec_id, token, round(logp, 6) AS target_logp FROM lp WHERE token = label"""),
        "vocab_argmax": _with(_LOGP, """
          SELECT vec_id, token AS pred FROM x
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) = 1"""),
        "scalar_helpers": """
          SELECT doc_id, n_chars // 128 * 128 AS floor_128, (n_chars + 127) // 128 AS tiles,
            -(n_chars // 128) AS negative_tiles, (n_chars + 127) // 128 * 128 AS round_128,
            xor(42::BIGINT << 32, doc_id * 1315423911) AS epoch_seed,
            xor(xor(42::BIGINT << 32, 3::BIGINT * 1315423911), doc_id * 2654435761) AS document_seed,
            'shard_' || lpad(doc_id::VARCHAR, 5, '0') AS stem,
            'Attention Scores ' || upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || source[2:] AS title
          FROM documents""",
    }
    prompts = out["prompt_sequences"]
    out["choice_targets"] = f"""
      SELECT item_id, choice_idx, pos FROM (
        SELECT item_id, choice_idx, unnest(range(len(l) - 1)) AS pos, unnest(l[2:]) AS following
        FROM (SELECT item_id, choice_idx, string_split(labels, ',') AS l FROM ({prompts}))) WHERE following = '1'"""
    out["encode_docs_skewed"] = out["encode_docs"]
    out["token_cap_early"] = out["token_cap"]
    out["vocab_argmax_rows"] = out["vocab_argmax"]
    out["metric_table"] = out["metric_log"]
    out["stream_tokenize"] = out["tokenize_docs"]
    out["stream_shard_assign"] = out["shard_assign"]
    out["raw_shard_sequences"] = out["packed_sequences"]
    out["raw_shard_round_trip"] = _with(_INDEX, """
      SELECT shard_idx, doc_ix, "start", "end", array_to_string(tokens, ',') AS tokens
      FROM idx JOIN doc_tokens USING (doc_id)""")
    out["raw_shard_stream"] = out["raw_shard_round_trip"]
    out["raw_shard_pick"] = out["raw_shard_round_trip"] + " WHERE shard_idx % 3 = 0 AND doc_ix >= 5 AND doc_ix < 20"
    out["stream_packed_sequences"] = out["packed_sequences"]
    out["stream_packing_rest"] = out["packing_rest"]
    out["stream_metric_log"] = out["metric_log"]
    out["raw_shard_index"] = _with(_INDEX, """
      SELECT shard_idx, 'shard_' || lpad(shard_idx::VARCHAR, 5, '0') AS stem, count(*) AS documents,
        sum(n)::BIGINT AS num_tokens, sum(n)::BIGINT AS written FROM idx GROUP BY shard_idx""")
    out["shard_table_round_trip"] = _with(_INDEX, """
      SELECT shard_idx, count(*) AS rows, sum(list_sum(tokens))::BIGINT AS token_sum, count(*) AS documents,
        sum(n)::BIGINT AS num_tokens FROM idx JOIN doc_tokens USING (doc_id) GROUP BY shard_idx""")
    out["stream_pack_bins"] = _with(_DOC_TOKENS + f""",
      dealt AS (SELECT doc_id, n, (doc_id % {WORLD})::INT AS rank,
        row_number() OVER (PARTITION BY doc_id % {WORLD} ORDER BY doc_id) AS r FROM lens),
      filled(rank, r, doc_id, n, bin, ord, acc, seq_start) AS (
        SELECT rank, r, doc_id, n, 0::BIGINT, 0::BIGINT, n, 0::BIGINT FROM dealt WHERE r = 1
        UNION ALL
        SELECT d.rank, d.r, d.doc_id, d.n,
               CASE WHEN f.acc >= {L} THEN f.bin + 1 ELSE f.bin END,
               CASE WHEN f.acc >= {L} THEN 0 ELSE f.ord + 1 END,
               CASE WHEN f.acc >= {L} THEN d.n ELSE f.acc + d.n END,
               CASE WHEN f.acc >= {L} THEN 0 ELSE f.seq_start + f.n + 2 + (f.n - 1) // {S} END
        FROM filled f JOIN dealt d ON d.rank = f.rank AND d.r = f.r + 1)""", f"""
      SELECT rank, bin, ord, doc_id, n AS len, seq_start FROM filled
      QUALIFY max(acc) OVER (PARTITION BY rank, bin) >= {L}""")
    return out
