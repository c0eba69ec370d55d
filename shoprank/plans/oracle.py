"""DuckDB SQL for every registered query (the correctness oracle).

The SQL brute-forces what the Spark plans compute incrementally: every question is
scored against every product with list functions in the same left-to-right DOUBLE order,
so both sides produce the same bits before rounding.
"""

from __future__ import annotations

import json

from ..config import (AGENT_ANSWER_USER_PARTS, AGENT_RECOMMENDATION_SYSTEM_MSG, AGENT_SLICING_SYSTEM_MSG, ALPHA_GRID,
                      ANSWER_USER_PARTS, HASH_DIM, MODE_CHOICES, PARITY_ALPHA, PARITY_K, PARITY_MULTIPLIER,
                      QUERY_SLICING_SYSTEM_MSG, RECOMMENDATION_SYSTEM_MSG, TEXT_ENCODERS, TEXT_SPACES)
from .fixtures import DISPATCH_MODES, MIXED_ALPHA, MIXED_K, MIXED_MODES, MIXED_MULTIPLIER

# The constraint grammar, written out here on its own.
CONSTRAINT_PATTERN = (r"(price|star|stars|rating|ratings|review|reviews)\s+"
                      r"(above|over|more than|at least|under|below|less than|at most|up to)\s+\$?(\d+(?:\.\d+)?)")
OP_MAP = {"above": ">", "over": ">", "more than": ">", "at least": ">=", "under": "<", "below": "<", "less than": "<",
          "at most": "<=", "up to": "<="}


K, MULT, A = PARITY_K, PARITY_MULTIPLIER, PARITY_ALPHA
# What Python's strip() removes.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _cos(a: str, b: str, na: str, nb: str) -> str:
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    return f"(CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE {dot} / ({na} * {nb}) END)"


def _norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


CATALOG = """
rating AS (
  SELECT l_partkey AS product_id, CAST(avg(l_quantity) / 10 AS FLOAT) AS average_rating
  FROM lineitem GROUP BY l_partkey),
catalog AS (
  SELECT p.p_partkey AS product_id, p.p_name AS title, p.p_brand AS store, p.p_type AS description,
         CAST(p.p_retailprice AS FLOAT) AS price, r.average_rating,
         'https://img.invalid/' || CAST(p.p_partkey AS VARCHAR) || '.jpg' AS image
  FROM part p LEFT JOIN rating r ON r.product_id = p.p_partkey)"""

# Slices of the embedding per vector set: (name, first, last).
SETS = [("cl", 17, 48), ("sb", 1, 24), ("bl", 5, 44), ("am", 9, 32), ("iv", 33, 64)]
VECTORS = f"""
vec AS (
  SELECT vec_id AS product_id, {", ".join(f"CAST(embedding[{a}:{b}] AS DOUBLE[]) AS {n}" for n, a, b in SETS)}
  FROM embeddings
  WHERE vec_id IN (SELECT p_partkey FROM part) AND len(embedding) = 64
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
vecn AS (SELECT *, {", ".join(f"{_norm(n)} AS {n}n" for n, _, _ in SETS)} FROM vec)"""

_KNOWN = ", ".join(q(m) for m in MODE_CHOICES)


def retrieval_ctes(mode_sql: str = "'Clip-STrans'", k: str = str(K), mult: str = str(MULT), alpha: str = f"CAST({A!r} AS DOUBLE)") -> str:
    """CTEs ``qr, pairs, ranked, pool`` for every question (= every searchable product); settings are SQL over its
    ``product_id``, NULL ones take the defaults.

    Clip-Clip probes its text set with the joint-space (image) vector; Blip-Text searches its own text set only, with
    n = k; unknown modes fall back to Clip-Clip.
    """
    return f"""
{CATALOG.strip()},
{VECTORS.strip()},
qm AS (SELECT product_id AS query_id, coalesce({mode_sql}, 'Clip-STrans') AS model_choice, coalesce({k}, 5) AS k,
              coalesce({mult}, 20) AS mult, coalesce({alpha}, 0.5) AS alpha FROM vecn),
qr AS (SELECT *, CASE WHEN model_choice IN ({_KNOWN}) THEN model_choice ELSE 'Clip-Clip' END AS route_mode FROM qm),
pairs AS (
  SELECT r.query_id, r.model_choice, r.route_mode, r.k, r.alpha, c.product_id,
         CASE r.route_mode WHEN 'Clip-Clip' THEN {_cos('qv.iv', 'c.cl', 'qv.ivn', 'c.cln')}
              WHEN 'Clip-STrans' THEN {_cos('qv.sb', 'c.sb', 'qv.sbn', 'c.sbn')}
              WHEN 'Clip-Blip' THEN {_cos('qv.bl', 'c.bl', 'qv.bln', 'c.bln')}
              ELSE {_cos('qv.sb', 'c.am', 'qv.sbn', 'c.amn')} END AS text_sim,
         CASE WHEN r.route_mode = 'Blip-Text' THEN NULL
              ELSE {_cos('qv.iv', 'c.iv', 'qv.ivn', 'c.ivn')} END AS image_sim,
         CASE WHEN r.route_mode = 'Blip-Text' THEN r.k ELSE r.k * r.mult END AS n_text,
         CASE WHEN r.route_mode = 'Blip-Text' THEN 0 ELSE r.k * r.mult END AS n_image
  FROM qr r JOIN vecn qv ON qv.product_id = r.query_id CROSS JOIN vecn c),
ranked AS (
  SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY text_sim DESC, product_id) AS text_rank0,
    row_number() OVER (PARTITION BY query_id ORDER BY image_sim DESC NULLS LAST, product_id) AS image_rank0
  FROM pairs),
pool AS (
  SELECT *, CASE WHEN text_rank0 <= n_text THEN text_rank0 END AS text_rank,
            CASE WHEN image_sim IS NOT NULL AND image_rank0 <= n_image THEN image_rank0 END AS image_rank
  FROM ranked WHERE text_rank0 <= n_text OR (image_sim IS NOT NULL AND image_rank0 <= n_image))"""


def _score(alpha: str = "alpha") -> str:
    return f"CASE WHEN n_image = 0 THEN text_sim ELSE {alpha} * text_sim + (1 - {alpha}) * image_sim END"


def top_ctes() -> str:
    return f"""
scored AS (SELECT *, {_score()} AS score FROM pool),
top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= k)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


RANKED = _with(retrieval_ctes(), top_ctes())

# ----------------------------------------------------------------------- text fixtures

QUESTION_TEXTS = """
qtext AS (
  SELECT p_partkey AS query_id,
    CASE p_size % 4
      WHEN 0 THEN 'price under ' || CAST(900 + p_size AS VARCHAR)
      WHEN 1 THEN 'stars above 2.' || CAST(p_size % 10 AS VARCHAR)
      WHEN 2 THEN 'price at most $' || CAST(920 + p_size % 30 AS VARCHAR) || '.50 and rating at least 2.'
                  || CAST(p_size % 7 AS VARCHAR)
      ELSE 'None' END AS constraint_text,
    concat_ws(', ', string_split(p_name, ' ')[-1], string_split(p_name, ' ')[1], lower(p_type),
              upper(string_split(p_name, ' ')[-1])) AS keywords_text,
    p_name, p_type, p_size
  FROM part),
qtexts AS (
  SELECT query_id, constraint_text, keywords_text,
         'I want a ' || p_name || ' (' || lower(p_type) || ')'
           || CASE WHEN p_size % 4 != 3 THEN ', ' || constraint_text ELSE '' END AS query
  FROM qtext)"""

RESPONSES = f"""
{QUESTION_TEXTS.strip()},
responses AS (
  SELECT query_id, query, query_id % 7 != 6 AS ok,
    CASE query_id % 7
      WHEN 0 THEN 'output_1: ' || constraint_text || chr(10) || 'output_2: ' || keywords_text
      WHEN 1 THEN 'output_1: ' || constraint_text || chr(10) || 'Output_2: ' || keywords_text
      WHEN 2 THEN 'output_2: ' || keywords_text || chr(10)
      WHEN 3 THEN 'Sure. output_1: ' || constraint_text || chr(10) || chr(10) || '  output_2:' || chr(160) || chr(12288) || ' ' || keywords_text || ' ' || chr(8195) || chr(160)
      WHEN 4 THEN 'output_1: ' || constraint_text || chr(10) || 'output_1: None' || chr(10) || 'output_2: '
                  || keywords_text || chr(10) || 'output_2: extra'
      WHEN 5 THEN chr(9) || 'output_1: ' || constraint_text || chr(13) || chr(10) || 'output_2: ' || keywords_text
                  || chr(13) || chr(10)
      ELSE 'Error calling model: request ' || CAST(query_id AS VARCHAR) || ' timed out' END AS body
  FROM qtexts)"""


def _label(body: str, label: str) -> str:
    lines = f"string_split({strip(body)}, chr(10))"
    hit = f"list_filter({lines}, lambda l: contains(lower(l), '{label}'))[1]"
    return f"coalesce({strip(f'replace({hit}, {q(label + ':')}, {q('')})')}, '')"


def sliced_cte(src: str = "responses") -> str:
    return f"""
sliced AS (
  SELECT *, CASE WHEN ok THEN {_label('body', 'output_1')} END AS constraints,
            CASE WHEN ok THEN {_label('body', 'output_2')} END AS keywords
  FROM {src})"""


SLICED = f"{RESPONSES.strip()},\n{sliced_cte().strip()}"

_PAT = q(CONSTRAINT_PATTERN)
_OPS = " ".join(f"WHEN {q(w)} THEN {q(s)}" for w, s in OP_MAP.items())
CONSTRAINTS = f"""
cx AS (
  SELECT query_id, regexp_extract_all(lower(coalesce(constraints, '')), {_PAT}, 1) AS f,
         regexp_extract_all(lower(coalesce(constraints, '')), {_PAT}, 2) AS o,
         regexp_extract_all(lower(coalesce(constraints, '')), {_PAT}, 3) AS v
  FROM sliced),
cxi AS (SELECT query_id, f, o, v, unnest(generate_series(1, len(f))) AS i FROM cx WHERE len(f) > 0),
constraints AS (
  SELECT query_id, CAST(i AS INTEGER) AS pos, CASE WHEN f[i] = 'price' THEN 'price' ELSE 'rating' END AS field,
         CASE o[i] {_OPS} END AS op, CAST(v[i] AS DOUBLE) AS value
  FROM cxi)"""

VIOLATION = """
(NOT coalesce(CASE c.op
   WHEN '>' THEN CASE WHEN c.field = 'price' THEN CAST(t.price AS DOUBLE) ELSE CAST(t.average_rating AS DOUBLE) END > c.value
   WHEN '>=' THEN CASE WHEN c.field = 'price' THEN CAST(t.price AS DOUBLE) ELSE CAST(t.average_rating AS DOUBLE) END >= c.value
   WHEN '<' THEN CASE WHEN c.field = 'price' THEN CAST(t.price AS DOUBLE) ELSE CAST(t.average_rating AS DOUBLE) END < c.value
   WHEN '<=' THEN CASE WHEN c.field = 'price' THEN CAST(t.price AS DOUBLE) ELSE CAST(t.average_rating AS DOUBLE) END <= c.value
 END, false))"""

FETCHED = "fetched AS (SELECT t.*, c.title, c.store, c.description, c.price, c.average_rating, c.image " \
          "FROM top t JOIN catalog c ON c.product_id = t.product_id)"

SURVIVORS = f"""
survivors AS (
  SELECT t.* FROM fetched t
  WHERE NOT EXISTS (SELECT 1 FROM constraints c WHERE c.query_id = t.query_id AND {VIOLATION.strip()}))"""


def _float_repr(x: str) -> str:
    return f"coalesce(CAST(CAST({x} AS DOUBLE) AS VARCHAR), 'N/A')"


BLOCKS = f"""
blocks AS (
  SELECT query_id, rank, product_id,
    'Title: ' || coalesce(title, '') || chr(10) || 'Description: ' || coalesce(description, '') || chr(10)
    || 'Store: ' || coalesce(store, '') || chr(10) || 'Features: ' || chr(10) || 'Details: ' || chr(10)
    || 'Price: ' || {_float_repr('price')} || chr(10) || 'Rating: ' || {_float_repr('average_rating')} || chr(10)
    || 'Image: ' || coalesce(image, '') AS block
  FROM fetched)"""

CONTEXT = """
context AS (
  SELECT query_id, count(*) AS n_products, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context
  FROM blocks GROUP BY query_id)"""


def _messages(system: str, user: str) -> str:
    return (f"CAST(to_json([{{'role': 'system', 'content': {q(system)}}}, {{'role': 'user', 'content': {user}}}]) "
            "AS VARCHAR)")




def _user(parts: tuple[str, ...]) -> str:
    a, b, c, d = (q(p) for p in parts)
    return f"{a} || coalesce(s.query, '') || {b} || coalesce(s.constraints, '') || {c} || coalesce(x.context, '') || {d}"


def _dumped(system: str, user: str) -> str:
    """Messages as json.dumps text (the fixtures' own columns are ASCII)."""
    head = '[{"role": "system", "content": ' + json.dumps(system) + '}, {"role": "user", "content": '
    return f"{q(head)} || CAST(to_json({user}) AS VARCHAR) || '}}]'"


def _hash_tokens(name: str, src: str, key: str, text: str) -> str:
    return f"""
{name}_tok AS (SELECT {key} AS id, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM {src}),
{name} AS (
  SELECT id, CAST(CAST(('0x' || substr(md5(tok), 1, 6)) AS BIGINT) % {HASH_DIM} AS INTEGER) AS bucket, count(*) AS tf
  FROM {name}_tok WHERE length(tok) > 0 GROUP BY ALL)"""


def _modes_sql() -> str:
    arr = "[" + ", ".join(q(m) for m in DISPATCH_MODES) + "]"
    return f"{arr}[(product_id % {len(DISPATCH_MODES)}) + 1]"



def _cycle(values: list, kind: str) -> str:
    """The value at position product_id mod their number."""
    items = ", ".join("NULL" if v is None else q(v) if isinstance(v, str) else repr(v) for v in values)
    return f"CAST([{items}] AS {kind}[])[(product_id % {len(values)}) + 1]"


MIXED = retrieval_ctes(_cycle(MIXED_MODES, "VARCHAR"), _cycle(MIXED_K, "INTEGER"), _cycle(MIXED_MULTIPLIER, "INTEGER"),
                       _cycle(MIXED_ALPHA, "DOUBLE"))
_GRID = ", ".join(f"(CAST({a!r} AS DOUBLE))" for a in ALPHA_GRID)

ORACLE = {
    "catalog_typed_scan": _with(CATALOG) + "\nSELECT product_id, title, store, description, price, average_rating, image FROM catalog",
    "catalog_csv_ingest": _with(CATALOG) + """
SELECT c.product_id, c.title, c.store,
       CASE WHEN p.p_size % 13 = 0 OR p.p_size % 17 = 0 OR p.p_size % 19 = 0 OR p.p_size % 11 = 0 THEN NULL ELSE c.price END AS price,
       c.average_rating, c.image
FROM catalog c JOIN part p ON p.p_partkey = c.product_id
WHERE p.p_size % 13 = 0 OR p.p_size % 17 = 0 OR p.p_size % 19 = 0 OR p.p_size % 11 = 0
   OR NOT (p.p_size % 23 = 0 OR p.p_size % 7 = 0)""",
    "catalog_csv_rejects": """
SELECT p_partkey AS product_id, CASE WHEN p_size % 23 = 0 THEN '12d' ELSE 'about 9' END AS price, 'price' AS reason
FROM part
WHERE NOT (p_size % 13 = 0 OR p_size % 17 = 0 OR p_size % 19 = 0 OR p_size % 11 = 0) AND (p_size % 23 = 0 OR p_size % 7 = 0)""",
    "vector_rejects": """
SELECT * FROM (
  SELECT vec_id AS product_id,
         CASE WHEN embedding IS NULL OR len(embedding) != 64 THEN 'length'
              WHEN list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) THEN 'element'
              WHEN vec_id NOT IN (SELECT p_partkey FROM part) THEN 'no product' END AS reason
  FROM embeddings) WHERE reason IS NOT NULL""",
    "vector_route": _with(VECTORS) + """
SELECT model_choice, text_encoder, image_encoder, text_only, text_space, image_space,
       (SELECT count(*) FROM vec) AS n_text_vectors, CAST(text_dim AS INTEGER) AS text_dim,
       CASE WHEN image_space IS NOT NULL THEN (SELECT count(*) FROM vec) END AS n_image_vectors, CAST(image_dim AS INTEGER) AS image_dim
FROM (VALUES
  ('Clip-Clip', 'clip', 'clip', false, 'clip_text', 'clip_image', 32, 32),
  ('Clip-STrans', 'sbert', 'clip', false, 'sbert_text', 'clip_image', 24, 32),
  ('Clip-Blip', 'blip', 'clip', false, 'blip_text', 'clip_image', 40, 32),
  ('Blip-Text', 'sbert', NULL, true, 'amazon_text', NULL, 24, NULL))
  r(model_choice, text_encoder, image_encoder, text_only, text_space, image_space, text_dim, image_dim)""",
    "l2_normalize": f"""
WITH sp AS (
  SELECT vec_id AS product_id, 'text' AS space, CAST(embedding[1:32] AS DOUBLE[]) AS v FROM embeddings
  UNION ALL SELECT vec_id, 'image', CAST(embedding[33:64] AS DOUBLE[]) FROM embeddings
  UNION ALL SELECT vec_id, 'full', CAST(embedding AS DOUBLE[]) FROM embeddings),
n AS (SELECT *, {_norm('v')} AS nb FROM sp),
u AS (SELECT *, list_transform(v, lambda x: CASE WHEN nb = 0 THEN 0.0 ELSE x / nb END) AS u FROM n)
SELECT product_id, space, round(nb, 6) + 0.0 AS norm_before, round({_norm('u')}, 6) AS norm_after,
       round(u[1], 6) + 0.0 AS first_value
FROM u""",
    "text_encode_hashed": _with(_hash_tokens("db", "documents", "doc_id", "text")) + """
SELECT id AS doc_id, bucket, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)), 6) AS weight FROM db""",
    "topn_text": _with(retrieval_ctes()) + """
SELECT query_id, product_id, CAST(text_rank AS INTEGER) AS rank, round(text_sim, 6) + 0.0 AS sim FROM pool WHERE text_rank IS NOT NULL""",
    "topn_image": _with(retrieval_ctes()) + """
SELECT query_id, product_id, CAST(image_rank AS INTEGER) AS rank, round(image_sim, 6) + 0.0 AS sim FROM pool WHERE image_rank IS NOT NULL""",
    "candidate_union": _with(retrieval_ctes()) + """
SELECT query_id, product_id, text_rank IS NOT NULL AS in_text, image_rank IS NOT NULL AS in_image FROM pool""",
    "rescore_fusion": _with(retrieval_ctes(), top_ctes()) + """
SELECT query_id, product_id, round(text_sim, 6) + 0.0 AS text_sim, round(image_sim, 6) + 0.0 AS image_sim, round(score, 6) + 0.0 AS score
FROM scored""",
    "hybrid_topk_fetch": RANKED + """
SELECT t.query_id, t.rank, t.product_id, c.title, c.store, c.price, c.average_rating, c.image,
       round(t.score, 6) + 0.0 AS score
FROM top t JOIN catalog c ON c.product_id = t.product_id""",
    "text_only_topk": _with(retrieval_ctes("'Blip-Text'"), top_ctes()) + """
SELECT t.query_id, t.rank, t.product_id, c.title, round(t.text_sim, 6) + 0.0 AS text_sim
FROM top t JOIN catalog c ON c.product_id = t.product_id""",
    "mode_dispatch": _with(retrieval_ctes(_modes_sql()), top_ctes()) + """
SELECT query_id, model_choice, route_mode, rank, product_id, round(score, 6) + 0.0 AS score FROM top""",
    "alpha_sweep": _with(retrieval_ctes(), f"""
grid(alpha) AS (VALUES {_GRID}),
swept AS (SELECT p.* EXCLUDE (alpha), g.alpha, {_score('g.alpha')} AS score FROM pool p CROSS JOIN grid g),
top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, alpha ORDER BY score DESC, product_id) AS INTEGER) AS rank
  FROM swept QUALIFY rank <= {K})""") + """
SELECT query_id, alpha, rank, product_id, round(score, 6) + 0.0 AS score FROM top""",
    "mixed_parameter_topk": _with(MIXED, top_ctes()) + """
SELECT query_id, k, rank, product_id, round(score, 6) + 0.0 AS score FROM top""",
    "question_rejects": _with(VECTORS) + f"""
SELECT query_id, reason FROM (
  SELECT CASE WHEN product_id % 23 != 0 THEN product_id END AS query_id,
    CASE WHEN product_id % 23 = 0 THEN 'query_id' WHEN product_id % 13 = 0 THEN 'k' WHEN product_id % 17 = 0 THEN 'multiplier'
         WHEN product_id % 11 = 0 OR product_id % 19 = 0 THEN 'alpha' END AS reason
  FROM vec) WHERE reason IS NOT NULL""",
    "slice_response_parse": _with(SLICED) + "\nSELECT query_id, ok, constraints, keywords FROM sliced",
    "keyword_normalize": _with(SLICED, f"""
kw AS (
  SELECT query_id, keywords,
         list_filter(list_transform(string_split(lower(keywords), ','), lambda x: {strip('x')}),
                     lambda x: length(x) > 0) AS parts
  FROM sliced)""") + """
SELECT query_id, keywords, array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ', ') AS keywords_norm
FROM kw""",
    "constraint_extract": _with(SLICED, CONSTRAINTS) + "\nSELECT query_id, pos, field, op, value FROM constraints",
    "constraint_filter_post": _with(retrieval_ctes(), top_ctes(), FETCHED, SLICED, CONSTRAINTS, SURVIVORS) + """
SELECT query_id, rank, product_id, price, average_rating FROM survivors""",
    "recommend_top3": _with(retrieval_ctes(), top_ctes(), FETCHED, SLICED, CONSTRAINTS, SURVIVORS) + """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, product_id) AS INTEGER) AS rec_rank,
       product_id, title, price, average_rating, image
FROM survivors QUALIFY rec_rank <= 3""",
    "recommendation_guard": _with(retrieval_ctes(), top_ctes()) + """
SELECT p.query_id, p.product_id,
       EXISTS (SELECT 1 FROM top t WHERE t.query_id = p.query_id AND t.product_id = p.product_id) AS allowed
FROM pool p WHERE p.image_rank <= 3""",
    "product_block_format": _with(retrieval_ctes(), top_ctes(), FETCHED, BLOCKS) + """
SELECT query_id, rank, product_id, block FROM blocks""",
    "context_assemble": _with(retrieval_ctes(), top_ctes(), FETCHED, BLOCKS, CONTEXT) + """
SELECT query_id, n_products, context FROM context""",
    "result_card_format": RANKED + ",\n" + FETCHED + """
SELECT query_id, rank,
  '**' || coalesce(title, '') || '**  ' || chr(10) || 'Store: ' || coalesce(store, '') || '  ' || chr(10)
  || 'Price: $' || coalesce(printf('%.2f', CAST(price AS DOUBLE)), 'N/A') || '  ' || chr(10)
  || 'Rating: ' || coalesce(printf('%.1f', CAST(average_rating AS DOUBLE)), 'N/A') || '/5' AS card
FROM fetched""",
    "response_status": _with(RESPONSES, """
raw AS (
  SELECT query_id, ok,
    CASE WHEN ok THEN CAST(to_json({'output': {'message': {'content': [{'text': body}]}}}) AS VARCHAR) ELSE body END AS raw
  FROM responses),
parsed AS (
  SELECT query_id, ok, CASE WHEN ok THEN json_extract_string(raw, '$.output.message.content[0].text') END AS body
  FROM raw)""", sliced_cte("parsed")) + """
SELECT ok, count(*) AS n_responses, count(body) AS n_parsed,
       CAST(sum(CASE WHEN length(keywords) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_with_keywords,
       CAST(sum(CASE WHEN length(constraints) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_with_constraints
FROM sliced GROUP BY ok""",
    "hashed_text_search": _with(
        _hash_tokens("qb", "benchmark", "item_id", "text"),
        _hash_tokens("cb", "part", "p_partkey", "concat_ws(' ', p_name, p_type, p_brand)"), """
qn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM qb GROUP BY id),
cn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM cb GROUP BY id),
dots AS (SELECT q.id AS qid, c.id AS pid, sum(q.tf * c.tf) AS d FROM qb q JOIN cb c USING (bucket) GROUP BY ALL),
pairs AS (
  SELECT b.item_id AS query_id, p.p_partkey AS product_id,
         CASE WHEN coalesce(qn.n, 0) * coalesce(cn.n, 0) = 0 THEN 0.0
              ELSE CAST(coalesce(d.d, 0) AS DOUBLE) / (qn.n * cn.n) END AS score
  FROM benchmark b CROSS JOIN part p
  LEFT JOIN qn ON qn.id = b.item_id LEFT JOIN cn ON cn.id = p.p_partkey
  LEFT JOIN dots d ON d.qid = b.item_id AND d.pid = p.p_partkey),
top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS INTEGER) AS rank
  FROM pairs QUALIFY rank <= 10)""") + """
SELECT query_id, rank, product_id, round(score, 6) + 0.0 AS score FROM top""",
}
ORACLE["stream_retrieval"] = _with(MIXED, top_ctes()) + """
SELECT t.query_id, t.rank, t.product_id, c.title, c.store, c.price, c.average_rating, c.image, round(t.score, 6) + 0.0 AS score
FROM top t JOIN catalog c ON c.product_id = t.product_id"""

# Questions with keywords, their hashed search over the catalog text and the context of the found products.
_REQUESTS = _with(
    SLICED, CATALOG,
    "kq AS (SELECT query_id, query, constraints, keywords FROM sliced WHERE ok AND length(keywords) > 0)",
    _hash_tokens("qb", "kq", "query_id", "keywords"),
    _hash_tokens("cb", "part", "p_partkey", "concat_ws(' ', p_name, p_type, p_brand)"), f"""
qn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM qb GROUP BY id),
cn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM cb GROUP BY id),
dots AS (SELECT q.id AS qid, c.id AS pid, sum(q.tf * c.tf) AS d FROM qb q JOIN cb c USING (bucket) GROUP BY ALL),
pairs AS (
  SELECT k.query_id, p.p_partkey AS product_id,
         CASE WHEN coalesce(qn.n, 0) * coalesce(cn.n, 0) = 0 THEN 0.0
              ELSE CAST(coalesce(d.d, 0) AS DOUBLE) / (qn.n * cn.n) END AS score
  FROM kq k CROSS JOIN part p
  LEFT JOIN qn ON qn.id = k.query_id LEFT JOIN cn ON cn.id = p.p_partkey
  LEFT JOIN dots d ON d.qid = k.query_id AND d.pid = p.p_partkey),
top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS INTEGER) AS rank
  FROM pairs QUALIFY rank <= {K})""", FETCHED, BLOCKS, CONTEXT)
ORACLE["keyword_rag_prompt"] = _REQUESTS + f"""
SELECT x.query_id, s.keywords, x.n_products, {_messages(RECOMMENDATION_SYSTEM_MSG, _user(ANSWER_USER_PARTS))} AS answer_json
FROM context x JOIN kq s ON s.query_id = x.query_id"""


def _encoded(name: str, src: str, key: str, text: str, encoder: str) -> str:
    """Token counts per bucket of an encoder (``<name>: id, bucket, tf``) and norms (``<name>_n``)."""
    return f"""
{name}_tok AS (SELECT {key} AS id, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM {src}),
{name} AS (
  SELECT id, CAST(('0x' || substr(md5('{encoder}:' || tok), 1, 6)) AS BIGINT) % {TEXT_ENCODERS[encoder]} AS bucket, count(*) AS tf
  FROM {name}_tok WHERE length(tok) > 0 GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM {name} GROUP BY id)"""


#: The question's encoder in each space.
_PROBES = {"clip_text": "clip", "sbert_text": "sbert", "blip_text": "blip", "amazon_text": "sbert", "clip_image": "clip"}
_MODE_SETS = {"Clip-Clip": "clip_text", "Clip-STrans": "sbert_text", "Clip-Blip": "blip_text", "Blip-Text": "amazon_text"}


def text_retrieval_ctes(mode_sql: str, k: int, mult: int, alpha: float) -> str:
    """CTEs ``kq, asked, pool0, top`` of text questions: every question of ``kq`` in its mode, all products compared."""
    parts = ["kq AS (SELECT query_id, query, constraints, keywords FROM sliced WHERE ok AND length(keywords) > 0)",
             f"asked AS (SELECT query_id, keywords AS text, {mode_sql} AS model_choice, CASE WHEN {mode_sql} IN ({_KNOWN}) THEN {mode_sql} ELSE 'Clip-Clip' END AS route_mode FROM kq)",
             "texts AS (SELECT DISTINCT text FROM asked)"]
    parts += [_encoded(f"q_{e}", "texts", "text", "text", e) for e in TEXT_ENCODERS]
    sims = []
    for space, (encoder, cols) in TEXT_SPACES.items():
        parts.append(_encoded(f"p_{space}", "catalog", "product_id", f"concat_ws(' ', {', '.join(cols)})", encoder))
        p, e = f"p_{space}", _PROBES[space]
        sims.append(f"""
s_{space} AS (
  SELECT t.text, c.product_id, CASE WHEN coalesce(qn.n, 0) * coalesce(pn.n, 0) = 0 THEN 0.0 ELSE CAST(coalesce(d.d, 0) AS DOUBLE) / (qn.n * pn.n) END AS sim
  FROM texts t CROSS JOIN catalog c LEFT JOIN q_{e}_n qn ON qn.id = t.text LEFT JOIN {p}_n pn ON pn.id = c.product_id
  LEFT JOIN (SELECT q.id AS qid, p.id AS pid, sum(q.tf * p.tf) AS d FROM q_{e} q JOIN {p} p USING (bucket) GROUP BY ALL) d
    ON d.qid = t.text AND d.pid = c.product_id)""")
    parts += sims
    one = " UNION ALL ".join(
        f"""SELECT m.text, m.route_mode, t.product_id, t.sim AS text_sim, {'NULL' if mode == 'Blip-Text' else 'i.sim'} AS image_sim,
       {k if mode == 'Blip-Text' else k * mult} AS n_text, {0 if mode == 'Blip-Text' else k * mult} AS n_image
  FROM (SELECT DISTINCT text, route_mode FROM asked WHERE route_mode = {q(mode)}) m JOIN s_{space} t ON t.text = m.text
  JOIN s_clip_image i ON i.text = m.text AND i.product_id = t.product_id""" for mode, space in _MODE_SETS.items())
    parts.append(f"allpairs AS ({one})")
    parts.append(f"""
pool0 AS (
  SELECT *, row_number() OVER (PARTITION BY text, route_mode ORDER BY text_sim DESC, product_id) AS tr,
         row_number() OVER (PARTITION BY text, route_mode ORDER BY image_sim DESC NULLS LAST, product_id) AS ir
  FROM allpairs QUALIFY tr <= n_text OR (image_sim IS NOT NULL AND ir <= n_image)),
best AS (
  SELECT *, CASE WHEN n_image = 0 THEN text_sim ELSE CAST({alpha!r} AS DOUBLE) * text_sim + (1 - CAST({alpha!r} AS DOUBLE)) * image_sim END AS score,
         CAST(row_number() OVER (PARTITION BY text, route_mode ORDER BY CASE WHEN n_image = 0 THEN text_sim
           ELSE CAST({alpha!r} AS DOUBLE) * text_sim + (1 - CAST({alpha!r} AS DOUBLE)) * image_sim END DESC, product_id) AS INTEGER) AS rank
  FROM pool0 QUALIFY rank <= {k}),
top AS (SELECT a.query_id, a.model_choice, b.* FROM asked a JOIN best b ON b.text = a.text AND b.route_mode = a.route_mode)""")
    return ",\n".join(x.strip() for x in parts)


_MODE_CYCLE = "[" + ", ".join(q(m) for m in DISPATCH_MODES) + f"][(query_id % {len(DISPATCH_MODES)}) + 1]"
ORACLE["text_mode_topk"] = _with(SLICED, CATALOG, text_retrieval_ctes(_MODE_CYCLE, K, MULT, A)) + """
SELECT query_id, model_choice, route_mode, rank, product_id, round(text_sim, 6) + 0.0 AS text_sim, round(image_sim, 6) + 0.0 AS image_sim,
       round(score, 6) + 0.0 AS score FROM top"""

_REQUEST = f"CAST({_dumped(AGENT_RECOMMENDATION_SYSTEM_MSG, _user(AGENT_ANSWER_USER_PARTS))} AS VARCHAR)"
ORACLE["rag_prompt_end_to_end"] = _with(SLICED, CATALOG, text_retrieval_ctes("'Clip-STrans'", 5, 20, 0.5), FETCHED, CONSTRAINTS, SURVIVORS,
                                        BLOCKS.replace("FROM fetched", "FROM survivors"), CONTEXT) + f"""
SELECT s.query_id, s.constraints, s.keywords, coalesce(x.n_products, 0) AS n_products,
       CAST(to_json([{{'role': 'user', 'content': [{{'text': {_REQUEST}}}]}}]) AS VARCHAR) AS request_json
FROM kq s LEFT JOIN context x ON x.query_id = s.query_id"""
_ASK = "'Query:' || chr(10) || '\"' || coalesce(a.query, '') || '\"'"
ORACLE["prompt_messages_json"] = _REQUESTS + f"""
SELECT a.query_id, {_messages(QUERY_SLICING_SYSTEM_MSG, _ASK)} AS slicing_json,
       CASE WHEN x.context IS NOT NULL THEN {_messages(RECOMMENDATION_SYSTEM_MSG, _user(ANSWER_USER_PARTS))} END AS answer_json
FROM sliced a LEFT JOIN context x ON x.query_id = a.query_id LEFT JOIN kq s ON s.query_id = a.query_id"""
ORACLE["agent_messages_json"] = _with(QUESTION_TEXTS) + f"""
SELECT a.query_id, {_dumped(AGENT_SLICING_SYSTEM_MSG, _ASK)} AS slicing_request FROM qtexts a"""
ORACLE["coded_topn_text"] = ORACLE["topn_text"]

ORACLE["sparse_text_search"] = _with(SLICED, """
asked AS (
  SELECT query_id, keywords AS text FROM sliced WHERE ok AND length(keywords) > 0
  UNION ALL SELECT -item_id - 1, text FROM benchmark),
texts AS (SELECT DISTINCT text FROM asked),
qtok AS (SELECT text, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS tok FROM texts),
qc AS (SELECT text, tok, count(*) AS tf FROM qtok WHERE length(tok) > 0 GROUP BY ALL),
ptok AS (SELECT p_partkey AS id, unnest(regexp_split_to_array(lower(concat_ws(' ', p_name, p_type, p_brand)), '[^\\p{L}\\p{N}]+')) AS tok FROM part),
pc AS (SELECT id, tok, count(*) AS tf FROM ptok WHERE length(tok) > 0 GROUP BY ALL),
qn AS (SELECT text, sqrt(sum(tf * tf)) AS n FROM qc GROUP BY text),
pn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM pc GROUP BY id),
dots AS (SELECT text, id, sum(q.tf * p.tf) AS d FROM qc q JOIN pc p USING (tok) GROUP BY ALL),
best AS (
  SELECT text, id, CAST(d AS DOUBLE) / (qn.n * pn.n) AS score,
         CAST(row_number() OVER (PARTITION BY text ORDER BY CAST(d AS DOUBLE) / (qn.n * pn.n) DESC, id) AS INTEGER) AS rank
  FROM dots JOIN qn USING (text) JOIN pn USING (id) QUALIFY rank <= 10)""") + """
SELECT a.query_id, b.rank, b.id AS product_id, round(b.score, 6) + 0.0 AS score FROM asked a JOIN best b ON b.text = a.text"""

# The fused top k over all products, and whether the pools' top k has the same rows.
ORACLE["certified_fused_topk"] = _with(MIXED, top_ctes(), f"""
every AS (
  SELECT query_id, product_id, k, {_score()} AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_score()} DESC, product_id) AS INTEGER) AS rank
  FROM pairs QUALIFY rank <= k),
same AS (
  SELECT e.query_id, bool_and(t.product_id IS NOT NULL AND t.product_id = e.product_id) AS pool_is_exact
  FROM every e LEFT JOIN top t ON t.query_id = e.query_id AND t.rank = e.rank GROUP BY e.query_id)""") + """
SELECT e.query_id, e.rank, e.product_id, round(e.score, 6) + 0.0 AS score, s.pool_is_exact FROM every e JOIN same s ON s.query_id = e.query_id"""

ORACLE["stored_topk_fetch"] = ORACLE["hybrid_topk_fetch"]
ORACLE["stored_mode_dispatch"] = ORACLE["mode_dispatch"]
ORACLE["stored_vectors"] = _with(VECTORS) + "\n" + " UNION ALL ".join(
    f"SELECT {q(space)} AS space, count(*) AS n_vectors, max(len({v})) :: INTEGER AS dim, round(min({v}n), 6) AS least_norm, round(max({v}n), 6) AS greatest_norm FROM vecn"
    for space, v in (("clip_text", "cl"), ("sbert_text", "sb"), ("blip_text", "bl"), ("amazon_text", "am"), ("clip_image", "iv")))
ORACLE["stream_answer_once"] = ORACLE["stream_retrieval"]
ORACLE["answers_written_twice"] = ORACLE["hybrid_topk_fetch"]
ORACLE["prompts_written"] = ORACLE["rag_prompt_end_to_end"]
ORACLE["faulty_vector_rejects"] = """
SELECT * FROM (
  SELECT CASE WHEN vec_id % 7 = 0 THEN -vec_id - 1 ELSE vec_id END AS product_id,
         CASE WHEN vec_id % 11 = 0 OR vec_id % 13 = 0 THEN 'length'
              WHEN vec_id % 17 = 0 OR vec_id % 19 = 0 OR vec_id % 23 = 0 THEN 'element'
              WHEN vec_id % 7 = 0 OR vec_id NOT IN (SELECT p_partkey FROM part) THEN 'no product' END AS reason
  FROM embeddings) WHERE reason IS NOT NULL"""
ORACLE["catalog_csv_split"] = _with(CATALOG) + """
SELECT row_number() OVER (ORDER BY product_id) - 1 AS product_id, title || ', ' || chr(10) || '"' || store || '"' || chr(10) || description AS title,
       store, price, average_rating, image FROM catalog"""
ORACLE["constraint_grammar"] = """
WITH p AS (SELECT p_partkey AS query_id, p_size % 8 AS form, CAST(p_size + 900 AS DOUBLE) AS low, CAST(p_size + 930 AS DOUBLE) AS high,
                  p_size % 3 + 2 AS stars FROM part)
SELECT query_id, CAST(pos AS INTEGER) AS pos, field, op, value FROM (
  SELECT query_id, 1 AS pos, 'price' AS field, '>=' AS op, low AS value FROM p WHERE form = 0
  UNION ALL SELECT query_id, 2, 'price', '<=', high FROM p WHERE form = 0
  UNION ALL SELECT query_id, 1, 'rating', '>=', CAST(stars AS DOUBLE) FROM p WHERE form IN (1, 4)
  UNION ALL SELECT query_id, 1, 'price', '<=', high + 0.5 FROM p WHERE form = 2
  UNION ALL SELECT query_id, 1, 'rating', '>=', CAST('2.' || stars AS DOUBLE) FROM p WHERE form = 3
  UNION ALL SELECT query_id, 2, 'price', '>=', low FROM p WHERE form = 4
  UNION ALL SELECT query_id, 3, 'price', '<=', high FROM p WHERE form = 4
  UNION ALL SELECT query_id, 1, 'price', '>', low FROM p WHERE form = 6
  UNION ALL SELECT query_id, 2, 'price', '<', high FROM p WHERE form = 6)"""
