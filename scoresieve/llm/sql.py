"""DuckDB SQL for the queries of this subpackage that SQL can express."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, line, pos, trim({LOWER.format("line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

OP10 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
t AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
sizes AS MATERIALIZED (SELECT doc_id, len(sh) AS n FROM s),
rare AS MATERIALIZED (SELECT doc_id, n, g FROM t JOIN (SELECT g, count(*) AS c FROM t GROUP BY g) USING (g)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c, g) <= n - (9 * n + 9) // 10 + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id < b.doc_id
  AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
links AS MATERIALIZED (
  SELECT a, b FROM cand JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b AND x.g = y.g
  GROUP BY a, b HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r(id, c) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.id, e.b FROM r JOIN both_ways e ON e.a = r.c)
SELECT doc_id, n::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.id = sizes.doc_id)::BIGINT AS component_id FROM sizes
"""

_WORDS = f"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP6 = f"""
WITH b AS MATERIALIZED (SELECT item_id, {_WORDS} AS ws FROM benchmark),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g
  FROM b, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS u(i) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM bw),
hits AS MATERIALIZED (
  SELECT doc_id, i, k, item_id FROM (
    SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS g FROM d, ks, unnest(generate_series(1, len(ws) - k + 1)) AS u(i)) JOIN bw USING (k, g)),
w AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hits, unnest(generate_series(0, k - 1)) AS u(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(w.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP5 = """
WITH RECURSIVE s AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1))::DOUBLE AS size FROM documents GROUP BY source),
r AS (SELECT source, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM s),
p AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS cdf FROM r
  UNION ALL SELECT source, rate, k + 1, log_p + ln(rate) - ln(k + 1), cdf + exp(log_p + ln(rate) - ln(k + 1)) FROM p WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
c AS (SELECT source, list(cdf) AS cdfs FROM p GROUP BY source),
n AS (
  SELECT doc_id, source, len(list_filter(cdfs, lambda x: x <= ('0x' || substr(md5('mix-1:' || doc_id), 1, 12))::BIGINT / 281474976710656.0)) AS n
  FROM documents JOIN c USING (source))
SELECT doc_id, source, i::BIGINT AS copy_no, ('0x' || substr(md5('mix-1:order:' || doc_id || ':' || i), 1, 15))::BIGINT AS order_key
FROM n, unnest(generate_series(1, n)) AS u(i)
"""

OP4 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.c),
g AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN g ON id = vec_id
"""

_ESC = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>"]
_ESCAPED = "replace(coalesce(text, ''), '\\', '\\\\')"
for _c in _ESC:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

OP7 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length({_ESCAPED}) AS escaped FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(3 + length(role) + 1 + escaped + 5)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL = {"op4_embedding_near_dedup": OP4, "op5_poisson_mix": OP5, "op6_decontamination": OP6, "op7_chat_format": OP7, "op9_line_dedup": OP9, "op10_ngram_jaccard_join": OP10}
