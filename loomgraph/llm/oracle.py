"""DuckDB SQL with the rows that operators must give, where SQL can say them."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Upper-case base 32 of a SHA-1 in hex, from 4 bits to 5: each 5 hex digits make 4 letters.
_BASE32 = (
    "list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(3, -1, -1), lambda j: "
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(code, 5 * i + 1, 5))::BIGINT >> (5 * j)) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '')"
)

OP1 = f"""
WITH p AS (SELECT DISTINCT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS code FROM pages),
best AS (SELECT code, n, max(page_id) AS keep FROM p GROUP BY code, n)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM p JOIN best USING (code, n)
"""

OP2 = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
c AS (SELECT conv_id, conv_id // 2 AS pair_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS chars FROM n GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY chars DESC, conv_id) AS side FROM c),
s AS (SELECT pair_id, side, k, role, text, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM n JOIN r USING (conv_id)),
z AS (SELECT pair_id, max(CASE WHEN side = 1 THEN conv_id END) AS chosen_id, max(CASE WHEN side = 2 THEN conv_id END) AS rejected_id FROM r GROUP BY pair_id),
m AS (SELECT pair_id, k, count(*) = 2 AND min(shown) = max(shown) AND min(role) = max(role) AS same FROM s GROUP BY pair_id, k),
f AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN k END), max(k) + 1) - 1 AS p FROM m GROUP BY pair_id)
SELECT z.pair_id, chosen_id, rejected_id, p::BIGINT AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 1 AND k <= p), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 1 AND k > p), '') AS chosen_completion,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 2 AND k > p), '') AS rejected_completion,
  coalesce(sum(length(text) + 8) FILTER (side = 1 AND k > p AND role = 'assistant'), 0)::BIGINT AS chosen_trained,
  coalesce(sum(length(text) + 8) FILTER (side = 2 AND k > p AND role = 'assistant'), 0)::BIGINT AS rejected_trained
FROM z JOIN f USING (pair_id) JOIN s USING (pair_id) GROUP BY ALL
"""

OP3 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
  row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS rank, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM r),
w AS (SELECT (list(share ORDER BY cap / weight, rank) FILTER (share * weight <= cap))[1] AS level FROM l),
t AS (SELECT source, source_size, n, coalesce(least(cap, level * weight), cap) AS target, coalesce('s' || source, 'n') AS part FROM l, w),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
  greatest(1, ceil(n / 4096.0)) AS blocks, ('0x' || substr(md5('mix|' || part), 1, 7))::BIGINT / 268435456.0::DOUBLE AS off FROM t),
p AS (SELECT d.doc_id, d.size, u.*, lpad(length(bin(d.size))::VARCHAR, 2, '0') || substr(bin(d.size), 1, 4) AS class,
  floor(('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 7))::BIGINT / 268435456.0::DOUBLE * blocks) AS block
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
q AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY class, block, size, doc_id) AS spot FROM p)
SELECT doc_id, size, source_size, target, (least(floor(spot * rate + off) - floor((spot - 1) * rate + off), 3.0) * size)::BIGINT AS taken FROM q
"""

OP4 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON pairs.x = reach.y),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS k FROM pairs GROUP BY x)
SELECT v.vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS p, b.n AS q, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT x, y FROM o WHERE 100 * k >= 80 * (p + q - k)),
ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT reach.x, ways.y FROM reach JOIN ways ON ways.x = reach.y),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c ON c.x = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op2_preferences": OP2, "op3_mixing": OP3, "op4_exact_dedup": OP4, "op5_embedding_dedup": OP5, "op7_jaccard_join": OP7}
