"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from classmeter.llm.queries import SEED

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {}

ORACLE["op1_source_mix"] = rf"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15) AS key
    FROM documents
),
listed AS (
    SELECT source, sum(size)::HUGEINT AS source_size,
           [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 + 1] AS weight,
           row_number() OVER (ORDER BY source IS NULL, source::BLOB) AS place
    FROM sized GROUP BY source
),
filled AS (
    SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS rest,
           sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights,
           row_number() OVER (ORDER BY source_size / weight, place) AS turn
    FROM listed
    WINDOW w AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
levelled AS (
    SELECT *, min(turn) FILTER (3 * source_size * weights >= weight * rest) OVER () AS first_free FROM filled
),
shared AS (
    SELECT l.*, CASE WHEN l.turn >= l.first_free THEN l.weight * f.rest ELSE 3 * l.source_size * f.weights END AS share, f.weights AS over
    FROM levelled l JOIN levelled f ON f.turn = l.first_free
),
wanted AS (
    SELECT *, (share // over) + (row_number() OVER (ORDER BY share % over DESC, place)
                 <= sum(source_size) OVER () - sum(share // over) OVER ())::INT AS quota
    FROM shared
),
hashes AS (SELECT source, key, sum(size) AS size FROM sized GROUP BY ALL),
lined AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) - size AS before FROM hashes
)
SELECT d.doc_id, d.size::BIGINT AS size, w.source_size::BIGINT AS source_size,
       w.share::DOUBLE / w.over::DOUBLE AS target,
       (d.size * CASE WHEN w.source_size = 0 THEN 0
                 ELSE w.quota // w.source_size + (2 * l.before + l.size <= 2 * (w.quota % w.source_size))::INT END)::BIGINT AS taken
FROM sized d
JOIN wanted w ON w.source IS NOT DISTINCT FROM d.source
JOIN lined l ON l.source IS NOT DISTINCT FROM d.source AND l.key = d.key
"""

ORACLE["op8_line_dedup"] = f"""
WITH split AS (SELECT doc_id, rowid AS doc, string_split(coalesce(text, ''), chr(10)) AS lines FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
lined AS (SELECT doc_id, doc, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM lined),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON c.key = k.key
GROUP BY doc
"""

_SOUND = "list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) IS NOT FALSE"

ORACLE["op5_top_k"] = f"""
WITH whole AS (
    SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE)::HUGEINT FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND {_SOUND}
),
scored AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id,
           coalesce(list_sum([q.v[i] * c.v[i] FOR i IN range(1, least(len(q.v), len(c.v)) + 1)]), 0)::BIGINT AS score
    FROM whole q JOIN whole c ON c.row <> q.row
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)
QUALIFY row_number() OVER w <= 5
"""

ORACLE["op6_embedding_dedup"] = f"""
WITH RECURSIVE sound AS (
    SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND {_SOUND} AND len([x FOR x IN embedding IF x <> 0]) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95
),
reached AS (
    SELECT vec_id AS node, vec_id AS low FROM embeddings
    UNION
    SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.node WHERE r.low < l.b
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       (SELECT min(low) FROM reached r WHERE r.node = e.vec_id) AS component_id,
       (SELECT min(low) FROM reached r WHERE r.node = e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""

ORACLE["op11_source_divergence"] = rf"""
WITH rows AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
),
places AS (SELECT doc, lang, source, unnest(words) AS term FROM rows),
kept AS (
    SELECT lang, term, count(*) AS n FROM places GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (
    SELECT p.lang, p.source, p.term, count(*) AS n FROM places p JOIN kept k ON k.lang = p.lang AND k.term = p.term GROUP BY ALL
),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM rows),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
           1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
    FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
    LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
listed AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term
                     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM listed
QUALIFY part = 'pair' OR rank <= 50
"""
