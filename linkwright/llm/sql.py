"""SQL in DuckDB's dialect for the operators that it can express, over whole tables.

Each query compares what the operator's contract names in the plainest way (all pairs, all windows), with no part of the
method. Language scores, model scores, tokens of a vocabulary and transcripts have no SQL.
"""

#: Vectors without null or non-finite components.
_VECTORS = "SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"

EMBEDDING_JOIN = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm FROM ({_VECTORS}) WHERE len(x) > 0 AND list_inner_product(x, x) > 0),
links AS MATERIALIZED (
    SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS r FROM embeddings UNION SELECT links.w, reach.r FROM reach JOIN links ON reach.u = links.u),
least AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.u LEFT JOIN counted ON e.vec_id = counted.u
"""

TOP_K = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(x, lambda c: floor(256 * c)) AS k FROM ({_VECTORS}) WHERE len(x) > 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.k, c.k)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

SUFFIX_DEDUP = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, b, unnest(range(0, n - 99)) AS i FROM d),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5_number(array_slice(b, i + 1, i + 100)) ORDER BY doc_id, i) AS nth FROM starts),
again AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM ranked WHERE nth > 1),
numbered AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM again),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM numbered GROUP BY doc_id, run),
pieces AS (
    SELECT doc_id, e AS s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM (SELECT doc_id, s, e FROM runs UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT d.doc_id, string_agg(CASE WHEN coalesce(e, n) > s THEN hex(array_slice(b, s + 1, coalesce(e, n))) ELSE '' END, '' ORDER BY s) AS h FROM pieces JOIN d USING (doc_id) GROUP BY d.doc_id),
removed AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

MIXING = """
WITH d AS (
    SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
keyed AS (
    SELECT doc_id, source, size, ln((('0x' || left(md5(concat_ws('|', 17, doc_id, text)), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS log_chance,
        length(text) / (size * 6::DOUBLE) AS ratio FROM d),
weighed AS (
    SELECT doc_id, source, size, -log_chance / (CASE WHEN size > 0 THEN greatest(0.05::DOUBLE, least(ratio, 1 / ratio)) ELSE 0.05::DOUBLE END) AS key FROM keyed),
sizes AS (
    SELECT source, sum(size)::BIGINT AS source_size, [3::DOUBLE, 1::DOUBLE, 2::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w
    FROM d GROUP BY source),
caps AS (SELECT *, source_size * 2::DOUBLE AS cap, source_size * 2::DOUBLE / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM sizes),
levels AS (
    SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
goals AS (SELECT source, source_size, coalesce(least(cap, w * max(CASE WHEN level <= ratio THEN level END) OVER ()), cap) AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goals),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM weighed)
SELECT p.doc_id, p.size, e.source_size, e.target, (e.whole * p.size + greatest(0, least(p.size, round(e.target - e.whole * e.source_size)::BIGINT - p.before)))::BIGINT AS taken
FROM placed p JOIN epochs e ON p.source IS NOT DISTINCT FROM e.source
"""

PHRASE_DEDUP = """
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
first AS (SELECT phrase, min(doc_id) AS doc FROM windows GROUP BY phrase),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (phrase) WHERE first.doc < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

JACCARD_JOIN = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z_\\x{80}-\\x{10FFFF}]+') AS words FROM documents),
sets AS MATERIALIZED (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS s FROM d),
classes AS MATERIALIZED (
    SELECT row_number() OVER () AS c, min(doc_id) AS class_id, count(*) AS copies, s FROM sets GROUP BY s, CASE WHEN len(s) = 0 THEN doc_id END),
grams AS MATERIALIZED (SELECT c, unnest(s) AS gram FROM classes),
pairs AS (SELECT a.c AS u, b.c AS w, count(*) AS shared FROM grams a JOIN grams b ON a.gram = b.gram AND a.c <> b.c GROUP BY a.c, b.c),
links AS MATERIALIZED (
    SELECT u, w, cw.copies FROM pairs JOIN classes cu ON u = cu.c JOIN classes cw ON w = cw.c WHERE shared::DOUBLE / (len(cu.s) + len(cw.s) - shared) >= 0.8::DOUBLE),
reach AS (SELECT c AS u, class_id AS r FROM classes UNION SELECT links.w, reach.r FROM reach JOIN links ON reach.u = links.u),
least AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u),
counted AS (SELECT u, sum(copies) AS n FROM links GROUP BY u)
SELECT sets.doc_id, class_id, (copies - 1 + coalesce(n, 0))::BIGINT AS n_links, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN classes ON sets.s = classes.s AND (len(sets.s) > 0 OR class_id = doc_id) JOIN least ON classes.c = least.u LEFT JOIN counted ON classes.c = counted.u
"""

_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH lines AS MATERIALIZED (SELECT doc_id, nth, line, {_KEY} AS key FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents)),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
told AS (SELECT *, key IN (SELECT key FROM common) AS gone FROM lines)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
