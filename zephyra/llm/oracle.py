"""The queries that SQL can express, as DuckDB SQL over whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op3_sharding"] = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
),
digits AS (
  SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS digits, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM documents
),
sized AS (
  SELECT doc_id, source, hash, CAST(length(digits) // 2 + 16 AS BIGINT) AS size,
    xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(digits), 2),
        lambda i: CAST((instr('0123456789ABCDEF', digits[i]) - 1) * 16 + instr('0123456789ABCDEF', digits[i + 1]) - 1 AS BIGINT))),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM digits, crc
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM sized
),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY (2 * place + 1) / (2 * n), hash, doc_id) - 1 AS spot, count(*) OVER () AS total FROM ranked
),
cut AS (SELECT *, ((spot + 1) * 40 - 1) // total AS shard FROM ordered)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(spot - (shard * total) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

ORACLE["op7_decontamination"] = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
),
sizes AS (SELECT *, least(13, len(words)) AS size FROM item_words WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
  FROM (SELECT item, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM sizes)
),
lengths AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM doc_words, lengths WHERE len(words) >= size),
found AS (
  SELECT s.doc_id, s.i, s.size, w.item
  FROM (SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS phrase FROM starts) s
  JOIN windows w ON w.phrase = s.phrase AND w.size = s.size
),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op9_jaccard_join"] = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM cut WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id != y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
),
reach AS (
  SELECT doc_id, doc_id AS other FROM cut
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT c.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.least AS component_id
FROM cut c LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r USING (doc_id)
"""

ORACLE["op10_suffix_dedup"] = """
WITH digits AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM digits WHERE length(h) >= 100)
),
owners AS (SELECT w, min(doc_id) AS owner FROM windows GROUP BY w),
starts AS (SELECT doc_id, i FROM windows JOIN owners USING (w) WHERE owner < doc_id),
runs AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM starts
),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs) GROUP BY doc_id, run
),
edges AS (
  SELECT s.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS before, h
  FROM spans s JOIN digits d ON d.doc_id = s.doc_id
),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h,
    sum(b - a) AS n_removed, count(*) AS n_spans
  FROM edges GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM digits d LEFT JOIN kept k USING (doc_id)
"""

ORACLE["op6_warc"] = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id != least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id != least THEN least END AS refers_to
FROM firsts
"""

ORACLE["op2_top_k"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id != q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLE["op12_lexical_search"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
sized AS (SELECT row_number() OVER () AS row, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM words WHERE len(words) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sized),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
counted AS (
  SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(words) AS term FROM sized)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY row, term
),
weighted AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals
),
scored AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total))))) AS BIGINT) AS score
  FROM item_terms JOIN counted USING (term) JOIN weighted USING (term) JOIN sized USING (row), totals
  GROUP BY item_id, row, doc_id
),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
