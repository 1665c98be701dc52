"""SQL twins of the numbered queries that SQL can express."""

#: Looks at every window that holds a shared shingle; which of equally good windows comes first is left out.
OP1 = r"""
WITH RECURSIVE
doc_words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-`{-\x7f]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
item_words AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-`{-\x7f]+'), lambda w: w <> '') AS w FROM benchmark),
items AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM item_words WHERE len(w) > 0),
item_grams AS (SELECT item_id, n, k, i - 1 AS item_at, array_to_string(w[i : i + k - 1], ' ') AS gram FROM items, unnest(range(1, n - k + 2)) AS t(i)),
widths AS (SELECT DISTINCT k FROM items),
doc_grams AS (SELECT doc_id, k, len(w) AS n_doc, i - 1 AS at, array_to_string(w[i : i + k - 1], ' ') AS gram FROM doc_words, widths, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hits AS (SELECT DISTINCT d.doc_id, g.item_id, g.n, g.k, d.n_doc, d.at AS place FROM doc_grams d JOIN item_grams g USING (k, gram)),
windows AS (SELECT DISTINCT doc_id, item_id, n, k, s AS start FROM hits,
  unnest(range(greatest(0, least(place - (n - k), n_doc - n)), greatest(0, least(place, n_doc - n)) + 1)) AS t(s)),
in_window AS (SELECT w.doc_id, w.item_id, w.start, d.gram, count(*) AS c FROM windows w JOIN doc_grams d ON d.doc_id = w.doc_id AND d.k = w.k AND d.at BETWEEN w.start AND w.start + w.n - w.k GROUP BY ALL),
in_item AS (SELECT item_id, gram, count(*) AS c FROM item_grams GROUP BY ALL),
sizes AS (SELECT doc_id, item_id, start, sum(c) AS c FROM in_window GROUP BY ALL),
shared AS (SELECT w.doc_id, w.item_id, w.start, sum(least(w.c, i.c)) AS c FROM in_window w JOIN in_item i USING (item_id, gram) GROUP BY ALL),
judged AS (SELECT s.doc_id, s.item_id, s.start, i.n, CAST(h.c AS DOUBLE) / (s.c + (i.n - i.k + 1) - h.c) AS similarity
  FROM sizes s JOIN shared h USING (doc_id, item_id, start) JOIN items i USING (item_id))
SELECT doc_id, item_id, CAST(any_value(n) AS INT) AS n_words, max(similarity) AS similarity
FROM judged WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""

OP8 = """
WITH data AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
starts AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM data, unnest(range(0, n - 49)) AS t(k) WHERE n >= 50),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
hits AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM starts JOIN firsts USING (s) WHERE first < doc_id),
runs AS (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM hits),
spans AS (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS open FROM spans),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * open + 1, 2 * (a - open)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h, sum(b - a) AS removed, count(*) AS n_spans
  FROM gaps g JOIN data d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM data d LEFT JOIN kept k USING (doc_id)
"""

OP9 = """
WITH pages_with AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
firsts AS (SELECT body, min(page_id) AS first FROM pages_with GROUP BY body),
digits AS (SELECT body, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(sha1(body), i, 1))]), '') AS bits FROM firsts),
digests AS (SELECT body, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * j + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * j + 2, 1) AS INT)
  + 4 * CAST(substr(bits, 5 * j + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * j + 4, 1) AS INT) + CAST(substr(bits, 5 * j + 5, 1) AS INT), 1)), '') AS digest FROM digits)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM pages_with JOIN firsts USING (body) JOIN digests USING (body)
"""

#: All phrases of all pieces counted, without any pruning.
OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM lists),
phrases AS (
  SELECT lang, words[i] AS phrase, 1 AS size FROM places
  UNION ALL SELECT lang, words[i] || ' ' || words[i + 1], 2 FROM places WHERE i + 1 <= len(words)
  UNION ALL SELECT lang, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2], 3 FROM places WHERE i + 2 <= len(words)),
counts AS (SELECT lang, phrase, size, count(*) AS f FROM phrases GROUP BY ALL),
sums AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, size, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM candidates
  UNION ALL SELECT lang, phrase, size, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3),
scores AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE size = 3) GROUP BY lang, phrase),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN longer g USING (lang, phrase) WHERE g.most IS NULL OR 100 * g.most < 50 * l.a),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranks JOIN sums USING (lang) WHERE rank <= 2000"""
