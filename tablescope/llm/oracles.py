"""The same results in SQL, where SQL can express them."""

ORACLES = {}

ORACLES["op8_warc_revisits"] = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS n, upper(sha1(body)) AS hex FROM p
), g AS (
  SELECT page_id, n, hex, i, ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT AS v FROM d, range(8) r(i)
), b AS (
  SELECT page_id, n, hex, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1), '' ORDER BY i) AS digest
  FROM g GROUP BY page_id, n, hex
), o AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS original FROM b
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to, true AS digest_fits
FROM o
"""

ORACLES["op4_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), long AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), s AS (
  SELECT doc_id, shingle FROM long
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2
), c AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), crossed AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), linked AS (
  SELECT a, b FROM crossed JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * common >= 90 * (ca.n + cb.n - common)
), edges AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, min(r.a) AS component_id
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id JOIN reach r ON r.b = d.doc_id GROUP BY 1, 2
"""

ORACLES["op1_line_templates"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents
), s AS (
  SELECT doc_id, line, raw, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS plain FROM l
), m AS (
  SELECT *, list_transform(plain, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM s
), t AS (
  SELECT doc_id, line, tokens, len(tokens) AS size, array_to_string(tokens[1:3], ' ') AS lead,
    len(list_filter(tokens, lambda t: t <> '<*>')) AS words, len(list_filter(tokens[1:3], lambda t: t <> '<*>')) AS lead_words, array_to_string(plain, ' ') AS whole
  FROM m WHERE len(tokens) > 0
), leaf AS (
  SELECT size, lead, count(DISTINCT doc_id) AS in_leaf FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3
), c AS (
  SELECT t.*, in_leaf, CASE WHEN 2 * words < size THEN whole ELSE '' END AS equal FROM t JOIN leaf USING (size, lead)
), shape AS (
  SELECT size, lead, tokens, words, lead_words, equal, in_leaf, count(DISTINCT doc_id) AS documents FROM c GROUP BY ALL
), place AS (
  SELECT size, lead, tokens, documents, in_leaf, unnest(range(4, size + 1)) AS spot FROM shape WHERE equal = ''
), deep AS (
  SELECT *, tokens[spot] AS token FROM place WHERE tokens[spot] <> '<*>'
), constant AS (
  SELECT size, lead, spot, token FROM deep GROUP BY 1, 2, 3, 4 HAVING sum(documents) >= 3 AND 100 * sum(documents) >= 10 * max(in_leaf)
), kept AS (
  SELECT d.size, d.lead, d.tokens, string_agg(d.spot || '=' || d.token, ' ' ORDER BY d.spot) AS template, count(*) AS n
  FROM deep d JOIN constant k USING (size, lead, spot, token) GROUP BY 1, 2, 3
), template AS (
  SELECT s.size, s.lead, s.tokens, s.equal, CASE WHEN s.equal = '' THEN coalesce(k.template, '') ELSE '= ' || s.equal END AS template
  FROM shape s LEFT JOIN kept k ON k.size = s.size AND k.lead = s.lead AND k.tokens = s.tokens AND s.equal = ''
  WHERE s.equal <> '' OR (s.lead_words + coalesce(k.n, 0)) * 100 >= s.words * 75
), found AS (
  SELECT c.doc_id, c.line, c.size, c.lead, p.template FROM c JOIN template p USING (size, lead, tokens, equal)
), wide AS (
  SELECT size, lead, template, min(doc_id) AS first FROM found GROUP BY 1, 2, 3 HAVING count(DISTINCT doc_id) >= 3
), gone AS (
  SELECT f.doc_id, f.line FROM found f JOIN wide w USING (size, lead, template) WHERE f.doc_id <> w.first
)
SELECT d.doc_id, coalesce(string_agg(l.raw, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text,
  count(l.line)::BIGINT AS n_lines, count(g.line)::BIGINT AS n_dropped
FROM documents d JOIN l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY d.doc_id
"""

ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), o AS (
  SELECT id, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS words FROM k GROUP BY 1
), c AS (
  SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), s AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS words FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.words + v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.words + v.v) AS whole
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 4
), word AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - whole) * (p - whole)) // whole)::BIGINT AS value FROM p WHERE n > 0 AND p > whole
), every AS (
  SELECT * FROM pair UNION ALL SELECT * FROM word
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM every
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES["op12_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), total AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY 1
), spot AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0
), gram AS (
  SELECT lang, len, array_to_string(words[i : i + len - 1], ' ') AS phrase FROM spot CROSS JOIN (VALUES (1), (2), (3), (4)) sizes(len) WHERE i + len - 1 <= len(words)
), f AS (
  SELECT lang, len, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY 1, 2, 3 HAVING count(*) >= 30
), cut AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS words, len, unnest(range(1, len)) AS k FROM f WHERE len > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
  FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1 : c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.k + 1 : c.len], ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM weakest s WHERE NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = s.lang AND g.len > len(string_split(s.phrase, ' ')) AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * g.f >= 80 * s.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
