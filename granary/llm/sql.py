"""SQL of the queries that DuckDB can express."""

# A conversation is laid out as <|role=R|>text<|next|>text<|end|>; every escaped control string adds a character.
OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v
), placed AS (
  SELECT *, row_number() OVER w AS nth, lag(role) OVER w AS before FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body)
), sized AS (
  SELECT *, len(body) + len(regexp_extract_all(body, '[<\[]\\*(/?s>|\||/?INST\])'))
    + CASE WHEN nth = 1 OR role <> before THEN len('<|role=' || url_encode(role) || '|><|end|>') ELSE len('<|next|>') END AS chars
  FROM placed
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY nth)) AS turns_sha256,
  len(coalesce(string_agg(body, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

# Similar sets share one of the rarest 20 % of their shingles; those pairs are compared in full.
OP8 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM split
), sizes AS (SELECT doc_id, len(shingles) AS n FROM sets),
items AS (SELECT doc_id, unnest(shingles) AS s FROM sets),
often AS (SELECT s, count(*) AS often FROM items GROUP BY s HAVING count(*) > 1),
ranked AS (
  SELECT i.doc_id, i.s, row_number() OVER (PARTITION BY i.doc_id ORDER BY coalesce(o.often, 1), i.s) AS nth, n
  FROM items i JOIN sizes USING (doc_id) LEFT JOIN often o USING (s)
), prefixes AS (SELECT doc_id, s, n FROM ranked WHERE nth <= n - (80 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM prefixes a JOIN prefixes b ON a.s = b.s AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS (
  SELECT u, v FROM pairs JOIN sets a ON a.doc_id = u JOIN sets b ON b.doc_id = v
  WHERE 100 * len(list_intersect(a.shingles, b.shingles)) >= 80 * (len(a.shingles) + len(b.shingles) - len(list_intersect(a.shingles, b.shingles)))
), ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, w.v FROM reached r JOIN ways w ON w.u = r.other
)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""

# Lines are compared trimmed, lower-cased, with digits as 0; documents of a host are told apart by all their lines.
OP3 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
), windows AS (
  SELECT rid, unnest(range(1, len(words) - 3)) AS place, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS w
  FROM split WHERE len(words) >= 5
), repeated AS (
  SELECT rid, place, lead(place) OVER (PARTITION BY rid ORDER BY place) AS following
  FROM (SELECT rid, place, count(*) OVER (PARTITION BY rid, w) AS times FROM windows) WHERE times > 1
), covered AS (SELECT rid, sum(least(5, coalesce(following - place, 5))) AS n_repeat_words FROM repeated GROUP BY rid),
normal AS (
  SELECT rid, source, lines, list_transform(lines, lambda x: translate(lower(trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), '123456789', '000000000')) AS shown FROM split
), parts AS (
  SELECT rid, source, shown, unnest(shown) AS line, unnest(list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))) AS n FROM normal
), common AS (SELECT source, line FROM parts GROUP BY source, line HAVING count(DISTINCT shown) > 10),
removed AS (
  SELECT rid, sum(n) AS n FROM parts p WHERE EXISTS (SELECT 1 FROM common c WHERE c.source IS NOT DISTINCT FROM p.source AND c.line = p.line) GROUP BY rid
), counted AS (
  SELECT rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM split
), judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed, CAST(n_words - coalesce(r.n, 0) AS BIGINT) AS words_left
  FROM counted LEFT JOIN covered USING (rid) LEFT JOIN removed r USING (rid)
)
SELECT *, NOT base_failed AND NOT words_left < 0.2 * n_words AS kept FROM judged
"""
