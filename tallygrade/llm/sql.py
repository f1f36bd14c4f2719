"""SQL that recomputes the results of this folder's queries from the tables."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS t FROM s),
c AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(min(b) AS BIGINT) AS component_id FROM n JOIN r ON r.a = doc_id GROUP BY ALL
"""

WORDS = f"""regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest([array_to_string(w[s:s + 9], ' ') FOR s IN generate_series(1, greatest(1, len(w) - 9))]) AS t
      FROM b WHERE len(w) > 0),
l AS (SELECT DISTINCT m FROM i),
p AS (SELECT k, m, w, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, l WHERE len(w) >= m),
h AS (SELECT DISTINCT k, s, p.m, item_id FROM p JOIN i ON p.m = i.m AND array_to_string(w[s:s + p.m - 1], ' ') = t),
c AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest(generate_series(s, s + m - 1)) AS q FROM h) GROUP BY k),
j AS (SELECT k, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(j.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, c.n IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (k) LEFT JOIN j USING (k)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to FROM p LEFT JOIN f USING (h)
"""

#: The table of crc32, and the crc32 of a list of bytes.
CRC_TABLE = """tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], CAST(range(8) AS BIGINT[])),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END)) AS t)"""
CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], CAST({} AS BIGINT[])), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), CAST(4294967295 AS BIGINT))"""

TURNS = f"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {CRC.format("list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x))")} % 20 AS k FROM conversations, tbl),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS r FROM d),
m AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  r || lead(r) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
  count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM m GROUP BY conv_id),
ins(s, z, cost, a, t) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', 'user:' || chr(10)), (1, 2, 3, 'I', 'user:' || chr(10)),
  (3, 2, 3, 'I', 'user:' || chr(10)), (2, 3, 3, 'I', 'assistant:' || chr(10)), (0, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
mv AS (SELECT conv_id, i, s, s AS z, 4 AS cost, 'D' AS a, '' AS t FROM m, range(4) x(s)
  UNION ALL SELECT conv_id, i, s, z, CASE WHEN fault IS NULL THEN 0 ELSE 3 END, 'K', role || ':' || text || chr(10) FROM m, (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')) x(s, z, w) WHERE w = r AND (fault IS NULL OR fault = 'truncated')
  UNION ALL SELECT conv_id, i, s, z, CASE WHEN fault IS NULL THEN 3 ELSE 6 END, 'R', w || ':' || text || chr(10) FROM m, (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')) x(s, z, w) WHERE fault IS NULL OR fault = 'truncated'),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS b FROM g
  UNION ALL SELECT dp.conv_id, dp.i + 1, CAST(mv.z AS BIGINT), min({{'c': CAST(b.c + ins.cost + mv.cost AS BIGINT), 'a': b.a || ins.a || mv.a, 't': b.t || ins.t || mv.t}})
    FROM dp JOIN ins ON ins.s = dp.s JOIN mv ON mv.conv_id IS NOT DISTINCT FROM dp.conv_id AND mv.i = dp.i + 1 AND mv.s = ins.z GROUP BY dp.conv_id, dp.i, mv.z),
e AS (SELECT dp.conv_id, min({{'c': CAST(b.c + ins.cost AS BIGINT), 'a': b.a || ins.a, 't': b.t || ins.t}}) AS b FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = g.n JOIN ins ON ins.s = dp.s AND (ins.z = 3 OR dp.s = 0 AND ins.z = 0) GROUP BY dp.conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(e.b.c, 0) AS cost, coalesce(e.b.a, '') AS audit, sha256(coalesce(left(e.b.t, greatest(length(e.b.t) - 1, 0)), '')) AS repaired_sha256
FROM a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, {LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS r FROM documents),
c AS (SELECT d, r, count(*) AS c FROM r WHERE length(r) >= 5 GROUP BY ALL),
h AS (SELECT r, c, {CRC.format("flatten(list_transform(string_split(d || ':' || r, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, 128 + ord(x) % 64] END))")} AS h FROM c, tbl),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND n >= 3),
s AS (SELECT word, n, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w)),
near AS (SELECT x.word, x.n, y.word AS o, y.n AS m FROM s x JOIN s y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT s.word, s.n, w.word, w.n FROM s JOIN w ON w.word = a || b UNION SELECT w.word, w.n, s.word, s.n FROM s JOIN w ON w.word = a || b),
best AS (SELECT word, count(*) AS k, first(o ORDER BY m DESC, o) AS o, max(m) AS m, any_value(n) AS n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(k, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN o END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
g AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.further)
SELECT f.word, f.form, g.root, f.n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN g ON g.word = f.word AND g.further IS NULL
"""
