"""DuckDB SQL for the operators that SQL can express."""

LINE_DEDUP = r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM cut),
t AS (SELECT doc_id, line_no, line,
             list_sort(list_distinct(list_filter(string_split_regex(line, '[ \t-\r]+'), lambda x: x <> ''))) AS ws FROM l),
c AS (SELECT ws, len(ws) AS n, min((doc_id, line_no)) AS first, row_number() OVER () AS cid FROM t WHERE len(ws) > 0 GROUP BY ws),
w AS (SELECT cid, n, first, unnest(ws) AS word FROM c),
hit AS (SELECT a.cid FROM w a JOIN w b ON a.word = b.word AND b.first < a.first AND 4 * a.n <= 5 * b.n AND 4 * b.n <= 5 * a.n
        GROUP BY a.cid, b.cid, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
k AS (SELECT t.doc_id, t.line_no, t.line,
             c.cid IS NOT NULL AND (c.first <> (t.doc_id, t.line_no) OR c.cid IN (SELECT cid FROM hit)) AS gone
      FROM t LEFT JOIN c ON c.ws = t.ws)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""

DECONTAM = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND array_to_string(dw.w[i : i + dw.n - 1], ' ') = phrase),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
pt AS (SELECT DISTINCT phrase, unnest(string_split(phrase, ' ')) AS term FROM win),
df AS (SELECT term, count(*) AS df FROM tok WHERE term IN (SELECT term FROM pt) GROUP BY 1),
rk AS (SELECT phrase, pt.term, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(df, 0), pt.term) AS r FROM pt LEFT JOIN df ON pt.term = df.term),
pr AS (SELECT phrase, max(term) FILTER (WHERE r = 1) AS t1, max(term) FILTER (WHERE r = 2) AS t2, max(term) FILTER (WHERE r = 3) AS t3 FROM rk WHERE r <= 3 GROUP BY 1),
n1 AS (SELECT phrase, doc_id, pos, t2, t3 FROM pr JOIN tok ON term = t1),
n2 AS (SELECT DISTINCT n1.phrase, n1.doc_id, n1.pos, t3 FROM n1 LEFT JOIN tok b ON b.doc_id = n1.doc_id AND b.term = t2 AND abs(b.pos - n1.pos) <= 9 WHERE t2 IS NULL OR b.pos IS NOT NULL),
n3 AS (SELECT DISTINCT n2.phrase, n2.doc_id FROM n2 LEFT JOIN tok b ON b.doc_id = n2.doc_id AND b.term = t3 AND abs(b.pos - n2.pos) <= 9 WHERE t3 IS NULL OR b.pos IS NOT NULL),
nr AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near FROM n3 JOIN win ON win.phrase = n3.phrase GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id LEFT JOIN nr ON d.doc_id = nr.doc_id
"""
