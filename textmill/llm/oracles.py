"""SQL for the training-data queries that SQL can express."""

from __future__ import annotations

P1_FOUND = r"""
WITH s AS (SELECT DISTINCT sample_id AS id, regexp_extract_all(lower(sample), '[\p{L}\p{N}]+') AS w
           FROM filter_results WHERE sample IS NOT NULL),
g AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) END) AS r
      FROM s WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.r = b.r AND a.id < b.id GROUP BY a.id, b.id)
SELECT c.a AS sample_id_a, c.b AS sample_id_b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b
WHERE c.c * 10 >= least(x.n, y.n) * 7
"""


P1_CLASSES = r"""
WITH RECURSIVE s AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS r
      FROM s WHERE len(w) > 0),
k AS (SELECT id, md5(array_to_string(list_sort(list(r)), chr(10))) AS t FROM g GROUP BY id),
t AS (SELECT t, min(id) AS first FROM k GROUP BY t),
h AS (SELECT t.t, g.r FROM t JOIN g ON g.id = t.first),
n AS (SELECT t, count(*) AS n FROM h GROUP BY t),
c AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM h a JOIN h b ON a.r = b.r AND a.t <> b.t GROUP BY a.t, b.t),
e AS (SELECT a, b FROM c JOIN n x ON x.t = c.a JOIN n y ON y.t = c.b WHERE c.c * 10 >= least(x.n, y.n) * 8),
reach(a, b) AS (SELECT t, t FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
root AS (SELECT a AS t, min(first) AS class_id FROM reach JOIN t ON reach.b = t.t GROUP BY a),
d AS (SELECT a AS t, count(*) AS links FROM e GROUP BY a)
SELECT k.id AS doc_id, class_id, coalesce(links, 0) AS links FROM k JOIN root USING (t) LEFT JOIN d USING (t)
"""


P4_FOUND = r"""
WITH q AS (SELECT DISTINCT item_id, lang, regexp_extract_all(lower(question), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE split = 'test' AND question IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
qs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) AS g FROM q WHERE coalesce(lang, '') <> 'zh' AND len(w) >= 10),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) AS g FROM d WHERE len(w) >= 10),
qz AS (SELECT item_id, regexp_extract_all(array_to_string(w, ''), '.') AS c FROM q WHERE lang = 'zh'),
zs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(c) - 18), lambda i: array_to_string(c[i:i+19], ''))) AS g FROM qz WHERE len(c) >= 20),
dz AS (SELECT doc_id, array_to_string(w, '') AS s FROM d)
SELECT doc_id, item_id FROM qs JOIN ds USING (g) UNION SELECT doc_id, item_id FROM dz JOIN zs ON contains(dz.s, zs.g)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_classes": P1_CLASSES, "p4_found": P4_FOUND}
