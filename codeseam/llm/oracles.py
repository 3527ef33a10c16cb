"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT dw.rid, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

#: Components of shingle sets, with the width of a shingle and the least similarity to be set.
COMPONENTS = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < WIDTH THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - WIDTH + 2), lambda i: array_to_string(list_slice(w, i, i + WIDTH - 1), ' '))) END AS g
  FROM d
), n AS (SELECT doc_id, len(g) AS n FROM s
), classes AS (SELECT min(doc_id) AS rep, list_sort(g) AS g FROM s WHERE len(g) > 0 GROUP BY list_sort(g)
), x AS (SELECT rep, len(g) AS n, unnest(g) AS g FROM classes
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= PERCENT * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), roots AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a
), placed AS (SELECT g, root FROM classes JOIN roots USING (rep))
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id
FROM s LEFT JOIN placed ON list_sort(s.g) = placed.g
"""

OP4 = f"SELECT *, doc_id = component_id AS kept FROM ({COMPONENTS.replace('WIDTH', '5').replace('PERCENT', '85')})"

OP12 = COMPONENTS.replace("WIDTH", "3").replace("PERCENT", "90")

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM w LEFT JOIN marks USING (doc_id) GROUP BY 1, 2
), letters(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.c NOT IN (b.c, c.c, d.c, e.c) AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c <> e.c
), s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM orders, range(1, 6) AS r(step)
), x AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failed, fails = f AS just_it, length(translate(earlier, fails, '')) < length(earlier) AS gone FROM m, s
), r AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0) AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (just_it), 0) AS unique_fails, coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256(concat('42:', doc_id)) AS h FROM documents
), u AS (
  SELECT *, len(w) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM d
), f AS (
  SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR k[3] % 100 >= 50 THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), c AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

OP5 = """
WITH RECURSIVE l AS (
  SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''))
), c AS (SELECT * FROM l WHERE line <> ''
), u AS (SELECT line, strlen(line) AS n, row_number() OVER () AS id FROM (SELECT DISTINCT line FROM c)
), links AS (
  SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.n >= 60 AND b.n BETWEEN a.n AND a.n + 2 AND a.id <> b.id AND levenshtein(a.line, b.line) <= 2
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (SELECT id, id FROM u UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a
), placed AS (
  SELECT doc_id, line_no, first_value(doc_id) OVER w AS class_doc, first_value(line_no) OVER w AS class_line
  FROM c JOIN u USING (line) JOIN roots USING (id) WINDOW w AS (PARTITION BY root ORDER BY doc_id, line_no)
), gone AS (
  SELECT doc_id, list(CAST(line_no AS INTEGER) ORDER BY line_no) AS removed, list(class_doc ORDER BY line_no) AS class_docs FROM placed WHERE (doc_id, line_no) <> (class_doc, class_line) GROUP BY doc_id
), counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line <> '') AS n_compared FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_compared, 0) AS BIGINT) AS n_compared, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed,
  coalesce(removed, []) AS removed, coalesce(class_docs, []) AS class_docs
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

SQL: dict[str, str] = {"op2_decontamination": OP2, "op4_near_duplicates": OP4, "op5_line_dedup": OP5, "op11_filter_audit": OP11, "op12_set_join": OP12, "op13_fill_in_middle": OP13}
