"""SQL twins of the packed-field queries, for the comparison with DuckDB."""

_Q = """"(?:[^"\\\\]|\\\\.|"")*"|''(?:[^''\\\\]|\\\\.|'''')*''"""
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_CLEAN = (
    "CASE WHEN len(p) > 1 AND p LIKE '\"%\"' THEN replace(p[2:-2], '\"\"', '\"') WHEN len(p) > 1 AND p LIKE '''%''' THEN replace(replace(p[2:-2], '''''', ''''), '\\''', '''') ELSE p END"
)
PIECES = f"""src AS (SELECT DISTINCT locid, field_name, x FROM (SELECT locid, unnest(['files', 'parents', 'tags', 'branches']) AS field_name, unnest([files, parents, tags, branches]) AS x FROM logs) WHERE x IS NOT NULL),
 cut AS (SELECT locid, field_name, CASE WHEN {_TRIM.format('x')} LIKE '[%]' AND json_valid({_TRIM.format('x')}) THEN from_json({_TRIM.format('x')}, '["VARCHAR"]')
  WHEN {_TRIM.format('x')} LIKE '[%]' THEN list_transform(regexp_extract_all(x, '{_Q}'), lambda p: {_CLEAN})
  ELSE list_transform(list_filter(regexp_extract_all(x, '{_Q}|---|(?:-{{0,2}}[^\\s,;|"''-])+'), lambda p: p <> '---'), lambda p: {_CLEAN}) END AS items FROM src),
 kept AS (SELECT locid, field_name, list_filter(list_transform(items, lambda p: {_TRIM.format('p')}), lambda p: p <> '') AS items FROM cut),
 pieces AS (SELECT DISTINCT locid, field_name, unnest(range(len(items)))::BIGINT AS pos, unnest(items) AS item FROM kept)"""

P3_FOUND = f"WITH {PIECES} SELECT * FROM pieces"
# every stored row counts, so repeats come back in by the number of rows of their locid and text
P4_FOUND = f"""WITH {PIECES}, f AS (SELECT locid, item, count(DISTINCT locid) AS one FROM pieces WHERE field_name = 'files' GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM logs), m AS (SELECT locid, count(*) AS k FROM logs GROUP BY 1)
 SELECT key_kind, key_text FROM (SELECT 'author' AS key_kind, author AS key_text, count(*) AS c FROM logs WHERE author <> '' GROUP BY 2 UNION ALL SELECT 'files', item, sum(k) FROM f JOIN m USING (locid) GROUP BY 2), n WHERE c >= 0.04 * n"""
P4_PROFILES = f"""WITH {PIECES}, f AS (SELECT DISTINCT locid, item FROM pieces WHERE field_name = 'files'), m AS (SELECT locid, count(*) AS k FROM logs GROUP BY 1),
 keyed AS (SELECT 'author' AS key_kind, author AS key_text, count(*) AS n_rows, count(DISTINCT locid) AS n_distinct FROM logs WHERE author <> '' GROUP BY 2 UNION ALL SELECT 'files', item, sum(k)::BIGINT, count(*) FROM f JOIN m USING (locid) GROUP BY 2),
 held AS (SELECT 'author' AS key_kind, assignedTo AS key_text, count(DISTINCT bug) AS n_bugs FROM validbugs WHERE assignedTo <> '' GROUP BY 2) SELECT keyed.*, n_bugs FROM keyed LEFT JOIN held USING (key_kind, key_text)"""
_P5 = f"""WITH RECURSIVE {PIECES}, fp AS (SELECT locid, lower(substr(split_part(item, ':', -1), 1, 12)) AS p FROM (SELECT locid, item, row_number() OVER (PARTITION BY locid ORDER BY pos) AS k FROM pieces WHERE field_name = 'parents' AND item NOT LIKE '-1:%') WHERE k = 1),
 c AS (SELECT lower(substr(cid, 1, 12)) AS id, min(cid) AS cid, min(logs.locid) AS locid, arg_min(fp.p, logs.locid) AS p FROM logs LEFT JOIN fp USING (locid) GROUP BY 1), l AS (SELECT c.id, c.cid, c.locid, q.id AS p FROM c LEFT JOIN c q ON q.id = c.p),
 tree AS (SELECT id, id AS root, 0 AS d FROM l WHERE p IS NULL UNION ALL SELECT l.id, t.root, t.d + 1 FROM l JOIN tree t ON l.p = t.id), rest AS (SELECT * FROM l WHERE id NOT IN (SELECT id FROM tree)),
 w AS (SELECT id, p AS hop, 1 AS d FROM rest UNION ALL SELECT w.id, r.p, w.d + 1 FROM w JOIN rest r ON r.id = w.hop WHERE w.d < 2 * (SELECT count(*) FROM rest)),
 rings AS (SELECT w.id, min(l.cid) AS ring FROM w JOIN l ON l.id = w.hop WHERE w.id IN (SELECT id FROM w WHERE hop = id) GROUP BY 1),
 tails AS (SELECT w.id, min(w.d) AS d, arg_min(rings.ring, w.d) AS ring FROM w JOIN rings ON rings.id = w.hop WHERE w.id NOT IN (SELECT id FROM rings) GROUP BY 1),
 found AS (SELECT l.cid, 'tree' AS kind, r.cid AS root_cid, t.d::BIGINT AS depth FROM tree t JOIN l USING (id) JOIN l r ON r.id = t.root
 UNION ALL SELECT l.cid, 'cycle', ring, 0 FROM rings JOIN l USING (id) UNION ALL SELECT l.cid, 'tail', ring, d FROM tails JOIN l USING (id))"""
P5_FOUND = _P5 + " SELECT * FROM found"
# loops are opened: their commits are roots of what leads into them
_OPEN = """, o AS (SELECT id, cid, locid, CASE WHEN id NOT IN (SELECT id FROM rings) THEN p END AS p FROM l)"""
P5_PATHS = f"""{_P5}{_OPEN}, path AS (SELECT id, '' AS path FROM o WHERE p IS NULL UNION ALL SELECT o.id, q.locid || CASE WHEN path.path = '' THEN '' ELSE '/' || path.path END FROM o JOIN path ON o.p = path.id JOIN o q ON q.id = o.p)
 SELECT found.*, o.locid, path.path FROM found JOIN o USING (cid) JOIN path USING (id)"""
P5_DESCENDANTS = f"""{_P5}{_OPEN}, above AS (SELECT id, p AS a FROM o WHERE p IS NOT NULL UNION ALL SELECT above.id, o.p FROM above JOIN o ON o.id = above.a WHERE o.p IS NOT NULL),
 below AS (SELECT a AS id, count(*) AS n FROM above GROUP BY 1), b AS (SELECT o.*, coalesce(n, 0) AS n FROM o LEFT JOIN below USING (id)), s AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY p ORDER BY locid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
 pre AS (SELECT id, locid AS root_id, 0::BIGINT AS pre FROM s WHERE p IS NULL UNION ALL SELECT s.id, root_id, (pre.pre + 1 + s.before)::BIGINT FROM s JOIN pre ON s.p = pre.id)
 SELECT s.cid, s.locid, root_id, pre, n AS n_descendants FROM s JOIN pre USING (id)"""
