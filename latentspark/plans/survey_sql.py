"""The same results in DuckDB's SQL, written independently of the operators."""

from __future__ import annotations

_P1 = """
SELECT '{tbl}' AS tbl, a.row_id, '{fld}' AS fld, {known} AS known_fill
FROM (SELECT row_id, {grp} AS g, {read} AS v FROM {tbl}) a
LEFT JOIN (
  SELECT {grp} AS g, min({read}) AS lo, max({read}) AS hi FROM {tbl} WHERE {grp} IS NOT NULL GROUP BY 1
) k ON a.g = k.g
WHERE a.v IS NULL
"""
_GENDER = (
    "CASE WHEN lower(trim(gender, ' ')) IN ('female', 'f') THEN 'female' WHEN lower(trim(gender, ' ')) IN ('male', 'm') THEN 'male' "
    "WHEN lower(trim(gender, ' ')) IN ('diverse', 'd') THEN 'diverse' END"
)
_TYPE = "CASE WHEN servicetype BETWEEN 1 AND 3 THEN CAST(servicetype AS VARCHAR) END"
_KNOWN = "CASE WHEN k.lo = k.hi THEN k.lo ELSE '' END"

P1_FOUND = " UNION ALL ".join(
    _P1.format(tbl=t, fld=f, grp=g, read=r, known=k)
    for t, f, g, r, k in (
        ("satisfaction", "sat1", "panel_id", "CASE WHEN sat1 BETWEEN 0 AND 10 THEN CAST(sat1 AS VARCHAR) END", "''"),
        ("satisfaction", "gender", "panel_id", _GENDER, _KNOWN),
        ("corporate_reputation", "cusl_1", "account_id", "CASE WHEN cusl_1 BETWEEN 1 AND 7 THEN CAST(cusl_1 AS VARCHAR) END", "''"),
        ("corporate_reputation", "servicetype", "account_id", _TYPE, _KNOWN),
    )
)

_P2_FIELDS = """
WITH l AS (
  SELECT line_id, feed, CASE WHEN coalesce(line, '') LIKE '%' || chr(13) THEN left(line, length(line) - 1) ELSE coalesce(line, '') END AS line
  FROM raw_lines WHERE line_no IS NULL OR line_no <> 1
), h AS (
  SELECT feed, regexp_extract_all(rtrim(line, chr(13)) || sep, '("(?:[^"]|"")*"|[^"' || sep || ']*)' || sep, 1) AS names, sep FROM (
    SELECT feed, CASE WHEN feed = 'satisfaction' THEN ',' ELSE ';' END AS sep, arg_max(line, n) AS line
    FROM (SELECT feed, line, count(*) AS n FROM raw_lines WHERE line_no = 1 GROUP BY ALL) GROUP BY 1, 2)
), q AS (
  SELECT l.line_id, l.feed, h.names, h.sep, l.line,
    regexp_full_match(line, '(?s)(?:"(?:[^"]|"")*"|[^"' || sep || ']*)(?:' || sep || '(?:"(?:[^"]|"")*"|[^"' || sep || ']*))*') AS quoted
  FROM l JOIN h USING (feed)
), f AS (
  SELECT *, CASE WHEN quoted THEN regexp_extract_all(line || sep, '(?s)("(?:[^"]|"")*"|[^"' || sep || ']*)' || sep, 1) END AS fields FROM q
)
"""
P2_FOUND = _P2_FIELDS.rstrip() + """, v AS (
  SELECT line_id, feed, lower(trim(trim(names[i], '"'))) AS name,
    trim(CASE WHEN fields[i] LIKE '"%' THEN replace(substr(fields[i], 2, length(fields[i]) - 2), '""', '"') ELSE fields[i] END, ' ' || chr(9) || chr(10) || chr(13)) AS value
  FROM f, unnest(range(1, len(names) + 1)) AS u(i) WHERE quoted AND len(fields) = len(names)
), bad AS (
  SELECT DISTINCT line_id FROM v LEFT JOIN model_indicators m ON m.tbl = v.feed AND m.fld = v.name
  WHERE value NOT IN ('', 'NA', '-99') AND (
    (m.fld IS NOT NULL AND NOT coalesce(regexp_full_match(value, '-?[0-9]{1,18}') AND try_cast(value AS BIGINT) BETWEEN scale_min AND scale_max, FALSE))
    OR (name = 'servicetype' AND NOT coalesce(regexp_full_match(value, '-?[0-9]{1,18}') AND try_cast(value AS BIGINT) BETWEEN 1 AND 3, FALSE))
    OR (name = 'serviceprovider' AND value NOT IN (SELECT CAST(serviceprovider AS VARCHAR) FROM providers))
    OR (name = 'gender' AND lower(value) NOT IN ('female', 'f', 'male', 'm', 'diverse', 'd')))
)
SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN len(fields) <> len(names) THEN 'columns' ELSE 'invalid' END AS reason
FROM f WHERE NOT quoted OR len(fields) <> len(names) OR line_id IN (SELECT line_id FROM bad)
"""

_P2_BAD = P2_FOUND[len(_P2_FIELDS.rstrip()) : P2_FOUND.index("SELECT line_id, CASE WHEN NOT quoted")]
P2_LOADED = _P2_FIELDS.rstrip() + _P2_BAD + """, u AS (
  SELECT line_id, feed, i, CASE WHEN fields[i] LIKE '"%' THEN replace(substr(fields[i], 2, length(fields[i]) - 2), '""', '"') ELSE fields[i] END AS value
  FROM f, unnest(range(1, len(names) + 1)) AS w(i) WHERE quoted AND len(fields) = len(names) AND line_id NOT IN (SELECT line_id FROM bad)
)
SELECT line_id, feed, string_agg(value, chr(31) ORDER BY i) AS fields FROM u GROUP BY line_id, feed
"""

P4_FOUND = """
WITH c AS (
  SELECT 'corporate_reputation' AS tbl, 'comp_1' AS fld, load_no, CAST(comp_1 AS VARCHAR) AS value FROM corporate_reputation
  UNION ALL SELECT 'corporate_reputation', 'qual_1', load_no, CAST(qual_1 AS VARCHAR) FROM corporate_reputation
  UNION ALL SELECT 'mobi', 'cusa1', load_no, cusa1 FROM mobi
), r AS (
  SELECT c.*, m.scale_min, m.scale_max, coalesce(value IN ('-99', '', 'NA'), TRUE) AS gap, regexp_full_match(value, '-?[0-9]+') AS whole
  FROM c JOIN model_indicators m USING (tbl, fld)
), a AS (
  SELECT *, CASE WHEN NOT gap AND whole AND try_cast(value AS DECIMAL(38, 0)) BETWEEN scale_min AND scale_max THEN CAST(try_cast(value AS INTEGER) AS VARCHAR) END AS answer FROM r
), u AS (
  SELECT tbl, fld, answer, usual_share / sum(usual_share) OVER (PARTITION BY tbl, fld) AS share FROM profile_baseline WHERE answer <> 'missing'
), n AS (
  SELECT tbl, fld, load_no, count(*) AS n, count(answer) AS n_valid, count(DISTINCT answer) AS k, count(*) FILTER (gap) AS gaps,
    count(*) FILTER (NOT gap AND NOT whole) AS odd, count(*) FILTER (NOT gap AND whole AND answer IS NULL) AS off,
    any_value(scale_max - scale_min + 1) AS points FROM a GROUP BY ALL
), s AS (
  SELECT n.tbl, n.fld, n.load_no, sum(abs(coalesce(x.m, 0) / n.n_valid - u.share)) / 2 AS shift FROM n JOIN u USING (tbl, fld)
  LEFT JOIN (SELECT tbl, fld, load_no, answer, count(*) AS m FROM a WHERE answer IS NOT NULL GROUP BY ALL) x
    ON x.tbl = n.tbl AND x.fld = n.fld AND x.load_no IS NOT DISTINCT FROM n.load_no AND x.answer = u.answer
  WHERE n.n_valid > 0 GROUP BY ALL
)
SELECT n.tbl, n.fld, n.load_no, 'nulls' AS finding FROM n JOIN profile_baseline b ON b.tbl = n.tbl AND b.fld = n.fld AND b.answer = 'missing'
  WHERE gaps / n.n - usual_share > 0.08
UNION ALL SELECT tbl, fld, load_no, 'pattern' FROM n WHERE odd > 0
UNION ALL SELECT tbl, fld, load_no, 'range' FROM n WHERE off > 0
UNION ALL SELECT tbl, fld, load_no, 'shift' FROM s WHERE shift > 0.2
UNION ALL SELECT tbl, fld, load_no, 'distinct' FROM n WHERE k BETWEEN 1 AND points // 2
"""

# Every column of both tables as text, with the aggregates of a profile.
P4_COUNTS = """
WITH c AS (
  SELECT 'corporate_reputation' AS tbl, load_no, fld, value FROM (
    UNPIVOT (SELECT load_no, CAST(COLUMNS(* EXCLUDE (load_no)) AS VARCHAR) FROM corporate_reputation) ON COLUMNS(* EXCLUDE (load_no)) INTO NAME fld VALUE value)
  UNION ALL SELECT 'mobi', load_no, fld, value FROM (
    UNPIVOT (SELECT load_no, CAST(COLUMNS(* EXCLUDE (load_no)) AS VARCHAR) FROM mobi) ON COLUMNS(* EXCLUDE (load_no)) INTO NAME fld VALUE value)
), size AS (
  SELECT 'corporate_reputation' AS tbl, load_no, count(*) AS n_rows FROM corporate_reputation GROUP BY 2 UNION ALL SELECT 'mobi', load_no, count(*) FROM mobi GROUP BY 2
), names AS (
  SELECT 'corporate_reputation' AS tbl, column_name AS fld FROM (DESCRIBE corporate_reputation) UNION ALL SELECT 'mobi', column_name FROM (DESCRIBE mobi)
), r AS (
  SELECT c.*, m.scale_min, m.scale_max, value IN ('-99', '', 'NA') AS gap, regexp_full_match(value, '-?[0-9]+') AS whole FROM c LEFT JOIN model_indicators m USING (tbl, fld)
), a AS (
  SELECT *, CASE WHEN NOT gap AND whole AND try_cast(value AS DECIMAL(38, 0)) BETWEEN scale_min AND scale_max THEN CAST(try_cast(value AS INTEGER) AS VARCHAR) END AS answer FROM r
), u AS (
  SELECT tbl, fld, answer, usual_share / sum(usual_share) OVER (PARTITION BY tbl, fld) AS share FROM profile_baseline WHERE answer <> 'missing'
), n AS (
  SELECT tbl, load_no, fld, count(*) FILTER (NOT gap) AS filled, count(DISTINCT value) FILTER (NOT gap) AS distinct_values, count(DISTINCT answer) AS distinct_answers, count(answer) AS n_valid,
    min(value) FILTER (NOT gap) AS min_text, max(value) FILTER (NOT gap) AS max_text, count(*) FILTER (NOT gap AND NOT whole) AS n_pattern, count(*) FILTER (NOT gap AND whole AND answer IS NULL) AS n_off_scale FROM a GROUP BY ALL
), s AS (
  SELECT n.tbl, n.fld, n.load_no, sum(abs(coalesce(x.m, 0) / n.n_valid - u.share)) / 2 AS shift FROM n JOIN u USING (tbl, fld)
  LEFT JOIN (SELECT tbl, fld, load_no, answer, count(*) AS m FROM a WHERE answer IS NOT NULL GROUP BY ALL) x
    ON x.tbl = n.tbl AND x.fld = n.fld AND x.load_no IS NOT DISTINCT FROM n.load_no AND x.answer = u.answer
  WHERE n.n_valid > 0 GROUP BY ALL
)
SELECT size.tbl, size.load_no, names.fld, size.n_rows, size.n_rows - coalesce(filled, 0) AS n_missing, round((size.n_rows - coalesce(filled, 0)) / size.n_rows, 9) AS missing_share,
  coalesce(distinct_values, 0) AS distinct_values, coalesce(distinct_answers, 0) AS distinct_answers, min_text, max_text, coalesce(n_pattern, 0) AS n_pattern, coalesce(n_off_scale, 0) AS n_off_scale,
  coalesce(n_valid, 0) AS n_valid, round(shift, 9) AS shift
FROM size JOIN names ON names.tbl = size.tbl AND names.fld <> 'load_no'
LEFT JOIN n ON n.tbl = size.tbl AND n.fld = names.fld AND n.load_no IS NOT DISTINCT FROM size.load_no
LEFT JOIN s ON s.tbl = size.tbl AND s.fld = names.fld AND s.load_no IS NOT DISTINCT FROM size.load_no
"""

SQL = {"p2_loaded": P2_LOADED, "p4_counts": P4_COUNTS, "p1_found": P1_FOUND, "p2_found": P2_FOUND, "p4_found": P4_FOUND}
