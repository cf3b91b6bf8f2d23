"""The same results in DuckDB's SQL where it can express them."""

from __future__ import annotations

# Reachability over dense cells from each probe's cell; the same cell width and density rule.
P3_FOUND = """
WITH RECURSIVE s AS (
  SELECT score_id, CASE WHEN score_unit = 'tscore' THEN (imag - 50.0) / 10.0 ELSE imag END AS a,
    CASE WHEN score_unit = 'tscore' THEN (sat - 50.0) / 10.0 ELSE sat END AS b,
    CASE WHEN score_unit = 'tscore' THEN (loy - 50.0) / 10.0 ELSE loy END AS c
  FROM satisfaction_scores WHERE isfinite(imag) AND isfinite(sat) AND isfinite(loy)
), m AS (
  SELECT count(*) AS n, 0.6 * greatest(stddev_pop(a), stddev_pop(b), stddev_pop(c)) * pow(count(*), -0.125) AS w,
    max(a) - min(a) AS ra, max(b) - min(b) AS rb, max(c) - min(c) AS rc FROM s
), t AS (
  SELECT *, n * 0.05 * least(1, w / ra) * least(1, w / rb) * least(1, w / rc) AS mean FROM m
), p AS (
  SELECT score_id, CAST(floor(a / w) AS BIGINT) AS x, CAST(floor(b / w) AS BIGINT) AS y, CAST(floor(c / w) AS BIGINT) AS z FROM s, t
), g AS (
  SELECT x, y, z, count(*) AS k FROM p GROUP BY ALL HAVING count(*) >= (SELECT greatest(2, ceil(mean + 4 * sqrt(mean) + 1)) FROM t)
), r AS (
  SELECT probe_id, g.x, g.y, g.z FROM score_probes, t JOIN g
    ON g.x = CAST(floor(imag / w) AS BIGINT) AND g.y = CAST(floor(sat / w) AS BIGINT) AND g.z = CAST(floor(loy / w) AS BIGINT)
  UNION
  SELECT probe_id, g.x, g.y, g.z FROM r JOIN g ON g.x BETWEEN r.x - 1 AND r.x + 1 AND g.y BETWEEN r.y - 1 AND r.y + 1 AND g.z BETWEEN r.z - 1 AND r.z + 1
), q AS (
  SELECT probe_id FROM r JOIN g USING (x, y, z) GROUP BY probe_id HAVING sum(k) >= 0.002 * (SELECT n FROM t)
), named AS (
  SELECT x, y, z, min(probe_id) AS probe_id FROM r JOIN q USING (probe_id) GROUP BY ALL
)
SELECT score_id, probe_id FROM p JOIN named USING (x, y, z)
"""

_UNITS = """
units AS (
  SELECT 'satisfaction' AS tbl, study_no, obs_id, category FROM (
    SELECT study_no, obs_id, CASE lower(trim(gender, ' ' || chr(9) || chr(13) || chr(10) || chr(160))) WHEN 'f' THEN 'female' WHEN 'female' THEN 'female'
      WHEN 'm' THEN 'male' WHEN 'male' THEN 'male' WHEN 'd' THEN 'diverse' WHEN 'diverse' THEN 'diverse' END AS category FROM satisfaction)
  UNION ALL
  SELECT 'corporate_reputation', study_no, obs_id, CASE WHEN servicetype BETWEEN 1 AND 3 THEN CAST(servicetype AS VARCHAR) END FROM corporate_reputation
), one AS (
  SELECT tbl, study_no, obs_id, category FROM (
    SELECT tbl, study_no, obs_id, category, row_number() OVER (PARTITION BY tbl, study_no, obs_id ORDER BY count(*) DESC, category) AS r
    FROM units WHERE category IS NOT NULL AND obs_id IS NOT NULL GROUP BY tbl, study_no, obs_id, category
  ) WHERE r = 1
), sizes AS (SELECT tbl, study_no, category, count(*) AS available FROM one GROUP BY ALL)
"""
P5_FOUND = f"""
WITH {_UNITS}
SELECT plan_id, p.category FROM sample_plans p LEFT JOIN sizes s ON s.tbl = p.tbl AND s.study_no = p.study_no AND s.category = p.category
WHERE coalesce(available, 0) < greatest(sample_rows * target_pct / 100.0, min_rows)
"""

SQL = {"p3_found": P3_FOUND, "p5_found": P5_FOUND}
