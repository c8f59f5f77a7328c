"""ANSI SQL of the general problems' queries, written apart from the operators."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _trim(c: str) -> str:
    return f"nullif(trim({c}, {_BLANK}), '')"


_CHANGES = rf"""
WITH complete AS (
  SELECT DISTINCT {_trim('repo')} AS repo, snapshot_id FROM deliveries WHERE lower({_trim('status')}) = 'complete'
), ordered AS (
  SELECT repo, snapshot_id, lag(snapshot_id) OVER (PARTITION BY repo ORDER BY snapshot_id) AS before FROM complete
), clean AS (
  SELECT {_trim('repo')} AS repo, snapshot_id, loaded_at,
    regexp_replace(regexp_replace(replace({_trim('path')}, '\', '/'), '/+', '/', 'g'), '^(\./|/)+', '') AS path,
    nullif(regexp_replace(lower({_trim('content_sha256')}), '^[a-z0-9]+:', ''), '') AS digest
  FROM files
), listed AS (
  SELECT repo, path, snapshot_id, digest FROM clean JOIN complete USING (repo, snapshot_id)
  WHERE path <> ''
  QUALIFY row_number() OVER (PARTITION BY repo, path, snapshot_id ORDER BY loaded_at DESC NULLS LAST, digest DESC NULLS LAST) = 1
), changes AS (
  SELECT n.repo, n.path, n.snapshot_id, CASE WHEN o.repo IS NULL THEN 'added' ELSE 'changed' END AS change
  FROM listed n JOIN ordered s ON s.repo = n.repo AND s.snapshot_id = n.snapshot_id AND s.before IS NOT NULL
  LEFT JOIN listed o ON o.repo = n.repo AND o.path = n.path AND o.snapshot_id = s.before
  WHERE o.repo IS NULL OR o.digest <> n.digest
  UNION ALL
  SELECT o.repo, o.path, s.snapshot_id, 'removed'
  FROM listed o JOIN ordered s ON s.repo = o.repo AND s.before = o.snapshot_id
  ANTI JOIN listed n ON n.repo = o.repo AND n.path = o.path AND n.snapshot_id = s.snapshot_id
)
"""

_ORPHANS = rf"""
WITH refs AS (
  SELECT relation_id, kind, recorded_at, target FROM (
    SELECT relation_id, lower({_trim('kind')}) AS kind, recorded_at, loaded_at,
      coalesce({_trim('target_qualified_name')}, {_trim('target_text')}) AS target
    FROM relations WHERE lower({_trim('resolution')}) IN ('resolved', 'probable') AND relation_id IS NOT NULL
  ) QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY loaded_at DESC NULLS LAST, target DESC NULLS LAST) = 1
), lives AS (
  SELECT name, start, stop FROM (
    SELECT {_trim('qualified_name')} AS name, first_seen_at AS start, deleted_at AS stop, loaded_at FROM symbols
  ) WHERE name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY loaded_at DESC NULLS LAST, start DESC NULLS LAST, stop DESC NULLS LAST) = 1
  UNION ALL
  SELECT {_trim('qualified_name')}, available_from, withdrawn_at FROM external_symbols
), judged AS (
  SELECT relation_id, r.kind, recorded_at, count(name) AS n,
    count(*) FILTER (WHERE name IS NOT NULL AND (start IS NULL OR recorded_at >= start) AND (stop IS NULL OR recorded_at < stop)) AS alive,
    count(*) FILTER (WHERE name IS NOT NULL AND recorded_at >= stop) AS ended
  FROM refs r LEFT JOIN lives ON name = target GROUP BY ALL
), orphans AS (
  SELECT relation_id, kind, recorded_at,
    CASE WHEN n = 0 THEN 'missing' WHEN ended > 0 THEN 'deleted' ELSE 'late' END AS reason
  FROM judged WHERE alive = 0
)
"""

_OPEN = rf"""
WITH refs AS (
  SELECT relation_id, kind, recorded_at, target, min(loaded_at) OVER (PARTITION BY relation_id) AS first_loaded FROM (
    SELECT relation_id, lower({_trim('kind')}) AS kind, recorded_at, loaded_at,
      coalesce({_trim('target_qualified_name')}, {_trim('target_text')}) AS target
    FROM relations WHERE lower({_trim('resolution')}) IN ('resolved', 'probable') AND relation_id IS NOT NULL
  ) QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY loaded_at DESC NULLS LAST, target DESC NULLS LAST) = 1
), arrivals AS (
  SELECT min(m) AS lo, max(m) AS hi FROM (
    SELECT year(loaded_at) * 12 + month(loaded_at) - 1 AS m FROM relations WHERE lower({_trim('resolution')}) IN ('resolved', 'probable')
    UNION ALL SELECT year(loaded_at) * 12 + month(loaded_at) - 1 FROM symbols)
), versions AS (
  SELECT source, name, start, stop, loaded_at, coalesce(year(loaded_at) * 12 + month(loaded_at) - 1, lo) AS since FROM (
    SELECT 's' AS source, {_trim('qualified_name')} AS name, first_seen_at AS start, deleted_at AS stop, loaded_at FROM symbols
    UNION ALL SELECT 'e', {_trim('qualified_name')}, available_from, withdrawn_at, NULL FROM external_symbols), arrivals
  WHERE name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source, name, since ORDER BY loaded_at DESC NULLS LAST, start DESC NULLS LAST, stop DESC NULLS LAST) = 1
), lives AS (
  SELECT *, coalesce(lead(since) OVER (PARTITION BY source, name ORDER BY since), hi + 1) AS until FROM versions, arrivals
), judged AS (
  SELECT relation_id, r.kind, m, count(name) AS n,
    count(*) FILTER (WHERE name IS NOT NULL AND (start IS NULL OR recorded_at >= start) AND (stop IS NULL OR recorded_at < stop)) AS alive,
    count(*) FILTER (WHERE name IS NOT NULL AND recorded_at >= stop) AS ended
  FROM (SELECT refs.*, m FROM refs, arrivals, LATERAL (SELECT unnest(generate_series(coalesce(year(first_loaded) * 12 + month(first_loaded) - 1, lo), hi)) AS m)) r
  LEFT JOIN lives ON name = target AND m >= since AND m < until GROUP BY ALL
)
"""

_TREE = rf"""
WITH RECURSIVE nodes AS (
  SELECT name, parent FROM (
    SELECT {_trim('qualified_name')} AS name, {_trim('parent_qualified_name')} AS parent, loaded_at FROM symbols
  ) WHERE name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY loaded_at DESC NULLS LAST, parent DESC NULLS LAST) = 1
), tree AS (
  SELECT name, name AS root, 0 AS depth, name AS path FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.name, t.root, t.depth + 1, t.path || ' > ' || n.name FROM nodes n JOIN tree t ON n.parent = t.name
)
"""

_CHAINS = rf"""
WITH RECURSIVE nodes AS (
  SELECT name, parent FROM (
    SELECT {_trim('qualified_name')} AS name, {_trim('parent_qualified_name')} AS parent, loaded_at FROM symbols
  ) WHERE name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY loaded_at DESC NULLS LAST, parent DESC NULLS LAST) = 1
), up AS (
  SELECT name AS start, parent AS node FROM nodes WHERE parent IS NOT NULL
  UNION SELECT start, n.parent FROM up JOIN nodes n ON n.name = up.node WHERE n.parent IS NOT NULL
), circle AS (SELECT start AS name FROM up WHERE start = node
), lost AS (
  SELECT start, 'broken' AS status, max(node) FILTER (WHERE node NOT IN (SELECT name FROM nodes)) AS top, count(*) AS steps FROM up
  GROUP BY start HAVING count(*) FILTER (WHERE node NOT IN (SELECT name FROM nodes)) > 0
), turning AS (
  SELECT start, CASE WHEN start IN (SELECT name FROM circle) THEN 'on_cycle' ELSE 'below_cycle' END AS status, min(node) FILTER (WHERE node IN (SELECT name FROM circle)) AS top,
    CASE WHEN start IN (SELECT name FROM circle) THEN 0 ELSE count(*) FILTER (WHERE node NOT IN (SELECT name FROM circle)) + 1 END AS steps
  FROM up GROUP BY start HAVING count(*) FILTER (WHERE node IN (SELECT name FROM circle)) > 0
)
"""

SQL = {
    "p1_found": _CHANGES + "SELECT repo, path, snapshot_id, change FROM changes",
    "p1_change_counts": _CHANGES + "SELECT repo, snapshot_id, change, count(*) AS n_files FROM changes GROUP BY ALL",
    "p3_found": _ORPHANS + "SELECT relation_id, reason FROM orphans",
    "p3_counts": _ORPHANS + "SELECT 'relations' AS table_name, kind, strftime(recorded_at, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM orphans GROUP BY ALL",
    "p3_open_by_period": _OPEN + """SELECT format('{:04d}-{:02d}', m // 12, m % 12 + 1) AS month, kind,
  CASE WHEN n = 0 THEN 'missing' WHEN ended > 0 THEN 'deleted' ELSE 'late' END AS reason, count(*) AS n_open FROM judged WHERE alive = 0 GROUP BY ALL""",
    "p6_found": _CHAINS + "SELECT start AS qualified_name, status, top, steps::INTEGER AS steps FROM (SELECT * FROM lost UNION ALL SELECT * FROM turning)",
    "p6_descendants": _CHAINS.replace("), circle AS", """), below AS (
  SELECT name AS descendant, parent AS ancestor, 1 AS distance FROM nodes WHERE parent IS NOT NULL AND name NOT IN (SELECT u.start FROM up u JOIN up v ON v.start = u.node AND v.node = u.node)
    AND name NOT IN (SELECT start FROM up WHERE start = node)
  UNION ALL SELECT descendant, n.parent, distance + 1 FROM below JOIN nodes n ON n.name = ancestor WHERE n.parent IS NOT NULL
), circle AS""") + "SELECT ancestor, descendant, distance FROM below WHERE ancestor IN (SELECT name FROM nodes)",
    "p6_paths": _TREE + "SELECT name AS qualified_name, path, depth, root FROM tree",
}
