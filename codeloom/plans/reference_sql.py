"""ANSI SQL of the retrieval engine's queries, written apart from the operators."""

from __future__ import annotations

from codeloom.plans.problem_sql import _trim

_INF = "('inf')::DOUBLE"


def _base(c: str) -> str:
    return f"regexp_extract(regexp_replace({c}, '\\(.*$', ''), '([^.:]+)$', 1)"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"


_SYMBOLS = rf"""
symbols_now AS (
  SELECT qualified_name, path, name, kind, start_line, end_line, start_byte, end_byte, signature, parent FROM (
    SELECT {_trim('qualified_name')} AS qualified_name, {_trim('path')} AS path, {_trim('name')} AS name, lower({_trim('kind')}) AS kind,
      start_line, end_line, start_byte, end_byte, signature, {_trim('parent_qualified_name')} AS parent, loaded_at FROM symbols
  ) WHERE qualified_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY loaded_at DESC NULLS LAST, path DESC NULLS LAST, name DESC NULLS LAST, kind DESC NULLS LAST,
    start_line DESC NULLS LAST, end_line DESC NULLS LAST, start_byte DESC NULLS LAST, end_byte DESC NULLS LAST, signature DESC NULLS LAST, parent DESC NULLS LAST) = 1
)"""
_UNITS = rf"""{_SYMBOLS}, units_now AS (
  SELECT u.*, s.name, s.kind, s.signature FROM (
    SELECT qualified_name, path, source_text, start_line, end_line, start_byte, end_byte FROM (
      SELECT {_trim('qualified_name')} AS qualified_name, {_trim('path')} AS path, coalesce(source_text, '') AS source_text, start_line, end_line, start_byte, end_byte, loaded_at
      FROM code_units
    ) WHERE qualified_name IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY loaded_at DESC NULLS LAST, path DESC NULLS LAST, source_text DESC NULLS LAST,
      start_line DESC NULLS LAST, end_line DESC NULLS LAST, start_byte DESC NULLS LAST, end_byte DESC NULLS LAST) = 1
  ) u JOIN symbols_now s USING (qualified_name)
)"""
_FILE = "regexp_replace(regexp_replace(replace({}, '\\', '/'), '/+', '/', 'g'), '^(\\./|/)+', '')"
_SEARCH = rf"""{_UNITS}, modules AS (
  SELECT {_FILE.format(_trim('path'))} AS file, {_trim('module_name')} AS module_name FROM files
  QUALIFY row_number() OVER (PARTITION BY file ORDER BY loaded_at DESC NULLS LAST, module_name DESC NULLS LAST) = 1
), search_units AS (SELECT u.*, module_name FROM units_now u LEFT JOIN modules ON file = {_FILE.format('u.path')})"""
_EDGES = rf"""
edges_now AS (
  SELECT relation_id, kind, source, target, target_text, resolution, path, start_byte, end_byte FROM (
    SELECT relation_id, lower({_trim('kind')}) AS kind, {_trim('source_qualified_name')} AS source, {_trim('target_qualified_name')} AS target,
      {_trim('target_text')} AS target_text, lower({_trim('resolution')}) AS resolution, {_trim('path')} AS path, start_byte, end_byte, loaded_at FROM relations
  ) WHERE relation_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY loaded_at DESC NULLS LAST, kind DESC NULLS LAST, source DESC NULLS LAST, target DESC NULLS LAST,
    target_text DESC NULLS LAST, resolution DESC NULLS LAST, path DESC NULLS LAST, start_byte DESC NULLS LAST, end_byte DESC NULLS LAST) = 1
)"""
_VECTORS = rf"""
unit_vectors AS (
  SELECT vec_id, model_id, {_trim('qualified_name')} AS qualified_name, vector::DOUBLE[] AS vector FROM reuse_vectors
  WHERE len(vector) = 64 AND len([x FOR x IN vector IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN vector IF x <> 0]) > 0
), search_queries AS (
  SELECT vec_id AS query_id, {_base('qualified_name')} AS text, model_id, vector, qualified_name AS gold FROM unit_vectors
  WHERE vec_id % 100 = 0 AND qualified_name IS NOT NULL
)"""
_FOLLOWED = """
followed AS (
  SELECT * FROM edges_now WHERE resolution IN ('resolved', 'probable') AND target IN (SELECT qualified_name FROM symbols_now) AND source IN (SELECT qualified_name FROM symbols_now)
)"""


def _lexical(columns: list[str], docs: str, key: str, depth: int, where: str = "") -> str:
    """CTEs that end in ``lexical`` (query_id, item, score, rank)."""
    text = " || [chr(1)] || ".join(_tokens(c) for c in columns)
    return rf"""
phrases AS (
  SELECT query_id, phrase, n FROM (
    SELECT query_id, array_to_string(t, ' ') AS phrase, len(t) AS n FROM (
      SELECT query_id, {_tokens('part')} AS t FROM (SELECT query_id, unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS part FROM search_queries)
    ) WHERE len(t) > 0)
), toks AS (
  SELECT {key} AS item, {text} AS t FROM {docs}
), sized AS (
  SELECT item, t, len(t) - {len(columns) - 1} AS dl FROM toks
), lengths AS (SELECT DISTINCT n FROM phrases
), grams AS (
  SELECT item, dl, array_to_string(t[i : i + n - 1], ' ') AS phrase FROM (SELECT item, dl, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM sized, lengths)
), hits AS (
  SELECT item, phrase, count(*) AS tf, any_value(dl) AS dl FROM grams WHERE phrase IN (SELECT phrase FROM phrases) GROUP BY item, phrase
), whole AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM sized
), weights AS (
  SELECT phrase, avg_dl, CASE WHEN ln((n_docs - df + 0.5e0) / (df + 0.5e0)) > 0 THEN ln((n_docs - df + 0.5e0) / (df + 0.5e0)) ELSE 1e-6 END AS idf
  FROM (SELECT phrase, count(*) AS df FROM hits GROUP BY phrase), whole
), scored AS (
  SELECT p.query_id, h.item, round(sum(idf * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avg_dl)))), 6) AS score
  FROM phrases p JOIN hits h USING (phrase) JOIN weights w USING (phrase) {where} GROUP BY ALL
), lexical AS (
  SELECT query_id, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM scored) WHERE rank <= {depth}
)"""


_COLUMNS = ["qualified_name", "name", "signature", "source_text", "module_name", "path", "kind"]


def _hybrid(limit: int, kind: str | None = None) -> str:
    """CTEs that end in ``hybrid`` (query_id, item, score, rank) with ``limit`` rows a query; ``kind``: only those under src/."""
    depth = max(50, 5 * limit)
    only = f"WHERE kind = '{kind}' AND starts_with(path, 'src/')" if kind else ""
    loose = f"WHERE item IN (SELECT qualified_name FROM units_now WHERE kind = '{kind}' AND starts_with(lower(path), 'src/'))" if kind else ""
    return rf"""{_SEARCH}, allowed AS (SELECT qualified_name FROM units_now {only}), {_VECTORS}, {_lexical(_COLUMNS, 'search_units', 'qualified_name', depth, loose)}, dense AS (
  SELECT query_id, item, rank FROM (
    SELECT q.query_id, v.qualified_name AS item,
      row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.vector, v.vector), 6) DESC, v.qualified_name) AS rank
    FROM search_queries q JOIN unit_vectors v ON v.model_id = q.model_id WHERE v.qualified_name IN (SELECT qualified_name FROM allowed) AND trim(q.text) <> ''
  ) WHERE rank <= {depth}
), hybrid AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM (
      SELECT query_id, item, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT query_id, item, rank FROM lexical UNION ALL SELECT query_id, item, rank FROM dense) GROUP BY ALL)
  ) WHERE rank <= {limit}
)"""


def _graph(limit: int, kind: str | None = None) -> str:
    """CTEs that end in ``graph`` (query_id, item, score, rank)."""
    pool = max(10, limit)
    return rf"""{_hybrid(pool, kind)}, {_EDGES}, seeds AS (SELECT query_id, item AS seed, rank AS seed_rank FROM hybrid WHERE rank <= 10
), links AS (
  SELECT DISTINCT kind, source, target FROM edges_now WHERE resolution = 'resolved' AND kind IN ('calls', 'references', 'inherits', 'contains')
), evidence AS (
  SELECT DISTINCT * FROM (
    SELECT query_id, seed, seed_rank, target AS item, kind, 'seed_to_candidate' AS direction FROM seeds JOIN links ON source = seed
    UNION ALL SELECT query_id, seed, seed_rank, source, kind, 'candidate_to_seed' FROM seeds JOIN links ON target = seed
  ) WHERE item <> seed AND item IN (SELECT qualified_name FROM allowed)
), support AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, item) AS rank FROM (
    SELECT query_id, item, round(sum(1e0 / (60 + seed_rank)), 9) AS support FROM (SELECT DISTINCT query_id, item, seed_rank FROM evidence) GROUP BY ALL)
), graph AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM (
      SELECT query_id, item, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT query_id, item, rank FROM hybrid UNION ALL SELECT query_id, item, rank FROM support) GROUP BY ALL)
  ) WHERE rank <= {limit}
)"""


def _reranked(limit: int) -> str:
    """CTEs that end in ``channels`` and ``reranked``."""
    depth = max(20, 5 * limit)
    return rf"""{_graph(depth)}, channels AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY support DESC, item) AS rank FROM (
    SELECT query_id, kind, item, round(sum(1e0 / (60 + seed_rank)), 9) AS support FROM (
      SELECT DISTINCT query_id, kind, item, seed_rank FROM evidence SEMI JOIN graph USING (query_id, item)) GROUP BY ALL)
), contributions AS (
  SELECT query_id, item, 'graph_base' AS source, rank AS list_rank FROM graph UNION ALL SELECT query_id, item, kind, rank FROM channels
), reranked AS (
  SELECT query_id, item, score, original_rank, rank, original_rank - rank AS rank_delta FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank, item) AS rank FROM (
      SELECT c.query_id, c.item, round(sum(1e0 / (60 + list_rank)), 9) AS score, any_value(g.rank) AS original_rank
      FROM contributions c JOIN graph g USING (query_id, item) GROUP BY ALL)
  ) WHERE rank <= {limit}
)"""


_CODE_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\t\n\v\f\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _modes() -> str:
    """The five ranked lists of one limit; each mode fuses at its own depth, so the CTEs are nested queries."""

    def part(mode: str, ctes: str, table: str) -> str:
        return f"SELECT query_id, '{mode}' AS mode, item, rank FROM (WITH {ctes} SELECT query_id, item, rank FROM {table})"

    lexical = f"{_SEARCH}, {_VECTORS}, {_lexical(_COLUMNS, 'search_units', 'qualified_name', 10)}"
    return " UNION ALL ".join(
        [
            part("lexical", lexical, "lexical"),
            part("dense", _hybrid(10), "dense WHERE rank <= 10"),
            part("hybrid", _hybrid(10), "hybrid"),
            part("graph", _graph(10), "graph"),
            part("reranked", _reranked(10), "reranked"),
        ]
    )


_RANKS = rf"""
WITH {_VECTORS}, ranked AS ({_modes()}), ranks AS (
  SELECT q.query_id, q.model_id AS category, m.mode, min(r.rank) AS rank
  FROM search_queries q CROSS JOIN (VALUES ('lexical'), ('dense'), ('hybrid'), ('graph'), ('reranked')) m(mode)
  LEFT JOIN ranked r ON r.query_id = q.query_id AND r.mode = m.mode AND r.item = q.gold AND r.rank <= 10 GROUP BY ALL
)
"""


def _listing(name: str, back: int) -> str:
    path = f"regexp_replace(regexp_replace(replace({_trim('path')}, '\\', '/'), '/+', '/', 'g'), '^(\\./|/)+', '')"
    return rf"""
{name} AS (
  SELECT repo, path, digest, language_id FROM (
    SELECT f.repo, {path} AS path, nullif(regexp_replace(lower({_trim('content_sha256')}), '^[a-z0-9]+:', ''), '') AS digest, lower({_trim('language_id')}) AS language_id, loaded_at
    FROM files f JOIN (
      SELECT repo, snapshot_id, row_number() OVER (PARTITION BY repo ORDER BY snapshot_id DESC) AS n
      FROM (SELECT DISTINCT repo, snapshot_id FROM deliveries WHERE lower({_trim('status')}) = 'complete')
    ) c ON c.repo = f.repo AND c.snapshot_id = f.snapshot_id AND n = {back + 1}
  ) WHERE path <> ''
  QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY loaded_at DESC NULLS LAST, digest DESC NULLS LAST, language_id DESC NULLS LAST) = 1
)"""


_CHANGES = rf"""{_listing('old_files', 1)}, {_listing('new_files', 0)}, changes AS (
  SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path,
    CASE WHEN o.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'deleted' WHEN o.digest IS NOT DISTINCT FROM n.digest THEN 'unchanged' ELSE 'changed' END AS change
  FROM old_files o FULL JOIN new_files n ON o.repo = n.repo AND o.path = n.path
)"""


def _surface(name: str, where: str) -> str:
    return rf"""
{name} AS (
  SELECT qualified_name, name, kind, parent FROM (
    SELECT {_trim('qualified_name')} AS qualified_name, {_trim('name')} AS name, lower({_trim('kind')}) AS kind, {_trim('parent_qualified_name')} AS parent, loaded_at FROM symbols {where}
  ) WHERE qualified_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY loaded_at DESC NULLS LAST, name DESC NULLS LAST, kind DESC NULLS LAST, parent DESC NULLS LAST) = 1
)"""


def _reach(direction: str, depth: int) -> str:
    a, b = ("source", "target") if direction == "outgoing" else ("target", "source")
    return rf"""
WITH RECURSIVE {_SYMBOLS}, {_EDGES}, {_FOLLOWED}, {_VECTORS}, hops AS (SELECT DISTINCT {a} AS a, {b} AS b FROM followed
), reach AS (
  SELECT DISTINCT gold AS seed, gold AS name, 0 AS distance FROM search_queries WHERE gold IN (SELECT qualified_name FROM symbols_now)
  UNION SELECT seed, b, distance + 1 FROM reach JOIN hops ON a = name WHERE distance < {depth}
), nearest AS (SELECT seed, name, min(distance) AS distance FROM reach GROUP BY ALL)
"""


_DENSE = """
SELECT query_id, vec_id, cosine, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS cosine,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id)::INTEGER AS rank
  FROM embeddings q JOIN embeddings v ON {on} WHERE q.vec_id % 100 = 0
) WHERE rank <= 10
"""
_FINGERPRINT = "sha256('symbol: ' || qualified_name || chr(10) || 'signature: ' || coalesce(signature, '') || chr(10) || 'code:' || chr(10) || source_text)"
_DOCUMENT_TOKENS = f"SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents"

SQL = {
    "lexical_search": f"WITH {_SEARCH}, {_VECTORS}, {_lexical(_COLUMNS, 'search_units', 'qualified_name', 10)} SELECT query_id, item AS qualified_name, score, rank::INTEGER AS rank FROM lexical",
    "lexical_documents": f"WITH {_VECTORS}, {_lexical(['text'], 'documents', 'doc_id', 10)} SELECT query_id, item AS doc_id, score, rank::INTEGER AS rank FROM lexical",
    "lexical_filtered": f"WITH {_SEARCH}, {_VECTORS}, {_lexical(_COLUMNS, 'search_units', 'qualified_name', 10, where='''WHERE item IN (SELECT qualified_name FROM units_now WHERE kind = 'method' AND starts_with(lower(path), 'src/'))''')} SELECT query_id, item AS qualified_name, score, rank::INTEGER AS rank FROM lexical",
    "all_token_statistics": f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM ({_DOCUMENT_TOKENS}) GROUP BY token",
    "token_statistics": f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM ({_DOCUMENT_TOKENS}) GROUP BY token ORDER BY cf DESC, token LIMIT 50",
    "path_prefix_counts": f"WITH {_UNITS} SELECT kind, 'strict' AS rule, count(*) AS n_units FROM units_now WHERE starts_with(path, 'src/') GROUP BY ALL UNION ALL SELECT kind, 'loose', count(*) FROM units_now WHERE starts_with(lower(path), 'src/') GROUP BY ALL",
    "dense_search": _DENSE.format(on="true"),
    "dense_filtered": _DENSE.format(on="q.label = v.label"),
    "vector_norms": "SELECT vec_id, len(embedding)::INTEGER AS dimension, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 5) AS norm, coalesce(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]) > 0, false) AS usable FROM embeddings",
    "unit_fingerprints": f"WITH {_UNITS} SELECT qualified_name, {_FINGERPRINT} AS fingerprint FROM units_now",
    "corpus_fingerprint": f"WITH {_UNITS}, f AS (SELECT sha256(strlen(qualified_name) || ':' || qualified_name || ':' || {_FINGERPRINT}) AS h FROM units_now) SELECT count(*) AS n_units, sha256("
    + " || ',' || ".join(f"coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT), 0)::HUGEINT::VARCHAR" for i in range(8))
    + ") AS fingerprint FROM f",
    "vector_reuse": f"WITH {_UNITS}, fresh AS (SELECT qualified_name, {_FINGERPRINT} AS fingerprint FROM units_now), held AS (SELECT {_trim('qualified_name')} AS qualified_name, list(lower(doc_fingerprint)) AS held FROM reuse_vectors GROUP BY 1) "
    "SELECT coalesce(f.qualified_name, h.qualified_name) AS qualified_name, CASE WHEN f.qualified_name IS NULL THEN 'drop' WHEN list_contains(held, fingerprint) THEN 'reuse' ELSE 'embed' END AS action "
    "FROM fresh f FULL JOIN (SELECT * FROM held WHERE qualified_name IS NOT NULL) h ON f.qualified_name = h.qualified_name",
    "rrf_fusion": "WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY q DESC, o_orderkey) AS b "
    "FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey), s AS (SELECT query_id, item, round(1e0 / (60 + a) + 1e0 / (60 + b), 9) AS score FROM r) "
    "SELECT query_id, item, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 3",
    "hybrid_search": f"WITH {_hybrid(10)} SELECT query_id, item, score, rank::INTEGER AS rank FROM hybrid",
    "hybrid_filtered": f"WITH {_hybrid(10, 'function')} SELECT query_id, item, score, rank::INTEGER AS rank FROM hybrid",
    "graph_search": f"WITH {_graph(10)} SELECT query_id, item, score, rank::INTEGER AS rank FROM graph",
    "graph_filtered": f"WITH {_graph(10, 'method')} SELECT query_id, item, score, rank::INTEGER AS rank FROM graph",
    "graph_support": f"WITH {_graph(10)} SELECT query_id, item, support, rank::INTEGER AS rank FROM support",
    "relation_evidence": f"WITH {_graph(10)} SELECT query_id, seed, seed_rank::INTEGER AS seed_rank, item, kind, direction FROM evidence",
    "channel_rankings": f"WITH {_reranked(10)} SELECT query_id, kind, item, support, rank::INTEGER AS rank FROM channels",
    "reranked_search": f"WITH {_reranked(10)} SELECT query_id, item, score, original_rank::INTEGER AS original_rank, rank::INTEGER AS rank, rank_delta::INTEGER AS rank_delta FROM reranked",
    "rerank_contributions": f"WITH {_reranked(10)} SELECT c.query_id, c.item, source, list_rank::INTEGER AS list_rank, round(1e0 / (60 + list_rank), 9) AS part FROM contributions c SEMI JOIN reranked USING (query_id, item)",
    "context_pack": rf"""
WITH RECURSIVE {_reranked(20)}, candidates AS (
  SELECT query_id, item, rank, path, start_byte, end_byte, len(regexp_extract_all('=== CODE UNIT ===' || chr(10) || 'symbol: ' || item || chr(10) || 'kind: ' || coalesce(kind, '') || chr(10) || 'location: ' || coalesce(u.path, '')
    || ':L' || coalesce(start_line::VARCHAR, '') || '-' || coalesce(end_line::VARCHAR, '') || chr(10) || 'code:' || chr(10) || source_text || chr(10) || '=== END CODE UNIT ===' || chr(10), '{_CODE_TOKEN}')) AS tokens
  FROM reranked JOIN units_now u ON u.qualified_name = item
), packed AS (
  SELECT query_id, 0::BIGINT AS rank, NULL::VARCHAR AS item, 0::BIGINT AS tokens, 'none' AS decision, 0::BIGINT AS used, []::STRUCT(p VARCHAR, s INTEGER, e INTEGER)[] AS spans
  FROM (SELECT DISTINCT query_id FROM candidates)
  UNION ALL
  SELECT query_id, rank, item, tokens, decision, used + CASE WHEN decision = 'selected' THEN tokens ELSE 0 END,
    CASE WHEN decision = 'selected' THEN list_append(spans, {{'p': path, 's': start_byte, 'e': end_byte}}) ELSE spans END
  FROM (
    SELECT c.*, p.used, p.spans, CASE WHEN len([x FOR x IN p.spans IF x.p = c.path AND x.s < c.end_byte AND c.start_byte < x.e]) > 0 THEN 'overlap' WHEN c.tokens > 2048 THEN 'oversized'
      WHEN p.used + c.tokens > 2048 THEN 'budget' ELSE 'selected' END AS decision
    FROM packed p JOIN candidates c ON c.query_id = p.query_id AND c.rank = p.rank + 1)
)
SELECT query_id, item, rank::INTEGER AS rank, tokens::INTEGER AS tokens, decision, used::INTEGER AS used FROM packed WHERE rank > 0
""",
    "span_overlap_pairs": f"WITH {_UNITS} SELECT x.qualified_name AS a, y.qualified_name AS b FROM units_now x JOIN units_now y ON x.path = y.path AND x.qualified_name < y.qualified_name AND x.start_byte < y.end_byte AND y.start_byte < x.end_byte",
    "unit_token_counts": f"WITH {_UNITS} SELECT qualified_name, len(regexp_extract_all(source_text, '{_CODE_TOKEN}'))::INTEGER AS tokens FROM units_now",
    "unit_previews": rf"WITH {_UNITS}, l AS (SELECT qualified_name, trim(regexp_replace(string_split(source_text, chr(10))[1], '\s+', ' ', 'g')) AS line FROM units_now) SELECT qualified_name, CASE WHEN length(line) > 120 THEN substr(line, 1, 117) || '...' ELSE line END AS preview FROM l",
    "graph_summary": f"WITH {_EDGES} SELECT k AS kind, s AS resolution, count(relation_id) AS n_edges FROM (VALUES ('contains'), ('imports'), ('references'), ('calls'), ('inherits')) kk(k) CROSS JOIN (VALUES ('resolved'), ('probable'), ('unresolved')) ss(s) LEFT JOIN edges_now ON kind = k AND resolution = s GROUP BY ALL",
    "graph_degrees": f"WITH {_SYMBOLS}, {_EDGES}, {_FOLLOWED} SELECT qualified_name AS name, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM symbols_now LEFT JOIN (SELECT source, count(*) AS n_out FROM edges_now GROUP BY 1) ON source = qualified_name LEFT JOIN (SELECT target, count(*) AS n_in FROM followed GROUP BY 1) ON target = qualified_name",
    "graph_neighbours": f"WITH {_SYMBOLS}, {_EDGES}, {_FOLLOWED} SELECT source AS name, target AS neighbour FROM followed UNION SELECT target, source FROM followed",
    "graph_reach": _reach("outgoing", 3) + "SELECT seed, name, distance::INTEGER AS distance FROM nearest",
    "graph_related": f"""WITH {_SYMBOLS}, {_EDGES}, {_VECTORS}, golds AS (SELECT DISTINCT gold FROM search_queries)
SELECT 'outgoing' AS direction, relation_id, kind, source, coalesce(target, target_text) AS target, resolution FROM edges_now WHERE source IN (SELECT gold FROM golds) AND kind IN ('calls', 'inherits')
UNION ALL SELECT 'incoming', relation_id, kind, source, target, resolution FROM edges_now WHERE target IN (SELECT gold FROM golds) AND resolution = 'resolved'""",
    "graph_shortest_distance": rf"""
WITH RECURSIVE {_SYMBOLS}, {_EDGES}, {_FOLLOWED}, {_VECTORS}, hops AS (SELECT DISTINCT source AS a, target AS b FROM followed
), pairs AS (
  SELECT DISTINCT p.parent AS source, s.qualified_name AS target FROM search_queries JOIN symbols_now s ON s.qualified_name = gold JOIN symbols_now p ON p.qualified_name = s.parent
  WHERE p.parent IN (SELECT qualified_name FROM symbols_now)
), reach AS (
  SELECT DISTINCT source AS seed, source AS name, 0 AS distance FROM pairs
  UNION SELECT seed, b, distance + 1 FROM reach JOIN hops ON a = name WHERE distance < 4
)
SELECT source, target, (SELECT min(distance) FROM reach WHERE seed = source AND name = target)::INTEGER AS distance FROM pairs
""",
    "graph_distance_to_module": _reach("incoming", 6) + "SELECT seed, min(distance)::INTEGER AS distance FROM nearest WHERE name IN (SELECT qualified_name FROM symbols_now WHERE kind = 'module') GROUP BY seed",
    "graph_canonical_edges": f"WITH {_EDGES}, e AS (SELECT DISTINCT kind, source, target, target_text, resolution, path, start_byte, end_byte FROM edges_now WHERE source IS NOT NULL) SELECT source, kind, target, target_text, resolution, row_number() OVER (PARTITION BY source ORDER BY kind, target_text NULLS FIRST, coalesce(target, ''), path NULLS FIRST, coalesce(start_byte, -1), coalesce(end_byte, -1), resolution NULLS FIRST)::INTEGER AS position FROM e",
    "graph_dangling": f"WITH {_SYMBOLS}, {_EDGES} SELECT target, count(*) AS n_edges FROM edges_now WHERE resolution IN ('resolved', 'probable') AND target IS NOT NULL AND target NOT IN (SELECT qualified_name FROM symbols_now) GROUP BY target",
    "contains_edges": f"WITH {_SYMBOLS} SELECT parent AS source, qualified_name AS target, path FROM symbols_now WHERE parent IS NOT NULL",
    "duplicate_symbols": f"SELECT {_trim('qualified_name')} AS qualified_name, count(DISTINCT concat_ws(':', {_trim('path')}, start_line)) AS n_paths FROM symbols WHERE {_trim('qualified_name')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT concat_ws(':', {_trim('path')}, start_line)) > 1",
    "resolve_facts": f"WITH {_SYMBOLS}, {_EDGES} SELECT relation_id AS fact_id, coalesce(d.qualified_name, m.qualified_name) AS target, CASE WHEN d.qualified_name IS NOT NULL THEN 'resolved' WHEN m.qualified_name IS NOT NULL THEN 'probable' ELSE 'unresolved' END AS resolution "
    "FROM edges_now e LEFT JOIN symbols_now s ON s.qualified_name = e.source LEFT JOIN symbols_now d ON d.qualified_name = e.target_text "
    "LEFT JOIN symbols_now m ON m.qualified_name = s.parent || CASE WHEN contains(s.parent, '::') THEN '::' ELSE '.' END || e.target_text",
    "unique_stems": f"WITH {_SYMBOLS} SELECT {_base('qualified_name')} AS stem, count(*) AS n_symbols, CASE WHEN count(*) = 1 THEN min(qualified_name) END AS qualified_name FROM symbols_now WHERE kind IN ('function', 'method') GROUP BY 1",
    "scope_walk": rf"""
WITH {_SYMBOLS}, {_EDGES}, facts AS (
  SELECT relation_id, target_text, CASE WHEN contains(source, '::') THEN '::' ELSE '.' END AS sep, string_split(regexp_replace(source, '\(.*$', ''), CASE WHEN contains(source, '::') THEN '::' ELSE '.' END) AS parts
  FROM edges_now WHERE kind <> 'contains' AND source IS NOT NULL AND target_text IS NOT NULL
), levels AS (
  SELECT relation_id, depth, CASE WHEN len(parts) - depth - 1 = 0 THEN target_text WHEN sep = '.' THEN array_to_string(parts[1 : len(parts) - depth - 1], '.') || '.' || target_text
    ELSE array_to_string(parts[1 : len(parts) - depth - 1], '::') || '::' || target_text END AS candidate
  FROM (SELECT *, unnest(range(0, len(parts))) AS depth FROM facts)
), matched AS (
  SELECT relation_id, depth, count(*) AS n_matches, min(s.qualified_name) AS least FROM levels JOIN symbols_now s ON regexp_replace(s.qualified_name, '\(.*$', '') = candidate GROUP BY ALL
)
SELECT relation_id AS fact_id, depth::INTEGER AS depth, n_matches, CASE WHEN n_matches = 1 THEN least END AS target FROM matched QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY depth) = 1
""",
    "returnable_units": f"WITH {_UNITS} SELECT qualified_name, name, kind, path, signature, sha256(source_text) AS source_sha256, start_line, end_line FROM units_now",
    "per_file_view": f"WITH {_UNITS} SELECT path, n_symbols, names_digest, coalesce(n_units, 0) AS n_units FROM (SELECT path, count(*) AS n_symbols, sum(('0x' || substr(sha256(qualified_name), 1, 13))::BIGINT)::HUGEINT::VARCHAR AS names_digest FROM symbols_now GROUP BY path) LEFT JOIN (SELECT path, count(*) AS n_units FROM units_now GROUP BY path) USING (path)",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("files", "file_contents", "symbols", "code_units", "relations")),
    "change_set": f"WITH {_CHANGES} SELECT repo, path, change FROM changes",
    "work_counts": f"WITH {_CHANGES} SELECT repo, count(*) FILTER (WHERE change IN ('added', 'changed')) AS n_analysed, count(*) FILTER (WHERE change = 'added') AS n_added, count(*) FILTER (WHERE change = 'changed') AS n_changed, count(*) FILTER (WHERE change = 'deleted') AS n_deleted, count(*) FILTER (WHERE change = 'unchanged') AS n_unchanged FROM changes GROUP BY repo",
    "incremental_merge": f"WITH {_listing('old_files', 1)}, {_listing('new_files', 0)} SELECT repo, path, digest FROM new_files",
    "surface_changes": f"WITH {_surface('old_surface', '''WHERE loaded_at < TIMESTAMP '2024-10-01' ''')}, {_surface('new_surface', '')} SELECT *, 'old' AS side FROM (SELECT * FROM old_surface EXCEPT ALL SELECT * FROM new_surface) UNION ALL SELECT *, 'new' FROM (SELECT * FROM new_surface EXCEPT ALL SELECT * FROM old_surface)",
    "language_mix": f"WITH {_listing('new_files', 0)} SELECT repo, count(DISTINCT language_id) AS n_languages, count(*) AS n_files, count(DISTINCT language_id) > 1 AS mixed FROM new_files GROUP BY repo",
    "first_relevant_ranks": _RANKS + "SELECT query_id, category, mode, rank::DOUBLE AS rank FROM ranks",
    "ranking_metrics": _RANKS
    + "SELECT category, mode, count(*) AS n_queries, "
    + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1e0 ELSE 0e0 END), 6) AS hit_{k}" for k in (1, 5, 10))
    + ", round(avg(coalesce(1e0 / rank, 0)), 6) AS mrr_10 FROM (SELECT 'all' AS category, mode, rank FROM ranks UNION ALL SELECT coalesce(category, 'none'), mode, rank FROM ranks) GROUP BY ALL",
    "ranking_pairs": _RANKS
    + "SELECT a.mode AS mode_a, b.mode AS mode_b, count(*) FILTER (WHERE coalesce(a.rank, 99) < coalesce(b.rank, 99)) AS wins, count(*) FILTER (WHERE coalesce(a.rank, 99) = coalesce(b.rank, 99)) AS ties, count(*) FILTER (WHERE coalesce(a.rank, 99) > coalesce(b.rank, 99)) AS losses "
    "FROM ranks a JOIN ranks b USING (query_id) WHERE (a.mode, b.mode) IN (('graph', 'hybrid'), ('reranked', 'graph')) GROUP BY ALL",
    "gold_missing": f"WITH {_UNITS}, {_VECTORS} SELECT query_id, gold AS item FROM search_queries WHERE gold NOT IN (SELECT qualified_name FROM units_now)",
}
