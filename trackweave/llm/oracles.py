"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

MIXING = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, {_SIZE}::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 13))::BIGINT AS h FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
), weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM sources
), levels(round, level) AS (
  SELECT 0, sum(source_size)::DOUBLE / sum(weight) FROM weighted
  UNION ALL
  SELECT round + 1, raised FROM (
    SELECT l.round, l.level, (SELECT (sum(source_size) - sum(CASE WHEN weight * l.level > source_size * 3 THEN source_size * 3 ELSE 0 END))::DOUBLE
      / sum(CASE WHEN weight * l.level > source_size * 3 THEN 0 ELSE weight END) FROM weighted) AS raised FROM levels l)
  WHERE raised > level
), plan AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM levels), (source_size * 3)::DOUBLE) AS target FROM weighted
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INTEGER ELSE 0 END AS whole FROM plan
), sums AS (
  SELECT source, h, sum(size) AS size, count(*) AS n FROM base GROUP BY source, h
), run AS (
  SELECT source, h, size, n, sum(size) OVER (PARTITION BY source ORDER BY h) AS after FROM sums
), cuts AS (
  SELECT b.source, min(h) AS cut, arg_min(ceil((rest - (after - size)) * n / size - 0.5), h) AS m
  FROM (SELECT *, target - whole * source_size AS rest FROM budgets) b JOIN run r ON r.source IS NOT DISTINCT FROM b.source
  WHERE rest > 0 AND after - size <= rest AND after > rest GROUP BY b.source
)
SELECT doc_id, d.size, source_size, target, (d.size * (whole + CASE WHEN h < cut OR h = cut AND place <= m THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY source, h) AS place FROM base) d JOIN budgets b ON b.source IS NOT DISTINCT FROM d.source LEFT JOIN cuts c ON c.source IS NOT DISTINCT FROM d.source
"""

LINE_DEDUP = r"""
WITH cut AS (
  SELECT doc_id, text, string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(30)), chr(30)) AS us FROM documents
), units AS (
  SELECT doc_id, unnest(us) AS u, unnest(range(len(us))) AS pos FROM cut
), full_units AS (
  SELECT doc_id, pos, line, words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
  FROM (SELECT doc_id, pos, regexp_replace(u, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, len(regexp_extract_all(u, '[^\x20\x09-\x0D]+')) AS words FROM units) WHERE words > 0
), onward AS (
  SELECT a.doc_id, a.k AS first_k, min(b.k) AS last_k FROM full_units a JOIN full_units b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.k < a.k + 50
    AND b.upto - a.upto + a.words >= 50 GROUP BY a.doc_id, a.k
), backward AS (
  SELECT b.doc_id, max(a.k) AS first_k, b.k AS last_k FROM full_units a JOIN full_units b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.k < a.k + 50
    AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.k
), spans AS (
  SELECT * FROM onward UNION SELECT * FROM backward
), keyed AS (
  SELECT s.doc_id, first_k, min(l.pos) AS first_at, max(l.pos) AS last_at, string_agg(line, chr(10) ORDER BY l.k) AS body
  FROM spans s JOIN full_units l ON l.doc_id = s.doc_id AND l.k BETWEEN first_k AND last_k GROUP BY s.doc_id, first_k, last_k
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY body ORDER BY doc_id, first_at) AS r FROM keyed
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM ranked r JOIN units l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.first_at AND r.last_at WHERE r.r > 1
), rest AS (
  SELECT u.doc_id, count(g.pos) AS n_removed, string_agg(u.u, '' ORDER BY u.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM units u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.pos = u.pos GROUP BY u.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR r.n_removed = 0 THEN d.text ELSE coalesce(regexp_replace(r.text, '[\x20\x09-\x0D]+$', ''), '') END AS text, r.n_removed::INTEGER AS n_removed
FROM documents d JOIN rest r ON r.doc_id = d.doc_id
"""

TOP_K = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _secrets() -> str:
    from trackweave.llm import secrets as own

    # The contract's patterns in RE2's syntax, written here anew so that a wrong one in the operator shows.
    keys = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
    patterns = (f"""'({keys})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'""", "'AKIA[A-Z0-9]{14,}'", "'[0-9a-f]{16,}'", "'[A-Za-z0-9+/_-]{20,}'")
    least = "(kind = 0 AND length(value) >= 12 OR kind = 1 AND length(value) >= 18 OR kind = 2 AND length(value) >= 16 OR kind = 3 AND regexp_matches(value, '[0-9]'))"
    found = " UNION ALL ".join(
        f"SELECT doc_id, owner, repo, {k} AS kind, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {2 if k == 0 else 0}) AS v, regexp_split_to_array(text, {p}) AS g FROM texts" for k, p in enumerate(patterns)
    )
    listed = "string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents
), found AS ({found}
), numbered AS (
  SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found
), placed AS (
  SELECT doc_id, owner, repo, kind, v[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS len FROM numbered
), spans AS (
  SELECT *, start + len AS stop FROM placed
  WHERE {least}
), clear AS (
  SELECT * FROM spans WHERE kind < 3 UNION ALL
  SELECT s.* FROM spans s WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.kind < 3 AND b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop)
), held AS (
  SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repo)) AS n_repos FROM clear GROUP BY value
), judged AS (
  SELECT c.*, n_owners = 1 AND n_repos < {own.EXAMPLE_REPOS} AND regexp_matches(c.value, '[0-9]') AND regexp_matches(c.value, '[A-Za-z]') AND len(list_distinct(string_split(c.value, ''))) >= {own.LIVE_CHARACTERS} AS live, n_owners >= {own.EXAMPLE_OWNERS} OR n_repos >= {own.EXAMPLE_REPOS} AS example
  FROM clear c JOIN held h ON h.value = c.value
), summed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    {listed} FILTER (WHERE kind < 3) AS base, {listed} FILTER (WHERE kind < 3 OR live) AS spans,
    count(*) FILTER (WHERE kind = 3 AND live) AS n_owned, count(*) FILTER (WHERE kind < 3 AND live) AS n_live, count(*) FILTER (WHERE kind < 3 AND example) AS n_example
  FROM judged GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM texts t LEFT JOIN summed s ON s.doc_id = t.doc_id
"""


ORACLES = {"op4_mtree_top_k": TOP_K, "op5_secret_scan": _secrets(), "op7_line_dedup": LINE_DEDUP, "op8_mixing": MIXING}
