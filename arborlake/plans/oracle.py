"""Pieces of SQL that the registered queries are held against, written for DuckDB."""

from __future__ import annotations


def tree(leaves: str, folders: str = "SELECT '/' AS full_path", tag: str = "") -> str:
    """CTEs that end in nodes: the roll-up of leaves (full_path, size_bytes, modified_utc) by unnested folders."""
    t = tag
    return f"""
leaves{t} AS ({leaves}), folders{t} AS ({folders}),
up{t} AS (SELECT CASE WHEN k = 1 THEN '/' ELSE array_to_string(p[1:k], '/') END AS full_path, size_bytes, n
  FROM (SELECT string_split(full_path, '/') AS p, unnest(range(1, len(string_split(full_path, '/')))) AS k, size_bytes, 1 AS n FROM leaves{t}
        UNION ALL SELECT string_split(full_path, '/') AS p, unnest(range(1, len(string_split(full_path, '/')))) AS k, 0, 0 FROM folders{t} WHERE full_path <> '/')
  UNION ALL SELECT full_path, 0, 0 FROM folders{t} WHERE full_path <> '/'),
dirs{t} AS (SELECT full_path, sum(size_bytes)::BIGINT AS size_bytes, sum(n)::BIGINT AS file_count FROM up{t} GROUP BY full_path),
rows{t} AS (SELECT full_path, size_bytes::BIGINT AS size_bytes, 1::BIGINT AS file_count, false AS is_directory, modified_utc FROM leaves{t}
  UNION ALL SELECT full_path, size_bytes, file_count, true, NULL FROM dirs{t}),
nodes{t} AS (SELECT *, CASE WHEN is_directory THEN NULL ELSE regexp_extract(name, '(\\.[^.]+)$', 1) END AS extension,
    CASE WHEN full_path = '/' THEN '' WHEN is_directory THEN chr(2) || replace(substr(full_path, 2), '/', chr(2))
      WHEN parent_path = '/' THEN chr(1) || name ELSE chr(2) || replace(substr(parent_path, 2), '/', chr(2)) || chr(1) || name END AS traversal_ord
  FROM (SELECT *, CASE WHEN full_path = '/' THEN '/' ELSE regexp_extract(full_path, '([^/]*)$', 1) END AS name,
    CASE WHEN full_path = '/' THEN NULL WHEN regexp_extract(full_path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(full_path, '^(.*)/[^/]*$', 1) END AS parent_path,
    CASE WHEN full_path = '/' THEN 0 ELSE len(string_split(full_path, '/')) - 1 END::INTEGER AS depth FROM rows{t}))"""


ORDERS = tree(
    "SELECT '/' || r_name || '/' || n_name || '/' || c_name || '/' || o_orderkey AS full_path, round(o_totalprice * 100)::BIGINT AS size_bytes, o_orderdate AS modified_utc "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "SELECT '/' || r_name || '/' || n_name || '/' || c_name AS full_path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)

DOC_FILES = (
    "SELECT doc_id, '/' || lang || '/' || source || '/' || doc_id || '.txt' AS full_path, octet_length(encode(text))::BIGINT AS size_bytes, "
    "make_timestamp((1704067200 + (doc_id * 7919 % 1000) * 3600) * 1000000) AS modified_utc, text FROM documents"
)
DOCS = tree(f"SELECT full_path, size_bytes, modified_utc FROM ({DOC_FILES})")

BEFORE = tree(f"SELECT full_path, size_bytes, modified_utc FROM ({DOC_FILES})", tag="_a")
AFTER = tree(
    f"""SELECT CASE WHEN doc_id % 11 = 3 THEN '/archive/' || string_split(full_path, '/')[3] || '/' || doc_id || '.txt'
        WHEN doc_id % 13 = 5 THEN '/' || string_split(full_path, '/')[2] || '/' || string_split(full_path, '/')[3] || '/renamed_' || doc_id || '.txt' ELSE full_path END AS full_path,
      size_bytes + CASE WHEN doc_id % 19 = 2 THEN 10 ELSE 0 END AS size_bytes, modified_utc FROM ({DOC_FILES}) WHERE doc_id % 17 <> 7
    UNION ALL SELECT '/new/extra_' || doc_id || '.txt', doc_id + 1, modified_utc FROM ({DOC_FILES}) WHERE doc_id % 23 = 1""",
    tag="_b",
)

PAGES = tree(
    "SELECT '/' || regexp_replace(regexp_replace(url, '^[^:]*://|[?#].*$', '', 'g'), '/+$', '') || '/page-' || page_id || '.html' AS full_path, "
    "octet_length(encode(html))::BIGINT AS size_bytes, NULL::TIMESTAMP AS modified_utc FROM pages"
)

CONVERSATIONS = tree(
    """SELECT '/' || coalesce(conv_id::VARCHAR, '-') || '/turn \\' || coalesce(turn::VARCHAR, '-') || ' "' || coalesce(role, '-') || '" {"Name":{}.txt' AS full_path,
      sum(coalesce(octet_length(encode(text)), 0))::BIGINT AS size_bytes, max(make_timestamp((1704067200 + turn * 60) * 1000000)) AS modified_utc FROM conversations GROUP BY 1"""
)


def events(cut: str, where: str, tag: str, kind: str = "event_type") -> str:
    return tree(
        f"SELECT '/user_' || user_id || '/' || {kind} AS full_path, count(*) AS size_bytes, max(ts) AS modified_utc FROM events WHERE ts < TIMESTAMP '{cut}' AND {where} GROUP BY 1", tag=tag
    )


def diff(a: str = "_a", b: str = "_b") -> str:
    """CTE changes: paths added, removed or of another size."""
    key = lambda t: f"SELECT lower(full_path) AS key, arg_min(full_path, traversal_ord) AS full_path, arg_max(name, traversal_ord) AS name, arg_max(is_directory, traversal_ord) AS is_directory, arg_max(size_bytes, traversal_ord) AS size_bytes, arg_max(coalesce(extension, ''), traversal_ord) AS extension, max(traversal_ord) AS traversal_ord FROM nodes{t} WHERE depth > 0 GROUP BY 1"
    return f"""
old AS ({key(a)}), new AS ({key(b)}),
changes AS (SELECT CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS kind,
    coalesce(n.full_path, o.full_path) AS full_path, coalesce(n.name, o.name) AS name, coalesce(n.is_directory, o.is_directory) AS is_directory,
    coalesce(n.extension, o.extension) AS extension, coalesce(n.traversal_ord, o.traversal_ord) AS traversal_ord,
    coalesce(o.size_bytes, 0) AS old_bytes, coalesce(n.size_bytes, 0) AS new_bytes, coalesce(n.size_bytes, 0) - coalesce(o.size_bytes, 0) AS delta_bytes
  FROM old o FULL OUTER JOIN new n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.size_bytes <> n.size_bytes)"""


#: CTEs moved (the pairs of both tiers) and rest (what they leave), after changes.
MOVES = """
sized AS (SELECT *, greatest(old_bytes, new_bytes) AS size FROM changes),
r1 AS (SELECT *, row_number() OVER (PARTITION BY name, size, is_directory ORDER BY traversal_ord) AS nth FROM sized WHERE kind = 'removed'),
a1 AS (SELECT *, row_number() OVER (PARTITION BY name, size, is_directory ORDER BY traversal_ord) AS nth FROM sized WHERE kind = 'added'),
t1 AS (SELECT r1.full_path AS old_path, a1.full_path AS new_path, r1.name AS old_name, a1.name AS new_name, r1.is_directory, r1.size AS size_bytes, 1 AS tier
  FROM r1 JOIN a1 USING (name, size, is_directory, nth)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY extension, size ORDER BY traversal_ord) AS nth FROM sized WHERE kind = 'removed' AND NOT is_directory AND size > 0 AND full_path NOT IN (SELECT old_path FROM t1)),
a2 AS (SELECT *, row_number() OVER (PARTITION BY extension, size ORDER BY traversal_ord) AS nth FROM sized WHERE kind = 'added' AND NOT is_directory AND size > 0 AND full_path NOT IN (SELECT new_path FROM t1)),
t2 AS (SELECT r2.full_path AS old_path, a2.full_path AS new_path, r2.name AS old_name, a2.name AS new_name, r2.is_directory, r2.size AS size_bytes, 2 AS tier
  FROM r2 JOIN a2 USING (extension, size, nth)),
moved AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2),
rest AS (SELECT * FROM changes WHERE NOT (kind = 'removed' AND full_path IN (SELECT old_path FROM moved)) AND NOT (kind = 'added' AND full_path IN (SELECT new_path FROM moved)))"""


def size_text(e: str) -> str:
    """The size as text, from whole numbers."""
    n = f"abs(({e})::HUGEINT)"
    cases = []
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB", "PB"]))):
        u = f"{1024**k}::HUGEINT"
        if k == 0:
            cases.append(f"ELSE {n}::VARCHAR || ' B'")
            continue
        h = f"(({n} * 200 + {u}) // (2 * {u}))"
        cases.append(
            f"WHEN {n} >= {u} THEN ({h} // 100)::VARCHAR || CASE WHEN {h} % 100 = 0 THEN '' WHEN {h} % 10 = 0 THEN '.' || (({h} % 100) // 10)::VARCHAR ELSE '.' || lpad(({h} % 100)::VARCHAR, 2, '0') END || ' {unit}'"
        )
    return f"(CASE WHEN ({e}) < 0 THEN '-' ELSE '' END || CASE {' '.join(cases)} END)"


def signed_text(e: str) -> str:
    return f"(CASE WHEN ({e}) < 0 THEN '' ELSE '+' END || {size_text(e)})"


def points(part: str, total: str) -> str:
    """Basis points."""
    return f"(CASE WHEN ({total}) > 0 THEN ((({part})::HUGEINT * 20000 + ({total})) // (2 * ({total})::HUGEINT))::BIGINT ELSE 0 END)"


def thousandths(value: str) -> str:
    """Thousandths, rounded half up."""
    return f"floor(({value}) * 1000 + 0.5)::BIGINT"
