"""The registered queries of the library, and the SQL that each is held against."""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dhash, fmt, versions
from ..operators import duplicates as dup
from ..operators import overview, rename, rollup, search, similar, snapshot, treemap
from ..operators.search import SearchCriteria
from ..sinks import export, snapshots
from ..sources import adapters, fsnodes
from ..sources.adapters import EVENT_CUTS, conversations_tree, deep_files, documents_files, documents_tree, events_tree, moved_documents, orders_tree, pages_tree
from . import oracle as Q
from .numbering import number_rows, rank_within
from .scratch import Scratch, delete_folder, local_shared_dir, shared_dir

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries():
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# roll-up and overview

_NODE = "full_path, parent_path, name, is_directory, depth, size_bytes, file_count"


def _node_columns(nodes: DataFrame) -> DataFrame:
    return nodes.select(*_NODE.split(", "))


@_register("tree_rollup", f"WITH {Q.ORDERS} SELECT {_NODE} FROM nodes")
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _node_columns(orders_tree(spark, d))


@_register("tree_rollup_variable_depth", f"WITH {Q.PAGES} SELECT {_NODE}, extension FROM nodes")
def tree_rollup_variable_depth(spark, d):
    return pages_tree(spark, d).select(*_NODE.split(", "), "extension")


@_register(
    "scan_totals",
    f"""WITH {Q.ORDERS}, t AS (SELECT count(*) FILTER (NOT is_directory) AS files, count(*) FILTER (is_directory) AS folders,
      sum(size_bytes) FILTER (NOT is_directory)::BIGINT AS total_bytes, 0::BIGINT AS unreadable FROM nodes)
    SELECT *, files || ' files, ' || {Q.size_text("total_bytes")} || ' total' AS line FROM t""",
)
def scan_totals(spark, d):
    return rollup.scan_totals(orders_tree(spark, d)).withColumn("line", fmt.totals_line(F.col("files"), F.col("total_bytes")))


@_register(
    "percent_of_root",
    f"""WITH {Q.ORDERS}, r AS (SELECT size_bytes AS root FROM nodes WHERE depth = 0)
    SELECT full_path, {Q.points("size_bytes", "root")} AS share_bp, (least({Q.points("size_bytes", "root")}, 10000) * 60 // 100)::BIGINT AS bar_width FROM nodes, r""",
)
def percent_of_root(spark, d):
    nodes = orders_tree(spark, d)
    share = fmt.basis_points(F.col("size_bytes"), F.col("root_bytes"))
    return rollup.with_root_total(nodes).select("full_path", share.alias("share_bp"), fmt.bar_width(share).alias("bar_width"))


@_register("format_sizes", f"WITH {Q.ORDERS} SELECT full_path, {Q.size_text('size_bytes * 977')} AS size_text, {Q.signed_text('50000000 - size_bytes')} AS change_text FROM nodes")
def format_sizes(spark, d):
    return orders_tree(spark, d).select("full_path", fmt.format_bytes(F.col("size_bytes") * 977).alias("size_text"), fmt.signed_bytes(50000000 - F.col("size_bytes")).alias("change_text"))


@_register(
    "biggest_children",
    f"""WITH {Q.ORDERS}, r AS (SELECT size_bytes AS root FROM nodes WHERE depth = 0)
    SELECT full_path, name, size_bytes, {Q.size_text("size_bytes")} AS size_text, {Q.points("size_bytes", "root")} AS share_bp, file_count,
      CASE WHEN is_directory THEN 'Folder' ELSE 'File' END AS kind FROM nodes, r WHERE parent_path = '/' ORDER BY size_bytes DESC, traversal_ord LIMIT 6""",
)
def biggest_children(spark, d):
    return overview.biggest_children(orders_tree(spark, d))


@_register("children_of_parent", f"WITH {Q.ORDERS} SELECT full_path, size_bytes, file_count, row_number() OVER (ORDER BY size_bytes DESC, traversal_ord)::INTEGER AS rank FROM nodes WHERE parent_path = '/EUROPE'")
def children_of_parent(spark, d):
    rank = F.row_number().over(W.partitionBy("parent_path").orderBy(*rollup.by_size()))
    return rollup.children(orders_tree(spark, d), "/EUROPE").select("full_path", "size_bytes", "file_count", rank.alias("rank"))


@_register(
    "treemap_candidates",
    f"""WITH {Q.ORDERS}, k AS (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY size_bytes DESC, traversal_ord)::INTEGER AS rank FROM nodes WHERE parent_path IS NOT NULL AND size_bytes > 0)
    SELECT parent_path, full_path, size_bytes, rank FROM k WHERE rank <= 60""",
)
def treemap_candidates(spark, d):
    return treemap.candidates(orders_tree(spark, d)).select("parent_path", "full_path", "size_bytes", "rank")


@_register(
    "treemap_layout",
    f"""WITH RECURSIVE {Q.ORDERS}, k AS (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY size_bytes DESC, traversal_ord)::INTEGER AS rank FROM nodes WHERE parent_path IS NOT NULL AND size_bytes > 0),
    c AS (SELECT parent_path AS p, list(size_bytes::DOUBLE ORDER BY rank) AS v, list_reduce(list(size_bytes::DOUBLE ORDER BY rank), lambda s, z: s + z) AS total FROM k WHERE rank <= 60 GROUP BY 1),
    r(p, v, i, j, held, worst, x, y, w, h, thick, upright, rx, ry, done) AS (
      SELECT p, list_transform(v, lambda z: z * 100.0::DOUBLE * 60.0::DOUBLE / total), 1, 1, 0.0::DOUBLE, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE, 60.0::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM c
      UNION ALL SELECT p, v, CASE WHEN grows THEN i ELSE j END, CASE WHEN grows THEN j + 1 ELSE j END, CASE WHEN grows THEN grown ELSE 0.0 END, CASE WHEN grows THEN ratio ELSE 'inf'::DOUBLE END,
        CASE WHEN NOT grows AND w >= h THEN x + held / side ELSE x END, CASE WHEN NOT grows AND w < h THEN y + held / side ELSE y END, CASE WHEN NOT grows AND w >= h THEN w - held / side ELSE w END,
        CASE WHEN NOT grows AND w < h THEN h - held / side ELSE h END, CASE WHEN NOT grows THEN held / side END, w >= h, x, y, CASE WHEN grows THEN 0 ELSE i END
      FROM (SELECT *, j <= len(v) AND ratio <= worst AS grows FROM (SELECT *, least(w, h) AS side, held + v[least(j, len(v))] AS grown,
        greatest(least(w, h) * least(w, h) * v[i] / (held + v[least(j, len(v))]) / (held + v[least(j, len(v))]), (held + v[least(j, len(v))]) * (held + v[least(j, len(v))]) / (least(w, h) * least(w, h) * v[least(j, len(v))])) AS ratio FROM r WHERE i <= len(v)))),
    b AS (SELECT p, done AS i, i - 1 AS e, v, thick, upright, rx, ry FROM r WHERE done > 0),
    o AS (SELECT p, unnest(range(i, e + 1))::INTEGER AS rank, i, v, thick, upright, rx, ry FROM b),
    q AS (SELECT *, v[rank] / thick AS long, coalesce(list_sum(list_transform(v[i:rank - 1], lambda z: z / thick)), 0.0) AS before FROM o)
    SELECT k.parent_path, full_path, k.rank, size_bytes, {Q.thousandths("rx + CASE WHEN upright THEN 0 ELSE before END")} AS x, {Q.thousandths("ry + CASE WHEN upright THEN before ELSE 0 END")} AS y,
      {Q.thousandths("CASE WHEN upright THEN thick ELSE long END")} AS width, {Q.thousandths("CASE WHEN upright THEN long ELSE thick END")} AS height FROM k JOIN q ON k.parent_path = q.p AND k.rank = q.rank WHERE k.rank <= 60""",
)
def treemap_layout(spark, d):
    """Every folder's rectangles on 100 x 60, in thousandths, rounded."""
    boxes = treemap.layout(treemap.candidates(orders_tree(spark, d)))
    return boxes.select("parent_path", "full_path", "rank", "size_bytes", *(F.floor(F.col(c) * 1000 + 0.5).cast("bigint").alias(c) for c in ("x", "y", "width", "height")))


_SOME_ORDER = "(SELECT min(full_path) AS p FROM nodes WHERE NOT is_directory)"


@_register("ancestors_of_file", f"WITH {Q.PAGES}, f AS {_SOME_ORDER} SELECT full_path, depth, size_bytes FROM nodes, f WHERE is_directory AND (full_path = '/' OR starts_with(p, full_path || '/'))")
def ancestors_of_file(spark, d):
    nodes = pages_tree(spark, d)
    path = nodes.where("NOT is_directory").agg(F.min("full_path")).first()[0]
    return rollup.ancestors(nodes, path).select("full_path", "depth", "size_bytes")


# search

_HIT = "full_path, is_directory, size_bytes"


def _search(name: str, tree, sql_tree: str, where: str, criteria: SearchCriteria) -> None:
    @_register(name, f"WITH {sql_tree} SELECT {_HIT} FROM nodes WHERE {where}")
    def run(spark, d):
        return search.search(tree(spark, d), criteria).select(*_HIT.split(", "))


_search("search_wildcard", pages_tree, Q.PAGES, r"regexp_matches(name, '(?i)^page-1.*\.html$')", SearchCriteria("PAGE-1*.html"))
_search("search_regex", documents_tree, Q.DOCS, r"regexp_matches(name, '(?i)^\d*7\.TXT$')", SearchCriteria(r"^\d*7\.TXT$", is_regex=True))
_search("search_size_range", orders_tree, Q.ORDERS, "size_bytes >= 10485760 AND size_bytes <= 31457280", search.criteria_from_text("10", "30"))
_search(
    "search_modified_range", orders_tree, Q.ORDERS, "coalesce(modified_utc, TIMESTAMP '0001-01-01') >= TIMESTAMP '1997-01-01' AND coalesce(modified_utc, TIMESTAMP '0001-01-01') <= TIMESTAMP '1998-06-30'",
    SearchCriteria(modified_after="1997-01-01 00:00:00", modified_before="1998-06-30 00:00:00"),
)
_search("search_extension", documents_tree, Q.DOCS, "is_directory OR lower(extension) IN ('.txt', '.md')", SearchCriteria(extensions=["TXT", " .md", ""]))
_search("search_files_only", orders_tree, Q.ORDERS, "NOT is_directory", SearchCriteria(include_directories=False))
_search("search_dirs_only", orders_tree, Q.ORDERS, "is_directory", SearchCriteria(include_files=False))
_search(
    "search_combined", documents_tree, Q.DOCS, r"NOT is_directory AND regexp_matches(name, '(?i)^.*1.txt$') AND size_bytes >= 500 AND modified_utc >= TIMESTAMP '2024-01-05' AND lower(extension) = '.txt'",
    SearchCriteria("*1?txt", min_size=500, modified_after="2024-01-05 00:00:00", extensions=["txt"], include_directories=False),
)


# duplicates

_DUP = f"""files AS ({Q.DOC_FILES}),
dups AS (SELECT full_path, size_bytes, modified_utc, digest, copies, row_number() OVER (PARTITION BY size_bytes, digest ORDER BY modified_utc, full_path)::INTEGER AS rank FROM
  (SELECT *, sha256(text) AS digest, count(*) OVER (PARTITION BY octet_length(encode(text)), sha256(text)) AS copies FROM files WHERE size_bytes > 0) WHERE copies > 1),
grp AS (SELECT size_bytes, digest, count(*) AS copies, min(full_path) FILTER (rank = 1) AS kept_path, size_bytes * (count(*) - 1) AS wasted_bytes FROM dups GROUP BY size_bytes, digest)"""


@_register("duplicates_by_size", f"WITH files AS ({Q.DOC_FILES}) SELECT full_path, size_bytes FROM files WHERE size_bytes > 0 AND size_bytes IN (SELECT size_bytes FROM files GROUP BY 1 HAVING count(*) > 1)")
def duplicates_by_size(spark, d):
    return dup.size_candidates(documents_files(spark, d)).select("full_path", "size_bytes")


@_register("duplicates_to_hash", f"WITH files AS ({Q.DOC_FILES}) SELECT count(*) AS files FROM files WHERE size_bytes > 0 AND size_bytes IN (SELECT size_bytes FROM files GROUP BY 1 HAVING count(*) > 1)")
def duplicates_to_hash(spark, d):
    return dup.to_hash(documents_files(spark, d))


@_register("duplicates_exact", f"WITH {_DUP} SELECT full_path, size_bytes, digest, copies FROM dups")
def duplicates_exact(spark, d):
    return dup.duplicate_files(documents_files(spark, d)).select("full_path", "size_bytes", "digest", "copies")


@_register("duplicates_keep_plan", f"WITH {_DUP} SELECT full_path, size_bytes, rank, rank > 1 AS selected FROM dups")
def duplicates_keep_plan(spark, d):
    return dup.keep_plan(dup.duplicate_files(documents_files(spark, d))).select("full_path", "size_bytes", "rank", "selected")


@_register("duplicates_waste", f"WITH {_DUP} SELECT size_bytes, digest, copies, kept_path, wasted_bytes, {Q.size_text('wasted_bytes')} AS wasted_text FROM grp")
def duplicates_waste(spark, d):
    return dup.groups(dup.duplicate_files(documents_files(spark, d))).withColumn("wasted_text", fmt.format_bytes(F.col("wasted_bytes")))


@_register(
    "duplicates_guard",
    f"""WITH {_DUP}, g AS (SELECT digest, bool_and(sel) AS whole, count(*) FILTER (sel) AS n, sum(size_bytes) FILTER (sel) AS b
      FROM (SELECT *, rank > 1 OR size_bytes % 5 = 0 AS sel FROM dups) GROUP BY size_bytes, digest)
    SELECT sum(n)::BIGINT AS selected_files, sum(b)::BIGINT AS selected_bytes, bool_or(whole) AS loses_a_group FROM g""",
)
def duplicates_guard(spark, d):
    plan = dup.keep_plan(dup.duplicate_files(documents_files(spark, d)))
    return dup.guard(plan.withColumn("selected", F.col("selected") | (F.col("size_bytes") % 5 == 0)))


@_register(
    "duplicates_after_delete",
    f"""WITH {_DUP}, l AS (SELECT * FROM dups WHERE rank <> 2), n AS (SELECT size_bytes, digest, count(*) AS copies FROM l GROUP BY ALL HAVING count(*) > 1)
    SELECT l.full_path, l.size_bytes, n.copies FROM l JOIN n USING (size_bytes, digest)""",
)
def duplicates_after_delete(spark, d):
    found = dup.duplicate_files(documents_files(spark, d))
    gone = dup.keep_plan(found).where("rank = 2").select(F.upper("full_path").alias("full_path"))
    return dup.after_delete(found, gone).select("full_path", "size_bytes", "copies")


# similar images

_BITS = "string_agg(CASE WHEN (embedding[65 - i] > 0) <> (copy AND ((64 - i) * 7 + vec_id) % 64 < vec_id % 14) THEN '1' ELSE '0' END, '' ORDER BY i)"
_IMAGES = f"""img AS (SELECT '/img/' || CASE WHEN copy THEN 'copy_' ELSE '' END || vec_id || '.png' AS full_path, 1000 + vec_id % 97 AS size_bytes, make_timestamp((1704067200 + vec_id * 37 % 501 * 60) * 1000000) AS modified_utc,
  {_BITS} AS bits FROM (SELECT *, false AS copy FROM embeddings UNION ALL SELECT *, true FROM embeddings WHERE vec_id % 4 = 0), range(1, 65) r(i) GROUP BY ALL)"""
_NEAR = "len(replace(array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN a.bits[i] <> b.bits[i] THEN '1' ELSE '' END), ''), '0', ''))"
_PAIRS = f"""{_IMAGES}, rep AS (SELECT bits, min(full_path) AS full_path FROM img GROUP BY bits), pairs AS (SELECT a.full_path AS a, b.full_path AS b, {_NEAR} AS distance FROM rep a JOIN rep b ON a.full_path < b.full_path)"""
_GROUPS = f"""WITH RECURSIVE {_PAIRS}, near AS (SELECT a, b FROM pairs WHERE distance <= 20 UNION ALL SELECT b, a FROM pairs WHERE distance <= 20
  UNION ALL SELECT rep.full_path, img.full_path FROM rep JOIN img USING (bits) WHERE rep.full_path <> img.full_path UNION ALL SELECT img.full_path, rep.full_path FROM rep JOIN img USING (bits) WHERE rep.full_path <> img.full_path),
reach(n, m) AS (SELECT DISTINCT a, a FROM near UNION SELECT r.n, near.b FROM reach r JOIN near ON r.m = near.a),
named AS (SELECT n AS full_path, min(m) AS group_path FROM reach GROUP BY n),
grp AS (SELECT full_path, size_bytes, group_path, row_number() OVER (PARTITION BY group_path ORDER BY size_bytes DESC, upper(full_path), full_path)::INTEGER AS rank FROM named JOIN img USING (full_path))"""


@_register("similar_pairs", f"WITH {_PAIRS} SELECT a, b, distance::INTEGER AS distance FROM pairs WHERE distance <= 20")
def similar_pairs(spark, d):
    """Pairs between the first images of each hash; similar_members has the others."""
    return similar.image_pairs(adapters.embedding_hashes(spark, d), 20)


@_register("similar_pairs_default", f"WITH {_PAIRS} SELECT a, b, distance::INTEGER AS distance FROM pairs WHERE distance <= 10")
def similar_pairs_default(spark, d):
    return similar.image_pairs(adapters.embedding_hashes(spark, d))


@_register("similar_members", f"WITH {_IMAGES} SELECT full_path, min(full_path) OVER (PARTITION BY bits) AS representative FROM img")
def similar_members(spark, d):
    return similar.representatives(adapters.embedding_hashes(spark, d)).select("full_path", "representative")


def _similar(spark, d):
    return similar.similar_groups(adapters.embedding_hashes(spark, d), 20)


@_register("similar_groups", f"{_GROUPS} SELECT full_path, size_bytes, min(full_path) OVER (PARTITION BY group_path) AS group_path, rank FROM grp")
def similar_groups(spark, d):
    return _similar(spark, d).select("full_path", "size_bytes", F.min("full_path").over(W.partitionBy("group_id")).alias("group_path"), "rank")


@_register("similar_waste", f"{_GROUPS} SELECT min(full_path) FILTER (rank = 1) AS kept_path, count(*) AS members, (sum(size_bytes) - max(size_bytes))::BIGINT AS wasted_bytes FROM grp GROUP BY group_path")
def similar_waste(spark, d):
    return similar.group_waste(_similar(spark, d)).select("kept_path", "members", "wasted_bytes")


@_register(
    "similar_capped",
    f"""WITH {_IMAGES}, c AS (SELECT full_path FROM img ORDER BY modified_utc DESC, full_path LIMIT 100)
    SELECT c.full_path, (SELECT count(*) FROM img) AS found, least(100, (SELECT count(*) FROM img))::BIGINT AS considered, (SELECT count(*) FROM img) > 100 AS truncated FROM c""",
)
def similar_capped(spark, d):
    images = adapters.embedding_hashes(spark, d)
    return similar.newest(images, 100).select("full_path").crossJoin(F.broadcast(similar.cap_figures(images, 100)))


_GRID = "list_transform(range(72), lambda i: floor(embedding[i % 64 + 1]::DOUBLE * 1000)::INTEGER + i % 5)"


@_register(
    "difference_hash",
    f"""WITH g AS (SELECT vec_id, {_GRID} AS g FROM embeddings),
    h AS (SELECT vec_id, sum(CASE WHEN g[y * 9 + x + 1] > g[y * 9 + x + 2] THEN 1::HUGEINT << (y * 8 + x)::INTEGER ELSE 0::HUGEINT END) AS h FROM g, range(8) a(y), range(8) b(x) GROUP BY vec_id)
    SELECT vec_id, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS hash FROM h""",
)
def difference_hash(spark, d):
    """Of grids of 9 x 8 grey values made from the vectors."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor(F.get(F.col("embedding"), i % 64).cast("double") * 1000).cast("int") + i % 5)
    return adapters.table(spark, d, "embeddings").select("vec_id", dhash.grid_hash_column(grid).alias("hash"))


_TYPES = [".jpg", ".JPEG", ".png", ".Bmp", ".gif", ".webp", ".TIFF", ".tif", ".txt", ".jp"]


@_register(
    "image_files",
    f"""WITH f AS (SELECT '/' || lang || '/' || doc_id || {_TYPES}[doc_id % {len(_TYPES)} + 1] AS full_path, doc_id % {len(_TYPES)} AS k, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE octet_length(encode(text)) END::BIGINT AS size_bytes FROM documents)
    SELECT full_path, size_bytes FROM f WHERE k < 8 AND size_bytes > 0""",
)
def image_files(spark, d):
    kinds = F.array(*map(F.lit, _TYPES))
    path = F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.get(kinds, (F.col("doc_id") % len(_TYPES)).cast("int")))
    rows = adapters.table(spark, d, "documents").select(path.alias("full_path"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.octet_length("text")).cast("bigint").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_utc"))
    return similar.image_files(rollup.build_nodes(rows)).select("full_path", "size_bytes")


@_register(
    "reclaim_totals",
    f"""{_GROUPS.replace("grp AS", "sim AS")}, {_DUP}, s AS (SELECT sum(size_bytes) - max(size_bytes) AS w FROM sim GROUP BY group_path),
    t AS (SELECT coalesce((SELECT sum(wasted_bytes) FROM grp), 0)::BIGINT AS duplicate_bytes, coalesce((SELECT sum(w) FROM s), 0)::BIGINT AS similar_bytes)
    SELECT *, duplicate_bytes + similar_bytes AS total_bytes FROM t""",
)
def reclaim_totals(spark, d):
    return overview.reclaim_totals(dup.groups(dup.duplicate_files(documents_files(spark, d))), similar.group_waste(_similar(spark, d)))


# snapshots

_NEW_TYPES = "CASE WHEN user_id % 11 = 5 THEN event_type || '_new' ELSE event_type END"
_EVENTS = f"{Q.events(EVENT_CUTS[0], 'true', '_a')}, {Q.events(EVENT_CUTS[1], 'user_id % 7 <> 3', '_b', _NEW_TYPES)}, {Q.diff()}"
_DOC_MOVES = f"WITH {Q.BEFORE}, {Q.AFTER}, {Q.diff()}, {Q.MOVES}"
_CHANGE = "full_path, name, is_directory, old_bytes, new_bytes, delta_bytes"


def _event_changes(spark, d):
    return snapshot.changes(*(events_tree(spark, d, cut) for cut in EVENT_CUTS))


def _changes(kind: str) -> None:
    texts = f"{Q.signed_text('delta_bytes')} AS delta_text, CASE WHEN old_bytes = 0 THEN {Q.size_text('new_bytes')} WHEN new_bytes = 0 THEN {Q.size_text('old_bytes')} ELSE {Q.size_text('old_bytes')} || ' → ' || {Q.size_text('new_bytes')} END AS size_text"

    @_register(f"snapshot_{kind}", f"WITH {_EVENTS} SELECT {_CHANGE}, {texts} FROM changes WHERE kind = '{kind}'")
    def run(spark, d):
        return snapshot.change_texts(_event_changes(spark, d).where(F.col("kind") == kind)).select(*_CHANGE.split(", "), "delta_text", "size_text")


for _kind in ("added", "removed", "changed"):
    _changes(_kind)


@_register(
    "snapshot_moves",
    rf"""{_DOC_MOVES} SELECT old_path, new_path, is_directory, size_bytes, tier::INTEGER AS tier, CASE WHEN old_name <> new_name AND f THEN 'Moved & renamed' WHEN old_name <> new_name THEN 'Renamed' ELSE 'Moved' END AS move_kind
    FROM (SELECT *, lower(regexp_extract(old_path, '^(.*)/[^/]*$', 1)) <> lower(regexp_extract(new_path, '^(.*)/[^/]*$', 1)) AS f FROM moved)""",
)
def snapshot_moves(spark, d):
    return snapshot.moves(snapshot.changes(*moved_documents(spark, d))).select("old_path", "new_path", "is_directory", "size_bytes", "tier", "move_kind")


@_register(
    "snapshot_net_delta",
    f"""{_DOC_MOVES} SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'changed') AS changed,
    coalesce(sum(delta_bytes), 0)::BIGINT AS net_delta_reference, coalesce(sum(delta_bytes) FILTER (NOT is_directory), 0)::BIGINT AS net_delta_bytes FROM rest""",
)
def snapshot_net_delta(spark, d):
    return snapshot.net_delta(snapshot.compare(*moved_documents(spark, d))[0])


@_register("snapshot_top20", f"WITH {_EVENTS} SELECT {_CHANGE} FROM changes WHERE kind = 'changed' ORDER BY abs(delta_bytes) DESC, traversal_ord LIMIT 20")
def snapshot_top20(spark, d):
    return snapshot.top(_event_changes(spark, d), "changed").select(*_CHANGE.split(", "))


@_register("snapshot_roundtrip", f"WITH {Q.ORDERS} SELECT {_NODE} FROM nodes")
def snapshot_roundtrip(spark, d):
    folder = f"{shared_dir(spark)}/arborlake/snapshots-{uuid.uuid4().hex}"
    snapshots.save(orders_tree(spark, d), folder, "first")
    out = Scratch(spark).keep(_node_columns(snapshots.load(spark, folder, "first")), "loaded")
    delete_folder(spark, folder)
    return out


@_register(
    "snapshot_json_roundtrip",
    f"WITH {Q.CONVERSATIONS} SELECT full_path, parent_path, is_directory, depth, size_bytes, file_count, coalesce(extension, '') AS extension, epoch(modified_utc)::BIGINT AS seconds, traversal_ord FROM nodes",
)
def snapshot_json_roundtrip(spark, d):
    """The conversations as one nested JSON document, which tasks write and read side by side."""
    path = f"{shared_dir(spark)}/arborlake/nested-{uuid.uuid4().hex}.json"
    snapshots.write_json(conversations_tree(spark, d), path, root_path="/data/chats")
    nodes = snapshots.import_json(spark, path).select(
        "full_path", "parent_path", "is_directory", "depth", "size_bytes", "file_count", F.coalesce("extension", F.lit("")).alias("extension"), F.unix_timestamp("modified_utc").alias("seconds"), "traversal_ord"
    )
    out = Scratch(spark).keep(nodes, "imported")
    delete_folder(spark, path)
    return out


@_register("snapshot_stored_changes", f"WITH {_EVENTS} SELECT kind, {_CHANGE} FROM changes")
def snapshot_stored_changes(spark, d):
    """Two snapshots stored as bucketed tables, compared without a shuffle."""
    names = [f"snapshot_{uuid.uuid4().hex}" for _ in EVENT_CUTS]
    try:
        for name, cut in zip(names, EVENT_CUTS):
            snapshots.save_table(events_tree(spark, d, cut), name, 8)
        stored = (snapshots.load_table(spark, name) for name in names)
        return Scratch(spark).keep(snapshot.changes(*stored).select("kind", *_CHANGE.split(", ")), "compared")
    finally:
        for name in names:
            snapshots.drop_table(spark, name)


# renames

_FILES = f"files AS ({Q.DOC_FILES})"


def _batch(spark, d):
    return documents_files(spark, d).select("full_path", F.col("doc_id").alias("ord"))


def _rename(name: str, new_base: str, options: rename.RenameOptions) -> None:
    sql = f"""WITH {_FILES}, b AS (SELECT full_path, doc_id AS ord, regexp_extract(full_path, '^(.*)/', 1) AS folder, doc_id::VARCHAR AS base, row_number() OVER (ORDER BY doc_id) AS nth FROM files),
    n AS (SELECT full_path, ord, folder, {new_base} AS stem FROM b),
    k AS (SELECT *, row_number() OVER (PARTITION BY lower(folder || '/' || stem), trim(stem) = '' ORDER BY ord) AS again FROM n)
    SELECT full_path, stem || '.txt' AS new_name, CASE WHEN trim(stem) = '' THEN '{rename.EMPTY}' WHEN again > 1 THEN '{rename.COLLIDES}'
      WHEN folder || '/' || stem || '.txt' IN (SELECT full_path FROM files WHERE doc_id % 10 = 0) AND folder || '/' || stem || '.txt' NOT IN (SELECT full_path FROM b) THEN '{rename.EXISTS}' END AS error FROM k"""

    @_register(name, sql)
    def run(spark, d):
        return rename.preview(_batch(spark, d), options).select("full_path", "new_name", "error")


_rename("rename_prefix_suffix", "'2026-' || base || '-edited'", rename.RenameOptions(prefix="2026-", suffix="-edited"))
_rename("rename_literal", "replace(base, '1', 'One ')", rename.RenameOptions(find="1", replace="One "))
_rename("rename_regex", r"regexp_replace(base, '(\d)(\d)$', '\2$\1', 'g')", rename.RenameOptions(find=r"(\d)(\d)$", is_regex=True, replace="$2$$$1"))
_rename("rename_counter", "base || lpad((5 + 10 * (nth - 1))::VARCHAR, greatest(3, length((5 + 10 * (nth - 1))::VARCHAR))::INTEGER, '0')", rename.RenameOptions(use_counter=True, counter_start=5, counter_step=10, counter_digits=3))

_COLLIDE = f"""{_FILES}, b AS (SELECT full_path, doc_id AS ord, regexp_extract(full_path, '^(.*)/', 1) AS folder, replace(doc_id::VARCHAR, '7', '') AS stem FROM files),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(folder || '/' || stem), trim(stem) = '' ORDER BY ord) AS again, folder || '/' || stem || '.txt' AS new_path FROM b),
p AS (SELECT full_path, ord, new_path, CASE WHEN trim(stem) = '' THEN '{rename.EMPTY}' WHEN again > 1 THEN '{rename.COLLIDES}'
  WHEN lower(new_path) IN (SELECT lower(regexp_extract(full_path, '^(.*)/', 1) || '/' || replace(doc_id::VARCHAR, '1', '') || '.txt') FROM files) AND lower(new_path) NOT IN (SELECT lower(full_path) FROM b) THEN '{rename.EXISTS}' END AS error FROM k)"""


def _collisions(spark, d):
    """All files, beside others in their folders that are not in the batch."""
    files = documents_files(spark, d).select("full_path", F.col("doc_id").alias("ord"))
    others = files.select(F.concat(F.regexp_extract("full_path", "^(.*/)", 1), F.replace(F.col("ord").cast("string"), F.lit("1"), F.lit("")), F.lit(".txt")).alias("full_path"))
    return rename.preview(files, rename.RenameOptions(find="7"), others)


@_register("rename_collisions", f"WITH {_COLLIDE} SELECT full_path, new_path, CASE WHEN error IS NOT NULL THEN 'fail' WHEN full_path = new_path THEN 'skip' ELSE 'rename' END AS action, error FROM p")
def rename_collisions(spark, d):
    return rename.plan(_collisions(spark, d)).select("full_path", "new_path", "action", "error")


@_register("rename_errors", f"WITH {_COLLIDE} SELECT count(*) AS files, count(error) AS errors FROM p")
def rename_errors(spark, d):
    return rename.error_count(_collisions(spark, d))


@_register(
    "rename_applied_tree",
    f"WITH {_COLLIDE}, l0 AS (SELECT coalesce(p.new_path, f.full_path) AS full_path, size_bytes, modified_utc FROM files f LEFT JOIN p ON f.full_path = p.full_path AND p.error IS NULL), {Q.tree('SELECT * FROM l0')} SELECT {_NODE} FROM nodes",
)
def rename_applied_tree(spark, d):
    done = rename.plan(_collisions(spark, d)).where("action = 'rename'")
    return _node_columns(rollup.rename_nodes(documents_tree(spark, d), done.select("full_path", "new_path")))


_CHAIN_NAME = "CASE WHEN doc_id % 10 < 9 THEN CAST(doc_id + 1 AS VARCHAR(20)) WHEN doc_id % 20 = 9 THEN CAST(doc_id - 9 AS VARCHAR(20)) ELSE concat('end_', doc_id) END"


@_register(
    "rename_chains",
    f"""WITH RECURSIVE b AS (SELECT '/all/' || doc_id || '.txt' AS full_path, '/all/' || {_CHAIN_NAME} || '.txt' AS new_path, doc_id * 37 % 101 * 1000000 + doc_id AS ord FROM documents),
    r(start, cur, k, late) AS (SELECT full_path, full_path, 0, false FROM b
      UNION ALL SELECT r.start, n.full_path, k + 1, late OR n.ord > b.ord FROM r JOIN b ON r.cur = b.full_path JOIN b n ON b.new_path = n.full_path WHERE n.full_path <> r.start AND k < 20),
    e AS (SELECT start, max(k) AS k, arg_max(late, k) AS late, arg_max(cur, k) AS final FROM r GROUP BY start)
    SELECT full_path, b.new_path, CASE WHEN c THEN NULL ELSE k END::BIGINT AS waits, c AS in_cycle, late OR c AS fails_in_order
    FROM (SELECT e.*, coalesce((SELECT l.new_path FROM b l WHERE l.full_path = e.final) = e.start, false) AS c FROM e) e JOIN b ON b.full_path = e.start""",
)
def rename_chains(spark, d):
    """Chains of ten documents, every second one a circle."""
    rows = adapters.table(spark, d, "documents").selectExpr("concat('/all/', doc_id, '.txt') AS full_path", f"concat({_CHAIN_NAME}, '.txt') AS new_name", f"concat('/all/', {_CHAIN_NAME}, '.txt') AS new_path", "doc_id * 37 % 101 * 1000000 + doc_id AS ord", "CAST(NULL AS STRING) AS error")
    return rename.chains(rows).drop("ord")


# patches and exports

_GONE = "(full_path LIKE '/EUROPE/%' AND size_bytes % 3 = 0 AND depth = 4) OR full_path IN (SELECT min(full_path) FROM nodes WHERE depth = 2 AND full_path LIKE '/ASIA/%')"


_PATCHED = f"""WITH {Q.ORDERS}, gone AS (SELECT full_path, is_directory FROM nodes WHERE {_GONE}),
    l2 AS (SELECT full_path, size_bytes, modified_utc FROM leaves WHERE full_path NOT IN (SELECT full_path FROM gone) AND NOT starts_with(full_path, (SELECT full_path || '/' FROM gone WHERE is_directory))),
    f2 AS (SELECT full_path FROM dirs WHERE full_path NOT IN (SELECT full_path FROM gone) AND NOT starts_with(full_path, (SELECT full_path || '/' FROM gone WHERE is_directory))),
    {Q.tree("SELECT * FROM l2", "SELECT * FROM f2", "_c")}"""


def _patched(spark, d):
    nodes = orders_tree(spark, d)
    some = nodes.where("full_path LIKE '/EUROPE/%' AND size_bytes % 3 = 0 AND depth = 4").select("full_path")
    first = nodes.where("depth = 2 AND full_path LIKE '/ASIA/%'").agg(F.min("full_path").alias("full_path"))
    return rollup.remove_nodes(nodes, some.union(first))


@_register("delete_patch_rollup", f"{_PATCHED} SELECT {_NODE} FROM nodes_c")
def delete_patch_rollup(spark, d):
    return _node_columns(_patched(spark, d))


@_register("delete_patch_rebased", f"{_PATCHED} SELECT full_path, size_bytes, file_count, {Q.points('size_bytes', '(SELECT size_bytes FROM nodes_c WHERE depth = 0)')} AS share_bp FROM nodes_c")
def delete_patch_rebased(spark, d):
    """What is left after a delete, with shares of the root's new size."""
    return rollup.with_shares(Scratch(spark).keep(_patched(spark, d), "patched")).select("full_path", "size_bytes", "file_count", "share_bp")


_CELLS = f"""name AS "Name", full_path AS "Full Path", CASE WHEN is_directory THEN 'Folder' ELSE 'File' END AS "Type", size_bytes::VARCHAR AS "Size (Bytes)", {Q.size_text("size_bytes")} AS "Size",
  (bp // 100)::VARCHAR || '.' || lpad((bp % 100)::VARCHAR, 2, '0') AS "% of Total", file_count::VARCHAR AS "File Count", coalesce(strftime(modified_utc, '%Y-%m-%d %H:%M:%SZ'), '') AS "Last Modified (UTC)" """


@_register("export_csv_rows", f"WITH {Q.ORDERS}, s AS (SELECT *, {Q.points('size_bytes', '(SELECT size_bytes FROM nodes WHERE depth = 0)')} AS bp FROM nodes) SELECT {_CELLS} FROM s")
def export_csv_rows(spark, d):
    nodes = orders_tree(spark, d)
    return export.csv_rows(nodes, rollup.root_total(nodes).first()[0])


@_register(
    "export_html_rows",
    f"""WITH {Q.ORDERS}, t AS (SELECT sum(size_bytes) AS t FROM nodes), s AS (SELECT *, {Q.points("size_bytes", "t")} AS bp FROM nodes, t)
    SELECT name, full_path, CASE WHEN is_directory THEN 'Folder' ELSE 'File' END AS kind, size_bytes, {Q.size_text("size_bytes")} AS size_text,
      ((bp + 5) // 10 // 10)::VARCHAR || '.' || ((bp + 5) // 10 % 10)::VARCHAR AS percent_text, bp AS bar_bp, file_count, coalesce(strftime(modified_utc, '%Y-%m-%d %H:%M'), '—') AS modified_text FROM s""",
)
def export_html_rows(spark, d):
    return export.html_rows(orders_tree(spark, d)).drop("traversal_ord", "is_directory")


# orders


def _ranked(rows, first, *ties):
    """Adds rank, from 1, without a task for all rows."""
    return number_rows(rows, F.struct((-first).alias("first"), *ties), "rank")


@_register("search_ranked", f"WITH {Q.PAGES} SELECT {_HIT}, row_number() OVER (ORDER BY size_bytes DESC, traversal_ord) AS rank FROM nodes WHERE size_bytes >= 2000")
def search_ranked(spark, d):
    """Hits, the largest first."""
    hits = search.search(pages_tree(spark, d), SearchCriteria(min_size=2000))
    return _ranked(hits, F.col("size_bytes"), "traversal_ord").select(*_HIT.split(", "), "rank")


@_register("duplicates_ranked", f"WITH {_DUP} SELECT kept_path, wasted_bytes, copies, row_number() OVER (ORDER BY wasted_bytes DESC, kept_path) AS rank FROM grp")
def duplicates_ranked(spark, d):
    """Groups, the most waste first."""
    found = dup.groups(dup.duplicate_files(documents_files(spark, d)))
    return _ranked(found, F.col("wasted_bytes"), "kept_path").select("kept_path", "wasted_bytes", "copies", "rank")


@_register(
    "similar_ranked",
    f"""{_GROUPS}, w AS (SELECT min(full_path) FILTER (rank = 1) AS kept_path, (sum(size_bytes) - max(size_bytes))::BIGINT AS wasted_bytes FROM grp GROUP BY group_path)
    SELECT *, row_number() OVER (ORDER BY wasted_bytes DESC, kept_path) AS rank FROM w""",
)
def similar_ranked(spark, d):
    waste = similar.group_waste(_similar(spark, d))
    return _ranked(waste, F.col("wasted_bytes"), "kept_path").select("kept_path", "wasted_bytes", "rank")


@_register(
    "snapshot_ranked",
    f"""{_DOC_MOVES}, k AS (SELECT kind, full_path, CASE kind WHEN 'added' THEN new_bytes WHEN 'removed' THEN old_bytes ELSE abs(delta_bytes) END AS by_bytes, traversal_ord AS tie FROM rest
      UNION ALL SELECT 'moved', old_path, size_bytes, old_path FROM moved)
    SELECT kind, full_path, by_bytes, row_number() OVER (PARTITION BY kind ORDER BY by_bytes DESC, tie)::INTEGER AS rank FROM k""",
)
def snapshot_ranked(spark, d):
    """Added, removed, changed and moved nodes, each kind in its order."""
    rest, moved = snapshot.compare(*moved_documents(spark, d))
    by = F.when(F.col("kind") == "added", F.col("new_bytes")).when(F.col("kind") == "removed", F.col("old_bytes")).otherwise(F.abs("delta_bytes"))
    rows = rest.select("kind", "full_path", by.alias("by_bytes"), F.col("traversal_ord").alias("tie"))
    rows = rows.union(moved.select(F.lit("moved"), "old_path", "size_bytes", "old_path"))
    return rank_within(Scratch(spark).keep(rows, "kinds"), ["kind"], [F.desc("by_bytes"), F.col("tie")]).drop("tie")


@_register("export_csv_lines", f"WITH {Q.ORDERS}, s AS (SELECT *, {Q.points('size_bytes', '(SELECT size_bytes FROM nodes WHERE depth = 0)')} AS bp FROM nodes), c AS (SELECT {_CELLS}, traversal_ord FROM s)"
    """ SELECT row_number() OVER (ORDER BY traversal_ord) AS line, concat_ws(',', "Name", "Full Path", "Type", "Size (Bytes)", "Size", "% of Total", "File Count", "Last Modified (UTC)") AS value FROM c""")  # fmt: skip
def export_csv_lines(spark, d):
    """The lines of the CSV file, which tasks write in order and the file system joins, read back with their places."""
    nodes = Scratch(spark).keep(orders_tree(spark, d), "nodes")
    folder = f"{shared_dir(spark)}/arborlake/report-{uuid.uuid4().hex}"
    export.write_lines(export.ordered_csv_lines(nodes, rollup.root_total(nodes).first()[0]), [F.col("traversal_ord")], folder, joined=False)
    parts = spark.read.text(folder).select("value", "_metadata.file_name", F.monotonically_increasing_id().alias("at"))
    lines = number_rows(parts, F.struct(F.regexp_extract("file_name", r"^part-(\d+)", 1), "at"), "line").select("line", "value")
    out = Scratch(spark).keep(lines, "lines")
    delete_folder(spark, folder)
    return out


@_register("export_html_order", f"WITH {Q.ORDERS} SELECT full_path, size_bytes, row_number() OVER (ORDER BY size_bytes DESC, traversal_ord) AS rank FROM nodes")
def export_html_order(spark, d):
    return _ranked(orders_tree(spark, d), F.col("size_bytes"), "traversal_ord").select("full_path", "size_bytes", "rank")


# trees of files made from the documents, scanned


def _planted(spark, files, made):
    """What `made` returns of a folder in the shared folder with these files, written to a scratch table before they go."""
    root = f"{local_shared_dir(spark)}/arborlake/planted-{uuid.uuid4().hex}"
    try:
        fsnodes.create_files(files, root)
        return Scratch(spark).keep(made(root), "planted")
    finally:
        shutil.rmtree(root, ignore_errors=True)


_DEEP_FILES = r"""SELECT '/' || lang || '/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN regexp_replace(doc_id::VARCHAR, '(\d)', '\1/', 'g') ELSE '' END || doc_id || '.txt' AS full_path,
  octet_length(encode(text))::BIGINT AS size_bytes, make_timestamp((1704067200 + doc_id * 7919 % 1000 * 3600) * 1000000) AS modified_utc FROM documents"""


@_register(
    "scan_local_tree",
    f"WITH {Q.tree(_DEEP_FILES)} SELECT full_path, is_directory, size_bytes, CASE WHEN is_directory THEN file_count END AS files_below, CASE WHEN NOT is_directory THEN epoch(modified_utc)::BIGINT END AS seconds, false AS access_denied FROM nodes",
)
def scan_local_tree(spark, d):
    """A tree as skewed as languages and sources are, a third of it as deep as ids have digits; files have sizes but no content."""
    folder = F.col("is_directory")
    return _planted(spark, deep_files(spark, d), lambda root: fsnodes.scan(spark, root).select(
        "full_path", "is_directory", "size_bytes", F.when(folder, F.col("file_count")).alias("files_below"), F.when(~folder, F.unix_timestamp("modified_utc")).alias("seconds"), "access_denied"
    ))


@_register("duplicates_local_files", f"WITH {_DUP} SELECT full_path, size_bytes, rank, rank > 1 AS selected FROM dups")
def duplicates_local_files(spark, d):
    """The documents as files on disk, read by size, first bytes and whole digest."""

    def made(root):
        files = fsnodes.scan(spark, root).where("NOT is_directory").select("full_path", "size_bytes", "modified_utc")
        return dup.keep_plan(fsnodes.duplicates(files, root)).select("full_path", "size_bytes", "rank", "selected")

    return _planted(spark, documents_files(spark, d), made)


#: Names with quotes, commas, breaks and markup, in words that both dialects read alike.
_ODD_NAME = """CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('say "', page_id, '", twice') WHEN 2 THEN concat('<', url, '> & more') ELSE concat('line', chr(10), page_id) END"""


@_register(
    "export_local_names",
    rf"""WITH n AS (SELECT page_id, {_ODD_NAME} AS name FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(name, '[,"\n\r]') THEN '"' || replace(name, '"', '""') || '"' ELSE name END AS csv_name,
      replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html_name FROM n""",
)
def export_local_names(spark, d):
    rows = adapters.table(spark, d, "pages").selectExpr("page_id", f"{_ODD_NAME} AS name")
    return rows.select("page_id", fmt.csv_cell(F.col("name")).alias("csv_name"), fmt.html_escape(F.col("name")).alias("html_name"))


# versions, manifests and rights, made from the tables

_OFFERED = "concat_ws('.', CASE WHEN o_orderkey % 13 = 5 THEN 'x' ELSE concat(o_custkey % 3) END, concat(o_orderkey % 4), CASE WHEN o_orderkey % 2 = 0 THEN concat(o_custkey % 5) END)"
_RUNNING = "concat_ws('.', concat(o_orderkey % 3), CASE WHEN o_custkey % 7 <> 1 THEN concat(o_custkey % 4) END, CASE WHEN o_custkey % 7 <> 1 THEN '0' END)"


@_register(
    "version_compare",
    f"WITH v AS (SELECT o_orderkey, {_OFFERED} AS offered, {_RUNNING} AS running FROM orders)"
    + r""",
    p AS (SELECT *, list_transform(list_concat(string_split(offered, '.'), ['0', '0', '0'])[1:4], lambda x: try_cast(x AS INTEGER)) AS o, list_transform(list_concat(string_split(running, '.'), ['0', '0', '0'])[1:4], lambda x: try_cast(x AS INTEGER)) AS r,
      regexp_matches(offered, '^\d+(\.\d+){1,3}$') AND regexp_matches(running, '^\d+(\.\d+){1,3}$') AS ok FROM v)
    SELECT o_orderkey, offered, running, ok AND o > r AS newer FROM p""",
)
def version_compare(spark, d):
    rows = adapters.table(spark, d, "orders").selectExpr("o_orderkey", f"{_OFFERED} AS offered", f"{_RUNNING} AS running")
    return rows.withColumn("newer", versions.is_newer(F.col("offered"), F.col("running")))


_MASKS = [versions.FULL_CONTROL, versions.MODIFY, versions.READ_EXECUTE, versions.WRITE, versions.READ, *versions.RIGHTS]
_ONE_MASK = lambda c: f"CASE {c} % {len(_MASKS)} " + " ".join(f"WHEN {k} THEN {m}" for k, m in enumerate(_MASKS)) + " END"
_MASK = f"({_ONE_MASK('o_custkey')} | {_ONE_MASK('o_orderkey')} | CASE WHEN o_orderkey % 17 = 3 THEN 512 ELSE 0 END)"
_HAS = lambda bits: f"(mask & {bits}) = {bits}"


@_register(
    "rights_labels",
    f"""WITH m AS (SELECT o_orderkey, {_MASK} AS mask FROM orders)
    SELECT o_orderkey, mask::INTEGER AS mask, CASE WHEN {_HAS(versions.FULL_CONTROL)} THEN 'Full control' WHEN {_HAS(versions.MODIFY)} THEN 'Modify'
      WHEN {_HAS(versions.READ_EXECUTE)} AND {_HAS(versions.WRITE)} THEN 'Read & execute, Write' WHEN {_HAS(versions.READ_EXECUTE)} THEN 'Read & execute'
      WHEN {_HAS(versions.READ)} AND {_HAS(versions.WRITE)} THEN 'Read, Write' WHEN {_HAS(versions.READ)} THEN 'Read' WHEN {_HAS(versions.WRITE)} THEN 'Write'
      WHEN (mask & 512) = 0 THEN concat_ws(', ', {", ".join(f"CASE WHEN {_HAS(b)} THEN '{n}' END" for b, n in versions.RIGHTS.items())}) ELSE mask::VARCHAR END AS label FROM m""",
)
def rights_labels(spark, d):
    rows = adapters.table(spark, d, "orders").selectExpr("o_orderkey", f"CAST({_MASK} AS INT) AS mask")
    return rows.withColumn("label", versions.rights_label(F.col("mask")))


_MANIFEST = """CASE page_id % 8 WHEN 0 THEN '<other/>' WHEN 1 THEN concat('page ', page_id) WHEN 2 THEN concat('<appinfo><version>1.', page_id, '</url></appinfo>') ELSE
  concat('<appinfo>', CASE page_id % 8 WHEN 3 THEN '' WHEN 4 THEN concat('<version>v', page_id, '</version>') ELSE concat('<version> ', page_id, '.0 </version>') END,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('<url>', replace(replace(url, '&', '&amp;'), '<', '&lt;'), '</url>') END, CASE WHEN page_id % 2 = 0 THEN '<about/>' ELSE concat('<about> page ', page_id, ' </about>') END, '</appinfo>') END"""


@_register(
    "manifest_parse",
    """SELECT page_id, CASE WHEN k > 3 THEN CASE WHEN k = 4 THEN 'v' || page_id ELSE page_id || '.0' END END AS version, CASE WHEN k > 2 AND page_id % 3 <> 0 THEN url END AS url,
      CASE WHEN k > 2 AND page_id % 2 = 1 THEN 'page ' || page_id END AS about,
      CASE WHEN k = 0 THEN 'no appinfo element' WHEN k < 3 THEN 'not well-formed' WHEN k = 3 THEN 'no version' WHEN k = 4 THEN 'not a version' WHEN page_id % 3 = 0 THEN 'no url' END AS error
    FROM (SELECT *, page_id % 8 AS k FROM pages)""",
)
def manifest_parse(spark, d):
    rows = adapters.table(spark, d, "pages").selectExpr("page_id", f"{_MANIFEST} AS xml")
    return rows.select("page_id", versions.manifest_fields(F.col("xml")).alias("m")).select("page_id", "m.*")
