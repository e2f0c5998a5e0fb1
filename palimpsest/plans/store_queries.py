"""Queries over trees, index and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import glob, scalar, text
from palimpsest.operators import check, diff, ingest, prune, rewrite, select, stats, tree
from palimpsest.plans.registry import query
from palimpsest.sources import readers, writers
from palimpsest.sources.virtual import Virtual

_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_PARENT = "CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END"


def _all(v: Virtual) -> DataFrame:
    return tree.walk(v.root_snapshots().where("id = 'all'"), v.stored_nodes())


def _roots(v: Virtual) -> DataFrame:
    return v.root_snapshots().select(F.col("tree").alias("tree_id")).where("tree_id IN ('r0', 'r2')")


def _every_root(v: Virtual) -> DataFrame:
    return v.root_snapshots().select(F.col("tree").alias("tree_id"))


#: What regions 0 and 2 use.
_USED = {
    "used_trees": "SELECT 'r' || r_regionkey AS tree_id FROM region WHERE r_regionkey IN (0, 2) UNION ALL SELECT n.subtree FROM used_trees u JOIN nodes n ON n.tree_id = u.tree_id WHERE n.subtree IS NOT NULL",
    "used": "SELECT 'tree' AS blob_type, tree_id AS blob_id FROM used_trees UNION ALL SELECT DISTINCT 'data', unnest(content) FROM nodes WHERE type = 'file' AND tree_id IN (SELECT tree_id FROM used_trees)",
    "first_copies": "SELECT * EXCLUDE nr FROM (SELECT *, row_number() OVER (PARTITION BY blob_type, blob_id ORDER BY pack_id, index_id) AS nr FROM index_blobs) WHERE nr = 1",
}

#: What all snapshots use.
_EVERY = _USED | {"used_trees": "SELECT tree AS tree_id FROM root_snapshots UNION SELECT n.subtree FROM used_trees u JOIN nodes n ON n.tree_id = u.tree_id WHERE n.subtree IS NOT NULL"}


@query("SELECT snapshot_id, path, CAST(depth AS INTEGER) AS depth, type, size FROM walk")
def t1_walk(v: Virtual) -> DataFrame:
    return tree.walk(v.root_snapshots(), v.stored_nodes()).select("snapshot_id", "path", "depth", "type", "size")


@query("SELECT tree_id FROM used_trees", **_EVERY)
def t2_reachable_trees(v: Virtual) -> DataFrame:
    return tree.reachable_trees(_every_root(v), v.stored_nodes())


@query("SELECT 'n' || n_nationkey AS tree_id, count(*) AS entries FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation) GROUP BY n_nationkey")
def t3_resolve_folder(v: Virtual) -> DataFrame:
    first = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").first()
    at = tree.resolve_folder("root", f"{first.r_name}/{first.n_name}", v.nodes())
    return v.nodes().where(F.col("tree_id") == at).groupBy("tree_id").agg(F.count("*").alias("entries"))


@query("SELECT tree_id, name, type FROM nodes WHERE (tree_id, name) IN (SELECT 'c' || o_custkey, 'o' || o_orderkey || '.f' FROM orders)")
def t4_find_in_trees(v: Virtual) -> DataFrame:
    """All orders by the name they have if they are finished; others aren't found."""
    o = v.table("orders")
    wanted = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("tree_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".f")).alias("name"))
    return tree.find_in_trees(wanted, v.nodes()).select("tree_id", "name", "type")


@query("SELECT coalesce(a.name, b.name) AS name, a.name IS NOT NULL AS in_left, b.name IS NOT NULL AS in_right FROM (SELECT name FROM nodes WHERE tree_id = 'n1' AND name LIKE '%1%') a FULL JOIN (SELECT name FROM nodes WHERE tree_id = 'n1' AND name LIKE '%2%') b ON a.name = b.name")
def t5_dual_trees(v: Virtual) -> DataFrame:
    own = v.nodes().where("tree_id = 'n1'")
    out = tree.dual(own.where("name LIKE '%1%'"), own.where("name LIKE '%2%'"))
    return out.select("name", F.col("left_node").isNotNull().alias("in_left"), F.col("right_node").isNotNull().alias("in_right"))


@query("SELECT blob_type, blob_id FROM used", **_EVERY)
def t6_used_blobs(v: Virtual) -> DataFrame:
    return tree.used_blobs(_every_root(v), v.stored_nodes())


@query("SELECT DISTINCT blob_id AS tree_id FROM index_blobs WHERE blob_type = 'tree' AND blob_id NOT IN (SELECT subtree FROM nodes WHERE subtree IS NOT NULL AND NOT (tree_id LIKE 'n%' AND CAST(substr(subtree, 2) AS BIGINT) % 17 = 3)) AND blob_id NOT IN (SELECT 'r' || r_regionkey FROM region WHERE r_regionkey = 0)")
def t7_unreferenced_roots(v: Virtual) -> DataFrame:
    keep = ~(F.col("tree_id").startswith("n") & (F.substring("subtree", 2, 20).try_cast("long") % 17 == 3))
    nodes = v.nodes().where(F.coalesce(keep, F.lit(True)))
    return tree.unreferenced_roots(v.index_blobs(), nodes, v.root_snapshots().where("id = 'region0'"))


@query("SELECT snapshot_id, inode, device_id, path FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, inode, device_id ORDER BY string_split(path, '/')) AS nr FROM walk WHERE type <> 'dir' AND links > 1 AND inode <> 0) WHERE nr = 1")
def t8_hardlinks(v: Virtual) -> DataFrame:
    return tree.hardlinks(tree.walk(v.root_snapshots(), v.stored_nodes())).select("snapshot_id", "inode", "device_id", "path")


_FOLDER = "(SELECT '/' || r_name FROM region ORDER BY r_regionkey LIMIT 1)"


@query(f"SELECT path, type, CASE WHEN type = 'file' THEN size END AS size FROM walk WHERE snapshot_id = 'all' AND (path = {_FOLDER} OR {_PARENT} = {_FOLDER})")
def t9_ls_folder(v: Virtual) -> DataFrame:
    folder = "/" + v.table("region").orderBy("r_regionkey").first().r_name
    return tree.list_tree(_all(v), (folder,)).select("path", "type", F.when(F.col("type") == "file", F.col("size")).alias("size"))


@query(f"SELECT path, type FROM walk WHERE snapshot_id = 'all' AND (path = {_FOLDER} OR starts_with(path, {_FOLDER} || '/'))")
def t9_ls_recursive(v: Virtual) -> DataFrame:
    folder = "/" + v.table("region").orderBy("r_regionkey").first().r_name
    return tree.list_tree(_all(v), (folder,), recursive=True).select("path", "type")


@query(f"SELECT snapshot_id, path FROM walk WHERE regexp_matches({_NAME}, '^o[0-9]*7\\.f$') AND mtime >= TIMESTAMP '1996-01-01' AND mtime <= TIMESTAMP '1997-12-31'")
def t10_find_pattern(v: Virtual) -> DataFrame:
    found = tree.find_paths(v.root_snapshots(), v.stored_nodes(), ["o*7.f"], oldest="1996-01-01", newest="1997-12-31")
    return found.select("snapshot_id", "path")


@query(f"SELECT path FROM walk WHERE snapshot_id = 'all' AND starts_with(path, {_FOLDER} || '/') AND depth >= 3 AND regexp_matches(path, '^/[^/]*/[^/]*/[^/]*1(/.*)?$')")
def t10_find_rooted(v: Virtual) -> DataFrame:
    folder = "/" + v.table("region").orderBy("r_regionkey").first().r_name
    return tree.find_paths(v.root_snapshots().where("id = 'all'"), v.stored_nodes(), [f"{folder}/*/*1"]).select("path")


@query(f"SELECT path, regexp_matches(lower({_NAME}), '^o[0-9]*[0-4]\\.[fp]$') AND NOT regexp_matches(path, '(^|/)[^/]*9(/.*)?$') OR regexp_matches(path, '^/.*/o1[^/]*(/.*)?$') AS matched FROM walk WHERE snapshot_id = 'all'")
def f11_f13_pattern_list(v: Virtual) -> DataFrame:
    walked = _all(v)
    return walked.select("path", glob.matches_list(F.col("path"), ["O*[0-4].[fp]".lower(), "!*9", "/**/o1*"]).alias("matched"))


@query("SELECT snapshot_id, path, content_pos - 1 AS content_pos, blob_id FROM (SELECT snapshot_id, path, unnest(content) AS blob_id, generate_subscripts(content, 1) AS content_pos FROM walk WHERE type = 'file') WHERE blob_id IN ('b1', 'b7', 'b42')")
def t11_find_blob(v: Virtual) -> DataFrame:
    ids = v.spark.createDataFrame([("b1",), ("b7",), ("b42",)], "blob_id string")
    return tree.find_blobs(tree.walk(v.root_snapshots(), v.stored_nodes()), ids).select("snapshot_id", "path", F.col("content_pos").cast("long").alias("content_pos"), "blob_id")


@query("SELECT snapshot_id, path, subtree AS tree_id FROM walk WHERE subtree IN ('r1', 'n3', 'c9') UNION ALL SELECT id, '/', tree FROM root_snapshots WHERE tree IN ('r1', 'n3', 'c9')")
def t12_find_tree(v: Virtual) -> DataFrame:
    ids = v.spark.createDataFrame([("r1",), ("n3",), ("c9",)], "tree_id string")
    return tree.find_trees(v.root_snapshots(), tree.walk(v.root_snapshots(), v.stored_nodes()), ids)


@query("SELECT snapshot_id, path, count(*) AS blobs FROM (SELECT snapshot_id, path, unnest(content) AS blob_id FROM walk WHERE type = 'file') WHERE blob_id IN (SELECT blob_id FROM index_blobs WHERE pack_id = 'p3') GROUP BY snapshot_id, path")
def t13_find_pack(v: Virtual) -> DataFrame:
    blobs = tree.blobs_of_packs(v.index_blobs(), v.spark.createDataFrame([("p3",)], "pack_id string"))
    return tree.find_blobs(tree.walk(v.root_snapshots(), v.stored_nodes()), blobs).groupBy("snapshot_id", "path").agg(F.count("*").alias("blobs"))


@query("SELECT blob_type, blob_id, min(pack_id) AS pack_id FROM index_blobs WHERE blob_type = 'data' GROUP BY ALL")
def t14_pack_of_blob(v: Virtual) -> DataFrame:
    return tree.first_pack(v.index_blobs(), v.index_blobs().where("blob_type = 'data'"))


@query("""WITH f AS (SELECT l_orderkey AS file_id, l_partkey AS blob_id, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
    c AS (SELECT *, sum(size) OVER (PARTITION BY file_id ORDER BY pos) AS e FROM (SELECT file_id, pos, blob_id, s.size FROM f JOIN (SELECT p_partkey AS blob_id, CAST(p_size AS BIGINT) AS size FROM part) s USING (blob_id)))
    SELECT file_id, pos, CAST(greatest(20 - (e - size), 0) AS BIGINT) AS start, CAST(least(65 - (e - size), size) AS BIGINT) AS stop FROM c WHERE e - size < 65 AND e > 20""")
def t16_read_range(v: Virtual) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    files = v.table("lineitem").select(F.col("l_orderkey").alias("file_id"), F.row_number().over(order).cast("long").alias("pos"), F.col("l_partkey").alias("blob_id"))
    sizes = v.table("part").select(F.col("p_partkey").alias("blob_id"), F.col("p_size").cast("long").alias("size"))
    return tree.read_range(files, sizes, 20, 45).select("file_id", "pos", "start", "stop")


@query("SELECT DISTINCT pack_id FROM index_blobs JOIN used USING (blob_type, blob_id)", **_EVERY)
def g8_c10_packs_of_snapshots(v: Virtual) -> DataFrame:
    return check.packs_of_snapshots(_every_root(v), v.stored_nodes(), v.index_blobs())


@query("SELECT path, size, regexp_extract(path, '(\\.[^./]*)$', 1) AS extension FROM walk WHERE snapshot_id = 'all'")
def g7_z9_extensions(v: Virtual) -> DataFrame:
    return _all(v).select("path", "size", scalar.extension(F.col("path")).alias("extension"))


_A, _B = dict(until="1999-01-01", lines_until="1998-06-01"), dict(until="2000-01-01", lines_until="1999-06-01")
#: Two early versions, of which neither uses all blobs.
_C, _D = dict(until="1995-02-01", lines_until="1995-02-10"), dict(until="1995-03-01", lines_until="1995-02-20")


def _sides(a: dict, b: dict) -> dict[str, str]:
    """Files of both versions, and the trees whose content differs: customers, and what lies above them but the root."""
    views = {
        f"{x}{k}": text
        for x, cut in {"a": a, "b": b}.items()
        for k, text in {
            "lines": f"SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS size, list('b' || l_partkey ORDER BY l_linenumber, l_partkey) AS content FROM lineitem WHERE l_shipdate < TIMESTAMP '{cut['lines_until']}' GROUP BY l_orderkey",
            "files": f"SELECT o_custkey, o_orderkey, 'o' || o_orderkey || '.' || lower(o_orderstatus) AS name, CASE WHEN o_orderkey % 50 = 0 THEN 'symlink' ELSE 'file' END AS type, coalesce(size, 0) AS size, CASE WHEN o_orderkey % 50 <> 0 THEN coalesce(content, []) END AS content FROM orders LEFT JOIN {x}lines ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '{cut['until']}'",
        }.items()
    }
    views["differing"] = "SELECT DISTINCT coalesce(a.o_custkey, b.o_custkey) AS c FROM afiles a FULL JOIN bfiles b ON a.o_orderkey = b.o_orderkey WHERE a.name IS NULL OR b.name IS NULL OR a.size <> b.size OR a.content IS DISTINCT FROM b.content"
    views["changed"] = "SELECT DISTINCT unnest(['c' || c_custkey, 'n' || n_nationkey, 'r' || n_regionkey]) AS tree_id FROM differing JOIN customer ON c = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    return views


_SIDES = _sides(_A, _B)


def _versions(v: Virtual, a: dict, b: dict) -> tuple[DataFrame, DataFrame]:
    """Nodes of two versions; trees whose content differs have ids of their own in the second one, equal ones are shared."""
    old, new = v.stored_nodes(**a), v.stored_nodes(**b)
    digest = lambda df: df.where("type <> 'dir'").groupBy("tree_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("name", "type", "size", "content")))), "\n"), 256).alias("digest"))
    both = digest(old).alias("o").join(digest(new).alias("n"), "tree_id", "full_outer")
    changed = level = both.where(~F.col("o.digest").eqNullSafe(F.col("n.digest"))).select("tree_id").checkpoint()
    for _ in range(2):  # nations, regions
        level = new.join(level.withColumnRenamed("tree_id", "subtree"), "subtree", "left_semi").select("tree_id").distinct()
        changed = changed.union(level)
    changed = changed.checkpoint()
    flag = lambda c: changed.select(F.col("tree_id").alias(c), F.lit("b").alias(f"own_{c}"))
    own = lambda c: F.concat(F.col(c), F.coalesce(f"own_{c}", F.lit(""))).alias(c)
    tagged = new.join(flag("tree_id"), "tree_id", "left").join(flag("subtree"), "subtree", "left")
    return old, tagged.select(*(own(c) if c in ("tree_id", "subtree") else c for c in new.columns)).checkpoint()


@query(
    """SELECT '/' || r_name || '/' || n_name || '/' || c_name || '/' || coalesce(a.name, b.name) AS path,
        CASE WHEN a.name IS NULL THEN '+' WHEN b.name IS NULL THEN '-' WHEN a.type = 'file' AND a.content <> b.content THEN CASE WHEN a.size = b.size THEN 'M?' ELSE 'M' END END AS change
    FROM afiles a FULL JOIN bfiles b ON a.o_orderkey = b.o_orderkey JOIN customer ON c_custkey = coalesce(a.o_custkey, b.o_custkey) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE a.name IS NULL OR b.name IS NULL OR a.type = 'file' AND a.content <> b.content""",
    **_SIDES,
)
def d1_diff_paths(v: Virtual) -> DataFrame:
    return diff.diff_trees("root", "root", *_versions(v, _A, _B)).select("path", "change")


@query(
    """SELECT count(*) FILTER (a.name IS NOT NULL AND b.name IS NOT NULL AND a.type = 'file' AND a.content <> b.content) AS changed_files, count(*) FILTER (a.name IS NULL AND b.type = 'file') AS files_added, CAST(0 AS BIGINT) AS dirs_added,
        count(*) FILTER (a.name IS NULL AND b.type = 'symlink') AS others_added, count(*) FILTER (b.name IS NULL) AS files_removed, CAST(0 AS BIGINT) AS dirs_removed, CAST(0 AS BIGINT) AS others_removed
    FROM afiles a FULL JOIN bfiles b ON a.o_orderkey = b.o_orderkey""",
    **_SIDES,
)
def d3_diff_counts(v: Virtual) -> DataFrame:
    return diff.diff_counts(diff.diff_trees("root", "root", *_versions(v, _A, _B)))


_PLAIN = "CASE WHEN uncompressed_length > 0 THEN uncompressed_length ELSE length - 32 END"


@query(
    f"""WITH a AS (SELECT DISTINCT unnest(content) AS blob_id FROM afiles WHERE type = 'file'), b AS (SELECT DISTINCT unnest(content) AS blob_id FROM bfiles WHERE type = 'file'),
    o AS (SELECT 'removed' AS side, 'data' AS blob_type, blob_id FROM a WHERE blob_id NOT IN (SELECT blob_id FROM b) UNION ALL SELECT 'added', 'data', blob_id FROM b WHERE blob_id NOT IN (SELECT blob_id FROM a)
        UNION ALL SELECT 'removed', 'tree', tree_id FROM changed UNION ALL SELECT 'added', 'tree', tree_id || 'b' FROM changed),
    s AS (SELECT blob_type, blob_id, arg_min({_PLAIN}, pack_id) AS size FROM index_blobs GROUP BY ALL)
    SELECT side, blob_type, count(*) AS blobs, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) FILTER (size IS NULL) AS unknown FROM o LEFT JOIN s USING (blob_type, blob_id) GROUP BY ALL""",
    **_sides(_C, _D),
)
def d7_diff_blobs(v: Virtual) -> DataFrame:
    return diff.diff_blobs("root", "root", *_versions(v, _C, _D), v.index_blobs())


@query("""SELECT snapshot_id, CAST(sum(n) AS BIGINT) AS total_file_count, CAST(sum(size) AS BIGINT) AS total_size FROM (
        SELECT snapshot_id, count(*) AS n, sum(size) AS size FROM walk WHERE links = 1 OR type = 'dir' OR inode = 0 GROUP BY snapshot_id
        UNION ALL SELECT snapshot_id, count(*), arg_min(size, string_split(path, '/')) FROM walk WHERE NOT (links = 1 OR type = 'dir' OR inode = 0) GROUP BY snapshot_id, inode, device_id) GROUP BY snapshot_id""")
def a1_restore_size(v: Virtual) -> DataFrame:
    return stats.restore_size(tree.walk(v.root_snapshots(), v.stored_nodes()))


@query("SELECT count(*) AS total_file_count, CAST(sum(size) AS BIGINT) AS total_size FROM (SELECT arg_min(size, (snapshot_id, string_split(path, '/'))) AS size FROM walk GROUP BY coalesce(array_to_string(content, ''), ''))")
def a2_files_by_contents(v: Virtual) -> DataFrame:
    return stats.files_by_contents(tree.walk(v.root_snapshots(), v.stored_nodes()))


@query(
    f"""WITH f AS (SELECT arg_min(path, (snapshot_id, string_split(path, '/'))) AS path, array_to_string(content, '') AS k, any_value(content) AS content FROM walk WHERE len(content) > 0 GROUP BY array_to_string(content, '')),
    p AS (SELECT DISTINCT path, unnest(content) AS blob_id FROM f)
    SELECT count(DISTINCT path) AS total_file_count, count(*) AS total_blob_count, CAST(coalesce(sum({_PLAIN}), 0) AS BIGINT) AS total_size FROM p LEFT JOIN (SELECT * FROM first_copies WHERE blob_type = 'data') USING (blob_id)""",
    **_USED,
)
def a3_blobs_per_file(v: Virtual) -> DataFrame:
    return stats.blobs_per_file(tree.walk(v.root_snapshots(), v.stored_nodes()), v.index_blobs())


@query(
    f"""SELECT n AS total_blob_count, total AS total_size, plain AS total_uncompressed_size, cp / cs AS compression_ratio, cp / plain * 100 AS compression_progress, (1 - total / plain) * 100 AS compression_space_saving FROM (
        SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS total, CAST(sum({_PLAIN} + 32) AS BIGINT) AS plain, CAST(sum(length) FILTER (uncompressed_length > 0) AS BIGINT) AS cs, CAST(sum({_PLAIN} + 32) FILTER (uncompressed_length > 0) AS BIGINT) AS cp
        FROM first_copies JOIN used USING (blob_type, blob_id))""",
    **_EVERY,
)
def a4_a5_raw_data(v: Virtual) -> DataFrame:
    return stats.raw_data(tree.used_blobs(_every_root(v), v.stored_nodes()), v.index_blobs())


@query("""SELECT CASE WHEN size = 0 THEN 0 WHEN size < 10 THEN 1 WHEN size < 100 THEN 10 WHEN size <= 150 THEN 100 END::BIGINT AS low, CASE WHEN size = 0 THEN 0 WHEN size < 10 THEN 9 WHEN size < 100 THEN 99 WHEN size <= 150 THEN 150 END::BIGINT AS high,
    count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM nodes WHERE type = 'file' GROUP BY 1, 2""")
def a6_size_histogram(v: Virtual) -> DataFrame:
    return stats.size_histogram(v.nodes().where("type = 'file'"), 150)


@query("SELECT count(*) FILTER (type = 'file') AS files, count(*) FILTER (type = 'dir') AS dirs, count(*) FILTER (type NOT IN ('file', 'dir')) AS others, CAST(coalesce(sum(size) FILTER (type = 'file'), 0) AS BIGINT) AS bytes FROM nodes")
def s19_a8_scan_totals(v: Virtual) -> DataFrame:
    return stats.entry_counts(v.nodes())


@query("SELECT * FROM pack_sizes")
def a9_pack_sizes(v: Virtual) -> DataFrame:
    return stats.pack_sizes(v.index_blobs())


@query("SELECT pack_id, CASE WHEN min(blob_type) = max(blob_type) THEN min(blob_type) ELSE 'mixed' END AS pack_type FROM index_blobs GROUP BY pack_id")
def a10_pack_types(v: Virtual) -> DataFrame:
    return stats.pack_types(v.index_blobs())


@query("SELECT blob_type, blob_id, length FROM first_copies JOIN used USING (blob_type, blob_id) WHERE (blob_type, blob_id) NOT IN (SELECT (blob_type, blob_id) FROM index_blobs WHERE index_id IN ('i1', 'i2'))", **_USED)
def m8_a12_blobs_to_copy(v: Virtual) -> DataFrame:
    return rewrite.blobs_to_copy(_roots(v), v.stored_nodes(), v.index_blobs(), v.index_blobs().where("index_id IN ('i1', 'i2')"))


@query("SELECT pack_id, count(*) AS blobs, CAST(sum(length) AS BIGINT) AS bytes, string_agg(blob_type || ':' || blob_id || ':' || length, ',' ORDER BY blob_type, blob_id, length) AS listed FROM index_blobs GROUP BY pack_id")
def s9_blobs_by_pack(v: Virtual) -> DataFrame:
    text = F.array_join(F.transform("listed", lambda x: F.concat_ws(":", x.blob_type, x.blob_id, x.length.cast("string"))), ",")
    return stats.blobs_by_pack(v.index_blobs()).withColumn("listed", text)


@query("SELECT tree_id, name, type, size, coalesce(array_to_string(content, ','), 'none') AS content, subtree FROM nodes")
def s6_tree_json(v: Virtual) -> DataFrame:
    n = v.nodes().select("tree_id", "name", "type", "size", "content", "subtree", "links", "inode")
    docs = n.groupBy("tree_id").agg(F.to_json(F.struct(F.collect_list(F.struct("name", "type", "size", "content", "subtree", "links", "inode")).alias("nodes"))).alias("data"))
    return readers.tree_nodes(docs).select("tree_id", "name", "type", "size", F.coalesce(F.array_join("content", ","), F.lit("none")).alias("content"), "subtree")


@query('SELECT pack_id, blob_type, blob_id, CAST(sum(length) OVER (PARTITION BY pack_id ORDER BY blob_type, blob_id) - length AS BIGINT) AS "offset", length, uncompressed_length FROM index_blobs')
def s7_index_json(v: Virtual) -> DataFrame:
    i = ingest.pack_layout(v.index_blobs(), ("blob_type", "blob_id"))
    twice = writers.index_files(i).select("id", F.explode(F.array("data", "data")).alias("j"))
    raw = twice.select("id", F.from_json("j", readers.INDEX_JSON).alias("d")).select("id", "d.packs")
    return readers.master_index(readers.index_rows(raw))


@query("SELECT pack_id, blob_id, CAST(sum(length) OVER (PARTITION BY pack_id ORDER BY blob_type, blob_id) - length AS BIGINT) AS \"offset\" FROM index_blobs")
def s10_pack_offsets(v: Virtual) -> DataFrame:
    return ingest.pack_layout(v.index_blobs().withColumn("pos", F.struct("blob_type", "blob_id"))).select("pack_id", "blob_id", "offset")


@query("""WITH l AS (SELECT pack_id, blob_id, CAST(sum(length) OVER (PARTITION BY pack_id ORDER BY blob_type, blob_id) - length AS BIGINT) AS o, length FROM index_blobs), w AS (SELECT * FROM l WHERE CAST(substr(blob_id, 2) AS BIGINT) % 4 = 0 AND blob_id LIKE 'b%'),
    g AS (SELECT *, lag(o + length) OVER (PARTITION BY pack_id ORDER BY o) AS before FROM w), r AS (SELECT *, sum(CASE WHEN before IS NULL OR o - before > 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY pack_id ORDER BY o) AS run FROM g)
    SELECT pack_id, min(o) AS "offset", max(o + length) - min(o) AS length, count(*) AS blobs FROM r GROUP BY pack_id, run""")
def s12_coalesced_reads(v: Virtual) -> DataFrame:
    laid = ingest.pack_layout(v.index_blobs().withColumn("pos", F.struct("blob_type", "blob_id")))
    wanted = laid.where(F.col("blob_id").startswith("b") & (F.substring("blob_id", 2, 20).try_cast("long") % 4 == 0))
    return ingest.coalesce_ranges(wanted, gap=3000)


_FAULTY = {"faulty": "SELECT *, CASE WHEN blob_type = 'data' AND CAST(substr(blob_id, 2) AS BIGINT) % 97 = 0 THEN 'i9' ELSE index_id END AS other FROM index_blobs"}


@query("""SELECT pack_id, 'incomplete' AS finding FROM index_blobs WHERE pack_id LIKE 'p%' AND CAST(substr(pack_id, 2) AS BIGINT) % 9 = 0 GROUP BY pack_id HAVING max(CASE WHEN CAST(substr(blob_id, 2) AS BIGINT) % 3 <> 0 THEN 1 ELSE 0 END) = 1 AND min(CAST(substr(blob_id, 2) AS BIGINT) % 3) = 0
    UNION ALL SELECT pack_id, 'several indexes' FROM index_blobs WHERE pack_id LIKE 'p%' AND CAST(substr(pack_id, 2) AS BIGINT) % 9 = 0 GROUP BY pack_id HAVING min(CAST(substr(blob_id, 2) AS BIGINT) % 3) = 0""")
def c1_c3_index_findings(v: Virtual) -> DataFrame:
    i = v.index_blobs()
    n = lambda c: F.substring(c, 2, 20).try_cast("long")
    more = i.where(F.col("pack_id").startswith("p") & (n("pack_id") % 9 == 0) & (n("blob_id") % 3 == 0)).withColumn("index_id", F.lit("extra"))
    return check.index_findings(i.union(more))


@query("""SELECT coalesce(w.pack_id, p.pack_id) AS pack_id, CASE WHEN p.size IS NULL THEN 'missing' WHEN w.size IS NULL THEN 'orphaned' ELSE 'truncated' END AS finding, w.size AS expected, CAST(p.size AS BIGINT) AS found
    FROM pack_sizes w FULL JOIN packs p USING (pack_id) WHERE p.size IS DISTINCT FROM w.size""")
def c4_pack_findings(v: Virtual) -> DataFrame:
    return check.pack_findings(v.index_blobs(), v.packs())


@query("""WITH f AS (SELECT * FROM nodes WHERE type <> 'dir' AND tree_id IN (SELECT subtree FROM nodes WHERE type = 'dir' AND name NOT LIKE 'Customer%7' AND name NOT LIKE 'Customer%8'))
    SELECT tree_id, name, 'blob not in index' AS finding FROM (SELECT tree_id, name, unnest(content) AS blob_id FROM f WHERE type = 'file' AND size <= 250) WHERE CAST(substr(blob_id, 2) AS BIGINT) % 97 = 0
    UNION ALL SELECT tree_id, name, 'invalid type' FROM f WHERE type = 'symlink' AND name LIKE '%p'
    UNION ALL SELECT tree_id, name, 'no content' FROM f WHERE type = 'file' AND size > 250
    UNION ALL SELECT tree_id, name, 'no subtree' FROM nodes WHERE type = 'dir' AND name LIKE 'Customer%7'
    UNION ALL SELECT tree_id, name, 'null subtree' FROM nodes WHERE type = 'dir' AND name LIKE 'Customer%8'
    UNION ALL SELECT subtree, NULL, 'tree not in index' FROM nodes WHERE subtree LIKE 'c%' AND CAST(substr(subtree, 2) AS BIGINT) % 101 = 0 AND name NOT LIKE 'Customer%7' AND name NOT LIKE 'Customer%8'
    UNION ALL SELECT repeat('0', 64), NULL, 'tree not in index'""")
def c5_tree_findings(v: Virtual) -> DataFrame:
    """Without the contents of big files, and with faults in some types, subtrees, and rows of the index.

    What lies below a folder without a subtree isn't reached.
    """
    n = lambda c: F.substring(c, 2, 20).try_cast("long")
    i = v.index_blobs().where(~F.coalesce((n("blob_id") % F.when(F.col("blob_type") == "data", 97).when(F.col("blob_id").startswith("c"), 101)) == 0, F.lit(False)))
    bad = v.nodes().withColumns({
        "content": F.when((F.col("type") == "file") & (F.col("size") > 250), F.lit(None)).otherwise(F.col("content")),
        "type": F.when((F.col("type") == "symlink") & F.col("name").endswith("p"), "odd").otherwise(F.col("type")),
        "subtree": F.when(F.col("name").like("Customer%7"), F.lit(None)).when(F.col("name").like("Customer%8"), F.lit(check.NULL_ID)).otherwise(F.col("subtree")),
    })
    return check.tree_findings(v.spark.createDataFrame([("root",)], "tree_id string"), bad, i)


@query("SELECT DISTINCT blob_type, blob_id FROM index_blobs WHERE (blob_type, blob_id) NOT IN (SELECT (blob_type, blob_id) FROM used)", **_USED)
def c6_unused_blobs(v: Virtual) -> DataFrame:
    return check.unused_blobs(v.index_blobs(), tree.used_blobs(_roots(v), v.stored_nodes()))


@query("SELECT blob_type, blob_id FROM (SELECT 'data' AS blob_type, sha256(coalesce(text, '')) AS blob_id FROM documents WHERE doc_id % 10 = 3)")
def c7_data_findings(v: Virtual) -> DataFrame:
    d = v.table("documents")
    text = F.coalesce("text", F.lit(""))
    rows = d.select(F.lit("data").alias("blob_type"), F.sha2(text, 256).alias("blob_id"), F.encode(F.when(F.col("doc_id") % 10 == 3, F.concat(text, F.lit("!"))).otherwise(text), "UTF-8").alias("data"))
    return check.data_findings(rows)


@query("SELECT id FROM (SELECT sha256('pack' || p_partkey) AS id FROM part) WHERE CAST('0x' || substr(id, 1, 2) AS INTEGER) % 7 = 2")
def c8_pack_bucket(v: Virtual) -> DataFrame:
    ids = v.table("part").select(F.sha2(F.concat(F.lit("pack"), F.col("p_partkey").cast("string")), 256).alias("id"))
    return ids.where(check.pack_bucket(F.col("id"), 3, 7))


_STATES = {
    "marked": "SELECT i.pack_id, blob_type, blob_id, length, uncompressed_length, (blob_type, blob_id) IN (SELECT (blob_type, blob_id) FROM used) AS needed, count(*) OVER (PARTITION BY blob_type, blob_id) AS copies FROM index_blobs i",
    # blob by blob: the first copy in a pack that takes it, or the last one, whose pack takes copies from then on
    "takers": "SELECT coalesce(list(pack_id), []) AS takers FROM (SELECT pack_id FROM marked GROUP BY pack_id HAVING count(*) FILTER (needed AND copies = 1) > 0 OR count(*) FILTER (NOT needed) = 0)",
    "several": "MATERIALIZED SELECT blob_type, blob_id, list(pack_id ORDER BY pack_id) AS places, row_number() OVER (ORDER BY blob_type, blob_id) AS nr FROM marked WHERE needed AND copies > 1 GROUP BY blob_type, blob_id",
    "choice": """SELECT CAST(0 AS BIGINT) AS nr, takers AS taking, CAST(NULL AS VARCHAR) AS pack_id, CAST(NULL AS VARCHAR) AS blob_type, CAST(NULL AS VARCHAR) AS blob_id FROM takers
        UNION ALL SELECT nr, CASE WHEN hit IS NULL THEN list_append(taking, places[-1]) ELSE taking END, coalesce(hit, places[-1]), blob_type, blob_id
        FROM (SELECT s.nr, s.places, s.blob_type, s.blob_id, taking, list_filter(s.places, lambda x: list_contains(taking, x))[1] AS hit FROM choice c JOIN several s ON s.nr = c.nr + 1)""",
    "classified": "SELECT m.*, CASE WHEN NOT needed THEN 'unused' WHEN copies = 1 OR c.pack_id IS NOT NULL THEN 'used' ELSE 'duplicate' END AS state FROM marked m LEFT JOIN (SELECT blob_type, blob_id, pack_id FROM choice WHERE nr > 0) c ON m.blob_type = c.blob_type AND m.blob_id = c.blob_id AND m.pack_id = c.pack_id",
    "infos": """SELECT pack_id, CASE WHEN min(blob_type) = max(blob_type) THEN min(blob_type) ELSE 'mixed' END AS pack_type, count(*) FILTER (state = 'used') AS used_blobs, count(*) FILTER (state = 'duplicate') AS duplicate_blobs, count(*) FILTER (state = 'unused') AS unused_blobs,
        CAST(36 + coalesce(sum(n) FILTER (state = 'used'), 0) AS BIGINT) AS used_size, CAST(coalesce(sum(n) FILTER (state = 'duplicate'), 0) AS BIGINT) AS duplicate_size, CAST(coalesce(sum(n) FILTER (state = 'unused'), 0) AS BIGINT) AS unused_size, bool_or(uncompressed_length = 0) AS plain
        FROM (SELECT *, length + CASE WHEN uncompressed_length > 0 THEN 41 ELSE 37 END AS n FROM classified) GROUP BY pack_id""",
}
_CLASSIFIED = _USED | _STATES
#: What one nation uses, so that packs have much that is unused.
_NATION = _USED | _STATES | {"used_trees": "SELECT 'n1' AS tree_id UNION ALL SELECT n.subtree FROM used_trees u JOIN nodes n ON n.tree_id = u.tree_id WHERE n.subtree IS NOT NULL"}


def _nation_used(v: Virtual) -> DataFrame:
    return tree.used_blobs(v.spark.createDataFrame([("n1",)], "tree_id string"), v.stored_nodes())


def _classified(v: Virtual) -> DataFrame:
    return prune.classify(v.index_blobs(), tree.used_blobs(_roots(v), v.stored_nodes()))


@query("SELECT pack_id, blob_type, blob_id, state FROM classified", **_CLASSIFIED)
def gc1_gc4_classify(v: Virtual) -> DataFrame:
    return _classified(v).select("pack_id", "blob_type", "blob_id", "state")


@query("SELECT pack_id, blob_type, blob_id, state FROM classified", **_NATION)
def gc4_choice_of_copies(v: Virtual) -> DataFrame:
    return prune.classify(v.index_blobs(), _nation_used(v)).select("pack_id", "blob_type", "blob_id", "state")


@query("SELECT * FROM infos", **_CLASSIFIED)
def gc3_pack_infos(v: Virtual) -> DataFrame:
    return prune.pack_infos(_classified(v))


@query(
    """SELECT coalesce(i.pack_id, p.pack_id) AS pack_id, CASE WHEN pack_type IS NULL THEN 'unindexed' WHEN size IS NULL THEN CASE WHEN used_blobs > 0 THEN 'missing' ELSE 'ignore' END WHEN used_blobs > 0 AND size <> used_size + duplicate_size + unused_size THEN 'damaged'
        WHEN used_blobs = 0 THEN 'remove' WHEN unused_blobs = 0 AND duplicate_blobs = 0 AND pack_type <> 'mixed' THEN 'keep' ELSE 'candidate' END AS decision FROM infos i FULL JOIN packs p ON i.pack_id = p.pack_id""",
    **_CLASSIFIED,
)
def gc5_gc7_decide(v: Virtual) -> DataFrame:
    return prune.decide(prune.pack_infos(_classified(v)), v.packs()).select("pack_id", "decision")


@query("SELECT action, count(*) AS packs, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT size, CASE WHEN used_blobs = 0 THEN 'remove' WHEN unused_blobs = 0 AND duplicate_blobs = 0 THEN 'keep' ELSE 'repack' END AS action FROM infos JOIN pack_sizes USING (pack_id)) GROUP BY action", **_CLASSIFIED)
def gc9_gc11_plan_totals(v: Virtual) -> DataFrame:
    planned = prune.plan(v.index_blobs(), tree.used_blobs(_roots(v), v.stored_nodes()), stats.pack_sizes(v.index_blobs()), prune.Options(max_unused=0))
    return prune.totals(planned).select("action", "packs", "bytes")


@query("SELECT blob_type, blob_id FROM used WHERE (blob_type, blob_id) NOT IN (SELECT (blob_type, blob_id) FROM classified JOIN infos USING (pack_id) WHERE used_blobs > 0 AND unused_blobs = 0 AND duplicate_blobs = 0)", **_CLASSIFIED)
def gc12_blobs_to_repack(v: Virtual) -> DataFrame:
    used = tree.used_blobs(_roots(v), v.stored_nodes()).checkpoint()
    planned = prune.plan(v.index_blobs(), used, stats.pack_sizes(v.index_blobs()), prune.Options(max_unused=0))
    return prune.blobs_to_copy(prune.classify(v.index_blobs(), used), planned)


def _planned(options: str, most: str, least_unused: str, must: str = "pack_type <> 'data'", small: str = "false", keep: str = "false") -> dict[str, str]:
    """Views of a plan: decisions, candidates in order, and the choice among them under a budget of ``most`` bytes."""
    return {
        "decided": f"""SELECT i.*, s.size, {small} AS small, CASE WHEN used_blobs = 0 THEN 'remove' WHEN {keep} THEN 'keep' WHEN unused_blobs = 0 AND duplicate_blobs = 0 AND pack_type <> 'mixed' AND NOT ({options}) THEN 'keep' ELSE 'candidate' END AS decision
            FROM infos i JOIN pack_sizes s USING (pack_id)""",
        "candidates": "MATERIALIZED SELECT *, row_number() OVER (ORDER BY pack_type = 'data', small DESC, (unused_size + duplicate_size) / used_size DESC, pack_id) AS nr FROM decided WHERE decision = 'candidate'",
        "chosen": f"""SELECT CAST(0 AS BIGINT) AS nr, CAST(0 AS BIGINT) AS done, CAST((SELECT coalesce(sum(unused_size + duplicate_size), 0) FROM decided WHERE decision <> 'remove') AS BIGINT) AS waste, CAST(NULL AS VARCHAR) AS pack_id, false AS taken
            UNION ALL SELECT nr, CASE WHEN take THEN done + size ELSE done END, CASE WHEN take THEN waste - unused_size - duplicate_size ELSE waste END, pack_id, take
            FROM (SELECT c.*, h.done, h.waste, h.done + c.size < {most} AND ({must} OR small OR h.waste >= (SELECT CAST({least_unused} AS DOUBLE) FROM decided WHERE decision <> 'remove')) AS take FROM chosen h JOIN candidates c ON c.nr = h.nr + 1)""",
        "plan": "SELECT d.pack_id, CASE WHEN c.taken THEN 'repack' WHEN decision = 'candidate' THEN 'keep' ELSE decision END AS action FROM decided d LEFT JOIN chosen c ON d.pack_id = c.pack_id",
    }


_STEPS = "SELECT CASE action WHEN 'repack' THEN 2 ELSE 4 END AS step, action, pack_id FROM plan WHERE action IN ('repack', 'remove')"
_BUDGET = _planned("false", "300000", "coalesce(sum(used_size), 0) / 9")


@query(_STEPS, **_NATION, **_BUDGET)
def gc9_gc13_budgeted_plan(v: Virtual) -> DataFrame:
    """Ordered steps under a repack budget and a tenth of waste."""
    return prune.steps(prune.plan(v.index_blobs(), _nation_used(v), stats.pack_sizes(v.index_blobs()), prune.Options(max_unused="10%", max_repack=300_000)))


@query(_STEPS, **_NATION, **_planned("plain", "1e18", "max(1e18)", must="pack_type <> 'data' OR plain"))
def gc7_gc8_recompress(v: Virtual) -> DataFrame:
    """Only packs with uncompressed blobs and tree packs are repacked, whatever they waste."""
    return prune.steps(prune.plan(v.index_blobs(), _nation_used(v), stats.pack_sizes(v.index_blobs()), prune.Options(max_unused=None, repack_uncompressed=True)))


_TEN_SMALL = "s.size < 20000 AND (SELECT count(*) FROM infos JOIN pack_sizes USING (pack_id) WHERE size < 20000 AND used_blobs > 0 AND unused_blobs = 0 AND duplicate_blobs = 0 AND pack_type <> 'mixed') >= 10"


@query(_STEPS, **_CLASSIFIED, **_planned(_TEN_SMALL, "1e18", "max(0)", small="size < 20000"))
def gc2_gc7_small_packs(v: Virtual) -> DataFrame:
    """Packs under 20,000 bytes are repacked too, if ten or more could stay otherwise."""
    used = tree.used_blobs(_roots(v), v.stored_nodes())
    return prune.steps(prune.plan(v.index_blobs(), used, stats.pack_sizes(v.index_blobs()), prune.Options(max_unused=0, repack_small=True, smallest=20_000)))


@query("SELECT action, count(*) AS packs FROM plan GROUP BY action", **_NATION, **_planned("false", "1e18", "max(0)", keep="pack_type = 'data'"))
def gc7_cacheable_only(v: Virtual) -> DataFrame:
    planned = prune.plan(v.index_blobs(), _nation_used(v), stats.pack_sizes(v.index_blobs()), prune.Options(max_unused=0, cacheable_only=True))
    return prune.totals(planned).select("action", "packs")


_PACKED = """n AS (SELECT CAST(greatest(1, ceil(sum(length) / 96000.0)) AS BIGINT) AS n FROM b), s AS (SELECT b.*, length >= 1500 AS own, CAST('0x' || substr(sha256(blob_id), 1, 8) AS BIGINT) % n AS shard FROM b, n),
    c AS (SELECT *, CASE WHEN own THEN blob_id ELSE CAST((sum(length) OVER (PARTITION BY blob_type, own, shard ORDER BY blob_id) - length) // 1500 AS VARCHAR) END AS k FROM s)
    SELECT blob_type, blob_id, length, CAST(sum(length) OVER (w ORDER BY blob_id) - length AS BIGINT) AS "offset", min(blob_id) OVER w AS first_blob, count(*) OVER w AS blobs FROM c WINDOW w AS (PARTITION BY blob_type, own, shard, k)"""


def _packed(assembled: DataFrame) -> DataFrame:
    """Packs by their first blob and number of blobs."""
    from pyspark.sql import Window

    pack = Window.partitionBy("pack_id")
    return assembled.select("blob_type", "blob_id", "length", "offset", F.min("blob_id").over(pack).alias("first_blob"), F.count("*").over(pack).alias("blobs"))


@query("""WITH lost AS (SELECT blob_type, blob_id FROM classified WHERE state <> 'unused' EXCEPT SELECT blob_type, blob_id FROM classified JOIN plan USING (pack_id) WHERE action = 'keep'),
    b AS (SELECT blob_type, blob_id, arg_min(length, (CASE WHEN action = 'repack' THEN 0 ELSE 1 END, pack_id)) AS length FROM classified JOIN plan USING (pack_id) JOIN lost USING (blob_type, blob_id) GROUP BY ALL),
    """ + _PACKED, **_NATION, **_BUDGET)  # fmt: skip
def gc14_repack(v: Virtual) -> DataFrame:
    used = _nation_used(v).checkpoint()
    planned = prune.plan(v.index_blobs(), used, stats.pack_sizes(v.index_blobs()), prune.Options(max_unused="10%", max_repack=300_000))
    return _packed(prune.repack(prune.classify(v.index_blobs(), used).checkpoint(), planned.checkpoint(), pack_size=1500))


@query("""WITH redo AS (SELECT index_id FROM index_blobs GROUP BY index_id HAVING count(*) < 5000 OR count(*) FILTER (pack_id IN ('p1', 'p2', 't3')) > 0),
    rest AS (SELECT DISTINCT * EXCLUDE index_id FROM index_blobs WHERE index_id IN (FROM redo) AND pack_id NOT IN ('p1', 'p2', 't3')), n AS (SELECT CAST(greatest(1, ceil(count(*) / 5000.0)) AS BIGINT) AS n FROM rest)
    SELECT index_id, pack_id, blob_type, blob_id, length FROM index_blobs WHERE index_id NOT IN (FROM redo)
    UNION ALL SELECT 'new-' || CAST('0x' || substr(sha256(pack_id), 1, 8) AS BIGINT) % n, pack_id, blob_type, blob_id, length FROM rest, n""")
def gc16_rewrite_index(v: Virtual) -> DataFrame:
    gone = v.spark.createDataFrame([("p1",), ("p2",), ("t3",)], "pack_id string")
    return prune.rewrite_index(v.index_blobs(), gone, full=5000).select("index_id", "pack_id", "blob_type", "blob_id", "length")


@query("SELECT coalesce(w.pack_id, p.pack_id) AS pack_id, CASE WHEN p.size IS NULL THEN 'drop' WHEN w.size = p.size THEN 'keep' ELSE 'read' END AS action FROM pack_sizes w FULL JOIN packs p USING (pack_id)")
def m4_repair_index(v: Virtual) -> DataFrame:
    return rewrite.repair_index(v.index_blobs(), v.packs())


@query(f"""WITH i AS (SELECT 'b' || p_partkey AS blob_id, CASE WHEN p_partkey % 3 = 0 THEN 68 + CAST(p_size AS BIGINT) * 37 ELSE 150 + CAST(p_size AS BIGINT) * 80 END AS plain FROM part WHERE p_partkey % 97 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem)),
    e AS (SELECT tree_id, name, unnest(content) AS blob_id, generate_subscripts(content, 1) AS p FROM nodes WHERE type = 'file'),
    l AS (SELECT tree_id, name, string_agg(CASE WHEN plain IS NOT NULL THEN blob_id END, ',' ORDER BY p) AS content, CAST(coalesce(sum(plain), 0) AS BIGINT) AS size, count(*) FILTER (plain IS NULL) AS lost FROM e LEFT JOIN i USING (blob_id) GROUP BY ALL)
    SELECT n.tree_id, n.name, coalesce(l.lost, 0) > 0 AS repaired, CASE WHEN l.lost > 0 THEN l.size ELSE n.size END AS size, CASE WHEN l.lost > 0 THEN coalesce(l.content, '') ELSE coalesce(array_to_string(n.content, ','), '') END AS content
    FROM nodes n LEFT JOIN l ON n.tree_id = l.tree_id AND n.name = l.name""")
def m3_repair_nodes(v: Virtual) -> DataFrame:
    i = v.index_blobs().where(~((F.col("blob_type") == "data") & (F.substring("blob_id", 2, 20).try_cast("long") % 97 == 0)))
    return rewrite.repair_nodes(v.nodes(), i).select("tree_id", "name", "repaired", "size", F.coalesce(F.array_join("content", ","), F.lit("")).alias("content"))


@query("SELECT substr(blob_id, 1, 8) AS name, blob_id AS subtree FROM index_blobs WHERE blob_type = 'tree' AND blob_id NOT IN (SELECT subtree FROM nodes WHERE subtree IS NOT NULL AND tree_id <> 'root') AND blob_id <> 'root'")
def m6_recover(v: Virtual) -> DataFrame:
    lone = v.nodes().where("tree_id <> 'root'")
    return rewrite.recover(v.index_blobs(), lone, v.root_snapshots().where("id = 'all'")).select("name", "subtree")


@query(f"SELECT snapshot_id, path FROM walk WHERE NOT regexp_matches(path, '(^|/)[^/]*3(/.*)?$') AND NOT ({_NAME} LIKE '%.o')")
def m1_rewrite_exclude(v: Virtual) -> DataFrame:
    w = tree.walk(v.root_snapshots(), v.stored_nodes())
    return rewrite.rewrite_entries(w, exclude=glob.matches_list(F.col("path"), ["*3", "*.o"])).select("snapshot_id", "path")


@query("""WITH k AS (SELECT snapshot_id, path FROM walk WHERE name LIKE '%7.p'), p AS (SELECT DISTINCT snapshot_id, array_to_string(string_split(path, '/')[1:i], '/') AS path FROM k, unnest(range(2, len(string_split(path, '/')) + 1)) AS u(i)) SELECT * FROM p""")
def m2_rewrite_include(v: Virtual) -> DataFrame:
    w = tree.walk(v.root_snapshots(), v.stored_nodes())
    return rewrite.rewrite_entries(w, include=F.col("name").like("%7.p")).select("snapshot_id", "path")


@query("""WITH a AS (SELECT snapshot_id, count(*) AS n FROM walk GROUP BY 1), b AS (SELECT snapshot_id, count(*) AS n, count(*) FILTER (type = 'file') AS files, CAST(coalesce(sum(size) FILTER (type = 'file'), 0) AS BIGINT) AS bytes FROM walk WHERE NOT starts_with(path || '/', (SELECT '/' || min(n_name) || '/' FROM nation WHERE n_regionkey = 1)) AND NOT contains(path || '/', (SELECT '/' || min(n_name) || '/' FROM nation WHERE n_regionkey = 1)) GROUP BY 1)
    SELECT id, CASE WHEN a.n = coalesce(b.n, 0) THEN 'unchanged' WHEN coalesce(b.n, 0) = 0 THEN 'remove' ELSE 'rewrite' END AS action, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes FROM root_snapshots LEFT JOIN a ON id = a.snapshot_id LEFT JOIN b ON id = b.snapshot_id""")
def m2_rewrite_snapshots(v: Virtual) -> DataFrame:
    name = v.table("nation").where("n_regionkey = 1").agg(F.min("n_name")).first()[0]
    w = tree.walk(v.root_snapshots(), v.stored_nodes())
    kept = rewrite.rewrite_entries(w, exclude=F.col("name") == name)
    return rewrite.rewrite_snapshots(v.root_snapshots(), w, kept).select("id", "action", "files", "bytes")


def _hashes(level: str, below: str) -> str:
    """Ids of the trees one level up, of folders whose own ids are in ``below``."""
    line = """'{"name":"' || n.name || '","type":"dir"' || coalesce(',"subtree":"' || h.id || '"', '') || '}'"""
    return f"SELECT tree_id, sha256(string_agg({line}, chr(10) ORDER BY {line})) AS id FROM nodes n LEFT JOIN {below} h USING (subtree) WHERE tree_id LIKE '{level}' AND type = 'dir' GROUP BY tree_id"


_FILE_LINE = """'{"name":"' || name || '","type":"' || type || '"' || CASE WHEN type = 'file' THEN ',"size":' || size ELSE '' END || CASE WHEN content IS NULL THEN '' WHEN len(content) = 0 THEN ',"content":[]' ELSE ',"content":["' || array_to_string(content, '","') || '"]' END || '}'"""


@query(
    "SELECT w.snapshot_id, w.path, count(*) AS entries, any_value(t.id) AS tree_id FROM (SELECT snapshot_id, CASE WHEN depth = 1 THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS path, tree_id FROM walk) w JOIN hashes t USING (tree_id) GROUP BY w.snapshot_id, w.path",
    hc=f"SELECT tree_id AS subtree, sha256(string_agg({_FILE_LINE}, chr(10) ORDER BY {_FILE_LINE})) AS id FROM nodes WHERE tree_id LIKE 'c%' GROUP BY tree_id",
    hn=f"SELECT tree_id AS subtree, id FROM ({_hashes('n%', 'hc')})",
    hr=f"SELECT tree_id AS subtree, id FROM ({_hashes('r_', 'hn')})",
    hashes=f"SELECT subtree AS tree_id, id FROM hc UNION ALL SELECT subtree, id FROM hn UNION ALL SELECT subtree, id FROM hr UNION ALL {_hashes('root', 'hr')}",
)
def x7_assemble_trees(v: Virtual) -> DataFrame:
    return rewrite.assemble_trees(tree.walk(v.root_snapshots(), v.stored_nodes())).select("snapshot_id", "path", "entries", "tree_id")


def _backups(v: Virtual) -> DataFrame:
    """Both versions by name, which is unique in them; a folder is changed if its subtree is."""
    old, new = (df.withColumnRenamed("name", "path") for df in _versions(v, _A, _B))
    return ingest.compare_backup(old, new, ["type", "size", "mtime", "inode", "content", "subtree"], ignore_ctime=True)


_FOLDERS = "SELECT name, CASE WHEN subtree IN (FROM changed) THEN 'changed' ELSE 'unmodified' END AS state FROM nodes WHERE type = 'dir'"


@query(
    f"""SELECT b.name AS path, CASE WHEN a.name IS NULL THEN 'new' WHEN a.content IS NOT DISTINCT FROM b.content AND a.size = b.size THEN 'unmodified' ELSE 'changed' END AS state, b.type = 'file' AND (a.name IS NULL OR a.type <> 'file' OR a.size <> b.size) AS read
    FROM bfiles b LEFT JOIN afiles a ON a.o_orderkey = b.o_orderkey UNION ALL SELECT name, state, false FROM ({_FOLDERS})""",
    **_SIDES,
)
def x2_x4_changes(v: Virtual) -> DataFrame:
    return _backups(v).select("path", "state", "read")


@query(
    f"""WITH f AS ({_FOLDERS}), d AS (SELECT CAST(0 AS BIGINT) AS dirs_new, count(*) FILTER (state = 'changed') AS dirs_changed, count(*) FILTER (state = 'unmodified') AS dirs_unmodified FROM f)
    SELECT count(*) FILTER (type = 'file' AND a IS NULL) AS files_new, count(*) FILTER (type = 'file' AND a AND NOT same) AS files_changed, count(*) FILTER (type = 'file' AND a AND same) AS files_unmodified, any_value(dirs_new) AS dirs_new, any_value(dirs_changed) AS dirs_changed, any_value(dirs_unmodified) AS dirs_unmodified,
        CAST(coalesce(sum(size) FILTER (type = 'file' AND (a IS NULL OR differs)), 0) AS BIGINT) AS bytes_read
    FROM d, (SELECT b.type, b.size, CASE WHEN a.name IS NOT NULL THEN true END AS a, a.content IS NOT DISTINCT FROM b.content AND a.size = b.size AS same, a.type <> 'file' OR a.size <> b.size AS differs FROM bfiles b LEFT JOIN afiles a ON a.o_orderkey = b.o_orderkey)""",
    **_SIDES,
)
def a7_backup_summary(v: Virtual) -> DataFrame:
    return ingest.backup_summary(_backups(v))


@query("SELECT name AS path, len(list_filter(content, lambda x: CAST(substr(x, 2) AS BIGINT) % 97 = 0)) = 0 AS complete FROM nodes WHERE type = 'file'")
def x3_reusable_content(v: Virtual) -> DataFrame:
    i = v.index_blobs().where(~F.coalesce((F.col("blob_type") == "data") & (F.substring("blob_id", 2, 20).try_cast("long") % 97 == 0), F.lit(False)))
    files = v.nodes().where("type = 'file'").select(F.col("name").alias("path"), "content")
    return ingest.reusable(files, i).select("path", "complete")


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS blob_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 4 = 0)")
def k1_x6_new_blobs(v: Virtual) -> DataFrame:
    blobs = v.table("documents").select(F.lit("data").alias("blob_type"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob_id"), "doc_id")
    return ingest.new_blobs(blobs.drop("doc_id"), blobs.where("doc_id % 4 = 0")).select("blob_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS sha, true AS in_limits FROM documents")
def x5_chunks(v: Virtual) -> DataFrame:
    """Each document put together again from its chunks, as their ids name them (cut points aren't expressible in SQL).

    in_limits: no chunk is longer than the most, and all but the last are as long as the least.
    """
    files = v.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    cut = ingest.chunk(files, least=512, average_bits=10, most=8192).checkpoint()
    store = cut.join(files, "path").select("blob_id", F.expr("substring(data, CAST(start + 1 AS INT), CAST(length AS INT))").alias("data")).where(F.sha2("data", 256) == F.col("blob_id"))
    whole = cut.groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "blob_id"))), lambda x: x.blob_id).alias("content"),
        F.sum("length").alias("bytes"), F.max("length").alias("most"), F.max(F.struct("pos", "length")).alias("last"), F.count_if(F.col("length") < 512).alias("short"),
    )
    rows = files.select("path").join(whole, "path", "left").withColumn("content", F.coalesce("content", F.array().cast("array<string>")))
    in_limits = F.coalesce((F.col("most") <= 8192) & (F.col("short") <= (F.col("last.length") < 512).cast("int")), F.lit(True))
    made = ingest.dump_file(rows, store).select("path", F.sha2("data", 256).alias("sha"))
    return rows.join(made, "path").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"), "sha", in_limits.alias("in_limits"))


@query("WITH b AS (SELECT DISTINCT blob_type, blob_id, length FROM index_blobs), " + _PACKED)
def k2_assemble_packs(v: Virtual) -> DataFrame:
    blobs = v.index_blobs().select("blob_type", "blob_id", "length", "uncompressed_length").distinct()
    return _packed(ingest.assemble_packs(blobs, pack_size=1500))


@query(
    """WITH f AS (SELECT * FROM walk WHERE type = 'file' AND (links = 1 OR inode = 0) UNION ALL SELECT * EXCLUDE nr FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, inode, device_id ORDER BY path) AS nr FROM walk WHERE type = 'file' AND NOT (links = 1 OR inode = 0)) WHERE nr = 1),
    e AS (SELECT snapshot_id, path, unnest(content) AS blob_id FROM f)
    SELECT snapshot_id, pack_id, min(path) AS first_path, count(DISTINCT path) AS files, count(*) AS blobs, CAST(sum(length) AS BIGINT) AS bytes FROM e JOIN (SELECT * FROM first_copies WHERE blob_type = 'data') USING (blob_id) GROUP BY ALL""",
    **_USED,
)
def x9_restore_plan(v: Virtual) -> DataFrame:
    return ingest.restore_plan(tree.walk(v.root_snapshots(), v.stored_nodes()), v.index_blobs())


@query("SELECT path FROM walk WHERE snapshot_id = 'all' AND (type = 'dir' OR size <= 150)")
def f18_exclude_large(v: Virtual) -> DataFrame:
    return _all(v).where(~ingest.exclude_large(150)).select("path")


@query("""WITH w AS (SELECT * FROM walk WHERE snapshot_id = 'all'), m AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, name AS marker FROM w WHERE type = 'file' AND name = 'o17.f' OR type = 'file' AND name = 'o17.o' OR type = 'file' AND name = 'o17.p')
    SELECT path FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE starts_with(path, folder || '/') AND name <> marker)""")
def f19_exclude_marked(v: Virtual) -> DataFrame:
    w = _all(v)
    name = w.where("name IN ('o17.f', 'o17.o', 'o17.p')").select("name").first()
    return ingest.exclude_marked(w, name[0] if name else "none").select("path")


@query("SELECT path FROM walk WHERE snapshot_id = 'all' AND device_id = 0")
def f20_exclude_devices(v: Virtual) -> DataFrame:
    return ingest.exclude_other_devices(_all(v), [0]).select("path")


@query("SELECT path FROM walk WHERE snapshot_id = 'all' AND NOT regexp_matches(path, '(^|/)[^/]*5(/.*)?$') AND NOT regexp_matches(lower(path), '(^|/)customer#[^/]*1(/.*)?$')")
def f15_f17_exclude(v: Virtual) -> DataFrame:
    return ingest.exclude(_all(v), ["*5"], ["CUSTOMER#*1"]).select("path")


@query("SELECT path, name, CAST(size AS BIGINT) AS asize, CAST((size + 511) // 512 * 512 AS BIGINT) AS dsize, inode, device_id AS dev, links AS nlink, CAST(coalesce(epoch(mtime), 0) AS BIGINT) AS mtime, type <> 'dir' AS notreg FROM walk WHERE snapshot_id = 'all'")
def k11_ncdu(v: Virtual) -> DataFrame:
    return writers.ncdu_rows(_all(v)).drop("snapshot_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '') || coalesce(text, '')) AS sha FROM documents")
def k8_dump_file(v: Virtual) -> DataFrame:
    d = v.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    blob = F.sha2("data", 256)
    files = d.select("path", F.array(blob, blob).alias("content"))
    return ingest.dump_file(files, d.select(blob.alias("blob_id"), "data")).select("path", F.sha2("data", 256).alias("sha"))


@query("SELECT path, CAST(pos - 1 AS INTEGER) AS pos FROM (SELECT name AS path, unnest(content) AS blob_id, generate_subscripts(content, 1) AS pos FROM nodes WHERE type = 'file') WHERE CAST(substr(blob_id, 2) AS BIGINT) % 50 = 0")
def x11_verify(v: Virtual) -> DataFrame:
    n = F.col("p_partkey")
    blob = lambda c: F.sha2(F.concat(F.lit("b"), F.substring(c, 2, 20)), 256)
    files = v.nodes().where("type = 'file'").select(F.col("name").alias("path"), F.transform("content", blob).alias("content"))
    data = v.table("part").where(n % 50 != 0).select(F.sha2(F.concat(F.lit("b"), n.cast("string")), 256).alias("blob_id"), F.encode(F.concat(F.lit("b"), n.cast("string")), "UTF-8").alias("data"))
    return ingest.verify(files, data)


@query("SELECT path FROM walk WHERE snapshot_id = 'all' AND size % 7 = 3 AND path NOT IN (SELECT path FROM walk WHERE snapshot_id = 'all' AND size > 60)")
def x12_unexpected(v: Virtual) -> DataFrame:
    w = _all(v)
    return ingest.unexpected(w.select("path", "size"), w.where("size > 60"), F.col("size") % 7 == 3).select("path")


@query("SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM walk WHERE snapshot_id = 'all' AND type = 'file' AND size > 40")
def a11_surviving_size(v: Virtual) -> DataFrame:
    return stats.surviving_size(_all(v), F.col("size") > 40)


def _with_mode(nodes: DataFrame) -> DataFrame:
    """Mode bits for nodes that have none: from the size."""
    return nodes.withColumn("mode", F.col("size") % 512)


_SHOWN = "CASE type WHEN 'dir' THEN 'd' WHEN 'symlink' THEN 'L' ELSE '-' END || " + " || ".join(f"CASE WHEN (size >> {8 - i}) & 1 = 1 THEN '{'rwx'[i % 3]}' ELSE '-' END" for i in range(9))


@query(f"SELECT snapshot_id, path, {_SHOWN} AS permissions, type, size, mtime, inode, device_id, links, size % 512 AS mode FROM walk WHERE regexp_matches({_NAME}, '^o[0-9]*[02468]\\.[fp]$')")
def f25_found_rows(v: Virtual) -> DataFrame:
    return tree.found_rows(tree.find_paths(v.root_snapshots(), _with_mode(v.stored_nodes()), ["o*[02468].[fp]"]))


@query(f"SELECT snapshot_id, name, type, path, CASE WHEN type = 'file' THEN size END AS size, size % 512 AS mode, {_SHOWN} AS permissions, mtime, inode FROM walk")
def f24_listed_rows(v: Virtual) -> DataFrame:
    return tree.listed_rows(tree.walk(v.root_snapshots(), _with_mode(v.stored_nodes()))).drop("uid", "gid", "atime", "ctime")


@query("SELECT tree_id, name, array_to_string(list_filter(['user.a', 'user.b' || inode % 3, 'security.x', 'system.posix_acl'], lambda x: x LIKE 'user.%' AND x NOT LIKE '%2'), ',') AS attributes FROM nodes")
def f26_select_attributes(v: Virtual) -> DataFrame:
    names = F.array(F.lit("user.a"), F.concat(F.lit("user.b"), (F.col("inode") % 3).cast("string")), F.lit("security.x"), F.lit("system.posix_acl"))
    nodes = v.nodes().withColumn("extended_attributes", F.transform(names, lambda x: F.struct(x.alias("name"), F.encode(x, "UTF-8").alias("value"))))
    kept = select.select_attributes(select.select_attributes(nodes, include=["user.*"]), exclude=["*2"])
    return kept.select("tree_id", "name", F.array_join(F.transform("extended_attributes", lambda x: x["name"]), ",").alias("attributes"))


_TAG_TEXT = "' ' || event_type || ' ,x' || user_id % 3 || ',,\t' || event_type || 'z '"


@query(f"SELECT event_id, array_to_string(t, '|') AS tags, array_to_string(list_filter(t || ['y', ''], lambda x: x <> ''), '|') AS flat FROM (SELECT event_id, list_transform(string_split({_TAG_TEXT}, ','), lambda x: trim(x, ' ' || chr(9))) AS t FROM events)")
def p6_tag_lists(v: Virtual) -> DataFrame:
    own = text.split_tags(F.concat(F.lit(" "), "event_type", F.lit(" ,x"), (F.col("user_id") % 3).cast("string"), F.lit(",,\t"), "event_type", F.lit("z ")))
    rows = v.table("events").select("event_id", own.alias("t"))
    return rows.select("event_id", F.array_join("t", "|").alias("tags"), F.array_join(text.flatten_tags(F.array("t", F.array(F.lit("y"), F.lit("")))), "|").alias("flat"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('minute', t) WHEN 2 THEN t WHEN 3 THEN t - INTERVAL 90 MINUTE WHEN 4 THEN t END AS time
    FROM (SELECT *, o_orderdate + to_minutes(o_orderkey % 1440) + to_seconds(o_orderkey % 60) AS t FROM orders)""")
def z11_parse_times(v: Virtual) -> DataFrame:
    """Texts of six shapes, the last one unknown."""
    t = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"), (F.col("o_orderkey") % 60).cast("decimal(18,6)"))
    shown = lambda p, more="": F.concat(F.date_format("t", p), F.lit(more))
    long = F.concat(F.date_format("t", "EEE MMM d HH:mm:ss"), F.lit(" +0000 GMT "), F.date_format("t", "yyyy"))
    shapes = [shown("yyyy-MM-dd"), shown("dd.MM.yyyy HH:mm"), shown("yyyy-MM-dd HH:mm:ss"), shown("dd.MM.yyyy HH:mm:ss", " +0130"), long, shown("yyyy/MM/dd")]
    rows = v.table("orders").withColumn("t", t)
    return rows.select("o_orderkey", text.parse_time(F.get(F.array(*shapes), (F.col("o_orderkey") % 6).cast("int"))).alias("time"))


@query("""WITH p AS (SELECT o.o_orderkey, arg_max(s.id, (s.time, s.id)) AS parent, arg_max(s.tree, (s.time, s.id)) AS before FROM orders o JOIN order_snapshots s ON s.hostname = 'c' || o.o_custkey AND s.time <= o.o_orderdate + INTERVAL 1 DAY GROUP BY o.o_orderkey)
    SELECT 'c' || o_custkey AS hostname, o_orderdate + INTERVAL 1 DAY AS time, parent, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'c' || o_custkey END AS tree, 64 AS id_length FROM orders JOIN p USING (o_orderkey) WHERE o_orderkey % 2 = 0 OR before IS DISTINCT FROM 'c' || o_custkey""")
def x8_x13_create_snapshots(v: Virtual) -> DataFrame:
    """A backup a day after each order, every other one of the tree its parent has."""
    host = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    requests = v.table("orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("time"), host.alias("hostname"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(host).alias("tree"))
    made = ingest.create_snapshots(requests, v.order_snapshots(), skip_unchanged=True, program="palimpsest")
    return made.select("hostname", "time", "parent", "tree", F.length("id").alias("id_length"))


@query("SELECT sha256(coalesce(text, '')) AS blob_id, CASE WHEN min(doc_id % 15) FILTER (doc_id % 15 <> 0) IS NULL THEN NULL WHEN min(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) = 0 THEN 'a' ELSE 'b' END AS pack_id FROM documents GROUP BY 1")
def s11_load_blobs(v: Virtual) -> DataFrame:
    """Documents stored in two packs, some copies of which are damaged in the first or in both."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = v.table("documents").select("doc_id", F.lit("data").alias("blob_type"), F.sha2(data, 256).alias("blob_id"), data.alias("data"))
    broken = F.concat("data", F.encode(F.lit("!"), "UTF-8"))
    pack = lambda name, n: docs.select(F.lit(name).alias("pack_id"), "blob_type", "blob_id", F.when(F.col("doc_id") % n == 0, broken).otherwise(F.col("data")).alias("data"))
    stored = pack("a", 3).union(pack("b", 15))
    wanted = docs.select("blob_type", "blob_id").distinct()
    return ingest.load_blobs(wanted, stored.select("pack_id", "blob_type", "blob_id"), stored).select("blob_id", "pack_id")


@query("SELECT id, 'rewrite' AS action, count(*) FILTER (type = 'file') AS files, 'elsewhere' AS hostname, TIMESTAMP '2024-05-06 07:08:00' AS time FROM root_snapshots JOIN walk ON id = snapshot_id GROUP BY id")
def m2_rewrite_metadata(v: Virtual) -> DataFrame:
    w = tree.walk(v.root_snapshots(), v.stored_nodes())
    return rewrite.rewrite_snapshots(v.root_snapshots(), w, w, hostname="elsewhere", time="2024-05-06 07:08").select("id", "action", "files", "hostname", "time")


@query("SELECT DISTINCT blob_type, blob_id FROM used", **(_USED | {"used_trees": "SELECT tree AS tree_id FROM root_snapshots WHERE id NOT IN ('all', 'region0', 'region3') UNION SELECT n.subtree FROM used_trees u JOIN nodes n ON n.tree_id = u.tree_id WHERE n.subtree IS NOT NULL"}))
def gc15_used_without_ignored(v: Virtual) -> DataFrame:
    ignore = v.spark.createDataFrame([("all",), ("region0",), ("region3",)], "id string")
    return tree.used_by_snapshots(v.root_snapshots(), v.stored_nodes(), ignore)


@query("SELECT depth, path, size FROM (SELECT depth, path, size, row_number() OVER (ORDER BY size DESC, string_split(path, '/')) AS nr FROM walk WHERE snapshot_id = 'all') WHERE nr <= 20")
def g7_sorted_top(v: Virtual) -> DataFrame:
    return select.sort_entries(_all(v), "size", reverse=True).limit(20).select("depth", "path", "size")
