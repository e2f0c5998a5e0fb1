"""Trees of directory nodes: walks, reachability, lookup by path, listings and joins.

The tables are snapshots(id, tree) and nodes(tree_id, name, type, content, subtree, ...). A walk goes
down level by level with one equi-join a level, over directories only; each level is checkpointed, so the lineage does
not grow with the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.glob import child_may_match_list, matches_list
from palimpsest.functions.scalar import join_path, parent_path, permissions, within_directory
from palimpsest.functions.text import required_time
from palimpsest.model import RepositoryError, with_checkpoints


def walk(snapshots: DataFrame, nodes: DataFrame, descend: Column | None = None) -> DataFrame:
    """Every node under each snapshot's root: snapshot_id, path, depth and the node's columns.

    ``descend`` (over path and the node's columns) tells which directories are gone into; that
    is where pruning belongs, as a filter on the result doesn't reach the levels above.
    Only directories are gone through level by level; all nodes join them once, at the end.
    """
    with_checkpoints(nodes.sparkSession)
    edges = nodes.where("type = 'dir' AND subtree IS NOT NULL")
    edges = edges.select("tree_id", "name", "subtree") if descend is None else edges
    front = snapshots.select(F.col("id").alias("snapshot_id"), F.col("tree").alias("at"), F.lit("/").alias("up"), F.lit(1).alias("depth"))
    folders = front
    while True:
        below = front.join(edges, F.col("at") == F.col("tree_id")).withColumn("path", join_path(F.col("up"), F.col("name")))
        below = below if descend is None else below.where(descend)
        front = below.select("snapshot_id", F.col("subtree").alias("at"), F.col("path").alias("up"), (F.col("depth") + 1).alias("depth")).checkpoint()
        if front.isEmpty():
            break
        folders = folders.union(front)
    path = join_path(F.col("up"), F.col("name")).alias("path")
    return folders.join(nodes, F.col("at") == F.col("tree_id")).select("snapshot_id", path, "depth", *nodes.columns)


def reachable_trees(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree_id) of every different tree that roots(tree_id) reach, each once however often it is shared.

    Each level is written once; trees seen before are looked up in all levels so far.
    """
    with_checkpoints(nodes.sparkSession)
    edges = nodes.where("subtree IS NOT NULL").select(F.col("tree_id").alias("up"), F.col("subtree").alias("tree_id")).distinct().checkpoint()
    seen = front = roots.select("tree_id").where("tree_id IS NOT NULL").distinct().checkpoint()
    while True:
        below = edges.join(front.withColumnRenamed("tree_id", "up"), "up", "left_semi").select("tree_id").distinct()
        front = below.join(seen, "tree_id", "left_anti").checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def used_blobs(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(blob_type, blob_id): all reachable trees, and the contents of their files."""
    trees = reachable_trees(roots, nodes)
    files = nodes.join(trees, "tree_id", "left_semi").where("type = 'file'").select(F.explode("content").alias("blob_id")).distinct()
    return trees.select(F.lit("tree").alias("blob_type"), F.col("tree_id").alias("blob_id")).union(files.select(F.lit("data").alias("blob_type"), "blob_id"))


def used_by_snapshots(snapshots: DataFrame, nodes: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """``used_blobs`` of all snapshots(id, tree) but those of ignore(id)."""
    kept = snapshots if ignore is None else snapshots.join(ignore.select("id"), "id", "left_anti")
    return used_blobs(kept.select(F.col("tree").alias("tree_id")), nodes)


def unreferenced_roots(index: DataFrame, nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(tree_id) of indexed trees that are neither a subtree of any tree nor a snapshot's root."""
    trees = index.where("blob_type = 'tree'").select(F.col("blob_id").alias("tree_id")).distinct()
    below = nodes.where("subtree IS NOT NULL").select(F.col("subtree").alias("tree_id"))
    return trees.join(below, "tree_id", "left_anti").join(snapshots.select(F.col("tree").alias("tree_id")), "tree_id", "left_anti")


def resolve_folder(root: str, folder: str, nodes: DataFrame) -> str:
    """The tree id of a folder below a root, one lookup a level."""
    at = root
    for k, name in enumerate(p := [x for x in folder.split("/") if x]):
        got = nodes.where((F.col("tree_id") == at) & (F.col("name") == name)).select("type", "subtree").limit(1).collect()
        shown = "/".join(p[: k + 1])
        if not got:
            raise RepositoryError(f"path {shown}: not found")
        if got[0]["type"] != "dir" or got[0]["subtree"] is None:
            raise RepositoryError(f"path {shown}: not a directory")
        at = got[0]["subtree"]
    return at


def find_in_trees(lookups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes by (tree_id, name)."""
    return lookups.select("tree_id", "name").join(nodes, ["tree_id", "name"])


def dual(left: DataFrame, right: DataFrame, on: str = "name") -> DataFrame:
    """Two sorted trees side by side: left and right node structs, either null where missing."""
    a = left.select(on, F.struct("*").alias("left_node"))
    b = right.select(on, F.struct("*").alias("right_node"))
    return a.join(b, on, "full_outer")


def hardlinks(walked: DataFrame) -> DataFrame:
    """The first path, in walk order, of each (snapshot, inode, device) with more than one link."""
    order = Window.partitionBy("snapshot_id", "inode", "device_id").orderBy(F.split("path", "/"))
    linked = walked.where("type <> 'dir' AND links > 1 AND inode <> 0")
    return linked.withColumn("nr", F.row_number().over(order)).where("nr = 1").drop("nr")


def list_tree(walked: DataFrame, folders: tuple[str, ...] = (), recursive: bool = False) -> DataFrame:
    """Entries of folders: themselves, what lies in them and, if ``recursive``, below. No folders: everything."""
    if not folders:
        return walked
    keep = F.lit(False)
    for f in folders:
        inside = within_directory(F.col("path"), f) if recursive else (F.col("path") == f) | (parent_path(F.col("path")) == f)
        keep = keep | inside
    return walked.where(keep)


def find_paths(snapshots: DataFrame, nodes: DataFrame, patterns: list[str], fold: bool = False, newest: str | None = None, oldest: str | None = None) -> DataFrame:
    """Nodes whose path meets a pattern and whose mtime lies in a range, both ends included.

    Directories below which no pattern can match aren't gone into.
    """
    path = F.col("path")
    found = walk(snapshots, nodes, child_may_match_list(path, patterns, fold)).where(matches_list(path, patterns, fold))
    if oldest:
        found = found.where(F.col("mtime") >= required_time(oldest))
    if newest:
        found = found.where(F.col("mtime") <= required_time(newest))
    return found


def found_rows(found: DataFrame) -> DataFrame:
    """What a search shows of nodes: path, permissions and the node without its name, attributes, device, content and subtree."""
    hidden = {"snapshot_id", "path", "depth", "tree_id", "name", "extended_attributes", "generic_attributes", "device", "content", "subtree"}
    mode = F.col("mode") if "mode" in found.columns else F.lit(None).cast("long")
    return found.select("snapshot_id", "path", permissions(mode, F.col("type")).alias("permissions"), *[c for c in found.columns if c not in hidden])


def listed_rows(entries: DataFrame) -> DataFrame:
    """What a listing shows of nodes: fixed columns (null where the store lacks one), the size of files only."""
    shown = ["name", "type", "path", "uid", "gid", "size", "mode", "permissions", "mtime", "atime", "ctime", "inode"]
    mode = F.col("mode") if "mode" in entries.columns else F.lit(None).cast("long")
    made = {"size": F.when(F.col("type") == "file", F.col("size")), "permissions": permissions(mode, F.col("type"))}
    return entries.select("snapshot_id", *[made.get(c, F.col(c) if c in entries.columns else F.lit(None)).alias(c) for c in shown])


def find_blobs(walked: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each time a blob of ids(blob_id) is in a file's content; ids may be short (8 digits)."""
    each = walked.where("type = 'file'").select("snapshot_id", "path", F.posexplode("content").alias("content_pos", "blob_id"))
    short = ids.where(F.length("blob_id") == 8).select(F.col("blob_id").alias("short"))
    full = each.join(ids.select("blob_id").distinct(), "blob_id", "left_semi")
    return full.union(each.join(short, F.substring("blob_id", 1, 8) == F.col("short"), "left_semi").select(full.columns).join(ids, "blob_id", "left_anti"))


def find_trees(snapshots: DataFrame, walked: DataFrame, ids: DataFrame) -> DataFrame:
    """Every place of trees(tree_id): snapshot_id, path; roots are "/".

    All snapshots are searched whole.
    """
    at = snapshots.select(F.col("id").alias("snapshot_id"), F.lit("/").alias("path"), F.col("tree").alias("tree_id"))
    below = walked.where("subtree IS NOT NULL").select("snapshot_id", "path", F.col("subtree").alias("tree_id"))
    return at.union(below).join(ids.select("tree_id").distinct(), "tree_id", "left_semi")


def blobs_of_packs(index: DataFrame, packs: DataFrame) -> DataFrame:
    """(blob_type, blob_id) in packs(pack_id); ids may be short (8 digits). A pack that the index doesn't name is an error."""
    wanted = packs.select(F.col("pack_id").alias("given")).distinct()
    named = index.select("pack_id").distinct()
    found = wanted.join(named, F.col("given") == F.col("pack_id"))
    found = found.union(wanted.where(F.length("given") == 8).join(named, F.col("given") == F.substring("pack_id", 1, 8)))
    lost = wanted.join(found, "given", "left_anti").orderBy("given").limit(5).collect()
    if lost:
        raise RepositoryError("packs are not in the index: " + ", ".join(r.given for r in lost))
    packs = found.select("pack_id").distinct()
    return index.join(packs.select("pack_id"), "pack_id", "left_semi").select("blob_type", "blob_id").distinct()


def first_pack(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """blobs(blob_type, blob_id) with the first pack (by id) that holds each."""
    return index.join(blobs.select("blob_type", "blob_id").distinct(), ["blob_type", "blob_id"]).groupBy("blob_type", "blob_id").agg(F.min("pack_id").alias("pack_id"))


def snapshot_links(snapshots: DataFrame, template: str, time_format: str = "yyyy-MM-dd'T'HH:mm:ss") -> DataFrame:
    """Paths of snapshots by a template: %i short id, %I id, %u user, %h host, %t tag, %T time.

    A snapshot has a path for each tag; equal paths get -1, -2, ... by time and id. A template
    that ends in %T also gives, for each folder, "latest" to its newest snapshot.
    """
    df = snapshots
    if "%t" in template:
        df = df.withColumn("_tag", F.explode_outer(F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("untagged")))))
        df = df.withColumn("_tag", F.coalesce("_tag", F.lit("untagged")))
    fill = {"%i": F.substring("id", 1, 8), "%I": F.col("id"), "%u": F.col("username"), "%h": F.col("hostname"), "%t": F.col("_tag") if "%t" in template else F.lit(""), "%T": F.date_format("time", time_format)}
    import re

    parts = [fill.get(x, F.lit(x)) for x in re.findall(r"%[iIuhtT]|(?:(?!%[iIuhtT]).)+", template)]
    df = df.withColumn("path", F.concat(*parts))
    clash = Window.partitionBy("path").orderBy("time", "id")
    df = df.withColumn("_n", F.row_number().over(clash) - 1)
    named = df.select(F.when(F.col("_n") > 0, F.concat("path", F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col("path")).alias("path"), "id", "time")
    out = named.select("path", "id")
    if template.endswith("%T"):
        folder = F.regexp_replace("path", "[^/]*$", "")
        newest = named.groupBy(folder.alias("folder")).agg(F.max_by("id", F.struct("time", "id")).alias("id"))
        out = out.union(newest.select(F.concat("folder", F.lit("latest")), "id"))
    return out


def read_range(files: DataFrame, sizes: DataFrame, offset: int, length: int) -> DataFrame:
    """Which part of which blob gives bytes [offset, offset+length) of each file.

    files(file_id, pos, blob_id), sizes(blob_id, size): file_id, pos, blob_id, start and stop in the blob.
    """
    order = Window.partitionBy("file_id").orderBy("pos")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = files.join(sizes, "blob_id").withColumn("stop_at", end).withColumn("start_at", F.col("stop_at") - F.col("size"))
    hit = at.where((F.col("start_at") < offset + length) & (F.col("stop_at") > offset))
    start = F.greatest(F.lit(offset) - F.col("start_at"), F.lit(0))
    stop = F.least(F.lit(offset + length) - F.col("start_at"), F.col("size"))
    return hit.select("file_id", "pos", "blob_id", start.alias("start"), stop.alias("stop"))
