"""Plans that change snapshots: tags, rewrites, repairs, recovery and copies. Results are new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalar import parent_path, short_id
from palimpsest.functions.text import required_time
from palimpsest.model import RepositoryError, with_checkpoints
from palimpsest.operators.stats import pack_sizes
from palimpsest.operators.tree import unreferenced_roots, used_blobs

_KEY = ["blob_type", "blob_id"]
_NONE = "array<string>"


def change_tags(snapshots: DataFrame, set_: Sequence[str] = (), add: Sequence[str] = (), remove: Sequence[str] = ()) -> DataFrame:
    """Tags replaced ([""]: none), or added without repeats and removed; with ``changed`` and the first ``original``.

    What is left keeps its order.
    """
    if set_ and (add or remove):
        raise RepositoryError("set can't be combined with add or remove")
    own = F.coalesce("tags", F.array().cast(_NONE))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast(_NONE)
    if set_:
        new = lit([t for t in set_ if t])
    else:
        new = F.concat(own, F.array_except(lit(add), own)) if add else own
        new = F.filter(new, lambda t: ~t.isin(list(remove))) if remove else new
    changed = ~new.eqNullSafe(own)
    original = F.when(changed, F.coalesce("original", "id") if "original" in snapshots.columns else F.col("id")).otherwise(F.col("original") if "original" in snapshots.columns else F.lit(None))
    return snapshots.withColumns({"original": original, "changed": changed, "tags": new})


def assemble_trees(entries: DataFrame) -> DataFrame:
    """Folders hashed bottom-up: per (snapshot_id, path of a folder) its tree id and number of entries.

    entries(snapshot_id, path, type, size, content): a tree id is the SHA-256 of its entries in
    name order, subtrees by their id. One pass a level.
    """
    with_checkpoints(entries.sparkSession)
    rows = entries.select("snapshot_id", "path", "type", "size", "content", F.size(F.split("path", "/")).alias("level"), F.lit(None).cast("string").alias("subtree"))
    rows = rows.dropDuplicates(["snapshot_id", "path"]).checkpoint()
    level = rows.agg(F.max("level")).first()[0] or 1
    hashed, out = rows.where(F.col("level") == level), None
    while level > 1:
        line = F.to_json(F.struct(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "type", F.when(F.col("type") == "file", F.col("size")).alias("size"), "content", "subtree"))
        trees = hashed.groupBy("snapshot_id", parent_path(F.col("path")).alias("path")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("tree_id"), F.count("*").alias("entries")).checkpoint()
        out = trees if out is None else out.union(trees)
        level -= 1
        up = rows.where(F.col("level") == level).join(trees.select("snapshot_id", "path", "tree_id"), ["snapshot_id", "path"], "left")
        hashed = up.withColumn("subtree", F.when(F.col("type") == "dir", F.col("tree_id"))).drop("tree_id")
    return out


def rewrite_entries(walked: DataFrame, exclude: Column | None = None, include: Column | None = None, drop_empty: bool = False) -> DataFrame:
    """Entries left after an exclusion, or an inclusion; what lies below an excluded folder goes too.

    An inclusion keeps the folders above what it keeps; ``drop_empty`` drops folders that end up empty.
    """
    if (exclude is None) == (include is None):
        raise RepositoryError("give either an exclusion or an inclusion")
    ups = lambda c: F.transform(F.sequence(F.lit(2), F.size(F.split(c, "/")) - 1), lambda i: F.array_join(F.slice(F.split(c, "/"), F.lit(1), i), "/"))
    above = lambda df: df.where(F.size(F.split("path", "/")) > 2).select("snapshot_id", F.explode(ups(F.col("path"))).alias("path")).distinct()
    if exclude is not None:
        gone = walked.where(exclude).select("snapshot_id", "path")
        each = walked.select("snapshot_id", F.col("path").alias("own"), F.explode(F.concat(F.when(F.size(F.split("path", "/")) > 2, ups(F.col("path"))).otherwise(F.array().cast(_NONE)), F.array("path"))).alias("path"))
        hit = each.join(gone, ["snapshot_id", "path"], "left_semi").select("snapshot_id", F.col("own").alias("path")).distinct()
        kept = walked.join(hit, ["snapshot_id", "path"], "left_anti")
    else:
        own = walked.where(include)
        kept = walked.join(own.select("snapshot_id", "path").union(above(own)).distinct(), ["snapshot_id", "path"], "left_semi")
    if drop_empty:
        full = above(kept.where("type <> 'dir'"))
        kept = kept.join(full.withColumn("_full", F.lit(True)), ["snapshot_id", "path"], "left").where("type <> 'dir' OR _full").drop("_full")
    return kept


def rewrite_snapshots(snapshots: DataFrame, before: DataFrame, after: DataFrame, forget: bool = False, hostname: str | None = None, time: str | None = None) -> DataFrame:
    """Per snapshot: action (unchanged, rewrite, remove), files and bytes left, and ``original`` where the old one stays.

    With a new ``hostname`` or ``time`` (both given as well then, new or old) a snapshot is rewritten though its entries are unchanged.
    """
    n = lambda df, a: df.groupBy(F.col("snapshot_id").alias("id")).agg(F.count("*").alias(a), F.count_if(F.col("type") == "file").alias(f"{a}_files"), F.coalesce(F.sum(F.when(F.col("type") == "file", F.col("size"))), F.lit(0)).cast("long").alias(f"{a}_bytes"))
    both = snapshots.select("id").join(n(before, "old"), "id", "left").join(n(after, "new"), "id", "left").fillna(0)
    other = hostname is not None or time is not None
    action = F.when((F.col("old") == F.col("new")) & F.lit(not other), "unchanged").when((F.col("new") == 0) & (F.col("old") > 0), "remove").otherwise("rewrite")
    out = both.select("id", action.alias("action"), F.col("new_files").alias("files"), F.col("new_bytes").alias("bytes"), F.when((action == "rewrite") & F.lit(not forget), F.col("id")).alias("original"))
    if not other:
        return out
    own = {c: F.col(c) if c in snapshots.columns else F.lit(None) for c in ("hostname", "time")}
    new = [F.lit(hostname).alias("hostname") if hostname is not None else own["hostname"].alias("hostname"), required_time(time).alias("time") if time is not None else own["time"].cast("timestamp").alias("time")]
    return out.join(snapshots.select("id", *new), "id")


def repair_nodes(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Nodes of valid type with the contents that are indexed, their sizes corrected; with ``repaired``.

    Folders whose tree isn't indexed become empty (no subtree).
    """
    from palimpsest.functions.scalar import plain_length
    from palimpsest.model import NODE_TYPES

    size = index.where("blob_type = 'data'").groupBy("blob_id").agg(F.min(plain_length(F.col("length"), F.col("uncompressed_length"))).alias("plain"))
    each = nodes.where("type = 'file'").select("tree_id", "name", F.posexplode("content").alias("p", "blob_id")).join(size, "blob_id", "left")
    left = each.groupBy("tree_id", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("plain").isNotNull(), F.struct("p", "blob_id")))), lambda x: x.blob_id).alias("_content"),
        F.coalesce(F.sum("plain"), F.lit(0)).cast("long").alias("_size"), F.count_if(F.col("plain").isNull()).alias("_lost"),
    )
    known = index.where("blob_type = 'tree'").select(F.col("blob_id").alias("subtree")).distinct().withColumn("_known", F.lit(True))
    df = nodes.where(F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False))).join(left, ["tree_id", "name"], "left").join(known, "subtree", "left")
    lost = F.coalesce(F.col("_lost"), F.lit(0)) > 0
    bare = (F.col("type") == "dir") & F.col("_known").isNull()
    return df.select(
        "tree_id", "name", "type", F.when(lost, F.col("_size")).otherwise(F.col("size")).alias("size"), F.when(lost, F.col("_content")).otherwise(F.col("content")).alias("content"),
        F.when(~bare, F.col("subtree")).alias("subtree"), (lost | bare).alias("repaired"),
    )


def repair_index(index: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: read (unknown, or of another size than indexed), drop (not there) or keep."""
    both = pack_sizes(index).withColumnRenamed("size", "expected").join(packs, "pack_id", "full_outer")
    action = F.when(F.col("size").isNull(), "drop").when(F.col("expected").eqNullSafe(F.col("size")), "keep").otherwise("read")
    return both.select("pack_id", action.alias("action"))


def salvage_blobs(listed: DataFrame, index: DataFrame, blob_data: DataFrame) -> DataFrame:
    """Blobs of damaged packs, by index or header, whose data still has their hash."""
    named = listed.select(*_KEY).union(index.select(*_KEY)).distinct()
    return named.join(blob_data.where(F.sha2("data", 256) == F.col("blob_id")), _KEY, "left_semi")


def recover(index: DataFrame, nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The root of a snapshot of all unreferenced trees: a folder for each, named by its short id, in name order."""
    roots = unreferenced_roots(index, nodes, snapshots)
    return roots.select(short_id(F.col("tree_id")).alias("name"), F.lit("dir").alias("type"), F.col("tree_id").alias("subtree")).orderBy("name", "subtree")


def copy_plan(source: DataFrame, target: DataFrame, similar: Sequence[str] = ("time", "hostname", "paths", "tags")) -> DataFrame:
    """Source snapshots with ``copied``: whether the target has one of the same original id and equal fields."""
    first = lambda df: F.coalesce("original", "id") if "original" in df.columns else F.col("id")
    there = target.select(first(target).alias("_original"), *[F.col(c).alias(f"_{c}") for c in similar])
    on = first(source) == F.col("_original")
    for c in similar:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    done = source.join(there, on, "left_semi").select("id").withColumn("copied", F.lit(True))
    return source.join(done, "id", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))


def blobs_to_copy(roots: DataFrame, nodes: DataFrame, index: DataFrame, target_index: DataFrame) -> DataFrame:
    """Blobs that roots reach and the target lacks, with the length of their first copy."""
    from palimpsest.operators.stats import first_copy

    need = used_blobs(roots, nodes).join(target_index.select(*_KEY).distinct(), _KEY, "left_anti")
    return first_copy(index).join(need, _KEY, "left_semi").select(*_KEY, "length")
