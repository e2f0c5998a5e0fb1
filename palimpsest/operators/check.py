"""Integrity checks over index, packs, trees and blob data. Each gives rows of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalar import blob_hash
from palimpsest.model import NODE_TYPES, RepositoryError
from palimpsest.operators.stats import pack_sizes, pack_types
from palimpsest.operators.tree import reachable_trees, used_blobs

_KEY = ["blob_type", "blob_id"]
NULL_ID = "0" * 64


def index_findings(index: DataFrame) -> DataFrame:
    """(pack_id, finding): packs that indexes disagree on, that are in several, and mixed ones."""
    rows = F.array_sort(F.collect_list(F.struct("blob_type", "blob_id", "offset" if "offset" in index.columns else F.lit(0).alias("offset"), "length", "uncompressed_length")))
    per = index.groupBy("pack_id", "index_id").agg(F.sha2(F.to_json(rows), 256).alias("digest"))
    packs = per.groupBy("pack_id").agg(F.count_distinct("digest").alias("digests"), F.count("*").alias("indexes"))
    differ = packs.where("digests > 1").select("pack_id", F.lit("incomplete").alias("finding"))
    several = packs.where("indexes > 1").select("pack_id", F.lit("several indexes").alias("finding"))
    return differ.union(several).union(pack_types(index).where("pack_type = 'mixed'").select("pack_id", F.lit("mixed").alias("finding")))


def pack_findings(index: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, finding, expected, found): missing, truncated and orphaned packs."""
    want = pack_sizes(index).withColumnRenamed("size", "expected")
    both = want.join(packs.select("pack_id", F.col("size").alias("found")), "pack_id", "full_outer")
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "orphaned").when(F.col("expected") != F.col("found"), "truncated")
    return both.select("pack_id", kind.alias("finding"), "expected", "found").where("finding IS NOT NULL")


def tree_findings(roots: DataFrame, nodes: DataFrame, index: DataFrame) -> DataFrame:
    """(tree_id, name, finding) of each reachable tree, once: bad types, names, contents and subtrees, and trees that aren't there."""
    trees = reachable_trees(roots, nodes)
    own = nodes.join(trees, "tree_id", "left_semi")
    say = lambda df, text: df.select("tree_id", "name", F.lit(text).alias("finding"))
    out = say(own.where("name IS NULL OR name = ''"), "empty name")
    out = out.union(say(own.where(~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False))), "invalid type"))
    out = out.union(say(own.where("type = 'file' AND content IS NULL"), "no content"))
    out = out.union(say(own.where("type = 'dir' AND subtree IS NULL"), "no subtree"))
    out = out.union(say(own.where((F.col("type") == "dir") & (F.col("subtree") == NULL_ID)), "null subtree"))
    each = own.where("type = 'file'").select("tree_id", "name", F.explode("content").alias("blob_id"))
    out = out.union(say(each.where(F.col("blob_id") == NULL_ID), "null blob"))
    data = index.where("blob_type = 'data'").select("blob_id").distinct()
    out = out.union(say(each.where(F.col("blob_id") != NULL_ID).join(data, "blob_id", "left_anti"), "blob not in index"))
    known = index.where("blob_type = 'tree'").select(F.col("blob_id").alias("tree_id"))
    lost = trees.join(known, "tree_id", "left_anti").select("tree_id", F.lit(None).cast("string").alias("name"), F.lit("tree not in index").alias("finding"))
    return out.union(lost)


def unused_blobs(index: DataFrame, used: DataFrame) -> DataFrame:
    return index.select(*_KEY).distinct().join(used, _KEY, "left_anti")


def data_findings(blob_data: DataFrame) -> DataFrame:
    """Blobs whose data doesn't have their id as its hash."""
    return blob_data.where(blob_hash(F.col("data")) != F.col("blob_id")).select(*_KEY)


def layout_findings(index: DataFrame) -> DataFrame:
    """(pack_id, blob_id, gap): blobs that don't start where the one before ended; overlaps are negative."""
    order = Window.partitionBy("pack_id").orderBy("offset", "blob_id")
    gap = F.col("offset") - F.coalesce(F.lag(F.col("offset") + F.col("length")).over(order), F.lit(0))
    return index.select("pack_id", "blob_id", gap.alias("gap")).where("gap <> 0")


def pack_bucket(pack_id: Column, n: int, total: int) -> Column:
    """Whether a pack is in part n of total, by the first byte of its id."""
    if not 1 <= n <= total <= 256:
        raise RepositoryError("n/t must be in 1/t..t/t with t at most 256")
    return F.conv(F.substring(pack_id, 1, 2), 16, 10).cast("int") % total == n - 1


def random_packs(packs: DataFrame, share: float | None = None, size: int | None = None, seed: int = 0) -> DataFrame:
    """A random part of the packs by share or bytes, one at least; the order is a hash with a seed."""
    order = F.xxhash64("pack_id", F.lit(seed))
    if share is not None:
        n = max(1, int(packs.count() * share))
    else:
        total, count = packs.agg(F.sum("size"), F.count("*")).first()
        n = max(1, int(count * min(1.0, size / total))) if total else 1
    return packs.orderBy(order, "pack_id").limit(n)


def packs_of_snapshots(roots: DataFrame, nodes: DataFrame, index: DataFrame) -> DataFrame:
    """(pack_id) of all packs that hold a blob the roots reach."""
    return index.join(used_blobs(roots, nodes), _KEY, "left_semi").select("pack_id").distinct()


def summary(index: DataFrame, packs: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check, finding, n) of all table checks."""
    count = lambda df, name: df.groupBy("finding").count().select(F.lit(name).alias("check"), "finding", F.col("count").alias("n"))
    unused = unused_blobs(index, used_blobs(roots, nodes)).withColumn("finding", F.lit("unused"))
    return count(index_findings(index), "index").union(count(pack_findings(index, packs), "packs")).union(count(tree_findings(roots, nodes, index), "trees")).union(count(unused, "blobs"))
