"""Differences between two snapshots: changed paths and blob statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalar import join_path, plain_length
from palimpsest.model import with_checkpoints
from palimpsest.operators.tree import used_blobs


def same_node(left: str, right: str, columns: list[str], skip: tuple[str, ...] = ()) -> Column:
    """Null-safe equality of two node structs; attribute lists count as sets."""
    out = F.lit(True)
    for c in columns:
        if c in ("tree_id", *skip):
            continue
        a, b = F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
        if c == "extended_attributes":
            a, b = F.array_sort(a), F.array_sort(b)
        if c == "generic_attributes":
            a, b = F.array_sort(F.map_entries(a)), F.array_sort(F.map_entries(b))
        out = out & a.eqNullSafe(b)
    return out


def diff_trees(root_a: str, root_b: str, nodes_a: DataFrame, nodes_b: DataFrame, metadata: bool = False) -> DataFrame:
    """Changed paths: path, change ("+", "-", "T", "M", "M?", "U") and both types.

    Folders with equal subtree ids are not gone into. A folder that becomes a file, or back, is one
    "T" row, without its children. Folders end in "/".
    """
    spark = with_checkpoints(nodes_a.sparkSession)
    cols = nodes_a.columns
    front = spark.createDataFrame([("/", root_a, root_b)], "up string, ta string, tb string")
    out = None
    while True:
        a = front.join(nodes_a, F.col("ta") == F.col("tree_id")).select("up", "name", F.struct(*cols).alias("a"))
        b = front.join(nodes_b, F.col("tb") == F.col("tree_id")).select("up", "name", F.struct(*cols).alias("b"))
        both = a.join(b, ["up", "name"], "full_outer").withColumn("path", join_path(F.col("up"), F.col("name"))).checkpoint()
        out = both if out is None else out.union(both)
        dir_a, dir_b = F.coalesce(F.col("a.type") == "dir", F.lit(False)), F.coalesce(F.col("b.type") == "dir", F.lit(False))
        one = F.col("a").isNull() | F.col("b").isNull()
        go = (dir_a & dir_b & ~F.col("a.subtree").eqNullSafe(F.col("b.subtree"))) | (one & (dir_a | dir_b))
        below = both.where(go)
        front = below.select(F.col("path").alias("up"), F.when(dir_a, F.col("a.subtree")).alias("ta"), F.when(dir_b, F.col("b.subtree")).alias("tb"))
        if below.isEmpty():
            break
    type_a, type_b = F.col("a.type"), F.col("b.type")
    files = (type_a == "file") & (type_b == "file")
    modified = files & ~F.col("a.content").eqNullSafe(F.col("b.content"))
    rest = same_node("a", "b", cols, ("content",))
    mark = (
        F.when(F.col("a").isNull(), "+")
        .when(F.col("b").isNull(), "-")
        .otherwise(F.concat(F.when(type_a != type_b, "T").otherwise(""), F.when(modified, F.when(rest, "M?").otherwise("M")).when(F.lit(metadata) & ~same_node("a", "b", cols), "U").otherwise("")))
    )
    last = F.coalesce(type_b, type_a)
    shown = F.when(last == "dir", F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    return out.select(shown.alias("path"), mark.alias("change"), type_a.alias("type_a"), type_b.alias("type_b")).where("change <> ''")


def diff_counts(changes: DataFrame) -> DataFrame:
    """Added and removed files, folders and others, and changed files."""
    kind = lambda c: F.when(F.col(c) == "file", "files").when(F.col(c) == "dir", "dirs").otherwise("others")
    row = changes.select("change", kind("type_a").alias("ka"), kind("type_b").alias("kb"))
    n = lambda cond, name: F.count_if(cond).alias(name)
    c = F.col("change")
    added = [n((c == "+") & (F.col("kb") == k), f"{k}_added") for k in ("files", "dirs", "others")]
    removed = [n((c == "-") & (F.col("ka") == k), f"{k}_removed") for k in ("files", "dirs", "others")]
    return row.agg(n(c.contains("M"), "changed_files"), *added, *removed)


def diff_blobs(root_a: str, root_b: str, nodes_a: DataFrame, nodes_b: DataFrame, index: DataFrame) -> DataFrame:
    """Blobs only one side uses, by side and type: count, plaintext bytes, and how many have no known size."""
    spark = nodes_a.sparkSession
    root = lambda r: spark.createDataFrame([(r,)], "tree_id string")
    a, b = used_blobs(root(root_a), nodes_a).checkpoint(), used_blobs(root(root_b), nodes_b).checkpoint()
    key = ["blob_type", "blob_id"]
    only = a.join(b, key, "left_anti").withColumn("side", F.lit("removed")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("added")))
    size = index.groupBy(*key).agg(F.min(F.struct("pack_id", plain_length(F.col("length"), F.col("uncompressed_length")).alias("size"))).alias("first"))
    sized = only.join(size, key, "left")
    return sized.groupBy("side", "blob_type").agg(F.count("*").alias("blobs"), F.coalesce(F.sum("first.size"), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("first").isNull()).alias("unknown"))
