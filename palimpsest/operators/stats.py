"""Statistics over walked snapshots and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalar import entry_length, plain_length
from palimpsest.model import HEADER

_KEY = ["blob_type", "blob_id"]


def restore_size(walked: DataFrame) -> DataFrame:
    """Per snapshot: all nodes, and the bytes a restore writes (hard links once)."""
    once = (F.col("links") == 1) | (F.col("type") == "dir") | (F.col("inode") == 0)
    kinds = walked.groupBy("snapshot_id", F.when(once, F.lit(None)).otherwise(F.struct("inode", "device_id")).alias("link"))
    first = kinds.agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min_by("size", F.split("path", "/")).alias("one"))
    size = F.when(F.col("link").isNull(), F.col("all")).otherwise(F.col("one"))
    return first.groupBy("snapshot_id").agg(F.sum("n").alias("total_file_count"), F.sum(size).cast("long").alias("total_size"))


def files_by_contents(walked: DataFrame) -> DataFrame:
    """Different contents and the size of the first node of each; all nodes without content are one."""
    content = F.sha2(F.concat_ws("", F.coalesce("content", F.array().cast("array<string>"))), 256)
    first = walked.groupBy(content.alias("c")).agg(F.min_by("size", F.struct("snapshot_id", F.split("path", "/"))).alias("size"))
    return first.agg(F.count("*").alias("total_file_count"), F.sum("size").cast("long").alias("total_size"))


def first_copy(index: DataFrame) -> DataFrame:
    """One row a blob: its copy in the first pack."""
    order = Window.partitionBy(*_KEY).orderBy("pack_id", "index_id")
    return index.withColumn("_nr", F.row_number().over(order)).where("_nr = 1").drop("_nr")


def blobs_per_file(walked: DataFrame, index: DataFrame) -> DataFrame:
    """Of the first node of each content: files with blobs, (path, blob) pairs and their plaintext bytes."""
    full = walked.where(F.size("content") > 0)
    order = Window.partitionBy(F.sha2(F.concat_ws("", "content"), 256)).orderBy("snapshot_id", F.split("path", "/"))
    first = full.withColumn("_nr", F.row_number().over(order)).where("_nr = 1")
    pairs = first.select("path", F.explode("content").alias("blob_id")).distinct()
    size = first_copy(index.where("blob_type = 'data'")).select("blob_id", plain_length(F.col("length"), F.col("uncompressed_length")).alias("size"))
    return pairs.join(size, "blob_id", "left").agg(F.count_distinct("path").alias("total_file_count"), F.count("*").alias("total_blob_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def raw_data(used: DataFrame, index: DataFrame) -> DataFrame:
    """Stored and uncompressed bytes of used blobs, and the ratios derived from them."""
    c = first_copy(index).join(used, _KEY, "left_semi")
    packed = F.col("uncompressed_length") > 0
    plain = plain_length(F.col("length"), F.col("uncompressed_length"))
    total = c.agg(
        F.count("*").alias("total_blob_count"), F.sum("length").cast("long").alias("total_size"), F.sum(plain + 32).cast("long").alias("total_uncompressed_size"),
        F.coalesce(F.sum(F.when(packed, F.col("length"))), F.lit(0)).cast("long").alias("compressed_size"),
        F.coalesce(F.sum(F.when(packed, plain + 32)), F.lit(0)).cast("long").alias("compressed_plain"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return total.select(
        "total_blob_count", "total_size", "total_uncompressed_size",
        ratio("compressed_plain", "compressed_size").alias("compression_ratio"),
        (ratio("compressed_plain", "total_uncompressed_size") * 100).alias("compression_progress"),
        F.when(F.col("total_uncompressed_size") > 0, (1 - F.col("total_size") / F.col("total_uncompressed_size")) * 100).alias("compression_space_saving"),
    )


def size_classes(limit: int) -> list[tuple[int, int]]:
    """0, then [1, 9], [10, 99], ... up to the limit."""
    out, low = [(0, 0)], 1
    while low <= limit:
        out.append((low, min(low * 10 - 1, limit)))
        low *= 10
    return out


def size_histogram(sizes: DataFrame, limit: int, col: str = "size") -> DataFrame:
    """Count and sum in each class; sizes above the limit have class null."""
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for a, b in size_classes(limit):
        inside = F.col(col).between(a, b)
        low, high = F.when(inside, F.lit(a)).otherwise(low), F.when(inside, F.lit(b)).otherwise(high)
    return sizes.groupBy(low.cast("long").alias("low"), high.cast("long").alias("high")).agg(F.count("*").alias("files"), F.sum(col).cast("long").alias("bytes"))


def entry_counts(entries: DataFrame) -> DataFrame:
    """Files, folders and others with the files' bytes (a scan before a backup)."""
    t = F.col("type")
    return entries.agg(
        F.count_if(t == "file").alias("files"), F.count_if(t == "dir").alias("dirs"), F.count_if(~t.isin("file", "dir")).alias("others"),
        F.coalesce(F.sum(F.when(t == "file", F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
    )


def pack_sizes(index: DataFrame) -> DataFrame:
    """(pack_id, size): what a pack must measure, of index rows without repeats."""
    return index.select("pack_id", *_KEY, "length", "uncompressed_length").distinct().groupBy("pack_id").agg((HEADER + F.sum(F.col("length") + entry_length(F.col("uncompressed_length")))).cast("long").alias("size"))


def pack_types(index: DataFrame) -> DataFrame:
    """(pack_id, pack_type): data, tree or mixed."""
    low, high = F.min("blob_type"), F.max("blob_type")
    return index.groupBy("pack_id").agg(F.when(low == high, low).otherwise("mixed").alias("pack_type"))


def surviving_size(walked: DataFrame, keep: Column) -> DataFrame:
    """Files and bytes that a rewrite keeps."""
    return walked.where((F.col("type") == "file") & keep).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def blobs_by_pack(index: DataFrame) -> DataFrame:
    """Per pack: blobs, bytes, and the list of its blobs (type, id, length) in order."""
    row = F.struct("blob_type", "blob_id", "length")
    return index.groupBy("pack_id").agg(F.count("*").alias("blobs"), F.sum("length").cast("long").alias("bytes"), F.array_sort(F.collect_list(row)).alias("listed"))
